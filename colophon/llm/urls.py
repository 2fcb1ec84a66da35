"""URL filter: host rules first, then words of the host and path scored by naive Bayes.

Names in a host are often words run together.  A unigram Viterbi splits each into its most likely
words.  The dictionary is counted over all hosts, each once, and seed words; a part of a host that
is itself words run together counts for those words and never as one of its own.  The dictionary
stays in Spark: each name meets, by a join, those of its substrings that are words.

A multinomial naive Bayes over the words of host and path then tells blocked urls from others.  It
is fitted on at most ``sample`` distinct urls, those whose hashes are least, labelled by the seed
words; the host's segments and all path tokens, seed words or not, get their weights from them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm.common import ascii_lower, mapped, table
from colophon.session import reuse

# Words that mark a url as unwanted, and common words of urls.
BLOCK_WORDS = "adult ads bet bets betting casino cheap click escort farm free gambling jackpot loan pharmacy pills poker popup porn sex slots spam track tracker tracking viagra win xxx".split()
PLAIN_WORDS = "about archive article blog book catalog city contact data docs edu example forum game guide help home image info journal library list mail map market media mobile museum music news page photo post press report research review school science search shop sport static store story time tv university video weather web wiki world".split()
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SEEDS = frozenset([*BLOCK_WORDS, *PLAIN_WORDS])
SEED_COUNT = 20
#: letters of a word of the dictionary that is no seed word
SHORTEST, LONGEST = 2, 12
TOKEN = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.  Ties go to the first by code point."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, result in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last one asked wins
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(result)).otherwise(verdict)
    return name, verdict


@dataclass
class Words:
    """Unigram dictionary and the most likely split of a name."""

    counts: Counter
    known: dict[str, list[str]] = field(default_factory=dict)
    total: int = 0  # of the whole dictionary, if ``counts`` is a part of it

    def __post_init__(self):
        self.total = self.total or sum(self.counts.values()) + 1
        self.longest = max(map(len, self.counts), default=1)

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        # a word that was never met costs more with each letter
        return -math.log(n / self.total) if n else math.log(self.total) + 3.0 * len(word) + 2.0

    def split(self, name: str) -> list[str]:
        if name in self.known:
            return self.known[name]
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = [(best[start] + self.cost(name[start:end]), start) for start in range(max(0, end - max(self.longest, 1)), end)]
            if end == len(name) and end > self.longest:
                options.append((self.cost(name), 0))
            least = min(options)
            best.append(least[0])
            cut.append(least[1])
        out, end = [], len(name)
        while end:
            out.append(name[cut[end] : end])
            end = cut[end]
        if len(self.known) >= 100_000:
            self.known.clear()
        self.known[name] = out[::-1]
        return self.known[name]


def names_in(text: str) -> list[str]:
    """Parts of a host or a lower-case path in order; a number is ``#``."""
    return [part if part[0].isalpha() else "#" for part in TOKEN.findall(text)]


def run_together(name: str, pieces: list[str], counts: dict[str, int]) -> bool:
    """Whether a name's best split without itself makes it words run together, not a word of its own.

    Each piece is a seed word or has four letters at least, and half of the letters are in known words.
    """
    if name in SEEDS or len(pieces) < 2 or any(p not in SEEDS and len(p) < 4 for p in pieces):
        return False
    return 2 * sum(len(p) for p in pieces if p in counts or p in SEEDS) >= len(name)


def _column_of(rows: DataFrame, work: Callable[[dict], Iterator[str]], name: str) -> DataFrame:
    """One string column with what ``work`` makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for r in batch.to_pylist() for x in work(r)], pa.string())], [name])

    return mapped(rows, run, f"{name} string")


def host_words(hosts: DataFrame) -> DataFrame:
    """``word`` and ``n``: the number of distinct hosts with it as a part, and the seed words."""
    parts = _column_of(hosts.select("host").distinct(), lambda r: {p for p in names_in(r["host"]) if p != "#" and SHORTEST <= len(p) <= LONGEST}, "word")
    seeds = hosts.sparkSession.createDataFrame([(w, SEED_COUNT) for w in sorted(SEEDS)], "word string, n bigint")
    return parts.groupBy("word").agg(F.count("*").alias("n")).unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def splits(names: DataFrame, words: DataFrame, own: bool) -> DataFrame:
    """``name``, its ``pieces`` and whether it is ``run_together``, for distinct names.

    Names meet the words among their substrings, themselves only if ``own``.
    """
    total = (words.agg(F.sum("n")).first()[0] or 0) + 1

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = sorted({name[i:j] for i in range(len(name)) for j in range(i + SHORTEST, min(len(name), i + LONGEST) + 1)} - (set() if own else {name}))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string())], ["name", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            counts = [{w["word"]: w["n"] for w in r["found"] or []} for r in rows]
            pieces = [Words(Counter(c), total=total).split(r["name"]) for r, c in zip(rows, counts)]
            joined = [run_together(r["name"], p, c) for r, p, c in zip(rows, pieces, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(pieces, pa.list_(pa.string())), pa.array(joined, pa.bool_())], ["name", "pieces", "run_together"])

    met = mapped(names.select("name"), inside, "name string, word string").join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return mapped(names.select("name").join(met, "name", "left"), cut, "name string, pieces array<string>, run_together boolean")


def dictionary(hosts: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all hosts; what is run together counts for its words."""
    counted = reuse(host_words(hosts), "host_words")
    judged_words = splits(counted.select(F.col("word").alias("name")), counted, own=False)
    found = counted.join(judged_words, F.col("word") == F.col("name"))
    words = F.when(F.col("run_together"), F.col("pieces")).otherwise(F.array("word"))
    return found.select(F.explode(words).alias("word"), "n").filter(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    weight: dict[str, float]  # log odds for blocking, by token
    prior: float

    def odds_of(self, pieces: list[str], mark: str) -> float:
        return sum(self.weight.get(mark + w, 0.0) for w in pieces)


def fit(urls: list[tuple[str, str]], pieces: dict[str, list[str]]) -> Model:
    """Weights of the tokens of some urls, each a host and a path, by the splits of their names.

    Words of the path are marked with a slash; numbers count as one token.
    """
    block, seen, n = set(BLOCK_WORDS), {True: Counter(), False: Counter()}, Counter()
    for host, path in urls:
        found = [w for x in names_in(host) for w in pieces.get(x, [x])] + ["/" + w for x in names_in(path.lower()) for w in pieces.get(x, [x])]
        bad = any(t.lstrip("/") in block for t in found)
        n[bad] += 1
        seen[bad].update(found)
    # each seed word is one example of its kind, so that the fit never lacks one
    seen[True].update(BLOCK_WORDS)
    seen[False].update(PLAIN_WORDS)
    n.update({True: 1, False: 1})
    vocabulary = set(seen[True]) | set(seen[False])
    size = {k: sum(v.values()) + len(vocabulary) for k, v in seen.items()}
    weight = {t: math.log((seen[True][t] + 1) / size[True]) - math.log((seen[False][t] + 1) / size[False]) for t in vocabulary}
    return Model(weight, math.log(n[True] / n[False]))


def sampled(pairs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """The distinct urls of the least hashes, ``sample`` at most; tasks send about that many in all."""
    n, order = pairs.count(), F.xxhash64("host", "path")
    few = pairs.filter("host <> ''").withColumn("_order", order)
    if n > 2 * sample:
        part = few.filter(F.col("_order") < F.lit(int(-(2**63) + 2**64 * 1.5 * sample / n)))
        few = part if part.count() >= sample else few
    return [(r["host"], r["path"]) for r in few.orderBy("_order", "host", "path").limit(sample).collect()]


def scored(pairs: DataFrame, sample: int) -> DataFrame:
    """``host``, ``path`` and ``odds`` of distinct urls."""
    names = reuse(_column_of(pairs, lambda r: {x for t in (r["host"], r["path"].lower()) for x in names_in(t) if x != "#"}, "name").distinct(), "names")
    found = reuse(splits(names, reuse(dictionary(pairs.filter("host <> ''")), "dictionary"), own=True), "splits")
    urls = sampled(pairs, sample)
    asked = pairs.sparkSession.createDataFrame([(x,) for x in sorted({x for h, p in urls for x in [*names_in(h), *names_in(p.lower())]})], "name string")
    pieces = {r["name"]: r["pieces"] for r in found.join(asked, "name", "left_semi").collect()} | {"#": ["#"]}
    model = fit(urls, pieces)
    # names of the sample, the frequent ones among them, need no join
    known = {mark + x: model.odds_of(p, mark) for x, p in pieces.items() for mark in ("", "/")}

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [[*names_in(h), *("/" + x for x in names_in(p.lower()))] for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            part = pa.array([model.prior + sum(known.get(t, 0.0) for t in own) for own in tokens], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), part, pa.array([[t for t in own if t not in known] for own in tokens], pa.list_(pa.string()))], ["host", "path", "part", "others"])

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(mark + r["name"], odds) for r in batch.to_pylist() for mark in ("", "/") if (odds := model.odds_of(r["pieces"], mark))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([o for _, o in rows], pa.float64())], ["token", "odds"])

    begun = reuse(mapped(pairs, some, "host string, path string, part double, others array<string>"), "begun")
    rest = begun.select("host", "path", F.explode("others").alias("token")).join(mapped(found, other, "token string, odds double"), "token")
    # added in one order, so that runs agree
    added = rest.groupBy("host", "path").agg(F.aggregate(F.sort_array(F.collect_list("odds")), F.lit(0.0), lambda a, b: a + b).alias("more"))
    return begun.join(added, ["host", "path"], "left").select("host", "path", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("odds"))


def judged(pages: DataFrame, rules=RULES, sample: int = 20_000) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the ``score`` of the words, 0 to 1, of every row.

    A null url, or one without ``://``, has an empty host and path and no word, and is allowed.
    """
    rows = reuse(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    some = F.expr("host <> '' or path <> ''")
    odds = scored(reuse(rows.filter(some).select("host", "path").distinct(), "pairs"), sample)
    all_rows = rows.filter(some).join(odds, ["host", "path"]).unionByName(rows.filter(~some).withColumn("odds", F.lit(-50.0)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("odds")))))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return all_rows.withColumn("score", score).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract: host, path, rule and verdict of every page's url."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))
