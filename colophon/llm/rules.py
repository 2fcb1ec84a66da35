"""Quality rules: measure once, store failure bits, decide by versioned policies.

``ledger`` measures each text and evaluates every rule once; the result has the measurements and
one bit a failed rule.  A policy is a named set of rules, so a new version, the effect of leaving a
rule out, and overlaps of rules are bitwise work on the stored ledger and never read a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm.common import WORD, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lettered", "n_shouts")

#: a word with two capital letters at least and no small one; a word with a letter
CAPITALS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{Ll}\p{Lu}]*+\p{Lu}[^\x20\x09-\x0D\p{Ll}\p{Lu}]*+\p{Lu}[^\x20\x09-\x0D\p{Ll}]*+(?![^\x20\x09-\x0D])"
LETTERED = r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition on the measurements.  The bit never changes once a ledger is stored."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 2 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_words"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(5, "capitals", "10 * n_capitals > 4 * n_words"),
    Rule(6, "no_letters", "10 * n_lettered < 6 * n_words"),
    Rule(7, "shouting", "10 * n_shouts > 3 * n_words"),
)
BITS = {r.name: 1 << r.bit for r in RULES}

#: A stored decision names its version, so a version is never edited; a change is a new one.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "2024-1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"),
    "2024-2": tuple(r.name for r in RULES),
}
CURRENT = "2024-2"


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _repeated(windows: str) -> str:
    """Words in windows that occur twice or more, from the ordered list of (hash, place) of all windows."""
    again = f"filter(transform({windows}, (x, i) -> if((i > 0 and x.h = {windows}[i - 1].h) or (i + 1 < size({windows}) and x.h = {windows}[i + 1].h), x.i, -1)), i -> i >= 0)"
    return f"sort_array({again})"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the measurements as longs; columns of these names are replaced.

    Null counts as an empty text, for which all are 0.  Every row stays.
    """
    base = docs.drop(*MEASURES)
    words = base.withColumn("_words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(WORD))
    hashed = words.withColumns({
        "_lines": lines,
        "_hashes": F.expr("if(size(_words) < 4, array(), transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2])))").cast("array<bigint>"),
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.aggregate("_words", F.lit(0), lambda n, w: n + F.length(w)).cast("bigint"),
        "n_symbols": F.coalesce(F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("bigint"),
        "n_capitals": F.coalesce(F.regexp_count(F.col(text), F.lit(CAPITALS)), F.lit(0)).cast("bigint"),
        "n_lettered": F.coalesce(F.regexp_count(F.col(text), F.lit(LETTERED)), F.lit(0)).cast("bigint"),
        "n_shouts": F.coalesce(F.regexp_count(F.col(text), F.lit(r"!!+")), F.lit(0)).cast("bigint"),
    })
    # few texts repeat a window: only those sort their windows
    windows = F.expr("if(size(array_distinct(_hashes)) = size(_hashes), array(), array_sort(transform(_hashes, (h, i) -> struct(h, i))))").cast("array<struct<h:bigint,i:int>>")
    placed = hashed.withColumns({"_windows": windows, "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")}).drop("_words", "_lines", "_hashes")
    at = placed.withColumn("_at", F.expr(_repeated("_windows"))).drop("_windows")
    covered = F.expr("aggregate(_at, struct(0 as n, -3 as last), (s, i) -> struct(s.n + least(3, i - s.last), i), s -> s.n)")
    return at.withColumn("n_repeat_words", covered.cast("bigint")).select(*base.columns, *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with measurements and ``failed``, the bits of the rules that fail."""
    rows = measured(docs, text).drop("failed")
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("failed", total)


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: the rows that fail it, those that fail only it, and those kept without it.

    Rows are first counted by their bits, so at most 2**rules rows meet in the last step.
    """
    whole = mask(policy)
    by_bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("bigint").alias("bit")) for name in POLICIES[policy]])
    each = by_bits.withColumn("_r", F.explode(rules)).select("bits", "n", "_r.rule", "_r.bit")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("bigint")
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    text = f"_c{docs.columns.index('text')}"
    # the partition number keeps the filter above the measurements, which would be computed anew in it
    kept = ledger(docs.select(*columns), text).withColumn("_part", F.spark_partition_id()).filter(passes(policy) & (F.col("_part") >= 0))
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract: measurements, base decision and verdict of every document, with its failure bits."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes(CURRENT).alias("kept"), "failed")


#: words and windows as rows; the rest by regular expression
OP4_SQL = r"""
with docs as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
lists as (select *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') as ws from docs),
words as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from lists),
windows as (select r, i, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by r order by i)),
marked as (select r, i, count(*) over (partition by r, w, w2, w3) > 1 as again from windows where w3 is not null),
covered as (select r, count(distinct i + k) as n from marked, (values (0), (1), (2)) v(k) where again group by r),
lines as (select r, count(*) - count(distinct l) as n from (select r, unnest(string_split(t, chr(10))) as l from docs) where regexp_matches(l, '[^ \t\n\x0B\f\r]') group by r),
m as (select l.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
  len(list_filter(ws, lambda w: not regexp_matches(w, '\p{Ll}') and len(regexp_extract_all(w, '\p{Lu}')) >= 2)) as n_capitals,
  len(list_filter(ws, lambda w: regexp_matches(w, '\p{L}'))) as n_lettered, len(regexp_extract_all(t, '!!+')) as n_shouts
  from lists l left join lines using (r) left join covered using (r)),
b as (select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end) + (case when 10 * n_symbols > 2 * n_words then 4 else 0 end)
  + (case when 100 * n_dup_lines > 50 * n_words then 8 else 0 end) + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end) + (case when 10 * n_capitals > 4 * n_words then 32 else 0 end)
  + (case when 10 * n_lettered < 6 * n_words then 64 else 0 end) + (case when 10 * n_shouts > 3 * n_words then 128 else 0 end) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed::bigint as failed from b
"""
