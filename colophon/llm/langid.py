"""Language of a text and of its spans.

A word is a run of letters and marks.  The script of its first letter, found from code point
ranges, leaves only the languages that were seen in that script; each of them gets the word's
score, the sum of log probabilities of its character trigrams.  A Viterbi path over the words, in
which each change of language costs ``switch``, labels spans of mixed-language texts.

The model is fitted on at most ``rows_per_language`` labelled rows a language, taken by hash of
their id; it is a table of ``BUCKETS`` trigram buckets by language, whatever the corpus holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from colophon.llm.common import mapped, slices

BUCKETS = 1 << 16
UNKNOWN = "und"
#: a language is a candidate in a script that holds at least this share of its training letters
SCRIPT_SHARE = 0.01
#: characters handled at once by a Python worker
CHARS_AT_ONCE = 1_000_000
#: characters or words of these whose wide intermediate values are held at once
PIECE = 1 << 17

# First and last code point of the ranges of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # [BUCKETS, languages], float32
    allowed: np.ndarray  # [scripts + 1, languages]; script 0 is any other
    switch: float


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: part of a word, letter, script, lower case."""
    n = 0x110000
    kinds = [unicodedata.category(chr(i))[0] for i in range(n)]
    letter = np.array([k == "L" for k in kinds])
    inside = letter | np.array([k == "M" for k in kinds])
    script = np.zeros(n, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = k
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        if len(small := chr(i).lower()) == 1:
            lower[i] = ord(small)
    return inside, letter, script, lower


def _words(texts: list[str]) -> dict[str, np.ndarray]:
    """Words of all texts: where they begin and end, whose they are, and their trigram buckets."""
    inside, letter, script, lower = characters()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    mask = np.zeros(len(points) + 2, bool)
    mask[1:-1] = inside[points]
    edge = np.diff(mask.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    padded = np.zeros(len(points) + 2, np.uint32)
    lower.take(points, out=padded[1:-1], mode="clip")
    padded *= mask
    buckets = np.zeros(int(mask.sum()), np.uint16)
    done = 0
    for begin in range(0, len(points), PIECE):
        at = np.flatnonzero(mask[begin + 1 : min(begin + PIECE, len(points)) + 1]) + begin
        # the three characters of each trigram, mixed
        mixed = sum(padded[at + k].astype(np.uint64) * np.uint64(by) for k, by in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))
        mixed ^= mixed >> np.uint64(29)
        buckets[done : done + len(at)] = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        done += len(at)
    letters = np.add.reduceat(letter[points][mask[1:-1]], np.cumsum(ends - starts) - (ends - starts), dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return {
        "start": starts, "end": ends, "letters": letters, "buckets": buckets,
        "doc": np.searchsorted(begins, starts, "right") - 1, "script": script[points[starts]] if len(starts) else np.zeros(0, np.uint8), "begins": begins,
    }


def _viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word.  Text ``d`` has ``count[d]`` words from ``first[d]``; all texts step together."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    alive = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right") if len(count) else []
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    best = np.zeros((len(count), scores.shape[1]), np.float32)
    for t, n in enumerate(alive):
        at, now = first[:n] + t, best[:n]
        top = now.argmax(1)
        changed = now[np.arange(n), top] - np.float32(switch)
        move = changed[:, None] > now
        back[at] = np.where(move, top[:, None], own)
        best[:n] = np.where(move, changed[:, None], now) + scores[at]
    state = best.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def _label(texts: list[str], model: Model) -> dict[str, np.ndarray]:
    w = _words(texts)
    per_text = np.bincount(w["doc"], minlength=len(texts))
    total = np.bincount(w["doc"], weights=w["letters"], minlength=len(texts))
    if not len(w["start"]) or not model.languages:
        return w | {"label": np.zeros(len(w["start"]), np.int16), "total": total, "held": np.zeros((len(texts), max(1, len(model.languages))))}
    length = w["end"] - w["start"]
    ends = np.cumsum(length)
    scores = np.empty((len(length), len(model.languages)), np.float32)
    # cut where so many characters are full
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PIECE, ends[-1], PIECE)), len(length)])
    for a, b in zip(cuts, cuts[1:]):
        first = ends[a] - length[a]
        scores[a:b] = np.add.reduceat(model.log_prob[w["buckets"][first : ends[b - 1]]], ends[a:b] - length[a:b] - first, axis=0)
    allowed = model.allowed[w["script"]]
    known = allowed.any(1)
    scores = np.where(allowed, scores, np.float32(-1e6))
    scores[~known] = 0
    scores -= scores.max(1, keepdims=True)
    label = _viterbi(scores, np.cumsum(per_text) - per_text, per_text, model.switch)
    fits = allowed[np.arange(len(label)), label]
    n = len(model.languages)
    held = np.bincount(w["doc"] * n + label, weights=w["letters"] * fits, minlength=len(texts) * n).reshape(len(texts), n)
    return w | {"label": label, "total": total, "held": held}


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def _spans(found: dict[str, np.ndarray], model: Model, rows: int) -> pa.Array:
    """Runs of words with one label in a text, as code point ranges of that text."""
    doc, label = found["doc"], found["label"]
    names = pa.array(model.languages or [UNKNOWN])
    if len(doc):
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])
        last = np.r_[new[1:], len(doc)] - 1
        base = found["begins"][doc[new]]
        parts = [pa.array(found["start"][new] - base), pa.array(found["end"][last] - base), names.take(pa.array(label[new].astype(np.int32)))]
        owner = doc[new]
    else:
        parts, owner = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], np.zeros(0, np.int64)
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "end", "lang"]))


def with_languages(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """The rows with ``lang_pred``, ``lang_score`` and, if asked for, ``lang_spans``.

    ``lang_pred`` holds most letters of the text (ties: the first in order of name) and is ``und``
    for a null text, one without letters, and a model without languages.  ``lang_score`` is the
    share of all letters in its spans and its scripts, 0 to 1.  Columns of these names are replaced;
    every row stays, repeated rows too.
    """
    base = docs.drop("lang_pred", "lang_score", "lang_spans")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())] + ([T.StructField("lang_spans", SPAN)] if spans else [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, CHARS_AT_ONCE):
            found = _label([t or "" for t in batch.column(text).to_pylist()], model)
            held, total = found["held"], found["total"]
            top = held.argmax(1)
            score = held[np.arange(len(total)), top] / np.maximum(total, 1)
            none = (total == 0) | (not model.languages)
            names = [UNKNOWN if n else model.languages[k] for k, n in zip(top, none)]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score))]
            if spans:
                columns.append(_spans(found, model, batch.num_rows))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[f.name for f in added]])

    return mapped(base, work, T.StructType(base.schema.fields + added))


def held_out(doc_id="doc_id"):
    """True for the rows no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = 1500, switch: float = 12.0, smoothing: float = 0.05) -> Model:
    """Learns trigram scores from ``text`` and ``lang`` of rows with both, leaving ``held_out`` rows alone.

    At most ``rows_per_language`` rows of a language are read, those whose ids have the least hashes.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    # one row a language
    bounds = F.broadcast(rows.withColumn("_n", place).filter(F.col("_n") <= rows_per_language).groupBy("lang").agg(F.max("_h").alias("_to")))
    sample = docs.filter(~held_out() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("_h")).join(bounds, "lang").filter("_h <= _to").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHARS_AT_ONCE):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            w = _words(texts)
            length = w["end"] - w["start"]
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], np.int32)[w["doc"]] if len(w["doc"]) else np.zeros(0, np.int64)
            for kind, keys, owner, weight in (("gram", w["buckets"], np.repeat(of, length), None), ("script", w["script"], of, w["letters"])):
                for k, name in enumerate(names):
                    mine = owner == k
                    n = np.bincount(keys[mine], weights=None if weight is None else weight[mine], minlength=1).astype(np.int64)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(n[at])], ["kind", "lang", "bucket", "n"])

    counts = mapped(sample, count, "kind string, lang string, bucket bigint, n bigint").groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    kind, lang, bucket, n = (counts.column(c).to_numpy() if c in ("bucket", "n") else np.array(counts.column(c).to_pylist(), dtype=object) for c in ("kind", "lang", "bucket", "n"))
    languages = sorted(set(lang))
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    for k, name in enumerate(languages):
        for which, out in (("gram", grams), ("script", scripts)):
            mine = (lang == name) & (kind == which)
            out[bucket[mine].astype(np.int64), k] = n[mine]
    log_prob = np.log((grams + smoothing) / (grams.sum(0) + smoothing * BUCKETS)).astype(np.float32)
    return Model(languages, log_prob, scripts > SCRIPT_SHARE * scripts.sum(0), switch)


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.4) -> DataFrame:
    """The documents whose language is known and holds ``least_score`` of the letters, with their own columns."""
    labelled = with_languages(docs.withColumns({f"_{c}": F.col(c) for c in ("lang_pred", "lang_score") if c in docs.columns}), model, spans=False)
    kept = labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least_score))
    return kept.select(*[F.col(f"_{c}").alias(c) if c in ("lang_pred", "lang_score") else F.col(c) for c in docs.columns])


def op1_language_id(docs: DataFrame) -> DataFrame:
    """Contract: language, score and the held-out mark of every document, with the number of its spans."""
    rows = docs.select("doc_id", "text", "lang")
    found = with_languages(rows.select("doc_id", "text"), fit(rows))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").cast("bigint").alias("n_spans"))
