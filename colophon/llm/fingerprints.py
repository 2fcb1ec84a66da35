"""Homomorphic fingerprints of documents: a sum over the multiset of their paragraphs.

A paragraph is a line.  It is hashed to a vector of eight 16-bit numbers, from hashes with a salt of
their own, and the vectors are added modulo 2**16, so texts with the same lines in any order have
the same sum, and texts with other lines another.  For likeness, lines are also cut after each eighth
word, because a text without line breaks would have one part; each piece is hashed to a wide vector
of zeros and ones, and these are added as well.  One is inserted or deleted by adding or subtracting
its vectors (``added``, ``removed``).  The fingerprint writes the number of pieces modulo 2**32, then
each component modulo 2**16, those of the pieces and those of the lines.

Read as plus and minus one, the components of the pieces of two texts estimate how many they share
(``likeness``).  Null texts count as empty; an empty text has one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm.common import table
from colophon.operators.ranking import running_totals
from colophon.session import reuse

#: 64 components a hash; each long of a vector carries two of them, in its lower and its upper half
HASHES = 2
COMPONENTS = 64 * HASHES
#: hashes of a line, four 16-bit lanes each
WIDE = 2
TWO_BITS = 0x0000000100000001
PARAGRAPHS = r"(?:[^\n\S]*+\S++){1,8}+[^\n\S]*+|(?<![^\n])[^\n\S]*+(?![^\n])"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, blank lines included, without their line breaks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPHS), F.lit(0))


def vector_of(piece: Column, begins: Column, lines: list[Column]) -> Column:
    """Struct of the number of pieces and the summed vectors of pieces and lines, for use after a ``groupBy``.

    ``lines`` are the hashes of the piece's line; they count where it ``begins``.
    """
    hashes = [F.xxhash64(F.lit(k), piece) for k in range(HASHES)]
    lane = lambda h, j: F.sum(F.when(begins, F.shiftrightunsigned(h, 16 * j).bitwiseAND(F.lit(0xFFFF))).otherwise(F.lit(0)))
    return F.struct(
        F.count(piece).alias("n"),
        F.array(*[F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(TWO_BITS))) for h in hashes for s in range(32)]).alias("sums"),
        F.array(*[lane(h, j) for h in lines for j in range(4)]).alias("wide"),
    )


def _each(a: Column, b: Column, op) -> Column:
    return F.struct(op(a["n"], b["n"]).alias("n"), *[F.zip_with(a[c], b[c], op).alias(c) for c in ("sums", "wide")])


def added(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of both."""
    return _each(a, b, lambda x, y: x + y)


def removed(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``, which must be among them."""
    return _each(a, b, lambda x, y: x - y)


def fingerprint(v: Column) -> Column:
    """Eight hex digits for the number of pieces, four for each component."""
    low, high = (lambda x: x.bitwiseAND(F.lit(0xFFFF))), (lambda x: F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(0xFFFF)))
    digits = F.transform(v["sums"], lambda x: F.lpad(F.hex(F.shiftleft(high(x), 16).bitwiseOR(low(x))), 8, "0"))
    lanes = F.transform(v["wide"], lambda x: F.lpad(F.hex(low(x)), 4, "0"))
    return F.lower(F.concat(F.lpad(F.hex(v["n"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.array_join(digits, ""), F.array_join(lanes, "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of 2 |A and B| / (|A| + |B|) over the two multisets; 1 exactly if the vectors are equal."""

    def signed(x: Column, n: Column, shift: int) -> Column:
        return (2 * F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFFFFFF)) - n).cast("double")

    def squares(x: Column, n: Column) -> Column:
        return F.pow(signed(x, n, 0), 2) + F.pow(signed(x, n, 32), 2)

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda t, x: t + x)

    apart = total(F.zip_with(a["sums"], b["sums"], lambda x, y: F.pow(signed(x, a["n"], 0) - signed(y, b["n"], 0), 2) + F.pow(signed(x, a["n"], 32) - signed(y, b["n"], 32), 2)))
    size = total(F.transform(a["sums"], lambda x: squares(x, a["n"]))) + total(F.transform(b["sums"], lambda x: squares(x, b["n"])))
    return F.greatest(F.lit(0.0), 1.0 - apart / F.greatest(size, F.lit(1.0)))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the ``vector`` of each text.  Rows that agree in ``keys`` are summed."""
    lines = docs.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_line"))
    hashed = lines.select(*keys, "_line", *[F.xxhash64(F.lit(k), "_line").alias(f"_h{k}") for k in range(WIDE)])
    own = [f"_h{k}" for k in range(WIDE)]
    pieces = hashed.select(*keys, *own, F.posexplode(paragraphs(F.col("_line"))).alias("_at", "_piece"))
    return pieces.groupBy(*keys).agg(vector_of(F.col("_piece"), F.col("_at") == 0, [F.col(h) for h in own]).alias("vector"))


def _followers(docs: DataFrame) -> DataFrame:
    """For each id its predecessor's id (the last one's for the first) and half of the predecessor's length."""
    ids = reuse(docs.groupBy("_id", "_null").agg(F.max(F.expr("length(_text) div 2")).alias("half")).withColumn("one", F.lit(1)), "ids")
    order = [("_null", "asc"), ("_id", "asc")]
    placed = reuse(running_totals(ids, order, {"place": "one"}), "places")
    n = placed.count()
    before = placed.select(F.col("_id").alias("to_id"), F.col("_null").alias("to_null"), F.col("half").alias("to_half"), F.pmod(F.col("place") + 1, F.lit(max(n, 1))).alias("place"))
    return reuse(placed.select("_id", "_null", "place").join(before, "place").drop("place"), "followers")


def with_edits(docs: DataFrame) -> DataFrame:
    """Vectors of each text and of its edited text: its last half replaced by the head of the next one's.

    ``docs`` has ``doc_id`` and ``text``.  The next document is that of the next larger id, the first
    one's after the last; null ids come last.  Every row is kept.  Where an id repeats, each of its
    rows has a result, and where the next id repeats, the least text (in binary order) counts.
    Texts cross the cluster once, the halves for the predecessors once more.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.coalesce("text", F.lit("")).alias("_text"))
    after = _followers(rows)
    heads = rows.join(after, ["_id", "_null"]).select(F.col("to_id").alias("_id"), F.col("to_null").alias("_null"), F.expr("substring(_text, 1, cast(to_half as int))").alias("_head")).groupBy("_id", "_null").agg(F.min("_head").alias("_head"))
    pairs = rows.join(heads, ["_id", "_null"]).withColumns({"_row": F.monotonically_increasing_id(), "n_chars": F.length("_text").cast("bigint")})
    texts = pairs.withColumn("_edited", F.expr("concat(substring(_text, 1, cast(n_chars - n_chars div 2 as int)), substring(_head, 1, cast(n_chars div 2 as int)))"))
    keys = ["_id", "_null", "_row", "n_chars", "edited_sha256"]
    both = texts.select(*keys[:4], F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("edited"), F.col("_text").alias("text")), F.struct(F.lit(1).alias("edited"), F.col("_edited").alias("text")))).alias("_t"))
    vectors = fingerprints(both.select(*keys, "_t.edited", "_t.text"), [*keys, "edited"])
    one = lambda k: F.max(F.when(F.col("edited") == k, F.col("vector")))
    paired = vectors.groupBy(*keys).agg(one(0).alias("vector"), one(1).alias("edited_vector"))
    small = paired.select("_id", "_null", "n_chars", "edited_sha256", "vector", fingerprint(F.col("edited_vector")).alias("edited_fingerprint"), likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"))
    done = reuse(small, "vectors")
    nexts = done.select("_id", "_null", "vector").join(after, ["_id", "_null"]).groupBy(F.col("to_id").alias("_id"), F.col("to_null").alias("_null")).agg(F.min("vector").alias("_next"))
    return done.join(nexts, ["_id", "_null"]).select(
        F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("vector")).alias("fingerprint"), "edited_fingerprint", "near_edited", likeness(F.col("vector"), F.col("_next")).alias("near_next")
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract: fingerprints of every text and of its edited text, and their likeness."""
    return with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
