"""Mixing of sources to target weights, in blocks of words.

The words of a source, document after document, form one stream that is cut into blocks of
``block_words``.  Output shards have ``shard_blocks`` slots; for each shard the number of slots of
every source is a multinomial draw.  The n-th slot of a source maps to a block through a
pseudorandom permutation of the source's block numbers, a new one for each pass, so the first pass
takes every block once before any is taken again.  Slots and documents meet by block number.

Over all shards a source's draws are held to its quota: draws beyond it are given to the sources
that are short of theirs.  All of it is arithmetic on keys; texts are read once, for their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colophon.llm.common import table, word_count
from colophon.operators.ranking import running_totals
from colophon.session import reuse

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: equal slices of the draw's range; a draw meets only the sources of its slice
BINS = 1024
ROUNDS = 12


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row a source: ``source_no`` by code point with null last, size, target and the words before it.

    The weights repeat along the sources and share ``share`` of all sizes.  A target stops at
    ``repeats`` times its source's size and the excess is shared anew, which ends at one level for
    all that do not stop: sources are taken by the level at which they would stop.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()  # one row a source
    in_order = everything.orderBy(F.col("source").asc_nulls_last())
    before = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    listed = sizes.select(
        "*", (F.row_number().over(in_order) - 1).cast("bigint").alias("source_no"), F.coalesce(F.sum("source_size").over(before(in_order)), F.lit(0)).alias("words_before")
    ).withColumns({"weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")), "cap": F.col("source_size") * float(repeats)})
    by_stop = everything.orderBy(F.col("cap") / F.col("weight"), "source_no")
    level = listed.withColumn(
        "level",
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before(by_stop)), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before(by_stop)), F.lit(0.0))),
    ).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return level.withColumn("open", open_level).select("source", "source_no", "source_size", "words_before", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("open") * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The image of ``index`` under a pseudorandom permutation of 0 .. n - 1 chosen by ``key``.

    Each round pairs x with (k - x) mod n and swaps the two if a hash of the larger says so.
    """

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(x, partner)), F.lit(2)) == 0, x).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def drawn_blocks(targets: DataFrame, block_words: int, shard_blocks: int, seed: int, repeats: int = REPEATS) -> DataFrame:
    """One row a filled slot: ``shard``, ``source_no``, ``draw`` (its number within the source) and ``block``."""
    spark = targets.sparkSession
    everything = Window.partitionBy().orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.least(F.round(F.col("target") * blocks / F.greatest("source_size", F.lit(1))).cast("bigint"), blocks * repeats)
    plan = reuse(targets.select("source_no", blocks.cast("bigint").alias("blocks"), quota.alias("quota")).withColumn("low", F.coalesce(F.sum("quota").over(everything), F.lit(0))), "plan")
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    n = max(total, 1)
    bins = plan.filter("quota > 0").select("source_no", "low", (F.col("low") + F.col("quota")).alias("high"), F.explode(F.sequence(F.expr(f"low * {BINS} div {n}"), F.expr(f"(low + quota - 1) * {BINS} div {n}"))).alias("bin"))
    slots = spark.range(total).select(F.expr(f"id div {shard_blocks}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("at")).withColumn("bin", F.expr(f"at * {BINS} div {n}"))
    counts = reuse(slots.join(bins, "bin").filter("low <= at and at < high").groupBy("shard", "source_no").agg(F.count("*").alias("n")), "counts")
    # what a source has drawn too much or too little, laid end to end
    drawn = reuse(counts.groupBy("source_no").agg(F.sum("n").alias("drawn")), "drawn")
    settled = reuse(
        plan.join(drawn, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumns({
            "over_low": F.coalesce(F.sum(F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).over(everything), F.lit(0)),
            "short_low": F.coalesce(F.sum(F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))).over(everything), F.lit(0)),
        }), "settled",
    )
    # slots of a source before each shard: running totals over all, less those of the sources before
    base = reuse(drawn.select("source_no", F.coalesce(F.sum("drawn").over(everything), F.lit(0)).alias("base")), "base")
    placed = running_totals(counts, [("source_no", "asc"), ("shard", "asc")], {"upto": "n"}).join(base, "source_no").withColumn("first", F.col("upto") - F.col("base"))
    # a shard's slots of a source are listed wherever that row lies, not where its source is
    draws = reuse(placed.select("shard", "source_no", "n", "first"), "firsts").repartition("shard", "source_no").select("shard", "source_no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw")).join(settled, "source_no")
    kept = draws.filter("draw < quota").select("shard", "source_no", "draw", "blocks")
    over = draws.filter("draw >= quota").select("shard", (F.col("over_low") + F.col("draw") - F.col("quota")).alias("place"))
    short = settled.filter("drawn < quota").select("source_no", "blocks", F.posexplode(F.sequence(F.col("drawn"), F.col("quota") - 1)).alias("_i", "draw"), "short_low").withColumn("place", F.col("short_low") + F.col("_i"))
    filled = kept.unionByName(over.join(short, "place").select("shard", "source_no", "draw", "blocks"))
    return filled.select("shard", "source_no", "draw", permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), F.expr("draw div blocks")).alias("block"))


def mixed(rows: DataFrame, block_words: int = 128, shard_blocks: int = 1024, seed: int = 17) -> DataFrame:
    """``doc_id``, ``source`` and ``size`` of every row with ``source_size``, ``target``, ``taken`` and ``copies``.

    ``taken`` counts the words of the row in all blocks taken; ``copies`` is how often the block of
    its first word is taken, the whole-document form of the mix (0 for a row without words).  Null
    sources are one source, the last; null and repeated ids are rows like any other; an empty table
    gives an empty result.
    """
    narrow = reuse(rows.select("doc_id", "source", "size"), "sizes")
    targets = reuse(source_targets(narrow), "targets")
    streams = narrow.join(targets, narrow["source"].eqNullSafe(targets["source"])).select("doc_id", narrow["source"], "size", "source_no", "source_size", "target", "words_before", F.lit(1).alias("one"))
    order = [("source_no", "asc"), ("doc_id", "asc"), ("size", "asc")]
    placed = reuse(running_totals(streams, order, {"begin": "size", "row": "one"}).withColumn("begin", F.col("begin") - F.col("words_before")), "streams")
    copies = drawn_blocks(targets, block_words, shard_blocks, seed).groupBy("source_no", "block").agg(F.count("*").alias("n"))
    parts = placed.filter("size > 0").select("row", "source_no", "begin", (F.col("begin") + F.col("size")).alias("end"), F.explode(F.expr(f"sequence(begin div {block_words}, (begin + size - 1) div {block_words})")).alias("block"))
    overlap = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    own_first = F.when(F.col("block") == F.expr(f"begin div {block_words}"), F.col("n")).otherwise(F.lit(0))
    taken = parts.join(copies, ["source_no", "block"]).groupBy("row").agg(F.sum(overlap * F.col("n")).alias("taken"), F.max(own_first).alias("copies"))
    return placed.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole and as often as it takes them, with their own columns.

    A document goes with the block that holds its first word; rows that agree in id, source and
    size go together.
    """
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]).withColumns({"_id": F.col(f"_c{names.index('doc_id')}"), "_source": F.col(f"_c{names.index('source')}"), "_size": word_count(F.col(f"_c{names.index('text')}"))})
    mix = mixed(rows.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"))).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    on = rows["_id"].eqNullSafe(mix["doc_id"]) & rows["_source"].eqNullSafe(mix["source"]) & (rows["_size"] == mix["size"])
    times = rows.join(mix, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract: size, its source's size and target, and the words taken of every document."""
    docs = table(spark, sf_dir, "documents")
    return mixed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).drop("source", "copies")
