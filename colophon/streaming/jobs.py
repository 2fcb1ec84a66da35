"""Continuous intake and event counts.

Every job writes through ``foreachBatch`` into a versioned table, one part a micro-batch, named by the
query and the batch.  A batch that is sent again finds itself done, another query on the same table
has parts of its own, and full levels of parts are merged, so neither a restart nor a long life makes
a batch read more files.  ``read_latest`` gives the current state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from colophon import constants as K
from colophon.operators.intake import extract_code_candidates
from colophon.operators.metrics import period_cutoff
from colophon.operators.ranking import latest_per_key
from colophon.sources.versioned import VersionedTable


def read_event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; new files are picked up as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """One Parquet table as a stream, be it a single file or a folder of files."""
    # a glob of one name: without it Spark takes the path of a file for a folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def event_time(c: str = "ts") -> Column:
    """A zone-less timestamp as an instant, read as UTC whatever the session's zone (watermarks
    need an instant)."""
    return F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())


def wall_time(c) -> Column:
    """The reverse of ``event_time``, for output."""
    return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"].replace("-", "")


def _start(df: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, mode: str, once: bool) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def _numbered(schema) -> StructType:
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    return fields.add("batch", "long")


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update", once: bool = True, keys: list[str] | None = None) -> StreamingQuery:
    """Start a stream that stores its micro-batches, each under the number of the change that brings it.

    With ``keys``, merged parts keep the last update of each key alone.
    """
    spark = df.sparkSession
    table = VersionedTable(spark, path, _numbered(df.schema), keys)

    def store(batch: DataFrame, number: int) -> None:
        base = table.current()
        rows = batch.withColumn("batch", F.lit(base["notes"].get("changes", 0)).cast("long"))
        merge = (lambda r: latest_rows(r, keys)) if keys else None
        table.append(rows, _writer(spark, checkpoint), number, merge, {"changes": base["notes"].get("changes", 0) + 1})

    return _start(df, store, checkpoint, mode, once)


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All stored rows with the number of their batch."""
    return VersionedTable(spark, path, _numbered(schema)).read()


def read_latest(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    return latest_rows(stored, keys).drop("batch")


def latest_rows(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The same with the number of its batch."""
    return latest_per_key(stored, keys, [("batch", "desc")])


def stream_event_counts(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events per window and type; events later than the watermark are dropped."""
    timed = events.withColumn("at", event_time()).withWatermark("at", delay)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    counts = timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "0 seconds") -> DataFrame:
    """Closed visits per visitor: events without a pause longer than the gap.

    A visit is emitted when the watermark has passed its end.  Rows of ``with_ticks`` move the
    watermark and belong to no visit.
    """
    timed = events.withColumn("at", event_time()).withWatermark("at", delay)
    visits = timed.groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"), F.max("event_id").alias("_real"))
    return visits.filter(F.col("_real").isNotNull()).select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def with_ticks(events: DataFrame, folder: str) -> DataFrame:
    """The stream together with the ticks of a folder, rows that have a time only."""
    spark = events.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    ticks = spark.readStream.schema(StructType([f for f in events.schema if f.name == "ts"])).parquet(folder)
    return events.unionByName(ticks, allowMissingColumns=True)


def tick(spark: SparkSession, folder: str, ts: str) -> None:
    """Says that no event before ``ts`` is to come: what is open until then is closed by the next run."""
    spark.sql("select timestamp_ntz'" + ts + "' as ts").write.mode("append").parquet(folder)


def stream_late_rows(events: DataFrame, path: str, checkpoint: str, size: str = "1 day", delay: str = "1 day", once: bool = True) -> StreamingQuery:
    """Counts per window and type, with the rows behind the watermark apart instead of dropped.

    The watermark of a batch is the latest time of the batches before it, less the delay; a row is
    late if its window has ended by then.  ``path/counts`` has increments ``window_start,
    window_end, event_type, late, events`` (merged parts are summed), ``path/late`` the late rows
    with the watermark that they missed.  Each input row is in exactly one count.
    """
    spark = events.sparkSession
    counts = VersionedTable(spark, f"{path}/counts", LATE_COUNTS, ["window_start", "event_type"])
    rows = VersionedTable(spark, f"{path}/late", StructType(list(events.schema.fields)).add("watermark", "timestamp"))
    keys = ["window_start", "window_end", "event_type", "late"]

    def store(batch: DataFrame, number: int) -> None:
        writer = _writer(spark, checkpoint)
        base = counts.current()
        if base["done"].get(writer, -1) >= number:
            return
        seen = base["notes"].get(f"latest {writer}")
        watermark = F.timestamp_micros(F.lit(seen).cast("long")) - F.expr(f"interval {delay}") if seen is not None else F.lit(None).cast("timestamp")
        timed = batch.withColumn("_at", event_time()).withColumn("_w", F.window("_at", size))
        marked = timed.withColumn("watermark", watermark).withColumn("late", F.coalesce(F.col("_w.end") <= F.col("watermark"), F.lit(False)))
        rows.append(marked.filter("late").select(*batch.columns, "watermark"), writer, number)
        latest = timed.agg(F.max(F.unix_micros("_at")).alias("t")).first()["t"]
        found = marked.groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "event_type", "late").agg(F.count("*").alias("events"))
        latest = max((x for x in (latest, seen) if x is not None), default=None)
        counts.append(found, writer, number, lambda r: r.groupBy(*keys).agg(F.sum("events").alias("events")), {f"latest {writer}": latest})

    return _start(events, store, checkpoint, "append", once)


LATE_COUNTS = "window_start timestamp, window_end timestamp, event_type string, late boolean, events long"


def read_late_counts(spark: SparkSession, path: str) -> DataFrame:
    """``window_start, window_end, event_type, late, events`` of a stream of ``stream_late_rows``."""
    stored = VersionedTable(spark, f"{path}/counts", LATE_COUNTS).read()
    return stored.groupBy("window_start", "window_end", "event_type", "late").agg(F.sum("events").alias("events"))


def stream_daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per day, work and type: the increments the discovery metrics are summed from."""
    timed = events.withColumn("at", event_time()).withWatermark("at", delay)
    counts = timed.groupBy(F.window("at", "1 day").alias("w"), "work_id", "event_type").agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("day"), "work_id", "event_type", "events")


def periods_from_days(days: DataFrame, as_of: str) -> DataFrame:
    """Views, clicks and other event counts per work and period out of the daily counts.

    ``days(day, work_id, event_type, events)``; exact when ``as_of`` is a midnight, as the
    nightly run's is.
    """
    inside = {p: None if n is None else F.col("day") >= period_cutoff(as_of, n) for p, n in K.PERIODS}
    sums = [F.sum("events" if c is None else F.when(c, F.col("events")).otherwise(0)).alias(p) for p, c in inside.items()]
    wide = days.groupBy("work_id", "event_type").agg(*sums)
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("events")) for p in inside])
    return wide.select("work_id", "event_type", F.inline(rows)).filter("events > 0")


def stream_code_candidates(posts: DataFrame, source: str, post_url: str, delay: str = "7 days") -> DataFrame:
    """Candidates of incoming posts, each (source, key) once within the watermark.

    ``posts(post_id, text, observed_at)`` with ``observed_at`` an instant.
    """
    found = extract_code_candidates(posts.withWatermark("observed_at", delay), source, post_url)
    return found.dropDuplicatesWithinWatermark(["source", "source_key"])


def stream_ingest_items(posts: DataFrame, table: str, checkpoint: str, source: str, post_url: str) -> StreamingQuery:
    """Candidates of incoming posts into a table, insert-ignore on (source, source_key).

    The check against the stored keys also covers repeats older than the watermark, and those of
    another query on the table.  It reads the buckets that a batch has keys in.
    """
    spark = posts.sparkSession
    candidates = stream_code_candidates(posts, source, post_url)
    keys = ["source", "source_key"]
    stored = VersionedTable(spark, table, _numbered(candidates.schema), keys)

    def store(batch: DataFrame, number: int) -> None:
        base = stored.current()
        fresh = batch.join(stored.read(stored.touched(batch)).select(*keys), keys, "left_anti").select(*candidates.columns)
        changes = base["notes"].get("changes", 0)
        stored.append(fresh.withColumn("batch", F.lit(changes).cast("long")), _writer(spark, checkpoint), number, None, {"changes": changes + 1})

    return _start(candidates, store, checkpoint, "append", True)
