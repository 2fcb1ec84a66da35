"""The streaming jobs run over the event and document files, to be compared with batch SQL."""

from pyspark.sql import functions as F

from colophon.plans.bindings import AS_OF, Tables
from colophon.plans.registry import query
from colophon.session import shared_folder
from colophon.streaming import jobs


def _events(t: Tables):
    raw = jobs.read_table_stream(t.spark, f"{t.sf_dir}/events.parquet", t.raw("events").schema)
    n = t.raw("part").count()
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select("event_id", "ts", F.col("user_id").alias("session_id"), "event_type", ((F.col("event_id") * 7 + k) % n).alias("work_id"))


def _run(t: Tables, stream, schema: str, keys: list[str], mode: str = "update"):
    folder = shared_folder(t.spark, "stream")
    jobs.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", mode, keys=keys).awaitTermination()
    stored = jobs.read_batches(t.spark, f"{folder}/out", schema)
    return jobs.read_latest(stored, keys)


_COUNTS = "window_start timestamp, window_end timestamp, event_type string, events long"


def _windows(t: Tables, size: str, slide: str | None = None):
    out = _run(t, jobs.stream_event_counts(_events(t), size, slide), _COUNTS, ["window_start", "window_end", "event_type"])
    day = F.date_format(jobs.wall_time(F.col("window_start")), "yyyy-MM-dd").alias("day")
    return out.select(day, "event_type", "events")


@query("S2_daily_counts", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) events from events group by 1, 2")
def daily(t: Tables):
    return _windows(t, "1 day")


@query("S3_sliding_week", "select strftime(date_trunc('day', ts) - (i * interval 1 day), '%Y-%m-%d') as day, event_type, count(*) events from events, range(0, 7) r(i) group by 1, 2")
def weekly(t: Tables):
    return _windows(t, "7 days", "1 day")


@query("S4_sessions", """
with e as (select user_id session_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end fresh from events),
v as (select *, sum(fresh) over (partition by session_id order by ts) v from e)
select session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') started, count(*) events from v group by session_id, v""")
def sessions(t: Tables):
    # the second run goes on from the first one's checkpoint: a tick after the last event closes what is open
    folder = shared_folder(t.spark, "sessions")
    stream = jobs.stream_sessions(jobs.with_ticks(_events(t), f"{folder}/ticks"))
    for last in (False, True):
        if last:
            jobs.tick(t.spark, f"{folder}/ticks", "2100-01-01 00:00:00")
        jobs.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", "append").awaitTermination()
    out = jobs.read_batches(t.spark, f"{folder}/out", stream.schema)
    return out.select("session_id", F.date_format(jobs.wall_time(F.col("started_at")), "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


#: days of one wave of files, and how many waves later a delayed row comes
_WAVE = 6


@query("S6_late_rows", f"""
with w as (select *, (epoch(date_trunc('day', ts)) / 86400)::bigint // {_WAVE} + (event_id % 3) * (case when event_id % 4 = 0 then 1 else 0 end) wave from events),
seen as (select wave, max(max(ts)) over (order by wave rows between unbounded preceding and 1 preceding) - interval 1 day mark from w group by wave)
select strftime(ts, '%Y-%m-%d') as day, event_type, coalesce(date_trunc('day', ts) + interval 1 day <= mark, false) late, count(*) events
from w join seen using (wave) group by 1, 2, 3""")
def late_rows(t: Tables):
    """Events that arrive in waves of files, some one or two waves late, each wave a run on one checkpoint."""
    folder = shared_folder(t.spark, "late")
    events = t.raw("events").select("event_id", "ts", "event_type")
    day = F.floor(F.unix_micros(jobs.event_time()) / F.lit(86_400_000_000))
    delayed = F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 3).otherwise(0)
    events.withColumn("wave", F.floor(day / _WAVE) + delayed).write.partitionBy("wave").parquet(f"{folder}/waves")
    waves = t.spark.read.parquet(f"{folder}/waves")
    for wave in sorted(r["wave"] for r in waves.select("wave").distinct().collect()):  # a row a wave
        # a wave's files reach the folder that the stream reads in one go
        waves.filter(F.col("wave") == wave).drop("wave").write.parquet(f"{folder}/in/wave={wave}")
        arrived = t.spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        jobs.stream_late_rows(arrived, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = jobs.read_late_counts(t.spark, f"{folder}/out")
    return found.select(F.date_format(jobs.wall_time(F.col("window_start")), "yyyy-MM-dd").alias("day"), "event_type", "late", "events")


_PERIODS = f"(values ('day', timestamp '{AS_OF}' - interval 1 day), ('week', timestamp '{AS_OF}' - interval 7 day), ('month', timestamp '{AS_OF}' - interval 30 day), ('all', timestamp '1900-01-01')) p(period, cutoff)"


@query("S5_discovery_counts", f"select work_id, event_type, period, count(*) events from events_bound, {_PERIODS} where ts >= cutoff group by 1, 2, 3", "events_bound")
def discovery(t: Tables):
    days = _run(t, jobs.stream_daily_counts(_events(t)), "day timestamp, work_id long, event_type string, events long", ["day", "work_id", "event_type"])
    return jobs.periods_from_days(days.withColumn("day", jobs.wall_time(F.col("day"))), AS_OF)


@query("S1_ingest_items", r"""
with c as (select doc_id, unnest(list_distinct(list_transform(range(1, len(h)+1), lambda i: concat(upper(h[i]),'-',n[i])))) code from (
  select doc_id, regexp_extract_all(text, '\b([A-Za-z]{2,12})[\s_-]?([0-9]{2,8})\b', 1) h, regexp_extract_all(text, '\b([A-Za-z]{2,12})[\s_-]?([0-9]{2,8})\b', 2) n from documents))
select concat(cast(doc_id as varchar), ':', code) source_key, code product_code from c""")
def ingest(t: Tables):
    docs = jobs.read_table_stream(t.spark, f"{t.sf_dir}/documents.parquet", t.raw("documents").schema)
    posts = docs.select(F.col("doc_id").alias("post_id"), "text", F.timestamp_seconds(F.col("doc_id") + 1700000000).alias("observed_at"))
    folder = shared_folder(t.spark, "ingest")
    jobs.stream_ingest_items(posts, f"{folder}/items", f"{folder}/checkpoint", "posts", "https://posts.example/status/").awaitTermination()
    stored = jobs.read_batches(t.spark, f"{folder}/items", "source_key string, product_code string")
    return stored.select("source_key", "product_code")
