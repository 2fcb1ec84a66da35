"""Candidate triage, review actions and quality measurement."""

from pyspark.sql import functions as F

from colophon.operators import review, staging
from colophon.plans.bindings import Tables
from colophon.plans.feed import renamed_works
from colophon.plans.registry import query

SETTINGS = review.QualitySettings(high=0.8, medium=0.4, auto_approve=0.95, auto_approve_enabled=True, min_samples=50, min_precision=0.5)


def _items(t: Tables):
    return t.source_items().withColumn("performer", F.lit(None).cast("string"))


def _works(t: Tables):
    return renamed_works(t)


_DUP = """
k as (select *, nullif(regexp_replace(upper(trim(product_code)),'[^A-Z0-9]','','g'),'') code from source_items),
n as (select code, count(*) filter (where status in ('pending','promoted')) live from k where code is not null group by 1),
w3 as (select distinct regexp_replace(upper(case when id % 3 = 0 then product_code else 'OLD-' || product_code end),'[^A-Z0-9]','','g') code from works),
d as (select k.*, k.code is not null and (live - case when status in ('pending','promoted') then 1 else 0 end > 0 or w3.code is not null) dup from k left join n on n.code=k.code left join w3 on w3.code=k.code)"""


@query("I11_triage_candidates", f"""with {_DUP} select id, case when not dup and product_code is not null and trim(title)<>'' and confidence>=0.95 then 'auto_approved' when dup then 'duplicate' when product_code is null or trim(title)='' then 'invalid'
  when confidence>=0.8 then 'high' when confidence>=0.4 then 'medium' else 'low' end review_bucket from d""", "source_items works")
def triage(t: Tables):
    return review.triage_candidates(_items(t), _works(t), SETTINGS, True).select("id", "review_bucket")


def _actions(t: Tables):
    i = F.col("id")
    return t.source_items().filter("id % 3 <> 2").select(
        i, F.when(i % 3 == 0, "promote").when(i % 2 == 0, "ignore").otherwise("save").alias("action"), F.when(i % 7 == 0, F.concat(F.lit("new-"), i.cast("string"))).alias("product_code"),
        F.when(i % 11 == 0, F.lit(" ")).alias("title"), F.lit(None).cast("string").alias("performer"), F.lit(None).cast("string").alias("maker"), F.lit(None).cast("string").alias("series"))


_REVIEW = """
a as (select id, case when id%3=2 then null when id%3=0 then 'promote' when id%2=0 then 'ignore' else 'save' end act, status, product_code oc, title ot,
  case when id%3<>2 and id%7=0 then 'NEW-' || cast(id as varchar) else upper(product_code) end product_code, case when id%3<>2 and id%11=0 then null else title end title from source_items),
r as (select *, case when act='ignore' then 'ignored' when act='promote' and status='pending' and product_code is not null and trim(title)<>'' then 'promoted' when act='promote' and status='pending' then 'error' else status end next_status,
  case when act is null then '' else concat_ws('|', case when coalesce(oc,'')<>coalesce(product_code,'') then 'product_code' end, case when coalesce(ot,'')<>coalesce(title,'') then 'title' end) end changed from a)"""


@query("I12_apply_review", f"with {_REVIEW} select id, next_status status, product_code from r", "source_items")
def apply_review(t: Tables):
    return review.apply_review(_items(t), _actions(t), _works(t), SETTINGS)["items"].select("id", "status", "product_code")


@query("I12_review_corrections", f"""with {_REVIEW} select id item_id, 'corrected' decision, changed changed_fields from r where changed<>'' union all select id, 'rejected', changed from r where act='ignore'
  union all select id, 'approved', changed from r where act='promote' and status='pending' and product_code is not null and trim(title)<>''""", "source_items")
def corrections(t: Tables):
    return review.apply_review(_items(t), _actions(t), _works(t), SETTINGS)["corrections"].select("item_id", "decision", F.array_join("changed_fields", "|").alias("changed_fields"))


_QUALITY = """
latest as (select item_id, arg_max(decision, decided_at) decision from corrections where decision in ('approved','rejected') group by 1),
st as (select model, count(*) sample_count, count(*) filter (where decision='approved') approved_count, count(*) filter (where decision='rejected') rejected_count,
  count(*) filter (where id in (select item_id from corrections where decision='corrected')) corrected_count, round(avg(confidence),6)::double average_confidence,
  count(*) filter (where decision='approved' and confidence>=0.8) ha, count(*) filter (where confidence>=0.8) ht from source_items join latest on item_id=id group by 1),
q as (select model, sample_count, approved_count, rejected_count, corrected_count, round(approved_count::double/(approved_count+rejected_count),6) approval_rate, round(corrected_count::double/sample_count,6) correction_rate, average_confidence,
  round(ha::double/nullif(ht,0),6) high_confidence_precision, sample_count>=50 and coalesce(ha::double/nullif(ht,0),0)>=0.5 passed_gate from st)"""


def _quality(t: Tables, every: bool):
    out = review.quality_snapshot(t.source_items(), t.corrections(), SETTINGS, every)
    for c in ("approval_rate", "correction_rate", "average_confidence", "high_confidence_precision"):
        out = out.withColumn(c, F.round(F.col(c).cast("double"), 6))
    return out


@query("E9_quality_snapshot", f"with {_QUALITY} select * from q order by sample_count desc, model limit 1", "source_items corrections")
def quality(t: Tables):
    return _quality(t, False)


@query("E9_quality_by_model", f"with {_QUALITY} select * from q", "source_items corrections")
def quality_all(t: Tables):
    return _quality(t, True)


@query("D9_exists_flag", "select id, id in (select item_id from corrections where decision='corrected') corrected from source_items", "source_items corrections")
def exists_flag(t: Tables):
    fixed = t.corrections().filter("decision = 'corrected'").select(F.col("item_id").alias("id")).distinct().withColumn("_c", F.lit(True))
    return t.source_items().select("id").join(fixed, "id", "left").select("id", F.coalesce("_c", F.lit(False)).alias("corrected"))


@query("E8_operations_metrics", f"""with {_DUP} select (select count(*) from d) collected, (select count(product_code) from d) candidates, (select count(*) from d where status='promoted') approved, (select count(*) from d where status='ignored') rejected,
  (select count(*) from d where dup) duplicates, (select count(*) from d where status='pending') pending, (select count(*) from conversations) ai_requests, cast((select sum(turn) from conversations) as bigint) input_tokens, cast((select sum(length(text)) from conversations) as bigint) output_tokens,
  (select count(*) from affiliate_clicks) affiliate_clicks, (select count(*) from d where extraction_status='failed') + (select count(*) from conversations where turn=3) errors,
  round((select count(*) from d where status='promoted')/(select count(product_code) from d)::double,6) approval_rate, round((select count(*) from d where status='ignored')/(select count(product_code) from d)::double,6) rejection_rate,
  round((select count(*) from d where dup)/(select count(product_code) from d)::double,6) duplicate_rate, round((select count(*) from d where status='promoted')/(select count(*) from d where status in ('promoted','ignored'))::double,6) decided_approval_rate,
  round((select count(*) from d where status='ignored')/(select count(*) from d where status in ('promoted','ignored'))::double,6) decided_rejection_rate, round((select count(*) from affiliate_clicks)/(select count(product_code) from d)::double,6) click_through_rate,
  (select count(*) from works) works, (select count(*) from supplier) performers, (select count(distinct maker) from works) makers""", "source_items works affiliate_clicks")
def operations(t: Tables):
    items = _items(t)
    found = staging.find_candidate_duplicates(items.select("id", "status", "product_code"), _works(t))
    runs = t.raw("conversations").select(F.when(F.col("turn") == 3, "failed").otherwise("completed").alias("status"), F.col("turn").alias("input_tokens"), F.length("text").cast("bigint").alias("output_tokens"))
    counted = {"works": t.works("id"), "performers": t.performers(), "makers": t.works("maker").filter("maker is not null").distinct()}
    out = review.operations_metrics(items.join(found, "id", "left"), runs, t.affiliate_clicks(), counted)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_rate")})


@query("C16_open_review_queue", "select id, model review_bucket, round(confidence::double,6) confidence from source_items where status='pending' order by model, confidence desc nulls last, minutes_old desc, id", "source_items")
def queue(t: Tables):
    rows = t.source_items().withColumnRenamed("model", "review_bucket").withColumnRenamed("minutes_old", "observed_at")
    return review.open_review_queue(rows).select("id", "review_bucket", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query("G12_queue_head", """with s as (select id, status, case when extraction_status='processing' and minutes_old>15 then 'failed' else extraction_status end es from source_items)
  select id from s where status='pending' and es in ('pending','failed') order by id limit 200""", "source_items")
def queue_head(t: Tables):
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("minutes_old").cast("int"))
    rows = review.release_stale(t.source_items().withColumn("updated_at", at), "2024-01-31 00:00:00")
    return review.queue_head(rows, 200).select("id")


@query("D2_left_outer", "select id, product_code, coalesce(n,0) clicks from works left join (select work_id, count(*) n from affiliate_clicks group by 1) on work_id=id", "works affiliate_clicks")
def left_outer(t: Tables):
    counts = t.affiliate_clicks().groupBy("work_id").agg(F.count("*").alias("clicks"))
    return t.works("id", "product_code").join(counts, F.col("id") == F.col("work_id"), "left").drop("work_id").fillna(0, ["clicks"])


@query("D3_semi_under_or", """select id from works where is_published and (title ilike '%hot%' or series in (select canonical_name from aliases where entity_type='series' and alias like 'red%')
  or performer in (select canonical_name from aliases where entity_type='performer' and alias like '%1'))""", "works aliases")
def semi_under_or(t: Tables):
    out = t.works("id", "title", "series", "performer", "is_published").filter("is_published")
    for kind, pattern in (("series", "red%"), ("performer", "%1")):
        names = t.aliases().filter((F.col("entity_type") == kind) & F.col("alias").like(pattern)).select(F.col("canonical_name").alias(kind), F.lit(True).alias(f"_{kind}")).distinct()
        out = out.join(names, kind, "left")
    return out.filter(F.col("title").ilike("%hot%") | F.coalesce("_series", "_performer", F.lit(False))).select("id")


@query("D8_period_table", """select p period, count(*) n from search_logs cross join (values ('week', timestamp '2024-01-24'), ('month', timestamp '2024-01-01'), ('all', timestamp '1900-01-01')) v(p, cutoff) where ts >= cutoff group by 1""", "search_logs")
def period_table(t: Tables):
    # the literal periods become one conditional count each: the log is read once and never multiplied
    stamp = F.col("ts").cast("timestamp_ntz")
    cut = {"week": "2024-01-24", "month": "2024-01-01"}
    wide = t.search_logs().agg(*[F.count_if(stamp >= F.lit(d).cast("timestamp_ntz")).alias(p) for p, d in cut.items()], F.count("*").alias("all"))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("n")) for p in ("week", "month", "all")])))


@query("D13_shared_attribute", """select distinct b.performer from works a join works b on a.maker=b.maker where a.is_published and b.is_published and a.performer='Supplier#000000003' and b.performer<>a.performer""", "works")
def shared_attribute(t: Tables):
    from colophon.operators.related import performers_sharing

    return performers_sharing(t.works("performer", "maker", "popularity", "is_published"), "Supplier#000000003", "maker", None).select("performer")


@query("H1_union_entities", """select kind, count(*) n, count(distinct name) names from (select 'performer' kind, performer as name from works where performer is not null union all select 'maker', maker from works union all select 'series', series from works) group by 1""", "works")
def union_entities(t: Tables):
    rows = t.works("performer", "maker", "series").select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("performer", "maker", "series")]))).filter("name is not null")
    per_name = rows.groupBy("kind", "name").agg(F.count("*").alias("n"))
    return per_name.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("names"))


