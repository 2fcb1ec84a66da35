"""The vendor feed: items derived from the works, staged against works and earlier rows."""

from pyspark.sql import functions as F

from colophon import constants as K
from colophon.operators import publication, staging
from colophon.plans.bindings import Tables
from colophon.plans.registry import query
from colophon.session import reuse
from colophon.sources import item_list

HOSTS = ("shop.example",)
WORK_FIELDS = ("id", "product_code", "title", "performer", "maker", "series", "genre", "price")


def raw_items(t: Tables, works=None):
    """``position, raw``: one JSON item per work, with faults by key, and some repeated items."""
    w = works or t.works(*WORK_FIELDS)
    i = F.col("id")
    text = i.cast("string")
    named = lambda c: F.array(F.struct(F.lit(None).cast("string").alias("id"), F.col(c).alias("name")))
    item = lambda title: F.to_json(F.struct(
        F.when(i % 20 != 0, F.concat(F.lit("c"), text)).alias("content_id"),
        F.when(i % 20 == 0, None).when(i % 97 == 0, F.lit(" zzz-00001 ")).otherwise(F.lower("product_code")).alias("product_id"),
        F.when(i % 11 == 0, F.lit("  ")).otherwise(title).alias("title"),
        F.lit("2020/01/02 10:00:00").alias("date"),
        F.concat(F.when(i % 13 == 0, F.lit("http")).otherwise(F.lit("https")), F.lit("://www.shop.example/d/"), text).alias("URL"),
        F.when(i % 17 != 0, F.concat(F.lit("https://al.shop.example/?a="), text)).alias("affiliateURL"),
        F.struct(F.concat(F.lit("https://pics.shop.example/"), text, F.lit(".jpg")).alias("large")).alias("imageURL"),
        F.struct(F.concat(F.lit("1,"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("円~")).alias("price")).alias("prices"),
        F.struct(named("performer").alias("actress"), named("maker").alias("maker"), named("series").alias("series"),
                 F.concat(named("genre"), named("genre")).alias("genre")).alias("iteminfo"),
    ))
    first = w.select((i * 2).alias("position"), item(F.col("title")).alias("raw"))
    again = w.filter("id % 29 = 0 or id % 37 = 0").select((i * 2 + 1).alias("position"), item(F.when(i % 37 == 0, F.concat("title", F.lit(" b"))).otherwise(F.col("title"))).alias("raw"))
    return first.unionByName(again)


def items(t: Tables, works=None):
    rows = raw_items(t, works).withColumn("item", F.from_json("raw", item_list.item_schema()))
    return item_list.normalize_items(rows).drop("item")


def known_works(t: Tables, works=None):
    w, i = works or t.works(*WORK_FIELDS), F.col("id")
    return w.filter("id % 3 = 0 or (id % 3 = 1 and id % 5 = 0)").select(
        "id", F.when(i % 3 == 0, F.concat(F.lit("c"), i.cast("string"))).alias("external_product_id"),
        F.regexp_replace("product_code", "[^A-Z0-9]", "").alias("code_key"),
        F.when(i % 2 == 0, F.col("title")).otherwise("old").alias("title"),
        F.array("performer").alias("performers"), "maker", "series", F.array("genre").alias("genres"))


def known_staged(t: Tables, works=None):
    w, i = works or t.works(*WORK_FIELDS), F.col("id")

    def rows(df, shift, external, title):
        return df.select(
            (i + shift).alias("id"), external.alias("external_product_id"), F.regexp_replace("product_code", "[^A-Z0-9]", "").alias("code_key"),
            title.alias("title"), F.array("performer").alias("performers"), "maker", "series", F.array("genre").alias("genres"),
            F.lit("pending").alias("review_status"), F.when(i % 14 == 0, "needs_review").otherwise("new").alias("preview_status"),
            F.lit(2).cast("bigint").alias("attempt_count"), F.when(i % 21 == 0, i).alias("linked_work_id"))

    own = rows(w.filter("id % 7 = 0"), 10**9, F.concat(F.lit("c"), i.cast("string")), F.when(i % 2 == 0, F.col("title")).otherwise("old"))
    foreign = rows(w.filter("id % 19 = 0"), 2 * 10**9, F.concat(F.lit("other"), i.cast("string")), F.col("title"))
    return own.unionByName(foreign)


def _staged(t: Tables):
    works = t.written_works(*WORK_FIELDS)
    return staging.stage_items(items(t, works), known_works(t, works), known_staged(t, works), HOSTS)


_ITEMS = r"""
ritems as (select id*2 as position, id, title t from works union all select id*2+1, id, case when id%37=0 then title || ' b' else title end from works where id%29=0 or id%37=0),
items as (select position, id, case when id%20=0 then '' else concat('c', cast(id as varchar)) end ext,
  case when id%20=0 then null when id%97=0 then 'ZZZ-00001' else product_code end code,
  case when id%20=0 then null when id%97=0 then 'ZZZ00001' else regexp_replace(product_code,'[^A-Z0-9]','','g') end code_key,
  case when id%11=0 then null else t end title, performer, maker, series, genre,
  concat(case when id%13=0 then 'http' else 'https' end, '://www.shop.example/d/', cast(id as varchar)) official_url,
  case when id%17<>0 then concat('https://al.shop.example/?a=', cast(id as varchar)) end affiliate_url,
  1000.0 + id%1000 price,
  case when id%11=0 then 'blank' else t end pay from ritems join works using (id)),
kworks as (select id, case when id%3=0 then concat('c', cast(id as varchar)) end ext, regexp_replace(product_code,'[^A-Z0-9]','','g') code_key,
  case when id%2=0 then title else 'old' end title, performer, maker, series, genre from works where id%3=0 or (id%3=1 and id%5=0)),
kstaged as (select id + 1000000000 id, concat('c', cast(id as varchar)) ext, regexp_replace(product_code,'[^A-Z0-9]','','g') code_key,
  case when id%2=0 then title else 'old' end title, performer, maker, series, genre, case when id%14=0 then 'needs_review' else 'new' end preview_status, case when id%21=0 then id end linked from works where id%7=0
  union all select id + 2000000000, concat('other', cast(id as varchar)), regexp_replace(product_code,'[^A-Z0-9]','','g'), title, performer, maker, series, genre,
  case when id%14=0 then 'needs_review' else 'new' end, case when id%21=0 then id end from works where id%19=0)
"""
_STAGED = _ITEMS + r""",
batch_ids as (select ext, count(*) copies, count(distinct pay) hashes from items where ext<>'' group by 1),
batch_codes as (select code_key, count(distinct ext) ids from items where ext<>'' and code_key is not null group by 1),
firsts as (select *, case when ext<>'' then ext else concat('missing:', cast(id as varchar), pay) end skey from items
  qualify row_number() over (partition by case when ext<>'' then ext else concat('missing:', cast(id as varchar), pay) end order by position) = 1),
se as (select ext, count(*) n, min(id) id, arg_min(title,id) title, arg_min(performer,id) performer, arg_min(maker,id) maker, arg_min(series,id) series, arg_min(genre,id) genre,
  arg_min(preview_status,id) preview_status, max(linked) linked from kstaged group by 1),
we as (select ext, count(*) n, min(id) id, arg_min(title,id) title, arg_min(performer,id) performer, arg_min(maker,id) maker, arg_min(series,id) series, arg_min(genre,id) genre from kworks where ext is not null group by 1),
wc as (select code_key, count(*) n, min(id) id, arg_min(title,id) title, arg_min(performer,id) performer, arg_min(maker,id) maker, arg_min(series,id) series, arg_min(genre,id) genre from kworks group by 1),
j as (select f.*, copies, hashes, ids, se.n sn, se.id sid, se.preview_status sprev, se.linked, we.n wn, we.id wid, wc.n cn, wc.id cid,
  (select count(*) from kstaged k where k.code_key = f.code_key and k.ext <> f.ext) foreign_n,
  case when (f.title,f.performer,f.maker,f.series,f.genre) is not distinct from (se.title,se.performer,se.maker,se.series,se.genre) then 'unchanged' else 'update' end s_cmp,
  case when (f.title,f.performer,f.maker,f.series,f.genre) is not distinct from (we.title,we.performer,we.maker,we.series,we.genre) then 'unchanged' else 'update' end w_cmp,
  case when (f.title,f.performer,f.maker,f.series,f.genre) is not distinct from (wc.title,wc.performer,wc.maker,wc.series,wc.genre) then 'unchanged' else 'update' end c_cmp,
  concat_ws('|', case when f.ext='' then 'external_product_id_missing' end, case when code is null then 'product_code_missing' end,
    case when f.code_key is null then 'normalized_product_code_missing' end, case when f.title is null then 'title_missing' end,
    case when f.performer is null then 'performer_metadata_missing' end, case when official_url not like 'https:%' then 'official_url_not_allowed' end,
    case when affiliate_url is null then 'affiliate_url_missing' end) safety
  from firsts f left join batch_ids on batch_ids.ext=f.ext left join batch_codes on batch_codes.code_key=f.code_key
  left join se on se.ext=f.ext left join we on we.ext=f.ext left join wc on wc.code_key=f.code_key),
staged as (select *, case when safety<>'' then 'needs_review' when copies>1 and hashes>1 then 'needs_review' when copies>1 then case when sn=1 then s_cmp else 'new' end
    when ids>1 then 'needs_review' when sn>1 or wn>1 then 'needs_review' when sn=1 then s_cmp when foreign_n>0 then 'needs_review'
    when cn>1 or (wn=1 and cn=1 and wid<>cid) then 'needs_review' when wn=1 then w_cmp when cn=1 then c_cmp else 'new' end preview_status,
  case when safety<>'' then safety when copies>1 and hashes>1 then 'same_external_id_payload_conflict' when copies>1 then ''
    when ids>1 then 'normalized_code_batch_collision' when sn>1 or wn>1 then 'external_id_match_ambiguous' when sn=1 then '' when foreign_n>0 then 'normalized_code_source_collision'
    when cn>1 or (wn=1 and cn=1 and wid<>cid) then 'work_match_ambiguous' else '' end reasons,
  coalesce(case when sn=1 then linked end, case when wn=1 then wid end, case when cn=1 and foreign_n=0 then cid end) matched from j)
"""


@query("B14_normalize_items", f"with {_ITEMS} select position, ext external_product_id, code product_code, code_key, title, performer performers, maker, series, "
       "genre genres, '2020-01-02' release_date, official_url, affiliate_url, price::double price from items", "works")
def normalize(t: Tables):
    join = lambda c: F.array_join(c, "|").alias(c)
    return items(t).select("position", "external_product_id", "product_code", "code_key", "title", join("performers"), "maker", "series", join("genres"),
                           "release_date", "official_url", "affiliate_url", "price")


@query("A4_read_item_list", f"""with {_ITEMS} select cast(position // 100 as varchar) page, cast(row_number() over (partition by position // 100 order by position) - 1 as int) as position,
  ext external_product_id, title from items""", "works")
def read_items(t: Tables):
    # pages of the feed as they are sent, opened again item by item
    rows = raw_items(t).withColumn("page", F.floor(F.col("position") / 100).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "raw")))
    pages = rows.groupBy("page").agg(F.transform(ordered, lambda e: e["raw"]).alias("raws"))
    pages = pages.select("page", F.concat(F.lit('{"result":{"items":['), F.array_join("raws", ","), F.lit("]}}")).alias("body"))
    return item_list.normalize_items(item_list.explode_items(pages)).select("page", "position", "external_product_id", "title")


@query("I1_stage_items", f"with {_STAGED} select position, preview_status, reasons, case when preview_status<>'needs_review' then matched end duplicate_work_id, case when sn=1 then sid end existing_staged_id from staged", "works")
def stage(t: Tables):
    return _staged(t).select("position", "preview_status", F.array_join("review_reasons", "|").alias("reasons"), "duplicate_work_id", "existing_staged_id")


@query("I1_stage_counts", f"with {_STAGED} select count(*) staged, " + ", ".join(f"count(*) filter (where preview_status='{s}') \"{s}\"" for s in K.PREVIEW_STATES) + " from staged", "works")
def stage_counts(t: Tables):
    return staging.stage_counts(_staged(t))


@query("I2_safety_reasons", f"with {_STAGED} select position, safety reasons from j", "works")
def safety(t: Tables):
    from colophon.operators.ranking import latest_per_key

    key = F.when(F.col("external_product_id") != "", F.col("external_product_id")).otherwise(F.col("payload_hash"))
    first = latest_per_key(items(t).withColumn("k", key), ["k"], [("position", "asc")])
    return first.select("position", F.array_join(staging.safety_reasons(HOSTS), "|").alias("reasons"))


@query("I3_merge_stage_state", f"""with {_STAGED} select position, case when sn=1 and sprev in ('needs_review','duplicate') then sprev else preview_status end preview_status,
  'pending' review_status, cast(case when sn=1 then 3 else 1 end as bigint) attempt_count, nullif(replace(reasons,'|',','),'') error_message from staged""", "works")
def merge_state(t: Tables):
    products = _staged(t)
    rows = staging.merge_stage_state(products, "feed", "2024-01-31").join(products.select("external_product_id", "position"), "external_product_id")
    return rows.select("position", "preview_status", "review_status", "attempt_count", "error_message")


@query("E14_reason_counts", f"with {_STAGED} select reason, count(*) n from (select unnest(string_split(reasons,'|')) reason from staged where reasons<>'') group by 1", "works")
def reasons(t: Tables):
    return staging.reason_counts(_staged(t), "review_reasons")


@query("E14_class_counts", f"with {_STAGED} select c as class, (select count(*) from staged where preview_status=c) n from (values " + ",".join(f"('{s}')" for s in K.PREVIEW_STATES) + ") v(c)", "works")
def classes(t: Tables):
    return staging.class_counts(_staged(t), "preview_status", K.PREVIEW_STATES)


@query("E15_null_counts", f"""with {_ITEMS} select 'external_product_id' field, count(*) filter (where ext='') n from items union all select 'title', count(*) filter (where title is null) from items
  union all select 'affiliate_url', count(*) filter (where affiliate_url is null) from items""", "works")
def nulls(t: Tables):
    return staging.null_counts(items(t), ["external_product_id", "title", "affiliate_url"])


@query("E16_batch_report", f"""with {_STAGED} select (select count(*) from items) received, (select count(*) from items where ext<>'' and code is not null and title is not null) normalized,
  (select count(*) from items where code is null) missing_product_code, (select count(*) from items where performer is null) missing_performer, (select count(*) from items where maker is null) missing_maker,
  (select count(*) from items where affiliate_url is not null) affiliate_urls, count(*) staged, count(*) filter (where preview_status='new') "new", count(*) filter (where preview_status='needs_review') needs_review,
  (select count(*) from batch_ids where copies>1) repeated_ids, (select count(*) from batch_codes where ids>1) codes_with_many_ids,
  (select count(*) from items where ext in (select ext from kworks where ext is not null) or code_key in (select code_key from kworks)) in_works,
  (select count(*) from items where ext in (select ext from kstaged) or code_key in (select code_key from kstaged)) in_staged from staged""", "works")
def report(t: Tables):
    # read by six counts and the staging
    works = t.written_works(*WORK_FIELDS)
    known, staged = known_works(t, works), known_staged(t, works)
    found = reuse(items(t, works).drop("raw"), "items")
    out = staging.batch_report(found, staging.stage_items(found, known, staged, HOSTS), known, staged)
    return out.select("received", "normalized", "missing_product_code", "missing_performer", "missing_maker", "affiliate_urls", "staged", "new", "needs_review",
                      "repeated_ids", "codes_with_many_ids", "in_works", "in_staged")


@query("E16_url_hosts", f"with {_ITEMS} select 'official_url' field, 'www.shop.example' host, count(*) urls from items union all select 'affiliate_url', 'al.shop.example', count(*) from items where affiliate_url is not null", "works")
def hosts(t: Tables):
    return staging.url_hosts(items(t), ["official_url", "affiliate_url"])


@query("D5_match_works", f"with {_ITEMS} select id from kworks where ext in (select ext from items) or lower(code_key) in (select lower(code_key) from items)", "works")
def match(t: Tables):
    known = known_works(t).withColumn("product_code", F.col("code_key"))
    return staging.match_works_for_import(items(t), known).select("id")


@query("H3_mark_existing", f"with {_ITEMS} select position, coalesce(ext in (select ext from kworks where ext is not null), false) or coalesce(code_key in (select code_key from kworks), false) already_exists from items", "works")
def mark(t: Tables):
    return staging.mark_existing(items(t), known_works(t).select("external_product_id", "code_key")).select("position", "already_exists")


@query("H6_batch_duplicates", f"""with {_STAGED} select ext as name, 'id' kind, hashes > 1 conflict from batch_ids where copies > 1 union all select code_key, 'code', null from batch_codes where ids > 1""", "works")
def duplicates(t: Tables):
    repeated, shared = staging.batch_duplicates(items(t))
    a = repeated.select(F.col("external_product_id").alias("name"), F.lit("id").alias("kind"), "conflict")
    return a.unionByName(shared.select(F.col("code_key").alias("name"), F.lit("code").alias("kind"), F.lit(None).cast("boolean").alias("conflict")))


def renamed_works(t: Tables):
    """All works, two thirds under a code that no item has."""
    return t.works("id", "product_code").withColumn("product_code", F.expr("case when id % 3 = 0 then product_code else 'OLD-' || product_code end"))


@query("D6_find_duplicates", """
with k as (select id, status, nullif(regexp_replace(upper(trim(product_code)),'[^A-Z0-9]','','g'),'') code from source_items),
others as (select a.id, b.id other, row_number() over (partition by a.id order by b.status='promoted' desc, b.id) r from k a join k b on a.code=b.code and a.id<>b.id and b.status in ('pending','promoted'))
select k.id, other duplicate_of, (select min(w.id) from works w where regexp_replace(upper(case when w.id % 3 = 0 then w.product_code else 'OLD-' || w.product_code end),'[^A-Z0-9]','','g') = k.code) duplicate_work_id
from k left join others on others.id = k.id and r = 1""", "source_items works")
def find_duplicates(t: Tables):
    return staging.find_candidate_duplicates(t.source_items().select("id", "status", "product_code"), renamed_works(t))


# -- publication ------------------------------------------------------------------------------------
_GATE = r"""
g as (select id, product_code, case when id%9=0 then ' ' else title end title, performer, case when id%4=0 then 'feed' end source_name,
  case when id%5=0 then concat('x', cast(id//2*2 as varchar)) else concat('y', cast(id as varchar)) end ext,
  concat('https://shop.example/', cast(id as varchar)) official_url, case when id%6=0 then 'http://shop.example/a' when id%7=0 then null else 'https://a.shop.example/' end affiliate_url,
  case when id%8=0 then 'https://evil.example/i.jpg' when id%10=0 then null else 'https://pics.shop.example/i.jpg' end image, case when id%3<>0 then id end pid from works)
"""


def _gate_works(t: Tables):
    w, i = t.works("id", "product_code", "title", "performer"), F.col("id")
    return w.select(
        "id", "product_code", F.when(i % 9 == 0, " ").otherwise(F.col("title")).alias("title"), "performer", F.when(i % 4 == 0, "feed").alias("source_name"),
        F.when(i % 5 == 0, F.concat(F.lit("x"), (F.floor(i / 2) * 2).cast("string"))).otherwise(F.concat(F.lit("y"), i.cast("string"))).alias("external_product_id"),
        F.concat(F.lit("https://shop.example/"), i.cast("string")).alias("official_url"),
        F.when(i % 6 == 0, "http://shop.example/a").when(i % 7 == 0, None).otherwise("https://a.shop.example/").alias("affiliate_url"),
        F.when(i % 8 == 0, "https://evil.example/i.jpg").when(i % 10 == 0, None).otherwise("https://pics.shop.example/i.jpg").alias("card_image_url"),
        F.lit(None).cast("string").alias("image_url"), F.when(i % 3 != 0, i).alias("performer_id"))


@query("I5_publication_reasons", f"""with {_GATE} select id, concat_ws('|', case when trim(title)='' then 'title_missing' end, case when source_name is null then 'source_provenance_missing' end,
  case when affiliate_url is null then 'affiliate_url_missing' when affiliate_url like 'http:%' then 'affiliate_url_not_allowed' end,
  case when image is null then 'image_missing' when image like '%evil%' then 'image_url_not_allowed' end,
  case when performer is null then 'performer_metadata_missing' end, case when pid is null or id not in (select work_id from work_performers) then 'performer_relation_missing' end,
  case when id%2=0 then 'source_relation_missing' end, case when (select count(*) from g b where b.ext=g.ext) > 1 then 'duplicate_detected' end) reasons from g""", "works work_performers")
def publication_gate(t: Tables):
    links = t.works("id").filter("id % 2 = 1").withColumnRenamed("id", "work_id")
    out = publication.publication_reasons(_gate_works(t), t.work_performers(), links, HOSTS, HOSTS)
    return out.select("id", F.array_join("reasons", "|").alias("reasons"))


def _stored_products(t: Tables):
    """Staged products as the next step reads them: ids, source and link columns added."""
    p = _staged(t)
    return p.select(
        F.col("position").alias("id"), "external_product_id", "product_code", "code_key", "code_rejection", "title", "performers", "maker", "series", "label", "genres",
        "release_date", "description", "card_image_url", "image_url", "sample_images", "video_url", "official_url", "affiliate_url", "price",
        F.lit("pending").alias("review_status"), "preview_status", F.col("duplicate_work_id").alias("linked_work_id"), F.lit(1).alias("data_source_id"), F.lit("2024-01-31").alias("fetched_at"))


def _pending_products(t: Tables):
    """Staged products, and for some of them a second product of the same work."""
    p = _stored_products(t).withColumn("_again", F.explode(F.when(F.col("id") % 8 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    changed = {
        "id": F.col("id") + F.lit(10**10), "external_product_id": F.concat(F.lit("again-"), "external_product_id"), "title": F.concat("title", F.lit(" again")),
        "maker": F.lit(None).cast("string"), "price": F.col("price") + 1,
    }
    return p.select(*[F.when(F.col("_again"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c for c in p.columns if c != "_again"])


def _promoted(t: Tables, name: str):
    return publication.promote(_pending_products(t), _catalog(t), HOSTS, "feed")[name]


def _known_id(t: Tables, rows, column: str):
    """Rows with the id of a work that was there before, else null."""
    known = _catalog(t).select(F.col("id").alias(column), F.col("id").alias("known_work_id"))
    return rows.join(known, column, "left")


def _catalog(t: Tables):
    i = F.col("id")
    w = t.works("id", "product_code", "title", "performer", "maker", "series", "genre", "popularity", "favorite_count", "is_published")
    known = w.filter("id % 3 = 0 or (id % 3 = 1 and id % 5 = 0)")
    extra = ("official_url", "affiliate_url", "source_name", "external_product_id", "source_checked_at")
    return known.withColumn("title", F.when(i % 2 == 0, F.col("title")).otherwise("old")).select("*", *[F.lit(None).cast("string").alias(c) for c in extra])


_READY = """ready as (select *, coalesce(matched, cid) target from staged where preview_status in ('new','update','unchanged')),
products as (select position as id, ext, price, affiliate_url, target from ready
  union all select position + 10000000000, concat('again-', ext), price + 1, affiliate_url, target from ready where position % 8 = 0)"""


@query("I4_promote_works", f"""with {_STAGED}, {_READY} select code product_code, case when position%8=0 then title || ' again' else title end title, maker,
  case when position%8=0 then concat('again-', ext) else ext end external_product_id, target is null is_new from ready
  union all select product_code, case when id%2=0 then title else 'old' end, maker, null, false from works where (id%3=0 or (id%3=1 and id%5=0)) and id not in (select target from ready where target is not null)""", "works")
def promote_works(t: Tables):
    flag = _catalog(t).select("id", F.lit(False).alias("is_new"))
    return _promoted(t, "works").join(flag, "id", "left").select("product_code", "title", "maker", "external_product_id", F.coalesce("is_new", F.lit(True)).alias("is_new"))


@query("I4_promote_errors", f"""with {_STAGED} select position as id, 'review required' message from staged where preview_status='needs_review'
  union all select position + 10000000000, 'review required' from staged where preview_status='needs_review' and position%8=0""", "works")
def promote_errors(t: Tables):
    return _promoted(t, "errors")


@query("I4_promote_change_log", f"""with {_STAGED}, {_READY} select w.product_code, case when (case when w.id%2=0 then w.title else 'old' end) is distinct from (case when position%8=0 then r.title || ' again' else r.title end) then 'title|' else '' end ||
  'official_url|affiliate_url|external_product_id|source_name|source_checked_at' changed_fields from ready r join works w on w.id = r.target""", "works")
def promote_log(t: Tables):
    codes = _catalog(t).select(F.col("id").alias("work_id"), "product_code")
    return _promoted(t, "change_log").join(codes, "work_id").select("product_code", F.array_join("changed_fields", "|").alias("changed_fields"))


@query("I4_promote_offers", f"with {_STAGED}, {_READY} select id staged_id, ext external_product_id, price::double price, affiliate_url, target known_work_id from products", "works")
def promote_offers(t: Tables):
    return _known_id(t, _promoted(t, "offers"), "work_id").select("staged_id", "external_product_id", "price", "affiliate_url", "known_work_id")


@query("I4_promote_source_links", f"""with {_STAGED}, {_READY} select p.id staged_id, p.target known_work_id, case when r.position%8=0 then 2 else 1 end work_products
  from products p join ready r on r.position = p.id % 10000000000""", "works")
def promote_links(t: Tables):
    links = _promoted(t, "source_links")
    counts = links.groupBy("work_id").agg(F.count("*").cast("int").alias("work_products"))
    return _known_id(t, links.join(counts, "work_id"), "work_id").select("staged_id", "known_work_id", "work_products")


@query("I4_promote_staged_updates", f"""with {_STAGED}, {_READY} select id, 'promoted' review_status, target known_work_id, null::varchar error_message from products
  union all select position, 'error', null, 'review required' from staged where preview_status='needs_review'
  union all select position + 10000000000, 'error', null, 'review required' from staged where preview_status='needs_review' and position%8=0""", "works")
def promote_updates(t: Tables):
    return _known_id(t, _promoted(t, "staged_updates"), "promoted_work_id").select("id", "review_status", "known_work_id", "error_message")


def _candidates(t: Tables):
    i = F.col("position")
    return items(t).withColumn("expected_id", F.when(i % 82 == 0, "else").otherwise(F.col("external_product_id"))).withColumn("expected_code", F.col("code_key"))


@query("I24_freeze_records", f"""with {_STAGED} select i.position, case when i.position%82=0 then 'INVALID' when i.ext<>'' and i.position > (select min(position) from items b where b.ext=i.ext) then 'DUPLICATE'
  when i.ext='' then 'INVALID' when s.preview_status='new' and s.reasons='' then 'SAFE_NEW' when s.preview_status='unchanged' then 'EXISTING_UNCHANGED' when s.preview_status='update' then 'EXISTING_UPDATE'
  when regexp_matches(s.reasons,'duplicate|collision|ambiguous') then 'DUPLICATE' else 'NEEDS_REVIEW' end classification
  from items i left join staged s on s.ext=i.ext and i.ext<>''""", "works")
def freeze(t: Tables):
    return staging.freeze_records(_candidates(t), _staged(t)).select("position", "classification")


@query("I25_verify_frozen", f"""with {_STAGED} select i.position, concat_ws('|', case when coalesce(s.preview_status,'')<>'new' or s.position<>i.position or i.position%82=0 then 'classification' end, case when i.position%6=0 then 'payload_hash' end,
  case when performer is null then 'performer' end, nullif(replace(concat_ws(',', case when i.ext='' then 'external_product_id_missing' end, case when i.code is null then 'product_code_missing' end,
    case when i.code_key is null then 'normalized_product_code_missing' end, case when i.title is null then 'title_missing' end, case when i.performer is null then 'performer_metadata_missing' end,
    case when i.official_url not like 'https:%' then 'official_url_not_allowed' end, case when i.affiliate_url is null then 'affiliate_url_missing' end),'|',','),'')) issues
  from items i left join (select ext e, position, preview_status from staged where ext<>'') s on s.e=i.ext""", "works")
def verify(t: Tables):
    frozen = staging.freeze_records(_candidates(t), _staged(t)).withColumn("frozen_id", F.col("external_product_id")).withColumn("frozen_code", F.col("code_key"))
    frozen = frozen.withColumn("payload_hash", F.when(F.col("position") % 6 == 0, "0").otherwise(F.col("payload_hash")))
    return staging.verify_frozen(frozen, HOSTS).select("position", F.array_join("issues", "|").alias("issues"))


@query("I31_safe_pending", f"""with {_STAGED} select position as id, cast((row_number() over (order by position) - 1)//5 as bigint) batch from staged where preview_status='new'""", "works")
def safe_pending(t: Tables):
    return staging.select_safe_pending(_stored_products(t), HOSTS).select("id", "batch")


@query("I26_promotion_states", """
select id source, case when id%6=0 then 'issue:UNKNOWN_SOURCE' when id%5=0 then 'issue:SOURCE_MISMATCH' when id%4=0 then 'completed' when id%4=1 then 'pending' when id%4=2 then 'failed' else 'foreign' end state from works""", "works")
def promotion_states(t: Tables):
    w, i = t.works("id", "product_code"), F.col("id")
    uid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(i.cast("string"), 12, "0"))
    sources = w.select(uid.alias("source_id"), F.lower("product_code").alias("product_code"), F.concat(F.lit("c"), i.cast("string")).alias("external_product_id"), F.lit("m").alias("membership"))
    seen = w.filter("id % 6 <> 0").select(
        uid.alias("id"), F.concat(F.when(i % 5 == 0, "d").otherwise("c"), i.cast("string")).alias("external_product_id"), F.regexp_replace("product_code", "-", "").alias("code_key"),
        F.when(i % 4 == 0, "promoted").when(i % 4 == 1, "pending").when(i % 4 == 2, "error").otherwise("pending").alias("review_status"),
        F.when(i % 4 == 1, "new").otherwise("update").alias("preview_status"), F.when(i % 4 == 0, i).alias("promoted_work_id"))
    issues, states = publication.verify_promotion_input(sources, seen, 10**12, "m", K.UUID_PATTERN)
    rows = issues.filter("source_id is not null").select("source_id", F.concat(F.lit("issue:"), "issue").alias("state")).unionByName(states.select("source_id", "state"))
    return rows.select(F.substring("source_id", 25, 12).cast("bigint").alias("source"), "state")


@query("I27_write_scope", """select id, case when id%11=0 and id%3<>0 then 'UNEXPECTED_MUTATION' when id%3=0 and id%13=0 then 'TARGET_DELTA_MISMATCH' else 'SAVED_ROW_MISMATCH' end issue
  from works where (id%11=0 and id%3<>0) or (id%3=0 and (id%13=0 or id%7=0))""", "works")
def write_scope(t: Tables):
    i = F.col("id")
    rows = t.works("id", "product_code", "price").withColumn("status", F.lit("pending"))
    before = rows.filter("id % 3 <> 0 or id % 13 = 0")
    after = rows.withColumn("price", F.when((i % 11 == 0) & (i % 3 != 0), F.lit(-1.0)).otherwise(F.col("price"))).withColumn("status", F.when((i % 3 == 0) & (i % 7 == 0), "other").otherwise(F.col("status")))
    return publication.verify_write_scope(before, after, rows.filter("id % 3 = 0"), "id", ["product_code"], {"status": "pending"})


@query("I32_exact_scope", """select id, case when id%5=0 then 'WORK_MISSING' when id%7=0 then 'SOURCE_MISSING' when id%10=0 then 'x' when not is_published then 'WORK_NOT_PUBLISHED' when id%11=0 then 'SOURCE_ID_MISMATCH' end issue from works""", "works")
def exact_scope(t: Tables):
    i = F.col("id")
    w = t.works("id", "product_code", "is_published").withColumn("source_name", F.lit("Feed service"))
    handoff = w.select(i.alias("work_id"), "product_code", F.when(i % 11 == 0, "zz").otherwise(F.concat(F.lit("c"), i.cast("string"))).alias("external_product_id"))
    staged = w.filter("id % 7 <> 0").select(F.when(i % 2 == 0, i).alias("promoted_work_id"), F.concat(F.lit("c"), i.cast("string")).alias("external_product_id"), F.regexp_replace("product_code", "-", "").alias("code_key"))
    return publication.exact_scope_rows(handoff, w.filter("id % 5 <> 0"), staged, "feed").select(F.col("work_id").alias("id"), "issue")
