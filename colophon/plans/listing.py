"""Search, listing and facets."""

from pyspark.sql import functions as F

from colophon.functions.codes import code_key_lower, code_key_upper, hyphenate_code, name_key
from colophon.functions.text import trigram_similarity, trigrams
from colophon.operators import ranking, related, search
from colophon.plans import sqltext as S
from colophon.plans.bindings import SITE, Tables
from colophon.plans.registry import query
from colophon.session import reuse, shared_folder
from colophon.sources import exports

SHOWN = ("id", "product_code", "title", "popularity")
SEARCHED = ("id", "product_code", "title", "performer", "maker", "series", "popularity", "created_at", "release_date", "is_published")


# -- keys ------------------------------------------------------------------------------------
def _scalar(name, expr, sql, column="product_code"):
    @query(name, f"select id, {sql} as value from works", "works")
    def run(t: Tables):
        return t.works("id", column).select("id", expr().alias("value"))

    return run


_scalar("B1_code_key_lower", lambda: code_key_lower("product_code"), S.code_lower("product_code"))
_scalar("B2_code_key_upper", lambda: code_key_upper("product_code"), S.code_upper("product_code"))
_scalar("B3_code_key_strict", lambda: code_key_upper(F.concat(F.lower("product_code"), F.lit("-A1")), strict_reference=True),
        "upper(regexp_replace(concat(lower(product_code),'-A1'),'[^A-Z0-9]','','g'))")
_scalar("B5_hyphenate_code", lambda: hyphenate_code(code_key_upper("product_code")),
        f"regexp_replace({S.code_upper('product_code')},'^([A-Za-z]+)([0-9]+)$','\\1-\\2')")


@query("B6_name_key", f"select entity_type, canonical_name, {S.name_key('alias')} as alias_key from aliases", "aliases")
def alias_keys(t: Tables):
    return t.aliases().select("entity_type", "canonical_name", name_key("alias").alias("alias_key"))


@query("B7_trigrams", f"select id, array_to_string(list_sort({S.trigrams('title')}),'|') grams, "
       f"round({S.similarity('title', 'series')},6) similarity from works", "works")
def title_trigrams(t: Tables):
    return t.works("id", "title", "series").select(
        "id", F.array_join(F.array_sort(trigrams("title")), "|").alias("grams"),
        F.round(trigram_similarity("title", "series"), 6).alias("similarity"),
    )


# -- search ------------------------------------------------------------------------------------
def _search_sql(q: str, sort: str = "popularity") -> str:
    code = "".join(ch for ch in q if ch.isascii() and ch.isalnum()).lower()
    name = search.name_key_of(q)
    return f"""
with hits as (select distinct canonical_name from aliases where {S.name_key('alias')} like '%{name}%')
select id, product_code, title, popularity, similarity from (
  select *, round(greatest({S.similarity('product_code', f"'{q}'")}, {S.similarity('title', f"'{q}'")},
                     {S.similarity('performer', f"'{q}'")}, {S.similarity('maker', f"'{q}'")}),6) similarity
  from works where is_published and (
    {S.code_lower('product_code')} like '%{code}%' or {S.name_key('performer')} like '%{name}%'
    or product_code ilike '%{q}%' or title ilike '%{q}%' or maker ilike '%{q}%' or series ilike '%{q}%'
    or performer in (select canonical_name from hits) or maker in (select canonical_name from hits)
    or series in (select canonical_name from hits)))
order by case when {S.code_lower('product_code')} = '{code}' then 0 else 1 end, {sort} desc nulls last, similarity desc, id
limit 100"""


for _name, _q, _sort in (
    ("C1_search_works", "small ring", "popular"),
    ("C1_search_code", "SMA-0010", "new"),
    ("C1_search_alias", "S 12", "release"),
):
    _by = {"popular": "popularity", "new": "created_at", "release": "release_date"}[_sort]

    @query(_name, _search_sql(_q, _by), "works aliases")
    def search_query(t: Tables, q=_q, sort=_sort):
        return search.search_works(t.works(*SEARCHED), t.aliases(), q, sort, 100).select(*SHOWN, "similarity")


_PATTERN = "(product_code ilike '%{q}%' or title ilike '%{q}%' or performer ilike '%{q}%' or maker ilike '%{q}%' or series ilike '%{q}%')"


@query("C2_search_filtered", "select id, product_code, title, popularity from works where is_published and "
       "(product_code ilike '%ring%' or title ilike '%ring%') and maker ilike '%brand#1%' and series ilike '%red%' "
       "order by popularity desc nulls last, created_at desc nulls last, id limit 50", "works")
def search_filtered(t: Tables):
    return search.search_works_filtered(t.works(*SEARCHED), "ring", maker="brand#1", series="red", limit=50).select(*SHOWN)


@query("C3_search_fallback", "select id, product_code, title, popularity from works where is_published and "
       f"({_PATTERN.format(q='red0001')} or product_code ilike '%red-0001%') "
       "order by created_at desc nulls last, id limit 100", "works")
def search_fallback(t: Tables):
    return search.search_works_fallback(t.works(*SEARCHED), "red0001", "new", 100).select(*SHOWN)


@query("C4_alias_hits", f"select distinct canonical_name from aliases where {S.name_key('alias')} like '%redb%'", "aliases")
def alias_hits(t: Tables):
    return search.alias_hits(t.aliases(), "red-b")


@query("C5_work_by_code", """
with wanted as (select distinct replace(product_code,'-','') code from search_logs)
select code, id, product_code from wanted join works on is_published
  and regexp_replace(upper(product_code),'[^A-Z0-9]','','g') = regexp_replace(upper(code),'[^A-Z0-9]','','g')""", "search_logs works")
def work_by_code(t: Tables):
    codes = t.search_logs().select(F.replace("product_code", F.lit("-"), F.lit("")).alias("code")).distinct()
    return search.work_by_code(t.works("id", "product_code", "is_published"), codes).select("code", "id", "product_code")


@query("C6_catalog_works", "select id, product_code, title, popularity from works where is_published and genre='ECONOMY' "
       "order by favorite_count desc nulls last, popularity desc nulls last, created_at desc nulls last, id limit 1000", "works")
def catalog_works(t: Tables):
    cols = (*SHOWN, "favorite_count", "created_at", "genre", "is_published")
    return search.catalog_works(t.works(*cols), "recommended", genre="ECONOMY", limit=1000).select(*SHOWN)


_PERFORMER = "Supplier#000000003"


@query("C7_performer_works", f"select id, product_code, title, popularity from works where is_published and performer='{_PERFORMER}' "
       "and (product_code ilike '%e%' or title ilike '%e%' or maker ilike '%e%' or series ilike '%e%') "
       "order by maker asc nulls last, created_at desc nulls last, id limit 100", "works")
def performer_works(t: Tables):
    return search.performer_works(t.works(*SEARCHED), _PERFORMER, "e", "maker", 100).select(*SHOWN)


@query("C7_count_performer_works", f"select count(*) work_count from works where is_published and performer='{_PERFORMER}'", "works")
def count_performer_works(t: Tables):
    return search.count_performer_works(t.works("performer", "is_published"), _PERFORMER)


for _kind, _value in (("maker", "Brand#3"), ("series", "red widget"), ("genre", "ECONOMY")):

    @query(f"C8_{_kind}_works", f"select id, product_code, title, popularity from works where is_published and {_kind}='{_value}' "
           "order by popularity desc nulls last, id limit 100", "works")
    def works_where(t: Tables, kind=_kind, value=_value):
        return search.works_where(t.works(*SHOWN, kind, "is_published"), kind, value).select(*SHOWN)


@query("C9_tag_works", """
select id, product_code, title, popularity from works where is_published and id in (select work_id from work_tags where tag='red') order by id limit 50 offset 5""", "works work_tags")
def tag_works(t: Tables):
    return search.tag_works(t.works(*SHOWN, "is_published"), t.work_tags(), "red", 50, 5).select(*SHOWN)


@query("C10_popular_tags", "select distinct tag from work_tags where work_id in (select id from works where is_published) order by tag limit 30", "works work_tags")
def popular_tags(t: Tables):
    return search.popular_tags(t.works("id", "is_published"), t.work_tags())


@query("C13_admin_works", "select id, product_code, (select count(*) from works where " + _PATTERN.format(q="gear") + ") total from works where "
       + _PATTERN.format(q="gear") + " order by created_at desc nulls last, id limit 30 offset 30", "works")
def admin_works(t: Tables):
    rows = t.works(*SEARCHED).withColumnRenamed("created_at", "updated_at")
    return search.admin_works(rows, "gear", 2).select("id", "product_code", "total")


@query("C15_newest_works", "select id, product_code from works where is_published order by created_at desc nulls last, id limit 100", "works")
def newest_works(t: Tables):
    return search.newest_works(t.works("id", "product_code", "created_at", "is_published"), 100).select("id", "product_code")


# -- facets and sitemaps --------------------------------------------------------------------------
for _kind in ("maker", "genre"):

    @query(f"E3_facet_{_kind}", f"select {_kind} as name, count(*) work_count, cast(sum(popularity) as bigint) popularity from works "
           f"where is_published and trim({_kind})<>'' group by 1 order by 2 desc, 1 limit 200", "works")
    def facets(t: Tables, kind=_kind):
        return search.facet_counts(t.works(kind, "popularity", "is_published"), kind, 200)


@query("A8_sitemap_pages", f"""select cast(floor((rn-1)/1000) as bigint) page, rn as position, concat('{SITE}/work/', product_code) url,
  strftime(created_at,'%Y-%m-%d') lastmod from (select *, row_number() over (order by id) rn from works where is_published)""", "works")
def sitemap_pages(t: Tables):
    return related.sitemap_pages(t.works("id", "product_code", "created_at", "is_published"), SITE)


@query("A8_sitemap_written", f"""select cast(floor((rn-1)/1000) as bigint) page, concat('{SITE}/work/', product_code, '?a=1&b=<', maker, '>') url,
  strftime(created_at,'%Y-%m-%d') lastmod from (select *, row_number() over (order by id) rn from works where is_published)""", "works")
def sitemap_written(t: Tables):
    """The sitemap as written and read back, with characters that mark-up must escape."""
    works = reuse(t.works("id", "product_code", "maker", "created_at", "is_published"), "works")
    pages = related.sitemap_pages(works, SITE).join(works.select(F.concat(F.lit(f"{SITE}/work/"), "product_code").alias("url"), "maker"), "url")
    path = shared_folder(t.spark, "sitemap")
    exports.write_sitemap(pages.withColumn("url", F.concat("url", F.lit("?a=1&b=<"), "maker", F.lit(">"))), path)
    return exports.read_sitemap(t.spark, path)


@query("A8_sitemap_plan", """select 'works' source, cast(greatest(1, ceil(count(*)/1000)) as bigint) pages from works where is_published
  union all select 'posts', cast(ceil(count(*)/1000) as bigint) from posts""", "works posts")
def sitemap_plan(t: Tables):
    return related.sitemap_plan(t.works("is_published"), t.posts())


@query("A9_entity_sitemap", """
with names as (
  select 'performer' kind, performer as name from works where is_published union all select 'maker', maker from works where is_published
  union all select 'series', series from works where is_published union all select 'genre', genre from works where is_published
  union all select 'tag', tag from work_tags where work_id in (select id from works where is_published))
select distinct kind, name, concat('/', kind, '/', replace(replace(name,' ','%20'),'#','%23')) path from names where name <> ''""", "works work_tags")
def entity_sitemap(t: Tables):
    return related.entity_names(t.works("id", "performer", "maker", "series", "genre", "is_published"), t.work_tags())


@query("B13_work_detail", """select cast(id as varchar) id, product_code, title, performer, maker, series, genre, duration, popularity, favorite_count,
  cast(release_date as varchar) release_date from works where trim(product_code)<>'' and trim(title)<>''""", "works")
def work_detail(t: Tables):
    rows = search.to_work_detail(t.works(), ("images.example",))
    return rows.select("id", "product_code", "title", "performer", "maker", "series", "genre", "duration", "popularity", "favorite_count", "release_date")


# -- joins and windows of the listing layer --------------------------------------------------------
@query("D4_work_cast", """select id, product_code, cast(position as bigint) as position, s_name performer from works left join work_performers on work_id = id
  left join supplier on s_suppkey = performer_id""", "works work_performers")
def work_cast(t: Tables):
    return related.work_cast(t.works("id", "product_code"), t.work_performers(), t.performers())


@query("G3_keyset_page", "select id, product_code from works where id > 500 order by id limit 100", "works")
def keyset(t: Tables):
    return ranking.keyset_page(t.works("id", "product_code"), "id", 500, 100)


@query("F1_rank_global", "select id, row_number() over (order by price desc nulls last, id) as rank from works", "works")
def rank_global(t: Tables):
    return ranking.numbered(t.works("id", "price"), [], [("price", "desc"), ("id", "asc")]).select("id", "rank")


@query("F2_rank_within", "select id, maker, row_number() over (partition by maker order by price desc nulls last, id) as rank from works", "works")
def rank_within(t: Tables):
    return ranking.numbered(t.works("id", "maker", "price"), ["maker"], [("price", "desc"), ("id", "asc")]).select("id", "maker", "rank")


@query("F2_top_within", "select * from (select id, maker, cast(row_number() over (partition by maker order by price desc nulls last, id) as int) as rank from works) where rank <= 5", "works")
def top_within(t: Tables):
    return ranking.top_within(t.works("id", "maker", "price"), ["maker"], [("price", "desc"), ("id", "asc")], 5).select("id", "maker", "rank")


@query("F3_latest_per_key", "select distinct on (session_id) session_id, event_id, work_id from page_views order by session_id, ts desc, event_id", "page_views")
def latest(t: Tables):
    return ranking.latest_per_key(t.page_views(), ["session_id"], [("ts", "desc"), ("event_id", "asc")]).select("session_id", "event_id", "work_id")


@query("F4_observation_span", """select work_id, cast(min(event_id) as bigint) first_event_id, cast(max(event_id) as bigint) last_event_id,
  arg_min(session_id, event_id) first_session_id, arg_max(session_id, event_id) last_session_id from page_views group by 1""", "page_views")
def span(t: Tables):
    return ranking.observation_span(t.page_views(), ["work_id"], "event_id", ["event_id", "session_id"])


@query("F5_best_and_runner_up", """select series, max(case when r=1 then id end) best_id, max(case when r=2 then id end) runner_id,
  max(case when r=1 then price end) best_price, max(case when r=2 then price end) runner_price,
  round(max(case when r=1 then price end) - coalesce(max(case when r=2 then price end),0),6) score_delta
  from (select *, row_number() over (partition by series order by price desc nulls last, id) r from works) where r<=2 group by 1""", "works")
def best_and_runner_up(t: Tables):
    out = ranking.best_and_runner_up(t.works("id", "series", "price"), ["series"], [("price", "desc"), ("id", "asc")], "price", ["id"])
    return out.withColumn("score_delta", F.round("score_delta", 6))
