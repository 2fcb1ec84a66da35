"""Rollups and rankings."""

from pyspark.sql import functions as F

from colophon.operators import metrics, ranking, related
from colophon.operators.joins import by_key
from colophon.plans.bindings import AS_OF, Tables
from colophon.plans.registry import query
from colophon.session import reuse

_METRICS_SQL = """
with counted as (
  select w.*, v.*, s.*, c.* from works w
  left join (select work_id v_id, count(*) filter (where ts >= timestamp '{t}' - interval 1 day) v_day,
      count(*) filter (where ts >= timestamp '{t}' - interval 7 day) v_week,
      count(*) filter (where ts >= timestamp '{t}' - interval 30 day) v_month, count(*) v_all
      from page_views group by 1) v on v_id = w.id
  left join (select upper(product_code) s_code, count(*) filter (where ts >= timestamp '{t}' - interval 1 day) s_day,
      count(*) filter (where ts >= timestamp '{t}' - interval 7 day) s_week,
      count(*) filter (where ts >= timestamp '{t}' - interval 30 day) s_month, count(*) s_all
      from search_logs group by 1) s on s_code = upper(w.product_code)
  left join (select work_id c_id, count(*) filter (where ts >= timestamp '{t}' - interval 1 day) c_day,
      count(*) filter (where ts >= timestamp '{t}' - interval 7 day) c_week,
      count(*) filter (where ts >= timestamp '{t}' - interval 30 day) c_month, count(*) c_all
      from affiliate_clicks group by 1) c on c_id = w.id
  where w.is_published),
periods(period) as (values ('day'),('week'),('month'),('all')),
m as (
  select upper(product_code) entity_key, product_code, performer, maker, series, popularity, period,
    coalesce(case period when 'day' then v_day when 'week' then v_week when 'month' then v_month else v_all end,0) views,
    coalesce(case period when 'day' then s_day when 'week' then s_week when 'month' then s_month else s_all end,0) searches,
    coalesce(case period when 'day' then c_day when 'week' then c_week when 'month' then c_month else c_all end,0) clicks
  from counted, periods),
entity as (
  select 'performer' entity_type, performer entity_key, * exclude (entity_key, performer, maker, series) from m where performer is not null
  union all select 'maker', maker, * exclude (entity_key, performer, maker, series) from m where maker is not null
  union all select 'series', series, * exclude (entity_key, performer, maker, series) from m where series is not null),
entity_sum as (
  select entity_type, entity_key, period, sum(searches) searches, sum(clicks) clicks,
    round(cast(sum(searches) + 2*sum(clicks) as double) + sum(popularity)*cast(0.01 as double), 6) score,
    count(distinct product_code) work_count from entity group by all),
result as (
  select 'work' entity_type, entity_key, period, cast(views as bigint) views, cast(searches as bigint) searches,
    cast(clicks as bigint) clicks, cast(searches + 2*clicks as double) score,
    row_number() over (partition by period order by popularity desc, product_code) as rank, cast(null as bigint) work_count from m
  union all
  select entity_type, entity_key, period, 0, cast(searches as bigint), cast(clicks as bigint), score,
    row_number() over (partition by period, entity_type order by score desc, entity_key), work_count from entity_sum)
""".replace("{t}", AS_OF)

_METRIC_VIEWS = "works page_views search_logs affiliate_clicks"
METRIC_WORKS = ("id", "product_code", "performer", "maker", "series", "popularity", "is_published")


def _metrics(t: Tables):
    return metrics.discovery_metrics(t.works(*METRIC_WORKS), t.page_views(), t.search_logs(), t.affiliate_clicks(), AS_OF)


@query("E5_discovery_metrics", _METRICS_SQL + "select * from result", _METRIC_VIEWS)
def discovery_metrics(t: Tables):
    return _metrics(t)


@query("E5_metric_totals", _METRICS_SQL + "select entity_type, period, count(*) entities, cast(sum(searches) as bigint) searches, "
       "cast(sum(clicks) as bigint) clicks from result group by all", _METRIC_VIEWS)
def metric_totals(t: Tables):
    return _metrics(t).groupBy("entity_type", "period").agg(
        F.count("*").alias("entities"), F.sum("searches").alias("searches"), F.sum("clicks").alias("clicks"))


@query("E11_entity_ranking", _METRICS_SQL + "select entity_key, rank, score, searches, clicks, work_count from result "
       "where entity_type='performer' and period='week' order by rank limit 50", _METRIC_VIEWS)
def entity_ranking(t: Tables):
    return metrics.entity_ranking(_metrics(t), "performer", "week", 50).select("entity_key", "rank", "score", "searches", "clicks", "work_count")


_PERIOD_TABLE = "(values ('day', timestamp '{t}' - interval 1 day), ('week', timestamp '{t}' - interval 7 day), ('month', timestamp '{t}' - interval 30 day), ('all', timestamp '1900-01-01')) p(period, cutoff)".replace("{t}", AS_OF)

_V1_SQL = f"""
with s as (select period, upper(product_code) k, count(*) searches from search_logs, {_PERIOD_TABLE} where ts >= cutoff group by all),
c as (select period, upper(w.product_code) k, count(*) clicks from affiliate_clicks a join works w on w.id = a.work_id, {_PERIOD_TABLE} where ts >= cutoff group by all),
sr as (select *, row_number() over (partition by period order by searches desc, k) r from s),
cr as (select *, row_number() over (partition by period order by clicks desc, k) r from c),
m as (select coalesce(sr.period, cr.period) period, coalesce(sr.k, cr.k) k, coalesce(searches,0) searches, coalesce(clicks,0) clicks,
        coalesce(searches,0) + 2*coalesce(clicks,0) score, case when sr.k is not null and cr.k is not null then null else coalesce(sr.r, cr.r) end r
      from sr full join cr on sr.k = cr.k and sr.period = cr.period),
e as (select entity_type, entity_key, period, product_code, popularity, coalesce(searches,0) searches, coalesce(clicks,0) clicks from (
        select 'performer' entity_type, performer entity_key, product_code, popularity from works where performer is not null
        union all select 'maker', maker, product_code, popularity from works union all select 'series', series, product_code, popularity from works) w
      cross join (values ('day'),('week'),('month'),('all')) p(period) left join m using (period) where coalesce(m.k, upper(w.product_code)) = upper(w.product_code) or m.k is null),
e2 as (select w.entity_type, w.entity_key, w.period, w.product_code, w.popularity, coalesce(m.searches,0) searches, coalesce(m.clicks,0) clicks from (
        select * from (select 'performer' entity_type, performer entity_key, product_code, popularity from works where performer is not null
        union all select 'maker', maker, product_code, popularity from works union all select 'series', series, product_code, popularity from works)
        cross join (values ('day'),('week'),('month'),('all')) p(period)) w left join m on m.period = w.period and m.k = upper(w.product_code)),
es as (select entity_type, entity_key, period, sum(searches) searches, sum(clicks) clicks,
        round(cast(sum(searches)+2*sum(clicks) as double) + sum(popularity)*cast(0.01 as double),6) score, count(distinct product_code) work_count from e2 group by all)
select 'work' entity_type, k entity_key, period, cast(searches as bigint) searches, cast(clicks as bigint) clicks, cast(score as double) score,
  cast(r as bigint) as rank, cast(null as bigint) work_count from m
union all select entity_type, entity_key, period, cast(searches as bigint), cast(clicks as bigint), score,
  row_number() over (partition by period, entity_type order by score desc, entity_key), work_count from es"""
_V1_SQL = _V1_SQL[: _V1_SQL.index("e as (select")] + _V1_SQL[_V1_SQL.index("e2 as (select"):]


@query("E6_discovery_metrics_v1", _V1_SQL, "works search_logs affiliate_clicks")
def metrics_v1(t: Tables):
    works = t.works("id", "product_code", "performer", "maker", "series", "popularity")
    return metrics.discovery_metrics_v1(works, t.search_logs(), t.affiliate_clicks(), AS_OF)


@query("E7_keyword_metrics", f"""
with q as (select product_code entity_key, period, count(*) searches from search_logs cross join {_PERIOD_TABLE}
  where source='web_search' and ts >= cutoff and period <> 'day' group by all)
select *, cast(searches as double) score, row_number() over (partition by period order by searches desc, entity_key) as rank from q""", "search_logs")
def keyword_metrics(t: Tables):
    return metrics.keyword_metrics(t.search_logs(), AS_OF)


_POPULAR = """select upper(s.product_code) product_code, count(*) search_count from search_logs s
  join works w on upper(w.product_code) = upper(s.product_code) and w.is_published {where}
  group by 1 order by 2 desc, 1 limit {limit}"""


@query("E1_popular_works", _POPULAR.format(where="", limit=20), "search_logs works")
def popular_works(t: Tables):
    return metrics.popular_works(t.search_logs(), t.works("product_code", "is_published"))


@query("E2_popular_works_period", _POPULAR.format(where=f"where s.ts >= timestamp '{AS_OF}' - interval 7 day", limit="40 offset 10"), "search_logs works")
def popular_works_period(t: Tables):
    return metrics.popular_works_period(t.search_logs(), t.works("product_code", "is_published"), AS_OF, 7, 40, 10)


@query("D1_search_counts", _POPULAR.format(where="", limit="1000000000"), "search_logs works")
def search_counts(t: Tables):
    return metrics.search_counts(t.search_logs(), t.works("product_code", "is_published"))


@query("E10_performer_ranking", f"""
with top as ({_POPULAR.format(where="", limit="all")})
select performer, cast(sum(greatest(search_count,1)) as bigint) searches from top join works w on upper(w.product_code) = top.product_code
where is_published and performer is not null group by 1 order by 2 desc, 1 limit 8""", "search_logs works")
def performer_ranking(t: Tables):
    return metrics.performer_ranking(t.search_logs(), t.works("product_code", "performer", "is_published"))


@query("D10_event_counts", """select id, coalesce(v,0) views, coalesce(s,0) searches, coalesce(c,0) clicks from works
  left join (select work_id, count(*) v from page_views group by 1) a on a.work_id = id
  left join (select upper(product_code) pc, count(*) s from search_logs group by 1) b on pc = upper(product_code)
  left join (select work_id, count(*) c from affiliate_clicks group by 1) d on d.work_id = id where is_published""",
       "works page_views search_logs affiliate_clicks")
def event_counts(t: Tables):
    rows = metrics.work_period_counts(t.works("id", "product_code", "is_published"), t.page_views(), t.search_logs(), t.affiliate_clicks(), AS_OF)
    return rows.select("id", F.col("views_all").alias("views"), F.col("searches_all").alias("searches"), F.col("clicks_all").alias("clicks"))


# -- performers and related works ---------------------------------------------------------------
_PERFORMER = "Supplier#000000003"


@query("E4_performer_stats", "select performer, count(*) work_count, count(distinct maker) maker_count from works where is_published and performer is not null group by 1", "works")
def performer_stats(t: Tables):
    return related.performer_stats(t.works("performer", "maker", "is_published"))


for _name, _column in (("E4_co_maker_performers", "maker"), ("E4_co_genre_performers", "genre")):

    @query(_name, f"""select performer, count(*) work_count, cast(sum(popularity) as bigint) popularity from works where is_published and performer <> '{_PERFORMER}'
      and {_column} in (select {_column} from works where is_published and performer = '{_PERFORMER}')
      group by 1 order by 3 desc, 2 desc, 1 limit 30""", "works")
    def sharing(t: Tables, column=_column):
        return related.performers_sharing(t.works("performer", column, "popularity", "is_published"), _PERFORMER, column, 30)


@query("G4_recommend", """
select id, product_code, cast(2*popularity + 3*favorite_count + case when maker='Brand#3' then 40 else 0 end
  + case when genre in ('ECONOMY','PROMO') then 30 else 0 end as double) score from works where is_published order by score desc, id limit 50""", "works")
def recommend(t: Tables):
    rows = t.works("id", "product_code", "performer", "maker", "series", "genre", "popularity", "favorite_count", "is_published")
    return related.recommend(rows, {"maker": "Brand#3", "genres": ["ECONOMY", "PROMO"]}, 50).select("id", "product_code", "score")


@query("G4_recommend_all", """
with v as (select session_id, work_id, row_number() over (partition by session_id order by ts desc, event_id desc) r from page_views),
l as (select v.session_id, w.performer, w.maker, w.series, (select list(distinct x.genre) from v u join works x on x.id = u.work_id where u.session_id = v.session_id and u.r <= 3) genres from v join works w on w.id = v.work_id where v.r = 1),
s as (select session_id, w.id, cast(2*popularity + 3*favorite_count + case when w.performer = l.performer then 100 else 0 end + case when w.maker = l.maker then 40 else 0 end
  + case when w.series = l.series then 60 else 0 end + case when list_contains(l.genres, w.genre) then 30 else 0 end as double) score from l, works w where is_published)
select session_id, id work_id, score, cast(row_number() over (partition by session_id order by score desc, id) as int) as rank from s qualify rank <= 5""", "works page_views")
def recommend_all(t: Tables):
    """Every session: the cast, maker and series of what it saw last, the genres of the last three."""
    works = reuse(t.works("id", "performer", "maker", "series", "genre", "popularity", "favorite_count", "is_published"), "works")
    views = ranking.top_within(t.page_views(), ["session_id"], [("ts", "desc"), ("event_id", "desc")], 3, "_r")
    seen = views.join(by_key(works.select(F.col("id").alias("work_id"), "performer", "maker", "series", "genre")), "work_id")
    last = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c))).alias(c)
    profiles = reuse(seen.groupBy(F.col("session_id").alias("visitor")).agg(last("performer"), last("maker"), last("series"), F.collect_set("genre").alias("genres")), "profiles")  # three rows a session
    return related.recommend_all(works, profiles, 5).select(F.col("visitor").alias("session_id"), F.col("id").alias("work_id"), "score", "rank")


@query("G5_related_works", """
with p as (select id, popularity, created_at, maker, series, genre from works where is_published),
pk as (select distinct p.*, performer_id k from p join work_performers on work_id = p.id),
pairs as (
  select distinct a.id work_id, 'performer' kind, b.id related_id, b.popularity, null::timestamp created_at from pk a join pk b on a.k = b.k and a.id <> b.id
  union all select a.id, 'maker', b.id, b.popularity, null from p a join p b on a.maker = b.maker and a.id <> b.id
  union all select a.id, 'series', b.id, b.popularity, null from p a join p b on a.series = b.series and a.id <> b.id
  union all select a.id, 'genre', b.id, b.popularity, b.created_at from p a join p b on a.genre = b.genre and a.id <> b.id)
select work_id, kind, cast(r as int) as rank, related_id from (
  select *, row_number() over (partition by work_id, kind order by popularity desc nulls last, created_at desc nulls last, related_id) r from pairs) where r <= 8""",
       "works work_performers")
def related_works(t: Tables):
    works = t.works("id", "popularity", "created_at", "maker", "series", "genre", "is_published")
    return related.related_works(works, t.work_performers())


@query("F8_recently_viewed", """select session_id, work_id, cast(r as int) as rank from (
  select *, row_number() over (partition by session_id order by seen desc, work_id) r from (
    select session_id, work_id, max(ts) seen from page_views group by 1,2)) where r <= 20""", "page_views")
def recently_viewed(t: Tables):
    return related.recently_viewed(t.page_views()).select("session_id", "work_id", "rank")


@query("G6_interleave", """
with a as (select product_code item, row_number() over (order by id) - 1 i from works where is_published order by id limit 60),
b as (select external_post_id item, row_number() over (order by external_post_id) - 1 i from posts order by 1 limit 15)
select item, side, slot from (
  select item, 'primary' side, cast(4*(i//3) + i%3 as bigint) slot from a union all select item, 'secondary', cast(4*i+3 as bigint) from b)
order by slot limit 60""", "works posts")
def interleave(t: Tables):
    from pyspark.sql import Window

    def page(df, key, item, n):
        head = df.orderBy(key).limit(n)  # a page: at most n rows
        pos = F.row_number().over(Window.orderBy(key)) - 1
        return head.withColumn("position", pos).select(F.col(item).alias("item"), "position")

    works = page(t.works("id", "product_code", "is_published").filter("is_published"), "id", "product_code", 60)
    posts = page(t.posts(), "external_post_id", "external_post_id", 15)
    return related.interleave(works, posts, 60).select("item", "side", F.col("slot").cast("bigint").alias("slot"))
