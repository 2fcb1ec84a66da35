"""The catalog's tables as views over the driver's parquet tables, once for Spark and once as SQL.

``AS_OF`` stands for the current time: the events end on 2024-01-30.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colophon.operators.joins import lookup
from colophon.operators.ranking import numbered
from colophon.session import partitions_of, reuse

AS_OF = "2024-01-31 00:00:00"
AS_OF_DAY = "2024-01-31"
#: works in a task where each becomes several wide rows
WORKS_A_TASK = 20_000
#: rows in a task where each becomes one page or post
ROWS_A_TASK = 50_000
WORK_COLUMNS = (
    "id", "product_code", "title", "performer", "maker", "series", "genre", "duration", "price",
    "popularity", "favorite_count", "created_at", "release_date", "is_published",
)
SITE = "https://catalog.example"


def _code(key: Column, name: Column) -> Column:
    digits = key.cast("string")
    return F.concat(
        F.upper(F.substring(name, 1, 3)), F.lit("-"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), "0")
    )


class Tables:
    """Lazy views; every method reads only the columns its caller names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        # reading a file's schema is a small job of its own, so each table is opened once
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table's rows dealt by key: a file is read in few tasks, whatever work its rows are made into."""
        rows = self.raw(name)
        return rows.repartition(max(partitions_of(self.spark), -(-rows.count() // ROWS_A_TASK)), key)

    @cached_property
    def part_count(self) -> Column:
        return self.raw("part").agg(F.count("*").alias("n")).scalar()

    # -- catalog ---------------------------------------------------------------------------
    def works(self, *columns: str) -> DataFrame:
        """One row per work.  Facts are joined only when a fact column is asked for."""
        want = set(columns or WORK_COLUMNS)
        df = self.raw("part").select(
            F.col("p_partkey").alias("id"),
            _code(F.col("p_partkey"), F.col("p_name")).alias("product_code"),
            F.concat_ws(" ", "p_name", "p_type").alias("title"),
            F.col("p_brand").alias("maker"),
            F.col("p_name").alias("series"),
            F.col("p_type").alias("genre"),
            F.col("p_size").cast("bigint").alias("duration"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_partkey") % 10 != 0).alias("is_published"),
        )
        facts = want & {"performer", "popularity", "favorite_count", "created_at", "release_date"}
        if facts:
            df = df.join(self._work_facts(facts), "id", "left")
            if "popularity" in facts:
                df = df.withColumn("popularity", F.coalesce("popularity", F.lit(0)))
            if "favorite_count" in facts:
                df = df.withColumn("favorite_count", F.coalesce("favorite_count", F.lit(0)))
        return df.select(*(columns or WORK_COLUMNS))

    def written_works(self, *columns: str) -> DataFrame:
        """The works dealt by id and written, for a query that reads them again and again."""
        parts = max(partitions_of(self.spark), -(-self._work_count // WORKS_A_TASK))
        return reuse(self.works(*columns).repartition(parts, "id"), "works")

    def works_by_code(self, *columns: str) -> DataFrame:
        """The works dealt by code, as many a task however large the table: what each work is made into stays in its task."""
        parts = max(partitions_of(self.spark), -(-self._work_count // WORKS_A_TASK))
        return self.works(*columns).repartition(parts, "product_code")

    @cached_property
    def _work_count(self) -> int:
        return self.raw("part").count()

    def _work_facts(self, facts: set[str]) -> DataFrame:
        lines = self.raw("lineitem")
        per_order = facts & {"favorite_count", "created_at"}
        if per_order:
            # one row per (work, order) first: the distinct count becomes a plain count and
            # the orders join sees each pair once
            lines = lines.groupBy("l_partkey", "l_orderkey").agg(
                F.count("*").alias("n"), F.min("l_shipdate").alias("l_shipdate"), F.min("l_suppkey").alias("l_suppkey")
            )
        else:
            lines = lines.withColumn("n", F.lit(1).cast("bigint"))
        if "created_at" in facts:
            orders = self.raw("orders").select("o_orderkey", "o_orderdate")
            lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
        aggs = {
            "popularity": F.sum("n").alias("popularity"),
            "favorite_count": F.count("*").alias("favorite_count"),
            "created_at": F.min("o_orderdate").alias("created_at"),
            "release_date": F.min("l_shipdate").cast("date").alias("release_date"),
            "performer": F.min("l_suppkey").alias("s_key"),
        }
        out = lines.groupBy(F.col("l_partkey").alias("id")).agg(*(aggs[f] for f in sorted(facts)))
        if "performer" in facts:
            names = self.raw("supplier").select(F.col("s_suppkey").alias("s_key"), F.col("s_name").alias("performer"))
            out = out.join(names, "s_key", "left").drop("s_key")
        return out

    def work_performers(self) -> DataFrame:
        """Bridge ``work_id, performer_id, position`` (0 = first billed)."""
        pairs = self.raw("lineitem").select(
            F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("performer_id")
        ).distinct()
        ranked = numbered(pairs, ["work_id"], [("performer_id", "asc")], "position")
        return ranked.withColumn("position", F.col("position") - 1)

    def performers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("performer_id"), F.col("s_name").alias("name"))

    def work_tags(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("work_id"), F.explode(F.split("p_name", " ")).alias("tag"))

    def aliases(self) -> DataFrame:
        """``entity_type, canonical_name, alias``: short forms of the performers and series."""
        performers = self.raw("supplier").select(
            F.lit("performer").alias("entity_type"),
            F.col("s_name").alias("canonical_name"),
            F.concat(F.lit("S・"), F.col("s_suppkey").cast("string")).alias("alias"),
        )
        series = self.raw("part").select(
            F.lit("series").alias("entity_type"),
            F.col("p_name").alias("canonical_name"),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("–")).alias("alias"),
        ).distinct()
        return performers.unionByName(series)

    # -- events ----------------------------------------------------------------------------
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            "event_id", "ts", F.col("user_id").alias("session_id"), "event_type", "value",
            ((F.col("event_id") * 7 + k) % self.part_count).alias("work_id"),
        )

    def page_views(self) -> DataFrame:
        return self.events().filter(F.col("event_type") == "view")

    def affiliate_clicks(self) -> DataFrame:
        return self.events().filter(F.col("event_type") == "click")

    def related_clicks(self) -> DataFrame:
        return self.events().filter(F.col("event_type") == "purchase")

    def search_logs(self) -> DataFrame:
        logs = self.events().filter(F.col("event_type").isin("signup", "error"))
        codes = self.works("id", "product_code").withColumnRenamed("id", "work_id")
        source = F.when(F.col("event_type") == "signup", "web_search").otherwise("api")
        return logs.join(codes, "work_id").select("event_id", "ts", "session_id", source.alias("source"), "product_code")

    # -- intake ----------------------------------------------------------------------------
    def source_items(self, text: bool = False) -> DataFrame:
        doc = F.col("doc_id")
        items = self.raw("documents").select(
            doc.alias("id"),
            "source",
            F.concat(F.lit("doc:"), doc.cast("string")).alias("source_key"),
            *([F.col("text")] if text else []),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            ((F.col("n_chars") % 101) / 100).alias("confidence"),
            F.when(doc % 2 == 0, F.floor(doc / 4) % self.part_count).alias("work_id"),
            F.element_at(F.array(*map(F.lit, ("promoted", "pending", "pending", "pending", "ignored"))), (doc % 5 + 1).cast("int")).alias("status"),
            F.element_at(F.array(*map(F.lit, ("pending", "failed", "processing", "completed"))), (doc % 4 + 1).cast("int")).alias("extraction_status"),
            F.concat(F.lit("model-"), (doc % 3).cast("string")).alias("model"),
            (doc % 60).cast("bigint").alias("minutes_old"),
        )
        codes = self.works("id", "product_code", "maker", "series").withColumnRenamed("id", "work_id")
        # half of the documents have no work
        return lookup(items, codes, "work_id", spread=[F.col("id")]).drop("work_id")

    def corrections(self) -> DataFrame:
        """Reviewer decisions, one row per decision, with a time that orders them."""
        rows = self.raw("labels").select(
            F.col("doc_id").alias("item_id"),
            F.explode(
                F.array(
                    F.when(F.col("quality") == 1, "approved").otherwise("rejected"),
                    F.when(F.col("toxic") == 1, "corrected"),
                    F.when(F.col("doc_id") % 9 == 0, "rejected"),
                )
            ).alias("decision"),
        )
        order = F.when((F.col("decision") == "rejected") & (F.col("item_id") % 9 == 0), 2).otherwise(1)
        return rows.filter("decision is not null").withColumn("decided_at", order.cast("bigint")).distinct()

    # -- second source ---------------------------------------------------------------------
    def creators(self) -> DataFrame:
        seg = F.col("c_mktsegment")
        return self.raw("customer").select(
            F.col("c_custkey").alias("creator_id"),
            F.lit(1).cast("bigint").alias("data_source_id"),
            F.concat(F.lit("profile_slug:maker_"), F.col("c_custkey").cast("string")).alias("external_creator_id"),
            F.concat(F.lit("maker_"), F.col("c_custkey").cast("string")).alias("profile_slug"),
            F.when(F.col("c_custkey") % 50 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("display_name"),
            F.concat(F.lit("https://creators.example/maker_"), F.col("c_custkey").cast("string")).alias("official_url"),
            F.when(seg == "HOUSEHOLD", "unknown").when(seg == "MACHINERY", "not_public")
            .when(seg == "BUILDING", "affiliate_visible").otherwise("public_general").alias("visibility"),
            F.when(F.col("c_acctbal") < 0, "needs_review").otherwise("approved").alias("review_state"),
        )

    def posts(self, dealt: bool = False) -> DataFrame:
        """The posts; ``dealt`` over the tasks where much is made of each."""
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        post_id = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(key.cast("string"), 12, "0"))
        return (self.dealt("orders", "o_orderkey") if dealt else self.raw("orders")).select(
            key.alias("post_id"),
            F.lit(1).cast("bigint").alias("data_source_id"),
            F.col("o_custkey").alias("creator_id"),
            post_id.alias("external_post_id"),
            F.when(key % 40 == 0, F.lit("")).otherwise(F.concat(F.lit("Post "), key.cast("string"), F.lit(" "), F.col("o_orderpriority"))).alias("title"),
            F.concat(F.lit("https://creators.example/posts/"), F.when(key % 30 == 0, F.lit("x")).otherwise(post_id)).alias("official_url"),
            F.floor("o_totalprice").cast("bigint").alias("price"),
            F.when(key % 25 == 0, F.lit("USD")).otherwise(F.lit("JPY")).alias("currency"),
            F.when(key % 3 == 0, F.lit("video")).when(key % 3 == 1, F.lit("image")).alias("media_indicator"),
            F.when(key % 2 == 0, F.lit("text")).alias("content_type"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "active").when(F.col("o_orderpriority") == "2-HIGH", "revoked").otherwise("missing").alias("link_status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.when(key % 4 == 0, F.lit("http")).otherwise(F.lit("https")), F.lit("://link.creators.example/p/"), key.cast("string"))).alias("affiliate_url"),
            F.when(status == "F", "public_general").when(status == "O", "approved_affiliate_only").otherwise("unknown").alias("visibility"),
            F.when(key % 7 == 0, "needs_review").otherwise("approved").alias("review_state"),
        )

    def data_sources(self) -> DataFrame:
        """The registered source the posts belong to; one active row, as the catalog holds it."""
        return self.raw("region").filter("r_regionkey = 1").select(
            F.col("r_regionkey").cast("bigint").alias("data_source_id"), F.lit("creator feed").alias("name"), F.lit(True).alias("is_active")
        )

    # -- images and pages --------------------------------------------------------------------
    def image_vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("label"))

    def pages(self) -> DataFrame:
        return self.raw("pages")


_CODE_SQL = (
    "concat(upper(substr(p_name,1,3)),'-',lpad(cast(p_partkey as varchar),"
    "cast(greatest(5,length(cast(p_partkey as varchar))) as int),'0'))"
)

# name -> (views it reads, SQL text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "work_facts": ((), """
        select l_partkey, count(*) popularity, count(distinct l_orderkey) favorite_count,
               min(o_orderdate) created_at, cast(min(l_shipdate) as date) release_date, min(l_suppkey) s_key
        from lineitem left join orders on l_orderkey = o_orderkey group by l_partkey"""),
    "works": (("work_facts",), f"""
        select p_partkey id, {_CODE_SQL} product_code, concat(p_name,' ',p_type) title, s_name performer,
               p_brand maker, p_name series, p_type genre, cast(p_size as bigint) duration, p_retailprice price,
               coalesce(popularity,0) popularity, coalesce(favorite_count,0) favorite_count,
               created_at, release_date, p_partkey % 10 <> 0 is_published
        from part left join work_facts on l_partkey = p_partkey left join supplier on s_suppkey = s_key"""),
    "work_performers": ((), """
        select l_partkey work_id, l_suppkey performer_id,
               row_number() over (partition by l_partkey order by l_suppkey) - 1 as position
        from (select distinct l_partkey, l_suppkey from lineitem)"""),
    "work_tags": ((), "select p_partkey work_id, unnest(string_split(p_name,' ')) tag from part"),
    "aliases": ((), """
        select 'performer' entity_type, s_name canonical_name, concat('S・', cast(s_suppkey as varchar)) alias from supplier
        union all
        select distinct 'series', p_name, replace(p_name,' ','–') from part"""),
    "events_bound": ((), r"""
        select event_id, ts, user_id session_id, event_type, value,
               (event_id*7 + cast(regexp_extract(props, '"k": ([0-9]+)', 1) as bigint)) % (select count(*) from part) work_id
        from events"""),
    "page_views": (("events_bound",), "select * from events_bound where event_type='view'"),
    "affiliate_clicks": (("events_bound",), "select * from events_bound where event_type='click'"),
    "related_clicks": (("events_bound",), "select * from events_bound where event_type='purchase'"),
    "search_logs": (("events_bound",), f"""
        select event_id, ts, session_id, case event_type when 'signup' then 'web_search' else 'api' end source,
               {_CODE_SQL} product_code
        from events_bound join part on p_partkey = work_id where event_type in ('signup','error')"""),
    "source_items": ((), f"""
        select doc_id id, source, concat('doc:', cast(doc_id as varchar)) source_key, text,
               split_part(text, chr(10), 1) title, (n_chars % 101)/100.0 confidence,
               ['promoted','pending','pending','pending','ignored'][cast(doc_id%5+1 as int)] status,
               ['pending','failed','processing','completed'][cast(doc_id%4+1 as int)] extraction_status,
               concat('model-', cast(doc_id%3 as varchar)) model, doc_id%60 minutes_old,
               case when p_partkey is not null then {_CODE_SQL} end product_code, p_brand maker, p_name series
        from documents left join part
          on p_partkey = case when doc_id%2=0 then (doc_id // 4) % (select count(*) from part) end"""),
    "corrections": ((), """
        select distinct doc_id item_id, decision,
               cast(case when decision='rejected' and doc_id%9=0 then 2 else 1 end as bigint) decided_at
        from (select doc_id, unnest([case when quality=1 then 'approved' else 'rejected' end,
                                     case when toxic=1 then 'corrected' end,
                                     case when doc_id%9=0 then 'rejected' end]) decision from labels)
        where decision is not null"""),
    "creators": ((), """
        select c_custkey creator_id, cast(1 as bigint) data_source_id,
               concat('profile_slug:maker_', cast(c_custkey as varchar)) external_creator_id,
               concat('maker_', cast(c_custkey as varchar)) profile_slug,
               case when c_custkey%50=0 then ' ' else c_name end display_name,
               concat('https://creators.example/maker_', cast(c_custkey as varchar)) official_url,
               case c_mktsegment when 'HOUSEHOLD' then 'unknown' when 'MACHINERY' then 'not_public'
                    when 'BUILDING' then 'affiliate_visible' else 'public_general' end visibility,
               case when c_acctbal < 0 then 'needs_review' else 'approved' end review_state
        from customer"""),
    "posts": ((), """
        select o_orderkey post_id, cast(1 as bigint) data_source_id, o_custkey creator_id,
               concat('00000000-0000-4000-8000-', lpad(cast(o_orderkey as varchar),12,'0')) external_post_id,
               case when o_orderkey%40=0 then '' else concat('Post ', cast(o_orderkey as varchar), ' ', o_orderpriority) end title,
               concat('https://creators.example/posts/', case when o_orderkey%30=0 then 'x'
                      else concat('00000000-0000-4000-8000-', lpad(cast(o_orderkey as varchar),12,'0')) end) official_url,
               cast(floor(o_totalprice) as bigint) price, case when o_orderkey%25=0 then 'USD' else 'JPY' end currency,
               case o_orderkey%3 when 0 then 'video' when 1 then 'image' end media_indicator,
               case when o_orderkey%2=0 then 'text' end content_type,
               case o_orderpriority when '1-URGENT' then 'active' when '2-HIGH' then 'revoked' else 'missing' end link_status,
               case when o_orderpriority='1-URGENT' then concat(case when o_orderkey%4=0 then 'http' else 'https' end,
                    '://link.creators.example/p/', cast(o_orderkey as varchar)) end affiliate_url,
               case o_orderstatus when 'F' then 'public_general' when 'O' then 'approved_affiliate_only' else 'unknown' end visibility,
               case when o_orderkey%7=0 then 'needs_review' else 'approved' end review_state
        from orders"""),
}


def oracle(uses: list[str], body: str) -> str:
    """``with`` clause of the named views and what they read, then the query."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in uses:
        visit(name)
    ctes = ", ".join(f"{n} as ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
