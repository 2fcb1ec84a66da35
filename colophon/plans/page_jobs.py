"""Raw pages: metadata, classification, discovery, duplicates."""

from pyspark.sql import functions as F

from colophon.operators import bundles, pages
from colophon.plans.bindings import Tables
from colophon.plans.registry import query

HOST = "creators.example"


def _decoded(x: str) -> str:
    for entity, text in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x},'{entity}','{text}')"
    return x


def _attribute(tag: str, name: str) -> str:
    value = f"""regexp_extract({tag}, '(?i)(?:^|[\\s"''<])(?:{name})\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1)"""
    return f"""regexp_replace({value}, '^["'']|["'']$', '', 'g')"""


def _clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({_decoded(x)}, '\\s+', ' ', 'g')), '')"


@query("A11_page_metadata", rf"""
with p as (select page_id, nullif(regexp_extract(html,'(?is)<title\b[^>]*>(.*?)</title\s*>',1), '') raw,
  list_zip(regexp_extract_all(html,'(?is)<a\b([^>]*)>(.*?)</a\s*>',1), regexp_extract_all(html,'(?is)<a\b([^>]*)>(.*?)</a\s*>',2)) tags, list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda l: lower({_attribute('l', 'rel')}) = 'canonical') canon,
  list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda m: {{'k': lower(coalesce(nullif({_attribute('m', 'property')}, ''), {_attribute('m', 'name')})), 'v': {_clean(_attribute('m', 'content'))}}}) metas,
  len(regexp_extract_all(html, '(?is)<script\b[^>]*type\s*=\s*["'']application/ld\+json["''][^>]*>')) blocks from pages),
a as (select page_id, list_transform(list_filter(tags, lambda t: {_attribute('t[1]', 'href')} <> ''), lambda t: {{'rel': {_clean(_attribute('t[1]', 'rel'))}, 'text': {_clean("regexp_replace(t[2], '<[^>]+>', ' ', 'g')")}, 'class': {_clean(_attribute('t[1]', 'class'))}}}) l from p)
select page_id, {_clean('raw')} title, blocks::bigint json_ld_blocks, len(list_filter(metas, lambda m: m.k <> '' and m.v is not null))::bigint metas, len(canon) > 0 canonical,
  coalesce(array_to_string(list_transform(a.l, lambda x: concat_ws('|', coalesce(x.text, '-'), coalesce(x.rel, '-'), coalesce(x.class, '-'))), ';'), '') anchors from p join a using (page_id)""")
def metadata(t: Tables):
    """What the operator reads of the given pages; their anchors are kept whatever site they lead to."""
    m = pages.page_metadata(t.pages(), keep_foreign=True)
    shown = F.transform("anchors", lambda a: F.concat_ws("|", *[F.coalesce(a[c], F.lit("-")) for c in ("text", "rel", "class_name")]))
    return m.select("page_id", "title", F.size("json_ld").cast("bigint").alias("json_ld_blocks"), F.size("meta").cast("bigint").alias("metas"), F.col("canonical").isNotNull().alias("canonical"), F.array_join(shown, ";").alias("anchors"))


def _marked_pages(t: Tables):
    """Pages with every kind of mark-up that the operator reads, one of each creator."""
    c = F.col("c_custkey")
    n = c.cast("string")
    html = F.concat(
        F.lit("<TITLE>Caf&#xe9; &amp; &#9731;"), n, F.lit("</TITLE><meta property='OG:url' content='/maker_"), n, F.lit("'><META name=description content=\"A &#66;&quot;"), n, F.lit('">'),
        F.when(c % 2 == 0, F.concat(F.lit('<link href="/maker_'), n, F.lit('/" rel=canonical>'))).otherwise("<link rel=stylesheet href=/x.css>"),
        F.when(c % 3 == 0, F.concat(F.lit('<script type="application/ld+json">[{"@type":"Person"},{"@graph":[{"@type":"Article"},{"n":'), n, F.lit("}]}]</script>"))).when(c % 3 == 1, F.lit("<script type='application/ld+json'>{broken</script>")).otherwise(""),
        F.lit("<a class=\"b &lt;c&gt;\" data-creator-id="), n, F.lit(" href='/maker_"), n, F.lit("?q=1' rel=author><b>Maker</b> &#"), (c % 20000 + 0x4E00).cast("string"), F.lit(";x</a><a href='https://else.example/'>away</a><a name=x>no link</a>"),
    )
    return t.dealt("customer", "c_custkey").select(c.alias("page_id"), F.concat(F.lit(f"https://{HOST}/list/"), n).alias("url"), html.alias("html"))


@query("A11_page_fields", f"""
select c_custkey page_id, 'Café & ☃' || c_custkey title, case when c_custkey % 2 = 0 then 'https://{HOST}/maker_' || c_custkey end canonical, '/maker_' || c_custkey og_url, case c_custkey % 3 when 0 then 4 else 0 end json_ld, 'A B"' || c_custkey description,
  'https://{HOST}/maker_' || c_custkey || '|Maker ' || chr(cast(c_custkey % 20000 + 19968 as int)) || 'x|author|' || c_custkey || '|b <c>' anchors from customer""")
def fields(t: Tables):
    m = pages.page_metadata(_marked_pages(t), HOST)
    shown = F.transform("anchors", lambda a: F.concat_ws("|", a["url"], a["text"], a["rel"], a["creator_id"], a["class_name"]))
    return m.select("page_id", "title", "canonical", pages.meta_value("og:url").alias("og_url"), F.size("json_ld").alias("json_ld"), pages.meta_value("description").alias("description"), F.array_join(shown, ";").alias("anchors"))


@query("A11_page_links", r"""
with p as (select page_id, url, lower(regexp_extract(url,'(?i)^https?://([^/?#:]+)',1)) host, regexp_extract(url,'(?i)^https?://[^/?#]+([^?#]*/)',1) base, html from pages),
a as (select page_id, host, base, trim(unnest(list_filter(list_transform(regexp_extract_all(html,'(?is)<a\b([^>]*)>(.*?)</a\s*>',1), lambda x: regexp_extract(x, '(?i)(?:^|[\s"''<])href\s*=\s*"([^"]*)"', 1)), lambda x: x <> ''))) h from p),
r as (select page_id, host, case when regexp_matches(h,'(?i)^[a-z][a-z0-9+.-]*:') then case when lower(regexp_extract(h,'(?i)^https:(?://)([^/?#]+)',1))=host then regexp_extract(h,'(?i)^https://[^/?#]+([^?#]*)',1) end when starts_with(h,'//') then null when starts_with(h,'/') then regexp_extract(h,'^(/[^?#]*)',1)
  else case when base='' then '/' else base end || regexp_extract(h,'^([^?#]*)',1) end path from a)
select distinct page_id, 'https://' || host || case when regexp_replace(regexp_replace(path,'/+','/','g'),'/$','')='' then '/' else regexp_replace(regexp_replace(path,'/+','/','g'),'/$','') end link from r where path is not null""")
def links(t: Tables):
    return pages.page_metadata(t.pages()).select("page_id", F.explode("links").alias("link"))


def site_pages(t: Tables):
    """Creator and post pages built from the customers and orders, with faults by key."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    slug = lambda x: F.concat(F.lit("maker_"), x.cast("string"))
    curl = lambda x: F.concat(F.lit(f"https://{HOST}/"), slug(x))
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(o.cast("string"), 12, "0"))
    person = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Person","name":"'), "c_name", F.lit('","url":"'), F.when(c % 4 == 0, F.lit("https://else.example/")).otherwise(curl(c)), F.lit('"}]}</script>'))
    creators = t.dealt("customer", "c_custkey").select(
        (c * 2).alias("page_id"), F.concat(curl(c), F.lit("?ref=1")).alias("url"), F.when(c % 11 == 0, 403).when(c % 13 == 0, 302).otherwise(200).alias("status"), F.when(c % 26 == 0, "/login").otherwise("/").alias("location"),
        F.concat(F.lit("<title>T &amp; "), "c_name", F.lit("</title>"), F.when(c % 3 != 0, person).otherwise(""), F.when(c % 5 == 0, F.concat(F.lit('<link rel="canonical" href="/'), slug(c), F.lit('">'))).otherwise(""),
                 F.when(c % 7 == 0, F.lit('<form action="/login">')).otherwise("")).alias("html"))
    article = F.concat(F.lit('<script type="application/ld+json">{"@type":["Article"],"headline":"H '), o.cast("string"), F.lit('","author":{"url":"'), curl(F.col("o_custkey")), F.lit('"},"datePublished":"2024-01-01T00:00:00Z"}</script>'))
    posts = t.dealt("orders", "o_orderkey").select(
        (o * 2 + 1).alias("page_id"), F.concat(F.lit(f"https://{HOST}/posts/"), F.when(o % 30 == 0, "x").otherwise(uuid)).alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"),
        F.concat(F.when(o % 4 != 0, article).otherwise("<title>plain</title>"), F.when(o % 6 == 0, F.lit("<p>Subscribers only</p>")).when(o % 10 == 0, F.lit("<p>followers only</p>")).otherwise("")).alias("html"))
    return creators.unionByName(posts)


def _classified(t: Tables):
    known = t.raw("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("maker_"), F.col("c_custkey").cast("string")).alias("slug"))
    return pages.page_classify(site_pages(t), HOST, known)


_CLASSIFIED = """
cl as (select c_custkey*2 page_id, case when c_custkey%11=0 then 'SOURCE_ACCESS_BLOCKED' when c_custkey%26=0 then 'AUTH_REQUIRED' when c_custkey%13=0 then 'SOURCE_ACCESS_BLOCKED' when c_custkey%7=0 then 'AUTH_REQUIRED' when c_custkey%3<>0 and c_custkey%4<>0 then 'PUBLIC_SAFE_METADATA' else 'PUBLIC_NEEDS_REVIEW' end classification,
  case when c_custkey%11=0 then 'HTTP_403_SOURCE_BLOCKED' when c_custkey%26=0 then 'AUTH_REDIRECT_REJECTED' when c_custkey%13=0 then 'REDIRECT_NOT_FOLLOWED' when c_custkey%7=0 then 'LOGIN_WALL_REJECTED' when c_custkey%3<>0 and c_custkey%4<>0 then 'ANONYMOUS_HTTP_200|CREATOR_IDENTITY_SELF_CONSISTENT|CREATOR_STRUCTURAL_EVIDENCE|JSON_LD'
   when c_custkey%5=0 then 'CREATOR_STRUCTURAL_EVIDENCE_MISSING' else 'CREATOR_SELF_IDENTITY_NOT_CONFIRMED' end reason_codes from customer
  union all select o_orderkey*2+1, case when o_orderkey%30=0 then 'UNSUPPORTED' when o_orderkey%6=0 or o_orderkey%10=0 then 'PAID_PROTECTED' when o_orderkey%4<>0 and o_custkey%2=0 then 'PUBLIC_SAFE_METADATA' else 'PUBLIC_NEEDS_REVIEW' end,
   case when o_orderkey%30=0 then 'STABLE_POST_ID_MISSING' when o_orderkey%6=0 then 'PAID_METADATA_EXCLUDED' when o_orderkey%10=0 then 'LIMITED_METADATA_EXCLUDED' when o_orderkey%4<>0 and o_custkey%2=0 then 'ANONYMOUS_HTTP_200|JSON_LD|KNOWN_CREATOR|STABLE_POST_ID' else 'CREATOR_IDENTITY_NOT_CONFIRMED' end from orders)"""


@query("I13_page_classify", f"with {_CLASSIFIED} select * from cl")
def classify(t: Tables):
    return _classified(t).select("page_id", "classification", F.array_join("reason_codes", "|").alias("reason_codes"))


@query("I14_discover_creators", """select 'https://creators.example/maker_' || cast(c_custkey as varchar) url, case when c_custkey%3=0 then 'json_ld_item_list' else 'ranking_anchor' end "method", case when c_custkey%3=0 or c_custkey%2=0 then null else 'RANKING_ITEM_STRUCTURAL_EVIDENCE_MISSING' end rejected_reason from customer
  union all select 'https://creators.example/login', 'ranking_anchor', 'KNOWN_NON_CREATOR_ROUTE'""")
def discover(t: Tables):
    c = F.col("c_custkey")
    slug = F.concat(F.lit("maker_"), c.cast("string"))
    # ranking pages of 50 creators: a few in the JSON-LD list, all as anchors, some of them marked
    rows = t.raw("customer").select(F.floor(c / 50).cast("bigint").alias("page_id"), c.alias("k"), F.when(c % 3 == 0, F.concat(F.lit('{"@type":"ListItem","item":{"@type":"Person","name":"N","url":"/'), slug, F.lit('"}}'))).alias("item"),
                                     F.concat(F.lit("<a href='/"), slug, F.lit("/'"), F.when(c % 2 == 0, F.lit(" rel=author")).otherwise(""), F.lit(">x</a>")).alias("a"))
    grouped = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "item", "a"))).alias("x"))
    body = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['), F.array_join(F.array_compact(F.transform("x", lambda e: e["item"])), ","), F.lit("]}</script><a href='/login'>l</a>"), F.array_join(F.transform("x", lambda e: e["a"]), ""))
    made = grouped.select("page_id", F.lit(f"https://{HOST}/ranking/creators/all").alias("url"), body.alias("html"))
    return pages.discover_creators(made, HOST).select("url", "method", "rejected_reason")


@query("I15_dedupe_records", r"""
with recursive r as (select row_number() over (order by page_id) n, page_id, regexp_extract(url,'/([0-9]+)',1) ext, regexp_extract(url,'://([^/]+)',1) host from pages),
g as (select cast(0 as bigint) n, []::varchar[] ids, []::varchar[] hosts, null::bigint page_id, ''::varchar reason
  union all select r.n, case when list_contains(g.ids, r.ext) or list_contains(g.hosts, r.host) then g.ids else list_append(g.ids, r.ext) end, case when list_contains(g.ids, r.ext) or list_contains(g.hosts, r.host) then g.hosts else list_append(g.hosts, r.host) end, r.page_id,
  case when list_contains(g.ids, r.ext) then 'DUPLICATE_STABLE_ID' when list_contains(g.hosts, r.host) then 'DUPLICATE_OFFICIAL_URL' else '' end from g join r on r.n = g.n + 1)
select page_id, nullif(reason,'') duplicate_reason from g where n > 0""")
def dedupe(t: Tables):
    rows = t.pages().select("page_id", F.lit("page").alias("entity_type"), F.regexp_extract("url", "/([0-9]+)", 1).alias("external_id"), F.regexp_extract("url", "://([^/]+)", 1).alias("official_url"))
    return bundles.dedupe_records(rows, "page_id").select("page_id", "duplicate_reason")
