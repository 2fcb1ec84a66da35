"""Raw pages: metadata, access and record classification, creator discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from colophon.functions.codes import _col
from colophon.operators.ranking import latest_per_key
from colophon.session import reuse

# fixed values: routes that are no creator page, and the markers of each kind of wall
RESERVED_ROUTES = (
    "about", "account", "admin", "api", "auth", "categories", "category", "contact", "creators", "discover", "faq", "feed", "genres",
    "help", "home", "login", "logout", "media", "messages", "plans", "posts", "privacy", "ranking", "rankings", "register", "search",
    "settings", "signin", "signup", "support", "terms", "unlimited", "users",
)
LOGIN_MARKERS = ("<form[^>]+(?:login|sign[-_ ]?in)", "(?:ログイン|サインイン).{0,80}(?:必要|してください)", "(?:login|sign in).{0,80}(?:required|continue)")
AGE_MARKERS = ("18歳未満.{0,80}(?:閲覧|利用|禁止|戻)", "(?:18歳以上|成人).{0,80}(?:確認|同意|入場)", "age.{0,30}(?:verification|confirmation|gate)")
PAID_MARKERS = ("(?:有料|購入|課金|プラン加入|会員限定|購読者限定|支援者限定)", "(?:subscribe|subscription|subscribers? only|members? only|paid content|purchase required)")
LIMITED_MARKERS = ("(?:限定公開|フォロワー限定|閲覧期限|公開終了)", "(?:limited access|followers? only|restricted content)")
#: what a text must contain in lower case, all of one row, before the markers are worth a search
LOGIN_HINTS = (("<form", "login"), ("<form", "sign"), ("ログイン",), ("サインイン",), ("login",), ("sign in",))
AGE_HINTS = (("18歳",), ("成人",), ("age", "verification"), ("age", "confirmation"), ("age", "gate"))
PAID_HINTS = (("有料",), ("購入",), ("課金",), ("プラン加入",), ("会員限定",), ("購読者限定",), ("支援者限定",), ("subscri",), ("member", "only"), ("paid content",), ("purchase required",))
LIMITED_HINTS = (("限定公開",), ("フォロワー限定",), ("閲覧期限",), ("公開終了",), ("limited access",), ("follower", "only"), ("restricted content",))
POST_TYPES = ("article", "socialmediaposting", "blogposting", "videoobject", "imageobject")
TIMESTAMP_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})$"
SLUG = "^[a-zA-Z0-9_-]{2,100}$"
POST_PATH = "(?i)^/posts/([0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})$"


def has_marker(html: Column, patterns: tuple[str, ...], hints: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a text matches one of the patterns, in any case; plain searches for hints spare most texts the patterns."""
    low = F.lower(html)
    hinted = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low, F.lit(x)) for x in row]) for row in hints])
    return hinted & html.rlike("(?i)" + "|".join(patterns))


def _character(code: Column) -> Column:
    """The character of a code point, empty for one that is none."""
    ok = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    hexed = F.when(ok, F.lpad(F.hex(code), 8, "0"))
    return F.coalesce(F.decode(F.unhex(hexed), "UTF-32"), F.lit(""))


NUMBERED = "(?i)&#(x[0-9a-f]{1,8}|[0-9]{1,9});"


def decode_entities(c) -> Column:
    """The named entities of mark-up in any case, and numbered ones, decimal or hexadecimal, as characters."""
    c = _col(c)
    out = c
    for entity, text in (("amp", "&"), ("quot", '"'), ("(?:#39|apos)", "'"), ("lt", "<"), ("gt", ">")):
        out = F.regexp_replace(out, f"(?i)&{entity};", text)
    # the text between numbered entities, and their numbers, in turn
    number = lambda x: F.when(F.lower(x).startswith("x"), F.conv(F.substring(x, 2, 8), 16, 10)).otherwise(x).cast("bigint")
    spelled = F.zip_with(F.split(out, NUMBERED), F.regexp_extract_all(out, F.lit(NUMBERED), F.lit(1)), lambda a, x: F.concat(a, F.when(x.isNull(), "").otherwise(_character(number(x)))))
    # few texts have any
    return F.when(F.contains(c, F.lit("&")) & F.contains(c, F.lit("#")), F.array_join(spelled, "")).when(F.contains(c, F.lit("&")), out).otherwise(c)


def clean_text(c) -> Column:
    """Entities decoded, white space collapsed, trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(decode_entities(c), "\\s+", " ")), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag text, in any quoting; empty when absent."""
    pattern = f"(?i)(?:^|[\\s\"'<])(?:{name})\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)"
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), "^[\"']|[\"']$", "")


def first_filled(*values: Column) -> Column:
    """First value that is not empty, else empty."""
    out = values[-1]
    for v in reversed(values[:-1]):
        out = F.when(v != "", v).otherwise(out)
    return out


def site_url(href: Column, page_url: Column, host: Column) -> Column:
    """A link of a page as ``https://host/path``, or null when it leads elsewhere.

    Rooted, relative and absolute links are understood; query and fragment are dropped.
    """
    h = F.trim(href)
    base = F.regexp_extract(page_url, "(?i)^https?://[^/?#]+([^?#]*/)", 1)
    scheme = h.rlike("(?i)^[a-z][a-z0-9+.-]*:")
    own = F.lower(F.regexp_extract(h, "(?i)^https:(?://)([^/?#]+)", 1)) == F.lower(host)
    absolute = F.regexp_extract(h, "(?i)^https://[^/?#]+([^?#]*)", 1)
    rooted = F.regexp_extract(h, "^(/[^?#]*)", 1)
    relative = F.concat(F.when(base == "", F.lit("/")).otherwise(base), F.regexp_extract(h, "^([^?#]*)", 1))
    path = F.when(scheme, F.when(own, absolute)).when(h.startswith("//"), F.lit(None)).when(h.startswith("/"), rooted).otherwise(relative)
    tidy = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    return F.concat(F.lit("https://"), F.lower(host), F.when(tidy == "", F.lit("/")).otherwise(tidy))


def page_metadata(pages: DataFrame, host: str | None = None, keep_foreign: bool = False) -> DataFrame:
    """Title, meta values, canonical link, JSON-LD entries and anchors of raw pages.

    ``pages(page_id, url, html)``; ``host`` defaults to the page's own.  Entries are JSON
    texts, with the members of ``@graph`` beside their parent.  Anchors to other sites are left out, or
    have no URL with ``keep_foreign``.
    """
    own = F.lit(host) if host else F.regexp_extract("url", "(?i)^https?://([^/?#:]+)", 1)
    html = F.col("html")
    blocks = F.regexp_extract_all(html, F.lit("(?is)<script\\b[^>]*type\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>(.*?)</script\\s*>"), F.lit(1))
    as_list = lambda b: F.from_json(F.when(F.trim(b).startswith("["), F.trim(b)).otherwise(F.concat(F.lit("["), F.trim(b), F.lit("]"))), "array<string>")
    none = F.array().cast("array<string>")
    tops = F.flatten(F.transform(blocks, lambda b: F.coalesce(as_list(b), none)))
    metas = F.transform(
        F.regexp_extract_all(html, F.lit("(?i)<meta\\b[^>]*>"), F.lit(0)),
        lambda m: F.struct(F.lower(attribute(m, "property")).alias("property"), F.lower(attribute(m, "name")).alias("name"), attribute(m, "content").alias("content")),
    )
    links = F.filter(F.regexp_extract_all(html, F.lit("(?i)<link\\b[^>]*>"), F.lit(0)), lambda m: F.lower(attribute(m, "rel")) == "canonical")
    tags = F.regexp_extract_all(html, F.lit("(?is)<a\\b([^>]*)>(.*?)</a\\s*>"), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit("(?is)<a\\b([^>]*)>(.*?)</a\\s*>"), F.lit(2))
    # attributes first, then what is made of them: inside a lambda nothing is shared otherwise
    found = F.zip_with(
        tags, texts,
        lambda a, x: F.struct(
            F.trim(attribute(a, "href")).alias("href"), F.regexp_replace(x, "<[^>]+>", " ").alias("text"), attribute(a, "rel").alias("rel"), attribute(a, "data-creator-id").alias("creator_id"),
            attribute(a, "data-entity-type|data-type|data-kind").alias("entity_type"), attribute(a, "data-testid").alias("testid"), attribute(a, "class").alias("class_name"),
        ),
    )
    staged = pages.withColumn("_host", own).withColumns(
        {
            "title": clean_text(F.nullif(F.regexp_extract(html, "(?is)<title\\b[^>]*>(.*?)</title\\s*>", 1), F.lit(""))),
            "_tops": tops, "_metas": metas, "_links": links, "_found": F.filter(found, lambda a: a["href"] != ""),
        }
    )
    graphs = F.flatten(F.transform("_tops", lambda e: F.when(F.contains(e, F.lit("@graph")), F.coalesce(F.from_json(F.get_json_object(e, "$['@graph']"), "array<string>"), none)).otherwise(none)))
    keyed = F.transform("_metas", lambda m: F.struct(first_filled(m["property"], m["name"]).alias("key"), clean_text(m["content"]).alias("value")))
    anchors = F.transform("_found", lambda a: F.struct(
        site_url(a["href"], F.col("url"), F.col("_host")).alias("url"), clean_text(a["text"]).alias("text"),
        *[clean_text(a[c]).alias(c) for c in ("rel", "creator_id", "entity_type", "testid", "class_name")],
    ))
    staged = staged.withColumns({"json_ld": F.concat("_tops", graphs), "meta": keyed, "anchors": anchors, "_href": attribute(F.try_element_at("_links", F.lit(1)), "href")})
    out = staged.withColumns(
        {
            "meta": F.filter("meta", lambda m: (m["key"] != "") & m["value"].isNotNull()), "anchors": F.col("anchors") if keep_foreign else F.filter("anchors", lambda a: a["url"].isNotNull()),
            "canonical": F.when(F.col("_href") != "", site_url(F.col("_href"), F.col("url"), F.col("_host"))),
        }
    )
    return out.withColumn("links", F.array_distinct(F.array_compact(F.transform("anchors", lambda a: a["url"])))).drop("_host", "_tops", "_metas", "_links", "_found", "_href")


def meta_value(key: str) -> Column:
    """First value of a meta property or name."""
    return F.try_element_at(F.filter("meta", lambda m: m["key"] == key), F.lit(1))["value"]


def page_access(status, location, html) -> Column:
    """Struct ``access, reason`` by status first, then by the markers of a wall in the text."""
    s, h = _col(status), _col(html)
    code = s.cast("string")
    result = lambda access, reason: F.struct(F.lit(access).alias("access"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(s == 401, result("AUTH_REQUIRED", "HTTP_401_AUTH_REQUIRED")).when(s == 403, result("SOURCE_BLOCKED", "HTTP_403_SOURCE_BLOCKED"))
        .when(s == 429, result("SOURCE_BLOCKED", "HTTP_429_NO_RETRY")).when(s >= 500, result("HTTP_ERROR", F.concat(F.lit("HTTP_"), code, F.lit("_SOURCE_ERROR"))))
        .when(s.between(300, 399) & F.coalesce(_col(location).rlike("(?i)\\b(?:login|signin|auth)\\b"), F.lit(False)), result("AUTH_REQUIRED", "AUTH_REDIRECT_REJECTED"))
        .when(s.between(300, 399), result("SOURCE_BLOCKED", "REDIRECT_NOT_FOLLOWED")).when(s != 200, result("HTTP_ERROR", F.concat(F.lit("HTTP_"), code, F.lit("_UNSUPPORTED"))))
        .when(has_marker(h, LOGIN_MARKERS, LOGIN_HINTS), result("AUTH_REQUIRED", "LOGIN_WALL_REJECTED")).when(has_marker(h, AGE_MARKERS, AGE_HINTS), result("SOURCE_BLOCKED", "AGE_INTERSTITIAL_NOT_BYPASSED"))
        .otherwise(result("PUBLIC_ACCESSIBLE", "ANONYMOUS_HTTP_200"))
    )


ENTRY_FIELDS = ("@type", "@id", "url", "name", "headline", "description", "author", "datePublished", "isAccessibleForFree", "offers", "itemListElement", "item", "position")
ENTRY_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in ENTRY_FIELDS])


def parse_entry(entry: Column) -> Column:
    """Known fields of a JSON-LD entry as texts (nested values keep their JSON), read in one parse."""
    return F.from_json(entry, ENTRY_SCHEMA)


def _has_type(entry: Column, types: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce(entry["@type"], F.lit("")))
    return text.rlike("(^|[\\[\",\\s])(" + "|".join(types) + ")([\\]\",\\s]|$)")


def path_of(url) -> Column:
    return F.regexp_extract(_col(url), "(?i)^https://[^/?#]+([^?#]*)", 1)


def creator_slug(url) -> Column:
    """Single path segment that is no reserved route."""
    slug = F.regexp_extract(path_of(url), "^/([^/]+)$", 1)
    return F.when(slug.rlike(SLUG) & ~F.lower(slug).isin(*RESERVED_ROUTES), slug)


def post_id(url) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path_of(url), POST_PATH, 1)), F.lit(""))


def page_classify(pages: DataFrame, host: str, known_creators: DataFrame | None = None) -> DataFrame:
    """One record per page: creator or post, its access, evidence, visibility and class.

    ``pages(page_id, url, status, location, html[, discovery])``; ``discovery`` lists where a
    creator page was found.  Posts need a creator that ``known_creators(slug)`` holds.
    """
    if "discovery" not in pages.columns:
        pages = pages.withColumn("discovery", F.array().cast("array<string>"))
    m = page_metadata(pages, host)
    self_url = site_url(F.col("url"), F.col("url"), F.lit(host))
    # what the raw page has to say is read once and written; the page itself goes no further
    marks = {
        "_a": page_access("status", "location", "html"), "_paid": has_marker(F.col("html"), PAID_MARKERS, PAID_HINTS), "_limited": has_marker(F.col("html"), LIMITED_MARKERS, LIMITED_HINTS),
        "_ids": F.regexp_extract_all("html", F.lit("(?i)\\bdata-creator-id\\s*=\\s*[\"']?([^\"'\\s>]+)"), F.lit(1)), "source_page_hash": F.sha2("html", 256),
    }
    m = reuse(m.withColumns(marks).select("page_id", "url", "discovery", "title", "json_ld", "meta", "canonical", "links", *marks), "pages")
    base = m.withColumn("source_url", self_url).withColumns({"slug": creator_slug("source_url"), "post": post_id("source_url")})
    # every JSON-LD entry once: its fields, its kind and whether it names this page
    # most links of a page to itself are spelled like its address
    own = lambda v: F.when(v.isNull(), False).when(v == F.col("source_url"), True).otherwise(F.coalesce(site_url(v, F.col("source_url"), F.lit(host)) == F.col("source_url"), F.lit(False)))
    base = base.withColumns({"_parsed": F.transform("json_ld", parse_entry), "_og_url": meta_value("og:url")})
    described = F.transform("_parsed", lambda e: F.struct(
        e.alias("f"), _has_type(e, ("person",)).alias("person"), _has_type(e, ("profilepage",)).alias("profile"), _has_type(e, POST_TYPES).alias("article"),
        own(e["url"]).alias("url_own"), own(e["@id"]).alias("id_own"),
        F.coalesce(F.get_json_object(e["offers"], "$.price"), F.get_json_object(e["offers"], "$[0].price")).alias("price"),
    ))
    base = base.withColumn("_e", described)
    self_named = lambda e: e["url_own"] | (e["f"]["url"].isNull() & e["id_own"])
    consistent = F.exists("_e", lambda e: (e["person"] | e["profile"]) & (e["url_own"] | e["id_own"])) | own(F.col("_og_url")) | F.coalesce(F.col("canonical") == F.col("source_url"), F.lit(False))
    evidence = F.array_sort(F.array_compact(F.array(
        F.when(F.exists("_e", lambda e: e["person"] & self_named(e)), "JSON_LD_PERSON_SELF"), F.when(F.exists("_e", lambda e: e["profile"] & self_named(e)), "JSON_LD_PROFILE_SELF"),
        F.when(F.array_contains("_ids", F.col("slug")), "EXPLICIT_CREATOR_ID_SELF"), F.when(F.exists("links", lambda u: post_id(u).isNotNull()), "CREATOR_POST_RELATION"),
        F.when(F.exists("discovery", lambda d: d.startswith("RANKING_CREATOR_ITEM_")), "RANKING_CREATOR_ITEM_LINK"),
    )))
    first = lambda test: F.try_element_at(F.filter("_e", test), F.lit(1))["f"]
    structured = F.coalesce(first(lambda e: e["person"]), first(lambda e: e["profile"]))
    worded = lambda e: F.coalesce(e["f"]["name"], e["f"]["headline"], e["f"]["description"]).isNotNull()
    article = F.coalesce(first(lambda e: e["article"]), first(worded))
    base = base.withColumns({"_entry": F.when(F.col("post").isNotNull(), article).otherwise(structured), "evidence": evidence, "consistent": consistent})
    entry = F.col("_entry")
    name = clean_text(F.coalesce(F.when(F.col("post").isNotNull(), entry["headline"]), entry["name"], meta_value("og:title"), F.col("title")))
    writer = entry["author"]
    writer = F.when(writer.startswith("{"), F.coalesce(F.get_json_object(writer, "$.url"), F.get_json_object(writer, "$['@id']"))).when(writer.startswith("["), F.get_json_object(writer, "$[0].url")).otherwise(writer)
    published = F.coalesce(entry["datePublished"], meta_value("article:published_time"))
    # one column per step keeps the expressions small
    base = base.withColumns({"name": name, "_writer": writer, "_published": published})
    base = base.withColumn("_writer_url", site_url(F.col("_writer"), F.col("url"), F.lit(host)))
    base = base.withColumns({"_author": creator_slug("_writer_url"), "published_at": F.when(F.col("_published").rlike(TIMESTAMP_PATTERN), F.col("_published"))})
    free = F.exists("_e", lambda e: F.coalesce(e["f"]["isAccessibleForFree"] == "false", F.lit(False)))
    price = F.try_element_at(F.filter(F.transform("_e", lambda e: e["price"]), lambda x: x.isNotNull()), F.lit(1)).try_cast("double")
    shown = F.when(free | F.coalesce(price > 0, F.lit(False)) | F.col("_paid"), "paid").when(F.col("_limited"), "limited").otherwise("public")
    base = reuse(base.select(
        "page_id", "url", "source_url", "_a", "slug", "post", "links", "evidence", "consistent", "name", "_author", "published_at", shown.alias("_shown"),
        F.col("_entry").isNotNull().alias("_structured"), "source_page_hash",
    ))
    if known_creators is not None:
        # the author named in the metadata, else the first linked creator that is known
        known = known_creators.select(F.col("slug").alias("_k")).distinct()
        linked = base.select("page_id", F.posexplode("links").alias("_pos", "_u")).withColumn("_k", creator_slug("_u")).filter("_k is not null").join(known, "_k")
        linked = linked.groupBy("page_id").agg(F.min_by("_k", "_pos").alias("_linked"))
        base = base.join(linked, "page_id", "left").withColumn("creator_external_id", F.coalesce("_author", "_linked"))
        base = base.join(known.withColumn("_known", F.lit(True)), base.creator_external_id == F.col("_k"), "left").drop("_k")
    else:
        base = base.withColumns({"creator_external_id": F.col("_author"), "_known": F.lit(False)})
    open_page, is_post = F.col("_a.access") == "PUBLIC_ACCESSIBLE", F.col("post").isNotNull()
    is_creator = ~is_post & F.col("slug").isNotNull()
    creator_ok = F.col("name").isNotNull() & F.col("consistent") & (F.size("evidence") > 0)
    known_ok = F.coalesce(F.col("_known"), F.lit(False))
    post_ok = F.col("name").isNotNull() & known_ok
    blocked = F.when(F.col("_a.access") == "AUTH_REQUIRED", "AUTH_REQUIRED").otherwise("SOURCE_ACCESS_BLOCKED")
    label = (
        F.when(~open_page, blocked).when(is_post & (F.col("_shown") != "public"), "PAID_PROTECTED").when(is_post, F.when(post_ok, "PUBLIC_SAFE_METADATA").otherwise("PUBLIC_NEEDS_REVIEW"))
        .when(is_creator, F.when(creator_ok, "PUBLIC_SAFE_METADATA").otherwise("PUBLIC_NEEDS_REVIEW")).when(F.col("source_url").contains("/posts/"), "UNSUPPORTED").otherwise("INVALID")
    )
    kind = F.when(F.col("_structured"), "JSON_LD").otherwise("OPEN_GRAPH")
    safe = F.col("classification") == "PUBLIC_SAFE_METADATA"
    reason = (
        F.when(~open_page, F.array(F.col("_a.reason"))).when(is_post & (F.col("_shown") == "paid"), F.array(F.lit("PAID_METADATA_EXCLUDED"))).when(is_post & (F.col("_shown") == "limited"), F.array(F.lit("LIMITED_METADATA_EXCLUDED")))
        .when(is_post & safe, F.array(F.lit("ANONYMOUS_HTTP_200"), kind, F.lit("KNOWN_CREATOR"), F.lit("STABLE_POST_ID")))
        .when(is_post, F.array(F.when(known_ok, "PUBLIC_POST_METADATA_INCOMPLETE").otherwise("CREATOR_IDENTITY_NOT_CONFIRMED")))
        .when(is_creator & safe, F.array(F.lit("ANONYMOUS_HTTP_200"), F.lit("CREATOR_IDENTITY_SELF_CONSISTENT"), F.lit("CREATOR_STRUCTURAL_EVIDENCE"), kind))
        .when(is_creator, F.array(F.when(~F.col("consistent"), "CREATOR_SELF_IDENTITY_NOT_CONFIRMED").otherwise("CREATOR_STRUCTURAL_EVIDENCE_MISSING")))
        .otherwise(F.array(F.when(F.col("source_url").contains("/posts/"), "STABLE_POST_ID_MISSING").otherwise("CREATOR_CANDIDATE_SLUG_MISSING_OR_RESERVED")))
    )
    visibility = F.when(~open_page, "unknown").when(is_post, F.col("_shown")).when(F.col("classification") == "PUBLIC_SAFE_METADATA", "public").otherwise("unknown")
    out = base.withColumn("classification", label)
    return out.select(
        "page_id", F.when(is_post, "post").otherwise("creator").alias("entity_type"), F.coalesce("post", "slug").alias("external_id"), F.when(is_post, F.col("creator_external_id")).alias("creator_external_id"),
        "source_url", F.col("source_url").alias("official_url"), "name", F.when(is_post, F.col("published_at")).alias("published_at"), F.col("_a.access").alias("access"), visibility.alias("visibility"),
        "classification", F.array_sort(reason).alias("reason_codes"), F.when(is_creator, F.col("evidence")).alias("entity_evidence"), "source_page_hash",
    )


def anchor_evidence(a: Column) -> Column:
    """Structural signs that an anchor leads to a creator."""
    part = "(?i)(^|[-_:])creator($|[-_:])"
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(F.array(
        F.when(yes(a["rel"].rlike("(?i)\\bauthor\\b")), "RANKING_CREATOR_ITEM_REL_AUTHOR"), F.when(yes(a["entity_type"].rlike(part)), "RANKING_CREATOR_ITEM_ENTITY_TYPE"),
        F.when(yes(a["testid"].rlike(part)), "RANKING_CREATOR_ITEM_TESTID"), F.when(yes(a["creator_id"] == creator_slug(a["url"])), "RANKING_CREATOR_ITEM_DATA_ID"),
    ))


def discover_creators(pages: DataFrame, host: str, rendered: DataFrame | None = None) -> DataFrame:
    """Creator candidates of ranking pages, one per URL; an accepted sighting beats a rejected one.

    Sources: JSON-LD list items, anchors, and ``rendered(page_id, rank, href, text)`` units.
    """
    m = page_metadata(pages, host).select("page_id", "url", "json_ld", "anchors")
    lists = m.select("page_id", "url", F.explode(F.transform("json_ld", parse_entry)).alias("_e")).filter(_has_type(F.col("_e"), ("itemlist",)))
    items = lists.select("page_id", "url", F.posexplode(F.from_json(F.col("_e")["itemListElement"], "array<string>")).alias("_i", "_raw")).withColumn("_x", parse_entry(F.col("_raw")))
    items = items.withColumn("_item", F.when(F.col("_x.item").isNotNull(), parse_entry(F.col("_x.item"))).otherwise(F.col("_x")))
    item = F.col("_item")
    from_lists = items.filter(_has_type(item, ("person", "profilepage"))).select(
        "page_id", site_url(F.coalesce(item["url"], item["@id"]), F.col("url"), F.lit(host)).alias("found"), F.lit(0).alias("_source"), F.col("_i").alias("_place"), F.lit("json_ld_item_list").alias("method"),
        F.coalesce(F.col("_x.position").try_cast("int"), F.col("_i") + 1).alias("ranking_position"), clean_text(item["name"]).alias("text"), F.array(F.lit("RANKING_CREATOR_ITEM_JSON_LD")).alias("evidence"))
    from_anchors = m.select("page_id", F.posexplode("anchors").alias("_i", "_x")).select(
        "page_id", F.col("_x.url").alias("found"), F.lit(1).alias("_source"), F.col("_i").alias("_place"), F.lit("ranking_anchor").alias("method"), F.lit(None).cast("int").alias("ranking_position"), F.col("_x.text").alias("text"), anchor_evidence(F.col("_x")).alias("evidence"))
    parts = [from_lists, from_anchors]
    if rendered is not None:
        r = rendered.join(m.select("page_id", "url"), "page_id").filter(F.col("rank").between(1, 999))
        r = r.withColumn("found", site_url(F.col("href"), F.col("url"), F.lit(host))).withColumn("text", clean_text("text")).filter(creator_slug("found").isNotNull() & F.col("text").isNotNull())
        one = r.groupBy("page_id", "rank").agg(F.min("found").alias("found"), F.max("found").alias("_hi"), F.max("text").alias("text")).filter("found = _hi")
        parts.append(one.select("page_id", "found", F.lit(2).alias("_source"), F.col("rank").alias("_place"), F.lit("rendered_ranking_unit").alias("method"), F.col("rank").cast("int").alias("ranking_position"), "text", F.array(F.lit("RANKING_CREATOR_ITEM_RENDERED_STRUCTURAL_UNIT")).alias("evidence")))
    rows = reduce(DataFrame.unionByName, parts).filter(path_of("found").rlike("^/[^/]+$"))
    reserved = F.lower(F.regexp_extract(path_of("found"), "^/([^/]+)$", 1)).isin(*RESERVED_ROUTES)
    rejected = F.when(reserved, "KNOWN_NON_CREATOR_ROUTE").when(F.size("evidence") == 0, "RANKING_ITEM_STRUCTURAL_EVIDENCE_MISSING")
    judged = rows.withColumn("rejected_reason", rejected).withColumn("_bad", F.col("rejected_reason").isNotNull().cast("int"))
    best = latest_per_key(judged, ["found"], [("_bad", "asc"), ("page_id", "asc"), ("_source", "asc"), ("_place", "asc")])
    return best.select(F.col("found").alias("url"), F.regexp_extract(path_of("found"), "^/([^/]+)$", 1).alias("candidate_slug"), "page_id", "method", "ranking_position", "text", F.array_sort("evidence").alias("evidence"), "rejected_reason")


