"""Creators and posts: projection, review, bundles, identity resolution."""

from pyspark.sql import functions as F

from colophon.operators import bundles, posts
from colophon.plans.bindings import Tables
from colophon.plans.registry import query

SOURCE = posts.PostSource("creator feed", "creators.example", "link.creators.example", "Creators")
_VIS = "('public_general','affiliate_visible','approved_affiliate_only')"
_APPROVED = f"""
approved as (select p.external_post_id, p.title, p.official_url canonical_url, p.price, p.currency, coalesce(media_indicator, content_type, 'unknown') media_type, link_status, affiliate_url,
  coalesce(link_status='active' and affiliate_url like 'https://%', false) show_affiliate_cta, c.external_creator_id, c.profile_slug creator_slug, c.display_name creator_name
  from posts p join creators c on c.creator_id=p.creator_id and c.data_source_id=p.data_source_id
  where c.review_state='approved' and c.visibility in {_VIS} and p.review_state='approved' and p.visibility in {_VIS} and trim(c.display_name)<>'' and trim(p.title)<>''
  and lower(p.official_url) = 'https://creators.example/posts/' || lower(p.external_post_id))"""


def _approved(t: Tables):
    return posts.approved_posts(t.posts(), t.creators(), t.data_sources(), SOURCE)


@query("C11_approved_posts", f"with {_APPROVED} select * from approved", "posts creators")
def approved(t: Tables):
    return _approved(t).drop("creator_url", "source_badge")


@query("D14_multi_key_join", "select external_post_id, external_creator_id from posts p join creators c on c.creator_id=p.creator_id and c.data_source_id=p.data_source_id", "posts creators")
def multi_key(t: Tables):
    return t.posts().select("external_post_id", "creator_id", "data_source_id").join(t.creators(), ["creator_id", "data_source_id"]).select("external_post_id", "external_creator_id")


@query("C12_search_posts", f"with {_APPROVED} select external_post_id, title from approved where (title ilike '%URGENT%' or creator_name ilike '%URGENT%') and external_post_id > '00000000-0000-4000-8000-000000000500' order by 1 limit 24", "posts creators")
def search_posts(t: Tables):
    return posts.search_posts(_approved(t), "  URGENT,", "00000000-0000-4000-8000-000000000500").select("external_post_id", "title")


@query("C12_list_posts", f"with {_APPROVED} select external_post_id, title from approved order by 1 limit 5000", "posts creators")
def list_posts(t: Tables):
    return posts.list_posts(_approved(t), None, 5000).select("external_post_id", "title")


@query("B28_public_posts", f"with {_APPROVED} select external_post_id, '/work/post/' || external_post_id path, title, creator_name, price, media_type, case when show_affiliate_cta then affiliate_url end affiliate_url, show_affiliate_cta from approved where currency='JPY'", "posts creators")
def public_posts(t: Tables):
    return posts.public_posts(_approved(t), SOURCE).select("external_post_id", "path", "title", "creator_name", "price", "media_type", "affiliate_url", "show_affiliate_cta")


def _publication_rows(t: Tables):
    c = t.creators().select("creator_id", F.col("visibility").alias("creator_visibility"), F.col("review_state").alias("creator_review_state"))
    p = t.posts().join(c, "creator_id", "left")
    return p.select(
        F.lit("creator feed").alias("source_name"), "external_post_id", "title", F.col("official_url").alias("canonical_url"), F.col("creator_visibility").isNotNull().alias("creator_relation_valid"),
        "creator_visibility", "creator_review_state", F.col("visibility").alias("post_visibility"), F.col("review_state").alias("post_review_state"), "link_status", "affiliate_url",
        F.when(F.col("post_id") % 60 == 0, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("prohibited_fields"))


_DECIDED = f"""
decided as (select p.external_post_id, concat_ws('|', case when c.visibility not in {_VIS} then 'creator_visibility_not_approved' end, case when c.review_state<>'approved' then 'creator_review_not_approved' end,
  case when p.visibility not in {_VIS} then 'post_visibility_not_approved' end, case when p.review_state<>'approved' then 'post_review_not_approved' end, case when p.title='' then 'title_missing' end,
  case when p.official_url like '%/x' then 'canonical_url_identity_mismatch' end, case when post_id%60=0 then 'prohibited_private_fields_present' end) block_reasons,
  case when p.official_url not like '%/x' then p.official_url end canonical_outbound_url, p.link_status='active' and p.affiliate_url like 'https:%' show_link,
  case when p.link_status<>'active' then 'status_not_active' when p.affiliate_url like 'https:%' then 'active_valid' else 'active_url_invalid' end link_reason
  from posts p join creators c using (creator_id))"""


@query("I28_publication_decision", f"with {_DECIDED} select *, block_reasons='' eligible from decided", "posts creators")
def decisions(t: Tables):
    out = posts.publication_decisions(_publication_rows(t), SOURCE)
    return out.select("external_post_id", F.array_join("block_reasons", "|").alias("block_reasons"), "canonical_outbound_url", F.col("link.show").alias("show_link"), F.col("link.reason").alias("link_reason"), "eligible")


@query("I28_preview_summary", f"with {_DECIDED} select count(*) total, count(*) filter (where block_reasons='') eligible, count(*) filter (where block_reasons<>'') blocked, count(*) filter (where show_link) affiliate_cta_visible, count(*) neutral_placeholders from decided", "posts creators")
def summary(t: Tables):
    return posts.preview_summary(posts.publication_decisions(_publication_rows(t), SOURCE))


def _review_creators(t: Tables):
    i = F.col("creator_id")
    return t.creators().select(
        i, "data_source_id", F.lit("creator feed").alias("source_name"), F.when(i % 35 == 0, F.lit("profile_slug:maker_0")).otherwise(F.col("external_creator_id")).alias("external_creator_id"), "profile_slug", "display_name", "official_url",
        F.when(i % 22 == 0, '{"email":"x"}').when(i % 18 == 0, '{"shoe_size":1}').otherwise("{}").alias("metadata"), (i % 16 == 0).alias("has_media"))


def _review_posts(t: Tables):
    i = F.col("post_id")
    return t.posts().select(
        i, F.when(i % 45 == 0, 2).otherwise(F.col("data_source_id")).alias("data_source_id"), "creator_id", F.lit("creator feed").alias("source_name"), "external_post_id", "title", "official_url",
        F.coalesce("media_indicator", "content_type", F.lit("unknown")).alias("media_type"), F.when(i % 8 != 0, F.col("price")).alias("price"), "currency", F.lit("{}").alias("metadata"), F.lit(False).alias("has_media"), "link_status", "affiliate_url")


_REVIEWED = """
cr as (select creator_id id, *, case when creator_id%35=0 then 'profile_slug:maker_0' else external_creator_id end ext, (select count(*) from posts p where p.creator_id=c.creator_id) linked,
  (select count(*) from posts p where p.creator_id=c.creator_id and post_id%45=0) foreign_n from creators c),
cc as (select id, concat_ws('|', case when ext in (select ext from cr group by 1 having count(*)>1) then 'DUPLICATE_CREATOR_IDENTITY' end, case when ext<>external_creator_id then 'CREATOR_IDENTITY_CONFLICT|CREATOR_STABLE_IDENTITY_INVALID' end,
  case when trim(display_name)='' then 'CREATOR_NAME_MISSING' end, case when id%22=0 then 'PROHIBITED_PRIVATE_DATA_PRESENT' end, case when foreign_n>0 then 'CREATOR_POST_RELATION_CONFLICT' end) rej,
  concat_ws('|', case when id%22<>0 and id%18=0 then 'UNEXPECTED_METADATA_REQUIRES_REVIEW' end, case when id%16=0 then 'RIGHTS_DEPENDENT_MEDIA_PRESENT' end, case when linked=0 then 'CREATOR_HAS_NO_LINKED_POSTS' end) rev from cr),
creators_judged as (select id, case when rej<>'' then 'REJECT' when rev<>'' then 'NEEDS_HUMAN_REVIEW' else 'AUTO_APPROVABLE' end classification,
  coalesce(nullif(concat_ws('|', nullif(rej,''), nullif(rev,'')),''),'TEXT_ONLY_CREATOR_CONTRACT_SATISFIED') reason_codes from cc),
pp as (select p.*, k.classification cclass, coalesce(media_indicator, content_type, 'unknown') media_type, concat_ws('|', case when official_url in (select official_url from posts group by 1 having count(*)>1) then 'DUPLICATE_POST_IDENTITY' end,
  case when official_url like '%/x' then 'POST_CANONICAL_IDENTITY_INVALID' end, case when title='' then 'POST_TITLE_MISSING' end, case when post_id%45=0 then 'POST_CREATOR_RELATION_CONFLICT' end,
  case when k.classification='REJECT' then 'CREATOR_REJECTED' end, case when currency<>'JPY' then 'POST_CURRENCY_INVALID' end) rej, case when k.classification='NEEDS_HUMAN_REVIEW' then 'CREATOR_REVIEW_DEPENDENCY' else '' end rev
  from posts p join creators_judged k on k.id=p.creator_id),
posts_judged as (select post_id, external_post_id, link_status, affiliate_url, case when rej<>'' then 'REJECT' when rev<>'' then 'NEEDS_HUMAN_REVIEW' else 'AUTO_APPROVABLE' end classification,
  concat_ws('|', nullif(rej,''), nullif(rev,''), case when rej='' and rev='' then 'TEXT_ONLY_POST_CONTRACT_SATISFIED' end, case when post_id%8=0 then 'OPTIONAL_PRICE_MISSING' end, case when media_type='unknown' then 'OPTIONAL_MEDIA_TYPE_UNKNOWN' end,
  case when link_status='missing' then 'AFFILIATE_LINK_MISSING_NON_BLOCKING' end) reason_codes from pp)"""


def _judged(t: Tables):
    creators = posts.classify_creators(_review_creators(t), _review_posts(t), SOURCE)
    return creators, posts.classify_posts(_review_posts(t), creators, SOURCE)


@query("I29_review_creators", f"with {_REVIEWED} select * from creators_judged", "posts creators")
def review_creators(t: Tables):
    return _judged(t)[0].select(F.col("creator_id").alias("id"), "classification", F.array_join("reason_codes", "|").alias("reason_codes"))


@query("I29_review_posts", f"with {_REVIEWED} select post_id, classification, reason_codes from posts_judged", "posts creators")
def review_posts(t: Tables):
    return _judged(t)[1].select("post_id", "classification", F.array_join("reason_codes", "|").alias("reason_codes"))


@query("I29_simulate_approval", f"""with {_REVIEWED}, a as (select *, classification='AUTO_APPROVABLE' ok, classification='AUTO_APPROVABLE' and link_status='active' and affiliate_url like 'https:%' cta from posts_judged)
  select count(*) filter (where ok) eligible_posts, count(*) filter (where not ok) blocked_posts, count(*) filter (where cta) affiliate_cta_count, count(*) filter (where ok) placeholder_count, count(*) filter (where ok) projection_candidates from a""", "posts creators")
def simulate(t: Tables):
    return posts.simulate_approval(_judged(t)[1], SOURCE)


# -- bundles ---------------------------------------------------------------------------------------
def bundle_posts(t: Tables):
    i = F.col("post_id")
    base = t.posts(dealt=True)
    slug = F.concat(F.lit("maker_"), (F.col("creator_id") % 50).cast("string"))
    rows = base.select(
        (i * 2).alias("index"), F.upper("external_post_id").alias("post_uuid"), F.concat(F.lit("https://www.creators.example/posts/"), F.when(i % 30 == 0, "x").otherwise(F.col("external_post_id"))).alias("post_public_url"),
        F.when(i % 40 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "title")).alias("title"), F.when(i % 33 == 0, "Other").otherwise(F.concat(F.lit("Name "), slug)).alias("creator_name"),
        F.when(i % 2 == 0, slug).alias("creator_username"), F.when(i % 2 == 1, F.concat(F.lit("https://creators.example/"), slug)).alias("creator_profile_url"), "price",
        (i % 120).cast("double").alias("reward_rate"), F.when(i % 4 == 0, F.floor(F.col("price") * (i % 120) / 100).cast("bigint") + F.when(i % 12 == 0, 5).otherwise(0)).alias("estimated_reward"),
        F.coalesce("media_indicator", F.lit("unknown")).alias("media_type"), F.lit(None).cast("bigint").alias("duration_seconds"), (i % 7 - 1).cast("bigint").alias("likes"), (i % 10 != 1).alias("eligible"),
        F.when(F.col("affiliate_url").like("https%"), F.col("affiliate_url")).alias("displayed_affiliate_url"), F.when(F.col("affiliate_url").like("https%"), "ACTIVE").alias("affiliate_link_status"),
        F.lit("HIGH").alias("parser_confidence"), F.lit("2024-01-30T10:00:00").alias("collected_at"))
    again = rows.filter("floor(index / 2) % 9 = 0").withColumn("index", F.col("index") + 1)
    changed = again.withColumn("price", F.when(F.floor(F.col("index") / 2) % 18 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return rows.unionByName(changed)


_BUNDLE = """
raw as (select post_id*2 idx, post_id i, 0 copy, price from posts union all select post_id*2+1, post_id, 1, case when post_id%18=0 then price+1 else price end from posts where post_id%9=0),
b as (select r.idx, r.i, r.copy, r.price, p.external_post_id ext, 'maker_' || cast(p.creator_id%50 as varchar) slug, case when r.i%33=0 then 'Other' else 'Name maker_' || cast(p.creator_id%50 as varchar) end nm, r.i%120 rate,
  case when r.i%4=0 then cast(floor(p.price*(r.i%120)/100.0) as bigint) + case when r.i%12=0 then 5 else 0 end end reward, r.i%10<>1 eligible from raw r join posts p on p.post_id=r.i),
n as (select *, concat_ws('|', case when i%30=0 then 'MALFORMED_OR_MISMATCHED_POST_PUBLIC_URL' end, case when rate>100 then 'INVALID_AFFILIATE_REWARD_RATE' end, case when i%7=0 then 'INVALID_LIKES' end,
  case when reward>price then 'ESTIMATED_REWARD_EXCEEDS_PRICE' end, case when reward > price*rate/100.0+1 then 'ESTIMATED_REWARD_EXCEEDS_GROSS_RATE' end, case when i%40=0 then 'EMPTY_TITLE' end) bad from b),
nm as (select slug, arg_min(nm, idx) ref from n where bad='' and eligible group by 1),
f as (select ext, min(idx) first_idx, arg_min(price, idx) first_price from n join nm using (slug) where bad='' and eligible and nm=ref group by 1),
o as (select n.*, ref, first_idx, case when bad<>'' then 'rejected' when not eligible then 'skipped' when first_idx<idx and first_price=price and nm=ref then 'duplicate' when first_idx<idx then 'rejected' when nm<>ref then 'rejected' else 'accepted' end outcome,
  case when bad<>'' then bad when not eligible then 'AFFILIATE_INELIGIBLE' when first_idx<idx and (first_price<>price or nm<>ref) then 'DUPLICATE_CONFLICTING_UUID' when first_idx<idx then '' when nm<>ref then 'CONFLICTING_CREATOR_DISPLAY_NAME' else '' end reasons
  from n left join nm using (slug) left join f using (ext))"""


@query("I17_import_bundle", f"with {_BUNDLE} select idx \"index\", outcome, reasons from o", "posts")
def import_bundle(t: Tables):
    return bundles.import_bundle(bundle_posts(t), SOURCE).select("index", "outcome", F.array_join("reasons", "|").alias("reasons"))


@query("I17_import_report", f"with {_BUNDLE} select count(*) \"input\", count(*) filter (where outcome='accepted') accepted, count(*) filter (where outcome='rejected') rejected, count(*) filter (where outcome in ('skipped','duplicate')) skipped, count(*) filter (where outcome='duplicate') duplicate_identical, count(*) filter (where reasons='DUPLICATE_CONFLICTING_UUID') duplicate_conflicting from o", "posts")
def import_report(t: Tables):
    return bundles.import_report(bundles.import_bundle(bundle_posts(t), SOURCE))


def _targets(t: Tables):
    imported = bundles.import_bundle(bundle_posts(t), SOURCE)
    return bundles.bundle_targets(imported)


def _stored_creators(t: Tables):
    i = F.col("creator_id")
    slug = F.concat(F.lit("maker_"), i.cast("string"))
    known = t.creators().select(
        i, F.when(i % 5 == 0, F.concat(F.lit("ext:"), i.cast("string"))).otherwise(F.concat(F.lit("profile_slug:"), slug)).alias("external_creator_id"), F.when(i % 7 == 0, F.concat(slug, F.lit("x"))).otherwise(slug).alias("profile_slug"),
        F.when(i % 3 == 0, F.concat(F.lit("Name "), slug)).otherwise("old name").alias("display_name"), F.concat(F.lit("https://creators.example/"), slug).alias("official_url"))
    twins = known.filter("creator_id % 11 = 0").withColumn("creator_id", F.col("creator_id") + 1000000000)
    return known.unionByName(twins)


_STORED = """
sc as (select creator_id id, case when creator_id%5=0 then 'ext:' || cast(creator_id as varchar) else 'profile_slug:maker_' || cast(creator_id as varchar) end ext, 'maker_' || cast(creator_id as varchar) || case when creator_id%7=0 then 'x' else '' end slug,
  case when creator_id%3=0 then 'Name maker_' || cast(creator_id as varchar) else 'old name' end nm, 'https://creators.example/maker_' || cast(creator_id as varchar) url from creators),
sc2 as (select * from sc union all select id+1000000000, ext, slug, nm, url from sc where id%11=0),
tc as (select slug, 'profile_slug:' || slug ext, ref nm, 'https://creators.example/' || slug url from o where outcome='accepted' group by all),
mc as (select tc.ext, min(s.id) lo, max(s.id) hi, arg_min(s.slug,s.id) slug, arg_min(s.nm,s.id) nm, arg_min(s.ext,s.id) sext from tc join sc2 s on s.ext=tc.ext or s.slug=tc.slug or s.url=tc.url group by 1),
rc as (select tc.ext, lo, case when lo is null then 'NEW' when lo<>hi then 'AMBIGUOUS' when mc.slug<>tc.slug then 'CONFLICT' else 'EXISTING_EXACT' end status, case when lo is not null and lo=hi and mc.slug=tc.slug and mc.nm<>tc.nm then 'display_name' else '' end changed from tc left join mc on mc.ext=tc.ext)"""


@query("I18_resolve_creators", f"with {_BUNDLE}, {_STORED} select ext external_creator_id, status, changed changed_fields, case when status='EXISTING_EXACT' then lo end creator_id from rc", "posts creators")
def resolve_creators(t: Tables):
    out = bundles.resolve_creators(_targets(t)["creators"], _stored_creators(t))
    return out.select("external_creator_id", "status", F.array_join("changed_fields", "|").alias("changed_fields"), "creator_id")


def _stored_posts(t: Tables):
    i = F.col("post_id")
    return t.posts().filter("post_id % 3 = 0").select(
        "external_post_id", (F.col("creator_id") % 50 + F.when(i % 9 == 0, 1).otherwise(0)).alias("creator_id"), F.when(i % 6 == 0, "old").otherwise(F.trim("title")).alias("title"), SOURCE.post_url(F.col("external_post_id")).alias("official_url"),
        F.coalesce("media_indicator", F.lit("unknown")).alias("content_type"), F.coalesce("media_indicator", F.lit("unknown")).alias("media_indicator"), "price", F.lit("JPY").alias("currency"))


@query("I18_resolve_posts", f"""with {_BUNDLE}, {_STORED} select o.ext external_post_id, case when status in ('AMBIGUOUS','CONFLICT') then 'CONFLICT' when i%3<>0 then 'NEW'
  when status='NEW' or p.creator_id%50 + case when i%9=0 then 1 else 0 end <> lo then 'CONFLICT' when i%6=0 or p.price<>o.price then 'EXISTING_UPDATE_NEEDED' else 'EXISTING_IDENTICAL' end status
  from o join rc on rc.ext='profile_slug:' || o.slug join posts p on p.post_id=o.i where outcome='accepted'""", "posts creators")
def resolve_posts(t: Tables):
    return bundles.resolve_identities(_targets(t), _stored_creators(t), _stored_posts(t))[1].select("external_post_id", "status")


@query("I18_second_run", "select cast(null as varchar) identity, cast(null as varchar) status where false")
def second_run(t: Tables):
    return bundles.second_run_changes(_targets(t), _stored_creators(t), _stored_posts(t))


@query("I19_link_import", """
with ob as (select post_id*2 pos, post_id i, external_post_id ext, affiliate_url url from posts where affiliate_url is not null union all select post_id*2+1, post_id, external_post_id, affiliate_url || '?b' from posts where affiliate_url is not null and post_id%3=0)
select pos as position, case when url like 'http:%' then 'INVALID' when pos%2=1 then 'CONFLICT' when i%5=0 then 'INVALID' when i%7=0 then 'ACTIVE_IDENTICAL' when i%11=0 then 'CONFLICT' else 'ACTIVE_NEW' end status from ob""", "posts")
def link_import(t: Tables):
    i = F.col("post_id")
    p = t.posts().filter("affiliate_url is not null")
    first = p.select((i * 2).alias("position"), F.col("external_post_id").alias("post_uuid"), F.col("affiliate_url").alias("displayed_affiliate_url"))
    second = p.filter("post_id % 3 = 0").select((i * 2 + 1).alias("position"), F.col("external_post_id").alias("post_uuid"), F.concat("affiliate_url", F.lit("?b")).alias("displayed_affiliate_url"))
    stored = t.posts().filter("post_id % 5 <> 0").select(
        "external_post_id", F.when(i % 7 == 0, "active").when(i % 11 == 0, "revoked").otherwise("missing").alias("link_status"), F.when(i % 7 == 0, F.col("affiliate_url")).alias("affiliate_url"))
    return bundles.resolve_link_import(first.unionByName(second), stored, SOURCE).select("position", "status")


_CUM = ["title", "official_url", "price", "link"]


def _cumulative(t: Tables):
    i = F.col("post_id")
    link = F.when(i % 5 == 0, F.concat(F.lit("https://l/"), i.cast("string")))
    old = t.posts().filter("post_id % 4 <> 0").select(
        "external_post_id", "title", "official_url", "price", link.alias("link"), F.lit("2024-01-01").alias("first_seen_at"), F.lit("r1").alias("first_seen_run"), F.lit("2024-01-01").alias("last_seen_at"), F.lit("r1").alias("last_seen_run"))
    new = t.posts().filter("post_id % 6 <> 0").select(
        "external_post_id", "title", F.when(i % 13 == 0, "https://other/").otherwise(F.col("official_url")).alias("official_url"), F.when(i % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"),
        F.when(i % 25 == 0, "https://l/else").alias("link"), F.lit("2024-01-02").alias("collected_at"))
    return bundles.merge_cumulative(old, new, "external_post_id", _CUM, ["official_url"], "r2", sticky="link")


_CUM_SQL = """
c as (select post_id i, external_post_id, post_id%4<>0 has_old, post_id%6<>0 has_new, price, post_id%5=0 lnk from posts),
s as (select *, case when has_old and has_new and (i%13=0 or (i%25=0 and lnk)) then 'conflict' when not has_new then 'absent' when not has_old then 'added' when i%7=0 then 'updated' when i%25=0 and not lnk then 'updated' else 'unchanged' end status from c where has_old or has_new)"""


@query("I20_merge_cumulative", f"""with {_CUM_SQL} select external_post_id, status, case when has_new and status<>'conflict' and i%7=0 then price+1 else price end price,
  case when status='added' then '2024-01-02' else '2024-01-01' end first_seen_at, case when has_new and status<>'conflict' then 'r2' else 'r1' end last_seen_run from s""", "posts")
def merge_cumulative(t: Tables):
    out = _cumulative(t)
    return out["records"].join(out["status"], "external_post_id").select("external_post_id", "status", "price", "first_seen_at", "last_seen_run")


@query("I20_merge_counts", f"with {_CUM_SQL} select " + ", ".join(f"count(*) filter (where status='{x}') {x}" for x in ("added", "updated", "unchanged", "absent", "conflict")) + " from s", "posts")
def merge_counts(t: Tables):
    return _cumulative(t)["counts"]


@query("I21_incremental_diff", """select external_post_id, case when post_id%9=0 then 'CONFLICT' when post_id%5=0 then 'NEW' when post_id%13=0 then 'CONFLICT' when post_id%7=0 then 'UPDATE_NEEDED' else 'EXISTING_IDENTICAL' end status from posts""", "posts")
def incremental_diff(t: Tables):
    i = F.col("post_id")
    rows = t.posts().select(i, "external_post_id", "official_url", "title", "price")
    past = rows.filter("post_id % 5 <> 0").withColumns({"price": F.when(i % 7 == 0, F.col("price") + 1).otherwise(F.col("price")), "official_url": F.when(i % 13 == 0, "https://other/").otherwise(F.col("official_url"))})
    baseline = bundles.baseline_of(past, "external_post_id", ["title", "price"], ["official_url"])
    return bundles.incremental_diff(rows.filter("post_id % 9 <> 0"), baseline, "external_post_id", ["title", "price"], ["official_url"], rows.select("external_post_id"))


def _observations(t: Tables):
    i = F.col("post_id")
    seen = t.posts().select((F.floor(i / 20)).cast("bigint").alias("page"), (i % 20).alias("place"), F.lit("post_search").alias("source_surface"), F.col("external_post_id").alias("post_uuid"), "price")
    again = t.posts().filter("post_id % 4 = 0").select((F.floor(i / 20) + 1).cast("bigint").alias("page"), (i % 20 + 100).alias("place"), F.lit("post_search").alias("source_surface"), F.col("external_post_id").alias("post_uuid"), (F.col("price") + 1).alias("price"))
    return seen.unionByName(again)


_OBS = "obs as (select post_id//20 page, external_post_id ext, post_id%20 place, price from posts union all select post_id//20+1, external_post_id, post_id%20+100, price+1 from posts where post_id%4=0)"


@query("I22_page_fingerprints", f"""with {_OBS} select page, count(*) detected_posts, sha256('post_search' || chr(10) || string_agg(ext, ',' order by ext)) fingerprint from obs group by 1""", "posts")
def fingerprints(t: Tables):
    return bundles.page_fingerprints(_observations(t)).drop("source_surface")


@query("I22_bundle_records", f"with {_OBS} select ext post_uuid, arg_max(price, page*1000+place) price, min(page) first_page from obs group by 1", "posts")
def bundle_records(t: Tables):
    return bundles.bundle_pages(_observations(t), "post_uuid", ["price"])["records"]


@query("I30_staging_posts", "select external_post_id external_id, title, 'username:maker_' || cast(creator_id as varchar) creator_external_id, price, 'AFFILIATE_VISIBLE' permission_scope from posts", "posts")
def staging_posts(t: Tables):
    p = t.posts().select(F.col("external_post_id").alias("post_uuid"), F.col("official_url").alias("post_public_url"), "title", F.concat(F.lit("Maker_"), F.col("creator_id").cast("string")).alias("creator_username"), "price", F.col("media_indicator").alias("media_type"))
    c = t.creators().select(F.col("profile_slug").alias("username"), F.col("display_name").alias("creator_name"), F.col("official_url").alias("profile_url"), F.array(F.lit("basic")).alias("plans"))
    return bundles.bundle_to_staging(c, p)["posts"].select("external_id", "title", "creator_external_id", "price", "permission_scope")


@query("I30_unresolved_plans", "select 'username:' || profile_slug creator_external_id, p plan_name, 'NEEDS_STABLE_PLAN_ID' import_status from creators, (values ('basic'),('gold')) v(p)", "creators")
def staging_plans(t: Tables):
    c = t.creators().select(F.upper("profile_slug").alias("username"), F.col("display_name").alias("creator_name"), F.col("official_url").alias("profile_url"), F.array(F.lit("basic"), F.lit("gold")).alias("plans"))
    return bundles.bundle_to_staging(c, t.posts().select(F.col("external_post_id").alias("post_uuid"), F.col("official_url").alias("post_public_url"), "title", F.lit(None).cast("string").alias("creator_username"), "price", F.col("content_type").alias("media_type")))["unresolved_plans"]


@query("I16_staging_plan", """select external_post_id external_id, case when post_id%8=0 then 'CONFLICT' when post_id%5=0 then 'CONFLICT' when post_id%9=0 then 'CONFLICT' when post_id%3=0 then 'NEW' when post_id%7=0 then 'EXISTING_CHANGED' else 'UNCHANGED' end state,
  case when post_id%8=0 then 'NOT_PUBLIC_SAFE_METADATA' when post_id%5=0 then 'MULTIPLE_EXISTING_IDENTITY_ROWS' when post_id%9=0 then 'OFFICIAL_URL_ID_CONFLICT' when post_id%3=0 then 'TARGET_ABSENT' when post_id%7=0 then 'EXISTING_ROW_DIFFERS' else 'EXACT_FROZEN_MATCH' end reason from posts""", "posts")
def staging_plan(t: Tables):
    i = F.col("post_id")
    rows = t.posts().select(
        i, F.lit("post").alias("entity_type"), F.col("external_post_id").alias("external_id"), F.concat(F.lit("https://creators.example/posts/"), "external_post_id").alias("official_url"), F.col("creator_id").cast("string").alias("creator_external_id"),
        F.sha2("title", 256).alias("metadata_hash"), F.when(i % 8 == 0, "PAID").otherwise("PUBLIC_SAFE_METADATA").alias("classification"))
    known = rows.filter("post_id % 3 <> 0 or post_id % 5 = 0 or post_id % 9 = 0").withColumns({
        "external_id": F.when((i % 9 == 0) & (i % 5 != 0), F.concat(F.lit("z"), "external_id")).otherwise(F.col("external_id")), "metadata_hash": F.when(i % 7 == 0, "0").otherwise(F.col("metadata_hash")),
        "data_source_id": F.lit(1), "visibility": F.lit("public"), "review_status": F.lit("public_metadata_staged")})
    stored = known.unionByName(known.filter("post_id % 5 = 0"))
    return bundles.staging_plan(rows, stored, 1)


@query("G13_target_selection", """select post_id place, external_post_id post_uuid from posts where post_id%30<>0 and post_id%4<>0 and affiliate_url is null and post_id%5<>0 order by post_id limit 20""", "posts")
def target_selection(t: Tables):
    i = F.col("post_id")
    catalog = t.posts().select(F.col("external_post_id").alias("post_uuid"), F.col("official_url").alias("post_public_url"), (i % 4 != 0).alias("eligible"), F.col("affiliate_url").alias("displayed_affiliate_url"), F.lit(None).cast("string").alias("affiliate_link_status"))
    page = t.posts().select(i.alias("place"), F.col("external_post_id").alias("post_uuid"), SOURCE.post_url(F.col("external_post_id")).alias("post_public_url"))
    excluded = t.posts().filter("post_id % 5 = 0").select(F.col("external_post_id").alias("post_uuid"))
    return bundles.target_selection(catalog, page, excluded, 20, SOURCE).select("place", "post_uuid")


@query("B24_post_text_fields", """select post_id, price, (post_id%100)::double reward_rate, cast(post_id%500 as bigint) estimated_reward, cast((post_id%59)*60 + post_id%60 as int) duration_seconds, 'user.' || cast(post_id as varchar) username,
  '3日前' relative_published_text, 'video' media_type from posts where true""", "posts")
def text_fields(t: Tables):
    i = F.col("post_id")
    text = F.concat_ws(" ", F.lit("価格 ¥"), F.col("price").cast("string"), F.lit("円  報酬率："), F.concat((i % 100).cast("string"), F.lit("% (¥"), (i % 500).cast("string"), F.lit("円)")),
                       F.concat((i % 59).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0")), F.concat(F.lit("@user."), i.cast("string")), F.lit("3日前"))
    out = bundles.post_text_fields(t.posts().select(i, text.alias("text")))
    return out.select("post_id", "price", "reward_rate", "estimated_reward", "duration_seconds", "username", "relative_published_text", "media_type")
