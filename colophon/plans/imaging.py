"""Image candidates: features derived from the works, scored and decided."""

import math

from pyspark.sql import functions as F

from colophon.operators import images, sampling
from colophon.plans.bindings import Tables
from colophon.plans.registry import query

TYPES = ("dvd_full", "dvd_right", "dvd_center", "sample", "sample", "vertical_package")


def features(t: Tables):
    """Six candidates per work with measured features."""
    w = t.works_by_code("id", "product_code")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("type")) for k, x in enumerate(TYPES)])
    rows = w.select("id", F.col("product_code").alias("code"), F.inline(kinds))
    i, k = F.col("id"), F.col("k")
    m = lambda a, b, n: (i * a + k * b) % n
    return rows.select(
        "id", "code", (i * 10 + k).alias("candidate_id"), "type", (0.5 + m(1, 9, 60) / 100).alias("ratio"), (300 + m(13, 29, 300)).alias("short_edge"), (150000 + m(977, 31, 1000) * 400).alias("area"),
        (m(7, 13, 30) / 100).alias("edge_density"), (m(5, 11, 25) / 100).alias("top_bottom_edge_density"), m(3, 17, 200).alias("seam_strength"), (m(11, 7, 80) / 100).alias("skin_ratio"),
        (m(1, 5, 50) / 100).alias("flat_extreme_ratio"), (0.7 + m(1, 1, 80) / 100).alias("left_right_lift"), (0.6 + m(2, 1, 90) / 100).alias("top_bottom_lift"), (i % 3 == 0).alias("identity"), (i % 4 == 0).alias("ensemble"),
        F.concat(F.when(F.col("type") == "sample", F.lit("sample:")).otherwise(F.lit("dvd:")), F.when(F.col("type") == "sample", (k - 2).cast("string")).otherwise(F.replace("type", F.lit("dvd_"), F.lit("")))).alias("source_id"),
        F.concat(F.lit("https://pics.example/"), i.cast("string"), F.lit("/"), k.cast("string"), F.lit(".jpg")).alias("url"), F.sha2(F.concat_ws("/", i.cast("string"), k.cast("string")), 256).alias("source_hash"),
        F.sha2(F.concat_ws("-", i.cast("string"), k.cast("string")), 256).alias("output_hash"), F.when(F.col("type") == "sample", k - 2).cast("int").alias("sample_index"), (k * 10).cast("int").alias("crop_left"), F.lit(200).alias("crop_width"))


_SCORED = """
f0 as (select id, product_code code, unnest([{'k':0,'t':'dvd_full'},{'k':1,'t':'dvd_right'},{'k':2,'t':'dvd_center'},{'k':3,'t':'sample'},{'k':4,'t':'sample'},{'k':5,'t':'vertical_package'}]) x from works),
f as (select id, code, id*10+x.k candidate_id, x.k k, x.t t, 0.5+((id+x.k*9)%60)/100 ratio, 300+(id*13+x.k*29)%300 se, 150000+((id*977+x.k*31)%1000)*400 area, ((id*7+x.k*13)%30)/100 edge, ((id*5+x.k*11)%25)/100 band, (id*3+x.k*17)%200 seam, ((id*11+x.k*7)%80)/100 skin,
  ((id+x.k*5)%50)/100 flat, 0.7::double+((id+x.k)%80)/100 lr, 0.6::double+((id*2+x.k)%90)/100 tb, id%3=0 identity, id%4=0 ensemble from f0),
g as (select *, edge>=0.15 and band>=0.13 and seam>=80 and skin<0.66 dense, ratio between 0.55 and 0.9 and edge>=0.1 and band>=0.095 and skin<0.62 and flat<0.42 jacket, edge<0.095 and band<0.09 and seam<85 plain,
  skin>=0.58 and band<0.13 and seam<95 body, skin>=0.45 and edge<0.11 and flat<0.18 face, t in ('dvd_right','dvd_center') and skin>=0.6 and band<0.12 cut, flat>0.34 or lr<0.78 or lr>1.35 side_band from f),
p as (select *, least(70, case when identity then 14 else 0 end + case when dense then 24 else 0 end + case when jacket then 16 else 0 end + case when tb>=1.25 then 6 else 0 end + case when seam>=120 then 8 when seam>=90 then 4 else 0 end
   + case when ensemble and t='dvd_full' and dense then 12 else 0 end + case when t='dvd_full' and side_band and dense then 8 else 0 end) ex,
  case when cut then 24 else 0 end + case when t='dvd_right' and ensemble and skin>=0.55 and tb<0.8 then 12 else 0 end + case when t='dvd_center' and skin>=0.68 then 10 else 0 end pc, case when body then 30 else 0 end + case when skin>=0.72 then 12 else 0 end bp,
  case when face then 18 else 0 end fo, case when plain then 28 else 0 end + case when t='sample' and not dense and not jacket then 24 else 0 end + case when t='sample' and face then 10 else 0 end sp, case when jacket then 24 else 0 end jf,
  case when dense then 28 else 0 end + case when band>=0.18 then 8 else 0 end + case when edge>=0.2 then 8 else 0 end + case when seam>=150 then 8 else 0 end inf, greatest(0, floor(24-abs(ratio-0.7)*24+0.5)) fit, case when se>=500 then 10 when se>=360 then 5 else 0 end res from g),
q as (select *, case when t='sample' then floor(inf*0.5+0.5) else 0 end ic, case when t='sample' then floor(jf*0.5+0.5) else 0 end jc, case when t in ('dvd_full','vertical_package') then greatest(0,inf-16) else 0 end fc, t='sample' and (se<360 or area<200000) low from p),
s as (select *, cast(case when low then -999 else ex+jf+inf+fit+res + case t when 'vertical_package' then 6 when 'sample' then 2 when 'dvd_right' then 3 when 'dvd_center' then 1 when 'dvd_full' then -4 else 0 end - pc-bp-fo-sp-ic-jc-fc - case when t='sample' then 20 else 0 end end as int) score from q),
sr as (select *, not low and (score<58 or bp>=30 or sp>=40 or (t='sample' and ex<32 and jf<24)) review, case when low then 'low_resolution_for_card' else concat_ws('|', case when ex>=40 then 'strong_explanation_power' end, case when inf>=28 then 'information_dense' end, case when jf>=24 then 'jacket_like' end, case when pc>0 then 'person_or_text_cut_risk' end,
  case when bp>0 then 'body_part_risk' end, case when fo>0 then 'face_only_risk' end, case when sp>0 then 'plain_scene_risk' end, case when t='dvd_center' and side_band then 'center_crop_rescues_side_band' end, case when t='dvd_full' and ensemble and dense then 'dvd_full_preserves_context' end,
  case when ic>0 then 'sample_information_signal_discounted' end, case when jc>0 then 'sample_jacket_signal_discounted' end, case when fc>0 then 'full_information_saturation_discounted' end) end reasons from s),
r as (select *, low or review or body or face or plain or cut or bp>0 or fo>0 or sp>=40 or regexp_matches(reasons,'body_part|face_only|plain_scene|person_or_text_cut|low_resolution') risk, body or face or plain or bp>0 or fo>0 or sp>=40 or regexp_matches(reasons,'body_part|face_only|plain_scene|person_or_text_cut') risk2,
  row_number() over (partition by code order by score desc, candidate_id) rn from sr),
cls0 as (select code, max(case when rn=1 then candidate_id end) best_id, max(case when rn=1 then t end) best_type, max(case when rn=1 then score end) best_score, bool_or(rn=1 and risk) best_risk, max(case when rn=2 then score end) runner_score,
  max(case when t='dvd_right' then score end) right_score, bool_or(t='dvd_right' and (cut or body)) rbad, bool_or(t='dvd_full' and side_band) fside, bool_or(t='sample' and not low) has_sample from r group by 1),
cls1 as (select *, best_type<>'dvd_center' or fside or rbad or right_score<58 center_eligible, case when best_type='dvd_full' then best_score-right_score end frd from cls0),
cls2 as (select *, concat_ws('|', case when best_risk then 'CANDIDATE_RISK' end, case when best_score<78 then 'BELOW_AUTO_SCORE' end) hard, concat_ws('|', case when best_type='sample' then 'SAMPLE_REQUIRES_REVIEW' end, case when best_type='dvd_center' then 'CENTER_REQUIRES_REVIEW' end,
  case when best_type='dvd_right' and has_sample then 'RIGHT_WITH_SAMPLE_CANDIDATES_REQUIRES_REVIEW' end, case when best_score-runner_score<12 then 'RUNNER_UP_MARGIN_TOO_SMALL' end, case when frd<32 then 'FULL_RIGHT_MARGIN_TOO_SMALL' end, case when not center_eligible then 'CENTER_NOT_ELIGIBLE' end) soft from cls1),
cls as (select *, case when hard<>'' then 'C' when soft<>'' then 'B' else 'A' end classification, case when hard<>'' then hard else soft end reason_codes from cls2)
"""


def _scored(t: Tables):
    return images.score_candidates(features(t))


@query("J1_score_candidates", f"with {_SCORED} select candidate_id, score, review, low excluded, reasons from sr", "works")
def score(t: Tables):
    return _scored(t).select("candidate_id", "score", "review", "excluded", F.array_join("reasons", "|").alias("reasons"))


@query("J2_classify", f"with {_SCORED} select code, best_id, best_type, best_score, best_score-runner_score score_delta, classification, reason_codes from cls", "works")
def classify(t: Tables):
    return images.classify_works(_scored(t)).select("code", "best_id", "best_type", "best_score", "score_delta", "classification", F.array_join("reason_codes", "|").alias("reason_codes"))


def _current(t: Tables):
    i = F.col("id")
    kind = F.when(i % 3 == 0, "dvd_right").when(i % 3 == 1, "dvd_full").otherwise("sample")
    url = F.concat(F.lit("https://pics.example/"), i.cast("string"), F.lit("/"), F.when(i % 3 == 0, "1").when(i % 3 == 1, "0").otherwise("3"), F.lit(".jpg"))
    return t.works_by_code("id", "product_code").select(F.col("product_code").alias("code"), url.alias("current_url"), kind.alias("current_type"))


_DECIDED = _SCORED + """,
dec0 as (select w.id, w.product_code code, 'https://pics.example/' || cast(w.id as varchar) || '/' || case w.id%3 when 0 then '1' when 1 then '0' else '3' end || '.jpg' current_url, cls.*,
  (select c.score from sr c where c.id=w.id and c.k = case w.id%3 when 0 then 1 when 1 then 0 else 3 end) current_score from works w join cls on cls.code=w.product_code),
dec as (select *, case when classification<>'A' then 'needs_review' else best_type end next_type, case when classification<>'A' then current_url when best_type='dvd_right' then '/card-thumbnails/' || code || '-auto-right.jpg' when best_type='dvd_center' then '/card-thumbnails/' || code || '-auto-center.jpg'
  else 'https://pics.example/' || cast(id as varchar) || '/' || cast(best_id%10 as varchar) || '.jpg' end next_url from dec0)"""


@query("J3_decide_image", f"with {_DECIDED} select code, next_type, next_url, classification='A' and next_url<>current_url changed, case when classification='A' and next_url<>current_url then best_score-current_score end gain, current_score from dec", "works")
def decide(t: Tables):
    return images.decide_images(_current(t), _scored(t)).select("code", "next_type", "next_url", "changed", "gain", "current_score")


@query("E19_candidate_summary", f"with {_DECIDED} select 'next_type' field, next_type as value, count(*) n from dec group by 2 union all select 'classification', classification, count(*) from dec group by 2 union all select 'confidence', case classification when 'A' then 'high' when 'B' then 'medium' else 'low' end, count(*) from dec group by 2", "works")
def candidate_summary(t: Tables):
    return images.candidate_summary(images.decide_images(_current(t), _scored(t)), ["next_type", "classification", "confidence"])


@query("J6_candidate_records", f"with {_DECIDED} select code, case best_type when 'sample' then 'SAMPLE' when 'dvd_right' then 'PACKAGE_RIGHT' when 'dvd_center' then 'PACKAGE_CENTER' when 'dvd_full' then 'PACKAGE_FULL' end candidate_mode, classification, cast(null as varchar) contract from dec", "works")
def records(t: Tables):
    return images.candidate_records(_current(t), _scored(t)).select("code", "candidate_mode", "classification", "contract")


@query("J11_review_sheet_class", f"""with {_DECIDED},
k as (select code, max(case when t='dvd_full' then score end) fs, max(case when t='dvd_right' then score end) rs, max(case when t='dvd_center' then score end) cs, bool_or(t='dvd_center' and risk2) cr, bool_or(t='dvd_center' and reasons like '%rescues%') resc, bool_or(t='dvd_right' and (cut or body)) rb, bool_or(rn=1 and risk2) top_risk,
  max(case when rn=1 then score end) s1, max(case when rn=2 then score end) s2 from r group by 1),
nr as (select code, t, arg_max(risk2, score*100-candidate_id%10) nrisk from r group by 1,2),
d2 as (select dec.*, best_score-current_score gain_, case when classification='A' and next_url<>current_url then best_score-current_score end gain from dec)
select d2.code, case when coalesce(nrisk, top_risk) or best_score<78 or coalesce(gain, best_score-coalesce(current_score,0))<24 then 'C'
  when next_type='dvd_center' and not coalesce(not cr and cs>=115 and coalesce(gain, best_score-coalesce(current_score,0))>=50 and cs-rs>=18 and cs-fs>=18 and (resc or rb or rs<45), false) then 'B' when s1-s2<12 then 'B' when next_type='dvd_full' and fs-rs<24 then 'B' else 'A' end sheet_class
from d2 join k using (code) left join nr on nr.code=d2.code and nr.t=d2.next_type""", "works")
def sheet_class(t: Tables):
    scored = _scored(t)
    decided = images.decide_images(_current(t), scored).select("code", "next_type", F.col("best_score").alias("next_score"), "current_score", "gain")
    return images.review_sheet_class(decided, scored).select("code", "sheet_class")


@query("J11_pick_candidates", f"with {_SCORED} select candidate_id from (select *, row_number() over (partition by code, t order by score desc, candidate_id) pick from sr where not low) where pick=1", "works")
def pick(t: Tables):
    return images.pick_candidates(_scored(t)).select("candidate_id")


# -- labelled ranking ---------------------------------------------------------------------------
def _labelled(t: Tables):
    modes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mode"), F.lit(s).alias("source_id")) for k, (m, s) in enumerate((("PACKAGE_RIGHT", "dvd:right"), ("PACKAGE_FULL", "dvd:full"), ("PACKAGE_CENTER", "dvd:center"), ("SAMPLE", "sample:1"), ("SAMPLE", "sample:2")))])
    rows = t.works_by_code("id", "product_code").select("id", F.col("product_code").alias("code"), F.inline(modes))
    i, k = F.col("id"), F.col("k")
    value = lambda n: (i * (n + 3) + k * (n + 7)) % 25 - 2
    flags = {c: (i + k * n) % (7 + n) == 0 for n, (c, _, _) in enumerate(images.PENALTIES)}
    out = rows.withColumns({c: value(n) for n, c in enumerate(images.SCORES)}).withColumns(flags)
    return out.withColumns({"whitespace": F.when((i + k) % 9 == 0, 12).otherwise(0), "context_loss": F.when((i + k) % 11 == 0, 50).otherwise(0), "sides_invalid": i % 2 == 0, "right_loss": i % 3 == 0, "source_url": F.lit("u"), "source_hash": F.lit("h")})


def _labels(t: Tables):
    c = _labelled(t).select(*images.IDENTITY, "id", "k")
    pos = c.filter("id % 7 = 0 and k = 2").withColumn("label", F.lit("POSITIVE"))
    return pos.unionByName(c.filter("id % 5 = 0 and k in (0, 3)").withColumn("label", F.lit("NEGATIVE"))).drop("id", "k")


_VAL = " + ".join(f"least(20, greatest(0, (id*{n + 3}+k*{n + 7})%25 - 2))" for n in range(8))
_PEN = " + ".join(f"case when (id+k*{n})%{7 + n}=0 then {p} else 0 end" for n, (_, p, _) in enumerate(images.PENALTIES))
_UNC = " or ".join(f"(id+k*{n})%{7 + n}=0" for n in (0, 1, 2, 3))
_LABELLED = f"""
l0 as (select id, product_code code, unnest([{{'k':0,'m':'PACKAGE_RIGHT','s':'dvd:right'}},{{'k':1,'m':'PACKAGE_FULL','s':'dvd:full'}},{{'k':2,'m':'PACKAGE_CENTER','s':'dvd:center'}},{{'k':3,'m':'SAMPLE','s':'sample:1'}},{{'k':4,'m':'SAMPLE','s':'sample:2'}}]) x from works),
l1 as (select id, code, x.k k, x.m m, x.s s from l0),
l as (select *, ({_VAL} - ({_PEN} + case when (id+k)%9=0 then 12 else 0 end + case when (id+k)%11=0 then 40 else 0 end + case when m='PACKAGE_CENTER' and id%2<>0 then 35 else 0 end))::double score, {_UNC} or (id+k)%11=0 unclear, id%5=0 and k in (0,3) neg, id%7=0 and k=2 pos from l1),
lv as (select *, row_number() over (partition by code, m='SAMPLE' order by score desc, s) rs, row_number() over (partition by code order by score desc, s) ra from l where not neg),
w as (select code, any_value(id) id, max(case when m='SAMPLE' and rs=1 then s end) s1, max(case when m='SAMPLE' and rs=1 then score end) s1s, bool_or(m='SAMPLE' and rs=1 and unclear) s1u, max(case when m='SAMPLE' and rs=2 then score end) s2s,
  max(case when m='PACKAGE_RIGHT' then score end) r, max(case when m='PACKAGE_FULL' then score end) f, max(case when m='PACKAGE_CENTER' and id%2=0 then score end) c, max(case when ra=1 then s end) a, max(case when ra=1 then score end) as_, max(case when ra=2 then score end) bs from lv group by 1),
w1 as (select *, case when r is not null and id%3<>0 then 'dvd:right' when f is not null then 'dvd:full' when r is not null then 'dvd:right' when c is not null then 'dvd:center' end pk, case when r is not null and id%3<>0 then r when f is not null then f when r is not null then r else c end ps from w),
w2 as (select *, s1 is not null and coalesce(s1s-ps, 1e9)>=12 and coalesce(s1s-s2s, 1e9)>=8 and not s1u clear from w1),
w3 as (select w2.*, id%7=0 human, case when id%7=0 then 'dvd:center' when clear then s1 else coalesce(pk, s1) end ch, case when id%7=0 then (select score from l where l.code=w2.code and k=2) when clear then s1s else coalesce(ps, s1s) end chs from w2),
w4 as (select *, ch is null or ch='dvd:center' or (s1 is not null and pk is not null and abs(s1s-ps)<12) or (s1 is not null and s2s is not null and s1s-s2s<8) unsure from w3)"""


@query("J4_rank_labelled", f"""with {_LABELLED} select code, case when human then 'CURRENT_OK' when unsure then 'NEEDS_USER_REVIEW' when ch like 'sample%' then 'HIGH_CONFIDENCE_SAMPLE' when ch='dvd:full' then 'PACKAGE_FULL_PREFERRED' else 'PACKAGE_RIGHT_PREFERRED' end classification,
  ch source_id, case when human then 'human' when unsure then 'low' else 'high' end confidence, round(chs - case when a=ch then bs else as_ end, 2) score_delta from w4""", "works")
def rank_labelled(t: Tables):
    return images.rank_labelled(_labelled(t), _labels(t)).select("code", "classification", "source_id", "confidence", "score_delta")


@query("J5_dedupe_samples", """select product_code code, cast(2*n as int) source_index, 'https://pics.example/' || cast(id as varchar) || '/ajp-' || cast(n as varchar) || '.jpg' url from works, range(1,4) r(n) union all select product_code, 7, 'https://pics.example/' || cast(id as varchar) || '/b-9.jpg' from works""", "works")
def dedupe_samples(t: Tables):
    base = F.concat(F.lit("https://pics.example/"), F.col("id").cast("string"))
    pairs = [F.concat(base, F.lit(f"/{name}{n}.jpg")) for n in (1, 2, 3) for name in ("a-", "ajp-")]
    return images.dedupe_samples(t.works_by_code("id", "product_code").select(F.col("product_code").alias("code"), F.array(*pairs, F.concat(base, F.lit("/b-9.jpg"))).alias("sample_images")))


@query("J7_vector_distance", """with f as (select label, arg_min(embedding, vec_id) v, min(vec_id) first_id from embeddings group by 1)
select vec_id image_id, first_id, round(list_sum(list_transform(range(1, len(embedding)+1), lambda i: abs(embedding[i]::double - v[i]::double)))/len(embedding), 6) distance from embeddings join f using (label)""")
def vector_distance(t: Tables):
    return images.distance_to_first(t.image_vectors()).select("image_id", "first_id", F.round("distance", 6).alias("distance"))


@query("J8_resolve_image", """select id, case when id%50=0 then 'INVALID_CODE' when id%7=0 or id%3=0 or id%2=0 then 'RESOLVED' else 'SOURCE_MISSING' end outcome, case when id%50=0 then null when id%7=0 then 'human_decision' when id%3=0 then 'gold_label' when id%2=0 then 'database_url' end decision_source from works""", "works")
def resolve_image(t: Tables):
    i = F.col("id")
    w = t.works("id", "product_code").select("id", F.when(i % 50 == 0, " ").otherwise(F.col("product_code")).alias("code"))
    d = lambda n, s: t.works("id", "product_code").filter(f"id % {n} = 0").select(F.lower("product_code").alias("code"), F.lit(s).alias("source"), F.lit(s + ".jpg").alias("url"))
    decisions = d(7, "human_decision").unionByName(d(3, "gold_label")).unionByName(d(2, "database_url")).unionByName(d(5, "external_fallback").withColumn("url", F.lit(" ")))
    return images.resolve_images(w, decisions).select("id", "outcome", "decision_source")


def _decisions(t: Tables):
    w, i = t.works("id", "product_code"), F.col("id")
    d = lambda n, s, mode: w.filter(f"id % {n} = 0").select(F.col("product_code").alias("code"), F.lit(s).alias("registry"), F.lit(mode).alias("mode"), i.cast("string").alias("source_id"), F.lit("k").alias("kind"), F.lit("o").alias("output_url"))
    return d(11, "fixed_canonical", "SAMPLE").unionByName(d(3, "review_3", "PACKAGE_FULL")).unionByName(d(2, "review_1", "SAMPLE")).unionByName(d(5, "generated_gold", "SAMPLE"))


@query("H4_merge_registry", """select product_code code, case when id%11=0 then 'fixed_canonical' when id%3=0 then 'review_3' when id%2=0 then 'review_1' else 'generated_gold' end registry from works where id%11=0 or id%3=0 or id%2=0 or id%5=0""", "works")
def merge_registry(t: Tables):
    return images.merge_registry(_decisions(t))[0].select("code", "registry")


@query("H4_registry_conflicts", """select product_code code, 'fixed_canonical' kept, 'review_3' ignored from works where id%11=0 and id%3=0 union all select product_code, 'review_3', 'generated_gold' from works where id%11<>0 and id%3=0 and id%5=0""", "works")
def registry_conflicts(t: Tables):
    return images.merge_registry(_decisions(t))[1].select("code", "kept", "ignored")


@query("H5_effective_labels", "select product_code code, case when id%3=0 then 'production' else 'extra' end origin from works where id%3=0 or id%2=0", "works")
def effective_labels(t: Tables):
    w = t.works("id", "product_code")
    label = lambda n, s: w.filter(f"id % {n} = 0").select(F.col("product_code").alias("code"), F.lit(s).alias("origin"))
    return images.effective_labels(label(3, "production"), label(2, "extra"))


@query("J9_build_registry", """select 'adopted_fixed' what, count(*) n from works where id%11=0 union all select 'adopted_human', count(*) from works where id%11<>0 and id%3=0 union all select 'adopted_gold', count(*) from works where id%11<>0 and id%3<>0 and id%2=0
  union all select 'collisions', count(*) from works where id%21=0 union all select 'conflicts', count(*) from works where id%11=0 and id%2=0 union all select 'rejected', cast(1 as bigint)""", "works")
def build_registry(t: Tables):
    w = t.works("id", "product_code")
    row = lambda df, mode: df.select(F.col("product_code").alias("code"), F.lit(mode).alias("mode"), F.lit("s").alias("source_id"))
    human = row(w.filter("id % 3 = 0"), "SAMPLE").unionByName(row(w.filter("id % 21 = 0").withColumn("product_code", F.lower("product_code")), "SAMPLE"))
    human = human.unionByName(row(w.filter("id = 0").withColumn("product_code", F.lit("1namh500006")), "SAMPLE"))
    out = images.build_registry(row(w.filter("id % 2 = 0"), "PACKAGE_FULL"), human, row(w.filter("id % 11 = 0"), "SAMPLE"))
    adopted = out["counters"].select(F.concat(F.lit("adopted_"), "registry").alias("what"), F.col("adopted").alias("n"))
    for part in ("collisions", "conflicts", "rejected"):
        adopted = adopted.unionByName(out[part].agg(F.count("*").alias("n")).select(F.lit(part).alias("what"), "n"))
    return adopted


def _funnel(t: Tables):
    i = F.col("id")
    return t.works_by_code("id", "product_code").select(
        i, F.col("product_code").alias("code"), F.when(i % 2 == 0, "SAMPLE_POTENTIALLY_COMPETITIVE").otherwise("FINAL_FULL").alias("stage1"), F.when(i % 4 == 0, "SAMPLE_STILL_COMPETITIVE").alias("stage2"), F.lit(None).cast("string").alias("stage3"),
        F.when(i % 2 == 1, "APPROVE_FULL").alias("final_decision"), F.when(i % 2 == 1, "PACKAGE_FULL").alias("final_mode"), F.when(i % 2 == 1, "dvd:full").alias("final_source_id"), F.lit(None).cast("string").alias("final_url"), F.when(i % 2 == 1, 1).alias("decision_stage"))


@query("J10_staged_codes", "select product_code code from works where id%4=0", "works")
def staged_codes(t: Tables):
    return images.staged_review_codes(_funnel(t), 3)


@query("J10_apply_stage", """select id, case when id%2=1 then 'APPROVE_FULL' when id%6=0 then 'APPROVE_RIGHT' when id%6=2 and id%5<>0 then 'APPROVE_SAMPLE' end final_decision,
  case when id%2=1 and id%3=0 then 'FINAL_DECISION_ALREADY_RECORDED' when id%6=2 and id%5=0 then 'SAMPLE_SOURCE_ID_REQUIRED' end issue from works""", "works")
def apply_stage(t: Tables):
    i = F.col("id")
    d = t.works_by_code("id", "product_code").filter("id % 3 <> 1").select(
        F.col("product_code").alias("code"), F.when(i % 3 == 0, "FINAL_RIGHT").when(i % 2 == 0, "FINAL_SAMPLE").otherwise("FINAL_FULL").alias("classification"), F.when(i % 5 == 0, "x").otherwise("sample:1").alias("source_id"))
    return images.apply_stage_decisions(_funnel(t), d, features(t), 2).select("id", "final_decision", "issue")


@query("C14_image_pending", "select id from works where is_published and id%4<>0 and id%3<>0 and id%7<>0 and id%5<>0", "works")
def image_pending(t: Tables):
    i = F.col("id")
    w = t.works("id", "product_code", "is_published").select(
        "id", "product_code", "is_published", F.when(i % 4 != 0, "feed").alias("source_name"), F.lit("x").alias("external_product_id"), F.when(i % 3 != 0, "u").alias("card_image_url"), F.lit(None).cast("string").alias("image_url"))
    decided = lambda n: t.works("id", "product_code").filter(f"id % {n} = 0").select(F.col("product_code").alias("code"))
    return images.image_pending(w, decided(7), decided(5), source_name="feed").select("id")


def _evaluated(t: Tables):
    i = F.col("id")
    mode = lambda c: F.element_at(F.array(*map(F.lit, images.MODES)), (c % 4 + 1).cast("int"))
    w = t.works("id", "product_code").withColumn("code", F.col("product_code"))
    ev = w.filter("id % 9 <> 0").select("code", mode(i).alias("mode1"), (i % 5).cast("string").alias("source1"), mode(F.floor(i / 2)).alias("mode2"), (i % 3).cast("string").alias("source2"))
    return ev, w.select("code", mode(F.floor(i / 3)).alias("truth_mode"), F.when(i % 2 == 0, (i % 7).cast("string")).alias("truth_source"))


_MODE = "['SAMPLE','PACKAGE_RIGHT','PACKAGE_CENTER','PACKAGE_FULL']"
_EVAL = f"""e as (select id, {_MODE}[cast(id//3%4+1 as int)] tm, case when id%2=0 then id%7 end ts, id%9<>0 seen, {_MODE}[cast(id%4+1 as int)] m1, id%5 s1, {_MODE}[cast(id//2%4+1 as int)] m2, id%3 s2 from works)"""


@query("E18_calibration", f"""with {_EVAL} select tm truth_mode, count(*) filter (where seen) n, count(*) filter (where seen and m1=tm) top1_mode, count(*) filter (where seen and m1=tm and (ts is null or s1=ts)) top1_source, count(*) filter (where seen and (m1=tm or m2=tm)) top2_mode,
  count(*) filter (where seen and ((m1=tm and (ts is null or s1=ts)) or (m2=tm and (ts is null or s2=ts)))) top2_source, count(*) filter (where seen and m1<>tm) wrong, count(*) filter (where not seen) missing from e group by 1""", "works")
def calibration(t: Tables):
    return images.calibration(*_evaluated(t))[0]


@query("E18_confusion", f"with {_EVAL} select tm truth_mode, m1 predicted, count(*) n from e where seen and m1<>tm group by 1,2", "works")
def confusion(t: Tables):
    return images.calibration(*_evaluated(t))[1]


@query("E22_gold_acceptance", f"with {_EVAL} select product_code code, case when not seen then 'missing_result' else 'type_or_source_mismatch' end reason from e join works using (id) where not seen or m1<>tm or s1 is distinct from ts", "works")
def gold_acceptance(t: Tables):
    ev, labels = _evaluated(t)
    results = ev.select("code", F.lit(None).cast("string").alias("blocked_code"), F.col("mode1").alias("type"), F.col("source1").alias("source"))
    return images.gold_acceptance(results, labels.select("code", F.col("truth_mode").alias("expected_type"), F.col("truth_source").alias("expected_source"))).select("code", "reason")


@query("E23_tuning_report", f"""with {_EVAL} select m1 as mode, count(*) sample_size, count(*) filter (where id%2=0) before_correct, count(*) filter (where id%3<>0) after_correct, count(*) filter (where id%3=1) holdout_correct, count(*) filter (where id%3=2) holdout_acceptable, count(*) filter (where id%3=0) holdout_wrong,
  count(*) filter (where id%5=0) class_a, round(count(*) filter (where id%5=0 and id%3=1)::double/nullif(count(*) filter (where id%5=0),0),6) class_a_precision from e group by 1""", "works")
def tuning_report(t: Tables):
    i = F.col("id")
    mode = F.element_at(F.array(*map(F.lit, images.MODES)), (i % 4 + 1).cast("int"))
    rows = t.works("id").select(
        mode.alias("before_mode"), mode.alias("candidate_mode"), F.lit("CURRENT").alias("review_group"), F.when(i % 2 == 0, "APPROVE_CANDIDATE").otherwise("REJECT").alias("before_result"), F.when(i % 3 == 0, "WRONG").otherwise("OK").alias("after_result"),
        F.when(i % 3 == 1, "CORRECT").when(i % 3 == 2, "ACCEPTABLE").otherwise("WRONG").alias("visual_result"), F.when(i % 5 == 0, "A").otherwise("B").alias("classification"))
    return images.tuning_report(rows, rows).withColumn("class_a_precision", F.round("class_a_precision", 6))


# -- samples --------------------------------------------------------------------------------------
def _inventory(t: Tables):
    i = F.col("id")
    mode = F.element_at(F.array(*map(F.lit, images.MODES)), (i % 4 + 1).cast("int"))
    return t.works("id", "product_code", "maker", "series").select(
        F.col("product_code").alias("code"), mode.alias("mode"), F.when(i % 3 == 0, "high").otherwise("low").alias("confidence"), (i % 100).alias("score"), F.lit("2024").alias("created_at"), "maker", "series", F.when(i % 5 == 0, "A").otherwise("B").alias("classification"))


TARGETS = {"SAMPLE": 10, "PACKAGE_RIGHT": 10, "PACKAGE_CENTER": 5, "PACKAGE_FULL": 5}


def _sample_sql(order: str, share: float, where: str = "true") -> str:
    """A fold over the rows, three passes a mode: fresh groups, then rows after the last of them, then any unused."""
    modes = ", ".join(f"({k}, '{m}', {n}, {math.ceil(n * share)})" for k, (m, n) in enumerate(TARGETS.items()))
    names = ", ".join(f"'{m}'" for m in images.MODES)
    now = lambda c: f"(case when x.k = a.k then a.{c} else 0 end)"
    take = f"""not list_contains(a.codes, x.code) and case x.pass when 1 then {now('held')} < x.spread and not list_contains(a.grps, x.grp)
      when 2 then {now('held')} < x.target and {now('fresh')} > 0 and {now('fresh')} = x.spread and x.place > {now('latest')} else {now('held')} < x.target end"""
    kept = f"""{{'k': x.k, 'pass': x.pass, 'place': x.place, 'target': x.target, 'spread': x.spread, 'code': x.code, 'grp': x.grp, 'held': {now('held')} + t::bigint, 'latest': case when t and x.pass = 1 then x.place else {now('latest')} end,
      'fresh': {now('fresh')} + (t and x.pass = 1)::bigint, 'codes': case when t then list_append(a.codes, x.code) else a.codes end, 'grps': case when t then list_append(a.grps, x.grp) else a.grps end}}"""
    row = "{'k': k::bigint, 'pass': pass::bigint, 'place': place, 'target': target::bigint, 'spread': spread::bigint, 'code': code, 'grp': grp, 'held': 0::bigint, 'latest': 0::bigint, 'fresh': 0::bigint, 'codes': []::varchar[], 'grps': []::varchar[]}"
    start = "{'k': -1::bigint, 'pass': 0::bigint, 'place': 0::bigint, 'target': 0::bigint, 'spread': 0::bigint, 'code': '', 'grp': '', 'held': 0::bigint, 'latest': 0::bigint, 'fresh': 0::bigint, 'codes': []::varchar[], 'grps': []::varchar[]}"
    return f"""with i as (select product_code code, ([{names}])[id % 4 + 1] as mode, case when id % 3 = 0 then 0 else 2 end confidence, id % 100 score, maker || chr(0) || series grp, case when id % 5 = 0 then 'A' else 'B' end class from works),
m(k, mode, target, spread) as (values {modes}),
r as (select * from (select m.k, m.target, m.spread, i.code, i.grp, row_number() over (partition by m.k order by {order}) place from i join m using (mode) where {where}), range(1, 4) p(pass)),
g as (select list({row} order by k, pass, place) l from r),
p as (select unnest(list_reduce(l, lambda a, x: list_transform([{take}], lambda t: {kept})[1], {start}).codes) code from g)
select code, mode from p join i using (code)"""


@query("G9_stratified_sample", _sample_sql("confidence, case when score = 0 then -999 else score end desc, code", 0.5), "works")
def stratified(t: Tables):
    return sampling.stratified_sample(_inventory(t), TARGETS).select("code", "mode")


@query("G10_holdout_sample", _sample_sql("case when i.mode = 'PACKAGE_FULL' and class <> 'A' then 1 else 0 end, sha256(code)", 1.0, "code not like 'RED%'"), "works")
def holdout(t: Tables):
    return sampling.holdout_sample(_inventory(t), TARGETS, t.works("product_code").withColumnRenamed("product_code", "code").filter("code like 'RED%'")).select("code", "mode")


@query("G11_even_indices", """select id, case when id%20=0 then '' when id%20=1 then '1' else array_to_string(list_sort(list_distinct(list_transform(range(0, least(id%20,8)), lambda i: cast(floor(i*(id%20-1)/(least(id%20,8)-1)+0.5) as int)+1))),'|') end picks from works""", "works")
def even(t: Tables):
    return t.works("id").select("id", F.array_join(sampling.even_indices((F.col("id") % 20).cast("int")), "|").alias("picks"))


@query("G11_spread_indices", """select id, case id%4 when 0 then '' when 1 then '' when 2 then '2' else '2|3' end picks from works""", "works")
def spread(t: Tables):
    n = (F.col("id") % 4).cast("int")
    return t.works("id").select("id", F.array_join(sampling.spread_indices(n, F.array(F.lit(1)), 8), "|").alias("picks"))
