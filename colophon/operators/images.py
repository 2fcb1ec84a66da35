"""Ranking of image candidates from a table of measured features.

Candidates are few per work by nature of a catalog page; even so, every per-work choice is a
top-k window or an aggregate, so no step needs a work's full candidate list at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.codes import blank_to_null, canonical_code
from colophon.operators.joins import by_key
from colophon.operators.ranking import latest_per_key, top_within

# fixed values: thresholds and weights of the scorer
MIN_SHORT_EDGE, MIN_AREA = 360, 200_000
IDEAL_RATIO = 0.7
AUTO_THRESHOLD, AUTO_SCORE, REVIEW_GAP, FULL_RIGHT_GAP = 58, 78, 12, 32
SAMPLE_OFFSET, SAMPLE_DISCOUNT, FULL_ALLOWANCE = -20, 0.5, 16
TYPE_HINT = {"vertical_package": 6, "sample": 2, "dvd_right": 3, "dvd_center": 1, "dvd_full": -4}
RISK_REASONS = "body_part|face_only|plain_scene|person_or_text_cut|low_resolution"
MODE_OF_TYPE = {"sample": "SAMPLE", "dvd_right": "PACKAGE_RIGHT", "dvd_center": "PACKAGE_CENTER", "dvd_full": "PACKAGE_FULL"}
MODES = tuple(MODE_OF_TYPE.values())
SOURCE_ID_PATTERNS = {"SAMPLE": "^sample:[1-9][0-9]*$", "PACKAGE_RIGHT": "^dvd:right$", "PACKAGE_CENTER": "^dvd:center$", "PACKAGE_FULL": "^dvd:full$"}
SHA256_PATTERN = "^[a-f0-9]{64}$"
FINAL_DECISIONS = {  # classification: (decision, mode, candidate type, source id)
    "FINAL_RIGHT": ("APPROVE_RIGHT", "PACKAGE_RIGHT", "dvd_right", "dvd:right"),
    "FINAL_CENTER": ("APPROVE_CENTER", "PACKAGE_CENTER", "dvd_center", "dvd:center"),
    "FINAL_FULL": ("APPROVE_FULL", "PACKAGE_FULL", "dvd_full", "dvd:full"),
    "FINAL_KEEP": ("KEEP_CURRENT", "KEEP_CURRENT", None, None),
    "FINAL_SAMPLE": ("APPROVE_SAMPLE", "SAMPLE", "sample", None),
    "REVIEW_UNCERTAIN": ("REVIEW_UNCERTAIN", None, None, None),
    "REJECT_ALL": ("REJECT_ALL", None, None, None),
}
IMAGE_PRIORITY = ("production_canonical", "human_decision", "gold_label", "local_generated_asset", "database_url", "external_fallback")
REGISTRY_PRIORITY = ("fixed_canonical", "review_3", "review_2", "review_1", "generated_human", "generated_gold", "review_0")
SUPERSEDED = {"review_3": ("review_2", "review_1"), "review_2": ("review_1",)}


def _points(*pairs: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in pairs])


def _round(c: Column) -> Column:
    return F.floor(c + 0.5)


def score_candidates(features: DataFrame) -> DataFrame:
    """Score, review flag, reasons and risk flags of every candidate.

    ``features(code, type, ratio, short_edge, area, edge_density, top_bottom_edge_density,
    seam_strength, skin_ratio, flat_extreme_ratio, left_right_lift, top_bottom_lift, identity,
    ensemble)``.  Samples below the size limit score -999 and are excluded.
    """
    edge, band, seam, skin = (F.col(c) for c in ("edge_density", "top_bottom_edge_density", "seam_strength", "skin_ratio"))
    flat, lr, tb, kind = (F.col(c) for c in ("flat_extreme_ratio", "left_right_lift", "top_bottom_lift", "type"))
    flags = {
        "dense": (edge >= 0.15) & (band >= 0.13) & (seam >= 80) & (skin < 0.66),
        "jacket": F.col("ratio").between(0.55, 0.9) & (edge >= 0.1) & (band >= 0.095) & (skin < 0.62) & (flat < 0.42),
        "plain": (edge < 0.095) & (band < 0.09) & (seam < 85),
        "body": (skin >= 0.58) & (band < 0.13) & (seam < 95),
        "face": (skin >= 0.45) & (edge < 0.11) & (flat < 0.18),
        "cut": kind.isin("dvd_right", "dvd_center") & (skin >= 0.6) & (band < 0.12),
        "side_band": (flat > 0.34) | (lr < 0.78) | (lr > 1.35),
    }
    df = features.withColumn("flags", F.struct(*[v.alias(k) for k, v in flags.items()]))
    f = {k: F.col(f"flags.{k}") for k in flags}
    is_sample, is_full = kind == "sample", kind == "dvd_full"
    seam_points = F.when(seam >= 120, 8).when(seam >= 90, 4).otherwise(0)
    explanation = _points(
        (F.col("identity"), 14), (f["dense"], 24), (f["jacket"], 16), (tb >= 1.25, 6), (F.col("ensemble") & is_full & f["dense"], 12), (is_full & f["side_band"] & f["dense"], 8)
    ) + seam_points
    parts = {
        "explanation": F.least(F.lit(70), explanation),
        "person_cut": _points((f["cut"], 24), ((kind == "dvd_right") & F.col("ensemble") & (skin >= 0.55) & (tb < 0.8), 12), ((kind == "dvd_center") & (skin >= 0.68), 10)),
        "body_part": _points((f["body"], 30), (skin >= 0.72, 12)),
        "face_only": _points((f["face"], 18)),
        "scene_photo": _points((f["plain"], 28), (is_sample & ~f["dense"] & ~f["jacket"], 24), (is_sample & f["face"], 10)),
        "jacket_feel": _points((f["jacket"], 24)),
        "information": _points((f["dense"], 28), (band >= 0.18, 8), (edge >= 0.2, 8), (seam >= 150, 8)),
        "card_fit": F.greatest(F.lit(0), _round(24 - F.abs(F.col("ratio") - IDEAL_RATIO) * 24)),
        "resolution": F.when(F.col("short_edge") >= 500, 10).when(F.col("short_edge") >= 360, 5).otherwise(0),
    }
    df = df.withColumn("parts", F.struct(*[v.cast("int").alias(k) for k, v in parts.items()]))
    p = {k: F.col(f"parts.{k}") for k in parts}
    hint = reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), list(TYPE_HINT.items())[1:], F.when(kind == "vertical_package", TYPE_HINT["vertical_package"])).otherwise(0)
    info_cut = F.when(is_sample, _round(p["information"] * SAMPLE_DISCOUNT)).otherwise(0)
    jacket_cut = F.when(is_sample, _round(p["jacket_feel"] * SAMPLE_DISCOUNT)).otherwise(0)
    full_cut = F.when(kind.isin("dvd_full", "vertical_package"), F.greatest(F.lit(0), p["information"] - FULL_ALLOWANCE)).otherwise(0)
    plus = p["explanation"] + p["jacket_feel"] + p["information"] + p["card_fit"] + p["resolution"] + hint
    minus = p["person_cut"] + p["body_part"] + p["face_only"] + p["scene_photo"] + info_cut + jacket_cut + full_cut
    score = plus - minus + F.when(is_sample, SAMPLE_OFFSET).otherwise(0)
    low = is_sample & ((F.col("short_edge") < MIN_SHORT_EDGE) | (F.col("area") < MIN_AREA))
    df = df.withColumn("excluded", low).withColumn("score", F.when(low, -999).otherwise(score).cast("int"))
    review = (F.col("score") < AUTO_THRESHOLD) | (p["body_part"] >= 30) | (p["scene_photo"] >= 40) | (is_sample & (p["explanation"] < 32) & (p["jacket_feel"] < 24))
    reasons = (
        (p["explanation"] >= 40, "strong_explanation_power"), (p["information"] >= 28, "information_dense"), (p["jacket_feel"] >= 24, "jacket_like"),
        (p["person_cut"] > 0, "person_or_text_cut_risk"), (p["body_part"] > 0, "body_part_risk"), (p["face_only"] > 0, "face_only_risk"), (p["scene_photo"] > 0, "plain_scene_risk"),
        ((kind == "dvd_center") & f["side_band"], "center_crop_rescues_side_band"), (is_full & F.col("ensemble") & f["dense"], "dvd_full_preserves_context"),
        (info_cut > 0, "sample_information_signal_discounted"), (jacket_cut > 0, "sample_jacket_signal_discounted"), (full_cut > 0, "full_information_saturation_discounted"),
    )
    listed = F.array_compact(F.array(*[F.when(c, r) for c, r in reasons]))
    return df.withColumn("review", ~low & review).withColumn("reasons", F.when(low, F.array(F.lit("low_resolution_for_card"))).otherwise(listed))


def candidate_risk(low_resolution: bool = True) -> Column:
    pattern = RISK_REASONS if low_resolution else "body_part|face_only|plain_scene|person_or_text_cut"
    f = lambda k: F.col(f"flags.{k}")
    risk = f("body") | f("face") | f("plain") | (F.col("parts.body_part") > 0) | (F.col("parts.face_only") > 0) | (F.col("parts.scene_photo") >= 40)
    risk = risk | F.exists("reasons", lambda r: r.rlike(pattern))
    if low_resolution:
        risk = risk | F.col("excluded") | F.col("review") | f("cut")
    return F.coalesce(risk, F.lit(False))


def classify_works(scored: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Best and second candidate per work with class A, B or C, reasons and gaps.

    ``scored(code, candidate_id, type, score, ...)``; equal scores go by ``candidate_id``.  Columns
    of ``carry`` are those of the best candidate, named ``best_...``.
    """
    rows = scored.withColumn("risk", candidate_risk())
    top = top_within(rows.select("code", "candidate_id", "type", "score", "risk", *carry), ["code"], [("score", "desc"), ("candidate_id", "asc")], 2, "_n")
    pick = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    best = top.groupBy("code").agg(
        pick(1, "candidate_id").alias("best_id"), pick(1, "type").alias("best_type"), pick(1, "score").alias("best_score"), pick(1, "risk").alias("best_risk"),
        pick(2, "candidate_id").alias("runner_id"), pick(2, "type").alias("runner_type"), pick(2, "score").alias("runner_score"), *[pick(1, c).alias(f"best_{c}") for c in carry],
    )
    first = lambda t, c: F.max_by(F.when(F.col("type") == t, F.col(c)), F.when(F.col("type") == t, F.struct("score", -F.col("candidate_id"))))
    facts = rows.groupBy("code").agg(
        first("dvd_right", "score").alias("right_score"), first("dvd_right", "flags").alias("_rf"), first("dvd_full", "flags").alias("_ff"),
        F.max((F.col("type") == "sample") & ~F.col("excluded")).alias("has_sample"), F.count_if("excluded").alias("excluded_candidates"),
        F.max(F.col("type") == "dvd_center").alias("has_center"),
    )
    j = best.join(by_key(facts), "code")
    rescue = F.coalesce(F.col("_ff.side_band"), F.lit(False)) | F.coalesce(F.col("_rf.cut"), F.lit(False)) | F.coalesce(F.col("_rf.body"), F.lit(False)) | F.coalesce(F.col("right_score") < AUTO_THRESHOLD, F.lit(False))
    j = j.withColumns({
        "center_eligible": (F.col("best_type") != "dvd_center") | rescue,
        "score_delta": F.col("best_score") - F.col("runner_score"),
        "full_right_delta": F.when(F.col("best_type") == "dvd_full", F.col("best_score") - F.col("right_score")),
    })
    hard = F.array_compact(F.array(F.when(F.col("best_risk"), "CANDIDATE_RISK"), F.when(F.col("best_score") < AUTO_SCORE, "BELOW_AUTO_SCORE")))
    soft = F.array_compact(F.array(
        F.when(F.col("best_type") == "sample", "SAMPLE_REQUIRES_REVIEW"), F.when(F.col("best_type") == "dvd_center", "CENTER_REQUIRES_REVIEW"),
        F.when((F.col("best_type") == "dvd_right") & F.col("has_sample"), "RIGHT_WITH_SAMPLE_CANDIDATES_REQUIRES_REVIEW"), F.when(F.col("score_delta") < REVIEW_GAP, "RUNNER_UP_MARGIN_TOO_SMALL"),
        F.when(F.col("full_right_delta") < FULL_RIGHT_GAP, "FULL_RIGHT_MARGIN_TOO_SMALL"), F.when(~F.col("center_eligible"), "CENTER_NOT_ELIGIBLE"),
    ))
    j = j.withColumn("reason_codes", F.when(F.size(hard) > 0, hard).otherwise(soft))
    label = F.when(F.size(hard) > 0, "C").when(F.size("reason_codes") > 0, "B").otherwise("A")
    j = j.withColumn("classification", label)
    by = lambda a, b, c: F.when(F.col("classification") == "A", a).when(F.col("classification") == "B", b).otherwise(c)
    return j.withColumns({"confidence": by("high", "medium", "low"), "risk": by("safe", "review", "reject"), "needs_review": F.col("classification") != "A"}).drop("_rf", "_ff", "best_risk")


def decide_images(works: DataFrame, scored: DataFrame) -> DataFrame:
    """Next image of every work: whether it changes, to what, and the gain over the current one.

    ``works(code, current_url, current_type)``; candidates carry ``url``.
    """
    gate = classify_works(scored, ("url", "reasons")).withColumnsRenamed({"best_url": "_best_url", "best_reasons": "_best_reasons"})
    j = works.join(by_key(gate), "code", "left")
    named = scored.select("code", "type", "score", "flags", "url").join(by_key(works), "code")
    hit = F.when(F.col("current_type").isin("dvd_right", "dvd_center"), F.col("type") == F.col("current_type")).otherwise((F.col("url") == F.col("current_url")) | ((F.col("current_type") == "dvd_full") & (F.col("type") == "dvd_full")))
    exact = F.when(F.col("url") == F.col("current_url"), 1).otherwise(0)
    current = named.filter(hit).groupBy("code").agg(F.max_by("score", F.struct(exact, "score")).alias("current_score"), F.max_by("flags", F.struct(exact, "score")).alias("_cf"))
    j = j.join(by_key(current), "code", "left")
    review = F.coalesce(F.col("needs_review"), F.lit(True))
    made = F.when(F.col("best_type") == "dvd_right", F.concat(F.lit("/card-thumbnails/"), "code", F.lit("-auto-right.jpg"))).when(
        F.col("best_type") == "dvd_center", F.concat(F.lit("/card-thumbnails/"), "code", F.lit("-auto-center.jpg"))).otherwise(F.col("_best_url"))
    j = j.withColumns({"needs_review": review, "next_type": F.when(review, "needs_review").otherwise(F.col("best_type")), "next_url": F.when(review, F.col("current_url")).otherwise(made)})
    changed = ~F.col("needs_review") & ~F.col("next_url").eqNullSafe(F.col("current_url"))
    reason = F.when(F.col("needs_review"), F.lower(F.array_join(F.coalesce("reason_codes", F.array(F.lit("NO_CANDIDATE"))), ","))).otherwise(F.coalesce(F.nullif(F.array_join("_best_reasons", ","), F.lit("")), F.lit("highest_total_score")))
    weak = F.coalesce(F.col("_cf.plain") | F.col("_cf.body") | F.col("_cf.face"), F.lit(False))
    return j.withColumns({"changed": changed, "reason": reason, "gain": F.when(changed, F.col("best_score") - F.col("current_score")), "current_weak": weak}).drop("_best_url", "_best_reasons", "_cf")


def candidate_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of each column, ``NONE`` for blank, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(blank_to_null(F.col(c).cast("string")), F.lit("NONE")).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


SCORES = ("visual_quality", "work_information", "identity_and_context", "representativeness", "subject_retention", "subject_scale", "orientation", "composition")
PENALTIES = (  # column, points, reason
    ("primary_subject_lost", 45, "CARD_PRIMARY_SUBJECT_LOST"), ("subject_too_small", 28, "CARD_SUBJECT_TOO_SMALL"), ("partial_composition", 32, "LOCAL_OR_PARTIAL_COMPOSITION"),
    ("orientation_invalid", 45, "INVALID_ORIENTATION"), ("near_duplicate", 18, "DUPLICATE_OR_NEAR_DUPLICATE"), ("generic_scene", 18, "GENERIC_SCENE"),
)
UNCLEAR = ("CARD_PRIMARY_SUBJECT_LOST", "CARD_SUBJECT_TOO_SMALL", "LOCAL_OR_PARTIAL_COMPOSITION", "INVALID_ORIENTATION", "CARD_CONTEXT_LOSS")
IDENTITY = ("code", "mode", "source_id", "source_url", "source_hash")


def score_labelled(candidates: DataFrame) -> DataFrame:
    """Eight bounded scores minus penalties."""
    cap = lambda c, hi: F.least(F.lit(float(hi)), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    plus = reduce(lambda a, b: a + b, [cap(c, 20) for c in SCORES])
    center = (F.col("mode") == "PACKAGE_CENTER") & ~on("sides_invalid")
    minus = _points(*[(on(c), p) for c, p, _ in PENALTIES], (center, 35)) + cap("whitespace", 30) + cap("context_loss", 40)
    reasons = F.array_compact(F.array(
        *[F.when(on(c), r) for c, _, r in PENALTIES], F.when(cap("whitespace", 30) > 0, "EXCESSIVE_WHITESPACE"), F.when(cap("context_loss", 40) > 0, "CARD_CONTEXT_LOSS"), F.when(center, "CENTER_WITHOUT_INVALID_SIDES")
    ))
    return candidates.withColumns({"score": F.round(plus - minus, 2), "score_reasons": reasons})


def rank_labelled(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Selected candidate per work: a human positive wins, negatives are out, a sample must
    clearly beat the package and the next sample, else the package order decides."""
    scored = score_labelled(candidates)
    marks = labels.groupBy(*IDENTITY).agg(F.max(F.col("label") == "NEGATIVE").alias("_neg"), F.max(F.col("label") == "POSITIVE").alias("_pos"))
    j = scored.join(by_key(marks), list(IDENTITY), "left").fillna(False, ["_neg", "_pos"])
    live = j.filter(~F.col("_neg"))
    mode = lambda m: F.col("mode") == m
    sides = F.coalesce(F.col("sides_invalid"), F.lit(False))
    row = F.struct("source_id", "mode", "score", "score_reasons", F.coalesce("right_loss", F.lit(False)).alias("loss"))
    top = top_within(live.withColumn("_sample", mode("SAMPLE")), ["code", "_sample"], [("score", "desc"), ("source_id", "asc")], 2, "_n")
    samples = top.filter("_sample").groupBy("code").agg(F.max(F.when(F.col("_n") == 1, row)).alias("s1"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("s2"))
    # highest score; equal scores go by source id
    best_of = lambda m, extra=F.lit(True): F.min_by(F.when(mode(m) & extra, row), F.when(mode(m) & extra, F.struct((-F.col("score")).alias("s"), "source_id")))
    packs = live.groupBy("code").agg(best_of("PACKAGE_RIGHT").alias("r"), best_of("PACKAGE_FULL").alias("f"), best_of("PACKAGE_CENTER", sides).alias("c"))
    pack = F.when(F.col("r").isNotNull() & ~F.col("r.loss"), F.col("r")).otherwise(F.coalesce("f", "r", "c"))
    two = top_within(live, ["code"], [("score", "desc"), ("source_id", "asc")], 2, "_n").groupBy("code").agg(
        F.max(F.when(F.col("_n") == 1, F.struct("source_id", "mode", "score"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.struct("source_id", "mode", "score"))).alias("b"))
    pos = j.filter("_pos").groupBy("code").agg(F.count("*").alias("_np"), F.max("_neg").alias("_clash"), F.max(row).alias("p"))
    k = candidates.select("code").distinct()
    for part in (packs, samples, two, pos):
        k = k.join(by_key(part), "code", "left")
    k = k.withColumn("pack", pack)
    inf = F.lit(float("inf"))
    versus = F.when(F.col("s1").isNull(), -inf).when(F.col("pack").isNull(), inf).otherwise(F.col("s1.score") - F.col("pack.score"))
    gap = F.coalesce(F.col("s1.score") - F.col("s2"), inf)
    k = k.withColumns({"_versus": versus, "_gap": gap})
    clear = F.col("s1").isNotNull() & (F.col("_versus") >= 12) & (F.col("_gap") >= 8) & ~F.coalesce(F.arrays_overlap("s1.score_reasons", F.array(*map(F.lit, UNCLEAR))), F.lit(False))
    k = k.withColumn("_clear", clear).withColumn("chosen", F.when(F.col("p").isNotNull(), F.col("p")).when(F.col("_clear"), F.col("s1")).otherwise(F.coalesce("pack", "s1")))
    both = F.col("s1").isNotNull() & F.col("pack").isNotNull()
    unsure = F.col("chosen").isNull() | (F.col("chosen.mode") == "PACKAGE_CENTER") | (both & (F.abs("_versus") < 12)) | (F.col("s1").isNotNull() & F.col("s2").isNotNull() & (F.col("_gap") < 8))
    k = k.withColumn("_unsure", F.coalesce(unsure, F.lit(False)))
    is_chosen = (F.col("a.source_id") == F.col("chosen.source_id")) & (F.col("a.mode") == F.col("chosen.mode"))
    runner = F.when(F.coalesce(is_chosen, F.lit(False)), F.col("b")).otherwise(F.col("a"))
    human = F.col("p").isNotNull()
    label = (
        F.when(human, "CURRENT_OK").when(F.col("_unsure"), "NEEDS_USER_REVIEW").when(F.col("chosen.mode") == "SAMPLE", "HIGH_CONFIDENCE_SAMPLE")
        .when(F.col("chosen.mode") == "PACKAGE_FULL", "PACKAGE_FULL_PREFERRED").otherwise("PACKAGE_RIGHT_PREFERRED")
    )
    problem = F.when(F.col("_np") > 1, "MULTIPLE_POSITIVES").when(F.col("_clash"), "POSITIVE_NEGATIVE_CONFLICT")
    return k.select(
        "code", label.alias("classification"), F.col("chosen.source_id").alias("source_id"), F.col("chosen.mode").alias("mode"),
        F.when(human, "human").when(F.col("_unsure"), "low").otherwise("high").alias("confidence"), F.round(F.col("chosen.score") - runner["score"], 2).alias("score_delta"), problem.alias("problem"),
    )


def dedupe_samples(images: DataFrame) -> DataFrame:
    """Pair the small and large rendition of a sample and keep the large one, in list order.

    ``images(code, sample_images)``; result ``code, source_index, url`` (indexes from 1).
    """
    rows = images.select("code", F.posexplode("sample_images").alias("index", "url"))
    path = F.regexp_extract("url", "(?i)^https?://[^/?#]+([^?#]*)", 1)
    large = path.rlike("(?i)jp-[0-9]+[.]jpg$")
    keyed = rows.withColumn("_pair", F.regexp_replace(path, "(?i)jp-([0-9]+)[.]jpg$", "-$1.jpg")).withColumn("_large", large)
    kept = keyed.groupBy("code", "_pair").agg(F.max_by(F.struct("index", "url"), F.struct("_large", "index")).alias("k"))
    return kept.select("code", (F.col("k.index") + 1).alias("source_index"), F.col("k.url").alias("url"))


def candidate_records(works: DataFrame, scored: DataFrame) -> DataFrame:
    """Wide review rows with ``contract``: the first broken rule of a row, or null.

    Candidates carry ``source_id, url, source_hash, output_hash, sample_index, crop_left, crop_width``.
    """
    carried = ("source_id", "url", "source_hash", "output_hash", "sample_index", "crop_left", "crop_width", "reasons", "flags")
    gate = classify_works(scored, carried)
    pairs = [F.lit(x) for kv in MODE_OF_TYPE.items() for x in kv]
    mode = F.create_map(*pairs)
    j = works.join(by_key(gate), "code", "left").withColumns({
        "candidate_mode": mode[F.col("best_type")], "candidate_reasons": F.to_json("best_reasons"), "risk_flags": F.to_json("best_flags"), "runner_up_mode": mode[F.col("runner_type")],
    }).drop("best_reasons", "best_flags")
    j = j.withColumnsRenamed({f"best_{c}": f"candidate_{c}" for c in ("source_id", "url", "source_hash", "output_hash")} | {f"best_{c}": c for c in ("sample_index", "crop_left", "crop_width")})
    m, sid = F.col("candidate_mode"), F.col("candidate_source_id")
    pattern_ok = reduce(lambda a, b: a | b, [(m == k) & sid.rlike(v) for k, v in SOURCE_ID_PATTERNS.items()])
    hashes = F.col("candidate_source_hash").rlike(SHA256_PATTERN) & F.col("candidate_output_hash").rlike(SHA256_PATTERN)
    no = lambda x: ~F.coalesce(x, F.lit(False))
    crop = m.isin("PACKAGE_RIGHT", "PACKAGE_CENTER")
    contract = (
        F.when(blank_to_null("current_url").isNull(), "MISSING_CURRENT_URL").when(m.isNull(), None).when(no(pattern_ok), "SOURCE_ID_CONTRACT").when(no(hashes), "HASH_CONTRACT")
        .when((m == "SAMPLE") & no(F.regexp_extract(sid, "([0-9]+)$", 1).try_cast("int") == F.col("sample_index")), "SAMPLE_INDEX_MISMATCH")
        .when(crop & no(F.col("crop_left") >= 0), "CROP_LEFT_CONTRACT").when(crop & no(F.col("crop_width") > 0), "CROP_WIDTH_CONTRACT")
    )
    return j.withColumns({"apply": F.lit(False), "review_status": F.lit("PENDING_REVIEW"), "contract": contract})


def vector_distance(pairs: DataFrame, left: str = "left_vector", right: str = "right_vector") -> DataFrame:
    """Mean absolute difference of the vectors of each given pair, over the shorter length."""
    diffs = F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    n = F.least(F.size(left), F.size(right))
    total = F.aggregate(F.slice(diffs, 1, F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return pairs.withColumn("distance", total / F.greatest(n, F.lit(1)))


def distance_to_first(vectors: DataFrame, group: str = "label") -> DataFrame:
    """Distance of every image to the first image of its group (its current picture).

    One comparison per image; the first image is one row per group.
    """
    first = vectors.groupBy(group).agg(F.min_by("vector", "image_id").alias("right_vector"), F.min("image_id").alias("first_id"))
    return vector_distance(vectors.withColumnRenamed("vector", "left_vector").join(first, group))


def resolve_images(works: DataFrame, decisions: DataFrame) -> DataFrame:
    """First available image source per work: ``decisions(code, source, url, ...)``."""
    rank = reduce(lambda acc, kv: acc.when(F.col("source") == kv[1], kv[0]), list(enumerate(IMAGE_PRIORITY))[1:], F.when(F.col("source") == IMAGE_PRIORITY[0], 0))
    usable = decisions.filter(blank_to_null("url").isNotNull()).withColumn("_code", canonical_code("code")["canonical"]).withColumn("_rank", rank).filter("_code is not null and _rank is not null")
    best = latest_per_key(usable, ["_code"], [("_rank", "asc"), ("url", "asc")]).select("_code", F.col("source").alias("decision_source"), F.col("url").alias("resolved_url"))
    j = works.withColumn("_c", canonical_code("code")).withColumn("_code", F.col("_c.canonical")).join(best, "_code", "left")
    outcome = F.when(F.col("_code").isNull(), "INVALID_CODE").when(F.col("resolved_url").isNull(), "SOURCE_MISSING").otherwise("RESOLVED")
    return j.withColumn("outcome", outcome).drop("_c").withColumnRenamed("_code", "canonical_code")


def merge_registry(decisions: DataFrame, priority: tuple[str, ...] = REGISTRY_PRIORITY) -> tuple[DataFrame, DataFrame]:
    """``(kept, conflicts)`` of decision sources by priority; one row per code and source.

    A later review silently supersedes an earlier one; any other differing row is a conflict.
    """
    rank = reduce(lambda acc, kv: acc.when(F.col("registry") == kv[1], kv[0]), list(enumerate(priority))[1:], F.when(F.col("registry") == priority[0], 0))
    ranked = decisions.withColumn("_rank", rank)
    kept = latest_per_key(ranked, ["code"], [("_rank", "asc")])
    same = ("mode", "source_id", "kind", "output_url")
    k = kept.select("code", F.col("registry").alias("kept"), F.col("_rank").alias("_kept_rank"), F.struct(*same).alias("_k"))
    rest = ranked.join(k, "code").filter("_rank > _kept_rank")
    quiet = reduce(lambda a, b: a | b, [(F.col("kept") == w) & F.col("registry").isin(*ls) for w, ls in SUPERSEDED.items()])
    conflicts = rest.filter(~quiet & ~F.struct(*same).eqNullSafe(F.col("_k"))).select("code", "kept", F.col("registry").alias("ignored"), F.col("_k.mode").alias("kept_mode"), F.col("mode").alias("ignored_mode"))
    return kept.drop("_rank"), conflicts


def effective_labels(production: DataFrame, extra: DataFrame, key: str = "code") -> DataFrame:
    """All production labels, and extra labels for codes without one."""
    return production.unionByName(extra.join(production.select(key), key, "left_anti"))


def build_registry(gold: DataFrame, human: DataFrame, fixed: DataFrame) -> dict[str, DataFrame]:
    """Adopted decisions by canonical code, with collisions, rejections, conflicts and counters.

    ``gold``/``human``/``fixed`` carry ``code, mode, source_id``.  Two human rows of one
    canonical code are a collision; a gold row that contradicts a fixed one is a conflict.
    """
    def canon(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("canonical", canonical_code("code")["canonical"]).withColumn("registry", F.lit(name))

    h, g, f = canon(human, "human"), canon(gold, "gold"), canon(fixed, "fixed")
    rejected = h.filter("canonical is null").unionByName(g.filter("canonical is null"))
    collisions = h.filter("canonical is not null").groupBy("canonical").agg(F.count("*").alias("copies")).filter("copies > 1")
    every = reduce(DataFrame.unionByName, [f, h, g]).filter("canonical is not null")
    order = F.when(F.col("registry") == "fixed", 0).when(F.col("registry") == "human", 1).otherwise(2)
    adopted = latest_per_key(every.withColumn("_o", order), ["canonical"], [("_o", "asc"), ("code", "asc")]).drop("_o")
    x = f.select("canonical", F.col("mode").alias("fixed_mode"), F.col("source_id").alias("fixed_source_id"))
    conflicts = g.join(x, "canonical").filter(~F.col("mode").eqNullSafe(F.col("fixed_mode")) | ~F.col("source_id").eqNullSafe(F.col("fixed_source_id"))).select("canonical", "fixed_mode", "mode")
    counters = adopted.groupBy("registry").agg(F.count("*").alias("adopted"))
    return {"adopted": adopted, "collisions": collisions, "rejected": rejected, "conflicts": conflicts, "counters": counters}


def staged_review_codes(records: DataFrame, stage: int) -> DataFrame:
    """Works that reach a stage of the review funnel; ``records(code, stage1, stage2)``."""
    if stage == 1:
        return records.select("code")
    first = F.col("stage1") == "SAMPLE_POTENTIALLY_COMPETITIVE"
    if stage == 2:
        return records.filter(first).select("code")
    if stage == 3:
        return records.filter(first & (F.col("stage2") == "SAMPLE_STILL_COMPETITIVE")).select("code")
    raise ValueError("stage must be 1, 2 or 3")


def apply_stage_decisions(records: DataFrame, decisions: DataFrame, candidates: DataFrame, stage: int) -> DataFrame:
    """Records after a stage's decisions; ``issue`` names a decision that cannot be applied.

    A decision is final (see FINAL_DECISIONS) or moves the work down the funnel; a record that
    is final already keeps its first decision, and another one is an issue.
    """
    table = F.create_map(*[x for k, (d, m, t, s) in FINAL_DECISIONS.items() for x in (F.lit(k), F.struct(F.lit(d).cast("string").alias("d"), F.lit(m).cast("string").alias("m"), F.lit(t).cast("string").alias("t"), F.lit(s).cast("string").alias("s")))])
    d = decisions.select("code", F.col("classification").alias("_class"), F.col("source_id").alias("_sid")).withColumn("_f", table[F.col("_class")])
    j = records.join(by_key(d), "code", "left")
    wanted = F.coalesce("_f.s", F.when(F.col("_class") == "FINAL_SAMPLE", F.col("_sid")))
    j = j.withColumn("_want", wanted)
    have = candidates.groupBy("code", F.col("source_id").alias("_want")).agg(F.min("url").alias("_url"))
    j = j.join(by_key(have), ["code", "_want"], "left")
    final = F.col("_f").isNotNull()
    needs = F.col("_f.t").isNotNull()
    issue = (
        F.when(final & (F.col("_class") == "FINAL_SAMPLE") & ~F.coalesce(F.col("_sid").rlike(SOURCE_ID_PATTERNS["SAMPLE"]), F.lit(False)), "SAMPLE_SOURCE_ID_REQUIRED")
        .when(final & needs & F.col("_url").isNull(), "FINAL_CANDIDATE_MISSING")
        .when(final & F.col("final_decision").isNotNull() & (~F.col("final_decision").eqNullSafe(F.col("_f.d")) | ~F.col("final_source_id").eqNullSafe(F.col("_want"))), "FINAL_DECISION_ALREADY_RECORDED")
    )
    j = j.withColumn("issue", issue)
    take = final & F.col("issue").isNull() & F.col("final_decision").isNull()
    out = j.withColumns({
        "final_source_id": F.when(take, F.col("_want")).otherwise(F.col("final_source_id")), "final_mode": F.when(take, F.col("_f.m")).otherwise(F.col("final_mode")),
        "final_url": F.when(take, F.col("_url")).otherwise(F.col("final_url")), "decision_stage": F.when(take, F.lit(stage)).otherwise(F.col("decision_stage")),
        f"stage{stage}": F.coalesce(F.when(F.col("issue").isNull(), F.col("_class")), F.col(f"stage{stage}")),
    })
    return out.withColumn("final_decision", F.when(take, F.col("_f.d")).otherwise(F.col("final_decision"))).select(*records.columns, "issue")


def review_sheet_class(decided: DataFrame, scored: DataFrame) -> DataFrame:
    """Older A/B/C gate on decided works: risk, score and gain first, then the strict centre
    rules, a close runner-up, and full against right.

    ``decided(code, next_type, next_score, current_score, gain)``.
    """
    rows = scored.withColumn("_risk", candidate_risk(low_resolution=False))
    order = F.struct("score", -F.col("candidate_id"))
    at = lambda t, c: F.max_by(F.when(F.col("type") == t, c), F.when(F.col("type") == t, order))
    facts = rows.groupBy("code").agg(
        at("dvd_full", F.col("score")).alias("_full"), at("dvd_right", F.col("score")).alias("_right"), at("dvd_center", F.col("score")).alias("_center"), at("dvd_center", F.col("_risk")).alias("_center_risk"),
        at("dvd_center", F.array_contains("reasons", "center_crop_rescues_side_band")).alias("_rescue"), at("dvd_right", F.col("flags.cut") | F.col("flags.body")).alias("_right_bad"), F.max_by("_risk", order).alias("_top_risk"),
    )
    two = top_within(rows.select("code", "candidate_id", "score"), ["code"], [("score", "desc"), ("candidate_id", "asc")], 2, "_n").groupBy("code").agg(
        F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("_s1"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("_s2"))
    by_type = rows.groupBy("code", "type").agg(F.max_by("_risk", order).alias("_risk"))
    # an entry a type, of which there are few
    risks = by_type.filter("type is not null").groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("type", "_risk"))).alias("_risks"))
    j = decided
    for part in (facts, two, risks):
        j = j.join(by_key(part), "code", "left")
    j = j.withColumn("_next_risk", F.try_element_at("_risks", F.col("next_type")))
    gain = F.coalesce(F.col("gain"), F.coalesce("next_score", F.lit(0)) - F.coalesce("current_score", F.lit(0)))
    ok = lambda c: F.coalesce(c, F.lit(True))
    yes = lambda c: F.coalesce(c, F.lit(False))
    strict = (F.col("next_type") != "dvd_center") | (
        F.col("_center").isNotNull() & ~yes(F.col("_center_risk")) & (F.col("_center") >= 115) & (gain >= 50) & ok(F.col("_center") - F.col("_right") >= 18) & ok(F.col("_center") - F.col("_full") >= 18)
        & (yes(F.col("_rescue")) | yes(F.col("_right_bad")) | yes(F.col("_right") < 45)))
    label = (
        F.when(yes(F.coalesce("_next_risk", "_top_risk")) | F.col("_s1").isNull() | ~yes(F.col("next_score") >= AUTO_SCORE) | (gain < 24), "C")
        .when(~yes(strict), "B").when(F.coalesce(F.col("_s1") - F.col("_s2"), F.lit(999)) < 12, "B")
        .when((F.col("next_type") == "dvd_full") & yes(F.col("_full") - F.col("_right") < 24), "B").otherwise("A")
    )
    return j.withColumn("sheet_class", label).select(*decided.columns, "sheet_class")


def pick_candidates(scored: DataFrame) -> DataFrame:
    """One candidate per kind for the review sheet; a sample over the threshold is preferred."""
    rows = scored.filter("not excluded")
    return top_within(rows, ["code", "type"], [("score", "desc"), ("candidate_id", "asc")], 1, "_n").drop("_n")


def image_pending(works: DataFrame, *decision_sets: DataFrame, source_name: str) -> DataFrame:
    """Published works of a source with an image and in none of the decision sets (``code``)."""
    out = works.filter(F.col("is_published") & (F.col("source_name") == source_name) & blank_to_null("external_product_id").isNotNull())
    out = out.filter(F.coalesce(blank_to_null("card_image_url"), blank_to_null("image_url")).isNotNull()).withColumn("_code", canonical_code("product_code")["canonical"])
    for decided in decision_sets:
        out = out.join(decided.select(F.col("code").alias("_code")).distinct(), "_code", "left_anti")
    return out.drop("_code")


def calibration(evaluated: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(per truth mode, confusion)`` of ranked results against labels.

    ``evaluated(code, mode1, source1, mode2, source2)``, ``labels(code, truth_mode, truth_source)``.
    """
    j = labels.join(evaluated.withColumn("_seen", F.lit(True)), "code", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    m1, m2 = yes(F.col("mode1") == F.col("truth_mode")), yes(F.col("mode2") == F.col("truth_mode"))
    src = lambda n: F.col("truth_source").isNull() | yes(F.col(f"source{n}") == F.col("truth_source"))
    seen = F.col("_seen").isNotNull()
    per_mode = j.groupBy("truth_mode").agg(
        F.count_if(seen).alias("n"), F.count_if(seen & m1).alias("top1_mode"), F.count_if(seen & m1 & src(1)).alias("top1_source"), F.count_if(seen & (m1 | m2)).alias("top2_mode"),
        F.count_if(seen & ((m1 & src(1)) | (m2 & src(2)))).alias("top2_source"), F.count_if(seen & ~m1).alias("wrong"), F.count_if(~seen).alias("missing"),
    )
    confusion = j.filter(seen & ~m1).groupBy("truth_mode", F.coalesce("mode1", F.lit("NONE")).alias("predicted")).agg(F.count("*").alias("n"))
    return per_mode, confusion


def gold_acceptance(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that the results miss or contradict: no rows means accepted.

    ``results(code, blocked_code, type, source)``, ``labels(code, expected_type, expected_source)``.
    """
    j = labels.join(results.withColumn("_seen", F.lit(True)), "code", "left")
    differs = ~F.col("type").eqNullSafe(F.col("expected_type")) | ~F.col("source").eqNullSafe(F.col("expected_source"))
    reason = F.when(F.col("_seen").isNull(), "missing_result").when(F.col("blocked_code").isNotNull(), F.col("blocked_code")).when(differs, "type_or_source_mismatch")
    return j.withColumn("reason", reason).filter("reason is not null").select("code", "expected_type", "expected_source", "type", "source", "reason")


def tuning_report(before_after: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per mode: correct before and after tuning, and the holdout's results."""
    b = before_after.filter("review_group <> 'HISTORICAL_CONTROL'").groupBy(F.col("before_mode").alias("mode")).agg(
        F.count("*").alias("sample_size"), F.count_if(F.col("before_result") == "APPROVE_CANDIDATE").alias("before_correct"), F.count_if(F.col("after_result") != "WRONG").alias("after_correct"))
    h = holdout.groupBy(F.col("candidate_mode").alias("mode")).agg(
        *[F.count_if(F.col("visual_result") == r).alias(f"holdout_{r.lower()}") for r in ("CORRECT", "ACCEPTABLE", "WRONG")],
        F.count_if(F.col("classification") == "A").alias("class_a"), F.count_if((F.col("classification") == "A") & (F.col("visual_result") == "CORRECT")).alias("_a"))
    out = b.join(h, "mode", "full_outer")
    return out.withColumn("class_a_precision", F.col("_a") / F.nullif(F.col("class_a"), F.lit(0))).drop("_a").fillna(0, [c for c in out.columns if c not in ("mode", "class_a_precision", "_a")])
