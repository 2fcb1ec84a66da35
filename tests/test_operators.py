"""Operators against brute force and inline fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colophon.functions import codes, dates, text, urls
from colophon.functions.registry import register_functions
from colophon.operators import bundles, frontier, greedy, images, intake, joins, merging, metrics, posts, priority, publication, ranking, related, review, sampling, search, staging
from colophon.sources import catalog_csv, exports, item_list, source_items


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# -- numbering under skew ------------------------------------------------------------------------
def test_numbered_equals_row_number_with_hot_groups_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(50)}", rng.choice([None, 1.0, 1.0, 2.0, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: r["rank"] for r in ranking.numbered(df, ["g"], [("v", "desc"), ("id", "asc")], buckets=7).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        for place, r in enumerate(members, 1):
            assert got[r[0]] == place
    overall = {r.id: r["rank"] for r in ranking.numbered(df, [], [("v", "asc"), ("id", "asc")]).collect()}
    assert sorted(overall.values()) == list(range(1, 3001))


def test_numbered_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert ranking.numbered(df, [], [("v", "desc"), ("id", "asc")]).count() == 0


def test_nearest_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)])) for _ in range(400)] + [("c", 5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: (r.p50, r.p95) for r in ranking.nearest_ranks(df, ["k"], {"p50": ("v", 0.5), "p95": ("v", 0.95)}).collect()}
    for k in {k for k, _ in rows}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        assert got[k] == tuple(own[-(-len(own) * p // 100) - 1] if own else None for p in (50, 95))
    every = sorted(v for _, v in rows if v is not None)
    assert ranking.nearest_ranks(df, [], {"p": ("v", 0.9)}).first().p == every[-(-len(every) * 9 // 10) - 1]
    assert ranking.nearest_ranks(df.limit(0), [], {"p": ("v", 0.9)}).first().p is None


def brute_first_come(rows):
    ids, keys, kept = set(), set(), []
    for pos, a, b in rows:
        if (a is not None and a in ids) or (b is not None and b in keys):
            continue
        kept.append(pos)
        ids.add(a)
        keys.add(b)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_first_come_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", *map(str, range(20))]), rng.choice([None, "x", *map(str, range(25))])) for i in range(120)]
    df = spark.createDataFrame(rows, "pos long, a string, b string")
    assert sorted(r.pos for r in greedy.first_come(df, ["a", "b"], "pos").collect()) == brute_first_come(rows)


@pytest.mark.parametrize("local", [0, 7, 40])
def test_first_come_in_rounds_equals_a_scan(spark, local):
    rng = random.Random(local)
    rows = [(i, rng.choice([None, "hot", *map(str, range(60))]), rng.choice([None, None, "x", *map(str, range(70))])) for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, a string, b string")
    report = []
    assert sorted(r.pos for r in greedy.first_come(df, ["a", "b"], "pos", local, report).collect()) == brute_first_come(rows)
    assert report[0] == "round"


def chain(n):
    """Each row shares its id with the one before it or its code with it, in turn."""
    return [(k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(n)]


def test_a_long_chain_takes_logarithmic_rounds(spark):
    rows = chain(10_000)
    df = spark.createDataFrame(rows, "pos long, a string, b string")
    whole, jumps = [], []
    assert sorted(r.pos for r in greedy.first_come(df, ["a", "b"], "pos", report=whole).collect()) == list(range(0, 10_000, 2))
    assert whole == ["scan"]
    got = greedy.first_come(df, ["a", "b"], "pos", 500, jumps)
    assert sorted(r.pos for r in got.collect()) == list(range(0, 10_000, 2))
    assert jumps.count("jump") <= 15 and len(jumps) <= 22


def test_lookup_deals_rows_without_a_key(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("k"))
    other = spark.createDataFrame([(2, "two"), (4, "four"), (None, "none")], "k long, name string")
    got = joins.lookup(df, other, "k")
    assert got.columns == ["k", "id", "name"] and got.count() == 2000
    assert {(r.k, r.name) for r in got.collect()} == {(None, None), (0, None), (2, "two"), (4, "four"), (6, None), (8, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in joins.lookup(df, other, "k").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 1000


# -- lanes and samples -----------------------------------------------------------------------------
def brute_lanes(rank, latest, backfill, size):
    key = lambda c: (-c["priority_score"], tuple(-ord(ch) for ch in c["release_date"]), c["code_key"] or "~", c["external_product_id"], c["position"])
    targets = priority.lane_targets(size)
    chosen, ids, keys = [], set(), set()

    def add(pool, lane, limit, ok=lambda c: True):
        for c in sorted(pool, key=key):
            if sum(1 for r in chosen if r[1] == lane) >= limit:
                break
            if not ok(c) or c["external_product_id"] in ids or (c["code_key"] and c["code_key"] in keys):
                continue
            chosen.append((c["position"], lane))
            ids.add(c["external_product_id"])
            if c["code_key"]:
                keys.add(c["code_key"])

    add(rank, "RECENT_POPULAR", targets["RECENT_POPULAR"], lambda c: c["rank_position"] is not None and c["age_days"] <= 180)
    add(latest, "LATEST", targets["LATEST"])
    add(backfill, "BACKFILL", targets["BACKFILL"])
    if len(chosen) < size:
        add(latest, "LATEST", targets["LATEST"] + size - len(chosen))
    return sorted(chosen)


def test_select_lanes_equals_a_scan(spark):
    rng = random.Random(5)
    pool = [
        {"position": i, "external_product_id": f"c{rng.randrange(60)}", "code_key": rng.choice([None, f"K{rng.randrange(60)}"]), "release_date": f"2024-01-{rng.randrange(1, 29):02d}",
         "age_days": rng.randrange(0, 300), "rank_position": rng.choice([None, rng.randrange(600)]), "priority_score": float(rng.randrange(20))}
        for i in range(150)
    ]
    schema = "position long, external_product_id string, code_key string, release_date string, age_days int, rank_position int, priority_score double"
    df = spark.createDataFrame([tuple(c.values()) for c in pool], schema)
    parts = [[c for c in pool if c["position"] % 3 == n] for n in range(3)]
    frames = [df.filter(f"position % 3 = {n}") for n in range(3)]
    got = sorted((r.position, r.lane) for r in priority.select_lanes(*frames, 30).collect())
    assert got == brute_lanes(*parts, 30)


def brute_sample(rows, targets, place, share):
    import math

    used_codes, used_groups, out = set(), set(), []
    for mode, target in targets.items():
        pool = sorted([r for r in rows if r["mode"] == mode], key=place)
        picked = []
        for r in pool:
            if len(picked) == target:
                break
            g = (r["maker"], r["series"])
            if (g in used_groups and len(picked) < math.ceil(target * share)) or r["code"] in used_codes:
                continue
            picked.append(r["code"])
            used_codes.add(r["code"])
            used_groups.add(g)
        for r in pool:
            if len(picked) == target:
                break
            if r["code"] not in used_codes:
                picked.append(r["code"])
                used_codes.add(r["code"])
        out += picked
    return sorted(out)


@pytest.mark.parametrize("hot, codes", [(1, 300), (40, 300), (40, 25)])
def test_samples_equal_a_scan(spark, hot, codes):
    import hashlib

    rng = random.Random(hot)
    rows = [
        {"code": f"A-{i if codes == 300 else rng.randrange(codes):04d}", "mode": rng.choice(["SAMPLE", "PACKAGE_RIGHT"]), "confidence": rng.choice(["high", "medium", "low"]), "score": rng.randrange(100), "created_at": f"2024-{rng.randrange(1, 10)}",
         "maker": "M0" if i % 3 else f"M{rng.randrange(hot)}", "series": f"S{rng.randrange(2)}", "classification": rng.choice("AB")}
        for i in range(300)
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'int' if k == 'score' else 'string'}" for k in rows[0]))
    targets = {"SAMPLE": 12, "PACKAGE_RIGHT": 9}
    level = {"high": 0, "medium": 1, "low": 2}
    place = lambda r: (level[r["confidence"]], -(r["score"] or -999) if r["score"] else 999, r["created_at"], r["code"])
    assert sorted(r.code for r in sampling.stratified_sample(df, targets).collect()) == brute_sample(rows, targets, place, 0.5)
    by_hash = lambda r: (hashlib.sha256(r["code"].encode()).hexdigest(), r["maker"], r["series"])
    none = df.filter("false")
    assert sorted(r.code for r in sampling.holdout_sample(df, targets, none).collect()) == brute_sample(rows, targets, by_hash, 1.0)


def test_index_choices(spark):
    assert one(spark, sampling.even_indices(F.lit(20), 8)) == [1, 4, 6, 9, 12, 15, 17, 20]
    assert one(spark, sampling.even_indices(F.lit(1), 8)) == [1]
    chosen, left, want = [1, 20], list(range(2, 20)), []
    seen = set(chosen)
    for _ in range(4):
        left.sort(key=lambda i: (-min(abs(c - i) for c in seen), i))
        seen.add(left[0])
        want.append(left.pop(0))
    assert one(spark, sampling.spread_indices(F.lit(20), F.array(F.lit(1), F.lit(20)), 4)) == sorted(want)


@pytest.mark.parametrize("start", range(4))
def test_interleave_equals_a_loop(spark, start):
    for n, m in ((0, 3), (7, 2), (2, 7), (9, 3)):
        a = spark.createDataFrame([(i, f"p{i}") for i in range(n)], "position long, item string")
        b = spark.createDataFrame([(i, f"s{i}") for i in range(m)], "position long, item string")
        got = [r["item"] for r in related.interleave(a, b, 8, start).orderBy("slot", "side").collect()]
        want, i, j, k = [], 0, 0, start
        while len(want) < 8 and (i < n or j < m):
            if k != 3 and i < n:
                want.append(f"p{i}"); i += 1; k = (k + 1) % 4
            elif k == 3 and j < m:
                want.append(f"s{j}"); j += 1; k = 0
            elif i < n:
                want.append(f"p{i}"); i += 1
            else:
                want.append(f"s{j}"); j += 1
        assert got == want, (n, m, start)


# -- scalars -----------------------------------------------------------------------------------------
def test_code_keys(spark):
    assert one(spark, codes.code_key_upper(F.lit(" abc-12 "))) == "ABC12"
    assert one(spark, codes.code_key_upper(F.lit("--"))) is None
    assert one(spark, codes.code_key_upper(F.lit("abc-12"), strict_reference=True)) == "12"
    assert one(spark, codes.hyphenate_code(F.lit("ABC123"))) == "ABC-123"
    assert one(spark, codes.name_key(F.lit("Ab・c ー　d_e/f.g-h"))) == "abcdefgh"
    c = one(spark, codes.canonical_code(F.lit(" 1namh 500006")))
    assert c["rejected"] and c["canonical"] is None
    c = one(spark, codes.canonical_code(F.lit("h_1784ft000062")))
    assert c["alias_applied"] and c["canonical"] == "H_1784FTO00062" and c["key"] == "H1784FTO00062"


def test_trigram_similarity(spark):
    assert one(spark, text.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, text.trigram_similarity(F.lit(""), F.lit("--"))) == 0.0
    register_functions(spark)
    assert spark.sql("select trigram_similarity('word', 'two words') s, code_key_upper(' a-1 ') k, name_key('A・b') n").first() == (pytest.approx(4 / 11), "A1", "ab")


@pytest.mark.parametrize("url,ok", [
    ("https://shop.example/x", True), ("https://a.shop.example:443/x?y#z", True), ("https://shop.example", True), ("http://shop.example/x", False), ("https://shop.example.evil.example/", False),
    ("https://evilshop.example/", False), ("https://user@shop.example/", False), ("https://shop.example:8443/", False), ("https://shop.example\\@evil.example/", False), ("junk", False), (None, False),
])
def test_url_allowed(spark, url, ok):
    assert one(spark, urls.url_allowed(F.lit(url).cast("string"), ("shop.example",))) is ok


def test_dates(spark):
    assert one(spark, dates.release_age_days(F.lit("2024-01-01"), "2024-01-31")) == 30
    assert one(spark, dates.release_age_days(F.lit("2024-02-01"), "2024-01-31")) == 0
    assert one(spark, dates.release_age_days(F.lit("2024-13-01"), "2024-01-31")) is None
    r = one(spark, dates.review_signal(F.lit(150), F.lit(4.25)))
    assert r["label"] == "count:150;average:4.25" and r["score"] == 143.0
    assert one(spark, dates.review_signal(F.lit(1), F.lit(6.0)))["label"] == "NONE"


def test_redaction_and_keys(spark):
    msg = one(spark, text.redact(F.lit("token=abc&x=1 Bearer zz.z hunter22"), ("hunter22",)))
    assert msg == "token=[REDACTED]&x=1 Bearer [REDACTED] [REDACTED]"
    payload = F.lit('{"a":{"Email":"x","b":[{"token":1}]},"c":2}')
    assert one(spark, text.forbidden_keys(payload)) == ["Email", "token"]
    assert one(spark, text.unexpected_keys(payload, ("c",))) == ["a", "b"]


def test_codes_in_text(spark):
    assert one(spark, text.codes_in(F.lit("xAB-12 abc 123, ABC-123 zz_9999 éab-12 toolongprefixx-12"))) == ["XAB-12", "ABC-123", "ZZ-9999", "AB-12"]


# -- catalog CSV --------------------------------------------------------------------------------------
CSV = '''﻿品番,タイトル,女優名,発売日,収録時間,サンプル画像,ジャンル,タグ,削除項目,説明
abc-1,One,"Name ""A""",2024-01-01,60,"[""https://i.example/1.jpg""]",drama|other,t1||t2,,"two
lines"

,No code,,,,,,,,
abc-2,Two,,2024/01/01,,,,,,
abc-3,Three,,,-5,,,,,
abc-4,Four,,,,,,,nonsense,
abc-5,Five,,,,ftp://x|https://i.example/2.jpg,,,,
abc-6,,,,9007199254740992,,,,,
abc-7,,Kept,,,,,,シリーズ|sample_images,
abc-1,Again,,,,,,,,
'''


def test_catalog_csv_and_upsert(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV, encoding="utf-8")
    rows = catalog_csv.read_catalog_csv(spark, str(path))
    valid, errors = catalog_csv.validate_catalog_rows(rows)
    by_row = {r.row: r for r in errors.collect()}
    assert [by_row[n].message[:4] for n in (3, 4, 5, 6, 7, 8)] == ["品番は必", "発売日は", "数値項目", "削除項目", "URL形", "数値項目"]
    good = {r.row: r for r in valid.collect()}
    assert good[2].performer == 'Name "A"' and good[2].sample_images == ["https://i.example/1.jpg"] and good[2].genres == ["drama", "other"] and good[2].tags == ["t1", "t2"] and good[2].description == "two\nlines"
    assert good[9].clear_fields == ["series", "sample_images"]
    stored = [("ABC-7", "Seven", "Old", "M", "S", "L", "g", 10, "2020-01-01", ["https://i.example/0.jpg"], None, None, None, None, "d", 5, 6, True)]
    fields = ", ".join(f"{c} {'array<string>' if c == 'sample_images' else 'long' if c in ('duration', 'popularity', 'favorite_count') else 'string'}" for c in merging.CATALOG_FIELDS)
    existing = spark.createDataFrame(stored, f"product_code string, {fields}, is_published boolean")
    catalog, outcome, log = merging.upsert_catalog_csv(existing, valid, "update")
    got = {r.product_code: r for r in catalog.collect()}
    assert got["ABC-1"].title == "Again" and got["ABC-1"].popularity == 0 and not got["ABC-1"].is_published
    assert got["ABC-7"].performer == "Kept" and got["ABC-7"].series is None and got["ABC-7"].sample_images == [] and got["ABC-7"].title == "Seven" and got["ABC-7"].is_published
    assert sorted(r.outcome for r in outcome.collect()) == ["imported", "imported", "updated"]
    assert log.first().changed_fields == ["performer", "series", "sample_images"]
    skipped = merging.upsert_catalog_csv(existing, valid, "skip")[1]
    report = merging.import_job_report(skipped, errors).first()
    assert (report.processed, report.imported, report.updated, report.duplicate, report.failed) == (9, 2, 0, 1, 6)


def test_bridges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    rows = spark.createDataFrame([(1, ["x"], True, []), (2, [], True, ["tags"]), (3, [], False, [])], "id long, tags array<string>, supplied boolean, clear_fields array<string>")
    run = lambda mode: sorted(map(tuple, merging.sync_bridges(old, rows, "id", "tags", "supplied", mode, "tags").collect()))
    assert run("merge") == [(1, "a"), (1, "x"), (3, "c")] and run("replace") == [(1, "x"), (3, "c")]


def test_source_items(spark, tmp_path):
    lines = [{"source": "x", "source_key": "1", "product_code": " abc-1 ", "title": "", "tags": ["a"]}, {"source": "x", "source_key": "2", "tags": ["t" * 101]}, {"source_key": "3"}, {"source": "x", "source_key": "4", "source_url": "ftp://no"}]
    path = tmp_path / "items.json"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n", encoding="utf-8")
    ok, bad = source_items.check_source_items(source_items.read_source_items(spark, str(path)).cache(), "now")
    row = ok.first()
    assert ok.count() == 1 and bad.count() == 4 and row.product_code == "ABC-1" and row.title is None and row.status == "pending" and row.observed_at == "now"


def test_export_is_quoted(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a"b', "k2", "x\r\ny", ["p", "q"]), (1, "s", "k1", None, [])], "id long, source string, source_key string, title string, tags array<string>")
    for c in ("source_url", "observed_at", "product_code", "performer", "maker", "series", "status"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    source_items.export_source_items(df.coalesce(1), str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8").splitlines()
    assert body[0].startswith('"source","source_key"') and body[1].startswith('"s","k1"') and '"a""b","k2"' in body[2] and '"x y"' in body[2] and '"p|q"' in body[2]


# -- feed ---------------------------------------------------------------------------------------------
def feed_item(cid="c1", code="abc-001", **more):
    item = {
        "content_id": cid, "product_id": code, "title": " Title ", "date": "2024/01/02 10:00:00", "URL": "https://shop.example/1", "affiliateURL": "https://al.shop.example/1",
        "imageURL": {"small": "https://pics.shop.example/s.jpg", "list": "javascript:x"}, "sampleImageURL": {"sample_l": {"image": ["https://pics.shop.example/1.jpg", "https://pics.shop.example/1.jpg"]}},
        "sampleMovieURL": {"size_560_360": "https://v.shop.example/m"}, "prices": {"price": "1,980円~"}, "iteminfo": {"actress": [{"id": 1, "name": " A "}, {"id": 2, "name": ""}], "maker": [{"name": "M"}], "genre": [{"name": "g"}, {"name": "g"}]},
    }
    item.update(more)
    return item


def stage(spark, tmp_path, items, works=(), staged=()):
    path = tmp_path / "page.json"
    path.write_text(json.dumps({"result": {"items": items}}), encoding="utf-8")
    rows = item_list.normalize_items(item_list.read_item_list(spark, str(path)))
    base = "id long, external_product_id string, code_key string, title string, performers array<string>, maker string, series string, genres array<string>"
    w = spark.createDataFrame(list(works), base)
    s = spark.createDataFrame(list(staged), base + ", review_status string, preview_status string, attempt_count long, linked_work_id long")
    return rows, staging.stage_items(rows, w, s, ("shop.example",))


def test_normalize_item(spark, tmp_path):
    rows, _ = stage(spark, tmp_path, [feed_item()])
    r = rows.first()
    assert (r.product_code, r.code_key, r.title, r.performers, r.maker, r.series, r.genres) == ("ABC-001", "ABC001", "Title", ["A"], "M", None, ["g"])
    assert r.release_date == "2024-01-02" and r.price == 1980.0 and r.card_image_url.endswith("s.jpg") and r.image_url.endswith("s.jpg") and len(r.sample_images) == 1 and r.video_url.endswith("/m")


def test_staging_tree(spark, tmp_path):
    same = ("Title", ["A"], "M", None, ["g"])
    items = [
        feed_item(), feed_item("c2", "abc-002"), feed_item("c2", "abc-002"), feed_item("c3", "abc-003"), feed_item("c3", "abc-003", title="Other"), feed_item("c4", "abc-004"), feed_item("c5", "ABC 004"),
        feed_item("c6", "abc-006"), feed_item("c7", "abc-007"), feed_item("c8", "abc-008"), feed_item(None, None), feed_item("c9", "abc-009", URL="http://shop.example/1"),
    ]
    works = [(1, "c1", "ABC001", *same), (6, None, "ABC006", "Old", ["A"], "M", None, ["g"]), (71, None, "ABC007", *same), (72, None, "ABC007", *same)]
    staged = [(80, "c8", "ABC008", *same, "pending", "needs_review", 4, None), (81, "other", "ABC006", *same, "pending", "new", 0, None)]
    _, out = stage(spark, tmp_path, items, works, staged)
    got = {r.external_product_id: (r.preview_status, r.review_reasons) for r in out.collect()}
    assert got["c1"] == ("unchanged", []) and got["c2"] == ("new", []) and got["c3"] == ("needs_review", ["same_external_id_payload_conflict"])
    assert got["c4"] == got["c5"] == ("needs_review", ["normalized_code_batch_collision"])
    assert got["c6"] == ("needs_review", ["normalized_code_source_collision"]) and got["c7"] == ("needs_review", ["work_match_ambiguous"])
    assert got["c8"] == ("unchanged", []) and got["c9"] == ("needs_review", ["official_url_not_allowed"])
    missing = next(v for k, v in got.items() if k.startswith("missing:"))
    assert missing[1] == ["external_product_id_missing", "product_code_missing", "normalized_product_code_missing"]
    kept = {r.external_product_id: r for r in staging.merge_stage_state(out, 1, "t").collect()}
    assert kept["c8"].preview_status == "needs_review" and kept["c8"].attempt_count == 5 and kept["c1"].attempt_count == 1


def test_unsafe_pending_fails(spark):
    row = ("1", "x", None, "X1", "X1", "t", ["p"], "http://bad/", "https://shop.example/", "https://shop.example/i.jpg", None, [], "new", "pending", "2024")
    schema = ("id string, external_product_id string, code_rejection string, product_code string, code_key string, title string, performers array<string>, official_url string, affiliate_url string, "
              "card_image_url string, image_url string, sample_images array<string>, preview_status string, review_status string, fetched_at string")
    with pytest.raises(Exception, match="unsafe"):
        staging.select_safe_pending(spark.createDataFrame([row], schema), ("shop.example",)).collect()


# -- second source ----------------------------------------------------------------------------------
SOURCE = posts.PostSource("feed", "posts.example", "link.posts.example", "Posts")
UUID = "00000000-0000-4000-8000-000000000001"


@pytest.mark.parametrize("url,ok", [
    (f"https://posts.example/posts/{UUID}", True), (f"https://posts.example/posts/{UUID}?a", False), (f"https://www.posts.example/posts/{UUID}", False), (f"http://posts.example/posts/{UUID}", False), ("https://posts.example/posts/x", False), (None, False),
])
def test_post_url(spark, url, ok):
    assert one(spark, SOURCE.is_post_url(F.lit(url).cast("string"), F.lit(UUID))) is ok


@pytest.mark.parametrize("url,ok", [("https://link.posts.example/p/1", True), ("https://link.posts.example/?q", True), ("https://link.posts.example/", False), ("https://link.posts.example", False), ("https://x.link.posts.example/p", False), ("http://link.posts.example/p", False)])
def test_link_url(spark, url, ok):
    assert one(spark, SOURCE.link_ok(F.lit(url))) is ok


def test_merge_cumulative_is_idempotent(spark):
    old = spark.createDataFrame([("a", "t", 1, "L", "d1", "r1", "d1", "r1"), ("b", "t", 2, None, "d1", "r1", "d1", "r1")], "k string, title string, price long, link string, first_seen_at string, first_seen_run string, last_seen_at string, last_seen_run string")
    run = spark.createDataFrame([("a", "t", 5, None, "d2"), ("c", "n", 3, None, "d2")], "k string, title string, price long, link string, collected_at string")
    args = ("k", ["title", "price", "link"], ["title"], "r2", "link")
    first = merging_result = bundles.merge_cumulative(old, run, *args)
    rows = {r.k: r for r in first["records"].collect()}
    assert rows["a"].price == 5 and rows["a"].link == "L" and rows["a"].first_seen_run == "r1" and rows["a"].last_seen_run == "r2" and rows["b"].last_seen_run == "r1" and rows["c"].first_seen_run == "r2"
    again = bundles.merge_cumulative(merging_result["records"], run, *args)
    assert again["counts"].first().asDict() == {"added": 0, "updated": 0, "unchanged": 2, "absent": 1, "conflict": 0}
    assert sorted(map(str, again["records"].collect())) == sorted(map(str, first["records"].collect()))


def test_membership_hash_matches_hashlib_and_refuses_large_windows(spark):
    import hashlib

    df = spark.createDataFrame([(0, i, f"id{i}", f"h{i}") for i in range(5)], "w long, p long, id string, h string")
    row = frontier.membership_hashes(df, "w", "p", "id", "h").first()
    assert row.membership_sha256 == hashlib.sha256("".join(f"id{i}\n" for i in range(5)).encode()).hexdigest()
    assert row.payload_sha256 == hashlib.sha256("".join(f"id{i}\th{i}\n" for i in range(5)).encode()).hexdigest()
    with pytest.raises(Exception, match="too large"):
        frontier.membership_hashes(df, "w", "p", "id", "h", limit=3).collect()


def test_anchored_window_outcomes(spark):
    parents = spark.createDataFrame([(i, f"p{i}", None, None, f"h{i}") for i in range(1, 101)], "source_offset long, external_id string, code_key string, release_date string, payload_hash string")
    anchors = frontier.frontier_anchors(parents, 10).cache()
    listing = [(i, f"n{i}", "x") for i in range(1, 8)] + [(i + 7, f"p{i}", f"h{i}") for i in range(1, 101)] + [(108, "p3", "h3"), (109, "q1", "x"), (110, "q1", "x"), (111, "q2", "x"), (112, "q3", "x")]
    df = spark.createDataFrame(listing, "offset long, external_id string, payload_hash string")
    ids = parents.select("external_id")
    records, report = frontier.anchored_window(df, anchors, ids, 3, min_matches=5)
    assert [r.external_id for r in records.orderBy("live_offset").collect()] == ["q1", "q2", "q3"]
    row = report.first()
    assert (row.status, row.drift, row.anchor_matches, row.payload_matches) == ("ok", 7, 10, 10)
    assert frontier.anchored_window(df, anchors, ids, 4, min_matches=5)[1].first().status == "window_incomplete"
    assert frontier.anchored_window(df.filter("external_id not like 'p%'"), anchors, ids, 3)[1].first().status == "anchor_not_found"
    assert frontier.anchored_window(df.withColumn("offset", F.when(F.col("external_id") == "p95", 2).otherwise(F.col("offset"))), anchors, ids, 3)[1].first().status == "anchor_ambiguous"


def test_snapshot_digest(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id long, v string")
    same, other = a.orderBy(F.col("id").desc()).repartition(3), a.limit(2)
    d = lambda df: exports.table_digest(df).first().digest
    assert d(a) == d(same) != d(other)
    diff = exports.compare_snapshots(exports.catalog_snapshot({"t": a}), exports.catalog_snapshot({"t": other})).first()
    assert not diff.unchanged and (diff.rows_before, diff.rows_after) == (3, 2)
    exports.write_sitemap(spark.createDataFrame([(0, "https://x/?a&b", "2024-01-01")], "page long, url string, lastmod string"), str(tmp_path / "map"))
    assert "a&amp;b" in next((tmp_path / "map" / "page=0").glob("part-*")).read_text()


def test_quality_settings_are_checked():
    with pytest.raises(ValueError):
        review.QualitySettings(high=0.5, medium=0.6)
    with pytest.raises(ValueError):
        priority.lane_targets(0)


def test_search_edges(spark):
    works = spark.createDataFrame([(1, "ABC-001", "One", "P", "M", "S", 1, "2024", "2024", True)], "id long, product_code string, title string, performer string, maker string, series string, popularity long, created_at string, release_date string, is_published boolean")
    aliases = spark.createDataFrame([("performer", "P", "ぺー")], "entity_type string, canonical_name string, alias string")
    n = lambda q: search.search_works(works, aliases, q).count()
    assert (n(" "), n("・"), n("abc001"), n("O%e"), n("ぺ"), n("zzz")) == (0, 0, 1, 1, 1, 0)


def test_hot_key_staging_and_joins(spark):
    """A third of all log rows on one code: counts stay exact and every row is used."""
    logs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "HOT-1").otherwise(F.concat(F.lit("c-"), (F.col("id") % 100).cast("string"))).alias("product_code"))
    works = spark.createDataFrame([("hot-1", True), ("C-1", True), ("C-2", False)], "product_code string, is_published boolean")
    got = {r.product_code: r.search_count for r in metrics.search_counts(logs, works).collect()}
    assert got == {"HOT-1": 3000, "C-1": logs.filter("product_code = 'c-1'").count()}


def test_write_scope_and_intake_edges(spark):
    df = spark.createDataFrame([("a", 1, "pending")], "k string, v int, status string")
    assert publication.verify_write_scope(df.filter("false"), df, df, "k", ["v"], {"status": "pending"}).count() == 0
    e = spark.createDataFrame([(UUID, UUID, None, "abc")], "work_id string, related_work_id string, session_id string, product_code string")
    assert intake.valid_events(e).count() == 0
    assert intake.valid_events(e.withColumn("related_work_id", F.lit(UUID.replace("1", "2")))).first().product_code == "ABC"
    assert images.score_candidates is not None


# -- promotion --------------------------------------------------------------------------------------
def test_two_products_of_one_work_both_count(spark):
    url = "https://shop.example/a"
    cols = (
        "id long, external_product_id string, product_code string, code_key string, code_rejection string, title string, performers array<string>, maker string, genres array<string>, "
        "card_image_url string, image_url string, sample_images array<string>, official_url string, affiliate_url string, price double, review_status string, preview_status string, "
        "linked_work_id long, data_source_id int, fetched_at string, series string, label string, release_date string, description string, video_url string"
    )

    def product(i, ext, code, title, maker, genres, status="new", linked=None):
        return (i, ext, code, code, None, title, ["p"], maker, genres, url, None, [], url, url, float(i), "pending", status, linked, 1, f"day {i}", None, None, None, None, None)

    staged = spark.createDataFrame([
        product(10, "a", "K1", "first", "m", ["g"], "update", 1), product(11, "b", "K1", "second", None, [], "update"),
        product(12, "c", "N1", "new", "n", ["h"]), product(13, "d", "N1", "newer", None, ["i", "i"]), product(14, "c", "N1", "newest", None, None), product(15, "e", "X", "held", "m", ["g"], "needs_review"),
    ], cols)
    works = spark.createDataFrame([(1, "K1", "old", "was", True, "s"), (2, "Z", "other", None, True, None)], "id long, product_code string, title string, maker string, is_published boolean, series string")
    out = publication.promote(staged, works, ("shop.example",), "feed")
    rows = {r.product_code: r for r in out["works"].collect()}
    assert {c: (r.title, r.maker, r.is_published, r.series) for c, r in rows.items()} == {
        "K1": ("second", "m", True, "s"), "Z": ("other", None, True, None), "N1": ("newest", "n", False, None)}
    new = rows["N1"].id
    assert {(r.external_product_id, r.work_id, r.staged_id, r.price) for r in out["offers"].collect()} == {("a", 1, 10, 10.0), ("b", 1, 11, 11.0), ("c", new, 14, 14.0), ("d", new, 13, 13.0)}
    assert sorted((r.work_id == 1, r.staged_id) for r in out["source_links"].collect()) == [(False, 12), (False, 13), (False, 14), (True, 10), (True, 11)]
    assert {r.id: r.review_status for r in out["staged_updates"].collect()} == {**dict.fromkeys(range(10, 15), "promoted"), 15: "error"}
    assert {(r.work_id == 1, r.name) for r in out["genres"].collect()} == {(True, "g"), (False, "i")}
    assert [(r.work_id, r.changed_fields) for r in out["change_log"].collect()] == [(1, ["title", "maker"])]


# -- manifests --------------------------------------------------------------------------------------
def test_manifest_digest_of_many_levels(spark):
    import hashlib

    rows = [(i, f"c{i}", f"h{i * 7}") for i in range(53)]
    got = frontier.manifest_digest(spark.createDataFrame(rows, "at long, code string, payload string").repartition(5), [("at", "asc")], "code", "payload", fan=3).first()
    for lines, found in (([f"{c}\n" for _, c, _ in rows], got.membership_sha256), ([f"{c}\t{p}\n" for _, c, p in rows], got.payload_sha256)):
        steps = 0
        while len(lines) > 1 or steps < 2:
            lines = [hashlib.sha256("".join(lines[k : k + 3]).encode()).hexdigest() + "\n" for k in range(0, len(lines), 3)]
            steps += 1
        assert lines[0].strip() == found
    assert got.rows == 53
    assert frontier.manifest_digest(spark.createDataFrame([], "at long, code string, payload string"), [("at", "asc")], "code", "payload").count() == 0


def test_repeated_new_errors_raise_the_attempts(spark):
    cols = "job_id string, api_offset long, stage string, error_type string, external_product_id string, message string, attempt_count long"
    old = spark.createDataFrame([("j", 1, "persist", "e", "a", "m", 3)], cols).withColumn("resolved_at", F.lit(None).cast("string"))
    new = spark.createDataFrame([("j", 1, "persist", "e", "a", "m2", 1), ("j", 1, "persist", "e", "a", "m1", 1), ("j", 2, "persist", "e", "b", "m", 1), ("j", 2, "persist", "e", "b", "m", 1)], cols)
    none = spark.createDataFrame([], "job_id string, external_product_id string, resolved_at string")
    got = {r.api_offset: (r.attempt_count, r.message) for r in merging.api_error_log(old, new, none).collect()}
    assert got == {1: (5, "m2"), 2: (2, "m")} and merging.api_error_log(old, new, none).count() == 2


# -- quoted CSV in splits ---------------------------------------------------------------------------
CSV_TEXT = """\ufeff品番,タイトル, メーカー ,説明
A-1,one,m,"first\nsecond ""x""\n\nlast"
A-2,"two, with comma",,plain

"A-3","a
b","m ""q""\n",
A-4,,,"ends ""quoted"" x"
A-5,"","x","é\nü\n日本"
"""


@pytest.mark.parametrize("size", [11, 29, 1000])
def test_quoted_csv_is_the_same_however_it_is_cut(spark, tmp_path, size):
    (tmp_path / "a.csv").write_text(CSV_TEXT, encoding="utf-8")
    (tmp_path / "b.csv").write_text(CSV_TEXT.replace("A-", "B-").rstrip("\n"), encoding="utf-8")
    whole = [tuple(r) for r in catalog_csv.read_catalog_csv(spark, str(tmp_path), split=False).orderBy("row").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [tuple(r) for r in catalog_csv.read_catalog_csv(spark, str(tmp_path)).orderBy("row").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == whole and len(got) == 10
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "c.csv").write_text("")
    assert size > 11 or catalog_csv.read_catalog_csv(spark, str(empty)).count() == 0
