"""Results that small tables did not show."""

from pyspark.sql import functions as F


def test_all_performers_who_share_a_maker(spark):
    from colophon.operators.related import performers_sharing

    rows = [(f"p{i:02}", "m", 1, True) for i in range(45)]
    works = spark.createDataFrame(rows, "performer string, maker string, popularity long, is_published boolean")
    assert performers_sharing(works, "p00", "maker", None).count() == 44
    assert performers_sharing(works, "p00", "maker").count() == 8


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    from colophon.streaming import jobs

    df = spark.range(20).withColumn("ts", F.lit("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in" / "events.parquet"))
    single = tmp_path / "single" / "events.parquet"
    single.parent.mkdir()
    part = next((tmp_path / "in" / "events.parquet").glob("part-*"))
    single.write_bytes(part.read_bytes())
    counts = []
    for folder in ("in", "single"):
        out = str(tmp_path / f"out-{folder}")
        stream = jobs.read_table_stream(spark, f"{tmp_path}/{folder}/events.parquet", df.schema)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start(out).awaitTermination()
        counts.append(spark.read.parquet(out).count())
    assert counts == [20, spark.read.parquet(str(part)).count()]


def test_changed_ranges_where_a_row_takes_the_id_of_one_that_went(spark, tmp_path):
    from colophon.plans import intake
    from colophon.plans.bindings import Tables

    # ``gone + 1000000`` goes, and ``gone`` comes again under that id with the same price
    gone = next(k for k in range(1, 10**6) if k % 211 == 0 and (k + 1000000) % 151 == 0 and k % 97 and k % 151)
    rows = [(k, "red bolt", "Brand#1", "BOLT", 1, 5.0) for k in (151, gone, gone + 1000000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["range"] for r in intake.changed_ranges(Tables(spark, str(tmp_path))).collect()}
    assert got == {15}


def test_manifest_digest_of_two_steps(spark):
    import hashlib

    from colophon.operators import frontier

    codes = [f"c{i}" for i in range(53)]
    rows = spark.createDataFrame(list(enumerate(codes)), "at long, code string").withColumn("payload", F.lit("h")).repartition(5)
    got = frontier.manifest_digest(rows, [("at", "asc")], "code", "payload", fan=3, steps=2).first()
    sha = lambda lines: hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()
    assert got.rows == 53 and got.membership_sha256 == sha([sha(codes[k : k + 3]) for k in range(0, 53, 3)])


def test_derived_candidates_are_never_broadcast(spark):
    import __spark_entry__ as entry

    for name in ("J3_decide_image", "J4_rank_labelled", "J6_candidate_records", "J10_apply_stage", "J11_review_sheet_class", "E19_candidate_summary", "J2_classify"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan, name


def test_sheet_class_of_types_without_a_candidate(spark):
    from colophon.operators import images

    flags = "struct(false body, false face, false plain, false cut, false side_band, false dense, false jacket) flags, struct(0 body_part, 0 face_only, 0 scene_photo) parts"
    scored = spark.sql(f"select 'c' code, id candidate_id, if(id = 1, 'dvd_full', 'dvd_right') type, cast(100 - id * 30 as int) score, false excluded, false review, array('x') reasons, {flags} from range(1, 3)")
    decided = spark.createDataFrame([("c", "dvd_full", 90, 10, 40), ("c", "needs_review", 90, 10, 40), ("d", None, None, None, None)], "code string, next_type string, next_score int, current_score int, gain int")
    got = {(r.code, r.next_type): r.sheet_class for r in images.review_sheet_class(decided, scored).collect()}
    assert got == {("c", "dvd_full"): "A", ("c", "needs_review"): "A", ("d", None): "C"}


def test_visitors_meet_no_broadcast_table(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["G4_recommend_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_pairs_of_related_works_are_not_shuffled(spark):
    import re

    import __spark_entry__ as entry

    plan = entry.queries()["G5_related_works"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*related_id", plan) and "hashpartitioning(work_id" in plan


def test_pages_and_posts_are_made_in_many_tasks(spark, monkeypatch):
    from colophon.plans import bindings, page_jobs

    monkeypatch.setattr(bindings, "ROWS_A_TASK", 10, raising=False)
    t = bindings.Tables(spark, "/root/testdata/sf0.001")
    customers, orders = (-(-t.raw(name).count() // 10) for name in ("customer", "orders"))
    assert page_jobs._marked_pages(t).rdd.getNumPartitions() == customers
    assert page_jobs.site_pages(t).rdd.getNumPartitions() == customers + orders


def test_a_report_makes_the_works_once(spark, monkeypatch):
    from colophon.plans import bindings, feed

    made = []
    works = bindings.Tables.works
    monkeypatch.setattr(bindings.Tables, "works", lambda self, *columns: made.append(columns) or works(self, *columns))
    assert feed.report(bindings.Tables(spark, "/root/testdata/sf0.001")).count() == 1
    assert len(made) == 1


def test_bundle_posts_are_made_in_many_tasks_of_orders_alone(spark, monkeypatch):
    from colophon.plans import bindings, second_source

    monkeypatch.setattr(bindings, "ROWS_A_TASK", 100, raising=False)
    t = bindings.Tables(spark, "/root/testdata/sf0.001")
    once = t.posts().count()
    rows = second_source.bundle_posts(t)
    assert rows.rdd.getNumPartitions() == 2 * -(-once // 100)
    assert "customer.parquet" not in "".join(rows.inputFiles())
