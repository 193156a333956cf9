"""Stage tables in buckets: what an upsert touches and what it leaves alone."""

from attestor.sources import stage_tables as B

ROWS = "nct_id string, pmid string, score int"


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.glob("bucket=*/*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = tmp_path / "matches"
    rows = [(f"N{i}", str(i % 3), i) for i in range(200)] + [(None, "x", 1), (None, None, 2)]
    B.write_buckets(spark.createDataFrame(rows, ROWS), str(path), ["nct_id", "pmid"], 32)
    before = files(path)
    updates = [("N7", "1", 700), ("N300", "0", 300), (None, None, 20)]
    touched = B.upsert_buckets(spark.createDataFrame(updates, ROWS), str(path), ["nct_id", "pmid"], 32)
    assert 1 <= len(touched) <= 3
    want = {r[:2]: r[2] for r in rows} | {r[:2]: r[2] for r in updates}
    assert sorted(((r.nct_id, r.pmid), r.score) for r in B.read_buckets(spark, str(path)).collect() if r.nct_id and r.pmid) == sorted((k, v) for k, v in want.items() if None not in k)
    got = B.read_buckets(spark, str(path))
    assert got.count() == len(want) and got.filter("nct_id IS NULL AND pmid IS NULL").first().score == 20
    after = files(path)
    kept = {f: t for f, t in before.items() if int(f.split("/")[0].split("=")[1]) not in touched}
    assert kept and kept.items() <= after.items() and after != before
    assert {r.nct_id for r in B.read_buckets(spark, str(path), touched).collect()} >= {"N7", "N300"}
    assert B.upsert_buckets(spark.createDataFrame([], ROWS), str(path), ["nct_id", "pmid"], 32) == [] and files(path) == after


def test_old_rows_are_not_shuffled_for_few_updates(spark, tmp_path):
    path = str(tmp_path / "matches")
    B.write_buckets(spark.range(1000).selectExpr("cast(id AS string) AS nct_id", "cast(id AS int) AS score"), path, ["nct_id"], 8)
    named = spark.createDataFrame([("5", 50)], "nct_id string, score int").withColumn(B.BUCKET, B.bucket_of(["nct_id"], 8))
    named.write.parquet(str(tmp_path / "updates"))
    updates = spark.read.parquet(str(tmp_path / "updates"))
    touched = [r[0] for r in updates.select(B.BUCKET).distinct().collect()]
    plan = B.staying(spark.read.parquet(path), updates, ["nct_id"], touched)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_resume(spark, tmp_path):
    path = str(tmp_path / "done")
    B.write_buckets(spark.createDataFrame([("a", "1", 1)], ROWS), path, ["nct_id"], 4)
    todo = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], ROWS)
    assert [r.nct_id for r in B.not_yet(todo, path, ["nct_id"]).collect()] == ["b"]
