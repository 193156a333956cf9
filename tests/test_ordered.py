"""Running totals, medians and top rows: the split path equals the plain one."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attestor.operators import ordered, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, many equal dates."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else rng.choice([f"g{j}" for j in range(20)] + [None]), rng.randint(1, 5), i, float(rng.randint(1, 9))) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, day int, id int, v double"), rows


@pytest.mark.parametrize("limit", [None, 1, 17])
def test_running_totals(skewed, limit):
    df, rows = skewed
    out = ordered.running_totals(df, ["g"], ["day", "id"], {"total": F.col("v"), "no": F.lit(1)}, limit)
    totals, want = defaultdict(lambda: (0.0, 0)), {}
    for g, day, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        totals[g] = (totals[g][0] + v, totals[g][1] + 1)
        want[i] = totals[g]
    assert {r["id"]: (r["total"], r["no"]) for r in out.collect()} == want
    assert out.columns == ["g", "day", "id", "v", "total", "no"]


@pytest.mark.parametrize("limit", [None, 1, 17])
def test_running_totals_of_one_whole_table(skewed, limit):
    df, rows = skewed
    out = ordered.running_totals(df, [], ["day", "id"], {"no": F.lit(1)}, limit)
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert {r["id"]: r["no"] for r in out.collect()} == want


@pytest.mark.parametrize("limit", [None, 3])
def test_median(skewed, limit):
    df, rows = skewed
    by = defaultdict(list)
    for g, _, _, v in rows:
        by[g].append(v)
    got = {r["g"]: r["median"] for r in ordered.grouped_median(df, ["g"], "v", parts=limit).collect()}
    assert got == {g: statistics.median(vs) for g, vs in by.items()}


def test_median_of_whole_table(skewed):
    df, rows = skewed
    assert ordered.grouped_median(df, [], "v").first()["median"] == statistics.median(r[3] for r in rows)


def test_keep_latest_and_top_rows(frame):
    df = frame("k string, ts int, v string", [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)])
    assert sorted(tuple(r) for r in ordered.keep_latest(df, ["k"], ["ts"]).collect()) == [("a", 2, "y"), ("b", 1, None)]
    top = ordered.top_rows(df, ["k"], [F.desc("ts")], 1).collect()
    assert sorted((r["k"], r["ts"]) for r in top) == [("a", 2), ("b", 1)]


def test_keep_latest_by_time_and_number(spark):
    import datetime as dt

    t = dt.datetime(1969, 3, 30, 2, 30, 0, 7)
    rows = [("a", t, 5, "x"), ("a", t, -(2**63), "y"), ("a", t - dt.timedelta(microseconds=1), 9, "z"), ("b", None, 1, "n"), ("b", None, 2, "m"), (None, t, None, "k"), (None, t, 0, "l")]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, f"k string, ts {kind}, id long, v string")
        assert sorted((str(r["k"]), r["v"]) for r in ordered.keep_latest(df, ["k"], ["ts", "id"]).collect()) == [("None", "l"), ("a", "x"), ("b", "m")]
    # Rows that tie in the order are told apart by their values, equal rows are one.
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y")], "k string, n int, v string")
    got = {ordered.keep_latest(df.repartition(p), ["k"], ["n"]).first()["v"] for p in (1, 2, 3)}
    assert len(got) == 1 and ordered.keep_latest(df, ["k"], ["n"]).count() == 1
    # An order by text is combined with the row.
    assert ordered.keep_latest(df, ["k"], ["v"]).first()["v"] == "y"


def test_histogram_covers_all_numbers(frame):
    df = frame("v string", [(str(i / 10),) for i in range(11)] + [("abc",), ("",)])
    got = ordered.histogram(df, "v", 5)
    assert sum(r["n"] for r in got.collect()) == 11
    assert {r["bin"] for r in got.collect()} <= set(range(5))


@pytest.mark.parametrize("edge_keys", [4096, 2])
def test_stable_share_is_the_head_of_the_hash_order(spark, edge_keys, monkeypatch):
    import hashlib

    keys = [f"NCT{i:05d}_1" for i in range(9000)]
    df = spark.createDataFrame([(k,) for k in keys], "pair_id string")
    order = sorted(keys, key=lambda k: (hashlib.sha256(k.encode()).hexdigest()[:16], k))
    monkeypatch.setattr(sampling, "EDGE_KEYS", edge_keys)
    for n in (0, 1, 900, 8999, 9000, 10_000):
        got = {r[0] for r in sampling.stable_share(df, lambda _: n).collect()}
        assert got == set(order[:n])


def test_stable_share_counts_copies(frame):
    df = frame("pair_id string", [("a",)] * 5 + [("b",)] * 5 + [("c",)])
    for n in range(12):
        got = {r[0] for r in sampling.stable_share(df, lambda _: n).collect()}
        import hashlib

        order = sorted(["a"] * 5 + ["b"] * 5 + ["c"], key=lambda k: hashlib.sha256(k.encode()).hexdigest()[:16])
        assert got == set(order[:n])


def test_whole_sort_grows_in_tasks_not_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SORTED_ROWS", 50)
    rows = [(None if i % 3 else i % 7, i) for i in range(2000)]
    df = ordered.in_order(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"])
    parts = df.rdd.glom().map(len).collect()
    assert len(parts) == 40 and max(parts) < 400  # two rows in three have the same key
    assert [tuple(r) for r in df.collect()] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
