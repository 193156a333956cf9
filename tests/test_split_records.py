"""One CSV or JSON file cut into splits of any size equals the same file read by one task."""

import json
import random
import time
from pathlib import Path

import pytest

from attestor import schemas
from attestor.session import CLEANUP_CONF, shared_dir
from attestor.sources import split_records as S
from attestor.sources import tables

TEXTS = ["", "plain", "a,b", 'say "hi"', "two\nlines", '"', '""', "\n", "\n\n", 'x"\n"y', "tail\r\nmore", "é ü 日本", " padded ", "{}", '\\"', "end\\"]


@pytest.fixture
def splits(spark):
    """``splits(bytes)`` sets the size of a split; it is reset afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def make(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield make
    for n, v in before.items():
        spark.conf.set(n, v)


def csv_of(rows, end="\n"):
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    return end.join(",".join(map(quoted, r)) for r in [("id", "text", "more"), *rows]) + end


@pytest.mark.parametrize("seed, end, sizes", [(1, "\n", (1, 7, 64)), (2, "\r\n", (5, 33)), (3, "\n", (3, 16, 10**6))])
def test_csv_in_splits_of_any_size(spark, tmp_path, splits, seed, end, sizes):
    rng = random.Random(seed)
    rows = [(str(i), rng.choice(TEXTS) + rng.choice(TEXTS), rng.choice(TEXTS)) for i in range(6)]
    path = tmp_path / "log.csv"
    path.write_bytes(csv_of(rows, end).encode())
    plain = spark.read.options(**tables.CSV_OPTIONS).csv(str(path)).fillna("").collect()
    # One task reads these rows; where lines end in CR LF, it makes line feeds of those in fields, too.
    fold = (lambda v: v.replace("\r\n", "\n")) if end == "\r\n" else str
    rows = sorted(tuple(map(fold, r)) for r in rows)
    assert sorted(map(tuple, plain)) == rows
    for size in sizes:
        splits(size)
        got = tables.read_text_table(spark, str(path), ["id", "text", "more", "extra"]).collect()
        assert sorted(tuple(map(fold, r))[:3] for r in got) == rows and {r.extra for r in got} == {""}


def test_csv_files_blank_lines_and_short_records(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text('id,text,more\n1,"x\ny",z\n\n2,only\n3,a,b,c\n')
    (tmp_path / "b.csv").write_text('id,text,more\n4,"last, without end","q')
    splits(6)
    got = sorted(map(tuple, tables.read_text_table(spark, str(tmp_path), ["id"]).collect()))
    assert got == [("1", "x\ny", "z"), ("2", "only", ""), ("3", "a", "b"), ("4", "last, without end", "q")]


def test_states_beyond_the_limit_are_sorted_instead(spark, tmp_path, splits):
    rows = [(str(i), TEXTS[i % len(TEXTS)], "x") for i in range(40)]
    (tmp_path / "log.csv").write_bytes(csv_of(rows).encode())
    splits(20)
    few = S.split_records(spark, str(tmp_path / "log.csv"), "\n", S.csv_quotes, most_splits=1)
    many = S.split_records(spark, str(tmp_path / "log.csv"), "\n", S.csv_quotes)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 41


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_in_splits_of_any_size(spark, tmp_path, splits, indent):
    rows = [{"pair_id": f"N{i}", "nct_id": TEXTS[i % len(TEXTS)], "pmid": None, "hr": i / 8, "source_reference": TEXTS[-1 - i % len(TEXTS)] + "}{"} for i in range(8)]
    path = tmp_path / "effects.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    want = sorted(map(tuple, spark.read.schema(schemas.EFFECT_SCHEMA).json(str(path), multiLine=True).collect()), key=str)
    assert len(want) == 8
    for size in (5, 64, 10**6):
        splits(size)
        assert sorted(map(tuple, tables.read_effects(spark, str(path), multi_line=True).collect()), key=str) == want


def test_written_arrays_are_json(spark, tmp_path):
    row = ("p", "n", None, 0.8, 0.6, 1.1, -0.2231, 0.15, 0.02, "hr_paren_ci", 'quoted "text"\n}', "2020-01-01")
    df = spark.createDataFrame([row, row], schemas.EFFECT_SCHEMA)
    for n, some in ((2, df), (0, df.limit(0))):
        tables.write_effect_array(some, str(tmp_path / f"out{n}"))
        (file,) = (tmp_path / f"out{n}").glob("part-*")
        assert [tuple(r.values()) for r in json.loads(file.read_text())] == [row] * n
        assert [tuple(r) for r in tables.read_effects(spark, str(tmp_path / f"out{n}"), multi_line=True).collect()] == [row] * n


def test_large_arrays_are_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ARRAY_ROWS", 3)
    rows = [(f"p{i % 40:02d}", "n", None, 0.8, 0.6, 1.1, -0.2231, 0.15, 0.02, "hr_paren_ci", f'"{i}"\n}}', "2020-01-01") for i in range(90)]
    tables.write_effect_array(spark.createDataFrame(rows, schemas.EFFECT_SCHEMA).repartition(4), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    assert sorted(tuple(r.values()) for r in json.loads(file.read_text())) == sorted(rows)
    lines = [line.removeprefix(",") for line in file.read_text().splitlines()]
    assert (lines[0], lines[-1]) == ("[", "]") and lines[1:-1] == sorted(lines[1:-1])


def test_arrays_leave_nothing_else_on_disk(spark, tmp_path):
    """The staged rows, the sorted parts and the shuffles go; the array alone is larger than its table."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    def below(folder):
        return {str(f) for f in Path(folder).rglob("*") if f.is_file()}

    shared = shared_dir(spark).removeprefix("file:")
    rows = [(f"p{i:04d}", "n", None, 0.8, 0.6, 1.1, -0.2231, 0.15, 0.02, "hr_paren_ci", "é — \r\n", "2020-01-01") for i in range(3000)]
    df = spark.createDataFrame(rows, schemas.EFFECT_SCHEMA).repartition(4)
    spark.sparkContext._jvm.System.gc()
    cleanup = spark.conf.get(CLEANUP_CONF)
    files, shuffled = below(shared), shuffles()
    tables.write_effect_array(df, str(tmp_path / "out"))
    assert below(shared) <= files and spark.conf.get(CLEANUP_CONF) == cleanup
    until = time.time() + 30
    while (left := shuffles() - shuffled) and time.time() < until:
        time.sleep(0.2)
    assert not left
    (file,) = (tmp_path / "out").glob("part-*")
    assert [tuple(r.values()) for r in json.loads(file.read_text())] == rows
