"""Multi-line CSV in many tasks against Spark's own one-task read of the same file."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.sources import applicants as ap
from sievework.sources import csv_records as cr


@pytest.fixture
def small_splits(spark):
    """Files are cut every 150 bytes; the setting is gone before the rows are read."""
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "150b")
    yield lambda: spark.conf.set(name, old)
    spark.conf.set(name, old)


def one_task(spark, path, names):
    schema = ", ".join(f"`{n}` string" for n in (*names, ap.CORRUPT))
    rows = spark.read.schema(schema).csv(
        str(path), header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).withColumn("n", F.monotonically_increasing_id()).orderBy("n")
    return [tuple(r)[:len(names)] for r in rows.collect()]


def value(rng):
    kind = rng.random()
    text = "".join(rng.choices(["a", "bc", ",", "\n", '""', " ", "é", "\n\n", "x,y"], k=rng.randint(0, 12)))
    if kind < 0.6:
        return f'"{text}"'
    plain = text.replace("\n", "").replace('""', "").replace(",", "")
    return plain + rng.choice(["", "", 'q"q', '5" pipe']) if plain else plain


def file_text(seed, rows, end="\n"):
    rng = random.Random(seed)
    lines = ["c1,c2,c3"]
    for _ in range(rows):
        lines.append(",".join(value(rng) for _ in range(3)))
        if rng.random() < 0.05:
            lines.append("")
    return (end.join(lines) + (end if seed % 2 else "")).replace("\n", end if end != "\n" else "\n")


@pytest.mark.parametrize("seed", range(4))
def test_rows_equal_a_one_task_read(spark, tmp_path, small_splits, seed):
    path = tmp_path / "f.csv"
    path.write_text(file_text(seed, 150), newline="")
    raw = ap.scan_csv(spark, str(path))
    small_splits()
    got = [tuple(r) for r in raw.orderBy("row_id").select("c1", "c2", "c3").collect()]
    assert got == one_task(spark, path, ["c1", "c2", "c3"])
    assert [r.row_id for r in raw.select("row_id").orderBy("row_id").collect()] == list(range(len(got)))


def test_a_value_of_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {k}, ""quoted""' for k in range(400))
    path = tmp_path / "f.csv"
    path.write_text(f'id,text\n1,"{long}"\n2,"a\nb"\n\n3,"{long}"\n4,x')
    raw = ap.scan_csv(spark, str(path))
    splits = cr.pinned_lines(spark, str(path)).select("split").distinct().count()
    small_splits()
    assert splits > 20
    rows = [tuple(r) for r in raw.orderBy("row_id").select("row_id", "id", "text").collect()]
    want = long.replace('""', '"')
    assert rows == [(0, "1", want), (1, "2", "a\nb"), (2, "3", want), (3, "4", "x")]


def test_line_ends_headers_and_empty_files(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('﻿id,"a ""b""\nc",,id\r\n1,"x\r\ny",z,4\r\n\r\n2,u,v,w\r\n', newline="")
    (tmp_path / "b.csv").write_text("id1,new\n9,8")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("id1,new\n")
    raw = ap.scan_csv(spark, str(tmp_path))
    assert raw.columns[:4] == ["id0", 'a "b"\nc', "_c2", "id3"]
    rows = [tuple(r) for r in raw.orderBy("row_id").select("row_id", "id0", raw.columns[1], "`_c2`", "id3", "id1", "new").collect()]
    assert rows == [(0, "1", "x\r\ny", "z", "4", None, None), (1, "2", "u", "v", "w", None, None),
                    (2, None, None, None, None, "9", "8")]


def test_states_of_lines():
    for line, outside, inside in [
            (b"", False, True), (b"a,b", False, True), (b'"a', True, False), (b'a,"b', True, False), (b'a"b', False, False),
            (b'"a"",b', True, False), (b'"a""",b', False, False), (b'x",y,"', True, True), (b'"a"b"c,"d', True, True),
            (b'""', False, True), (b'"', True, False)]:
        assert (cr.open_after(line, False), cr.open_after(line, True)) == (outside, inside), line


def test_quotes_are_left_alone_without_multi_line(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    path.write_text("a,b\n" + '1,"x\n' + "2,y\n" * 100)
    raw = ap.scan_csv(spark, str(path), multi_line=False)
    small_splits()
    assert raw.count() == 101 and raw.filter("a = '2'").count() == 100
