"""Delimited text over many blocks, archives and XML of any element; record keys of parts."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import compare
from vitalframe.sources import delimited, files


PLAIN = {"sep": ",", "quote": '"', "header": True}


@pytest.fixture
def small_blocks(spark):
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    yield lambda n: spark.conf.set(size, str(n))
    spark.conf.set(size, before)


def made(rnd, n):
    cell = lambda: "".join(rnd.choices(["a", "bc", ",", '"', "\n", " ", "é", "\n\n", "x" * 9], k=rnd.randrange(5)))
    return [[cell() or "e", cell(), cell()] for _ in range(n)]


def written(rows, header=("id", "b", "c")):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def test_line_ends_against_a_character_machine():
    def slowly(text):
        """Positions of line breaks that end a record, by the fields' grammar."""
        state, out = "start", []
        for c in text:
            if state == "quoted":
                state = "closing" if c == '"' else state
            elif state == "closing" and c == '"':
                state = "quoted"
            elif c == '"' and state == "start":
                state = "quoted"
            elif c in ",\n":
                out += [c == "\n"] if c == "\n" else []
                state = "start"
            else:
                state = "plain"
            if c == "\n" and state == "quoted":
                out.append(False)
        return out

    rnd = random.Random(9)
    for _ in range(3000):
        text = "".join(rnd.choices('ab,"\n', k=rnd.randrange(30))) + "\n"
        inside, got = False, []
        for line in text[:-1].split("\n"):
            inside = delimited.ends_inside(line, inside, ",", '"')
            got.append(not inside)
        assert got == slowly(text)


def test_csv_over_blocks(spark, tmp_path, small_blocks):
    rnd = random.Random(10)
    for k, block in enumerate((20, 64, 300, 1 << 20)):
        rows = made(rnd, 60)
        at = tmp_path / f"t{k}.csv"
        at.write_text(written(rows), encoding="utf-8", newline="")
        small_blocks(block)
        df = files.read_csv(spark, str(at), PLAIN)
        got = sorted(tuple("" if v is None else v for v in r) for r in df.collect())
        assert df.columns == ["id", "b", "c"] and got == sorted(map(tuple, rows))
        if block == 20:
            assert delimited.records(spark, str(at), ",", '"').rdd.getNumPartitions() > 4


def test_csv_rows_like_the_header_carriage_returns_and_nothing(spark, tmp_path, small_blocks):
    at = tmp_path / "t.csv"
    at.write_bytes('﻿id,note\r\n1,"a\r\nb"\r\n\r\nid,note\r\n2,\r\n3\r\n'.encode())
    for block in (8, 1 << 20):
        small_blocks(block)
        df = files.read_csv(spark, str(at), PLAIN)
        assert df.columns == ["id", "note"]
        got = {r["id"]: r["note"] for r in df.collect()}
        assert set(got) == {"1", "id", "2", "3"} and got["1"].replace("\r", "") == "a\nb" and got["3"] is None
    (tmp_path / "long.csv").write_text('"a\nlong\nheader",b\n1,2\n')
    small_blocks(4)
    df = files.read_csv(spark, str(tmp_path / "long.csv"), PLAIN)
    assert df.columns == ["a\nlong\nheader", "b"] and [tuple(r) for r in df.collect()] == [("1", "2")]
    (tmp_path / "empty.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "open.csv").write_text("a,b\n1,2\n3,\"never\nclosed\n4,5\n")
    small_blocks(6)
    assert sorted(tuple(r)[0] for r in files.read_csv(spark, str(tmp_path / "open.csv"), PLAIN).collect()) == ["1", "3"]


def test_csv_in_an_archive(spark, tmp_path):
    rows = [["1", "x\ny"], ["id", "note"], ["2", 'q"uote'], ["3", "a,b"]]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", written(rows, ("id", "note")))
    (data,) = files.open_files(spark, {"path": str(tmp_path / "t.zip"), **PLAIN})
    assert sorted(tuple(r) for r in data.frame.collect()) == sorted(map(tuple, rows))


def test_xml_of_any_element(spark, tmp_path):
    at = tmp_path / "t.xml"
    at.write_text('<?xml version="1.0"?><catalog><book id="1"><title>A</title></book><book id="2"><title>B</title></book></catalog>')
    got = files.read_xml(spark, str(at)).select("title", F.col("@attributes.id").alias("id")).collect()
    assert {(r["id"], r["title"]) for r in got} == {("1", "A"), ("2", "B")}
    assert files.read_xml(spark, str(at), {"root": "book"}).count() == 2
    (tmp_path / "bad.xml").write_text("no markup")
    with pytest.raises(ValueError):
        files.read_xml(spark, str(tmp_path / "bad.xml"))


def test_keys_of_several_parts_stay_apart(spark):
    schema = "a string, b string, v int"
    old = spark.createDataFrame([("x|y", "z", 1), (None, "n", 1), ("None", "n", 2), ("s", "s", 5)], schema)
    new = spark.createDataFrame([("x", "y|z", 1), (None, "n", 3), ("None", "n", 2), ("s", "s", 6)], schema)
    got = {(r["k"], r["kind"]) for r in compare.record_changes(old, new, ["a", "b"]).collect()}
    assert got == {('["x|y","z"]', "only_in_1"), ('["x","y|z"]', "only_in_2"), ('["n"]', "modified"), ('["s","s"]', "modified")} or got == {
        ('["x|y","z"]', "only_in_1"), ('["x","y|z"]', "only_in_2"), ('[null,"n"]', "modified"), ('["s","s"]', "modified"),
    }
