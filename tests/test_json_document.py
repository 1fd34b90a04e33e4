"""JSON documents cut into records over many blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vitalframe.sources import files, json_document


@pytest.fixture
def small_blocks(spark):
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    yield lambda n: spark.conf.set(size, str(n))
    spark.conf.set(size, before)


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rnd.choices(['"', "\\", ",", "{", "]", "é", "\n", "x", ":", "\\\"", " "], k=rnd.randrange(9)))
    if kind == 2:
        return rnd.choice([None, True, 7, -2.5])
    if kind == 3:
        return "y" * rnd.randrange(60)
    if kind == 4:
        return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(["a", "b,c", "data", 'q"', "d:e", "x"]): value(rnd, depth + 1) for _ in range(rnd.randrange(4))}


def read(spark, path, root=None):
    rows = files.read_json(spark, str(path), {"root": root}).select(F.to_json("v").alias("t")).collect()
    return sorted(json.dumps(json.loads(r["t"]), sort_keys=True) for r in rows)


def wanted(doc, root=None):
    for part in (root or "").split("."):
        if part:
            doc = doc.get(part, Ellipsis) if isinstance(doc, dict) else Ellipsis
    rows = [] if doc is Ellipsis else doc if isinstance(doc, list) else [doc]
    return sorted(json.dumps(r if isinstance(r, dict) else {"value": r}, sort_keys=True) for r in rows)


def test_marks_against_a_character_machine():
    rnd = random.Random(3)
    for _ in range(500):
        data = json.dumps([value(rnd) for _ in range(3)], ensure_ascii=False).encode()
        inside = escaped = False
        level, want = 0, []
        for c in data:
            if inside:
                inside, escaped = c != 34 or escaped, c == 92 and not escaped
            else:
                inside = c == 34
                level += (c in b"{[") - (c in b"}]")
            want.append((not inside, level))
        _, outside, levels = json_document.marks(data, False, 0)
        assert list(zip(outside.tolist(), levels.tolist(), strict=True)) == want


@pytest.mark.parametrize("block", [31, 400, 1 << 20])
def test_records_of_an_array_over_blocks(spark, tmp_path, small_blocks, block):
    small_blocks(block)
    rnd = random.Random(block)
    for i, kind in enumerate(("array", "indented", "deep", "late")):
        rows = [value(rnd) for _ in range(25)]
        doc = rows if kind in ("array", "indented") else {"n": rnd.random(), "b,c": {"data": ["no", "x"]}, "meta": {"data": rows, "x": [1]}, "tail": {"data": [8, 9], "k": "]" * 40}}
        path = tmp_path / f"{i}_{block}.json"
        path.write_text(json.dumps(doc, ensure_ascii=kind == "late", indent=2 if kind == "indented" else None), encoding="utf-8")
        root = None if isinstance(doc, list) else "meta.data"
        assert read(spark, path, root) == wanted(doc, root), kind


CASES = [
    ("[]", None), ("[ \n ]", None), ("{}", None), ('{"a": 1, "b": [1, 2]}', None), ('"a, b"', None), ("7", None), ('{"a": []}', "a"), ('{"a": {"b": 3, "c": 4}, "d": 5}', "a"),
    ('{"a": "x, y", "b": 2}', "a"), ('{"b": 2, "a": null}', "a"), ('{"b": 2}', "a"), ("[1, 2]", "a"), ('{"a": {}, "b": {"x": [1, 2, 3], "y": "' + "z" * 80 + '"}}', "a.x"),
    ('{"a": [1, 2], "b": [3, [4, 5], {"c": [6, 7]}, ' + "8, " * 40 + "9]}", "a"), ('{"a": 1, "a": [2, 3]}', "a"), ("[[1, 2], [], [[3]], {}]", None), ('{"\\u0061": [1, 2]}', "a"),
    ('{"x": [{"a": [9]}, {"a": [8]}], "a": [1]}', "a"),
]


@pytest.mark.parametrize("block", [17, 1 << 20])
def test_small_documents(spark, tmp_path, small_blocks, block):
    small_blocks(block)
    for i, (text, root) in enumerate(CASES):
        for j, start in enumerate(("", "\ufeff \n")):
            path = tmp_path / f"{i}_{j}.json"
            path.write_text(start + text + "\n" * j, encoding="utf-8")
            assert read(spark, path, root) == wanted(json.loads(text), root), (text, root)


@pytest.mark.parametrize("text", ["", " \n", "[1, 2", '[1, "2]', "[1,]", "[1,,2]", "[1, 2] [3, 4]", '[{"a": 1}, {"b" 2}]', "[1, 2], 3"])
def test_damaged_documents_fail(spark, tmp_path, small_blocks, text):
    small_blocks(9)
    path = tmp_path / "d.json"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017
        read(spark, path)


def test_many_tasks_read_one_line(spark, tmp_path, small_blocks):
    small_blocks(1 << 14)
    path = tmp_path / "long.json"
    rows = [{"id": i, "t": "w" * 50} for i in range(4000)]
    path.write_text(json.dumps(rows), encoding="utf-8")  # a single line
    v = files.read_json(spark, str(path))
    assert v.count() == 4000 and v.select(F.spark_partition_id()).distinct().count() > 8
