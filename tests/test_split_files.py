"""One file of many blocks against the readers that give a file to one task."""

import json
import random

import pytest

from tidemark.sources import readers, split_files

VALUES = ["plain", "a\nb", 'x "quoted" y\n\nz', " pad ", "", None, "a,b", "\r\n in", "tail\r", "\\", '"', "{}][", "é中\n\n"]


@pytest.fixture(autouse=True)
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def collected(df):
    return sorted(map(str, df.collect()))


def tasks(spark, path, separator):
    return split_files._pieces(spark, path, separator).rdd.getNumPartitions()


def test_csv_of_many_blocks(spark, tmp_path):
    pick = random.Random(1)
    rows = [(i, pick.choice(VALUES), pick.choice(VALUES), pick.random() if i % 7 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, a string, `b c` string, x double").coalesce(1)
    path = readers.write_version(df, str(tmp_path / "v.csv"))
    got = split_files.read_csv_split(spark, path)
    assert got.schema == readers.read_version(spark, path).schema and tasks(spark, path, "\n") > 5
    assert collected(got) == collected(readers.read_version(spark, path)) == collected(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" in plan and "SinglePartition" not in plan


def test_a_field_longer_than_blocks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,t\n1,"' + "line\n" * 20_000 + '"\n2,b\n\n3,""\n4,')
    path = str(tmp_path / "x.csv")
    got = {r["id"]: r["t"] for r in split_files.read_csv_split(spark, path).collect()}
    assert got == {1: "line\n" * 20_000, 2: "b", 3: "", 4: None} and tasks(spark, path, "\n") > 4


def test_line_ends_and_heads(spark, tmp_path):
    text = "id,t\r\n" + "".join(f'{i},"l{i}\r\nm"\r\n' if i % 3 else f"{i},k\r\n" for i in range(3000))
    (tmp_path / "c.csv").write_bytes(text.encode())
    assert collected(split_files.read_csv_split(spark, str(tmp_path / "c.csv"))) == collected(readers.read_version(spark, str(tmp_path / "c.csv")))
    (tmp_path / "h.csv").write_text('"a\nb",c\n1,2\n')
    got = split_files.read_csv_split(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["a\nb", "c"] and [tuple(r) for r in got.collect()] == [(1, 2)]
    (tmp_path / "none.csv").write_text("a,b\n")
    assert split_files.read_csv_split(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        split_files.read_csv_split(spark, str(tmp_path / "empty.csv"))


def test_malformed_csv_rows_are_set_aside(spark, tmp_path):
    lines = [f'{i},"l{i}\nm"' if i % 3 else f"{i},k,extra" if i % 5 == 0 else f"{i},z" for i in range(3000)]
    (tmp_path / "m.csv").write_text("id,t\n" + "\n".join(lines) + "\n")
    schema = spark.createDataFrame([], "id int, t string").schema
    good, bad = split_files.split_malformed_csv(spark, str(tmp_path / "m.csv"), schema)
    want_good, want_bad = readers.split_malformed(spark, str(tmp_path / "m.csv"), schema=schema)
    assert collected(good) == collected(want_good) and collected(bad) == collected(want_bad) and bad.count() == 200
    with pytest.raises(Exception, match="MALFORMED"):
        split_files.read_csv_split(spark, str(tmp_path / "m.csv"), schema).collect()
    (tmp_path / "open.csv").write_text('id,t\n1,a\n2,"open\n3,b\n')
    _, bad = split_files.split_malformed_csv(spark, str(tmp_path / "open.csv"), schema)
    assert [r[readers.CORRUPT] for r in bad.collect()] == ['2,"open\n3,b\n'.rstrip("\n")]
    with pytest.raises(Exception, match="Quotes without end"):
        split_files.read_csv_split(spark, str(tmp_path / "open.csv"), schema).collect()


TEXTS = ["a", "}{][", 'q"uo\\te', "n\nl", "", None, 'é\\"}', "\\\\"]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_of_many_blocks(spark, tmp_path, indent):
    pick = random.Random(2)
    rows = [{"id": i, "t": pick.choice(TEXTS), "o": {"k": [{"z": str(i)}, {"z": pick.choice(TEXTS)}], "m": {"n": 1}} if i % 3 else None, "x": i / 7} for i in range(3000)]
    path = tmp_path / "x.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(indent)))
    got = split_files.read_json_split(spark, str(path))
    want = readers.read_version(spark, str(path))
    assert got.schema == want.schema and collected(got) == collected(want) and tasks(spark, str(path), "}") > 5


@pytest.mark.parametrize("text", ["[]", " [ ]\n", '{"id": 1, "v": {"a":2}}', '[{"id": 1}]', '[\n {"id": 1},{"id": 2}\n]\n', '[{"id": 1, "v": []}, {}]'])
def test_small_json(spark, tmp_path, text):
    (tmp_path / "s.json").write_text(text)
    schema = spark.createDataFrame([], "id bigint, v string").schema
    assert collected(split_files.read_json_split(spark, str(tmp_path / "s.json"), schema)) == collected(readers.read_version(spark, str(tmp_path / "s.json"), schema=schema))


def test_malformed_json_elements_are_set_aside(spark, tmp_path):
    (tmp_path / "m.json").write_text("[" + ",".join('{"id": "x%d"}' % i if i % 100 == 7 else '{"id": %d}' % i for i in range(1000)) + "]")
    schema = spark.createDataFrame([], "id bigint").schema
    good, bad = split_files.split_malformed_json(spark, str(tmp_path / "m.json"), schema)
    assert good.count() == 990 and [r[readers.CORRUPT] for r in bad.orderBy(readers.CORRUPT).limit(1).collect()] == ['{"id": "x107"}']
    for text in ('[{"id": 1}, {"id": 2', '[{"id": 1}', '[{"id": 1},', '{"id": 1', '[{"id": "1}]'):
        (tmp_path / "cut.json").write_text(text)
        with pytest.raises(Exception, match="MALFORMED"):
            split_files.read_json_split(spark, str(tmp_path / "cut.json"), schema).collect()
