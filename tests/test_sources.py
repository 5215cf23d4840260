import hashlib

import pytest

from tidemark.sources import fingerprints, readers, store

T10 = '[{"id": 1, "product": "a", "price": 10},\n {"id": 2, "product": "b", "price": 20}]'


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_types_and_empty_fields(spark, tmp_path, rows):
    path = write(tmp_path, "sample.csv", "customer_id,revenue,country\n1,10.5,US\n2,,US\n3,30.0,UK\n")
    df = readers.read_version(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "double", "string"]
    assert rows(df, "customer_id", "revenue") == [(1, 10.5), (2, None), (3, 30.0)]


def test_csv_returns_what_was_written(spark, tmp_path):
    rows = [(1, 'a\n"b",c'), (2, " a "), (3, ""), (4, None), (5, "\t\r\nx"), (6, '"'), (7, "\\"), (8, "\\\""), (9, " "), (10, "#x"), (11, ",")]
    df = spark.createDataFrame(rows, "id int, t string")
    path = readers.write_version(df, str(tmp_path / "v.csv"))
    assert sorted(tuple(r) for r in readers.read_version(spark, path, schema=df.schema).collect()) == rows
    assert sorted(tuple(r) for r in readers.read_version(spark, path).collect()) == rows
    one = spark.createDataFrame([("a\nb",), ("c",), ("",)], "t string")
    path = readers.write_version(one, str(tmp_path / "one.csv"))
    assert sorted(r["t"] for r in readers.read_version(spark, path).collect()) == ["", "a\nb", "c"]
    with pytest.raises(ValueError):
        readers.write_version(spark.createDataFrame([(None,)], "t string"), str(tmp_path / "null.csv"))


@pytest.mark.parametrize("text", ["a,b\n1,2", "a\n1"])
def test_csv_without_final_newline(spark, tmp_path, text):
    assert readers.read_version(spark, write(tmp_path, "x.csv", text)).count() == 1


@pytest.mark.parametrize("text", [T10, T10.replace("\n", "")])
def test_json_array_on_one_or_more_lines(spark, tmp_path, text, rows):
    df = readers.read_version(spark, write(tmp_path, "x.json", text))
    assert rows(df, "id", "product") == [(1, "a"), (2, "b")]


def test_ndjson(spark, tmp_path):
    path = write(tmp_path, "x.ndjson", '{"id": 1, "log": "a"}\n{"id": 2, "log": "b"}\n{"id": 3, "log": "c"}\n')
    assert readers.read_version(spark, path).count() == 3


def test_unknown_format():
    with pytest.raises(ValueError, match="Unsupported format"):
        readers.format_of("x.xlsx")


def test_malformed_row_is_refused_not_cut(spark, tmp_path):
    path = write(tmp_path, "bad.csv", "id,name\n1,Alice\n2,Bob,extra\n")
    with pytest.raises(ValueError, match="Malformed dataset file"):
        readers.require_wellformed(spark, path)
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_version(spark, path).collect()
    good, bad = readers.split_malformed(spark, path)
    assert good.count() == 1
    assert [r[readers.CORRUPT] for r in bad.collect()] == ["2,Bob,extra"]


def test_malformed_is_found_whatever_is_selected(spark, tmp_path):
    path = write(tmp_path, "bad.csv", "id,name\n1,Alice\n2,Bob,extra\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_version(spark, path).select("id").collect()


def test_size_cap(spark, tmp_path):
    path = write(tmp_path, "x.csv", "a\n" + "1\n" * 100)
    readers.require_size(spark, path, 1000)
    with pytest.raises(ValueError, match="maximum size"):
        readers.read_version(spark, path, max_bytes=100)
    assert readers.oversize_files(spark, str(tmp_path), 100).count() == 1


def test_versions_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "v1.parquet")
    readers.write_version(spark.range(3), path)
    with pytest.raises(Exception, match="already exists"):
        readers.write_version(spark.range(4), path)
    assert readers.read_version(spark, path).count() == 3


def test_schema_fingerprint_ignores_column_order(spark):
    a = fingerprints.schema_rows(spark.createDataFrame([], "id bigint, val string"), "a")
    b = fingerprints.schema_rows(spark.createDataFrame([], "val string, id bigint"), "b")
    got = {r["dataset_id"]: r["schema_fingerprint"] for r in fingerprints.schema_fingerprint(a.unionByName(b)).collect()}
    assert got["a"] == got["b"] == hashlib.sha256(b"id:BIGINTval:VARCHAR").hexdigest()[:16]


def test_file_hash(spark, tmp_path):
    path = write(tmp_path, "x.csv", "a\n1\n")
    row = fingerprints.file_hashes(spark, path).first()
    assert (row["length"], row["sha256"]) == (4, hashlib.sha256(b"a\n1\n").hexdigest())
    assert fingerprints.file_hashes(spark, path, whole_bytes=1).first()["sha256"] == row["sha256"]


def test_file_fingerprint_by_value(spark, tmp_path):
    import os

    path = write(tmp_path, "x.csv", "a\n1\n")
    row = fingerprints.file_fingerprints(spark, path, "schema").first()
    micros = os.stat(path).st_mtime_ns // 1_000_000 * 1000  # Spark lists times in milliseconds
    want = hashlib.sha256(f"{row['path']}_4_{micros}_schema".encode()).hexdigest()[:16]
    assert row["fingerprint"] == want


def test_content_hash_sees_values_and_nulls_but_not_order(spark):
    def h(values):
        return fingerprints.content_hash(spark.createDataFrame(values, "a int, b int")).first()["content_hash"]

    assert h([(1, None), (2, 3)]) == h([(2, 3), (1, None)])
    assert h([(1, None), (2, 3)]) != h([(None, 1), (2, 3)])
    assert h([(1, 2)]) != h([(1, 2), (1, 2)])


def test_registry_keeps_newest_row(spark, tmp_path, rows):
    root = str(tmp_path)
    store.append(spark.createDataFrame([("i1", "OPEN", 1), ("i2", "OPEN", 1)], "id string, status string, rev int"), root, "inv")
    store.append(spark.createDataFrame([("i1", "RESOLVED", 2)], "id string, status string, rev int"), root, "inv")
    out = store.current(store.read_table(spark, root, "inv"), ["id"], ["rev"])
    assert rows(out, "id", "status") == [("i1", "RESOLVED"), ("i2", "OPEN")]
