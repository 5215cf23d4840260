import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment


@pytest.fixture
def load(spark, tmp_path):
    path = str(tmp_path / "v2.parquet")
    spark.createDataFrame([(1, None), (2, None), (3, "c@c")], "id bigint, email string").write.parquet(path)
    return lambda session: session.read.parquet(path)


def test_select_counts_everything_and_samples(spark, load):
    r = experiment.run(spark, load, "SELECT * FROM dataset WHERE email IS NULL ORDER BY id;")
    assert (r.status, r.row_count, r.columns, r.sample_rows[0]) == ("COMPLETED", 2, ["id", "email"], {"id": 1, "email": None})
    r = experiment.run(spark, load, "SELECT a.id FROM dataset a, dataset b, dataset c", sample_limit=5)
    assert (r.row_count, len(r.sample_rows)) == (27, 5)


def test_no_rows_still_name_the_columns(spark, load):
    r = experiment.run(spark, load, "WITH x AS (SELECT id FROM dataset) SELECT * FROM x WHERE id > 9 -- none")
    assert (r.status, r.row_count, r.columns) == ("COMPLETED", 0, ["id"])


REFUSED = [
    "DROP TABLE dataset", "DROP VIEW dataset", "INSERT INTO dataset VALUES (1, 'x')", "DELETE FROM dataset",
    "UPDATE dataset SET id = 1", "TRUNCATE TABLE dataset", "CREATE TABLE t AS SELECT 1", "CREATE VIEW v AS SELECT 1",
    "CREATE TEMP VIEW v AS SELECT 1", "ALTER TABLE dataset ADD COLUMN x INT", "CACHE TABLE dataset", "SET spark.x = 1",
    "USE default", "ADD JAR x.jar", "MERGE INTO dataset USING dataset b ON true WHEN MATCHED THEN DELETE",
    "SELECT 1; DROP VIEW dataset", "SELECT 1) AS a; DROP VIEW dataset; SELECT * FROM (SELECT 1",
    "SELECT 1) AS a CROSS JOIN (SELECT 2", "BEGIN SELECT 1; END", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.System', 'getenv', 'HOME')",
    "SELECT try_reflect /* x */ ('java.lang.System', 'getenv', 'HOME')", "SELECT `reflect`('java.lang.System', 'exit', 1)",
    "SELEC 1", "SELECT missing FROM dataset", "",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM dataset",
    "SELECT * FROM IDENTIFIER('dataset')", "SELECT * FROM global_temp.secret", "SELECT * FROM secret_table", "SELECT * FROM default.secret_table",
    "WITH secret_table AS (SELECT 1 AS x) SELECT * FROM dataset", "WITH dataset AS (SELECT 1 AS id) SELECT * FROM dataset",
    "SELECT reflect /* a /* b */ c */ ('java.lang.System', 'exit', 1)", "SELECT 1 FROM dataset WHERE id IN (SELECT reflect('java.lang.System', 'exit', 1))",
    "SELECT rank() OVER w FROM dataset WINDOW w AS (ORDER BY reflect('java.lang.System', 'getenv', 'HOME'))",
    "SELECT * FROM range(5)", "SELECT TRANSFORM(id) USING 'cat' FROM dataset", "SELECT input_file_name() FROM dataset", "SELECT current_user()",
    "SELECT own_function(id) FROM dataset", "SELECT raise_error('x') FROM dataset", "SELECT * FROM dataset LATERAL VIEW java_method('java.lang.System', 'exit', 1) t AS x",
    "VALUES (1) |> SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM read_files('/etc')", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE dataset",
]

ALLOWED = [
    "SELECT 'see reflect (docs)' AS note FROM dataset", "SELECT id FROM dataset WHERE email RLIKE 'java_method ?\\\\(' OR true",
    "SELECT d.id, (SELECT max(id) FROM dataset) AS top, rank() OVER (PARTITION BY id ORDER BY email) AS r FROM dataset d LEFT JOIN (SELECT 1 AS id) b USING (id)",
    "WITH x AS (SELECT id FROM dataset), y AS (SELECT id + 1 AS id FROM x) SELECT * FROM x WHERE id IN (SELECT id FROM y) OR NOT EXISTS (SELECT 1 FROM y WHERE y.id = x.id)",
    "SELECT id, t FROM dataset LATERAL VIEW explode(array(1, 2)) v AS t", "SELECT transform(array(id), x -> x + 1) AS a, CAST(id AS STRING) AS s, date '2020-01-01' AS d FROM dataset",
    "SELECT id, count(*) FILTER (WHERE id > 1) AS n FROM dataset GROUP BY id HAVING count(*) > 0 ORDER BY 1 LIMIT 3 OFFSET 1", "SELECT 1 AS x UNION SELECT id FROM dataset EXCEPT SELECT 2",
    "SELECT sum(id) OVER w AS s FROM dataset WINDOW w AS (ORDER BY id)", "SELECT CASE WHEN id > 1 THEN 'a' ELSE 'b' END AS c, coalesce(email, 'x') || '!' AS e, id % 2 AS m FROM dataset",
    "SELECT DATE_TRUNC('month', current_date()) AS m, percentile(id, 0.5) AS p, count(DISTINCT email) AS n FROM DATASET",
]


@pytest.fixture
def secrets(spark):
    """A table and views of others that no experiment may read, and a function that none may call."""
    spark.createDataFrame([(1,)], "x int").createOrReplaceGlobalTempView("secret")
    spark.sql("CREATE TABLE IF NOT EXISTS secret_table (x INT) USING parquet")
    spark.udf.register("own_function", lambda x: x)
    yield
    spark.sql("DROP TABLE secret_table")
    spark.catalog.dropGlobalTempView("secret")


@pytest.mark.parametrize("sql", ALLOWED)
def test_queries_over_the_dataset_are_allowed(spark, load, sql):
    r = experiment.run(spark, load, sql)
    assert r.status == "COMPLETED", r.error_message


def test_the_query_runs_once(spark, load):
    counted = spark.sparkContext.accumulator(0)

    def seen(x):
        counted.add(1)
        return x

    def watched(session):
        return session.read.parquet(load(session).inputFiles()[0].rsplit("/", 1)[0]).withColumn("id", F.udf(seen, "bigint")("id"))

    assert experiment.run(spark, watched, "SELECT id FROM dataset").row_count == 3 and counted.value == 3


@pytest.mark.parametrize("sql", REFUSED)
def test_refused_text_becomes_a_failed_result(spark, load, secrets, sql):
    r = experiment.run(spark, load, sql)
    assert r.status == "FAILED" and r.row_count == 0 and r.columns == [] and r.error_message


def test_data_survives_the_refused_text(spark, load, secrets):
    session = experiment.experiment_session(spark, load)
    for sql in REFUSED:
        with pytest.raises(Exception):
            experiment.select(session, sql).collect()
    assert experiment.select(session, "SELECT count(*) AS n FROM dataset").first()["n"] == 3


def test_verdicts(spark):
    runs = spark.createDataFrame(
        [("e1", "h1", 2, None), ("e2", "h2", 0, None), ("e3", "h3", 0, "boom")],
        "experiment_id string, hypothesis_id string, row_count long, error_message string",
    )
    got = {r["experiment_id"]: (r["verdict"], r["note"], r["value"]) for r in experiment.verdicts(runs).collect()}
    assert got["e1"] == ("SUPPORTED", "Experiment found 2 rows supporting the hypothesis.", '{"rows":2,"error":null}')
    assert got["e2"][0] == "REJECTED" and "returned 0 rows" in got["e2"][1]
    assert got["e3"] == ("REJECTED", "Experiment failed to execute: boom", '{"rows":0,"error":"boom"}')


def test_latest_experiment_wins(spark):
    t = datetime.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("e1", "h1", t, 5), ("e2", "h1", t + datetime.timedelta(1), 0), ("e3", "h1", t, 9)],
        "experiment_id string, hypothesis_id string, completed_at timestamp_ntz, row_count long",
    )
    assert [r["experiment_id"] for r in experiment.latest(runs).collect()] == ["e2"]


def test_illegal_hypothesis_moves(spark):
    t = datetime.datetime(2024, 1, 1)
    steps = ["PROPOSED", "SUPPORTED", "REJECTED", "PROPOSED"]
    events = spark.createDataFrame(
        [("h1", t + datetime.timedelta(hours=i), i, s) for i, s in enumerate(steps)] + [("h2", t, 1, "REJECTED")],
        "hypothesis_id string, ts timestamp_ntz, event_id int, status string",
    )
    for bucket in ("hour", "year"):
        out = experiment.illegal_moves(events, F.date_trunc(bucket, "ts")).collect()
        assert sorted((r["hypothesis_id"], r["event_id"]) for r in out) == [("h1", 2), ("h1", 3)]
