import pytest
from helpers import rows
from pyspark.sql import functions as F

from crawlmill.plans.staged import StagedTransform
from crawlmill.session import scratch_path
from crawlmill.sources.detect import detect_schema
from crawlmill.sources.readers import query, read_delimited
from crawlmill.sources.sinks import append_with_id


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a bigint, b bigint")


def staged(*stages):
    st = StagedTransform()
    for s in stages:
        st.add_stage(*s)
    return st


def test_stages_in_order(frame):
    st = staged(("double", lambda d: d.withColumn("c", F.col("a") * 2)), ("keep", lambda d: d.filter("c > 2")))
    run = st.run(frame)
    assert (run.rows_in, run.rows_out, run.stages_completed, run.validation_passed) == (3, 2, 2, True)
    assert list(run.stage_timings) == st.stage_names() == st.dry_run(frame) == ["double", "keep"]
    assert frame.columns == ["a", "b"]
    assert st.run(frame.limit(0)).rows_out == 0


def test_failed_check_keeps_the_current_frame(frame):
    st = staged(("none", lambda d: d.filter("a > 9"), F.count("*") > 0), ("never", lambda d: d.drop("a")))
    run = st.run(frame)
    assert (run.stages_completed, run.validation_passed, run.rows_out, run.output.columns) == (1, False, 0, ["a", "b"])
    assert not staged(("x", lambda d: d, lambda d: d.count() > 3)).run(frame).validation_passed


def test_error_keeps_earlier_columns(frame):
    st = staged(("c", lambda d: d.withColumn("c", F.lit(1))), ("bad", lambda d: d.select("missing")))
    run = st.run(frame)
    assert (run.stages_completed, run.validation_passed, run.output.columns) == (1, False, ["a", "b", "c"])
    assert run.error is not None


def test_data_errors_show_at_a_check_or_when_eager(frame):
    bad = lambda d: d.withColumn("c", F.raise_error(F.lit("boom")))
    assert staged(("bad", bad)).run(frame).validation_passed
    run = staged(("bad", bad)).run(frame, eager=True)
    assert (run.stages_completed, run.validation_passed) == (0, False)
    checked = staged(("bad", bad, F.max("c").isNull())).run(frame)
    assert (checked.stages_completed, checked.validation_passed) == (1, False)


def test_remove(frame):
    st = staged(("a", lambda d: d), ("b", lambda d: d), ("a", lambda d: d))
    assert st.remove_stage("a") and st.stage_names() == ["b", "a"]
    assert not st.remove_stage("zzz")


EMPLOYEES = "name string, age bigint, salary double, active boolean, hired string"


@pytest.fixture
def employees(spark):
    data = [("Al", 30, 5.5, True, "2024-01-01"), ("Bo", 41, float("nan"), False, "02/03/2024"), (None, 25, 7.0, True, None)]
    return spark.createDataFrame(data, EMPLOYEES)


def test_detect_schema(employees):
    got = rows(detect_schema(employees, "age"), "column", "label", "nullable", "row_count", "samples")
    assert got == [
        ("name", "text", True, 3, ["Al", "Bo"]),
        ("age", "integer", False, 3, ["25", "30", "41"]),
        ("salary", "float", False, 3, ["7.0", "5.5", "NaN"]),
        ("active", "boolean", False, 3, ["true", "true", "false"]),
        ("hired", "date", True, 3, ["2024-01-01", "02/03/2024"]),
    ]


def test_append_goes_on_with_ids(spark, employees):
    path = scratch_path(spark, "people")
    append_with_id(employees, path, ["age"])
    append_with_id(employees, path, ["age"])
    got = rows(spark.read.parquet(path).orderBy("id"), "id", "age", "salary")
    assert got == [(1, 25, 7.0), (2, 30, 5.5), (3, 41, None), (4, 25, 7.0), (5, 30, 5.5), (6, 41, None)]


def test_query_with_parameters(spark, employees):
    sql = "SELECT name FROM {people} WHERE age > ?"
    assert rows(query(spark, sql, [35], people=employees)) == [("Bo",)]
    assert rows(query(spark, "SELECT count(*) FROM {people} WHERE age < :top", {"top": 35}, people=employees)) == [(2,)]
    assert query(spark, sql, ["35 OR 1=1"], people=employees.withColumn("age", F.col("name"))).count() == 2


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,price,ok\n"Desk, ""big""",1.5,true\nLamp,2,false\n')
    (tmp_path / "b.tsv").write_text("k\tv\nx\t1\n")
    df = read_delimited(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["string", "double", "boolean"]
    assert rows(df)[0] == ('Desk, "big"', 1.5, True)
    assert rows(read_delimited(spark, str(tmp_path / "b.tsv"), "k string, v int")) == [("x", 1)]
