"""Reader, sink, stage and job-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..session import scratch_path
from ..sources.detect import detect_schema
from ..sources.readers import query as run_query
from ..sources.readers import read_delimited, read_table
from ..sources.sinks import append_with_id
from . import inputs as I
from .registry import query, rnd
from .staged import StagedTransform


@query(
    "src_delimited",
    "SELECT p_partkey AS id, p_name AS name, p_brand || ', \"' || p_type || '\"' AS kind, p_size AS size, "
    "p_retailprice AS price FROM part",
)
def src_delimited(spark, folder):
    path = scratch_path(spark, "parts") + ".tsv"
    kind = F.concat(F.col("p_brand"), F.lit(', "'), F.col("p_type"), F.lit('"'))
    read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        kind.alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    ).write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return read_delimited(spark, path).withColumn("id", F.col("id").cast("bigint"))


@query(
    "detect_schema",
    """WITH t AS (SELECT o_orderkey AS k, o_orderkey, nullif(o_orderstatus, 'F') AS status, o_totalprice AS price,
  strftime(o_orderdate, '%m/%d/%Y') AS day, o_custkey % 2 = 0 AS even, o_orderdate AS placed,
  CASE WHEN o_orderkey > 10 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS due FROM orders)
"""
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{label}' AS label, count({c}) < count(*) AS nullable, count(*) AS row_count,
  (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT k, {text} AS v FROM t WHERE {c} IS NOT NULL ORDER BY k LIMIT 3)) AS samples
FROM t"""
        for i, (c, label, text) in enumerate(
            [
                ("o_orderkey", "integer", "CAST(o_orderkey AS VARCHAR)"),
                ("status", "text", "status"),
                ("price", "float", "CAST(price AS VARCHAR)"),
                ("day", "date", "day"),
                ("even", "boolean", "CAST(even AS VARCHAR)"),
                ("placed", "date", "strftime(placed, '%Y-%m-%d %H:%M:%S')"),
                ("due", "text", "due"),
            ]
        )
    ),
)
def detect_schema_query(spark, folder):
    table = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        F.col("o_totalprice").alias("price"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        (F.col("o_custkey") % 2 == 0).alias("even"),
        F.col("o_orderdate").alias("placed"),
        F.when(F.col("o_orderkey") > 10, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("due"),
    )
    return detect_schema(table, "o_orderkey").withColumn("samples", F.concat_ws("|", "samples"))


@query(
    "sink_table_with_id",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey, o_custkey, o_totalprice FROM orders
UNION ALL SELECT (SELECT count(*) FROM orders) + row_number() OVER (ORDER BY c_custkey), -c_custkey, c_custkey, c_acctbal
FROM customer""",
)
def sink_table_with_id(spark, folder):
    path = scratch_path(spark, "numbered")
    first = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    second = read_table(spark, folder, "customer").select(
        (-F.col("c_custkey")).alias("o_orderkey"),
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_acctbal").alias("o_totalprice"),
    )
    append_with_id(first, path, ["o_orderkey"])
    append_with_id(second, path, ["o_custkey"])
    return spark.read.parquet(path)


@query(
    "query_param",
    """SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice > 100000.0 AND c_mktsegment = 'BUILDING'""",
)
def query_param(spark, folder):
    sql = """SELECT o_orderkey, o_totalprice, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey
             WHERE o_totalprice > :low AND c_mktsegment = :segment"""
    tables = {t: read_table(spark, folder, t) for t in ("orders", "customer")}
    return run_query(spark, sql, {"low": 100000.0, "segment": "BUILDING"}, **tables)


# --- stages ---------------------------------------------------------------------------------------


def _revenue(df):
    return df.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query(
    "stage_projection",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS doubled, l_quantity + l_discount + l_tax AS total
FROM lineitem""",
)
def stage_projection(spark, folder):
    st = StagedTransform()
    st.add_stage("double", lambda d: d.withColumn("doubled", F.col("l_extendedprice") * 2))
    st.add_stage("total", lambda d: d.withColumn("total", F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")))
    st.add_stage("keep", lambda d: d.select("l_orderkey", "l_linenumber", "doubled", "total"))
    return st.run(read_table(spark, folder, "lineitem")).output


@query(
    "stage_filter_chain",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 10 AND l_discount < 0.05 AND l_returnflag = 'R'""",
)
def stage_filter_chain(spark, folder):
    st = StagedTransform()
    st.add_stage("quantity", lambda d: d.filter("l_quantity > 10"))
    st.add_stage("discount", lambda d: d.filter("l_discount < 0.05"))
    st.add_stage("flag", lambda d: d.filter("l_returnflag = 'R'"))
    return st.run(read_table(spark, folder, "lineitem")).output.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "staged_run",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {rnd("sum(l_extendedprice * (1 - l_discount))", 2)} AS revenue
FROM lineitem WHERE l_quantity >= 5 GROUP BY ALL""",
)
def staged_run(spark, folder):
    st = StagedTransform()
    st.add_stage("filter", lambda d: d.filter("l_quantity >= 5"), F.count("*") > 0)
    st.add_stage("revenue", _revenue)
    st.add_stage(
        "sum",
        lambda d: d.groupBy("l_returnflag", "l_linestatus").agg(
            F.count("*").alias("n"),
            F.round(F.sum("revenue").cast("decimal(38,10)"), 2).cast("double").alias("revenue"),
        ),
        F.min("n") > 0,
    )
    st.add_stage("never", lambda d: d.filter("n < 0"), F.count("*") > 0)
    run = st.run(read_table(spark, folder, "lineitem"))
    # the last check fails, so that stage was run but the frame before it is what we want to see
    assert run.stages_completed == 4 and not run.validation_passed
    st.remove_stage("never")
    return st.run(read_table(spark, folder, "lineitem")).output


# --- job runs -------------------------------------------------------------------------------------


@query(
    "job_interval",
    rf"""WITH {I.JOBS_SQL}, parts AS (SELECT *, regexp_extract_all(cron, '[^\s]+') AS p FROM jobs),
found AS (SELECT *, CASE WHEN len(p) = 5 THEN CASE
    WHEN starts_with(p[1], '*/') AND p[2] = '*' AND p[3] = '*' THEN TRY_CAST(substr(p[1], 3) AS BIGINT) * 60
    WHEN p[1] = '0' AND p[2] = '*' AND p[3] = '*' THEN 3600 WHEN p[1] = '0' AND p[2] = '0' AND p[3] = '*' THEN 86400 END
  END AS c FROM parts)
SELECT name, cron, coalesce(c, interval_seconds) AS interval_seconds, c IS NOT NULL AS cron_applied FROM found""",
)
def job_interval(spark, folder):
    return R.job_intervals(I.jobs(spark, folder)).select("name", "cron", "interval_seconds", "cron_applied")


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


@query(
    "job_status",
    f"""WITH {I.RUNS_SQL}, {I.JOBS_SQL}
SELECT name AS job, count(*) FILTER (success) AS run_count, count(*) FILTER (NOT success) AS error_count,
  {_TS.format("max(ts) FILTER (success)")} AS last_run,
  first(error ORDER BY ts DESC, seq DESC) FILTER (NOT success) AS last_error,
  first(result ORDER BY ts DESC, seq DESC) FILTER (success) AS last_result,
  {_TS.format("max(ts)")} AS last_attempt, {_TS.format("max(ts) + to_seconds(any_value(interval_seconds))")} AS next_run
FROM jobs JOIN runs ON job = name GROUP BY name""",
)
def job_status(spark, folder):
    status = R.job_status(I.runs(spark, folder), I.jobs(spark, folder))
    return status.withColumns({c: _ts(c) for c in ("last_run", "last_attempt", "next_run")})


@query(
    "job_fleet",
    f"""WITH {I.RUNS_SQL}, {I.JOBS_SQL}
SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM jobs WHERE enabled) AS active_jobs,
  count(*) FILTER (success) AS total_runs, count(*) FILTER (NOT success) AS total_errors FROM runs""",
)
def job_fleet(spark, folder):
    return R.fleet_totals(I.jobs(spark, folder), I.runs(spark, folder))


@query(
    "job_recent_runs",
    f"""WITH {I.RUNS_SQL}
SELECT job, {_TS.format("ts")} AS ts, seq, success, result, error,
  row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS position FROM runs QUALIFY position <= 10""",
)
def job_recent_runs(spark, folder):
    recent = R.recent_runs(I.runs(spark, folder))
    return recent.withColumns({"ts": _ts("ts"), "position": F.col("position").cast("bigint")})
