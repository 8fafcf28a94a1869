"""Profile, schema-rule, outlier, quality-score and record-validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import round_to
from ..functions.records import quality_of_record
from ..operators import quality as Q
from ..operators import rules as V
from ..operators.record_profile import completeness_of_records, profile_records
from ..sources.readers import read_table
from . import inputs as I
from .registry import query, rnd

# --- profiles -------------------------------------------------------------------------------------

_LINEITEM = (
    "l_orderkey n,l_partkey n,l_suppkey n,l_linenumber n,l_quantity n,l_extendedprice n,l_discount n,l_tax n,"
    "l_returnflag s,l_linestatus s,l_shipdate d"
)
_EVENTS = "event_id n,ts d,user_id n,event_type s,value n,day s,nothing s,flag b"

# events with holes: values, types, a date-like text and an empty column
_HOLED_EVENTS_SQL = """holed AS (SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,
  CASE WHEN user_id % 10 <> 3 THEN value END AS value,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE strftime(ts, '%Y-%m-%d') END AS day,
  CAST(NULL AS VARCHAR) AS nothing, CASE WHEN user_id % 5 > 0 THEN value > 10 END AS flag FROM events)"""


def _holed_events(spark, folder):
    return read_table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("user_id") % 10 != 3, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("day"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("user_id") % 5 > 0, F.col("value") > 10).alias("flag"),
    )


_DATE_LIKE = Q.DATE_PATTERN


def _profile_sql(table: str, columns: str) -> str:
    parts = []
    for i, spec in enumerate(columns.replace("\n", "").split(",")):
        c, kind = spec.split()
        label = {
            "n": "'numeric'",
            "b": "'boolean'",
            "d": "'date'",
            "s": f"CASE WHEN count(*) FILTER (regexp_matches({c}, '{_DATE_LIKE}')) > count({c}) * 0.5 "
            "THEN 'date' ELSE 'string' END",
        }[kind]
        label = f"CASE WHEN count({c}) = 0 THEN 'unknown' ELSE {label} END"
        num = kind == "n"
        text = f"CASE WHEN ({label}) = 'string' THEN @fn@({c}) END" if kind == "s" else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"""SELECT {i} AS position, '{c}' AS "column", {label} AS dtype, count(*) AS row_count,
  count(*) - count({c}) AS null_count, {rnd(f"(count(*) - count({c})) / count(*)", 6)} AS null_ratio,
  count(DISTINCT CAST({c} AS VARCHAR)) AS unique_count,
  {rnd(f"CASE WHEN count({c}) = 0 THEN 0 ELSE count(DISTINCT CAST({c} AS VARCHAR)) / count({c}) END", 6)} AS cardinality_ratio,
  {f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"} AS min_value,
  {f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"} AS max_value,
  {text.replace("@fn@", "min")} AS min_text, {text.replace("@fn@", "max")} AS max_text,
  {rnd(f"avg({c})", 4) if num else "CAST(NULL AS DOUBLE)"} AS mean,
  {rnd(f"CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END", 4) if num else "CAST(NULL AS DOUBLE)"} AS std
FROM {table}"""
        )
    return "\nUNION ALL\n".join(parts)


def _shown_profile(frame):
    rounded = {c: round_to(c, 6) for c in ("null_ratio", "cardinality_ratio")}
    return frame.withColumns({**rounded, "mean": round_to("mean", 4), "std": round_to("std", 4)})


@query("profile_lineitem", _profile_sql("lineitem", _LINEITEM))
def profile_lineitem(spark, folder):
    return _shown_profile(Q.profile(read_table(spark, folder, "lineitem")))


@query("profile_events", f"WITH {_HOLED_EVENTS_SQL} {_profile_sql('holed', _EVENTS)}")
def profile_events(spark, folder):
    return _shown_profile(Q.profile(_holed_events(spark, folder)))


_RECORD = """concat('{"k": ', CAST(user_id AS VARCHAR), ', "v": ', CAST(value AS VARCHAR), ', "flag": ',
  CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, ', "type": "', event_type, '", "day": "2024-01-0',
  CAST(1 + user_id % 9 AS VARCHAR), '", "mix": ', CASE WHEN event_id % 2 = 0 THEN '"a"' ELSE '1' END, ', "none": null',
  CASE WHEN user_id % 3 = 0 THEN ', "rare": 1.5}' ELSE '}' END)"""


@query(
    "detect_types_variant",
    f"""WITH recs AS (SELECT {_RECORD} AS r FROM events),
keys AS (SELECT unnest(json_keys(r)) AS key, r FROM recs),
kinds AS (SELECT key, json_type(r, '$.' || key) AS k, json_extract_string(r, '$.' || key) AS t FROM keys),
counts AS (SELECT key, count(*) FILTER (k <> 'NULL') AS filled, count(*) FILTER (k = 'BOOLEAN') AS b,
  count(*) FILTER (k IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS n, count(*) FILTER (k = 'VARCHAR') AS s,
  count(*) FILTER (k = 'VARCHAR' AND regexp_matches(t, '{_DATE_LIKE}')) AS d FROM kinds GROUP BY key)
SELECT key, CASE WHEN filled = 0 THEN 'unknown' WHEN b = filled THEN 'boolean' WHEN n = filled THEN 'numeric'
    WHEN s = filled AND d > s * 0.5 THEN 'date' WHEN s = filled THEN 'string' ELSE 'mixed' END AS dtype,
  filled, (SELECT count(*) FROM recs) - filled AS null_count FROM counts""",
)
def detect_types_variant(spark, folder):
    record = _RECORD.replace("VARCHAR", "STRING")
    return Q.detect_types(read_table(spark, folder, "events").selectExpr(f"{record} AS r"), "r")


# records of which some are broken, no objects or missing
_ROUGH_RECORD = f"""CASE WHEN user_id % 17 = 1 THEN '{{"k": ' WHEN user_id % 19 = 2 THEN '[1, 2]' WHEN user_id % 23 = 3 THEN NULL ELSE {_RECORD} END"""

_FIELDS_SQL = f"""recs AS (SELECT {_ROUGH_RECORD} AS r FROM events),
good AS (SELECT r FROM recs WHERE json_valid(r) AND json_type(r) = 'OBJECT'),
totals AS (SELECT (SELECT count(*) FROM recs) AS records, (SELECT count(*) FROM good) AS readable),
keys AS (SELECT unnest(json_keys(r)) AS key, r FROM good),
fields AS (SELECT key, json_type(r, '$.' || key) AS k, json_extract_string(r, '$.' || key) AS t FROM keys)"""


@query(
    "profile_json_records",
    f"""WITH {_FIELDS_SQL}, counts AS (SELECT key, count(*) FILTER (k <> 'NULL') AS filled, count(*) FILTER (k = 'BOOLEAN') AS b,
  count(*) FILTER (k IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS n, count(*) FILTER (k = 'VARCHAR') AS s,
  count(*) FILTER (k = 'VARCHAR' AND regexp_matches(t, '{_DATE_LIKE}')) AS d, count(DISTINCT t) AS u, min(t) AS lt, max(t) AS mt,
  min(TRY_CAST(t AS DOUBLE)) AS lo, max(TRY_CAST(t AS DOUBLE)) AS hi, avg(TRY_CAST(t AS DOUBLE)) AS mean,
  coalesce(stddev_samp(TRY_CAST(t AS DOUBLE)), 0) AS std FROM fields GROUP BY key),
named AS (SELECT *, CASE WHEN filled = 0 THEN 'unknown' WHEN b = filled THEN 'boolean' WHEN n = filled THEN 'numeric'
    WHEN s = filled AND d > s * 0.5 THEN 'date' WHEN s = filled THEN 'string' ELSE 'mixed' END AS dtype FROM counts)
SELECT key, dtype, readable AS row_count, records - readable AS unreadable, readable - filled AS null_count,
  {rnd("(readable - filled) / readable", 6)} AS null_ratio, u AS unique_count,
  {rnd("CASE WHEN filled = 0 THEN 0 ELSE u / filled END", 6)} AS cardinality_ratio,
  CASE WHEN dtype = 'numeric' THEN lo END AS min_value, CASE WHEN dtype = 'numeric' THEN hi END AS max_value,
  CASE WHEN dtype = 'numeric' THEN {rnd("mean", 4)} END AS mean, CASE WHEN dtype = 'numeric' THEN {rnd("std", 4)} END AS std,
  CASE WHEN dtype = 'string' THEN lt END AS min_text, CASE WHEN dtype = 'string' THEN mt END AS max_text
FROM named, totals""",
)
def profile_json_records(spark, folder):
    """Profile of event records of changing keys, some of them unreadable."""
    return _shown_profile(profile_records(_rough_records(spark, folder), "r"))


@query(
    "json_completeness",
    f"""WITH {_FIELDS_SQL}, cells AS (SELECT count(DISTINCT key) AS keys, count(*) FILTER (k <> 'NULL') AS filled FROM fields)
SELECT records, readable, records - readable AS unreadable, keys, filled, {rnd("filled / (readable * keys)", 4)} AS completeness
FROM totals, cells""",
)
def json_completeness(spark, folder):
    return completeness_of_records(_rough_records(spark, folder), "r")


def _rough_records(spark, folder):
    record = _ROUGH_RECORD.replace("VARCHAR", "STRING")
    return read_table(spark, folder, "events").selectExpr(f"{record} AS r")


@query(
    "completeness",
    f"""WITH {_HOLED_EVENTS_SQL}, c AS (SELECT count(*) AS row_count, count(*) * 8 AS cells,
  count(event_id) + count(ts) + count(user_id) + count(event_type) + count(value) + count(day) + count(nothing)
  + count(flag) AS non_null_cells FROM holed)
SELECT *, {rnd("non_null_cells / cells", 4)} AS completeness FROM c""",
)
def completeness(spark, folder):
    return Q.completeness(_holed_events(spark, folder))


# --- schema rules ---------------------------------------------------------------------------------

_RULES = (
    Q.SchemaRule("event_type", "string"),
    Q.SchemaRule("value", "numeric", min_value=1.0, max_value=300.0),
    Q.SchemaRule("user_id", "string"),
    Q.SchemaRule("flag", "boolean", required=False),
    Q.SchemaRule("ts", "date"),
    Q.SchemaRule("absent", "numeric"),
)

_FINDINGS_SQL = f"""SELECT * FROM (
  SELECT 'event_type' AS "column", 'error' AS severity, 'Column ''event_type'' has ' || n || ' missing values but is required' AS message, n AS affected
    FROM (SELECT count(*) - count(event_type) AS n FROM holed)
  UNION ALL SELECT 'value', 'error', 'Column ''value'' has ' || n || ' missing values but is required', n
    FROM (SELECT count(*) - count(value) AS n FROM holed)
  UNION ALL SELECT 'value', 'warning', 'Column ''value'' has ' || n || ' values below minimum 1.0', n
    FROM (SELECT count(*) FILTER (value < 1.0) AS n FROM holed)
  UNION ALL SELECT 'value', 'warning', 'Column ''value'' has ' || n || ' values above maximum 300.0', n
    FROM (SELECT count(*) FILTER (value > 300.0) AS n FROM holed)
  UNION ALL SELECT 'user_id', 'error', 'Column ''user_id'' has ' || n || ' values with wrong type (expected string)', n
    FROM (SELECT count(user_id) AS n FROM holed)
  UNION ALL SELECT 'absent', 'error', 'Column ''absent'' has ' || n || ' missing values but is required', n
    FROM (SELECT count(*) AS n FROM holed)) WHERE affected > 0"""


@query("schema_rules", f"WITH {_HOLED_EVENTS_SQL} {_FINDINGS_SQL}")
def schema_rules(spark, folder):
    return Q.check_schema(_holed_events(spark, folder), _RULES)


# --- outliers and score ---------------------------------------------------------------------------


def _fences_sql(table: str, columns: tuple[str, ...]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(lo AS DOUBLE) AS lower_fence, CAST(hi AS DOUBLE) AS upper_fence,
  (SELECT count(*) FROM {table} WHERE {c} < lo OR {c} > hi) AS outlier_count, n AS value_count
FROM (SELECT n, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT max(n) AS n, CAST(max(v) FILTER (r = n // 4) AS DOUBLE) AS q1, CAST(max(v) FILTER (r = 3 * n // 4) AS DOUBLE) AS q3
  FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n
        FROM {table} WHERE {c} IS NOT NULL)))"""
        for c in columns
    )


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
_HOLED_NUMBERS = ("event_id", "user_id", "value")


@query("outlier_fences", _fences_sql("lineitem", _MEASURES))
def outlier_fences(spark, folder):
    return Q.outlier_fences(read_table(spark, folder, "lineitem"), _MEASURES)


@query(
    "outlier_rows",
    f"""WITH f AS ({_fences_sql("events", ("value",))})
SELECT event_id, user_id, event_type, value FROM events, f WHERE value < lower_fence OR value > upper_fence""",
)
def outlier_rows(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return Q.outlier_rows(events, "value")


@query(
    "quality_score",
    f"""WITH {_HOLED_EVENTS_SQL}, f AS ({_fences_sql("holed", _HOLED_NUMBERS)}), e AS ({_FINDINGS_SQL}),
c AS (SELECT {rnd('''(count(event_id) + count(ts) + count(user_id) + count(event_type) + count(value) + count(day)
  + count(nothing) + count(flag)) / (count(*) * 8)''', 4)} AS completeness FROM holed),
v AS (SELECT greatest(0.0, 1.0 - count(*) FILTER (severity = 'error') * 0.1::DOUBLE)::DOUBLE AS validity FROM e),
o AS (SELECT sum(outlier_count) / sum(value_count) AS share FROM f)
SELECT completeness, {rnd("validity", 6)} AS validity, {rnd("1 - share", 6)} AS outlier_score,
  {rnd("0.4 * completeness + 0.4 * validity + 0.2 * (1 - share)", 4)} AS overall_score FROM c, v, o""",
)
def quality_score(spark, folder):
    score = Q.quality_score(_holed_events(spark, folder), _RULES)
    return score.withColumns({c: round_to(c, 6) for c in ("validity", "outlier_score")})


@query(
    "quality_recs",
    f"""WITH {_HOLED_EVENTS_SQL}, p AS ({_profile_sql("holed", _EVENTS)}), f AS ({_fences_sql("holed", _HOLED_NUMBERS)}),
e AS ({_FINDINGS_SQL})
SELECT 1 AS step, 0 AS position, 'Data completeness is below 90%; consider imputing or collecting missing values' AS advice
  FROM p HAVING round(1 - sum(null_count) / sum(row_count), 4) < 0.9
UNION ALL SELECT 2, position, 'Column ''' || "column" || ''' is over 50% null; consider dropping or imputing'
  FROM p WHERE null_ratio > 0.5
UNION ALL SELECT 2, position, 'Column ''' || "column" || ''' has very low cardinality; may be categorical'
  FROM p WHERE dtype = 'numeric' AND unique_count / (row_count - null_count) < 0.01 AND unique_count > 0
UNION ALL SELECT 3, 0, 'Schema validation found ' || count(*) || ' error(s); review data pipeline'
  FROM e WHERE severity = 'error' HAVING count(*) > 0
UNION ALL SELECT 4, 0, 'Column ''' || "column" || ''' has ' || outlier_count || ' outlier(s); review for data errors'
  FROM f WHERE outlier_count > 0""",
)
def quality_recs(spark, folder):
    return Q.recommendations(_holed_events(spark, folder), _RULES)


_FETCH_SQL = r"""fetched AS (SELECT page_id, CASE WHEN page_id % 10 <> 1 THEN url END AS url,
    CASE WHEN page_id % 20 = 3 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
    CASE WHEN page_id % 7 = 5 THEN '' ELSE html END AS body,
    TIMESTAMP '2024-01-31' - to_hours(page_id * 5) AS scraped_at,
    CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 ELSE 200 END AS status FROM pages)"""


_QUALITY_SQL = f"""WITH {_FETCH_SQL}, scored AS (SELECT page_id, {rnd('''
  0.4 * (((CASE WHEN url <> '' THEN 1 ELSE 0 END) + (CASE WHEN title <> '' THEN 1 ELSE 0 END)
    + (CASE WHEN body <> '' THEN 1 ELSE 0 END)) / 3.0::DOUBLE)
  + 0.3 * greatest(0.0, 1.0 - (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(scraped_at)) / 86400e6 / 30)
  + 0.3 * (CASE WHEN status = 200 THEN 1.0 ELSE 0.3 END)::DOUBLE''', 3)} AS quality FROM fetched)"""


@query("record_quality", f"{_QUALITY_SQL} SELECT * FROM scored")
def record_quality(spark, folder):
    kind = F.col("page_id")
    status = F.when(kind % 6 == 0, 404).when(kind % 6 == 1, 301).when(kind % 6 == 2, 500).otherwise(200)
    fetched = read_table(spark, folder, "pages").select(
        "page_id",
        F.when(kind % 10 != 1, F.col("url")).alias("url"),
        F.when(kind % 20 == 3, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.when(kind % 7 == 5, "").otherwise(F.col("html")).alias("body"),
        (F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(hours=(kind * 5).cast("int"))).alias("at"),
        status.alias("status"),
    )
    as_of = F.lit("2024-02-01").cast("timestamp")
    parts = [F.col(c) for c in ("url", "title", "body", "at", "status")]
    return fetched.select("page_id", quality_of_record(*parts, as_of).alias("quality"))


@query("record_quality_average", f"{_QUALITY_SQL} SELECT count(*) AS records, {rnd('avg(quality)', 6)} AS quality FROM scored")
def record_quality_average(spark, folder):
    scored = record_quality(spark, folder)
    return scored.agg(F.count("*").alias("records"), round_to(F.avg("quality"), 6).alias("quality"))


# --- record rules ---------------------------------------------------------------------------------

_CHECKS = [
    V.required("name"),
    V.matching("name", "Customer#0*[1-9]", "name needs a number"),
    V.of_type("balance", "int"),
    V.of_type("balance", "float"),
    V.in_range("balance", 0, 9000),
    V.custom("segment", lambda c: F.length(c) > 8, "Segment too short"),
    V.required("phone"),
]

_RECORDS_SQL = """recs AS (SELECT c_custkey, CASE c_custkey % 11 WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE c_name END AS name,
  CASE WHEN c_custkey % 9 <> 4 THEN c_acctbal END AS balance, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer)"""

_FAILS = {
    "name is required": "name IS NULL OR trim(name) = ''",
    "name needs a number": "NOT regexp_matches(name, '^(?:Customer#0*[1-9])')",
    "balance must be int": "balance IS NOT NULL",
    "balance must be float": "FALSE",
    "balance out of range": "balance < 0 OR balance > 9000",
    "Segment too short": "NOT length(segment) > 8",
    "phone is required": "TRUE",
}


def _records(spark, folder):
    kind = F.col("c_custkey") % 11
    return read_table(spark, folder, "customer").select(
        "c_custkey",
        F.when(kind == 2, "  ").when(kind != 1, F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 9 != 4, F.col("c_acctbal")).alias("balance"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
    )


@query(
    "validate_records",
    f"""WITH {_RECORDS_SQL} SELECT c_custkey, FALSE AS is_valid,
  concat_ws('; ', {", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in _FAILS.items())}) AS messages FROM recs""",
)
def validate_records(spark, folder):
    checked = V.validate(_records(spark, folder), _CHECKS)
    return checked.select("c_custkey", "is_valid", F.concat_ws("; ", "errors.message").alias("messages"))


@query(
    "validate_summary",
    f"WITH {_RECORDS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT CAST({i + 1} AS BIGINT) AS rule, '{r.field}' AS field, '{r.rule_type}' AS rule_type, '{m}' AS message,
  count(*) FILTER ({c}) AS failures, count(*) AS records FROM recs"""
        for i, (r, (m, c)) in enumerate(zip(_CHECKS, _FAILS.items()))
    ),
)
def validate_summary(spark, folder):
    return V.validation_summary(_records(spark, folder), _CHECKS)


_VARIANT_CHECKS = [
    V.required("type"),
    V.of_type("k", "int"),
    V.of_type("v", "int", "v is not whole"),
    V.of_type("flag", "bool"),
    V.of_type("mix", "str"),
    V.in_range("flag", 1, None, "flag is off"),
    V.in_range("v", None, 100),
    V.matching("type", "c|p", "odd type"),
    V.required("none"),
    V.required("rare"),
]


@query(
    "validate_variant_records",
    f"""WITH recs AS (SELECT event_id, {_RECORD} AS r FROM events),
f AS (SELECT event_id, CAST(json_extract(r, '$.v') AS DOUBLE) AS v, json_type(r, '$.v') AS vt, json_type(r, '$.mix') AS mt,
  json_extract_string(r, '$.flag') AS flag, json_extract_string(r, '$.type') AS t, json_type(r, '$.rare') AS rt FROM recs)
SELECT event_id, concat_ws('; ', CASE WHEN vt = 'DOUBLE' AND v <> floor(v) THEN 'v is not whole' END,
  CASE WHEN mt <> 'VARCHAR' THEN 'mix must be str' END, CASE WHEN flag = 'false' THEN 'flag is off' END,
  CASE WHEN v > 100 THEN 'v out of range' END, CASE WHEN NOT regexp_matches(t, '^(c|p)') THEN 'odd type' END,
  'none is required', CASE WHEN rt IS NULL THEN 'rare is required' END) AS messages FROM f""",
)
def validate_variant_records(spark, folder):
    record = _RECORD.replace("VARCHAR", "STRING")
    names = sorted({r.field for r in _VARIANT_CHECKS})
    recs = read_table(spark, folder, "events").selectExpr("event_id", f"parse_json({record}) AS r")
    recs = recs.select("event_id", *[F.try_variant_get("r", f"$.{n}", "variant").alias(n) for n in names])
    return V.validate(recs, _VARIANT_CHECKS).select("event_id", F.concat_ws("; ", "errors.message").alias("messages"))


# --- item lists -----------------------------------------------------------------------------------

_ITEMS_SQL = """items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
  'part ' || l_partkey AS title, CASE WHEN l_linenumber = 2 THEN '' ELSE '$' || l_suppkey END AS price,
  CASE WHEN l_discount > 0.05 THEN 'sale' END AS label FROM lineitem)"""


def _items(spark, folder):
    from ..operators.ordering import with_position

    lines = with_position(
        read_table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"
        ),
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        "pos",
    )
    price = F.when(F.col("l_linenumber") == 2, "").otherwise(F.concat(F.lit("$"), F.col("l_suppkey").cast("string")))
    fields = {
        "title": F.concat(F.lit("part "), F.col("l_partkey").cast("string")),
        "price": price,
        "label": F.when(F.col("l_discount") > 0.05, "sale"),
    }
    return lines.select(
        "l_orderkey",
        (F.col("pos") - 1).alias("pos"),
        F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("fields"),
    )


@query(
    "item_completeness",
    f"""WITH {_ITEMS_SQL}, r AS (SELECT l_orderkey, 1 AS n, (CASE WHEN title <> '' THEN 1 ELSE 0 END)
  + (CASE WHEN price <> '' THEN 1 ELSE 0 END) + (CASE WHEN label <> '' THEN 1 ELSE 0 END) AS p FROM items
  UNION ALL SELECT o_orderkey, 0, 0 FROM orders),
s AS (SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS item_count, CAST(sum(p) AS BIGINT) AS present_fields FROM r GROUP BY l_orderkey)
SELECT *, CASE WHEN item_count = 0 THEN 100.0::DOUBLE ELSE {rnd("present_fields / (item_count * 3) * 100", 1)} END AS completeness_score,
  CASE WHEN item_count < 3 THEN 'Expected at least 3 items, got ' || item_count END AS count_warning FROM s""",
)
def item_completeness(spark, folder):
    lists = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.item_completeness(_items(spark, folder), ["l_orderkey"], ["title", "price", "label"], 3, lists)


@query(
    "item_missing_fields",
    f"""WITH {_ITEMS_SQL} SELECT l_orderkey, 'data[' || pos || '].' || f AS field,
  'Missing or empty field ''' || f || ''' in item ' || pos AS message FROM (
  SELECT l_orderkey, pos, 'price' AS f FROM items WHERE price = '' UNION ALL
  SELECT l_orderkey, pos, 'label' FROM items WHERE label IS NULL)""",
)
def item_missing_fields(spark, folder):
    gaps = V.missing_item_fields(_items(spark, folder), ["l_orderkey"], ["title", "price", "label"])
    return gaps.select("l_orderkey", "field", "message")
