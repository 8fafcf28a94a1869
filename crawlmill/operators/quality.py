"""Profiles, schema rules, outlier fences and the overall quality score of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import ratio, round_to

# fixed values: texts that look like dates
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}/[0-9]{2}/[0-9]{4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"

PROFILE = (
    "column dtype row_count null_count null_ratio unique_count cardinality_ratio "
    "min_value max_value min_text max_text mean std"
).split()


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _label(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "string"
    return "date" if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "mixed"


def _number_facts(position: int, f: T.StructField) -> Column:
    """Counts and, for numbers, range and moments: fixed-size buffers only."""
    c, number = F.col(_q(f.name)), is_numeric(f.dataType)
    filled = F.count(c)
    shown = lambda v: v.cast("double") if number else _nothing("double")
    # a single value has deviation 0
    deviation = F.when(filled == 1, F.lit(0.0)).otherwise(F.stddev_samp(c)) if number else _nothing("double")
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(f.name).alias("column"),
        F.lit(_label(f.dataType)).alias("dtype"),
        F.count(F.lit(1)).alias("row_count"),
        filled.alias("filled"),
        shown(F.min(c)).alias("min_value"),
        shown(F.max(c)).alias("max_value"),
        shown(F.avg(c)).alias("mean"),
        deviation.alias("std"),
    )


_BY_TEXT = (T.DoubleType, T.FloatType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _value_facts(df: DataFrame, f: T.StructField, approximate: bool) -> DataFrame:
    """One row: distinct values by text form and, for texts, range and number of date-like cells.

    Exact form: the scan is pruned to the column, values are combined before the shuffle and spread by
    value, so neither a frequent value nor a wide table fills one task; the date pattern is tried once per
    distinct text. Fractions are compared as text, which keeps 0.0 and -0.0 apart.
    """
    c = F.col(_q(f.name))
    value = c.cast("string") if isinstance(f.dataType, _BY_TEXT) else c
    text = isinstance(f.dataType, T.StringType)
    column = df.select(value.alias("value"))
    if approximate:
        rows, unique = column.withColumn("n", F.lit(1)), F.approx_count_distinct("value")
    elif text:
        rows, unique = column.groupBy("value").agg(F.count(F.lit(1)).alias("n")), F.count("value")
    else:
        rows, unique = column.distinct(), F.count("value")
    dates = F.coalesce(F.sum(F.when(F.col("value").rlike(DATE_PATTERN), F.col("n"))), F.lit(0)) if text else F.lit(0)
    return rows.agg(
        F.lit(f.name).alias("column"),
        unique.alias("unique_count"),
        dates.cast("bigint").alias("dates"),
        (F.min("value") if text else _nothing("string")).alias("min_text"),
        (F.max("value") if text else _nothing("string")).alias("max_text"),
    )


def profile(df: DataFrame, approximate: bool = False, nan_as_null: bool = False) -> DataFrame:
    """One row per column: type label, nulls, distinct values, range, mean and sample deviation."""
    if nan_as_null:
        fractions = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        df = df.withColumns({c: F.nanvl(_q(c), F.lit(None).cast("double")) for c in fractions})
    numbers = df.agg(F.array(*[_number_facts(i, f) for i, f in enumerate(df.schema)]).alias("facts"))
    values = reduce(DataFrame.unionByName, [_value_facts(df, f, approximate) for f in df.schema])
    # both sides have one row per column of the table
    out = numbers.select(F.inline("facts")).join(F.broadcast(values), "column").filter("row_count > 0")
    filled, is_date = F.col("filled"), (F.col("dtype") == "string") & (F.col("dates") > F.col("filled") * 0.5)
    plain_text = (F.col("dtype") == "string") & ~is_date
    shown = {
        "null_count": F.col("row_count") - filled,
        "null_ratio": ratio(F.col("row_count") - filled, F.col("row_count")),
        "cardinality_ratio": F.coalesce(ratio(F.col("unique_count"), filled), F.lit(0.0)),
        "min_text": F.when(plain_text, F.col("min_text")),
        "max_text": F.when(plain_text, F.col("max_text")),
        "dtype": F.when(filled == 0, "unknown").when(is_date, "date").otherwise(F.col("dtype")),
    }
    return out.withColumns(shown).select("position", *PROFILE)


def _cell_counts(df: DataFrame) -> list[Column]:
    filled = reduce(lambda a, b: a + b, [F.count(F.col(_q(c))) for c in df.columns], F.lit(0))
    rows = F.count(F.lit(1))
    return [
        rows.alias("row_count"),
        (rows * len(df.columns)).alias("cells"),
        filled.cast("bigint").alias("non_null_cells"),
    ]


def _share_filled() -> Column:
    share = round_to(ratio(F.col("non_null_cells"), F.greatest("cells", F.lit(1))), 4)
    return F.when(F.col("row_count") == 0, F.lit(1.0)).otherwise(share)


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, cells, filled cells and their share (1 for an empty table), four decimals."""
    return df.agg(*_cell_counts(df)).withColumn("completeness", _share_filled())


def detect_types(records: DataFrame, record: str) -> DataFrame:
    """Type label and counts per key of JSON objects, one row per key.

    Keys missing from a record count as nulls, like an explicit null.
    """
    total = records.agg(F.count(F.lit(1))).scalar()
    fields = records.select(F.explode(F.from_json(F.col(record), "map<string,variant>")).alias("key", "value"))
    kind = F.schema_of_variant("value")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    text = kind == "STRING"
    date_like = F.coalesce(text & F.try_variant_get("value", "$", "string").rlike(DATE_PATTERN), F.lit(False))
    counts = fields.groupBy("key").agg(
        F.count_if(kind != "VOID").alias("filled"),
        F.count_if(kind == "BOOLEAN").alias("booleans"),
        F.count_if(number).alias("numbers"),
        F.count_if(text).alias("texts"),
        F.count_if(date_like).alias("dates"),
    )
    all_are = lambda c: F.col(c) == F.col("filled")
    label = (
        F.when(F.col("filled") == 0, "unknown")
        .when(all_are("booleans"), "boolean")
        .when(all_are("numbers"), "numeric")
        .when(all_are("texts") & (F.col("dates") > F.col("texts") * 0.5), "date")
        .when(all_are("texts"), "string")
        .otherwise("mixed")
    )
    return counts.select("key", label.alias("dtype"), "filled", (total - F.col("filled")).alias("null_count"))


# --- schema rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class SchemaRule:
    """Expected type (numeric, string, boolean; other names are not checked) and limits of a column."""

    column: str
    expected_type: str
    required: bool = True
    min_value: float | None = None
    max_value: float | None = None


_EXPECTED = {"numeric": T.NumericType, "string": T.StringType, "boolean": T.BooleanType}


def _rule_findings(df: DataFrame, rule: SchemaRule) -> list[Column]:
    known = {f.name: f.dataType for f in df.schema}
    dtype = known.get(rule.column, T.NullType())
    c = F.col(_q(rule.column)) if rule.column in known else F.lit(None)
    name = f"Column '{rule.column}' has "

    def row(severity: str, n: Column, tail: str, wanted: bool = True) -> Column:
        return F.struct(
            F.lit(rule.column).alias("column"),
            F.lit(severity).alias("severity"),
            F.concat(F.lit(name), n.cast("string"), F.lit(tail)).alias("message"),
            (n if wanted else F.lit(0)).cast("bigint").alias("affected"),
        )

    out = []
    if rule.required:
        out.append(row("error", F.count(F.lit(1)) - F.count(c), " missing values but is required"))
    wrong = f" values with wrong type (expected {rule.expected_type})"
    if isinstance(dtype, T.VariantType):
        kind = F.schema_of_variant(c)
        filled = kind != "VOID"
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        if rule.required:
            out = [row("error", F.count(F.lit(1)) - F.count_if(filled), " missing values but is required")]
        right = {"numeric": number, "string": kind == "STRING", "boolean": kind == "BOOLEAN"}
        if rule.expected_type in right:
            out.append(row("error", F.count_if(filled & ~right[rule.expected_type]), wrong))
        c, dtype = F.when(number, F.try_variant_get(c, "$", "double")), T.DoubleType()
    expected = _EXPECTED.get(rule.expected_type)
    if expected and not isinstance(known.get(rule.column), (expected, T.VariantType, type(None))):
        out.append(row("error", F.count(c), wrong))
    if is_numeric(dtype):
        ok = ~F.isnan(c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else F.lit(True)
        if rule.min_value is not None:
            out.append(row("warning", F.count_if(ok & (c < rule.min_value)), f" values below minimum {rule.min_value}"))
        if rule.max_value is not None:
            out.append(row("warning", F.count_if(ok & (c > rule.max_value)), f" values above maximum {rule.max_value}"))
    return out


_FINDING_ROW = "array<struct<column:string,severity:string,message:string,affected:bigint>>"


def _checks(df: DataFrame, rules: Sequence[SchemaRule]) -> Column:
    checks = [f for rule in rules for f in _rule_findings(df, rule)]
    return F.filter(F.array(*checks).cast(_FINDING_ROW), lambda f: f["affected"] > 0)


def check_schema(df: DataFrame, rules: Sequence[SchemaRule]) -> DataFrame:
    """Findings ``column, severity, message, affected`` of all rules, from one pass over the table."""
    return df.agg(_checks(df, rules).alias("checks")).select(F.inline("checks"))


# --- order statistics and outliers ----------------------------------------------------------------

EXACT_ROWS = 100_000  # up to this many values of a column are ranked in one aggregate buffer
_ACCURACY = 20_000  # rank error of the sketch: rows / this


def _quartile_ranks(n: int) -> list[int]:
    return [n // 4, (3 * n) // 4]


class _Search:
    """One wanted rank of one column, narrowed to an open value interval."""

    def __init__(self, column: str, rows: int, rank: int):
        self.column, self.rows, self.rank = column, rows, rank
        self.low = self.high = self.found = None

    def value(self) -> Column:
        """The column where it lies in the interval, else NULL."""
        c, keep = F.col(_q(self.column)), F.lit(True)
        if self.low is not None:
            keep = keep & (c > self.low)
        if self.high is not None:
            keep = keep & (c < self.high)
        return F.when(keep, c)

    def fractions(self) -> list[float]:
        at, margin = (self.rank + 0.5) / self.rows, 2.0 / _ACCURACY
        return [max(0.0, at - margin), min(1.0, at + margin)]

    def counts(self, low, high) -> Column:
        v = self.value()
        return F.struct(
            F.count_if(v < low),
            F.count_if(v == low),
            F.count_if((v > low) & (v < high)),
            F.count_if((v == high) & (v > low)),
        )

    def narrow(self, low, high, counts) -> None:
        under, at_low, between, at_high = counts
        upto = [under, under + at_low, under + at_low + between, under + at_low + between + at_high]
        if self.rank < upto[0]:  # the sketch was off: the rank lies in front of the bracket
            self.high, self.rows = low, under
        elif self.rank < upto[1]:
            self.found = low
        elif self.rank < upto[2]:
            self.low, self.high, self.rows, self.rank = low, high, between, self.rank - upto[1]
        elif self.rank < upto[3]:
            self.found = high
        else:
            self.low, self.rows, self.rank = high, self.rows - upto[3], self.rank - upto[3]


def _brackets(df: DataFrame, searches: list[_Search]) -> list[tuple]:
    """A value pair around each rank; ranks of the same column and interval share one sketch."""
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault((s.column, s.low, s.high), []).append(s)
    sketches = [
        F.percentile_approx(group[0].value(), [f for s in group for f in s.fractions()], _ACCURACY).alias(f"b{i}")
        for i, group in enumerate(shared.values())
    ]
    row = df.agg(*sketches).first()
    found = {
        id(s): (bounds[2 * j], bounds[2 * j + 1])
        for bounds, group in zip(row, shared.values())
        for j, s in enumerate(group)
    }
    return [found[id(s)] for s in searches]


def order_statistics(
    df: DataFrame, ranks_of: dict[str, tuple[int, list[int]]], exact_rows: int = EXACT_ROWS
) -> dict[str, list[float]]:
    """Exact values at zero-based ranks: ``{column: (non-null rows, ranks)}`` to ``{column: values}``.

    A bounded sketch gives a value bracket around each rank, a count verifies it, and only values strictly
    inside go on, until they fit one buffer. All columns and ranks share a pass; a pass returns one row, and
    each round shrinks the rows by a factor of thousands, whatever the distribution.
    """
    searches = [_Search(c, n, r) for c, (n, ranks) in ranks_of.items() for r in ranks]
    while wide := [s for s in searches if s.found is None and s.rows > exact_rows]:
        brackets = _brackets(df, wide)
        counts = df.agg(*[s.counts(*brackets[i]).alias(f"c{i}") for i, s in enumerate(wide)]).first()
        for i, s in enumerate(wide):
            s.narrow(*brackets[i], counts[i])
    if rest := [s for s in searches if s.found is None]:
        values = df.select(*[s.value().alias(f"v{i}") for i, s in enumerate(rest)])
        picked = values.agg(
            *[
                # the fraction half-way into the rank's step picks exactly that element
                F.expr(f"percentile_disc({(s.rank + 0.5) / s.rows!r}D) within group (order by v{i})")
                for i, s in enumerate(rest)
            ]
        ).first()
        for i, s in enumerate(rest):
            s.found = picked[i]
    found = iter(searches)
    return {c: [float(next(found).found) for _ in ranks] for c, (_, ranks) in ranks_of.items()}


@dataclass(frozen=True)
class Fence:
    column: str
    values: int
    q1: float | None
    q3: float | None
    lower: float
    upper: float

    @property
    def active(self) -> bool:
        return self.values >= 4

    def outside(self) -> Column:
        c = F.col(_q(self.column))
        return (c < self.lower) | (c > self.upper) if self.active else F.lit(False)


def fences(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, exact_rows: int = EXACT_ROWS
) -> list[Fence]:
    """Tukey fences of numeric columns from the values at positions n//4 and 3n//4.

    With fewer than four values the fences are the extremes and nothing is flagged.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return []
    row = df.agg(
        *[F.count(_q(c)).alias(f"n#{c}") for c in columns],
        *[F.min(_q(c)).cast("double").alias(f"lo#{c}") for c in columns],
        *[F.max(_q(c)).cast("double").alias(f"hi#{c}") for c in columns],
    ).first()
    n = {c: row[f"n#{c}"] for c in columns}
    big_enough = {c: (n[c], _quartile_ranks(n[c])) for c in columns if n[c] >= 4}
    quartiles = order_statistics(df, big_enough, exact_rows) if big_enough else {}
    out = []
    for c in columns:
        if c in quartiles:
            q1, q3 = quartiles[c]
            spread = q3 - q1
            out.append(Fence(c, n[c], q1, q3, q1 - multiplier * spread, q3 + multiplier * spread))
        else:
            low, high = row[f"lo#{c}"], row[f"hi#{c}"]
            out.append(Fence(c, n[c], None, None, 0.0 if low is None else low, 0.0 if high is None else high))
    return out


def outlier_fences(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5) -> DataFrame:
    """One row per column: fences, outliers and checked values."""
    return _fence_rows(df, fences(df, columns, multiplier))


_FENCE_ROW = (
    "array<struct<column:string,lower_fence:double,upper_fence:double,outlier_count:bigint,value_count:bigint>>"
)


def _fence_facts(marks: Sequence[Fence]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(m.column).alias("column"),
                F.lit(m.lower).alias("lower_fence"),
                F.lit(m.upper).alias("upper_fence"),
                F.count_if(m.outside()).alias("outlier_count"),
                F.lit(m.values).alias("value_count"),
            )
            for m in marks
        ]
    ).cast(_FENCE_ROW)


def _fence_rows(df: DataFrame, marks: Sequence[Fence]) -> DataFrame:
    return df.agg(_fence_facts(marks).alias("rows")).select(F.inline("rows"))


def outlier_rows(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    """The rows strictly outside the fences of a column; the limits are plain literals for the scan."""
    return df.filter(fences(df, [column], multiplier)[0].outside())


# --- overall score --------------------------------------------------------------------------------


def quality_score(df: DataFrame, rules: Sequence[SchemaRule] = (), multiplier: float = 1.5) -> DataFrame:
    """One row: completeness, validity, outlier share and the weighted overall score.

    After the fences are known, one pass gives all parts.
    """
    marks = [m for m in fences(df, None, multiplier) if m.active]
    facts = df.agg(*_cell_counts(df), _checks(df, rules).alias("checks"), _fence_facts(marks).alias("marks"))
    errors = F.size(F.filter("checks", lambda f: f["severity"] == "error"))
    total = lambda name: F.aggregate("marks", F.lit(0).cast("bigint"), lambda n, m: n + m[name])
    parts = facts.select(
        _share_filled().alias("completeness"),
        F.greatest(F.lit(0.0), 1.0 - errors * 0.1).alias("validity"),
        F.coalesce(1.0 - ratio(total("outlier_count"), total("value_count")), F.lit(1.0)).alias("outlier_score"),
    )
    overall = 0.4 * F.col("completeness") + 0.4 * F.col("validity") + 0.2 * F.col("outlier_score")
    return parts.withColumn("overall_score", round_to(overall, 4))


def recommendations(df: DataFrame, rules: Sequence[SchemaRule] = (), multiplier: float = 1.5) -> DataFrame:
    """Advice texts with their order of importance."""
    name = lambda tail: F.concat(F.lit("Column '"), F.col("column"), F.lit("' "), tail)
    table = completeness(df).filter("completeness < 0.9")
    parts = [
        table.select(
            F.lit(1).alias("step"),
            F.lit(0).alias("position"),
            F.lit("Data completeness is below 90%; consider imputing or collecting missing values").alias("advice"),
        )
    ]
    per_column = profile(df).select(
        "position",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("null_ratio") > 0.5, name(F.lit("is over 50% null; consider dropping or imputing"))
                    ),
                    F.when(
                        (F.col("dtype") == "numeric")
                        & (F.col("cardinality_ratio") < 0.01)
                        & (F.col("unique_count") > 0),
                        name(F.lit("has very low cardinality; may be categorical")),
                    ),
                )
            )
        ).alias("advice"),
    )
    parts.append(per_column.select(F.lit(2).alias("step"), "position", "advice"))
    errors = check_schema(df, rules).agg(F.count_if(F.col("severity") == "error").alias("n")).filter("n > 0")
    parts.append(
        errors.select(
            F.lit(3).alias("step"),
            F.lit(0).alias("position"),
            F.concat(
                F.lit("Schema validation found "),
                F.col("n").cast("string"),
                F.lit(" error(s); review data pipeline"),
            ).alias("advice"),
        )
    )
    marks = [m for m in fences(df, None, multiplier) if m.active]
    spots = _fence_rows(df, marks).filter("outlier_count > 0")
    parts.append(
        spots.select(
            F.lit(4).alias("step"),
            F.lit(0).alias("position"),
            name(
                F.concat(
                    F.lit("has "), F.col("outlier_count").cast("string"), F.lit(" outlier(s); review for data errors")
                )
            ).alias("advice"),
        )
    )
    return reduce(DataFrame.unionByName, parts)
