"""Record validation by rule lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import FINDING, blank, finding, findings, ratio, round_to


@dataclass(frozen=True)
class Rule:
    """One check of one field: required, type, range, regex or custom."""

    field: str
    rule_type: str
    params: Mapping = field(default_factory=dict)
    message: str = ""


def required(name: str, message: str = "") -> Rule:
    return Rule(name, "required", {}, message or f"{name} is required")


def of_type(name: str, expected: str, message: str = "") -> Rule:
    return Rule(name, "type", {"type": expected}, message or f"{name} must be {expected}")


def in_range(name: str, low: float | None = None, high: float | None = None, message: str = "") -> Rule:
    limits = {k: v for k, v in (("min", low), ("max", high)) if v is not None}
    return Rule(name, "range", limits, message or f"{name} out of range")


def matching(name: str, pattern: str, message: str = "") -> Rule:
    return Rule(name, "regex", {"pattern": pattern}, message or f"{name} does not match pattern")


def custom(name: str, check: Callable[[Column], Column], message: str = "") -> Rule:
    """``check`` gets the column and returns a boolean column; use a pandas UDF inside if needed."""
    return Rule(name, "custom", {"validator": check}, message or f"{name} failed custom validation")


def rules_from_config(config: Sequence[Mapping]) -> list[Rule]:
    return [Rule(c["field"], c["rule_type"], c.get("params", {}), c.get("message", "")) for c in config]


class _Value:
    """A field seen through the checks: present, text form, number form and type, typed or variant."""

    def __init__(self, df: DataFrame, name: str):
        known = {f.name: f.dataType for f in df.schema}
        self.dtype = known.get(name, T.NullType())
        self.col = F.col(f"`{name}`") if name in known else F.lit(None).cast("string")
        self.variant = isinstance(self.dtype, T.VariantType)
        self.kind = F.schema_of_variant(self.col) if self.variant else None
        if self.variant:
            self.present = F.coalesce(self.kind != "VOID", F.lit(False))
        else:
            self.present = self.col.isNotNull()

    def is_a(self, expected: str) -> Column:
        if self.variant:
            whole = self.kind.isin("BIGINT", "BOOLEAN") | self.kind.rlike(r"^DECIMAL\([0-9]+,0\)$")
            number = whole | self.kind.isin("DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")
            tests = {"str": self.kind == "STRING", "int": whole, "float": number, "bool": self.kind == "BOOLEAN"}
            return tests.get(expected, F.lit(True))
        # booleans count as whole numbers
        whole = (T.IntegralType, T.BooleanType)
        accepted = {"str": T.StringType, "int": whole, "float": (T.NumericType, *whole), "bool": T.BooleanType}
        return F.lit(expected not in accepted or isinstance(self.dtype, accepted[expected]))

    def number(self) -> Column:
        """The value as a double where it is a number, else NULL; NaN counts as no number."""
        if self.variant:
            flag = F.try_variant_get(self.col, "$", "boolean").cast("double")
            plain = F.try_variant_get(self.col, "$", "double")
            x = F.when(self.kind == "BOOLEAN", flag).when(self.is_a("float"), plain)
        elif isinstance(self.dtype, (T.NumericType, T.BooleanType)):
            x = self.col.cast("double")
        else:
            return F.lit(None).cast("double")
        return F.when(~F.isnan(x), x)

    def text(self) -> Column:
        """The value where it is a text, else NULL."""
        if self.variant:
            return F.when(self.kind == "STRING", F.try_variant_get(self.col, "$", "string"))
        return self.col if isinstance(self.dtype, T.StringType) else F.lit(None).cast("string")

    def shown(self) -> Column:
        if self.variant:
            return F.coalesce(self.text(), F.to_json(self.col))
        simple = not isinstance(self.dtype, (T.ArrayType, T.MapType, T.StructType))
        return self.col.cast("string") if simple else F.to_json(self.col)


def _fails(rule: Rule, v: _Value) -> Column:
    if rule.rule_type == "required":
        return ~v.present | (v.text().isNotNull() & blank(v.text()))
    if rule.rule_type == "type":
        return v.present & ~v.is_a(rule.params["type"])
    if rule.rule_type == "range":
        x, out = v.number(), F.lit(False)
        if "min" in rule.params:
            out = out | (x < rule.params["min"])
        if "max" in rule.params:
            out = out | (x > rule.params["max"])
        return out
    if rule.rule_type == "regex":
        return ~v.text().rlike(rf"\A(?:{rule.params['pattern']})")  # anchored at the start only
    if rule.rule_type == "custom" and rule.params.get("validator"):
        return v.present & ~rule.params["validator"](v.col)
    return F.lit(False)


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The records with ``errors`` (in rule order) and ``is_valid``."""
    checks = []
    for rule in rules:
        v = _Value(df, rule.field)
        checks.append(finding(_fails(rule, v), rule.field, rule.rule_type, rule.message, v.shown()))
    errors = findings(checks)
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def validation_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failing records per rule, in rule order, from one pass over the table."""
    counted = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("rule"),
            F.lit(r.field).alias("field"),
            F.lit(r.rule_type).alias("rule_type"),
            F.lit(r.message).alias("message"),
            F.count_if(F.coalesce(_fails(r, _Value(df, r.field)), F.lit(False))).alias("failures"),
            F.count(F.lit(1)).alias("records"),
        )
        for i, r in enumerate(rules)
    ]
    return df.agg(F.array(*counted).alias("r")).select(F.inline("r"))


# --- completeness of scraped items ----------------------------------------------------------------


def _filled(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)) != "", F.lit(False))


def item_completeness(
    items: DataFrame,
    keys: Sequence[str],
    required_fields: Sequence[str],
    min_items: int = 0,
    lists: DataFrame | None = None,
) -> DataFrame:
    """Share of filled required fields per item list in percent, one decimal, and the count warning.

    ``lists`` names all item lists by their keys (rows may repeat), so that lists without items get a row too: they
    lack no field (100 %) and have too few items. Both inputs are counted together, in one shuffle.
    """
    present = sum((_filled(f).cast("bigint") for f in required_fields), F.lit(0).cast("bigint"))
    rows = items.select(*keys, F.lit(1).alias("items"), present.alias("present"))
    if lists is not None:
        rows = rows.unionByName(lists.select(*keys, F.lit(0).alias("items"), F.lit(0).cast("bigint").alias("present")))
    sums = rows.groupBy(*keys).agg(F.sum("items").alias("item_count"), F.sum("present").alias("present_fields"))
    total = F.col("item_count") * len(required_fields)
    score = F.coalesce(round_to(ratio(F.col("present_fields"), total) * 100, 1), F.lit(100.0))
    few = F.concat(
        F.lit(f"Expected at least {min_items} items, got "), F.col("item_count").cast("string")
    )
    return sums.withColumns(
        {
            "completeness_score": score,
            "count_warning": F.when(F.col("item_count") < min_items, few),
        }
    )


def missing_item_fields(items: DataFrame, keys: Sequence[str], required_fields: Sequence[str]) -> DataFrame:
    """One warning row per missing or empty required field; ``pos`` is the item's place in its list."""
    place = F.col("pos").cast("string")
    gaps = [
        finding(
            ~_filled(f),
            F.concat(F.lit("data["), place, F.lit(f"].{f}")),
            "missing",
            F.concat(F.lit(f"Missing or empty field '{f}' in item "), place),
        )
        for f in required_fields
    ]
    if not gaps:
        return items.select(*keys, F.inline(F.array().cast(f"array<{FINDING}>")))
    return items.select(*keys, F.inline(findings(gaps)))
