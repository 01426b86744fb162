"""Who may do what, whether attributes keep to a schema, and search in attributes.

Rules are small and become Columns; grants are tables and meet by semi, anti and equi joins.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, prop

#: The ladder of permissions.
LEVELS = {"read": 1, "write": 2, "admin": 3}


def _level() -> Column:
    c = F.lit(0)
    for name, n in LEVELS.items():
        c = F.when(F.col("permission") == name, n).otherwise(c)
    return c


def access_levels(branches: DataFrame, dataset_grants: DataFrame, branch_grants: DataFrame) -> DataFrame:
    """(branch, user, level): a branch with grants of its own is ruled by them alone, any other by its dataset's."""
    inherited = branches.join(branch_grants.select("branch"), "branch", "left_anti").join(dataset_grants, "dataset").select("branch", "user", "permission")
    return branch_grants.select("branch", "user", "permission").union(inherited).groupBy("branch", "user").agg(F.max(_level()).alias("level"))


def _field_error(field: dict[str, Any], properties: str) -> Column:
    """The first rule that the field breaks, in the order required, type, allowed, min, max; null if none."""
    text = prop(field["name"], properties)
    value = number(text)
    kind = field.get("type", "string")
    wrong = {"string": F.lit(False), "number": value.isNull(), "integer": value.isNull() | (value != F.floor(value)), "boolean": ~text.isin("true", "false")}[kind]
    error = F.when(text.isNull(), F.lit("required") if field.get("required") else F.lit(None)).when(wrong, "type")
    if "allowed" in field:
        error = error.when(~text.isin([str(v) for v in field["allowed"]]), "allowed")
    if "min" in field:
        error = error.when(value < float(field["min"]), "min")
    if "max" in field:
        error = error.when(value > float(field["max"]), "max")
    return error


def schema_errors(rows: DataFrame, fields: list[dict[str, Any]], properties: str = "properties") -> DataFrame:
    """(feature_id, field, error): one row per broken field; features that keep to the schema give none."""
    checks = F.array(*[F.struct(F.lit(f["name"]).alias("field"), _field_error(f, properties).alias("error")) for f in fields])
    return rows.select("feature_id", F.explode(F.filter(checks, lambda c: c["error"].isNotNull())).alias("e")).select("feature_id", "e.*")


def property_search(rows: DataFrame, key: str, text: str, properties: str = "properties") -> DataFrame:
    """Rows whose attribute holds ``text`` in any case; its signs mean nothing but themselves."""
    return rows.filter(F.lower(prop(key, properties)).contains(text.lower()))
