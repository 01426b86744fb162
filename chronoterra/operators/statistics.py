"""Grouped statistics over typed attributes, with having, stable order and a page probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATS = {"count": F.count, "sum": F.sum, "avg": F.avg, "stddev": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}
NEEDS_NUMBER = {"sum", "avg", "stddev", "var"}
MAX_STATS, MAX_GROUPS = 32, 16


def out_statistics(rows: DataFrame, statistics: list[tuple[str, str] | tuple[str, str, str]], group_by: list[str] = (), having: Column | None = None, limit: int | None = None) -> DataFrame:
    """``statistics`` are (statistic, field[, name]); the name defaults to statistic_field.

    Rows come in the order of the group columns, nulls last, as a total order over all columns.
    """
    if not 0 < len(statistics) <= MAX_STATS or len(group_by) > MAX_GROUPS:
        raise ValueError(f"one to {MAX_STATS} statistics and at most {MAX_GROUPS} groups")
    kinds, cols = dict(rows.dtypes), []
    for stat, field, *name in statistics:
        if stat not in _STATS or (stat in NEEDS_NUMBER and kinds[field] in ("string", "boolean", "binary")):
            raise ValueError(f"{stat} of {field} isn't possible")
        cols.append(_STATS[stat](field).alias(name[0] if name else f"{stat}_{field}"))
    out = rows.groupBy(*group_by).agg(*cols)
    out = out if having is None else out.filter(having)
    out = out.orderBy(*[F.col(c).asc_nulls_last() for c in out.columns])
    return out if limit is None else out.limit(limit + 1)  # one row more tells that the limit was exceeded


def distinct_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select(*fields).distinct()


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)
