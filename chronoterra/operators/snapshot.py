"""Branch snapshots of the append-only version log.

The latest version of a feature, by (created_at, version_id), wins before deletes are removed. Winners
are found on the three id columns alone, by a hash aggregate with map-side combining; the wide columns
are then joined by version. A filter on them (a window on the coordinates, say) so reaches the scan of
the log, and wide rows are never sorted to be aggregated.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import valid_at
from .history import ancestors, closure, small

ORDER = ("created_at", "version_id")
_STEP = Decimal(10**19)


def rank(order: tuple[str, str] = ORDER) -> Column:
    """Both order columns as one decimal: unlike a struct, it lets max() run in a hash aggregate."""
    most, least = (F.col(c).cast("decimal(19,0)") for c in order)
    return most * F.lit(_STEP) + least


def latest(versions: DataFrame, keys: tuple[str, ...] = ("feature_id",), order: tuple[str, str] = ORDER) -> DataFrame:
    """The newest row per key, deletes included. ``order`` are two whole-number columns, the last of them unique per key."""
    best = versions.groupBy(*keys).agg(F.max(rank(order)).alias("_rank"))
    return versions.withColumn("_rank", rank(order)).join(best, [*keys, "_rank"]).drop("_rank")


def live(rows: DataFrame) -> DataFrame:
    return rows.filter("operation <> 'delete'")


def of_changesets(versions: DataFrame, chain: DataFrame) -> DataFrame:
    """Versions of the changesets in ``chain`` (id). The chain is the side that is broadcast, if its count allows it."""
    return versions.join(small(chain.select(F.col("id").alias("changeset_id"))), "changeset_id", "left_semi")


def resolve(versions: DataFrame, changesets: DataFrame, head: int) -> DataFrame:
    """Latest versions along the parent chain of ``head``, deletes included."""
    return latest(of_changesets(versions, ancestors(changesets, head, both=False)))


def snapshot(versions: DataFrame, changesets: DataFrame, head: int) -> DataFrame:
    return live(resolve(versions, changesets, head))


def all_branches(versions: DataFrame, changesets: DataFrame, branches: DataFrame) -> DataFrame:
    """Live features of every branch at once, with column branch."""
    chains = closure(changesets, branches.select(F.col("head").alias("id"))).select("start", F.col("id").alias("changeset_id"))
    own = branches.select(F.col("name").alias("branch"), F.col("head").alias("start"))
    rows = versions.join(small(chains), "changeset_id").join(small(own), "start").drop("start")
    return live(latest(rows, ("branch", "feature_id")))


def feature_at(versions: DataFrame, changesets: DataFrame, changeset: int, feature_id: int) -> DataFrame:
    """One feature as it stood at a changeset; no row if it wasn't there. The id reaches the scan of the log."""
    return snapshot(versions.filter(F.col("feature_id") == feature_id), changesets, changeset)


def page(rows: DataFrame, cursor: int | None = None, limit: int = 100, where: Column | None = None, valid: Column | None = None) -> DataFrame:
    """Keyset page by feature_id; the limit is held between 1 and 10,000.

    With an instant ``valid``, only rows valid then: from valid_from on and before valid_to, either open if null.
    """
    rows = rows if where is None else rows.filter(where)
    rows = rows if valid is None else rows.filter(valid_at(valid, F.col("valid_from"), F.col("valid_to")))
    rows = rows if cursor is None else rows.filter(F.col("feature_id") > cursor)
    return rows.orderBy("feature_id").limit(max(1, min(limit, 10_000)))


def time_travel(versions: DataFrame, changesets: DataFrame, branch: str, at: int) -> DataFrame:
    """Live features as the branch stood at time ``at``: from its newest own changeset of that time."""
    head = changesets.filter((F.col("branch") == branch) & (F.col("created_at") <= at)).agg(F.max_by("id", F.struct("created_at", "id"))).first()[0]
    if head is None:
        return versions.limit(0)
    return snapshot(versions.filter(F.col("created_at") <= at), changesets, head)


def compact(versions: DataFrame, branch_changesets: DataFrame, keep: int) -> DataFrame:
    """The log without all but the newest ``keep`` versions per feature among the branch's own changesets."""
    own = of_changesets(versions, branch_changesets)
    newest = Window.partitionBy("feature_id").orderBy(*[F.desc(c) for c in ORDER])
    gone = own.withColumn("n", F.row_number().over(newest)).filter(F.col("n") > keep).select("version_id")
    return versions.join(gone, "version_id", "left_anti")
