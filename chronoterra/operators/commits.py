"""Writes to the version log: commits, forks, and what a peer has to pull or may push.

A write is two frames to append, one changeset and its versions; the caller appends both and moves the
branch's head in one step of its table format. Each checks the head it was planned against, so that of
two writers the slower one is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import ancestors, small
from .snapshot import latest, live, of_changesets, resolve
from .spatial import object_ids


def appended(versions: DataFrame, changes: DataFrame, changeset_id: int, created_at: int) -> DataFrame:
    """``changes`` (feature_id and content columns) as rows of the log; ids go on from the highest one, in order of feature_id."""
    last = versions.agg(F.coalesce(F.max("version_id"), F.lit(0))).first()[0]
    known = {"version_id": F.lit(last) + F.col("oid"), "changeset_id": F.lit(changeset_id), "created_at": F.lit(created_at)}
    numbered = object_ids(changes)
    kinds = {f.name: f.dataType for f in versions.schema.fields}
    missing = lambda c: F.col(c) if c in changes.columns else F.lit(None)
    return numbered.select(*[known.get(c, missing(c)).cast(kinds[c]).alias(c) for c in versions.columns])


VALID = ("valid_from", "valid_to")


def of_features(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The part of the log that is about changed features, before anything of it is resolved."""
    return versions.join(small(changes.select("feature_id").distinct()), "feature_id", "left_semi")


def inherited(chain_log: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` with what updates omit: coordinates, properties and valid times (both null) of the feature's
    newest version in ``chain_log`` (versions of the branch's own chain) that isn't a delete; raises where there is none."""
    missing = {c: chain_log.schema[c].dataType for c in ("properties", "lng", "lat", *VALID) if c in chain_log.columns and c not in changes.columns}
    whole = changes.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in missing.items()])
    parts = [part for part in (("lng", "lat"), ("properties",), VALID) if set(part) <= set(chain_log.columns)]
    absent = lambda part: reduce(lambda x, y: x & y, [F.col(f"c.{x}").isNull() for x in part])
    old = chain_log.filter("operation <> 'delete'")
    best = old.groupBy("feature_id").agg(F.max("version_id").alias("version_id"))
    old = old.join(best, ["feature_id", "version_id"]).select("feature_id", *[F.col(x).alias(f"_{x}") for part in parts for x in part], F.lit(True).alias("_known"))
    met = whole.alias("c").join(old, "feature_id", "left")
    update = F.col("c.operation") == "update"
    needed = [part for part in parts if part is not VALID]
    lost = met.filter(update & F.col("_known").isNull() & reduce(lambda x, y: x | y, [absent(part) for part in needed]))
    if bad := lost.select("feature_id").take(1):
        raise ValueError(f"update of feature {bad[0].feature_id} has nothing to inherit from")
    filled = {x: F.when(update & absent(part), F.col(f"_{x}")).otherwise(F.col(f"c.{x}")) for part in parts for x in part}
    return met.select(*[filled.get(x, F.col(f"c.{x}") if x != "feature_id" else F.col(x)).alias(x) for x in whole.columns])


def commit(versions: DataFrame, changesets: DataFrame, branches: DataFrame, branch: str, changes: DataFrame, changeset_id: int, created_at: int, expected_head: int | None = None, validate: bool = True, merge_parent: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions to append, changeset to append, branches with the new head).

    ``changes`` are (feature_id, operation) and content, one row per feature; what an update leaves null or
    out is taken from the feature's newest version on the branch (see inherited). With ``validate``, an
    insert of a live feature and an update or delete of one that isn't are refused; without it (a batch)
    they are written as they are. ``expected_head`` is the head the writer has seen, ``merge_parent`` the
    head that a merge brings in. Only the log of the changed features is resolved.
    """
    row = branches.filter(F.col("name") == branch).first()
    if row is None:
        raise ValueError(f"no branch {branch!r}")
    if expected_head is not None and row.head != expected_head:
        raise ValueError(f"the head is {row.head}, not {expected_head}")
    if changes.groupBy("feature_id").agg(F.count("*").alias("n")).filter("n > 1").take(1):
        raise ValueError("a feature is changed twice")
    chain_log = versions.limit(0)
    if row.head is not None:
        chain_log = of_changesets(of_features(versions, changes), ancestors(changesets, row.head, both=False))
    if validate:
        now = live(latest(chain_log))
        told = changes.join(now.select("feature_id", F.lit(True).alias("lives")), "feature_id", "left")
        wrong = told.filter(((F.col("operation") == "insert") & F.col("lives").isNotNull()) | ((F.col("operation") != "insert") & F.col("lives").isNull()))
        if bad := wrong.select("feature_id", "operation").take(1):
            raise ValueError(f"{bad[0].operation} of feature {bad[0].feature_id} isn't possible")
    spark = versions.sparkSession
    fresh = spark.createDataFrame([(changeset_id, row.head, merge_parent, branch, created_at)], "id long, parent_id long, merge_parent_id long, branch string, created_at long")
    kinds = {f.name: f.dataType for f in changesets.schema.fields}
    fresh = fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in changesets.columns])
    moved = branches.withColumn("head", F.when(F.col("name") == branch, F.lit(changeset_id).cast("long")).otherwise(F.col("head")))
    return appended(versions, inherited(chain_log, changes), changeset_id, created_at), fresh, moved


def fork(branches: DataFrame, name: str, source: str | None = None) -> DataFrame:
    """``branches`` with one more, at the head of ``source``, or without a head."""
    if not branches.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"branch {name!r} exists")
    none = F.lit(None).cast(branches.schema["head"].dataType)
    if source is None:
        fresh = branches.sparkSession.range(1).select(F.lit(name).alias("name"), none.alias("head"))
    else:
        fresh = branches.filter(F.col("name") == source).select(F.lit(name).alias("name"), "head")
        if fresh.isEmpty():
            raise ValueError(f"no branch {source!r}")
    return branches.select("name", "head").union(fresh)


def pull(versions: DataFrame, changesets: DataFrame, head: int, since: int | None = None) -> DataFrame:
    """What a peer at ``since`` lacks, the newest version per feature with deletes; everything live for a new peer."""
    if since is None:
        return live(resolve(versions, changesets, head))
    new = ancestors(changesets, head).select("id").join(ancestors(changesets, since).select("id"), "id", "left_anti")
    return latest(of_changesets(versions, new))


def push(versions: DataFrame, changesets: DataFrame, branches: DataFrame, branch: str, base: int, changes: DataFrame, changeset_id: int, created_at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A peer's changes as one commit without validation; refused unless ``base`` is the branch's head."""
    return commit(versions, changesets, branches, branch, changes, changeset_id, created_at, expected_head=base, validate=False)


def distance_behind(changesets: DataFrame, head: int, peer: int, most: int = 1000) -> int:
    """Changesets between ``peer`` and the head of its branch; -1 if it isn't among the last ``most``."""
    found = ancestors(changesets, head, both=False).filter((F.col("id") == peer) & (F.col("depth") < most)).first()
    return -1 if found is None else int(found.depth)


def extract_changes(versions: DataFrame, changesets: DataFrame, head: int, since: int) -> DataFrame:
    """(feature_id, change, version columns) between a generation in time and the head.

    The base is the newest changeset of the chain at or before ``since``. change is add, update or delete,
    by whether the feature lived at the base; what came and went in between is left out.
    """
    chain = changesets.join(ancestors(changesets, head, both=False), "id")
    base = chain.filter(F.col("created_at") <= since).agg(F.max(F.struct("created_at", "id")).alias("b")).first().b
    if base is None:
        return live(resolve(versions, changesets, head)).withColumn("change", F.lit("add"))
    now = latest(of_changesets(versions, chain.filter((F.col("created_at") > base.created_at) | ((F.col("created_at") == base.created_at) & (F.col("id") > base.id))).select("id")))
    before = live(resolve(versions, changesets, base.id)).select("feature_id", F.lit(True).alias("lived"))
    gone, lived = F.col("operation") == "delete", F.col("lived").isNotNull()
    change = F.when(gone & lived, "delete").when(~gone & lived, "update").when(~gone, "add")
    return now.join(before, "feature_id", "left").withColumn("change", change).filter("change is not null").drop("lived")


def event_clock(*clocks: DataFrame) -> int | None:
    """The greatest created_at of all given frames; null stamps and empty frames don't count."""
    found = [x for d in clocks if (x := d.agg(F.max("created_at")).first()[0]) is not None]
    return max(found, default=None)
