"""Diff and three-way merge of branches.

A diff is the latest version per feature of the changesets that are new in ``to``. A merge joins both
diffs and the base contents once and decides every feature with one chain of conditions; two updates
of different attributes combine key by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import json_entries, json_object
from .commits import VALID, appended, commit
from .history import ancestors, checkpoint, is_reachable, merge_base, reached, small
from .snapshot import latest, of_changesets

CONTENT = ("operation", "properties", "lng", "lat")


def content(versions: DataFrame) -> tuple[str, ...]:
    """The content columns of a log; valid times are content where it has them."""
    return CONTENT + tuple(c for c in VALID if c in versions.columns)


def diff(versions: DataFrame, changesets: DataFrame, start: int | None, end: int) -> DataFrame:
    """(feature_id and content) of what ``end`` has and ``start`` lacks; the latest row's operation counts."""
    new = ancestors(changesets, end) if start is None else reached(changesets, start, end).filter("not in_a")
    return latest(of_changesets(versions, checkpoint(new.select("id")))).select("feature_id", *content(versions))


def merged_properties(base: Column, ours: Column, theirs: Column) -> tuple[Column, Column]:
    """(merged JSON, whether a key conflicts): per key, the side that changed wins; equal changes agree; a missing key is a removal."""
    b, o, t = (F.coalesce(json_entries(c), F.create_map().cast("map<string,string>")) for c in (base, ours, theirs))
    keys = F.array_sort(F.array_union(F.array_union(F.map_keys(b), F.map_keys(o)), F.map_keys(t)))
    pick = lambda k: F.when(t[k].eqNullSafe(b[k]), o[k]).otherwise(t[k])
    clash = F.exists(keys, lambda k: ~o[k].eqNullSafe(b[k]) & ~t[k].eqNullSafe(b[k]) & ~o[k].eqNullSafe(t[k]))
    merged = F.map_filter(F.map_from_arrays(keys, F.transform(keys, pick)), lambda _, v: v.isNotNull())
    return json_object(merged), clash


def filled_properties(first: Column, second: Column) -> Column:
    """All keys of ``first``, and those of ``second`` that it lacks."""
    a, b = (F.coalesce(json_entries(c), F.create_map().cast("map<string,string>")) for c in (first, second))
    return json_object(F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))))


def _sides(changesets: DataFrame, target: int, source: int) -> DataFrame:
    """(changeset_id, ours, theirs, base): to which side of the merge a changeset belongs.

    ours and theirs are what each head reaches and the merge base doesn't; base is the base's parent chain.
    """
    flags = checkpoint(reached(changesets, target, source).withColumnsRenamed({"in_a": "ours", "in_b": "theirs"}))
    base = changesets.join(flags.filter("ours and theirs").select("id"), "id").agg(F.max(F.struct("created_at", "id")).alias("b")).first().b
    if base is None:
        return flags.select(F.col("id").alias("changeset_id"), "ours", "theirs", F.lit(False).alias("base"))
    known = ancestors(changesets, base.id).select("id", F.lit(True).alias("known"))
    chain = ancestors(changesets, base.id, both=False).select("id", F.lit(True).alias("base"))
    marked = flags.join(known, "id", "left").join(chain, "id", "full_outer")
    fresh = F.col("known").isNull()
    out = marked.select(F.col("id").alias("changeset_id"), *[(F.coalesce(c, F.lit(False)) & fresh).alias(c) for c in ("ours", "theirs")], F.coalesce("base", F.lit(False)).alias("base"))
    return checkpoint(out.filter("ours or theirs or base"))


def merge_choices(versions: DataFrame, changesets: DataFrame, target: int, source: int) -> DataFrame:
    """One row per feature changed on either side since the merge base: choice, and the content to write.

    choice: nothing, ours, theirs, merged, or one of delete_modify, geometry_conflict,
    property_conflict, full_conflict. The log is read once: the newest version of ours, of theirs and of
    the base are three conditional aggregates.
    """
    at = F.struct("created_at", "version_id")
    fields = content(versions)
    times = fields[len(CONTENT):]
    rows = versions.join(small(_sides(changesets, target, source)), "changeset_id")
    newest = lambda side: F.max_by(F.when(F.col(side), F.struct(*fields)), F.when(F.col(side), at))
    both = rows.groupBy("feature_id").agg(newest("ours").alias("o"), newest("theirs").alias("t"), newest("base").alias("b")).filter("o is not null or t is not null")
    gone = lambda c: F.col(c).isNull() | (F.col(f"{c}.operation") == "delete")
    place = lambda c: F.struct(f"{c}.lng", f"{c}.lat")
    same_place = lambda x, y: place(x).eqNullSafe(place(y))
    alike = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in ("properties", *times)]
    same = lambda x, y: (gone(x) & gone(y)) | reduce(lambda p, q: p & q, alike(x, y), ~gone(x) & ~gone(y) & same_place(x, y))
    props, clash = merged_properties(F.col("b.properties"), F.col("o.properties"), F.col("t.properties"))
    for c in times:  # a time that both sides changed differently is an attribute in conflict
        clash = clash | (~F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) & ~F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) & ~F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")))
    moved = ~same_place("o", "b") & ~same_place("t", "b") & ~same_place("o", "t")
    choice = (
        F.when(F.col("t").isNull(), F.when(same("o", "b"), "nothing").otherwise("ours"))
        .when(F.col("o").isNull(), F.when(same("t", "b"), "nothing").otherwise("theirs"))
        .when(same("o", "t") | same("t", "b"), "ours")
        .when(same("o", "b"), "theirs")
        .when(gone("o") | gone("t"), "delete_modify")
        .when(moved & clash, "full_conflict")
        .when(moved, "geometry_conflict")
        .when(clash, "property_conflict")
        .otherwise("merged")
    )
    there = lambda f: F.when(same_place("t", "b"), F.col(f"o.{f}")).otherwise(F.col(f"t.{f}"))
    when = [F.when(F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")), F.col(f"o.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in times]
    merged = F.struct(F.lit("update").alias("operation"), props.alias("properties"), there("lng").alias("lng"), there("lat").alias("lat"), *when)
    picked = both.withColumn("choice", choice)
    kept = F.when(F.col("choice") == "ours", F.col("o")).when(F.col("choice") == "theirs", F.col("t")).when(F.col("choice") == "merged", merged)
    return picked.withColumn("c", kept).select("feature_id", "choice", *[F.col(f"c.{x}").alias(x) for x in fields])


def conflicts(choices: DataFrame) -> DataFrame:
    """(feature_id, choice, suggestion) of the features that need a decision."""
    hint = F.when(F.col("choice") == "delete_modify", "review").when(F.col("choice") == "full_conflict", "custom").otherwise("auto_merge")
    return choices.filter(F.col("choice").isin(*CONFLICTS)).select("feature_id", "choice", hint.alias("suggestion"))


CONFLICTS = ("delete_modify", "full_conflict", "geometry_conflict", "property_conflict")


def merge(versions: DataFrame, changesets: DataFrame, target: int, source: int, changeset_id: int, created_at: int) -> DataFrame:
    """Version rows that the merge appends to the target, in the columns of ``versions``; raises if any feature conflicts.

    A source that the target already reaches has nothing to merge. Version ids go on from the highest one.
    """
    if is_reachable(changesets, target, source):
        return versions.limit(0)
    choices = checkpoint(merge_choices(versions, changesets, target, source))
    if n := choices.filter(F.col("choice").isin(*CONFLICTS)).count():
        raise ValueError(f"{n} features conflict")
    return appended(versions, choices.filter(F.col("choice").isin("theirs", "merged")), changeset_id, created_at)


def merge_commit(versions: DataFrame, changesets: DataFrame, branches: DataFrame, target: str, source: str, changeset_id: int, created_at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions to append, changeset to append, branches with the new head) of a merge of two branches by name.

    The changeset names the source's head as its merge parent, so that the next merge of the same branches
    starts from there. A source that is merged already appends no version and no changeset.
    """
    heads = {r.name: r.head for r in branches.filter(F.col("name").isin(target, source)).collect()}
    if is_reachable(changesets, heads[target], heads[source]):
        return versions.limit(0), changesets.limit(0), branches
    rows = checkpoint(merge(versions, changesets, heads[target], heads[source], changeset_id, created_at))
    _, fresh, moved = commit(versions.limit(0), changesets, branches, target, rows.select("feature_id", "operation").limit(0), changeset_id, created_at, heads[target], validate=False, merge_parent=heads[source])
    return rows, fresh, moved


def resolve_conflicts(choices: DataFrame, strategies: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Content for conflicting features by their strategy (feature_id, strategy and, for custom ones, properties, lng, lat).

    ours, theirs, delete; auto_merge takes the place of theirs and fills the attributes of ours with
    those of theirs; custom takes the given content; valid times come from theirs with both; an unknown strategy is ours.
    """
    given = [c for c in ("properties", "lng", "lat") if c in strategies.columns]
    how = strategies.select("feature_id", "strategy", F.struct(*given).alias("g")) if given else strategies
    bad = choices.filter(F.col("choice").isin(*CONFLICTS)).select("feature_id").join(how, "feature_id")
    times = [c for c in VALID if c in ours.columns and c in theirs.columns]
    fields = [*CONTENT, *times]
    side = lambda d, n: d.select("feature_id", F.struct(*fields).alias(n))
    none = F.lit(None).cast("double")
    when = lambda of: [(F.col(f"{of}.{c}") if of else F.lit(None)).cast(ours.schema[c].dataType).alias(c) for c in times]
    pack = lambda op, p, x, y, of="t": F.struct(op.alias("operation"), p.alias("properties"), x.alias("lng"), y.alias("lat"), *when(of))
    joined = bad.join(side(ours, "o"), "feature_id", "left").join(side(theirs, "t"), "feature_id", "left")
    update, auto = F.lit("update"), filled_properties(F.col("o.properties"), F.col("t.properties"))
    pick = F.when(F.col("strategy") == "theirs", F.col("t")).when(F.col("strategy") == "delete", pack(F.lit("delete"), F.lit("{}"), none, none, None))
    pick = pick.when(F.col("strategy") == "auto_merge", pack(update, auto, F.col("t.lng"), F.col("t.lat")))
    if given:
        of = lambda c, kind: F.col(f"g.{c}").cast(kind) if c in given else F.lit(None).cast(kind)
        pick = pick.when(F.col("strategy") == "custom", pack(update, of("properties", "string"), of("lng", "double"), of("lat", "double")))
    return joined.withColumn("c", pick.otherwise(F.col("o"))).select("feature_id", "strategy", *[F.col(f"c.{x}").alias(x) for x in fields])


def resolve_and_merge(versions: DataFrame, changesets: DataFrame, target: int, source: int, strategies: DataFrame, changeset_id: int, created_at: int) -> DataFrame:
    """As merge(), with every conflict settled by its strategy; a conflict without one raises."""
    choices = checkpoint(merge_choices(versions, changesets, target, source))
    bad = choices.filter(F.col("choice").isin(*CONFLICTS)).select("feature_id")
    if n := bad.join(strategies.select("feature_id"), "feature_id", "left_anti").count():
        raise ValueError(f"{n} conflicts have no strategy")
    base = merge_base(changesets, target, source).first()
    settled = resolve_conflicts(choices, strategies, *(diff(versions, changesets, base and base.id, head) for head in (target, source)))
    clear = choices.filter(F.col("choice").isin("theirs", "merged"))
    return appended(versions, clear.select("feature_id", *content(versions)).union(settled.select("feature_id", *content(versions))), changeset_id, created_at)
