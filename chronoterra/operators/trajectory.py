"""Trajectories from timed fixes (traj, ts in seconds, lng, lat): length, speeds, position at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.columns import haversine
from .geometry import kept_places
from .history import checkpoint


def segments(fixes: DataFrame) -> DataFrame:
    """One row per fix and its successor."""
    w = Window.partitionBy("traj").orderBy("ts", "seq")
    nxt = {f"{c}2": F.lead(c).over(w) for c in ("ts", "lng", "lat")}
    s = fixes.withColumns(nxt).filter("ts2 is not null")
    return s.withColumn("metres", haversine(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"))).withColumn("seconds", F.col("ts2") - F.col("ts"))


def summary(fixes: DataFrame) -> DataFrame:
    """(traj, metres, mean_speed, max_speed): the mean is time-weighted; instants without duration have no speed."""
    s = segments(fixes)
    speed = F.when(F.col("seconds") > 0, F.col("metres") / F.col("seconds"))
    total = F.sum("seconds")
    return s.groupBy("traj").agg(F.sum("metres").alias("metres"), F.when(total > 0, F.sum("metres") / total).alias("mean_speed"), F.max(speed).alias("max_speed"))


def position_at(fixes: DataFrame, ts: float) -> DataFrame:
    """Linear interpolation; trajectories whose period doesn't hold ``ts`` are absent."""
    s = segments(fixes).filter((F.col("ts") <= ts) & (F.col("ts2") > ts))
    f = (F.lit(float(ts)) - F.col("ts")) / F.col("seconds")
    return s.select("traj", (F.col("lng") + f * (F.col("lng2") - F.col("lng"))).alias("lng"), (F.col("lat") + f * (F.col("lat2") - F.col("lat"))).alias("lat"))


def periods(fixes: DataFrame) -> DataFrame:
    """(traj, n, start, end): number of fixes and period."""
    return fixes.groupBy("traj").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


#: Fixes of an interval that one task walks, and intervals (about 80 bytes each) up to which they are broadcast.
WALKED, BROADCAST_INTERVALS = 10_000, 500_000


def kept_fixes(fixes: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(traj, ts, seq, lng, lat) of the fixes that Douglas-Peucker keeps, for trajectories of any length.

    While intervals of over WALKED fixes are open, a round takes the fix farthest from the chord of each, by
    one aggregate with map-side combining, and splits it there if that is farther than ``tolerance``
    (degrees). Shorter intervals are walked by a task each. A fix carries the start of its interval alone.
    """
    own = fixes.filter("lng is not null and lat is not null").select("traj", F.struct("ts", "seq").alias("at"), F.col("lng").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    fix = F.struct("at", "x", "y")
    ends = checkpoint(own.groupBy("traj").agg(F.min_by(fix, "at").alias("a"), F.max_by(fix, "at").alias("b"), (F.count("*") - 2).alias("n")))
    kept = ends.select("traj", F.explode(F.array("a", "b")).alias("p")).distinct()
    intervals = ends.select("traj", F.col("a.at").alias("lo"), "a", "b", "n")
    open_ = own.join(ends.select("traj", F.col("a.at").alias("lo"), F.col("b.at").alias("hi")), "traj").filter("at > lo and at < hi").drop("hi")
    small = lambda d: F.broadcast(d) if d.count() <= BROADCAST_INTERVALS else d
    while True:
        short, long = intervals.filter(F.col("n") <= WALKED), intervals.filter(F.col("n") > WALKED)
        kept = kept.union(_walked(open_.join(short.filter("n > 0").drop("n"), ["traj", "lo"]), tolerance))
        if long.isEmpty():
            return kept.select("traj", "p.at.ts", "p.at.seq", F.col("p.x").alias("lng"), F.col("p.y").alias("lat"))
        met = open_.join(small(long), ["traj", "lo"])
        px, py, dx, dy = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y"), F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / size))).otherwise(0.0)
        far = (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)
        # of equally far fixes the first
        first = F.struct(far.alias("far"), (-F.col("at.ts")).alias("ts"), (-F.col("at.seq")).alias("seq"))
        best = met.groupBy("traj", "lo").agg(F.max_by(fix, first).alias("m"), F.max(far).alias("far"))
        split = checkpoint(best.filter(F.col("far") > tolerance * tolerance).select("traj", "lo", "m"))
        kept = kept.union(split.select("traj", F.col("m").alias("p")))
        later = F.when(F.col("at") > F.col("m.at"), F.col("m.at")).otherwise(F.col("lo"))
        open_ = checkpoint(open_.join(small(split), ["traj", "lo"]).filter(F.col("at") != F.col("m.at")).select("traj", later.alias("lo"), "at", "x", "y"))
        halves = long.join(split, ["traj", "lo"]).select("traj", F.explode(F.array(F.struct("lo", "a", F.col("m").alias("b")), F.struct(F.col("m.at").alias("lo"), F.col("m").alias("a"), "b"))).alias("h"))
        counts = open_.groupBy("traj", "lo").agg(F.count("*").alias("n"))
        intervals = checkpoint(halves.select("traj", "h.lo", "h.a", "h.b").join(counts, ["traj", "lo"], "left").withColumn("n", F.coalesce("n", F.lit(0))))


def _kept_inside(paths: pa.ListArray, tolerance: float) -> pa.Array:
    """Places between the ends that each path keeps; one path at a time is in Python objects, not the whole batch."""
    flat = paths.flatten()
    x, y = (pc.struct_field(flat, c).to_numpy() for c in ("x", "y"))
    ends = np.cumsum(pc.list_value_length(paths).to_numpy())
    places = []
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        places.append(np.array(kept_places(list(zip(x[lo:hi].tolist(), y[lo:hi].tolist(), strict=True)), tolerance)[1:-1], np.int32))
    return pa.array(places, pa.list_(pa.int32()))


def _walked(rows: DataFrame, tolerance: float) -> DataFrame:
    """(traj, p) of the fixes kept in intervals (traj, lo, a, b) of bounded length."""
    fix = F.struct("at", "x", "y")
    whole = rows.groupBy("traj", "lo").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.array_sort(F.collect_list(fix)).alias("inner"))
    path = whole.select("traj", F.concat(F.array("a"), "inner", F.array("b")).alias("path"))
    one = StructType([path.schema["traj"], StructField("places", ArrayType(IntegerType())), path.schema["path"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _kept_inside(b.column(1), tolerance), b.column(1)], ["traj", "places", "path"])

    return path.mapInArrow(run, one).select("traj", F.explode(F.transform("places", lambda i: F.get("path", i))).alias("p"))


def simplify(fixes: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(traj, before, after, path): each trajectory's path by Douglas-Peucker; only what is kept is gathered."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("x"), p["lat"].alias("y")))
    before = fixes.filter("lng is not null and lat is not null").groupBy("traj").agg(F.count("*").cast("int").alias("before"))
    after = kept_fixes(fixes, tolerance).groupBy("traj").agg(path.alias("path"))
    return before.join(after, "traj").select("traj", "before", F.size("path").alias("after"), "path")


def nearest_approach(fixes: DataFrame, a: int, b: int) -> DataFrame:
    """(ts, metres) when two trajectories are nearest at one time, the first such instant; no row if they share no time.

    Both are placed at every fix of either; between two such instants both move straight, so the nearest
    point of the relative motion is the projection of the origin, held to the interval.
    """
    s = segments(fixes.filter(F.col("traj").isin(a, b))).filter("seconds > 0")
    first, last, n = s.agg(F.min("ts"), F.max("ts2"), F.count("*")).first()
    if not n:
        return fixes.select("ts", F.lit(0.0).alias("metres")).limit(0)
    width = max((last - first) / n, 1e-6)  # pieces meet in slots of time of about their length
    slot = lambda t: F.floor((t - first) / width).cast("long")
    named = lambda i, n: s.filter(F.col("traj") == i).select(*[F.col(c).alias(f"{n}_{c}") for c in ("ts", "ts2", "lng", "lat", "lng2", "lat2")], F.explode(F.sequence(slot(F.col("ts")), slot(F.col("ts2")))).alias("slot"))
    met = named(a, "a").join(named(b, "b"), "slot").filter((F.col("a_ts") < F.col("b_ts2")) & (F.col("b_ts") < F.col("a_ts2")) & (F.col("slot") == slot(F.greatest("a_ts", "b_ts"))))
    lo, hi = F.greatest("a_ts", "b_ts"), F.least("a_ts2", "b_ts2")
    at = lambda n, c, t: F.col(f"{n}_{c}") + (t - F.col(f"{n}_ts")) / (F.col(f"{n}_ts2") - F.col(f"{n}_ts")) * (F.col(f"{n}_{c}2") - F.col(f"{n}_{c}"))
    gap = lambda c, t: at("a", c, t) - at("b", c, t)
    met = met.select("*", lo.alias("lo"), hi.alias("hi"))
    d0, d1 = ({c: gap(c, F.col(t)) for c in ("lng", "lat")} for t in ("lo", "hi"))
    move = {c: d1[c] - d0[c] for c in d0}
    size = move["lng"] * move["lng"] + move["lat"] * move["lat"]
    f = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(d0["lng"] * move["lng"] + d0["lat"] * move["lat"]) / size))).otherwise(0.0)
    when = met.select("*", (F.col("lo") + f * (F.col("hi") - F.col("lo"))).alias("ts"))
    placed = when.select("ts", *[at(n, c, F.col("ts")).alias(f"{n}{c}") for n in "ab" for c in ("lng", "lat")])
    metres = haversine(F.col("alng"), F.col("alat"), F.col("blng"), F.col("blat"))
    return placed.select("ts", metres.alias("metres")).orderBy("metres", "ts").limit(1)
