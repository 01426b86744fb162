"""Line dedup by site-relative frequency.

A line that stands on more than ``ratio`` of a host's pages is boilerplate of that host and is
dropped from all of them. Every row is one page; a line counts once per page however often it
repeats there.

Defined cases: null text stays null and has no lines; null host is the host ''; blank lines are
layout and are never dropped; repeated rows are pages of their own; an empty table gives an empty
table; other columns, whatever their names, pass through; very long texts are split whole; a line at the
ratio exactly stays. A line must be on ``min_pages`` pages at least, so a host with
two pages has no boilerplate. A document may end up with an empty text, it is never removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, quoted, with_name

RATIO = 0.1
MIN_PAGES = 3
#: Boilerplate lines (16 bytes each) up to which the per-host lists are broadcast; beyond it the
#: join shuffles on the host and Spark splits hot hosts.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    """96 bits that stand for a line, so that counting shuffles no text."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: (host, keys). keys has at most mean lines per page / ratio entries."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.trim("line") != "")
    counts = lines.select("host", _key(F.col("line")).alias("k")).groupBy("host", "k.h", "k.g").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.filter(F.col("n") >= min_pages).join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list(F.struct("h", "g")).alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with ``text`` rewritten, and two columns more: n_lines and n_dropped (int)."""
    rules = checkpoint(boilerplate(docs, host, text, ratio, min_pages))
    size = rules.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    h, k = with_name(docs, "_host"), with_name(docs, "_keys")
    rules = rules.select(F.col("host").alias(h), F.col("keys").alias(k))
    tagged = docs.withColumn(h, F.coalesce(F.col(host).cast("string"), F.lit("")))
    joined = tagged.join(F.broadcast(rules) if size <= BROADCAST_LINES else rules, h, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col(k).isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains(F.col(k), _key(x)) | (F.trim(x) == ""))
    )
    fresh = F.when(F.col(k).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    counted = joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)),
            "n_dropped": F.coalesce(F.size(lines) - F.size(kept), F.lit(0)),
            text: fresh,
        }
    )
    return counted.select(*[quoted(c) for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
