"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The contingency table source x language x topic holds tokens. Raking scales its weights in turn
until the source, language and topic sums meet their targets; a document's rate is proportional to (calibrated weight /
tokens) of its cell. A rate over one can't be met by keeping a document once: ``copies`` says how often
it is taken, the rate on average, so that the copies' tokens meet the targets. ``probability`` and
``sampled`` are those of being taken at all.

Targets are tempered shares, share ** power over its sum, so that rare categories gain weight. Every
source and language has a target of its own, however rare.

Defined cases: null source or language is the category ''; null text has no tokens; a cell without
tokens has nothing to calibrate and its documents get the rate ``keep``; an empty table gives an
empty table; repeated rows share one draw (it depends on doc_id alone); null doc_id draws as 'null';
very long texts are counted whole. Columns of the input, whatever their names, pass through unless the
result has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

KEEP = 0.75
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS = 12
#: Cells up to which the table is raked in one task (under 100 bytes each); a larger one is raked by joins.
ONE_TASK_CELLS = 20_000
#: Cells up to which the fitted table is broadcast; beyond it the join shuffles.
BROADCAST_CELLS = 100_000


def topic(text: Column) -> Column:
    """A topic from the text's make-up: empty, table, noisy, records, note or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    of = lambda signs: F.regexp_count(t, F.lit(signs))  # noqa: E731  a third of the time that translate() takes
    return (
        F.when(n == 0, "empty")
        .when((n - F.length(F.replace(t, F.lit("|"), F.lit("")))) * 50 >= n, "table")
        .when(of("[%*#$&]") * 20 >= n, "noisy")
        .when(of("[0-9@]") * 100 >= n, "records")
        .when(n < 400, "note")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Runs of anything but white space: one for a leading run, and one for each that follows white space."""
    t = F.coalesce(text, F.lit(""))
    return (F.regexp_count(t, F.lit("[ \\t\\n\\r][^ \\t\\n\\r]")) + t.rlike("^[^ \\t\\n\\r]").cast("int")).cast("long")


def _categories(docs: DataFrame) -> DataFrame:
    """The input as one struct, so that its column names clash with none of ours, and what is raked."""
    return docs.select(F.struct("*").alias("_row")).select(
        "_row",
        F.coalesce(F.col("_row.source").cast("string"), F.lit("")).alias("_s"),
        F.coalesce(F.col("_row.lang").cast("string"), F.lit("")).alias("_l"),
        topic(F.col("_row.text")).alias("topic"),
        tokens(F.col("_row.text")).alias("n_tokens"),
    )


def rake(cells: DataFrame, rounds: int = ROUNDS, powers: dict[str, float] = POWERS) -> DataFrame:
    """Fits column w of ``cells`` (source, lang, topic, tokens > 0; checkpointed) to the tempered marginals."""
    return (_rake_in_one_task if cells.count() <= ONE_TASK_CELLS else _rake_by_joins)(cells, rounds, powers)


def _rake_in_one_task(cells: DataFrame, rounds: int, powers: dict[str, float]) -> DataFrame:
    """The table is in one partition, which serves every window without a shuffle."""
    one = cells.repartition(1)
    for dim, power in powers.items():
        by = Window.partitionBy(dim)
        one = one.withColumn("_m", F.pow(F.sum("tokens").over(by).cast("double"), F.lit(power))).withColumn("_n", F.count("*").over(by))
        one = one.withColumn(f"_t_{dim}", F.col("_m") / F.sum(F.col("_m") / F.col("_n")).over(Window.partitionBy(F.lit(1))))
    one = one.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for dim in powers:
            one = one.withColumn("w", F.col("w") * F.col(f"_t_{dim}") / F.sum("w").over(Window.partitionBy(dim)))
    return one.select("source", "lang", "topic", "tokens", "w")


def _rake_by_joins(cells: DataFrame, rounds: int, powers: dict[str, float]) -> DataFrame:
    """The same for a table of any size: w is tokens times a factor of each dimension, and only the factors are kept."""
    targets, factors, small = {}, {}, {}
    for dim, power in powers.items():
        m = checkpoint(cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("_m")))
        whole, rows = m.agg(F.sum("_m"), F.count("*")).first()
        targets[dim], small[dim] = m.select(dim, (F.col("_m") / whole).alias("_t")), rows <= BROADCAST_CELLS

    def weighed(dims: list[str]) -> DataFrame:
        out = cells.withColumn("w", F.col("tokens").cast("double"))
        for dim in dims:
            out = out.join(F.broadcast(factors[dim]) if small[dim] else factors[dim], dim).withColumn("w", F.col("w") * F.col("_f")).drop("_f")
        return out

    for _ in range(rounds):
        for dim in powers:
            sums = weighed([x for x in factors if x != dim]).groupBy(dim).agg(F.sum("w").alias("_w"))
            factors[dim] = checkpoint(sums.join(targets[dim], dim).select(dim, (F.col("_t") / F.col("_w")).alias("_f")))
    return weighed([*factors]).select("source", "lang", "topic", "tokens", "w")


def mixing_probabilities(docs: DataFrame, keep: float = KEEP, rounds: int = ROUNDS, powers: dict[str, float] = POWERS) -> DataFrame:
    """``docs`` with topic, n_tokens, probability (six digits), sampled and copies."""
    d = _categories(docs)
    cells = d.groupBy(F.col("_s").alias("source"), F.col("_l").alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens"))
    cells = checkpoint(cells.filter("tokens > 0"))
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    fitted = checkpoint(rake(cells, rounds, powers))
    rate = fitted.select(
        F.col("source").alias("_s"), F.col("lang").alias("_l"), "topic",
        F.round(F.lit(keep) * float(total) * F.col("w") / F.col("tokens"), 6).alias("_rate"),
    )
    small = fitted.count() <= BROADCAST_CELLS
    out = d.join(F.broadcast(rate) if small else rate, ["_s", "_l", "topic"], "left")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = F.coalesce("_rate", F.lit(keep))
    once = F.least(F.lit(1.0), times)
    fresh = {"topic": F.col("topic"), "n_tokens": F.col("n_tokens"), "probability": once, "sampled": draw < once, "copies": F.floor(times) + (draw < times - F.floor(times)).cast("long")}
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in fresh], *[v.alias(k) for k, v in fresh.items()])


def oracle(keep: float = KEEP, rounds: int = ROUNDS, powers: dict[str, float] = POWERS) -> str:
    """The same computation as DuckDB SQL over documents."""
    of = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, s, l, len(regexp_extract_all(t, '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens,
  CASE WHEN length(t) = 0 THEN 'empty' WHEN {of('|')} * 50 >= length(t) THEN 'table' WHEN {of('%*#$&')} * 20 >= length(t) THEN 'noisy'
  WHEN {of('0123456789@')} * 100 >= length(t) THEN 'records' WHEN length(t) < 400 THEN 'note' ELSE 'prose' END AS topic FROM d),
tot AS (SELECT coalesce(sum(n_tokens), 0)::DOUBLE AS total FROM c),
p AS (SELECT doc_id, s AS source0, l AS lang0, topic, n_tokens, s AS source, l AS lang FROM c),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM p GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    ]
    last = "cells"
    for dim, power in powers.items():
        steps.append(f"m_{dim} AS (SELECT {dim}, pow(sum(tokens), {power}) AS m FROM cells GROUP BY 1)")
        steps.append(f"t_{dim} AS (SELECT {dim}, m / (SELECT sum(m) FROM m_{dim}) AS t_{dim} FROM m_{dim})")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells " + " ".join(f"JOIN t_{d} USING ({d})" for d in powers) + ")")
    last = "w0"
    for i, dim in enumerate([*powers] * rounds):
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{dim} / sum(w) OVER (PARTITION BY {dim}) AS w) FROM {last})")
        last = f"w{i + 1}"
    steps.append(f"r AS (SELECT source, lang, topic, round(least(1.0, {keep} * (SELECT total FROM tot) * w / tokens), 6) AS q FROM {last})")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT p.doc_id, source0 AS source, lang0 AS lang, p.topic, n_tokens, coalesce(q, {keep}) AS probability, "
        f"('0x' || substr(md5('mix:' || coalesce(p.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < coalesce(q, {keep}) AS sampled "
        "FROM p LEFT JOIN r ON p.source = r.source AND p.lang = r.lang AND p.topic = r.topic"
    )
