"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, fill_in_middle, html_text, language_id, line_dedup, mixing, pii, simhash, substring_dedup, token_files, topk, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(table(spark, sf_dir, "pages"), docs.select("doc_id", "source", "text"), docs.select("lang", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixing_probabilities(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def op3_mixing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_mixing samples, with how often each document is taken; its SQL has no such column."""
    out = mixing.mixing_probabilities(table(spark, sf_dir, "documents"))
    return out.filter("sampled").select("doc_id", "source", "lang", "topic", "n_tokens", "copies")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(F.array_position(kinds, x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        said(ordered).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.toxicity_scores(docs, docs, table(spark, sf_dir, "labels"), columns=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["a"], x["b"])), ",")
    return out.select("doc_id", "n_bytes", "n_removed", F.coalesce(spans, F.lit("")).alias("removed"), "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = fill_in_middle.restore(made)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha("output"), sha("text"),
    ).withColumnRenamed("text_sha256", "restored_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_files.token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_mixing, op4_pii, op5_toxicity, op6_topk, op7_html_text, op8_substring_dedup, op9_decontamination, op10_simhash, op3_mixing_copies, op11_fill_in_middle, op12_collocations, op13_token_files)
}

#: Word lists of a text in DuckDB: A-Z lower-cased, then runs of anything but ASCII other than a-z and 0-9.
_WORDS = "regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM d),
c AS (SELECT host, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL HAVING count(*) >= {line_dedup.MIN_PAGES}),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY 1),
b AS (SELECT host, list(line) AS rules FROM c JOIN t USING (host) WHERE n > {line_dedup.RATIO} * pages GROUP BY host),
k AS (SELECT doc_id, source, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(rules, []), x)) AS kept FROM d LEFT JOIN b USING (host))
SELECT doc_id, source, coalesce(len(lines), 0)::INT AS n_lines, coalesce(len(lines) - len(kept), 0)::INT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM k""",
    "op3_mixing": mixing.oracle(),
    "op6_topk": f"""
WITH v AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.K}""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {decontamination.WINDOW}) AS n FROM (SELECT item_id::VARCHAR AS item_id, {_WORDS.format(t='text')} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM pos, (SELECT DISTINCT n FROM p) WHERE i + n - 1 <= len(w)),
h AS (SELECT doc_id, i, n, item_id FROM o JOIN p USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_fill_in_middle": f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_in_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fill_in_middle.PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {fill_in_middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
    "op12_collocations": f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '{collocations.UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, m, w[i:i + m - 1] AS ph FROM o, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, ph, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE m > 1 AND f >= {collocations.LEAST}),
k AS (SELECT lang, m, ph, f, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.ph, k.f AS a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.f * k.f) // (x.f * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.ph = k.ph[1:k.k] JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.ph = k.ph[k.k + 1:k.m]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM s),
z AS (SELECT lang, ph, max(f) AS f FROM (SELECT lang, ph[1:2] AS ph, f FROM c WHERE m = 3 UNION ALL SELECT lang, ph[2:3], f FROM c WHERE m = 3) GROUP BY ALL),
q AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN z ON z.lang = b.lang AND z.ph = b.ph WHERE o = 1 AND (z.f IS NULL OR 100 * z.f < {collocations.INSIDE} * a)),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM e JOIN n USING (lang) WHERE rank <= {collocations.TOP}""",
}
