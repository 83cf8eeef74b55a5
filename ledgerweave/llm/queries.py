"""The dealt operators as queries over the driver's tables: thin projections of each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import decontaminate, fingerprint, langid, mixing, passages, pii, quality, simhash, substring_exact, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_exact.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 3) == 1
    model = langid.fit_languages(docs, ~held)
    out = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix_counts(docs)
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    base = F.filter(spans, lambda x: x["k"] < len(pii.BASE_KINDS))
    is_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter(spans, is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans(base).cast("binary"), 256).alias("base_sha256"), pii.joined_spans(spans).alias("spans"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 0
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model, keep=["doc_id"])
    score = F.col("toxicity.score")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    led = fingerprint.with_next(docs, "doc_id", "text", "fp")
    led = led.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text")))
    led = fingerprint.add_vector(led, F.col("edited"), "edited_fp")
    return led.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("fp")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hits = F.col("hits")
    return out.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        decontaminate.hit_words(hits).alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(hits).alias("contaminated"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score_quality(docs, quality.fit_quality(docs), keep=["doc_id"])
    return out.select("doc_id", F.col("quality.score").alias("score"), F.col("quality.weak_label").alias("weak_label"), (F.col("quality.score") >= 0.5).alias("keep"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_mixing, op4_simhash, op5_pii, op6_passages, op7_toxicity, op8_fingerprint, op9_decontaminate, op10_quality)
}

_WORD = r"[^\x20\x09-\x0D]+"

_MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sums
), levels AS (
  SELECT a.place, a.cap, a.w,
    (SELECT sum(source_size) FROM ranked) AS total,
    coalesce((SELECT sum(b.cap) FROM ranked b WHERE b.cap * a.w < a.cap * b.w OR (b.cap * a.w = a.cap * b.w AND b.place < a.place)), 0) AS full_caps,
    (SELECT sum(w) FROM ranked) - coalesce((SELECT sum(b.w) FROM ranked b WHERE b.cap * a.w < a.cap * b.w OR (b.cap * a.w = a.cap * b.w AND b.place < a.place)), 0) AS open_w
  FROM ranked a
), marked AS (
  SELECT r.*, l.cap * l.open_w <= l.w * (l.total - l.full_caps) AS capped, l.total FROM ranked r JOIN levels l USING (place)
), goals AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(w AS DOUBLE) * CAST(total - (SELECT coalesce(sum(cap), 0) FROM marked WHERE capped) AS DOUBLE)
      / CAST((SELECT sum(w) FROM marked WHERE NOT capped) AS DOUBLE) END AS target
  FROM marked
), rated AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)"""

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": _MIX_SQL
    + """
SELECT doc_id, size, source_size, target,
  CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated""",
    "op9_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents
), bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, CAST(len(w) - least(len(w), 13) + 2 AS BIGINT)), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' '))) AS p FROM bw WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM phrases),
docs AS (
  SELECT rid, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i, w FROM dw, sizes WHERE len(w) >= n
), hits AS (
  SELECT d.rid, d.i, d.n, p.item FROM (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM docs) d JOIN phrases p ON p.p = d.p AND p.n = d.n
), places AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)""",
}
