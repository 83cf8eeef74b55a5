"""A corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Each stage takes what the one before kept and returns the columns of documents; the last adds the copy's number.
Results are defined for empty tables, nulls in any column and extra columns, as the operators' docstrings state:

* ``language``: rows without a letter (null and empty texts included) are rejected, all others stay, and a null language
  becomes the predicted one;
* ``near_duplicates``: of each group (five-word shingles, a similarity of 0.8 or more) one row stays, the one of
  the smallest id;
* ``decontaminate``: rows of which a twentieth or more lies inside benchmark phrases go;
* ``personal_data``: spans are replaced by their kind;
* ``mix``: rows are repeated to their source's target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import arrow_text, decontaminate, langid, mixing, pii, wide_simhash
from ledgerweave.plans.checkpoint import cut

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = arrow_text.fresh(docs.columns, "stage_language")
    model = langid.fit_languages(docs, F.lit(True))
    marked = langid.identify(docs, model, into=name)
    # with nothing to learn from, nothing is rejected
    if not model:
        return docs
    known = marked.where(F.col(f"{name}.lang") != langid.UNKNOWN)
    return known.select(*[(F.coalesce("lang", f"{name}.lang").alias(c) if c == "lang" else F.col(f"`{c}`")) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wide_simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = arrow_text.fresh(docs.columns, "stage_hits")
    marked = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=name)
    return marked.where(~decontaminate.is_contaminated(F.col(name))).drop(name)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("personal_data", personal_data), ("mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
