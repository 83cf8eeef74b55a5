"""Mixing sources to target weights by whole-document repetition.

Sizes are summed per source (partial sums first, so a hot source is a few rows per task). A source's repetition rate
is its target over its size; each document is emitted floor(rate) times, plus once more when a hash of the seed and
the document (its id and text) falls below the rate's fraction. Targets fill to the sources' weights under a cap per source: the level
L at which the sum of min(cap, weight * L) is the total.

Defined cases: null text has size 0; a null source is a source of its own and comes last; sources without words have
target 0; rows equal in id and text get equal draws; an empty table gives an empty mix; an input column named as the
result is replaced. The per-source table has one row per source and is ranked in one task; documents meet it by a join on
the source, which broadcasts the table if it has at most ``BROADCAST_ROWS`` sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerweave.llm import arrow_text as A
from ledgerweave.plans.checkpoint import cut

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes``: source, source_size. Adds ``target``; weights repeat over the sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat)
    # sources by the level at which they reach their cap; those before the first that does not stay capped
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("place"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levelled = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("full"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open_w"),
    )
    # capped if its cap is at most what its weight gives once all before it are full
    capped = F.col("cap") * F.col("open_w") <= F.col("w") * (F.col("total") - F.col("full"))
    marked = levelled.withColumn("capped", capped)
    rest = marked.withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)).withColumn("rest_w", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything))
    share = F.col("w").cast("double") * F.col("rest").cast("double") / F.col("rest_w").cast("double")
    return rest.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def draw(document: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed, the document's name and its text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(document.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(1 << 48))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, into: str = "mix") -> DataFrame:
    """All columns of ``docs`` plus struct ``into``: size, source_size, target and ``copies``."""
    name = A.fresh(docs.columns, "mix_size")
    sized = docs.withColumn(name, word_count(F.col(f"`{text}`")))
    sums = sized.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(name).alias("source_size"))
    goals = cut(source_targets(sums, weights, max_repeat).select(F.struct("source", "source_size", "target").alias("goal")))
    goals = F.broadcast(goals) if goals.count() <= BROADCAST_ROWS else goals
    joined = sized.join(goals, F.col(f"`{source}`").eqNullSafe(F.col("goal.source")))
    rate = F.when(F.col("goal.source_size") > 0, F.col("goal.target") / F.col("goal.source_size").cast("double")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col(f"`{id_col}`"), F.col(f"`{text}`"), seed) < rate - F.floor(rate), 1).otherwise(0)
    struct = F.struct(F.col(name).alias("size"), F.col("goal.source_size").alias("source_size"), F.col("goal.target").alias("target"), copies.cast("long").alias("copies"))
    return joined.withColumn(into, struct).select(*[F.col(f"`{c}`") for c in docs.columns if c != into], into)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, number: str = "copy") -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the copy's number from 1."""
    name = A.fresh(docs.columns, "mix_of")
    counted = mix_counts(docs, id_col, text, source, weights, max_repeat, seed, name).where(F.col(f"{name}.copies") > 0)
    number = A.fresh(docs.columns, number)
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies").cast("int"))).alias(number))
