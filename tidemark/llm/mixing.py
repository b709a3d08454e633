"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, carried, given, n_words, uniform

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0
SEED = 7


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) of a table with columns source and size.

    Sources in code-point order, null last, take the weights in turn. Targets
    share ``total`` times all sizes by weight; none exceeds ``most`` times its
    source's size, and the excess goes to the others by weight until all fit.
    That is one water level: with sources ordered by cap / weight, the first
    k are full for the k whose level stays below the next source's own.
    The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("goal", F.sum("source_size").over(W.partitionBy()) * F.lit(float(total)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level of the first source that does not fill up holds for it and all after it
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED, keep: bool = True) -> DataFrame:
    """Each input row with _size, _source_size, _target, _rate and _copies.

    A source's rate is target / size. A row is taken floor(rate) times and
    once more if a draw seeded by its doc_id falls below the fraction, so no
    row exceeds ceil(rate) copies and reruns agree. Null text has size 0;
    null sources form one source; a source whose sizes are all 0 has rate 0;
    rows that share a doc_id share the draw. ``keep=False`` drops the other
    columns. Input columns named as those added are replaced. An empty table
    gives an empty result.
    """
    out = _mixed(df, text, doc_id, source, weights, total, most, seed, keep)
    own = given(df, *ADDED) if keep else [F.col("id").alias("doc_id"), "source"]
    return out.select(*own, *ADDED)


ADDED = ("_size", "_source_size", "_target", "_rate", "_copies")


def _mixed(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED, keep: bool = True) -> DataFrame:
    """(id, source, row if kept) and the columns that ``mix`` adds."""
    size = n_words(F.col(f"`{text}`")).alias("_size")
    src = F.col(f"`{source}`").alias("source")
    named = df.select(*[carried(df)] * keep, F.col(f"`{doc_id}`").alias("id"), src, size)
    scratch = Scratch(df.sparkSession, "mixing")
    per = scratch.save(source_targets(df.select(src, size.alias("size")), weights, total, most), "targets")
    per = per.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"))
    out = named.join(_small(per), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.floor("_rate")
    extra = (uniform(seed, F.col("id")) < F.col("_rate") - whole).cast("long")
    return out.withColumn("_copies", (whole + extra).cast("long"))


def _small(per: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """Broadcast the per-source table only if it has at most so many rows; else adaptive execution splits the hot source."""
    return F.broadcast(per) if per.limit(most_rows + 1).count() <= most_rows else per


def repeat_rows(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the input's columns."""
    out = _mixed(df, **options).where("_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*given(df))
