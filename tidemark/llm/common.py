"""What the text operators share: the shared scratch folder, word pattern, row attachment."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the folder that the cluster shares.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where
    that is unset, a local one is made and set if the master is local, as in
    tests; on a cluster it is an error.
    A table written here cuts lineage and survives lost executors. With
    ``tidy`` what was shuffled for it is deleted once it is written, as no later
    step reads it; else that waits for the driver's collector.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if self.tidy:
                self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        return self.read(name, df)

    def save_seen(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
        """The saved table and its aggregate measures, taken while it is written."""
        seen = Observation()
        return self.save(df.observe(seen, *measures), name), seen.get

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def one_blas_thread() -> None:
    """A task has one core: keep numpy's matrix products in it, where the library it came with lets that be set.

    Products of small matrices on two threads took twice the CPU time, most of it waiting.
    """
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def carried(df: DataFrame, name: str = "row") -> Column:
    """The caller's row as one struct, so that none of its columns meets a helper's, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def given(df: DataFrame, *added: str, name: str = "row") -> list[Column]:
    """The carried row's columns under their own names, without those that ``added`` replaces."""
    return [F.col(name)[c].alias(c) for c in df.columns if c not in added]


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building the array: word starts counted by pattern."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """Deterministic draw in [0, 1) from a seed and key columns: 52 bits of an MD5 digest, so any SQL engine can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def pick_rows(df: DataFrame, keys: DataFrame, doc_id: str, mark: Column, scratch: Scratch) -> DataFrame:
    """The rows of df, all columns, whose (doc_id, mark) is among ``keys`` (doc_id, mark, n), n being how many rows bear it.

    Null ids match null. Of rows that repeat a key one stays, the one whose
    columns hash highest; those alone are grouped.
    """
    keys = scratch.save(keys.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("n").alias("_n")), "keys")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    own = df.select(row, F.col(doc_id).alias("_own"), mark.alias("_hash"))
    hit = own.join(keys, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mark")))
    out = hit.where("_n = 1").select("_row.*")
    if keys.where("_n > 1").isEmpty():
        return out
    again = hit.where("_n > 1").groupBy("_id", "_mark").agg(F.max_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return out.union(again.select("_row.*"))


def components(edges: DataFrame, scratch: Scratch, label: str, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list as (node, root), root the least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each
    round one job written to the shared folder, until the edge set stops
    changing. Every step is a group-by minimum and a join whose hot keys
    adaptive execution splits; no component is gathered in one task. Nodes
    without an edge do not appear. An empty edge list gives an empty result.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")]
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cur, seen = scratch.save_seen(start, f"{label}-0", *sums)
    for k in range(1, 200):
        if not seen["n"]:
            break
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, both.u == low.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = large.where("u != v").distinct()
        least = big.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        hop = big.join(least, big.u == least.n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, now = scratch.save_seen(hop.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), f"{label}-{k}", *sums)
        same, seen = now == seen, now
        scratch.drop(f"{label}-{k - 1}")
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle in 200 rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select("v", "v").distinct())
