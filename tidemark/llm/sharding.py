"""Shards in random order by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, carried, given

BUCKET_BYTES = 8 << 20
SEED = 11


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with the key is highest: key and shard count decide, and one more shard takes rows only into itself."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed), key, j).alias("h"), j.alias("shard")))
    return F.array_max(drawn)["shard"]


def shuffle_shards(df: DataFrame, path: str, shards: int = 8, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Write the rows to ``path`` in shards, each in random order, and return them as read back.

    Result: the input's columns, then _shard, _slot (gapless from 0 in each
    shard) and _grown (the shard with one more). First pass: each row goes
    to a bucket of its shard by a seeded hash of its id, text and place, and
    a shard has as many buckets as its own bytes need, so that they have about
    ``bucket_bytes`` also where one id or text fills a shard. Second
    pass: each bucket, in memory, is put in order by a Fisher-Yates shuffle
    and written. A slot is the rows of the shard's buckets before the row's,
    plus its place in its own. Null ids go to one shard; null texts have no
    bytes; an empty table gives none. Input columns named as those added are
    replaced.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1
    key = F.col(f"`{doc_id}`")
    rows = df.select(carried(df), shard_of(key, shards, seed).alias("_shard"), F.xxhash64(F.lit(seed), key, F.col(f"`{text}`"), F.monotonically_increasing_id()).alias("_mix"))
    sizes = {r["_shard"]: r["size"] for r in df.groupBy(shard_of(key, shards, seed).alias("_shard")).agg(F.sum(size).alias("size")).collect()}  # one row for each shard
    per = [max(1, -(-sizes.get(j, 0) // bucket_bytes)) for j in range(shards)]
    rows = rows.withColumn("_bucket", F.pmod("_mix", F.get(F.array(*map(F.lit, per)), F.col("_shard"))).cast("int"))
    scattered = rows.repartition(sum(per), "_shard", "_bucket").sortWithinPartitions("_shard", "_bucket", "_mix")
    buckets = scattered.groupBy("_shard", "_bucket").agg(F.collect_list("row").alias("rows"))
    dealt = buckets.select("_shard", "_bucket", F.posexplode(F.shuffle("rows", F.expr(f"{seed}L"))).alias("_place", "row"))
    dealt.write.mode("overwrite").parquet(path)

    back = df.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = back.groupBy("_shard", "_bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = Scratch(df.sparkSession, "sharding").save(counts.select("_shard", "_bucket", before.alias("_base")), "bases")
    out = back.join(bases, ["_shard", "_bucket"]).withColumns({"_slot": (F.col("_base") + F.col("_place")).cast("long"), "_grown": shard_of(F.col("row")[doc_id], shards + 1, seed)})
    return out.select(*given(df, "_shard", "_slot", "_grown"), "_shard", "_slot", "_grown")
