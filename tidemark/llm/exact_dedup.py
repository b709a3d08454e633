"""Exact de-duplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are
sorted and numbered; the number is the block's name, and two blocks share a
name exactly when their bytes are equal. Then adjacent names are paired and
the distinct pairs numbered in turn, halving each document's sequence, until
one name is left. Documents of equal text, and only those, end with the same
(level, name). No step compares digests in place of contents: the 64-bit key
that orders the blocks only says where equal blocks meet, and blocks whose
keys clash while their bytes differ are told apart by the bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick_rows

BLOCK_BYTES = 1024


def _blocks(text, size: int):
    raw = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(raw) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _key(block, bits: int):
    key = F.xxhash64(block)
    return key if bits >= 64 else F.pmod(key, F.lit(1 << bits))


def identities(df: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): rows has a row number, the id and the text's SHA-256; ids has each row number's (level, name)."""
    source = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # names of distinct blocks: equal blocks meet under their key, the bytes decide, sorted order numbers them
    met = source.select(F.explode(_blocks(F.col("t"), block_bytes)).alias("block")).select(_key(F.col("block"), key_bits).alias("key"), "block")
    met = met.groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("found")).sortWithinPartitions("key")
    met = met.select("key", F.size("found").alias("clash"), F.explode("found").alias("block"))
    names = scratch.save(met.select("key", F.monotonically_increasing_id().alias("name"), F.when(F.col("clash") > 1, F.col("block")).alias("block")), "names")
    clashes = not names.where("block is not null").isEmpty()

    blocks = _blocks(F.col("t"), block_bytes)
    rows = source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("t", 256).alias("sha"), F.transform(blocks, lambda b: _key(b, key_bits)).alias("keys"), *([blocks.alias("blocks")] if clashes else []))
    rows = scratch.save(rows, "rows")
    at = rows.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    cur = at.join(names.where("block is null").select("key", "name"), "key").select("rid", "n", "pos", "name")
    if clashes:
        full = rows.select("rid", F.size("keys").alias("n"), "keys", F.posexplode("blocks").alias("pos", "block"))
        full = full.select("rid", "n", "pos", "block", F.element_at("keys", F.col("pos") + 1).alias("key"))
        cur = cur.union(full.join(names.where("block is not null"), ["key", "block"]).select("rid", "n", "pos", "name"))
    cur = scratch.save(cur, "level-0")

    done, level = [cur.where("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0
    longest = cur.agg(F.max("n")).first()[0] or 0
    while 1 << level < longest:
        level += 1
        live = cur.where(F.col("n") > (1 << (level - 1)))
        side = F.col("pos") % 2
        pairs = live.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max("n").alias("n"), F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = scratch.save(pairs, f"pairs-{level}")
        named = scratch.save(pairs.groupBy("a", "b").count().sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")), f"names-{level}")
        cur = scratch.save(pairs.join(named, ["a", "b"]).select("rid", "n", "pos", "name"), f"level-{level}")
        scratch.drop(f"pairs-{level}", f"names-{level}")
        done.append(cur.where(F.col("n") <= (1 << level)).select("rid", F.lit(level).alias("level"), "name"))
    ids = done[0]
    for more in done[1:]:
        ids = ids.union(more)
    return rows.select("rid", "doc_id", "sha"), ids


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the identity (level, name).

    Of equal texts the row with the largest doc_id is kept. A null text
    equals an empty one. A null doc_id ranks below every other. Rows that
    repeat a doc_id and its text tie; exactly one of them is kept. An empty
    table gives an empty result. Further columns of the input are ignored,
    whatever their names.
    """
    scratch = Scratch(df.sparkSession, "exact-dedup")
    rows, ids = identities(df, scratch, text, doc_id, block_bytes, key_bits)
    full = scratch.save(rows.join(ids, "rid"), "identified")
    top = F.max(F.struct(F.col("doc_id").alias("id"), F.col("rid").alias("row"))).alias("top")
    groups = scratch.save(full.groupBy("level", "name").agg(top, F.count(F.lit(1)).alias("group_size")), "groups")
    out = full.join(groups, ["level", "name"])
    return out.select("doc_id", F.col("top.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"), "level", "name")


def keep_first_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input's rows, all columns, without the copies that ``exact_dedup`` drops.

    Rows are found again by doc_id (null matches null) and digest of the
    text; where rows repeat both, one of them stays, the one whose columns
    hash highest.
    """
    found = exact_dedup(df, text, doc_id)
    keys = found.groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("kept").select("doc_id", "mark", "n")
    return pick_rows(df, keys, doc_id, F.sha2(F.coalesce(F.col(text), F.lit("")), 256), Scratch(df.sparkSession, "exact-keep"))
