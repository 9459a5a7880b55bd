"""Shards by jump consistent hashing: no ring table, and a new shard takes rows only into itself."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layoutcheck.llm.shared import small_batches, task
from layoutcheck.llm.words import mix

#: Ranges of the hash inside a shard; each is numbered by itself.
RANGES = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, by Lamping and Veach's loop over all keys at once."""
    keys = keys.astype(np.uint64)
    shard = np.zeros(len(keys), np.int64)
    at, b, j, key = np.arange(len(keys)), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), keys
    while len(at):
        inside = j < shards
        shard[at[~inside]] = b[~inside]
        at, key, b = at[inside], key[inside], j[inside]
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        j = ((b + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return shard


def _dealer(shards: int):
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("__key").fill_null(0)).astype(np.uint64)
            key = mix(ids + np.uint64(0x9E3779B97F4A7C15))
            spread = mix(key ^ np.asarray(batch.column("text_crc32")).astype(np.uint64)) >> np.uint64(52)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(jump(key, shards), pa.int32()), pa.array(jump(key, shards + 1), pa.int32()), pa.array(spread.astype(np.int32), pa.int32())],
                [*batch.schema.names, "shard", "grown_shard", "range"],
            )

    return run


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The integer id and the number of shards decide the shard. Slots count from
    0 in each shard, by a hash range, then id, checksum and size. A null id is
    dealt as the id 0, a null text has no bytes (size 1, checksum 0), rows of
    one id share a shard, repeated rows get a slot each, long texts count whole,
    an empty table gives no rows. Only ids, sizes and
    checksums are shuffled; ranges keep a shard's numbering parallel.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("long").alias("__key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(task(_dealer(shards)), f"doc_id {kind}, __key long, size long, text_crc32 long, shard int, grown_shard int, range int").drop("__key")
    # shards * RANGES rows at most, whatever the input
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "range").count().select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("nth", F.row_number().over(own)).join(F.broadcast(offsets), ["shard", "range"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes whole rows as Parquet, a folder ``shard=N`` each, into a path that must not exist.

    Shards are those of ``assign_shards``: a null id is dealt as 0, rows of one
    id and repeated rows share a shard, null and very long texts are written as
    they are, an empty table makes no folder, a column named shard is replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("shard", "grown_shard", "range", "__key", "text_crc32")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{id_col}`").cast("long").alias("__key"), F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("text_crc32"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("shard", "grown_shard", "range"))])
    dealt = rows.mapInArrow(task(_dealer(shards)), schema)
    dealt.select(*(F.col(f"`{c}`") for c in kept), "shard").write.partitionBy("shard").parquet(path)
