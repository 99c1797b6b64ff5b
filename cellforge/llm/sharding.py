"""Sharding: two-pass external shuffle, DataFrame functions only.

Pass one scatters records into buckets of about `bucket_rows` records by a seeded hash of the
whole record. Pass two gathers one bucket at a time, sorts it (so that the order of arrival does
not matter) and runs Spark's seeded Fisher-Yates `shuffle` over it. Buckets one after the other
are a random order of all records; that order is cut into shards whose row counts differ by one
at most (law `rows`). No step sorts or windows all records: bucket sizes are summed in two levels.

Memory is bounded by bucket_rows: equal records are counted before the scatter and travel as
(record, copies) in pieces of `bucket_rows` copies at most, each hashed on its own, so one record
that is a third of the table still spreads evenly.

Results for odd input: a null text has 0 bytes and crc32 0; null ids are records like others;
repeated rows each get a slot of their own. An empty table gives an empty result. Fewer rows than
shards: the first shards get one each. Other columns are ignored by `assign_shards` and carried
by `write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, quoted, written

SUPER = 1024


def _assign(records: DataFrame, keys: list[str], shards: int, seed: int, bucket_rows: int) -> DataFrame:
    """keys, shard, slot for each row of records."""
    counted = written(records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")), "records")
    total = counted.agg(F.sum("_copies")).first()[0] or 0
    buckets = max(1, -(-total // bucket_rows))
    last = F.floor((F.col("_copies") - 1) / bucket_rows)
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    held = F.least(F.lit(bucket_rows), F.col("_copies") - F.col("_piece") * bucket_rows).cast("int")
    scattered = pieces.select(
        F.pmod(F.xxhash64(F.lit(seed), *keys, "_piece"), F.lit(buckets)).alias("_bucket"),
        F.struct(*keys, held.alias("_n")).alias("_record"),
    )
    sizes = scattered.groupBy("_bucket").agg(F.sum("_record._n").alias("_rows"))
    sizes = sizes.withColumn("_super", F.floor(F.col("_bucket") / SUPER))
    supers = sizes.groupBy("_super").agg(F.sum("_rows").alias("_all"))
    before = F.sum("_all").over(W.orderBy("_super").rowsBetween(W.unboundedPreceding, -1))
    supers = supers.select("_super", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum("_rows").over(W.partitionBy("_super").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(supers, "_super")
    offsets = offsets.select("_bucket", (F.col("_inside") + F.col("_base")).alias("_first"))
    # An explicit number of partitions, sorted: the seeded shuffle then meets each bucket at the same place in any rerun.
    gathered = (
        scattered.repartition(min(buckets, 16384), "_bucket")
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list("_record")).alias("_records"))
        .sortWithinPartitions("_bucket")
    )
    each = F.flatten(F.transform("_records", lambda x: F.array_repeat(F.struct(*(x[k].alias(k) for k in keys)), x["_n"])))
    shuffled = gathered.select("_bucket", F.shuffle(each, seed).alias("_order"))
    placed = shuffled.join(offsets, "_bucket").select("_first", F.posexplode("_order").alias("_at", "_r"))
    at = F.col("_first") + F.col("_at")
    q, r = divmod(total, shards)
    cut = r * (q + 1)
    shard = F.when(at < cut, F.floor(at / (q + 1))).otherwise(r + F.floor((at - cut) / max(q, 1)))
    slot = F.when(at < cut, at % (q + 1)).otherwise((at - cut) % max(q, 1))
    return placed.select(*(F.col(f"_r.{k}").alias(k) for k in keys), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 20240229, bucket_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(quoted(text_col))
    records = docs.select(
        F.col(quoted(id_col)).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("_size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("_crc"),
    )
    out = _assign(records, ["_id", "_size", "_crc"], shards, seed, bucket_rows)
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20240229, bucket_bytes: int = 32 << 20) -> None:
    """Writes docs to path/shard=N, with all their columns, the files of a shard sorted by slot. The records
    themselves travel: into buckets of about bucket_bytes (a longer record makes a longer bucket), which are
    shuffled and written. Rows that agree in all columns are alike. A column `shard` of docs gives way."""
    columns = [c for c in docs.columns if c.lower() != "shard"]
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in columns)).alias("row"))
    length = sum((F.coalesce(F.octet_length(F.col("row")[c].cast("string")), F.lit(0)) for c in columns), F.lit(16))
    total, n = rows.agg(F.sum(length), F.count(F.lit(1))).first()
    placed = _assign(rows, ["row"], shards, seed, max(1, bucket_bytes * n // max(total or 1, 1)))
    slot = fresh(docs, "slot")
    out = placed.select(*(F.col("row")[c].alias(c) for c in columns), "shard", F.col("slot").alias(slot))
    stretch = max(1, bucket_bytes * n // max(total or 1, 1))  # rows of a written file
    files = max(1, -(-n // stretch))
    out = out.repartition(max(shards, files), "shard", F.floor(F.col(slot) / stretch)).sortWithinPartitions("shard", slot)
    out.drop(slot).write.partitionBy("shard").parquet(path)
