"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly into buckets that fit into memory, by a seeded hash of the whole record and of its number among its
repeats; so a record that is repeated very often doesn't fill one bucket. Pass two puts every bucket in random order and writes it.
Bucket after bucket the written records stand in one random order; shard s holds the positions p with floor(p * shards / n) = s. So the counts of two
shards differ by one at most (the law `rows`), whatever the keys. Everything is DataFrame functions.

The result follows from the records and the seed alone, however the input is partitioned, also where a lost task runs again. Spark's own array shuffle
(Fisher-Yates) does not give that: its random state depends on the number of the task and on the buckets before. So a bucket is sorted by a second seeded
hash, which is the same uniform choice of an order.

Defined results: a null text has no bytes (size 1, crc of the empty text); null or repeated ids are records of their own. An
empty table gives no rows, and fewer records than shards leave shards empty. Input columns whose names clash with shard or slot give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import written

BUCKET_BYTES = 16 << 20


def numbered(docs: DataFrame, seed: int) -> DataFrame:
    """All columns of docs, a hash of the record (_hash) and its number among equal records (_nth); which of the equal ones gets which number is open.

    Counts by record and task say where each task's numbers begin, so a record that is a third of all rows is numbered in all tasks that hold it.
    """
    marked = docs.withColumn("_hash", F.xxhash64(F.lit(seed), *docs.columns)).withColumn("_task", F.spark_partition_id())
    counts = marked.groupBy("_hash", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_hash").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_hash")))
    repeated = written(counts.where("_all > 1").select("_hash", "_task", "_before"), "repeats")
    found = marked.join(repeated, ["_hash", "_task"], "left")
    inside = Window.partitionBy("_hash", "_task").orderBy("_before")
    again = found.where("_before is not null").withColumn("_nth", F.row_number().over(inside) - 1 + F.col("_before"))
    single = found.where("_before is null").withColumn("_nth", F.lit(0).cast("long"))
    return single.unionByName(again).drop("_task", "_before")


def shuffled(docs: DataFrame, shards: int, *, seed: int = 42, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs in a random order, with shard and slot (gapless from 0 in a shard)."""
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("shard", "slot")))
    size = docs.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("bytes")).head()
    buckets = 1 + (size["bytes"] or 0) // bucket_bytes
    dealt = numbered(docs, seed).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "_hash", "_nth"), F.lit(buckets)))
    dealt = dealt.select("bucket", F.struct(F.xxhash64(F.lit(seed + 1), "_hash", "_nth").alias("order"), "_hash", "_nth", F.struct(*docs.columns).alias("record")).alias("item"))
    # Dealt out first: all of a bucket is then in one place, and nothing is gathered before the exchange.
    gathered = dealt.repartition("bucket").groupBy("bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    mixed = gathered.select("bucket", F.posexplode("items").alias("place", "item")).select("bucket", "place", F.col("item.record").alias("record"))
    mixed = written(mixed, "shuffled")
    counts = mixed.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row per bucket, that is per `bucket_bytes` of input.
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    placed = mixed.join(F.broadcast(before) if buckets <= 100_000 else before, "bucket").withColumn("position", F.col("before") + F.col("place"))
    total = size["n"]
    placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
    # The first position of shard s is the least p with p * shards >= s * n.
    slot = F.expr(f"position - (shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("record.*", "shard", slot.alias("slot"))
