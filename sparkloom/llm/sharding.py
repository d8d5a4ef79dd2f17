"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together; groups, heaviest
first, go to the least-loaded shard through a heap.  Groups of one weight are
interchangeable, so the schedule is made from the histogram of weights (the
number of distinct weights is at most the square root of twice the total
bytes) and groups are then numbered within their weight to find their shard.

A null text has no bytes and weighs 1 as any row does on top of its bytes;
null and empty texts are one group.  Rows that repeat a doc_id count as rows.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.llm._session import kept, with_group

SHARDS = 16
#: Rows that one window partition numbers.
ROWS_PER_BUCKET = 100_000


def schedule(histogram: Iterable[tuple[int, int]], shards: int = SHARDS) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(weight, [(shard, groups), ...]) for (weight, groups) pairs, heaviest first.

    The same assignment as one heap step per group: while loads differ by more
    than a weight the least-loaded shard takes as many groups as bring it past
    the next one, and once they don't, whole rounds are dealt at once.
    """
    heap = [(0, s) for s in range(shards)]
    heapify(heap)
    for weight, groups in histogram:
        taken: list[tuple[int, int]] = []
        while groups:
            load, shard = heap[0]
            if groups > shards and max(heap)[0] - load <= weight:
                rounds = groups // shards
                taken += [(s, rounds) for _, s in sorted(heap)]
                heap = [(x + rounds * weight, s) for x, s in heap]
                heapify(heap)
                groups -= rounds * shards
                continue
            after = min(heap[1:3], default=(load + weight * groups, shard))[0]
            n = min(groups, max(1, -(-(after - load) // weight)))
            heapreplace(heap, (load + n * weight, shard))
            taken.append((shard, n))
            groups -= n
        yield weight, taken


def numbered(rows: DataFrame, by: str, tie: list[str], n: int, name: str) -> DataFrame:
    """`rows` with a gapless number from 0 within each value of `by`, in no window larger than a bucket.

    Rows are dealt into hash buckets; each row's number is its rank in its
    bucket plus the rows of the buckets before it.
    """
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    own = rows.withColumn("_bucket", F.pmod(F.xxhash64(*tie), F.lit(buckets)))
    before = own.groupBy(by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*tie)))
    return ranked.join(before, [by, "_bucket"]).withColumn(name, F.col("_rank") - 1 + F.col("_before")).drop("_bucket", "_rank", "_before")


def _parallel(spark: SparkSession, plan: Iterator[tuple[int, list[tuple[int, int]]]]) -> DataFrame:
    """The schedule as (weight, upto, shards): group numbers below upto[i] (and not below upto[i - 1]) go to shards[i]."""
    weights, upto, shards = [], [], []
    for weight, taken in plan:
        ends, total = [], 0
        for _, n in taken:
            total += n
            ends.append(total)
        weights.append(weight)
        upto.append(ends)
        shards.append([s for s, _ in taken])
    table = pa.table({"weight": pa.array(weights, pa.int64()), "upto": pa.array(upto, pa.list_(pa.int64())), "shards": pa.array(shards, pa.list_(pa.int32()))})
    return spark.createDataFrame(table)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("_group")))
    groups = kept(rows.groupBy("_group").agg(F.sum("size").alias("weight"), F.count("*").alias("members")))
    n_groups, n_rows = groups.count(), rows.count()
    histogram = ((r[0], r[1]) for r in groups.groupBy("weight").count().orderBy(F.desc("weight")).toLocalIterator())
    plan = _parallel(rows.sparkSession, schedule(histogram, shards))
    placed = numbered(groups, "weight", ["_group"], n_groups, "_number").join(plan, "weight")
    shard: Column = F.expr("element_at(shards, cast(size(filter(upto, x -> x <= _number)) as int) + 1)")
    placed = kept(placed.select("_group", shard.cast("int").alias("shard"), "members"))
    dealt = kept(with_group(rows, placed, "_group", "members").drop("_group", "members"))
    return numbered(dealt, "shard", ["doc_id", "text_crc32", "size"], n_rows, "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
