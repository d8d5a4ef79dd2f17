"""Connected components: links contracted to stars where they are, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._session import kept


def _smallest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v), with the smallest of u and all its v as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


#: Links that one task handles in a round; fewer tasks write fewer files.
LINKS = 200_000


def _contracted(links: DataFrame, most: int) -> DataFrame:
    """Each task's links (u, v) as stars: every node but the smallest with the smallest that the task's links lead to.

    Nothing is disconnected by it.  A task holds `most` links at once, and passes on the stars of those before it goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in up if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
                if len(up) > 2 * most:
                    yield stars()
                    up.clear()
        yield stars()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most: int = LINKS) -> DataFrame:
    """(node, root) for every node of `edges` (a, b longs); root is the smallest node reachable.

    Each task first contracts its own links to stars.  If `most` links or fewer
    are left, one task contracts them to the result.  Else, each round links every
    node's larger neighbours, then its smaller ones, to the smallest neighbour;
    the rounds are logarithmic in the size of a component.  Group minima combine
    before the shuffle; a hub's links meet in one task, as rows of two longs.
    Nulls and self-links are ignored; an empty table has no components.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = kept(_contracted(links, most))
    tasks = max(1, -(-now.count() // most))
    if tasks == 1:
        now = kept(_contracted(now.coalesce(1), most))
        return now.selectExpr("u as node", "v as root").unionByName(now.coalesce(1).select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    now = kept(now.coalesce(tasks).distinct().coalesce(tasks))
    state = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        star = _smallest(large).coalesce(tasks)
        small = star.select("u", F.col("m").alias("v")).unionByName(star.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = kept(small.distinct().coalesce(tasks))
