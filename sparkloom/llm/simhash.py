"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distances.

A fingerprint's bit is 1 if over half the XXH64 hashes (seed 42) of the text's
word shingles have it.  Fingerprints link at 4 or fewer differing bits.  With
64 bits in B blocks, two such fingerprints agree on at least B - 4 blocks, so
every choice of B - 4 blocks is a join key; B follows the number of distinct
fingerprints, so that chance partners per key stay few at any size.

Equal fingerprints are one node from the start.  Within a key's group a
breadth-first search compares fingerprints and emits a spanning forest, never
all pairs.  A group larger than ``TILE`` is cut into tiles, and pairs of tiles
are compared by other tasks, so no task holds an unbounded group and no link
is lost.

Null and empty texts, and texts without words, have fingerprint zero and link
like any other.  Rows with a null doc_id get the component of their
fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._graph import components
from sparkloom.llm._session import few, kept, packed, unpacked, with_group, with_rows, written

BITS, NEAR, SHINGLE, TILE = 64, 4, 4, 4096
#: Shingles hashed at a time, so that a very long text needs bounded memory.
STRIDE = 1 << 16
#: Rows of (key, fingerprint) in one partition of the block join.
KEYS_PER_TASK = 500_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def hashed_shingles(text: str | None, size: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, a bounded number at a time (none without words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for i in range(0, n, STRIDE):
        raw = b"".join([digest(line[s:e], 42) for s, e in zip(starts[i : i + STRIDE], ends[i : i + STRIDE])])
        yield np.frombuffer(raw, np.uint64)


def simhash(parts: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(BITS, np.int64), 0
    for part in parts:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        n += len(part)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text (zero without words)."""
    return simhash(hashed_shingles(text, size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(n: int, near: int = NEAR) -> list[int]:
    """Bit masks of the join keys for n distinct fingerprints: the blocks that `near` differing bits can leave untouched."""

    def cost(b: int) -> float:
        return comb(b, near) * (1 + n / 2.0 ** (BITS * (b - near) // b))

    b = min(range(near + 1, near + 9), key=cost)
    bounds = [BITS * i // b for i in range(b + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:])]
    return [sum(own) for own in combinations(blocks, b - near)]


def forest(fp: np.ndarray, doc: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """Spanning forest (doc, doc) of the graph of fingerprints within `near` bits."""
    edges: list[tuple[int, int]] = []
    while len(fp):
        front = [(fp[0], doc[0])]
        fp, doc = fp[1:], doc[1:]
        while front and len(fp):
            f, d = front.pop()
            close = np.bitwise_count(fp ^ f) <= near
            if close.any():
                edges += [(d, x) for x in doc[close]]
                front += list(zip(fp[close], doc[close]))
                fp, doc = fp[~close], doc[~close]
    return edges


class Rule(NamedTuple):
    """When members of one key link.  Members are rows of longs, the first of which is their id."""

    pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]  # whether the members of two tables link, row by row
    group: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  # links (a, b) that connect what links in a table
    across: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # and between two tables


def within(near: int = NEAR) -> Rule:
    """Members (doc, fingerprint) link within `near` differing bits."""

    def group(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edges = np.array(forest(m[:, 1].view(np.uint64), m[:, 0], near), np.int64).reshape(-1, 2)
        return edges[:, 0], edges[:, 1]

    return Rule(lambda x, y: np.bitwise_count((x[:, 1] ^ y[:, 1]).view(np.uint64)) <= near, group, lambda x, y: group(np.concatenate([x, y])))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("tile", pa.int64()), ("data", pa.binary())])
LINKS = "a long, b long, key long, tile long, data binary"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.binary())], schema=_LINKS)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return starts, np.diff(np.append(starts, len(key)))


def _linker(rule: Rule, tile: int, small: int = 8, large_from: int | None = None):
    def shipped(key: int, number: int | None, members: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([number], pa.int64()), pa.array([members.tobytes()], pa.binary())], schema=_LINKS)

    def groups(key: np.ndarray, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links within complete groups."""
        starts, sizes = _runs(key)
        short = np.repeat(sizes <= small, sizes)
        k, m = key[short], members[short]
        for o in range(1, small):
            same = np.flatnonzero(k[o:] == k[:-o]) if len(k) > o else np.zeros(0, np.int64)
            same = same[rule.pairwise(m[same], m[same + o])] if len(same) else same
            if len(same):
                yield _links(m[same + o, 0], m[same, 0])
        for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
            yield _links(*rule.group(members[s : s + n]))
            if large_from is not None and n > large_from:
                yield shipped(int(key[s]), None, members[s : s + n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a group that outgrows a tile is passed on tile by tile."""
        key, held = np.zeros(0, np.int64), None
        large, tiles = None, 0  # the key that has already filled a tile, and how many

        def tiled(last: bool) -> Iterator[pa.RecordBatch]:
            """Ships full tiles of the held key (at its end also the rest)."""
            nonlocal key, held, large, tiles
            k = int(key[0])
            if large != k:
                large, tiles = k, 0
            while len(key) >= tile or last and len(key):
                yield _links(*rule.group(held[:tile]))
                yield shipped(k, None if large_from is not None else tiles, held[:tile])
                tiles += 1
                key, held = key[tile:], held[tile:]

        for batch in batches:
            if not len(batch):
                continue
            columns = [np.asarray(batch.column(i)) for i in range(batch.num_columns)]
            members = np.stack(columns[1:], axis=1)
            key, held = np.concatenate([key, columns[0]]), members if held is None else np.concatenate([held, members])
            while len(key):
                starts, sizes = _runs(key)
                if len(starts) > 1:  # all groups but the last are complete
                    if int(key[0]) == large or sizes[0] > tile:
                        rest = key[sizes[0] :], held[sizes[0] :]
                        key, held = key[: sizes[0]], held[: sizes[0]]
                        yield from tiled(True)
                        large, (key, held) = None, rest
                        continue
                    over = np.flatnonzero(sizes[:-1] > tile)
                    end = starts[over[0]] if len(over) else starts[-1]
                    yield from groups(key[:end], held[:end])
                    key, held = key[end:], held[end:]
                    continue
                if len(key) > tile or int(key[0]) == large and len(key) >= tile:
                    yield from tiled(False)
                break
        if len(key):
            if int(key[0]) == large:
                yield from tiled(True)
            else:
                yield from groups(key, held)

    return run


def _across(rule: Rule, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                yield _links(*rule.across(*(np.frombuffer(x.as_py(), np.int64).reshape(-1, width) for x in (one, two)))).select(["a", "b"])

    return run


def hub_links(rows: DataFrame, rule: Rule, n: int, large_from: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) by the rule within each key of `rows` (key, members' longs), and the rows of keys with more than `large_from`.

    The rule is to link members of such a key to a few of them only.
    """
    names, width = rows.columns, len(rows.columns) - 1
    dealt = rows.repartition(max(1, -(-n // KEYS_PER_TASK)), "key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_linker(rule, tile, large_from=large_from), LINKS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                members = np.frombuffer(data.as_py(), np.int64).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), key)), *(pa.array(members[:, i]) for i in range(width))], names)

    large = found.where("data is not null").select("key", "data").mapInArrow(spread, ", ".join(f"{c} long" for c in names))
    return found.where("a is not null").select("a", "b").distinct(), large


def links_by_key(rows: DataFrame, rule: Rule, n: int, tile: int = TILE) -> DataFrame:
    """(a, b): links by the rule between the rows (key, and the members' longs) of each key; n is about how many rows there are.

    A key of more rows than a tile is shipped as tiles, and each pair of its
    tiles is compared in the task of the pair's first or second tile.
    """
    dealt = rows.repartition(max(1, -(-n // KEYS_PER_TASK)), "key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_linker(rule, tile), LINKS))
    tiles = found.where("tile is not null").select("key", "tile", "data")
    out = found.where("a is not null").select("a", "b")
    if not tiles.isEmpty():
        each = tiles.select("key", "tile")
        pairs = each.alias("x").join(each.alias("y"), F.expr("x.key = y.key and x.tile < y.tile")).select("x.key", F.col("x.tile").alias("one"), F.col("y.tile").alias("two"))
        for side in ("one", "two"):
            pairs = pairs.join(tiles.select("key", F.col("tile").alias(side), F.col("data").alias(f"data_{side}")), ["key", side])
        out = out.unionByName(pairs.select("data_one", "data_two").mapInArrow(_across(rule, len(rows.columns) - 1), "a long, b long"))
    return out.distinct()


def near_links(nodes: DataFrame, n: int, near: int = NEAR, tile: int = TILE) -> DataFrame:
    """(a, b): links between nodes (fp, doc_id; fp distinct) that connect all pairs within `near` bits."""
    masks = block_masks(n, near)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))
    return links_by_key(nodes.select(F.explode(keys).alias("key"), "doc_id", "fp"), within(near), n * len(masks), tile)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, near: int = NEAR, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    own = kept(fingerprints(docs, size))
    nodes = kept(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n")))
    named = nodes.where("doc_id is not null").select("fp", "doc_id")
    roots = components(near_links(named, nodes.count(), near, tile))
    labelled = nodes.join(roots, nodes.doc_id == roots.node, "left").select("fp", F.coalesce("root", "doc_id").alias("component_id"), "_n")
    return with_group(own, kept(labelled), "fp", "_n").select("doc_id", "fp", "component_id")


def one_per_component(rows: DataFrame, doc_id: Column, found: DataFrame) -> DataFrame:
    """Of each component in found (row, component) the one of `rows` with the smallest doc_id; a null one only where there is no other."""
    ids = rows.select(F.col("_row").alias("row"), doc_id.cast("long").alias("_id"))
    member = kept(found.join(ids, "row").select("component", F.struct(F.col("_id").isNull().alias("none"), "_id", "row").alias("me")))
    first = kept(member.groupBy("component").agg(F.min("me").alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = with_group(member, first, "component", "n").where("me.row <> first.row").select(F.col("me.row").alias("_row"))
    return rows.join(few(gone), "_row", "left_anti")


def survivors(docs: DataFrame, size: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """One row of `docs` for each component, with all its columns: that with the smallest doc_id."""
    rows = with_rows(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), packed(docs, "text").alias("text")), size, near)
    return unpacked(one_per_component(rows, packed(docs, "doc_id"), found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))), docs)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
