"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash links (fingerprints of the same shingles within 4 bits) come first;
they settle most of a large cluster without comparing all its pairs.  As such
texts may be less similar than 0.8, and similar ones further apart than any
number of blocks reaches, links are only candidates, and the other pairs come
from an exact prefix join: of n shingles in an order that all texts share, two
texts of the wanted similarity have one in common among their first
n - ceil(0.8 n) + 1.  Rare shingles come first: those of all texts are counted
in cells of their hashes, and only the work depends on which share a cell.  Sizes, positions and
parities rule out pairs that can't reach the similarity (a bit of a parity is
the number of shingles of that hash modulo 2, so two sets differ in at least as
many shingles as their parities in bits).  Texts of a frequent shingle meet one
of them first; those still apart are compared by their parities where they are,
in a few passes with one partner each, then with all.  What is left falls into components
of candidates; the texts of a component go to one task, each once, where sets
are compared until they are connected, so exactly the wanted links count.  A
component too large for a task is compared pair by pair.

Equal sets (a 64-bit hash names them) are one node, that of their smallest row.
Texts without words have the empty set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._chunks import mix
from sparkloom.llm._graph import components
from sparkloom.llm._session import few, hinted, kept, packed, unpacked, with_group, with_rows, written
from sparkloom.llm._worker import let_go
from sparkloom.llm.simhash import NEAR, Rule, hashed_shingles, hub_links, links_by_key, near_links, one_per_component, simhash

WORDS = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Cells that shingles are counted in, at least and at most, as powers of two; between, the one from the bytes of text on.
CELLS = (16, 22)
#: Cells whose counts are sent at a time.
SEGMENT = 4096
#: Bits of a set's parity at least and at most; between, the power of two from its size on.
PARITY = (512, 1 << 16)
#: Members of a key that are compared in one task before the rest is shipped to others.
TILE = 4096
#: Members of a key up to which all are compared at once; of more, all with one first, and those still apart in a second pass.
HUBS = 64
#: Passes in which each member of such a key meets one that it may be similar to, before all are compared.
PASSES = 4
#: Shingles of a component of candidates that one task compares, and of the components that one bucket holds on average.
WHOLE, BUCKET = 4_000_000, 1_000_000


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes."""
    parts = list(hashed_shingles(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def parity(own: np.ndarray) -> bytes:
    """Of each remainder of the hashes by a power of two near the set's size: whether an odd number of them has it."""
    bits = min(PARITY[1], max(PARITY[0], 1 << len(own).bit_length()))
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def parity_difference(p: bytes, q: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the other's length: no more than the sets' shingles differ in."""
    p, q = sorted((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)), key=len)
    return int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)))).sum())


def similar(common, n, m, least: tuple[int, int] = LEAST):
    """Whether sets of n and m with so many in common reach the similarity."""
    return common * (least[0] + least[1]) >= (n + m) * least[0]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts of a segment in the fewest bytes each that hold them."""
    return counts.astype(next(f"<u{b}" for b in (1, 2, 4, 8) if not int(counts.max()) >> 8 * b)).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // SEGMENT}").astype(np.int64)


def _cells(own: np.ndarray, n: int) -> np.ndarray:
    """Of n cells, a power of two, the one of each hash."""
    return (own >> np.uint64(65 - n.bit_length())).astype(np.int64)


def _counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many shingles, each once for each text that has it, fall into each cell, over all texts.

    A task sends one packed segment of counts after the other, and those of a
    segment are added up as they come: the counts of no other task are held.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 << min(max(CELLS[0], total.bit_length()), CELLS[1])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        own = np.zeros(n, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(own, _cells(shingle_set(text.as_py(), size), n), 1)
        if own.any():
            packs = [zlib.compress(_narrow(x), 1) for x in own.reshape(-1, SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packs)), pa.int64()), pa.array(packs, pa.binary())], ["segment", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[at] = sums.get(at, 0) + _wide(zlib.decompress(data.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array(map(_narrow, sums.values()), pa.binary())], ["segment", "data"])

    form = "segment long, data binary"
    found = rows.select("text").mapInArrow(counted, form).repartition("segment").mapInArrow(added, form).toArrow()
    out = np.zeros((n // SEGMENT, SEGMENT), np.int64)
    for at, data in zip(found.column(0).to_pylist(), found.column(1)):
        out[at] = _wide(data.as_py())
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32).reshape(-1)


def _marks(rows: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """(row, node, fp, n, parity, keys): each row's set, its fingerprint, size and parity, and its first shingles, rare ones first."""
    counts = _counts(rows, size)
    schema = pa.schema([("row", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("parity", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            node, fp, sizes, parities, keys = [], [], [], [], []
            for text in batch.column(1):
                parts = list(hashed_shingles(text.as_py(), size))
                fp.append(simhash(parts))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                node.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                parities.append(parity(own))
                first = len(own) + 1 - -(-least[0] * len(own) // least[1]) if len(own) else 0
                # By counts, and those of one count by hash.
                keys.append(own[np.argsort(counts[_cells(own, len(counts))], kind="stable")[:first]].view(np.int64))
            arrays = [batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.select("_row", "text").mapInArrow(run, "row long, node long, fp long, n long, parity binary, keys array<long>")


def _prefixes(least: tuple[int, int], hubs_from: int | None = None, turn: int | None = None) -> Rule:
    """Members (row, root, size, place, and words of a folded parity if there are any) of one prefix shingle that may reach the similarity and aren't connected yet.

    With `hubs_from`, members of a key with more than so many are only paired
    with one of them, drawn by hash: so a text meets as many others as it has
    keys, which connects a large cluster without all its pairs.  With `turn`,
    each member is paired with one of those that it may reach, another in each
    turn: so no more pairs than members.
    """

    def pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m, at, to = x[:, 2], y[:, 2], x[:, 3], y[:, 3]
        most = np.minimum(at, to) + np.minimum(n - at, m - to)
        good = (x[:, 1] != y[:, 1]) & similar(most, n, m, least) & similar(np.minimum(n, m), n, m, least)
        if x.shape[1] > 4:
            apart = np.bitwise_count((x[:, 4:] ^ y[:, 4:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            good &= similar(n + m - apart, 2 * n, 2 * m, least)
        return good

    def one_each(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            drawn = mix(x[:, 0].view(np.uint64) + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15))
        may = ((i, good) for i in range(len(x)) if len(good := np.flatnonzero(pairwise(x[i : i + 1], y))))
        return _ordered([(x[i : i + 1, 0], y[good[int(drawn[i]) % len(good)], 0].reshape(1)) for i, good in may])

    def across(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if turn is not None:
            return one_each(x, y)
        parts = [(np.broadcast_to(x[i, 0], len(good)), y[good, 0]) for i in range(len(x)) if len(good := np.flatnonzero(pairwise(x[i : i + 1], y)))]
        return _ordered(parts)

    def group(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if hubs_from is not None and len(m) > hubs_from:
            with np.errstate(over="ignore"):
                hub = int(np.argmin(mix((m[:, 0] ^ np.bitwise_xor.reduce(m[:, 0])).view(np.uint64))))
            return across(m[hub : hub + 1], m)
        if turn is not None:
            return one_each(m, m)
        parts = [(np.broadcast_to(m[i, 0], len(good)), m[i + 1 :][good, 0]) for i in range(len(m) - 1) if len(good := np.flatnonzero(pairwise(m[i : i + 1], m[i + 1 :])))]
        return _ordered(parts)

    return Rule(pairwise, group, across)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parity in the last column as the words of one of the least length."""
    words = PARITY[0] // 64
    for batch in batches:
        own = np.array([np.bitwise_xor.reduce(np.frombuffer(x.as_py(), np.int64).reshape(-1, words)) for x in batch.column(5)], np.int64).reshape(-1, words)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(own[:, i]) for i in range(words))], [*batch.schema.names[:5], *(f"p{i}" for i in range(words))])


def _ordered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return np.minimum(a, b), np.maximum(a, b)


def _ends(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of `table` (row) of both ends."""
    a, b = (table.select(F.col("row").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in columns)) for e in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", *(f"{c}_{e}" for c in columns for e in "ab"))


def _linked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, least: tuple[int, int], whole: int = WHOLE) -> DataFrame:
    """(a, b): links between nodes of which all reach the similarity and connect all `pairs` that do."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n, m = (np.asarray(batch.column(i)) for i in (2, 3))
                apart = np.array([parity_difference(p.as_py(), q.as_py()) for p, q in zip(batch.column(4), batch.column(5))], np.int64)
                # Sets that differ in d shingles have (n + m - d) / 2 in common.
                good = similar(n + m - apart, 2 * n, 2 * m, least)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    def reaches(x: np.ndarray, y: np.ndarray) -> bool:
        return bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least))

    def together(key, texts: pa.Table, links: pa.Table) -> pa.Table:
        """Links among the texts of a bucket; pairs that earlier ones connect aren't compared."""
        sets = dict(zip(texts.column("row").to_pylist(), (shingle_set(t.as_py(), size) for t in texts.column("text"))))
        root = {r: r for r in sets}

        def find(r: int) -> int:
            while root[r] != r:
                root[r] = r = root[root[r]]
            return r

        found = []
        for a, b in sorted(zip(links.column("a").to_pylist(), links.column("b").to_pylist())):
            x, y = find(a), find(b)
            if x != y and reaches(sets[a], sets[b]):
                root[max(x, y)] = min(x, y)
                found.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), size).tobytes() for x in batch.column(1)], pa.binary())], ["row", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [reaches(*(np.frombuffer(z.as_py(), np.uint64) for z in pair)) for pair in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = kept(_ends(pairs, nodes, "n", "parity").mapInArrow(possible, "a long, b long"))
    if pairs.isEmpty():
        return pairs
    member = kept(components(pairs).join(nodes.select(F.col("row").alias("node"), "n"), "node"))
    weights = kept(member.groupBy("root").agg(F.sum("n").alias("weight"), F.count("*").alias("members")))
    total, largest = weights.agg(F.sum("weight"), F.max("weight")).first()
    buckets = max(1, total // BUCKET)
    placed = kept(with_group(member, weights, "root", "members").select(F.col("node").alias("row"), F.when(F.col("weight") <= whole, F.pmod(F.xxhash64("root"), F.lit(buckets))).alias("bucket")))
    texts = rows.join(hinted(placed.withColumnRenamed("row", "_row")), "_row").select("bucket", F.col("_row").alias("row"), "text")
    dealt = pairs.join(hinted(placed.select(F.col("row").alias("a"), F.col("bucket").alias("links_in"))), "a")
    out = texts.where("bucket is not null").groupBy("bucket").cogroup(dealt.where("links_in is not null").groupBy("links_in")).applyInArrow(together, "a long, b long")
    if largest > whole:
        found = kept(texts.where("bucket is null").select("row", "text").mapInArrow(sets, "row long, own binary"))
        out = out.unionByName(_ends(dealt.where("links_in is null").select("a", "b"), found, "own").mapInArrow(check, "a long, b long"))
    return out


def near_copies(rows: DataFrame, size: int = WORDS, least: tuple[int, int] = LEAST, tile: int = TILE, whole: int = WHOLE, hubs: int = HUBS, passes: int = PASSES) -> DataFrame:
    """(row, component): the component, of rows (_row, text) linked by the similarity, each one is in."""
    marks = written(_marks(rows, size, least))
    sets = kept(marks.groupBy("node").agg(F.min_by(F.struct("row", "fp", "n", "parity"), "row").alias("x"), F.count("*").alias("rows")).select("node", "rows", "x.*"))
    nodes = sets.where("n > 0").select("row", "fp", "n", "parity")
    prints = kept(nodes.groupBy("fp").agg(F.min("row").alias("doc_id"), F.count("*").alias("size")))
    equal = with_group(nodes.select("fp", "row"), prints, "fp", "size").where("row <> doc_id").select(F.col("doc_id").alias("a"), F.col("row").alias("b"))
    close = near_links(prints.select("fp", "doc_id"), prints.count(), NEAR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = kept(_linked(kept(equal.unionByName(close).distinct()), nodes, rows, size, least, whole))
    roots = few(components(links).where("node <> root").withColumnRenamed("node", "row"))
    # Each node once; those that are connected already don't meet again.
    again = with_group(marks.select("row", "node"), sets.select("node", F.col("row").alias("first"), "rows"), "node", "rows").where("row <> first").select("row")
    keyed = marks.select("row", "n", "keys").join(few(again), "row", "left_anti").join(roots, "row", "left").select("row", F.coalesce("root", "row").alias("root"), "n", F.posexplode("keys").alias("at", "key"))
    n_keys = marks.agg(F.sum(F.size("keys"))).first()[0] or 0
    pairs, large = hub_links(keyed.select("key", "row", "root", "n", F.col("at").cast("long").alias("at")), _prefixes(least, hubs), n_keys, hubs, tile)
    links = links.unionByName(kept(_linked(kept(pairs), nodes, rows, size, least, whole)))
    # The members of large keys that are still apart: some passes with one partner each, as long as they connect any, then all pairs.
    for turn in (*range(passes), None):
        now = few(components(links).where("node <> root").withColumnRenamed("node", "row"))
        apart = large.drop("root").join(now, "row", "left").join(nodes.select("row", "parity"), "row").select("key", "row", F.coalesce("root", "row").alias("root"), "n", "at", "parity")
        apart = kept(apart.mapInArrow(_folded, f"key long, row long, root long, n long, at long, {', '.join(f'p{i} long' for i in range(PARITY[0] // 64))}"))
        met = kept(links_by_key(apart, _prefixes(least, turn=turn), apart.count(), tile))
        if turn is not None and met.isEmpty():
            break
        found = kept(_linked(met, nodes, rows, size, least, whole))
        links = links.unionByName(found)
    final = few(components(links).withColumnRenamed("node", "first"))
    of_node = sets.select("node", F.col("row").alias("first"), "rows").join(final, "first", "left").select("node", F.coalesce("root", "first").alias("component"), "rows")
    return with_group(marks.select("row", "node"), kept(of_node), "node", "rows").select("row", "component")


def survivors(docs: DataFrame, size: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of near copies the one with the smallest doc_id."""
    rows = with_rows(docs)
    found = near_copies(rows.select("_row", packed(docs, "text").alias("text")), size, least)
    return unpacked(one_per_component(rows, packed(docs, "doc_id"), found), docs)
