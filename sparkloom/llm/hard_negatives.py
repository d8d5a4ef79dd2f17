"""Hard negatives of anchors, by exact scores from residue matrix products.

A vector is quantised to integers.  Its score with another is their integer
inner product, found without wide arithmetic: both matrices are reduced modulo
several small primes, the residues (at most half a prime, with a sign) are
multiplied in float32, where sums below 2 ** 24 are exact, and the signed
product is put together by Chinese remaindering.  As many primes are taken as
the bound ``columns * largest * largest`` of the two blocks needs.

Rows lie in packed blocks.  Each block of anchors meets each block of rows:
the anchors are a stated query set, and what is compared is the answer's own
cost.  Within a task the best of an anchor are kept across blocks, so what is
shuffled follows the anchors and not the pairs.

Two passes: the first finds the positives of each anchor (the best other rows
of its label), the second selects, for each positive, the best rows of other
labels whose score lies in the positive's window.

Rows with a null label, a null vector or any component that is null or not
finite take no part; a null vec_id is no anchor and comes last among ties.
Rows that repeat a vec_id are rows of their own: each is an anchor, and one is
an "other row" for the next; between equal scores and ids any comes first.
Vectors of different lengths are compared as if zeros followed the shorter.
Blocks whose scores may reach 2 ** 60 raise an error: the result is a long.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm._session import kept, written

SCALE = 256
#: Bytes of a packed block of rows, and the most rows of a block of anchors.
BLOCK_BYTES, ANCHORS = 2 << 20, 512
#: Bytes of all blocks of anchors up to which they are broadcast; beyond, they are shuffled.
BROADCAST_BYTES = 32 << 20
#: Best rows (scores and rows of all anchors) that a task holds before it passes them on.
HELD = 4_000_000
POSITIVES, NEGATIVES = 5, 10
#: Of a hundred parts of the positive's score, what a negative's has at least and at most.
WINDOW = (30, 90)
MOST_SCORE = 1 << 60
_LAST = np.iinfo(np.int64).max


def _primes(below: int = 256) -> list[int]:
    """Primes below a number, largest first."""
    return [p for p in range(below - 1, 2, -1) if all(p % d for d in range(2, int(p**0.5) + 1))]


def moduli(bound: int) -> list[int]:
    """The fewest of the largest primes whose product exceeds four times the bound."""
    if bound >= MOST_SCORE:
        raise ArithmeticError(f"scores may reach {bound}, more than is put together in a long")
    out, product = [], 1
    for p in _primes():
        if product > 4 * bound:
            break
        out.append(p)
        product *= p
    return out


def _residues(m: np.ndarray, p: int) -> np.ndarray:
    """m modulo p as float32, from -(p // 2) to p // 2."""
    r = m % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices as int64, by float32 products modulo primes."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    primes = moduli(width * top(a) * top(b))
    out, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        x, y = _residues(a, p), _residues(b, p)
        step = (1 << 24) // (p // 2) ** 2  # columns whose sum stays exact
        r = np.zeros(out.shape, np.int64)
        for k in range(0, width, step):
            r += (x[:, k : k + step] @ y[:, k : k + step].T).astype(np.int64) % p
        # Mixed radix: the next digit makes the sum right modulo p too.
        digit = (r - out) % p * pow(product % p, -1, p) % p
        # The last digit has a sign; as the product is four times the bound, that is the sign of the sum.
        out += (np.where(digit > p // 2, digit - p, digit) if p == primes[-1] else digit) * product
        product *= p
    return out


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at most k allowed entries of each row of `scores`: the highest, earlier columns first among ties."""
    rows, columns = [], []
    for i in np.flatnonzero(allowed.any(1)):
        own = np.flatnonzero(allowed[i])
        s = scores[i, own]
        if len(own) > 4 * k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            own = own[s >= least]
            s = scores[i, own]
        first = own[np.argsort(-s, kind="stable")[:k]]
        rows.append(np.full(len(first), i))
        columns.append(first)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


PACKED = "block long, n long, width long, ids binary, rows binary, labels binary, matrix binary"
_PACKED = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as the rows of a matrix, zeros behind the shorter ones."""
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _pack(batch: pa.RecordBatch, most: int, block: int) -> Iterator[dict]:
    """Blocks of the rows (_row, vec_id, label, q) of a batch, in order of vec_id."""
    ids = np.asarray(batch.column(1).fill_null(_LAST), np.int64)
    order = np.lexsort((np.asarray(batch.column(0), np.int64), ids))
    matrix = _matrix(batch.column(3))
    each = max(1, min(most, BLOCK_BYTES // (8 * matrix.shape[1])))
    rows, labels = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(2), np.int64)
    for k in range(0, len(order), each):
        at = order[k : k + each]
        yield {"block": block, "n": len(at), "width": matrix.shape[1], "ids": ids[at].tobytes(), "rows": rows[at].tobytes(), "labels": labels[at].tobytes(), "matrix": matrix[at].tobytes()}


def quantised(vectors: DataFrame, label: Column | None = None, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(_row, vec_id, label, q) of the rows that take part, written once: q is floor(scale * x) of each component."""
    label = F.col("label") if label is None else label
    x = F.col(vector)
    sound = label.isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    own = vectors.where(F.coalesce(sound, F.lit(False)))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return written(own.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), q.alias("q")))


def _blocks(points: DataFrame, most: int = 1 << 20) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _pack(batch, most, 0):
                yield pa.RecordBatch.from_pylist([block], _PACKED)

    return points.select("_row", "vec_id", "label", "q").mapInArrow(run, PACKED)


def _anchor_blocks(anchors: DataFrame, n: int, most: int = ANCHORS) -> DataFrame:
    """(block, anchors): packed blocks of anchors, dealt by a hash of their row; `windows` has the scores of their positives, if any."""
    blocks = max(1, -(-n // most))
    schema = "block long, n long, width long, ids binary, rows binary, labels binary, matrix binary, windows binary"
    arrow = _PACKED.append(pa.field("windows", pa.binary()))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0] if len(table) else None
        if batch is None:
            return arrow.empty_table()
        one = next(_pack(batch.select(["_row", "vec_id", "label", "q"]), len(batch), int(key[0].as_py())))
        own = [one]
        if BLOCK_BYTES // (8 * one["width"]) < len(batch):  # wide vectors: more blocks of one number
            own = list(_pack(batch.select(["_row", "vec_id", "label", "q"]), len(batch), int(key[0].as_py())))
        windows = dict(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()))
        for block in own:
            rows = np.frombuffer(block["rows"], np.int64).tolist()
            scores = [windows[r] or [] for r in rows]
            flat = np.full((len(rows), max(map(len, scores), default=0)), -1, np.int64)
            for i, s in enumerate(scores):
                flat[i, : len(s)] = s
            block["windows"] = flat.tobytes()
        return pa.Table.from_pylist(own, arrow)

    own = anchors if "windows" in anchors.columns else anchors.withColumn("windows", F.lit(None).cast("array<long>"))
    dealt = own.select("_row", "vec_id", "label", "q", F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("block"), "windows")
    return dealt.groupBy("block").applyInArrow(run, schema)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Each block of rows with each block of anchors, anchors packed in the columns a_*."""
    own = rows.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    own_anchors = anchors.select(*(F.col(c).alias(c if c == "block" else f"a_{c}") for c in anchors.columns))
    size = own_anchors.agg(F.sum(F.octet_length("a_matrix") + F.octet_length("a_windows") + 24 * F.col("a_n"))).first()[0] or 0
    return own.join(F.broadcast(own_anchors) if size <= BROADCAST_BYTES else own_anchors, "block")


FOUND = "anchor long, slot int, score long, vec_id long, row long"
_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])


class _Kept:
    """The best k rows of each (anchor, slot) so far, for one block of anchors: arrays in no order."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def pruned(self) -> None:
        anchor, slot, score, ids, rows = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((rows, ids, -score, slot, anchor))
        a, s = anchor[order], slot[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])))[: len(a)])
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = order[rank < self.k]
        self.parts = [(anchor[keep], slot[keep], score[keep], ids[keep], rows[keep])]
        self.size = len(keep)


def _searched(met: DataFrame, k: int, windows: tuple[int, int] | None) -> DataFrame:
    """FOUND rows: of each anchor (and each of its positives, the slot, if windows are given) the best k of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, _Kept] = OrderedDict()

        def passed(own: _Kept) -> pa.RecordBatch:
            own.pruned()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own.parts[0], _FOUND.types)], schema=_FOUND)

        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}
                array = lambda name: np.frombuffer(row[name].as_buffer() or b"", np.int64)  # noqa: B023, E731
                n, m = row["n"].as_py(), row["a_n"].as_py()
                a, b = array("a_matrix").reshape(m, -1), array("matrix").reshape(n, -1)
                scores = exact_product(a, b)
                same = array("a_labels")[:, None] == array("labels")[None, :]
                block = row["block"].as_py()
                own = held.setdefault(block, _Kept(k))
                if windows is None:
                    i, j = _best(scores, same & (array("a_rows")[:, None] != array("rows")[None, :]), k)
                    own.add(array("a_rows")[i], np.zeros(len(i), np.int32), scores[i, j], array("ids")[j], array("rows")[j])
                else:
                    positives = array("a_windows").reshape(m, -1)
                    for slot in range(positives.shape[1]):
                        p = positives[:, slot][:, None]
                        low, high = -(-windows[0] * p // 100), windows[1] * p // 100
                        i, j = _best(scores, ~same & (p >= 0) & (scores >= low) & (scores <= high), k)
                        own.add(array("a_rows")[i], np.full(len(i), slot, np.int32), scores[i, j], array("ids")[j], array("rows")[j])
                if own.size > 4 * k * m * (1 if windows is None else POSITIVES):
                    own.pruned()
                while sum(x.size for x in held.values()) > HELD and len(held) > 1:
                    yield passed(held.popitem(last=False)[1])
        for own in held.values():
            if own.parts:
                yield passed(own)

    return met.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each (anchor, slot) of all tasks, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(points: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of quantised() rows; anchors are those whose vec_id is divisible by `every`."""
    anchors = points.where(F.col("vec_id") % every == 0)
    n = anchors.count()
    blocks = max(1, -(-n // ANCHORS))
    rows = written(_blocks(points))
    best = _ranked(_searched(_met(rows, kept(_anchor_blocks(anchors, n)), blocks), positives, None), positives)
    own = kept(best.select(F.col("anchor").alias("_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")))
    # A positive whose score is negative has an empty window.
    scores = own.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("s")).select("_row", F.transform("s", lambda e: e["positive_score"]).alias("windows"))
    with_windows = anchors.join(scores, "_row")
    found = _ranked(_searched(_met(rows, kept(_anchor_blocks(with_windows, n)), blocks), negatives, window), negatives)
    pairs = own.join(anchors.select("_row", F.col("vec_id").alias("anchor_id")), "_row")
    out = found.join(pairs, (F.col("anchor") == F.col("_row")) & (found["slot"] == pairs["slot"]))
    absent = lambda c: F.when(F.col(c) != int(_LAST), F.col(c))
    return out.select("anchor_id", absent("positive_id").alias("positive_id"), "rank", absent("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in all of embeddings; every seventh label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLES = {
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
              FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10
    """
}
