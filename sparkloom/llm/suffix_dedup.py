"""Removal of long repeated byte strings by longest previous factors.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id is removed; strings are those of the input.

1. Anchors.  The string at each start has an anchor, the smallest hash among
   its grams of ``GRAM`` bytes; equal strings have equal anchors.  Consecutive
   starts with one anchor are a run.
2. Every chunk of documents sends the distinct anchors of its runs to buckets;
   a bucket answers which occur in more than one document.
3. For runs with such anchors, the chunk sends each distinct text of a run, with
   the smallest doc_id that has it, to the anchor's bucket, where all copies of
   all its strings meet.
4. The bucket sorts the suffixes that start a string by their first ``LENGTH``
   bytes and then by document, and finds for each the previous and the next
   suffix of a smaller document; the longer of the two common prefixes is its
   longest previous factor, of which one bit goes back: whether it is a whole
   string.  So the factors of a text need only be compared within its bucket.
5. The chunk marks the covered bytes of each document.

A text travels to Python once per pass and is shuffled once.  A passage that a
third of all documents share is one text per chunk, however many documents have
it.  Null and empty texts have no strings; a null doc_id is larger than any
other; of rows that repeat a doc_id none is earlier than another.  An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._chunks import PIECE, by_bucket, chunked, joined, mix, pieces

LENGTH, GRAM = 50, 20
#: Starts in one text of a run; a longer run is cut at multiples of it.
STARTS = 32
#: Text of a chunk: what it takes in a worker is about 40 times as much.
CHUNK_BYTES = 4 << 20
BLOCK = 1 << 16
#: Chunks for each bucket.
SPREAD = 2
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LAST = np.int64((1 << 63) - 1)

with np.errstate(over="ignore"):
    _TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Anchor of the string of `length` bytes at each start (len(text) - length + 1 of them)."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    width = length - gram + 1
    for s in range(0, n, BLOCK):
        h = _TABLE[text[s : s + min(BLOCK, n - s) + length - 1]]
        size, powers = 1, {1: h}
        for k in range(gram.bit_length() - 1):  # hashes of 2, 4, 8, ... bytes
            h = h[:-size] * _ODD[k] + h[size:]
            size *= 2
            powers[size] = h
        at, left = size, gram - size
        while left:  # and the rest of the gram from the smaller ones
            part = 1 << (left.bit_length() - 1)
            more = powers[part][at:]
            h = h[: len(more)] * _ODD[4] + more
            at += part
            left -= part
        h = h ^ (h >> np.uint64(32))
        h *= _ODD[2]
        h ^= h >> np.uint64(29)
        size = 1
        while size * 2 <= width:  # minima of 2, 4, 8, ... grams
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        if size < width:
            h = np.minimum(h[: len(h) - (width - size)], h[width - size :])
        out[s : s + BLOCK] = h
    return out


def runs(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, starts, anchor, document) of each run, documents lying end to end in `body`; long runs are cut."""
    value = anchors(body, length, gram)
    n = len(value)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(value[1:], value[:-1], out=change[1:])
    firsts = offsets[:-1][offsets[:-1] < n]
    change[firsts] = True
    beyond = np.maximum(offsets[1:] - length + 1, offsets[:-1])  # starts from here on would cross into the next document
    change[beyond[beyond < n]] = True
    start = np.flatnonzero(change)
    document = np.searchsorted(offsets, start, side="right") - 1
    size = np.diff(np.append(start, n))
    good = start < beyond[document]
    start, size, document = start[good], size[good], document[good]
    parts = -(-size // STARTS)
    if (parts > 1).any():
        own = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size, document = start[own] + nth * STARTS, np.minimum(size[own] - nth * STARTS, STARTS), document[own]
    return start, size, value[start], document


def _spread(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each anchor, and what tells it apart there (48 bits)."""
    with np.errstate(over="ignore"):
        m = mix(value)
    return ((m >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64) if buckets <= 1 << 16 else (m % np.uint64(buckets)).astype(np.int64), m & np.uint64((1 << 48) - 1)


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6]


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body, offsets = joined(table.column("text"))
    ids = table.column("doc_id").cast(pa.int64()).fill_null(int(LAST)).to_numpy()
    return body, offsets, ids


class _Chunk:
    """What every pass finds again in the same documents of a chunk.  Rows are put in the order of their ids and texts."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.table = table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.body, self.offsets, self.ids = _documents(table)
        self.start, self.size, anchor, self.document = runs(self.body, self.offsets, length, gram)
        self.distinct, self.of = np.unique(anchor, return_inverse=True)
        self.doc = self.ids[self.document]

    def dealt(self, buckets: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """Distinct anchors of each bucket, and the marks of all."""
        bucket, mark = _spread(self.distinct, buckets)
        return by_bucket(bucket), mark

    def shared_here(self) -> np.ndarray:
        """Which distinct anchors occur in several documents of the chunk."""
        low = np.full(len(self.distinct), LAST)
        high = np.full(len(self.distinct), -LAST)
        np.minimum.at(low, self.of, self.doc)
        np.maximum.at(high, self.of, self.doc)
        return low < high

    def answers(self, table: pa.Table) -> dict[int, bytes]:
        return dict(zip(table.column("to").to_pylist(), table.column("data").to_pylist()))

    def shared(self, masks: pa.Table, buckets: int) -> np.ndarray:
        """Runs whose anchor occurs in several documents, by the buckets' answers."""
        dealt, _ = self.dealt(buckets)
        flag = np.zeros(len(self.distinct), bool)
        for bucket, data in self.answers(masks).items():
            own = dealt[bucket]
            flag[own] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(own)).astype(bool)
        return np.flatnonzero(flag[self.of])

    def texts(self, which: np.ndarray, length: int, buckets: int):
        """Distinct (text, starts) among runs: rows of padded bytes, starts, smallest doc, inverse, and the texts of each bucket."""
        width = length - 1 + STARTS
        size = self.size[which]
        padded = np.concatenate((self.body, np.zeros(width, np.uint8)))
        rows = np.empty((len(which), width + 1), np.uint8)
        rows[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[self.start[which]]
        rows[:, :width] *= np.arange(width) < (size + length - 1)[:, None]
        rows[:, width] = size
        first, inverse = _same(rows)
        low = np.full(len(first), LAST)
        np.minimum.at(low, inverse, self.doc[which])
        bucket, _ = _spread(self.distinct[self.of[which[first]]], buckets)
        return rows[first], low, inverse, by_bucket(bucket)


def _same(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct row, and which distinct row each is."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    key = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for word in wide.view(np.uint64).T:
            key = mix(key ^ word) + _ODD[0]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if not np.array_equal(rows, rows[first][inverse]):  # two texts with one hash
        _, first, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, inverse


def suffixes(rows: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the strings of texts: (order, documents in it, common prefix of each with the one before).

    Suffixes are numbered text by text and start by start, and sorted by their
    first `length` bytes, then by document; prefixes count up to `length`.
    """
    size = rows[:, -1].astype(np.int64)
    text = np.repeat(np.arange(len(rows)), size)
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(rows, ((0, 0), (0, 8))), 8, axis=1)

    def word(which: np.ndarray, w: int) -> np.ndarray:
        """Bytes 8w to 8w + 7 of suffixes as numbers, without those beyond `length`."""
        key = view[text[which], at[which] + 8 * w].view(">u8").ravel().astype(np.uint64)
        over = 8 * (w + 1) - length
        return key if over <= 0 else key >> np.uint64(8 * over)

    def level(key: np.ndarray) -> np.ndarray:
        """Leading bytes that neighbours have in common (8 where they are equal)."""
        differ = key[1:] ^ key[:-1]
        return sum((differ < np.uint64(1 << 64 - 8 * k)).astype(np.int64) for k in range(1, 8)) + (differ == 0)

    key = word(np.arange(n), 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    common = np.concatenate(([0], level(key << np.uint64(8 * max(0, 8 - length)))))
    same = np.concatenate(([False], key[1:] == key[:-1]))
    # Most significant word first: each further word only orders suffixes that are still equal.
    for w in range(1, -(-length // 8)):
        where = np.flatnonzero(same | np.append(same[1:], False))
        if not len(where):
            break
        group = np.cumsum(~same)[where]
        key = word(order[where], w)
        sub = np.lexsort((key, group))
        order[where] = order[where[sub]]
        key = key[sub]  # groups stay in place, so same[where] still tells where they begin
        again = same[where]
        over = max(0, 8 * (w + 1) - length)
        more = level(key << np.uint64(8 * over))
        common[where[1:][again[1:]]] = (8 * w + more)[again[1:]]
        again[1:] &= key[1:] == key[:-1]
        same[where] = again
    common[same] = length
    ranked = np.lexsort((doc[text[order]], np.cumsum(~same)))
    order = order[ranked]
    return order, doc[text[order]], common


def previous_factors(doc: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors in suffix order: for each suffix the longest prefix that one of a smaller document has, if it reaches `least` (else 0).

    Each suffix points to its neighbour and jumps to where that one points, while
    it isn't of a smaller document and what is in common on the way reaches
    `least`: the previous smaller value, and from the other end the next one.
    """
    out = np.zeros(len(doc), np.int64)
    for d, shared in ((doc, common), (doc[::-1], np.concatenate(([0], common[:0:-1])))):
        smaller, way = np.arange(len(d)) - 1, shared.copy()
        way[smaller < 0] = 0
        open_ = np.flatnonzero(way >= least)
        while len(open_ := open_[d[smaller[open_]] >= d[open_]]):
            on = smaller[open_]
            way[open_], smaller[open_] = np.minimum(way[open_], way[on]), smaller[on]
            open_ = open_[way[open_] >= least]
        found = np.where((smaller >= 0) & (way >= least), way, 0)
        out = np.maximum(out, found if d is doc else found[::-1])
    return out


def earlier(rows: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string of `length` bytes in the texts (text by text): whether it is in a text of a smaller document."""
    order, documents, common = suffixes(rows, doc, length)
    out = np.zeros(len(order), bool)
    out[order] = previous_factors(documents, common, length) >= length
    return out


OUT = "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long"


def _answer_shared(key, table):
    """Bucket: which of the anchors that each chunk sent occur in several documents."""
    data = table.column("data").to_pylist()
    sizes = [len(d) * 8 // 49 for d in data]  # n marks of 6 bytes and n bits
    marks, flags = [], []
    for d, n in zip(data, sizes):
        raw = np.frombuffer(d, np.uint8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = raw[: 6 * n].reshape(n, 6)
        marks.append(wide.view(np.uint64).ravel())
        flags.append(np.unpackbits(raw[6 * n :], count=n))
    mark, flag = np.concatenate(marks), np.concatenate(flags)
    distinct, inverse, count = np.unique(mark, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[inverse[flag > 0]] = True
    out, at = [], 0
    for chunk, n in zip(table.column("chunk").to_pylist(), sizes):
        out.append((int(key[0].as_py()), chunk, np.packbits(shared[inverse[at : at + n]]).tobytes()))
        at += n
    return pieces(out)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, kept (remaining bytes), spans (maximal removed byte ranges), n_bytes."""
    base, n = chunked(docs, chunk_bytes)
    buckets = -(-n // SPREAD)
    width = length + STARTS

    def ask(key, table):
        own = _Chunk(table, length, gram)
        dealt, mark = own.dealt(buckets)
        several = own.shared_here()
        return pieces([(b, int(key[0].as_py()), _six(mark[which]).tobytes() + np.packbits(several[which]).tobytes()) for b, which in dealt.items()])

    def send(key, left, masks):
        if not left.num_rows:
            return pieces([])
        own = _Chunk(left, length, gram)
        rows, low, _, dealt = own.texts(own.shared(masks, buckets), length, buckets)
        return pieces([(b, int(key[0].as_py()), low[which].tobytes() + rows[which].tobytes()) for b, which in dealt.items()])

    def factors(key, table):
        """Bucket: of every string of every text that a chunk sent, whether it is in a document smaller than the text's smallest there."""
        rows, low, sizes = [], [], []
        for d in table.column("data").to_pylist():
            k = len(d) // (8 + width)
            low.append(np.frombuffer(d, np.int64, k))
            rows.append(np.frombuffer(d, np.uint8, offset=8 * k).reshape(k, width))
            sizes.append(k)
        rows, low = np.concatenate(rows), np.concatenate(low)
        first, inverse = _same(rows)
        least = np.full(len(first), LAST)
        np.minimum.at(least, inverse, low)
        rows = rows[first]
        found = earlier(rows, least, length)
        size = rows[:, -1].astype(np.int64)
        begin = np.cumsum(size) - size
        out, at = [], 0
        for chunk, k in zip(table.column("chunk").to_pylist(), sizes):
            own, here = inverse[at : at + k], low[at : at + k]
            at += k
            each = np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(size[own].sum())
            out.append((int(key[0].as_py()), chunk, np.packbits(found[each] | np.repeat(least[own] < here, size[own])).tobytes()))
        return pieces(out)

    def remove(key, left: pa.Table, masks: pa.Table, firsts: pa.Table) -> pa.Table:
        own = _Chunk(left, length, gram)
        which = own.shared(masks, buckets)
        rows, low, inverse, dealt = own.texts(which, length, buckets)
        size = rows[:, -1].astype(np.int64)
        begin = np.zeros(len(rows), np.int64)
        values, at = [], 0
        for b, data in own.answers(firsts).items():
            mine = dealt[b]
            v = np.unpackbits(np.frombuffer(data, np.uint8), count=int(size[mine].sum()))
            begin[mine] = at + np.cumsum(size[mine]) - size[mine]
            values.append(v)
            at += len(v)
        value = np.concatenate(values).astype(bool) if values else np.zeros(0, bool)
        n_of = own.size[which]
        nth = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        gone = value[np.repeat(begin[inverse], n_of) + nth] | np.repeat(own.doc[which] > low[inverse], n_of)
        at = (np.repeat(own.start[which], n_of) + nth)[gone]
        step = np.zeros(len(own.body) + 1, np.int32)
        step[at] += 1
        step[at + length] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept, spans = [], []
        ends = own.offsets.tolist()
        upto = np.concatenate(([0], np.cumsum(gone)))
        touched = upto[own.offsets[1:]] > upto[own.offsets[:-1]]
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            part = own.body[a:b]
            if not touched[i]:
                kept.append(part.tobytes())
                spans.append([])
                continue
            mask = gone[a:b]
            d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
            kept.append(part[~mask].tobytes())
            spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist())])
        return pa.table({"doc_id": own.table.column("doc_id").cast(pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "n_bytes": pa.array(np.diff(own.offsets))})

    by_chunk = base.groupBy("_chunk")
    asked = by_chunk.applyInArrow(ask, PIECE)
    masks = asked.groupBy("to").applyInArrow(_answer_shared, PIECE).withColumnRenamed("chunk", "_chunk")
    sent = by_chunk.cogroup(masks.groupBy("_chunk")).applyInArrow(send, PIECE)
    firsts = sent.groupBy("to").applyInArrow(factors, PIECE).withColumnRenamed("chunk", "_chunk")
    both = masks.select("to", "_chunk", "data", F.lit(0).alias("kind")).unionByName(firsts.select("to", "_chunk", "data", F.lit(1).alias("kind")))

    def last(key, left, answers):
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=_OUT_ARROW)
        kind = np.asarray(answers.column("kind").combine_chunks()) if answers.num_rows else np.zeros(0, np.int32)
        return remove(key, left, answers.filter(pa.array(kind == 0)), answers.filter(pa.array(kind == 1)))

    return by_chunk.cogroup(both.groupBy("_chunk")).applyInArrow(last, OUT)


_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_bytes", pa.int64())])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without its later copies of 50-byte strings."""
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
