"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary answers pre-tokens that
are one token.  Tier two: every other pre-token is merged by a heap of
candidate pairs over a doubly linked list of its bytes, lowest rank first.
Answers are memoised per worker in a table of bounded size.

Null text counts as empty (no ids).  Any byte sequence round-trips, as the 256
single bytes are in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._worker import keeping

#: Entries of the per-worker memo (about 200 bytes each) before it starts afresh.
MEMO_ENTRIES = 900_000


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: hash, displace, compare.

    Keys fall into buckets by the high half of XXH3-64; buckets, largest
    first, get the first displacement that sends all their keys to free slots.
    Buckets of one key store their slot itself (as -slot - 1).
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = m = max(1, n // 2)
        self.shift = np.zeros(m, np.int64).tolist()
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        members: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            members[(h >> 32) % m].append((h, i))
        taken = [False] * n
        order = sorted(range(m), key=lambda b: -len(members[b]))
        free = 0
        for b in order:
            own = members[b]
            if not own:
                break
            if len(own) == 1:
                while taken[free]:
                    free += 1
                taken[free] = True
                self.shift[b] = -free - 1
                self.keys[free], self.values[free] = keys[own[0][1]], own[0][1]
                continue
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in own]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, own):
                taken[s] = True
                self.keys[s], self.values[s] = keys[i], i

    def _slot(self, h: int, d: int) -> int:
        h = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        return ((h * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n

    def get(self, key: bytes) -> int:
        """Index of `key` among the keys, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ids (which are dense from 0)."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be dense from 0")
    return [found[i] for i in range(len(found))]


class _SpaceBeforeSpace(Exception):
    """A part that follows a space is empty or starts with white space."""


class _Memo(dict):
    """Packed ids of ' ' + part."""

    def __init__(self, encode_part):
        super().__init__()
        self.encode_part = encode_part

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace():
            raise _SpaceBeforeSpace
        self[part] = ids = self.encode_part(f" {part}")
        return ids


class Codec:
    """Encoder and decoder of one vocabulary; built once in each Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str, memo_entries: int = MEMO_ENTRIES):
        self.tokens = tokens
        self.whole = PerfectHash(tokens)
        self.split = regex.compile(pattern).findall
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte = [ids[bytes([b])] for b in range(256)]
        n = self.n = len(tokens)
        self.pairs: dict[int, int] = {}
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a * n + b] = i
        self.memo = _Memo(self.encode_part)
        self.most = memo_entries

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token that is no token, by a heap over linked bytes."""
        n, pairs, size = self.n, self.pairs.get, len(piece)
        byte = self.byte
        at = [byte[b] for b in piece]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        bits = size.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i, (x, y) in enumerate(zip(at, at[1:])) if (r := pairs(x * n + y, -1)) >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & low, top >> bits
            j = after[i]
            left = at[i]
            if left < 0 or j >= size or pairs(left * n + at[j]) != rank:
                continue  # one of the two has been merged meanwhile
            at[i], at[j] = rank, -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                r = pairs(rank * n + at[k])
                if r is not None:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0:
                r = pairs(at[h] * n + rank)
                if r is not None:
                    heappush(heap, r << bits | h)
        return [x for x in at if x >= 0]

    def encode_part(self, part: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of text that is split by the pattern alone."""
        out: list[int] = []
        for token in self.split(part):
            raw = token.encode("utf-8", "surrogatepass")
            i = self.whole.get(raw)
            out += [i] if i >= 0 else self.merge(raw)
        return pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed.

        A space that no white space follows starts a pre-token, so the text is
        cut before each space and the parts are encoded on their own, most of
        them from the memo; text with a space before white space or at its end
        is split as a whole.
        """
        if not text:
            return b""
        if len(self.memo) > self.most:
            self.memo.clear()
        head, *parts = text.split(" ")
        try:
            return self.encode_part(head) + b"".join(map(self.memo.__getitem__, parts))
        except _SpaceBeforeSpace:
            return self.encode_part(text)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[str, Codec] = keeping({})


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; the file is part of the installation on every machine."""
    key = f"{path}\0{pattern}"
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(path), pattern)
    return _codecs[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column `ids` (binary, little-endian unsigned 32-bit); all other columns stay.

    Null text gives no ids.  A map over the scan: no shuffle, memory bounded by
    one Arrow batch and the memo.
    """
    own_path, own_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own_path, pattern or own_pattern

    @F.pandas_udf("binary")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for batch in column:
            yield pd.Series([c.encode(x) if x is not None else b"" for x in batch], dtype=object)

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the bytes that packed ids stand for; null ids give no bytes."""
    own_path, own_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own_path, pattern or own_pattern

    @F.pandas_udf("binary")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for batch in column:
            yield pd.Series([c.decode(x) if x is not None else b"" for x in batch], dtype=object)

    return docs.withColumn(out, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode, decode and digest in one pass over the scan.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, same (the decoded
    bytes are the text's) and, if asked for, the packed ids.
    """
    own_path, own_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own_path, pattern or own_pattern
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, a, b, same, packed = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = c.encode(text)
                back = c.decode(ids)
                n.append(len(ids) // 4)
                a.append(sha(ids))
                b.append(sha(back))
                same.append(back == text.encode("utf-8", "surrogatepass"))
                if keep_ids:
                    packed.append(ids)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string()), "same": pa.array(same, pa.bool_())}
            if keep_ids:
                columns["ids"] = pa.array(packed, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents through the codec and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_bpe": op7_bpe}
