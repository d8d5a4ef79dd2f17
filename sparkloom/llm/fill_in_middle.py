"""Fill-in-the-middle documents over texts in seekable compressed frames.

A text is stored as independent zstandard frames of whole tokens, each with the
counts of tokens, code points and bytes before it.  A cut at a token is found
by a binary search in those counts, and only the frames that hold cuts are
decompressed to place it.  What is written, and the text that is rebuilt from
it, go into their digests as a stream of ordered frames, one decompressed at a
time.

A token is ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`` or a run of whitespace at
the end.  Null text is empty and has no tokens; a null doc_id counts as the
empty string where cuts are drawn.  Rows are transformed one by one, so ties,
repeated rows and an empty table need no rule, and columns of other names are
not looked at.  A text of any length is transformed whole; a frame ends at the
first token end after FRAME_BYTES, so it outgrows that by one token at most.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Where a token ends and another begins.
EDGE = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Share of documents (in a hundred) that are cut, and of those the share written suffix first.
CUT, SUFFIX_FIRST = 50, 80
SEED = 42
#: Bytes after which a frame ends, and how hard it is compressed.
FRAME_BYTES, LEVEL = 1 << 16, 1
_packer, _unpacker = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

STORE = "doc_id long, n long, marked boolean, frames array<struct<units: long, chars: long, bytes: long, data: binary>>"
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
OUTPUT = ", output array<struct<units: long, chars: long, bytes: long, data: binary>>"
_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))
_STORE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("frames", _FRAMES)])
_FORMS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


@dataclass
class Frames:
    """A text as compressed frames.  `units`, `chars` and `bytes` have the counts before each frame, and the totals last."""

    data: list[bytes] = field(default_factory=list)
    units: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    bytes: list[int] = field(default_factory=lambda: [0])

    def add(self, piece: str, units: int) -> None:
        raw = piece.encode("utf-8", "surrogatepass")
        self.data.append(_packer.compress(raw))
        self.units.append(self.units[-1] + units)
        self.chars.append(self.chars[-1] + len(piece))
        self.bytes.append(self.bytes[-1] + len(raw))

    def frame(self, i: int) -> bytes:
        return _unpacker.decompress(self.data[i])

    def place(self, unit: int) -> tuple[int, int]:
        """Code points and bytes before the token number `unit`; one frame is read, none at a frame's edge."""
        i = bisect.bisect_right(self.units, unit) - 1
        if self.units[i] == unit:
            return self.chars[i], self.bytes[i]
        text = self.frame(i).decode("utf-8", "surrogatepass")
        end = sum(map(len, TOKEN.findall(text)[: unit - self.units[i]]))
        return self.chars[i] + end, self.bytes[i] + len(text[:end].encode("utf-8", "surrogatepass"))

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from `start` to `end`, a frame at a time."""
        i = max(0, bisect.bisect_right(self.bytes, start) - 1)
        while start < end:
            piece = self.frame(i)[start - self.bytes[i] : end - self.bytes[i]]
            yield piece
            start += len(piece)
            i += 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """Where `mark` begins first, also across the edges of frames; -1 where it is not."""
        held, at = b"", start
        for piece in self.read(start, self.bytes[-1]):
            held += piece
            k = held.find(mark)
            if k >= 0:
                return at + k
            keep = min(len(mark) - 1, len(held))
            at += len(held) - keep
            held = held[len(held) - keep :]
        return -1

    def rows(self) -> list[dict]:
        each = zip(self.data, self.units[1:], self.units, self.chars[1:], self.chars, self.bytes[1:], self.bytes)
        return [{"units": u - v, "chars": c - d, "bytes": b - e, "data": x} for x, u, v, c, d, b, e in each]

    @classmethod
    def of(cls, rows: list[dict] | None) -> Frames:
        out = cls()
        for row in rows or []:
            out.data.append(row["data"])
            out.units.append(out.units[-1] + row["units"])
            out.chars.append(out.chars[-1] + row["chars"])
            out.bytes.append(out.bytes[-1] + row["bytes"])
        return out


def framed(text: str, size: int = FRAME_BYTES) -> Frames:
    """Frames of whole tokens, each ended by the first token that reaches `size` code points."""
    out, begin = Frames(), 0
    while begin < len(text):
        edge = EDGE.search(text, begin + size)
        end = edge.start() if edge else len(text)
        piece = text[begin:end]
        out.add(piece, len(TOKEN.findall(piece)))
        begin = end
    return out


def stream_framed(pieces: Iterator[bytes], size: int = FRAME_BYTES) -> Frames:
    """Frames of a stream of bytes, which need not end at tokens: their units and code points are not counted."""
    out, held = Frames(), bytearray()

    def flush(part: bytes) -> None:
        out.data.append(_packer.compress(part))
        out.units.append(out.units[-1])
        out.chars.append(out.chars[-1])
        out.bytes.append(out.bytes[-1] + len(part))

    for piece in pieces:
        held += piece
        if len(held) >= size:
            flush(bytes(held))
            held.clear()
    if held:
        flush(bytes(held))
    return out


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers from the digest of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: Frames, marked: bool, doc_id: int | None, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, Iterator[bytes]]:
    """Form, code points of prefix and middle (None if plain), and what is written, as a stream."""
    n, total = text.units[-1], text.bytes[-1]
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or marked or h3 % 100 >= cut:
        return "plain", None, None, text.read(0, total)
    (a, first), (b, second) = (text.place(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < suffix_first else "psm"
    parts = {PREFIX: (0, first), SUFFIX: (second, total), MIDDLE: (first, second)}

    def written() -> Iterator[bytes]:
        for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
            yield mark.encode()
            yield from text.read(*parts[mark])

    return form, a, b - a, written()


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text, rebuilt from what was written and its form alone."""
    total = output.bytes[-1]
    if form == "plain":
        yield from output.read(0, total)
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    second = output.find(order[1].encode())
    third = output.find(order[2].encode(), second)
    ends = {order[0]: (3, second), order[1]: (second + 3, third), order[2]: (third + 3, total)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(*ends[mark])


def _digest(pieces: Iterator[bytes]) -> str:
    sha = hashlib.sha256()
    for piece in pieces:
        sha.update(piece)
    return sha.hexdigest()


def store(docs: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, marked, frames): each text as compressed frames, its tokens counted, and whether it holds a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in ((batch.column(0)[k : k + 64], batch.column(1)[k : k + 64]) for k in range(0, len(batch), 64)):
                rows = []
                for i, value in zip(ids.to_pylist(), texts):
                    text = value.as_py() or ""
                    own = framed(text, size)
                    rows.append({"doc_id": i, "n": own.units[-1], "marked": any(m in text for m in (PREFIX, SUFFIX, MIDDLE)), "frames": own.rows()})
                yield pa.RecordBatch.from_pylist(rows, _STORE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORE)


def fill_in_middle(stored: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, keep_output: bool = False, size: int = FRAME_BYTES) -> DataFrame:
    """What a store() becomes: doc_id, n, form, prefix_chars, middle_chars, digests of the output and of the text rebuilt from it; the output's frames if asked for."""
    schema = _FORMS.append(pa.field("output", _FRAMES)) if keep_output else _FORMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                rows = []
                for row in batch.slice(k, 64).to_pylist():
                    text = Frames.of(row["frames"])
                    form, prefix, middle, pieces = transformed(text, row["marked"], row["doc_id"], seed, cut, suffix_first)
                    output = stream_framed(pieces, size)
                    values = (row["doc_id"], row["n"], form, prefix, middle, _digest(output.read(0, output.bytes[-1])), _digest(restored(output, form)))
                    rows.append(dict(zip(_FORMS.names, values)) | ({"output": output.rows()} if keep_output else {}))
                yield pa.RecordBatch.from_pylist(rows, schema)

    return stored.mapInArrow(run, FORMS + OUTPUT * keep_output)


def texts(outputs: DataFrame, column: str = "output") -> DataFrame:
    """`outputs` with the frames of a column put together to a string again."""

    @F.udf("string")
    def whole(frames):
        own = Frames.of([f.asDict() for f in frames])
        return b"".join(own.read(0, own.bytes[-1])).decode("utf-8", "surrogatepass")

    return outputs.withColumn(column, whole(F.col(column)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, cut, written and rebuilt."""
    return fill_in_middle(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

ORACLES = {
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                          regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents),
        e AS (SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
                     CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                          WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
        g AS (SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM f)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM g
    """
}
