"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased; every other ASCII character
but digits and letters separates), each benchmark item gives its windows of 10
consecutive words (an item of fewer words is one window), and an automaton
over all windows scans each document once.  Hits are mapped back to words and
to byte offsets of the original text.

Nulls and texts without words have no words and are never contaminated; an
item without words gives no window; windows that several items share count for
each of them.  Items with a null item_id are one null, listed last.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._session import kept

WINDOW = 10
#: Bytes of window text that one automaton may hold; a larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 8 << 20

#: Lower-cases A-Z and turns every ASCII separator into a space, byte by byte, so offsets stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> tuple[bytes, list[bytes]]:
    """The normalised bytes (same length as the text's) and their words."""
    flat = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return flat, flat.split()


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    _, words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automata(items: list[tuple[str | None, str | None]], size: int = WINDOW, most: int = AUTOMATON_BYTES) -> list[list[tuple[str, str | None]]]:
    """(window, item) pairs in lists of bounded size, one per automaton."""
    out: list[list[tuple[str, str | None]]] = [[]]
    held = 0
    for item, text in items:
        own = [(w.decode("latin-1"), item) for w in dict.fromkeys(windows_of(text, size))]
        weight = sum(len(w) for w, _ in own)
        if held and held + weight > most:
            out.append([])
            held = 0
        out[-1] += own
        held += weight
    return [x for x in out if x]


def build(pairs: list[tuple[str, str | None]]) -> ahocorasick.Automaton:
    """Automaton over ' window ' strings; a value is (words, length, items)."""
    found: dict[str, list[str | None]] = {}
    for window, item in pairs:
        found.setdefault(window, []).append(item)
    automaton = ahocorasick.Automaton()
    for window, items in found.items():
        automaton.add_word(f" {window} ", (window.count(" ") + 1, len(window) + 2, items))
    automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
    """Which words lie in a window's occurrence, and the items whose windows occur."""
    hit = np.zeros(len(words) + 1, np.int32)
    items: set[str | None] = set()
    line = f" {b' '.join(words).decode('latin-1')} "
    ends = None
    for end, (n, _, own) in automaton.iter(line):
        if ends is None:  # the end of word i in the line is ends[i]
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = int(np.searchsorted(ends, end))
        hit[last - n + 1] += 1
        hit[last + 1] -= 1
        items.update(own)
    return np.cumsum(hit[:-1]) > 0, items


def spans_of(flat: bytes, words: list[bytes], hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges [start, end) of the original text, one per run of hit words."""
    out: list[tuple[int, int]] = []
    at, previous = 0, False
    for word, h in zip(words, hit.tolist()):
        start = flat.index(word, at)
        at = start + len(word)
        if h:
            if previous:
                start = out.pop()[0]
            out.append((start, at))
        previous = h
    return out


SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _scanner(pairs: list[tuple[str, str | None]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(pairs) if pairs else None
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for value in batch.column(1):
                flat, words = words_of(value.as_py())
                n_hit, items, spans = 0, [], []
                if automaton is not None and words:
                    hit, found = scan(automaton, words)
                    if found:
                        n_hit, items = int(hit.sum()), sorted(found, key=lambda x: (x is None, x or ""))
                        spans = [{"start": a, "end": b} for a, b in spans_of(flat, words, hit)]
                for column, x in zip(rows, (len(words), n_hit, items, spans)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip(rows, list(_ARROW)[1:]))], schema=_ARROW)

    return run


def items_of(benchmark: DataFrame) -> list[tuple[str | None, str | None]]:
    """(item_id, text) of all items, also of those with a null item_id."""
    return [(None if r[0] is None else str(r[0]), r[1]) for r in benchmark.select("item_id", "text").toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted), spans (original bytes).

    The benchmark, a test set, is read by the driver; its windows are dealt to
    automata of bounded size.  With one automaton the scan is a map without a
    shuffle; with more, each scans all documents, which are written once with a
    key of each row, and their hit words are united per row.
    """
    dealt = automata(items_of(benchmark), size, most) or [[]]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(dealt) == 1:
        return base.mapInArrow(_scanner(dealt[0]), SCHEMA)
    rows = kept(base.withColumn("_row", F.monotonically_increasing_id()))
    parts = [rows.select("_row", "text").mapInArrow(_scanner(pairs), SCHEMA) for pairs in dealt]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # Byte spans of different automata may overlap: they are merged before words are counted again.
    merged = union.where("n_hit > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.join(merged, "_row", "left").select("doc_id", "text", *(F.coalesce(c, F.array()).alias(c) for c in ("items", "spans"))).mapInArrow(_recount, SCHEMA)


def survivors(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of `docs` in whose text no window occurs, with all their columns; a filter without a shuffle."""
    out = docs
    for pairs in automata(items_of(benchmark), size, most):
        out = out.where(~_occurs(pairs)(F.col("text")))
    return out


def _occurs(pairs: list[tuple[str, str | None]]):
    @F.pandas_udf("boolean")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = build(pairs)
        for batch in column:
            yield pd.Series([next(automaton.iter(f" {b' '.join(words_of(x)[1]).decode('latin-1')} "), None) is not None for x in batch.tolist()], dtype=bool)

    return run


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            flat, words = words_of(row["text"])
            cover = np.zeros(len(flat) + 1, np.int32)
            for s in row["spans"]:
                cover[s["start"]] += 1
                cover[s["end"]] -= 1
            cover = np.cumsum(cover) > 0
            at, hit = 0, np.zeros(len(words), bool)
            for i, w in enumerate(words):
                start = flat.index(w, at)
                at = start + len(w)
                hit[i] = cover[start]
            spans = [{"start": a, "end": b} for a, b in spans_of(flat, words, hit)]
            out.append({"doc_id": row["doc_id"], "n_words": len(words), "n_hit": int(hit.sum()), "items": row["items"], "spans": spans})
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against every benchmark item."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op3_decontaminate": op3_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        own AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
        sizes AS (SELECT DISTINCT n FROM own),
        seen AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT d.*, sizes.n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
        hits AS (SELECT doc_id, k, n, item FROM seen JOIN own USING (n, s)),
        words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS listed FROM hits GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """
}
