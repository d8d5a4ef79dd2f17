"""Exact deduplication by two passes over a Bloom filter of text hashes.

Pass one sets two cells per row in a filter of bounded size and keeps the
cells that were set more than once.  Pass two tests every row against that
filter: a row with a cell that was set once has no copy and passes straight
through; only the others are shuffled and compared by the SHA-256 of their
normalised text.  The filter never decides that two rows are equal, so a full
filter costs shuffle, not rows.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest doc_id stays (a null doc_id is smaller
than any other; of rows that repeat a doc_id all count, and one stays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._session import BROADCAST, kept, unpacked, with_group, with_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most cells of the filter, whatever the input: 2 ** 27 cells are at most 2 ** 21 words of 64, 32 MB, to broadcast.
MOST_CELLS = 1 << 27


def normalised(text: str | Column = "text") -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def _cells(key: Column, cells: int) -> list[Column]:
    """Two cells of a row, from a hash of its key."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(cells)) for i in (1, 2)]


def repeated_cells(keys: DataFrame, key: str, cells: int) -> DataFrame:
    """Pass one: (word, bits) of the filter's cells that rows set more than once."""
    each = keys.select(F.explode(F.array(*_cells(F.col(key), cells))).alias("cell"))
    again = each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    return again.groupBy(F.floor(F.col("cell") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def possibly_repeated(rows: DataFrame, key: str, most_cells: int = MOST_CELLS, flag: str = "_again") -> DataFrame:
    """Pass two: `rows` with a boolean that is false only for rows whose key no other row has."""
    n = rows.count()
    cells = 1 << min(max((16 * n).bit_length(), 12), most_cells.bit_length() - 1)
    words = F.broadcast(kept(repeated_cells(rows.select(key), key, cells)))
    out = rows
    for i, cell in enumerate(_cells(F.col(key), cells)):
        out = out.withColumn(f"_cell{i}", cell)
        out = out.join(words.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}")), F.floor(F.col(f"_cell{i}") / 64).cast("long") == F.col(f"_word{i}"), "left")
    hit = [F.coalesce(F.expr(f"getbit(_bits{i}, cast(_cell{i} % 64 as int))"), F.lit(0)) == 1 for i in (0, 1)]
    return out.withColumn(flag, hit[0] & hit[1]).drop(*(f"_{x}{i}" for x in ("cell", "word", "bits") for i in (0, 1)))


def groups(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The signatures (doc_id and digest) are written once to the checkpoint
    folder, so the texts are read once for both passes.
    """
    rows = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))
    marked = possibly_repeated(rows, "text_sha256", most_cells)
    lone = marked.where(~F.col("_again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = kept(marked.where("_again").drop("_again"))
    first = kept(again.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_top"), F.count("*").alias("group_size")))
    compared = with_group(again, first, "text_sha256", "group_size").select("doc_id", F.col("_top.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_top._row")).alias("kept"), "text_sha256")
    return lone.unionByName(compared)


def survivors(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns (whatever their names).

    Of equal texts with one doc_id a digest of the raw text and the other
    columns decides, so the row that stays doesn't follow the order of the input.
    Digests are written next to the rows once; the passes read only them.  The
    losers' keys are taken away from the rows where these are; more keys than a
    join broadcasts meet only the rows that may be repeated.
    """
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    tie = F.sha2(F.concat_ws("/", F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull().cast("string"), F.to_json(F.struct(*others))), 256)
    rows = with_rows(docs, _id=F.col("doc_id").cast("long"), _sha=F.sha2(normalised(), 256), _tie=tie)
    marked = possibly_repeated(rows, "_sha", most_cells)
    again = kept(marked.where("_again").select("_row", "_id", "_sha", "_tie"))
    best = kept(again.groupBy("_sha").agg(F.max(F.struct("_id", "_tie", "_row")).alias("_top"), F.count("*").alias("_size")))
    gone = kept(with_group(again, best, "_sha", "_size").where("_row <> _top._row").select("_row"))
    if gone.count() <= BROADCAST:
        return unpacked(rows.join(F.broadcast(gone), "_row", "left_anti"), docs)
    return unpacked(marked.where(~F.col("_again")).select("_all").unionByName(marked.where("_again").join(gone, "_row", "left_anti").select("_all")), docs)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays for it."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

ORACLES = {
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """
}
