"""Removal of later copies of repeated line runs, by winnowing.

A window is a run of lines as short as it may be with ``WINDOW`` lines or
``WORDS`` words: one or two long lines are a window too.  Winnowing selects the
smallest line hash of every window; of each selected line one row is made, its
fingerprint, with the windows that selected it.  Equal windows select equal
fingerprints, so positions are joined with the fingerprints that occur more
than once, their matches are extended to both sides by the windows around them,
and a window that also stands earlier (smaller doc_id, or earlier in the
document) is deleted; windows that overlap or touch make longer runs.  The
first copy stays.

Only DataFrame functions.  Minima and counts combine before they are shuffled,
and rows of a hot fingerprint or window stay where they are.

Lines end at ``\\n`` and are compared as they are; words are runs of other
characters than ASCII white space.  Null text is one empty line, as is an empty
one; a document without a window keeps all lines.  A null doc_id is larger than
any other.  Of rows that repeat a doc_id, each is a document of its own, in the
order of their texts' hashes; rows that repeat both are one document read
several times, and all of them get its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm._session import kept, with_group, written

WINDOW, WORDS = 3, 50
#: Fixed pattern: a word.
WORD = r"[^\x20\x09-\x0D]+"


def _document(text: Column) -> Column:
    """What orders documents and tells them apart."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def fingerprints(docs: DataFrame, size: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc, print, place, windows): each selected line, its hash and place, and the windows (at, lines, key) that selected it."""
    split = docs.select(_document(_text()).alias("doc"), F.split(_text(), "\n").alias("lines"))
    hashed = split.select("doc", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("counts"))

    def length(i):
        """Lines of the window at line i (from 1); 0 where the text ends before."""
        out = F.when(i + (size - 1) <= F.size("lines"), size).otherwise(0)
        for k in range(size - 1, 0, -1):
            enough = sum((F.get("counts", i + (j - 1)) for j in range(1, k)), F.get("counts", i - 1)) >= words
            out = F.when(enough, k).otherwise(out)
        return out

    lengths = hashed.select("doc", "lines", "hashes", F.transform(F.sequence(F.lit(1), F.size("lines")), length).alias("lengths"))

    def window(n, k):
        own, text = F.slice("hashes", k + 1, n), F.slice("lines", k + 1, n)
        least = F.array_min(own)
        place = k + F.array_position(own, least).cast("int") - 1
        return F.when(n > 0, F.struct(k.alias("at"), n.alias("lines"), least.alias("print"), place.alias("place"), F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)).alias("key")))

    each = lengths.select("doc", F.transform("lengths", window).alias("all"))
    # A window contains its fingerprint, so those that selected a line start at it or less than a window before.
    selected = F.filter("all", lambda w, k: w.isNotNull() & F.forall(F.array(*(F.lit(j) for j in range(1, size))), lambda j: ~F.get(F.col("all"), k - j)["place"].eqNullSafe(w["place"])))
    rows = each.select("doc", "all", F.explode(selected).alias("s"))
    around = F.filter(F.slice("all", F.greatest(F.col("s.place") - size + 2, F.lit(1)), size), lambda w: w["place"] == F.col("s.place"))
    return rows.select("doc", F.col("s.print").alias("print"), F.col("s.place").alias("place"), F.transform(around, lambda w: F.struct(w["at"].alias("at"), w["lines"].alias("lines"), w["key"].alias("key"))).alias("windows"))


def repeated_runs(docs: DataFrame, size: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc, spans): line ranges [start, end) of later copies, in order."""
    every = written(fingerprints(docs, size, words))
    place = F.struct("doc", "place")
    prints = kept(every.groupBy("print").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_n")).where("_first < _last").select("print", "_n"))
    around = written(with_group(every, prints, "print", "_n").select("doc", F.explode("windows").alias("w")).select("doc", "w.*"))
    position = F.struct("doc", "at")
    firsts = kept(around.groupBy("key").agg(F.min(position).alias("_first"), F.max(position).alias("_last"), F.count("*").alias("_n")).where("_first < _last").drop("_last"))
    later = with_group(around, firsts, "key", "_n").where(position > F.col("_first")).select("doc", "at", (F.col("at") + F.col("lines")).alias("end")).distinct()
    own = Window.partitionBy("doc").orderBy("at")
    begins = later.withColumn("_new", F.when(F.col("at") > F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)), 1).otherwise(0))
    islands = begins.withColumn("_run", F.sum("_new").over(own)).groupBy("doc", "_run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def without_repeats(docs: DataFrame, size: int = WINDOW, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text (remaining lines), spans (removed line ranges), n_lines."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _document(_text()).alias("doc"), _text().alias("text"))
    found = base.join(repeated_runs(docs, size, words), "doc", "left").withColumn("_lines", F.split("text", "\n"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.coalesce("spans", none)
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.size("_lines")))
    rest = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, b - a)))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return found.select("doc_id", text.alias("text"), spans.alias("spans"), F.size("_lines").alias("n_lines"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later copies of runs of three or more lines, or of fewer with 50 or more words."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}

ORACLES = {
    "op5_line_dedup": """
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
        l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM s),
        n AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
        w AS (SELECT doc_id, i, line, words, lead(line, 1) OVER d AS line1, lead(line, 2) OVER d AS line2, lead(words, 1) OVER d AS words1
              FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        k AS (SELECT *, CASE WHEN words >= 50 THEN 1 WHEN words + words1 >= 50 THEN 2 WHEN line2 IS NOT NULL THEN 3 ELSE 0 END AS k FROM w),
        f AS (SELECT doc_id, i, line, CASE WHEN row_number() OVER (
                     PARTITION BY k, line, CASE WHEN k > 1 THEN line1 END, CASE WHEN k > 2 THEN line2 END ORDER BY doc_id, i) > 1 THEN k ELSE 0 END AS later FROM k),
        c AS (SELECT doc_id, i, line, later > 0 OR coalesce(lag(later, 1) OVER d, 0) > 1
                     OR coalesce(lag(later, 2) OVER d, 0) > 2 AS gone FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, i, line, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               count(*) FILTER (WHERE starts) AS n_spans,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id
    """
}
