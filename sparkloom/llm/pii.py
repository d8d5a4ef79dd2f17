"""Personal data: formats, and boosted trees over what high-recall generators propose.

Emails, addresses of machines (ip), card and phone numbers in their plain
formats are always spans.  Beyond them, generators propose everything that
looks like one of the kinds at all: spelt-out and bracketed separators, other
groupings, numbers that may be anything.  Proposals overlap each other.
Boosted trees score each by its format and by what stands around it, a
threshold for each kind selects, and of selected spans that overlap the most
probable stay.

What the trees learn comes from the documents themselves: plain spans are
written in other ways in the place where they stand (positive), or spoilt so
that they are none (negative); proposals of the documents that aren't such
spans in disguise are negative too.  A third of the learning spans is held
out, and a kind's threshold is the least score at which a share of PRECISION
of the held-out proposals above it is right.  Where nothing can be learnt (no
plain span in all documents), only plain spans are found.

Everything is DataFrame functions: positions come from the pieces that a
pattern splits a text into, trees are column expressions.  Texts are read once;
spans and proposals are written as a table, which has no texts.

Null text is empty and has no spans; a null doc_id stays null.  Repeated rows
and ties are rows of their own, an empty table gives an empty result, columns
of other names are not looked at.  Whole texts are searched, however long, by
patterns whose time is linear in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm._session import few, packed, with_rows, written
from sparkloom.operators.compiled import Ensemble, ensemble

KINDS = ("email", "ip", "card", "phone")
#: Learning spans of each kind and negative proposals of documents (the ones whose hashes are smallest), and trees and their depth.
LEARN, NEGATIVES, TREES, DEPTH = 1500, 8000, 12, 4
#: Share of right proposals from a threshold on, and the least threshold.
PRECISION, LEAST = 0.98, 0.5
#: Characters on either side that a score looks at.
CONTEXT = 24
#: Stands in a text where a plain span was.
MASK = "￼"

# The plain formats.  Possessive repeats and what may not stand before make them linear without changing what they match.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PLAIN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# The generators.
_IN, _OUT, _WORDS = r"[\[({]", r"[\])}]", r" (?:at|AT) "
_AT, _DOT = rf"\s?(?:@|{_IN}(?:at|AT){_OUT})\s?", rf"(?:\.| \. | (?:dot|DOT) |\s?{_IN}(?:dot|DOT|\.){_OUT}\s?)"
PROPOSED = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)*+|{_WORDS}{_LABEL}++(?:{_DOT}{_LABEL}++)++)",
    "ip": r"(?i)(?<![0-9])[0-9]{1,3}(?:(?: ?\. ?|\s?[\[({](?:\.|dot)[\])}]\s?| dot |[ ,-])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+|00) ?)?\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
}
#: What a text without a proposed email lacks: one of these signs, or a bare word before a label and a dot of some kind.
SIGNS, BARE = ["@", *(f"{at}{mark}" for at in ("at", "AT") for mark in "])}")], {f" {at} ": rf" {at} {_LABEL}++{_DOT}{_LABEL}" for at in ("at", "AT")}
#: Words around a span that speak for and against it.
FOR = r"(?i)mail|contact|write|reach|phone|tel|call|fax|mobile|cell|card|visa|credit|debit|pay|server|host|addr|login|\bip\b"
AGAINST = r"(?i)order|invoice|\bref|\bno\b|\bnr\b|number|version|\bv\b|page|isbn|total|token|\bid\b|[$€£=\"]"

_SPAN = "struct<start: long, end: long, s: string, left: string, right: string>"
#: Matches whose positions are summed in one go.
_GROUP = 256


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a right check digit."""
    own = F.lpad(digits, 19, "0")
    each = (F.substring(own, i, 1).cast("int") for i in range(1, 20))
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.pmod(reduce(lambda a, b: a + b, (x if i % 2 == 0 else doubled(x) for i, x in enumerate(each))), F.lit(10)) == 0


def _valid(kind: str, s: Column) -> Column:
    """Whether a match of a plain format counts."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: x.cast("double") <= 255)
    n = F.length(_digits(s))
    return {"email": F.lit(True), "card": n.between(13, 19) & luhn(_digits(s)), "phone": n.between(9, 15)}[kind]


def _placed(steps: Column) -> Column:
    """Spans of (gap, n, s, left, right), in order, by running sums of gap + n; sums over groups come first, so time is linear."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _GROUP).cast("int")), lambda g: F.slice(steps, g * _GROUP + 1, F.lit(_GROUP)))
    zero = F.lit(0).cast("long")
    length = lambda group: F.aggregate(group, zero, lambda a, x: a + x["gap"] + x["n"])
    starts = F.aggregate(groups, F.array(zero), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + length(g))))

    def within(group: Column, i: Column) -> Column:
        begin = F.struct(F.get(starts, i).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        span = lambda a, x: F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["s"], x["left"], x["right"])
        step = lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(span(a, x))).alias("out"))
        return F.aggregate(group, begin, step, lambda a: a["out"])

    return F.flatten(F.transform(groups, within))


def with_matches(df: DataFrame, out: str, text: str, pattern: str, where: Column | None = None) -> DataFrame:
    """`df` with `out`: leftmost matches that don't overlap, as spans with up to CONTEXT characters of the text between them and their neighbours.

    Only rows `where` holds are searched.  `out`_m and `out`_g have the matches
    and the pieces between them.
    """
    m, g = f"{out}_m", f"{out}_g"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(m, found if where is None else F.when(where, found).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)))
    piece = lambda i: F.get(F.col(g), i)
    steps = F.transform(m, lambda s, i: F.struct(F.length(piece(i)).alias("gap"), F.length(s).alias("n"), s.alias("s"), F.right(piece(i), F.lit(CONTEXT)).alias("left"), F.left(piece(i + 1), F.lit(CONTEXT)).alias("right")))
    df = df.withColumn(f"{out}_s", steps)
    return df.withColumn(out, F.when(F.size(m) > 0, _placed(F.col(f"{out}_s"))).otherwise(F.array().cast(f"array<{_SPAN}>"))).drop(f"{out}_s")


def _masked(m: str, g: str, kind: str) -> Column:
    """The text of pieces and matches, valid matches masked."""
    cover = lambda x: F.when(_valid(kind, x), F.repeat(F.lit(MASK), F.length(x))).otherwise(x)
    return F.array_join(F.zip_with(g, m, lambda a, b: F.concat(a, F.coalesce(cover(b), F.lit("")))), "")


def _with_signs(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with cheap tests that most texts fail: whether there is a digit, or what an email may have."""
    sign = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in SIGNS))
    bare = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) & F.rlike(text, F.lit(pattern)) for x, pattern in BARE.items()))
    return docs.withColumns({"_number": F.rlike(text, F.lit("[0-9]")), "_mail": sign | bare})


def plain(docs: DataFrame, text: str = "_text") -> DataFrame:
    """`docs` with a column of valid plain spans for each kind."""
    docs = _with_signs(docs, text)
    signs = {"email": F.contains(text, F.lit("@")), "phone": F.col("_number") & F.contains(text, F.lit("+"))}
    for kind in KINDS:
        docs = with_matches(docs, kind, text, PLAIN[kind], signs.get(kind, F.col("_number"))).drop(f"{kind}_m", f"{kind}_g")
        docs = docs.withColumn(kind, F.filter(kind, lambda x: _valid(kind, x["s"])))
    return docs


def proposals(docs: DataFrame, text: str = "_text") -> DataFrame:
    """`docs` with `proposed`: what the generators find, with its kind; spans of different kinds may overlap."""
    docs = _with_signs(docs, text)
    for kind in KINDS:
        docs = with_matches(docs, f"_{kind}", text, PROPOSED[kind], F.col("_mail" if kind == "email" else "_number")).drop(f"_{kind}_m", f"_{kind}_g")
    named = lambda kind: F.transform(f"_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), x["left"].alias("left"), x["right"].alias("right")))
    return docs.withColumn("proposed", F.concat(*map(named, KINDS))).drop("_number", "_mail", *(f"_{kind}" for kind in KINDS))


def searched(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(_row, doc_id, email, ip, card, phone, proposed), written once: plain spans, and proposals where no plain span is.

    `row` is a key of the rows; without one, they are numbered.
    """
    row = F.monotonically_increasing_id() if row is None else row
    own = plain(docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")))
    for kind in KINDS:
        own = with_matches(own, "_here", "_text", PLAIN[kind], F.size(kind) > 0)
        own = own.withColumn("_text", F.when(F.size("_here_m") > 0, _masked("_here_m", "_here_g", kind)).otherwise(F.col("_text"))).drop("_here", "_here_m", "_here_g")
    return written(proposals(own).select("_row", "doc_id", *KINDS, "proposed"))


FEATURES = [*(f"is_{kind}" for kind in KINDS), "chars", "digits", "groups", "longest", "shortest", "last", "spaces", "hyphens", "dots", "slashes", "commas", "brackets", "at", "at_marked", "dot_words", "labels", "tld", "tld_letters", "luhn", "plus", "zeros", "largest", "before", "after", "speaks_for", "speaks_against"]


def with_features(rows: DataFrame) -> DataFrame:
    """`rows` (kind, s, left, right) with the FEATURES as doubles."""
    s, digits = F.col("s"), _digits(F.col("s"))
    rows = rows.withColumns({"_groups": F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), "_digits": digits, "_domain": F.split(_normal_email(s), "@")})
    many = lambda characters: F.length(s) - F.length(F.regexp_replace(s, characters, ""))
    size = F.transform("_groups", lambda x: F.length(x))
    tld = F.element_at(F.split(F.element_at("_domain", -1), r"\."), -1)
    side = lambda c: F.when(F.length(c) == 0, 0).when(F.rlike(c, F.lit(r"\s")), 1).when(F.rlike(c, F.lit("[A-Za-z]")), 2).when(F.rlike(c, F.lit("[0-9]")), 3).otherwise(4)
    around = F.concat_ws(" ", "left", "right")
    values = {f"is_{kind}": F.col("kind") == kind for kind in KINDS} | {
        "chars": F.length(s), "digits": F.length("_digits"), "groups": F.size("_groups"), "longest": F.array_max(size), "shortest": F.array_min(size), "last": F.length(F.get("_groups", F.size("_groups") - 1)),
        "spaces": many(r"\s"), "hyphens": many("-"), "dots": many(r"\."), "slashes": many("[/_]"), "commas": many(","), "brackets": many(r"[\[\](){}]"),
        "at": F.contains(s, F.lit("@")), "at_marked": F.rlike(s, F.lit(r"(?i)[\[({]at[\])}]")), "dot_words": F.rlike(s, F.lit(r"(?i) dot |[\[({](?:dot|\.)[\])}]")),
        "labels": F.size(F.split(F.element_at("_domain", -1), r"\.")), "tld": F.length(tld), "tld_letters": F.rlike(tld, F.lit("^[A-Za-z]{2,6}$")),
        "luhn": F.length("_digits").between(12, 19) & luhn(F.col("_digits")), "plus": F.startswith(s, F.lit("+")), "zeros": F.startswith(s, F.lit("00")),
        "largest": F.array_max(F.transform("_groups", lambda x: F.least(x.cast("double"), F.lit(1e6)))),
        "before": side(F.right("left", F.lit(1))), "after": side(F.left("right", F.lit(1))), "speaks_for": F.rlike(around, F.lit(FOR)), "speaks_against": F.rlike(around, F.lit(AGAINST)),
    }
    return rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}).drop("_groups", "_digits", "_domain")


def _normal_email(s: Column) -> Column:
    own = F.regexp_replace(F.lower(s), rf"{_AT}|{_WORDS}", "@")
    return F.regexp_replace(own, _DOT, ".")


def _normal(s: Column) -> dict[str, Column]:
    """What two ways of writing one span have in common, by kind."""
    return {"email": _normal_email(s), "ip": F.array_join(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), "."), "card": _digits(s), "phone": _digits(s)}


def _by_kind(values: dict[str, Column]) -> Column:
    return reduce(lambda out, k: out.when(F.col("kind") == k, values[k]), KINDS[1:], F.when(F.col("kind") == KINDS[0], values[KINDS[0]]))


def _variants() -> dict[str, list[tuple[Column, bool]]]:
    """Other ways to write the plain span `s` of a kind (true), and ways that spoil it (false)."""
    s, digits = F.col("s"), _digits(F.col("s"))
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    spelt = lambda dot: F.replace(domain, F.lit("."), F.lit(dot))
    dotted = lambda dot: F.replace(s, F.lit("."), F.lit(dot))
    wrong = F.concat(F.left(digits, F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).cast("int") + 3, F.lit(10)).cast("string"))
    fours = lambda d, mark: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{mark}")
    number = F.substring(s, 2, 99)
    return {
        "email": [(F.concat(local, F.lit(" at "), spelt(" dot ")), True), (F.concat(local, F.lit("[at]"), domain), True), (F.concat(local, F.lit(" (at) "), spelt(" (dot) ")), True), (F.concat(local, F.lit(" @ "), domain), True), (F.concat(local, F.lit(" at "), domain), True), (F.concat(local, F.lit("@"), spelt("")), False)],
        "ip": [(dotted("[.]"), True), (dotted(" . "), True), (dotted("(dot)"), True), (dotted(" dot "), True), (dotted(","), False), (dotted("-"), False), (dotted(" "), False), (F.concat(F.lit("9"), dotted("[.]")), False)],
        "card": [(fours(digits, "."), True), (fours(digits, "_"), True), (fours(digits, "  "), True), (fours(digits, "/"), True), (wrong, False), (fours(wrong, " "), False), (fours(wrong, "-"), False), (fours(wrong, "."), False)],
        "phone": [(F.concat(F.lit("00"), number), True), (number, True), (F.concat(F.lit("00 "), F.regexp_replace(number, "[ ().-]+", " ")), True), (F.regexp_replace(s, r"^\+[0-9]+ ?", ""), True), (F.regexp_replace(F.regexp_replace(s, r"^\+[0-9]+ ?\(?", ""), "[ ().-]+", "."), True), (digits, False), (F.concat(digits, F.lit("7")), False)],
    }


def _in_disguise(s: Column) -> dict[str, Column]:
    """Proposals of documents that may be personal data: they aren't taught as negative."""
    parts = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
    return {
        "email": F.contains(_normal_email(s), F.lit(".")),
        "ip": ~F.rlike(s, F.lit("[0-9][ ,-][0-9]")) & F.forall(parts, lambda x: x.cast("double") <= 255),
        "card": F.length(_digits(s)).between(13, 19) & luhn(_digits(s)),
        "phone": F.rlike(s, F.lit(r"^(\+|00|\()|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")) & F.length(_digits(s)).between(9, 15),
    }


def labelled(found: DataFrame, learn: int = LEARN, negatives: int = NEGATIVES) -> DataFrame:
    """(key, held, kind, s, left, right, label), written once: proposals to learn from; `held` ones are left for the thresholds.

    Of each kind's plain spans and of the documents' proposals, the ones whose
    hashes are smallest are taken, at most `learn` and `negatives`.
    """
    parts = []
    for kind, ways in _variants().items():
        spans = found.select("_row", F.explode(kind).alias("x")).select(F.xxhash64("_row", F.lit(kind), "x.start").alias("key"), "x.s", "x.left", "x.right")
        own = spans.orderBy("key", "s").limit(learn)
        written_ways = F.array(*(F.struct(c.alias("s"), F.lit(right).alias("good")) for c, right in ways))
        parts.append(own.select("key", F.lit(kind).alias("truth"), F.col("s").alias("base"), "left", "right", F.posexplode(written_ways).alias("way", "v")))
    ways = written(reduce(DataFrame.unionByName, parts).select("key", "truth", "base", "way", "v", F.concat("left", "v.s", "right").alias("_text")))
    tried = proposals(ways).select("key", "way", "truth", "base", "v.good", F.explode("proposed").alias("p")).select("key", "way", "truth", "base", "good", "p.*")
    mine, base = _by_kind(_normal(F.col("s"))), _by_kind(_normal(F.col("base")))
    tail = (F.col("kind") == "phone") & (F.length(mine) >= 9) & (F.endswith(base, mine) | (mine == F.concat(F.lit("00"), base)))
    label = F.col("good") & (F.col("kind") == F.col("truth")) & ((mine == base) | tail)
    # A proposal of the right kind that is more or less than the span says nothing; one of another kind is wrong.
    tried = tried.withColumn("label", label.cast("double")).where((F.col("label") == 1) | ~F.col("good") | (F.col("kind") != F.col("truth")))
    clean = found.select("_row", F.explode("proposed").alias("p")).select("_row", "p.*").where(~F.coalesce(_by_kind(_in_disguise(F.col("s"))), F.lit(False)))
    clean = clean.withColumn("key", F.xxhash64("_row", "kind", "start")).orderBy("key", "s").limit(negatives).withColumns({"label": F.lit(0.0), "way": F.lit(-1)})
    columns = ["key", "way", "kind", "start", "s", "left", "right", "label"]
    rows = tried.select(columns).unionByName(clean.select(columns))
    return written(rows.withColumn("held", F.pmod("key", F.lit(3)) == 0))


def learn(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> tuple[Ensemble, dict[str, float]] | None:
    """Trees and each kind's threshold (kinds without one select nothing), from labelled() rows; None if there is only one class."""
    own = with_features(rows)
    fit = own.where(~F.col("held"))
    if fit.select("label").distinct().count() < 2:
        return None
    order = ["key", "way", "kind", "start"]
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(fit.repartition(8, "key").sortWithinPartitions(*order)).select("_features", "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=42, featuresCol="_features", labelCol="label").fit(vectors)
    scores = ensemble(model, FEATURES, probability=True)
    upto = Window.partitionBy("kind").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    checked = own.where("held").withColumn("p", scores.column()).select("kind", "p", F.avg("label").over(upto).alias("right"))
    least = checked.where((F.col("right") >= precision) & (F.col("p") >= LEAST)).groupBy("kind").agg(F.min("p").alias("p")).collect()
    return scores, {r["kind"]: r["p"] for r in least}


def selected(found: DataFrame, model: tuple[Ensemble, dict[str, float]]) -> DataFrame:
    """(_row, added): proposals at or above their kind's threshold; of those that overlap, the most probable (then the first, then by kind) stay."""
    scores, thresholds = model
    enough = reduce(lambda out, k: out.when(F.col("kind") == k, F.col("p") >= thresholds.get(k, 2.0)), KINDS[1:], F.when(F.col("kind") == KINDS[0], F.col("p") >= thresholds.get(KINDS[0], 2.0)))
    each = found.where(F.size("proposed") > 0).select("_row", F.explode("proposed").alias("x")).select("_row", "x.*")
    # Written before it is filtered: a filter on p would put the trees and what they test into one condition, over and over.
    each = written(with_features(each).select("_row", "kind", "start", "end", scores.column().alias("p"))).where(enough)
    order = Window.partitionBy("_row").orderBy("start", "end", "kind")
    apart = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    each = each.withColumn("_apart", apart.cast("int")).withColumn("island", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = each.groupBy("_row", "island").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("q"), "start", "end", "kind"))).alias("x"))
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    own = F.aggregate("x", none, lambda out, y: F.when(F.exists(out, lambda z: (z["start"] < y["end"]) & (y["start"] < z["end"])), out).otherwise(F.concat(out, F.array(F.struct(y["kind"].alias("kind"), y["start"].alias("start"), y["end"].alias("end"))))))
    return ranked.select("_row", own.alias("own")).groupBy("_row").agg(F.flatten(F.collect_list("own")).alias("added"))


def detected(found: DataFrame, learn_rows: int = LEARN, negatives: int = NEGATIVES) -> DataFrame:
    """(_row, doc_id, email, ip, card, phone, added) of searched() rows: plain spans by kind, and what the trees selected beside them."""
    model = learn(labelled(found, learn_rows, negatives))
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    if model is None:
        return found.select("_row", "doc_id", *KINDS, none.alias("added"))
    more = few(selected(found, model))
    every = F.concat(*KINDS)
    beside = F.filter(F.coalesce("added", none), lambda x: ~F.exists(every, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return found.join(more, "_row", "left").select("_row", "doc_id", *KINDS, beside.alias("added"))


def _joined(spans: Column) -> Column:
    """kind:start:end of (kind number, start, end), in order."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(spans: DataFrame) -> DataFrame:
    """Counts of plain spans, and the digest and text that the contract asks for, of detected() rows."""
    numbered = lambda kind, x: F.struct(kind.cast("int").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    own = lambda i: F.transform(KINDS[i], lambda x: numbered(F.lit(i), x))
    base = F.concat(*map(own, range(len(KINDS))))
    more = F.transform("added", lambda x: numbered(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]) - 1, x))
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in KINDS)
    return spans.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, more)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs`, all columns kept, with each span of the text replaced by its kind in brackets; of spans that overlap, the one that begins first (of those the longest) goes and takes the others along."""
    rows = with_rows(docs)
    own = rows.select("_row", packed(docs, "doc_id").alias("doc_id"), packed(docs, text).alias("text"))
    spans = detected(searched(own, F.col("_row")))
    turned = lambda x, kind: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), kind.alias("kind"))
    each = lambda k: F.transform(k, lambda x: turned(x, F.lit(k)))
    every = F.concat(*map(each, KINDS), F.transform("added", lambda x: turned(x, x["kind"])))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, stop: long, mark: string>>").alias("out"))
    # Spans that overlap become one; each piece is the text before a span, and its mark.
    last = lambda a: F.element_at(a["out"], -1)
    joined = lambda a, x: F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["stop"], -x["back"]).alias("stop"), last(a)["mark"].alias("mark"))))
    added = lambda a, x: F.concat(a["out"], F.array(F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("mark"))))
    apart = F.aggregate(F.sort_array(every), zero, lambda a, x: F.struct(F.greatest(a["at"], -x["back"]).alias("at"), F.when((F.size(a["out"]) > 0) & (x["start"] < a["at"]), joined(a, x)).otherwise(added(a, x)).alias("out")), lambda a: a["out"])
    marks = spans.select("_row", apart.alias("_x")).where(F.size("_x") > 0)
    clean = packed(docs, text)
    before = lambda x, i: F.substr(clean, (F.coalesce(F.get("_x", i - 1)["stop"], F.lit(0)) + 1).cast("int"), (x["start"] - F.coalesce(F.get("_x", i - 1)["stop"], F.lit(0))).cast("int"))
    pieces = F.transform("_x", lambda x, i: F.concat(before(x, i), x["mark"]))
    rest = F.substr(clean, (F.element_at("_x", -1)["stop"] + 1).cast("int"))
    new = F.when(F.col("_x").isNull(), clean).otherwise(F.concat(F.array_join(pieces, ""), rest))
    out = rows.join(few(marks), "_row", "left").withColumn("_new", new)
    return out.select(*(F.col("_new").alias(c) if c == text else F.col(f"_all.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return report(detected(searched(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


QUERIES = {"op11_pii": op11_pii}
