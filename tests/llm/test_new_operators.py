"""Personal data, hard negatives and fill-in-the-middle against brute force and round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import fill_in_middle, hard_negatives, pii

# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if passes(k, m.group())]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def written_numbers(n, seed=5):
    """Texts with plain spans between words, and numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8)))
    out = []
    for _ in range(n):
        while True:
            card = "".join(rng.choice("0123456789") for _ in range(16))
            if passes("card", card):
                break
        spans = [f"{word()}.{rng.randint(1, 99)}@{word()}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, f"+{rng.randint(1, 9)} ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", str(rng.randint(10**15, 10**16 - 1))]
        rng.shuffle(spans)
        out.append(" ".join(f"{word()} {word()} {s} {word()}." for s in spans))
    return out


EDGES = [
    None, "", "no", "a@b", "a@b.c", "a@b.c_d@e.f", "x@y.z@q.r.s", "é.a@b.c ü", "😀 me@x.org 😀 1.2.3.4", "..@a..b", "a@b.c.@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "5" * 20, "7" * 5000, "9 " * 3000, "+1 (415) 555-2671", "+1+2 345 678 901", "+ 12345678901", "+12345678", "+1(((555)))123.456.7-8-", "+1 826 555 4081 144.137.1.2", "a" * 40_000, "a." * 9000 + "@b.c", "1." * 4000,
]


def test_plain_spans_of_odd_texts(spark):
    """Where nothing is learnt, plain spans alone; digests and counts by brute force, clashing columns left alone."""
    texts = EDGES + [t * 300 for t in ("me@x.org, ", "1.2.3.4 ", "+1 (415) 555-2671 / ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"p": F.lit(1), "kind": F.lit("x"), "email": F.lit("y"), "_row": F.lit(0)})
    found = pii.searched(docs)
    rows = {r["doc_id"]: r for r in pii.report(found.select("_row", "doc_id", *pii.KINDS, F.array().cast("array<struct<kind: string, start: long, end: long>>").alias("added"))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = plain_spans(text)
        assert rows[i]["spans"] == joined(want), text
        assert rows[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]


@pytest.fixture(scope="module")
def disguised(spark):
    """Plain texts to learn from, two rows of one id, an id that is null, and texts whose spans are written otherwise."""
    plain = written_numbers(120)
    clean = [re.sub("|".join(x for x in BASE.values()), "so", t).replace("so", "and at the end. Then") for t in written_numbers(40, 9)]
    hidden = ["write to jane.doe [at] mail [dot] example [dot] com today", "mail jane.doe at mail.example.com soon", "the host 10.20.30[.]40 was up and 10[.]20[.]30[.]40 too", "card 4111.1111.1111.1111 of hers", "call (415) 555-2671 now", "call 001 (415) 555-2671 now"]
    texts = plain + clean + hidden
    ids = [*range(len(texts))]
    ids[3], ids[4] = 2, None
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumns({"s": F.lit("x"), "_all": F.lit(2)})
    return docs, texts, len(plain), len(clean), {r["_row"]: r for r in pii.detected(pii.searched(docs.coalesce(1))).collect()}


def test_disguised_spans_are_added(disguised):
    docs, texts, plain, clean, rows = disguised
    rows = [rows[i] for i in sorted(rows)]
    assert len(rows) == len(texts)
    added = [[(x["kind"], texts[i][x["start"] : x["end"]].strip()) for x in r["added"]] for i, r in enumerate(rows)]
    for i in range(plain):
        base = {(k, x["start"], x["end"]) for k in pii.KINDS for x in rows[i][k]}
        assert base == set(plain_spans(texts[i]))
    assert not any(added[plain : plain + clean])
    assert sum(map(len, added[:plain])) <= plain // 20  # numbers that are none
    hidden = added[plain + clean :]
    assert sum(map(bool, hidden)) >= 5, hidden
    assert ("email", "jane.doe at mail.example.com") in hidden[1] and ("card", "4111.1111.1111.1111") in hidden[3]


def test_spans_added_do_not_overlap(disguised):
    for r in disguised[4].values():
        every = sorted((x["start"], x["end"]) for x in r["added"])
        assert all(a[1] <= b[0] for a, b in zip(every, every[1:]))
        base = [(x["start"], x["end"]) for k in pii.KINDS for x in r[k]]
        assert not any(a < d and c < b for a, b in every for c, d in base)


def test_redacted(spark):
    texts = EDGES[:19] + written_numbers(30)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, email string")
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        if i == 18 or t is None or not plain_spans(t):
            continue
        assert rows[i]["email"] == "k"
        left = rows[i]["text"]
        assert all(t[a:b] not in left for _, a, b in plain_spans(t)) and "[" in left
    assert rows[0]["text"] is None and rows[4]["text"] == "[EMAIL]" and rows[8]["text"] == "😀 [EMAIL] 😀 [IP]"


def test_pii_of_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(pii.detected(pii.searched(empty))).count() == 0


def test_pii_runs_no_python(spark, small):
    plan = pii.op11_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Hard negatives


@pytest.mark.parametrize(("width", "top"), [(1, 1), (64, 134), (1500, 255), (100, 10**7), (40, 10**8)])
def test_exact_product(width, top):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-top, top + 1, (5, width)), rng.integers(-top, top + 1, (6, width))
    a[0], b[0], b[1] = top, top, -top
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert hard_negatives.exact_product(a, b).tolist() == want
    assert hard_negatives.exact_product(a[:, : max(1, width // 2)], b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p[: max(1, width // 2)], q)) for q in b] for p in a]


def test_scores_too_large_are_refused():
    with pytest.raises(ArithmeticError):
        hard_negatives.exact_product(np.full((1, 4), 1 << 30), np.full((1, 4), 1 << 30))


def mined_by_hand(rows, every):
    """Brute force over (vec_id, label, ints), by row."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (anchor, label, q) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        rank = lambda same: sorted(((-score(q, r), v, k) for k, (v, own, r) in enumerate(rows) if k != i and (own == label) == same))  # noqa: B023, E731
        for s, v, _ in rank(True)[:5]:
            inside = [(-t, w) for t, w, _ in rank(False) if 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(anchor, v, k, w, -s, t) for k, (t, w) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "broadcast", "held"), [(512, 1 << 25, 4_000_000), (3, 0, 20)])
def test_hard_negatives(spark, monkeypatch, anchors, broadcast, held):
    """With ties, repeated rows and ids, rows that take no part, and clashing columns; blocks and tasks of any size."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(hard_negatives, "HELD", held)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.2, 0.4, 8)]) for i in range(150)]
    rows += [(150 + i, i % 3, [0.5] * 8) for i in range(40)] + [(20, 1, rows[20][2]), (20, 1, rows[20][2]), (30, 2, rows[31][2])]
    sound = list(rows)
    rows += [(190, None, [0.1] * 8), (200, 1, None), (210, 1, [0.1, None] + [0.0] * 6), (220, 1, [float("nan")] * 8), (230, 1, [float("inf")] + [0.0] * 7), (240, 2, [float("-inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"score": F.lit(1), "block": F.lit("x"), "_row": F.lit(3)})
    got = hard_negatives.mined(hard_negatives.quantised(df.repartition(5)), every=10)
    ints = [(v, own, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in q]) for v, own, q in sound]
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined_by_hand(ints, 10)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mined(hard_negatives.quantised(empty)).count() == 0
    alone = spark.createDataFrame([(0, 1, [0.5]), (None, 1, [0.5]), (5, 2, [0.4])], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in hard_negatives.mined(hard_negatives.quantised(alone)).select("anchor_id", "positive_id", "negative_id").collect()] == [(0, None, 5)]


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_fill_in_middle"])
def test_same_as_sql(name, same):
    module = hard_negatives if "12" in name else fill_in_middle
    same(module.QUERIES[name], module.ORACLES[name])


# Fill-in-the-middle

MIDDLE_TEXTS = [None, "", " ", "\n\t ", "a", "a ", " a", "a b", "Ä  b\tc\x0bd\x0c\r\n", "x <P> y", "<S>", "<M", "< P>", "a <P b<S <M ><", "né e" * 40, "<P", "word " * 5000, "w" * 200_000, "  " * 5000 + "x", "a b c d", "😀 " * 700]


def by_hand(i, text):
    text = text or ""
    tokens = [m.group() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_fill_in_middle(spark, size):
    """Every text under several ids (one null, one repeated), in frames of any size."""
    ids = [None, *range(12), 7]
    rows = [(i if i is None else i + 100 * k, t) for k, t in enumerate(MIDDLE_TEXTS) for i in ids]
    if size < 16:
        rows = [r for r in rows if len(r[1] or "") < 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "form": F.lit(1), "frames": F.lit(2)})
    stored = fill_in_middle.store(docs, size)
    out = fill_in_middle.texts(fill_in_middle.fill_in_middle(stored, keep_output=True, size=size)).collect()
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    key = lambda r: repr(r)
    want = [(i, *by_hand(i, t)[:4], sha(by_hand(i, t)[4]), sha(t), by_hand(i, t)[4]) for i, t in rows]
    assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_cuts_read_only_their_frames(monkeypatch):
    """A cut decompresses one frame, wherever it is."""
    text = "".join(f" word{i}" for i in range(20_000))
    frames = fill_in_middle.framed(text, 1000)
    assert len(frames.data) > 100 and b"".join(frames.read(0, frames.bytes[-1])).decode() == text
    read = []
    frame = fill_in_middle.Frames.frame
    monkeypatch.setattr(fill_in_middle.Frames, "frame", lambda self, i: read.append(i) or frame(self, i))
    tokens = re.findall(r"\s*\S+", text)
    for unit in (0, 1, 777, 19_999, 20_000):
        read.clear()
        assert frames.place(unit) == (len("".join(tokens[:unit])),) * 2 and len(read) <= 1


def test_fill_in_middle_of_empty_table(spark):
    assert fill_in_middle.fill_in_middle(fill_in_middle.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# The near-copy stage where a group of texts is hard to connect


def test_texts_of_a_frequent_shingle(spark):
    """Hundreds of unlike texts and a cluster whose texts are about as similar as the limit, all with one passage: components by brute force, and few candidates."""
    from sparkloom.llm import near_copies

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(f"same{i}" for i in range(12))
    texts = [f"{passage} {' '.join(rng.choice(words) for _ in range(40))}" for _ in range(250)]
    stem = [rng.choice(words) for _ in range(120)]
    for _ in range(120):
        own = list(stem)
        for at in rng.sample(range(120), rng.choice([1, 2, 3])):
            own[at] = rng.choice(words)
        texts.append(f"{passage} {' '.join(own)}")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    for passes in (0, 3):
        got = {r["row"]: r["component"] for r in near_copies.near_copies(rows, hubs=8, passes=passes).collect()}
        assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(map(find, range(len(texts))))) > 250


def test_shingles_of_all_texts_are_counted(spark):
    """Of 24,000 texts of two shingles, one its own and one of three texts, each is found by the one of its own."""
    from sparkloom.llm import near_copies

    texts = [f"head{i // 3} a b c d tail{i}" for i in range(24_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(4)
    own = {i: set(near_copies.shingle_set(f"a b c d tail{i}").view(np.int64).tolist()) for i in range(len(texts))}
    marks = near_copies._marks(rows, 5, near_copies.LEAST).select("row", "keys").collect()
    # Cells that hashes share may change a few.
    assert len(marks) == len(texts) and sum(set(r["keys"]) == own[r["row"]] for r in marks) > 0.95 * len(texts)
    counts = near_copies._counts(rows, 5)
    assert counts.sum() == 2 * len(texts) and counts.max() < 12


def test_near_copies_let_the_codec_go(spark):
    """A worker that has encoded texts doesn't hold the codec and its memo while it looks for near copies."""
    import os

    import pyarrow as pa

    from sparkloom.llm import bpe, near_copies

    docs = spark.createDataFrame([(i, f"text of number {i} with words to remember") for i in range(2000)], "doc_id long, text string")
    held = lambda: {r["pid"]: r["n"] for r in spark.range(64).repartition(64).mapInArrow(look, "pid long, n long").collect()}

    def look(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()]), "n": pa.array([sum(len(c.memo) for c in bpe._codecs.values())])})

    assert bpe.round_trip(docs.repartition(64)).where("not same").count() == 0
    before = held()
    assert sum(before.values()) > 1000
    near_copies._marks(docs.select(F.col("doc_id").alias("_row"), "text").repartition(64), 5, near_copies.LEAST).write.format("noop").mode("overwrite").save()
    after = held()
    assert sum(after.values()) < sum(before.values()) // 2
