"""Training-data operators against brute force, round trips and held-out rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, decontaminate, exact_dedup, line_dedup, near_copies, pitman_yor, registry, sharding, simhash, suffix_dedup, toxicity
from sparkloom.llm._graph import components


def frame(spark, texts, extra=True):
    """documents with nulls, ties and a column whose name clashes with the operators' own."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"kept": F.lit("x"), "_sha": F.lit(1), "Score": F.lit(2.0)}) if extra else df


ODD = [None, "", " ", "\n\n\n", "a", "A", "a", "The cat sat on the mat and the dog sat too.", "the CAT sat on the mat and the dog sat too.", "é" * 300, "x " * 400, "ein\nzwei\ndrei\nvier", "null\nein\nzwei\ndrei\nvier\nfünf", "word" * 30_000]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


# 1


def remaining(docs, length):
    first = {}
    for i, t in sorted(docs.items()):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in docs.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out[i] = bytes(c for c, g in zip(t, gone) if not g)
    return out


@pytest.mark.parametrize(("length", "gram", "chunk"), [(50, 20, 3000), (12, 5, 1 << 20)])
def test_suffix_dedup(spark, length, gram, chunk):
    rng = random.Random(3)
    texts = ["word" * 200, "word" * 300, None, ""]
    for i in range(40):
        t = "".join(rng.choice("abé ") for _ in range(rng.choice([3, 49, 50, 51, 200, 400])))
        if i > 5 and rng.random() < 0.6:
            s = rng.choice(texts[4:])
            a = rng.randrange(len(s) + 1)
            t = t[: len(t) // 2] + s[a : a + rng.choice([40, 50, 70, 300])] + t[len(t) // 2 :]
        texts.append(t)
    rows = suffix_dedup.repeats(frame(spark, texts), length, gram, chunk).collect()
    want = remaining({i: (t or "").encode() for i, t in enumerate(texts)}, length)
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows} == want
    for r in rows:
        gone = sum(s["end"] - s["start"] for s in r["spans"])
        assert r["n_bytes"] - gone == len(r["kept"]) and all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("length", [7, 8, 20, 50])
def test_previous_factors(length):
    """Suffix order, common prefixes and factors against all pairs."""
    rng = np.random.default_rng(length)
    for n in (1, 2, 30):
        width = length - 1 + suffix_dedup.STARTS
        rows = np.zeros((n, width + 1), np.uint8)
        for row in rows:
            row[-1] = rng.integers(1, suffix_dedup.STARTS + 1)
            row[: length - 1 + row[-1]] = rng.choice(np.frombuffer(b"a\xff", np.uint8), length - 1 + row[-1], p=[0.9, 0.1])
        doc = rng.integers(0, 9, n)
        strings = [(bytes(row[k : k + length]), d) for row, d in zip(rows, doc.tolist()) for k in range(row[-1])]
        order, documents, common = suffix_dedup.suffixes(rows, doc, length)
        assert [strings[i] for i in order] == sorted(strings) and documents.tolist() == [strings[i][1] for i in order]
        prefix = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        want = [max((prefix(s, t) for t, e in strings if e < d), default=0) for s, d in strings]
        assert suffix_dedup.previous_factors(documents, common).tolist() == [want[i] for i in order]
        assert suffix_dedup.earlier(rows, doc, length).tolist() == [w == length for w in want]


def test_suffix_dedup_rows(spark):
    """Null and repeated ids, very long and empty texts, an empty table."""
    long = "".join(random.Random(5).choices("abcdefgh ", k=300_000))
    part = long[1000:1100]
    rows = [(1, part), (1, part), (None, part + "x"), (None, part + "y"), (0, long), (2, None), (3, "short"), (4, part[:49])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_chunk", F.lit(0))
    for chunk in (1 << 22, 200):
        got = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in suffix_dedup.repeats(docs, chunk_bytes=chunk).collect())
        assert got == sorted([("1", b""), ("1", b""), ("None", b"x"), ("None", b"y"), ("0", long.encode()), ("2", b""), ("3", b"short"), ("4", part[:49].encode())])
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


# 2


def test_chat_tree(spark):
    rows = [("r", None, "user", "q", 1.0), ("a", "r", "assistant", "one </s>", 2.0), ("b", "r", "assistant", None, 3.0), ("c", "a", "user", "\\<|x|>", 9.0), ("lost", "gone", None, "t", None), ("y", "z", "u", "", 0.0), ("z", "y", "u", "", 0.0), ("w", "y", "u", "", 0.0)]
    messages = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double")
    paths = chat.branches(messages)
    assert {(r["root"], r["leaf"], tuple(r["path"]), r["score"]) for r in paths.collect()} == {("r", "c", ("r", "a", "c"), 12.0), ("r", "b", ("r", "b"), 4.0), ("lost", "lost", ("lost",), 0.0)}
    best = chat.read_back(chat.formatted(chat.chosen(paths, 1), messages)).where("root = 'r'").collect()
    assert len(best) == 1 and best[0]["leaf"] == "c" and best[0]["rank"] == 1
    assert [tuple(t) for t in best[0]["turns"]] == [("user", "q"), ("assistant", "one </s>"), ("user", "\\<|x|>")]
    assert best[0]["loss_text"] == "one </s>" and best[0]["conversation"].count("</s>") == 1 and best[0]["conversation"].count("<|") == 3


def test_chat_long_chain(spark):
    messages = spark.createDataFrame([(i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 1.0) for i in range(70)], "id long, parent long, role string, text string, score double")
    row = chat.branches(messages).collect()
    assert len(row) == 1 and row[0]["path"] == list(range(70)) and row[0]["score"] == 70
    assert chat.branches(messages.limit(0)).count() == 0


# 3


def test_decontamination(spark):
    item = "One two, three FOUR five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([("q1", item), ("q2", "Übung macht den Meister"), ("q3", None), ("q4", "?!"), ("q5", "three four five six seven eight nine ten eleven twelve")], "item_id string, text string")
    texts = [None, "", "x one-two three four five six seven eight nine ten eleven twelve y", "übung macht", "Die Übung macht den Meister heute", "one two three four five"]
    docs = frame(spark, texts)
    rows = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert [rows[i]["n_hit"] for i in range(6)] == [0, 0, 12, 0, 4, 0]  # only A-Z is lower-cased: Ü is not ü
    assert rows[2]["items"] == ["q1", "q5"] and rows[4]["items"] == ["q2"]
    raw = texts[2].encode()
    assert [raw[s["start"] : s["end"]] for s in rows[2]["spans"]] == [b"one-two three four five six seven eight nine ten eleven twelve"]
    several = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark, most=60).collect()}
    assert {i: (r["n_hit"], r["items"], r["spans"]) for i, r in several.items()} == {i: (r["n_hit"], r["items"], r["spans"]) for i, r in rows.items()}
    left = decontaminate.survivors(docs, benchmark)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in range(6) if not rows[i]["n_hit"]}
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_by_row(spark):
    """One automaton or several: null and repeated ids, and items without an id, count alike."""
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([("q1", item), (None, "red green blue"), ("q2", "green blue black"), (None, "left right")], "item_id string, text string")
    rows = [(None, "x " + item), (None, "a red green blue black z"), (5, item + " and left right"), (5, "no"), (6, "left right"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    answers = []
    for most in (1 << 20, 20):
        found = decontaminate.contamination(docs, benchmark, most=most).collect()
        answers.append(sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in found), key=repr))
        left = decontaminate.survivors(docs, benchmark, most=most).collect()
        assert sorted((r["doc_id"], r["text"]) for r in left) == [(5, "no"), (7, None)]
    assert answers[0] == answers[1]
    assert sorted(((x[0], x[1], x[2], x[3]) for x in answers[0]), key=repr) == sorted([(None, 11, 10, ["q1"]), (None, 6, 4, ["q2", None]), (5, 13, 12, ["q1", None]), (5, 1, 0, []), (6, 2, 2, [None]), (7, 0, 0, [])], key=repr)


# 4


def test_pitman_yor(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", "A a\tA"] + [" ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randrange(1, 60))) for _ in range(120)]
    docs = frame(spark, texts)
    for chunk in (None, 600):
        rows = pitman_yor.scores(docs, ~pitman_yor.held_out(), **({"chunk_bytes": chunk} if chunk else {})).collect()
        tokens = {i: (t or "").lower().encode().split() + [b"\n"] for i, t in enumerate(texts)}
        learnt = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
        count = Counter(w for i in learnt for w in tokens[i])
        n, v = sum(count.values()), len(count)
        for r in rows:
            own = tokens[r["doc_id"]]
            assert (r["learnt"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in learnt, len(own), sum(w in count for w in own), n)
            assert r["base_score"] == pytest.approx(sum(log10((count[w] + 1) / (n + v + 1)) for w in own))
            assert r["score"] < 0
    held = [r for r in rows if not r["learnt"]]
    assert sum(r["score"] for r in held) > 1.1 * sum(r["base_score"] for r in held)


def one_by_one(count, parent, fixed, discount, strength, sweeps, burn_in):
    """Average tables of the dishes of one restaurant, its customers reseated one after another."""
    rng = random.Random(5)
    tables, out = [[c] for c in count], [0] * len(count)
    for sweep in range(sweeps):
        for dish, c in enumerate(count):
            sizes = tables[dish]
            for _ in range(c):
                at = rng.choices(range(len(sizes)), sizes)[0]
                sizes[at] -= 1
                if not sizes[at]:
                    del sizes[at]
                new = (strength + discount * (fixed + sum(map(len, tables)))) * parent[dish]
                at = rng.choices(range(len(sizes) + 1), [s - discount for s in sizes] + [new])[0]
                sizes[at : at + 1] = [sizes[at] + 1] if at < len(sizes) else [1]
        if sweep >= burn_in:
            out = [o + len(t) for o, t in zip(out, tables)]
    return np.array(out) / (sweeps - burn_in)


def test_seatings_keep_customers():
    rng = np.random.default_rng(0)
    owner, count = np.array([0, 0, 1, 2, 2]), np.array([2, 50, 3, 400, 30_000])
    tables, total = pitman_yor.seatings(owner, count, np.array([0.1, 0.3, 0.01, 0.5, 0.4]), np.array([3, 0, 1]), 0.7, 0.5, rng)
    assert (tables >= 1).all() and (tables <= count).all() and (tables[3:] > 5).all()
    assert total == pytest.approx(np.array([3, 0, 1]) + np.bincount(owner, tables))
    assert pitman_yor.seatings(owner[:0], count[:0], np.zeros(0), np.array([2]), 0.7, 0.5, rng)[1].tolist() == [2]


def test_seatings_by_brute_force(monkeypatch):
    """Tables drawn at once, and by lots where EXACT is small, are those of customers who move one by one."""
    count, parent = [2, 3, 10, 40, 300], [0.1, 0.3, 0.02, 0.2, 0.1]
    want = one_by_one(count, parent, 2, 0.7, 0.5, 1200, 100)
    for exact in (pitman_yor.EXACT, 32):
        monkeypatch.setattr(pitman_yor, "EXACT", exact)
        args = np.zeros(5, int), np.array(count), np.array(parent), np.array([2]), 0.7, 0.5
        got = np.mean([pitman_yor.seatings(*args, np.random.default_rng(seed), 30, 150)[0] for seed in range(10)], axis=0)
        assert got == pytest.approx(want, rel=0.12)


# 5


def test_line_dedup_edges(spark):
    rows = {r["doc_id"]: r for r in line_dedup.without_repeats(frame(spark, ODD)).collect()}
    assert rows[12]["text"] == "null\nfünf" and [tuple(s) for s in rows[12]["spans"]] == [(1, 5)]
    assert rows[11]["text"] == ODD[11] and rows[0]["text"] == "" and rows[0]["n_lines"] == 1
    assert all(r["text"] == (ODD[i] or "") for i, r in rows.items() if not r["spans"])


def test_line_dedup_of_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(50))
    half = [" ".join(f"{c}{i}" for i in range(25)) for c in "ab"]
    short = " ".join(f"w{i}" for i in range(49))
    texts = [f"x\n{long}\ny", f"p\n{long}\nq", long, "\n".join(half), "z\n" + "\n".join(half), half[0], short, short, f"{half[0]}\nother"]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(frame(spark, texts)).collect()}
    assert rows == {0: texts[0], 1: "p\nq", 2: "", 3: texts[3], 4: "z", 5: half[0], 6: short, 7: short, 8: texts[8]}


def test_line_dedup_by_document(spark):
    """Ids that repeat are documents of their own; a null one comes last; rows that repeat both id and text share one result."""
    lines = lambda s: "\n".join(s.split())
    rows = [(0, lines("a b c d")), (1, lines("x a b c y")), (1, lines("p q r s t")), (None, lines("q r s")), (2, lines("m n o")), (2, lines("m n o")), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("spans", F.lit(2))
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.without_repeats(docs).collect())
    assert got == sorted([("0", rows[0][1]), ("1", "x\ny"), ("1", rows[2][1]), ("None", ""), ("2", rows[4][1]), ("2", rows[4][1]), ("3", "")])
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_hot_groups_stay_whole(spark, monkeypatch):
    from sparkloom.llm import _session

    monkeypatch.setattr(_session, "HOT", 3)
    texts = ["same\nthree\nlines"] * 9 + ["other"] * 5 + [f"t{i}" for i in range(6)] + [None, ""]
    docs = frame(spark, texts)
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.groups(docs).collect()}
    assert groups == {i: (8, 9) if i < 9 else (13, 5) if i < 14 else (21, 2) if i > 19 else (i, 1) for i in range(22)}
    assert {r["doc_id"]: r["n_lines"] if not r["spans"] else 0 for r in line_dedup.without_repeats(docs).collect()} == {i: 3 if i == 0 else 0 if i < 9 else 1 for i in range(22)}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {i: 0 if i < 9 else 9 if i < 14 else 20 if i > 19 else i for i in range(22)}
    shards = {r["doc_id"]: r["shard"] for r in sharding.assign(docs).collect()}
    assert len({shards[i] for i in range(9)}) == 1 and len(shards) == 22


# 6


def test_exact_dedup(spark):
    docs = frame(spark, ODD)
    rows = exact_dedup.groups(docs).collect()
    same = defaultdict(list)
    for i, t in enumerate(ODD):
        same["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    want = {i: (max(g), len(g)) for g in same.values() for i in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == want
    assert {r["doc_id"] for r in rows if r["kept"]} == {max(g) for g in same.values()}
    for cells in (1 << 12, 2):  # a full filter only costs shuffle
        left = exact_dedup.survivors(docs, cells)
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {max(g) for g in same.values()}
    assert exact_dedup.groups(docs.limit(0)).count() == 0
    again = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert exact_dedup.groups(again).where("kept").count() == len(same) == exact_dedup.survivors(again).count()


# 7


def test_bpe_as_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    tokens = bpe.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = bpe.codec(path, pattern)
    rng = random.Random(7)
    alphabet = " \n\t\r  aAbBzé1٣Ⅷ'sll!?中  ſ<|>"
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
    docs = frame(spark, ODD)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back) and len(back) == len(ODD)


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(5000)) and table.n == 5000
    assert all(table.get(k + b"x") == -1 for k in keys) and bpe.PerfectHash([]).get(b"") == -1


# 8


def linked(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= near:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("tile", [8, 9, 4096])
def test_near_links(spark, tile):
    rng = random.Random(8)
    values = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        values += [centre ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(4))) for _ in range(30)]
    values = sorted(set(values))
    rng.shuffle(values)
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "fp long, doc_id long")
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(nodes, len(rows), tile=tile)).collect()}
    want = linked(values, 4)
    assert [roots.get(i, i) for i in range(len(values))] == want


@pytest.mark.parametrize("most", [1, 7, 60, 200_000])
def test_components(spark, most):
    rng = random.Random(3)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(n, n + 1) for n in range(100, 140)] + [(200, n) for n in range(180, 230)] + [(5, None), (None, None), (95, 95)]
    root = {n: n for pair in links if None not in pair and pair[0] != pair[1] for n in pair}
    for _ in root:
        for a, b in links:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert sorted(map(tuple, components(edges, most).collect())) == sorted(root.items())
    assert components(edges.limit(0), most).count() == 0


def test_block_masks():
    for n in (1, 10**4, 10**7, 10**10):
        masks = simhash.block_masks(n)
        rng = random.Random(n)
        for _ in range(200):
            flipped = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flipped & m for m in masks)


def test_simhash_edges(spark):
    docs = frame(spark, ODD)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[0]["fp"] == 0 and {rows[i]["component_id"] for i in range(4)} == {0}
    assert rows[5]["component_id"] == rows[6]["component_id"] == 4 and rows[8]["component_id"] == 7
    assert simhash.survivors(docs).columns == docs.columns
    assert {r["doc_id"] for r in simhash.survivors(docs).collect()} == {r["component_id"] for r in rows.values()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_keeps_one_row_of_a_component(spark):
    """Ids that are null or repeated don't decide for other rows."""
    a, b = "a b c d e f", "u v w x y z"
    rows = [(1, a), (2, a), (2, b), (1, a), (None, a), (None, "null null only here"), (None, "NULL null only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for left in (simhash.survivors(docs), near_copies.survivors(docs)):
        found = left.collect()
        assert sorted((str(r["doc_id"]), r["text"].lower()) for r in found) == [("1", a), ("2", b), ("None", "null null only here")]


def test_near_copies_as_brute_force(spark):
    """The stage against all pairs at 0.8, most of them further than 4 bits apart."""
    import corpus_pipeline

    rng = random.Random(11)
    texts = [None, "", "one two", "ONE  two", "one two three"]
    shared = " ".join(f"s{i}" for i in range(12))
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(5):
            own = list(words)
            for i in rng.sample(range(len(own)), rng.randrange(1 + len(own) // 30)):
                own[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own) + rng.choice(["", " " + shared]))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    far = [(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() for i, j in pairs]
    assert sum(x > 4 for x in far) > 20
    docs = frame(spark, texts)
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(root))
    # Keys dealt in tiles, and components compared pair by pair.
    rows = docs.select(F.col("doc_id").alias("_row"), "text")
    for tile, whole, hubs in ((3, 1 << 20, 64), (4096, 150, 2), (5, 1, 3)):
        assert {r["row"]: r["component"] for r in near_copies.near_copies(rows, tile=tile, whole=whole, hubs=hubs).collect()} == dict(enumerate(root))


# 9


def test_schedule_is_longest_first():
    rng = random.Random(9)
    groups = sorted((rng.choice([1, 1, 2, 7, 50, 400]) for _ in range(500)), reverse=True)
    loads = [0] * 16
    for w in groups:
        loads[loads.index(min(loads))] += w
    ours = [0] * 16
    for w, taken in sharding.schedule(sorted(Counter(groups).items(), reverse=True)):
        assert sum(n for _, n in taken) == Counter(groups)[w]
        for s, n in taken:
            ours[s] += n * w
    assert sorted(ours) == sorted(loads)


def test_sharding(spark):
    texts = ODD + [f"text {i % 90} " + "y" * (i % 37) for i in range(400)]
    rows = sharding.assign(frame(spark, texts)).collect()
    shards, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        shards[text].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(frame(spark, texts).limit(0)).count() == 0


# 10


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    syllables = ["th", "er", "on", "an", "re", "ed", "nd", "ea", "ti", "ou", "ing", "es"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 5)))
    insults = ["blorgface", "grumpf", "snivelwit"]
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(20, 60))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(insults)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    docs = frame(spark, texts + [None, "", "!!", " ".join("grumpf"), "Blorg-face!"])
    machine = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (7, None)], "doc_id long, toxic int"))
    rows = {r["doc_id"]: r["toxicity_score"] for r in toxicity.scored(docs, machine).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((rows[i] >= 0.5) == labels[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in rows.values()) and max(rows[600], rows[601], rows[602]) < 0.5 <= min(rows[603], rows[604])
    left = toxicity.survivors(docs, machine)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, s in rows.items() if s < 0.5}
    nothing = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing is None and toxicity.scored(docs, nothing).where("toxicity_score > 0").count() == 0


# The pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = corpus_pipeline.run(spark, small).collect()
    ids = {r["doc_id"] for r in rows}
    assert len(ids) == len(rows) and 0 < len(rows) < docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    codec = bpe.codec(*bpe.default_vocabulary())
    for r in rows:
        assert hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"] and codec.decode(bytes(r["ids"])).decode() == texts[r["doc_id"]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs, small).columns == docs.columns


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, small):
    df = registry.QUERIES[name](spark, small)
    assert df.count() == spark.read.parquet(f"{small}/documents.parquet").count()
