"""Brute-force versions, ties, nulls and clashing names of operators that SQL can't check or that a pipeline uses."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontaminate, exact_dedup, simhash, toxicity


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 2


def test_conversations_with_nulls_and_ties(spark, tmp_path, duck):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (1, None, "user", "b"), (1, 0, None, "<|x|>"), (1, 0, "assistant", "t\\"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "user", "long " * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"rank": F.lit(1), "score": F.lit("x"), "ID": F.lit(0)})
    table.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r.asDict() for r in chat.op2_chat(spark, str(tmp_path)).collect()}
    assert {i: r["n_turns"] for i, r in found.items()} == {None: 2, 1: 3, 2: 2, 3: 1, -1: 2}
    assert found[None]["loss_chars"] == 0 and found[1]["loss_chars"] == 2 and found[3]["formatted_chars"] == 7 + 8 + 250_000


def test_best_branch_and_ties(spark):
    paths = spark.createDataFrame([("r", "b", 1.0), ("r", "a", 1.0), ("r", "c", 0.5), ("s", "d", -1.0)], "root string, leaf string, score double")
    assert {(r["root"], r["leaf"], r["rank"]) for r in chat.chosen(paths, 2).collect()} == {("r", "a", 1), ("r", "b", 2), ("s", "d", 1)}


# 3


def contaminated(text, items, size=10):
    """(n_words, n_hit, items) by comparing each window at each word."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, found = split(text), set(), set()
    for name, item in items:
        own = split(item)
        for window in {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else ():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [1 << 20, 400])
def test_decontamination_as_brute_force(spark, most):
    rng = random.Random(33)
    words = ["a", "B", "ä", "cat", "cat1", "ÉE", "7"]
    some = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(words, k=n))
    items = [(f"q{i}", some(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [("q-null", None), ("q-none", "?")]
    texts = [None, "", "!"] + [some(rng.randrange(60)) for _ in range(60)]
    texts += [f"{some(4)} {items[rng.randrange(12)][1].upper()} {some(4)}" for _ in range(40)] + ["x " * 40_000 + (items[3][1] or "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"items": F.lit(1), "Words": F.lit(2)})
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), most=most)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in found.collect()} == {i: contaminated(t, items) for i, t in enumerate(texts)}


def test_no_documents_to_decontaminate(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("q", "one two")], "item_id string, text string")
    assert decontaminate.contamination(docs, items).count() == decontaminate.survivors(docs, items).count() == 0


# 6


def test_the_row_that_stays_does_not_follow_the_order(spark):
    rows = [(1, "Abc", 1), (1, "abc", 2), (1, "aBC", 3), (1, "abc", 4), (None, "ABC", 5), (2, None, 6), (2, "", 7), (3, "y" * 200_000, 8), (None, "y" * 200_000, 9)]
    answers = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT int").repartition(seed + 1)
        left = exact_dedup.survivors(docs)
        assert left.columns == docs.columns
        answers.add(tuple(sorted((r["doc_id"], r["KEPT"]) for r in left.collect())))
    assert len(answers) == 1 and [x[0] for x in answers.pop()] == [1, 2, 3]


def test_more_losers_than_a_join_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"T{i % 40}") for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "BROADCAST", 0)
    assert {r["doc_id"] for r in exact_dedup.survivors(docs).collect()} == set(range(160, 200))


# 8


def test_fingerprints_as_brute_force():
    rng = random.Random(8)
    for n in [0, 1, 3, 4, 5, 40, 300]:
        text = "".join(rng.choice(["Ab", "ä", "x", "Y1"]) + rng.choice([" ", "\t\n", "\r "]) for _ in range(n))
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) % (1 << 64) == want


# 10


def subsequences(window):
    """Weight of each subsequence of three characters that spans at most SPAN, by enumeration, scaled as the kernel scales."""
    out = {}
    for i, j, k in combinations(range(len(window)), 3):
        if k - i < toxicity.SPAN:
            key = tuple(toxicity._codes([window[i] + window[j] + window[k]])[0].tolist())
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
    norm = np.sqrt(sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in combinations(range(len(window)), 3) if k - i < toxicity.SPAN))
    return {s: w / norm for s, w in out.items()}


def test_kernel_and_features_as_brute_force():
    rng = random.Random(10)
    strings = [toxicity.EDGE + "".join(rng.choices("abcxyé7", k=rng.randrange(1, 13))) + toxicity.EDGE for _ in range(40)]
    strings = list(dict.fromkeys(strings))
    each = list(map(subsequences, strings))
    kernel = np.array([[sum(w * b.get(s, 0.0) for s, w in a.items()) for b in each[:15]] for a in each])
    assert np.allclose(toxicity.features(strings, *toxicity.landmark_columns(strings[:15])), kernel, atol=1e-4)
    mapped = toxicity.features(strings, *toxicity.nystroem(strings[:15]))
    assert np.allclose(mapped @ mapped[:15].T, kernel, atol=2e-2)


def test_machine_minimises_its_loss():
    """Newton steps against plain gradient descent."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=300) > 0.3, 1.0, -1.0)
    weight = rng.uniform(0.5, 2, 300)
    w, b = np.zeros(5), 0.0
    for _ in range(20_000):
        slack = weight * np.maximum(0, 1 - y * (x @ w + b)) * y
        w, b = w - 1e-5 * (2 * w - 20 * x.T @ slack), b - 1e-5 * (2e-3 * b - 20 * slack.sum())
    for start in (None, (rng.normal(size=5), 1.0)):
        found = toxicity.svm(x, y, weight, cost=10.0, start=start)
        assert np.allclose(found[0], w, atol=2e-2) and abs(found[1] - b) < 2e-2


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re", "ed", "nd", "ea", "ti"], k=rng.randrange(1, 5)))
    texts = [(i % 3 == 0, [word() for _ in range(40)] + (["snivelwit" if i % 2 else "averylongandharmlessbeginningofgrumpf"] if i % 3 == 0 else [])) for i in range(300)]
    return [(int(y), sorted(set(u))) for y, u in texts]


def test_no_clean_window_is_left_out(labelled):
    """Few negatives at a time or all at once: no clean window but those of the fit lies inside the margin."""
    clean = sorted({u for y, units in labelled if y == 0 for u in units})
    machines = [toxicity._learn(labelled, batch=b) for b in (50, 100_000)]
    decisions = [m.decide(clean) for m in machines]
    assert np.corrcoef(*decisions)[0, 1] > 0.98 and max(d.max() for d in decisions) < 0


def test_insults_behind_a_long_beginning(labelled):
    """Whole units are learnt from: what marks a unit may stand at its end."""
    machine = toxicity._learn(labelled)
    found = machine.decide(["averylongandharmlessbeginningofgrumpf", "snivelwit", "averylongandharmless", "theronan"])
    assert min(found[:2]) > 0 > found[3]


def test_odd_rows_are_scored(spark, labelled):
    machine = toxicity._learn(labelled)
    texts = [(None, "snivelwit"), (1, None), (1, "the"), (1, "the"), (2, "on " * 100_000 + "snivelwit"), (3, "on" * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"toxicity_score": F.lit("x"), "_SCORE": F.lit(1)})
    left = toxicity.survivors(docs, machine)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "1", "3"]
    assert toxicity.survivors(docs.limit(0), machine).count() == 0
    assert toxicity.learn(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")) is None


# The pipeline


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re", "ed"], k=3))
    own = lambda n: " ".join(word() for _ in range(n))
    item, near = own(12), own(60)
    rows = [(i, own(30) + (" snivelwit" if i % 2 else "")) for i in range(100, 160)]
    rows += [(None, own(30)), (1, None), (2, ""), (None, None), (3, "Same " + item[:9]), (4, "same " + item[:9]), (5, own(9) + " " + item + " " + own(9)), (6, near), (7, near + " more"), (8, "w " * 60_000), (9, own(30)), (9, own(31))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "Kept": F.lit(1), "_score": F.lit("x"), "_all": F.lit(2)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)] + [(None, 1), (9, None)], "doc_id long, toxic int")
    for name, df in {"documents": docs, "labels": labels, "benchmark": spark.createDataFrame([("q", item), (None, None)], "item_id string, text string")}.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r["doc_id"] for r in left if r["doc_id"] is not None)
    assert [i for i in ids if i < 100] == [2, 4, 6, 8, 9, 9] and sum(r["doc_id"] is None for r in left) == 1
    assert [i for i in ids if i >= 100] == list(range(100, 160, 2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
