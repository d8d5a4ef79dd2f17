"""Toxicity by a support vector machine with a gap-weighted subsequence kernel.

Kernel: two character strings are as similar as the subsequences of three
characters that they share, each occurrence weighted by ``DECAY`` per skipped
character and spanning at most ``SPAN`` characters; strings are scaled by the
weight of their own subsequences.  So an insult with inserted characters keeps
most of its weight.  Units carry a mark at each end, so a word and a longer one
that it begins differ.  Nyström landmarks (windows of the labelled sample) span
the feature space, and a squared-hinge SVM is trained in it on windows of units:
every window of a clean text is a negative; of a toxic text, the windows that
clean texts lack beyond chance are positives, or else its most suspicious one,
chosen anew in each round.  Copies of positives with an inserted letter are
positives too.  A text scores as its worst window.

Units are white-space tokens without their non-alphanumeric characters, in
lower case, and runs of single-character tokens joined.  As the kernel is a
sum over subsequences, the machine folds into one weight per subsequence, and
a unit is scored without visiting the landmarks.

Null, empty and wordless texts have no units and get the score of the lowest
decision.  Labels that are null are not learnt from; without labels of both
classes nothing is toxic (score 0).  Rows that repeat a doc_id each count; a
column of the score's name is replaced, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN, DECAY, ALPHABET = 7, 0.8, 64
#: Most labelled texts of each class that the machine learns from.
SAMPLE = 1500
LANDMARKS, ROUNDS, COST = 400, 5, 10.0
#: Clean windows that join a fit at a time.
BATCH = 20_000
#: Copies of a positive window with an inserted letter.
INSERTED = 2
#: A unit is scored in windows of so many characters, so that a long one doesn't dilute an insult.
WINDOW = 14
#: Marks the ends of a unit, so that a word and a longer one that it begins differ; units have no such character.
EDGE = "\0"
#: A unit of so many toxic texts and next to no clean ones that chance explains it with this probability is a certain sign.
CHANCE = 1e-6
#: Tokens that a worker remembers the decision of.
MEMO_ENTRIES = 900_000
#: Decision of a text without units.
LOWEST = -3.0

_DROP = re.compile(r"[\W_]+")
_STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (0 for EDGE, else 1 to 63) of all strings end to end, and the n + 1 offsets."""
    raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    low = np.where((raw >= 97) & (raw <= 122), raw - 96, np.where((raw >= 48) & (raw <= 57), raw - 21, np.where(raw == ord(EDGE), 0, 37 + raw % 27)))
    return low, np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))))


def _scale(n: int) -> float:
    """Norm of the weights of the subsequences of n characters."""
    return float(np.sqrt(sum(w * w * max(0, n - b) for _, b, w in _STEPS)))


def _windows(units: list[str]) -> tuple[list[str], np.ndarray]:
    """Units, with a mark at each end, in windows of at most WINDOW characters (each unit at least one), and whose they are."""
    out, owner = [], []
    for i, u in enumerate(units):
        u = EDGE + u + EDGE
        if len(u) <= WINDOW:
            out.append(u)
            owner.append(i)
        else:
            own = [u[k : k + WINDOW] for k in range(0, len(u) - WINDOW, WINDOW // 2)] + [u[-WINDOW:]]
            out += own
            owner += [i] * len(own)
    return out, np.array(owner, np.int64)


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For equally long strings (rows): the subsequence numbers at each start, and their weight."""
    n = codes.shape[1]
    for a, b, w in _STEPS:
        if n > b:
            yield (codes[:, : n - b] * ALPHABET + codes[:, a : n - b + a]) * ALPHABET + codes[:, b:], w


def _each_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, codes) of the units of each length from 3 on."""
    codes, offsets = _codes(units)
    lengths = np.diff(offsets)
    for n in np.unique(lengths[lengths >= 3]).tolist():
        which = np.flatnonzero(lengths == n)
        yield which, codes[offsets[which][:, None] + np.arange(n)]


def features(units: list[str], table: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sums of the rows of `columns`, found through `table`, over the subsequences of each unit, scaled: with landmark_columns, kernel values."""
    out = np.zeros((len(units), columns.shape[1]), np.float32)
    for which, codes in _each_length(units):
        for s in range(0, len(which), 4096):
            own = codes[s : s + 4096]
            total = np.zeros((len(own), columns.shape[1]), np.float32)
            for numbers, w in _subsequences(own):
                at = table[numbers]
                for k in range(at.shape[1]):
                    total += w * columns[at[:, k]]
            out[which[s : s + 4096]] = total / _scale(codes.shape[1])
    return out


def landmark_columns(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled subsequence weights of the landmarks as (table, columns): column j of row table[s] is landmark j's weight of s; row 0 is zero."""
    entries: dict[tuple[int, int], float] = {}
    for which, codes in _each_length(landmarks):
        scale = _scale(codes.shape[1])
        for numbers, w in _subsequences(codes):
            for r, j in enumerate(which.tolist()):
                for s in numbers[r].tolist():
                    entries[s, j] = entries.get((s, j), 0.0) + w / scale
    table = np.zeros(ALPHABET**3, np.int32)
    seen = sorted({s for s, _ in entries})
    table[seen] = np.arange(1, len(seen) + 1)
    columns = np.zeros((len(seen) + 1, len(landmarks)), np.float32)
    for (s, j), w in entries.items():
        columns[table[s], j] = w
    return table, columns


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the active rows, from `start` if given; y is -1 or 1."""
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = np.zeros(x.shape[1] + 1) if start is None else np.append(*start)
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    decide = lambda w: x @ w[:-1].astype(np.float32) + np.float32(w[-1])
    loss = lambda w: float(cost * (weight * np.maximum(0, 1 - y * decide(w)) ** 2).sum(dtype=np.float64) + (ridge * w * w).sum())
    now = loss(w)
    for _ in range(40):
        active = np.flatnonzero(y * decide(w) < 1)
        left, right = np.zeros((len(w), len(w))), np.zeros(len(w))
        for i in range(0, len(active), 2048):
            rows = active[i : i + 2048]
            own = np.hstack([x[rows], np.ones((len(rows), 1), np.float32)]).astype(np.float64)
            scaled = own * (cost * weight[rows])[:, None]
            left += own.T @ scaled
            right += scaled.T @ y[rows]
        step = np.linalg.solve(left + np.diag(ridge), right) - w
        size, new = 1.0, loss(w + step)
        while new > now and size > 1e-3:
            size /= 2
            new = loss(w + size * step)
        if now - new <= 1e-6 * now:
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


@dataclass
class Machine:
    """Weight of every subsequence, intercept, and the logistic scale of decisions."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def decide(self, units: list[str], block: int = 20_000) -> np.ndarray:
        """Decision of each unit: the largest of its windows."""
        if len(units) > block:
            return np.concatenate([self.decide(units[i : i + block]) for i in range(0, len(units), block)])
        windows, owner = _windows(units)
        out = np.full(len(units), LOWEST)
        np.maximum.at(out, owner, self.decide_windows(windows))
        return out

    def decide_windows(self, windows: list[str], block: int = 40_000) -> np.ndarray:
        """Decision of each window."""
        if len(windows) > block:
            return np.concatenate([self.decide_windows(windows[i : i + block]) for i in range(0, len(windows), block)])
        raw = np.full(len(windows), self.bias, np.float64)
        for which, codes in _each_length(windows):
            total = np.zeros(len(which))
            for numbers, w in _subsequences(codes):
                total += w * self.weights[numbers].sum(axis=1)
            raw[which] += total / _scale(codes.shape[1])
        return raw

    def score(self, decision: float) -> float:
        z = self.slope * decision + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def units_of(token: str) -> str:
    return _DROP.sub("", token.lower())


def spelled(tokens: list[str]) -> list[str]:
    """Runs of three or more tokens of at most two characters (one of them alphanumeric) that spell a word."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    short = lengths <= 2
    if not short.any():
        return []
    edges = np.diff(np.concatenate(([0], short.view(np.int8), [0])))
    out = []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        if b - a >= 3:
            run = ""
            n = 0
            for t in [units_of(t) for t in tokens[a:b]] + ["--"]:
                if len(t) == 1:
                    run += t
                    n += 1
                elif t:
                    if n >= 3:
                        out.append(run)
                    run, n = "", 0
    return out


def _inserted(window: str, rng: np.random.Generator) -> str:
    """`window` with a random letter inside."""
    at = int(rng.integers(1, max(2, len(window))))
    return window[:at] + chr(97 + int(rng.integers(26))) + window[at:]


def nystroem(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table, columns) as of landmark_columns() whose sums are Nyström features: their products approximate the kernel, and equal it among landmarks."""
    table, columns = landmark_columns(landmarks)
    gram = features(landmarks, table, columns)
    values, vectors = np.linalg.eigh((gram + gram.T).astype(np.float64) / 2)
    good = values > 1e-4 * values[-1]
    return table, columns @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)


def _learn(texts: list[tuple[int, list[str]]], landmarks: int = LANDMARKS, rounds: int = ROUNDS, batch: int = BATCH, chance: float = CHANCE) -> Machine | None:
    """Machine from (toxic, distinct units) of the labelled sample.

    Everything is learnt from whole units in windows.  Of the clean windows a
    fit holds `batch` at first (half of them the most frequent), then also up to
    `batch` more a time that lie inside its margin, until none outside the fit
    does: the machine is that of all of them.
    """
    cut: dict[str, list[str]] = {}  # the windows of each distinct unit
    windows = lambda units: {w for u in units for w in (cut.get(u) or cut.setdefault(u, _windows([u])[0]))}
    toxic = [sorted(windows(u)) for y, u in texts if y == 1 and u]
    clean = [u for y, u in texts if y == 0 and u]
    if not toxic or not clean:
        return None
    in_toxic, in_clean = Counter(x for u in toxic for x in u), Counter(x for u in clean for x in windows(u))
    odds = {x: np.log((n + 0.1) / (len(toxic) + 1)) - np.log((in_clean[x] + 0.1) / (len(clean) + 1)) for x, n in in_toxic.items()}
    suspicion = {x: o * np.log1p(in_toxic[x]) for x, o in odds.items()}
    order = sorted(odds, key=lambda x: (-suspicion[x], x))
    common = sorted(in_clean, key=lambda x: (-in_clean[x], x))
    half = landmarks // 2
    table, columns = nystroem(list(dict.fromkeys(order[:half] + common[:: max(1, min(len(common), 4 * half) // half)][:half])))
    negatives = list(in_clean)
    often = 1 + np.log1p([*in_clean.values()])
    rng = np.random.default_rng(0)
    held = np.zeros(len(negatives), bool)
    held[rng.permutation(len(negatives))[: batch // 2]] = True
    held[np.argsort(-often, kind="stable")[: batch // 2]] = True
    least = np.log(chance) / np.log(len(toxic) / (len(toxic) + len(clean)))
    certain = {x for x, n in in_toxic.items() if n >= least and in_clean[x] <= n / 100}
    signs = [[x for x in u if x in certain] for u in toxic]
    witness = [own or [max(u, key=lambda x: (suspicion[x], x))] for u, own in zip(toxic, signs)]
    open_ = sorted({x for u, sign in zip(toxic, signs) if not sign for x in u})
    for _ in range(rounds):
        positive = Counter(x for own in witness for x in own)
        altered = {_inserted(x, rng): n for x, n in sorted(positive.items()) for _ in range(INSERTED)}
        own_weight = np.concatenate([np.sqrt([*positive.values()]), np.sqrt([*altered.values()]) / INSERTED])
        own = features([*positive, *altered], table, columns)
        start = None
        while True:
            chosen = np.flatnonzero(held)
            x = np.vstack([own, features([negatives[i] for i in chosen.tolist()], table, columns)])
            y = np.concatenate([np.ones(len(own)), -np.ones(len(chosen))])
            start = svm(x, y, np.concatenate([own_weight, often[chosen]]), start=start)
            machine = Machine((columns @ start[0].astype(np.float32))[table].astype(np.float32), start[1])
            against = machine.decide_windows(negatives)
            hard = [i for i in np.argsort(-against, kind="stable").tolist() if against[i] > -1 and not held[i]][:batch]
            if not hard:
                break
            held[hard] = True
        # Toxic texts without a certain sign name their worst window anew.
        decided = dict(zip(open_, machine.decide_windows(open_).tolist()))
        now = [sign or [max(u, key=lambda x: (decided[x], x))] for sign, u in zip(signs, toxic)]
        if now == witness:
            break
        witness = now
    best = lambda u: float(machine.decide(u).max())
    d = np.array([best(u) for c in (1, 0) for y, u in texts if y == c and u])
    machine.slope, machine.offset = _logistic(d, np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))]))
    return machine


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic fit, classes weighted equally."""
    x = np.stack([d, np.ones(len(d))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.5, x.T @ (weight * (y - p)) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _text_units(text: str | None) -> list[str]:
    tokens = (text or "").split()
    return sorted({u for u in map(units_of, set(tokens)) if u} | set(spelled(tokens)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **more) -> Machine | None:
    """Machine from at most `sample` whole texts of each class, those with the smallest hashes of doc_id.

    `more` goes to _learn(): landmarks, rounds, batch and chance.

    The sample's ids and units go to the driver; their number is bounded by the
    parameter.  Rows with crc32(doc_id) mod 5 = 0 are held out.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("_h"))
    picks = [known.where(F.col("toxic") == c).orderBy("_h", "doc_id").limit(sample) for c in (0, 1)]
    ids = picks[0].unionByName(picks[1]).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = pa.array([_text_units(x.as_py()) for x in batch.column(2)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), units], ["doc_id", "toxic", "units"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(run, "doc_id long, toxic int, units array<string>")
    table = found.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    seen: dict[str, str] = {}  # one object for each distinct unit
    texts: list[tuple[int, list[str]]] = []
    for i in range(0, table.num_rows, 64):
        part = table.slice(i, 64)
        texts += [(y, [seen.setdefault(x, x) for x in units]) for y, units in zip(part["toxic"].to_pylist(), part["units"].to_pylist())]
    del table
    return _learn(texts, **more)


class Scorer:
    """Decisions of texts; tokens that are met for the first time are gathered and decided together, then remembered."""

    def __init__(self, machine: Machine, most: int = MEMO_ENTRIES):
        self.machine, self.most = machine, most
        self.memo: dict[str, float] = {}

    def decide(self, texts: list[str | None]) -> list[float]:
        """Decision of each text: that of its worst unit."""
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        split = [(t or "").split() for t in texts]
        new = list({t for tokens in split for t in tokens if t not in memo})
        units = list(map(units_of, new))
        decided = np.where(np.fromiter(map(len, units), np.int64, len(units)) > 0, self.machine.decide(units), LOWEST) if new else []
        memo.update(zip(new, map(float, decided)))
        out = [max(map(memo.__getitem__, tokens), default=LOWEST) for tokens in split]
        runs = [(i, s) for i, tokens in enumerate(split) for s in spelled(tokens)]
        if runs:
            for (i, _), d in zip(runs, self.machine.decide([s for _, s in runs])):
                out[i] = max(out[i], float(d))
        return out


def scored(docs: DataFrame, machine: Machine | None, name: str = "toxicity_score") -> DataFrame:
    """`docs` with a column `name`: the score of the text, 0 to 1; a map without a shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        scorer = Scorer(m) if m is not None else None
        for batch in column:
            texts = batch.tolist()
            out: list[float] = []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                out += [m.score(d) for d in scorer.decide(part)] if scorer else [0.0] * len(part)
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(name, run(F.col("text")))


def survivors(docs: DataFrame, machine: Machine | None, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns."""
    name = "_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return scored(docs, machine, name).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored by a machine that learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs.select("doc_id", "text"), machine)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
