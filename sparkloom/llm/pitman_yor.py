"""Language-model scores from a hierarchical Pitman-Yor process.

The model has one restaurant per preceding token and, above them all, the
restaurant of single tokens.  A token after context u is drawn from u's
restaurant, whose new tables order from the parent; the parent's new tables
order from a continuous base, so each known token has one table there and what
is left is the probability of the one unknown token.

A token that follows a context once sits at one table.  All others start at
about their expected tables and are seated by Gibbs sampling, in which each
sweep reseats all customers.  Up to ``EXACT`` customers of a token in a context
leave together, and their tables are drawn from the exact conditional of the
Chinese-restaurant process given the other tokens' tables; more customers leave
in ``LEAVES`` random lots that sit down by the Chinese-restaurant rule.
Predictive probabilities are averaged over the seatings after the burn-in; given
the parent they are linear in tables, so tables are averaged.  Discounts come
from the numbers of singletons and pairs.  Restaurants are sampled in parallel,
and so are a quarter of a restaurant's tokens, or a lot, at a time.

Chunks of documents send their distinct (context, token) counts to the bucket
of the context.  Buckets ask the bucket of a token for its parental
probability, seat, and return the tables to the parent; then each chunk gets
what its own tokens and pairs need.  All counts, of all documents, are used;
what moves grows with the input.

Texts are lower-cased (A-Z); tokens are words without ASCII white space and one
end.  Null and empty texts are the end alone.  A null doc_id is learnt from.
"""

from __future__ import annotations

from functools import lru_cache
from math import gamma, log10

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._chunks import PIECE, by_bucket, chunked, counts, mix, pack, pieces, small, unpack

#: Strength of the restaurants of contexts and of their parent.
STRENGTH, PARENT_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 2, 3
#: Customers of a token in a context up to which their tables are drawn exactly; lots in which more of them are reseated; parts of the tokens drawn one after another.
EXACT, LEAVES, PARTS = 1024, 16, 4
START_ROUNDS = 20
#: Numbers held at once while tables are drawn.
BLOCK = 1 << 20
#: Text of a chunk; larger than elsewhere, as its distinct tokens are sent.
CHUNK_BYTES = 16 << 20
END = b"\n"  # no word

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FORTY = np.uint64(24)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def short(hashes: np.ndarray) -> np.ndarray:
    """40 bits that name a token in a restaurant and order the buckets."""
    with np.errstate(over="ignore"):
        return mix(hashes) >> _FORTY


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    return (name * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5]


def _wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = x.reshape(-1, 5)
    return out.view(np.uint64).ravel()


class _Chunk:
    """Tokens of a chunk by rank of their hash, and its distinct pairs, context first."""

    def __init__(self, table: pa.Table, buckets: int):
        numbers = _Numbers({END: 0})
        get, parts, sizes = numbers.__getitem__, [], []
        for text in table.column("text"):
            words = text.as_py().encode("utf-8", "surrogatepass").translate(_LOWER).split()
            parts.append(np.fromiter(map(get, words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            sizes.append(len(words) + 1)
        tokens = np.concatenate(parts)
        del parts
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter(map(digest, numbers), np.uint64, len(numbers))
        name = short(hashes)
        order = np.lexsort((hashes, name))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.name = hashes[order], name[order]
        self.tokens = rank[tokens]
        self.sizes = np.array(sizes, np.int64)
        self.train = np.asarray(table.column("_train").to_numpy(), bool)
        learnt = np.repeat(self.train, self.sizes)
        before = np.concatenate(([rank[0]], self.tokens[:-1]))
        self.pairs, self.pair = np.unique(before * len(order) + self.tokens, return_inverse=True)
        self.context = self.pairs // len(order)
        self.count = np.bincount(self.tokens[learnt], minlength=len(order))
        self.pair_count = np.bincount(self.pair[learnt], minlength=len(self.pairs))
        # Buckets are ranges of names, so each has a range of tokens, and of pairs.
        own = bucket_of(self.name, buckets)
        self.buckets, starts = np.unique(own, return_index=True)
        self.bounds = np.append(starts, len(own)).tolist()
        self.pair_bounds = np.searchsorted(self.context, np.append(starts, len(own))).tolist()

    def ask(self, chunk: int) -> list[tuple[int, int, bytes]]:
        out = []
        n_pairs = np.bincount(self.context, minlength=len(self.hashes))
        token = self.name[self.pairs % len(self.hashes)]
        for k, b in enumerate(self.buckets.tolist()):
            t, p = slice(self.bounds[k], self.bounds[k + 1]), slice(self.pair_bounds[k], self.pair_bounds[k + 1])
            out.append((b, chunk, pack(self.hashes[t], *small(self.count[t]), *small(n_pairs[t]), _five(token[p]), *small(self.pair_count[p]))))
        return out


class _Bucket:
    """What all chunks sent about the contexts of a bucket."""

    def __init__(self, asked: pa.Table, pairs: bool = True):
        self.chunks = asked.column("chunk").to_pylist()
        sent = []
        for x in asked.column("data"):
            hashes, *rest = unpack(x.as_py(), "<u8", "u1", "<u4", "u1", "<u4", "u1", "u1", "<u4")
            sent.append((hashes, counts(*rest[:2]), counts(*rest[2:4]), rest[4], counts(*rest[5:])))
        self.n_tokens = [len(x[0]) for x in sent]
        hashes = np.concatenate([x[0] for x in sent])
        self.hashes, self.of = np.unique(hashes, return_inverse=True)
        self.count = np.bincount(self.of, np.concatenate([x[1] for x in sent]), len(self.hashes)).astype(np.int64)
        self.name = short(self.hashes)
        if pairs:
            self.n_pairs = [len(x[4]) for x in sent]
            context = np.repeat(self.of, np.concatenate([x[2] for x in sent]).astype(np.int64)).astype(np.uint64)
            token = np.concatenate([_wide(x[3]) for x in sent])
            key, self.pair_of = np.unique(context << np.uint64(40) | token, return_inverse=True)
            self.pair_count = np.bincount(self.pair_of, np.concatenate([x[4] for x in sent]), len(key)).astype(np.int64)
            self.context, self.token = (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)
            self.several = np.flatnonzero(self.pair_count > 1)

    def requests(self, buckets: int, saved: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By the bucket of the token: distinct tokens of pairs met several times, customers they don't send to the parent, and their places."""
        token, place = np.unique(self.token[self.several], return_inverse=True)
        total = np.bincount(place, saved, len(token)).astype("<f4")
        return {b: (token[own], total[own], own) for b, own in by_bucket(bucket_of(token, buckets)).items()}

    def places(self) -> tuple[int, np.ndarray]:
        token, place = np.unique(self.token[self.several], return_inverse=True)
        return len(token), place


@lru_cache(maxsize=2)
def _ratios(discount: float, most: int) -> np.ndarray:
    """Row c, column t - 1: log of S(c, t + 1) / S(c, t), S the generalised Stirling numbers that count seatings of c customers at t tables."""
    log_s = np.full((most + 1, most + 1), -np.inf)
    log_s[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        n = t[: c + 1]
        log_s[c + 1, 1 : c + 2] = np.logaddexp(log_s[c, : c + 1], np.log(np.maximum(c - discount * n, 1e-300)) + log_s[c, 1 : c + 2])
    with np.errstate(invalid="ignore"):
        return log_s[:, 2:] - log_s[:, 1:-1]


def _drawn(c: int, opening: np.ndarray, discount: float, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each, drawn given all others' tables; opening is strength + discount * those tables."""
    out = np.empty(len(opening), np.int64)
    step = max(1, BLOCK // c)
    for i in range(0, len(opening), step):
        own = slice(i, i + step)
        # Against t = 1, each further table counts its opening weight and how many more seatings there are.
        w = np.zeros((len(opening[own]), c))
        np.log(parent[own, None] * (opening[own, None] + discount * np.arange(1, c)), out=w[:, 1:])
        w[:, 1:] += _ratios(discount, EXACT)[c, : c - 1]
        np.cumsum(w, axis=1, out=w)
        w -= w.max(axis=1, keepdims=True)
        np.cumsum(np.exp(w, out=w), axis=1, out=w)
        out[own] = 1 + (w < rng.random((len(w), 1)) * w[:, -1:]).sum(axis=1)
    return np.minimum(out, c)


def seatings(owner: np.ndarray, count: np.ndarray, parent: np.ndarray, fixed: np.ndarray, discount: float, strength: float, rng: np.random.Generator, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Average tables of each dish and of each restaurant over Gibbs samples.

    Dish i of restaurant owner[i] has count[i] > 1 customers and the parental
    probability parent[i]; fixed holds the tables of each restaurant's dishes
    with one customer.  A sweep reseats every customer of every dish: of up to
    EXACT customers all at once, by the exact conditional of their tables; of
    more, in LEAVES lots that leave at random and sit down again, so that work
    follows the tables and not the customers.
    """
    n, restaurants = len(count), len(fixed)
    # At first, the tables that customers who come one by one would open, given as many tables in the whole restaurant as that makes.
    total = (fixed + np.bincount(owner, minlength=restaurants)).astype(float)
    for _ in range(START_ROUNDS):
        opening = (strength + discount * total[owner]) * parent
        tables = np.clip(np.rint(1 + opening * np.log1p((count - 1) / (1 + opening))), 1, count).astype(np.int64)
        total = fixed + np.bincount(owner, tables, restaurants)
    few, many = np.flatnonzero(count <= EXACT), np.flatnonzero(count > EXACT)
    few = few[np.argsort(count[few], kind="stable")]
    # Of many customers the first EXACT are seated by their conditional, the others as they come.
    opening = strength + discount * (total[owner[many]] - tables[many])
    begun = _drawn(EXACT, opening, discount, parent[many], rng)
    more = (opening + discount * begun) * parent[many] * np.log(count[many] / EXACT)
    total -= np.bincount(owner[many], tables[many], restaurants)
    tables[many] = np.minimum(begun + np.rint(more).astype(np.int64), count[many])
    total += np.bincount(owner[many], tables[many], restaurants)
    dish = np.repeat(np.arange(len(many)), tables[many])
    # Given their number, sizes of tables are Sibuya variables with a given sum; at first the dish's first table takes what the others leave.
    size = np.maximum(1, np.minimum((rng.random(len(dish)) * gamma(1 - discount)) ** (-1 / discount), (count // tables)[many][dish])).astype(np.int64)
    firsts = np.cumsum(tables[many]) - tables[many]
    size[firsts] += count[many] - np.bincount(dish, size, len(many)).astype(np.int64)
    dish_sum, all_sum = np.zeros(n), np.zeros(restaurants)
    for sweep in range(burn_in + samples):
        part = rng.integers(0, PARTS, len(few))
        for k in range(PARTS):
            mine = few[part == k]
            total -= np.bincount(owner[mine], tables[mine], restaurants)
            # Dishes of a part see the others' tables of now, and of each other those before the draw.
            opening = strength + discount * (total[owner[mine]] + np.bincount(owner[mine], tables[mine], restaurants)[owner[mine]] - tables[mine])
            counts_, starts = np.unique(count[mine], return_index=True)
            for c, i, j in zip(counts_.tolist(), starts.tolist(), [*starts[1:].tolist(), len(mine)]):
                tables[mine[i:j]] = _drawn(c, opening[i:j], discount, parent[mine[i:j]], rng)
            total += np.bincount(owner[mine], tables[mine], restaurants)
        for _ in range(LEAVES if len(many) else 0):
            left = rng.binomial(size, 1 / LEAVES)
            out = np.bincount(dish, left, len(many)).astype(np.int64)
            size = size - left
            dish, size = dish[size > 0], size[size > 0]
            now = np.bincount(dish, minlength=len(many))
            total += np.bincount(owner[many], now - tables[many], restaurants)
            # To tables there by their size less the discount, or to new ones.
            there = count[many] - out - discount * now
            new = (strength + discount * total[owner[many]]) * parent[many]
            opens = rng.binomial(out, new / (there + new))
            ends = np.cumsum(now)
            for i in np.flatnonzero(out > opens).tolist():
                at = slice(ends[i] - now[i], ends[i])
                weight = size[at] - discount
                size[at] += rng.multinomial(out[i] - opens[i], weight / weight.sum())
            order = np.argsort(np.concatenate((dish, np.repeat(np.arange(len(many)), opens))), kind="stable")
            dish = np.concatenate((dish, np.repeat(np.arange(len(many)), opens)))[order]
            size = np.concatenate((size, np.ones(int(opens.sum()), np.int64)))[order]
            tables[many] = now + opens
            total += np.bincount(owner[many], opens, restaurants)
        if sweep >= burn_in:
            dish_sum += tables
            all_sum += total
    return dish_sum / samples, all_sum / samples


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


#: Sums over all buckets: tokens, distinct tokens, pairs that save a customer, and what the discounts need.
TOTALS = ("tokens", "distinct", "saved", "ones", "twos", "pair_ones", "pair_twos")


def _count(key, asked):
    b = _Bucket(asked)
    c, p = b.count, b.pair_count
    row = [c.sum(), (c > 0).sum(), p.sum() - (p > 0).sum(), (c == 1).sum(), (c == 2).sum(), (p == 1).sum(), (p == 2).sum()]
    return pa.table({n: pa.array([float(x)]) for n, x in zip(TOTALS, row)})


def scores(docs: DataFrame, learn_from: Column | None = None, strength: float = STRENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score.

    `learn_from` is a condition on doc_id: which documents the model learns
    from (None: all).  score is the model's log10 probability of the text's
    tokens, base_score that of add-one unigrams.
    """
    base, n = chunked(docs, chunk_bytes)
    base = base.withColumn("_train", F.coalesce(learn_from, F.lit(True)) if learn_from is not None else F.lit(True))
    buckets = n

    def ask(key, table):
        return pieces(_Chunk(table, buckets).ask(int(key[0].as_py())))

    def first(key, asked):
        """Every pair starts at one table; tokens of several pairs ask for their parental probability."""
        own = _Bucket(asked)
        me = int(key[0].as_py())
        return pieces([(b, me, pack(token, saved)) for b, (token, saved, _) in own.requests(buckets, own.pair_count[own.several] - 1.0).items()])

    def totals_of(messages):
        row = [x.as_py() for x, c in zip(messages.column("data"), messages.column("chunk").to_pylist()) if c < 0]
        return [np.frombuffer(x, "<f8") for x in row]

    def customers(own: _Bucket, messages) -> tuple[np.ndarray, np.ndarray, list]:
        """Names of the bucket's tokens, and the customers each has at the parent."""
        name, place = np.unique(own.name, return_inverse=True)
        have = np.bincount(place, own.count, len(name))
        asked = [(c, *unpack(x.as_py(), "<u8", "<f4")) for c, x in zip(messages.column("chunk").to_pylist(), messages.column("data")) if c >= 0]
        for _, token, saved in asked:
            have[np.searchsorted(name, token)] -= saved
        return name, have, asked

    def parental(key, asked, messages):
        """Answers with parental probabilities of tokens, in the order of the requests."""
        if not asked.num_rows:
            return pieces([])
        own = _Bucket(asked, pairs=False)
        name, have, requests = customers(own, messages)
        t = dict(zip(TOTALS, totals_of(messages)[0]))
        d = _discount(t["ones"], t["twos"])
        probability = np.maximum(have - d, 1e-3) / (PARENT_STRENGTH + t["tokens"] - t["saved"])
        me = int(key[0].as_py())
        return pieces([(c, me, probability[np.searchsorted(name, token)].astype("<f4").tobytes()) for c, token, _ in requests])

    def seated(key, own: _Bucket, answers):
        """Average tables of the pairs met several times, and of all restaurants, in this bucket."""
        t = dict(zip(TOTALS, totals_of(answers)[0]))
        d = _discount(t["pair_ones"], t["pair_twos"])
        size, place = own.places()
        parent = np.zeros(size)
        requests = own.requests(buckets, np.zeros(len(own.several)))
        for b, x in zip(answers.column("chunk").to_pylist(), answers.column("data")):
            if b >= 0:
                parent[requests[b][2]] = np.frombuffer(x.as_py(), "<f4")
        fixed = np.bincount(own.context[own.pair_count == 1], minlength=len(own.hashes))
        rng = np.random.default_rng([7, int(key[0].as_py())])
        tables, total = seatings(own.context[own.several], own.pair_count[own.several], parent[place], fixed, d, strength, rng)
        return d, tables, total

    def returned(key, asked, answers):
        """Tokens of several pairs return, to their own bucket, the customers that they now don't send to the parent."""
        if not asked.num_rows:
            return pieces([])
        own = _Bucket(asked)
        _, tables, _ = seated(key, own, answers)
        me = int(key[0].as_py())
        return pieces([(b, me, pack(token, saved)) for b, (token, saved, _) in own.requests(buckets, own.pair_count[own.several] - tables).items()])

    def to_chunks(key, asked, answers):
        """Each chunk's contexts: customers less discounts of its pairs, and the weight of the parent."""
        if not asked.num_rows:
            return pieces([])
        own = _Bucket(asked)
        d, tables, total = seated(key, own, answers)
        count = np.maximum(own.count, 0)
        back = np.where(count > 0, (strength + d * total) / (strength + count), 1.0).astype("<f4")
        share = np.maximum(own.pair_count - d, 0) * (own.pair_count > 0)
        share[own.several] = own.pair_count[own.several] - d * tables
        share /= strength + count[own.context]
        code = np.minimum(own.pair_count, 2).astype(np.uint8)
        out, at, pt, me = [], 0, 0, int(key[0].as_py())
        for chunk, n_tokens, n_pairs in zip(own.chunks, own.n_tokens, own.n_pairs):
            mine, pairs = own.of[at : at + n_tokens], own.pair_of[pt : pt + n_pairs]
            at, pt = at + n_tokens, pt + n_pairs
            kinds = code[pairs]
            out.append((chunk, me, pack(back[mine], kinds, share[pairs[kinds == 2]].astype("<f4"), np.array([d, strength], "<f8"))))
        return pieces(out)

    def words(key, asked, messages):
        """Each chunk's tokens: their counts and parental probabilities."""
        if not asked.num_rows:
            return pieces([])
        own = _Bucket(asked, pairs=False)
        name, have, _ = customers(own, messages)
        found = totals_of(messages)
        t = next(dict(zip(TOTALS, x)) for x in found if len(x) == len(TOTALS))
        saved = next(float(x[0]) for x in found if len(x) == 1)
        d = _discount(t["ones"], t["twos"])
        whole = PARENT_STRENGTH + t["tokens"] - saved
        unknown = (PARENT_STRENGTH + d * t["distinct"]) / whole
        have = have[np.searchsorted(name, own.name)]
        probability = np.where(own.count > 0, np.maximum(have - d, 1e-3) / whole, unknown).astype("<f4")
        out, at, me = [], 0, int(key[0].as_py())
        for chunk, n_tokens in zip(own.chunks, own.n_tokens):
            mine = own.of[at : at + n_tokens]
            at += n_tokens
            out.append((chunk, me, pack(*small(own.count[mine]), probability[mine], np.array([t["tokens"], t["distinct"]], "<f8"))))
        return pieces(out)

    def score(key, left, answers):
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=_OUT)
        own = _Chunk(left, buckets)
        size = len(own.hashes)
        count, parent, back = np.zeros(size), np.zeros(size), np.ones(size)
        share = np.zeros(len(own.pairs))
        at = {b: k for k, b in enumerate(own.buckets.tolist())}
        tokens = distinct = 0.0
        for b, kind, x in zip(answers.column("to").to_pylist(), answers.column("kind").to_pylist(), answers.column("data")):
            k = at[b]
            t, p = slice(own.bounds[k], own.bounds[k + 1]), slice(own.pair_bounds[k], own.pair_bounds[k + 1])
            if kind:
                few, many, parent[t], (tokens, distinct) = unpack(x.as_py(), "u1", "<u4", "<f4", "<f8")
                count[t] = counts(few, many)
            else:
                back[t], code, several, (d, s) = unpack(x.as_py(), "<f4", "u1", "<f4", "<f8")
                part = np.zeros(len(code))
                part[code == 1] = 1 - d
                part[code == 2] = several
                share[p] = part  # of one customer still to be divided by all customers, below
                own.single = getattr(own, "single", np.zeros(len(own.pairs), bool))
                own.single[p] = code == 1
                own.strength = s
        single = own.single
        share[single] /= own.strength + count[own.context[single]]
        p = share + back[own.context] * parent[own.pairs % size]
        ends = np.concatenate(([0], np.cumsum(own.sizes)[:-1]))
        add = lambda x: np.add.reduceat(x, ends)
        known = add((count[own.tokens] > 0).astype(np.int64))
        plain = add(np.log10(count[own.tokens] + 1)) - own.sizes * log10(tokens + distinct + 1)
        return pa.table({"doc_id": left.column("doc_id").cast(pa.int64()), "learnt": pa.array(own.train), "n_tokens": pa.array(own.sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(own.sizes), int(tokens))), "base_score": pa.array(plain), "score": pa.array(add(np.log10(p)[own.pair]))}, schema=_OUT)

    by_chunk = base.groupBy("_chunk")
    asked = by_chunk.applyInArrow(ask, PIECE)
    by_bucket_ = asked.groupBy("to")
    sums = by_bucket_.applyInArrow(_count, ", ".join(f"{c} double" for c in TOTALS)).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in TOTALS))
    everyone = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("to")
    totals = sums.select(everyone, F.lit(-1).cast("long").alias("chunk"), _doubles(*TOTALS).alias("data"))
    together = lambda *parts: _union(*parts).groupBy("to")
    answers = by_bucket_.cogroup(together(by_bucket_.applyInArrow(first, PIECE), totals)).applyInArrow(parental, PIECE)
    known = together(answers, totals)
    back_to_parent = by_bucket_.cogroup(known).applyInArrow(returned, PIECE).repartition("to")
    saved = back_to_parent.groupBy("to").applyInArrow(_saved, "saved double").agg(F.coalesce(F.sum("saved"), F.lit(0.0)).alias("saved")).select(everyone, F.lit(-1).cast("long").alias("chunk"), _doubles("saved").alias("data"))
    about_words = by_bucket_.cogroup(together(back_to_parent, totals, saved)).applyInArrow(words, PIECE)
    about_pairs = by_bucket_.cogroup(known).applyInArrow(to_chunks, PIECE)
    # Answers come back with the chunk in `to` and the bucket in `chunk`.
    back = about_words.select(F.col("chunk").alias("to"), F.col("to").alias("_chunk"), "data", F.lit(1).alias("kind")).unionByName(about_pairs.select(F.col("chunk").alias("to"), F.col("to").alias("_chunk"), "data", F.lit(0).alias("kind")))
    return by_chunk.cogroup(back.groupBy("_chunk")).applyInArrow(score, "doc_id long, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_OUT = pa.schema([("doc_id", pa.int64()), ("learnt", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _doubles(*columns: str):
    """Columns of one row as packed doubles, in order."""

    @F.pandas_udf("binary")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([np.array(r, "<f8").tobytes() for r in rows.itertuples(index=False)], dtype=object)

    return run(F.struct(*columns))


def _saved(key, table):
    return pa.table({"saved": pa.array([float(sum(unpack(x.as_py(), "<u8", "<f4")[1].sum(dtype=float) for x in table.column("data")))])})


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 7 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score by a model of the documents that are not held out."""
    found = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out())
    return found.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_pitman_yor": op4_pitman_yor}
