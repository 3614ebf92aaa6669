"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters. Each has the states clean and toxic; emission weights belong to the
word, its beginnings of 3 to 8 letters and its shape, transition weights to pairs of states.
Marginals of tokens and of pairs of neighbours come from the forward-backward recursion over the
whole text, kept as odds.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table
from .langid import held_out

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled rows that a fit reads, of each label, at most: the documented bound of the sample.
FIT_ROWS = 2500
#: Characters of either label that a fit reads, at most, and the last text whole: the rest of that bound.
FIT_CHARS = 20_000_000
THRESHOLD = 0.7
#: Evidence (in documents' log-likelihood ratio) and purity that mark a feature's tokens as toxic.
EVIDENCE, PURITY = 30.0, 0.9
#: A feature in fewer documents of the sample has no weight of its own.
LEAST = 5
EPOCHS = 60
#: Pairs of neighbours whose expectations are added up at once.
BLOCK = 1 << 18
#: One token in so many, and two at least, show a feature densely.
DENSE = 100
#: Words whose emission a worker remembers.
REMEMBER = 200_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word whole, its beginnings (marked), and whether it is short."""
    return [word, *(word[:n] + "-" for n in range(3, 9) if len(word) > n), "#short" if len(word) < 4 else "#long"]


@dataclass
class Model:
    weights: dict[str, float]
    #: Log potentials of clean to toxic, toxic to clean and toxic to toxic; clean to clean is 0.
    moves: tuple[float, float, float]
    bias: float
    #: The document score's logistic: weights of the log of the expected toxic tokens and of all, and offset.
    score: tuple[float, float, float]

    def emission(self, word: str) -> float:
        """The sum of its features' weights: what no longer beginning can have, as a shorter one has none, isn't asked for."""
        get, size = self.weights.get, len(word)
        total = self.bias + get("#short" if size < 4 else "#long", 0.0)
        for n in range(3, min(size, 9)):
            if (w := get(f"{word[:n]}-")) is None:
                return total
            total += w
        return total + get(word, 0.0)


class Chains:
    """Where the tokens of many sequences lie so that all of them advance together, longest first."""

    def __init__(self, sizes: list[int]):
        n = np.array(sizes, np.int64)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))
        longest = int(n.max()) if len(n) else 0
        width = len(n) - np.searchsorted(np.sort(n), np.arange(longest), side="right")  # sequences that reach each step
        self.start = np.concatenate(([0], np.cumsum(width))).astype(np.int64)
        offset = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(offset, n)
        self.place = self.start[step] + np.repeat(rank, n)
        self.stops = np.cumsum(n)
        self.back: np.ndarray | None = None  # how far before a token's place its neighbour's lies

    def marginals(self, emissions: np.ndarray, moves: tuple[float, float, float]) -> np.ndarray:
        """Probability of the toxic state of each token, all sequences' tokens one after another."""
        return self.expected(emissions, moves)[0]

    def expected(self, emissions: np.ndarray, moves: tuple[float, float, float], pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``marginals``, and with ``pairs`` the expected numbers of moves clean to toxic, toxic to clean, toxic to toxic.

        A sequence begins after a clean token. Weights are taken relative to the clean state, so a
        pair's four cases weigh 1, what goes forward into it times what comes back, and so on.
        """
        e = np.empty(len(emissions))
        e[self.place] = np.exp(np.clip(emissions, -30, 30))
        ct, tc, tt = np.exp(moves)
        fwd, bwd, q = np.empty_like(e), np.ones_like(e), np.zeros(3)
        a = self.start.tolist()
        odds = None
        for lo, hi in zip(a[:-1], a[1:], strict=True):
            odds = fwd[lo:hi] = e[lo:hi] * (ct if odds is None else (ct + tt * odds[: hi - lo]) / (1 + tc * odds[: hi - lo]))
        for t in range(len(a) - 3, -1, -1):
            n = a[t + 2] - a[t + 1]
            after = bwd[a[t + 1] : a[t + 2]] * e[a[t + 1] : a[t + 2]]
            bwd[a[t] : a[t] + n] = (tc + tt * after) / (1 + ct * after)
        own = fwd * bwd
        p = np.where(np.isinf(own), 1.0, own / (1 + own))
        if pairs and len(a) > 1:
            if self.back is None:
                width = np.diff(self.start)
                self.back = np.repeat(width[:-1], width[1:]).astype(np.int32)
            for at in range(a[1], a[-1], BLOCK):
                right = np.arange(at, min(at + BLOCK, a[-1]))
                before, after = fwd[right - self.back[right - a[1]]], bwd[right] * e[right]
                cases = np.stack((ct * after, tc * before, tt * before * after))
                q += (cases / (1 + cases.sum(axis=0))).sum(axis=1)
            q[0] += p[a[0] : a[1]].sum()
        return p[self.place], q

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        return np.split(flat, self.stops[:-1]) if len(self.stops) else []


def clusters(docs: list[np.ndarray], hashes: np.ndarray) -> list[int]:
    """A class for each list of words, the same for near copies: those that share one of 8 min-hashes of word triples."""
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[tuple[int, int], int] = {}
    mix = np.random.default_rng(9).integers(1, 1 << 62, 8, dtype=np.uint64) | np.uint64(1)
    for i, own in enumerate(docs):
        h = hashes[own]
        h = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:] if len(h) > 2 else np.array([h.sum()], np.uint64)
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for j, m in enumerate(mix):
            x = h * m
            k = (j, int((x ^ (x >> np.uint64(32))).min()))
            parent[root(i)] = root(first.setdefault(k, i))
    return [root(i) for i in range(len(docs))]


class Vocabulary:
    """The words of texts and their features as numbers, each word's features in one stretch of an array.

    Texts are read once and not kept: a token takes four bytes.
    """

    def __init__(self, texts: Iterable[str | None]):
        place: dict[str, int] = {}
        self.docs = [np.array([place.setdefault(w, len(place)) for w in tokens(t)], np.int32) for t in texts]
        ids: dict[str, int] = {}
        start, own = array("q", [0]), array("i")
        for w in place:
            own.extend(ids.setdefault(f, len(ids)) for f in features(w))
            start.append(len(own))
        self.words, self.names = list(place), list(ids)
        self.start, self.features = np.frombuffer(start, np.int64), np.frombuffer(own, np.int32) if own else np.zeros(0, np.int32)
        self.hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in place), np.uint64, len(place))

    def shown(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of different words, and how many tokens have each."""
        size = self.start[words + 1] - self.start[words]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[words], size)
        found, owner = np.unique(self.features[at], return_inverse=True)
        return found, np.bincount(owner, np.repeat(counts, size), len(found))


def toxic_features(v: Vocabulary, labels: list[int]) -> np.ndarray:
    """Numbers of the features whose presence marks toxic documents, by log-likelihood ratio and smoothed purity.

    Near copies count once: else the chance words of a text that is copied often would qualify.
    In rounds: toxic documents that hold a marked feature are set aside, and those left are held
    against all clean ones again, until nothing more qualifies. That two tokens of a document, and
    one in DENSE, have a feature may qualify where one token doesn't: families of words show that
    chance words join.
    """
    of: dict[tuple[int, int], list[np.ndarray]] = {}
    for c, own, y in zip(clusters(v.docs, v.hashes), v.docs, labels, strict=True):
        of.setdefault((y, c), []).append(own)
    n = len(v.names)
    clean, n_clean, left = np.zeros(2 * n, np.int64), 0, []
    for (y, _), members in of.items():
        words, counts = _most_of_each(members)
        found, tokens_ = v.shown(words, counts)
        dense = found[tokens_ >= max(2, -(-int(counts.sum()) // DENSE))]
        own = np.concatenate((found, dense + n))  # what one token shows, and what many show
        if y == 0:
            clean[own] += 1
            n_clean += 1
        else:
            left.append(own)
    plain = np.array([f[0] == "#" for f in v.names] * 2, bool)
    marked = np.zeros(2 * n, bool)
    while left:
        new = _marking(np.bincount(np.concatenate(left), minlength=2 * n), clean, len(left), n_clean) & ~plain
        if not new.any():
            break
        marked |= new
        left = [own for own in left if not new[own].any()]
    return np.unique(np.flatnonzero(marked) % max(1, n))


def _most_of_each(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different words of token lists, and how often each stands in the list that has most of it."""
    each = [np.unique(x, return_counts=True) for x in members]
    if len(each) == 1:
        return each[0]
    words, owner = np.unique(np.concatenate([w for w, _ in each]), return_inverse=True)
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, owner, np.concatenate([k for _, k in each]))
    return words, most


def _marking(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features' counts, of ``n_toxic`` and ``n_clean`` documents, reach EVIDENCE and PURITY."""
    base = n_toxic / max(1, n_toxic + n_clean)
    if base == 1:
        return np.zeros(len(toxic), bool)
    n, k = (toxic + clean).astype(float), toxic.astype(float)
    term = lambda part, share: np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(n * share, 1e-9)), 0.0)
    return (n >= LEAST) & ((k + 0.5) / (n + 1) >= PURITY) & (2 * (term(k, base) + term(n - k, 1 - base)) >= EVIDENCE)


def fit(docs: Iterable[tuple[str | None, int]]) -> Model:
    """Train on (text, label): token labels from toxic features, then weights by gradient ascent over whole texts, then the score."""
    labels: list[int] = []

    def texts():
        for text, y in docs:
            labels.append(int(y))
            yield text

    v = Vocabulary(texts())
    mark = np.zeros(len(v.names), bool)
    mark[toxic_features(v, labels)] = True
    of_word = np.repeat(np.arange(len(v.words)), np.diff(v.start))
    word_toxic = np.bincount(of_word, mark[v.features], len(v.words)) > 0
    df = np.zeros(len(v.names), np.int64)
    for own in v.docs:
        if len(own):
            df[v.shown(*np.unique(own, return_counts=True))[0]] += 1
    order = sorted(np.flatnonzero(df >= LEAST).tolist(), key=v.names.__getitem__)
    names = [v.names[i] for i in order]
    number = np.full(len(v.names), -1, np.int64)
    number[order] = np.arange(len(order))
    # Features belong to words, tokens refer to words: whole texts fit, at a few numbers a token.
    feature = number[v.features]
    owner, feature = of_word[feature >= 0], feature[feature >= 0]
    whole = [(own, y) for own, y in zip(v.docs, labels, strict=True) if len(own)]
    sizes = [len(own) for own, _ in whole]
    word = np.concatenate([own for own, _ in whole]) if whole else np.zeros(0, np.int32)
    y = (word_toxic[word] & np.repeat(np.array([y == 1 for _, y in whole], bool), sizes)).astype(np.float64)
    weights, bias, moves = np.zeros(len(names)), -4.0, np.zeros(3)
    square = {"w": np.full(len(names), 1e-6), "b": 1e-6, "m": np.full(3, 1e-6)}
    chains, n_words = Chains(sizes), len(v.words)
    first, ends = chains.stops - np.array(sizes, np.int64), np.zeros(len(y), bool)
    ends[chains.stops - 1] = True
    pair = np.flatnonzero(~ends)
    truth = np.array([((1 - y[pair]) * y[pair + 1]).sum() + y[first].sum() if len(y) else 0.0, (y[pair] * (1 - y[pair + 1])).sum(), (y[pair] * y[pair + 1]).sum()]) if len(y) else np.zeros(3)
    for _ in range(EPOCHS if len(y) else 0):
        emit = np.bincount(owner, weights[feature], n_words)[word] + bias
        p, q = chains.expected(emit, tuple(moves), pairs=True)
        g = np.bincount(feature, np.bincount(word, y - p, n_words)[owner], len(names)) - 0.05 * weights
        gb, gm = (y - p).sum(), truth - q - 0.5 * moves
        square["w"] += g * g
        square["b"] += gb * gb
        square["m"] += gm * gm
        weights += 0.5 * g / np.sqrt(square["w"])
        bias += 0.5 * gb / math.sqrt(square["b"])
        moves += 0.2 * gm / np.sqrt(square["m"])
    model = Model(dict(zip(names, weights.tolist(), strict=True)), tuple(float(m) for m in moves), float(bias), (1.0, 0.0, 0.0))
    marginals = Chains([len(own) for own in v.docs])
    emit = np.bincount(owner, weights[feature], n_words) + bias
    flat = marginals.marginals(emit[np.concatenate(v.docs)] if v.docs else np.zeros(0), model.moves)
    return _calibrated(model, marginals.split(flat), labels)


def evidence(p: np.ndarray) -> float:
    """Log of the expected number of toxic tokens among those more likely toxic than not.

    Without that bound the tiny marginals of a long text's clean tokens would add up to evidence.
    """
    return math.log(0.05 + float(p[p >= 0.5].sum()))


def toxic_odds(docs: list[list[str]], model: Model, emit: dict[str, float]) -> list[np.ndarray]:
    """Toxic marginals of each token list; ``emit`` remembers words' emissions."""
    if len(emit) > REMEMBER:
        emit.clear()
    for w in set(chain.from_iterable(docs)) - emit.keys():
        emit[w] = model.emission(w)
    chains = Chains([len(words) for words in docs])
    flat = np.fromiter(map(emit.__getitem__, chain.from_iterable(docs)), np.float64, len(chains.place))
    return chains.split(chains.marginals(flat, model.moves))


def document_score(model: Model, p: np.ndarray) -> float:
    """Probability that a text is toxic, from its tokens' marginals: their evidence, held against the text's length."""
    weight, length, offset = model.score
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, weight * evidence(p) + length * math.log(len(p) + 10) + offset))))


def _calibrated(model: Model, marginals: list[np.ndarray], labels: list[int]) -> Model:
    x = np.array([(evidence(p), math.log(len(p) + 10)) for p in marginals]).reshape(-1, 2)
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        model.score = (1.0, 0.0, -3.0)
        return model
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, a, b = (x - mean) / spread, np.array([1.0, 0.0]), 0.0
    for _ in range(600):
        d = y - 1 / (1 + np.exp(-(z @ a + b)))
        a = a + 0.5 * ((d[:, None] * z).mean(axis=0) * 4 - 0.002 * a)
        b += 0.5 * (d.mean() * 4)
    a = a / spread
    model.score = (float(a[0]), float(a[1]), float(b - a @ mean))
    return model


def sample(docs: DataFrame, labels: DataFrame) -> Iterator[tuple[str | None, int]]:
    """Up to FIT_ROWS (text, label) of either label, the same ones at every run: by hash of the id.

    Only rows outside the held-out part are read. Ids come first and are few by the bound; their
    texts are then found by a broadcast of those ids. A doc_id that repeats counts once, with its
    least text, and is toxic if any of its labels says so. Null ids and other labels aren't read; no
    labels give nothing. Rows come one at a time, and none is held here.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(parts=3, part=1))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    for label in (0, 1):
        if not sizes.get(label):
            continue
        share = min(1.0, 1.3 * FIT_ROWS / sizes[label] + 1e-4)
        some = own.where(F.col("toxic") == label).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("doc_id")
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
        chars = 0
        for (text,) in rows.select("text").toLocalIterator():
            yield text, label
            chars += len(text or "")
            if chars >= FIT_CHARS:
                break


def tag(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score, spans) of every row of ``docs(text, *keep)``; spans are code points, end exclusive.

    A span is a run of tokens that are toxic with a probability of a half or more, with the largest
    of them. Null and empty texts have the score of no evidence and no spans. Whole texts are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def one(batches):
        model = held.value
        emit: dict[str, float] = {}
        for b in batches:
            texts = b.column(0).to_pylist()
            found = [tokens(t) for t in texts]
            scores, spans = [], []
            for text, p in zip(texts, toxic_odds(found, model, emit), strict=True):
                scores.append(document_score(model, p))
                spans.append(_spans(text.lower(), text, p) if len(p) and p.max() >= 0.5 else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64()), pa.array(spans, kind)], [*b.schema.names[1:], "score", "spans"])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *(F.col(k) for k in keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), "score double", "spans array<struct<start:int,stop:int,p:double>>"])
    return map_arrow(rows, one, schema)


def _spans(lower: str, text: str, p: np.ndarray) -> list[dict]:
    at = [m.span() for m in TOKEN.finditer(lower)]
    if len(lower) != len(text):  # lower-casing may lengthen a letter: places are those of the text
        own = [i for i, c in enumerate(text) for _ in c.lower()]
        at = [(own[a], own[b - 1] + 1) for a, b in at]
    out: list[dict] = []
    before = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i == before + 1:
            out[-1] |= {"stop": at[i][1], "p": max(out[-1]["p"], float(p[i]))}
        else:
            out.append({"start": at[i][0], "stop": at[i][1], "p": float(p[i])})
        before = i
    return out


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of ``documents``.

    Null, empty and wordless texts have the score of no evidence; repeated rows and null doc_ids
    each come back (a null id isn't held out); no documents give no rows; with no labels to learn
    from every score is that of no evidence, under THRESHOLD. Texts of any length are read whole.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(sample(docs, table(spark, sf_dir, "labels")))
    scored = tag(docs.withColumn("held_out", held_out(parts=3, part=1)), model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
