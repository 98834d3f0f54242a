"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The gap-weighted subsequence kernel of two words sums, over all triples of
characters that occur in both in order, the product of their weights; a triple
spread over *s* characters weighs ``DECAY ** s``. Inserted characters and gaps
so cost weight but do not hide a word. Kernels are normalised and raised to
``SHARPEN``. A word is mapped to its kernels with a fixed set of landmark words,
whitened by their own kernel matrix (Nyström), and scored by a linear support
vector machine. A text's words give its measures (best word, second best, share and
count of words with a clearly positive margin), and a logistic fit makes them
a score between 0 and 1.

Labels are of whole texts, so the words that make a text toxic are found by
turns: start from character n-grams that mark toxic texts, train on the best
words of toxic texts against the best and other words of clean ones, choose the
best words anew with the trained machine.

The fit uses a bounded sample of labelled rows: at most ``SAMPLE`` of either
label, chosen by a hash of the id, of at most ``SAMPLE_CHARS`` characters each.
Scoring covers every whole text.

Edge cases: a null or empty text has no words and scores as one whose measures
are at their lowest. If the labelled sample lacks one of the labels, the score
is the share of toxic labels (0 without labels). Repeated rows are scored as
often as they come.
"""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ngram_hashes, word_hashes

DECAY, SPAN, SHARPEN = 0.7, 5, 3
LANDMARKS = 128
#: By round, the share of clean texts whose best word a word of a toxic text must exceed to count as its mark.
USUAL = (0.5, 0.9, 0.9)
SAMPLE, SAMPLE_CHARS = 1500, 20_000
CLEAR = 0.3
LONGEST = 32  # a longer word is read in overlapping parts of this many characters
THRESHOLD = 0.7
CLASSES = 128  # letters have a class each, other characters share the rest
KEPT_WORDS = 400_000

_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
_MARKS = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased blank-separated words; runs of four or more single characters also count as one word."""
    if not text:
        return []
    low = text.lower()
    return low.split() + ["".join(m.split()) for m in _SPELLED.findall(low)]


def units_of(word: str) -> list[str]:
    """A word without its marks (and the parts between marks inside it), in overlapping parts if it is long."""
    parts = _MARKS.split(word)
    whole = "".join(parts)
    units, step = [], LONGEST // 2
    for bare in dict.fromkeys([whole, *parts]):
        if len(bare) > LONGEST:
            units += [bare[i:i + LONGEST] for i in range(0, len(bare) - step, step)]
        elif len(bare) > 2:
            units.append(bare)
    return units


def triples(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit number, code, weight) of every triple of characters within ``SPAN``; a mark stands before each unit."""
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1
    points = np.frombuffer("".join("\x00" + u for u in units).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    letter = (points >= 97) & (points <= 122)
    classes = np.where(points == 0, 26, np.where(letter, points - 97, 27 + points * 31 % (CLASSES - 27)))
    owner = np.repeat(np.arange(len(units)), lengths)
    last = np.cumsum(lengths)[owner]  # one past the end of the unit
    place = np.arange(len(classes))
    who, codes, weights = [], [], []
    for j in range(1, SPAN - 1):
        for k in range(j + 1, SPAN):
            at = place[place + k < last]
            who.append(owner[at])
            codes.append((classes[at] * CLASSES + classes[at + j]) * CLASSES + classes[at + k])
            weights.append(np.full(len(at), DECAY ** (k + 1), dtype=np.float32))
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return np.concatenate(who), np.concatenate(codes), np.concatenate(weights)


def profiles(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, code, share) with equal triples of a unit put together and shares of unit length."""
    who, codes, weights = triples(units)
    key = who * CLASSES ** 3 + codes
    distinct, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, weights=weights, minlength=len(distinct))
    who, codes = distinct // CLASSES ** 3, distinct % CLASSES ** 3
    norm = np.sqrt(np.bincount(who, weights=total ** 2, minlength=len(units)))
    return who, codes, (total / norm[who]).astype(np.float32)


@dataclass
class Kernel:
    """Normalised subsequence kernels of words with landmarks; the landmarks' triples are a small matrix."""

    codes: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, landmarks: list[str]) -> Kernel:
        who, codes, share = profiles(landmarks)
        distinct, place = np.unique(codes, return_inverse=True)
        matrix = np.zeros((len(distinct), len(landmarks)), dtype=np.float32)
        matrix[place, who] = share
        return cls(distinct, matrix)

    def __call__(self, units: list[str], batch: int = 256) -> np.ndarray:
        out = np.zeros((len(units), self.shares.shape[1]), dtype=np.float32)
        for lo in range(0, len(units), batch):  # a batch of units as a small matrix over the landmarks' triples
            some = units[lo:lo + batch]
            who, codes, share = profiles(some)
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[at] == codes
            matrix = np.zeros((len(some), len(self.codes)), dtype=np.float32)
            matrix[who[known], at[known]] = share[known]
            out[lo:lo + len(some)] = matrix @ self.shares
        out **= SHARPEN
        return out


@dataclass
class Model:
    """``weights`` already include the Nyström whitening; without a kernel every text has the prior."""

    prior: float
    kernel: Kernel | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    fit: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    def margins(self, units: list[str], batch: int = 1 << 14) -> np.ndarray:
        parts = [self.kernel(units[lo:lo + batch]) @ self.weights + np.float32(self.bias) for lo in range(0, len(units), batch)]
        return np.round(np.concatenate([np.empty(0, dtype=np.float32), *parts]), 5)  # alike in any batch

    def score(self, measures: np.ndarray) -> np.ndarray:
        z = ((measures - self.centre) / self.scale) @ self.fit[1:] + self.fit[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def measures_of(margins: np.ndarray) -> tuple[float, float, float, float]:
    """Best and second best margin (clipped to -2..2), and of words with a clearly positive one the root of their share and the log of their count."""
    if not len(margins):
        return -2.0, -2.0, 0.0, 0.0
    top = np.sort(margins)[-2:] if len(margins) < 3 else np.partition(margins, -2)[-2:]
    top = np.clip(top, -2, 2)
    return float(top[-1]), float(top[-2] if len(top) > 1 else -2.0), float(np.sqrt(np.mean(margins > CLEAR))), float(np.log1p(np.sum(margins > CLEAR)))


def _support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, decay: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.diag(np.r_[np.full(x.shape[1] - 1, decay), 1e-6])

    def loss(v):
        slack = np.maximum(0, 1 - y * (x @ v))
        return 0.5 * v @ ridge @ v + 0.5 * np.sum(cost * slack ** 2)

    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        gradient = ridge @ w - xa.T @ (ca * (y[active] - xa @ w))
        step = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, decay: float = 0.05, steps: int = 50) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = decay * np.diag(np.r_[1e-3, np.ones(x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (cost * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (cost * (p - y)) + ridge @ w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Character n-grams (4 to 6, with the start mark) of every word, which has three characters at least: their numbers, word
    after word, where each word's begin, and how many different ones there are."""
    lengths = np.fromiter(map(len, vocabulary), dtype=np.int32, count=len(vocabulary)) + 1
    points = np.frombuffer("".join("^" + v for v in vocabulary).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(ends[-1])  # characters from a place to the end of its word

    def pairs(first: np.ndarray, second: np.ndarray, n: int, by: int) -> np.ndarray:
        """Numbers of the n-grams whose first part starts at a place and whose second ``by`` places on; elsewhere 0."""
        at = np.flatnonzero(left >= n)
        both = first[at].astype(np.int64) * (int(second.max()) + 1) + second[at + by]
        out = np.zeros(len(left), dtype=np.int32)
        out[at] = np.unique(both, return_inverse=True)[1]
        return out

    one = np.unique(points, return_inverse=True)[1].astype(np.int32)
    two = pairs(one, one, 2, 1)
    four = pairs(two, two, 4, 2)
    counts = sum(np.maximum(0, lengths - n + 1) for n in (4, 5, 6))
    begins = np.r_[0, np.cumsum(counts)]
    grams, filled, total = np.empty(begins[-1], dtype=np.int32), begins[:-1].copy(), 0
    for n, numbers in ((4, four), (5, None), (6, None)):
        numbers = pairs(four, one if n == 5 else two, n, 4) if numbers is None else numbers
        own = np.maximum(0, lengths - n + 1)
        grams[np.repeat(filled - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum())] = numbers[left >= n] + total
        filled, total = filled + own, total + int(numbers.max(initial=0)) + 1
    return grams, begins, total


def _first_scores(vocabulary: list[str], docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per word, how much its best character n-gram speaks for toxic texts."""
    grams, begins, n_grams = _grams(vocabulary)  # as arrays: as strings, the n-grams take some hundred MB of the driver
    counts = np.zeros((2, n_grams))
    for words, label in zip(docs, y):
        if len(words):
            counts[label, np.unique(np.concatenate([grams[begins[w]:begins[w + 1]] for w in words]))] += 1
    n0, n1 = np.sum(y == 0), np.sum(y == 1)
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    odds -= 1.64 * np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))  # lower bound: rare n-grams say little
    return np.maximum.reduceat(odds[grams], begins[:-1])


def _with_insertion(word: str, rng: np.random.Generator) -> str:
    """The word with a letter repeated, a digit or another letter inserted somewhere inside."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + str(rng.choice([word[at], "x", "0", "1", "e"])) + word[at:]


def _landmarks(vocabulary: list[str], counts: np.ndarray, most: int = LANDMARKS // 2) -> list[str]:
    """Words that are counted often and unlike those chosen before (pivoted Cholesky of the kernel matrix)."""
    pick = np.argsort(-counts, kind="stable")[:10 * most]
    pick = pick[counts[pick] > 0]
    words = [vocabulary[i] for i in pick]
    matrix, importance = Kernel.of(words)(words).astype(np.float64), np.sqrt(counts[pick])
    rest, rows, chosen = np.diag(matrix).copy(), [], []
    for _ in range(min(most, len(words))):
        i = int(np.argmax(rest * importance))
        if rest[i] < 0.05:
            break
        row = matrix[i] - sum(r[i] * r for r in rows)
        rows.append(row / np.sqrt(rest[i]))
        rest = np.maximum(0, rest - rows[-1] ** 2)
        chosen.append(words[i])
    return chosen


def _without_copies(docs: list[list[str]]) -> list[int]:
    """Places of texts that are not near copies of earlier ones: half of eight minimum hashes of word pairs must not agree."""
    seen: list[dict[int, set[int]]] = [{} for _ in range(8)]
    factors = np.random.default_rng(1).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
    kept = []
    for i, words in enumerate(docs):
        pairs = ngram_hashes(word_hashes(" ".join(words)), 2)
        if len(pairs):
            mins = [int((pairs * f).min()) for f in factors]
            met = Counter(k for table, m in zip(seen, mins) for k in table.get(m, ()))
            if any(n >= 4 for n in met.values()):
                continue
            for table, m in zip(seen, mins):
                table.setdefault(m, set()).add(i)
        kept.append(i)
    return kept


def train(docs: list[list[str]], labels: list[int], prior: float, seed: int = 7) -> Model:
    """Fit on the words of labelled texts; ``prior`` is the share of toxic labels among all learnable rows."""
    kept = _without_copies(docs)  # a group of copies would make any of its words look like a mark of its label
    docs, y = [docs[i] for i in kept], np.array([labels[i] for i in kept], dtype=np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return Model(prior=float(prior))
    numbers: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    own = []
    for d in docs:
        for w in d:
            if w not in of_word:
                of_word[w] = [numbers.setdefault(u, len(numbers)) for u in units_of(w)]
        own.append(np.array([u for w in d for u in of_word[w]], dtype=np.int64))
    del docs, of_word
    vocabulary, rng = list(numbers), np.random.default_rng(seed)
    distinct = [np.unique(d) for d in own]
    if not vocabulary:
        return Model(prior=float(prior))
    score = _first_scores(vocabulary, distinct, y)
    model = None
    for cut in USUAL:
        good, bad = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
        clean_best = np.array([score[d].max() for d, t in zip(distinct, y) if t == 0 and len(d)])
        usual = np.quantile(clean_best, cut) if len(clean_best) else -np.inf
        for d, toxic in zip(distinct, y):
            if not len(d):
                continue
            best = d[np.argsort(score[d], kind="stable")[::-1][:3]]
            if toxic:
                good[best[score[best] > usual]] += 1  # the others are as good as the best of clean texts: noise
            else:
                bad[best] += 1
                bad[rng.choice(d, size=min(4, len(d)), replace=False)] += 1
        good[(bad >= good) & (good > 0)] = 0
        pick = np.flatnonzero((good > 0) | (bad > 0))
        if not (good > 0).any():
            break
        target = np.where(good[pick] > 0, 1.0, -1.0)
        landmarks = _landmarks(vocabulary, good) + _landmarks(vocabulary, np.where(good > 0, 0, bad))
        kernel = Kernel.of(landmarks)
        values, vectors = np.linalg.eigh(kernel(landmarks).astype(np.float64))
        keep = values > 1e-4
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        weight = np.where(target > 0, good[pick], bad[pick])
        cost = np.where(target > 0, weight / weight[target > 0].sum(), weight / weight[target < 0].sum()) * 500
        words = [vocabulary[i] for i in pick]
        spoilt = [_with_insertion(words[i], rng) for i in np.flatnonzero(target > 0)]  # learnt too, at half the cost
        w = _support_vectors(kernel(words + spoilt) @ whiten, np.r_[target, np.ones(len(spoilt))], np.r_[cost, cost[target > 0] / 2])
        model = Model(prior=float(prior), kernel=kernel, weights=(whiten @ w[:-1]).astype(np.float32), bias=float(w[-1]))
        score = model.margins(vocabulary)
    if model is None:
        return Model(prior=float(prior))
    x = np.array([measures_of(score[d]) for d in own])
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    cost = np.where(y == 1, prior / np.mean(y == 1), (1 - prior) / np.mean(y == 0))
    model.fit = _logistic((x - model.centre) / model.scale, y, cost)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled rows whose crc32(id as text) mod 3 is not 1; see the module for the bounded sample."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__toxic"))
    known = known.where(F.crc32(F.col("__key").cast("string").cast("binary")) % 3 != 1)
    counts = {r["__toxic"]: r["count"] for r in known.where("__toxic IN (0, 1)").groupBy("__toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = [known.where(F.col("__toxic") == t).orderBy(F.xxhash64("__key"), "__key").limit(SAMPLE) for t in (0, 1)]
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length("__text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "__key").dropDuplicates(["__key"]).orderBy("__key").collect()  # at most 2 * SAMPLE ids
    words, labels, same = [], [], {}
    while rows:  # the driver keeps one string per different word, and no text
        row = rows.pop()
        words.append([same.setdefault(w, w) for w in words_of(row["__text"])])
        labels.append(row["__toxic"])
    del same
    return train(words[::-1], labels[::-1], prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = sys.modules.setdefault("parley_worker_state", types.ModuleType("parley_worker_state"))
        kept: dict[str, float] = {}
        of_units: dict[str, float] = {}
        if model.kernel is not None:  # margins of words are kept from task to task of a worker while the model is the same
            mark = (model.weights.tobytes(), model.bias)
            if state.__dict__.get("toxicity_model") != mark:
                state.toxicity_model, state.toxicity_words, state.toxicity_units = mark, {}, {}
            kept, of_units = state.toxicity_words, state.toxicity_units

        def scores(texts: list[str | None]) -> np.ndarray:
            if model.kernel is None:
                return np.full(len(texts), model.prior)
            for known in (kept, of_units):
                if len(known) > KEPT_WORDS:  # the newer half goes; frequent ones come early
                    for w in list(known)[KEPT_WORDS // 2:]:
                        del known[w]
            split = [words_of(t) for t in texts]
            new = [w for w in set().union(*split) if w not in kept]
            parts = [units_of(w) for w in new]
            units = list({u for p in parts for u in p if u not in of_units})  # words differ by marks that units have not
            of_units.update(zip(units, model.margins(units).tolist()))
            kept.update((w, max((of_units[u] for u in p), default=np.nan)) for w, p in zip(new, parts))
            out = np.empty((len(texts), 4))
            for i, words in enumerate(split):
                margins = np.fromiter(map(kept.__getitem__, words), dtype=np.float64, count=len(words))
                out[i] = measures_of(margins[~np.isnan(margins)])
            return model.score(out)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [scores(texts[lo:lo + 512]) for lo in range(0, len(texts), 512)]
            values = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["key", "score"])

    return rows.mapInArrow(run, f"key {kind.simpleString()}, score double").withColumnRenamed("key", key)


def reject(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    model = fit(docs, labels, key, text)
    return score_rows(docs, model, text).where(F.col("__score") < threshold).drop("__score")


def score_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``__score``, in one pass without a join."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    packed = inner.select(F.struct(*inner.columns).alias("row"), F.col(f"c{names.index(text)}").alias("text"))
    return score(packed, model, "row", "text").select("row.*", F.col("score").alias("__score")).toDF(*names, "__score")
