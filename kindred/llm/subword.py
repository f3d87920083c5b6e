"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, into a softmax.

Vectors and softmax are trained jointly by stochastic gradient descent in numpy. A word's vector is the mean of its
n-gram vectors and its own; a passage's vector is the mean of its words. An unseen spelling shares most n-grams with the
spellings that were seen. Averages and softmax are linear up to the last step, so scoring needs one number per bucket.
A text takes the softmax of its highest passage, rescaled by a logistic calibration of that one number.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, strings, widened

PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Config:
    """``passage`` words are averaged at a time, 0 for the whole text. ``same`` makes a word that repeats the one before a token of its own.

    ``rows`` labelled rows of each class and ``sample_bytes`` of their texts in all bound the training sample.
    """

    lower: bool = True
    passage: int = 0
    grams: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 17
    dim: int = 8
    epochs: int = 6
    rate: float = 0.5
    batch: int = 64
    rows: int = 2000
    sample_bytes: int = 16 << 20
    calibrate: float = 0.25
    clean: float = 0.999
    same: bool = False
    seed: int = 7


def word_buckets(words: list[str], config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of all words, where each word's begin); the last bucket of a word is the word's own."""
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    index = np.arange(len(flat))
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    rolled, n = flat.copy(), 1
    with np.errstate(over="ignore"):
        while n < max(config.grams):
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + flat[n:]
            n += 1
            if n in config.grams:
                valid = index[: len(rolled)] + n <= ends[: len(rolled)]
                found.append(rolled[valid] * PRIME + np.uint64(n))
                owners.append(owner[: len(rolled)][valid])
        place = (index - np.repeat(starts, lengths)).astype(np.uint64)
        whole = np.add.reduceat((flat + place * PRIME) * (place * np.uint64(2) + PRIME), starts)
        found.append(whole * PRIME)
        owners.append(np.arange(len(words)))
        keys, owners = np.concatenate(found), np.concatenate(owners)
        keys = ((keys ^ (keys >> np.uint64(29))) * PRIME) >> np.uint64(32)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return (keys[order] % np.uint64(config.buckets)).astype(np.int64), np.cumsum(counts) - counts


#: Stands for a word that repeats the word before it, so that repetition is a feature of its own.
SAME = "\x02"


def tokens(text: str, config: Config) -> list[str]:
    words = (text.lower() if config.lower else text).split()
    if not config.same:
        return words
    return words[:1] + [SAME if w == before else w for before, w in zip(words, words[1:])]  # noqa: B905


def passages(n: int, size: int) -> list[tuple[int, int]]:
    """Runs of ``size`` words that cover n words, the last one whole; one run if n is smaller or size is 0."""
    if not size or n <= size:
        return [(0, n)] if n else []
    return [(s, s + size) for s in [*range(0, n - size, size), n - size]]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ... in one array."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Corpus:
    """Passages as index arrays: word types of each, and the buckets of each type. Words are numbered as they come, so that
    no list of them is held, and the types' buckets are made a few thousand types at a time."""

    def __init__(self, texts: Iterable[list[str]], config: Config):
        types: dict[str, int] = {}
        flat, sizes, owner = array("i"), array("i"), array("i")
        for i, words in enumerate(texts):
            for a, b in passages(len(words), config.passage):
                flat.extend([types.setdefault(w, len(types)) for w in words[a:b]])
                sizes.append(b - a)
                owner.append(i)
        self.words, self.sizes, self.owner = (np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (flat, sizes, owner))
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        every = list(types)
        parts = [word_buckets(every[i : i + 4096], config) for i in range(0, len(every), 4096)]
        self.buckets = np.concatenate([np.empty(0, np.int32), *[b.astype(np.int32) for b, _ in parts]])
        counts = [np.diff(np.r_[starts, len(b)]) for b, starts in parts]
        self.type_sizes = np.concatenate([np.empty(0, np.int64), *counts])
        self.type_starts = np.cumsum(self.type_sizes) - self.type_sizes

    def raw(self, state) -> np.ndarray:
        """Log odds of each passage."""
        table, bias = _table(state)
        by_type = np.add.reduceat(table[self.buckets], self.type_starts) / self.type_sizes
        return bias + np.add.reduceat(by_type[self.words], self.starts) / self.sizes


def _table(state) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds, and their bias."""
    vectors, soft, bias = state
    return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def _balanced(labels: np.ndarray) -> np.ndarray:
    """Weights that give both classes half of the whole."""
    return np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)


def train(corpus: Corpus, use: np.ndarray, labels: np.ndarray, config: Config):
    """(vectors, softmax weights, bias) by SGD with per-row adaptive rates over the passages ``use``."""
    rng = np.random.default_rng(config.seed)
    d = config.dim
    vectors = rng.uniform(-1 / d, 1 / d, (config.buckets, d))
    soft, bias = rng.uniform(-0.5, 0.5, (d, 2)), np.zeros(2)
    seen, soft_seen = np.full(config.buckets, 1e-3), 1e-3
    weights = np.zeros(len(labels))
    weights[use] = _balanced(labels[use])
    for _ in range(config.epochs):
        order = rng.permutation(use)
        for at in range(0, len(order), config.batch):
            b = order[at : at + config.batch]
            sizes = corpus.sizes[b]
            types, words = np.unique(corpus.words[_ranges(corpus.starts[b], sizes)], return_inverse=True)
            type_sizes = corpus.type_sizes[types]
            used, grams = np.unique(corpus.buckets[_ranges(corpus.type_starts[types], type_sizes)], return_inverse=True)
            typed = np.add.reduceat(vectors[used][grams], np.cumsum(type_sizes) - type_sizes) / type_sizes[:, None]
            mean = np.add.reduceat(typed[words], np.cumsum(sizes) - sizes) / sizes[:, None]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.eye(2)[labels[b]]) * (weights[b] / weights[b].sum())[:, None]
            spread = np.repeat(error @ soft.T / sizes[:, None], sizes, axis=0)
            by_type = np.stack([np.bincount(words, spread[:, j], len(types)) for j in range(d)], 1) / type_sizes[:, None]
            spread = np.repeat(by_type, type_sizes, axis=0)
            slope = np.stack([np.bincount(grams, spread[:, j], len(used)) for j in range(d)], 1)
            seen[used] += (slope**2).mean(1) * 1e4
            vectors[used] -= config.rate * 10 * slope / np.sqrt(seen[used])[:, None]
            g = mean.T @ error
            soft_seen += float((g**2).mean())
            soft -= config.rate * g / np.sqrt(soft_seen)
            bias -= config.rate * error.sum(0)
    return vectors, soft, bias


@dataclass
class Model:
    """One number per bucket, a bias, and the slope and offset that rescale the log odds of a text."""

    config: Config
    table: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, texts: list[str]) -> np.ndarray:
        """Log odds of the highest passage of each text, at any word; the bias alone for a text without words."""
        types: dict[str, int] = {}
        flat: list[int] = []
        counts = []
        for text in texts:
            words = tokens(text, self.config)
            counts.append(len(words))
            flat += [types.setdefault(w, len(types)) for w in words]
        out = np.full(len(texts), self.bias)
        if not flat:
            return out
        every, by_type = list(types), np.empty(len(types))
        for i in range(0, len(every), 4096):  # a few thousand words at a time, since their n-grams take most of the memory
            buckets, starts = word_buckets(every[i : i + 4096], self.config)
            by_type[i : i + len(starts)] = np.add.reduceat(self.table[buckets], starts) / np.diff(np.r_[starts, len(buckets)])
        total = np.r_[0.0, np.cumsum(by_type[np.array(flat, np.int64)])]
        n = np.array(counts, np.int64)
        first = np.cumsum(n) - n
        wide = np.minimum(n, self.config.passage or n.max())
        some = np.flatnonzero(n)
        places = n[some] - wide[some] + 1  # passages of each text
        at, size = _ranges(first[some], places), np.repeat(wide[some], places)
        out[some] += np.maximum.reduceat((total[at + size] - total[at]) / size, np.cumsum(places) - places)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) * self.slope + self.offset, -40, 40)))


def _calibrate(model: Model, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """A logistic fit of label on log odds with smoothed targets and a light ridge, by Newton steps."""
    n1, n0 = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, scale = raw.mean(), max(raw.std(), 1e-9)
    x = np.column_stack([(raw - centre) / scale, np.ones(len(raw))])
    ridge = np.diag([0.3, 1e-3])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weights * (p - target)) + ridge @ beta
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge
        beta = beta - np.clip(np.linalg.solve(h, g), -2, 2)
    model.slope = float(beta[0] / scale)
    model.offset = float(beta[1] - beta[0] * centre / scale)


def _shown(corpus: Corpus, owner: np.ndarray, labels: np.ndarray, config: Config, rng) -> np.ndarray:
    """Labels of passages: 1 for those of a text of class 1 that show it.

    Half of the texts train a model with their texts' labels, and the other half's passages count as showing the class if
    that model puts them above nearly all (``clean``) of that half's passages of class 0. What a model learned by heart
    from one half isn't confirmed by the other.
    """
    half = (rng.random(owner.max() + 1) < 0.5)[owner]
    over = np.zeros(len(labels), bool)
    for mine in (half, ~half):
        if min((labels[mine] == c).sum() for c in (0, 1)) and (labels[~mine] == 0).any():
            raw = corpus.raw(train(corpus, np.flatnonzero(mine), labels, config))
            over |= ~mine & (raw > np.quantile(raw[~mine & (labels == 0)], config.clean))
    found = (labels == 1) & over
    return found.astype(np.int64) if found.any() else labels


def fit(texts: list[str], labels: list[int], share: dict[int, float], config: Config) -> Model:
    """Trains on most rows and calibrates on the rest. ``share``: how many rows each sampled row of a class stands for."""
    y = np.array(labels, np.int64)
    rng = np.random.default_rng(config.seed)
    aside = rng.random(len(y)) < config.calibrate
    if min((y[aside] == c).sum() for c in (0, 1)) < 10:
        aside[:] = False
    used = np.flatnonzero(~aside)
    corpus = Corpus((tokens(texts[i], config) for i in used), config)
    owner = used[corpus.owner]
    label = y[owner]
    if len(set(label.tolist())) < 2:
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        return Model(config, np.zeros(config.buckets), float(np.log(rate / (1 - rate))))
    if config.passage:
        label = _shown(corpus, owner, label, config, rng)
    model = Model(config, *_table(train(corpus, np.arange(len(label)), label, config)))
    held = aside if aside.any() else np.ones(len(y), bool)
    weights = np.array([share[c] for c in y[held].tolist()])
    _calibrate(model, np.concatenate([model.raw([texts[i]]) for i in np.flatnonzero(held)]), y[held], weights / weights.mean())
    return model


def sample(documents: DataFrame, labels: DataFrame, label: str, config: Config, key: str, text: str, usable: Column) -> tuple[list[str], list[int], dict[int, float]]:
    """A bounded sample of labelled rows in the order of a hash of the key, and what a row of each class stands for.

    Rows without a 0 or 1 label or with ``usable`` false are not taken. Keys and lengths of at most 2 * rows texts come to
    the driver first; then the whole texts of those that fit into sample_bytes. Of labels that contradict each other under
    one key the greatest counts, of texts that share a key the greatest.
    """
    known = labels.filter(F.col(label).isin(0, 1) & usable).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ranked = [known.filter(F.col("y") == c).orderBy(F.xxhash64("key"), "key").limit(config.rows) for c in (0, 1)]
    some = ranked[0].unionByName(ranked[1])
    chosen = {r["key"]: r["y"] for r in some.collect()}
    if not chosen:
        return [], [], {0: 1.0, 1: 1.0}
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    pick = lambda keys: F.broadcast(spark.createDataFrame([(k,) for k in keys], f"key {kind}"))
    body = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sizes = body.join(pick(chosen), "key", "left_semi").groupBy("key").agg(F.max(F.octet_length("text")).alias("size")).collect()
    taken, room = [], config.sample_bytes
    rank = {k: i for i, k in enumerate(sorted(chosen, key=lambda k: (zlib.crc32(f'{config.seed}:{k}'.encode()), str(k))))}
    for r in sorted(sizes, key=lambda r: rank[r["key"]]):
        if r["size"] <= room:
            taken.append(r["key"])
            room -= r["size"]
    if not taken:
        return [], [], {0: 1.0, 1: 1.0}
    rows = body.join(pick(taken), "key", "left_semi").groupBy("key").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: rank[r["key"]])
    y = [chosen[r["key"]] for r in rows]
    return [r["text"] for r in rows], y, {c: totals.get(c, 1) / max(1, y.count(c)) for c in (0, 1)}


def score(df: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``df`` and the calibrated score of ``text`` as ``name``; a column of that name is replaced.

    Null and empty texts have the score of no words. Repeated rows have equal scores.
    """
    source = df.drop(name)
    columns = source.columns
    at = columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in chunks(batches, 2 << 20):
            scores = shared.value.score(strings(part.column(at)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*columns, name])

    return source.mapInArrow(run, widened(source.schema, f"`{name}` double"))


#: Passages of two words: an insult among thousands of words is seen as well as in a short text.
TOXICITY = Config(lower=True, passage=2, rows=1000, epochs=8, batch=256)
QUALITY = Config(lower=False, passage=0, same=True)


def classifier(label: str, fold: int, modulus: int, threshold: float, config: Config) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function of (documents, labels) that learns ``label`` outside the held-out fold and scores every document."""

    def held_out(column: Column) -> Column:
        return F.crc32(column.cast("string").cast("binary")) % modulus == fold

    def run(documents: DataFrame, labels: DataFrame) -> DataFrame:
        scored = learned(documents.select("doc_id", "text"), labels)
        return scored.select(
            "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )

    def learned(documents: DataFrame, labels: DataFrame) -> DataFrame:
        """All columns of ``documents`` and ``score``, which replaces a column of that name."""
        texts, y, share = sample(documents, labels, label, config, "doc_id", "text", ~held_out(F.col("doc_id")))
        return score(documents, fit(texts, y, share, config))

    run.learned = learned
    return run


toxicity = classifier("toxic", 2, 4, 0.3, TOXICITY)
quality = classifier("quality", 1, 3, 0.5, QUALITY)
