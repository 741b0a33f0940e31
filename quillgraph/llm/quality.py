"""Document quality from random-indexing word vectors and a two-layer numpy network with calibrated probabilities.

Words are runs of letters and digits or runs of punctuation. Each frequent word of the sample has a sparse ternary
index vector; its word vector sums the index vectors of the words around it (random indexing), centred and scaled to
length one. A rarer word stands in as its shape: its case and length. A text's features are the mean of its words'
vectors and index vectors, the share of distinct words, of words that repeat one of the two before them, and the
logarithm of its length. A network of one hidden layer is fitted to the labels and its logit divided by a temperature
fitted on rows that the weights did not see.

Fitted on the driver from a bounded sample of labelled rows: at most `max_rows` rows (those least by hash, of the first 4 x `max_rows`
labels) and `max_chars` characters of text; a text that alone is longer isn't taken. Every text is scored whole. Never inputs: labels, lang, source, doc_id.

Defined cases: a very long text is scored whole, alone in its slice; null and empty texts have all features 0 and get the network's answer to that; without labels every
score is 0.5; labels whose quality is null or whose document is missing are ignored, and of a document labelled twice
the higher quality holds; a null doc_id isn't held out; extra columns are ignored by `scores` and carried untouched by `kept`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers, written
from .wordhash import _BASE, _BASE_INV, mix

DIMENSIONS, NONZERO, REACH, HIDDEN, MIN_COUNT = 32, 4, 2, 32, 8
MAX_ROWS, MAX_CHARS, FOLDS, LEAST = 5000, 24_000_000, 5, 0.3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _KIND[_a:_b] = 1
_VALUE = np.random.default_rng(4).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
SHAPES = 16


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each word of all rows, and each row's first word (rows + 1)."""
    kind = _KIND[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(kind)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.empty(0, np.uint64)
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x41) & (data <= 0x5A), out=capitals[1:])
    upper, size = capitals[ends] - capitals[starts], ends - starts
    case = np.where(kind[starts] == 2, 3, np.where(upper == 0, 0, np.where(upper == 1, 1, 2)))
    shape = case * 4 + np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 3)
    return hashes, shape, np.searchsorted(starts, offsets)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors: NONZERO places of DIMENSIONS, drawn by the hash alone."""
    out = np.zeros((len(hashes), DIMENSIONS), np.float32)
    for j in range(NONZERO):
        x = mix(hashes + np.uint64(j + 1))
        out[np.arange(len(hashes)), (x % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(x >> np.uint64(63), 1, -1)
    return out


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def ids(self, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Place of each word's vector: that of the word, or of its shape."""
        if not len(self.words):
            return shape
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + SHAPES, shape)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, shape, first = tokens(data, offsets)
        rows = len(offsets) - 1
        n, full = np.diff(first), np.flatnonzero(np.diff(first) > 0)
        out = np.zeros((rows, self.vectors.shape[1] + 3), np.float32)
        if len(full):
            ids = self.ids(hashes, shape)
            for r in full:
                out[r, :-3] = self.vectors.take(ids[first[r] : first[r + 1]], axis=0).sum(0) / n[r]
            again = np.zeros(len(hashes), np.float32)
            again[1:] = hashes[1:] == hashes[:-1]
            again[2:] = np.maximum(again[2:], hashes[2:] == hashes[:-2])
            for j in (0, 1):
                edge = first[full] + j
                again[edge[edge < first[full + 1]]] = 0
            out[full, -3] = np.add.reduceat(again, first[full]) / n[full]
            by_row = np.sort((np.repeat(np.arange(rows), n).astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
            new = np.ones(len(by_row), np.float32)
            new[1:] = by_row[1:] != by_row[:-1]
            out[full, -2] = np.add.reduceat(new, first[full]) / n[full]
            out[:, -1] = np.log1p(n) / 10
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(offsets) - 1, 0.5)
        z = self.logits(self.features(data, offsets)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _word_vectors(model: Model, texts: list[bytes]) -> None:
    """Random indexing over the sample, a few texts at a time."""
    def parts():
        for a in range(0, len(texts), 64):
            joined = np.frombuffer(b"".join(texts[a : a + 64]), np.uint8)
            yield tokens(joined, np.concatenate(([0], np.cumsum([len(t) for t in texts[a : a + 64]]))))

    found: dict[int, int] = {}
    for hashes, _, _ in parts():
        for h, n in zip(*(x.tolist() for x in np.unique(hashes, return_counts=True)), strict=True):
            found[h] = found.get(h, 0) + n
    model.words = np.array(sorted(h for h, n in found.items() if n >= MIN_COUNT), np.uint64)
    index = index_vectors(np.concatenate((np.arange(SHAPES, dtype=np.uint64), model.words)))
    context = np.zeros_like(index)
    for hashes, shape, first in parts():
        ids, row = model.ids(hashes, shape), np.repeat(np.arange(len(first) - 1), np.diff(first))
        for a in range(0, len(ids), 100_000):
            here = ids[a : a + 100_000]
            total = np.zeros((len(here), DIMENSIONS), np.float32)
            for step in (s for s in range(-REACH, REACH + 1) if s):
                at = np.arange(a, a + len(here)) + step
                fine = (at >= 0) & (at < len(ids))
                fine[fine] &= row[at[fine]] == row[a : a + len(here)][fine]
                total[fine] += index[ids[at[fine]]]
            order = np.argsort(here, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(here[order]) > 0))) if len(here) else []
            if len(starts):
                context[here[order][starts]] += np.add.reduceat(total[order], starts, axis=0)
    context -= context.sum(0) / max(len(context), 1)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    model.vectors = np.concatenate((context, index / np.sqrt(NONZERO)), axis=1).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, calibrate: np.ndarray, rounds: int = 30, seed: int = 4) -> Model:
    """calibrate: the rows that fit the temperature only."""
    model = Model()
    if not len(texts):
        return model
    _word_vectors(model, texts)
    x = np.concatenate([model.features(np.frombuffer(b"".join(texts[a : a + 64]), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts[a : a + 64]])))) for a in range(0, len(texts), 64)])
    train = ~calibrate if (~calibrate).any() else calibrate
    model.mean, model.scale = x[train].mean(0), x[train].std(0) + 1e-3
    rng, y = np.random.default_rng(seed), labels.astype(np.float32)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.float32(0)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z, places = (x - model.mean) / model.scale, np.flatnonzero(train)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(places), max(1, len(places) // 128)):
            step += 1
            hidden = np.tanh(z[part] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            for k, g in enumerate((z[part].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], error.sum())):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(p)
    held = np.flatnonzero(calibrate) if calibrate.any() else places
    logit, truth = model.logits(x[held]).astype(np.float64), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    model.temperature = float(min(grid, key=lambda t: np.mean(np.logaddexp(0, -(2 * truth - 1) * logit / t))))
    return model


def held_out(id_):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """From labels (doc_id, quality) of rows that aren't held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    # Each label is one row; a document labelled twice is folded after the sample is drawn. More labels than rows are drawn, as some may have no document.
    sample = usable.select(F.col("doc_id").alias("q_id"), F.col("quality").cast("int").alias("q_label"), F.xxhash64("doc_id").alias("q_order")).orderBy("q_order", "q_id", "q_label").limit(4 * max_rows)
    sample = sample.groupBy("q_id", "q_order").agg(F.max("q_label").alias("q_label"))
    # At most 4 x max_rows rows of three numbers are broadcast.
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("q_id"))
    # Texts that alone pass the bound are left out; rows alike in doc_id and text are one.
    fits = drawn.where(F.length("text") <= max_chars).withColumn("q_text", F.xxhash64("text"))
    sizes = fits.groupBy("q_order", "doc_id", "q_text").agg(F.max(F.length("text")).alias("n")).orderBy("q_order", "doc_id", "q_text").limit(max_rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > max_chars:
            break
        last = (r["q_order"], r["doc_id"], r["q_text"])
    if last is None:
        return Model()
    order, doc_id, text = (F.lit(x) for x in last)
    within = (F.col("q_order") < order) | (F.col("q_order") == order) & ((F.col("doc_id") < doc_id) | (F.col("doc_id") == doc_id) & (F.col("q_text") <= text))
    rows = fits.where(within).groupBy("q_order", "doc_id", "q_text").agg(F.min("text").alias("text"), F.max("q_label").alias("q_label"))
    rows = rows.select("doc_id", "text", "q_label", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)).alias("fold"))
    # The driver's JVM holds one part of the sample at a time, not all texts at once.
    drawn = sorted((r["doc_id"], r["text"].encode(), r["q_label"], r["fold"] == 1) for r in written(rows, "sample").toLocalIterator())
    try:
        return fit([r[1] for r in drawn], np.array([r[2] for r in drawn]), np.array([r[3] for r in drawn]))
    finally:
        _powers.clear()  # as long as the longest slice


def _scored(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(column)
    return np.concatenate([model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)] or [np.empty(0)])


def scores(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = _scored(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of docs that score `least` or more, with their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scored(shared.value, batch.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)
