"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of `window` consecutive words (a shorter item is one window). A window's shingles of
up to five words are ordered by rarity over the whole corpus; exact containment needs all of them, so the prefix is
the one rarest shingle. Documents are probed for prefix shingles only; a probe hit fixes where the window would begin,
is bounded by position and length (the window must lie inside the document) and verified word by word.

The benchmark is taken in blocks of about `block_words` words (some 250 bytes of index each, in flat arrays), so that what the driver and
a task hold is bounded whatever the benchmark's size: of several blocks each is counted and matched by itself against all documents,
one broadcast at a time, and what it hits, as digest of the text, ranges of words and items, is written and joined to the documents
in the end. Of one block, matching answers at once. Text is never shuffled.

Defined cases: very long texts are probed whole; null text has no words; items without words match nothing; items with equal ids are one item; a null
item_id counts as the empty string; empty tables give no rows or no hits; repeated rows get equal answers; extra
columns are ignored by `contamination` and carried untouched by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, text_buffers, written
from .wordhash import Words, grams, words_of

WINDOW, SHINGLE, BLOCK_WORDS, MIN_ITEMS = 8, 5, 500_000, 2
_SIEVE, _PAIRS = 1 << 20, 1 << 18


def item_windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[bytes, list[int]]:
    """Each distinct window, its words joined by blanks, and the numbers of its items."""
    found: dict[bytes, list[int]] = {}
    for number, (_, text) in enumerate(items):
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = words_of(data, np.array([0, len(data)]))
        listed = [words.word(k) for k in range(len(words.starts))]
        for k in range(max(len(listed) - window + 1, 1) if listed else 0):
            own = found.setdefault(b" ".join(listed[k : k + window]), [])
            if not own or own[-1] != number:
                own.append(number)
    return found


class Index:
    """The windows of one block in flat arrays: their words' hashes and shingles, and after `order` the rarest shingle of each as its prefix."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        found = item_windows(items, window)
        self.windows = list(found)
        self.item_first = np.cumsum([0, *map(len, found.values())])
        self.items = np.array([i for own in found.values() for i in own], np.int64)
        blob = b"\n".join(self.windows)
        words = words_of(np.frombuffer(blob, np.uint8), np.array([0, len(blob)]))
        self.hashes = words.hashes
        self.lengths = np.array([w.count(b" ") + 1 for w in self.windows], np.int64)
        self.first = np.cumsum(np.append(0, self.lengths))
        self.sizes = sorted({min(SHINGLE, n) for n in np.unique(self.lengths).tolist()})
        # Of each window, its shingles' values and places.
        owner, place, value = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for n in self.sizes:
            mine = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == n)
            counts = self.lengths[mine] - n + 1
            own = np.repeat(mine, counts)
            at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            owner.append(own)
            place.append(at)
            value.append(grams(self.hashes, n)[self.first[own] + at])
        self.owner, self.place, self.value = map(np.concatenate, (owner, place, value))
        self.known = np.unique(self.value)
        self.prefixes, self.prefix_window, self.prefix_place = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.sieve(self.known)

    def sieve(self, values: np.ndarray) -> None:
        self.looked = values
        self.bits = np.zeros(_SIEVE, bool)
        self.bits[(values & np.uint64(_SIEVE - 1)).astype(np.int64)] = True

    def order(self, counts: np.ndarray) -> None:
        """counts: occurrences in the corpus of each of `known`."""
        rank = np.lexsort((self.place, self.value, counts[np.searchsorted(self.known, self.value)], self.owner))
        rarest = rank[np.append(True, np.diff(self.owner[rank]) > 0)] if len(rank) else rank
        rarest = rarest[np.argsort(self.value[rarest], kind="stable")]
        self.prefixes, self.prefix_window, self.prefix_place = self.value[rarest], self.owner[rarest], self.place[rarest]
        self.owner = self.place = self.value = np.empty(0, np.int64)
        self.sieve(np.unique(self.prefixes))

    def matches(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(row, first word, window) of every occurrence of a window in the words."""
        for at, rows, values in self.probe(words):
            low, high = (np.searchsorted(self.prefixes, values, side) for side in ("left", "right"))
            total = np.cumsum(high - low)
            begin = 0
            while begin < len(at):  # probes whose windows number about _PAIRS, at least one
                stop = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _PAIRS, "right")), begin + 1)
                counts = (high - low)[begin:stop]
                probe = np.repeat(np.arange(begin, stop), counts)
                pick = np.arange(len(probe)) - np.repeat(np.cumsum(counts) - counts, counts) + low[probe]
                yield from self._verified(words, at[probe], rows[probe], pick)
                begin = stop

    def _verified(self, words: Words, at: np.ndarray, rows: np.ndarray, pick: np.ndarray) -> Iterator[tuple[int, int, int]]:
        window = self.prefix_window[pick]
        start, size = at - self.prefix_place[pick], self.lengths[window]
        left = np.flatnonzero((start >= words.first[rows]) & (start + size <= words.first[rows + 1]))
        for n in range(int(size.max(initial=0))):  # word by word, those that still agree
            mine = left[size[left] > n]
            wrong = mine[words.hashes[start[mine] + n] != self.hashes[self.first[window[mine]] + n]]
            left = np.setdiff1d(left, wrong, assume_unique=True)
        for k in left.tolist():
            first, own = int(start[k]), int(window[k])
            if b" ".join(words.word(first + i) for i in range(int(size[k]))) == self.windows[own]:
                yield int(rows[k]), first, own

    def items_of(self, window: int) -> list[str]:
        return [self.ids[i] for i in self.items[self.item_first[window] : self.item_first[window + 1]].tolist()]

    def probe(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Word places, rows and shingles of the words' shingles that are looked for."""
        for n in self.sizes:
            values = grams(words.hashes, n)
            at = np.flatnonzero(self.bits[(values & np.uint64(_SIEVE - 1)).astype(np.int64)])
            if not len(at) or not len(self.looked):
                continue
            near = np.minimum(np.searchsorted(self.looked, values[at]), len(self.looked) - 1)
            at = at[self.looked[near] == values[at]]
            rows = np.searchsorted(words.first, at, "right") - 1
            inside = at + n <= words.first[rows + 1]
            yield at[inside], rows[inside], values[at[inside]]


def _count(index: Index, name: str):
    def run(batches):
        total = np.zeros(len(index.known), np.int64)
        for batch in batches:
            data, offsets = text_buffers(column(batch, name))
            for a, b in slices(offsets):
                words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for _, _, values in index.probe(words):
                    np.add.at(total, np.searchsorted(index.known, values), 1)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    return run


def _judged(index: Index, column_: pa.Array) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """For each row: the number of its words, which of them are hit, its items."""
    data, offsets = text_buffers(column_)
    for a, b in slices(offsets):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hit, items = np.zeros(len(words.starts), bool), [set() for _ in range(b - a)]
        for row, first, window in index.matches(words):
            hit[first : first + int(index.lengths[window])] = True
            items[row].update(index.items_of(window))
        for r in range(b - a):
            own = hit[words.first[r] : words.first[r + 1]]
            yield len(own), own, items[r]


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A word and its blank take two characters or more.
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // (2 * block_words)))
    return [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def _index(docs: DataFrame, text_col: str, block: DataFrame, window: int):
    """The broadcast index of one block, ordered by counts over all documents."""
    index = Index([tuple(r) for r in block.distinct().collect()], window)
    counts = np.zeros(len(index.known), np.int64)
    if len(index.known):
        seen = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(index, "text"), "k long, n long")
        for r in seen.groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most one row per shingle of the block
            counts[r["k"]] = r["n"]
    index.order(counts)
    return docs.sparkSession.sparkContext.broadcast(index)


def _digest(text) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()


def _hits(docs: DataFrame, text_col: str, blocks: list[DataFrame], window: int) -> DataFrame:
    """(q_text, spans, items) of the texts that hold windows, by digest: merged over all blocks, each matched by itself."""
    found = None
    for block in blocks:
        shared = _index(docs, text_col, block, window)

        def run(batches, shared=shared):
            for batch in batches:
                texts, rows = batch.column(0), []
                for k, (_, hit, items) in enumerate(_judged(shared.value, texts)):
                    if items:
                        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                        rows.append({"q_text": _digest(texts[k].as_py()), "spans": edges.tolist(), "items": sorted(items)})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("q_text", pa.binary()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

        part = written(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "q_text binary, spans array<long>, items array<string>"), "hits")
        shared.unpersist(blocking=True)
        # Equal texts give equal rows; one stands for all.
        part = part.groupBy("q_text").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        found = part if found is None else found.unionByName(part)
    return written(found.groupBy("q_text").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "hits")


def _covered(spans: list[list[int]]) -> int:
    """Words that lie in any of the ranges."""
    total, end = 0, 0
    for a, b in sorted((own[k], own[k + 1]) for own in spans for k in range(0, len(own), 2)):
        total += max(b - max(a, end), 0)
        end = max(end, b)
    return total


def _answers(ids: pa.Array, found: list[tuple[int, int, list[str]]], min_items: int) -> pa.RecordBatch:
    n_words, n_hit, items = ([x[k] for x in found] for k in range(3))
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([len(x) >= min_items for x in items], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _n_words(texts: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(texts)
    return np.concatenate([words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).counts() for a, b in slices(offsets)] or [np.empty(0, np.int64)])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, min_items: int = MIN_ITEMS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (min_items items or more)."""
    blocks, kind = _blocks(benchmark, block_words), docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    answer = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if len(blocks) == 1:
        shared = _index(docs, text_col, blocks[0], window)

        def run(batches):
            for batch in batches:
                yield _answers(batch.column(0), [(n, int(hit.sum()), list(items)) for n, hit, items in _judged(shared.value, batch.column(1))], min_items)

        return rows.mapInArrow(run, answer)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_n_words(batch.column(1)), pa.int64()), pa.array([_digest(t.as_py()) for t in batch.column(1)], pa.binary())], ["doc_id", "n_words", "q_text"])

    def join(batches):
        for batch in batches:
            held = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            yield _answers(batch.column(0), [(n, _covered(spans or []), items or []) for n, spans, items in held], min_items)

    named = rows.mapInArrow(count, f"doc_id {kind}, n_words long, q_text binary")
    met = named.join(_hits(docs, text_col, blocks, window), "q_text", "left")
    return met.select("doc_id", "n_words", "spans", "items").mapInArrow(join, answer)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    blocks, at = _blocks(benchmark, block_words), docs.columns.index(text_col)
    if len(blocks) == 1:
        shared = _index(docs, text_col, blocks[0], window)

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([len(items) < min_items for _, _, items in _judged(shared.value, batch.column(at))], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    gone = _hits(docs, text_col, blocks, window).where(F.size("items") >= min_items).select("q_text")
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))
    return docs.join(gone, digest == gone["q_text"], "left_anti")
