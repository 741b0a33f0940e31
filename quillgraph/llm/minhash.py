"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Texts become multisets of five-word shingles (a shorter text is one shingle). A shingle's weight is its count in the
text times 1 + 0.1 ln(N / df), where df counts documents, over all of them, in a table of 2^20 hashed counters. The
noise that collisions add to df / N is the mean number of shingles a text over 2^20, so it does not depend on the
size of the corpus and neither do the weights' range and the rule. The factor of 0.1 is deliberate: a near copy's edits
make shingles that no other text holds, the heaviest there are, so undamped weights would let a few edits of a
long text outweigh all that it shares; damped, rare shingles still count up to about twice a common one.

`HASHES` consistent weighted samples (Ioffe 2010) a text, 16 bits of each, are cut into bands of `ROWS`; texts that share a band fall
into a bucket (its number ends in the band's). Every member of a bucket is held against one leader, the one whose buckets hold most texts (what a group of
copies was made from), and links join into classes by repeated minimum labels; buckets that still hold more than a block outside
their largest class get a second leader from there. After that only
buckets that hold several classes count, and in them only pairs across classes. The members outside a bucket's largest
class are the queries; they meet all its members in blocks of `LEAST_BLOCK` to `MOST_BLOCK` units (a member and each 4 KB of
its text are a unit), an eighth of the bucket between these bounds. So a member is sent to at most nine tasks until a bucket has
65536 units, and beyond that to one for each 8192 units of queries. Each pair is answered by the samples where they
agree too seldom (`AGREE`) and else by the exact weighted Jaccard similarity of the texts; a pair that shares several bands is
answered in the first. No partner or bucket is capped, and no pair of a group that is one class is made. A link at the
threshold of 0.8 shares a band with probability above 0.9999.

Buckets of a 65536th of all members or more (and of `HOT_ROWS`) are joined by broadcast, the others by a shuffle: there
are at most 65536 of the former, and none of the latter makes a task hot. Of whole texts only those shuffle that a bitmap of the wanted
ids (32 MB at most) lets pass: those that are compared, and in `deduplicated` those that may go. All steps of `classes` that
hand texts to Python run as it is called, and take them in small batches.

Texts of equal word sequences are folded first, so copies cost one row; they are of one class by definition. Texts
without any word are of one class if they are identical.

Defined cases: null text counts as empty; a very long text is taken whole, one at a time; rows with null doc_id are alone
(class_id null) and stay; rows that share a doc_id are one document, linked by each of their texts; an empty table gives an
empty result; extra columns are ignored by `classes` and carried untouched by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_buffers, written
from .exact_dedup import bitmap_of, filter_bits, maybe_in, tested_by
from .wordhash import gram_rows, grams, mix, words_of

SHINGLE, HASHES, ROWS, THRESHOLD = 5, 80, 4, 0.8
#: Samples that must agree before two texts are compared; of a pair at the threshold fewer do with probability 1e-4.
AGREE, TASK_LINKS = 50, 200_000
LEAST_BLOCK, MOST_BLOCK, UNIT_BYTES = 512, 8192, 4096
HOT_BUCKETS, HOT_ROWS, SMALL_MAP = 1 << 16, 256, 200_000
COUNTERS, BANDS = 1 << 20, 32  # a power of two above the number of bands
_SEEDS = np.random.default_rng(5).integers(1, 1 << 32, (HASHES, 3), np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """For all rows at once: distinct shingles (44 bits) in order of row and value, their counts, each row's first place (rows + 1), and a 16-byte key of each row's words."""
    words = words_of(data, offsets)
    values, (places, rows) = grams(words.hashes, SHINGLE), gram_rows(words, SHINGLE)
    values = values[places]
    few = np.flatnonzero((words.counts() > 0) & (words.counts() < SHINGLE))
    if len(few):
        short = np.array([grams(words.hashes[words.first[r] : words.first[r + 1]], int(words.counts()[r]))[0] for r in few], np.uint64)
        values, rows = np.concatenate((values, short)), np.concatenate((rows, few))
    packed = (rows.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20))  # a slice holds fewer than 2^20 rows
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    found = packed[at]
    counts = np.diff(np.append(at, len(packed)))
    first = np.searchsorted(found >> np.uint64(44), np.arange(len(offsets), dtype=np.uint64))
    keys = []
    for r in range(len(offsets) - 1):
        a, b = words.first[r], words.first[r + 1]
        raw = words.hashes[a:b].tobytes() if b > a else b"-" + data[offsets[r] : offsets[r + 1]].tobytes()
        keys.append(hashlib.blake2b(raw, digest_size=16).digest())
    return found & np.uint64((1 << 44) - 1), counts, first, keys


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(COUNTERS, np.int32), 0
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for a, b in slices(offsets):
            shingles, _, first, _ = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total += np.bincount(counter_of(shingles), minlength=COUNTERS).astype(np.int32)
            docs += int((np.diff(first) > 0).sum())
    part = 1 << 14
    for k in range(COUNTERS // part):  # only what isn't 0, as places and counts
        at = np.flatnonzero(total[k * part : (k + 1) * part]).astype(np.uint16)
        if len(at):
            n = total[k * part + at.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.tobytes()]), pa.array([n.astype(np.int32).tobytes()]), pa.array([0], pa.int64())], ["k", "at", "n", "docs"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""]), pa.array([b""]), pa.array([docs], pa.int64())], ["k", "at", "n", "docs"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters' parts of several tasks added up."""
    part, total, docs = 1 << 14, {}, 0
    for batch in batches:
        for k, at, n, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k < 0:
                docs += d
                continue
            sums = total.setdefault(k, np.zeros(part, np.int64))
            sums[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)
    for k, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.tobytes()]), pa.array([0], pa.int64())], ["k", "sums", "docs"])
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""]), pa.array([docs], pa.int64())], ["k", "sums", "docs"])


def idf_table(texts: DataFrame) -> np.ndarray:
    """1 + 0.1 ln(N / df) of each counter, from all texts; 4 MB whatever the input."""
    parts = texts.mapInArrow(_count, "k int, at binary, n binary, docs long").repartition(16, "k").mapInArrow(_summed, "k int, sums binary, docs long")
    df, docs = np.zeros(COUNTERS, np.int64), 0
    for row in parts.collect():  # 64 parts of 128 KB, and the number of documents
        if row["k"] >= 0:
            df[row["k"] << 14 : (row["k"] + 1) << 14] += np.frombuffer(row["sums"], np.int64)
        docs += row["docs"]
    return (1 + 0.1 * np.log(max(docs, 1) / np.minimum(np.maximum(df, 1), max(docs, 1)))).astype(np.float32)


def _mix32(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _pair(x: np.ndarray) -> np.ndarray:
    """Product of two uniform draws, from the halves of 32 bits; minus its logarithm is Gamma(2, 1)."""
    product = (x >> np.uint32(16)).astype(np.float32)
    product += np.float32(0.5)
    low = (x & np.uint32(0xFFFF)).astype(np.float32)
    low += np.float32(0.5)
    product *= low
    product *= np.float32(2.0**-32)
    return product


def samples(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES consistent weighted samples of each row that has shingles, as uint32; first: the places where those rows begin."""
    log_w, out = np.log(weights).astype(np.float32), np.empty((HASHES, len(first)), np.uint32)
    wide = mix(shingles)
    a, b = (wide >> np.uint64(32)).astype(np.uint32), wide.astype(np.uint32)
    for k in range(HASHES):
        x, y = _mix32(a ^ _SEEDS[k, 0]), _mix32(b ^ _SEEDS[k, 1])
        r = np.log(_pair(x))
        np.negative(r, out=r)
        beta = ((x ^ (y * np.uint32(0x9E3779B1))) >> np.uint32(8)).astype(np.float32)
        beta *= np.float32(2.0**-24)
        t = log_w / r
        t += beta
        np.floor(t, out=t)
        log_c = np.log(_pair(y))
        np.negative(log_c, out=log_c)
        np.log(log_c, out=log_c)
        # ln a = ln c - r (t - beta) - r
        log_a = beta
        log_a -= t
        log_a -= np.float32(1)
        log_a *= r
        log_a += log_c
        bits = log_a.view(np.int32)
        order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).view(np.uint32) ^ np.uint32(0x80000000)
        packed = order.astype(np.uint64)
        packed <<= np.uint64(32)
        packed |= a ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B))
        out[k] = np.minimum.reduceat(packed, first).astype(np.uint32)
    return out.T


def _sketch(idf):
    def run(batches):
        table = idf.value
        for batch in batches:
            ids, (data, offsets) = batch.column(0), text_buffers(batch.column(1))
            for a, b in slices(offsets, 1 << 17):  # arrays that stay in the processor's cache
                shingles, counts, first, keys = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                full = np.diff(first) > 0
                sig = samples(shingles, counts * table[counter_of(shingles)], first[:-1][full]) if full.any() else np.empty((0, HASHES), np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * HASHES))).astype(np.int32)), pa.array(sig.astype(np.uint16).ravel().view(np.int16)))
                units = 1 + np.diff(offsets[a : b + 1]) // UNIT_BYTES
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(keys, pa.binary()), lists, pa.array(units, pa.int64())], ["doc_id", "words_key", "samples", "units"])

    return run


def _weighted(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    shingles, counts, _, _ = shingle_sets(data, np.array([0, len(data)]))
    return shingles, counts * table[counter_of(shingles)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of the weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    most = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - least
    return least / most if most else 0.0


def _verify(idf, threshold):
    def run(batches):
        for batch in batches:
            keep, known = [], (None, None)
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                if text != known[0]:
                    known = text, _weighted(text, idf.value)
                keep.append(weighted_jaccard(known[1], _weighted(batch.column(3)[k].as_py(), idf.value)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, of all nodes of links (a, b); each round is written to the shared folder, in tasks of about TASK_LINKS links."""
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    tasks = 1 + 2 * links.count() // TASK_LINKS
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")).coalesce(tasks), "labels")
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer")).coalesce(tasks)
        least = labels.join(offered, "node").select("node", "label", F.least("label", "offer").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = least.join(jump, "new", "left").select("node", F.coalesce(F.least("new", "far"), "new").alias("label"), F.coalesce(F.least("new", "far") < F.col("label"), F.lit(False)).alias("moved"))
        after = written(after.coalesce(tasks), "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


class _Linker:
    """Finds the links of the buckets' members (bucket, node, size) and keeps what has been answered."""

    def __init__(self, rows: DataFrame, texts: DataFrame, members: DataFrame, hot: int, idf, threshold: float):
        self.rows, self.texts, self.hot, self.idf, self.threshold = rows, texts, hot, idf, threshold
        none = rows.sparkSession.createDataFrame([], "a long, b long")
        self.found, self.labels = [none], none.select(F.col("a").alias("node"), F.col("b").alias("label"))
        weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
        self.members, self.known = written(members.join(weights, "node"), "weighted"), None

    def links(self) -> DataFrame:
        return _union(self.found)

    def with_bucket(self, members: DataFrame, buckets: DataFrame) -> DataFrame:
        """members joined to buckets (bucket, size, ...), one row each; hot ones by broadcast, of which there are at most HOT_BUCKETS."""
        warm, cold = F.col("size") >= self.hot, F.col("size") < self.hot
        return members.where(cold).join(buckets.where(cold).drop("size"), "bucket").unionByName(members.where(warm).join(F.broadcast(buckets.where(warm).drop("size")), "bucket"))

    def mixed(self) -> DataFrame:
        """Members of buckets that hold several classes, with their class; made anew when classes have changed."""
        if self.known is not None:
            return self.known
        named = self.members.join(self.labels, "node", "left").select("bucket", "node", "size", "weight", F.coalesce("label", "node").alias("label"))
        several = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("size").alias("size")).where("x <> y").select("bucket", "size")
        self.known = written(self.with_bucket(named, several).join(self.texts.select("node", "units"), "node"), "mixed")
        return self.known

    def link(self, more: DataFrame) -> None:
        """Adds links; classes known so far are nodes of their own, so only what is new is connected."""
        more = written(more, "linked")
        if not more.isEmpty():
            self.found.append(more)
            self.join_classes(more)
            self.known = None

    def join_classes(self, links: DataFrame) -> None:
        by = [self.labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")) for side in ("a", "b")]
        between = links.join(by[0], "a", "left").join(by[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        now = connected(between)
        moved = now.select(F.col("node").alias("label"), F.col("label").alias("new"))
        if moved.count() <= SMALL_MAP:
            moved = F.broadcast(moved)
        after = self.labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        self.labels = written(after.unionByName(now.join(self.labels, "node", "left_anti")), "classes")

    def largest(self, named: DataFrame) -> DataFrame:
        """Of each bucket: its size, all units, its largest class and that one's units."""
        counts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("own"), F.max("size").alias("size"))
        top = F.max_by(F.struct("label", "own"), F.struct("n", "label")).alias("top")
        return counts.groupBy("bucket").agg(F.max("size").alias("size"), F.sum("own").alias("total"), top).select("bucket", "size", "total", F.col("top.label").alias("largest"), F.col("top.own").alias("own"))

    def star(self, again: bool) -> None:
        """Each bucket's members against one leader of another class; again: in buckets whose queries fill more than a block, a leader of those."""
        named = self.mixed()
        able = named
        if again:
            many = written(self.largest(named).where(F.col("total") - F.col("own") > LEAST_BLOCK).select("bucket", "size", "largest"), "many")
            if many.isEmpty():
                return
            able = self.with_bucket(named, many).where("label <> largest")
        lead = able.groupBy("bucket").agg(F.max_by(F.struct("node", "label"), F.struct("weight", F.xxhash64("node"))).alias("lead"), F.max("size").alias("size"))
        met = self.with_bucket(named, lead).where("label <> lead.label")
        pairs = met.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct()
        side = self.texts.select("node", "samples")
        both = pairs.join(side.select(F.col("node").alias("a"), F.col("samples").alias("x")), "a").join(side.select(F.col("node").alias("b"), F.col("samples").alias("y")), "b")
        agree = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda same: same))
        near = written(both.where(agree >= AGREE).select("a", "b"), "near")
        texts = self.texts_of(near.select(F.explode(F.array("a", "b")).alias("node")))
        sides = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        self.link(sides.select("a", "b", "text_a", "text_b").mapInArrow(_verify(self.idf, self.threshold), "a long, b long").distinct())

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        wanted = written(nodes.select(F.col("node").alias("doc_id")).distinct(), "wanted")
        bits = filter_bits(wanted.count())
        near = maybe_in(self.rows, F.col("doc_id"), bitmap_of(wanted, F.col("doc_id"), bits), bits)
        return written(near.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")

    def across(self) -> None:
        """All pairs across classes that share a bucket: its members outside the largest class against all, in blocks."""
        named = self.mixed()
        block = F.least(F.greatest(F.ceil(F.col("total") / 8), F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
        shapes = self.largest(named).select("bucket", "size", "largest", F.ceil(F.col("own") / block).alias("n1"), F.ceil((F.col("total") - F.col("own")) / block).alias("n2"))
        main, spread = F.col("label") == F.col("largest"), F.xxhash64("node")
        own = F.when(main, F.pmod(spread, "n1")).otherwise(F.col("n1") + F.pmod(spread, "n2"))
        others = F.sequence(F.when(main, F.col("n1")).otherwise(F.lit(0)), F.col("n1") + F.col("n2") - 1)
        placed = self.with_bucket(named, shapes).select(F.col("bucket").bitwiseAND(BANDS - 1).cast("int").alias("band"), "bucket", "node", "label", own.alias("block"), F.explode(others).alias("other"))
        parts = placed.select("band", "bucket", "node", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
        held = parts.join(self.texts.select("node", "samples"), "node")
        near = written(held.groupBy("bucket", "p", "q").applyInArrow(_near, held.schema), "near")
        full = near.join(self.texts_of(near), "node")
        self.link(full.groupBy("bucket", "p", "q").applyInArrow(_verify_block(self.idf, self.threshold), "a long, b long").distinct())

    def run(self) -> None:
        self.star(False)
        self.star(True)
        self.across()


def _agreeing(low: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of each row of low (HASHES bytes), the number of bytes equal to those of one; eight are counted at a time."""
    same = (low == one).view(np.uint64).sum(1)
    return (same * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _candidates(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    """(row, rows) of pairs across classes whose samples agree often, that share no earlier band and lie in this part's two blocks."""
    band, p, q = (table.column(c)[0].as_py() for c in ("band", "p", "q"))
    label, block = (table.column(c).to_numpy() for c in ("label", "block"))
    sig = table.column("samples").combine_chunks().flatten().to_numpy().reshape(table.num_rows, HASHES)
    low = np.ascontiguousarray(sig.astype(np.uint8))
    sides = [np.flatnonzero(block == k) for k in (p, q)]
    few, many = sorted(sides, key=len)
    held, found = low[many], []
    for k, row in enumerate(few.tolist()):
        start = k + 1 if p == q else 0
        at = many[start:]
        at = at[(_agreeing(held[start:], low[row]) >= AGREE) & (label[at] != label[row])]
        if len(at):
            agree = sig[at] == sig[row]
            fine = agree.sum(1) >= AGREE
            if band:
                fine &= ~agree[:, : band * ROWS].reshape(len(at), band, ROWS).all(2).any(1)
            at = at[fine]
        if len(at):
            found.append((row, at))
    return found


def _near(table: pa.Table) -> pa.Table:
    found = _candidates(table)
    at = np.unique(np.concatenate([np.array([row for row, _ in found], np.int64), *(rows for _, rows in found)]))
    return table.take(pa.array(at))


def _verify_block(idf, threshold):
    def run(table: pa.Table) -> pa.Table:
        data, offsets = text_buffers(table.column("text"))
        known = []
        for a, b in slices(offsets):
            shingles, counts, first, _ = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            weights = (counts * idf.value[counter_of(shingles)]).astype(np.float64)
            known += [(shingles[i:j], weights[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        whole = np.array([w.sum() for _, w in known])
        node, left, right = table.column("node").to_numpy(), [], []
        for row, at in _candidates(table):
            # No pair is more alike than the lighter text is of the heavier.
            at = at[np.minimum(whole[at], whole[row]) >= threshold * np.maximum(whole[at], whole[row])]
            alike = at[_similarities(known[row], [known[k] for k in at.tolist()]) >= threshold]
            left.append(np.full(len(alike), node[row]))
            right.append(node[alike])
        a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (left, right))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of one to each of others; shingles are sorted and distinct."""
    if not others:
        return np.empty(0)
    shingles, weights = (np.concatenate([o[k] for o in others]) for k in (0, 1))
    first = np.cumsum([0, *(len(o[0]) for o in others)])[:-1]
    at = np.minimum(np.searchsorted(one[0], shingles), len(one[0]) - 1)
    least = np.add.reduceat(np.where(one[0][at] == shingles, np.minimum(one[1][at], weights), 0.0), first)
    return least / (np.add.reduceat(weights, first) + one[1].sum() - least)


def sized(spread: DataFrame) -> tuple[DataFrame, int]:
    """spread (bucket, node) with the size of each bucket of two or more, and the size from which a bucket is hot."""
    sizes = written(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size >= 2"), "sizes")
    known = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("members"), F.count(F.lit(1)).alias("buckets")).first()
    hot = max(HOT_ROWS, -(-known["members"] // HOT_BUCKETS))
    # Most bands are one text's only; a bitmap of the others (32 MB at most) keeps those from being shuffled.
    bits = filter_bits(known["buckets"])
    near = maybe_in(spread, F.col("bucket"), bitmap_of(sizes, F.col("bucket"), bits), bits)
    warm = F.broadcast(sizes.where(F.col("size") >= hot))
    cold = near.join(warm.select("bucket"), "bucket", "left_anti").join(sizes.where(F.col("size") < hot), "bucket")
    return written(cold.unionByName(near.join(warm, "bucket")), "members"), hot


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class), n_links (links of its text to others that were verified; pairs inside a class that a leader has closed already are not made), kept (doc_id is the class's)."""
    with small_batches(docs.sparkSession):
        return _classes(docs, id_col, text_col, threshold)


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.where("doc_id is not null")
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(rows.select("text")))
    sketches = written(named.mapInArrow(_sketch(idf), "doc_id long, words_key binary, samples array<smallint>, units long"), "sketches")
    texts = written(sketches.groupBy("words_key").agg(F.min("doc_id").alias("node"), F.first("samples").alias("samples"), F.max("units").alias("units")), "nodes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda j: F.xxhash64(j, F.slice("samples", j * ROWS + 1, ROWS)).bitwiseAND(-BANDS).bitwiseOR(j))
    spread = texts.where(F.size("samples") > 0).select(F.explode(bands).alias("bucket"), "node")
    members, hot = sized(spread)
    linker = _Linker(named, texts, members, hot, idf, threshold)
    linker.run()
    # A document with several texts links them.
    same = sketches.join(texts.select("words_key", "node"), "words_key").where("doc_id <> node").select("doc_id", "node").join(texts.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    linker.join_classes(same)
    degree = linker.links().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    by_text = texts.select("words_key", "node").join(linker.labels, "node", "left").join(degree, "node", "left").select("words_key", F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = sketches.select("doc_id", "words_key").join(by_text, "words_key").select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    unnamed = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(unnamed)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose document stays, one document of each class, with their columns."""
    gone = written(classes(docs, id_col, text_col, threshold).where("not kept").select(F.col("doc_id").alias("q_gone")).distinct(), "gone")
    bits = filter_bits(gone.count())
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row"))
    packed = packed.select("q_row", F.col(f"q_row.`{id_col}`").cast("long").alias("q_id"))
    tested = tested_by(packed, F.col("q_id"), bitmap_of(gone, F.col("q_gone"), bits), bits)
    maybe = tested.where("q_maybe")
    stay = maybe.join(gone, F.col("q_id") == F.col("q_gone"), "left_anti")
    return tested.where("not q_maybe").select("q_row").unionByName(stay.select("q_row")).select(*(F.col(f"q_row.`{c}`").alias(c) for c in docs.columns))
