"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Texts are read once for their SHA-256 digests, which are written to the shared folder; all that follows reads those. Pass 1
builds a counting Bloom filter that saturates at two: each digest sets SLOTS places of a table of `bits` slots,
each task sends the counters it touched (summed before the shuffle), and the slots hit twice or more become a bitmap
of at most bits / 8 bytes. Pass 2 tests each row against that bitmap: a row of which some slot was hit once only is
surely unique and passes straight through; only the others (all repeated texts and about two per cent of false positives)
shuffle, as digest and doc_id in `groups`, and are grouped exactly by digest. `deduplicated` reads texts a second time, as it
returns whole rows; there the rows that may be repeated shuffle whole, of each text one a task.

A bitmap is broadcast: its size is bounded by `max_bits` / 8 bytes whatever the input. Beyond max_bits / 16 rows `groups` deals the
digests to ranges of their hash, each with a bitmap of its own that doesn't fill, one after the other; `deduplicated` has one
bitmap, so at such sizes more of its rows shuffle. The result is exact at any fill.

Digests of a 65536th of the rows in question or more (and of HOT_ROWS) are joined back by broadcast, the others by a shuffle: there
are at most 65536 of the former, and none of the latter makes a task hot.

Defined cases: null text counts as empty; very long texts count whole; rows with null doc_id take part, and lose to any row with one;
rows alike in doc_id and text are one document, of which one row is kept by `deduplicated`, and all have kept = true in `groups`;
an empty table gives an empty result; other columns, whatever their names, are carried by `deduplicated` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

SLOTS, HOT_KEYS, HOT_ROWS = 2, 1 << 16, 256
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
_BUCKET_BITS = 8 * 4096  # of Spark's bitmap functions


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """The least power of two of at least 16 bits a row, within bounds."""
    return min(max(1 << max(16 * rows - 1, 1).bit_length(), MIN_BITS), max_bits)


def _slots(text, bits: int):
    return [F.pmod(F.xxhash64(F.lit(seed), text), F.lit(bits)).cast("long") for seed in range(SLOTS)]


def repeated_filter(texts: DataFrame, text, bits: int) -> DataFrame:
    """Bitmap of the slots that two or more rows hit: (q_bucket, q_map), at most bits / 32768 rows of 4 KB."""
    slots = texts.select(F.explode(F.array(*_slots(text, bits))).alias("q_slot"))
    return _bitmap(slots.groupBy("q_slot").agg(F.count(F.lit(1)).alias("q_n")).where("q_n >= 2"))


def bitmap_of(values: DataFrame, value, bits: int) -> DataFrame:
    """Bitmap of the slots of all values: a plain Bloom filter."""
    return _bitmap(values.select(F.explode(F.array(*_slots(value, bits))).alias("q_slot")))


def maybe_in(rows: DataFrame, value, bitmap: DataFrame, bits: int) -> DataFrame:
    """The rows whose value's slots are all in the bitmap."""
    return tested_by(rows, value, bitmap, bits).where("q_maybe").drop("q_maybe")


def _bitmap(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.expr("bitmap_bucket_number(q_slot)").alias("q_bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(q_slot))").alias("q_map")
    )


def tested_by(rows: DataFrame, text, bitmap: DataFrame, bits: int) -> DataFrame:
    """rows plus boolean q_maybe, by a lookup of each slot in the broadcast bitmap."""
    hits = []
    for k, slot in enumerate(_slots(text, bits)):
        rows = rows.withColumn(f"q_slot{k}", slot)
    for k in range(SLOTS):
        here = bitmap.select(F.col("q_bucket").alias(f"q_bucket{k}"), F.col("q_map").alias(f"q_map{k}"))
        rows = rows.join(F.broadcast(here), F.expr(f"bitmap_bucket_number(q_slot{k}) = q_bucket{k}"), "left")
        place = F.expr(f"cast(bitmap_bit_position(q_slot{k}) as int)")
        byte = F.conv(F.hex(F.substring(f"q_map{k}", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.expr(f"shiftleft(1, cast(bitmap_bit_position(q_slot{k}) % 8 as int))")
        hits.append(F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False)))
    maybe = hits[0]
    for hit in hits[1:]:
        maybe = maybe & hit
    return rows.withColumn("q_maybe", maybe).drop(*(f"q_{n}{k}" for k in range(SLOTS) for n in ("slot", "bucket", "map")))


def _digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _grouped(rows: DataFrame, bits: int) -> DataFrame:
    """rows (doc_id, q_sha) plus keep_id and group_size."""
    tested = tested_by(rows, F.col("q_sha"), repeated_filter(rows, F.col("q_sha"), bits), bits)
    alone = tested.where("not q_maybe").select("doc_id", "q_sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = written(tested.where("q_maybe").select("doc_id", "q_sha"), "maybe-repeated")
    # Pre-aggregated before the shuffle, so that a hot group sends one row a task.
    best = written(maybe.groupBy("q_sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "repeated")
    least = max(HOT_ROWS, -(-maybe.count() // HOT_KEYS))
    hot = F.broadcast(best.where(F.col("group_size") >= least))
    cold = maybe.join(hot.select("q_sha"), "q_sha", "left_anti").join(best.where(F.col("group_size") < least), "q_sha")
    columns = ["doc_id", "q_sha", "keep_id", "group_size"]
    return alone.select(columns).unionByName(cold.select(columns)).unionByName(maybe.join(hot, "q_sha").select(columns))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("q_sha")), "digests")
    rows = digests.count()
    ranges = -(-16 * rows // max_bits)
    bits = filter_bits(-(-rows // max(ranges, 1)), max_bits)
    if ranges <= 1:
        found = _grouped(digests, bits)
    else:
        path = f"{shared_folder(docs.sparkSession)}/digest-ranges-{uuid.uuid4().hex}"
        dealt = digests.withColumn("q_range", F.pmod(F.xxhash64(F.lit(-1), "q_sha"), F.lit(ranges)))
        dealt.write.partitionBy("q_range").parquet(path)
        dealt, found = docs.sparkSession.read.schema(dealt.schema).parquet(path), None
        for k in range(ranges):  # a few passes, each over its own folder
            part = written(_grouped(dealt.where(F.col("q_range") == k).select("doc_id", "q_sha"), bits), "range")
            found = part if found is None else found.unionByName(part)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("q_sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts the row with the largest doc_id."""
    names = docs.columns
    digests = written(docs.select(_digest(F.col(f"`{text_col}`")).alias("q_sha")), "digests")
    bits = filter_bits(digests.count(), max_bits)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("q_row"))
    packed = packed.select("q_row", _digest(F.col(f"q_row.`{text_col}`")).alias("q_sha"), F.col(f"q_row.`{id_col}`").alias("q_id"))
    tested = tested_by(packed, F.col("q_sha"), repeated_filter(digests, F.col("q_sha"), bits), bits)
    # max_by keeps one row a text and task before the shuffle; null ids come first in order.
    best = tested.where("q_maybe").groupBy("q_sha").agg(F.max_by("q_row", F.struct(F.col("q_id").isNotNull(), F.col("q_id"))).alias("q_row"))
    return tested.where("not q_maybe").select("q_row").unionByName(best.select("q_row")).select(*(F.col(f"q_row.`{c}`").alias(c) for c in names))
