"""Token totals kept by signed deltas, with idempotent batch commits.

A batch of changes (op insert, delete or revise; doc_id, version, source, lang, n_tokens) is turned into signed entries
against the ledger: an insert adds a document and its tokens, a delete takes away what the ledger holds, a revision
does both. Each attempt writes its entries and their sums by source, language and tokenizer version to folders of its own, and
last a marker commits/<batch> that names the attempt, created only where there is none. So a batch that broke off leaves nothing that
counts, a batch that is delivered again changes nothing, and of two writers of one batch one counts. Different batches are
applied one after the other.

Totals are the sums of the deltas; they read no documents. A batch joins its changes with the ledger, which is the last
snapshot and the batches after it; every `COMPACT` batches a snapshot sums up what came before, so neither the ledger nor the
listing of markers grows with the number of batches.

Defined cases: doc_ids are compared as strings; a change without a doc_id can't be found again, so an insert or revision of it counts as a
document of its own, each row, and a delete of it as nothing; an insert of a document that is there counts as a revision, a revision
of one that isn't as an insert, a delete of one that isn't as nothing; changes of equal doc_id and version in one batch are one, the
largest (op, n_tokens, source, lang) holds, so repeated rows count once; null source and lang are values like others; null n_tokens and
null texts count as 0; very long texts are counted whole; an empty batch is committed and changes nothing; totals that fall to no
documents leave the result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SLICE, encoder
from .common import slices, text_buffers
from .wordhash import words_of

KEYS = ["source", "lang", "version"]
ENTRIES = "doc_id string, version string, source string, lang string, n_tokens long, sign long"
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
COMPACT = 32
WORDS_VERSION, BPE_VERSION = "words/1", "byte_bpe_50k/1"


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Inserts of all rows of docs (doc_id, text, source, lang) for two tokenizer versions: plain words and byte-level BPE."""

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            words, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in slices(offsets, SLICE):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words.append(words_of(part, own).counts())
                ids.append(np.diff(encode(part, own)[1]))
            for version, n in ((WORDS_VERSION, words), (BPE_VERSION, ids)):
                same = [pa.array([x] * batch.num_rows, pa.string()) for x in ("insert", version)]
                yield pa.RecordBatch.from_arrays([same[0], batch.column(0), same[1], batch.column(1), batch.column(2), pa.array(np.concatenate(n), pa.int64())], ["op", "doc_id", "version", "source", "lang", "n_tokens"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", "text").mapInArrow(run, "op string, doc_id string, version string, source string, lang string, n_tokens long")


class Rollup:
    """Totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, compact: int = COMPACT):
        self.spark, self.folder, self.compact_at = spark, folder.rstrip("/"), compact
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        at = self._path(f"{self.folder}/{part}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def _said(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _say(self, path: str, text: str) -> bool:
        """Writes a small file where there is none; False where there is one."""
        try:
            stream = self._files.create(self._path(path), False)
        except Exception as wrong:  # who came first counts
            if self._files.exists(self._path(path)):
                return False
            raise wrong
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last snapshot's folder and the batches it sums up."""
        whole = [n for n in self._names("snapshots") if self._files.exists(self._path(f"{self.folder}/snapshots/{n}/covers"))]
        if not whole:
            return None, set()
        path = f"{self.folder}/snapshots/{max(whole, key=lambda n: int(n.split('-')[0]))}"
        return path, set(self._said(f"{path}/covers").split("\n"))

    def committed(self) -> list[str]:
        """Names of the batches that count."""
        return self._names("commits")

    def _read(self, part: str, schema: str) -> DataFrame:
        base, covered = self._snapshot()
        paths = [f"{base}/{part}"] if base else []
        paths += [f"{self.folder}/attempts/{self._said(f'{self.folder}/commits/{b}')}/{part}" for b in self.committed() if b not in covered]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What is counted now, by document and version."""
        return self._netted().where("n > 0").select("doc_id", *KEYS, (F.col("n_tokens") / F.col("n")).cast("long").alias("n_tokens")).where("doc_id is not null")

    def _netted(self) -> DataFrame:
        return self._read("ledger", ENTRIES).where("doc_id is not null").groupBy("doc_id", *KEYS).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens."""
        return self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")

    def snapshot(self) -> None:
        """Sums up all batches committed so far; later reads begin there."""
        batches, number = self.committed(), len(self._names("snapshots"))
        path = f"{self.folder}/snapshots/{number}-{uuid.uuid4().hex}"
        self.ledger().select("doc_id", "version", "source", "lang", "n_tokens", F.lit(1).cast("long").alias("sign")).write.parquet(f"{path}/ledger")
        self.totals().select("source", "lang", "version", "n_docs", "n_tokens").write.parquet(f"{path}/deltas")
        self._say(f"{path}/covers", "\n".join(batches))

    def _entries(self, changes: DataFrame) -> DataFrame:
        named = changes.select(F.col("doc_id").cast("string").alias("doc_id"), "version", F.struct("op", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), "source", "lang").alias("change"))
        one = named.where("doc_id is not null").groupBy("doc_id", "version").agg(F.max("change").alias("change")).select("doc_id", "version", "change.*")
        old = self.ledger().select(F.col("doc_id").alias("o_doc"), F.col("version").alias("o_version"), F.col("source").alias("o_source"), F.col("lang").alias("o_lang"), F.col("n_tokens").alias("o_tokens"))
        met = one.join(old, (F.col("doc_id") == F.col("o_doc")) & F.col("version").eqNullSafe(F.col("o_version")), "left")
        there = F.col("o_tokens").isNotNull()
        out = F.when(there, F.struct("doc_id", "version", F.col("o_source").alias("source"), F.col("o_lang").alias("lang"), F.col("o_tokens").alias("n_tokens"), F.lit(-1).cast("long").alias("sign")))
        into = F.when(F.col("op") != "delete", F.struct("doc_id", "version", "source", "lang", "n_tokens", F.lit(1).cast("long").alias("sign")))
        entries = met.select(F.explode(F.array_compact(F.array(out, into))).alias("e")).select("e.*")
        nameless = named.where("doc_id is null and change.op <> 'delete'").select("doc_id", "version", "change.source", "change.lang", "change.n_tokens", F.lit(1).cast("long").alias("sign"))
        return entries.unionByName(nameless)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """False if the batch had been committed before."""
        if batch in self.committed():
            return False
        attempt = uuid.uuid4().hex
        path = f"{self.folder}/attempts/{attempt}"
        self._entries(changes).write.parquet(f"{path}/ledger")
        made = self.spark.read.schema(ENTRIES).parquet(f"{path}/ledger")
        sums = made.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.write.parquet(f"{path}/deltas")
        if not self._say(f"{self.folder}/commits/{batch}", attempt):
            return False
        if len(self.committed()) - len(self._snapshot()[1]) >= self.compact_at:
            self.snapshot()
        return True
