"""The corpus pipeline, stage by stage."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402

from quillgraph.llm import bpe, quality  # noqa: E402
from quillgraph.llm.common import BATCHES  # noqa: E402

from .test_operators import brute_classes, brute_contamination  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from quillgraph.llm import minhash

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    model, left = quality.train(docs, labels), {}
    for r in quality.scores(docs, model).collect():
        if r["predicted"]:
            left[r["doc_id"]] = None
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in left}
    best = {}
    for d, t in sorted(rows.items()):
        best[t] = d
    rows = {d: t for d, t in rows.items() if best[t] == d}
    kept = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    idf = minhash.idf_table(kept.select("text"))
    classes = brute_classes(sorted(rows.items()), idf)
    rows = {d: t for d, t in rows.items() if classes[d] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute_contamination(list(rows.items()), items)
    rows = {d: t for d, t in rows.items() if not judged[d][2]}
    got = P.run(spark, SMALL)
    sizes = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    library = Tokenizer.from_file(bpe.default_path())
    assert sizes == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_stages_in_python_take_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """Whoever writes a stage's result does so under settings of their own, so texts have passed Python in small batches by then."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.range(0, 200, 1, 1).select(F.repeat(F.lit("a text "), 9000).alias("text")).write.parquet(str(tmp_path / "long"))
    docs, before = spark.read.parquet(str(tmp_path / "long")), dict(spark.conf.getAll)
    monkeypatch.setattr(P.quality, "train", lambda docs, labels: None)
    monkeypatch.setattr(P.quality, "kept", lambda docs, model: docs.mapInArrow(sizes, "n long"))
    monkeypatch.setattr(P.decontaminate, "clean", lambda docs, benchmark, min_items: docs.mapInArrow(sizes, "n long"))
    for stage in (P.quality_stage, P.benchmark_stage):
        taken = [r["n"] for r in stage(spark, docs, SMALL).collect()]
        assert sum(taken) >= 200 * 63000 and max(taken) <= BATCHES["spark.sql.execution.arrow.maxBytesPerBatch"] + 2 * 63000
    assert dict(spark.conf.getAll) == before
