"""The command line build, the report, streaming, caches, and SQL parity of the queries."""

import csv
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph import __main__ as cli
from quillgraph.operators import report
from quillgraph.plans import catalog
from quillgraph.sources import reviews as source
from quillgraph.streaming import events

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_build_and_report(spark, tmp_path):
    path = tmp_path / "raw.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow("review_id created_date stars Title Text source language".split())
        for k in range(160):
            bad = k % 2
            text = "They removed my honest review, \"fake\" account support and the scam email never stopped" if bad else "Easy and simple to check a shop, honest reviews and great trust before buying things"
            out.writerow([f"r{k}", f"2021-{1 + k % 4:02d}-03T10:00:00Z", 1 if bad else 5, "", text, "O" if bad else "F", "nb" if k == 0 else "en"])
    cli.build(spark, str(path), str(tmp_path / "gold"), sample=1000)
    tables = source.load(spark, str(tmp_path / "gold"))
    assert tables["gold_reviews"].count() == 160 and tables["gold_interests"].count() >= 2
    assert tables["gold_reviews"].where("review_id = 'r0'").first()["language"] == "no"
    page = cli.write_report(spark, str(tmp_path / "gold"))
    assert "160 reviews" in page and "Organic reviews average 1.0 stars" in page
    assert source.load_optional(spark, str(tmp_path / "none.parquet")) is None
    assert {json.loads(r["value"])["type"] for r in spark.read.text(str(tmp_path / "gold/graph.json")).collect()} == {"node", "edge"}


def test_report_parts():
    assert report.sparkline([0, 1, 2], 10, 10) == "0.0,10.0 5.0,5.0 10.0,0.0" and report.sparkline([]) == ""
    assert report.findings([], [], []) == ["No interest rises or falls clearly."]
    assert '"a\\"b" -> "c"' in report.lineage_dot([('a"b', "c")], "d")


def test_json_cache_keeps_the_last(spark, tmp_path):
    for seq, v in ((1, "old"), (2, "new")):
        source.append_cache(spark.createDataFrame([("k", seq, v)], "key string, seq int, value string"), str(tmp_path / "c"))
    assert [r["value"] for r in source.json_cache(spark, str(tmp_path / "c"), "key string, seq int, value string").collect()] == ["new"]


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.read(spark, str(tmp_path / "in"), table.schema))
    started = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert started.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.windowed(table).collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    rows = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(rows.columns)
    got = sorted(str([_plain(r[c]) for c in columns]) for r in rows.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    answer = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert sorted(str([_plain(r[names.index(c)]) for c in columns]) for r in answer.fetchall()) == got


def _plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
