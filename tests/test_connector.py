"""Extraction by a provider, its errors and costs; lineage metrics, samples to look at, and clusters' colours and titles."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import canonical, connector, insights, report, sampling

GOOD = json.dumps({"aspects": [{"aspect": "refund", "category": "other", "opinion": "slow", "sentiment": "negative", "evidence": "slow refund"}] * 9, "triplets": [], "overall_sentiment": "negative", "is_about_brand": True})


def test_calls_are_retried_and_counted(spark):
    def provider():
        seen = {}

        def call(system, user):
            seen[user] = seen.get(user, 0) + 1
            if user == "breaks":
                raise TimeoutError("late")
            if user == "refused":
                return connector.Reply("", refused=True, input_tokens=5)
            if user == "cut":
                return connector.Reply(GOOD[:9], cut_off=True, input_tokens=5, output_tokens=9)
            bad = user == "second" and seen[user] == 1
            return connector.Reply("{" if bad else "[]" if user == "list" else GOOD, input_tokens=5, output_tokens=2, cache_read_tokens=3)

        return call

    asked = spark.createDataFrame([(m, m) for m in ("good", "second", "cut", "refused", "breaks", "list")] + [("null", None)], "review_id string, message string")
    answers = connector.asked(asked.coalesce(1), provider(), "find aspects")
    got = {r["review_id"]: r for r in answers.collect()}
    assert {k: r["calls"] for k, r in got.items()} == {"good": 1, "second": 2, "cut": 2, "refused": 1, "breaks": 0, "list": 2, "null": 1}
    assert {k for k, r in got.items() if r["extraction"]} == {"good", "second", "null"}
    assert len(got["good"]["extraction"]["aspects"]) == 4 and got["good"]["error"] is None and got["second"]["error"] is None
    assert got["breaks"]["error"] == "TimeoutError: late" and got["list"]["error"] == "not of the asked form"
    used = connector.usage(answers).first()
    assert (used["calls"], used["input_tokens"], used["output_tokens"], used["cache_read_tokens"]) == (9, 45, 30, 18)
    assert used["cost_usd"] == pytest.approx((45 * 2 + 30 * 10 + 18 * 0.2) / 1e6, abs=1e-6)
    assert connector.usage(answers.limit(0)).first()["cost_usd"] == 0


def test_a_refused_key_ends_the_job(spark):
    def denied(system, user):
        raise connector.AccessDenied("key")

    with pytest.raises(Exception, match="AccessDenied"):
        connector.asked(spark.createDataFrame([(1, "x")], "review_id long, message string"), denied, "").collect()


def test_providers_read_both_dialects(monkeypatch):
    sent = []
    monkeypatch.setattr(connector, "_posted", lambda url, headers, body, timeout: sent.append((headers, body)) or replies.pop())
    replies = [
        {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "stop_reason": "max_tokens", "usage": {"input_tokens": 1, "cache_read_input_tokens": 4}},
        {"choices": [{"message": {"content": None}, "finish_reason": "length"}], "usage": {"prompt_tokens": 7, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 3}}},
    ]
    assert connector.chat_provider("u", "m", "k")("s", "x") == connector.Reply("", True, False, 4, 2, 0, 3)
    assert connector.messages_provider("u", "m", "k", "v")("s", "x") == connector.Reply("ab", True, False, 1, 0, 0, 4)
    assert sent[0][1]["messages"][1]["content"] == "x" and sent[1][1]["system"][0]["text"] == "s"


def test_lineage_metrics(spark):
    lined = spark.createDataFrame([("A", "a", "a", "e1", "exact", 100.0, 3), ("a", "a", "a", "e1", "exact", 100.0, 1), ("ab", "ab", "a", "e1", "fuzzy", 91.0, 1), ("ac", "ac", "a", "e1", "fuzzy", 90.5, 2), ("b", "b", "b", "e2", "exact", 100.0, 1)], "raw string, normalized string, canonical string, entity_id string, merge string, fuzzy_score double, n_mentions long")
    assert tuple(canonical.lineage_metrics(lined).first()) == (5, 4, 2, 2)
    assert sorted(map(tuple, canonical.entity_forms(lined).collect())) == [("e1", 4, 7), ("e2", 1, 1)]
    assert [r["raw"] for r in canonical.fuzzy_merges(lined).collect()] == ["ac", "ab"]
    assert tuple(canonical.lineage_metrics(lined.limit(0)).first()) == (0, 0, 0, 0)


def test_matrix_and_display_sample(spark):
    shared = spark.createDataFrame([("k", "2020", 0.5), ("k", "2021", 0.25), ("l", "2020", 0.0)], "key string, period string, share double")
    assert sorted(map(tuple, insights.period_matrix(shared).collect())) == [("k", 0.5, 0.25), ("l", 0.0, None)]
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    one, two = (sampling.display_sample(r, "id", 7).collect() for r in (rows, rows.repartition(5)))
    assert one == two and len(one) == 7 and one != sampling.display_sample(rows, "id", 7, seed=1).collect()


def test_cluster_colors_and_titles(spark):
    clusters = spark.createDataFrame([(f"e{k}-{i}", k, f"{k}.{i % 2}") for k in range(10) for i in range(10 - k)] + [("x", -1, "-1")], "entity_id string, macro_cluster int, micro_cluster string")
    colors = {r["cluster"]: (r["size"], r["color"]) for r in report.cluster_colors(clusters).collect()}
    assert colors["0"] == (10, report.PALETTE[0]) and colors["7"] == (3, report.PALETTE[7]) and colors["8"] == (2, report.OTHER) and "-1" not in colors
    interests = spark.createDataFrame([("macro", "0", "Zero"), ("micro", "0.1", "Zero one")], "level string, cluster string, title string")
    titles = {r["cluster"]: r["title"] for r in report.cluster_titles(clusters, interests, "micro").collect()}
    assert titles["0.1"] == "Zero one" and titles["0.0"] == "Zero" and titles["5.1"] == "Minor cluster 5.1" and titles["-1"] == "Minor cluster -1"
