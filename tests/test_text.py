"""Cleaning, names and similarity."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names as N
from quillgraph.functions import text as T
from quillgraph.functions.similarity import common_length, ratio, token_sort_ratio
from quillgraph.plans.config import Brand

BRAND = Brand()


def value(spark, column, **columns):
    df = spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in columns.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, clean", [
    ("Trov&#230;rdig og p&#229;lidelig", "Troværdig og pålidelig"), ("don&#39;t  stop &#128077;", "don't stop 👍"), ("don’t go…", "don't go..."), ("don´t", "don't"), ("a​b   c\n\n\nd", "ab c\nd"), (None, ""), ("  x   y ", "x\ny"),
])
def test_normalized_text(spark, raw, clean):
    assert value(spark, T.normalize_text(F.col("t")), t=raw) == clean


@pytest.mark.parametrize("form", ["shop voice", "Shop-Voice", "SHOPVOICE's", "Shopvoce", "shopvioce", "sohpvoice", "Shopvoice.com", "SV"])
def test_brand_spellings(spark, form):
    assert value(spark, T.canonical_brand(F.col("t"), BRAND), t=f"I like {form} a lot").lower() == "i like shopvoice a lot"


def test_other_words_stay(spark):
    text = "I shop here, shopping and voices. Testing sv lowercase."
    assert value(spark, T.canonical_brand(F.col("t"), BRAND), t=text) == text


@pytest.mark.parametrize("title, kept, text", [
    ("It is an excellent platform for...", False, None), ("It is an excellent platform for our customers", False, None), ("excellent platform", False, None), ("Review deleted", True, "Review deleted\nIt is an excellent platform for our customers"), ("", False, None), ("👍", False, None),
])
def test_titles(spark, title, kept, text):
    body = "It is an excellent platform for our customers"
    got = value(spark, T.merge_title(F.col("a"), F.col("b")), a=title, b=body)
    assert (got["text"], got["kept"]) == (text or body, kept)


def test_title_without_body(spark):
    got = value(spark, T.merge_title(F.col("a"), F.col("b")), a=" only ", b="")
    assert (got["text"], got["kept"]) == ("only", True)


def test_truncation(spark):
    assert value(spark, T.truncate_text(F.col("t"), 100), t="short review") == "short review"
    assert value(spark, T.truncate_text(F.col("t"), 12), t="one two three four five") == "one two [...]"


@pytest.mark.parametrize("text, low", [("👍👍👍", True), ("Excellent service!", True), ("My genuine review was removed without reason", False)])
def test_low_content(spark, text, low):
    assert value(spark, T.is_low_content(F.col("t")), t=text) is low


@pytest.mark.parametrize("raw, name", [("Fake Reviews", "fake review"), ("Shop Voice", "shopvoice"), ("the business", "business"), ("Companies", "company"), ("e-mail", "e mail"), (None, ""), ("An (old) boxes", "old box")])
def test_names_and_traces(spark, raw, name):
    assert value(spark, N.normalize_name(F.col("t"), BRAND), t=raw) == name
    trace = value(spark, N.normalize_trace(F.col("t"), BRAND), t=raw)
    assert trace[0]["result"] == (raw or "") and trace[-1]["result"] == name and len(trace) == 5


def test_slugs_and_changed_steps(spark):
    assert value(spark, N.slug(F.col("t")), t="e mail & co.") == "e_e_mail_co"
    traced = spark.range(1).select(N.normalize_trace(F.lit("Emails"), BRAND).alias("trace"))
    assert traced.select(N.changed_steps(F.col("trace")).alias("c")).first()["c"] == ["case and width", "last word singular"]


def test_ratios_equal_the_plain_definition(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b):
                last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(9))) for _ in range(2))
        assert common_length(a, b) == plain(a, b)
    assert round(ratio("email", "e mail"), 1) == 90.9 and ratio("", "") == 100
    assert value(spark, token_sort_ratio(F.col("a"), F.col("b")), a="review fake", b="fake  review") == 100


def test_a_look_ahead_changes_no_match():
    import re

    from quillgraph.operators.explore import NOISE, THEMES, led

    assert all(led(p).startswith("(?=[") for p in THEMES.values()) and led("a?b") == "a?b" and led(NOISE["phone"]) == NOISE["phone"]
    texts = ["They REMOVED it", "taken down", "my  business", "Check the company", "before you buy", "user-friendly", "nothing here", "", "Our customers", "harassed"]
    for p in THEMES.values():
        assert [bool(re.search(f"(?i){led(p)}", t)) for t in texts] == [bool(re.search(f"(?i){p}", t)) for t in texts]
