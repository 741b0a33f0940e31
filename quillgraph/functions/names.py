"""Entity names: normalization with its trace, and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import Brand
from .text import canonical_brand, nfkc_casefold

# Words in s that aren't plurals.
SINGULAR = ("news", "series", "analytics", "status", "access", "process", "address", "business", "bonus", "focus", "virus", "sms", "always", "less", "terms", "this", "his", "is", "yes", "us", "gas", "plus")
# Fixed value: punctuation that isn't part of a name.
PUNCTUATION = "[\"'`.,;:!?()\\[\\]]"
STEPS = ("raw", "brand spellings", "case and width", "punctuation and article", "last word singular")


def singular(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(word.isin(*SINGULAR) | (F.length(word) <= 3), word)
        .when(word.rlike("ies$") & (F.length(word) > 4), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(?:ss|sh|ch|x)es$"), cut(2))
        .when(word.rlike("(?<![suio])s$"), cut(1))
        .otherwise(word)
    )


def _bare(name: Column) -> Column:
    name = F.regexp_replace(name, PUNCTUATION, " ")
    name = F.regexp_replace(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), r"^(?:the|an?) ", "")
    return F.trim(F.regexp_replace(name, r"(?U)[\s-]+", " "))


def _head_singular(name: Column) -> Column:
    last = F.substring_index(name, " ", -1)
    return F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(last)), singular(last))


def normalize_trace(name: Column, brand: Brand) -> Column:
    """array(struct(step, result)); the last result is the name."""
    raw = F.coalesce(name, F.lit(""))
    spelled = canonical_brand(raw, brand)
    folded = nfkc_casefold(spelled)
    bare = _bare(folded)
    return F.array(*(F.struct(F.lit(step).alias("step"), result.alias("result")) for step, result in zip(STEPS, (raw, spelled, folded, bare, _head_singular(bare)), strict=True)))


def normalize_name(name: Column, brand: Brand) -> Column:
    return _head_singular(_bare(nfkc_casefold(canonical_brand(F.coalesce(name, F.lit("")), brand))))


def changed_steps(trace: Column) -> Column:
    """Names of the steps that changed the name."""
    kept = F.filter(trace, lambda step, k: (k > 0) & (step["result"] != F.get(trace, k - 1)["result"]))
    return F.transform(kept, lambda step: step["step"])


def slug(name: Column) -> Column:
    return F.concat(F.lit("e_"), F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")))
