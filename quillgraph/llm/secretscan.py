"""Secret scans: fixed patterns, and strings that dictionary-primed zstandard can't compress.

The patterns (assign, access, hex) are matched over every whole text; their spans stay as they are. The method adds
spans of kind `novel`: runs of 16 or more of the characters [A-Za-z0-9+/_.=-] that hold a letter and a digit, are not
inside a base span, and have a word of a sensitive context (key, secret, token, credential, bearer and the like) in
the 48 characters before them. Each is compressed by zstandard with a raw dictionary of common code identifiers and the text around it (up to 400 characters
on either side, the string itself cut out); its novelty is the bytes its frame takes beyond that of an empty input, for each of its
bytes. Strings at or above `least` are reported: words, paths and identifiers are in the dictionary or repeat
themselves and fall below.

Defined cases: null text counts as empty; spans are code points, end exclusive; repeated rows each get their answer;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, AROUND, BEFORE, SHORTEST = 0.62, 400, 48, 16
# The patterns, and the kinds in order.
ASSIGN = re.compile(r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer is dropped anyway, and runs don't overlap
KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT = ("key", "secret", "token", "passw", "passphrase", "credential", "bearer", "auth", "private", "signature", "aws", "pwd")
_CONTEXT = re.compile("|".join(CONTEXT), re.I)
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
IDENTIFIERS = (
    b"import from return function class public private static void string const self this null true false None "
    b"config settings environment variable value default example password username account access secret token "
    b"api_key client_id client_secret authorization Bearer https://www.example.com/index.html http://localhost:8080/ "
    b"/usr/local/lib/python/site-packages/ application/json content-type charset=utf-8 0123456789 abcdefghijklmnopqrstuvwxyz "
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx your_key_here changeme placeholder 2023-01-01T00:00:00Z version 1.0.0 "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS) or not text.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novelty(text: str, start: int, end: int) -> float:
    """Compressed bytes a byte of text[start:end], primed with identifiers and what stands around it."""
    around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    own = text[start:end].encode()
    return (len(made.compress(own)) - len(made.compress(b""))) / len(own)


def novel_spans(text: str, base: list[tuple[int, int, int]], least: float = LEAST) -> list[tuple[int, int, int]]:
    found = []
    for m in _CANDIDATE.finditer(text) if _CONTEXT.search(text) else ():
        own = m[0]
        if not (re.search("[0-9]", own) and re.search("[A-Za-z]", own)) or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        if _CONTEXT.search(text, max(0, m.start() - BEFORE), m.start()) and novelty(text, m.start(), m.end()) >= least:
            found.append((m.start(), 3, m.end()))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                novel = novel_spans(text, base, least)
                rows.append(([sum(k == kind for _, k, _ in base) for kind in range(3)], len(novel), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + novel)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
