"""Chat formatting by incremental black-box rendering.

A template is a function from turns to one string; nothing else is known of it. The successive prefixes of a
conversation are rendered and consecutive outputs compared: what a prefix adds to the one before is the turn's span;
if the earlier output isn't a prefix of the later one, the template rewrites history, and this is reported with the
place. Every prefix is rendered and compared, at every length, so a template that rewrites at one length only is found
out; the comparing is native, and the default template keeps each turn's rendered form, so a prefix is one join. The text's own
span inside its turn is found by rendering two other last texts: what the outputs share at both ends is the template's. These
probes begin one turn back if the turn adds there exactly what it adds to the whole prefix, else they are rendered after the whole
prefix too.

Rows are dealt by conversation and sorted by turn (then role and text); one conversation is in memory at a time, as its
output is one string anyway. Its prefixes take work with the square of its turns. Defined cases: very long texts are taken whole; null text and role count as empty; rows with null conv_id are one
conversation; turns of equal number follow by role and text, repeated rows are repeated turns; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
KEPT_CHARS = 1 << 26
OPEN, CLOSE = "### ", "</turn>"


def escaped(text: str) -> str:
    """Control strings and backslashes get a backslash before them."""
    return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _role(role: str) -> str:
    return re.sub(r"[\\:]|###|</turn>", lambda m: "\\" + m[0], role)


class _Rendered(dict):
    """Each turn as the default template writes it, kept up to KEPT_CHARS."""

    chars = 0

    def __missing__(self, turn: Turn) -> str:
        if self.chars > KEPT_CHARS:
            self.clear()
            self.chars = 0
        made = f"{OPEN}{_role(turn[0])}: {escaped(turn[1])}{CLOSE}\n"
        self.chars += len(made)
        self[turn] = made
        return made


_rendered = _Rendered()


def render(turns: list[Turn]) -> str:
    """The default template: `### role: text</turn>` and a new line for each turn."""
    return "".join(map(_rendered.__getitem__, turns))


@dataclass
class Located:
    output: str
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)  # turns at which earlier output changed


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving what is compared."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def _inner(before: list[Turn], turn: Turn, output: str, start: int, template: Callable[[list[Turn]], str]) -> tuple[int, int]:
    """Where in output the turn's text is: what two other texts leave alone is the template's."""
    one, two = (template([*before, (turn[0], probe)]) for probe in ("q", "zz"))
    head = max(_common(one, two), start)
    tail = _common(one[head:][::-1], two[head:][::-1])
    return head, max(len(output) - tail, head)


def _text(turns: list[Turn], k: int, output: str, start: int, template: Callable[[list[Turn]], str]) -> tuple[int, int]:
    """Where in the prefix's output the text of its last turn is."""
    near = turns[max(k - 1, 0) : k]
    earlier, later = template(near) if near else "", template([*near, turns[k]])
    if later.startswith(earlier) and later[len(earlier) :] == output[start:]:
        a, b = _inner(near, turns[k], later, len(earlier), template)
        return start + a - len(earlier), start + b - len(earlier)
    return _inner(turns[:k], turns[k], output, start, template)


def locate(turns: list[Turn], template: Callable[[list[Turn]], str] = render) -> Located:
    found, earlier = Located(""), ""
    for k in range(len(turns)):
        output = template(turns[: k + 1])
        same = len(earlier) if output.startswith(earlier) else _common(earlier, output)
        if same < len(earlier):
            found.rewrites.append(k)
        found.turns.append((same, len(output)))
        found.texts.append(_text(turns, k, output, same, template))
        earlier = output
    found.output = earlier
    return found


def read_back(found: Located) -> list[Turn]:
    """Turns from the default template's output, by the spans."""
    out = []
    for (a, b), (c, d) in zip(found.turns, found.texts, strict=True):
        head = found.output[a:c]
        if not head.startswith(OPEN) or not head.endswith(": ") or not found.output[d:b].startswith(CLOSE):
            raise ValueError(f"no turn at {a}")
        out.append((unescaped(head[len(OPEN) : -2]), unescaped(found.output[c:d])))
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    now, turns = None, []
    for batch in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns and conv_id != now:
                yield now, turns
                turns = []
            now = conv_id
            turns.append((role, text))
    if turns:
        yield now, turns


def _grouped(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


FORMATTED = "conv_id long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, rewrites_history boolean"


def formatted(conversations: DataFrame, template: Callable[[list[Turn]], str] = render, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: the output, each turn's span, the spans under the loss mask, whether history was rewritten."""

    def run(batches):
        for conv_id, turns in _conversations(batches):
            found = locate(turns, template)
            mask = [list(s) for (role, _), s in zip(turns, found.texts, strict=True) if role == loss_role]
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv_id, "formatted": found.output, "turn_spans": [list(s) for s in found.turns], "loss_spans": mask, "rewrites_history": bool(found.rewrites)}],
                schema=pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_spans", pa.list_(pa.list_(pa.int64()))), ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("rewrites_history", pa.bool_())]),
            )

    return _grouped(conversations).mapInArrow(run, FORMATTED)


def digests(made: DataFrame) -> DataFrame:
    """From the default template's `formatted` rows, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                output = r["formatted"]
                spans, ends = r["turn_spans"], [b for _, b in r["turn_spans"]]
                texts = [_text_span(output, a, b) for a, b in spans]
                turns = read_back(Located(output, spans, texts))
                whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                for a, b in r["loss_spans"]:
                    text = unescaped(output[a:b])
                    loss.update(text.encode())
                    chars += len(text)
                rows.append({"conv_id": r["conv_id"], "n_turns": len(ends), "turns_sha256": whole.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(output)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return made.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _text_span(output: str, a: int, b: int) -> tuple[int, int]:
    """Between the turn's header, which ends at its first unescaped colon, and its closing mark."""
    at = a + len(OPEN)
    while output[at] != ":":
        at += 2 if output[at] == "\\" else 1
    return at + 2, b - len(CLOSE) - 1
