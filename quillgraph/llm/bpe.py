"""Byte-level BPE ids of many texts at once, equal to those of the `tokenizers` library.

Texts are cut into the tokenizer's pieces (words with their leading space, runs of digits, signs or white space) with
numpy, each distinct piece is encoded once with the same file's ranks and remembered, and the ids are put together by
places. About CACHE pieces are remembered a worker; then it starts anew. A text with an apostrophe (contractions) or
with a character from U+0250 on is given to the library whole. Pieces are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
from functools import cached_property
from pathlib import Path

import numpy as np
import regex

from .wordhash import _BASE, _BASE_INV, mix

CACHE, SLOTS, PROBES = 250_000, 1 << 20, 6
SLICE = 1 << 18
SIMPLE = 0x250
_VALUE = np.random.default_rng(2).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = np.zeros(SIMPLE, np.uint8)
for _c in range(SIMPLE):
    _s = chr(_c)
    _KIND[_c] = 1 if regex.match(r"\p{L}", _s) else 2 if regex.match(r"\p{N}", _s) else 3 if regex.match(r"\s", _s) else 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def piece_encoder(path: str):
    """bytes -> ids for one piece: by ranks where the file's ids follow the order of its merges, else by the library."""
    import tiktoken

    model, byte_of = json.loads(Path(path).read_text())["model"], _byte_of()
    as_bytes = lambda s: bytes(byte_of[c] for c in s)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        return None
    names = {*byte_of, *merged}
    ranks = {as_bytes(s): k for s, k in model["vocab"].items() if s in names}
    made = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return made._encode_single_piece


class Encoder:
    def __init__(self, path: str):
        self.path, self.by_rank = path, piece_encoder(path)
        self.forget()

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.first, self.known = np.empty(1 << 19, np.uint32), np.zeros(CACHE + (1 << 17), np.int64), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        left, h = None, hashes
        for j in range(PROBES):
            slot = ((h + np.uint64(j)) & np.uint64(SLOTS - 1)).astype(np.int64)
            there = self.keys[slot] == h
            value = self.values[slot]
            if left is None:
                out[there] = value[there]
                left = np.flatnonzero(~there)
            else:
                out[left[there]] = value[there]
                left = left[~there]
            if not len(left):
                break
            h = hashes[left]
        return out

    def _keep(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Into the table; what finds no slot in PROBES is encoded anew the next time."""
        for j in range(PROBES):
            slot = ((hashes + np.uint64(j)) & np.uint64(SLOTS - 1)).astype(np.int64)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            mine = free & (self.keys[slot] == hashes)
            self.values[slot[mine]] = numbers[mine]
            hashes, numbers = hashes[~mine], numbers[~mine]
            if not len(hashes):
                return

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        if self.by_rank:
            lists = [self.by_rank(p) for p in pieces]
        else:
            lists = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        k, n = self.known, int(sizes.sum())
        while self.first[k] + n > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids), np.uint32)))
        if k + len(lists) >= len(self.first):
            self.first = np.concatenate((self.first, np.zeros(len(lists), np.int64)))
        self.ids[self.first[k] : self.first[k] + n] = np.fromiter((x for one in lists for x in one), np.uint32, n)
        self.first[k + 1 : k + 1 + len(lists)] = self.first[k] + np.cumsum(sizes)
        self.known += len(lists)
        return np.arange(k, k + len(lists), dtype=np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and each row's first place (rows + 1)."""
        rows = len(offsets) - 1
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.searchsorted(at, offsets)
        odd_chars = np.concatenate(([0], np.cumsum((chars >= SIMPLE) | (chars == 0x27))))
        odd = odd_chars[first[1:]] > odd_chars[first[:-1]]
        if odd.any():
            parts: list[np.ndarray] = [np.empty(0, np.uint32)] * rows
            for r in np.flatnonzero(odd):
                parts[r] = self.whole(data[offsets[r] : offsets[r + 1]].tobytes().decode())
            fine = np.flatnonzero(~odd)
            if len(fine):
                sizes = np.diff(offsets)[fine]
                ids, places = self.encode(np.concatenate([data[offsets[r] : offsets[r + 1]] for r in fine]), np.concatenate(([0], np.cumsum(sizes))))
                for k, r in enumerate(fine):
                    parts[r] = ids[places[k] : places[k + 1]]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        if not len(chars):
            return np.empty(0, np.uint32), np.zeros(rows + 1, np.int64)
        kind = _KIND[chars]
        edge = np.zeros(len(chars), bool)
        edge[first[:-1][np.diff(first) > 0]] = True
        begins = edge.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        words = np.flatnonzero(begins & (kind != 3) & ~edge)  # after something in the same row
        after = words[kind[words - 1] == 3]
        begins[after - 1] = True  # the last white space stands alone, or leads the word if it is a space
        begins[after[chars[after - 1] == 0x20]] = False
        starts = at[begins]
        ends = np.append(starts[1:], len(data))
        if len(data) > 1 << 26:  # a huge row: powers by blocks would be needed
            return self._huge(data, offsets)
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        if self.known > CACHE:
            self.forget()
        place = self._look(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            raw, where = data.tobytes(), missing[where]
            numbers = self._learn([raw[x:y] for x, y in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            self._keep(new, numbers)
            place[missing] = numbers[np.searchsorted(new, hashes[missing])]
        begin = self.first[place]
        n = self.first[place + 1] - begin
        stop = np.cumsum(n)
        ids = self.ids[np.arange(stop[-1]) + np.repeat(begin - (stop - n), n)]
        piece_of_row = np.searchsorted(starts, offsets)
        return ids, np.concatenate(([0], stop))[piece_of_row]

    def _huge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.whole(data[offsets[r] : offsets[r + 1]].tobytes().decode()) for r in range(len(offsets) - 1)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(max(n, SLICE + 1), base, np.uint64)
            steps[0] = 1
            _pow[name] = np.cumprod(steps, dtype=np.uint64)
    return _pow["up"], _pow["down"]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
