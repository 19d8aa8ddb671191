"""Byte-level BPE: a heap of merge ranks over a doubly linked list of symbols, and decoding by joining vocabulary strings.

The vocabulary is a public tokenizer file given by its path; it is read by every Python worker once and never copied.
Work per row is bounded by the row: texts are cut into words as the file's pre-tokenizer does, and the ids of words seen
lately are remembered in a cache of bounded size.

Defined results: a NULL text is encoded as an empty one (no ids); texts of any length are encoded whole; repeated rows
give repeated rows; an empty table gives an empty table; columns beside the id and the text are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from censora.llm.frames import slices, with_fields

# Words whose ids a worker remembers: two generations of this many, about 200 bytes each.
CACHE_WORDS = 250_000

# Texts of these characters alone are cut by the faster of two engines; every letter here is one for both.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^\t\n\r -~{_LETTER[6:]}]")
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters and digits go first: no other alternative begins with one, and most words are letters.
_PLAIN = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|{_TAILS}| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
_ANY = regex.compile(rf"{_TAILS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\p{{White_Space}}\p{{L}}\p{{N}}]+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+")


def words(text: str) -> list[str]:
    """The words that merges stay within; joined they give the text."""
    return (_ANY if _OTHER.search(text) else _PLAIN).findall(text)


def byte_characters() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary writes each byte: itself, or one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_characters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocabulary.items():
            self.strings[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.specials.items():
            self.strings[i] = token.encode()
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocabulary[c]
        self.bits = size.bit_length()
        self.pairs: dict[int, int] = {}  # (left, right) to (rank from 1, merged), each two packed in one integer
        for rank, merge in enumerate(merges, 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocabulary[a] << self.bits | vocabulary[b]] = rank << self.bits | vocabulary[a + b]
        self.cutter = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.cache = Recent(self._word, CACHE_WORDS)

    def _word(self, word: str) -> bytes:
        return struct.pack(f"<{len(ids := self.merge(word.encode()))}I", *ids)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the lowest rank merges first, the leftmost of equal ones.

        The heap is never searched: an entry whose pair has meanwhile changed is stale and skipped when it is popped.
        """
        first, pairs, bits = self.first, self.pairs, self.bits
        symbols = [first[b] for b in word]
        n, known = len(symbols), pairs.get
        heap = [pair << 32 | i for i in range(n - 1) if (pair := known(symbols[i] << bits | symbols[i + 1]))]
        if not heap:
            return symbols
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)
        pop, push, mask = heapq.heappop, heapq.heappush, (1 << bits) - 1
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if known(symbols[i] << bits | symbols[j]) != entry >> 32:
                continue
            symbols[i] = merged = entry >> 32 & mask
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if pair := known(merged << bits | symbols[k]):
                    push(heap, pair << 32 | i)
            if (h := before[i]) >= 0 and (pair := known(symbols[h] << bits | merged)):
                push(heap, pair << 32 | h)
        return [s for s in symbols if s >= 0]

    @functools.cached_property
    def regular(self) -> bool:
        """Every merge makes a string of its own, strings rise in id as the ranks of their merges do, and each merges back to itself.

        Then merging the neighbours with the lowest joined id is merging by rank. Take a pair that no merge lists, though it
        joins to a known string, and whose id is the lowest: all merges of lower rank are done, none across the string's
        edges, so the string alone would come to the same pair and never to itself.
        """
        mask, special = (1 << self.bits) - 1, set(self.specials.values())
        made = [pair & mask for pair in self.pairs.values()]
        rising = all(a < b for a, b in zip(made, made[1:])) and all(max(k >> self.bits, k & mask) < v & mask for k, v in self.pairs.items())
        held = [(i, s) for i, s in enumerate(self.strings) if s and i not in special]
        single = {self.first[b] for b in range(256)}
        whole = len({s for _, s in held}) == len(held) and {i for i, _ in held} == single | set(made)
        return rising and whole and all(self.merge(s) == [i] for i, s in held)

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special strings, and the special strings with their ids."""
        at = 0
        for m in self.cutter.finditer(text) if self.cutter else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.specials[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.cache.__getitem__
        return b"".join(struct.pack("<I", i) if i is not None else b"".join(map(found, words(part))) for part, i in self.parts(text))

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary strings of the ids, joined: the UTF-8 bytes of the text."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, float], Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """The worker's encoder of this file."""
    key = (path, os.path.getmtime(path))
    if key not in _LOADED:
        _LOADED[key] = Bpe(path)
    return _LOADED[key]


def encode(df: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", ids: str = "ids") -> DataFrame:
    """``keep`` columns and the text's ``ids``: little-endian unsigned 32-bit integers in one binary value."""
    rows = df.select(*[df[c] for c in keep], df[text].cast("string").alias("_text"))
    schema = with_fields(df.select(*[df[c] for c in keep]).schema, f"`{ids}` binary")

    def run(batches):
        coder = vocabulary(path)
        for batch in slices(batches):
            packed = [coder.encode(t) if t else b"" for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(packed, pa.binary())], [*keep, ids])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids", text: str = "text") -> DataFrame:
    """``keep`` columns and the ``text`` of the ids; bytes that are no UTF-8 become U+FFFD. NULL ids give an empty text."""
    rows = df.select(*[df[c] for c in keep], df[ids].alias("_ids"))
    schema = with_fields(df.select(*[df[c] for c in keep]).schema, f"`{text}` string")

    def run(batches):
        coder = vocabulary(path)
        for batch in slices(batches):
            texts = [coder.decode(i).decode("utf-8", "replace") if i else "" for i in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, text])

    return rows.mapInArrow(run, schema)
