"""Best-fit packing of token sequences: a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The program (cover the count of every length with as
few configurations as possible) is solved by multiplicative weights: a length that is covered well loses weight, and a
knapsack dynamic program over the weights prices the next configurations. Whole copies are taken from the fractional
solution; what is left over is packed best-fit, longest first. All of this sees the histogram alone, which has at most
``capacity`` entries at any data size; pieces find their places by number within their length.

Defined results: a NULL or empty text is one piece that holds the closing id; a text of any length is kept whole, cut
into full pieces behind a shorter first one; equal lengths are told apart by number; repeated rows are packed each on
their own; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censora.llm import bpe
from censora.llm.frames import numbered, slices, with_fields
from censora.session import materialise

# Rounds of the weights (rounded solutions are looked at every STRIDE of them), how fast weights fall with the cover, and
# the share of the best price a configuration needs to be taken up in a round.
ROUNDS, STRIDE, RATE, NEAR = 240, 40, 0.3, 0.995
# A rounding takes whole copies of the configurations filled at least so far; the rest is packed best-fit.
FILLED = (1.0, 0.999, 0.99, 0.0)
# The search ends when a rounding is within this share of the lower bound.
GAP = 1e-4


# Words whose ids a worker remembers: two generations of this many. Longer words than LONG characters are left to the library.
KNOWN_WORDS, LONG = 700_000, 400


class LibraryIds:
    """A text's ids as the tokenizers library gives them, word by word: those of a text are those of its words, joined.

    Where the vocabulary is ``regular`` (``bpe.Bpe.regular``), a word that is not remembered is encoded by a second library
    that takes the lowest id of all neighbours whose strings join to a known one; there this is the lowest rank of all
    merges. Of any other vocabulary, and for very long words, the tokenizers library itself is asked.
    """

    def __init__(self, path: str, regular: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cut = bpe.vocabulary(path)
        if regular:
            import tiktoken

            special = set(self.cut.specials.values())
            ranks = {s: i for i, s in enumerate(self.cut.strings) if s and i not in special}
            self.short = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.short = self.by_library
        self.known = bpe.Recent(self._word, KNOWN_WORDS)

    def by_library(self, word: str) -> list[int]:
        return self.library.encode(word, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        ids = self.short(word) if len(word) <= LONG else self.by_library(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def batch(self, texts: list[str]) -> list[bytes]:
        found = self.known.__getitem__
        join = lambda part: b"".join(map(found, bpe.words(part)))
        return [b"".join(struct.pack("<I", i) if i is not None else join(part) for part, i in self.cut.parts(t)) for t in texts]


_LIBRARY: dict[tuple[str, bool], LibraryIds] = {}


def pieces(df: DataFrame, path: str, capacity: int, end_id: int = 0, keep: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, its ``ids``."""
    rows = df.select(df[keep], df[text].cast("string").alias("_text"))
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    key = (path, bpe.vocabulary(path).regular)

    def run(batches):
        if key not in _LIBRARY:
            _LIBRARY[key] = LibraryIds(*key)
        coder = _LIBRARY[key]
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches):
            owner, out = [], ([], [], [], [], [])
            for row, ids in enumerate(coder.batch([t or "" for t in part.column(1).to_pylist()])):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                edges = [0, *range(first, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    held = ids[4 * a : 4 * b]
                    owner.append(row)
                    for column, value in zip(out, (k, a, b - a, zlib.crc32(held), held if with_ids else None)):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(out, kinds)][: 5 if with_ids else 4]
            names = [keep, "piece", "start", "length", "ids_crc32", "ids"][: 1 + len(columns)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *columns], names)

    return rows.mapInArrow(run, with_fields(df.select(df[keep]).schema, fields))


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best value of each size up to ``capacity``, and the length last put in (0: none).

    ``values[l]`` is what a piece of length ``l`` is worth; lengths worth nothing are left out.
    """
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for size in range(1, capacity + 1):
        best[size] = best[size - 1]
        if n := ends[size]:
            gain = best[size - lengths[:n]] + worth[:n]
            top = gain.argmax()
            if gain[top] > best[size]:
                best[size], last[size] = gain[top], lengths[top]
    return best, last


def contents(size: int, last: np.ndarray) -> list[int]:
    out = []
    while size > 0:
        if last[size]:
            out.append(int(last[size]))
            size -= int(last[size])
        else:
            size -= 1
    return out


def covers(demand: np.ndarray, capacity: int) -> Iterator[tuple[dict[tuple[int, ...], float], float]]:
    """Ever better fractional covers of the demand (how often each configuration is used), each with a lower bound.

    Prices divided by the best configuration's price are a solution of the dual program, which bounds every packing.
    """
    lengths = np.flatnonzero(demand)
    need = demand[lengths].astype(float)
    place = {int(v): i for i, v in enumerate(lengths)}
    covered, used, bound = np.zeros(len(lengths)), Counter(), 0.0
    for k in range(1, ROUNDS + 1):
        values = np.zeros(capacity + 1)
        values[lengths] = np.exp(-RATE * (covered - covered.min())) * lengths / capacity
        best, last = price(values, capacity)
        bound = max(bound, float(values[lengths] @ need / best[capacity]))
        reach = values[lengths] + best[capacity - lengths]
        taken = {tuple(sorted([int(v), *contents(capacity - int(v), last)])) for v in lengths[reach >= NEAR * best[capacity]]}
        shared = Counter(v for c in taken for v in set(c))
        for c in sorted(taken):
            times = min(need[place[v]] / (m * shared[v]) for v, m in Counter(c).items())
            used[c] += times
            for v, m in Counter(c).items():
                covered[place[v]] += m * times / need[place[v]]
        if k % STRIDE == 0:
            scale = max(1.0, float(np.median(covered)))
            yield {c: x / scale for c, x in used.items()}, bound


def best_fit(demand: np.ndarray, capacity: int) -> Counter:
    """Best-fit, longest first, on counts: sequences alike in content are filled together."""
    done: Counter = Counter()
    room: dict[int, Counter] = {}
    open_sizes: set[int] = set()
    for length in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[length])
        for size in sorted(s for s in open_sizes if s >= length):
            if not left:
                break
            group = room[size]
            for content, n in sorted(group.items()):
                if not left:
                    break
                each = size // length
                full = min(n, left // each)
                for times, m in ((full, each), (1 if full < n and 0 < left - full * each < each else 0, left - full * each)):
                    if times and m:
                        group[content] -= times
                        room.setdefault(size - m * length, Counter())[content + (length,) * m] += times
                        open_sizes.add(size - m * length)
                        left -= times * m
            for content in [c for c, n in group.items() if not n]:
                del group[content]
            if not group:
                open_sizes.discard(size)
        each = capacity // length
        for times, m in ((left // each, each), (1 if left % each else 0, left % each)):
            if times and m:
                room.setdefault(capacity - m * length, Counter())[(length,) * m] += times
                open_sizes.add(capacity - m * length)
    for group in room.values():
        for content, n in group.items():
            done[tuple(sorted(content))] += n
    return done


def rounded(cover: dict[tuple[int, ...], float], demand: np.ndarray, capacity: int, filled: float) -> Counter:
    """Whole copies of the cover's configurations, fuller ones first, and best-fit for what they leave."""
    demand, plan = demand.copy(), Counter()
    for config, times in sorted(cover.items(), key=lambda c: (-sum(c[0]), -c[1], c[0])):
        if sum(config) >= filled * capacity:
            count = Counter(config)
            n = min(int(times + 1e-9), *(int(demand[v]) // m for v, m in count.items()))
            if n > 0:
                plan[config] += n
                for v, m in count.items():
                    demand[v] -= m * n
    plan.update(best_fit(demand, capacity))
    return plan


def solve(demand: np.ndarray, capacity: int) -> Counter:
    """How often each configuration is used so that every piece has its place; the best rounding of all covers."""
    demand = demand.astype(np.int64).copy()
    whole = Counter({(capacity,): int(demand[capacity])} if demand[capacity] else {})
    demand[capacity] = 0
    best: Counter | None = None
    for cover, bound in covers(demand, capacity) if demand.any() else ():
        for filled in FILLED:
            plan = rounded(cover, demand, capacity, filled)
            if best is None or plan.total() < best.total():
                best = plan
        if best.total() <= np.ceil(bound - 1e-6) * (1 + GAP):
            break
    return whole + (best or Counter())


def places(plan: Counter) -> np.ndarray:
    """Rows (length, first number, times, copies, first sequence, offset), sorted: where the numbered pieces go."""
    out, taken, base = [], Counter(), 0
    for config, times in sorted(plan.items()):
        offset = 0
        for v, m in sorted(Counter(config).items()):
            out.append((v, taken[v], times, m, base, offset))
            taken[v] += times * m
            offset += v * m
        base += times
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(cut: DataFrame, capacity: int, identity: Sequence[str] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``cut`` (a stored table with ``length``) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    histogram = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        demand[length] = n
    table = spark.sparkContext.broadcast(places(solve(demand, capacity)))  # at most rounds x capacity configurations
    names = cut.columns
    rows = numbered(cut, ["length"], identity, "_number").select(*names, "_number")

    def run(batches):
        t = table.value
        # One sortable key: pieces of a length are numbered below 2^50.
        keys = t[:, 0] * (1 << 50) + t[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in (names.index("length"), len(names)))
            at = np.searchsorted(keys, length * (1 << 50) + number, "right") - 1
            _, first, _, copies, base, offset = t[at].T
            nth = number - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(base + nth // copies), pa.array(offset + nth % copies * length)], [*names, "sequence_id", "offset"]
            )

    return rows.mapInArrow(run, with_fields(cut.schema, "sequence_id long, offset long"))


def packed_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all texts with their places; texts are read and encoded once."""
    return pack(materialise(pieces(df, path, capacity, end_id, keep, text), "pieces"), capacity, (keep, "piece", "start", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ``ids``: ``sequence_id`` and its joined ``ids`` (at most one capacity)."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("held"), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", joined.alias("ids"))
