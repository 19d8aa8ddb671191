"""Near-duplicates by shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

No link is lost. Equal sets are one node; what remains are sets that share four fifths of their hashes. This is used three times:

* Opening: in hash order, the first hashes that two similar sets share are among the first 40 % of each. So of a set with a
  similar one a known number of these opening hashes occurs in other sets. Sets with fewer go: most texts of a corpus, and
  those that share but passages with others. Only opening hashes are shuffled for that, and hashes that a task has met
  several times once.
* Prefix: of the sets left, hashes are counted. Each set is put in order, rarest hash first. Two similar sets share a hash
  in the first fifth (and one) of both. Hashes of one set alone are not kept, only their number; frequent passages are last.
* Place: the places of the first hash two sets share, and their sizes, bound what they can share altogether.

Two ways lead to candidates. Each set of those left has a SimHash fingerprint, and the vantage-point trees of ``simhash`` find
partners within ``REACH`` bits. Similar sets may differ in more bits, so sets with a common prefix hash are candidates as well:
these are all. A sketch of counts rules most candidates out without their sets: the counts of two sets differ by no more than the
sets do. Those left are linked only after their intersection is known exactly.

Groups of copies are not paired out: every set is first compared with its partner of the trees and with one other, the smallest
of all that share a prefix hash with it; then, where sets of a hash are still apart, with the smallest of each such hash; and only
sets that are then in different components are compared with each other, in blocks within a task: by sketches first, then those
with a candidate by the sets themselves. Only a forest of the similar pairs of two blocks becomes rows.

Defined results: words are runs of other characters than the six ASCII white spaces, lower-cased in A-Z alone; a text of
one to four words is one shingle; texts without words (NULL or empty) are alike; repeated shingles count once; texts are
read whole; NULL ids are never the smallest unless a component has no other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.llm.components import components
from censora.llm.frames import aside, slices, with_fields
from censora.llm.simhash import grouped, partners, print_of
from censora.session import materialise

SHINGLE, SEED = 5, 42
# Prints of sets that a task remembers having opened; opening hashes it holds before they go on.
OPENED, STEP = 200_000, 1 << 18
# Counts of a sketch: how many hashes of the set fall to each of so many cells, 255 at most; larger sets have more cells.
CELLS, LARGE, LARGE_CELLS = 256, 2_000, 4_096
# Bits that partners of the trees may differ in; sets of one hash that are compared with as many others at once, and the
# hashes that these may hold altogether.
REACH, BLOCK, BLOCK_HASHES = 4, 1_024, 1 << 20
_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - SHINGLE]]).tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64))


def set_print(own: np.ndarray) -> int:
    """64 bits for the whole set."""
    return xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MORE
    return x ^ (x >> np.uint64(32))


def opening(own: np.ndarray) -> np.ndarray:
    """The first hashes: as many as the set may have without a partner, and a fifth of the set."""
    n = len(own)
    return own[: n // 5 + -(-n // 5)]


def needed(size: int) -> int:
    """How many of its opening hashes a set shares with any similar set, which has four fifths of its size at least."""
    return -(-(-(-4 * size // 5)) // 5)


def sketch(own: np.ndarray) -> bytes:
    """The counts of the set's cells."""
    cells = LARGE_CELLS if len(own) > LARGE else CELLS
    found = np.bincount((mixed(own ^ _MORE) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def folded(found: bytes) -> bytes:
    """The sketch with ``CELLS`` cells: cells of a larger one are parts of these."""
    if len(found) == CELLS:
        return found
    return np.minimum(np.frombuffer(found, np.uint8).astype(np.int64).reshape(-1, CELLS).sum(0), 255).astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """False only for sketches of sets that differ in more than (a + b) / 9 hashes."""
    allowed = size_a + size_b
    if 9 * abs(size_a - size_b) > allowed:
        return False
    if len(a) != len(b):
        a, b = folded(a), folded(b)
    one, two = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b))
    return 9 * int(np.abs(one - two).sum()) <= allowed


def with_prints(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the print of the text's set, its size and its sketch (``_size`` and ``_sketch``)."""
    names, place = docs.columns, docs.columns.index(text)
    rows = docs.withColumn(text, F.col(f"`{text}`").cast("string"))

    def run(batches):
        for batch in slices(batches):
            owns = [shingles(t) for t in batch.column(place).to_pylist()]
            found = np.array([set_print(own) for own in owns], np.uint64).view(np.int64)
            added = [pa.array(found), pa.array([len(own) for own in owns], pa.int64()), pa.array([sketch(own) for own in owns], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, name, "_size", "_sketch"])

    return rows.mapInArrow(run, with_fields(rows.schema, f"`{name}` long, _size long, _sketch binary"))


def met_rows(held: list[tuple[int, int, np.ndarray, int]]) -> pa.RecordBatch:
    """Rows of ``opened`` for some sets (print, part, hashes, size). A hash of several of them is sent once, with ``n`` 0, for the
    sets of other tasks; that it is met is known here, and each set's number of such hashes is sent as a negative ``n``."""
    prints, parts = (np.array([h[k] for h in held], np.int64) for k in range(2))
    lengths = np.array([len(h[2]) for h in held])
    need = np.array([needed(h[3]) for h in held], np.int64)
    # 48 bits: hashes do not compress, and a hash too many that seems met loses nothing.
    hashes, whose = np.concatenate([h[2] for h in held]) >> np.uint64(16), np.repeat(np.arange(len(held)), lengths)
    order = np.argsort(hashes, kind="stable")
    hashes, whose = hashes[order].view(np.int64), whose[order]
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    several = again | np.concatenate([again[1:], [False]])
    known = np.bincount(whose[several], minlength=len(held))
    # Back in the order of sets: rows of one set together compress.
    sent = np.flatnonzero(~again)
    sent = sent[np.argsort(whose[sent], kind="stable")]
    some = np.flatnonzero(known)
    at = np.concatenate([whose[sent], some])
    n = np.concatenate([np.where(several[sent], 0, 1), -known[some]])
    columns = [np.concatenate([hashes[sent], prints[some]]), prints[at], parts[at], need[at], n]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["sig", "print", "part", "need", "n"])


def opened(texts: DataFrame) -> DataFrame:
    """``sig`` for the opening hashes of the sets of ``texts`` (print, text), with the ``print``, the ``part`` of a task that read
    it and how many are ``needed``; equal sets are opened once by a task that remembers them."""

    def run(batches):
        seen: set[int] = set()
        part, held, rows = TaskContext.get().partitionId() << 24, [], 0
        for batch in slices(batches):
            if len(seen) >= OPENED:
                seen.clear()
                part += 1
            for own_print, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own_print in seen:
                    continue
                seen.add(own_print)
                own = shingles(text)
                if len(own):
                    held.append((own_print, part, opening(own), len(own)))
                    rows += len(held[-1][2])
            if rows > STEP:
                yield met_rows(held)
                held, rows = [], 0
        if held:
            yield met_rows(held)

    return texts.mapInArrow(run, "sig long, print long, part long, need long, n long")


def involved(texts: DataFrame) -> DataFrame:
    """``_print`` of the sets of which enough opening hashes occur in other sets."""
    met = W.partitionBy("sig")
    found = F.when(F.col("n") < 0, -F.col("n")).when(F.min("print").over(met) < F.max("print").over(met), F.col("n")).otherwise(0)
    counted = opened(texts).withColumn("found", found).where("found > 0").groupBy("print", "part", "need").agg(F.sum("found").alias("found"))
    return counted.where("found >= need").select(F.col("print").alias("_print")).distinct()


def prefixes(known: DataFrame) -> DataFrame:
    """``sig``, ``print``, ``size`` and ``place`` of the prefix hashes that occur in several of the sets ``known``.

    A hash of any number of sets is counted before the shuffle and split by the join.
    """
    rows = known.select("print", F.size("set").alias("size"), F.explode("set").alias("sig"))
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = W.partitionBy("print")
    several, rank = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("often", "sig"))
    placed = rows.join(often, "sig").select("*", several.alias("several"), rank.alias("rank"))
    placed = placed.where("5 * several >= 4 * size").withColumn("place", F.expr("size - several + rank"))
    return placed.where("5 * (place - 1) <= size").select("sig", "print", "size", "place")


def sets(texts: DataFrame) -> DataFrame:
    """``print``, the ``set`` of hashes and its SimHash fingerprint as ``mark``."""

    def run(batches):
        for batch in slices(batches):
            owns = [shingles(t) for t in batch.column(1).to_pylist()]
            found = pa.array([own.view(np.int64) for own in owns], pa.list_(pa.int64()))
            marks = pa.array(np.array([print_of(own) for own in owns], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, marks], ["print", "set", "mark"])

    return texts.mapInArrow(run, "print long, set array<long>, mark long")


def near_marks(known: DataFrame) -> DataFrame:
    """``u``, ``v``: prints of sets whose fingerprints are equal, or within ``REACH`` bits as the vantage-point trees find them."""
    marks = materialise(known.groupBy("mark").agg(F.min("print").alias("least")), "marks")
    equal = known.select("mark", "print").join(marks, "mark").where("print <> least").select(F.col("least").alias("u"), F.col("print").alias("v"))
    found = partners(marks.select(F.col("mark").alias("print")), REACH)
    return equal.unionByName(found.join(marks.toDF("u", "_u"), "u").join(marks.toDF("v", "_v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of ``pairs`` (``u``, ``v``) those whose sketches do not rule them out."""

    def run(batches):
        for batch in batches:
            u, v, *sides = (batch.column(i) for i in range(6))
            keep = pa.array([may_be_similar(*side) for side in zip(*(c.to_pylist() for c in sides))], pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    both = pairs.join(sketches.toDF("u", "a", "size_a"), "u").join(sketches.toDF("v", "b", "size_b"), "v")
    return both.select("u", "v", "a", "b", "size_a", "size_b").mapInArrow(run, "u long, v long")


def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of ``pairs`` (``u``, ``v``) those with a similarity of 0.8 or more, by the sets in ``known``."""
    both = pairs.join(known.toDF("u", "a"), "u").join(known.toDF("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(9 * common >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def candidates(root: np.ndarray, size: np.ndarray, place: np.ndarray, block: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of one or two blocks, each with the later ones that are in other components and that neither places nor sketches rule out."""
    if (root == root[0]).all():
        return
    two = block != block[0]
    firsts = np.flatnonzero(~two)
    for k, i in enumerate(firsts):
        # The first hash that similar sets share meets this bound of places; a later one may fail it.
        others = np.flatnonzero(two) if two.any() else firsts[k + 1 :]
        both = size[others] + size[i]
        others = others[(root[others] != root[i]) & (9 * (1 + np.minimum(size[others] - place[others], size[i] - place[i])) >= 4 * both)]
        apart = np.abs(cells[others].astype(np.int16) - cells[i]).sum(1, dtype=np.int64)
        others = others[9 * apart <= size[others] + size[i]]
        if len(others):
            yield int(i), others


def forest(root: np.ndarray, found: Iterable[tuple[int, np.ndarray]], values: np.ndarray, starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the candidates ``found`` as few similar pairs as join all that are similar: less than one for each component that
    ``root`` names. The set of row i is ``values[starts[i] : starts[i + 1]]``."""
    # Places in the sorted hashes: sets are marked in a table, not searched.
    hashes, ids = np.unique(values, return_inverse=True)
    label, size, marked = np.unique(root, return_inverse=True)[1], np.diff(starts), np.zeros(len(hashes), bool)
    one, two = [], []
    for i, others in found:
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        own = ids[starts[i] : starts[i + 1]]
        marked[own] = True
        met = marked[np.concatenate([ids[starts[j] : starts[j + 1]] for j in others.tolist()])]
        common = np.bincount(np.repeat(np.arange(len(others)), size[others])[met], minlength=len(others))
        marked[own] = False
        near = others[9 * common >= 4 * (size[others] + size[i])]
        joined, first = np.unique(label[near], return_index=True)
        one += [i] * len(first)
        two += near[first].tolist()
        label[np.isin(label, joined)] = label[i]
    return one, two


def by_meeting(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the rows of every two blocks that meet (``sig``, ``one``, ``two``), in the order of ``print``."""

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            sig, one, two = (held.column(i).to_numpy() for i in range(3))
            ends = (np.flatnonzero((sig[1:] != sig[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1).tolist()
            done = (work(held.slice(a, b - a)) for a, b in zip([0, *ends], ends))
            yield from (out for out in done if out.num_rows)
            rest = held.slice(ends[-1] if ends else 0)
        if rest is not None:
            yield work(rest)

    keys = ["sig", "one", "two"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "print").mapInArrow(run, schema)


def met_candidates(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """``candidates`` of the rows of two blocks that meet."""
    columns = [rows.column(name).to_numpy() for name in ("root", "size", "place", "block")]
    return candidates(*columns, np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS))


def edges_of(rows: pa.RecordBatch, one: list[int] | np.ndarray, two: list[int] | np.ndarray) -> pa.RecordBatch:
    """``u``, ``v`` for pairs of rows."""
    own = rows.column("print").to_numpy()
    u, v = own[np.asarray(one, np.int64)], own[np.asarray(two, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def meetings(apart: DataFrame, sketches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``u``, ``v``: pairs of ``apart`` (a stored table of ``sig``, ``print``, ``root``, ``size``, ``place``) with a common ``sig`` that
    are in different components and that neither places nor sketches rule out.

    The sets of a hash are dealt to blocks, and every two blocks meet in a task. With ``known`` (``print``, ``set``) the tasks
    compare the sets themselves, and of the similar pairs a forest becomes rows, fewer than the sets that meet: sets with a
    candidate are found first, and only they are shuffled whole.
    """

    def fold(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(folded, batch.column(1).to_pylist()), pa.binary())], ["print", "cells"])

    def pairs(rows):
        found = [(np.full(len(others), i), others) for i, others in met_candidates(rows)] or [(np.zeros(0, np.int64),) * 2]
        return edges_of(rows, *(np.concatenate(side) for side in zip(*found)))

    def with_candidate(rows):
        chosen = np.zeros(rows.num_rows, bool)
        for i, others in met_candidates(rows):
            chosen[i] = chosen[others] = True
        return rows.filter(pa.array(chosen))

    def similar_pairs(rows):
        # Offsets of a slice count from the first row of the whole.
        held = rows.column("set")
        starts = held.offsets.to_numpy().astype(np.int64)
        values = held.values.to_numpy()[starts[0] : starts[-1]]
        return edges_of(rows, *forest(rows.column("root").to_numpy(), met_candidates(rows), values, starts - starts[0]))

    # A hash has as many blocks as its sets need, by number and by hashes; blocks are of one size but for chance. Hashes with
    # several are a small part of the rows, so they are broadcast, and rows of a frequent hash stay where they are.
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.col("size").cast("long")) / BLOCK_HASHES)).cast("long")
    several = apart.groupBy("sig").agg(blocks.alias("blocks")).where("blocks > 1")
    own = apart.join(F.broadcast(several), "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    own = own.withColumn("block", F.pmod(F.xxhash64("print"), "blocks"))
    cells = sketches.select("_print", "_sketch").mapInArrow(fold, "print long, cells binary")
    spread = own.join(cells, "print").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    spread = spread.select("sig", "one", "two", "print", "root", F.col("size").cast("long"), F.col("place").cast("long"), "block", "cells")
    if known is None:
        return by_meeting(spread, pairs, "u long, v long")
    chosen = by_meeting(spread, with_candidate, "sig long, one long, two long, print long, root long, size long, place long, block long, cells binary")
    whole = chosen.join(known.select("print", "set"), "print").select(*chosen.columns, "set")
    return by_meeting(whole, similar_pairs, "u long, v long")


def links(stored: DataFrame, text: str = "text") -> DataFrame:
    """``u``, ``v``: edges that join all prints of ``stored`` (a stored table with the columns of ``with_prints`` and ``_row``) that are similar."""
    asked = materialise(involved(stored.select("_print", text)), "involved")
    one = stored.groupBy("_print").agg(F.min("_row").alias("_row"), F.min("_sketch").alias("_sketch"), F.min("_size").alias("_size")).join(asked, "_print")
    one = materialise(one, "sketches")
    sketches = one.select("_print", "_sketch", "_size")
    # A table of its own, whose measured size tells Spark whether texts need a shuffle to meet it.
    chosen = materialise(one.select("_row"), "chosen")
    known = materialise(sets(stored.select("_row", "_print", text).join(chosen, "_row", "left_semi").select("_print", text)), "sets")
    prefix = materialise(prefixes(known), "prefixes")
    least = prefix.groupBy("sig").agg(F.min("print").alias("least"), F.max("print").alias("most")).where("least < most")
    meeting = materialise(prefix.join(least.drop("most"), "sig"), "meeting")

    def linked(pairs: DataFrame) -> DataFrame:
        """Sets are only joined for the pairs that their sketches leave."""
        left = materialise(likely(pairs, sketches), "likely")
        return materialise(similar(left, known.select("print", "set")), "links")

    def still_apart(found: DataFrame) -> DataFrame:
        """Prints of hashes whose prints are in several components, with the component and the smallest print of the smallest one."""
        roots = components(found).withColumnRenamed("u", "print")
        labelled = meeting.drop("least").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
        labelled = materialise(labelled, "labelled")
        first = labelled.groupBy("sig").agg(F.min(F.struct("root", "print")).alias("first"), F.max("root").alias("high"))
        return materialise(labelled.join(first.where("first.root < high").drop("high"), "sig"), "apart")

    one_each = meeting.where("print <> least").groupBy("print").agg(F.min("least").alias("least"))
    one_each = one_each.select(F.col("least").alias("u"), F.col("print").alias("v")).unionByName(near_marks(known))
    near = linked(one_each.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    star = still_apart(near).where(F.col("root") != F.col("first.root")).select(F.col("first.print").alias("u"), F.col("print").alias("v")).distinct()
    near = near.unionByName(linked(star))
    return near.unionByName(materialise(meetings(still_apart(near).drop("first"), sketches, known), "links"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (the first stored one of equal ids)."""
    own, back = aside(docs, ("_print", "_row", "_size", "_sketch"))
    stored = materialise(with_prints(own, text, "_print").withColumn("_row", F.monotonically_increasing_id()), "marked")
    groups = grouped(stored.select(F.col(doc_id).alias("_id"), F.col("_print").alias("print"), "_row"), "_id", lambda _: links(stored, text))
    first = F.min(F.struct(F.col("_id").isNull().alias("nameless"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    stay = materialise(groups.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("_row")), "staying")
    # Half the rows or more may stay, so they are never broadcast, at any size.
    return back(stored.join(stay.hint("merge"), "_row", "left_semi").drop("_print", "_row", "_size", "_sketch"))
