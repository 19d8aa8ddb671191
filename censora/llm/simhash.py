"""Near-duplicates by SimHash: fingerprints linked within two bits, found with vantage-point trees.

Equal fingerprints are one node. A tree of vantage points, built on a bounded sample, cuts the fingerprints into shards
by Hamming distance. Each fingerprint lives in one shard and asks every shard whose region the triangle bound lets hold
a partner; inside a shard the same cutting goes on until all pairs of what is left are compared. So all pairs within the
radius are found, but none is emitted: a shard returns one edge from each fingerprint to the smallest of its local
component. A ball of radius two holds 2,081 fingerprints, so no group, however large, can stay dense.

Defined results: words are runs of other characters than the six ASCII white spaces, lower-cased in A-Z alone; a text
without words (NULL or empty) has fingerprint zero and is linked like any other; a text of one or two words is one
shingle; texts are read whole; rows with the same id are one node of their fingerprint each; NULL ids are never the
smallest unless a component has no other; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from censora.llm.components import components
from censora.llm.frames import aside, slices, with_fields
from censora.session import materialise

SHINGLE, SEED, RADIUS = 3, 42, 2
# Fingerprints the tree of shards is built on at most; what a shard should hold; comparisons made at once.
SAMPLE, SHARD_ROWS, BLOCK = 50_000, 8_192, 1 << 21


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - SHINGLE]]).tolist()
    digest = xxhash.xxh64_intdigest
    return print_of(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], "<u8"))


def print_of(hashes: np.ndarray) -> int:
    """64 bits; a bit is set if it is set in over half of the hashes; zero for none."""
    hashes = hashes.astype("<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "print", keep_text: bool = False) -> DataFrame:
    """``docs`` with its fingerprint as a signed integer; the text goes unless it is to be kept."""
    names, place = docs.columns, docs.columns.index(text)
    rows = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    kept = [i for i in range(len(names)) if keep_text or i != place]

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(place).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found)], [*(names[i] for i in kept), name])

    schema = StructType([rows.schema[i] for i in kept])
    return rows.mapInArrow(run, with_fields(schema, f"`{name}` long"))


def distances(prints: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ vantage)


class Node(NamedTuple):
    """Prints within ``radius`` of the vantage point are inside. A leaf has a shard instead."""

    vantage: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None
    shard: int = -1


def split(prints: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves the prints best; None if nothing parts them.

    Of a few candidates the one whose distances spread most is taken: fewest prints then lie near the edge.
    """
    tried = prints[:: max(1, len(prints) // 8)][:8]
    spread = [(distances(prints, v).std(), k) for k, v in enumerate(tried)]
    vantage = tried[max(spread)[1]]
    d = distances(prints, vantage)
    radius = int(np.median(d))
    if not (d > radius).any():
        radius -= 1
    return (vantage, radius) if (d <= radius).any() and (d > radius).any() else None


def build(prints: np.ndarray, leaf: int, number: list[int] | None = None) -> Node:
    number = [0] if number is None else number
    cut = split(prints) if len(prints) > leaf else None
    if cut is None:
        number[0] += 1
        return Node(shard=number[0] - 1)
    inner = distances(prints, cut[0]) <= cut[1]
    return Node(*cut, build(prints[inner], leaf, number), build(prints[~inner], leaf, number))


def route(node: Node, prints: np.ndarray, at: np.ndarray, home: np.ndarray, reach: int = RADIUS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard by shard: places of the prints that go there (with partners within ``reach`` bits), and whether they live there."""
    if not len(at):
        return
    if node.shard >= 0:
        yield node.shard, at, home
        return
    d = distances(prints[at], node.vantage).astype(np.int64)
    # A partner inside is at most radius away from the vantage point, one outside at least radius + 1.
    near, far = d <= node.radius + reach, d >= node.radius + 1 - reach
    yield from route(node.inside, prints, at[near], home[near] & (d[near] <= node.radius), reach)
    yield from route(node.outside, prints, at[far], home[far] & (d[far] > node.radius), reach)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Labels are the smallest place in a component, as far as known; take the pairs (a, b) in."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def within(prints: np.ndarray, data: np.ndarray, asking: np.ndarray, reach: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``reach`` bits, one of ``asking`` and one of ``data`` (places in ``prints``), some at a time."""
    if not len(data) or not len(asking):
        return
    cut = split(prints[data]) if len(data) * len(asking) > BLOCK and len(data) > 64 else None
    if cut is None:
        step = max(1, BLOCK // len(data))
        for k in range(0, len(asking), step):
            part = asking[k : k + step]
            i, j = np.nonzero(np.bitwise_count(prints[part][:, None] ^ prints[data][None, :]) <= reach)
            yield part[i], data[j]
        return
    vantage, radius = cut
    of_data, of_asking = distances(prints[data], vantage), distances(prints[asking], vantage).astype(np.int64)
    yield from within(prints, data[of_data <= radius], asking[of_asking <= radius + reach], reach)
    yield from within(prints, data[of_data > radius], asking[of_asking >= radius + 1 - reach], reach)


def link(prints: np.ndarray, data: np.ndarray, asking: np.ndarray, labels: np.ndarray) -> None:
    """Join the labels of all pairs within the radius, one of ``data`` and one of ``asking`` (places in ``prints``)."""
    for i, j in within(prints, data, asking):
        join_labels(labels, i, j)


def dealt(prints: DataFrame, reach: int = RADIUS) -> DataFrame:
    """``shard``, ``print``, ``home``: each of ``prints`` (a stored table of distinct ``print``) in the shard where it lives, and in
    all that may hold a partner within ``reach`` bits."""
    spark = prints.sparkSession
    total = prints.count()
    drawn = prints.orderBy(F.xxhash64("print"), "print").limit(SAMPLE).collect()  # at most SAMPLE numbers
    sample = np.array([r["print"] for r in drawn], np.int64).view(np.uint64)
    leaf = max(16, int(SHARD_ROWS * len(sample) / max(1, total)))
    tree = spark.sparkContext.broadcast(build(sample, leaf))

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for shard, at, home in route(tree.value, own, np.arange(len(own)), np.ones(len(own), bool), reach):
                shards = pa.array(np.full(len(at), shard, np.int32))
                yield pa.RecordBatch.from_arrays([shards, pa.array(own[at].view(np.int64)), pa.array(home)], ["shard", "print", "home"])

    return prints.select("print").mapInArrow(deal, "shard int, print long, home boolean")


def partners(prints: DataFrame, reach: int) -> DataFrame:
    """``u``, ``v``: for every one of ``prints`` (a stored table of distinct ``print``) with smaller ones within ``reach`` bits, the
    smallest of these in each shard that holds any, as ``v``."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("print")
        signed = shard["print"].to_numpy(np.int64)
        least = np.arange(len(signed))
        for i, j in within(signed.view(np.uint64), np.flatnonzero(shard["home"].to_numpy(bool)), np.arange(len(signed)), reach):
            np.minimum.at(least, i, j)
        found = np.flatnonzero(least != np.arange(len(signed)))
        return pd.DataFrame({"u": signed[found], "v": signed[least[found]]})

    return dealt(prints, reach).groupBy("shard").applyInPandas(search, "u long, v long")


def edges(prints: DataFrame) -> DataFrame:
    """``u``, ``v``: a forest that joins all of ``prints`` (a stored table of distinct ``print``) within the radius."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("print")
        own, home = shard["print"].to_numpy(np.int64).view(np.uint64), shard["home"].to_numpy(bool)
        labels = np.arange(len(own))
        link(own, np.flatnonzero(home), np.arange(len(own)), labels)
        moved = np.flatnonzero(labels != np.arange(len(own)))
        signed = own.view(np.int64)
        return pd.DataFrame({"u": signed[moved], "v": signed[labels[moved]]})

    return dealt(prints).groupBy("shard").applyInPandas(search, "u long, v long")


def grouped(marked: DataFrame, doc_id: str = "doc_id", linked: Callable[[DataFrame], DataFrame] = edges) -> DataFrame:
    """``marked`` (a stored table with ``print``) with the ``root`` print of its component and ``component_id``, its smallest id.

    ``linked`` gives the edges between the distinct prints.
    """
    prints = materialise(marked.groupBy("print").agg(F.min(doc_id).alias("_least")), "prints")
    rooted = materialise(components(linked(prints)), "components")
    joined = prints.join(rooted.withColumnRenamed("u", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = joined.groupBy("root").agg(F.min("_least").alias("component_id"))
    return marked.join(joined.join(least, "root").select("print", "root", "component_id"), "print")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``print``, ``component_id``: one row per row of ``docs``. Texts are read once and not shuffled."""
    return grouped(materialise(with_fingerprints(docs.select(docs[doc_id], docs[text]), text), "fingerprints"), doc_id).drop("root")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (the first stored one of equal ids)."""
    own, back = aside(docs, ("_print", "_row"))
    stored = materialise(with_fingerprints(own, text, "_print", keep_text=True).withColumn("_row", F.monotonically_increasing_id()), "marked")
    groups = grouped(stored.select(F.col(doc_id).alias("_id"), F.col("_print").alias("print"), "_row"), "_id")
    first = F.min(F.struct(F.col("_id").isNull().alias("nameless"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    stay = materialise(groups.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("_row")), "staying")
    # Half the rows or more may stay, so they are never broadcast, at any size.
    return back(stored.join(stay.hint("merge"), "_row", "left_semi"))


def hex_print(column: str = "print") -> Column:
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
