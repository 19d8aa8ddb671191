"""Exact duplicates by skew-safe combining: local winners, winners of salted digest groups, winners over all salts.

Rows are grouped by the SHA-256 of their text, by a salt from the row's id, and by the whole text. Spark combines such groups
within a task before it shuffles them (local winners), then merges them over the tasks (salt winners); the second shuffle
brings the salts of a digest together (global winners). The whole text is a grouping key at each of these stages, so equal
digests alone never make two texts equal. However large a group of copies is, the second stage reads at most one row per
task and salt of it, and the third one row per salt.

The way back carries no text: a digest that has a single text stands for it. Winners go to the salts of their digest, and rows
meet them by digest and salt, so a hot group is spread over its salts here as well. Where several texts share a digest, rows
meet the winner by the text itself.

Defined results: NULL texts are empty ones, and these are equal to each other; texts are compared whole and as they are; the
largest id stays, and an id beats NULL; rows that repeat both the id and the text of the row that stays are all marked as kept
(``deduplicated`` leaves one of them); an empty table gives an empty one; other columns, whatever they are called, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.llm.frames import text_of
from censora.session import materialise

# Over how many salts a group of copies is spread.
SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _winners(keyed: DataFrame) -> DataFrame:
    """One row per distinct text: its digest, the id that stays, its rows; and the text itself where others share its digest."""
    salted = keyed.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    # Dealt by digest, so that grouping by text and counting the texts of a digest need no further shuffle.
    whole = salted.repartition("_digest").groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    texts = whole.withColumn("_texts", F.count(F.lit(1)).over(W.partitionBy("_digest")))
    return texts.withColumn("_text", F.when(F.col("_texts") > 1, F.col("_text")))


def _marked(keyed: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` and ``_id``, ``_digest``, ``_keep``, ``_size``, and ``_text`` where a digest has several texts."""
    names = [*carried, "_id", "_digest", "_salt"]
    rows = materialise(keyed.select(*names), "exact-rows")
    winners = materialise(_winners(keyed), "exact-winners")
    alone = winners.where("_texts = 1").drop("_texts", "_text")
    routed = rows.select("_digest", "_salt").distinct().join(alone, "_digest")
    marked = rows.join(routed, ["_digest", "_salt"]).withColumn("_text", F.lit(None).cast("string"))
    shared = winners.where("_texts > 1").drop("_texts")
    if not shared.isEmpty():
        marked = marked.unionByName(keyed.select(*names, "_text").join(shared, ["_digest", "_text"]).select(*marked.columns))
    return marked


def _keyed(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("_digest", digest(F.col("_text"))).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))


def marks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row for each row: ``doc_id``, ``keep_id`` (the id that stays), ``group_size``, ``kept`` and ``digest``."""
    rows = documents.select(documents[doc_id].alias("_id"), text_of(documents, text).alias("_text"))
    return _marked(_keyed(rows, digest), []).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("digest"),
    )


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``documents`` with one row of each distinct text: that with the largest id (the last stored one of equal ids)."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("_row"), documents[doc_id].alias("_id"), text_of(documents, text).alias("_text"))
    stored = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), "exact-documents")
    kept = _marked(_keyed(stored, digest), ["_at"]).where(F.col("_id").eqNullSafe(F.col("_keep")))
    stay = materialise(kept.groupBy("_digest", "_text").agg(F.max("_at").alias("_at")).select("_at"), "exact-staying")
    return stored.join(stay, "_at", "left_semi").select("_row.*")
