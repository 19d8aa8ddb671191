"""Exact top-k by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are cut by length into bins and these into chunks of bounded size, the queries into blocks; a task gets one block
and one chunk. The longest vectors of all (a bounded number) score every query first; the k-th best of these is a bound
that the query's results reach at least, so a block is never sent to chunks whose length cannot reach the bound of any of
its queries. Inside a task vectors are taken by descending length: a query ends when |q||x| falls below its bound, and a
pair is scored in full only if the sum over the leading rotated dimensions plus the product of what is left of both
lengths reaches it. Scores are exact integers; the floating bounds only decide what is left out, with a margin.

Products of wide vectors (longer than the root of ``EXACT``) may not be exact in double precision. They are kept apart: every
query meets the wide candidates, wide queries meet all candidates, again in blocks and chunks. There a floating score with
its error bound leaves out what cannot be among the k best, and the others are scored in whole numbers of any size.

Defined results: vectors that are NULL or hold a NULL or a non-finite component (also after scaling) take no part, neither as
query nor as candidate; scores beyond a long are shown as its end, and are ties there; shorter vectors count as filled up with zeros; a query never meets its own row,
but other rows with the same id; ties go to the smaller id; NULL ids come last and are no query; with fewer than k other
rows a query has them all; an empty table gives an empty table.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.llm.frames import numbered
from censora.session import materialise

# Longest vectors that give the first bounds; vectors of a chunk; queries of a block; candidates scored at once.
SEEDS, CHUNK, BLOCK, STEP = 2_048, 8_192, 1_024, 512
# Bins per unit of the logarithm of the squared length (about an eighth of the length each); share of dimensions in the partial
# sums; margin of the bounds.
BINS, LEADING, MARGIN = 4, 0.25, 1e-3
# Squared length up to which products of two vectors are exact, also with a place within a chunk behind them in one integer.
EXACT = float(1 << 49)
_NONE = np.iinfo(np.int64).min


def usable(whole: Column) -> Column:
    """No component is missing, infinite or not a number."""
    return F.coalesce(F.forall(whole, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def quantised(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """``id``, ``row`` and the vector's whole numbers, floor(scale * x), packed in ``packed``; ``bin`` grows with the length.

    Those of ``wide`` vectors are packed as doubles, which hold them exactly, the others as integers of four bytes.
    """
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), scaled.alias("scaled")).where(usable(F.col("scaled")))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("id", "scaled", "row")

    def run(batches):
        for batch in batches:
            arrays = [np.floor(np.array(v, np.float64)) for v in batch.column(1).to_pylist()]
            with np.errstate(over="ignore"):
                squared = np.array([float(a @ a) for a in arrays])
            wide = squared > EXACT
            bins = pa.array(np.floor(np.log1p(np.where(wide, EXACT, squared)) * BINS).astype(np.int32))
            packed = pa.array([a.astype("<f8" if w else "<i4").tobytes() for a, w in zip(arrays, wide)], pa.binary())
            size = pa.array([len(a) for a in arrays], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed, size, bins, pa.array(wide)], ["id", "row", "packed", "size", "bin", "wide"])

    return rows.mapInArrow(run, "id long, row long, packed binary, size int, bin int, wide boolean")


def unpack(packed, size: int) -> np.ndarray:
    """Packed vectors as rows of a matrix, filled up with zeros."""
    return np.frombuffer(b"".join(p.ljust(4 * size, b"\0") for p in packed), "<i4").reshape(-1, size).astype(np.float64)


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of all vectors, by falling singular value, from the sum of their outer products."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            m = unpack(batch.column(0).to_pylist(), size)
            total += m.T @ m
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["cell", "value"])

    cells = vectors.select("packed").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros(size * size)
    for cell, value in cells:
        gram[cell] = value
    values, columns = np.linalg.eigh(gram.reshape(size, size))
    return columns[:, np.argsort(-values)]


def first_bounds(queries: DataFrame, seeds: list, size: int, k: int) -> DataFrame:
    """``queries`` with ``bound``, the k-th best score among the seeds (minus infinity with fewer), and ``need``, the least bin that reaches it."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((np.array([s["row"] for s in seeds], np.int64), [s["packed"] for s in seeds]))
    names = queries.columns

    def run(batches):
        seed_rows, packed = shared.value
        longest = unpack(packed, size)
        for batch in batches:
            own = unpack(batch.column(names.index("packed")).to_pylist(), size)
            scores = own @ longest.T
            scores[batch.column(names.index("row")).to_numpy()[:, None] == seed_rows[None, :]] = -np.inf
            bound = -np.sort(-scores, axis=1)[:, k - 1] if len(seed_rows) >= k else np.full(len(own), -np.inf)
            length = np.sqrt((own * own).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where((bound > 0) & (length > 0), (bound / length) ** 2, 0.0)
            need = np.floor(np.log1p(least * (1 - MARGIN)) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound), pa.array(need)], [*names, "bound", "need"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{schema}, bound double, need int")


def best_of(q: np.ndarray, q_row: np.ndarray, bound: np.ndarray, x: np.ndarray, x_row: np.ndarray, rank: np.ndarray, turn: np.ndarray, k: int) -> np.ndarray:
    """The k best candidates of each query as score * n + (n - 1 - rank), the least integer where there are fewer.

    ``x`` is sorted by falling length; ``rank`` is the place of a candidate's id among all ids.
    """
    n, lead = len(x), max(1, int(x.shape[1] * LEADING))
    qr, xr = q @ turn, x @ turn
    q_length, x_length = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    q_rest = np.sqrt((qr[:, lead:] ** 2).sum(1))
    x_rest = np.sqrt((xr[:, lead:] ** 2).sum(1))
    bound = bound.copy()
    best = np.full((len(q), k), _NONE)
    margin = MARGIN * (1 + q_length)
    for at in range(0, n, STEP):
        part = slice(at, at + STEP)
        alive = np.flatnonzero(q_length * x_length[at] >= bound - margin)
        if not len(alive):
            break  # all later vectors are shorter, and bounds only rise
        reach = qr[alive, :lead] @ xr[part, :lead].T + q_rest[alive, None] * x_rest[None, part]
        maybe = (reach >= (bound - margin)[alive, None]) & (q_row[alive, None] != x_row[None, part])
        some, which = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if not len(some):
            continue
        alive, maybe = alive[some], maybe[np.ix_(some, which)]
        score = q[alive] @ x[part][which].T
        order = (n - 1 - rank[part][which])[None, :]
        found = np.where(maybe & (score >= bound[alive, None]), score.astype(np.int64) * n + order, _NONE)
        merged = np.concatenate([best[alive], found], axis=1)
        best[alive] = top = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        least = top.min(1)
        full = least != _NONE
        bound[alive[full]] = np.maximum(bound[alive[full]], np.floor_divide(least[full], n))
    return best


def scaled_down(m: np.ndarray, axis: int | None) -> np.ndarray:
    """``m`` times a power of two (for each row or for all) that brings its largest number below one."""
    largest = np.abs(m).max(axis=axis, keepdims=True, initial=0.0)
    return np.ldexp(m, -np.frexp(largest)[1])


def best_exact(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, rank: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """Query, candidate and score of the k best candidates of each query, in whole numbers of any size; ``rank`` breaks ties."""
    distinct, same = np.unique(x, axis=0, return_inverse=True)
    same = same.reshape(-1)
    near_q, near_x = scaled_down(q, 1), scaled_down(distinct, None)
    # Rounding errors of a sum of products, twice over, and of numbers too small to be told from zero.
    error = np.sqrt((near_q**2).sum(1))[:, None] * np.sqrt((near_x**2).sum(1))[None, :] * (x.shape[1] + 2) * 2.0**-51 + 1e-290
    about = near_q @ near_x.T
    whole = [[int(v) for v in row] for row in distinct.tolist()]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for i, row in enumerate(q_row):
        others = np.flatnonzero(x_row != row)
        low = (about[i] - error[i])[same[others]]
        least = np.partition(low, len(low) - k)[-k] if len(low) >= k else -np.inf
        maybe = others[(about[i] + error[i])[same[others]] >= least]
        own = [int(v) for v in q[i].tolist()]
        score = {int(d): sum(map(mul, own, whole[d])) for d in np.unique(same[maybe])}
        found = sorted((-min(max(score[int(same[j])], -(1 << 63)), (1 << 63) - 1), int(rank[j]), int(j)) for j in maybe)[:k]
        for negative, _, j in found:
            for column, value in zip(out, (i, j, -negative)):
                column.append(value)
    return out


def wide_best(asked: DataFrame, candidates: DataFrame, size: int, k: int) -> DataFrame:
    """The k best scores of ``asked`` among ``candidates`` of each chunk, where one of both is wide; both have ``wide``."""
    sides = [
        materialise(numbered(df, ["wide"], ["row"], "nth").withColumn("part", F.floor(F.col("nth") / step)).select("id", "row", "packed", "wide", "part"), name)
        for df, step, name in ((asked, BLOCK, "wide-queries"), (candidates, CHUNK, "wide-candidates"))
    ]
    # One number for each side and kind: how many blocks or chunks it has.
    counts = [{w: n + 1 for w, n in side.groupBy("wide").agg(F.max("part")).collect()} for side in sides]

    def met(side: DataFrame, other: dict[bool, int]) -> DataFrame:
        """Rows once for each part of the other side that they meet: narrow ones meet only wide ones."""

        def parts(wide: bool, n: int) -> Column:
            each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.struct(F.lit(wide).alias("w"), p.alias("p")))
            return F.when(F.col("wide") | F.lit(wide), each).otherwise(F.slice(each, 1, 0))

        kinds = [parts(w, n) for w, n in sorted(other.items())]
        return side.withColumn("other", F.explode(F.concat(*kinds))).select("*", F.col("other.w").alias("other_wide"), F.col("other.p").cast("long").alias("other_part"))

    schema = "query_row long, query_id long, vec_id long, x_row long, score long"
    if not all(counts):
        return asked.sparkSession.createDataFrame([], schema)
    names = ["q_wide", "q_part", "x_wide", "x_part"]
    q_side = met(sides[0], counts[1]).select("id", "row", "packed", *(F.col(c).alias(n) for c, n in zip(("wide", "part", "other_wide", "other_part"), names)))
    x_side = met(sides[1], counts[0]).select("id", "row", "packed", *(F.col(c).alias(n) for c, n in zip(("other_wide", "other_part", "wide", "part"), names)))

    def doubles(side: pd.DataFrame, wide: bool) -> np.ndarray:
        kind, width = ("<f8", 8) if wide else ("<i4", 4)
        return np.frombuffer(b"".join(p.ljust(width * size, b"\0") for p in side["packed"]), kind).reshape(-1, size).astype(np.float64)

    def cell(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "vec_id", "x_row", "score")})
        known, ids = x["id"].notna().to_numpy(), x["id"].fillna(0).astype("int64").to_numpy()
        rank = np.empty(len(x), np.int64)
        rank[np.lexsort([x["row"].to_numpy(), ids, ~known])] = np.arange(len(x))
        i, j, score = best_exact(doubles(q, bool(key[0])), q["row"].to_numpy(), doubles(x, bool(key[2])), x["row"].to_numpy(), rank, k)
        return pd.DataFrame(
            {
                "query_row": q["row"].to_numpy()[i],
                "query_id": q["id"].to_numpy()[i],
                "vec_id": pd.Series(ids[j]).astype("Int64").where(known[j]),
                "x_row": x["row"].to_numpy()[j],
                "score": np.array(score, np.int64),
            }
        )

    return q_side.groupBy(*names).cogroup(x_side.groupBy(*names)).applyInPandas(cell, schema)


def top_k(df: DataFrame, queries: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the k highest inner products of every row that ``queries`` holds for.

    ``queries`` is a condition on the column ``id``.
    """
    spark = df.sparkSession
    stored = materialise(quantised(df, vec_id, vector, scale), "vectors")
    size, widest = stored.agg(F.max("size"), F.max("wide")).first()
    schema = "query_row long, query_id long, vec_id long, x_row long, score long"
    if size is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    size = max(1, size)
    vectors, asks = stored.where("NOT wide"), queries & F.col("id").isNotNull()
    seeds = vectors.orderBy(F.desc("bin"), "row").limit(SEEDS).select("row", "packed").collect()  # at most SEEDS vectors
    turn = spark.sparkContext.broadcast(rotation(vectors, size))
    asked = materialise(first_bounds(vectors.where(asks).select("id", "row", "packed"), seeds, size, k), "queries")
    chunked = materialise(numbered(vectors, ["bin"], ["row"], "nth").select("id", "row", "packed", "bin", F.floor(F.col("nth") / CHUNK).alias("chunk")), "chunks")
    blocked = materialise(numbered(asked, ["need"], ["row"], "nth").withColumn("block", F.floor(F.col("nth") / BLOCK)).drop("nth"), "blocks")
    # Bins are few (BINS per unit of a logarithm); each says how many chunks or blocks it has.
    parts = spark.sparkContext.broadcast(sorted((r[0], r[1] + 1) for r in chunked.groupBy("bin").agg(F.max("chunk")).collect()))
    asking = spark.sparkContext.broadcast(sorted((r[0], r[1] + 1) for r in blocked.groupBy("need").agg(F.max("block")).collect()))

    def spread(others, own: str, fits, names):
        """Rows once for every chunk (or block) that their block (or chunk) meets."""

        def run(batches):
            for batch in batches:
                mine = batch.column(names.index(own)).to_numpy()
                for level in np.unique(mine):
                    rows = batch.take(pa.array(np.flatnonzero(mine == level)))
                    for other, count in others.value:
                        if fits(int(level), other):
                            for piece in range(count):
                                extra = [pa.array(np.full(rows.num_rows, v, t)) for v, t in ((other, np.int32), (piece, np.int64))]
                                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*names, "other", "piece"])

        return run

    q_names, x_names = ["id", "row", "packed", "bound", "need", "block"], ["id", "row", "packed", "bin", "chunk"]
    q_side = blocked.select(*q_names).mapInArrow(
        spread(parts, "need", lambda need, bin: bin >= need, q_names), "id long, row long, packed binary, bound double, need int, block long, other int, piece long"
    )
    x_side = chunked.select(*x_names).mapInArrow(
        spread(asking, "bin", lambda bin, need: bin >= need, x_names), "id long, row long, packed binary, bin int, chunk long, other int, piece long"
    )
    q_side = q_side.select("id", "row", "packed", "bound", "need", "block", F.col("other").alias("bin"), F.col("piece").alias("chunk"))
    x_side = x_side.select("id", "row", "packed", "bin", "chunk", F.col("other").alias("need"), F.col("piece").alias("block"))

    def cell(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "vec_id", "x_row", "score")})
        if q.empty or x.empty:
            return empty
        # Smaller ids first; NULL ids behind all others.
        known = x["id"].notna().to_numpy()
        ids = x["id"].fillna(0).astype("int64").to_numpy()
        rank = np.empty(len(x), np.int64)
        rank[np.lexsort([x["row"].to_numpy(), ids, ~known])] = np.arange(len(x))
        matrix = unpack(x["packed"], size)
        by = np.argsort(-(matrix * matrix).sum(1), kind="stable")
        best = best_of(unpack(q["packed"], size), q["row"].to_numpy(), q["bound"].to_numpy(), matrix[by], x["row"].to_numpy()[by], rank[by], turn.value, k)
        i, j = np.nonzero(best != _NONE)
        packed = best[i, j]
        at = np.empty(len(x), np.int64)
        at[rank] = np.arange(len(x))
        hit = at[len(x) - 1 - packed % len(x)]
        found = pd.Series(ids[hit]).astype("Int64").where(known[hit])
        return pd.DataFrame(
            {"query_row": q["row"].to_numpy()[i], "query_id": q["id"].to_numpy()[i], "vec_id": found, "x_row": x["row"].to_numpy()[hit], "score": packed // len(x)}
        )

    key = ["need", "block", "bin", "chunk"]
    partial = q_side.groupBy(*key).cogroup(x_side.groupBy(*key)).applyInPandas(cell, schema)
    if widest:
        partial = partial.unionByName(wide_best(stored.where(asks), stored, size, k))
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "x_row")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
