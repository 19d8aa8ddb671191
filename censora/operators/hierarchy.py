"""Code trees given as (code, parent): ancestors, closure, subtree totals, paths, level checks.

Trees are climbed by doubling: pairs at distance 1, 2, 4 … are joined to those found so far until none is left, so a chain of
any depth takes a logarithmic number of equi-joins and the tree is read once. A tree that leads back to itself is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.session import materialise


def closure(tree: DataFrame, itself: bool = True) -> DataFrame:
    """``(code, ancestor, distance)`` for every code and each of its ancestors, and the code itself at distance 0."""
    stored = materialise(tree.select("code", "parent"), "tree")
    codes = stored.count()
    known = stored.select("code").distinct()
    steps = stored.join(known.withColumnRenamed("code", "parent"), "parent", "left_semi")
    found = materialise(steps.select("code", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "ancestors")
    span = 1
    while not (far := found.where(F.col("distance") == span)).isEmpty():
        if span > codes:
            raise ValueError("the tree leads back to itself")
        leap = far.select(F.col("code").alias("ancestor"), F.col("ancestor").alias("above"))
        further = found.join(leap, "ancestor").select("code", F.col("above").alias("ancestor"), (F.col("distance") + span).alias("distance"))
        found = materialise(found.unionByName(further), "ancestors")
        span *= 2
    return known.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("distance")).unionByName(found) if itself else found


def ancestors(tree: DataFrame, code: str) -> DataFrame:
    """Ancestors of one code, root first: ``level`` counts from the root. One filtered look-up per level, nothing else is read."""
    chain, at = [], code
    while True:
        row = tree.where(F.col("code") == at).select("parent").first()
        at = row.parent if row else None
        if at is None or tree.where(F.col("code") == at).isEmpty():
            break
        if at in chain or at == code:
            raise ValueError("the tree leads back to itself")
        chain.append(at)
    kind = tree.schema["code"].dataType.simpleString()
    return tree.sparkSession.createDataFrame([(a, i) for i, a in enumerate(reversed(chain), 1)], f"ancestor {kind}, level int")


def children(tree: DataFrame, code: str) -> DataFrame:
    return tree.where(F.col("parent") == code).select("code")


def subtree_totals(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """Direct and total (with all descendants) counts of every code; ``leaves(code, n)`` are added up to each ancestor.

    The root receives every leaf: the sums fold map-side, one row per code and task.
    """
    direct = leaves.groupBy("code").agg(F.sum("n").alias("direct"))
    reach = closure(tree)
    rows = reach.join(direct, "code", "left").groupBy(F.col("ancestor").alias("code"))
    own = F.sum(F.when(F.col("distance") == 0, F.col("direct")))
    return rows.agg(F.coalesce(own, F.lit(0)).alias("direct"), F.coalesce(F.sum("direct"), F.lit(0)).alias("total"))


def paths(tree: DataFrame, separator: str = " › ") -> DataFrame:
    """Root-to-code path of names for every code; ``tree(code, parent, name)``. A path is as long as its code is deep."""
    named = materialise(tree.select("code", "parent", "name"), "names")
    labels = named.select(F.col("code").alias("ancestor"), "name")
    steps = closure(named).join(labels, "ancestor").groupBy("code").agg(F.array_sort(F.collect_list(F.struct(-F.col("distance"), "name"))).alias("steps"))
    return steps.select("code", F.concat_ws(separator, F.col("steps.name")).alias("path"))


def level_check(tree: DataFrame, level: Column, published: DataFrame) -> DataFrame:
    """Codes per level against the published counts; ``published(level, published)``."""
    counts = tree.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("codes"), F.min("code").alias("first"), F.max("code").alias("last"))
    rows = counts.join(published, "level", "full_outer")
    return rows.withColumn("matches", F.coalesce(F.col("codes") == F.col("published"), F.lit(False)))
