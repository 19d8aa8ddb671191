"""Hierarchies (L) over the driver's tables: world › region › nation › customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.operators import hierarchy as H
from censora.queries import Tables, query

TREE_SQL = """tree AS (SELECT 'W' AS code, NULL AS parent, 'World' AS name UNION ALL SELECT 'R' || r_regionkey, 'W', r_name FROM region
         UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name FROM customer),
     up AS (SELECT t.code, t.name, p.code AS p1, p.name AS n1, q.code AS p2, q.name AS n2, r.code AS p3, r.name AS n3 FROM tree t LEFT JOIN tree p ON p.code = t.parent LEFT JOIN tree q ON q.code = p.parent LEFT JOIN tree r ON r.code = q.parent)"""


def tree(t: Tables):
    def key(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    world = t.region.groupBy().agg(F.lit("W").alias("code"), F.lit(None).cast("string").alias("parent"), F.lit("World").alias("name"))
    regions = t.region.select(key("R", "r_regionkey").alias("code"), F.lit("W").alias("parent"), F.col("r_name").alias("name"))
    nations = t.nation.select(key("N", "n_nationkey").alias("code"), key("R", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    people = t.customer.select(key("C", "c_custkey").alias("code"), key("N", "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return world.unionByName(regions).unionByName(nations).unionByName(people)


@query(
    "l1_closure",
    f"""WITH {TREE_SQL} SELECT code, code AS ancestor, 0 AS distance FROM up UNION ALL SELECT code, p1, 1 FROM up WHERE p1 IS NOT NULL UNION ALL SELECT code, p2, 2 FROM up WHERE p2 IS NOT NULL UNION ALL SELECT code, p3, 3 FROM up WHERE p3 IS NOT NULL""",
)
def _(t: Tables):
    return H.closure(tree(t))


@query(
    "l1_ancestors",
    f"""WITH RECURSIVE {TREE_SQL}, c AS (SELECT parent, 1 AS distance FROM tree WHERE code = 'C7' UNION ALL SELECT t.parent, c.distance + 1 FROM c JOIN tree t ON t.code = c.parent)
        SELECT parent AS ancestor, (max(distance) OVER () - distance + 1)::INTEGER AS level FROM c WHERE parent IS NOT NULL""",
)
def _(t: Tables):
    return H.ancestors(tree(t), "C7")


CHAIN_SQL = "chain AS (SELECT 'L' || o_orderkey AS code, CASE WHEN o_orderkey > 1 THEN 'L' || (o_orderkey // 3) END AS parent FROM (SELECT DISTINCT o_orderkey FROM orders))"


@query(
    "l1_closure_any_depth",
    f"""WITH RECURSIVE {CHAIN_SQL}, u AS (SELECT c.code, c.parent AS ancestor, 1 AS distance FROM chain c WHERE c.parent IN (SELECT code FROM chain)
          UNION ALL SELECT u.code, c.parent, u.distance + 1 FROM u JOIN chain c ON c.code = u.ancestor WHERE c.parent IN (SELECT code FROM chain))
        SELECT code, ancestor, distance::INTEGER AS distance FROM u""",
)
def _(t: Tables):
    # A tree over the order numbers, as deep as they are many digits in base three.
    key = F.col("o_orderkey")
    parent = F.when(key > 1, F.concat(F.lit("L"), F.floor(key / 3).cast("string")))
    return H.closure(t.orders.select(F.concat(F.lit("L"), key.cast("string")).alias("code"), parent.alias("parent")).distinct(), itself=False)


@query("l1_children", f"WITH {TREE_SQL} SELECT code FROM tree WHERE parent = 'N3'")
def _(t: Tables):
    return H.children(tree(t), "N3")


@query(
    "l2_subtree_totals",
    f"""WITH {TREE_SQL}, d AS (SELECT 'C' || o_custkey AS code, count(*) AS n FROM orders GROUP BY 1),
             l AS (SELECT code AS a, code FROM up UNION ALL SELECT p1, code FROM up WHERE p1 IS NOT NULL UNION ALL SELECT p2, code FROM up WHERE p2 IS NOT NULL UNION ALL SELECT p3, code FROM up WHERE p3 IS NOT NULL),
             s AS (SELECT a, sum(n)::BIGINT AS total FROM l JOIN d USING (code) GROUP BY 1)
        SELECT t.code, coalesce(d.n, 0) AS direct, coalesce(s.total, 0) AS total FROM tree t LEFT JOIN d ON d.code = t.code LEFT JOIN s ON s.a = t.code""",
)
def _(t: Tables):
    leaves = t.orders.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return H.subtree_totals(tree(t), leaves)


@query("l3_paths", f"WITH {TREE_SQL} SELECT code, concat_ws(' › ', n3, n2, n1, name) AS path FROM up")
def _(t: Tables):
    return H.paths(tree(t))


@query(
    "l4_level_check",
    f"""WITH {TREE_SQL}, c AS (SELECT left(code, 1) AS level, count(*) AS codes, min(code) AS first, max(code) AS last FROM tree GROUP BY 1),
             p AS (SELECT 'W' AS level, 1::BIGINT AS published UNION ALL SELECT 'R', count(*) FROM region UNION ALL SELECT 'N', count(*) + 1 FROM nation UNION ALL SELECT 'C', count(*) FROM customer)
        SELECT level, codes, first, last, published, codes = published AS matches FROM c FULL JOIN p USING (level)""",
)
def _(t: Tables):
    def declared(letter, df, extra=0):
        return df.agg(F.lit(letter).alias("level"), (F.count(F.lit(1)) + extra).alias("published"))

    published = declared("R", t.region).unionByName(declared("N", t.nation, 1)).unionByName(declared("C", t.customer))
    published = published.unionByName(t.region.groupBy().agg(F.lit("W").alias("level"), F.lit(1).cast("bigint").alias("published")))
    return H.level_check(tree(t), F.substring("code", 1, 1), published)
