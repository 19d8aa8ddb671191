"""The semantic cube layer (I) over the driver's tables."""

from __future__ import annotations

from dataclasses import replace


from censora.plans import cube as Q
from censora.plans import cube_catalogue as C
from censora.queries import Tables, query
from censora.session import materialise

STAR = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


def numbered(body: str, order: str, limit: int | None = None) -> str:
    """The result of ``body`` with its position in the asked order and whether a limit left rows out."""
    rest = f"(SELECT count(*) FROM r) > {limit} AS truncated FROM r ORDER BY {order} LIMIT {limit}" if limit else "false AS truncated FROM r"
    return f"WITH r AS ({body}) SELECT *, row_number() OVER (ORDER BY {order}) AS position, {rest}"


@query(
    "i1_cube_query",
    numbered(
        f"""SELECT year(o_orderdate)::INTEGER AS year, r_regionkey AS region_id, r_name AS region, n_nationkey AS nation_id, n_name AS nation, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue,
              count(*) AS lines, count(DISTINCT o_custkey) AS customers, sum(round(l_discount * 100)::BIGINT)::BIGINT / (100 * count(l_discount)) AS avg_discount, lpad(r_regionkey::VARCHAR, 2, '0') AS region_cve
            FROM {STAR} WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY 1, 2, 3, 4, 5""",
        "revenue DESC NULLS LAST, year, region_id, nation_id",
        60,
    ),
)
def _(t: Tables):
    q = Q.CubeQuery(
        ("revenue", "lines", "customers", "avg_discount"),
        ("year", "nation"),
        {"year": [1996, 1997, 1998]},
        parents=True,
        limit=60,
    )
    return Q.plan(C.SALES, q, t)


@query(
    "i1_cube_many_groups",
    numbered(
        """SELECT o_orderdate AS day, o_custkey AS buyer, o_orderkey AS number, l_returnflag AS flag, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue, count(*) AS lines
           FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""",
        "revenue DESC NULLS LAST, day NULLS LAST, buyer NULLS LAST, number NULLS LAST, flag NULLS LAST",
    ),
)
def _(t: Tables):
    # Nearly as many groups as lines: the result is complete, and no task holds more of it than its range.
    fine = tuple(Q.Dimension(k, c, links=("orders",)) for k, c in (("day", "o_orderdate"), ("buyer", "o_custkey"), ("number", "o_orderkey")))
    return Q.plan(replace(C.SALES, dimensions=(*C.SALES.dimensions, *fine)), Q.CubeQuery(("revenue", "lines"), ("day", "buyer", "number", "flag")), t)


@query(
    "i1_cube_no_join_needed",
    numbered(
        "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity::BIGINT)::BIGINT AS quantity, count(*) AS lines FROM lineitem GROUP BY 1, 2",
        "flag DESC NULLS LAST, status",
    ),
)
def _(t: Tables):
    return Q.plan(C.SALES, Q.CubeQuery(("quantity", "lines"), ("flag", "status"), order="flag"), t)


@query(
    "i1_cube_partition_guard",
    numbered(
        "SELECT n_name AS place, count(*) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "people DESC NULLS LAST, place"
    ),
)
def _(t: Tables):
    # Without the level filter this query would be refused: levels contain one another.
    return Q.plan(C.CENSUS, Q.CubeQuery(("people",), ("place",), {"level": ["nation"]}), t)


@query(
    "i1_cube_rollup_routed",
    numbered(
        """SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS priority, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS amount, count(*) AS orders FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2""",
        "amount DESC NULLS LAST, year, priority",
    ),
)
def _(t: Tables):
    dimensions, measures = ("month", "year", "priority", "status"), ("amount", "orders")
    stored = materialise(Q.rollup_frame(C.ORDERS, t, dimensions, measures), "orders-rollup")
    routed = replace(C.ORDERS, rollups=(Q.Rollup(dimensions, measures, lambda _t: stored),))
    return Q.plan(routed, Q.CubeQuery(measures, ("year", "priority"), {"status": ["F", "O"]}), t)


@query(
    "i2_with_parents",
    numbered(
        """SELECT year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%Y-%m') AS month, r_regionkey AS region_id, r_name AS region, n_nationkey AS nation_id, n_name AS nation, count(*) AS orders, lpad(r_regionkey::VARCHAR, 2, '0') AS region_cve
           FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4, 5, 6""",
        "nation_id ASC NULLS LAST, year, month, region_id",
    ),
)
def _(t: Tables):
    return Q.plan(C.ORDERS, Q.CubeQuery(("orders",), ("month", "nation"), parents=True, order="nation", descending=False), t)


def listed(body: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS position, false AS truncated FROM ({body})"


@query(
    "i3_members_from_facts",
    listed("SELECT c_mktsegment AS id, c_mktsegment AS name, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT') AND c_mktsegment ILIKE '%ur%' GROUP BY 1, 2", "id"),
)
def _(t: Tables):
    return Q.members(C.ORDERS, "segment", t, contains="UR", filters={"priority": ["1-URGENT"]})


@query("i3_members_from_catalogue", listed("SELECT n_nationkey::VARCHAR AS id, n_name AS name, NULL::BIGINT AS n FROM nation WHERE n_name ILIKE '%n_1%'", "name, id"))
def _(t: Tables):
    return Q.members(C.CUSTOMERS, "nation", t, contains="N_1")


@query("i3_members_declared_order", "SELECT id, 'Flag ' || id AS name, NULL::BIGINT AS n, position, false AS truncated FROM (VALUES ('A', 1::BIGINT), ('N', 2), ('R', 3)) m(id, position)")
def _(t: Tables):
    return Q.members(C.QUANTITIES, "flag", t)


@query(
    "i3_members_by_synonym",
    """SELECT id, name, NULL::BIGINT AS n, row_number() OVER (ORDER BY hit, name, id) AS position, false AS truncated FROM (SELECT n_nationkey::VARCHAR AS id, n_name AS name,
         CASE WHEN regexp_matches(lower(n_name) || chr(10) || n_nationkey, '1') THEN 0 ELSE 1 END AS hit FROM nation WHERE regexp_matches(lower(n_name) || chr(10) || n_nationkey, '1|nation_2|nation_7'))""",
)
def _(t: Tables):
    # Decomposed accents in the query, a synonym in wide letters; ids are searched as well as names.
    return Q.members(C.CUSTOMERS, "nation", t, contains="1\u0301", thesaurus={"1": ["Na\u0301tion_2", "\uff4eation_7"]})


def _card_sql(key, topic, rows, cut, cube):
    not_additive = ",".join(m.key for m in cube.measures if not m.additive)
    start = Q.default_query(cube)
    return f"""SELECT '{",".join(m.unit for m in cube.measures)}' AS units, '{"; ".join(cube.notes)}' AS notes, '{",".join(start.measures)} by {",".join(start.columns)}' AS default_query, '{key}' AS cube, '{topic}' AS topic, ({rows}) AS rows, ({cut})::VARCHAR AS cut, '{",".join(m.key for m in cube.measures)}' AS measures, '{",".join(d.key for d in cube.dimensions)}' AS dimensions, '{not_additive}' AS not_additive"""


_COUNTS = {
    "sales": ("SELECT count(*) FROM lineitem", "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "orders": ("SELECT count(*) FROM orders", "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders"),
    "customers": ("SELECT count(*) FROM customer", "NULL"),
    "suppliers": ("SELECT count(*) FROM supplier", "NULL"),
    "parts": ("SELECT count(*) FROM part", "NULL"),
    "quantities": ("SELECT count(*) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey", "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders"),
    "census": ("SELECT count(DISTINCT c_nationkey) + count(DISTINCT n_regionkey) + 1 FROM customer JOIN nation ON c_nationkey = n_nationkey", "NULL"),
    "activity": ("SELECT count(*) FROM events", "SELECT max(ts) FROM events"),
    "funds": ("SELECT count(DISTINCT (c_mktsegment, strftime(o_orderdate, '%Y-%m'))) FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders"),
    "documents": ("SELECT count(*) FROM documents", "NULL"),
    "turns": ("SELECT count(*) FROM conversations", "NULL"),
}


@query("i4_cube_catalogue", " UNION ALL ".join(_card_sql(c.key, c.topic, *_COUNTS[c.key], c) for c in C.CUBES))
def _(t: Tables):
    return Q.catalogue(C.CUBES, t)


@query(
    "i5_unfold_virtual_dimension",
    numbered(
        """SELECT year, flag_id, 'Flag ' || flag_id AS flag, quantity FROM (SELECT year(o_orderdate)::INTEGER AS year, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT END)::BIGINT AS "A",
             sum(CASE WHEN l_returnflag = 'N' THEN l_quantity::BIGINT END)::BIGINT AS "N", sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT END)::BIGINT AS "R" FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
           UNPIVOT INCLUDE NULLS (quantity FOR flag_id IN ("A", "N", "R"))""",
        "quantity DESC NULLS LAST, year, flag_id",
    ),
)
def _(t: Tables):
    return Q.plan(C.QUANTITIES, Q.CubeQuery(("quantity",), ("year", "flag")), t)


@query(
    "i5_fold_virtual_filter",
    numbered(
        """SELECT o_orderstatus AS status, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT END)::BIGINT + sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT END)::BIGINT AS quantity
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
        "quantity DESC NULLS LAST, status",
    ),
)
def _(t: Tables):
    return Q.plan(C.QUANTITIES, Q.CubeQuery(("quantity",), ("status",), {"flag": ["A", "R"]}), t)


FLOWS_SQL = """m AS (SELECT c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS flow FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
     s AS (SELECT *, (sum(flow) OVER (PARTITION BY segment ORDER BY month))::BIGINT AS stock FROM m)"""


@query(
    "i8_semi_additive",
    f"""WITH {FLOWS_SQL}, r AS (SELECT segment, arg_max(stock, month) AS stock, sum(flow)::BIGINT AS flow, max(flow) AS largest_flow FROM s GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY stock DESC, segment) AS position, false AS truncated FROM r""",
)
def _(t: Tables):
    return Q.plan(C.FUNDS, Q.CubeQuery(("stock", "flow", "largest_flow"), ("segment",)), t)


def _default(cube: Q.Cube):
    return lambda t: Q.plan(cube, Q.default_query(cube), t)


_DEFAULTS = {
    "sales": (f"SELECT year(o_orderdate)::INTEGER AS year, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", "revenue DESC NULLS LAST, year"),
    "orders": ("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS orders FROM orders GROUP BY 1", "orders DESC NULLS LAST, year"),
    "customers": ("SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1", "customers DESC NULLS LAST, segment"),
    "suppliers": ("SELECT n_nationkey AS nation_id, n_name AS nation, count(*) AS suppliers FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2", "suppliers DESC NULLS LAST, nation_id"),
    "parts": ("SELECT p_brand AS brand, count(*) AS parts FROM part GROUP BY 1", "parts DESC NULLS LAST, brand"),
    "quantities": ("SELECT year(o_orderdate)::INTEGER AS year, sum(coalesce(l_quantity, 0)::BIGINT)::BIGINT AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", "quantity DESC NULLS LAST, year"),
    "census": ("SELECT unnest(['nation', 'region', 'world']) AS level, count(*) AS people FROM customer", "people DESC NULLS LAST, level"),
    "activity": ("SELECT hour(ts)::INTEGER AS hour, count(*) AS events FROM events WHERE event_type = 'click' GROUP BY 1", "events DESC NULLS LAST, hour"),
    "funds": (None, None),
    "documents": ("SELECT lang, count(*) AS documents FROM documents GROUP BY 1", "documents DESC NULLS LAST, lang"),
    "turns": ("SELECT role, count(*) AS turns FROM conversations GROUP BY 1", "turns DESC NULLS LAST, role"),
}

for _cube in C.CUBES:
    _body, _order = _DEFAULTS[_cube.key]
    _sql = numbered(_body, _order) if _body else f"WITH {FLOWS_SQL}, r AS (SELECT month, sum(stock)::BIGINT AS stock FROM s GROUP BY 1) SELECT *, row_number() OVER (ORDER BY stock DESC, month) AS position, false AS truncated FROM r"
    query(f"i7_cube_{_cube.key}", _sql)(_default(_cube))


@query(
    "i7_cube_documents_labels",
    numbered(
        "SELECT lang, count(*) AS documents, count(quality) AS labelled, sum(quality)::BIGINT / count(quality) AS avg_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
        "documents DESC NULLS LAST, lang",
    ),
)
def _(t: Tables):
    return Q.plan(C.DOCUMENTS, Q.CubeQuery(("documents", "labelled", "avg_quality"), ("lang",)), t)
