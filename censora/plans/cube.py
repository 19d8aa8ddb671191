"""Semantic cubes: a declared fact with measures, dimensions and hierarchies, and the one function that turns a query into
a DataFrame plan.

A definition knows what may be summed. A query is refused when it would count nested universes several times, lacks a
mandatory filter or names something unknown. Everything else is a plain Catalyst plan: filter, join, group, order. Results are
complete unless the query itself asks for a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.functions.scalars import map_code
from censora.functions.text import synonym_search
from censora.operators.filters import MAX_FILTER_VALUES, in_filter
from censora.operators.paging import ordered, truncated


@dataclass(frozen=True)
class Measure:
    """``expr`` is an aggregate in SQL. ``kind``: a flow adds up, a stock only adds up at one moment (over time the last
    one counts), a rate is never added."""

    key: str
    expr: str
    unit: str = ""
    kind: str = "flow"
    decimals: int | None = None

    @property
    def additive(self) -> bool:
        return self.kind != "rate"


@dataclass(frozen=True)
class Member:
    """Member of a virtual dimension: per measure the aggregate over the column that stands for it."""

    id: str
    name: str
    exprs: Mapping[str, str]


@dataclass(frozen=True)
class Dimension:
    """``id`` and ``name`` are SQL over the joined fact. ``links`` are the joins they need. ``partition`` marks nested
    universes; it lists the dimensions whose grouping already tells them apart."""

    key: str
    id: str
    name: str | None = None
    kind: str = "categorical"
    parent: str | None = None
    order: str | None = None
    links: tuple[str, ...] = ()
    virtual: tuple[Member, ...] = ()
    partition: tuple[str, ...] | None = None
    codes: Mapping[str, str] | None = None
    catalogue: Callable[[object], DataFrame] | None = None

    @property
    def id_column(self) -> str:
        return f"{self.key}_id" if self.name or self.virtual else self.key


@dataclass(frozen=True)
class Link:
    """A join of the fact to another table: condition in SQL over both, after the links it ``needs``."""

    table: Callable[[object], DataFrame]
    on: str
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rollup:
    """A stored summary: it answers queries over its dimensions and measures, by summing again."""

    dimensions: tuple[str, ...]
    measures: tuple[str, ...]
    table: Callable[[object], DataFrame]


@dataclass(frozen=True)
class Cube:
    key: str
    topic: str
    fact: Callable[[object], DataFrame]
    measures: tuple[Measure, ...]
    dimensions: tuple[Dimension, ...]
    links: Mapping[str, Link] = field(default_factory=dict)
    where: str | None = None
    where_links: tuple[str, ...] = ()
    measure_links: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    time: str | None = None
    cut: str | None = None
    default: Mapping[str, object] = field(default_factory=dict)
    notes: tuple[str, ...] = ()
    rollups: tuple[Rollup, ...] = ()

    def dimension(self, key: str) -> Dimension:
        for d in self.dimensions:
            if d.key == key:
                return d
        raise CubeError(f"cube {self.key!r} has no dimension {key!r}")

    def measure(self, key: str) -> Measure:
        for m in self.measures:
            if m.key == key:
                return m
        raise CubeError(f"cube {self.key!r} has no measure {key!r}")


@dataclass(frozen=True)
class CubeQuery:
    measures: tuple[str, ...]
    columns: tuple[str, ...] = ()
    filters: Mapping[str, Sequence] = field(default_factory=dict)
    parents: bool = False
    order: str | None = None
    descending: bool = True
    limit: int | None = None


class CubeError(ValueError):
    """The query or the definition is not valid."""


def check_definition(cube: Cube) -> None:
    """Unique keys, existing parents, links and defaults, virtual members that cover some measure."""
    for label, keys in (("measure", [m.key for m in cube.measures]), ("dimension", [d.key for d in cube.dimensions])):
        if len(set(keys)) != len(keys):
            raise CubeError(f"cube {cube.key!r} repeats a {label}")
    for d in cube.dimensions:
        if d.parent:
            cube.dimension(d.parent)
        for other in d.partition or ():
            cube.dimension(other)
        for name in d.links:
            if name not in cube.links:
                raise CubeError(f"dimension {d.key!r} needs the unknown link {name!r}")
    for key in (*cube.required, *([cube.time] if cube.time else [])):
        cube.dimension(key)
    check_query(cube, default_query(cube))


def default_query(cube: Cube) -> CubeQuery:
    return CubeQuery(**cube.default) if cube.default else CubeQuery((cube.measures[0].key,))


def _names(cube: Cube, q: CubeQuery) -> Iterator[str]:
    """What the query names exists, and nothing is asked for twice."""
    known = {"measure": {m.key for m in cube.measures}, "dimension": {d.key for d in cube.dimensions}}
    for kind, asked in (("measure", q.measures), ("dimension", q.columns), ("dimension", tuple(q.filters))):
        for key in sorted(set(asked) - known[kind]):
            yield f"{cube.key} declares no {kind} {key}"
        for key in sorted({k for k in asked if asked.count(k) > 1}):
            yield f"{kind} {key} is asked for more than once"
    if not q.measures:
        yield "a query needs a measure"
    if q.order is not None and q.order not in {*q.measures, *q.columns}:
        yield f"{q.order} is not in the result, so it cannot order it"


def _sizes(cube: Cube, q: CubeQuery) -> Iterator[str]:
    """Filters have values, but not more than a predicate should hold; a limit leaves something."""
    for key, values in q.filters.items():
        if not values:
            yield f"the filter by {key} has no values"
        if len(values) > MAX_FILTER_VALUES:
            yield f"the filter by {key} has {len(values)} values; join a table of more than {MAX_FILTER_VALUES}"
    if q.limit is not None and q.limit < 1:
        yield f"a limit of {q.limit} leaves nothing"


def _mandatory(cube: Cube, q: CubeQuery) -> Iterator[str]:
    for key in cube.required:
        if not q.filters.get(key):
            yield f"{cube.key} is only read filtered by {key}"


def _universes(cube: Cube, q: CubeQuery) -> Iterator[str]:
    """Levels that contain one another are told apart by a filter, or by grouping along them."""
    for d in cube.dimensions:
        apart = {d.key, *(d.partition or ())} & set(q.columns)
        if d.partition is not None and not apart and not q.filters.get(d.key):
            yield f"the levels of {d.key} contain one another and would be counted several times"


def _virtuals(cube: Cube, q: CubeQuery) -> Iterator[str]:
    """Columns of a wide table stand for one dimension at a time."""
    virtual = {d.key for d in cube.dimensions if d.virtual}
    used = virtual & {*q.columns, *q.filters}
    if len(used) > 1:
        yield f"{' and '.join(sorted(used))} both stand for columns; a query can break down by one of them"


# Each rule tells what is wrong, independently of the others.
RULES: tuple[Callable[[Cube, CubeQuery], Iterator[str]], ...] = (_names, _sizes, _mandatory, _universes, _virtuals)


def check_query(cube: Cube, q: CubeQuery) -> None:
    """Refuse a query with everything that is wrong with it."""
    wrong = [complaint for rule in RULES for complaint in rule(cube, q)]
    if wrong:
        raise CubeError("; ".join(wrong))


def expand(cube: Cube, q: CubeQuery) -> list[Dimension]:
    """The columns, each preceded by its ancestors when the query asks for parents; none is repeated."""
    out: list[Dimension] = []
    for key in q.columns:
        chain = [cube.dimension(key)]
        while q.parents and chain[0].parent:
            chain.insert(0, cube.dimension(chain[0].parent))
        out.extend(d for d in chain if d not in out)
    return out


def _joined(cube: Cube, tables, links: Sequence[str]) -> DataFrame:
    """The fact with only the links that the query needs; left joins, so unknown codes stay."""
    df, done = cube.fact(tables), set()

    def add(name: str) -> None:
        nonlocal df
        if name in done:
            return
        done.add(name)
        link = cube.links[name]
        for other in link.needs:
            add(other)
        df = df.join(link.table(tables), F.expr(link.on), "left")

    for name in links:
        add(name)
    return df


def _aggregate(cube: Cube, source: DataFrame, dims: Sequence[Dimension], q: CubeQuery) -> DataFrame:
    """Group the source by the real dimensions. Stocks that would be added over time take their last period instead."""
    real = [d for d in dims if not d.virtual]
    virtual = next((d for d in dims if d.virtual), None)
    keys = [c for d in real for c in ([(f"{d.key}_id", d.id), (d.key, d.name)] if d.name else [(d.key, d.id)])]
    keyed = [F.expr(sql).alias(name) for name, sql in keys]
    names = [name for name, _ in keys]
    folded = next((cube.dimension(k) for k in q.filters if cube.dimension(k).virtual), None)
    members = _members(virtual or folded, q) if (virtual or folded) else None

    def column(m: Measure, member: Member | None = None) -> Column:
        if member is not None:
            return F.expr(member.exprs[m.key]) if m.key in member.exprs else F.lit(None).cast("double")
        if folded is None or virtual is not None:
            return F.expr(m.expr)
        parts = [F.expr(x.exprs[m.key]) for x in members if m.key in x.exprs]
        if not parts:
            raise CubeError(f"measure {m.key!r} is not broken down by {folded.key!r}")
        return sum(parts[1:], parts[0])

    chosen = [cube.measure(k) for k in q.measures]
    if virtual is not None:
        for m in chosen:
            if not any(m.key in x.exprs for x in members):
                raise CubeError(f"measure {m.key!r} is not broken down by {virtual.key!r}")
        # One struct per member, all computed in the one aggregation, then one row each.
        shown = [
            F.struct(F.lit(x.id).alias(virtual.id_column), F.lit(x.name).alias(virtual.key), *[column(m, x).alias(m.key) for m in chosen]) for x in members
        ]
        return source.groupBy(*keyed).agg(F.array(*shown).alias("_members")).select(*names, F.inline("_members"))
    time_shown = cube.time is None or any(d.key == cube.time for d in dims)
    late = [m for m in chosen if m.kind == "stock"] if not time_shown else []
    plain = [m for m in chosen if m not in late]
    frames = []
    if plain:
        frames.append(source.groupBy(*keyed).agg(*[column(m).alias(m.key) for m in plain]))
    if late:
        period = F.expr(cube.dimension(cube.time).id).alias("_period")
        by_period = source.groupBy(*keyed, period).agg(*[column(m).alias(m.key) for m in late])
        frames.append(
            by_period.groupBy(*names).agg(*[F.max_by(m.key, "_period").alias(m.key) for m in late])
        )
    if len(frames) == 1:
        return frames[0]
    left, right = frames[0], frames[1].select(*[F.col(n).alias(f"r_{n}") for n in names], *[m.key for m in late])
    if not names:
        return left.withColumns({m.key: frames[1].select(m.key).scalar() for m in late})
    on = [left[n].eqNullSafe(right[f"r_{n}"]) for n in names]
    return left.join(right, on).drop(*[f"r_{n}" for n in names])


def _members(d: Dimension, q: CubeQuery) -> list[Member]:
    wanted = q.filters.get(d.key)
    chosen = [m for m in d.virtual if wanted is None or m.id in wanted]
    if not chosen:
        raise CubeError(f"no member of {d.key!r} matches the filter")
    return chosen


def _route(cube: Cube, q: CubeQuery, dims: Sequence[Dimension]) -> Rollup | None:
    """The narrowest rollup that holds every column, filter and measure of the query; only additive measures travel."""
    needed = {d.key for d in dims} | set(q.filters)
    if any(cube.dimension(k).virtual for k in needed) or any(cube.measure(k).kind != "flow" for k in q.measures):
        return None
    fit = [r for r in cube.rollups if needed <= set(r.dimensions) and set(q.measures) <= set(r.measures)]
    return min(fit, key=lambda r: len(r.dimensions), default=None)


def rollup_frame(cube: Cube, tables, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The summary a rollup stores: one row per combination of its dimensions, one column per additive measure."""
    if any(cube.measure(k).kind != "flow" for k in measures):
        raise CubeError("only flows can be summed again")
    dims = [cube.dimension(k) for k in dimensions]
    q = CubeQuery(tuple(measures), tuple(dimensions))
    return _aggregate(cube, _base(cube, tables, dims, q), dims, q)


def _base(cube: Cube, tables, dims: Sequence[Dimension], q: CubeQuery) -> DataFrame:
    stocks = cube.time and any(cube.measure(k).kind == "stock" for k in q.measures)
    used = [*dims, *[cube.dimension(k) for k in q.filters], *([cube.dimension(cube.time)] if stocks else [])]
    links = [x for d in used for x in d.links] + [x for k in q.measures for x in cube.measure_links.get(k, ())]
    df = _joined(cube, tables, [*cube.where_links, *links])
    if cube.where:
        df = df.where(cube.where)
    for key, values in q.filters.items():
        d = cube.dimension(key)
        if not d.virtual:
            df = df.where(in_filter(F.expr(d.id), list(values)))
    return df


def plan(cube: Cube, q: CubeQuery, tables) -> DataFrame:
    """The result of a query: columns of its dimensions, its measures, ``position`` in the asked order and ``truncated``."""
    check_query(cube, q)
    dims = expand(cube, q)
    rollup = _route(cube, q, dims)
    if rollup is None:
        result = _aggregate(cube, _base(cube, tables, dims, q), dims, q)
    else:
        stored = rollup.table(tables)
        for key, values in q.filters.items():
            stored = stored.where(in_filter(cube.dimension(key).id_column, list(values)))
        keys = [c for d in dims for c in ([d.id_column, d.key] if d.name else [d.key])]
        result = stored.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in q.measures])
    for d in dims:
        if d.kind == "geographic" and d.codes:
            result = result.withColumn(f"{d.key}_cve", map_code(F.col(d.id_column).cast("string"), d.codes))
    first = q.order or q.measures[0]
    by_dimension = next((d for d in dims if d.key == first), None)
    rest = [d.id_column for d in dims]
    order = ordered(by_dimension.id_column if by_dimension else first, q.descending, rest)
    return truncated(result, order, q.limit)


def members(
    cube: Cube,
    key: str,
    tables,
    contains: str | None = None,
    filters: Mapping[str, Sequence] | None = None,
    limit: int | None = None,
    thesaurus: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Members of a dimension ``(id, name, n, position, truncated)``: the declared ones of a virtual dimension in their
    declared order, the catalogue's by name, or those found in the fact with their rows, under the filters of other
    dimensions, by id; a declared order goes first. With a thesaurus the search ignores accents and knows synonyms; members
    that hold the words themselves come first. All members, unless the caller sets a limit."""
    d, filters = cube.dimension(key), dict(filters or {})
    unknown = F.lit(None).cast("bigint").alias("n")
    text = lambda sql, name: F.expr(sql).cast("string").alias(name)
    order = [F.expr(d.order)] if d.order else []
    if d.virtual:
        declared = [(m.id, m.name, i) for i, m in enumerate(d.virtual)]
        frame = tables.spark.createDataFrame(declared, "id string, name string, place int").select("id", "name", unknown, "place")
        order.append(F.col("place"))
    elif d.catalogue is not None:
        frame = d.catalogue(tables).select(text("id", "id"), text("name", "name"), unknown)
        order.append(F.col("name"))
    else:
        for needed in cube.required:
            if needed != key and not filters.get(needed):
                raise CubeError(f"members of {key!r} are read from the fact: filter by {needed!r}")
        kept = {k: v for k, v in filters.items() if k != key and not cube.dimension(k).virtual}
        base = _base(cube, tables, [d], CubeQuery((), (key,), kept))
        frame = base.groupBy(text(d.id, "id"), text(d.name or d.id, "name")).agg(F.count(F.lit(1)).alias("n"))
    order.append(F.col("id"))
    if contains and thesaurus is not None:
        frame = synonym_search(frame, ["name", "id"], contains, thesaurus)
        order.insert(0, F.col("synonym_only"))
    elif contains:
        needle = contains.lower()
        frame = frame.where(F.contains(F.lower("name"), F.lit(needle)) | F.contains(F.lower("id"), F.lit(needle)))
    return truncated(frame, order, limit).select("id", "name", "n", "position", "truncated")


def card(cube: Cube, tables) -> DataFrame:
    """One row that describes a cube: rows of its universe, latest cut-off, measures with units, dimensions, notes and the
    default query."""
    used, start = [cube.dimension(cube.time)] if cube.time else [], default_query(cube)
    base = _base(cube, tables, used, CubeQuery((cube.measures[0].key,)))
    cut = F.max(F.expr(cube.cut)).cast("string") if cube.cut else F.lit(None).cast("string")
    return base.agg(
        F.lit(cube.key).alias("cube"),
        F.lit(cube.topic).alias("topic"),
        F.count(F.lit(1)).alias("rows"),
        cut.alias("cut"),
        F.lit(",".join(m.key for m in cube.measures)).alias("measures"),
        F.lit(",".join(d.key for d in cube.dimensions)).alias("dimensions"),
        F.lit(",".join(m.key for m in cube.measures if not m.additive)).alias("not_additive"),
        F.lit(",".join(m.unit for m in cube.measures)).alias("units"),
        F.lit("; ".join(cube.notes)).alias("notes"),
        F.lit(f"{','.join(start.measures)} by {','.join(start.columns)}").alias("default_query"),
    )


def catalogue(cubes: Sequence[Cube], tables) -> DataFrame:
    """The cards of all cubes, by topic."""
    frame = card(cubes[0], tables)
    for cube in cubes[1:]:
        frame = frame.unionByName(card(cube, tables))
    return frame
