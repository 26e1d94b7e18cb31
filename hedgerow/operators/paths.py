"""Variable-length relationships, quantified groups and path selectors.

A step relation (near, far, ids, rels and, for groups, values) is joined to a frontier level by level. Bounded walks up to ``UNROLL`` steps stay
one lazy plan; longer ones checkpoint each level and stop when it is empty. Shortest paths search breadth first from the distinct
sources with a visited set, so a level costs one join and one anti join whatever the number of paths.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, Unsupported
from ..functions.values import BOOL, LONG, typed
from ..graph import holds
from ..plans.parser import Group, NodePattern, Part, RelPattern
from .checkpoints import cut

UNROLL = 5
#: Steps of a walk without an upper bound; a longer one raises an error instead of giving part of the answer.
MOST = 100


def steps(low, rel: RelPattern, keep=None) -> tuple[DataFrame, set, T.DataType]:
    """near, far, ids, rels of one step along a relationship pattern, over the tables that ``keep`` admits; properties and WHERE hold for each step."""
    from ..plans.lower import Frame

    df, b, _ = low.scan_rels(rel.types, keep, True)
    frame = low.props_filter(Frame(df, {rel.var: b} if rel.var else {}), b, rel.props, rel.where)
    v = b.value()
    s, e = F.col(b.fixed["start"]), F.col(b.fixed["end"])
    base = frame.df.select(s.alias("s"), e.alias("e"), F.array(b.id).alias("ids"), F.array(v.col).alias("rels"))
    out = base.select(F.col("s").alias("near"), F.col("e").alias("far"), "ids", "rels")
    back = base.select(F.col("e").alias("near"), F.col("s").alias("far"), "ids", "rels")
    if rel.direction == "<":
        out = back
    elif rel.direction == "-":
        out = out.unionAll(back.where("near <> far"))
    return out, low.kinds(low.rel_tables(rel.types)), T.ArrayType(v.type)


class Layers:
    """The edges of each step of a search of at most ``most`` steps between two node patterns.

    A step reads only the types that start at a label the search can have come to and from whose end the labels of the last node are within the
    steps left; a relationship whose ends' labels aren't known may lead anywhere.
    """

    def __init__(self, low, rel: RelPattern, first: NodePattern | None, last: NodePattern | None, most: int | None):
        self.low, self.rel, self.most = low, rel, most
        self.edges, self.types, self.kind = steps(low, rel)
        self.made: dict[frozenset, DataFrame] = {}
        tables = low.rel_tables(rel.types)
        self.arcs = None if any(None in (t.start_label, t.end_label) for t in tables) else []
        if self.arcs is None:
            return
        known = {t.labels for t in low.graph.nodes}
        known |= {frozenset({x}) for t in tables for x in (t.start_label, t.end_label) if not any(x in k for k in known)}
        for n, t in enumerate(tables):
            ends = [{k for k in known if x in k} for x in (t.start_label, t.end_label)]
            self.arcs += [(n, *ends)] * (rel.direction != "<") + [(n, *ends[::-1])] * (rel.direction != ">")
        fits = lambda node: {k for k in known if node is None or node.labels is None or low.depends(node.labels) or holds(k, low.static(node.labels))}
        self.here = fits(first)
        self.near = [fits(last)]  # labels from which the last node is within 0, 1, .. steps
        while most is None or len(self.near) < most:
            more = self.near[-1].union(*[s for _, s, e in self.arcs if e & self.near[-1]])
            if more == self.near[-1]:
                break
            self.near.append(more)

    def next(self, k: int) -> DataFrame:
        """The edges of step ``k``; steps are asked for in order."""
        if self.arcs is None:
            return self.edges
        goal = self.near[-1] if self.most is None else self.near[min(self.most - k, len(self.near) - 1)]
        on = [(n, e & goal) for n, s, e in self.arcs if s & self.here and e & goal]
        self.here = set().union(*[e for _, e in on])
        some = frozenset(n for n, _ in on)
        if some not in self.made:
            tables = self.low.rel_tables(self.rel.types)
            self.made[some] = steps(self.low, self.rel, lambda t: any(t is tables[n] for n in some))[0]
        return self.made[some]


class Same:
    """The same edges at each step."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    def next(self, k: int) -> DataFrame:
        return self.edges


def carried(low, part_var: str | None, x, kind: T.DataType) -> dict[str, T.DataType]:
    """The lists that a search carries: relationships only where a variable or a path holds them, not for their number."""
    wanted = any(n and n not in low.counted for n in (part_var, getattr(x, "var", None)))
    return {"ids": T.ArrayType(LONG)} | ({"rels": kind} if wanted else {})


def listed(names: dict[str, str], lists: dict[str, T.DataType]):
    """The value of a list of relationships: their ids where only their number is asked."""
    from ..plans.lower import Val

    n = "rels" if "rels" in lists else "ids"
    return Val(names[n], lists[n])


def group_steps(low, group: Group) -> tuple[DataFrame, set, T.DataType, dict]:
    """One step through a group: its pattern matched once; its variables become members of lists."""
    from ..plans.lower import Frame

    first, *rest = group.part.items
    idle = lambda x: (x.var is None or x.var in low.counted) and x.props is None and x.where is None
    if len(rest) == 2 and isinstance(first, NodePattern) and isinstance(rest[0], RelPattern) and not rest[0].many and isinstance(rest[1], NodePattern) and group.where is None and all(idle(x) and x.labels is None for x in (first, rest[1])):
        if rest[0].var is None or rest[0].var in low.counted:  # nothing is asked of its nodes but their number
            df, types, kind = steps(low, rest[0])
            names = [x.var for x in group.part.items if x.var]
            return df.select("*", *[F.array(F.lit(True)).alias(f"v_{n}") for n in names]), types, kind, {n: T.ArrayType(BOOL) for n in names}
    inner = replace(group.part, items=list(group.part.items), var=None)
    ends = []
    for k in (0, -1):
        n = replace(inner.items[k], var=inner.items[k].var or f" end{k}")
        inner.items[k] = n
        ends.append(n.var)
    for k, x in enumerate(inner.items):
        if isinstance(x, RelPattern) and not x.var:
            inner.items[k] = replace(x, var=f" rel{k}")
    low.counted, counted = set(), low.counted
    frame = low.match(Frame(None), [inner], group.where)
    low.counted = counted
    names = [x.var for x in group.part.items if getattr(x, "var", None)]
    values = {n: frame.env[n].value() for n in names}
    rels = low.chain([frame.env[x.var].value() for x in inner.items if isinstance(x, RelPattern)])
    ids = F.transform(rels.col, lambda r: r.getField("id"))
    values = {n: typed(F.lit(True), BOOL) if n in counted else v for n, v in values.items()}  # only how many there are is asked
    df = frame.df.select(F.col(frame.env[ends[0]].id).alias("near"), F.col(frame.env[ends[1]].id).alias("far"), ids.alias("ids"), rels.col.alias("rels"), *[F.array(v.col).alias(f"v_{n}") for n, v in values.items()])
    types = low.kinds(low.graph.rels)
    return df, types, rels.type, {n: T.ArrayType(v.type) for n, v in values.items()}


def step(edges: Layers | Same, k: int, lists: dict) -> DataFrame:
    return edges.next(k).select(F.col("near"), F.col("far").alias("to"), *[F.col(n).alias(f"n_{n}") for n in lists])


def walk(sources: DataFrame, edges: Layers | Same, least: int, most: int | None, lists: dict[str, T.DataType]) -> DataFrame:
    """src, far and the lists of every trail of least..most steps from each source; no relationship twice in a trail."""
    level = sources.select("src", F.col("src").alias("far"), *[F.array().cast(t).alias(n) for n, t in lists.items()])
    out = level if least == 0 else None
    k, bound = 0, MOST if most is None else most
    while k < bound:
        k += 1
        level = level.join(step(edges, k, lists), F.col("far") == F.col("near")).where(~F.arrays_overlap("ids", "n_ids"))
        level = level.select("src", F.col("to").alias("far"), *[F.concat(n, f"n_{n}").alias(n) for n in lists])
        if bound > UNROLL:
            level = cut(level)
            if level.limit(1).count() == 0:
                break
            if most is None and k == MOST:
                raise Unsupported("PathTooLong", f"a walk of more than {MOST} steps")
        if k >= least:
            out = level if out is None else out.unionAll(level)
    return out if out is not None else level.limit(0)


def shortest(pairs: DataFrame, edges: Layers | Same, most: int | None, lists: dict, every: bool) -> DataFrame:
    """src, far and the lists of one shortest trail (or all) for each pair (src, dst)."""
    level = cut(pairs.select("src").distinct().select("src", F.col("src").alias("far"), *[F.array().cast(t).alias(n) for n, t in lists.items()]))
    visited = level.select("src", "far")
    left = cut(pairs.select("src", "dst").distinct())
    out, k = None, 0
    while k < (most if most is not None else 1 << 30):
        k += 1
        level = level.join(step(edges, k, lists), F.col("far") == F.col("near")).select("src", F.col("to").alias("far"), *[F.concat(n, f"n_{n}").alias(n) for n in lists])
        level = level.join(visited, ["src", "far"], "left_anti")
        if not every:
            level = level.groupBy("src", "far").agg(*[F.min_by(n, "ids").alias(n) for n in lists])
        level = cut(level)
        found = level.join(left.withColumnRenamed("dst", "far"), ["src", "far"])
        out = found if out is None else out.unionAll(found)
        left = cut(left.join(level.select("src", F.col("far").alias("dst")).distinct(), ["src", "dst"], "left_anti"))
        # a source without pairs left is not searched on
        level = level.join(left.select("src").distinct(), "src", "left_semi")
        if level.limit(1).count() == 0:
            break
        visited = cut(visited.unionAll(level.select("src", "far").distinct()))
    return cut(out)


def shortest_to(sources: DataFrame, targets: DataFrame, edges: Layers | Same, most: int | None, lists: dict, every: bool) -> DataFrame:
    """src, far and the lists of one shortest trail (or all) from each source to each other target (far) that it reaches.

    Ends are never crossed: a source is searched on until it has met as many targets as there are.
    """
    targets = cut(targets.select("far").distinct())
    many = targets.count()
    level = cut(sources.select("src").distinct().select("src", F.col("src").alias("far"), *[F.array().cast(t).alias(n) for n, t in lists.items()]))
    own = targets.select(F.col("far").alias("src"), F.lit(1).alias("own"))
    left = level.select("src").join(own, "src", "left").select("src", (F.lit(many) - F.coalesce("own", F.lit(0))).alias("left"))
    visited = level.select("src", "far")
    out, k = None, 0
    while k < (most if most is not None else 1 << 30):
        k += 1
        level = level.join(step(edges, k, lists), F.col("far") == F.col("near")).select("src", F.col("to").alias("far"), *[F.concat(n, f"n_{n}").alias(n) for n in lists])
        level = level.join(visited, ["src", "far"], "left_anti")
        if not every:
            level = level.groupBy("src", "far").agg(*[F.min_by(n, "ids").alias(n) for n in lists])
        level = cut(level)
        found = level.join(targets, "far", "left_semi")
        out = found if out is None else out.unionAll(found)
        met = found.select("src", "far").distinct().groupBy("src").count()
        left = cut(left.join(met, "src", "left").select("src", (F.col("left") - F.coalesce("count", F.lit(0))).alias("left")).where("left > 0"))
        level = level.join(left.select("src"), "src", "left_semi")
        if k == most or level.limit(1).count() == 0:
            break
        visited = cut(visited.unionAll(level.select("src", "far").distinct()))
    return cut(out)


def expand(low, frame, at: str, rel: RelPattern, seen: list, path: str | None, near: NodePattern, node: NodePattern):
    """A variable-length relationship from the node at column ``at``: (frame, column of the far end, list of relationships)."""
    from ..plans.lower import fresh

    edges = Layers(low, rel, near, node, rel.high)
    types, lists = edges.types, carried(low, path, rel, edges.kind)
    sources = frame.df.select(F.col(at).alias("src")).distinct()
    names = {n: fresh() for n in ("src", "far", *lists)}
    found = walk(sources, edges, 1 if rel.low is None else rel.low, rel.high, lists).select(*[F.col(n).alias(c) for n, c in names.items()])
    frame = replace(frame, df=frame.df.join(found, F.col(at) == F.col(names["src"])))
    frame = low.unique(frame, names["ids"], types, True, seen)
    bound = listed(names, lists)
    if rel.var:
        frame = low.bind(frame, rel.var, bound)
    return frame, names["far"], bound


def select_paths(low, frame, part: Part, seen: list, waiting: list):
    """A part with a selector or with quantified groups. Conditions on the ends alone hold before a selector, which chooses for each pair of ends."""
    from ..plans.lower import Val, fresh

    items = _spaced(part.items)
    frame, at = low.match_node(frame, items[0], None, low.near_labels(items))
    frame = low.settle(frame, waiting)
    first, trail = at, [at]
    if part.selector and len(items) == 3:
        return _selected(low, frame, part, items, at, waiting)
    for near, x, node in zip(items[::2], items[1::2], items[2::2], strict=False):
        if isinstance(x, Group):
            edges, types, kind, values = group_steps(low, x)
            lists = carried(low, part.var, x, kind) | {f"v_{n}": t for n, t in values.items()}
            names = {n: fresh() for n in ("src", "far", *lists)}
            found = walk(frame.df.select(F.col(at).alias("src")).distinct(), Same(edges), x.low, x.high, lists).select(*[F.col(n).alias(c) for n, c in names.items()])
            frame = replace(frame, df=frame.df.join(found, F.col(at) == F.col(names["src"])))
            frame = low.unique(frame, names["ids"], types, True, seen)
            for n, t in values.items():
                frame = low.bind(frame, n, Val(names[f"v_{n}"], t))
            at = names["far"]
            trail.append(("many", listed(names, lists)))
        elif x.many:
            frame, at, rels = expand(low, frame, at, x, seen, part.var, near, node)
            trail.append(("many", rels))
        else:
            frame, _, at, b, _ = low.hop(frame, at, x, seen, near, node)
            trail.append(b)
        frame, at = low.match_node(frame, node, at, low.path_labels([x]))
        if not part.selector:
            frame = low.settle(frame, waiting)
        trail.append(at)
    var = part.var or " path"
    if part.var or part.selector:
        frame = low.bind_path(frame, var, trail, low.path_labels(part.items))
    if part.selector:
        frame = _ranked(low, frame, part.selector, F.size(F.col(frame.env[var].col).getField("relationships")), [first, at])
    return frame


def _spaced(items: list) -> list:
    """Items with a node between any two relationships or groups, and at both ends."""
    out: list = []
    for x in items:
        inner = list(x.part.items) if isinstance(x, Group) and x.low is None else [x]
        for y in inner:
            if isinstance(y, NodePattern) == bool(out and isinstance(out[-1], NodePattern)) and out and isinstance(y, NodePattern):
                raise Unsupported("AdjacentNodes", "two nodes side by side")
            if not isinstance(y, NodePattern) and (not out or not isinstance(out[-1], NodePattern)):
                out.append(NodePattern())
            out.append(y)
    if not isinstance(out[-1], NodePattern):
        out.append(NodePattern())
    return out


def _ranked(low, frame, selector, size, ends):
    """Keep, for each pair of ends, the paths that the selector asks for; more paths than the graph's limit, if it has one, are an error."""
    from ..plans.lower import fresh

    if low.graph.selector_limit is not None:
        frame = replace(frame, df=cut(frame.df))
        if frame.df.count() > low.graph.selector_limit:
            raise QueryError("SelectorLimit", f"a path selector has more than {low.graph.selector_limit} matches to choose from")

    kind, k = selector
    if kind == "all":
        return frame
    rank = fresh()
    w = Window.partitionBy(*ends, *frame.carry).orderBy(size)
    f = F.dense_rank() if kind in ("groups", "all shortest") else F.row_number()
    return replace(frame, df=frame.df.withColumn(rank, f.over(w)).where(F.col(rank) <= max(1, k)).drop(rank))


def _chosen(found: DataFrame, selector, lists: dict, single: bool) -> DataFrame:
    """The paths of each pair (src, far) that a selector asks for; ``single``: all are of one relationship."""
    kind, k = selector
    if kind == "all":
        return found
    if k <= 1 and kind not in ("groups", "all shortest"):
        if single and len(lists) == 1:  # a plain number aggregates by hash
            return found.groupBy("src", "far").agg(F.min(F.col("ids")[0]).alias("ids")).select("src", "far", F.array("ids").alias("ids"))
        first = F.struct(F.size("ids"), "ids")
        return found.groupBy("src", "far").agg(*[F.min_by(n, first).alias(n) for n in lists])
    w = Window.partitionBy("src", "far").orderBy(F.size("ids"))
    f = F.dense_rank() if kind in ("groups", "all shortest") else F.row_number()
    return found.withColumn("rank", f.over(w)).where(F.col("rank") <= max(1, k)).drop("rank")


def _selected(low, frame, part: Part, items: list, at: str, waiting: list):
    """A selector over one relationship or group between two nodes."""
    from ..plans.lower import Frame, Val, fresh, uses

    x, node = items[1], items[2]
    values: dict = {}
    if isinstance(x, Group):
        edges, _, kind, values = group_steps(low, x)
        edges, least, most = Same(edges), x.low, x.high
    else:
        least, most = (x.low, x.high) if x.many else (1, 1)
        edges = Layers(low, x, items[0], node, most)
        kind = edges.kind
    lists = carried(low, part.var, x, kind) | {f"v_{n}": t for n, t in values.items()}
    names = {n: fresh() for n in ("src", "far", *lists)}
    kind_of, k = part.selector
    alone = lambda e: set(uses(e, {})) <= {node.var}
    if kind_of in ("any", "all shortest") and least == 1 and node.var not in frame.env and alone(node.props) and alone(node.where) and not low.holds_subquery(node.where):
        ends, end = low.match_node(Frame(None), node, None)
        for c in waiting:
            if node.var and set(uses(c, {})) == {node.var}:
                ends = low.filter(ends, c)
        found = shortest_to(frame.df.select(F.col(at).alias("src")), ends.df.select(F.col(end).alias("far")), edges, most, lists, kind_of != "any").select(*[F.col(n).alias(c) for n, c in names.items()])
        frame = replace(frame, df=frame.df.join(found, F.col(at) == F.col(names["src"])))
        frame, to = low.match_node(frame, node, names["far"], low.path_labels([x]))
    elif kind_of in ("any", "all shortest") and least == 1:
        frame, to = low.match_node(frame, node, None)  # the ends are matched first: their labels and properties steer the search
        pairs = frame.df.select(F.col(at).alias("src"), F.col(to).alias("dst")).where("src <> dst").distinct()
        found = shortest(pairs, edges, most, lists, kind_of != "any").select(*[F.col(n).alias(c) for n, c in names.items()])
        frame = replace(frame, df=frame.df.join(found, (F.col(at) == F.col(names["src"])) & (F.col(to) == F.col(names["far"]))))
    else:
        found = walk(frame.df.select(F.col(at).alias("src")).distinct(), edges, least, most, lists)
        if low.graph.selector_limit is None:  # chosen before anything is joined: conditions on the ends keep or drop all paths of a pair
            found = _chosen(found, part.selector if kind_of != "any" else ("row", 1), lists, most == 1 and not isinstance(x, Group))
        found = found.select(*[F.col(n).alias(c) for n, c in names.items()])
        frame = replace(frame, df=frame.df.join(found, F.col(at) == F.col(names["src"])))
        last, implied = (replace(node, var=None) if node.var in low.unread else node), low.path_labels([x])
        if isinstance(x, RelPattern) and x.low != 0 and x.direction != "-":
            ends = {t.end_label if x.direction == ">" else t.start_label for t in low.rel_tables(x.types)}
            implied = None if None in ends else ends
        frame, to = low.match_node(frame, last, names["far"], implied)
        frame = low.settle(frame, waiting)
        if low.graph.selector_limit is not None:
            frame = _ranked(low, frame, ("row", 1) if kind_of == "any" else part.selector, F.size(names["ids"]), [at, to])
    rels = listed(names, lists)
    if getattr(x, "var", None):
        frame = low.bind(frame, x.var, rels)
    for n, t in values.items():
        frame = low.bind(frame, n, Val(names[f"v_{n}"], t))
    frame = low.settle(frame, waiting)
    return low.bind_path(frame, part.var, [at, ("many", rels), to], low.path_labels(part.items)) if part.var else frame


__all__ = ["expand", "select_paths", "shortest", "shortest_to", "typed", "walk"]
