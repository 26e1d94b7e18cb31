"""A property graph as typed DataFrames: one per set of node labels, one per relationship type.

Node ids pack the label's number and the table's key into one long, so ids are stable, unique over the graph, and tell the label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BITS = 48


@dataclass
class NodeTable:
    labels: frozenset[str]
    df: DataFrame  # id, then properties


@dataclass
class RelTable:
    type: str
    df: DataFrame  # id, start, end, then properties
    start_label: str | None = None
    end_label: str | None = None


@dataclass
class Graph:
    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    codes: dict[str, int] = field(default_factory=dict)
    catalog: dict[str, dict] = field(default_factory=dict)
    procedures: dict[str, object] = field(default_factory=dict)
    selector_limit: int | None = None

    def code(self, name: str) -> int:
        return self.codes.setdefault(name, len(self.codes) + 1)

    def node_id(self, label: str, key: Column) -> Column:
        return F.lit(self.code(label) << KEY_BITS).bitwiseOR(key.cast("long"))

    def add_nodes(self, label: str, df: DataFrame, key: str, rename: dict[str, str] | None = None, drop: tuple[str, ...] = (), labels: tuple[str, ...] = ()) -> Graph:
        names = {c: (rename or {}).get(c, c) for c in df.columns if c not in drop}
        self.nodes.append(NodeTable(frozenset({label, *labels}), df.select(self.node_id(label, F.col(key)).alias("id"), *[F.col(c).alias(n) for c, n in names.items()])))
        return self

    def add_rels(self, kind: str, df: DataFrame, start: tuple[str, Column], end: tuple[str, Column], key: Column, props: dict[str, Column] | None = None) -> Graph:
        cols = [F.lit(self.code("[" + kind) << KEY_BITS).bitwiseOR(key.cast("long")).alias("id"), self.node_id(*start).alias("start"), self.node_id(*end).alias("end")]
        frame = df.select(*cols, *[c.alias(n) for n, c in (props or {}).items()]).where("start IS NOT NULL AND end IS NOT NULL")
        self.rels.append(RelTable(kind, frame, start[0], end[0]))
        return self

    def copy(self) -> Graph:
        return Graph(self.spark, list(self.nodes), list(self.rels), dict(self.codes), dict(self.catalog), self.procedures, self.selector_limit)

    def node_props(self) -> dict[str, T.DataType]:
        return _common([t.df.schema for t in self.nodes], {"id"})


def _common(schemas: list[T.StructType], skip: set[str]) -> dict[str, T.DataType]:
    """Name -> type that holds the values of all tables: the widest number, else text where types differ."""
    out: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s:
            if f.name in skip:
                continue
            old = out.get(f.name)
            if old is None or isinstance(old, T.NullType):
                out[f.name] = f.dataType
            elif old != f.dataType and not isinstance(f.dataType, T.NullType):
                both = (old, f.dataType)
                if all(isinstance(x, T.IntegralType) for x in both):
                    out[f.name] = T.LongType()
                elif all(isinstance(x, T.NumericType) for x in both):
                    out[f.name] = T.DoubleType()
                else:
                    out[f.name] = T.StringType()
    return out


def holds(labels, expr: tuple | None) -> bool:
    """Whether a set of labels satisfies a label expression."""
    if expr is None:
        return True
    match expr:
        case ("name", n):
            return n in labels
        case ("and", a, b):
            return holds(labels, a) and holds(labels, b)
        case ("or", a, b):
            return holds(labels, a) or holds(labels, b)
        case ("not", a):
            return not holds(labels, a)
        case ("any",):
            return bool(labels)
    raise ValueError(expr)


def union(frames: list[DataFrame], types: dict[str, T.DataType], fixed: list[str]) -> DataFrame:
    """Frames with the fixed columns and every property, absent ones null."""
    made = [f.select(*fixed, *[(F.col(f"`{n}`") if n in f.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()]) for f in frames]
    out = made[0]
    for f in made[1:]:
        out = out.unionAll(f)
    return out
