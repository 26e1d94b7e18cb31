"""Built-in procedures, and those a user registers as functions that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ProcedureError, Unsupported
from ..functions import scalar as S
from ..functions.values import DOUBLE, typed

_SEARCH = (("indexName", "STRING"), ("numberOfNearestNeighbours", "INTEGER"), ("query", "ANY"))
#: Built-in procedures with the names and types of their inputs.
NAMES = {
    "db.labels": (), "db.relationshipTypes": (), "db.propertyKeys": (), "db.ping": (), "db.schema.visualization": (),
    "db.index.vector.queryNodes": _SEARCH, "db.index.vector.queryRelationships": _SEARCH,
}
_PYTHON = {"INTEGER": int, "FLOAT": (int, float), "NUMBER": (int, float), "STRING": str, "BOOLEAN": bool, "MAP": (dict, Row), "LIST": (list, tuple)}


@dataclass
class Procedure:
    """A user's function ``run(spark, *arguments) -> DataFrame``; ``inputs`` are pairs of a name and a type (``?`` behind it admits null), None leaves them open."""

    run: Callable
    inputs: tuple[tuple[str, str], ...] | None = None


def inputs_of(graph, name: str) -> tuple | None:
    """(name, type) of a procedure's inputs; None if they are open."""
    found = graph.procedures.get(name)
    if found is None and name not in NAMES:
        raise ProcedureError("ProcedureNotFound", name)
    return found.inputs if found else NAMES[name]


def coerced(name: str, kind: str, value):
    """A value as the input's type asks for it: whole numbers become floats, nothing else is converted."""
    kind, may_be_null = kind.rstrip("?"), kind.endswith("?") or kind == "ANY"
    if value is None:
        if not may_be_null:
            raise ProcedureError("InvalidArgumentType", f"{name} of type {kind} is null")
        return None
    want = _PYTHON.get(kind, object)
    if not isinstance(value, want) or (isinstance(value, bool) and kind in ("INTEGER", "FLOAT", "NUMBER")):
        raise ProcedureError("InvalidArgumentType", f"{name} must be of type {kind}")
    return float(value) if kind == "FLOAT" else value


def call(low, name: str, args: list, asts: list):
    """(rows, output name -> type) of a procedure."""
    graph, spark = low.graph, low.spark
    if name in graph.procedures:
        own = graph.procedures[name]
        values = list(spark.range(1).select(*[a.col.alias(f"x{k}") for k, a in enumerate(args)]).first()) if args else []
        if own.inputs is not None:
            values = [coerced(n, kind, v) for (n, kind), v in zip(own.inputs, values, strict=True)]
        df = own.run(spark, *values)
        return df, {f.name: f.dataType for f in df.schema}
    if name == "db.labels":
        found = sorted({x for t in graph.nodes for x in t.labels})
        return spark.createDataFrame([(x,) for x in found], "label string"), {"label": T.StringType()}
    if name == "db.relationshipTypes":
        return spark.createDataFrame([(x,) for x in sorted({t.type for t in graph.rels})], "relationshipType string"), {"relationshipType": T.StringType()}
    if name == "db.propertyKeys":
        found = sorted({c for t in [*graph.nodes, *graph.rels] for c in t.df.columns} - {"id", "start", "end"})
        return spark.createDataFrame([(x,) for x in found], "propertyKey string"), {"propertyKey": T.StringType()}
    if name == "db.ping":
        return spark.createDataFrame([(True,)], "success boolean"), {"success": T.BooleanType()}
    if name == "db.schema.visualization":
        rows = [(t.start_label, t.type, t.end_label) for t in graph.rels]
        df = spark.createDataFrame(rows, "source string, relationship string, target string")
        return df, {f.name: f.dataType for f in df.schema}
    if name.endswith("queryRelationships"):
        raise Unsupported("VectorIndex", "vector indexes on relationships")
    return nearest(low, args, asts)


def nearest(low, args: list, asts: list):
    """Exact nearest neighbours: a scored scan and a top-k, best first, ties by id."""
    value = lambda k: low.params[asts[k][1]] if asts[k][0] == "param" else asts[k][1]
    index = low.graph.catalog.get(value(0))
    if index is None or index["type"] != "VECTOR":
        raise ProcedureError("IndexNotFound", str(value(0)))
    df, b = low.scan_nodes(("name", index["label"]))
    col, kind = b.props[index["props"][0]]
    near = S.cosine if index.get("similarity", "cosine") == "cosine" else S.euclidean
    score = near(typed(F.col(col), kind), args[2])
    node = b.value()
    df = df.where(F.col(col).isNotNull()).select(node.col.alias("node"), score.col.alias("score"), F.col(b.id).alias("__id"))
    return df.orderBy(F.col("score").desc(), "__id").limit(int(value(1))), {"node": node.type, "score": DOUBLE}
