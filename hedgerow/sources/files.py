"""Files in and out: LOAD CSV rows, JSON and CSV graphs with their schema, Parquet snapshots."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, QueryTypeError
from ..graph import Graph, NodeTable, RelTable
from ..operators.checkpoints import cut


def load_csv(spark: SparkSession, url: str, headers: bool, sep: str = ",") -> tuple[DataFrame, T.DataType]:
    """Rows of a CSV file as ``row`` (a map by header, or a list), with the row's number and file; empty cells are null."""
    if "://" in url and not url.startswith(("file://", "hdfs://", "s3a://", "viewfs://")):
        raise QueryError("ExternalResource", f"{url} is not a file")
    root = os.environ.get("HEDGEROW_IMPORT_DIR")
    path = url.removeprefix("file://")
    if root and os.path.commonpath([os.path.realpath(root), os.path.realpath(os.path.join(root, path.lstrip("/")))]) != os.path.realpath(root):
        raise QueryError("ExternalResource", f"{url} is outside the import folder")
    df = spark.read.csv(url, sep=sep, header=headers, quote='"', escape='"', multiLine=True, nullValue="", emptyValue="")
    line = (F.monotonically_increasing_id() + (2 if headers else 1)).alias("__line")
    if headers:
        kind: T.DataType = T.StructType([T.StructField(c, T.StringType()) for c in df.columns])
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    else:
        kind = T.ArrayType(T.StringType())
        row = F.array(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), line, F.lit(url).alias("__file")), kind


def _sections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """(nodes, edges, schema statements) of a file with all three sections, or of a folder with lines of each."""
    if path.rstrip("/").endswith(".json"):
        raw = spark.read.json(path, multiLine=True)
        has = lambda n: n in raw.columns and isinstance(raw.schema[n].dataType, T.ArrayType) and isinstance(raw.schema[n].dataType.elementType, T.StructType)
        if not has("nodes"):
            raise QueryError("ImportError", "the file has no list of nodes")
        schema = [x for r in raw.select("schema").collect() for x in r[0] or ()] if "schema" in raw.columns else []  # statements, not nodes
        explode = lambda n: raw.select(F.explode(n).alias("x")).select("x.*")
        return explode("nodes"), explode("edges") if has("edges") else None, schema
    try:
        edges = spark.read.json(f"{path}/edges")
    except Exception as x:  # a graph without relationships has no such folder
        if "PATH_NOT_FOUND" not in str(x):
            raise
        edges = None
    return spark.read.json(f"{path}/nodes"), edges, [r[0] for r in spark.read.text(f"{path}/schema").collect() if r[0]]


def _props(df: DataFrame) -> list[str]:
    kind = df.schema["props"].dataType if "props" in df.columns else None
    return kind.names if isinstance(kind, T.StructType) else []


def import_json(spark: SparkSession, path: str) -> Graph:
    """A graph from ``{nodes: [{id, labels, props}], edges: [{type, startId, endId, props}], schema: [statements]}`` or from a folder of ``export_json``.

    Two nodes of one id, an edge to an unknown node and a schema that the graph breaks are errors.
    """
    from ..operators.writes import execute

    nodes, edges, schema = _sections(spark, path)
    graph = Graph(spark)
    if "id" not in nodes.columns:
        raise QueryError("ImportError", "nodes have no id")
    nodes = nodes if "labels" in nodes.columns else nodes.withColumn("labels", F.lit(None).cast("array<string>"))
    nodes = nodes.withColumns({"id": F.col("id").cast("string"), "labels": F.array_sort(F.coalesce(F.col("labels").cast("array<string>"), F.array().cast("array<string>")))})
    if nodes.where("id IS NULL").limit(1).count() or nodes.groupBy("id").count().where("count > 1").limit(1).count():
        raise QueryError("ImportError", "node ids must be there and differ")
    sets = [tuple(r[0]) for r in nodes.select("labels").distinct().collect()]  # label sets, not nodes
    known = None
    for labels in sets:
        name = labels[0] if labels else ""
        part = nodes.where(F.col("labels") == F.array(*[F.lit(x) for x in labels]).cast("array<string>"))
        df = part.select(graph.node_id(name, _key(F.col("id"))).alias("id"), F.col("id").alias("__source"), *[F.col("props").getField(p).alias(p) for p in _props(nodes)])
        ids = df.select("__source", "id")
        known = ids if known is None else known.unionAll(ids)
        graph.nodes.append(NodeTable(frozenset(labels), df.drop("__source")))
    if known is not None:
        _no_clash(known.select("id"))
    if edges is not None and known is not None:
        edges = edges.withColumns({"startId": F.col("startId").cast("string"), "endId": F.col("endId").cast("string")})
        for side in ("startId", "endId"):
            if edges.join(known, F.col(side) == F.col("__source"), "left_anti").limit(1).count():
                raise QueryError("ImportError", f"an edge's {side} is not a node of the file")
        start, end = known.toDF("__a", "start"), known.toDF("__b", "end")
        joined = edges.join(start, F.col("startId") == F.col("__a")).join(end, F.col("endId") == F.col("__b"))
        for (kind,) in edges.select("type").distinct().collect():  # types, not edges
            own = joined.where(F.col("type") == kind).select((F.lit(graph.code("[" + kind) << 48).bitwiseOR(F.monotonically_increasing_id())).alias("id"), "start", "end", *[F.col("props").getField(p).alias(p) for p in _props(edges)])
            graph.rels.append(RelTable(kind, cut(own)))  # numbers that a second run could deal out anew are kept
    for statement in schema:
        graph = execute(graph, statement)[0]
    return graph


def _key(c):
    """A key below 2^47 of a text: a whole number for itself, else from a hash; ``_no_clash`` finds two texts with one key."""
    number = F.when(c.rlike(r"^(0|[1-9]\d{0,13})$"), c.try_cast("bigint"))
    return F.coalesce(F.when(number < 1 << 46, number), F.xxhash64(c).bitwiseAND(F.lit((1 << 46) - 1)).bitwiseOR(F.lit(1 << 46)))


def _no_clash(ids: DataFrame) -> None:
    if ids.groupBy("id").count().where("count > 1").limit(1).count():
        raise QueryError("ImportError", "two nodes get one key; give them numbers as ids")


_CSV_TYPES = {"string": "string", "int": "bigint", "integer": "bigint", "long": "bigint", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean"}


def _typed_columns(df: DataFrame, fixed: tuple[str, ...]) -> dict[str, tuple[str, str]]:
    cols = {c: (c.split(":")[0], _CSV_TYPES.get((c.split(":") + ["string"])[1].lower())) for c in df.columns if c not in fixed}
    if any(c not in df.columns for c in fixed) or None in [t for _, t in cols.values()]:
        raise QueryTypeError("ImportError", f"the header needs {', '.join(fixed)} and known types")
    return cols


def _cells(df: DataFrame, cols: dict) -> list:
    """Typed columns; a cell that isn't of its type is an error."""
    for c, (_, t) in cols.items():
        if t != "string" and df.where(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).limit(1).count():
            raise QueryTypeError("ImportError", f"a cell of {c} is not of its type")
    return [F.col(f"`{c}`").cast(t).alias(n) for c, (n, t) in cols.items()]


def import_csv_nodes(graph: Graph, path: str) -> Graph:
    """Nodes from CSV with the header ``:ID,:LABEL,name[:type],...``; labels of a cell are joined by commas. Ids must differ."""
    df = graph.spark.read.csv(path, header=True, quote='"', escape='"', nullValue="")
    cells = _cells(df, _typed_columns(df, (":ID", ":LABEL")))
    if df.where("`:ID` IS NULL").limit(1).count() or df.groupBy(":ID").count().where("count > 1").limit(1).count():
        raise QueryError("ImportError", "node ids must be there and differ")
    made = None
    for (cell,) in df.select(":LABEL").distinct().collect():  # label sets, not nodes
        labels = frozenset(x for x in (cell or "").split(",") if x)
        part = df.where(F.col(":LABEL").eqNullSafe(F.lit(cell))).select(graph.node_id(min(labels, default=""), _key(F.col(":ID"))).alias("id"), *cells)
        made = part.select("id") if made is None else made.unionAll(part.select("id"))
        graph.nodes.append(NodeTable(labels, part))
    if made is not None:
        _no_clash(made)
    return graph


def import_csv_edges(graph: Graph, path: str) -> Graph:
    """Relationships from CSV with the header ``:START_ID,:END_ID,:TYPE,name[:type],...``; ids are those of nodes of the graph."""
    df = graph.spark.read.csv(path, header=True, quote='"', escape='"', nullValue="")
    cells = _cells(df, _typed_columns(df, (":START_ID", ":END_ID", ":TYPE")))
    df = df.withColumns({"__a": F.col(":START_ID").try_cast("bigint"), "__b": F.col(":END_ID").try_cast("bigint")})
    if df.where("`:TYPE` IS NULL").limit(1).count():
        raise QueryError("ImportError", "an edge without a type")
    known = None
    for t in graph.nodes:
        known = t.df.select("id") if known is None else known.unionAll(t.df.select("id"))
    for side, name in (("__a", ":START_ID"), ("__b", ":END_ID")):
        lost = df if known is None else df.join(known, F.col(side) == F.col("id"), "left_anti")
        if lost.limit(1).count():
            raise QueryError("ImportError", f"an edge's {name} is not a node of the graph")
    for (kind,) in df.select(":TYPE").distinct().collect():  # types, not edges
        begin = graph.catalog.get(f"next [{kind}", {"at": 1 << 40})["at"]
        key = F.lit(graph.code("[" + kind) << 48).bitwiseOR(F.lit(begin) + F.monotonically_increasing_id())
        own = cut(df.where(F.col(":TYPE") == kind).select(key.alias("id"), F.col("__a").alias("start"), F.col("__b").alias("end"), *cells))
        at = own.agg(F.max("id")).first()[0] & (1 << 48) - 1
        graph.catalog[f"next [{kind}"] = {"at": at + 1, "what": "NEXT", "type": "", "entity": "", "label": "", "props": []}
        same = next((k for k, t in enumerate(graph.rels) if t.type == kind), None)
        if same is None:
            graph.rels.append(RelTable(kind, own))
        else:
            graph.rels[same] = RelTable(kind, graph.rels[same].df.unionByName(own, allowMissingColumns=True))
    return graph


def schema_statements(graph: Graph) -> list[str]:
    """The statements that make the graph's indexes and constraints again."""
    out = []
    for name, c in graph.catalog.items():
        if c["what"] not in ("INDEX", "CONSTRAINT"):
            continue
        of = f"(x:`{c['label']}`)" if c["entity"] == "node" else f"()-[x:`{c['label']}`]-()"
        props = ", ".join(f"x.`{p}`" for p in c["props"])
        if c["what"] == "INDEX":
            options = f" OPTIONS {{indexConfig: {{`vector.similarity_function`: '{c['similarity']}'}}}}" if "similarity" in c else ""
            out.append(f"CREATE {c['type'] + ' ' if c['type'] != 'RANGE' else ''}INDEX `{name}` IF NOT EXISTS FOR {of} ON ({props}){options}")
        elif c["type"] in ("UNIQUENESS", "EXISTENCE", "KEY"):
            rule = {"UNIQUENESS": "UNIQUE", "EXISTENCE": "NOT NULL", "KEY": "NODE KEY" if c["entity"] == "node" else "RELATIONSHIP KEY"}[c["type"]]
            out.append(f"CREATE CONSTRAINT `{name}` IF NOT EXISTS FOR {of} REQUIRE ({props}) IS {rule}")
    return out


def export_json(graph: Graph, path: str) -> None:
    """Nodes, edges and schema statements as lines below ``path``, each table written by its tasks."""
    for t in graph.nodes:
        props = [c for c in t.df.columns if c != "id"]
        t.df.select(F.col("id").cast("string").alias("id"), F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>").alias("labels"), F.struct(*[F.col(f"`{c}`") for c in props]).alias("props") if props else F.lit(None).cast("string").alias("props")).write.mode("append").json(f"{path}/nodes")
    for r in graph.rels:
        props = [c for c in r.df.columns if c not in ("id", "start", "end")]
        r.df.select(F.col("id").cast("string").alias("id"), F.lit(r.type).alias("type"), F.col("start").cast("string").alias("startId"), F.col("end").cast("string").alias("endId"), F.struct(*[F.col(f"`{c}`") for c in props]).alias("props") if props else F.lit(None).cast("string").alias("props")).write.mode("append").json(f"{path}/edges")
    graph.spark.createDataFrame([(x,) for x in schema_statements(graph)], "value string").coalesce(1).write.text(f"{path}/schema")


def export_csv(graph: Graph, path: str) -> None:
    """Nodes, then edges, as CSV files by label set and type."""
    name = lambda f: f.name + {"bigint": ":int", "int": ":int", "double": ":float", "boolean": ":bool"}.get(f.dataType.simpleString(), "")
    for t in graph.nodes:
        labels = sorted(t.labels)
        t.df.select(F.col("id").alias(":ID"), F.lit(",".join(labels)).alias(":LABEL"), *[F.col(f"`{f.name}`").cast("string").alias(name(f)) for f in t.df.schema if f.name != "id"]).write.csv(f"{path}/nodes/{'_'.join(labels)}", header=True)
    for r in graph.rels:
        r.df.select(F.col("start").alias(":START_ID"), F.col("end").alias(":END_ID"), F.lit(r.type).alias(":TYPE"), *[F.col(f"`{f.name}`").cast("string").alias(name(f)) for f in r.df.schema if f.name not in ("id", "start", "end")]).write.csv(f"{path}/edges/{r.type}", header=True)


def snapshot(graph: Graph, path: str) -> None:
    """The whole graph as Parquet below ``path``, with a table of its tables, its numbering and its catalog."""
    rows = []
    for k, t in enumerate(graph.nodes):
        t.df.write.parquet(f"{path}/nodes-{k}")
        rows.append(("nodes", k, json.dumps(sorted(t.labels))))
    for k, r in enumerate(graph.rels):
        r.df.write.parquet(f"{path}/rels-{k}")
        rows.append(("rels", k, json.dumps([r.type, r.start_label, r.end_label])))
    rows += [("codes", 0, json.dumps(graph.codes)), ("catalog", 0, json.dumps(graph.catalog))]
    graph.spark.createDataFrame(rows, "kind string, k int, what string").coalesce(1).write.parquet(f"{path}/tables")


def load_snapshot(spark: SparkSession, path: str) -> Graph:
    """The graph of ``snapshot``."""
    graph = Graph(spark)
    for kind, k, what in sorted(map(tuple, spark.read.parquet(f"{path}/tables").collect())):
        value = json.loads(what)
        if kind == "nodes":
            graph.nodes.append(NodeTable(frozenset(value), spark.read.parquet(f"{path}/nodes-{k}")))
        elif kind == "rels":
            graph.rels.append(RelTable(value[0], spark.read.parquet(f"{path}/rels-{k}"), *value[1:]))
        else:
            setattr(graph, kind, value)
    return graph
