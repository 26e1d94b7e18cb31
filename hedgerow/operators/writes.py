"""Updates as copy-on-write: every clause makes new tables of a candidate graph; commit swaps it in, an error leaves the old one.

Rows of a clause are applied as sets. CREATE numbers new entities after the largest id; MERGE looks up distinct keys once and creates those without a match, so
a later row sees what an earlier one made; of several SETs of one property in one clause one wins, which one being undefined.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConstraintError, QueryError, QuerySyntaxError, QueryTypeError, Unsupported
from ..functions.values import is_entity, is_list, is_map, is_node, is_null, lit, typed
from ..graph import Graph, NodeTable, RelTable
from ..plans.lower import Ent, Frame, Lowering, Val, counted, fresh
from ..plans.parser import UPDATES, NodePattern, Part, RelPattern, parse
from .checkpoints import cut

COUNTERS = ("nodes_created", "nodes_deleted", "relationships_created", "relationships_deleted", "properties_set", "labels_added", "labels_removed")
_NEXT = 1 << 40  # created entities are numbered from here, above the keys of tables


class Writer(Lowering):
    """Plans queries that may update; ``graph`` is a copy that the caller keeps or drops."""

    def __init__(self, graph: Graph, params: dict | None = None):
        super().__init__(graph.copy(), params)
        self.counters = dict.fromkeys(COUNTERS, 0)
        self.gone: list[DataFrame] = []  # ids of nodes deleted without DETACH; the statement's end must leave them unconnected

    def count(self, what: str, df: DataFrame) -> None:
        self.counters[what] += df.count()

    def fixed(self, frame: Frame) -> Frame:
        """The rows as they are before the clause changes what they were read from."""
        return replace(frame, df=cut(frame.df if frame.df is not None else self.unit()))

    def new_ids(self, df: DataFrame, code: str, name: str) -> DataFrame:
        """Number the rows: partition offsets from counts, then places within the partition; no rows in one task."""
        key = f"next {code}"
        begin = self.graph.catalog.get(key, {"at": _NEXT})["at"]
        df = cut(df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
        sizes = df.groupBy("__p").count()
        total = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        bases = sizes.select("__p", F.coalesce(F.sum("count").over(total), F.lit(0)).alias("__base"))  # a row for each partition
        place = F.row_number().over(Window.partitionBy("__p").orderBy("__m")) - 1
        out = df.withColumn("__k", place).join(F.broadcast(bases), "__p")
        out = out.withColumn(name, F.lit(self.graph.code(code) << 48).bitwiseOR(F.lit(begin) + F.col("__base") + F.col("__k"))).drop("__p", "__m", "__k", "__base")
        self.graph.catalog[key] = {"at": begin + df.count(), "what": "NEXT", "type": "", "entity": "", "label": "", "props": []}
        return cut(out)

    def stored(self, frame: Frame, props) -> dict:
        out = {}
        for k, e in props[1] if props and props[0] == "map" else self.params.get(props[1], {}).items() if props else ():
            v = self.compile(e, frame.env) if isinstance(e, tuple) else lit(e)
            if is_map(v.type) or is_entity(v.type) or (is_list(v.type) and is_list(v.type.elementType)):
                raise QueryTypeError("InvalidPropertyType", k)
            if not is_null(v.type):
                out[k] = v
        return out

    def labels_of(self, expr) -> list[str]:
        if expr is None:
            return []
        expr = self.static(expr)
        if expr[0] == "name":
            return [expr[1]]
        if expr[0] == "and":
            return self.labels_of(expr[1]) + self.labels_of(expr[2])
        raise QuerySyntaxError("InvalidSyntax", "labels to add are plain names")

    # -- CREATE and MERGE
    def do_create(self, frame: Frame, parts: list[Part]) -> Frame:
        if any(isinstance(x, RelPattern) and x.direction == "-" for part in parts for x in part.items):
            raise QuerySyntaxError("RequiresDirectedRelationship", "a relationship to create has a direction")
        frame = self.fixed(frame)
        for part in parts:
            frame = self.create_part(frame, part)
        return frame

    def do_subquery(self, frame: Frame, query, scope, optional) -> Frame:
        """A body that updates runs for every outer row, equal ones too: rows are numbered, and the number is read by the body."""
        if not any(c.kind in UPDATES or c.kind == "subquery" for b in query.branches for c in b):
            return super().do_subquery(frame, query, scope, optional)
        frame, number = self.fixed(frame), fresh()
        numbered = replace(frame, df=cut(frame.df.withColumn(number, F.monotonically_increasing_id())), carry=[*frame.carry, number])
        return replace(super().do_subquery(numbered, query, scope, optional), carry=frame.carry)

    def declared(self, frame: Frame, part: Part) -> None:
        """A bound variable may only stand in a pattern to create as a bare node at the end of a relationship."""
        if part.var and part.var in frame.env:
            raise QuerySyntaxError("VariableAlreadyBound", part.var)
        for n in part.items[::2]:
            if n.var in frame.env:
                b = frame.env[n.var]
                if b.kind != "node" if isinstance(b, Ent) else not (is_null(b.type) or is_node(b.type)):
                    raise QuerySyntaxError("VariableTypeConflict", n.var)
                if n.labels or n.props or len(part.items) == 1:
                    raise QuerySyntaxError("VariableAlreadyBound", n.var)
        for r in part.items[1::2]:
            if r.var in frame.env:
                raise QuerySyntaxError("VariableAlreadyBound", r.var)

    def create_part(self, frame: Frame, part: Part) -> Frame:
        self.declared(frame, part)
        ids = []
        for n in part.items[::2]:
            if n.var in frame.env:
                if n.labels or n.props:
                    raise QuerySyntaxError("VariableAlreadyBound", n.var)
                b = frame.env[n.var]
                col = b.id if isinstance(b, Ent) else fresh()
                if isinstance(b, Val):
                    frame = replace(frame, df=frame.df.withColumn(col, F.col(b.col).getField("id")))
                ids.append(col)
            else:
                frame, col = self.create_node(frame, n)
                ids.append(col)
        for r, a, b in zip(part.items[1::2], ids, ids[1:], strict=False):
            frame = self.create_rel(frame, r, a, b)
        return frame

    def create_node(self, frame: Frame, n: NodePattern) -> tuple[Frame, str]:
        labels, col = self.labels_of(n.labels), fresh()
        frame = replace(frame, df=self.new_ids(frame.df, min(labels, default=""), col))
        props = self.stored(frame, n.props)
        made = cut(frame.df.select(F.col(col).alias("id"), *[v.col.alias(k) for k, v in props.items()]))
        self.count("nodes_created", made)
        self.counters["properties_set"] += sum(made.agg(*[F.count(F.col(f"`{k}`")).alias(k) for k in props]).first()) if props else 0
        self.counters["labels_added"] += len(labels) * made.count()
        self.add_nodes(frozenset(labels), made)
        cols = {k: (fresh(), v.type) for k, v in props.items()}
        ent = Ent("node", col, {"labels": fresh()}, cols)
        df = frame.df.select("*", F.array(*[F.lit(x) for x in sorted(labels)]).cast("array<string>").alias(ent.fixed["labels"]), *[props[k].col.alias(c) for k, (c, _) in cols.items()])
        return self.bind(replace(frame, df=df), n.var, ent), col

    def add_nodes(self, labels: frozenset, df: DataFrame) -> None:
        for k, t in enumerate(self.graph.nodes):
            if t.labels == labels:
                self.graph.nodes[k] = NodeTable(labels, t.df.unionByName(df, allowMissingColumns=True))
                return
        self.graph.nodes.append(NodeTable(labels, df))

    def create_rel(self, frame: Frame, r: RelPattern, a: str, b: str) -> Frame:
        if r.many:
            raise QuerySyntaxError("CreatingVarLength", "a variable-length relationship")
        if r.types is None or r.types[0] not in ("name", "dynamic"):
            raise QuerySyntaxError("NoSingleRelationshipType", "a relationship to create has one type")
        kind, col = self.labels_of(r.types)[0], fresh()
        if r.direction == "<":
            a, b = b, a
        frame = replace(frame, df=self.new_ids(frame.df, "[" + kind, col))
        props = self.stored(frame, r.props)
        made = cut(frame.df.select(F.col(col).alias("id"), F.col(a).alias("start"), F.col(b).alias("end"), *[v.col.alias(k) for k, v in props.items()]))
        self.count("relationships_created", made)
        self.counters["properties_set"] += sum(made.agg(*[F.count(F.col(f"`{k}`")).alias(k) for k in props]).first()) if props else 0
        for k, t in enumerate(self.graph.rels):
            if t.type == kind:
                self.graph.rels[k] = RelTable(kind, t.df.unionByName(made, allowMissingColumns=True))
                break
        else:
            self.graph.rels.append(RelTable(kind, made))
        cols = {k: (fresh(), v.type) for k, v in props.items()}
        ent = Ent("rel", col, {"type": fresh(), "start": fresh(), "end": fresh()}, cols)
        df = frame.df.select("*", F.lit(kind).alias(ent.fixed["type"]), F.col(a).alias(ent.fixed["start"]), F.col(b).alias(ent.fixed["end"]), *[props[k].col.alias(c) for k, (c, _) in cols.items()])
        return self.bind(replace(frame, df=df), r.var, ent)

    def do_merge(self, frame: Frame, part: Part, on: dict) -> Frame:
        self.declared(frame, part)
        frame, shown = self.fixed(frame), frame.env
        frame, part = self.with_values(frame, part)
        for x in part.items:
            for k, e in x.props[1] if x.props else ():
                if frame.df.where(self.compile(e, frame.env).col.isNull()).limit(1).count():
                    raise QueryError("MergeReadOwnWrites", f"a null value for {k}")
        sub, cols = self.keyed(replace(frame, carry=[]), part)  # rows with equal values share what is created
        keys = sub.df if sub.df is not None else None
        if cols:
            keys = cut(keys)
            sub = replace(sub, df=keys)
        found = self.match(sub, [part])
        found = replace(found, df=cut(found.df))
        absent = keys.join(found.df.select(*cols).distinct(), cols, "left_anti") if cols else (self.unit() if found.df.limit(1).count() == 0 else None)
        made = None
        if absent is not None and absent.limit(1).count():
            # one of each distinct set of values is created, so rows with equal keys share it
            made = self.create_part(Frame(cut(absent), sub.env, sub.carry), part)
            if on["CREATE"]:
                self.do_set(made, on["CREATE"])
        if on["MATCH"] and found.df.limit(1).count():
            self.do_set(found, on["MATCH"])
        again = self.match(replace(sub, df=keys) if cols else Frame(None), [part])
        new = {n: b for n, b in again.env.items() if n not in frame.env}
        keep = list(dict.fromkeys(c for b in new.values() for c in b.columns()))
        return replace(frame, df=cut(self.join_back(frame.df, again.df.select(*cols, *keep), cols, "inner")), env=shown | new)

    def with_values(self, frame: Frame, part: Part) -> tuple[Frame, Part]:
        """The pattern with the values of its properties in columns, so that rows are told apart by these and not by what they were read from."""
        items = []
        for x in part.items:
            if x.props and x.props[0] == "map":
                pairs = []
                for k, e in x.props[1]:
                    if e[0] not in ("lit", "param"):
                        frame, (e,) = self.hoist(frame, [e])
                        v, name, col = self.compile(e, frame.env), f" {fresh()}", fresh()
                        frame = replace(frame, df=frame.df.withColumn(col, v.col), env=frame.env | {name: Val(col, v.type)})
                        e = ("var", name)
                    pairs.append((k, e))
                x = replace(x, props=("map", tuple(pairs)))
            items.append(x)
        return frame, replace(part, items=items)

    # -- SET, REMOVE, DELETE
    def do_set(self, frame: Frame, items: list) -> Frame:
        frame = self.fixed(frame)
        for item in items:
            if item[0] == "labels":
                self.relabel(frame, item[1], self.labels_of(item[2]), True)
                continue
            _, target, e = item
            if target[0] in ("prop", "index"):
                name = target[2] if target[0] == "prop" else (self.params[target[2][1]] if target[2][0] == "param" else target[2][1])
                self.change(frame, target[1], {name: self.compile(e, frame.env)}, False)
            else:
                v = self.compile(e, frame.env)
                source = v.type["properties"].dataType if is_entity(v.type) else v.type
                base = (lambda c: c.getField("properties")) if is_entity(v.type) else (lambda c: c)
                values = {f.name: typed(base(v.col).getField(f.name), f.dataType) for f in source}
                self.change(frame, target, values, item[0] == "assign")
        return self.refreshed(frame)

    def do_remove(self, frame: Frame, items: list) -> Frame:
        frame = self.fixed(frame)
        for item in items:
            if item[0] == "labels":
                self.relabel(frame, item[1], self.labels_of(item[2]), False)
            else:
                name = item[2] if item[0] == "prop" else (self.params[item[2][1]] if item[2][0] == "param" else item[2][1])
                self.change(frame, item[1], {name: lit(None)}, False)
        return self.refreshed(frame)

    def target(self, frame: Frame, e):
        b = frame.env.get(e[1]) if e[0] == "var" else None
        if b is None:
            raise Unsupported("SetTarget", "SET takes variables")
        kind = b.kind if isinstance(b, Ent) else "node" if b.type.names[1] == "labels" else "rel"
        return kind, F.col(b.id) if isinstance(b, Ent) else F.col(b.col).getField("id")

    def change(self, frame: Frame, e, values: dict, whole: bool) -> None:
        """Set properties of the entities that ``e`` names; ``whole`` clears their other properties."""
        kind, key = self.target(frame, e)
        cols = {k: (F.lit(None) if is_null(v.type) else v.col) for k, v in values.items()}
        delta = frame.df.where(key.isNotNull()).select(key.alias("__id"), *[c.alias(f"__v{i}") for i, c in enumerate(cols.values())])
        delta = cut(delta.groupBy("__id").agg(*[F.last(f"__v{i}").alias(f"__v{i}") for i in range(len(cols))]) if cols else delta.distinct())
        self.counters["properties_set"] += delta.count() * len(cols)
        tables = self.graph.nodes if kind == "node" else self.graph.rels
        fixed = {"id"} if kind == "node" else {"id", "start", "end"}
        for k, t in enumerate(tables):
            if t.df.join(delta, F.col("id") == F.col("__id"), "left_semi").limit(1).count() == 0:
                continue
            joined = t.df.join(delta, F.col("id") == F.col("__id"), "left")
            hit, out = F.col("__id").isNotNull(), []
            for c in t.df.columns:
                old = F.col(f"`{c}`")
                if c in fixed:
                    out.append(old)
                elif c in cols:
                    kind_of = values[c].type if not is_null(values[c].type) else t.df.schema[c].dataType
                    same = kind_of == t.df.schema[c].dataType
                    new = F.col(f"__v{list(cols).index(c)}")
                    out.append(F.when(hit, new.cast(t.df.schema[c].dataType) if same or isinstance(kind_of, T.IntegralType) else new).otherwise(old if same or isinstance(kind_of, T.IntegralType) else old.cast(kind_of)).alias(c))
                else:
                    out.append(F.when(~hit, old).alias(c) if whole else old)
            out += [F.col(f"__v{i}").alias(c) for i, c in enumerate(cols) if c not in t.df.columns and not is_null(values[c].type)]
            tables[k] = replace(t, df=cut(joined.select(*out)))

    def relabel(self, frame: Frame, e, labels: list[str], add: bool) -> None:
        _, key = self.target(frame, e)
        ids = cut(frame.df.where(key.isNotNull()).select(key.alias("__id")).distinct())
        if not add:  # a relationship's ends may now lack the label that its table implied
            known = lambda x: None if x in labels else x
            self.graph.rels = [replace(t, start_label=known(t.start_label), end_label=known(t.end_label)) for t in self.graph.rels]
        for t in list(self.graph.nodes):
            to = t.labels | set(labels) if add else t.labels - set(labels)
            if to == t.labels:
                continue
            moved = cut(t.df.join(ids, F.col("id") == F.col("__id"), "left_semi"))
            n = moved.count()
            if n:
                self.counters["labels_added" if add else "labels_removed"] += n * len(to ^ t.labels)
                self.graph.nodes[self.graph.nodes.index(t)] = NodeTable(t.labels, cut(t.df.join(ids, F.col("id") == F.col("__id"), "left_anti")))
                self.add_nodes(to, moved)

    def refreshed(self, frame: Frame) -> Frame:
        """Bind entities again, so that later clauses see the new values."""
        for n, b in list(frame.env.items()):
            if isinstance(b, Ent):
                df, new = self.scan_nodes(None) if b.kind == "node" else self.scan_rels(None)[:2]
                frame = replace(frame, df=frame.df.join(df, F.col(b.id) == F.col(new.id), "left"), env=frame.env | {n: new})
        return replace(frame, df=cut(frame.df))

    def do_delete(self, frame: Frame, detach: bool, items: list) -> Frame:
        frame = self.fixed(frame)
        nodes, rels = [], []
        for e in items:
            if e[0] == "haslabel":
                raise QuerySyntaxError("InvalidDelete", "labels can't be deleted")
            v = self.compile(e, frame.env)
            if is_null(v.type):
                continue
            if not is_entity(v.type):
                raise QuerySyntaxError("InvalidArgumentType", "DELETE takes nodes, relationships and paths")
            if v.type.names[0] == "nodes":
                nodes.append(frame.df.select(F.explode(F.transform(v.col.getField("nodes"), lambda x: x.getField("id"))).alias("__id")))
                rels.append(frame.df.select(F.explode(F.transform(v.col.getField("relationships"), lambda x: x.getField("id"))).alias("__id")))
            else:
                (nodes if v.type.names[1] == "labels" else rels).append(frame.df.select(v.col.getField("id").alias("__id")).where("__id IS NOT NULL"))
        gone_nodes, gone_rels = (self.all_of(x) for x in (nodes, rels))
        if gone_rels is not None:
            self.drop_rels(gone_rels, "id")
        if gone_nodes is not None:
            for side in ("start", "end"):
                if detach:
                    self.drop_rels(gone_nodes, side)
            if not detach:
                self.gone.append(gone_nodes)
            for k, t in enumerate(self.graph.nodes):
                n = t.df.join(gone_nodes, F.col("id") == F.col("__id"), "left_semi").count()
                if n:
                    self.counters["nodes_deleted"] += n
                    self.graph.nodes[k] = replace(t, df=cut(t.df.join(gone_nodes, F.col("id") == F.col("__id"), "left_anti")))
        gone = {e[1] for e in items if e[0] == "var" and isinstance(frame.env.get(e[1]), Ent)}
        return replace(frame, env={n: replace(b, deleted=True) if n in gone else b for n, b in frame.env.items()})

    def all_of(self, frames: list[DataFrame]) -> DataFrame | None:
        out = None
        for f in frames:
            out = f if out is None else out.unionAll(f)
        return None if out is None else cut(out.distinct())

    def drop_rels(self, ids: DataFrame, side: str) -> None:
        for k, t in enumerate(self.graph.rels):
            n = t.df.join(ids, F.col(side) == F.col("__id"), "left_semi").count()
            if n:
                self.counters["relationships_deleted"] += n
                self.graph.rels[k] = replace(t, df=cut(t.df.join(ids, F.col(side) == F.col("__id"), "left_anti")))

    def do_foreach(self, frame: Frame, var: str, list: tuple, body: list) -> Frame:  # noqa: A002
        inner = self.do_unwind(self.fixed(frame), list, var)
        for c in body:
            if c.kind not in UPDATES:
                raise QuerySyntaxError("InvalidClauseComposition", "FOREACH takes updates")
            inner = getattr(self, f"do_{c.kind}")(inner, **c.data)
        return frame

    # -- schema
    def do_ddl(self, frame: Frame, action: str, what: str, type: str, name: str | None, lenient: bool, **d) -> Frame:  # noqa: A002
        catalog = self.graph.catalog
        if action == "drop":
            if name not in catalog and not lenient:
                raise QueryError("NotFound", f"no {what.lower()} {name}")
            catalog.pop(name, None)
            return Frame(None)
        name = name or f"{what.lower()}_{d['label']}_{'_'.join(d['props'])}"
        if name in catalog:
            if lenient:
                return Frame(None)
            raise QueryError("AlreadyExists", name)
        catalog[name] = {"what": what, "type": type, "entity": d["entity"], "label": d["label"], "props": d["props"], "of": d.get("of")}
        options = d.get("options")
        if type == "VECTOR" and options:
            config = dict(dict(options[1]).get("indexConfig", ("map", ()))[1])
            catalog[name]["similarity"] = config.get("vector.similarity_function", ("lit", "cosine"))[1].lower()
        return Frame(None)

    def check(self) -> None:
        """Hold the candidate graph against its constraints, and deleted nodes against the relationships that are left."""
        for ids in self.gone:
            if any(t.df.join(ids, F.col(side) == F.col("__id"), "left_semi").limit(1).count() for t in self.graph.rels for side in ("start", "end")):
                raise ConstraintError("DeleteConnectedNode", "a node to delete still has relationships")
        for name, c in self.graph.catalog.items():
            if c["what"] != "CONSTRAINT":
                continue
            df, b = self.scan_nodes(("name", c["label"])) if c["entity"] == "node" else self.scan_rels(("name", c["label"]))[:2]
            cols = [F.col(b.props[p][0]) if p in b.props else F.lit(None) for p in c["props"]]
            if c["type"] in ("EXISTENCE", "KEY"):
                missing = F.lit(False)
                for x in cols:
                    missing = missing | x.isNull()
                if df.where(missing).limit(1).count():
                    raise ConstraintError(name, "a property is missing")
            if c["type"] in ("UNIQUENESS", "KEY"):
                there = F.lit(True)
                for x in cols:
                    there = there & x.isNotNull()
                if df.where(there).groupBy(*cols).count().where("count > 1").limit(1).count():
                    raise ConstraintError(name, "two entities share a value")
            if c["type"] == "TYPE":
                for p in c["props"]:
                    if p in b.props and df.where(F.col(b.props[p][0]).isNotNull() & ~self.is_type(typed(F.col(b.props[p][0]), b.props[p][1]), c["of"]).col).limit(1).count():
                        raise ConstraintError(name, "a property has another type")


def changes(q) -> bool:
    """Whether a query holds an update or changes the schema."""
    return any(c.kind in UPDATES or c.kind == "ddl" or (c.kind == "subquery" and changes(c.data["query"])) or (c.kind == "when" and any(changes(x) for _, x in c.data["arms"])) for b in q.branches for c in b)


def explained(writer: Writer, q) -> DataFrame | None:
    """What the query would return, without rows; an update is not planned, since planning one carries it out."""
    last = q.branches[-1][-1]
    if last.kind not in ("return", "show", "procedure"):
        return None
    if changes(q):
        names = [n for _, n in last.data.get("items", [])]
        return writer.spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    frame = Lowering.query(writer, q, Frame(None))
    return frame.df.select(*[b.value().col.alias(n) for n, b in frame.env.items() if not n.startswith(" ")]).limit(0)


def execute(graph: Graph, text: str, params: dict | None = None) -> tuple[Graph, DataFrame | None, dict[str, int]]:
    """(graph after the statement, result if it returns one, counters); an error leaves ``graph`` as it was."""
    q = parse(text)
    writer = Writer(graph, params)
    last = q.branches[-1][-1].kind
    if q.explain == "EXPLAIN":
        return graph, explained(writer, q), dict.fromkeys(COUNTERS, 0)
    if not changes(q):
        writer.counted, writer.unread = counted(q)
    frame = writer.query(q, Frame(None))
    if changes(q):
        writer.check()
    if writer.strict and frame.env:
        frame = replace(frame, df=cut(frame.df))
    result = frame.df.select(*[b.value().col.alias(n) for n, b in frame.env.items() if not n.startswith(" ")]) if last in ("return", "show", "procedure") and frame.env else None
    return writer.graph, result, writer.counters
