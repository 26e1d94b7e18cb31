"""Syntax tree -> DataFrame plan.

A frame is a DataFrame with a scope: variables bound to columns. Entities that a pattern binds lie flat (id, labels, one column per property), so
Catalyst prunes and pushes down each property by itself; they become structs only where used as values. A subquery is planned once for the distinct outer
values that it uses and joined back, never run per row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EntityNotFound, ParameterMissing, ProcedureError, QueryArithmeticError, QuerySyntaxError, QueryTypeError, Unsupported, raised
from ..functions import scalar as S
from ..functions.values import BOOL, DOUBLE, LONG, STRING, Value, apply, cast, common, equal, is_entity, is_int, is_list, is_map, is_node, is_null, is_num, is_path, is_rel, lit, listed, never, ordered, struct_of, typed
from ..functions.values import field as get
from ..graph import Graph, _common, holds, union
from .parser import Clause, Group, NodePattern, Part, Query, RelPattern, parse

_serial = itertools.count()


def fresh() -> str:
    return f"c{next(_serial)}"


@dataclass
class Val:
    col: str
    type: T.DataType

    def columns(self):
        return [self.col]

    def value(self) -> Value:
        return typed(F.col(self.col), self.type)


@dataclass
class Ent:
    kind: str  # node or rel
    id: str
    fixed: dict[str, str]  # labels; or type, start, end
    props: dict[str, tuple[str, T.DataType]]
    deleted: bool = False  # by this statement
    squares: dict[str, str] = field(default_factory=dict)  # vector property -> column of its square

    def columns(self):
        return [self.id, *self.fixed.values(), *[c for c, _ in self.props.values()], *self.squares.values()]

    def value(self) -> Value:
        props = struct_of({n: typed(F.col(c), t) for n, (c, t) in self.props.items()})
        kinds = {"labels": T.ArrayType(STRING), "type": STRING, "start": LONG, "end": LONG}
        parts = {"id": typed(F.col(self.id), LONG), **{n: typed(F.col(c), kinds[n]) for n, c in self.fixed.items()}, "properties": props}
        whole = struct_of(parts)
        return apply(lambda w, i: F.when(i.isNotNull(), w), whole, parts["id"], kind=whole.type)


@dataclass
class Frame:
    df: DataFrame | None
    env: dict[str, Val | Ent] = field(default_factory=dict)
    carry: list[str] = field(default_factory=list)
    weight: str | None = None  # a column of how many equal rows a row stands for, see ``fold``
    order: str | None = None  # a column that ascends in the order that the last WITH gave the rows

    def columns(self):
        return list(dict.fromkeys([*self.carry, *[c for b in self.env.values() for c in b.columns()]]))


def children(ast):
    if isinstance(ast, tuple):
        for x in ast:
            if isinstance(x, (tuple, Query, Part)):
                yield x


SUBQUERIES = ("exists", "count", "collect", "pattern", "patcomp")


def is_subquery(ast) -> bool:
    return isinstance(ast, tuple) and len(ast) > 1 and ast[0] in SUBQUERIES and isinstance(ast[1], (Query, Part))


def uses(ast, found: dict[str, set]) -> dict[str, set]:
    """Variable -> properties read of it (None among them: used whole)."""
    if isinstance(ast, tuple):
        if len(ast) == 2 and ast[0] == "var" and isinstance(ast[1], str):
            found.setdefault(ast[1], set()).add(None)
        elif len(ast) == 3 and ast[0] == "prop" and isinstance(ast[1], tuple) and ast[1][:1] == ("var",):
            found.setdefault(ast[1][1], set()).add(ast[2])
        else:
            for x in ast:
                uses(x, found)
    elif isinstance(ast, (list, dict)):
        for x in ast.values() if isinstance(ast, dict) else ast:
            uses(x, found)
    elif isinstance(ast, Query):
        for b in ast.branches:
            for c in b:
                uses(c.data, found)
                if c.kind in ("with", "return") and c.data.get("star"):
                    found.setdefault("*", set())
    elif isinstance(ast, Part):
        for x in ast.items:
            uses(x, found)
    elif isinstance(ast, Group):
        uses(ast.part, found)
        uses(ast.where, found)
    elif isinstance(ast, Clause):
        uses(ast.data, found)
    elif isinstance(ast, (NodePattern, RelPattern)):
        if ast.var:
            found.setdefault(ast.var, set()).add("id")
        uses(ast.props, found)
        uses(ast.where, found)
    return found


def counted(ast) -> tuple[set[str], set[str]]:
    """(variables bound once of which a query asks at most how many they hold: size(), length(), count(); those that it doesn't read at all)."""
    bound: list[str] = []
    sized: set[str] = set()
    whole: set[str] = set()

    def walk(x):
        if isinstance(x, tuple):
            if x[:1] == ("call",) and x[1] in ("size", "length", "count") and len(x[2]) == 1 and x[2][0][:1] == ("var",) and not x[3]:
                sized.add(x[2][0][1])
            elif len(x) == 2 and x[0] == "var" and isinstance(x[1], str):
                whole.add(x[1])
            else:
                if is_subquery(x) and isinstance(x[1], Part):
                    whole.add(x[1].var)  # a path that is a value of its own
                for y in x:
                    walk(y)
        elif isinstance(x, (list, dict)):
            for y in x.values() if isinstance(x, dict) else x:
                if isinstance(y, str):
                    whole.add(y)
                walk(y)
        elif isinstance(x, (Query, Clause, Part, Group, NodePattern, RelPattern)):
            if isinstance(x, Clause) and x.kind in ("with", "return") and x.data.get("star"):
                whole.add("*")
            if not isinstance(x, (Query, Clause, Group)) and x.var:
                bound.append(x.var)
            for y in vars(x).values():
                walk(y)

    walk(ast)
    once = {n for n in bound if bound.count(n) == 1} - whole if "*" not in whole else set()
    return once, once - sized


def compared(ast) -> set[tuple[str, str]]:
    """(variable, property) of the vectors whose cosine a query asks for."""
    out: set = set()
    if isinstance(ast, tuple) and ast[:2] == ("call", "vector.similarity.cosine"):
        out |= {(e[1][1], e[2]) for e in ast[2] if e[:1] == ("prop",) and e[1][:1] == ("var",)}
    inner = ast.values() if isinstance(ast, dict) else ast if isinstance(ast, (tuple, list)) else vars(ast).values() if isinstance(ast, (Query, Clause, Part, Group, NodePattern, RelPattern)) else ()
    return out.union(*[compared(x) for x in inner])


def conjuncts(e):
    return [*conjuncts(e[1]), *conjuncts(e[2])] if e and e[0] == "and" else [e] if e else []


class Lowering:
    def __init__(self, graph: Graph, params: dict | None = None):
        self.graph, self.params, self.spark = graph, params or {}, graph.spark
        self.counters: dict[str, int] = {}
        self.counted: set[str] = set()  # variables of which only the number is asked, see ``counted``
        self.unread: set[str] = set()
        self.vectors: set[tuple[str, str]] = set()  # see ``compared``
        self.after: dict | None = None  # of the clause after a MATCH, if it only counts the rows
        self.strict = False  # the result has to be computed before the statement is known to succeed

    # -- expressions
    def compile(self, e: tuple, env: dict, local: dict | None = None) -> Value:
        local = local or {}
        go = lambda x: self.compile(x, env, local)
        match e:
            case ("lit", v):
                return lit(v)
            case ("param", n):
                if n not in self.params:
                    raise ParameterMissing("MissingParameter", n)
                return lit(self.params[n])
            case ("value", v):
                return v
            case ("var", n):
                if n in local:
                    return local[n]
                if n not in env:
                    raise QuerySyntaxError("UndefinedVariable", n)
                return env[n].value()
            case ("prop", ("var", n), p) if n not in local and isinstance(env.get(n), Ent):
                ent = env[n]
                if ent.deleted:
                    return self.lost(ent, ent.props[p][1] if p in ent.props else STRING)
                return typed(F.col(ent.props[p][0]), ent.props[p][1]) if p in ent.props else lit(None)
            case ("prop", x, p):
                return S.property_of(go(x), p)
            case ("index", x, i):
                v, k = go(x), go(i)
                if is_list(v.type):
                    return S.index(v, k)
                if is_null(v.type):
                    return lit(None)
                inner = get(v, "properties") if is_node(v.type) or is_rel(v.type) else v
                if i[0] in ("lit", "param"):
                    return S.property_of(v, i[1] if i[0] == "lit" else self.params[i[1]])
                names = inner.type.names
                kind = common([inner.type[n].dataType for n in names]) or STRING
                pick = lambda c, key: F.coalesce(*[F.when(key == n, c.getField(n).cast(kind)) for n in names], F.lit(None))
                return apply(pick, inner, k, kind=kind)
            case ("slice", x, a, b):
                return S.slice_(go(x), a and go(a), b and go(b))
            case ("neg", x):
                return apply(lambda c: -c, go(x))
            case ("pos", x):
                return go(x)
            case ("not", x):
                return apply(lambda c: ~c, self.boolean(go(x)), kind=BOOL)
            case ("and", a, b):
                return apply(lambda x, y: x & y, self.boolean(go(a)), self.boolean(go(b)), kind=BOOL)
            case ("or", a, b):
                return apply(lambda x, y: x | y, self.boolean(go(a)), self.boolean(go(b)), kind=BOOL)
            case ("xor", a, b):
                return apply(lambda x, y: x != y, self.boolean(go(a)), self.boolean(go(b)), kind=BOOL)
            case ("cmp", op, a, b):
                x, y = go(a), go(b)
                if op == "=":
                    return equal(x, y)
                if op == "<>":
                    return apply(lambda c: ~c, equal(x, y), kind=BOOL)
                return ordered(op, x, y)
            case ("+", a, b):
                return S.add(go(a), go(b))
            case ("||", a, b):
                x, y = go(a), go(b)
                return S.add(x, y) if is_list(x.type) else S.add(S.text_of(x), S.text_of(y))
            case ("-", a, b):
                return S.subtract(go(a), go(b))
            case ("*", a, b):
                return S.multiply(go(a), go(b))
            case ("/", a, b):
                return S.divide(go(a), go(b))
            case ("%", a, b):
                return S.modulo(go(a), go(b))
            case ("^", a, b):
                return S.power(go(a), go(b))
            case ("starts" | "ends" | "contains" as op, a, b):
                x, y = go(a), go(b)
                if not all(isinstance(v.type, T.StringType) for v in (x, y)):
                    return Value(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), BOOL)
                f = {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op]
                return apply(lambda p, q: f(p, q), x, y, kind=BOOL)
            case ("regex", a, b):
                x, y = go(a), go(b)
                if not all(isinstance(v.type, T.StringType) or is_null(v.type) for v in (x, y)):
                    raise QueryTypeError("InvalidArgumentType", "=~ needs strings")
                return apply(lambda p, q: F.regexp_like(p, F.concat(F.lit("^(?:"), q, F.lit(")$"))), S.text_of(x), S.text_of(y), kind=BOOL)
            case ("in", a, b):
                x, y = go(a), go(b)
                if is_null(y.type):
                    return Value(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), BOOL)
                if not is_list(y.type):
                    raise QueryTypeError("InvalidArgumentType", "IN needs a list")
                kind = STRING if is_null(y.type.elementType) else y.type.elementType
                test = lambda c, xs: F.exists(xs, lambda m: equal(Value(c, x.ghost, x.type), Value(m, F.lit(None).cast(kind), kind)).col)
                return apply(lambda c, xs: F.when(F.size(xs) == 0, F.lit(False)).otherwise(test(c, xs)), x, y, kind=BOOL)
            case ("isnull", x):
                if x[0] == "var" and isinstance(env.get(x[1]), Ent) and x[1] not in local:
                    return typed(F.col(env[x[1]].id).isNull(), BOOL)
                return apply(lambda c: c.isNull(), go(x), kind=BOOL)
            case ("istype", x, kinds):
                return self.is_type(go(x), kinds)
            case ("normalized", x, form):
                v = go(x)
                return equal(v, S.normalize(v, lit(form)))
            case ("haslabel", x, labels):
                v = go(x)
                if is_rel(v.type):
                    return self.label_test(apply(lambda c: F.array(c), get(v, "type"), kind=T.ArrayType(STRING)), labels, env)
                return self.label_test(get(v, "labels"), labels, env)
            case ("list", items):
                return listed([go(x) for x in items])
            case ("map", items):
                return struct_of({k: go(x) for k, x in items})
            case ("mapproj", x, items):
                return self.map_projection(go(x), items, env, local)
            case ("case", subject, arms, other):
                s = subject and go(subject)
                tests = [self.boolean(equal(s, go(c)) if s else go(c)) for c, _ in arms]
                values = [go(v) for _, v in arms] + [go(other)]
                kind = common([v.type for v in values]) or STRING
                values = [cast(v, kind) for v in values]

                def choose(*c):
                    out = F.when(c[0], c[len(tests)])
                    for k in range(1, len(tests)):
                        out = out.when(c[k], c[len(tests) + k])
                    return out.otherwise(c[-1])

                return apply(choose, *tests, *values, kind=kind)
            case ("comp", v, source, where, out):
                xs = go(source)
                if where is not None:
                    xs = self.over(xs, lambda x: self.boolean(self.compile(where, env, local | {v: x})), F.filter, xs.type)
                return self.over(xs, lambda x: self.compile(out, env, local | {v: x}), F.transform) if out is not None else xs
            case ("quant", kind, v, source, test):
                xs = go(source)
                if is_null(xs.type):
                    return Value(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), BOOL)
                body = lambda x: self.boolean(self.compile(test, env, local | {v: x}))
                if kind == "all":
                    return self.over(xs, body, F.forall, BOOL)
                if kind in ("any", "none"):
                    some = self.over(xs, body, F.exists, BOOL)
                    return some if kind == "any" else apply(lambda c: ~c, some, kind=BOOL)
                flags = self.over(xs, body, F.transform, T.ArrayType(BOOL))
                n = lambda c, want: F.size(F.filter(c, want))
                return apply(lambda c: F.when(n(c, lambda x: x) > 1, F.lit(False)).when(n(c, lambda x: x.isNull()) > 0, F.lit(None)).otherwise(n(c, lambda x: x) == 1), flags, kind=BOOL)
            case ("reduce", acc, init, v, source, body):
                xs, start = go(source), go(init)
                element = STRING if is_null(xs.type.elementType) else xs.type.elementType
                ghost = lambda t: Value(F.lit(None).cast(t), F.lit(None).cast(t), t)
                kind = start.type
                for _ in range(2):
                    kind = common([kind, self.compile(body, env, local | {acc: ghost(kind), v: ghost(element)}).type]) or STRING
                step = lambda a, x: cast(self.compile(body, env, local | {acc: Value(a, F.lit(None).cast(kind), kind), v: Value(x, F.lit(None).cast(element), element)}), kind).col
                return Value(F.aggregate(xs.col, cast(start, kind).col, step), F.lit(None).cast(kind), kind)
            case ("call", name, args, distinct):
                if name in S.AGGREGATES:
                    raise QuerySyntaxError("InvalidAggregation", name)
                return self.function(name, args, env, local)
            case _ if is_subquery(e):
                raise Unsupported("NestedSubquery", "a subquery in this place")
        raise QuerySyntaxError("InvalidSyntax", str(e)[:80])

    def boolean(self, v: Value) -> Value:
        if is_null(v.type):
            return cast(v, BOOL)
        if is_list(v.type):
            return apply(lambda c: F.size(c) > 0, v, kind=BOOL)
        if not isinstance(v.type, T.BooleanType):
            raise QueryTypeError("InvalidArgumentType", f"a boolean is needed, not {v.type.simpleString()}")
        return v

    def over(self, xs: Value, body, f, kind: T.DataType | None = None) -> Value:
        """A higher-order function over a list."""
        if is_null(xs.type):
            return xs
        if not is_list(xs.type):
            raise QueryTypeError("InvalidArgumentType", "a list is needed")
        element = STRING if is_null(xs.type.elementType) else xs.type.elementType
        if kind is None:
            kind = T.ArrayType(body(Value(F.lit(None).cast(element), F.lit(None).cast(element), element)).type)
            inner = kind.elementType
            kind = T.ArrayType(STRING) if is_null(inner) else kind
        run = lambda c: f(c, lambda x: body(Value(x, F.lit(None).cast(element), element)).col)
        return Value(run(xs.col), F.lit(None).cast(kind), kind)

    def function(self, name: str, args, env, local) -> Value:
        values = [self.compile(a, env, local) for a in args]
        if name in ("labels", "keys", "properties") and args[0][0] == "var" and args[0][1] not in local and getattr(env.get(args[0][1]), "deleted", False):
            return self.lost(env[args[0][1]], T.ArrayType(STRING))
        if name == "exists":
            return apply(lambda c: c.isNotNull(), values[0], kind=BOOL)
        if name in ("startnode", "endnode"):
            return self.endpoint(args[0], name[:-4], env)
        if name == "vector":
            kind = T.ArrayType(DOUBLE if args[2][1].upper().startswith("FLOAT") else LONG)
            v = values[0]
            return cast(apply(lambda c: F.from_json(c, "array<double>"), v, kind=T.ArrayType(DOUBLE)), kind) if isinstance(v.type, T.StringType) else cast(v, kind)
        if name in ("vector_distance", "vector_norm"):
            how = args[-1][1]
            if name == "vector_distance":
                return S.vector_distance(values[0], values[1], how)
            zero = apply(lambda c: F.transform(c, lambda x: F.lit(0.0)), values[0], kind=T.ArrayType(DOUBLE))
            return S.vector_distance(values[0], zero, how)
        if name == "linenumber":
            return typed(F.col("__line"), LONG)
        if name == "file":
            return typed(F.col("__file"), STRING)
        f = S.FUNCTIONS.get(name)
        if f is None:
            raise QuerySyntaxError("UnknownFunction", name)
        if values and is_null(values[0].type) and name not in ("coalesce", "isempty", "valuetype", "nullif"):
            return lit(None)
        if name == "vector.similarity.cosine" and len(args) == 2:
            own = [env.get(e[1][1]) if e[:1] == ("prop",) and e[1][:1] == ("var",) and e[1][1] not in local else None for e in args]
            if all(isinstance(x, Ent) and not x.deleted and e[2] in x.squares for x, e in zip(own, args, strict=True)):
                values = [*values, *[typed(F.col(x.squares[e[2]]), DOUBLE) for x, e in zip(own, args, strict=True)]]
        try:
            return f(*values)
        except TypeError as x:
            raise QuerySyntaxError("InvalidNumberOfArguments", name) from x

    def lost(self, ent: Ent, kind: T.DataType) -> Value:
        """What is asked of an entity that this statement has deleted: an error for every row that has one."""
        self.strict = True
        error = raised(EntityNotFound, "DeletedEntityAccess", "the entity has been deleted in this statement").cast(kind)
        return typed(F.when(F.col(ent.id).isNotNull(), error), kind)

    def endpoint(self, arg, side: str, env) -> Value:
        """The node at one end of a relationship, as ``hoist`` has joined it."""
        v = self.compile(arg, env)
        if is_null(v.type):
            return lit(None)
        raise Unsupported("NestedEndpoint", f"{side}Node() inside a list expression") if is_rel(v.type) else QueryTypeError("InvalidArgumentType", f"{side}Node() takes a relationship")

    def is_type(self, v: Value, kinds) -> Value:
        def one(name, inner):
            t = v.type
            groups = {
                "BOOLEAN": isinstance(t, T.BooleanType), "BOOL": isinstance(t, T.BooleanType), "INTEGER": is_int(t), "INT": is_int(t), "INT64": is_int(t), "SIGNED INTEGER": is_int(t), "INT32": isinstance(t, T.IntegerType), "FLOAT": is_num(t) and not is_int(t), "FLOAT64": is_num(t) and not is_int(t), "STRING": isinstance(t, T.StringType), "VARCHAR": isinstance(t, T.StringType),
                "DATE": isinstance(t, T.DateType), "ZONED DATETIME": isinstance(t, T.TimestampType), "LOCAL DATETIME": isinstance(t, T.TimestampNTZType), "POINT": t == S.POINT, "DURATION": t == S.DURATION, "NODE": is_node(t), "RELATIONSHIP": is_rel(t), "PATH": is_path(t), "MAP": is_map(t), "ANY": True, "PROPERTY VALUE": not is_entity(t) and not is_map(t), "NULL": is_null(t), "NOTHING": False,
            }
            if name in ("LIST", "ARRAY"):
                return is_list(t) and (inner is None or any(self.element_is(t.elementType, k) for k, _, _ in inner))
            if name not in groups:
                raise QuerySyntaxError("InvalidSyntax", f"no type {name}")
            return groups[name]

        fits, strict = any(one(n, i) for n, i, _ in kinds), all(s for _, _, s in kinds)
        return apply(lambda c: F.when(c.isNull(), F.lit(not strict)).otherwise(F.lit(fits)), v, kind=BOOL)

    def element_is(self, t, name) -> bool:
        return {"INTEGER": is_int(t), "INT": is_int(t), "FLOAT": is_num(t) and not is_int(t), "STRING": isinstance(t, T.StringType), "BOOLEAN": isinstance(t, T.BooleanType), "ANY": True}.get(name, False) or is_null(t)

    def label_test(self, labels: Value, expr, env) -> Value:
        def test(c, x):
            match x:
                case ("name", n):
                    return F.array_contains(c, n)
                case ("and", a, b):
                    return test(c, a) & test(c, b)
                case ("or", a, b):
                    return test(c, a) | test(c, b)
                case ("not", a):
                    return ~test(c, a)
                case ("any",):
                    return F.size(c) > 0
                case ("dynamic", d):
                    v = self.compile(d, env)
                    return F.forall(v.col, lambda n: F.array_contains(c, n)) if is_list(v.type) else F.array_contains(c, v.col)

        return Value(test(labels.col, expr), F.lit(None).cast("boolean"), BOOL)

    def map_projection(self, v: Value, items, env, local) -> Value:
        inner = get(v, "properties") if is_node(v.type) or is_rel(v.type) else v
        out: dict[str, Value] = {}
        for x in items:
            if x[0] == "all":
                out |= {n: get(inner, n) for n in inner.type.names}
            elif x[0] == "prop":
                out[x[1]] = S.property_of(v, x[1])
            else:
                out[x[1]] = self.compile(x[2], env, local)
        whole = struct_of(out)
        return apply(lambda w, c: F.when(c.isNotNull(), w), whole, v, kind=whole.type)

    # -- subqueries inside expressions
    def hoist(self, frame: Frame, asts: list) -> tuple[Frame, list]:
        """Plan the subqueries of expressions as joins; returns the expressions with their results in place."""

        def walk(e):
            nonlocal frame
            if is_subquery(e):
                frame, v = self.subquery_value(frame, e)
                return ("value", v)
            if isinstance(e, tuple) and e[:1] == ("call",) and e[1] in ("startnode", "endnode") and e[2] and frame.df is not None:
                (arg,) = (walk(x) for x in e[2])
                try:
                    r = self.compile(arg, frame.env)
                except QuerySyntaxError:  # a variable of a list expression, not of the row
                    return e
                if is_rel(r.type):
                    frame, v = self.joined_node(frame, get(r, "start" if e[1] == "startnode" else "end"))
                    return ("value", v)
                return e
            if isinstance(e, tuple):
                return tuple(walk(x) if isinstance(x, tuple) else x for x in e)
            return e

        out = [e if e is None else walk(e) for e in asts]
        return frame, out

    def joined_node(self, frame: Frame, i: Value) -> tuple[Frame, Value]:
        """The node of an id, by a join."""
        rows, b = self.scan_nodes(None)
        key, name, node = fresh(), fresh(), b.value()
        found = rows.select(F.col(b.id).alias(key), node.col.alias(name))
        return replace(frame, df=frame.df.join(found, i.col == F.col(key), "left").drop(key)), typed(F.col(name), node.type)

    def outer(self, frame: Frame, ast) -> tuple[list[str], dict]:
        """(columns of the outer row that the subquery reads, their scope)."""
        found = uses(ast, {})
        names = list(frame.env) if "*" in found else [n for n in found if n in frame.env]
        env, cols = {}, list(frame.carry)
        for n in names:
            b = frame.env[n]
            if isinstance(b, Ent) and None not in found.get(n, {None}):
                b = replace(b, props={p: c for p, c in b.props.items() if p in found[n]})
            env[n] = b
            cols += b.columns()
        return list(dict.fromkeys(cols)), env

    def keyed(self, frame: Frame, ast) -> tuple[Frame, list[str]]:
        """A frame of the distinct outer values that ``ast`` reads, under their own names."""
        cols, env = self.outer(frame, ast)
        if not cols:
            return Frame(None), []
        return Frame(frame.df.select(*cols).distinct(), env, cols), cols

    def join_back(self, df: DataFrame, sub: DataFrame, cols: list[str], how: str) -> DataFrame:
        if not cols:
            if how in ("left_semi", "left_anti"):
                return df.join(sub, F.lit(True), how)
            return df.join(sub, F.lit(True), "left" if how == "left" else "inner")
        names = {c: fresh() for c in cols}
        sub = sub.withColumnsRenamed(names)
        on = None
        for c, n in names.items():
            test = F.col(c).eqNullSafe(F.col(n))
            on = test if on is None else on & test
        return df.join(sub, on, how).drop(*names.values()) if how not in ("left_semi", "left_anti") else df.join(sub, on, how)

    def matches(self, e, sub: Frame) -> Frame:
        query = e[1]
        if isinstance(query, Part):
            return self.match(sub, [query], e[2] if e[0] == "patcomp" else None)
        return self.query(query, sub)

    def subquery_value(self, frame: Frame, e) -> tuple[Frame, Value]:
        if frame.df is None:
            frame = replace(frame, df=self.unit())
        sub, cols = self.keyed(frame, e)
        self.no_updates(e[1])
        kind = e[0]
        if kind == "pattern" and e[1].selector:
            return self.shortest_value(frame, e[1])
        found = self.matches(e, sub)
        name = fresh()
        if kind in ("exists", "pattern"):
            agg, default, t = F.lit(True), F.lit(False), BOOL
        elif kind == "count":
            agg, default, t = F.count(F.lit(1)), F.lit(0).cast("long"), LONG
        else:
            if kind == "patcomp":
                found, (out,) = self.hoist(found, [e[3]])
                v = self.compile(out, found.env)
            else:
                (b,) = found.env.values()
                v = b.value()
            t = T.ArrayType(STRING if is_null(v.type) else v.type)
            agg, default = F.collect_list(v.col), F.array().cast(t)
        if cols:
            rows = found.df.select(*cols).distinct().withColumn(name, agg) if t is BOOL else found.df.groupBy(*cols).agg(agg.alias(name))
        else:
            rows = found.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name)) if t is BOOL else found.df.agg(agg.alias(name))
        df = self.join_back(frame.df, rows, cols, "left")
        return replace(frame, df=df), typed(F.coalesce(F.col(name), default), t)

    def no_updates(self, q) -> None:
        from .parser import UPDATES

        if isinstance(q, Query) and any(c.kind in UPDATES for b in q.branches for c in b):
            raise QuerySyntaxError("InvalidClauseComposition", "an update inside a subquery expression")

    def filter(self, frame: Frame, where) -> Frame:
        """Keep rows where the predicate is true; EXISTS and its negation among the conjuncts become semi and anti joins."""
        if where is None:
            return frame
        plain = []
        for c in conjuncts(where):
            e, how = (c[1], "left_anti") if c[0] == "not" else (c, "left_semi")
            if is_subquery(e) and e[0] in ("exists", "pattern") and not (isinstance(e[1], Part) and e[1].selector) and frame.df is not None:
                self.no_updates(e[1])
                sub, cols = self.keyed(frame, e)
                if cols:
                    found = self.matches(e, sub)
                    frame = replace(frame, df=self.join_back(frame.df, found.df.select(*cols), cols, how))
                    continue
            plain.append(c)
        for c in plain:
            frame, (e,) = self.hoist(frame, [c])
            if frame.df is None:
                frame = replace(frame, df=self.unit())
            frame = replace(frame, df=frame.df.where(self.boolean(self.compile(e, frame.env)).col))
        return frame

    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias(fresh()))

    # -- patterns
    def scan_nodes(self, labels, only: set | None = None) -> tuple[DataFrame, Ent]:
        """All nodes that the label expression admits; ``only``: labels of which such a node has one, as the relationships at hand imply."""
        tables = [t for t in self.graph.nodes if holds(t.labels, self.static(labels)) and (only is None or t.labels & only)]
        types = _common([t.df.schema for t in tables], {"id"})
        ent = Ent("node", fresh(), {"labels": fresh()}, {n: (fresh(), t) for n, t in types.items()})
        if not tables:
            df = self.spark.createDataFrame([], "id long, labels array<string>")
        else:
            frames = [t.df.withColumn("__labels", F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>")) for t in tables]
            df = union(frames, types, ["id", "__labels"]).withColumnRenamed("__labels", "labels")
        return df.select(F.col("id").alias(ent.id), F.col("labels").alias(ent.fixed["labels"]), *[F.col(f"`{n}`").alias(c) for n, (c, _) in ent.props.items()]), ent

    def rel_tables(self, types) -> list:
        return [t for t in self.graph.rels if holds({t.type}, self.static(types))]

    def end_fits(self, label: str | None, node: NodePattern | None) -> bool:
        """Whether a relationship's end with this label (None: unknown) can be the node of a pattern."""
        if label is None or node is None or node.labels is None or self.depends(node.labels):
            return True
        return any(label in t.labels and holds(t.labels, self.static(node.labels)) for t in self.graph.nodes)

    def depends(self, expr) -> bool:
        """Whether a label expression holds names that only rows tell."""
        return isinstance(expr, tuple) and (expr[:1] == ("dynamic",) and expr[1][0] not in ("param", "lit") or any(self.depends(x) for x in expr))

    def scan_rels(self, types, keep=None, every: bool = False) -> tuple[DataFrame, Ent, list]:
        """Relationships of the tables that ``keep`` admits; ``every``: with the properties of all tables of the types."""
        tables = [t for t in self.rel_tables(types) if keep is None or keep(t)]
        kinds = _common([t.df.schema for t in (self.rel_tables(types) if every else tables)], {"id", "start", "end"})
        ent = Ent("rel", fresh(), {k: fresh() for k in ("type", "start", "end")}, {n: (fresh(), t) for n, t in kinds.items()})
        if not tables:
            df = union([self.spark.createDataFrame([], "id long, type string, start long, end long")], kinds, ["id", "type", "start", "end"])
        else:
            df = union([t.df.withColumn("__type", F.lit(t.type)) for t in tables], kinds, ["id", "__type", "start", "end"]).withColumnRenamed("__type", "type")
        cols = [F.col(k).alias(ent.fixed[k]) for k in ("type", "start", "end")]
        return df.select(F.col("id").alias(ent.id), *cols, *[F.col(f"`{n}`").alias(c) for n, (c, _) in ent.props.items()]), ent, tables

    def static(self, expr):
        """A label expression with its dynamic names filled in."""
        if expr is None:
            return None
        if expr[0] == "dynamic":
            v = expr[1]
            x = self.params.get(v[1]) if v[0] == "param" else v[1] if v[0] == "lit" else None
            if x is None:
                raise Unsupported("DynamicLabel", "a label that depends on rows")
            out = None
            for n in [x] if isinstance(x, str) else x:
                out = ("name", n) if out is None else ("and", out, ("name", n))
            return out
        return tuple(self.static(x) if isinstance(x, tuple) else x for x in expr)

    def match(self, frame: Frame, parts: list[Part], where=None, mode: str | None = None) -> Frame:
        if mode == "REPEATABLE":
            raise Unsupported("RepeatableElements", "REPEATABLE ELEMENTS")
        seen: list[tuple[str, set, bool]] = []  # (column of a relationship id or of a list of them, types, is a list)
        names: set[str] = set()
        every = conjuncts(where)
        waiting = [c for c in every if not self.holds_subquery(c)]
        after, self.after = self.after, None  # not for subqueries
        if after is not None:
            parts = [x for p in parts for x in self.meetings(p)]
        for k, part in enumerate(parts):
            frame = self.match_part(frame, part, seen, names, waiting)
            if after is not None and k + 1 < len(parts):
                frame = self.fold(frame, parts[k + 1 :], [after, waiting, [c for c in every if self.holds_subquery(c)]], seen)
        for c in [*waiting, *[c for c in every if self.holds_subquery(c)]]:
            frame = self.filter(frame, c)
        return frame

    def meetings(self, part: Part) -> list[Part]:
        """A plain chain, split at nodes that two relationships point to: many on one side may meet many on the other."""
        if part.var or part.selector or any(isinstance(x, Group) for x in part.items):
            return [part]
        out, items = [], [part.items[0]]
        for rel, node, then in zip(part.items[1::2], part.items[2::2], [*part.items[3::2], None], strict=False):
            if then is not None and not rel.many and not then.many and (rel.direction, then.direction) == (">", "<"):
                node = replace(node, var=node.var or f" {fresh()}")
                out.append(replace(part, items=[*items, rel, node]))
                items = [NodePattern(node.var, node.labels)]
            else:
                items += [rel, node]
        return [*out, replace(part, items=items)]

    def fold(self, frame: Frame, parts: list[Part], later: list, seen: list) -> Frame:
        """Rows that are equal in all that the rest of the statement reads become one with their number, before the next part multiplies them."""
        known: set = set()
        for p in parts:
            for near, x, node in zip([None, *p.items], p.items, [*p.items[1:], None], strict=False):
                if isinstance(x, RelPattern):
                    known |= self.kinds([t for t in self.rel_tables(x.types) if x.many or self.fitting(x, near, node)(t)])
                elif isinstance(x, Group):
                    known |= self.kinds(self.graph.rels)
        if any(kinds & known for _, kinds, _ in seen):  # their ids are still compared
            return frame
        read = uses([*later, *parts], {})
        env = {n: b for n, b in frame.env.items() if n in read or any(n == p.var for p in parts)}
        for n, b in env.items():
            if isinstance(b, Ent) and None not in read.get(n, {None}):
                env[n] = replace(b, props={p: c for p, c in b.props.items() if p in read[n]})
        if len(env) == len(frame.env):
            return frame
        cols = list(dict.fromkeys([*frame.carry, *[c for b in env.values() for c in b.columns()]]))
        if any(frame.df.schema[c].dataType.typeName() in ("map", "variant") for c in cols):
            return frame
        name = fresh()
        n = F.sum(frame.weight) if frame.weight else F.count(F.lit(1))
        df = frame.df.groupBy(*cols).agg(n.alias(name)) if cols else frame.df.agg(F.coalesce(n, F.lit(0)).alias(name)).where(F.col(name) > 0)
        return Frame(df, env, frame.carry, name)

    def holds_subquery(self, e) -> bool:
        return is_subquery(e) or isinstance(e, tuple) and any(self.holds_subquery(x) for x in e)

    def settle(self, frame: Frame, waiting: list) -> Frame:
        """Apply the conjuncts of WHERE whose variables are all bound by now, before the pattern grows on."""
        for c in list(waiting):
            names = set(uses(c, {}))
            if names and names <= set(frame.env):
                waiting.remove(c)
                frame = self.filter(frame, c)
        return frame

    def bind(self, frame: Frame, var: str | None, b) -> Frame:
        return replace(frame, env=frame.env | {var or f" {fresh()}": b})

    def cross(self, frame: Frame, df: DataFrame) -> DataFrame:
        return df if frame.df is None else frame.df.crossJoin(df)

    def props_filter(self, frame: Frame, b: Ent, props, where) -> Frame:
        if props is not None:
            if props[0] == "param":
                raise QuerySyntaxError("InvalidParameterUse", "a parameter map in MATCH or MERGE")
            for k, e in props[1]:
                frame, (e,) = self.hoist(frame, [e])
                v = typed(F.col(b.props[k][0]), b.props[k][1]) if k in b.props else lit(None)
                frame = replace(frame, df=frame.df.where(equal(v, self.compile(e, frame.env)).col))
        return self.filter(frame, where)

    def match_node(self, frame: Frame, n: NodePattern, at: str | None, implied: set | None = None) -> tuple[Frame, str]:
        """Bind a node, at the id in column ``at`` if there is one; returns its id column."""
        if n.var in frame.env:
            b = frame.env[n.var]
            if isinstance(b, Val):
                if not is_node(b.type):
                    raise QuerySyntaxError("VariableTypeConflict", n.var)
                name = fresh()
                frame = replace(frame, df=frame.df.withColumn(name, F.col(b.col).getField("id")), carry=frame.carry)
                if at:
                    frame = replace(frame, df=frame.df.where(F.col(name) == F.col(at)))
                return (replace(frame, df=frame.df.where(F.col(name).isNotNull())), name)
            if b.kind != "node":
                raise QuerySyntaxError("VariableTypeConflict", n.var)
            df = frame.df.where(F.col(b.id) == F.col(at)) if at else frame.df.where(F.col(b.id).isNotNull())
            frame = replace(frame, df=df)
            if n.labels:
                frame = replace(frame, df=frame.df.where(self.label_test(typed(F.col(b.fixed["labels"]), T.ArrayType(STRING)), n.labels, frame.env).col))
            return self.props_filter(frame, b, n.props, n.where), b.id
        if at and n.var is None and n.props is None and n.where is None and (n.labels is None or (implied and all(holds({x}, self.static(n.labels)) for x in implied) and n.labels[0] != "not")):
            return frame, at  # nothing is asked of the node that its id doesn't tell
        df, b = self.scan_nodes(n.labels, implied)
        for p in sorted(p for v, p in self.vectors if v == n.var and p in b.props):
            kind = b.props[p][1]
            if is_list(kind) and is_num(kind.elementType):  # once for a node, not for each pair
                b.squares[p] = fresh()
                df = df.withColumn(b.squares[p], S.square(typed(F.col(b.props[p][0]), kind)).col)
        df = self.cross(frame, df) if not at else frame.df.join(df, F.col(at) == F.col(b.id))
        frame = self.bind(replace(frame, df=df), n.var, b)
        return self.props_filter(frame, b, n.props, n.where), b.id

    def match_part(self, frame: Frame, part: Part, seen: list, names: set, waiting: list) -> Frame:
        if part.var and (part.var in frame.env or part.var in uses(part, {})):
            raise QuerySyntaxError("VariableAlreadyBound", part.var)
        for x in part.items:
            if isinstance(x, RelPattern) and x.var:
                if x.var in names:
                    raise QuerySyntaxError("RelationshipUniquenessViolation", x.var)
                names.add(x.var)
                if any(isinstance(n, NodePattern) and n.var == x.var for n in part.items) or not self.can_be_rel(frame.env.get(x.var)):
                    raise QuerySyntaxError("VariableTypeConflict", x.var)
        if part.selector or any(isinstance(x, Group) and x.low is not None for x in part.items):
            from ..operators.paths import select_paths

            return select_paths(self, frame, part, seen, waiting)
        items = self.flatten(part.items)
        where = [w for x in part.items if isinstance(x, Group) for w in [x.where] if w]
        at = None
        if len(items) == 1 or items[0] != NodePattern() or items[1].many or items[1].var in frame.env:
            frame, at = self.match_node(frame, items[0], None, self.near_labels(items))
            frame = self.settle(frame, waiting)
        trail: list = [at]
        implied: set | None = None
        for near, rel, node in zip(items[::2], items[1::2], items[2::2], strict=False):
            if rel.many:
                from ..operators.paths import expand

                frame, at, rels = expand(self, frame, at, rel, seen, part.var, near, node)
                trail += [("many", rels)]
                implied = self.path_labels([rel])
            else:
                frame, begin, at, b, implied = self.hop(frame, at, rel, seen, near, node)
                trail[0] = trail[0] or begin
                trail += [b]
            frame, at = self.match_node(self.settle(frame, waiting), node, at, implied)
            frame = self.settle(frame, waiting)
            trail.append(at)
        if part.var:
            frame = self.bind_path(frame, part.var, trail, self.path_labels(part.items))
        for w in where:
            frame = self.filter(frame, w)
        return frame

    def can_be_rel(self, b) -> bool:
        """Whether a variable's binding (None: not bound) is a relationship or a list of them, as far as its type tells."""
        if b is None:
            return True
        if isinstance(b, Ent):
            return b.kind == "rel"
        kind = b.type.elementType if is_list(b.type) else b.type
        return is_null(kind) or is_rel(kind)

    def flatten(self, items: list) -> list:
        out: list = []
        for x in items:
            inner = self.flatten(x.part.items) if isinstance(x, Group) else [x]
            if out and isinstance(out[-1], NodePattern) and isinstance(inner[0], NodePattern):
                out[-1] = self.merged(out[-1], inner[0])
                inner = inner[1:]
            out += inner
        return out

    def merged(self, a: NodePattern, b: NodePattern) -> NodePattern:
        both = lambda x, y, f: y if x is None else x if y is None else f(x, y)
        if a.var and b.var:
            raise Unsupported("AdjacentNodes", "two named nodes side by side")
        return NodePattern(a.var or b.var, both(a.labels, b.labels, lambda x, y: ("and", x, y)), both(a.props, b.props, lambda x, y: ("map", x[1] + y[1])), both(a.where, b.where, lambda x, y: ("and", x, y)))

    def kinds(self, tables: list) -> set:
        """What tells tables of relationships apart; a relationship lies in one table."""
        return {(t.type, t.start_label, t.end_label) for t in tables}

    def fitting(self, rel: RelPattern, first: NodePattern | None, node: NodePattern | None):
        """Whether a table's ends can be the nodes at either side of a relationship."""
        forth = lambda t: self.end_fits(t.start_label, first) and self.end_fits(t.end_label, node)
        back = lambda t: self.end_fits(t.end_label, first) and self.end_fits(t.start_label, node)
        return {">": forth, "<": back}.get(rel.direction, lambda t: forth(t) or back(t))

    def hop(self, frame: Frame, at: str | None, rel: RelPattern, seen: list, first: NodePattern, node: NodePattern):
        """One relationship from the node at column ``at`` (None: any node): (frame, columns of both ends, binding, labels of the other end).

        Types whose ends can't have the labels of the nodes at either side are not read.
        """
        df, b, tables = self.scan_rels(rel.types, self.fitting(rel, first, node))
        near, far = (b.fixed["start"], b.fixed["end"]) if rel.direction != "<" else (b.fixed["end"], b.fixed["start"])
        implied = {(t.end_label if rel.direction == ">" else t.start_label) for t in tables}
        if rel.direction == "-":
            implied = {x for t in tables for x in (t.start_label, t.end_label)}
            near, far = fresh(), fresh()
            s, e = b.fixed["start"], b.fixed["end"]
            df = df.select("*", F.col(s).alias(near), F.col(e).alias(far)).unionAll(df.where(F.col(s) != F.col(e)).select("*", F.col(e).alias(near), F.col(s).alias(far)))
        if at is None:
            frame = replace(frame, df=self.cross(frame, df))
        elif rel.var in frame.env:
            old = frame.env[rel.var]
            on = (F.col(b.id) == (F.col(old.id) if isinstance(old, Ent) else F.col(old.col).getField("id"))) & (F.col(near) == F.col(at))
        else:
            on = F.col(near) == F.col(at)
        if at is not None:
            frame = replace(frame, df=frame.df.join(df, on))
        frame = self.unique(frame, b.id, self.kinds(tables), False, seen)
        if rel.var not in frame.env:
            frame = self.bind(frame, rel.var, b)
        frame = self.props_filter(frame, b, rel.props, rel.where)
        return frame, near, far, b, None if None in implied else implied

    def near_labels(self, items: list) -> set | None:
        """Labels of which a pattern's first node has one, as its first relationship implies; None if that says nothing."""
        if len(items) < 2 or not isinstance(items[1], RelPattern) or items[1].low == 0:
            return None
        rel, first, node = items[1], items[0], None if items[1].many or len(items) < 3 else items[2]
        forth = {t.start_label for t in self.rel_tables(rel.types) if rel.direction != "<" and self.end_fits(t.start_label, first) and self.end_fits(t.end_label, node)}
        back = {t.end_label for t in self.rel_tables(rel.types) if rel.direction != ">" and self.end_fits(t.end_label, first) and self.end_fits(t.start_label, node)}
        return None if None in forth | back else forth | back

    def path_labels(self, items: list) -> set | None:
        """Labels of which each node of a path has one; None if any node may be on it."""
        out: set = set()
        rels = [x for x in items if not isinstance(x, NodePattern)]
        for x in rels:
            if x.low == 0:
                return None
            found = self.path_labels(x.part.items) if isinstance(x, Group) else {y for t in self.rel_tables(x.types) for y in (t.start_label, t.end_label)}
            if found is None or None in found:
                return None
            out |= found
        return out if rels else None

    def unique(self, frame: Frame, col: str, types: set, many: bool, seen: list) -> Frame:
        """A relationship is used once in a MATCH; pairs whose types can't overlap need no test."""
        for other, kinds, listy in seen:
            if not kinds & types:
                continue
            if many and listy:
                test = ~F.arrays_overlap(col, other)
            elif many or listy:
                test = ~F.array_contains(*((F.col(col), F.col(other)) if many else (F.col(other), F.col(col))))
            else:
                test = F.col(col) != F.col(other)
            frame = replace(frame, df=frame.df.where(test))
        seen.append((col, types, many))
        return frame

    def chain(self, rels: list[Value]) -> Value:
        """One list of relationships and lists of them, in one type."""
        kinds = [r.type if is_rel(r.type) else r.type.elementType for r in rels]
        props = _common([k["properties"].dataType for k in kinds], set())
        base = [T.StructField(n, LONG if n != "type" else STRING) for n in ("id", "type", "start", "end")]
        kind = T.StructType([*base, T.StructField("properties", T.StructType([T.StructField(n, t) for n, t in props.items()]))])

        def same(c, t):
            inner = c.getField("properties")
            filled = F.struct(*[(inner.getField(n) if n in t["properties"].dataType.names else F.lit(None)).cast(x).alias(n) for n, x in props.items()]) if props else F.from_json(F.lit("{}"), T.StructType([]))
            return F.struct(*[c.getField(n).alias(n) for n in ("id", "type", "start", "end")], filled.alias("properties"))

        def chained(r):
            return F.array(same(r.col, r.type)) if is_rel(r.type) else F.transform(r.col, lambda x: same(x, r.type.elementType))

        lists = [chained(r) for r in rels]
        return typed(F.concat(*lists) if lists else F.array().cast(T.ArrayType(kind)), T.ArrayType(kind))

    def bind_path(self, frame: Frame, var: str, trail: list, labels: set | None = None) -> Frame:
        """A path value: node ids and relationships, and the nodes by a join with those of the labels that the path can hold."""
        if var in self.counted or var == " path":  # only its length is asked
            n = sum((F.lit(1) if isinstance(x, Ent) else F.size(x[1].col) for x in trail[1::2]), F.lit(0))
            name, flags = fresh(), T.ArrayType(BOOL)
            df = frame.df.select("*", F.when(F.col(trail[0]).isNotNull(), F.struct(F.lit(None).cast(flags).alias("nodes"), F.array_repeat(F.lit(True), n).alias("relationships"))).alias(name))
            return self.bind(replace(frame, df=df), var, Val(name, T.StructType([T.StructField("nodes", flags), T.StructField("relationships", flags)])))
        whole = self.chain([x.value() if isinstance(x, Ent) else typed(F.col(x[1].col), x[1].type) for x in trail[1::2]])
        chain, kind, start = whole.col, whole.type.elementType, trail[0]
        follow = F.aggregate(chain, F.array(F.col(start)), lambda acc, r: F.array_append(acc, F.when(r.getField("start") == F.element_at(acc, -1), r.getField("end")).otherwise(r.getField("start"))))
        ids, name = fresh(), fresh()
        df = frame.df.select("*", follow.alias(ids), chain.alias(name + "r"))
        df, nodes = self.hydrate(df, ids, labels)
        whole = T.StructType([T.StructField("nodes", nodes.type), T.StructField("relationships", T.ArrayType(kind))])
        df = df.select("*", F.when(F.col(start).isNotNull(), F.struct(nodes.col.alias("nodes"), F.col(name + "r").alias("relationships"))).alias(name))
        return self.bind(replace(frame, df=df), var, Val(name, whole))

    def hydrate(self, df: DataFrame, ids: str, labels: set | None) -> tuple[DataFrame, Value]:
        """Nodes of a list of ids, in order, by one join over the distinct lists."""
        rows, b = self.scan_nodes(None, labels)
        node = b.value()
        each = df.select(F.col(ids).alias("__ids")).distinct().select("__ids", F.posexplode("__ids").alias("__at", "__id"))
        found = each.join(rows.select(F.col(b.id).alias("__key"), node.col.alias("__node")), F.col("__id") == F.col("__key"))
        name = fresh()
        by_place = found.groupBy("__ids").agg(F.map_from_entries(F.collect_list(F.struct("__at", "__node"))).alias("__m"))
        lists = by_place.select("__ids", F.transform(F.sequence(F.lit(0), F.size("__ids") - 1), lambda k: F.col("__m")[k]).alias(name))
        df = df.join(lists, F.col(ids) == F.col("__ids"), "left").drop("__ids")
        return df, typed(F.col(name), T.ArrayType(node.type))

    def shortest_value(self, frame: Frame, part: Part) -> tuple[Frame, Value]:
        from ..operators.paths import select_paths

        sub, cols = self.keyed(frame, part)
        var = part.var or " p"
        part = replace(part, var=var)
        found = select_paths(self, sub, part, [])
        b = found.env[var]
        single = part.selector[0] == "any"
        name = fresh()
        agg = F.first(b.col) if single else F.collect_list(b.col)
        rows = found.df.groupBy(*cols).agg(agg.alias(name))
        kind = b.type if single else T.ArrayType(b.type)
        return replace(frame, df=self.join_back(frame.df, rows, cols, "left")), typed(F.col(name), kind)

    # -- clauses
    def query(self, q: Query, start: Frame) -> Frame:
        frames = [self.branch(b, start) for b in q.branches]
        if len(frames) == 1:
            return frames[0]
        names = list(frames[0].env)
        if any(set(f.env) != set(names) for f in frames):
            raise QuerySyntaxError("DifferentColumnsInUnion", "branches return different columns")
        values = [{n: f.env[n].value() for n in names} for f in frames]
        types = {n: common([v[n].type for v in values]) or STRING for n in names}
        out = {n: fresh() for n in names}
        carry = frames[0].carry
        made = [f.df.select(*carry, *[cast(v[n], types[n]).col.alias(out[n]) for n in names]) for f, v in zip(frames, values, strict=True)]
        df = made[0]
        for m in made[1:]:
            df = df.unionAll(m)
        df = df if q.all else df.distinct()
        return Frame(df, {n: Val(c, types[n]) for n, c in out.items()}, carry)

    def branch(self, clauses: list[Clause], frame: Frame) -> Frame:
        for c, then in zip(clauses, [*clauses[1:], None], strict=True):
            self.after = then.data if c.kind == "match" and not c.data["optional"] and then is not None and self.counts(then) else None
            frame = getattr(self, f"do_{c.kind}", self.unknown)(frame, **c.data)
        return frame

    def counts(self, clause: Clause) -> bool:
        """Whether a clause only groups rows, with aggregates that need no more of equal rows than their number."""
        if clause.kind not in ("with", "return") or clause.data["star"]:
            return False
        found: list = []

        def walk(e):
            if isinstance(e, tuple):
                if e[:1] == ("call",) and e[1] in S.AGGREGATES:
                    found.append(e[1] in ("min", "max") or e[1] == "count")
                for x in e:
                    walk(x)

        items = [e for e, _ in clause.data["items"]]
        walk(tuple(items))
        return bool(found) and all(found) and not any(self.holds_subquery(e) for e in [*items, *[e for e, _ in clause.data["order"]]])

    def unknown(self, frame, **_):
        raise Unsupported("Clause", "this clause")

    def do_match(self, frame: Frame, optional, parts, where, mode) -> Frame:
        if not optional:
            return self.match(frame, parts, where, mode)
        if frame.df is None:
            frame = replace(frame, df=self.unit())
        sub, cols = self.keyed(frame, [parts, where])
        found = self.match(sub, parts, where, mode)
        new = {n: b for n, b in found.env.items() if n not in frame.env}
        keep = list(dict.fromkeys(c for b in new.values() for c in b.columns()))
        df = self.join_back(frame.df, found.df.select(*cols, *keep), cols, "left")
        return replace(frame, df=df, env=frame.env | {n: b for n, b in new.items() if not n.startswith(" ")})

    def do_unwind(self, frame: Frame, expr, var) -> Frame:
        frame, (expr,) = self.hoist(frame, [expr])
        v = self.compile(expr, frame.env)
        name = fresh()
        df = frame.df if frame.df is not None else self.unit()
        if is_list(v.type):
            kind = v.type.elementType
            df = df.select("*", F.explode(v.col).alias(name))
        elif is_null(v.type):
            kind, df = STRING, df.select("*", F.lit(None).cast("string").alias(name)).where(F.lit(False))
        else:
            kind, df = v.type, df.select("*", v.col.alias(name)).where(F.col(name).isNotNull())
        return replace(frame, df=df, env=frame.env | {var: Val(name, kind)})

    def do_filter(self, frame: Frame, where) -> Frame:
        return self.filter(frame, where)

    def do_let(self, frame: Frame, items) -> Frame:
        for name, e in items:
            frame, (e,) = self.hoist(frame, [e])
            v, c = self.compile(e, frame.env), fresh()
            df = (frame.df if frame.df is not None else self.unit()).withColumn(c, v.col)
            frame = replace(frame, df=df, env=frame.env | {name: Val(c, v.type)})
        return frame

    def do_finish(self, frame: Frame) -> Frame:
        return Frame((frame.df if frame.df is not None else self.unit()).limit(0), {}, frame.carry)

    def do_with(self, frame: Frame, **d) -> Frame:
        out = self.project(frame, **d)
        if not d["order"] or frame.carry or out.df is None:
            return out
        place = fresh()  # ascends over the sorted rows, whichever partitions they lie in
        return replace(out, df=out.df.withColumn(place, F.monotonically_increasing_id()), order=place)

    def do_return(self, frame: Frame, **d) -> Frame:
        return self.project(frame, **d)

    def has_aggregate(self, e) -> bool:
        if isinstance(e, tuple):
            if e[:1] == ("call",) and e[1] in S.AGGREGATES:
                return True
            return any(self.has_aggregate(x) for x in e if isinstance(x, tuple))
        return False

    def project(self, frame: Frame, distinct, star, items, order, skip, limit, where) -> Frame:
        if frame.df is None:
            frame = replace(frame, df=self.unit())
        scope = {n: b for n, b in frame.env.items() if not n.startswith(" ")}
        if star and not scope and not items:
            raise QuerySyntaxError("NoVariablesInScope", "* without variables")
        items = [(("var", n), n) for n in scope] * star + list(items)
        frame, exprs = self.hoist(frame, [e for e, _ in items])
        names = [n for _, n in items]
        grouped = any(self.has_aggregate(e) for e in exprs)
        if grouped:
            before, out, hidden = self.aggregate(frame, exprs, names)
        else:
            cols, out = [], {}
            for e, n in zip(exprs, names, strict=True):
                if e[0] == "var" and isinstance(frame.env.get(e[1]), Ent):
                    out[n] = frame.env[e[1]]
                else:
                    v = self.compile(e, frame.env)
                    out[n] = Val(fresh(), v.type)
                    cols.append(v.col.alias(out[n].col))
            before, hidden = replace(frame, df=frame.df.select("*", *cols) if cols else frame.df), frame.env
        keep = list(dict.fromkeys([*frame.carry, *[c for b in out.values() for c in b.columns()]]))
        same = {e: n for e, n in zip(exprs, names, strict=True)}
        if distinct:
            before = replace(before, df=before.df.select(*keep).distinct())
        env = (hidden if not distinct else {}) | out
        work = Frame(before.df, env, frame.carry)
        keys = []
        for e, down in order:
            e = self.swap(e, same)
            if self.has_aggregate(e):
                raise QuerySyntaxError("UndefinedVariable", "an aggregate in ORDER BY that is not returned")
            work, (e,) = self.hoist(work, [e])
            v = self.sort_key(self.compile(e, work.env))
            keys.append(v.col.desc_nulls_first() if down else v.col.asc_nulls_last())
        n, m = (self.constant(x) if x is not None else None for x in (skip, limit))
        if frame.carry and (n is not None or m is not None):
            rank = fresh()
            w = Window.partitionBy(*frame.carry).orderBy(*(keys or [F.lit(1)]))
            df = work.df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) > (n or 0))
            work = replace(work, df=df.where(F.col(rank) <= (n or 0) + m) if m is not None else df)
        else:
            df = work.df.orderBy(*keys) if keys else work.df
            if n is not None:
                df = df.offset(n)
            if m is not None:
                df = df.limit(m)
            work = replace(work, df=df)
        if where is not None:
            work = self.filter(replace(work, env=env), where)
        return Frame(work.df.select(*keep) if keep else work.df, out, frame.carry)

    def swap(self, e, same: dict):
        """An ORDER BY expression with projected expressions replaced by their names."""
        if isinstance(e, tuple):
            try:
                if e in same and e[0] != "lit":
                    return ("var", same[e])
            except TypeError:
                return e
            return tuple(self.swap(x, same) if isinstance(x, tuple) else x for x in e)
        return e

    def sort_key(self, v: Value) -> Value:
        if is_node(v.type) or is_rel(v.type):
            return get(v, "id")
        if is_null(v.type):
            return cast(v, STRING)
        return apply(lambda c: c.cast("string"), v, kind=STRING) if v.type == S.DURATION else v

    def constant(self, e) -> int:
        if uses(e, {}):
            raise QuerySyntaxError("NonConstantExpression", "SKIP and LIMIT take constants")
        v = self.params.get(e[1]) if e[0] == "param" else e[1] if e[0] == "lit" else self.spark.range(1).select(self.compile(e, {}).col.alias("x")).first()[0]
        if not isinstance(v, int) or isinstance(v, bool):
            raise QuerySyntaxError("InvalidArgumentType", "SKIP and LIMIT take whole numbers")
        if v < 0:
            raise QuerySyntaxError("NegativeIntegerArgument", str(v))
        return v

    def aggregate(self, frame: Frame, exprs, names):
        keys = [(e, n) for e, n in zip(exprs, names, strict=True) if not self.has_aggregate(e)]
        bound, cols, group = {}, [], []
        for e, n in keys:
            if e[0] == "var" and isinstance(frame.env.get(e[1]), Ent):
                bound[n] = frame.env[e[1]]
                group += bound[n].columns()
            else:
                v = self.compile(e, frame.env)
                if isinstance(v.type, T.DoubleType):
                    v = apply(lambda c: c + F.lit(0.0), v, kind=DOUBLE)
                bound[n] = Val(fresh(), STRING if is_null(v.type) else v.type)
                cols.append((v.col.cast("string") if is_null(v.type) else v.col).alias(bound[n].col))
                group.append(bound[n].col)
        aggs: dict[tuple, tuple[str, T.DataType, object]] = {}
        self.order = frame.order if frame.df is not None and frame.order in frame.df.columns else None
        self.before: list = []  # columns that an aggregate names in SQL

        def lift(e):
            if isinstance(e, tuple) and e[:1] == ("call",) and e[1] in S.AGGREGATES:
                if any(self.has_aggregate(a) for a in e[2]):
                    raise QuerySyntaxError("NestedAggregation", e[1])
                if e not in aggs:
                    c, t = self.aggregate_column(e, frame.env, frame.weight)
                    aggs[e] = (fresh(), t, c)
                return ("agg", e)
            if isinstance(e, tuple):
                for k, n in keys:
                    if e == k and e[0] not in ("lit", "param"):
                        return ("key", n)
                return tuple(lift(x) if isinstance(x, tuple) else x for x in e)
            return e

        lifted = [(lift(e), n) for e, n in zip(exprs, names, strict=True) if self.has_aggregate(e)]
        source = frame.df.select("*", *cols, *self.before) if cols or self.before else frame.df
        group = list(dict.fromkeys([*frame.carry, *group]))
        df = source.groupBy(*group).agg(*[c.alias(n) for n, _, c in aggs.values()])

        def drop(e):
            if isinstance(e, tuple):
                if e[:1] == ("agg",):
                    return ("value", typed(F.col(aggs[e[1]][0]), aggs[e[1]][1]))
                if e[:1] == ("key",):
                    return ("value", bound[e[1]].value())
                return tuple(drop(x) if isinstance(x, tuple) else x for x in e)
            return e

        out, made = dict(bound), []
        for e, n in lifted:
            try:
                v = self.compile(drop(e), {})
            except QuerySyntaxError as x:
                if x.code == "UndefinedVariable":
                    raise QuerySyntaxError("AmbiguousAggregationExpression", n) from x
                raise
            out[n] = Val(fresh(), v.type)
            made.append(v.col.alias(out[n].col))
        out = {n: out[n] for n in names}
        return Frame(df.select("*", *made), out, frame.carry), out, {}

    def aggregate_column(self, e, env, weight: str | None = None):
        _, name, args, distinct = e
        number = lambda c: F.count(c) if weight is None else F.coalesce(F.sum(F.when(c.isNotNull(), F.col(weight))), F.lit(0).cast("long"))
        if name == "count" and args == (("star",),):
            return number(F.lit(1)), LONG
        v = self.compile(args[0], env)
        c = v.col
        if name == "count":
            c = F.col(env[args[0][1]].id) if args[0][0] == "var" and isinstance(env.get(args[0][1]), Ent) else c
            return (F.count_distinct(c) if distinct else number(c)), LONG
        if name == "collect":
            t = T.ArrayType(STRING if is_null(v.type) else v.type)
            if self.order and not distinct and not is_null(v.type):
                pairs = F.collect_list(F.when(c.isNotNull(), F.struct(F.col(self.order).alias("at"), c.alias("v"))))
                return F.transform(F.array_sort(pairs, lambda a, b: (a.getField("at") > b.getField("at")).cast("int") - (a.getField("at") < b.getField("at")).cast("int")), lambda x: x.getField("v")), t
            return (F.array_distinct(F.collect_list(c)) if distinct and is_entity(v.type) else F.collect_set(c) if distinct else F.collect_list(c.cast("string") if is_null(v.type) else c)), t
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(c), v.type
        if not (is_num(v.type) or is_null(v.type)):
            raise QueryTypeError("InvalidArgumentType", f"{name}() takes numbers")
        whole = is_int(v.type)
        c = c.cast("long" if whole else "double")
        if name == "sum":
            return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0).cast("long" if whole else "double")), LONG if whole else DOUBLE
        if name == "avg":
            return (F.try_divide(F.sum_distinct(c.cast("double")), F.count_distinct(c)) if distinct else F.avg(c)), DOUBLE
        own, once = fresh(), "DISTINCT " if distinct else ""
        self.before.append(c.cast("double").alias(own))
        if name in ("stdev", "stdevp"):
            return F.coalesce(F.expr(f"{'stddev_samp' if name == 'stdev' else 'stddev_pop'}({once}`{own}`)"), F.lit(0.0)), DOUBLE
        p = self.share(args[1])
        if name == "percentilecont":
            return F.expr(f"percentile({once}`{own}`, {p!r}D)"), DOUBLE
        if not distinct:  # whole numbers beyond 2^53 are ranked as floats
            return F.expr(f"percentile_disc({p!r}D) WITHIN GROUP (ORDER BY `{own}`)").cast(v.type if not is_null(v.type) else DOUBLE), v.type
        ranked = F.array_sort(F.collect_set(c))
        return F.try_element_at(ranked, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(ranked))).cast("int")), v.type

    def share(self, e) -> float:
        """The constant share of a percentile."""
        if uses(e, {}):
            raise QuerySyntaxError("NonConstantExpression", "a percentile takes a constant share")
        x = self.params.get(e[1]) if e[0] == "param" else e[1] if e[0] == "lit" else self.spark.range(1).select(self.compile(e, {}).col.alias("x")).first()[0]
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            raise QueryTypeError("InvalidArgumentType", "a percentile takes a number")
        if not 0 <= x <= 1:
            raise QueryArithmeticError("NumberOutOfRange", str(x))
        return float(x)

    def do_subquery(self, frame: Frame, query, scope, optional) -> Frame:
        if frame.df is None:
            frame = replace(frame, df=self.unit())
        if scope is not None and scope != ["*"]:
            missing = [n for n in scope if n not in frame.env]
            if missing:
                raise QuerySyntaxError("UndefinedVariable", missing[0])
            visible = {n: frame.env[n] for n in scope}
        else:
            visible = frame.env
        sub, cols = self.keyed(replace(frame, env=visible), query)
        found = self.query(query, sub)
        if not self.gives(query):
            return frame
        clash = set(found.env) & set(frame.env)
        if clash:
            raise QuerySyntaxError("VariableAlreadyBound", min(clash))
        keep = list(dict.fromkeys(c for b in found.env.values() for c in b.columns()))
        names = {c: fresh() for c in keep if c in frame.df.columns and c not in cols}
        df = self.join_back(frame.df, found.df.select(*cols, *[F.col(c).alias(names.get(c, c)) for c in keep if c not in cols]), cols, "left" if optional else "inner")
        env = {n: Val(names.get(b.col, b.col), b.type) if isinstance(b, Val) else Ent(b.kind, names.get(b.id, b.id), {k: names.get(c, c) for k, c in b.fixed.items()}, {k: (names.get(c, c), t) for k, (c, t) in b.props.items()}) for n, b in found.env.items()}
        return replace(frame, df=df, env=frame.env | env)

    def gives(self, query: Query) -> bool:
        """Whether a query returns rows."""
        return any(c.kind == "return" or c.kind == "when" and any(self.gives(q) for _, q in c.data["arms"]) for c in query.branches[0])

    def do_when(self, frame: Frame, arms, **d) -> Frame:
        other = d["else"]
        outs, left = [], frame
        for cond, q in arms:
            hit = self.filter(left, cond)
            outs.append(self.query(q, hit))
            left = self.filter(left, ("not", ("call", "coalesce", (cond, ("lit", False)), False)))
        if other:
            outs.append(self.query(other, left))
        names = list(outs[0].env)
        types = {n: common([o.env[n].value().type for o in outs]) or STRING for n in names}
        cols = {n: fresh() for n in names}
        df = None
        for o in outs:
            part = o.df.select(*frame.carry, *[cast(o.env[n].value(), types[n]).col.alias(cols[n]) for n in names])
            df = part if df is None else df.unionAll(part)
        return Frame(df, {n: Val(cols[n], types[n]) for n in names}, frame.carry)

    def do_load(self, frame: Frame, headers, url, var, sep) -> Frame:
        from ..sources.files import load_csv

        at = self.constant_text(url)
        df, kind = load_csv(self.spark, at, headers, self.constant_text(sep) if sep else ",")
        name = fresh()
        df = df.select(F.col("row").alias(name), "__line", "__file")
        return Frame(self.cross(frame, df), frame.env | {var: Val(name, kind)}, frame.carry)

    def constant_text(self, e) -> str:
        return self.params[e[1]] if e[0] == "param" else e[1] if e[0] == "lit" else self.spark.range(1).select(self.compile(e, {}).col.alias("x")).first()[0]

    def do_procedure(self, frame: Frame, name, args, optional, **d) -> Frame:
        from ..operators.procedures import call

        args = self.arguments(name, args, frame.env)
        df, types = call(self, name, [self.compile(a, {}) for a in args], args)
        wanted = d["yield"] if d["yield"] not in (None, "*") else [(n, n) for n in types]
        cols, env = [], {}
        for n, alias in wanted:
            if n not in types:
                raise ProcedureError("UnknownOutput", n)
            if alias in frame.env:
                raise QuerySyntaxError("VariableAlreadyBound", alias)
            env[alias] = Val(fresh(), types[n])
            cols.append(F.col(n).alias(env[alias].col))
        made = df.select(*cols)
        out = Frame(made if frame.df is None else frame.df.join(made, F.lit(True), "left" if optional else "inner"), frame.env | env, frame.carry)
        return self.filter(out, d["where"])

    def arguments(self, name: str, args: list | None, env: dict) -> list:
        """A call's arguments, held against the procedure's inputs; left out altogether, they are the parameters of the inputs' names."""
        from ..operators.procedures import inputs_of

        inputs = inputs_of(self.graph, name)
        if args is None:
            if inputs and env:
                raise QuerySyntaxError("InvalidArgumentPassingMode", f"{name} takes arguments; parameters stand for them in a call of its own only")
            args = [("param", n) for n, _ in inputs or []]
        if inputs is not None and len(args) != len(inputs):
            raise QuerySyntaxError("InvalidNumberOfArguments", f"{name} takes {len(inputs)} arguments, not {len(args)}")
        if any(uses(a, {}) for a in args):
            raise Unsupported("ProcedureArguments", "arguments that depend on rows")
        return args

    def do_show(self, frame: Frame, what, **d) -> Frame:
        rows = self.spark.createDataFrame([(n, x["type"], x["entity"], x["label"], list(x["props"])) for n, x in self.graph.catalog.items() if x["what"] == ("INDEX" if what.startswith("INDEX") else "CONSTRAINT")], "name string, type string, entityType string, label string, properties array<string>")
        if what.startswith("PROCEDURE"):
            from ..operators.procedures import NAMES

            rows = self.spark.createDataFrame([(n,) for n in [*NAMES, *self.graph.procedures]], "name string")
        elif what.startswith("FUNCTION"):
            raise Unsupported("ShowFunctions", "SHOW FUNCTIONS")
        env = {f.name: Val(f.name, f.dataType) for f in rows.schema}
        if d["yield"] not in (None, "*"):
            env = {a: env[n] for n, a in d["yield"]}
        return self.filter(Frame(rows, env), d["where"])


def run(graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    """Plan a read query; the result's columns are named as the query says."""
    q = parse(text)
    low = Lowering(graph, params)
    (low.counted, low.unread), low.vectors = counted(q), compared(q)
    frame = low.query(q, Frame(None))
    if q.branches[-1][-1].kind not in ("return", "show", "procedure", "finish", "when"):
        raise QuerySyntaxError("InvalidClauseComposition", "a read query ends with RETURN")
    out = frame.df.select(*[b.value().col.alias(n) for n, b in frame.env.items() if not n.startswith(" ")]) if frame.env else frame.df.select()
    return out.limit(0) if q.explain == "EXPLAIN" else out
