"""Typed values: a column together with a stand-in of the same type, so that types are known before any data is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryTypeError, Unsupported

NULL, LONG, DOUBLE, STRING, BOOL = T.NullType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
DURATION = T.StructType([T.StructField(n, LONG) for n in ("months", "days", "seconds", "nanos")])
POINT = T.StructType([T.StructField("srid", T.IntegerType()), *[T.StructField(n, DOUBLE) for n in "xyz"]])


@dataclass(eq=False)
class Value:
    col: Column
    ghost: Column
    type: T.DataType


def typed(col: Column, kind: T.DataType) -> Value:
    return Value(col, F.lit(None).cast(kind), kind)


_cache: dict[str, T.DataType] = {}


def apply(f, *args: Value, kind: T.DataType | None = None) -> Value:
    """``f`` of the columns; its type is asked of the analyser, on stand-ins, unless given."""
    ghost = f(*[a.ghost for a in args])
    if kind is None:
        kind = SparkSession.getActiveSession().range(1).select(ghost.alias("x")).schema[0].dataType
    return Value(f(*[a.col for a in args]), ghost, kind)


def lit(v) -> Value:
    if isinstance(v, bool):
        return Value(F.lit(v), F.lit(v), BOOL)
    if isinstance(v, int):
        if not -(2**63) <= v < 2**63:
            raise QueryTypeError("IntegerOverflow", str(v))
        c = F.lit(v).cast("long")
        return Value(c, c, LONG)
    if isinstance(v, float):
        c = F.lit(v).cast("double")
        return Value(c, c, DOUBLE)
    if v is None:
        return Value(F.lit(None), F.lit(None), NULL)
    if isinstance(v, (list, tuple)):
        return listed([lit(x) for x in v])
    if isinstance(v, dict):
        return mapped({k: lit(x) for k, x in v.items()})
    c = F.lit(v)
    return apply(lambda: c)


def is_int(t):
    return isinstance(t, T.IntegralType)


def is_num(t):
    return isinstance(t, T.NumericType)


def is_null(t):
    return isinstance(t, T.NullType)


def is_list(t):
    return isinstance(t, T.ArrayType)


def is_map(t):
    return isinstance(t, T.StructType) and not is_entity(t) and t not in (DURATION, POINT)


def is_node(t):
    return isinstance(t, T.StructType) and t.names == ["id", "labels", "properties"]


def is_rel(t):
    return isinstance(t, T.StructType) and t.names == ["id", "type", "start", "end", "properties"]


def is_path(t):
    return isinstance(t, T.StructType) and t.names == ["nodes", "relationships"]


def is_entity(t):
    return is_node(t) or is_rel(t) or is_path(t)


def is_temporal(t):
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def struct_of(fields: dict[str, Value]) -> Value:
    if not fields:
        c = F.from_json(F.lit("{}"), T.StructType([]))
        return Value(c, c, T.StructType([]))
    make = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, fields, strict=True)])
    return apply(make, *fields.values(), kind=T.StructType([T.StructField(n, v.type) for n, v in fields.items()]))


mapped = struct_of


def common(types: list[T.DataType]) -> T.DataType | None:
    """One type for all, or None."""
    real = [t for t in types if not is_null(t)]
    if not real:
        return NULL
    if all(t == real[0] for t in real):
        return real[0]
    if all(is_int(t) for t in real):
        return LONG
    if all(is_num(t) for t in real):
        return DOUBLE
    if all(is_list(t) for t in real):
        inner = common([t.elementType for t in real])
        return None if inner is None else T.ArrayType(inner)
    if all(is_map(t) for t in real):
        names = dict.fromkeys(n for t in real for n in t.names)
        inner = {n: common([t[n].dataType for t in real if n in t.names]) for n in names}
        return None if None in inner.values() else T.StructType([T.StructField(n, x) for n, x in inner.items()])
    return None


def cast(v: Value, kind: T.DataType) -> Value:
    if v.type == kind:
        return v
    if is_map(v.type) and is_map(kind):
        return struct_of({f.name: cast(field(v, f.name), f.dataType) if f.name in v.type.names else typed(F.lit(None).cast(f.dataType), f.dataType) for f in kind})
    return Value(v.col.cast(kind), v.ghost.cast(kind), kind)


def listed(items: list[Value]) -> Value:
    """A list; numbers widen, and members of types that have nothing in common raise, since a column has one type."""
    kind = common([x.type for x in items])
    if kind is None:
        raise Unsupported("MixedTypes", f"a list of {', '.join(x.type.simpleString() for x in items)}")
    items = [cast(x, kind) for x in items]
    if not items:
        c = F.array().cast(T.ArrayType(STRING))
        return Value(c, c, T.ArrayType(NULL))
    return apply(lambda *c: F.array(*c), *items, kind=T.ArrayType(kind))


def field(v: Value, name: str) -> Value:
    return apply(lambda c: c.getField(name), v, kind=v.type[name].dataType)


def equal(a: Value, b: Value) -> Value:
    """Ternary equality: numbers by value, lists and maps member by member, entities by id, other mixes false."""
    if is_null(a.type) or is_null(b.type):
        return Value(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), BOOL)
    if is_num(a.type) and is_num(b.type):
        if is_int(a.type) and is_int(b.type):
            return apply(lambda x, y: x == y, a, b, kind=BOOL)
        return apply(lambda x, y: (x.cast("double") == y.cast("double")) & ~F.isnan(x.cast("double")), a, b, kind=BOOL)
    if is_list(a.type) and is_list(b.type):
        ea, eb = (T.StringType() if is_null(t.elementType) else t.elementType for t in (a.type, b.type))

        def same(x, y, deep):
            each = F.zip_with(x, y, lambda p, q: equal(Value(p, F.lit(None).cast(ea), ea), Value(q, F.lit(None).cast(eb), eb)).col)
            whole = F.aggregate(each, F.lit(True), lambda acc, v: acc & v)
            return F.when(F.size(x) != F.size(y), F.lit(False)).when(x.isNull() | y.isNull(), F.lit(None)).otherwise(whole)

        return apply(lambda x, y: same(x, y, 0), a, b, kind=BOOL)
    if is_entity(a.type) and is_entity(b.type):
        if is_path(a.type):
            ids = lambda v: apply(lambda c: F.transform(c.getField("relationships"), lambda r: r.getField("id")), v, kind=T.ArrayType(LONG))
            return equal(ids(a), ids(b))
        return equal(field(a, "id"), field(b, "id")) if is_node(a.type) == is_node(b.type) else never(a, b)
    if is_map(a.type) and is_map(b.type):
        if set(a.type.names) != set(b.type.names):
            return never(a, b)
        out = lit(True)
        for n in a.type.names:
            out = apply(lambda x, y: x & y, out, equal(field(a, n), field(b, n)), kind=BOOL)
        return apply(lambda x, y, o: F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(o), a, b, out, kind=BOOL)
    if type(a.type) is type(b.type) and (not isinstance(a.type, T.StructType) or a.type == b.type):
        return apply(lambda x, y: x == y, a, b, kind=BOOL)
    return never(a, b)


def never(a: Value, b: Value) -> Value:
    """False where both are there, else null."""
    return apply(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.lit(False)), a, b, kind=BOOL)


def ordered(op: str, a: Value, b: Value) -> Value:
    """<, <=, > or >=; null where the types can't be compared."""
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if is_num(a.type) and is_num(b.type):
        if is_int(a.type) and is_int(b.type):
            return apply(test, a, b, kind=BOOL)
        nan = lambda x, y: F.isnan(x.cast("double")) | F.isnan(y.cast("double"))
        return apply(lambda x, y: F.when(nan(x, y) & x.isNotNull() & y.isNotNull(), F.lit(False)).otherwise(test(x, y)), a, b, kind=BOOL)
    comparable = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.ArrayType)
    if type(a.type) is type(b.type) and isinstance(a.type, comparable):
        return apply(test, a, b, kind=BOOL)
    return Value(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), BOOL)
