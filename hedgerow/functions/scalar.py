"""Scalar functions and arithmetic, chosen by the types of their arguments."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryArithmeticError, QuerySyntaxError, QueryTypeError, raised
from .values import BOOL, DOUBLE, DURATION, LONG, POINT, STRING, Value, apply, cast, common, equal, field, is_entity, is_int, is_list, is_map, is_node, is_null, is_num, is_path, is_rel, is_temporal, lit, listed, struct_of

#: Fixed value: the radius of the sphere for distances on the earth, in metres.
EARTH = 6378140.0
#: Coordinate systems by SRID.
CRS = {7203: "cartesian", 9157: "cartesian-3d", 4326: "wgs-84", 4979: "wgs-84-3d"}
_WHITE = r"[\s\p{Z}\u0085\x1c-\x1f]+"


def text_of(v: Value) -> Value:
    return cast(v, STRING) if v.type != STRING else v


def wrong(what: str, *args: Value):
    return QueryTypeError("InvalidArgumentType", f"{what}: {', '.join(a.type.simpleString() for a in args)}")


def add(a: Value, b: Value) -> Value:
    ta, tb = a.type, b.type
    if is_list(ta) or is_list(tb):
        if is_null(ta) or is_null(tb):
            return Value(F.lit(None), F.lit(None), T.NullType())
        lists = [x if is_list(x.type) else listed([x]) for x in (a, b)]
        inner = common([x.type.elementType for x in lists]) or STRING
        kind = T.ArrayType(STRING if is_null(inner) else inner)
        return apply(lambda x, y: F.concat(x, y), *[cast(x, kind) for x in lists], kind=kind)
    if is_null(ta) or is_null(tb):
        return Value(F.lit(None), F.lit(None), T.NullType())
    if is_num(ta) and is_num(tb):
        return numbers(lambda x, y: x + y, a, b)
    if T.StringType in (type(ta), type(tb)) and all(isinstance(t, (T.StringType, T.BooleanType)) or is_num(t) for t in (ta, tb)):
        return apply(lambda x, y: F.concat(x, y), text_of(a), text_of(b), kind=STRING)
    if is_temporal(ta) and tb == DURATION:
        return shifted(a, b, 1)
    if ta == DURATION and is_temporal(tb):
        return shifted(b, a, 1)
    if ta == DURATION and tb == DURATION:
        return struct_of({n: apply(lambda x, y: x + y, field(a, n), field(b, n), kind=LONG) for n in DURATION.names})
    raise wrong("+", a, b)


def subtract(a: Value, b: Value) -> Value:
    if is_temporal(a.type) and b.type == DURATION:
        return shifted(a, b, -1)
    if a.type == DURATION and b.type == DURATION:
        return struct_of({n: apply(lambda x, y: x - y, field(a, n), field(b, n), kind=LONG) for n in DURATION.names})
    return numbers(lambda x, y: x - y, a, b)


def numbers(f, a: Value, b: Value, what: str = "arithmetic") -> Value:
    if is_null(a.type) or is_null(b.type):
        return Value(F.lit(None), F.lit(None), T.NullType())
    if not (is_num(a.type) and is_num(b.type)):
        raise wrong(what, a, b)
    kind = LONG if is_int(a.type) and is_int(b.type) else DOUBLE
    return apply(f, cast(a, kind), cast(b, kind), kind=kind)


def _divisor(y):
    return F.when(y == 0, raised(QueryArithmeticError, "DivisionByZero", "/ by zero").cast("long")).otherwise(y)


def divide(a: Value, b: Value) -> Value:
    if is_int(a.type) and is_int(b.type):
        # exact for all longs: the remainder is taken off first, so the quotient is whole
        return apply(lambda x, y: ((x - x % _divisor(y)).cast("decimal(20,0)") / _divisor(y).cast("decimal(20,0)")).cast("long"), cast(a, LONG), cast(b, LONG), kind=LONG)

    def real(x, y):
        by_zero = F.when(F.isnan(x) | (x == 0), F.lit(math.nan)).when((x > 0), F.lit(math.inf)).otherwise(F.lit(-math.inf))
        return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, by_zero).otherwise(x / y)

    return numbers(real, a, b, "/")


def modulo(a: Value, b: Value) -> Value:
    if is_int(a.type) and is_int(b.type):
        return numbers(lambda x, y: x % _divisor(y), a, b)
    return numbers(lambda x, y: F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, F.lit(math.nan)).otherwise(x % y), a, b)


def multiply(a: Value, b: Value) -> Value:
    for d, k in ((a, b), (b, a)):
        if d.type == DURATION and is_num(k.type):
            return struct_of({n: apply(lambda x, y: (x * y).cast("long"), field(d, n), k, kind=LONG) for n in DURATION.names})
    return numbers(lambda x, y: x * y, a, b, "*")


def power(a: Value, b: Value) -> Value:
    return numbers(lambda x, y: F.pow(x, y), cast(a, DOUBLE), cast(b, DOUBLE), "^")


def shifted(t: Value, d: Value, sign: int) -> Value:
    """A date or time moved by a duration: months (clamped to the month's end), then days, then the time part."""

    def move(x, u):
        months, days = u.getField("months") * sign, u.getField("days") * sign
        seconds, nanos = u.getField("seconds") * sign, u.getField("nanos") * sign
        if isinstance(t.type, T.DateType):
            return F.date_add(F.add_months(x, months.cast("int")), (days + (seconds / 86400).cast("long")).cast("int"))
        day = F.date_add(F.add_months(x.cast("date"), months.cast("int")), days.cast("int"))
        micros = F.unix_micros(x.cast("timestamp")) - F.unix_micros(x.cast("date").cast("timestamp")) + seconds * 1000000 + (nanos / 1000).cast("long")
        return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros).cast(t.type)

    return apply(move, t, d, kind=t.type)


def real(f, domain=None):
    """A function of a float; outside ``domain`` the IEEE result instead of null."""

    def run(v: Value) -> Value:
        if not (is_num(v.type) or is_null(v.type)):
            raise wrong("a number is needed", v)
        v = cast(v, DOUBLE)
        return apply(lambda c: F.when(c.isNull(), F.lit(None)).otherwise(domain(c, f(c)) if domain else f(c)), v, kind=DOUBLE)

    return run


def _log(c, value):
    return F.when(c < 0, F.lit(math.nan)).when(c == 0, F.lit(-math.inf)).otherwise(value)


def round_(v: Value, places: Value | None = None, mode: Value | None = None) -> Value:
    """Half away from zero, of the number times a power of ten; a mode is accepted and changes nothing."""
    if not is_num(v.type):
        raise wrong("round()", v)
    if places is None:
        return apply(lambda c: F.round(c, 0), cast(v, DOUBLE), kind=DOUBLE)
    if not (is_int(places.type) or is_null(places.type)):
        raise wrong("round() places", places)

    def shifted_(c, p):
        scale = F.pow(F.lit(10.0), p)
        return F.when(p.isNotNull(), F.when(F.isnan(c) | (F.abs(c) == math.inf), c).otherwise(F.round(c * scale, 0) / scale))

    return apply(shifted_, cast(v, DOUBLE), cast(places, LONG), kind=DOUBLE)


def _count(what: str):
    """A length or place that must not be negative, as an int."""
    def run(n):
        return F.when(n < 0, raised(QuerySyntaxError, "NegativeIntegerArgument", what).cast("int")).otherwise(F.least(n, F.lit(1 << 30)).cast("int"))

    return run


def part_of(side: str):
    def run(v: Value, n: Value) -> Value:
        if not is_int(n.type) and not is_null(n.type):
            raise wrong(f"{side}()", v, n)
        size = _count(f"{side}()")
        pick = (lambda c, k: F.substring(c, F.lit(1), size(k))) if side == "left" else (lambda c, k: F.when(size(k) == 0, F.lit("")).otherwise(F.right(c, size(k))))
        return strings(pick, 1)(v, cast(n, LONG))

    return run


def substring(v: Value, start: Value, n: Value | None = None) -> Value:
    for x in (start, n):
        if x is not None and not (is_int(x.type) or is_null(x.type)):
            raise wrong("substring()", v, x)
    size = _count("substring()")
    if n is None:
        return strings(lambda c, a: F.substring(c, size(a) + 1, F.lit(1 << 30)), 1)(v, cast(start, LONG))
    return strings(lambda c, a, k: F.substring(c, size(a) + 1, size(k)), 1)(v, cast(start, LONG), cast(n, LONG))


def length(v: Value) -> Value:
    if isinstance(v.type, T.StringType):
        return apply(lambda c: F.char_length(c).cast("long"), v, kind=LONG)
    if is_list(v.type):
        return apply(lambda c: F.when(c.isNotNull(), F.size(c)).cast("long"), v, kind=LONG)
    if is_path(v.type):
        return apply(lambda c: F.size(c.getField("relationships")).cast("long"), v, kind=LONG)
    if is_null(v.type):
        return lit(None)
    raise wrong("size() or length()", v)


def element(v: Value, i) -> Value:
    return apply(lambda c: F.try_element_at(c, F.lit(i)), v, kind=v.type.elementType)


def index(v: Value, i: Value) -> Value:
    if is_list(v.type):
        at = apply(lambda k: F.when(k >= 0, k + 1).otherwise(k).cast("int"), i, kind=T.IntegerType())
        return apply(lambda c, k: F.try_element_at(c, k), v, at, kind=v.type.elementType)
    raise wrong("[]", v, i)


def slice_(v: Value, low: Value | None, high: Value | None) -> Value:
    n = lambda c: F.size(c)
    place = lambda c, k: F.greatest(F.lit(0), F.least(F.when(k < 0, n(c) + k).otherwise(k), n(c))).cast("int")
    low, high = low or lit(0), high or length(v)
    cut = lambda c, a, b: F.when(a.isNull() | b.isNull() | c.isNull(), F.lit(None)).otherwise(F.slice(c, place(c, a) + 1, F.greatest(F.lit(0), place(c, b) - place(c, a))))
    return apply(cut, v, low, high, kind=v.type)


def range_(a: Value, b: Value, step: Value | None = None) -> Value:
    step = step or lit(1)
    fits = lambda x, y, s: F.when(((s > 0) & (x <= y)) | ((s < 0) & (x >= y)), F.sequence(x, y, s)).otherwise(F.array().cast("array<bigint>"))
    return apply(fits, *[cast(x, LONG) for x in (a, b, step)], kind=T.ArrayType(LONG))


def to_integer(v: Value) -> Value:
    if isinstance(v.type, T.StringType):
        return apply(lambda c: F.coalesce(c.try_cast("bigint"), F.when(~F.isnan(c.try_cast("double")), c.try_cast("double").try_cast("bigint"))), v, kind=LONG)
    if is_num(v.type) or isinstance(v.type, T.BooleanType) or is_null(v.type):
        return cast(v, LONG)
    raise wrong("toInteger()", v)


def to_float(v: Value) -> Value:
    if isinstance(v.type, T.StringType):
        return apply(lambda c: c.try_cast("double"), v, kind=DOUBLE)
    if is_num(v.type) or is_null(v.type):
        return cast(v, DOUBLE)
    raise wrong("toFloat()", v)


def to_boolean(v: Value) -> Value:
    if isinstance(v.type, T.StringType):
        return apply(lambda c: F.when(F.lower(F.trim(c)) == "true", True).when(F.lower(F.trim(c)) == "false", False), v, kind=BOOL)
    if is_int(v.type):
        return apply(lambda c: c != 0, v, kind=BOOL)
    if isinstance(v.type, T.BooleanType) or is_null(v.type):
        return cast(v, BOOL)
    raise wrong("toBoolean()", v)


def to_string(v: Value) -> Value:
    if v.type == DURATION:
        return apply(lambda c: F.concat(F.lit("P"), c.getField("months"), F.lit("M"), c.getField("days"), F.lit("DT"), c.getField("seconds"), F.lit("S")), v, kind=STRING)
    if isinstance(v.type, (T.StringType, T.BooleanType)) or is_num(v.type) or is_temporal(v.type) or is_null(v.type):
        return text_of(v)
    raise wrong("toString()", v)


def or_null(f):
    def run(v: Value) -> Value:
        try:
            return f(v)
        except QueryTypeError:
            return lit(None)

    return run


def each(f):
    """A conversion of every member of a list, null where it fails."""

    def run(v: Value) -> Value:
        if is_null(v.type):
            return lit(None)
        kind = v.type.elementType
        probe = or_null(f)(Value(F.lit(None).cast(kind), F.lit(None).cast(kind), kind))
        return apply(lambda c: F.transform(c, lambda x: or_null(f)(Value(x, F.lit(None).cast(kind), kind)).col), v, kind=T.ArrayType(probe.type))

    return run


def trimmed(side: str):
    def run(v: Value, chars: Value | None = None) -> Value:
        if chars is not None:
            return apply(lambda c, k: {"btrim": F.btrim, "ltrim": F.ltrim, "rtrim": F.rtrim}[side](c, k), v, chars, kind=STRING)
        pattern = {"btrim": f"^{_WHITE}|{_WHITE}$", "ltrim": f"^{_WHITE}", "rtrim": f"{_WHITE}$"}[side]
        return apply(lambda c: F.regexp_replace(c, pattern, ""), v, kind=STRING)

    return run


def split(v: Value, by: Value) -> Value:
    quote = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    if is_list(by.type):
        return apply(lambda c, d: F.split(c, F.array_join(F.transform(d, quote), "|")), v, by, kind=T.ArrayType(STRING))
    return apply(lambda c, d: F.when(d == "", F.filter(F.split(c, ""), lambda x: x != "")).otherwise(F.split(c, quote(d))), v, by, kind=T.ArrayType(STRING))


def _normal_forms(s: pd.Series, f: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize(k, x) for x, k in zip(s, f, strict=True)], dtype=object)


def normalize(v: Value, form: Value | None = None) -> Value:
    if not (isinstance(v.type, T.StringType) or is_null(v.type)):
        raise wrong("normalize()", v)
    run = F.pandas_udf(_normal_forms, "string")
    return apply(lambda c, k: run(c, k), text_of(v), form or lit("NFC"), kind=STRING)


def keys(v: Value) -> Value:
    inner = field(v, "properties") if is_node(v.type) or is_rel(v.type) else v
    names = sorted(inner.type.names)
    if not (is_node(v.type) or is_rel(v.type)):
        return listed([lit(n) for n in names])
    pick = lambda c: F.filter(F.array(*[F.when(c.getField(n).isNotNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    return apply(pick, inner, kind=T.ArrayType(STRING))


def property_of(v: Value, name: str) -> Value:
    if is_null(v.type):
        return lit(None)
    if is_node(v.type) or is_rel(v.type):
        inner = field(v, "properties")
        return field(inner, name) if name in inner.type.names else lit(None)
    if v.type == POINT:
        name = {"longitude": "x", "latitude": "y", "height": "z"}.get(name, name)
        if name == "crs":
            return apply(lambda c: F.create_map(*[F.lit(x) for kv in CRS.items() for x in kv])[c.getField("srid")], v, kind=STRING)
        return field(v, name)
    if v.type == DURATION:
        return duration_part(v, name)
    if isinstance(v.type, T.StructType):
        return field(v, name) if name in v.type.names else lit(None)
    if is_temporal(v.type):
        return temporal_part(v, name)
    raise wrong(f"property {name}", v)


def temporal_part(v: Value, name: str) -> Value:
    ts = lambda c: c.cast("timestamp")
    parts = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "ordinalDay": F.dayofyear,
        "weekDay": lambda c: F.weekday(c) + 1, "dayOfWeek": lambda c: F.weekday(c) + 1, "weekYear": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
        "dayOfQuarter": lambda c: F.datediff(c.cast("date"), F.trunc(c.cast("date"), "quarter")) + 1,
        "hour": lambda c: F.hour(ts(c)), "minute": lambda c: F.minute(ts(c)), "second": lambda c: F.second(ts(c)),
        "millisecond": lambda c: F.pmod(F.unix_millis(ts(c)), F.lit(1000)), "microsecond": lambda c: F.pmod(F.unix_micros(ts(c)), F.lit(1000000)),
        "nanosecond": lambda c: F.pmod(F.unix_micros(ts(c)), F.lit(1000000)) * 1000, "epochSeconds": lambda c: F.unix_seconds(ts(c)), "epochMillis": lambda c: F.unix_millis(ts(c)),
    }
    if name not in parts:
        raise QueryTypeError("InvalidArgumentValue", f"no component {name}")
    return apply(lambda c: parts[name](c).cast("long"), v, kind=LONG)


def duration_part(v: Value, name: str) -> Value:
    m, d, s, n = (lambda k: lambda c: c.getField(k))("months"), (lambda c: c.getField("days")), (lambda c: c.getField("seconds")), (lambda c: c.getField("nanos"))
    whole = lambda x: x.cast("long")
    parts = {
        "years": lambda c: whole(m(c) / 12), "quarters": lambda c: whole(m(c) / 3), "months": m, "monthsOfYear": lambda c: m(c) % 12, "quartersOfYear": lambda c: whole(m(c) % 12 / 3), "monthsOfQuarter": lambda c: m(c) % 3,
        "weeks": lambda c: whole(d(c) / 7), "days": d, "daysOfWeek": lambda c: d(c) % 7, "hours": lambda c: whole(s(c) / 3600), "minutes": lambda c: whole(s(c) / 60), "seconds": s,
        "minutesOfHour": lambda c: whole(s(c) / 60) % 60, "secondsOfMinute": lambda c: s(c) % 60, "milliseconds": lambda c: s(c) * 1000 + whole(n(c) / 1000000), "microseconds": lambda c: s(c) * 1000000 + whole(n(c) / 1000), "nanoseconds": lambda c: s(c) * 1000000000 + n(c), "nanosecondsOfSecond": n,
    }
    if name not in parts:
        raise QueryTypeError("InvalidArgumentValue", f"no component {name}")
    return apply(parts[name], v, kind=LONG)


DATE_KEYS = ("year", "quarter", "month", "week", "day", "dayOfWeek", "ordinalDay", "dayOfQuarter")
TIME_KEYS = ("hour", "minute", "second", "millisecond", "microsecond", "nanosecond")


def _int(c):
    return c.cast("int")


def _monday(year):
    """The Monday of a year's first ISO week."""
    fourth = F.make_date(_int(year), F.lit(1), F.lit(4))
    return F.date_sub(fourth, F.weekday(fourth))


def date_of(get, base=None):
    """A date column from components: ``get(name)`` is a column or None; ``base`` is a date that fills in what is not given."""
    given = {k: get(k) for k in DATE_KEYS if get(k) is not None}
    part = lambda k, f, default: given.get(k, f(base) if base is not None else F.lit(default))
    if "week" in given or "dayOfWeek" in given:
        year = part("year", lambda d: F.extract(F.lit("YEAROFWEEK"), d), 1970)
        days = (part("week", F.weekofyear, 1) - 1) * 7 + part("dayOfWeek", lambda d: F.weekday(d) + 1, 1) - 1
        return F.date_add(_monday(year), _int(days))
    year = part("year", F.year, 1970)
    if "ordinalDay" in given:
        return F.date_add(F.make_date(_int(year), F.lit(1), F.lit(1)), _int(given["ordinalDay"] - 1))
    if "quarter" in given or "dayOfQuarter" in given:
        first = F.make_date(_int(year), _int((part("quarter", F.quarter, 1) - 1) * 3 + 1), F.lit(1))
        if "dayOfQuarter" in given or base is None:
            return F.date_add(first, _int(given.get("dayOfQuarter", F.lit(1)) - 1))
        month = (given["quarter"] - 1) * 3 + (F.month(base) - 1) % 3 + 1
        return F.make_date(_int(year), _int(month), _int(part("day", F.dayofmonth, 1)))
    return F.make_date(_int(year), _int(part("month", F.month, 1)), _int(part("day", F.dayofmonth, 1)))


def parsed_date(c):
    """A date from an ISO form: calendar, week, quarter or ordinal, extended or basic; null where it is none of them."""
    group = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
    week, quarter, day, month = r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", r"^(\d{4})-?Q(\d)(?:-?(\d{1,2}))?$", r"^(\d{4})-?(\d{3})$", r"^(\d{4})-(\d{2})$|^(\d{4})(\d{2})$"
    at = lambda p, **names: date_of(lambda k: F.coalesce(group(p, names[k]), F.lit(1)) if k in names else None)
    full = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    out = F.when(c.rlike(week), at(week, year=1, week=2, dayOfWeek=3)).when(c.rlike(quarter), at(quarter, year=1, quarter=2, dayOfQuarter=3)).when(c.rlike(day), at(day, year=1, ordinalDay=2))
    out = out.when(c.rlike(month), F.make_date(F.coalesce(group(month, 1), group(month, 3)), F.coalesce(group(month, 2), group(month, 4)), F.lit(1)))
    return out.when(c.rlike(r"^\d{4}$"), F.make_date(group(r"^(\d{4})$", 1), F.lit(1), F.lit(1))).when(full.rlike(r"^\d{4}-\d{2}-\d{2}$"), full.try_cast("date"))


def _text_needed(c, out, what: str, kind: str):
    return F.when(c.isNotNull() & out.isNull(), raised(QueryTypeError, "InvalidArgumentValue", f"no {what}").cast(kind)).otherwise(out)


def _map_parts(v: Value, keys: tuple, what: str):
    """(column of a component by name, base value) of a map of components."""
    unknown = [n for n in v.type.names if n not in (*keys, "date", "time", "datetime", "timezone")]
    if unknown:
        raise QueryTypeError("InvalidArgumentValue", f"no component {unknown[0]} of {what}")
    base = next((field(v, n) for n in ("datetime", "date", "time") if n in v.type.names), None)
    if base is not None and not is_temporal(base.type):
        raise wrong(f"{what}()", base)
    return base


def date(v: Value | None = None) -> Value:
    kind = T.DateType()
    if v is None:
        return apply(lambda: F.current_date(), kind=kind)
    if is_map(v.type):
        base = _map_parts(v, DATE_KEYS, "date")
        names = v.type.names
        make = lambda c: date_of(lambda k: c.getField(k).cast("int") if k in names else None, None if base is None else c.getField("datetime" if "datetime" in names else "date").cast("date"))
        return apply(make, v, kind=kind)
    if isinstance(v.type, T.StringType):
        return apply(lambda c: _text_needed(c, parsed_date(c), "date", "date"), v, kind=kind)
    if not (is_temporal(v.type) or is_null(v.type)):
        raise wrong("date()", v)
    return cast(v, kind)


def _micros_of_day(c):
    return F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(86_400_000_000))


def stamp(kind: T.DataType):
    """datetime() or localdatetime(); instants are kept to the microsecond, and a zone only moves them."""
    zoned = isinstance(kind, T.TimestampType)

    def of_map(v: Value) -> Value:
        base, names = _map_parts(v, (*DATE_KEYS, *TIME_KEYS), "datetime"), v.type.names

        def make(c):
            get = lambda k: c.getField(k).cast("long") if k in names else None
            whole = next((c.getField(n) for n in ("datetime", "date") if n in names), None)
            clock = next((c.getField(n) for n in ("datetime", "time") if n in names), None)
            day = date_of(get, None if whole is None else whole.cast("date"))
            old = F.lit(0) if clock is None else _micros_of_day(clock)
            units = {"hour": (3_600_000_000, 24), "minute": (60_000_000, 60), "second": (1_000_000, 60)}
            micros = F.lit(0).cast("long")
            for k, (size, many) in units.items():
                micros = micros + (get(k) if k in names else F.floor(old / size) % many) * size
            rest = [get(k) * n for k, n in (("millisecond", 1000), ("microsecond", 1)) if k in names] + ([F.floor(get("nanosecond") / 1000)] if "nanosecond" in names else [])
            for x in rest or [old % 1_000_000]:
                micros = micros + x
            out = F.timestamp_micros((F.unix_micros(day.cast("timestamp")) + micros).cast("long"))
            out = F.to_utc_timestamp(out, c.getField("timezone")) if zoned and "timezone" in names else out
            return out.cast(kind)

        return apply(make, v, kind=kind)

    def of_text(c):
        day, clock = F.split_part(c, F.lit("T"), F.lit(1)), F.split_part(c, F.lit("T"), F.lit(2))
        pattern = r"^(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d+))?(Z|[+-]\d{2}(?::?\d{2})?)?(?:\[(.+)\])?$"
        group = lambda k: F.regexp_extract(clock, pattern, k)
        number = lambda k: F.coalesce(group(k).try_cast("long"), F.lit(0))
        micros = (number(1) * 3600 + number(2) * 60 + number(3)) * 1_000_000 + F.rpad(F.substring(F.concat(group(4), F.lit("000000")), 1, 6), 6, "0").cast("long")
        local = F.timestamp_micros(F.unix_micros(parsed_date(day).cast("timestamp")) + micros)
        if zoned:
            shift = F.when(group(5).isin("", "Z"), F.lit(0)).otherwise((F.substring(group(5), 2, 2).try_cast("long") * 60 + F.coalesce(F.right(group(5), F.lit(2)).try_cast("long"), F.lit(0)) * (F.length(group(5)) > 3).cast("long")) * F.when(F.startswith(group(5), F.lit("-")), -60).otherwise(60))
            local = F.when(group(6) != "", F.to_utc_timestamp(local, F.when(group(6) != "", group(6)).otherwise("UTC"))).otherwise(F.timestamp_micros(F.unix_micros(local) - shift * 1_000_000))
        return _text_needed(c, F.when((clock == "") | clock.rlike(pattern), local), "datetime", "timestamp").cast(kind)

    def run(v: Value | None = None) -> Value:
        if v is None:
            return apply(lambda: F.current_timestamp().cast(kind), kind=kind)
        if is_map(v.type):
            return of_map(v)
        if isinstance(v.type, T.StringType):
            return apply(of_text, v, kind=kind)
        if not (is_temporal(v.type) or is_null(v.type)):
            raise wrong("datetime()", v)
        return cast(v, kind)

    return run


#: Units of a duration's months, days, seconds and nanoseconds.
_UNITS = (
    {"years": 12, "quarters": 3, "months": 1}, {"weeks": 7, "days": 1}, {"hours": 3600, "minutes": 60, "seconds": 1}, {"milliseconds": 1000000, "microseconds": 1000, "nanoseconds": 1},
)
_MONTH_DAYS = 30.436875  # of the average Gregorian month
_DURATION_TEXT = r"^P(?=.)(-?\d+(\.\d+)?[YMWD])*(T(-?\d+(\.\d+)?[HMS])+)?$"


def _cascaded(months, days, seconds, nanos):
    """A duration of amounts with fractions: of a month they become days, of a day seconds; less than a nanosecond is cut off."""
    cut_off = lambda x: F.signum(x) * F.floor(F.abs(x) + 1e-9)
    whole_months = cut_off(months)
    days = days + (months - whole_months) * _MONTH_DAYS
    whole_days = cut_off(days)
    more = F.round((days - whole_days) * 86400, 9)
    whole_seconds = F.floor(seconds) + F.floor(more)
    rest = F.round((seconds - F.floor(seconds) + more - F.floor(more)) * 1e9) + nanos
    parts = (whole_months, whole_days, whole_seconds + F.floor(rest / 1e9), F.pmod(rest, F.lit(1e9)))
    return F.struct(*[x.cast("long").alias(n) for x, n in zip(parts, DURATION.names, strict=True)])


def duration(v: Value) -> Value:
    if is_map(v.type):
        names = v.type.names
        unknown = [n for n in names if not any(n in units for units in _UNITS)]
        if unknown:
            raise QueryTypeError("InvalidArgumentValue", f"no component {unknown[0]} of duration")

        def make(c):
            total = lambda units: sum((c.getField(n).cast("double") * k for n, k in units.items() if n in names), F.lit(0.0))
            return _cascaded(*[total(units) for units in _UNITS])

        return apply(make, v, kind=DURATION)

    def parse(c):
        date_part, time_part = F.split_part(F.substring(c, 2, 1 << 20), F.lit("T"), F.lit(1)), F.split_part(c, F.lit("T"), F.lit(2))
        get = lambda s, unit: F.coalesce(F.regexp_extract(s, rf"(-?\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
        seconds = get(time_part, "H") * 3600 + get(time_part, "M") * 60 + get(time_part, "S")
        out = _cascaded(get(date_part, "Y") * 12 + get(date_part, "M"), get(date_part, "W") * 7 + get(date_part, "D"), seconds, F.lit(0.0))
        bad = raised(QueryTypeError, "InvalidArgumentValue", "no duration").cast(DURATION)
        return F.when(c.isNull(), F.lit(None)).when(c.rlike(_DURATION_TEXT), out).otherwise(bad)

    return apply(parse, v, kind=DURATION)


def struct_sum(terms) -> Value:
    out = lit(0)
    for v, k in terms:
        out = apply(lambda a, b, k=k: (a + b * k).cast("long"), out, v, kind=LONG)
    return out


def between(unit: str | None):
    def run(a: Value, b: Value) -> Value:
        def make(x, y):
            x, y = x.cast("timestamp"), y.cast("timestamp")
            months = F.timestamp_diff("MONTH", x, y) if unit in (None, "MONTH") else F.lit(0).cast("long")
            after = F.timestamp_add("MONTH", months.cast("int"), x)
            days = F.timestamp_diff("DAY", after, y) if unit in (None, "DAY") else F.lit(0).cast("long")
            rest = F.unix_micros(y) - F.unix_micros(F.timestamp_add("DAY", days.cast("int"), after)) if unit in (None, "SECOND") else F.lit(0).cast("long")
            seconds = F.floor(rest / 1000000)
            return F.when(x.isNotNull() & y.isNotNull(), F.struct(months.alias("months"), days.alias("days"), seconds.cast("long").alias("seconds"), ((rest - seconds * 1000000) * 1000).cast("long").alias("nanos")))

        return apply(make, a, b, kind=DURATION)

    return run


def truncate(kind: T.DataType):
    def run(unit: Value, v: Value | None = None, extra: Value | None = None) -> Value:
        v = v or stamp(T.TimestampType())()
        if not (is_temporal(v.type) or is_null(v.type)):
            raise wrong("truncate()", v)

        def cut(u, c):
            t, low = c.cast("timestamp"), F.lower(u)
            years = lambda n: F.make_date(_int(F.floor(F.year(t) / n) * n), F.lit(1), F.lit(1)).cast("timestamp")
            out = raised(QueryTypeError, "InvalidArgumentValue", "an unknown unit of truncate()").cast("timestamp")
            for name in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond"):
                out = F.when(low == name, F.date_trunc(name, t)).otherwise(out)
            for name, n in (("millennium", 1000), ("century", 100), ("decade", 10)):
                out = F.when(low == name, years(n)).otherwise(out)
            out = F.when(low == "weekyear", _monday(F.extract(F.lit("YEAROFWEEK"), t)).cast("timestamp")).otherwise(out)
            return F.when(t.isNotNull(), out).cast(kind)

        whole = apply(cut, unit, v, kind=kind)
        if extra is None or is_null(extra.type) or not extra.type.names:
            return whole
        is_date = isinstance(kind, T.DateType)
        made = struct_of({n: field(extra, n) for n in extra.type.names} | {"date" if is_date else "datetime": whole})
        return (date if is_date else stamp(kind))(made)

    return run


def point(v: Value) -> Value:
    names = v.type.names
    geo = "longitude" in names or "latitude" in names
    get = lambda *ns: next((cast(field(v, n), DOUBLE) for n in ns if n in names), typed_null())
    z = get("z", "height")
    flat = not ("z" in names or "height" in names)
    srid = (4326 if flat else 4979) if geo else (7203 if flat else 9157)
    x, y = get("x", "longitude"), get("y", "latitude")
    out = struct_of({"srid": cast(field(v, "srid"), T.IntegerType()) if "srid" in names else cast(lit(srid), T.IntegerType()), "x": x, "y": y, "z": z})
    return apply(lambda o, a, b: F.when(a.isNotNull() & b.isNotNull(), o), out, x, y, kind=POINT)


def typed_null() -> Value:
    return Value(F.lit(None).cast("double"), F.lit(None).cast("double"), DOUBLE)


def distance(a: Value, b: Value) -> Value:
    if is_null(a.type) or is_null(b.type):
        return lit(None)

    def metres(p, q):
        x1, y1, x2, y2 = (F.radians(k) for k in (p.getField("x"), p.getField("y"), q.getField("x"), q.getField("y")))
        h = F.pow(F.sin((y2 - y1) / 2), F.lit(2)) + F.cos(y1) * F.cos(y2) * F.pow(F.sin((x2 - x1) / 2), F.lit(2))
        arc = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * EARTH
        square = sum((F.pow(F.coalesce(p.getField(k), F.lit(0.0)) - F.coalesce(q.getField(k), F.lit(0.0)), F.lit(2)) for k in "xyz"), F.lit(0.0))
        return F.when(p.getField("srid") == q.getField("srid"), F.when(p.getField("srid") < 5000, arc).otherwise(F.sqrt(square)))

    return apply(metres, a, b, kind=DOUBLE)


def within(p: Value, low: Value, high: Value) -> Value:
    def test(c, a, b):
        inside = lambda k: (c.getField(k) >= a.getField(k)) & (c.getField(k) <= b.getField(k))
        across = F.when((a.getField("srid") < 5000) & (a.getField("x") > b.getField("x")), (c.getField("x") >= a.getField("x")) | (c.getField("x") <= b.getField("x"))).otherwise(inside("x"))
        return across & inside("y") & F.coalesce(inside("z"), F.lit(True))

    return apply(test, p, low, high, kind=BOOL)


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda a, v: a + v)


def vector_distance(a: Value, b: Value, name: str) -> Value:
    gap = lambda f: lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: f(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)
    square = gap(lambda d: d * d)
    forms = {
        "EUCLIDEAN": lambda x, y: F.sqrt(square(x, y)), "EUCLIDEAN_SQUARED": square, "MANHATTAN": gap(F.abs), "DOT": lambda x, y: -_dot(x, y),
        "COSINE": lambda x, y: 1 - _dot(x, y) / F.sqrt(_dot(x, x) * _dot(y, y)), "HAMMING": gap(lambda d: F.when(d != 0, 1.0).otherwise(0.0)),
    }
    return apply(forms[name.upper()], a, b, kind=DOUBLE)


def square(v: Value) -> Value:
    return apply(lambda x: _dot(x, x), v, kind=DOUBLE)


def cosine(a: Value, b: Value, aa: Value | None = None, bb: Value | None = None) -> Value:
    """``aa`` and ``bb``: the squares of both vectors, if they are at hand."""
    if aa is not None:
        return apply(lambda x, y, p, q: (1 + _dot(x, y) / F.sqrt(p * q)) / 2, a, b, aa, bb, kind=DOUBLE)
    return apply(lambda x, y: (1 + _dot(x, y) / F.sqrt(_dot(x, x) * _dot(y, y))) / 2, a, b, kind=DOUBLE)


def euclidean(a: Value, b: Value) -> Value:
    d = vector_distance(a, b, "EUCLIDEAN_SQUARED")
    return apply(lambda c: 1 / (1 + c), d, kind=DOUBLE)


def coalesce(*args: Value) -> Value:
    kind = common([a.type for a in args]) or STRING
    return apply(lambda *c: F.coalesce(*c), *[cast(a, kind) for a in args], kind=kind)


def value_type(v: Value) -> Value:
    if is_null(v.type):
        return lit("NULL")
    names = ((T.BooleanType, "BOOLEAN"), (T.IntegralType, "INTEGER"), (T.NumericType, "FLOAT"), (T.StringType, "STRING"), (T.DateType, "DATE"), (T.TimestampType, "ZONED DATETIME"), (T.TimestampNTZType, "LOCAL DATETIME"), (T.ArrayType, "LIST"))
    name = "NODE" if is_node(v.type) else "RELATIONSHIP" if is_rel(v.type) else "PATH" if is_path(v.type) else "POINT" if v.type == POINT else "DURATION" if v.type == DURATION else next((n for k, n in names if isinstance(v.type, k)), "MAP")
    if name == "LIST":
        inner = v.type.elementType
        name = f"LIST<{value_type(Value(v.col, v.ghost, inner)).type and _static(inner)}>"
    return apply(lambda c: F.when(c.isNull(), F.lit("NULL")).otherwise(F.lit(name + " NOT NULL")), v, kind=STRING)


def _static(t) -> str:
    return "NOTHING" if is_null(t) else "INTEGER" if is_int(t) else "FLOAT" if is_num(t) else "STRING" if isinstance(t, T.StringType) else "BOOLEAN" if isinstance(t, T.BooleanType) else "ANY"


def nullif(a: Value, b: Value) -> Value:
    return apply(lambda x, e: F.when(~F.coalesce(e, F.lit(False)), x), a, equal(a, b), kind=a.type)


def is_empty(v: Value) -> Value:
    if is_map(v.type):
        return lit(not v.type.names)
    return apply(lambda n: n == 0, length(v), kind=BOOL)


def reverse(v: Value) -> Value:
    return apply(lambda c: F.reverse(c), v, kind=v.type)


def strings(f, n: int):
    def run(*args: Value) -> Value:
        for a in args[:n]:
            if not (isinstance(a.type, T.StringType) or is_null(a.type)):
                raise wrong("a string is needed", a)
        return apply(f, *[text_of(a) if is_null(a.type) else a for a in args], kind=STRING)

    return run


def absolute(v: Value) -> Value:
    if not is_num(v.type):
        raise wrong("abs()", v)
    return apply(lambda c: F.abs(c), cast(v, LONG) if is_int(v.type) else v, kind=LONG if is_int(v.type) else DOUBLE)


def entity_id(v: Value) -> Value:
    return field(v, "id")


FUNCTIONS = {
    "coalesce": coalesce, "nullif": nullif, "timestamp": lambda: apply(lambda: F.unix_millis(F.current_timestamp()), kind=LONG), "rand": lambda: apply(lambda: F.rand(), kind=DOUBLE),
    "e": lambda: lit(math.e), "pi": lambda: lit(math.pi), "randomuuid": lambda: apply(lambda: F.uuid(), kind=STRING),
    "size": length, "length": length, "char_length": length, "character_length": length, "isempty": is_empty, "valuetype": value_type,
    "isnan": lambda v: apply(lambda c: F.when(c.isNotNull(), F.isnan(c.cast("double"))), v, kind=BOOL),
    "id": entity_id, "elementid": lambda v: text_of(field(v, "id")), "labels": lambda v: field(v, "labels"), "type": lambda v: field(v, "type"), "keys": keys,
    "properties": lambda v: field(v, "properties") if is_entity(v.type) else v, "nodes": lambda v: field(v, "nodes"), "relationships": lambda v: field(v, "relationships"), "rels": lambda v: field(v, "relationships"),
    "head": lambda v: element(v, 1), "last": lambda v: element(v, -1), "tail": lambda v: slice_(v, lit(1), None), "reverse": reverse, "range": range_,
    "tointeger": to_integer, "toint": to_integer, "tofloat": to_float, "toboolean": to_boolean, "tostring": to_string,
    "tointegerornull": or_null(to_integer), "tofloatornull": or_null(to_float), "tobooleanornull": or_null(to_boolean), "tostringornull": or_null(to_string),
    "tointegerlist": each(to_integer), "tofloatlist": each(to_float), "tobooleanlist": each(to_boolean), "tostringlist": each(to_string),
    "abs": absolute, "sign": lambda v: apply(lambda c: F.signum(c).cast("long"), v, kind=LONG), "ceil": real(lambda c: F.ceil(c).cast("double")), "floor": real(lambda c: F.floor(c).cast("double")),
    "sqrt": real(F.sqrt), "exp": real(F.exp), "log": real(lambda c: F.log(c), _log), "ln": real(lambda c: F.log(c), _log), "log10": real(F.log10, _log),
    "sin": real(F.sin), "cos": real(F.cos), "tan": real(F.tan), "cot": real(F.cot), "asin": real(F.asin), "acos": real(F.acos), "atan": real(F.atan), "sinh": real(F.sinh), "cosh": real(F.cosh), "tanh": real(F.tanh), "coth": real(lambda c: 1 / F.tanh(c)),
    "degrees": real(F.degrees), "radians": real(F.radians), "haversin": real(lambda c: (1 - F.cos(c)) / 2), "atan2": lambda a, b: apply(lambda x, y: F.atan2(x, y), cast(a, DOUBLE), cast(b, DOUBLE), kind=DOUBLE), "round": round_,
    "tolower": strings(F.lower, 1), "lower": strings(F.lower, 1), "toupper": strings(F.upper, 1), "upper": strings(F.upper, 1), "trim": trimmed("btrim"), "btrim": trimmed("btrim"), "ltrim": trimmed("ltrim"), "rtrim": trimmed("rtrim"),
    "replace": strings(lambda c, a, b: F.replace(c, a, b), 3), "left": part_of("left"), "right": part_of("right"), "substring": substring,
    "split": split, "normalize": normalize,
    "date": date, "datetime": stamp(T.TimestampType()), "localdatetime": stamp(T.TimestampNTZType()), "duration": duration, "duration.between": between(None), "duration.inmonths": between("MONTH"), "duration.indays": between("DAY"), "duration.inseconds": between("SECOND"),
    "date.truncate": truncate(T.DateType()), "datetime.truncate": truncate(T.TimestampType()), "localdatetime.truncate": truncate(T.TimestampNTZType()),
    "date.transaction": date, "date.statement": date, "date.realtime": date, "datetime.transaction": stamp(T.TimestampType()), "datetime.statement": stamp(T.TimestampType()), "datetime.realtime": stamp(T.TimestampType()),
    "datetime.fromepoch": lambda s, n: apply(lambda a, b: F.timestamp_micros(a * 1000000 + (b / 1000).cast("long")), s, n, kind=T.TimestampType()), "datetime.fromepochmillis": lambda m: apply(lambda a: F.timestamp_millis(a), m, kind=T.TimestampType()),
    "point": point, "point.distance": distance, "distance": distance, "point.withinbbox": within,
    "vector.similarity.cosine": cosine, "vector.similarity.euclidean": euclidean, "vector_dimension_count": length,
}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "percentilecont", "percentiledisc", "stdev", "stdevp"}
