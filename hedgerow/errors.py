"""Errors of the query language: a class, a code and a message."""

from __future__ import annotations

import contextlib
import re


class QueryError(Exception):
    kind = "Error"

    def __init__(self, code: str, message: str = ""):
        self.code = code
        super().__init__(f"{self.kind}({code}): {message}" if message else f"{self.kind}({code})")


class QuerySyntaxError(QueryError):
    kind = "SyntaxError"


class QueryTypeError(QueryError):
    kind = "TypeError"


class ProcedureError(QueryError):
    kind = "ProcedureError"


class ParameterMissing(QueryError):
    kind = "ParameterMissing"


class Unsupported(QueryError):
    kind = "Unsupported"


class ConstraintError(QueryError):
    kind = "ConstraintValidationFailed"


class QueryArithmeticError(QueryError):
    kind = "ArithmeticError"


class EntityNotFound(QueryError):
    kind = "EntityNotFound"


def raised(kind: type[QueryError], code: str, what: str):
    """A column that raises this error where it is evaluated; ``of_spark`` recognises it."""
    from pyspark.sql import functions as F

    return F.raise_error(F.lit(f"<<{kind.kind}:{code}:{what}>>"))


def of_spark(x: Exception) -> QueryError | None:
    """The query's error behind an exception of Spark."""
    kinds = {k.kind: k for k in (QuerySyntaxError, QueryTypeError, QueryArithmeticError, EntityNotFound)}
    found = re.search(r"<<(\w+):(\w+):([^>]*)>>", str(x))
    if found and found[1] in kinds:
        return kinds[found[1]](found[2], found[3])
    if "ARITHMETIC_OVERFLOW" in str(x) or "overflow" in str(x)[:300]:
        return QueryArithmeticError("IntegerOverflow", "a number beyond 64 bits")
    return None


@contextlib.contextmanager
def translated():
    try:
        yield
    except QueryError:
        raise
    except Exception as x:
        own = of_spark(x)
        if own is None:
            raise
        raise own from x
