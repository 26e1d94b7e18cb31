"""The public surface: a database of one graph, its queries and transactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from .errors import translated
from .graph import Graph
from .operators.procedures import Procedure
from .operators.writes import changes, execute
from .plans.parser import parse


@dataclass
class Result:
    """Rows of a statement, and what it changed."""

    df: DataFrame | None
    counters: dict[str, int] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def __iter__(self) -> Iterator[Row]:
        if self.df is not None:
            with translated():
                yield from self.df.toLocalIterator()

    def collect(self) -> list[Row]:
        with translated():
            return self.df.collect() if self.df is not None else []

    def single(self) -> Row:
        with translated():
            rows = self.df.limit(2).collect() if self.df is not None else []
        if len(rows) != 1:
            raise ValueError(f"one row was expected, {'none' if not rows else 'more'} came")
        return rows[0]


class Transaction:
    """Statements on a graph of their own, which commit puts in place."""

    def __init__(self, db: Database):
        self.db, self.graph, self.open = db, db.graph.copy(), True

    def run(self, text: str, params: dict | None = None) -> Result:
        if not self.open:
            raise RuntimeError("the transaction is closed")
        with translated():
            self.graph, df, counters = execute(self.graph, text, params)
        return Result(df, counters)

    def commit(self) -> None:
        self.db.graph, self.open = self.graph, False

    def rollback(self) -> None:
        self.open = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.rollback() if kind else self.commit()


class Database:
    """``selector_limit``: the matches that a path selector other than the shortest-path searches may list before it raises; None sets no limit."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, selector_limit: int | None = None):
        self.spark, self.graph = spark, graph or Graph(spark)
        if selector_limit is not None:
            self.graph.selector_limit = selector_limit

    def run(self, text: str, params: dict | None = None) -> Result:
        """Run one statement; an update is committed if it succeeds."""
        with translated():
            graph, df, counters = execute(self.graph, text, params)
        if changes(parse(text)):
            self.graph = graph
        return Result(df, counters)

    def begin(self) -> Transaction:
        return Transaction(self)

    def register_procedure(self, name: str, f, inputs: list[tuple[str, str]] | None = None) -> None:
        """Make ``f(spark, *arguments) -> DataFrame`` callable as ``CALL name(...)``; see ``Procedure`` for the inputs."""
        self.graph.procedures[name] = Procedure(f, None if inputs is None else tuple(inputs))

    def vector_search(self, index: str, k: int, vector: list[float]) -> DataFrame:
        return self.run("CALL db.index.vector.queryNodes($index, $k, $vector) YIELD node, score RETURN node, score", {"index": index, "k": k, "vector": vector}).df
