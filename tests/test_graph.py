"""Queries on a small graph, updates, errors, and the registered queries against SQL."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from hedgerow.database import Database
from hedgerow.errors import ConstraintError, EntityNotFound, ParameterMissing, ProcedureError, QueryError, QuerySyntaxError, QueryTypeError, Unsupported
from hedgerow.plans.lower import run
from hedgerow.plans.parser import parse
from hedgerow.queries import CATALOG, ORACLE_SQL, QUERIES
from hedgerow.sources.tables import star_graph

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    db = Database(spark)
    db.run("CREATE (a:P {name: 'Alice', age: 30})-[:KNOWS {since: 2001}]->(b:P {name: 'Bob', age: 41})-[:KNOWS]->(c:P {name: 'Carol'})")
    return db


def rows(db, text, **params):
    return [tuple(r) for r in db.run(text, params).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("RETURN 1 = 1.0, [1, null] = [1, null], [1, 2] = [1, 3], null IN [1], 2 IN [1, null], 1 < 'a'", [(True, None, False, None, None, None)]),
        ("RETURN 7 / 2, -7 / 2, -7 % 2, 7 / 2.0, 2 ^ 3, -3 ^ 2, 1.0 / 0.0, 0.0 / 0.0 = 0.0 / 0.0", [(3, -3, -1, 3.5, 8.0, 9.0, math.inf, False)]),
        ("RETURN 'a' + 1, 'a' + 1.0, [1] + 2, 0 + [1], 'x' || 'y'", [("a1", "a1.0", [1, 2], [0, 1], "xy")]),
        ("RETURN range(1, 0), range(3, 1, -1), [1, 2, 3][-1], [1, 2, 3][5], [1, 2, 3][1..], [1, 2, 3][..-1]", [([], [3, 2, 1], 3, None, [2, 3], [1, 2])]),
        ("RETURN toInteger('1.7'), toInteger('x'), toFloat('2'), toBoolean('TRUE'), toBoolean(0), toString(1.0)", [(1, None, 2.0, True, False, "1.0")]),
        ("RETURN all(x IN [] WHERE x > 1), any(x IN [1, null] WHERE x > 1), none(x IN [1] WHERE x > 1), single(x IN [1, 2] WHERE x > 1)", [(True, None, True, True)]),
        ("RETURN substring('hello', 1, 3), left('ab', 5), right('abc', 2), split('a.b', '.'), trim('  x '), size('héé'), toUpper('a')", [("ell", "ab", "bc", ["a", "b"], "x", 3, "A")]),
        ("RETURN date('2024-01-31') + duration('P1M') = date('2024-02-29'), date('2024-03-05').week, duration.between(date('2024-01-31'), date('2024-03-01')).months", [(True, 10, 1)]),
        ("RETURN ceil(1.2), floor(-1.2), round(2.5), round(-2.5), sign(-3), log(-1) <> log(-1), sqrt(4)", [(2.0, -2.0, 3.0, -3.0, -1, True, 2.0)]),
        ("UNWIND [null, 2, 1] AS x RETURN x ORDER BY x", [(1,), (2,), (None,)]),
        ("UNWIND [null, 2, 1] AS x RETURN x ORDER BY x DESC", [(None,), (2,), (1,)]),
        ("UNWIND [] AS x RETURN count(x), sum(x), collect(x), avg(x)", [(0, 0, [], None)]),
        ("UNWIND [1, 2, 2] AS x WITH DISTINCT x RETURN sum(x) + 1 AS s", [(4,)]),
        ("WITH {a: 1, b: {c: 2}} AS m RETURN m.b.c, m['a'], m.z, keys(m)", [(2, 1, None, ["a", "b"])]),
        ("CALL { RETURN 1 AS a UNION RETURN 2 AS a } RETURN sum(a) AS s", [(3,)]),
    ],
)
def test_expressions(people, text, want):
    assert rows(people, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name", {("Alice", "Bob"), ("Bob", "Carol")}),
        ("MATCH (a)-[r]-(b) RETURN a.name, b.name", {("Alice", "Bob"), ("Bob", "Alice"), ("Bob", "Carol"), ("Carol", "Bob")}),
        ("MATCH (a)-[:KNOWS*]->(b) RETURN a.name, b.name", {("Alice", "Bob"), ("Bob", "Carol"), ("Alice", "Carol")}),
        ("MATCH (a {name: 'Alice'})-[:KNOWS*0..1]->(b) RETURN b.name", {("Alice",), ("Bob",)}),
        ("MATCH (a)-[r]->()-[s]->(c) RETURN a.name, c.name", {("Alice", "Carol")}),
        ("MATCH (a:P) WHERE a.age IS NULL RETURN a.name", {("Carol",)}),
        ("MATCH (a:P) OPTIONAL MATCH (a)-[r:KNOWS {since: 2001}]->(b) RETURN a.name, b.name", {("Alice", "Bob"), ("Bob", None), ("Carol", None)}),
        ("MATCH (a:P) WHERE (a)-->() AND NOT (a)<--() RETURN a.name", {("Alice",)}),
        ("MATCH p = shortestPath((a {name: 'Alice'})-[*]-(c {name: 'Carol'})) RETURN length(p), [n IN nodes(p) | n.name][1]", {(2, "Bob")}),
        ("MATCH (a {name: 'Alice'})((x)-[:KNOWS]->(y)){1,2}(b) RETURN size(x), b.name", {(1, "Bob"), (2, "Carol")}),
        ("MATCH (a:P) RETURN CASE WHEN a.age > 35 THEN 'old' END AS k, count(*) AS n", {("old", 1), (None, 2)}),
        ("MATCH (a)-[r:KNOWS WHERE r.since > 2000]->(b) RETURN type(r), b.name", {("KNOWS", "Bob")}),
        ("MATCH (a)-[r:KNOWS* {since: 2001}]->(b) RETURN size(r), b.name", {(1, "Bob")}),
        ("MATCH (a) RETURN a.name, COUNT { (a)-->() } AS n", {("Alice", 1), ("Bob", 1), ("Carol", 0)}),
        ("MATCH (a:!P) RETURN a.name", set()),
    ],
)
def test_patterns(people, text, want):
    assert set(rows(people, text)) == want


@pytest.mark.parametrize(
    ("text", "kind", "code"),
    [
        ("RETURN x", QuerySyntaxError, "UndefinedVariable"),
        ("MATCH (a)-[r]->()-[r]->() RETURN 1 AS x", QuerySyntaxError, "RelationshipUniquenessViolation"),
        ("RETURN nothing(1)", QuerySyntaxError, "UnknownFunction"),
        ("MATCH (a) WITH a.name RETURN 1", QuerySyntaxError, "NoExpressionAlias"),
        ("MATCH (a) RETURN a LIMIT -1", QuerySyntaxError, "NegativeIntegerArgument"),
        ("MATCH (a) WHERE count(a) > 1 RETURN a", QuerySyntaxError, "InvalidAggregation"),
        ("MATCH (a) RETURN a.age + count(*)", QuerySyntaxError, "AmbiguousAggregationExpression"),
        ("MATCH (a) RETURN count(count(*))", QuerySyntaxError, "NestedAggregation"),
        ("RETURN 1 AS a UNION RETURN 2 AS b", QuerySyntaxError, "DifferentColumnsInUnion"),
        ("RETURN 1 AND true", QueryTypeError, "InvalidArgumentType"),
        ("RETURN $p", ParameterMissing, "MissingParameter"),
        ("MATCH (a {name: 'Alice'}) DELETE a", ConstraintError, "DeleteConnectedNode"),
        ("CREATE (a)-[:A|B]->(b)", QuerySyntaxError, "NoSingleRelationshipType"),
    ],
)
def test_errors(people, text, kind, code):
    with pytest.raises(kind) as x:
        people.run(text).collect()
    assert x.value.code == code


def test_updates_and_transactions(spark):
    db = Database(spark)
    assert db.run("UNWIND ['x', 'y', 'x'] AS k MERGE (n:Q {k: k})").counters["nodes_created"] == 2
    with db.begin() as tx:
        tx.run("MATCH (n:Q) SET n.v = 1, n:Seen")
        tx.rollback()
    assert rows(db, "MATCH (n:Q) RETURN DISTINCT labels(n)") == [(["Q"],)]
    with db.begin() as tx:
        tx.run("MATCH (n:Q {k: 'x'}) SET n += {v: 2}")
    assert set(rows(db, "MATCH (n:Q) RETURN n.k, n.v")) == {("x", 2), ("y", None)}
    db.run("CREATE CONSTRAINT u FOR (n:Q) REQUIRE n.k IS UNIQUE")
    with pytest.raises(ConstraintError):
        db.run("CREATE (:Q {k: 'x'})")
    assert rows(db, "MATCH (n:Q) RETURN count(*)") == [(2,)]
    db.run("MATCH (n:Q) DETACH DELETE n")
    assert rows(db, "MATCH (n) RETURN count(*)") == [(0,)]


def test_parse_errors():
    for text in ("", "MATCH", "RETURN 1 +", "MATCH (a RETURN a", "RETURN 1 UNION RETURN 2 UNION ALL RETURN 3"):
        with pytest.raises(QueryError):
            parse(text)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_registered_queries(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in found.description)
    place = [[d[0] for d in found.description].index(n) for n in names]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names

    def plain(v):
        return round(v, 4) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v

    ours = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert ours == sorted(repr([plain(r[k]) for k in place]) for r in found.fetchall())


@pytest.mark.parametrize("name", ["undirected", "var_length", "quantified_group", "shortest_path", "all_shortest_paths", "vector_similarity"])
def test_path_and_vector_queries_also_run_over_whole_tables(name):
    graph, sql = CATALOG[f"{name}_all"]
    for bound in ("_id <", "key <", "key: ", "key =", "_id: "):
        assert bound not in graph and (bound not in sql or "JOIN" in sql)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("RETURN date({year: 2024, week: 5, dayOfWeek: 3}) = date('2024-01-31'), date('2024-W05-3') = date({year: 2024, ordinalDay: 31}), date('2024-Q2-15') = date('20240415')", [(True, True, True)]),
        ("RETURN date.truncate('weekYear', date('2023-01-01')) = date('2022-01-03'), date.truncate('month', date('2024-05-05'), {day: 7}).day, date({date: date('2024-05-05'), quarter: 1}) = date('2024-02-05')", [(True, 7, True)]),
        ("RETURN datetime('2024-05-05T12:30:15.5+02:00') = datetime('2024-05-05T10:30:15.500Z'), datetime('2024-05-05T12:00[Europe/Berlin]') = datetime({year: 2024, month: 5, day: 5, hour: 12, timezone: '+02:00'})", [(True, True)]),
        ("RETURN normalize('e\u0301') = '\u00e9', 'abc' IS NORMALIZED, 'e\u0301' IS NOT NORMALIZED, round(2.55, 1, 'UP'), normalize(null)", [(True, True, True, 2.6, None)]),
        ("UNWIND [1, 2, 2, 3] AS x RETURN stDev(DISTINCT x), avg(DISTINCT x), percentileCont(DISTINCT x, 0.5), percentileDisc(x, 0.5), percentileDisc(DISTINCT x, 0.7)", [(1.0, 2.0, 2.0, 2, 3)]),
        ("MATCH ()-[r:KNOWS]->() WITH r ORDER BY endNode(r).name DESC RETURN collect(startNode(r).name)", [(["Bob", "Alice"],)]),
        ("MATCH (a:P) RETURN a.name, exists((a)-->()) ORDER BY a.name", [("Alice", True), ("Bob", True), ("Carol", False)]),
        ("RETURN duration({years: 1.5}).months, duration('P0.5M').days, duration({days: 1.5}).seconds, duration({hours: 1.5}).minutes", [(18, 15, 43200, 90)]),
        ("UNWIND [0, 1, 2] AS p RETURN round(1.005, p), round(-2.5, 0, 'CEILING')", [(1.0, -3.0), (1.0, -3.0), (1.0, -3.0)]),
        ("EXPLAIN MATCH (a:P) RETURN a.name AS name", []),
        ("EXPLAIN CREATE (:X)", []),
        ("MATCH (x:X) RETURN count(*)", [(0,)]),
    ],
)
def test_more_expressions(people, text, want):
    assert rows(people, text) == want


@pytest.mark.parametrize(
    ("text", "kind", "code"),
    [
        ("RETURN 5 / 0", QueryError, "DivisionByZero"),
        ("UNWIND [0] AS x RETURN 5 % x", QueryError, "DivisionByZero"),
        ("UNWIND [9223372036854775807] AS x RETURN x + 1", QueryError, "IntegerOverflow"),
        ("RETURN substring('abc', -1)", QuerySyntaxError, "NegativeIntegerArgument"),
        ("UNWIND [-1] AS n RETURN left('abc', n)", QuerySyntaxError, "NegativeIntegerArgument"),
        ("RETURN date('nonsense')", QueryTypeError, "InvalidArgumentValue"),
        ("RETURN date({year: 2024, fish: 1})", QueryTypeError, "InvalidArgumentValue"),
        ("RETURN date.truncate('fortnight', date('2024-05-05'))", QueryTypeError, "InvalidArgumentValue"),
        ("RETURN [1, 'a']", QueryError, "MixedTypes"),
        ("CREATE (a)-[:R]-(b)", QuerySyntaxError, "RequiresDirectedRelationship"),
        ("MATCH (a) RETURN size((a)-->())", QuerySyntaxError, "UnexpectedSyntax"),
        ("MATCH (a) WITH (a)-->() AS x RETURN x", QuerySyntaxError, "UnexpectedSyntax"),
        ("CALL db.labels() YIELD * RETURN 1 AS x", QuerySyntaxError, "UnexpectedSyntax"),
        ("CALL db.labels() YIELD label AS l, label AS l RETURN l", QuerySyntaxError, "VariableAlreadyBound"),
        ("CALL db.labels(1)", QuerySyntaxError, "InvalidNumberOfArguments"),
        ("MATCH (n) CALL db.index.vector.queryNodes YIELD node RETURN node", QuerySyntaxError, "InvalidArgumentPassingMode"),
        ("MATCH (a) MERGE (a)", QuerySyntaxError, "VariableAlreadyBound"),
        ("MATCH (a)-[r]->(b) CREATE (a)-[r:K]->(b)", QuerySyntaxError, "VariableAlreadyBound"),
        ("MATCH (a)-[r]->(b) MERGE (a)-[r:K]->(b)", QuerySyntaxError, "VariableAlreadyBound"),
        ("MATCH p = (a)-->(p) RETURN 1", QuerySyntaxError, "VariableAlreadyBound"),
        ("MATCH (a) MATCH ()-[a]->() RETURN 1", QuerySyntaxError, "VariableTypeConflict"),
        ("MATCH (a)-[a]->() RETURN 1", QuerySyntaxError, "VariableTypeConflict"),
        ("MATCH (a) WITH a.name AS a CREATE (a)-[:X]->()", QuerySyntaxError, "VariableTypeConflict"),
        ("USE other MATCH (n) RETURN n", Unsupported, "Administration"),
        ("CREATE OR REPLACE DATABASE other", Unsupported, "Administration"),
        ("RETURN duration({fish: 1})", QueryTypeError, "InvalidArgumentValue"),
        ("UNWIND ['nope'] AS x RETURN duration(x)", QueryTypeError, "InvalidArgumentValue"),
        ("UNWIND [1] AS x RETURN percentileDisc(x, 2)", QueryError, "NumberOutOfRange"),
    ],
)
def test_more_errors(people, text, kind, code):
    with pytest.raises(kind) as x:
        people.run(text).collect()
    assert x.value.code == code


def test_updates_in_subqueries_run_for_every_row_and_deletes_hold_at_the_end(spark):
    db = Database(spark)
    assert db.run("UNWIND [1, 1, 2] AS x CALL (x) { CREATE (:Z) }").counters["nodes_created"] == 3
    assert db.run("UNWIND [1, 1, 2] AS x CALL (*) { CREATE (:Y) }").counters["nodes_created"] == 3
    assert rows(db, "UNWIND [1, 1, 2] AS x CALL (x) { MERGE (m:M {k: x}) RETURN m } RETURN count(*), count(DISTINCT m)") == [(3, 2)]
    db.run("CREATE (:A {k: 1})-[:R]->(:B)")
    with pytest.raises(ConstraintError):
        db.run("MATCH (a:A) DELETE a")
    assert rows(db, "MATCH (a:A) RETURN a.k") == [(1,)]
    db.run("MATCH (a:A)-[r]->() DELETE a DELETE r")
    assert rows(db, "MATCH (a:A) RETURN count(*)") == [(0,)]


def test_deleted_entities_can_not_be_read(spark):
    db = Database(spark)
    db.run("CREATE (:A {k: 1})-[:R {w: 2}]->(:B)")
    for text in ("MATCH (a:A) DETACH DELETE a RETURN a.k", "MATCH (a:A) DETACH DELETE a RETURN labels(a)", "MATCH ()-[r]->() DELETE r RETURN r.w"):
        with pytest.raises(EntityNotFound):
            db.run(text).collect()
    assert rows(db, "MATCH (a:A)-[r]->() RETURN a.k, r.w") == [(1, 2)]  # a statement that fails changes nothing
    assert rows(db, "MATCH (b:Nothing) DELETE b RETURN labels(b)") == []
    assert rows(db, "MATCH (a:A)-[r]->() DELETE r CREATE (:C) RETURN type(r), a.k") == [("R", 1)]


def test_registered_procedures_hold_their_inputs(people, spark):
    def scaled(session, by, k):
        return session.createDataFrame([(by * x, k) for x in (1, 2)], "x double, k long")

    people.register_procedure("own.scaled", scaled, [("by", "FLOAT"), ("k", "INTEGER?")])
    assert rows(people, "CALL own.scaled(3, null) YIELD x RETURN x ORDER BY x") == [(3.0,), (6.0,)]
    assert sorted(rows(people, "CALL own.scaled", by=0.5, k=7)) == [(0.5, 7), (1.0, 7)]
    for text, kind in (("CALL own.scaled('a', 1)", ProcedureError), ("CALL own.scaled(null, 1)", ProcedureError), ("CALL own.scaled(1)", QuerySyntaxError), ("CALL own.scaled", ParameterMissing)):
        with pytest.raises(kind):
            rows(people, text)


def test_a_selector_may_be_limited(spark):
    db = Database(spark, selector_limit=2)
    db.run("UNWIND range(1, 3) AS x CREATE (:A)-[:R]->(:B)")
    assert rows(db, "MATCH p = shortestPath((a:A)-[:R*]->(b:B)) RETURN count(p)") == [(3,)]
    with pytest.raises(QueryError) as x:
        rows(db, "MATCH p = SHORTEST 2 (a:A)-[:R]->{1,2}(b:B) RETURN count(p)")
    assert x.value.code == "SelectorLimit"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_labels_steer_the_scans(spark):
    from hedgerow.plans.lower import run
    from hedgerow.sources.tables import star_graph

    graph = star_graph(spark, DATA)
    bounded = plan_of(run(graph, "MATCH (e:Event)-[:NEXT_EVENT*1..3]->(f:Event) WHERE e.event_id < 100 RETURN e.event_id AS e, f.event_id AS f"))
    assert bounded.count("< 100") >= 3  # at the scan, and at the sources of walks of each length
    only_rels = plan_of(run(graph, "MATCH ()-[r:CONTAINS {returnflag: 'R'}]->() RETURN count(r) AS n"))
    assert only_rels.count("Relation [") == 1 and "Join" not in only_rels
    group = plan_of(run(graph, "MATCH (e:Event)((a)-[:NEXT_EVENT]->(b)){2}(f) RETURN e.event_id AS e, f.event_id AS f, size(a) AS k"))
    assert "r_name" not in group and "embedding" not in group
    path = plan_of(run(graph, "MATCH p = (n:Nation)-[:IN_REGION]->(r) RETURN length(p) AS l, [x IN nodes(p) | x.name] AS names"))
    assert "o_orderkey" not in path and "embedding" not in path
    near = plan_of(run(graph, "MATCH (s:Supplier)-[r:IN_NATION]->(n) RETURN n.name AS name, count(r) AS k"))
    assert "c_custkey" not in near and "embedding" not in near


def test_files(spark, tmp_path):
    from hedgerow.sources import files

    db = Database(spark)
    db.run("CREATE (:P {k: 1, name: 'a,\"b'})-[:R {w: 1.5}]->(:P:Q {k: 2, ok: true})")
    db.run("CREATE CONSTRAINT u FOR (n:P) REQUIRE n.k IS UNIQUE")
    seen = "MATCH (a)-[r:R]->(b) RETURN a.name, a.k, r.w, b.k, b.ok, labels(b)"
    want = rows(db, seen)
    files.export_json(db.graph, f"{tmp_path}/j")
    again = Database(spark, files.import_json(spark, f"{tmp_path}/j"))
    assert rows(again, seen) == want
    with pytest.raises(ConstraintError):
        again.run("CREATE (:P {k: 1})")
    files.snapshot(db.graph, f"{tmp_path}/s")
    back = Database(spark, files.load_snapshot(spark, f"{tmp_path}/s"))
    assert rows(back, seen) == want
    assert back.run("CREATE (:P {k: 3})").counters["nodes_created"] == 1 and rows(back, "MATCH (n:P) RETURN count(DISTINCT id(n))") == [(3,)]
    (tmp_path / "one.json").write_text('{"nodes": [{"id": "x", "labels": ["L"], "props": {"v": 1}}, {"id": "y", "labels": []}], "edges": [{"type": "T", "startId": "x", "endId": "y"}], "schema": ["CREATE INDEX i FOR (n:L) ON (n.v)"]}')
    one = Database(spark, files.import_json(spark, f"{tmp_path}/one.json"))
    assert rows(one, "MATCH (a:L)-[:T]->(b) RETURN a.v, labels(b)") == [(1, [])] and "i" in one.graph.catalog
    for text in ('{"nodes": [{"id": "x"}, {"id": "x"}]}', '{"nodes": [{"id": "x"}], "edges": [{"type": "T", "startId": "x", "endId": "z"}]}', '{"edges": []}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(QueryError):
            files.import_json(spark, f"{tmp_path}/bad.json")
    for text in (":START_ID,:END_ID,:TYPE\n1,2,R\n", ":START_ID,:TYPE\n1,R\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(QueryError):
            files.import_csv_edges(db.graph.copy(), f"{tmp_path}/bad.csv")


def test_result_texts(people):
    import json

    from hedgerow.sources import results

    df = people.run("MATCH p = (a:P {name: 'Alice'})-[r]->(b) RETURN a, r, p, date('2024-01-31') AS d, duration('P1Y2M3DT4H5.5S') AS u, point({x: 1, y: 2}) AS o, [1, null] AS l, {k: 1.5} AS m, null AS z").df
    whole = json.loads("".join(results.document(df)))["data"]
    assert whole["fields"] == df.columns
    a, r, p, d, u, o, lst, m, z = whole["values"][0]
    assert (a["labels"], a["properties"]["name"], r["type"], r["startNodeElementId"]) == (["P"], "Alice", "KNOWS", a["elementId"])
    assert len(p) == 3 and (d, u, o, lst, m, z) == ("2024-01-31", "P1Y2M3DT4H5.5S", "SRID=7203;POINT (1.0 2.0)", [1, None], {"k": 1.5}, None)
    kinds = [c["$type"] for c in json.loads("".join(results.document(df, results.typed)))["data"]["values"][0]]
    assert kinds == ["Node", "Relationship", "Path", "Date", "Duration", "Point", "List", "Map", "Null"]
    lines = list(results.toon(people.run("MATCH (a:P) RETURN a, a.age > 35 AS old, 'x, y' AS t ORDER BY a.name").df, {"nodes_created": 2}))
    assert lines[0].startswith("rows[3]{a._id,a._labels,a.") and lines[1].endswith(',false,"x, y"') and lines[-1] == "  nodesCreated: 2"
    assert sorted(json.loads(x.value)["n"] for x in results.jsonl(people.run("MATCH (a:P) RETURN a.name AS n, null AS z").df).collect()) == ["Alice", "Bob", "Carol"]


def unreadable(graph, *types):
    """The graph with relationships of these types that can't be read."""
    for t in graph.rels:
        if t.type in types:
            t.df = t.df.withColumn("start", F.raise_error(F.lit("read")).cast("long"))
    return graph


def test_a_search_reads_only_types_that_lead_on_to_its_end(spark):
    db = Database(spark, unreadable(star_graph(spark, DATA), "PLACED", "CONTAINS", "SUPPLIED_BY", "NEXT_EVENT"))
    found = rows(db, CATALOG["shortest_path_all"][0])
    want = duckdb.sql(ORACLE_SQL["shortest_path_all"].replace("customer", f"'{DATA}/customer.parquet'").replace("nation ON", f"'{DATA}/nation.parquet' ON").replace("region ON", f"'{DATA}/region.parquet' ON")).fetchall()
    assert sorted(found) == sorted(want)
    assert len(rows(db, "MATCH (c:Customer)-[*1..2]->(r:Region) RETURN c.custkey")) == len(found)
    graph = star_graph(spark, DATA)
    for t in graph.rels:  # unknown ends: any type may lead on
        t.start_label = t.end_label = None
    assert sorted(rows(Database(spark, graph), "MATCH p = shortestPath((c:Customer)-[*..2]->(r:Region)) RETURN c.custkey, r.name, length(p)")) == sorted(want)


def test_only_the_number_of_a_path_or_list_is_asked(people):
    text = "MATCH p = (a:P {name: 'Alice'})-[r:KNOWS*1..2]->(b) RETURN b.name, length(p), size(r)%s ORDER BY b.name"
    assert rows(people, text % "") == [("Bob", 1, 1), ("Carol", 2, 2)]
    assert rows(people, text % ", [x IN r | x.since]") == [("Bob", 1, 1, [2001]), ("Carol", 2, 2, [2001, None])]
    assert rows(people, text % ", [x IN nodes(p) | x.name]") == [("Bob", 1, 1, ["Alice", "Bob"]), ("Carol", 2, 2, ["Alice", "Bob", "Carol"])]
    text = "MATCH (a:P {name: 'Alice'})((x)-[r:KNOWS]->(y)){1,2}(b) RETURN b.name, size(x), size(r)%s ORDER BY b.name"
    assert rows(people, text % "") == [("Bob", 1, 1), ("Carol", 2, 2)]
    assert rows(people, text % ", [n IN y | n.name]") == [("Bob", 1, 1, ["Bob"]), ("Carol", 2, 2, ["Bob", "Carol"])]
    assert rows(people, "MATCH p = (a)-[:KNOWS*]->(b) RETURN count(p), sum(length(p))") == [(3, 4)]
    assert rows(people, "MATCH p = (a)-[:KNOWS*]->(b) CALL (p) { RETURN length(p) AS l } RETURN sum(l)") == [(4,)]


def plan(spark, text):
    return run(star_graph(spark, DATA), text)._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_only_count_are_folded_before_a_join_multiplies_them(spark, people):
    db = Database(spark)
    db.run("UNWIND range(1, 6) AS k CREATE (:H {k: k})")
    db.run("MATCH (h:H) WHERE h.k < 3 UNWIND range(1, 4) AS i CREATE (:A {i: i})-[:TO {w: i}]->(h), (:B {i: i % 2})-[:AT]->(h)")
    text = "MATCH (a:A)-[r:TO]->(h), (b:B)-[:AT]->(h) %sRETURN h.k AS k, %s ORDER BY k"
    assert rows(db, text % ("", "count(*)")) == [(1, 16), (2, 16)]
    assert rows(db, text % ("", "count(a), count(b.x), count(DISTINCT b.i), min(r.w), max(r.w)")) == [(1, 16, 0, 2, 1, 4), (2, 16, 0, 2, 1, 4)]
    assert rows(db, text % ("WHERE a.i > b.i ", "count(*)")) == [(1, 14), (2, 14)]
    assert rows(db, text % ("", "sum(b.i), count(*)")) == [(1, 8, 16), (2, 8, 16)]
    assert rows(db, "MATCH (a:A)-[:TO]->(h)<-[:AT]-(b:B), (c:A)-[s:TO]->(h) RETURN h.k AS k, count(*) ORDER BY k") == [(1, 48), (2, 48)]
    assert rows(db, "MATCH (a:A)-[:TO]->(h)<-[:TO]-(b:A) RETURN count(*)") == [(24,)]
    assert rows(db, "MATCH (a:A), (b:B), (h:H) RETURN count(*)") == [(384,)]
    assert rows(db, "MATCH (a:Nobody), (b:B) RETURN count(*)") == [(0,)]
    for shared in (CATALOG["shared_variable"][0], "MATCH (c:Customer)-[:IN_NATION]->(n)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS name, count(*) AS pairs"):
        assert plan(spark, shared).count("Aggregate [") == 2
        assert sorted(run(star_graph(spark, DATA), shared).collect()) == sorted(QUERIES["shared_variable"](spark, DATA).collect())


def test_any_path_is_chosen_among_numbers(spark, people):
    found = plan(spark, CATALOG["any_paths"][0])
    assert "Window" not in found and found.count("l_extendedprice") == 1  # the table's own list of columns
    db = Database(spark)
    db.run("CREATE (a:A {n: 1})-[:R {w: 1}]->(b:B {n: 2}), (a)-[:R {w: 2}]->(b), (a)-[:R]->(:B {n: 3}), (a)-[:R]->(:C {n: 4})")
    assert rows(db, "MATCH p = ANY 1 (x:A)-[:R]->(y:B) RETURN x.n, count(p)") == [(1, 2)]
    assert rows(db, "MATCH p = ANY 2 (x:A)-[:R]->(y:B) RETURN x.n, count(p)") == [(1, 3)]
    assert rows(db, "MATCH ANY 1 (x:A)-[r:R]->(y:B) RETURN y.n, size(r), r[0].w IS NULL ORDER BY y.n") == [(2, 1, False), (3, 1, True)]


def test_a_group_without_conditions_joins_no_nodes(spark):
    joins = [plan(spark, f"MATCH (e:Event){x}(f) RETURN e.event_id AS e, f.event_id AS f{k}").count("Join ") for x, k in (("((a)-[:NEXT_EVENT]->(b)){2}", ", size(a) AS k"), ("-[:NEXT_EVENT*2..2]->", ""))]
    assert joins[0] == joins[1]


def test_the_size_of_a_list_needs_no_relationships(spark):
    assert "NEXT_EVENT" not in plan(spark, CATALOG["quantified_relationship"][0])


def test_squares_of_vectors_are_not_taken_for_each_pair(spark):
    above = plan(spark, CATALOG["vector_similarity_all"][0]).split("Join ")[0]
    assert "zip_with(" in above and not re.search(r"zip_with\((c\d+#\d+), \1,", above)
