"""Registered queries over the star-schema graph, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .database import Database
from .graph import Graph
from .operators.checkpoints import new_folder
from .plans.lower import run
from .sources import files, results
from .sources.tables import star_graph

#: name -> (graph query, SQL or None)
CATALOG: dict[str, tuple[str, str | None]] = {
    "expand_aggregate": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 100000 RETURN c.mktsegment AS seg, count(*) AS n, round(sum(o.totalprice), 2) AS tot ORDER BY n DESC, seg",
        "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS tot FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "all_nodes_count": ("MATCH (n) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM embeddings) AS n"),
    "label_scan": ("MATCH (p:Part) RETURN p.partkey AS k, p.name AS name, p.size AS size", "SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part"),
    "property_lookup": ("MATCH (c:Customer {custkey: 42}) RETURN c.name AS name, c.acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 42"),
    "label_expression": ("MATCH (n:Customer|Supplier) WHERE n.acctbal < 0 RETURN labels(n) AS l, count(*) AS n", "SELECT ['Customer'] AS l, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT ['Supplier'], count(*) FROM supplier WHERE s_acctbal < 0 HAVING count(*) > 0"),
    "relationship_scan": ("MATCH ()-[r:CONTAINS {returnflag: 'R'}]->() RETURN count(r) AS n, round(avg(r.quantity), 4) AS q", "SELECT count(*) AS n, round(avg(l_quantity), 4) AS q FROM lineitem WHERE l_returnflag = 'R'"),
    "relationship_types": ("MATCH ()-[r]->() RETURN type(r) AS t, count(*) AS n", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'NEXT_EVENT', (SELECT count(*) - count(DISTINCT user_id) FROM events)"),
    "two_hops": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.size > 45 RETURN c.mktsegment AS seg, count(DISTINCT p) AS parts, round(sum(l.extendedprice * (1 - l.discount)), 2) AS revenue",
        "SELECT c_mktsegment AS seg, count(DISTINCT p_partkey) AS parts, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 45 GROUP BY 1",
    ),
    "incoming_direction": ("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS name, count(s) AS k", "SELECT n_name AS name, count(*) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "relationship_uniqueness": ("MATCH (a:Nation)-[r:IN_REGION]->(x)<-[s:IN_REGION]-(b:Nation) RETURN x.name AS region, count(*) AS pairs", "SELECT r_name AS region, count(*) AS pairs FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1"),
    "shared_variable": ("MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS name, count(*) AS pairs", "SELECT n_name AS name, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN c.custkey AS c, count(o) AS n, max(o.totalprice) AS top", "SELECT c_custkey AS c, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1"),
    "with_where": ("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n, avg(o.totalprice) AS a WHERE n > 12 RETURN c.name AS name, n, round(a, 2) AS a", "SELECT c_name AS name, count(*) AS n, round(avg(o_totalprice), 2) AS a FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12"),
    "order_skip_limit": ("MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 5"),
    "distinct": ("MATCH (o:Order) RETURN DISTINCT o.orderstatus AS s, o.orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "unwind": ("UNWIND range(1, 5) AS x UNWIND [x, x * x, null] AS y RETURN x, y", "SELECT x, y FROM (SELECT x, unnest([x, x * x, NULL]) AS y FROM range(1, 6) t(x))"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.mktsegment AS v UNION MATCH (o:Order) RETURN o.orderstatus AS v", "SELECT c_mktsegment AS v FROM customer UNION SELECT o_orderstatus FROM orders"),
    "union_all": ("MATCH (r:Region) RETURN r.name AS v UNION ALL MATCH (n:Nation) RETURN n.name AS v", "SELECT r_name AS v FROM region UNION ALL SELECT n_name FROM nation"),
    "let_filter": ("MATCH (p:Part) LET big = p.size > 40, price = p.retailprice FILTER big AND price > 1000 RETURN p.brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 40 AND p_retailprice > 1000 GROUP BY 1"),
    "exists_subquery": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 350000 } RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)"),
    "exists_function": (
        "MATCH (c:Customer) RETURN exists((c)-[:PLACED]->(:Order {orderstatus: 'P'})) AS b, count(*) AS n",
        "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS b, count(*) AS n FROM customer GROUP BY 1",
    ),
    "durations": (
        "MATCH (p:Part) WITH p.partkey AS k, duration({months: p.size / 4.0, days: p.size / 8.0, minutes: p.size}) AS d RETURN k, d.months AS m, d.days AS t, d.minutes AS n",
        "SELECT k, trunc(m)::BIGINT AS m, trunc(t)::BIGINT AS t, (x + floor(round((t - trunc(t)) * 1440, 6)))::BIGINT AS n FROM (SELECT p_partkey AS k, p_size AS x, p_size / 4.0::DOUBLE AS m, p_size / 8.0::DOUBLE + (p_size / 4.0::DOUBLE - trunc(p_size / 4.0::DOUBLE)) * 30.436875 AS t FROM part)",
    ),
    "round_places": ("MATCH (p:Part) RETURN p.partkey AS k, round(p.retailprice, p.size % 3) AS r, round(p.retailprice / 7, 2) AS s", "SELECT p_partkey AS k, round(p_retailprice * pow(10, p_size % 3)) / pow(10, p_size % 3) AS r, round(p_retailprice / 7 * 100) / 100 AS s FROM part"),
    "anti_pattern": ("MATCH (n:Nation) WHERE NOT (n)<-[:IN_NATION]-(:Supplier) RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    "count_subquery": ("MATCH (n:Nation) RETURN n.name AS name, COUNT { (n)<-[:IN_NATION]-(:Customer) } AS k", "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS k FROM nation"),
    "collect_subquery": ("MATCH (r:Region) RETURN r.name AS r, size(COLLECT { MATCH (r)<-[:IN_REGION]-(n) RETURN n.name }) AS k", "SELECT r_name AS r, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS k FROM region"),
    "pattern_comprehension": ("MATCH (r:Region) RETURN r.name AS r, reduce(s = 0, x IN [(r)<-[:IN_REGION]-(n) | n.nationkey] | s + x) AS s", "SELECT r_name AS r, sum(n_nationkey)::BIGINT AS s FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "call_subquery": ("MATCH (n:Nation) CALL (n) { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.custkey AS best ORDER BY c.acctbal DESC, best LIMIT 2 } RETURN n.name AS name, best", "SELECT n_name AS name, c_custkey AS best FROM nation JOIN customer ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2"),
    "named_path": ("MATCH p = (n:Nation)-[:IN_REGION]->(r) RETURN n.nationkey AS k, [x IN nodes(p) | x.name] AS names, length(p) AS l", "SELECT n_nationkey AS k, [n_name, r_name] AS names, 1 AS l FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "aggregates": (
        "MATCH (o:Order) RETURN o.orderstatus AS s, count(DISTINCT o.orderpriority) AS d, round(stDev(o.totalprice), 3) AS sd, round(percentileCont(o.totalprice, 0.25), 4) AS q, percentileDisc(o.totalprice, 0.5) AS m, min(o.orderdate) AS first",
        "SELECT o_orderstatus AS s, count(DISTINCT o_orderpriority) AS d, round(stddev_samp(o_totalprice), 3) AS sd, round(quantile_cont(o_totalprice, 0.25), 4) AS q, quantile_disc(o_totalprice, 0.5) AS m, min(o_orderdate) AS first FROM orders GROUP BY 1",
    ),
    "empty_aggregate": ("MATCH (c:Customer) WHERE c.acctbal > 1e12 RETURN count(*) AS n, sum(c.acctbal) AS s, avg(c.acctbal) AS a, stDev(c.acctbal) AS d, size(collect(c.name)) AS k", "SELECT 0 AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS a, 0.0::DOUBLE AS d, 0 AS k"),
    "string_functions": (
        "MATCH (p:Part) RETURN p.partkey AS k, toUpper(left(p.name, 3)) AS u, substring(p.type, 2, 4) AS s, replace(p.brand, '#', '-') AS r, split(p.type, ' ')[0] AS w, p.name STARTS WITH 'a' AS b, size(p.name) AS n",
        "SELECT p_partkey AS k, upper(left(p_name, 3)) AS u, substr(p_type, 3, 4) AS s, replace(p_brand, '#', '-') AS r, string_split(p_type, ' ')[1] AS w, p_name LIKE 'a%' AS b, length(p_name) AS n FROM part",
    ),
    "arithmetic": (
        "UNWIND range(-3, 3) AS x RETURN x, x / 2 AS d, x % 2 AS m, 1.0 * x / 2 AS f, x ^ 2 AS p, abs(x) AS a, sign(x) AS s, toInteger('1.7') AS t",
        "SELECT x, (trunc(x / 2))::BIGINT AS d, x % 2 AS m, x / 2 AS f, pow(x, 2) AS p, abs(x) AS a, sign(x)::BIGINT AS s, 1 AS t FROM range(-3, 4) t(x)",
    ),
    "ternary_logic": (
        "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS c, a OR b AS d, a XOR b AS e, NOT a AS f, a = b AS g",
        "WITH v(x) AS (VALUES (true), (false), (NULL)) SELECT a.x AS a, b.x AS b, a.x AND b.x AS c, a.x OR b.x AS d, a.x <> b.x AS e, NOT a.x AS f, a.x = b.x AS g FROM v a, v b",
    ),
    "case_list": ("MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'low' WHEN c.acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1"),
    "temporal": (
        "MATCH (o:Order) RETURN o.orderdate.year AS y, o.orderdate.quarter AS q, count(*) AS n, max(date(o.orderdate) + duration({months: 1})) AS later",
        "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, max((o_orderdate::DATE + INTERVAL 1 MONTH)::DATE) AS later FROM orders GROUP BY 1, 2",
    ),
    "spatial": ("MATCH (p:Part) RETURN p.partkey AS k, round(point.distance(point({x: 0, y: 0}), point({x: p.size, y: 2})), 6) AS d", "SELECT p_partkey AS k, round(sqrt(p_size * p_size + 4), 6) AS d FROM part"),
    "vector_index_search": ("CALL db.index.vector.queryNodes('items', 5, [" + ", ".join(["1.0", "0.5"] * 32) + "]) YIELD node, score RETURN node.vec_id AS id, round(score, 5) AS s", "SELECT vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(["1.0", "0.5"] * 32) + "]::DOUBLE[])) / 2, 5) AS s FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(["1.0", "0.5"] * 32) + "]::DOUBLE[]) DESC, vec_id LIMIT 5"),
    "type_predicates": ("MATCH (c:Customer) RETURN c.acctbal IS :: FLOAT AS a, c.name IS :: STRING AS b, c.name IS NOT :: INTEGER AS c, count(*) AS n", "SELECT true AS a, true AS b, true AS c, count(*) AS n FROM customer"),
    "schema_procedures": ("CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order', 'Event', 'Item']) AS label"),
    "undirected_all": ("MATCH (e:Event)-[:NEXT_EVENT]-(f) RETURN e.event_id AS e, count(f) AS n", "WITH x AS (SELECT event_id, lag(event_id) OVER w AS p, lead(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS e, (p IS NOT NULL)::BIGINT + (f IS NOT NULL)::BIGINT AS n FROM x WHERE p IS NOT NULL OR f IS NOT NULL"),
    "var_length_all": (
        "MATCH (e:Event)-[:NEXT_EVENT*1..3]->(f:Event) RETURN e.event_id AS e, f.event_id AS f",
        "WITH x AS (SELECT event_id, lead(event_id, 1) OVER w AS a, lead(event_id, 2) OVER w AS b, lead(event_id, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT * FROM (SELECT event_id AS e, unnest([a, b, c]) AS f FROM x) WHERE f IS NOT NULL",
    ),
    "quantified_group_all": (
        "MATCH (e:Event)((a)-[:NEXT_EVENT]->(b)){2}(f) RETURN e.event_id AS e, f.event_id AS f, size(a) AS k",
        "WITH x AS (SELECT event_id, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) SELECT event_id AS e, f, 2 AS k FROM x WHERE f IS NOT NULL",
    ),
    "shortest_path_all": (
        "MATCH p = shortestPath((c:Customer)-[*..3]->(r:Region)) RETURN c.custkey AS c, r.name AS r, length(p) AS l",
        "SELECT c_custkey AS c, r_name AS r, 2 AS l FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "all_shortest_paths_all": (
        "MATCH p = allShortestPaths((a:Nation)-[:IN_REGION|IN_NATION*..4]-(b:Nation)) RETURN a.nationkey AS a, b.nationkey AS b, count(p) AS n, min(length(p)) AS l",
        "SELECT a.n_nationkey AS a, b.n_nationkey AS b, 1 AS n, 2 AS l FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "vector_similarity_all": (
        "MATCH (a:Item), (b:Item) WHERE a.vec_id % 100 = 0 RETURN a.vec_id AS a, b.vec_id AS id, round(vector.similarity.cosine(a.embedding, b.embedding), 5) AS s",
        "SELECT a.vec_id AS a, b.vec_id AS id, round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 5) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0",
    ),
    "let_filter_rows": ("MATCH (p:Part) LET big = p.size > 40, price = p.retailprice FILTER big AND price > 950 RETURN p.brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 40 AND p_retailprice > 950 GROUP BY 1"),
    "anti_pattern_rows": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {orderstatus: 'P'}) RETURN c.custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "return_star": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH n.name AS nation, r.name AS region RETURN *", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "inline_where": ("MATCH (c:Customer WHERE c.acctbal < 0)-[:PLACED]->(o:Order WHERE o.totalprice > 200000) RETURN c.custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 AND o_totalprice > 200000 GROUP BY 1"),
    "type_expression": ("MATCH ()-[r:!PLACED&!CONTAINS&!SUPPLIED_BY&!NEXT_EVENT]->() RETURN type(r) AS t, count(*) AS n", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"),
    "either_type": ("MATCH (s:Supplier)-[r:IN_NATION|SUPPLIED_BY]-(x) RETURN s.suppkey AS s, type(r) AS t, count(x) AS n", "SELECT s_suppkey AS s, 'IN_NATION' AS t, 1 AS n FROM supplier UNION ALL SELECT l_suppkey, 'SUPPLIED_BY', count(*) FROM lineitem GROUP BY 1"),
    "quantified_relationship": (
        "MATCH (e:Event)-[r:NEXT_EVENT]->{2,3}(f:Event) RETURN e.event_id AS e, f.event_id AS f, size(r) AS k",
        "WITH x AS (SELECT event_id, lead(event_id, 2) OVER w AS b, lead(event_id, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS e, b AS f, 2 AS k FROM x WHERE b IS NOT NULL UNION ALL SELECT event_id, c, 3 FROM x WHERE c IS NOT NULL",
    ),
    "plain_group": ("MATCH ((s:Supplier)-[:IN_NATION]->(n:Nation)) RETURN n.name AS name, count(s) AS k", "SELECT n_name AS name, count(*) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "group_where": (
        "MATCH (e:Event)((a)-[:NEXT_EVENT]->(b) WHERE a.value < b.value){2}(f) RETURN e.event_id AS e, f.event_id AS f",
        "WITH x AS (SELECT event_id, value, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2, lead(event_id, 2) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS e, f FROM x WHERE value < v1 AND v1 < v2",
    ),
    "shortest_groups": ("MATCH p = SHORTEST 1 GROUPS (a:Nation)-[:IN_REGION]-{1,2}(b:Nation) RETURN a.nationkey AS a, b.nationkey AS b, count(p) AS n, min(length(p)) AS l", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, 1 AS n, 2 AS l FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "shortest_k": (
        "MATCH p = SHORTEST 2 (a:Event)-[:NEXT_EVENT]->{1,2}(b:Event) RETURN a.event_id AS a, count(p) AS n",
        "WITH x AS (SELECT event_id, lead(event_id, 1) OVER w AS b, lead(event_id, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS a, (b IS NOT NULL)::BIGINT + (c IS NOT NULL)::BIGINT AS n FROM x WHERE b IS NOT NULL",
    ),
    "any_paths": ("MATCH p = ANY 1 (o:Order)-[:CONTAINS]->(q:Part) RETURN o.orderkey AS o, count(p) AS n", "SELECT l_orderkey AS o, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1"),
    "shortest_least": (
        "MATCH p = shortestPath((a:Event)-[:NEXT_EVENT*2..3]->(b:Event)) RETURN a.event_id AS a, b.event_id AS b, length(p) AS l",
        "WITH x AS (SELECT event_id, lead(event_id, 2) OVER w AS b, lead(event_id, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS a, b, 2 AS l FROM x WHERE b IS NOT NULL UNION ALL SELECT event_id, c, 3 FROM x WHERE c IS NOT NULL",
    ),
    "optional_call": ("MATCH (n:Nation) OPTIONAL CALL (n) { MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 9000 RETURN s.suppkey AS s ORDER BY s LIMIT 1 } RETURN n.name AS name, s", "SELECT n_name AS name, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS s FROM nation"),
    "conditional_subquery": ("MATCH (c:Customer) CALL (c) { WHEN c.acctbal < 0 THEN { RETURN 'debt' AS k } ELSE { RETURN 'fine' AS k } } RETURN k, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS k, count(*) AS n FROM customer GROUP BY 1"),
    "end_nodes": ("MATCH ()-[r:IN_REGION]->() RETURN startNode(r).name AS a, endNode(r).name AS b", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "ordered_collect": ("MATCH (n:Nation) WITH n ORDER BY n.name DESC RETURN n.nationkey % 5 AS k, collect(n.name) AS names", "SELECT n_nationkey % 5 AS k, list(n_name ORDER BY n_name DESC) AS names FROM nation GROUP BY 1"),
    "list_functions": (
        "MATCH (p:Part) WITH p.partkey AS k, split(p.type, ' ') AS t RETURN k, [x IN t WHERE size(x) > 4 | toLower(x)] AS l, any(x IN t WHERE x STARTS WITH 'S') AS a, all(x IN t WHERE size(x) > 3) AS b, none(x IN t WHERE x = 'TIN') AS c, t[0..2] AS s, reverse(t) AS r, head(t) AS h, last(t) AS z, size(tail(t)) AS n",
        "SELECT p_partkey AS k, [lower(x) for x in t if length(x) > 4] AS l, list_bool_or([x LIKE 'S%' for x in t]) AS a, list_bool_and([length(x) > 3 for x in t]) AS b, NOT list_contains(t, 'TIN') AS c, t[1:2] AS s, list_reverse(t) AS r, t[1] AS h, t[-1] AS z, len(t) - 1 AS n FROM (SELECT p_partkey, string_split(p_type, ' ') AS t FROM part)",
    ),
    "map_projection": ("MATCH (c:Customer) WITH c {.name, key: c.custkey} AS m RETURN m.name AS name, m.key AS k", "SELECT c_name AS name, c_custkey AS k FROM customer"),
    "regex_match": ("MATCH (p:Part) WHERE p.brand =~ 'Brand#[1-3].*' RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].*')"),
    "numeric_functions": (
        "MATCH (p:Part) RETURN p.partkey AS k, ceil(p.retailprice) AS c, floor(p.retailprice) AS f, round(sqrt(p.retailprice), 6) AS s, round(log(p.retailprice), 6) AS l, round(exp(p.size / 50.0), 6) AS e, round(sin(p.size), 6) AS n, p.size % 7 AS m, p.size / 7 AS d, toFloat(p.size) ^ 2 AS w",
        "SELECT p_partkey AS k, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 50.0::DOUBLE), 6) AS e, round(sin(p_size), 6) AS n, (p_size % 7)::BIGINT AS m, (p_size // 7)::BIGINT AS d, pow(p_size::DOUBLE, 2) AS w FROM part",
    ),
    "conversions": ("MATCH (c:Customer) RETURN c.custkey AS k, toInteger(toString(c.custkey)) AS i, toFloat('1.5') AS f, toBoolean('true') AS b, coalesce(null, c.name) AS n, nullIf(c.mktsegment, 'BUILDING') AS s, right(c.name, 4) AS r, trim('  x ') AS t", "SELECT c_custkey AS k, c_custkey AS i, 1.5::DOUBLE AS f, true AS b, c_name AS n, nullif(c_mktsegment, 'BUILDING') AS s, right(c_name, 4) AS r, 'x' AS t FROM customer"),
    "distinct_aggregates": ("MATCH (o:Order) RETURN o.orderstatus AS s, round(stDev(DISTINCT o.totalprice), 3) AS sd, round(avg(DISTINCT o.totalprice), 3) AS a, round(sum(DISTINCT o.totalprice), 2) AS t, round(percentileCont(DISTINCT o.totalprice, 0.5), 4) AS m", "SELECT s, round(stddev_samp(p), 3) AS sd, round(avg(p), 3) AS a, round(sum(p), 2) AS t, round(quantile_cont(p, 0.5), 4) AS m FROM (SELECT DISTINCT o_orderstatus AS s, o_totalprice AS p FROM orders) GROUP BY 1"),
    "date_components": (
        "MATCH (o:Order) WITH o.orderkey AS k, date(o.orderdate) AS d RETURN k, date({year: d.year, week: 5, dayOfWeek: 3}) AS w, date({year: d.year, ordinalDay: 60}) AS o, date({year: d.year, quarter: d.quarter, dayOfQuarter: 10}) AS q, date({date: d, day: 1}) AS m, d.weekYear AS y, d.week AS n, d.dayOfWeek AS f, d.ordinalDay AS r, d.dayOfQuarter AS g",
        "SELECT k, (date_trunc('week', make_date(year(d), 1, 4)) + INTERVAL 30 DAY)::DATE AS w, (make_date(year(d), 1, 1) + 59)::DATE AS o, (date_trunc('quarter', d) + INTERVAL 9 DAY)::DATE AS q, date_trunc('month', d)::DATE AS m, isoyear(d) AS y, week(d) AS n, isodow(d) AS f, dayofyear(d) AS r, (d - date_trunc('quarter', d)::DATE) + 1 AS g FROM (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)",
    ),
    "date_texts": (
        "MATCH (o:Order) WITH o.orderkey AS k, toString(o.orderdate.year) AS y RETURN k, date(y + '-W07-2') AS w, date(y + '060') AS o, date(y + '-Q2-15') AS q, date(y + '0228') AS b, date(y + '-03') AS m, date(y) AS f",
        "SELECT o_orderkey AS k, (date_trunc('week', make_date(y, 1, 4)) + INTERVAL 43 DAY)::DATE AS w, (make_date(y, 1, 1) + 59)::DATE AS o, make_date(y, 4, 15) AS q, make_date(y, 2, 28) AS b, make_date(y, 3, 1) AS m, make_date(y, 1, 1) AS f FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)",
    ),
    "date_truncate": (
        "MATCH (o:Order) WITH o.orderkey AS k, date(o.orderdate) AS d RETURN k, date.truncate('decade', d) AS a, date.truncate('quarter', d) AS b, date.truncate('week', d) AS c, date.truncate('weekYear', d) AS e, date.truncate('month', d, {day: 7}) AS f, date.truncate('week', d, {dayOfWeek: 3}) AS g",
        "SELECT k, date_trunc('decade', d)::DATE AS a, date_trunc('quarter', d)::DATE AS b, date_trunc('week', d)::DATE AS c, date_trunc('week', make_date(isoyear(d), 1, 4))::DATE AS e, (date_trunc('month', d) + INTERVAL 6 DAY)::DATE AS f, (date_trunc('week', d) + INTERVAL 2 DAY)::DATE AS g FROM (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)",
    ),
    "datetimes": (
        "MATCH (e:Event) RETURN e.event_id AS k, datetime(toString(date(e.ts)) + 'T10:30:15.25+02:00').epochMillis AS a, datetime({year: e.ts.year, month: 2, day: 3, hour: e.ts.hour, millisecond: 7}).epochMillis AS b, datetime.truncate('hour', e.ts).epochSeconds AS c, duration.inDays(date(e.ts), date('2030-01-01')).days AS d",
        "SELECT event_id AS k, epoch_ms(ts::DATE + INTERVAL 30615250 MILLISECOND) AS a, epoch_ms(make_timestamp(year(ts), 2, 3, hour(ts), 0, 0.007)) AS b, epoch_ms(date_trunc('hour', ts)) // 1000 AS c, DATE '2030-01-01' - ts::DATE AS d FROM events",
    ),
}

#: name -> (statements, the last of which returns rows, SQL); the statements update a graph of the call's own.
UPDATES: dict[str, tuple[list[str], str]] = {
    "update_set_remove": (
        ["MATCH (c:Customer) WHERE c.acctbal < 0 SET c.band = 'debt', c:Debtor", "MATCH (c:Debtor) REMOVE c.name", "MATCH (c:Customer) RETURN c.custkey AS k, c.band AS band, c.name AS name, size(labels(c)) AS l"],
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' END AS band, CASE WHEN NOT c_acctbal < 0 THEN c_name END AS name, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS l FROM customer",
    ),
    "update_merge": (
        ["MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment})", "MATCH (c:Customer), (s:Segment) WHERE s.name = c.mktsegment CREATE (c)-[:IN_SEGMENT]->(s)", "MATCH (s:Segment)<-[:IN_SEGMENT]-(c) RETURN s.name AS name, count(c) AS n"],
        "SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1",
    ),
    "update_delete": (
        ["MATCH (s:Supplier) WHERE s.acctbal < 5000 DETACH DELETE s", "MATCH ()-[r:SUPPLIED_BY]->(s) RETURN s.suppkey AS s, count(r) AS n"],
        "SELECT l_suppkey AS s, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 5000 GROUP BY 1",
    ),
    "update_foreach": (["MATCH (n:Nation) FOREACH (x IN [1, 2] | CREATE (:Mark {k: n.nationkey * 10 + x}))", "MATCH (m:Mark) RETURN m.k AS k"], "SELECT n_nationkey * 10 + x AS k FROM nation, (VALUES (1), (2)) t(x)"),
    "update_call": (["MATCH (o:Order) WITH o.orderstatus AS s CALL (s) { CREATE (:Copy {s: s}) }", "MATCH (c:Copy) RETURN c.s AS s, count(*) AS n"], "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
}


def query(name: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(star_graph(spark, sf_dir), CATALOG[name][0])

    of.__name__ = name
    return of


def update(name: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, star_graph(spark, sf_dir))
        for text in UPDATES[name][0][:-1]:
            db.run(text)
        return db.run(UPDATES[name][0][-1]).df

    of.__name__ = name
    return of


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD CSV of the customers, written as CSV first."""
    path = new_folder(spark, "customers")
    spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return run(Graph(spark), "LOAD CSV WITH HEADERS FROM $path AS r RETURN toInteger(r.c_custkey) AS k, r.c_name AS name, toFloat(r.c_acctbal) AS bal", {"path": path})


_SUMMARY = "MATCH (s:Supplier)-[r:IN_NATION]->(n:Nation) RETURN n.name AS name, count(r) AS k, round(sum(s.acctbal), 2) AS bal"


def _part_of_star(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers, nations and what lies between them."""
    graph = star_graph(spark, sf_dir)
    graph.nodes = [t for t in graph.nodes if t.labels & {"Supplier", "Nation"}]
    graph.rels = [t for t in graph.rels if t.type == "IN_NATION" and t.start_label == "Supplier"]
    return graph


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "json")
    files.export_json(_part_of_star(spark, sf_dir), path)
    return run(files.import_json(spark, path), _SUMMARY)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, source = new_folder(spark, "csv"), _part_of_star(spark, sf_dir)
    files.export_csv(source, path)
    graph = Graph(spark, codes=source.codes, nodes=source.nodes)  # edges name ids of nodes that are there
    return run(files.import_csv_edges(graph, f"{path}/edges/IN_NATION"), _SUMMARY)


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "snapshot")
    files.snapshot(_part_of_star(spark, sf_dir), path)
    return run(files.load_snapshot(spark, path), _SUMMARY)


def csv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    files.export_csv(_part_of_star(spark, sf_dir), path)
    return run(files.import_csv_nodes(Graph(spark), f"{path}/nodes/Supplier"), "MATCH (s:Supplier) RETURN s.suppkey AS k, s.name AS name, s.acctbal AS bal")


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as lines of JSON."""
    return results.jsonl(run(star_graph(spark, sf_dir), "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.nationkey AS k, r.name AS r"))


_SUMMARY_SQL = "SELECT n_name AS name, count(*) AS k, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"
#: Queries that write files first, with their SQL.
FILES = {
    load_csv: "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer",
    json_round_trip: _SUMMARY_SQL,
    csv_round_trip: _SUMMARY_SQL,
    snapshot_round_trip: _SUMMARY_SQL,
    csv_nodes: "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier",
    result_lines: """SELECT '{"k":' || n_nationkey || ',"r":"' || r_name || '"}' AS value FROM nation JOIN region ON n_regionkey = r_regionkey""",
}
QUERIES = {n: query(n) for n in CATALOG} | {n: update(n) for n in UPDATES} | {f.__name__: f for f in FILES}
ORACLE_SQL = {n: s for n, (_, s) in (CATALOG | UPDATES).items() if s} | {f.__name__: s for f, s in FILES.items()}
