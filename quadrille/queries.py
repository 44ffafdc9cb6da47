"""Registered queries of the engine over the tables of a folder seen as statements, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.engine import Engine, solutions
from quadrille.operators import sampling
from quadrille.operators.compiler import Services
from quadrille.operators.paging import Budget
from quadrille.plans import federation
from quadrille.plans.parser import parse
from quadrille.sources.dataset import QuadDataset
from quadrille.sources.relational import BASE, RelationalDataset
from quadrille.sources.relational import TABLES as TABLES_MAPPED

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
PREFIXES = f"PREFIX t: <{BASE}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + " ".join(f"PREFIX {n}: <{BASE}{n}#>" for n in TABLES)


def iri(name: str, key: str) -> str:
    return f"'<{BASE}{name}/' || {key} || '>'"


def text(column: str) -> str:
    """SQL for the canonical text of a plain string without characters to escape."""
    return f"""('"' || {column} || '"')"""


#: Name, query, SQL.
PAIRS: list[tuple[str, str, str]] = [
    ("scan_tp", "SELECT ?c ?name { ?c customer:c_name ?name }",
     f"SELECT {iri('customer', 'c_custkey')} AS c, c_name AS name FROM customer"),
    ("scan_constant_subject", "SELECT ?name { <http://data.local/nation/7> nation:n_name ?name }",
     "SELECT n_name AS name FROM nation WHERE n_nationkey = 7"),
    ("scan_constant_object", 'SELECT ?c { ?c customer:c_mktsegment "BUILDING" }',
     f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    ("scan_repeated_var", "SELECT ?n { ?n nation:n_nationkey ?k ; nation:n_regionkey ?k }",
     f"SELECT {iri('nation', 'n_nationkey')} AS n FROM nation WHERE n_nationkey = n_regionkey"),
    ("scan_unknown", "SELECT ?s ?o { ?s <http://data.local/no#such> ?o }", "SELECT '' AS s, '' AS o WHERE false"),
    ("rdf_type", "SELECT ?r ?name { ?r a t:Region ; region:r_name ?name }",
     f"SELECT {iri('region', 'r_regionkey')} AS r, r_name AS name FROM region"),
    ("predicate_var", "SELECT ?p ?o { <http://data.local/region/1> ?p ?o }",
     f"""SELECT '<{BASE}region#r_regionkey>' AS p, '"1"^^<http://www.w3.org/2001/XMLSchema#integer>' AS o
         UNION ALL SELECT '<{BASE}region#r_name>', {text('r_name')} FROM region WHERE r_regionkey = 1
         UNION ALL SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{BASE}Region>'"""),
    ("bgp_join", "SELECT ?name ?bal { ?c customer:c_name ?name . ?c customer:c_acctbal ?bal . ?c customer:ref_c_nationkey ?n . ?n nation:n_name \"NATION_1\" FILTER(?bal > 1000) }",
     "SELECT c_name AS name, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_1' AND c_acctbal > 1000"),
    ("bgp_star", "SELECT ?o ?status ?price ?prio { ?o orders:o_orderstatus ?status ; orders:o_totalprice ?price ; orders:o_orderpriority ?prio }",
     f"SELECT {iri('orders', 'o_orderkey')} AS o, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS prio FROM orders"),
    ("bgp_chain", "SELECT ?o ?r { ?o orders:ref_o_custkey ?c . ?c customer:ref_c_nationkey ?n . ?n nation:ref_n_regionkey ?g . ?g region:r_name ?r }",
     f"SELECT {iri('orders', 'o_orderkey')} AS o, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    ("bgp_snowflake", "SELECT ?qty ?brand ?s ?seg { ?l lineitem:l_quantity ?qty ; lineitem:ref_l_partkey ?p ; lineitem:ref_l_suppkey ?u ; lineitem:ref_l_orderkey ?o . ?p part:p_brand ?brand . ?u supplier:s_name ?s . ?o orders:ref_o_custkey ?c . ?c customer:c_mktsegment ?seg FILTER(?qty >= 49) }",
     "SELECT l_quantity AS qty, p_brand AS brand, s_name AS s, c_mktsegment AS seg FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 49"),
    ("join_on_value", "SELECT ?a ?b { ?a customer:c_nationkey ?k . ?b supplier:s_nationkey ?k . ?b supplier:s_acctbal ?x FILTER(?x > 9000) }",
     f"SELECT {iri('customer', 'c_custkey')} AS a, {iri('supplier', 's_suppkey')} AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 9000"),
    ("cartesian", "SELECT ?a ?b { ?x region:r_name ?a . ?y region:r_name ?b }",
     "SELECT x.r_name AS a, y.r_name AS b FROM region x CROSS JOIN region y"),
    ("filter_num", "SELECT ?c ?b { ?c customer:c_acctbal ?b FILTER(?b > 5000 && ?b <= 6000 || ?b < -900) }",
     f"SELECT {iri('customer', 'c_custkey')} AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 6000 OR c_acctbal < -900"),
    ("filter_not_equal", 'SELECT ?c { ?c customer:c_mktsegment ?s FILTER(?s != "BUILDING") }',
     f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    ("filter_regex", 'SELECT ?n { ?c customer:c_name ?n FILTER(regex(?n, "7[0-4]$", "i")) }',
     "SELECT c_name AS n FROM customer WHERE regexp_matches(c_name, '7[0-4]$', 'i')"),
    ("filter_in", "SELECT ?p ?z { ?p part:p_size ?z FILTER(?z IN (1, 7, 50)) }",
     f"SELECT {iri('part', 'p_partkey')} AS p, p_size AS z FROM part WHERE p_size IN (1, 7, 50)"),
    ("filter_not_in", "SELECT ?r { ?x region:r_regionkey ?k ; region:r_name ?r FILTER(?k NOT IN (0, 3)) }",
     "SELECT r_name AS r FROM region WHERE r_regionkey NOT IN (0, 3)"),
    ("filter_date", 'SELECT (COUNT(*) AS ?n) { ?o orders:o_orderdate ?d FILTER(?d >= "1995-01-01T00:00:00"^^xsd:dateTime && ?d < "1996-01-01T00:00:00"^^xsd:dateTime) }',
     "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    ("filter_error_is_false", "SELECT ?r { ?x region:r_name ?r FILTER(?r > 3) }", "SELECT '' AS r WHERE false"),
    ("filter_between_patterns", "SELECT ?n { ?c customer:c_acctbal ?b FILTER(?b > 9900) ?c customer:c_name ?n }",
     "SELECT c_name AS n FROM customer WHERE c_acctbal > 9900"),
    ("bind_expr", "SELECT ?p ?x { ?p part:p_retailprice ?r ; part:p_size ?z BIND(?z * 2 + 1 - 3 AS ?x) FILTER(?x > 90) }",
     f"SELECT {iri('part', 'p_partkey')} AS p, CAST(p_size * 2 + 1 - 3 AS BIGINT) AS x FROM part WHERE p_size * 2 - 2 > 90"),
    ("bind_constant", "SELECT * { BIND(9 * 5 - 4 AS ?total) }", "SELECT CAST(41 AS BIGINT) AS total"),
    ("bind_iri_join", "SELECT ?c ?name { BIND(<http://data.local/nation/3> AS ?n) ?c customer:ref_c_nationkey ?n ; customer:c_name ?name }",
     f"SELECT {iri('customer', 'c_custkey')} AS c, c_name AS name FROM customer WHERE c_nationkey = 3"),
    ("project_expr", "SELECT (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) { ?x nation:n_name ?n }",
     "SELECT CAST(length(n_name) AS BIGINT) AS len, upper(n_name) AS up FROM nation"),
    ("project_missing", "SELECT ?n ?nothing { ?x nation:n_name ?n }", "SELECT n_name AS n, CAST(NULL AS VARCHAR) AS nothing FROM nation"),
    ("functions_string", 'SELECT (CONCAT(?n, "-", LCASE(?n)) AS ?a) (SUBSTR(?n, 3, 4) AS ?b) (STRBEFORE(?n, "_") AS ?c) (STRAFTER(?n, "_") AS ?d) (STRSTARTS(?n, "NATION_1") AS ?e) (CONTAINS(?n, "2") AS ?f) (STRENDS(?n, "4") AS ?g) (REPLACE(?n, "[AEIO]", "x") AS ?h) (ENCODE_FOR_URI(CONCAT(?n, " /")) AS ?i) { ?x nation:n_name ?n }',
     "SELECT n_name || '-' || lower(n_name) AS a, substr(n_name, 3, 4) AS b, split_part(n_name, '_', 1) AS c, split_part(n_name, '_', 2) AS d, starts_with(n_name, 'NATION_1') AS e, contains(n_name, '2') AS f, ends_with(n_name, '4') AS g, regexp_replace(n_name, '[AEIO]', 'x', 'g') AS h, n_name || '%20%2F' AS i FROM nation"),
    ("functions_numeric", "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (-?k AS ?neg) { ?x customer:c_custkey ?k ; customer:c_acctbal ?b }",
     "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r, -c_custkey AS neg FROM customer"),
    ("functions_date", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d }",
     "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h FROM orders"),
    ("functions_hash", "SELECT (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) { ?x nation:n_name ?n }",
     "SELECT md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    ("functions_term", "SELECT (STR(?x) AS ?s) (isIRI(?x) AS ?i) (isLiteral(?n) AS ?l) (isNumeric(?k) AS ?u) (LANG(?n) AS ?g) (STR(DATATYPE(?k)) AS ?t) (sameTerm(?x, <http://data.local/nation/2>) AS ?e) { ?x nation:n_name ?n ; nation:n_nationkey ?k }",
     f"SELECT '{BASE}nation/' || n_nationkey AS s, true AS i, true AS l, true AS u, '' AS g, 'http://www.w3.org/2001/XMLSchema#integer' AS t, n_nationkey = 2 AS e FROM nation"),
    ("functions_cast", 'SELECT (xsd:integer(STRAFTER(?n, "_")) AS ?i) (xsd:double(STRAFTER(?n, "_")) AS ?d) (xsd:string(?k) AS ?s) (xsd:boolean(?k) AS ?b) (xsd:integer(?n) AS ?err) { ?x nation:n_name ?n ; nation:n_nationkey ?k }',
     "SELECT CAST(split_part(n_name, '_', 2) AS BIGINT) AS i, CAST(split_part(n_name, '_', 2) AS DOUBLE) AS d, CAST(n_nationkey AS VARCHAR) AS s, n_nationkey <> 0 AS b, CAST(NULL AS BIGINT) AS err FROM nation"),
    ("functions_choice", 'SELECT ?k (IF(?k > 10, "high", "low") AS ?a) (COALESCE(?none, ?k) AS ?b) (BOUND(?none) AS ?c) { ?x nation:n_nationkey ?k OPTIONAL { ?x nation:no_such ?none } }',
     """SELECT n_nationkey AS k, CASE WHEN n_nationkey > 10 THEN 'high' ELSE 'low' END AS a, '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS b, false AS c FROM nation"""),
    ("values_join", 'SELECT ?c ?s { VALUES ?s { "BUILDING" "MACHINERY" "NONE" } ?c customer:c_mktsegment ?s }',
     f"SELECT {iri('customer', 'c_custkey')} AS c, {text('c_mktsegment')} AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("values_undef", "SELECT ?n ?name { VALUES (?n ?x) { (<http://data.local/nation/1> 1) (UNDEF 2) } ?n nation:n_name ?name }",
     f"SELECT {iri('nation', 'n_nationkey')} AS n, n_name AS name FROM nation WHERE n_nationkey = 1 UNION ALL SELECT {iri('nation', 'n_nationkey')}, n_name FROM nation"),
    ("values_empty", "SELECT ?n { VALUES ?n { } ?n nation:n_name ?name }", "SELECT '' AS n WHERE false"),
    ("values_cartesian", 'SELECT ?v ?r { VALUES ?v { "a" "b" } ?x region:r_name ?r }',
     """SELECT v, r_name AS r FROM region CROSS JOIN (VALUES ('"a"'), ('"b"')) x(v)"""),
    ("optional", "SELECT ?n ?s { ?n nation:n_name ?name OPTIONAL { ?s supplier:ref_s_nationkey ?n ; supplier:s_acctbal ?b FILTER(?b > 5000) } }",
     f"SELECT {iri('nation', 'n_nationkey')} AS n, {iri('supplier', 's_suppkey')} AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000"),
    ("optional_outer_condition", "SELECT ?n ?r { ?x nation:n_name ?n ; nation:n_nationkey ?k OPTIONAL { ?y region:r_name ?r ; region:r_regionkey ?g FILTER(?g = ?k) } }",
     "SELECT n_name AS n, r_name AS r FROM nation LEFT JOIN region ON r_regionkey = n_nationkey"),
    ("optional_nested", "SELECT ?r ?n ?s { ?g region:r_name ?r OPTIONAL { ?x nation:ref_n_regionkey ?g ; nation:n_name ?n OPTIONAL { ?u supplier:ref_s_nationkey ?x ; supplier:s_name ?s } } }",
     "SELECT r_name AS r, n_name AS n, s_name AS s FROM region LEFT JOIN (nation LEFT JOIN supplier ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey"),
    ("optional_unbound_join", "SELECT ?n ?k { ?x nation:n_name ?n OPTIONAL { ?x nation:n_nationkey ?k FILTER(?k < 2) } ?g region:r_regionkey ?k }",
     "SELECT n_name AS n, r_regionkey AS k FROM nation JOIN region ON n_nationkey >= 2 OR n_nationkey = r_regionkey"),
    ("union_same", "SELECT ?x { { ?s supplier:s_name ?x } UNION { ?c customer:c_name ?x } }",
     "SELECT s_name AS x FROM supplier UNION ALL SELECT c_name FROM customer"),
    ("union_hetero", "SELECT ?a ?b { { ?s supplier:s_name ?a } UNION { ?c region:r_name ?b } }",
     "SELECT s_name AS a, CAST(NULL AS VARCHAR) AS b FROM supplier UNION ALL SELECT NULL, r_name FROM region"),
    ("union_mixed_types", "SELECT ?v { { ?x region:r_name ?v } UNION { ?x region:r_regionkey ?v } }",
     f"""SELECT {text('r_name')} AS v FROM region UNION ALL SELECT '"' || r_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM region"""),
    ("graph_const", "SELECT ?s { GRAPH <http://data.local/graph/region> { ?s a ?t } }",
     f"SELECT {iri('region', 'r_regionkey')} AS s FROM region"),
    ("graph_var", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s a ?t } VALUES ?t { t:Region t:Nation } } GROUP BY ?g",
     f"SELECT '<{BASE}graph/region>' AS g, count(*) AS n FROM region UNION ALL SELECT '<{BASE}graph/nation>', count(*) FROM nation"),
    ("graph_complex", "SELECT ?n ?r { GRAPH <http://data.local/graph/nation> { ?x nation:n_name ?n OPTIONAL { ?x nation:n_regionkey ?r FILTER(?r > 2) } } }",
     "SELECT n_name AS n, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS r FROM nation"),
    ("from_graphs", "SELECT ?s FROM <http://data.local/graph/region> FROM <http://data.local/graph/nation> WHERE { ?s a ?t }",
     f"SELECT {iri('region', 'r_regionkey')} AS s FROM region UNION ALL SELECT {iri('nation', 'n_nationkey')} FROM nation"),
    ("count_star", "SELECT (COUNT(*) + 2 AS ?n) { ?o orders:o_orderstatus ?s }", "SELECT count(*) + 2 AS n FROM orders"),
    ("count_empty", "SELECT (COUNT(*) AS ?n) { ?o orders:no_such ?s }", "SELECT CAST(0 AS BIGINT) AS n"),
    ("count_var_optional", "SELECT (COUNT(?s) AS ?n) (COUNT(?x) AS ?m) { ?x nation:n_name ?name OPTIONAL { ?s supplier:ref_s_nationkey ?x ; supplier:s_acctbal ?b FILTER(?b > 8000) } }",
     "SELECT count(s_suppkey) AS n, count(*) AS m FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000"),
    ("count_subquery_cross", "SELECT ?r ?n { ?x region:r_name ?r { SELECT (COUNT(*) AS ?n) { ?c customer:c_name ?y } } }",
     "SELECT r_name AS r, (SELECT count(*) FROM customer) AS n FROM region"),
    ("group_subquery_join", "SELECT ?name ?n { ?x nation:n_name ?name { SELECT ?x (COUNT(*) AS ?n) { ?c customer:ref_c_nationkey ?x } GROUP BY ?x } }",
     "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"),
    ("group_count", "SELECT ?s (COUNT(*) AS ?n) { ?c customer:c_mktsegment ?s } GROUP BY ?s",
     "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1"),
    ("group_expr", "SELECT ?y (COUNT(*) AS ?n) { ?o orders:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
     "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    ("group_having", "SELECT ?x (COUNT(*) AS ?n) { ?c customer:c_nationkey ?x } GROUP BY ?x HAVING (COUNT(*) > 60)",
     "SELECT c_nationkey AS x, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60"),
    ("count_distinct", "SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(DISTINCT ?s) AS ?m) { ?o orders:ref_o_custkey ?c ; orders:o_orderstatus ?s }",
     "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderstatus) AS m FROM orders"),
    ("aggregates", "SELECT ?f (SUM(?q) AS ?sum) (AVG(?q) AS ?avg) (MIN(?p) AS ?min) (MAX(?p) AS ?max) { ?l lineitem:l_returnflag ?f ; lineitem:l_quantity ?q ; lineitem:l_extendedprice ?p } GROUP BY ?f",
     "SELECT l_returnflag AS f, sum(l_quantity) AS sum, avg(l_quantity) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1"),
    ("aggregate_texts", 'SELECT ?g (GROUP_CONCAT(?n ; SEPARATOR = "|") AS ?all) (SAMPLE(?n) AS ?one) (SUM(DISTINCT ?k) AS ?k2) { ?x nation:n_name ?n ; nation:n_regionkey ?g ; nation:n_nationkey ?k } GROUP BY ?g',
     "SELECT n_regionkey AS g, string_agg(n_name, '|' ORDER BY n_name) AS all, min(n_name) AS one, CAST(sum(DISTINCT n_nationkey) AS BIGINT) AS k2 FROM nation GROUP BY 1"),
    ("distinct", "SELECT DISTINCT ?s ?k { ?c customer:c_mktsegment ?s ; customer:c_nationkey ?k }",
     "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS k FROM customer"),
    ("reduced", "SELECT REDUCED ?s { ?c customer:c_mktsegment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    ("order_limit", "SELECT ?n ?b { ?c customer:c_name ?n ; customer:c_acctbal ?b } ORDER BY DESC(?b) ?n LIMIT 20",
     "SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20"),
    ("slice_tp", "SELECT ?c ?n { ?c customer:c_name ?n } LIMIT 12 OFFSET 5",
     f"SELECT {iri('customer', 'c_custkey')} AS c, c_name AS n FROM customer ORDER BY 1, 2 LIMIT 12 OFFSET 5"),
    ("slice_bgp", "SELECT ?name ?r { ?x nation:n_name ?name ; nation:ref_n_regionkey ?g . ?g region:r_name ?r } LIMIT 7 OFFSET 3",
     f"SELECT n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY {text('n_name')}, {text('r_name')} LIMIT 7 OFFSET 3"),
    ("slice_subquery_join", "SELECT ?name ?c { ?x nation:n_name ?name { SELECT ?c ?x { ?c customer:ref_c_nationkey ?x } LIMIT 100 OFFSET 10 } }",
     f"SELECT n_name AS name, c FROM nation JOIN (SELECT {iri('customer', 'c_custkey')} AS c, c_nationkey AS k FROM customer ORDER BY 1 LIMIT 100 OFFSET 10) ON k = n_nationkey"),
    ("slice_nested", "SELECT ?n { { SELECT ?n { { SELECT ?n { ?x nation:n_name ?n } LIMIT 20 OFFSET 2 } } LIMIT 10 OFFSET 1 } }",
     f"SELECT n_name AS n FROM nation ORDER BY {text('n_name')} LIMIT 10 OFFSET 3"),
    ("slice_zero", "SELECT ?n { ?x nation:n_name ?n } LIMIT 0", "SELECT '' AS n WHERE false"),
    ("minus", "SELECT ?c { ?c customer:c_name ?n MINUS { ?o orders:ref_o_custkey ?c } }",
     f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    ("minus_some", "SELECT ?n { ?x nation:n_name ?n MINUS { ?s supplier:ref_s_nationkey ?x ; supplier:s_acctbal ?b FILTER(?b > 3000) } }",
     "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)"),
    ("minus_unbound", "SELECT ?n { ?x nation:n_name ?n MINUS { ?s supplier:s_acctbal ?b FILTER(?b > 5000) OPTIONAL { ?s supplier:ref_s_nationkey ?x ; supplier:s_nationkey ?k FILTER(?k < 10) } } }",
     "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey < 10)"),
    ("optional_union", "SELECT ?n ?s ?g { ?x nation:n_name ?n OPTIONAL { { ?s supplier:ref_s_nationkey ?x ; supplier:s_acctbal ?b FILTER(?b > 9000) } UNION { ?x nation:ref_n_regionkey ?g . ?g region:r_regionkey ?k FILTER(?k = 2) } } }",
     f"""WITH m AS (SELECT s_nationkey AS k, {iri('supplier', 's_suppkey')} AS s, NULL AS g FROM supplier WHERE s_acctbal > 9000
                  UNION ALL SELECT n_nationkey, NULL, {iri('region', 'n_regionkey')} FROM nation WHERE n_regionkey = 2)
         SELECT n_name AS n, s, g FROM nation LEFT JOIN m ON k = n_nationkey"""),
    ("union_joined", "SELECT ?n ?v { { ?x nation:n_name ?n . ?x nation:n_regionkey ?v } UNION { ?x nation:n_name ?n } ?s supplier:ref_s_nationkey ?x ; supplier:s_nationkey ?v }",
     "SELECT n_name AS n, s_nationkey AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = s_nationkey UNION ALL SELECT n_name, s_nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    ("filter_error_in_one_arm", "SELECT ?r { ?x region:r_name ?r ; region:r_regionkey ?k FILTER(?r > 3 || ?k = 2) }",
     "SELECT r_name AS r FROM region WHERE r_regionkey = 2"),
    ("values_rows", "SELECT ?o ?s { VALUES (?c ?s) { (<http://data.local/customer/7> UNDEF) (<http://data.local/customer/9> \"O\") (UNDEF \"none\") } ?o orders:ref_o_custkey ?c ; orders:o_orderstatus ?s }",
     f"SELECT {iri('orders', 'o_orderkey')} AS o, {text('o_orderstatus')} AS s FROM orders WHERE o_custkey = 7 OR o_custkey = 9 AND o_orderstatus = 'O'"),
    ("functions_make", 'SELECT ?k (STRLEN(SHA384(?n)) AS ?a) (STRLEN(SHA512(?n)) AS ?b) (STR(IRI(CONCAT("http://x.test/", ?n))) AS ?c) (LANG(STRLANG(?n, "en")) AS ?d) (langMatches(LANG(STRLANG(?n, "en-gb")), "en") AS ?e) (isBlank(?x) AS ?f) (STR(DATATYPE(STRDT(STR(?k), xsd:integer))) AS ?g) (STRLEN(STRUUID()) AS ?h) (isIRI(UUID()) AS ?i) (isBlank(BNODE()) AS ?j) { ?x nation:n_name ?n ; nation:n_nationkey ?k }',
     "SELECT n_nationkey AS k, CAST(96 AS BIGINT) AS a, CAST(128 AS BIGINT) AS b, 'http://x.test/' || n_name AS c, 'en' AS d, true AS e, false AS f, 'http://www.w3.org/2001/XMLSchema#integer' AS g, CAST(36 AS BIGINT) AS h, true AS i, true AS j FROM nation"),
    ("functions_time", "SELECT ?k (MINUTES(?d) AS ?m) (SECONDS(?d) AS ?s) (TZ(?d) AS ?z) (BOUND(?t) AS ?b) (NOW() > ?d AS ?past) { ?e events:event_id ?k ; events:ts ?d BIND(TIMEZONE(?d) AS ?t) FILTER(?k < 500) }",
     "SELECT event_id AS k, minute(ts) AS m, extract('microseconds' FROM ts) / 1000000.0 AS s, '' AS z, false AS b, true AS past FROM events WHERE event_id < 500"),
    ("exists", "SELECT ?c { ?c customer:c_name ?n FILTER EXISTS { ?o orders:ref_o_custkey ?c ; orders:o_totalprice ?p FILTER(?p > 300000) } }",
     f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    ("not_exists", "SELECT ?n { ?x nation:n_name ?n FILTER NOT EXISTS { ?s supplier:ref_s_nationkey ?x ; supplier:s_acctbal ?b FILTER(?b > 3000) } }",
     "SELECT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 3000)"),
    ("property_list", 'SELECT ?n { [] customer:c_name ?n ; customer:ref_c_nationkey [ nation:n_name "NATION_4" ] }',
     "SELECT c_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_4'"),
    ("service_local", "SELECT ?n ?r { ?x nation:n_name ?n ; nation:ref_n_regionkey ?g SERVICE <http://other.local/> { ?g region:r_name ?r } }",
     "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    ("service_silent", "SELECT ?s ?p ?o { SERVICE SILENT <http://nobody.local/> { ?s ?p ?o } }", "SELECT '' AS s, '' AS p, '' AS o WHERE false"),
    ("service_var", "SELECT ?e ?r { SERVICE ?e { ?g region:r_name ?r } }", "SELECT '<http://other.local/>' AS e, r_name AS r FROM region"),
]

#: Name, query, budget: run page by page until no continuation is left.
PAGED = [
    ("continuation_results", "SELECT ?name ?r { ?g region:r_name ?r . ?x nation:ref_n_regionkey ?g ; nation:n_name ?name FILTER(?r != \"EUROPE\") }", Budget(max_results=9),
     f"SELECT {text('n_name')} AS name, {text('r_name')} AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'"),
    ("continuation_scans", "SELECT ?r ?n { ?g region:r_name ?r OPTIONAL { ?x nation:ref_n_regionkey ?g ; nation:n_name ?n } }", Budget(max_scans=12),
     f"SELECT {text('r_name')} AS r, {text('n_name')} AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey"),
    ("continuation_count", "SELECT (COUNT(*) AS ?n) { ?g region:r_name ?r . ?x nation:ref_n_regionkey ?g }", Budget(max_scans=14),
     """SELECT '"' || count(*) || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS n FROM region JOIN nation ON n_regionkey = r_regionkey"""),
]


PAGED += [
    ("continuation_orders", "SELECT ?o ?k { ?o orders:o_totalprice ?p FILTER(?p > 498500) ?l lineitem:ref_l_orderkey ?o ; lineitem:l_linenumber ?k }", Budget(max_results=20),
     f"""SELECT {iri('orders', 'o_orderkey')} AS o, '"' || l_linenumber || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS k
         FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 498500"""),
    ("continuation_customers", "SELECT ?c ?n { ?c customer:ref_c_nationkey ?n }", Budget(max_results=400),
     f"SELECT {iri('customer', 'c_custkey')} AS c, {iri('nation', 'c_nationkey')} AS n FROM customer"),
]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    dataset = RelationalDataset(spark, sf_dir)
    return Engine(dataset, Services({"http://other.local/": RelationalDataset(spark, sf_dir)}))


def _whole(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).execute(f"{PREFIXES} {query}")


def _paged(query: str, budget: Budget) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        rows, _ = e.run_to_completion(f"{PREFIXES} {query}", budget)
        names = e.plan(f"{PREFIXES} {query}").names
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))

    return run


JOINED = "?o orders:ref_o_custkey ?c . ?c customer:ref_c_nationkey ?n . ?n nation:ref_n_regionkey ?r"


def sample_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.walk(engine(spark, sf_dir), f"{PREFIXES} SELECT ?o ?c ?n ?r {{ {JOINED} }}", 10_000, seed=1)


def sample_walks_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks whose terms or probability are not what the tables say, and how many there are.

    Nations come first, then one of the nation's customers, then one of the customer's orders.
    """
    key = lambda c: F.regexp_extract(c, r"/(\d+)>$", 1).try_cast("long").alias(c)
    walks = sample_walks(spark, sf_dir).select("_walk", "_probability", *[key(c) for c in "ocnr"])
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nations, customers, orders = read("nation"), read("customer"), read("orders")
    in_nation = customers.groupBy(F.col("c_nationkey").alias("n")).agg(F.count("*").alias("in_nation"))
    of_customer = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("of_customer"))
    known = (walks.join(nations.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r0")), "n", "left")
             .join(customers.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n0")), "c", "left")
             .join(orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c0")), "o", "left")
             .join(in_nation, "n", "left").join(of_customer, "c", "left").crossJoin(F.broadcast(nations.agg(F.count("*").alias("nations")))))
    p = F.col("_probability")
    want = 1 / (F.col("nations") * F.col("in_nation") * F.col("of_customer"))
    won = F.col("r").eqNullSafe(F.col("r0")) & F.col("n").eqNullSafe(F.col("n0")) & F.col("c").eqNullSafe(F.col("c0")) & (F.abs(p / want - 1) < 1e-9)
    lost = F.col("o").isNull() & (F.col("c").isNull() | F.col("of_customer").isNull())
    right = F.coalesce(F.when(p > 0, won).otherwise(lost), F.lit(False))
    return known.agg(F.count_if(~right).alias("wrong"), F.count("*").alias("walks"))


def _near(estimate: DataFrame, exact: DataFrame) -> DataFrame:
    return estimate.crossJoin(exact).select((F.abs(F.col("d") / F.col("exact") - 1) <= 0.05).alias("near"))


def _nations_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).agg(F.count_distinct("c_nationkey").alias("exact"))


def weighted_count_distinct_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the weighted estimate is within a twentieth of the exact count."""
    return _near(weighted_count_distinct(spark, sf_dir), _nations_with_orders(spark, sf_dir))


def chao_lee_count_distinct_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimate by coverage is within a twentieth of the exact count."""
    return _near(chao_lee_count_distinct(spark, sf_dir), _nations_with_orders(spark, sf_dir))


def wander_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, as in the order written all walks have the same probability: every customer has one nation."""
    e = engine(spark, sf_dir)
    e.force_order = True
    return sampling.estimate(e, f"{PREFIXES} SELECT (COUNT(*) AS ?n) {{ ?c customer:ref_c_nationkey ?x . ?x nation:n_name ?y }}", 1_000, seed=1).select(
        F.round("n", 6).alias("n"))


def weighted_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.estimate(engine(spark, sf_dir), f"{PREFIXES} SELECT (COUNT(DISTINCT ?n) AS ?d) {{ {JOINED} }}", 5_000, seed=1)


def chao_lee_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.estimate(engine(spark, sf_dir), f"{PREFIXES} SELECT (COUNT(DISTINCT ?n) AS ?d) {{ {JOINED} }}", 5_000, seed=1, method="chao_lee")


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct summaries of the nations' and regions' statements."""
    tables = {n: RelationalDataset(spark, sf_dir).tables[n] for n in ("region", "nation")}
    return federation.summarise(RelationalDataset(spark, sf_dir, tables).quads())


def graph_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct summaries of the statements of all tables."""
    return federation.summarise(RelationalDataset(spark, sf_dir).quads())


def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs that can answer each pattern of a join, found on the summary."""
    op = parse(f"{PREFIXES} SELECT * {{ ?x nation:n_name ?n . ?x nation:ref_n_regionkey ?g . ?g region:r_name ?r }}").op
    query = federation.source_query(op)
    return solutions(Engine(QuadDataset(graph_summary(spark, sf_dir))).relation(query), list(query.child.vars))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _whole(q) for name, q, _ in PAIRS},
    **{name: _paged(q, b) for name, q, b, _ in PAGED},
    "sample_walks": sample_walks,
    "sample_walks_checked": sample_walks_checked,
    "wander_join_count": wander_join_count,
    "weighted_count_distinct": weighted_count_distinct,
    "chao_lee_count_distinct": chao_lee_count_distinct,
    "weighted_count_distinct_near": weighted_count_distinct_near,
    "chao_lee_count_distinct_near": chao_lee_count_distinct_near,
    "graph_summary": graph_summary,
    "graph_summary_all": graph_summary_all,
    "source_selection": source_selection,
}

#: Columns of the mapped tables that are literals, as the tables have them.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic",
    "pages": "page_id url html", "benchmark": "item_id text", "conversations": "conv_id turn role text",
}


def _summary_sql() -> str:
    """A row for each table, column and reference that has a value anywhere in it, and one for each table's types."""
    root, rdf_type, parts = BASE.rstrip("/"), "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", []
    for name, columns in COLUMNS.items():
        start = f"SELECT '<{BASE}graph/{name}>' AS g, '<{root}>' AS s"
        for c in columns.split():
            found = f" WHERE EXISTS (SELECT 1 FROM {name} WHERE {c} IS NOT NULL)"
            parts.append(f"""{start}, '<{BASE}{name}#{c}>' AS p, '"any"' AS o{found}""")
            if c in TABLES_MAPPED[name].refs:
                parts.append(f"{start}, '<{BASE}{name}#ref_{c}>' AS p, '<{root}>' AS o{found}")
        parts.append(f"{start}, '<{rdf_type}>' AS p, '<{root}>' AS o WHERE EXISTS (SELECT 1 FROM {name})")
    return " UNION ALL ".join(parts)


_ROOT = BASE.rstrip("/")
ORACLE_SQL: dict[str, str] = {
    **{name: sql for name, _, sql in PAIRS},
    **{name: sql for name, _, _, sql in PAGED},
    "wander_join_count": "SELECT CAST(count(*) AS DOUBLE) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "sample_walks_checked": "SELECT CAST(0 AS BIGINT) AS wrong, CAST(10000 AS BIGINT) AS walks",
    "weighted_count_distinct_near": "SELECT true AS near",
    "chao_lee_count_distinct_near": "SELECT true AS near",
    "graph_summary_all": _summary_sql(),
    "graph_summary": f"""
        SELECT '<{BASE}graph/region>' AS g, '<{_ROOT}>' AS s, p, o FROM (VALUES
            ('<{BASE}region#r_regionkey>', '"any"'), ('<{BASE}region#r_name>', '"any"'),
            ('<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{_ROOT}>')) v(p, o)
        UNION ALL SELECT '<{BASE}graph/nation>', '<{_ROOT}>', p, o FROM (VALUES
            ('<{BASE}nation#n_nationkey>', '"any"'), ('<{BASE}nation#n_name>', '"any"'), ('<{BASE}nation#n_regionkey>', '"any"'),
            ('<{BASE}nation#ref_n_regionkey>', '<{_ROOT}>'), ('<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{_ROOT}>')) v(p, o)""",
    "source_selection": f"SELECT '<{BASE}graph/nation>' AS source1, '<{BASE}graph/nation>' AS source2, '<{BASE}graph/region>' AS source3",
}

FLAGSHIP = "bgp_join"
