"""The registered queries of the engine and the DuckDB SQL that each is held against.

Every query is a pipeline text over the given tables, whose keys become ``_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.batch import compile_plan
from .plans.parser import parse
from .sources.catalog import Catalog
from .streaming.engine import Engine, TxResult

#: Key columns of the given tables; lineitem has none.
KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": None,
    "events": "event_id",
    "embeddings": "vec_id",
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog(spark)
    for name, key in KEYS.items():
        out.add_parquet(name, f"{sf_dir}/{name}.parquet", key)
    return out


#: name: (pipeline, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "from_project": (
        "(from :orders [o_custkey o_totalprice])",
        "SELECT o_orderkey AS _id, o_custkey, o_totalprice FROM orders",
    ),
    "from_star": (
        "(from :nation [*])",
        "SELECT *, n_nationkey AS _id, 'nation' AS _table FROM nation",
    ),
    "where_compare": (
        "(-> (from :orders [o_totalprice]) (where (>= o_totalprice 200000) (< o_totalprice 250000.5)))",
        "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_totalprice < 250000.5",
    ),
    "where_and_or_not": (
        '(-> (from :orders [o_orderstatus o_totalprice]) (where (or (and (= o_orderstatus "F") (> o_totalprice 300000)) (not (<= o_totalprice 450000)))))',
        "SELECT o_orderkey AS _id, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR NOT o_totalprice <= 450000",
    ),
    "where_truthy": (
        '(-> (from :orders [o_orderstatus]) (with {:s (null-if o_orderstatus "F")}) (where s))',
        "SELECT o_orderkey AS _id, o_orderstatus, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'",
    ),
    "where_nil_semantics": (
        '(-> (from :orders [o_orderstatus]) (where (!= (null-if o_orderstatus "F") "O")))',
        "SELECT o_orderkey AS _id, o_orderstatus FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'",
    ),
    "where_nil_compare": (
        '(-> (from :customer [c_acctbal c_mktsegment]) (with {:b (if (= c_mktsegment "FURNITURE") nil c_acctbal)}) (where (or (> b 5000) (nil? b))))',
        "SELECT * FROM (SELECT c_custkey AS _id, c_acctbal, c_mktsegment, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_acctbal END AS b FROM customer) WHERE b > 5000 OR b IS NULL",
    ),
    "like": (
        '(-> (from :customer [c_name]) (where (like c_name "%00_1")))',
        "SELECT c_custkey AS _id, c_name FROM customer WHERE c_name LIKE '%00_1'",
    ),
    "like_regex": (
        '(-> (from :part [p_type]) (where (like-regex p_type "[0-4]$|^[A-M]")))',
        "SELECT p_partkey AS _id, p_type FROM part WHERE regexp_matches(p_type, '[0-4]$|^[A-M]')",
    ),
    "with_arith": (
        "(-> (from :orders [o_custkey o_totalprice]) (with {:net (* o_totalprice (- 1 0.05)) :neg (- o_custkey) :ratio (/ o_totalprice 7) :inv (/ (+ o_custkey 1)) :more (+ o_custkey 2 3)}))",
        "SELECT o_orderkey AS _id, o_custkey, o_totalprice, o_totalprice * (1 - 0.05::DOUBLE) AS net, -o_custkey AS neg, o_totalprice / 7 AS ratio, 1.0::DOUBLE / (o_custkey + 1) AS inv, o_custkey + 5 AS more FROM orders",
    ),
    "with_sequence": (
        "(-> (from :orders [o_custkey]) (with {:a (+ o_custkey 1) :b (* a 2) :a (- b a)}))",
        "SELECT o_orderkey AS _id, o_custkey, o_custkey + 1 AS a, (o_custkey + 1) * 2 AS b FROM orders",
    ),
    "with_let": (
        "(-> (from :customer [c_acctbal]) (with {:x (let [a (* c_acctbal 2) b (+ a 1)] (- b a))}))",
        "SELECT c_custkey AS _id, c_acctbal, (c_acctbal * 2 + 1) - c_acctbal * 2 AS x FROM customer",
    ),
    "math_all": (
        "(-> (from :customer [c_acctbal c_custkey]) (with {:a (abs c_acctbal) :f (floor c_acctbal) :c (ceil c_acctbal) :r (round c_acctbal) :s (sqrt (abs c_acctbal)) :p (pow c_acctbal 2) :m (mod c_acctbal 7) :n (mod (- c_custkey) 5) :o (mod c_custkey -3)}))",
        "SELECT c_custkey AS _id, c_custkey, c_acctbal, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, floor(c_acctbal + 0.5)::BIGINT AS r, sqrt(abs(c_acctbal)) AS s, pow(c_acctbal, 2) AS p,"
        " ((trunc(c_acctbal)::BIGINT % 7) + 7) % 7 AS m, ((-c_custkey % 5) + 5) % 5 AS n, ((c_custkey % -3) + -3) % -3 AS o FROM customer",
    ),
    "string_all": (
        r'(-> (from :part [p_name]) (with {:t "\t  pad " :a (trim t) :b (trim-leading t) :c (trim-trailing t) :o (overlay p_name "XY" 2) :p (overlay p_name "XY" 2 1) :l (lower p_name) :u (upper p_name)}) (without t))',
        "SELECT p_partkey AS _id, p_name, 'pad' AS a, 'pad ' AS b, chr(9) || '  pad' AS c, substr(p_name, 1, 1) || 'XY' || substr(p_name, 4) AS o, substr(p_name, 1, 1) || 'XY' || substr(p_name, 3) AS p, lower(p_name) AS l, upper(p_name) AS u FROM part",
    ),
    "control_all": (
        '(-> (from :orders [o_orderstatus o_totalprice]) (with {:i (if (> o_totalprice 250000) "big" "small") :c (case (= o_orderstatus "F") 1 (= o_orderstatus "O") 2 3) :d (cond (> o_totalprice 400000) "top" (> o_totalprice 100000) "mid") :n (null-if o_orderstatus "P") :e (coalesce n "none") :z (or n "other")}))',
        "SELECT o_orderkey AS _id, o_orderstatus, o_totalprice, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS i, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::BIGINT AS c,"
        " CASE WHEN o_totalprice > 400000 THEN 'top' WHEN o_totalprice > 100000 THEN 'mid' END AS d, nullif(o_orderstatus, 'P') AS n, coalesce(nullif(o_orderstatus, 'P'), 'none') AS e, coalesce(nullif(o_orderstatus, 'P'), 'other') AS z FROM orders",
    ),
    "predicates": (
        '(-> (from :orders [o_orderstatus o_totalprice]) (with {:b (> o_totalprice 250000) :t (true? b) :f (false? b) :x (true? o_orderstatus) :y (nil? (null-if o_orderstatus "O")) :z (<> o_orderstatus 5)}))',
        "SELECT o_orderkey AS _id, o_orderstatus, o_totalprice, o_totalprice > 250000 AS b, o_totalprice > 250000 AS t, NOT o_totalprice > 250000 AS f, false AS x, o_orderstatus = 'O' AS y, true AS z FROM orders",
    ),
    "without": (
        "(-> (from :nation [*]) (without n_name :n_regionkey missing))",
        "SELECT n_nationkey, n_nationkey AS _id, 'nation' AS _table FROM nation",
    ),
    "return_distinct": (
        "(-> (from :customer [c_mktsegment c_nationkey]) (return c_mktsegment c_nationkey nothing))",
        "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    ),
    "unnest_array": (
        "(-> (from :embeddings [embedding]) (unnest {:x embedding}) (return xt/id x))",
        "SELECT DISTINCT vec_id AS _id, unnest(embedding) AS x FROM embeddings",
    ),
    "unnest_empty": (
        '(-> (rel [{:a 1 :t ["x" "y"]} {:a 2 :t []} {:a 3}]) (unnest {:u t}) (return a u))',
        "SELECT * FROM (VALUES (1::BIGINT, 'x'), (1, 'y'), (2, NULL), (3, NULL)) v(a, u)",
    ),
    "aggregate_global": (
        "(-> (from :orders [o_totalprice]) (aggregate {:n (row-count) :top (max o_totalprice)}))",
        "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders",
    ),
    "aggregate_empty": (
        "(-> (from :orders [o_totalprice]) (where (< o_totalprice 0)) (aggregate {:n (row-count)}))",
        "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0",
    ),
    "aggregate_key": (
        "(-> (from :orders [o_orderpriority o_totalprice]) (aggregate :o_orderpriority {:n (row-count) :low (min o_totalprice)}))",
        "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY o_orderpriority",
    ),
    "aggregate_symbol_key": (
        "(-> (from :orders [o_orderstatus]) (aggregate o_orderstatus {:n (row-count)}))",
        "SELECT o_orderstatus AS group_key, count(*) AS n FROM orders GROUP BY 1",
    ),
    "aggregate_vector_key": (
        "(-> (from :customer [c_mktsegment c_nationkey]) (aggregate [c_mktsegment c_nationkey] {:n (row-count)}) (with {:seg (.. group_key :c_mktsegment) :nat (.. group_key 1)}) (without group_key))",
        "SELECT c_mktsegment AS seg, c_nationkey AS nat, count(*) AS n FROM customer GROUP BY 1, 2",
    ),
    "aggregate_functions": (
        '(-> (from :orders [o_orderstatus o_orderpriority o_totalprice o_custkey]) (with {:s (null-if o_orderstatus "P") :v (if s o_totalprice nil)})'
        " (aggregate :o_orderpriority {:n (row-count) :total (sum v) :low (min v) :high (max v) :mean (avg v) :kinds (count-distinct s) :customers (count-distinct o_custkey)})"
        " (with {:total (/ (round (* total 100)) 100) :mean (/ (round (* mean 10000)) 10000)}))",
        "SELECT o_orderpriority, count(*) AS n, floor(sum(v) * 100 + 0.5) / 100 AS total, min(v) AS low, max(v) AS high, floor(avg(v) * 10000 + 0.5) / 10000 AS mean,"
        " count(DISTINCT s) + max(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS kinds, count(DISTINCT o_custkey) AS customers"
        " FROM (SELECT *, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) GROUP BY 1",
    ),
    "aggregate_set_semantics": (
        "(-> (from :orders [o_orderstatus o_custkey]) (return o_orderstatus o_custkey) (aggregate :o_orderstatus {:n (row-count)}))",
        "SELECT o_orderstatus, count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) GROUP BY 1",
    ),
    "limit_rows": (
        "(-> (from :orders [o_totalprice]) (where (> o_totalprice 100000)) (limit 25))",
        "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY 1 LIMIT 25",
    ),
    "offset_rows": (
        "(-> (from :customer [c_name]) (offset 40))",
        "SELECT c_custkey AS _id, c_name FROM customer ORDER BY 1 OFFSET 40",
    ),
    "offset_limit": (
        "(-> (from :customer [c_name]) (offset 40) (limit 7))",
        "SELECT c_custkey AS _id, c_name FROM customer ORDER BY 1 LIMIT 7 OFFSET 40",
    ),
    "rel_inline": (
        '(-> (rel [{:a 1 :b "x"} {:a 2.5 :b "y"} {:b "z"}]) (where (nil? (null-if b "x"))))',
        "SELECT 1.0::DOUBLE AS a, 'x' AS b",
    ),
    "rel_join": (
        '(-> (rel [{:n_regionkey 0 :tag "zero"} {:n_regionkey 3 :tag "three"}]) (join (from :nation [n_name n_regionkey]) {:n_regionkey :n_regionkey}))',
        "SELECT v.n_regionkey, v.tag, n.n_name, n.n_nationkey AS _id FROM (VALUES (0::BIGINT, 'zero'), (3, 'three')) v(n_regionkey, tag) JOIN nation n ON n.n_regionkey = v.n_regionkey",
    ),
    "join_inner": (
        "(-> (from :orders [o_custkey o_totalprice]) (join (from :customer [c_mktsegment]) {:o_custkey :xt/id}) (where (> o_totalprice 200000)))",
        "SELECT o_orderkey AS _id, o_custkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000",
    ),
    "join_many": (
        "(-> (from :customer [c_name]) (join (from :orders [o_custkey o_totalprice]) {:xt/id :o_custkey}))",
        "SELECT DISTINCT c_custkey AS _id, c_name, o_custkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey",
    ),
    "join_nil_keys": (
        '(-> (from :orders [o_orderstatus]) (with {:s (null-if o_orderstatus "F")}) (join (rel [{:s nil :tag "none"} {:s "O" :tag "open"}]) {:s :s}))',
        "SELECT o_orderkey AS _id, o_orderstatus, v.s, v.tag FROM orders JOIN (VALUES (NULL, 'none'), ('O', 'open')) v(s, tag) ON nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM v.s",
    ),
    "join_multi_key": (
        '(-> (from :orders [o_custkey o_orderstatus]) (join (-> (from :orders [o_custkey o_orderstatus]) (where (= o_orderstatus "F")) (with {:x o_custkey :y o_orderstatus}) (return xt/id x y)) {:xt/id :xt/id :o_custkey :x}))',
        "SELECT o_orderkey AS _id, o_custkey, o_orderstatus, o_custkey AS x, o_orderstatus AS y FROM orders WHERE o_orderstatus = 'F'",
    ),
    "join_nested": (
        "(-> (from :customer [c_nationkey c_acctbal]) (join (-> (from :nation [n_name n_regionkey]) (join (from :region [r_name]) {:n_regionkey :xt/id})) {:c_nationkey :xt/id}) (join (rel [{:r_name \"ASIA\"} {:r_name \"EUROPE\"} {:r_name \"REGION_1\"}]) {:r_name :r_name}))",
        "SELECT c_custkey AS _id, c_nationkey, c_acctbal, n_name, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'REGION_1')",
    ),
    "left_join": (
        "(-> (from :customer [c_name]) (left-join (-> (from :orders [o_custkey o_totalprice]) (where (> o_totalprice 300000))) {:xt/id :o_custkey}))",
        "SELECT DISTINCT c_custkey AS _id, c_name, o_custkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000",
    ),
    "unify_two_keys": (
        '(unify (from :orders [o_custkey o_totalprice]) (-> (from :orders [o_custkey o_orderstatus]) (where (= o_orderstatus "O")) (with {:o_totalprice -1})) {:xt/id :xt/id :o_custkey :o_custkey})',
        "SELECT o_orderkey AS _id, o_custkey, -1::BIGINT AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O'",
    ),
    "exists_flag": (
        "(-> (from :customer [c_name]) (with {:big (exists (-> (from :orders [o_custkey o_totalprice]) (where (> o_totalprice 400000))) {:xt/id :o_custkey})}))",
        "SELECT c_custkey AS _id, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer",
    ),
    "exists_local": (
        "(-> (from :embeddings [embedding]) (exists :strong (-> (unnest {:x embedding}) (where (> x 0.4)))) (return xt/id strong))",
        "SELECT vec_id AS _id, len(list_filter(embedding, lambda x: x > 0.4)) > 0 AS strong FROM embeddings",
    ),
    "pull_one": (
        "(-> (from :orders [o_custkey]) (pull :c (from :customer [c_name c_mktsegment]) {:o_custkey :xt/id}) (with {:name (.. c :c_name) :seg (.. c c_mktsegment)}) (without c))",
        "SELECT o_orderkey AS _id, o_custkey, c_name AS name, c_mktsegment AS seg FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    ),
    "pull_first": (
        "(-> (from :nation [n_name]) (pull :c (from :customer [c_nationkey c_name]) {:xt/id :c_nationkey}) (with {:first (.. c :xt/id) :name (.. c :c_name)}) (without c))",
        "SELECT n_nationkey AS _id, n_name, min(c_custkey) AS first, arg_min(c_name, c_custkey) AS name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
    ),
    "pull_star": (
        "(-> (from :customer [c_name]) (pull* :os (-> (from :orders [o_custkey o_totalprice]) (where (> o_totalprice 450000))) {:xt/id :o_custkey}) (unnest {:o os}) (with {:key (.. o :xt/id) :price (.. o :o_totalprice) :first (.. os 0 :xt/id)}) (return xt/id key price first))",
        "SELECT c_custkey AS _id, o_orderkey AS key, o_totalprice AS price, first_value(o_orderkey) OVER (PARTITION BY c_custkey ORDER BY o_totalprice, o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000",
    ),
    "nested_path": (
        '(-> (rel [{:a {:b [{:c 1} {:c 2}] :t true}} {:a {:b []}} {:a nil}]) (with {:x (.. a :b 1 :c) :y (.. a :b 5) :t (.. a :t)}) (with {:z (nil? y)}) (return x z t))',
        "SELECT * FROM (VALUES (2::BIGINT, true, true), (NULL, true, NULL)) v(x, z, t)",
    ),
    "lineitem_no_key": (
        "(-> (from :lineitem [l_returnflag l_linestatus l_quantity]) (aggregate :l_returnflag {:n (row-count) :q (sum l_quantity)}))",
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem) GROUP BY 1",
    ),
    "lineitem_revenue": (
        "(-> (from :lineitem [*]) (where (< l_discount 0.05)) (with {:net (* l_extendedprice (- 1 l_discount))}) (aggregate [l_returnflag l_linestatus] {:n (row-count) :net (sum net) :most (max l_quantity)})"
        " (with {:flag (.. group_key 0) :status (.. group_key 1) :net (round net)}) (without group_key))",
        "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5)::BIGINT AS net, max(l_quantity) AS most FROM (SELECT DISTINCT * FROM lineitem) WHERE l_discount < 0.05 GROUP BY 1, 2",
    ),
    "pipeline_flagship": (
        '(-> (from :orders [o_custkey o_orderpriority o_totalprice]) (join (from :customer [c_mktsegment c_nationkey]) {:o_custkey :xt/id}) (where (and (> o_totalprice 50000) (like c_mktsegment "%U%")))'
        ' (with {:net (* o_totalprice 0.9) :band (case (> net 300000) "high" (> net 150000) "mid" "low")}) (aggregate [c_mktsegment band] {:n (row-count) :net (sum net) :nations (count-distinct c_nationkey)})'
        " (with {:seg (.. group_key 0) :band (.. group_key 1) :net (round net)}) (without group_key) (where (> n 5)) (limit 100))",
        "SELECT c_mktsegment AS seg, CASE WHEN o_totalprice * 0.9::DOUBLE > 300000 THEN 'high' WHEN o_totalprice * 0.9::DOUBLE > 150000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n, floor(sum(o_totalprice * 0.9::DOUBLE) + 0.5)::BIGINT AS net, count(DISTINCT c_nationkey) AS nations"
        " FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 AND c_mktsegment LIKE '%U%' GROUP BY 1, 2 HAVING count(*) > 5",
    ),
}


def _batch(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: compile_plan(parse(text), catalog(spark, sf_dir))


# -- incremental: apply transactions, then return the maintained result -----------

_JOINED = "(-> (from :orders [o_custkey o_totalprice o_orderstatus]) (join (from :customer [c_mktsegment]) {:o_custkey :xt/id}))"

#: name: (pipeline, SQL over cust and ord, the tables as the transactions leave them)
INCREMENTAL: dict[str, tuple[str, str]] = {
    "inc_aggregate": (
        "(-> (from :orders [o_orderstatus o_totalprice]) (aggregate :o_orderstatus {:n (row-count) :high (max o_totalprice) :low (min o_totalprice)}))",
        "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS high, min(o_totalprice) AS low FROM ord GROUP BY 1",
    ),
    "inc_join": (
        f"{_JOINED[:-1]} (where (> o_totalprice 100000)))",
        "SELECT o_orderkey AS _id, o_custkey, o_totalprice, o_orderstatus, c_mktsegment FROM ord JOIN cust ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    ),
    "inc_join_aggregate": (
        f"{_JOINED[:-1]} (aggregate :c_mktsegment {{:n (row-count) :statuses (count-distinct o_orderstatus)}}))",
        "SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_orderstatus) AS statuses FROM ord JOIN cust ON o_custkey = c_custkey GROUP BY 1",
    ),
    "inc_left_join": (
        "(-> (from :customer [c_name]) (left-join (-> (from :orders [o_custkey o_totalprice]) (where (> o_totalprice 300000))) {:xt/id :o_custkey}))",
        "SELECT DISTINCT c_custkey AS _id, c_name, o_custkey, o_totalprice FROM cust LEFT JOIN ord ON o_custkey = c_custkey AND o_totalprice > 300000",
    ),
    "inc_distinct": (
        "(-> (from :orders [o_custkey o_orderstatus]) (return o_custkey o_orderstatus))",
        "SELECT DISTINCT o_custkey, o_orderstatus FROM ord",
    ),
    "inc_exists": (
        "(-> (from :customer [c_name]) (exists :big (-> (from :orders [o_custkey o_totalprice]) (where (> o_totalprice 400000))) {:xt/id :o_custkey}))",
        "SELECT c_custkey AS _id, c_name, EXISTS (SELECT 1 FROM ord WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM cust",
    ),
    "inc_unify": (
        "(unify (from :orders [o_custkey o_orderstatus]) (-> (from :customer [c_mktsegment]) (with {:o_custkey xt/id})) {:o_custkey :o_custkey})",
        "SELECT DISTINCT c_custkey AS _id, o_custkey, o_orderstatus, c_mktsegment FROM ord JOIN cust ON o_custkey = c_custkey",
    ),
    "inc_global": (
        "(-> (from :orders [o_totalprice]) (aggregate {:n (row-count) :high (max o_totalprice)}))",
        "SELECT count(*) AS n, max(o_totalprice) AS high FROM ord",
    ),
    "inc_pull": (
        "(-> (from :orders [o_custkey]) (pull :c (from :customer [c_name c_mktsegment]) {:o_custkey :xt/id}) (with {:name (.. c :c_name) :seg (.. c c_mktsegment)}) (without c))",
        "SELECT o_orderkey AS _id, o_custkey, c_name AS name, c_mktsegment AS seg FROM ord LEFT JOIN cust ON c_custkey = o_custkey",
    ),
    "inc_pull_star": (
        "(-> (from :customer [c_name]) (pull* :os (-> (from :orders [o_custkey o_totalprice]) (where (> o_totalprice 400000))) {:xt/id :o_custkey}) (unnest {:o os}) (with {:key (.. o :xt/id) :price (.. o :o_totalprice)}) (return xt/id key price))",
        "SELECT c_custkey AS _id, o_orderkey AS key, o_totalprice AS price FROM cust LEFT JOIN ord ON o_custkey = c_custkey AND o_totalprice > 400000",
    ),
    "inc_limit": (
        "(-> (from :orders [o_totalprice]) (where (< o_totalprice 200000)) (offset 5) (limit 20))",
        "SELECT o_orderkey AS _id, o_totalprice FROM ord WHERE o_totalprice < 200000 ORDER BY 1 LIMIT 20 OFFSET 5",
    ),
}

#: What the transactions below leave of both tables.
_AFTER = """
WITH ord AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey % 10 <> 7
), cust AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 5 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_custkey % 10 <> 9
)
"""


def _put(df: DataFrame) -> DataFrame:
    return df.withColumn("_op", F.lit("put"))


def _gone(df: DataFrame) -> DataFrame:
    return df.withColumn("_op", F.lit("delete"))


def _result(engine: Engine, *done: TxResult) -> DataFrame:
    for error in (e for d in done for e in d.errors.values()):
        raise error
    return engine.query_results("q")


def _incremental(text: str, late: bool = False, feeds: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """The transactions above; ``late``: the query comes after the first of them; ``feeds``: each table has a feed that numbers its batches from 0."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        orders = read("orders").select(F.col("o_orderkey").alias("_id"), "o_custkey", "o_orderstatus", "o_totalprice")
        customers = read("customer").select(F.col("c_custkey").alias("_id"), "c_name", "c_mktsegment")
        engine = Engine(spark)
        if not late:
            engine.register_query("q", text)
        apply = lambda table, changes, n: engine.apply_changes(table, changes, n if feeds else None, table if feeds else "")
        # Customers come, then all orders; some orders change and others go; last, customers change and go.
        done = [apply("customer", _put(customers), 0), apply("orders", _put(orders), 0)]
        if late:
            engine.register_query("q", text, backfill=True)
        changed = orders.where("_id % 10 = 3").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") / 2})
        done.append(apply("orders", _put(changed).unionByName(_gone(orders.where("_id % 10 = 7"))), 1))
        moved = customers.where("_id % 10 = 5").withColumn("c_mktsegment", F.lit("MOVED"))
        done.append(apply("customer", _put(moved).unionByName(_gone(customers.where("_id % 10 = 9"))), 1))
        if feeds:  # a batch that comes again changes nothing
            done.append(apply("customer", _gone(customers), 1))
        return _result(engine, *done)

    return run


def _unnested(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("_id"), "embedding")
    engine = Engine(spark)
    engine.register_query("q", "(-> (from :vectors [embedding]) (unnest {:x embedding}) (where (> x 0.4)) (return xt/id x))")
    halved = vectors.where("_id % 10 = 3").withColumn("embedding", F.slice("embedding", 1, 8))
    return _result(engine, engine.apply_changes("vectors", _put(vectors)), engine.apply_changes("vectors", _put(halved).unionByName(_gone(vectors.where("_id % 10 = 7")))))


def _documents_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by ``execute_tx``: both tables at once, then an update and deletes in one transaction."""
    rows = {t: [{"xt/id" if k == key else k: v for k, v in r.asDict().items()} for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(key, *names).collect()]
            for t, key, names in (("nation", "n_nationkey", ["n_name", "n_regionkey"]), ("region", "r_regionkey", ["r_name"]))}
    engine = Engine(spark)
    engine.register_query("q", "(-> (from :nation [n_name n_regionkey]) (join (from :region [r_name]) {:n_regionkey :xt/id}))")
    first = engine.execute_tx([("put-docs", t, *docs) for t, docs in rows.items()])
    moved = [d | {"n_name": "MOVED"} for d in rows["nation"] if d["n_regionkey"] == 1]
    gone = [d["xt/id"] for d in rows["nation"] if d["xt/id"] % 5 == 4]
    return _result(engine, first, engine.execute_tx([("put-docs", "nation", *moved), ("delete-docs", "nation", *gone)]))


def _from_files(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{Engine(spark).store.path}/customer"  # goes when the program ends
        customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
        options = {"header": "true"} if fmt == "csv" else {}
        customers.write.options(**options).format(fmt).save(path)
        found = Catalog(spark).add_file("customer", path, fmt, "c_custkey", customers.schema.simpleString()[len("struct<") : -1].replace(":", " "), **options)
        return compile_plan(parse("(-> (from :customer [c_name c_nationkey]) (where (> c_nationkey 10)))"), found)

    return run


#: name: (query, SQL)
_BACKFILLED, _FED = INCREMENTAL["inc_join_aggregate"], INCREMENTAL["inc_join"]
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "inc_backfill": (_incremental(_BACKFILLED[0], late=True), _AFTER + _BACKFILLED[1]),
    "inc_two_feeds": (_incremental(_FED[0], feeds=True), _AFTER + _FED[1]),
    "inc_unnest": (
        _unnested,
        "SELECT DISTINCT _id, x FROM (SELECT vec_id AS _id, unnest(CASE WHEN vec_id % 10 = 3 THEN embedding[1:8] ELSE embedding END) AS x FROM embeddings WHERE vec_id % 10 <> 7) WHERE x > 0.4",
    ),
    "inc_execute_tx": (
        _documents_put,
        "SELECT n_nationkey AS _id, CASE WHEN n_regionkey = 1 THEN 'MOVED' ELSE n_name END AS n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4",
    ),
    **{f"source_{fmt}": (_from_files(fmt), "SELECT c_custkey AS _id, c_name, c_nationkey FROM customer WHERE c_nationkey > 10") for fmt in ("csv", "json", "orc")},
}

QUERIES = {n: _batch(t) for n, (t, _) in TEXTS.items()} | {n: _incremental(t) for n, (t, _) in INCREMENTAL.items()} | {n: q for n, (q, _) in OTHERS.items()}
ORACLE_SQL = {n: s for n, (_, s) in TEXTS.items()} | {n: _AFTER + s for n, (_, s) in INCREMENTAL.items()} | {n: s for n, (_, s) in OTHERS.items()}
FLAGSHIP = "pipeline_flagship"
