"""Relational queries: one SQL text each, where needed with DuckDB's own spelling beside it.

Tables are named in braces, so that a query reads only those it uses and needs no
view in the session.
"""

from __future__ import annotations

#: name: text, or (Spark, DuckDB)
SQL: dict[str, str | tuple[str, str]] = {
    # access paths
    "scan_full": "SELECT * FROM {nation}",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey = 77",
    "pk_prefix_scan": "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_orderkey = 77",
    "range_scan": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey >= 100 AND o_orderkey < 400",
    "range_scan_desc": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 1",
    "order_by_index": "SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey = 3 ORDER BY c_custkey",
    "index_first_last": "SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM {orders}",
    "sec_index_eq": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = 42",
    "covering_read": "SELECT c_nationkey FROM {customer} WHERE c_nationkey BETWEEN 5 AND 9",
    "icp_filter": "SELECT o_orderkey FROM {orders} WHERE o_custkey < 200 AND o_custkey % 7 = 3 AND o_totalprice > 1000",
    "in_list": "SELECT p_partkey, p_name FROM {part} WHERE p_partkey IN (3, 17, 42, 99, 100000000, 150, 7, 8, 9, 11)",
    "rowid_refetch": "SELECT * FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 50)",
    # filters and expressions
    "filter_cmp": "SELECT c_custkey FROM {customer} WHERE c_acctbal > 0 AND c_acctbal <= 5000 AND c_nationkey <> 1",
    "filter_between": "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 10 AND 20",
    "filter_like_ci": "SELECT n_nationkey, n_name FROM {nation} WHERE n_name ILIKE '%A%'",
    "filter_null": "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS unknown FROM {orders} WHERE nullif(o_orderpriority, '1-URGENT') IS NULL OR (nullif(o_orderstatus, 'F') IS NOT NULL AND o_totalprice > 1000)",
    "expr_case": "SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'high' WHEN s_acctbal >= 0 THEN 'mid' ELSE 'low' END AS grade FROM {supplier}",
    "expr_if_nullif": "SELECT s_suppkey, if(s_acctbal > 0, 1, 0) AS positive, nullif(s_nationkey, 3) AS other_nation FROM {supplier}",
    "expr_coalesce": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM {customer}",
    "expr_arith": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax / 2, 4) AS net FROM {lineitem}",
    "expr_math": "SELECT p_partkey, round(pi() * p_size * p_size, 6) AS area FROM {part}",
    "project": "SELECT r_regionkey AS id, r_name AS name FROM {region}",
    "generated_cols": "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS total, concat(l_returnflag, '-', l_linestatus) AS flags FROM {lineitem}",
    "str_functions": (
        "SELECT p_partkey, upper(p_name) AS up, octet_length(p_name) AS n_bytes, concat(p_brand, '/', cast(p_size AS string)) AS tag, substring_index(p_name, ' ', 1) AS first_word, repeat('ab', 2) AS twice FROM {part}",
        "SELECT p_partkey, upper(p_name) AS up, strlen(p_name) AS n_bytes, concat(p_brand, '/', p_size::VARCHAR) AS tag, split_part(p_name, ' ', 1) AS first_word, repeat('ab', 2) AS twice FROM {part}",
    ),
    "date_functions": "SELECT cast(year(o_orderdate) AS int) AS y, cast(month(o_orderdate) AS int) AS m, count(*) AS n FROM {orders} GROUP BY 1, 2",
    "json_value": (
        "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM {events}",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}",
    ),
    # joins and subqueries
    "join_inner": "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "join_left_on": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 100000",
    "join_right": "SELECT s_suppkey, n_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey",
    "join_full": "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey",
    "join_cross": "SELECT n_name, r_name FROM {nation} CROSS JOIN {region} WHERE n_regionkey = r_regionkey AND r_regionkey > 1",
    "join_multi": "SELECT r_name, n_name, count(*) AS n_orders FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "join_self_theta": "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_agg": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey",
    "subq_scalar": "SELECT s_suppkey FROM {supplier} WHERE s_acctbal > (SELECT avg(s_acctbal) FROM {supplier})",
    "semi_in": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)",
    "semi_exists": "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "anti_not_exists": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)",
    # NOT IN as an anti join on distinct keys; what nulls do is left to numbers of rows, so that nothing that grows is broadcast
    "anti_not_in": (
        "SELECT p_partkey FROM {part} LEFT ANTI JOIN (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_quantity > 47) ON p_partkey = l_partkey WHERE (SELECT count_if(l_partkey IS NULL) FROM {lineitem} WHERE l_quantity > 47) = 0 AND (p_partkey IS NOT NULL OR (SELECT count(*) FROM {lineitem} WHERE l_quantity > 47) = 0)",
        "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 47)",
    ),
    "anti_not_in_null": (
        "SELECT count(*) AS n, count(DISTINCT k % 2) AS kinds FROM (SELECT p_partkey AS k FROM {part} LEFT ANTI JOIN (SELECT DISTINCT nullif(l_partkey, 7) AS x FROM {lineitem}) ON p_partkey = x WHERE (SELECT count_if(nullif(l_partkey, 7) IS NULL) FROM {lineitem}) = 0)",
        "SELECT count(*) AS n, count(DISTINCT k % 2) AS kinds FROM (SELECT p_partkey AS k FROM {part} WHERE p_partkey NOT IN (SELECT nullif(l_partkey, 7) FROM {lineitem}))",
    ),
    "subq_correlated": "SELECT s_suppkey, s_nationkey FROM {supplier} s WHERE s_acctbal = (SELECT max(x.s_acctbal) FROM {supplier} x WHERE x.s_nationkey = s.s_nationkey)",
    # > ALL and > ANY by one row of aggregates: true of no row at all, or beyond the greatest if no null is there; beyond the least
    "quant_all": (
        "SELECT s_suppkey FROM {supplier} WHERE (SELECT count(*) FROM {supplier} WHERE s_nationkey = 3) = 0 OR ((SELECT count_if(s_acctbal IS NULL) FROM {supplier} WHERE s_nationkey = 3) = 0 AND s_acctbal > (SELECT max(s_acctbal) FROM {supplier} WHERE s_nationkey = 3))",
        "SELECT s_suppkey FROM {supplier} WHERE s_acctbal > ALL (SELECT s_acctbal FROM {supplier} WHERE s_nationkey = 3)",
    ),
    "quant_all_empty": (
        "SELECT s_suppkey FROM {supplier} WHERE (SELECT count(*) FROM {supplier} WHERE s_nationkey = 99) = 0 OR ((SELECT count_if(s_acctbal IS NULL) FROM {supplier} WHERE s_nationkey = 99) = 0 AND s_acctbal > (SELECT max(s_acctbal) FROM {supplier} WHERE s_nationkey = 99))",
        "SELECT s_suppkey FROM {supplier} WHERE s_acctbal > ALL (SELECT s_acctbal FROM {supplier} WHERE s_nationkey = 99)",
    ),
    "quant_any": (
        "SELECT s_suppkey FROM {supplier} WHERE s_acctbal > (SELECT min(s_acctbal) FROM {supplier} WHERE s_nationkey = 3)",
        "SELECT s_suppkey FROM {supplier} WHERE s_acctbal > ANY (SELECT s_acctbal FROM {supplier} WHERE s_nationkey = 3)",
    ),
    "join_comma": "SELECT n_name, s_suppkey FROM {nation}, {supplier} WHERE s_nationkey = n_nationkey AND s_acctbal > 0",
    "in_list_long": "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_totalprice > 100000)",
    "derived_table": "SELECT d.k AS nation, d.n AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) d WHERE d.n > 10",
    "agg_nested": "SELECT round(max(a), 6) AS top FROM (SELECT avg(o_totalprice) AS a FROM {orders} GROUP BY o_custkey) t",
    # aggregation, order, sets
    "agg_global": "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem}",
    "agg_count_null": "SELECT count(*) AS n_all, count(nullif(l_returnflag, 'N')) AS n_some FROM {lineitem}",
    "agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_group_alias": "SELECT o_custkey % 10 AS bucket, count(*) AS n FROM {orders} GROUP BY bucket",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000",
    "agg_distinct": "SELECT count(DISTINCT l_suppkey) AS n_supp, count(DISTINCT l_partkey) AS n_part FROM {lineitem}",
    "select_distinct": "SELECT DISTINCT p_brand, p_size FROM {part}",
    "agg_group_concat": (
        "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    ),
    "dup_check": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1",
    "sort_multi": "SELECT s_nationkey, s_suppkey FROM {supplier} ORDER BY s_nationkey DESC, s_suppkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "topk_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "union_branch_limit": "(SELECT s_suppkey AS k FROM {supplier} ORDER BY s_suppkey LIMIT 3) UNION ALL (SELECT c_custkey FROM {customer} ORDER BY c_custkey DESC LIMIT 3)",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderkey % 3 = 0",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "window_rank": "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM {supplier}",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey",
    # tables after a change, as the query of the new contents
    "update_subquery": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000) THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM {customer}",
    "update_join": "SELECT s_suppkey, round(s_acctbal + coalesce(n_regionkey, 0), 2) AS s_acctbal FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey",
    # DELETE ... WHERE key NOT IN (...): what is left
    "delete_subquery": (
        "SELECT c_custkey FROM {customer} LEFT JOIN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_totalprice > 200000) ON c_custkey = o_custkey WHERE o_custkey IS NOT NULL OR (SELECT count_if(o_custkey IS NULL) FROM {orders} WHERE o_totalprice > 200000) > 0 OR (c_custkey IS NULL AND (SELECT count(*) FROM {orders} WHERE o_totalprice > 200000) > 0)",
        "SELECT c_custkey FROM {customer} WHERE NOT coalesce(c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000), false)",
    ),
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(grouping(l_returnflag) AS int) AS g FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())",
    "agg_approx": (
        "SELECT abs(approx_count_distinct(l_partkey) / count(DISTINCT l_partkey) - 1) < 0.15 AS distinct_near, abs(approx_percentile(l_quantity, 0.5) - percentile(l_quantity, 0.5)) <= 1 AS median_near FROM {lineitem}",
        "SELECT true AS distinct_near, true AS median_near",
    ),
    "window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quarter FROM {orders}",
    "cte_recursive": "WITH RECURSIVE t(k, depth) AS (SELECT 1, 1 UNION ALL SELECT k * 2, depth + 1 FROM t WHERE k < 1000) SELECT k, depth, n_name FROM t LEFT JOIN {nation} ON n_nationkey = k",
    "join_natural": "SELECT k, a, b FROM (SELECT c_custkey AS k, c_nationkey AS a FROM {customer}) NATURAL JOIN (SELECT s_suppkey AS k, s_nationkey AS b FROM {supplier})",
    "join_range": "SELECT s_suppkey, count(*) AS n FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey AND c_acctbal BETWEEN s_acctbal - 500 AND s_acctbal + 500 GROUP BY s_suppkey",
    "num_functions": "SELECT o_orderkey, cast(floor(o_totalprice / 1000) AS bigint) AS thousands, o_orderkey % 7 AS m, abs(-o_totalprice) AS p, sign(o_totalprice - 100000) AS s FROM {orders}",
    "unix_time": (
        "SELECT event_id, unix_micros(cast(ts AS timestamp)) DIV 1000000 AS seconds FROM {events}",
        "SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM {events}",
    ),
    "substring_index_last": (
        "SELECT p_partkey, substring_index(p_name, ' ', -1) AS last_word FROM {part}",
        "SELECT p_partkey, string_split(p_name, ' ')[-1] AS last_word FROM {part}",
    ),
    "selectivity_est": "SELECT o_custkey % 5 AS k, count(*) AS n, round(count(*) / (SELECT count(*) FROM {orders}), 6) AS share FROM {orders} GROUP BY o_custkey % 5",
    "part_range": "SELECT CASE WHEN o_orderkey < 1000 THEN 'p0' WHEN o_orderkey < 5000 THEN 'p1' ELSE 'pmax' END AS part, count(*) AS n FROM {orders} GROUP BY 1",
    "part_list": "SELECT CASE WHEN n_regionkey IN (0, 1) THEN 'west' WHEN n_regionkey IN (2, 3) THEN 'east' ELSE 'rest' END AS part, count(*) AS n FROM {nation} GROUP BY 1",
    "part_hash": "SELECT o_custkey % 4 AS part, count(*) AS n FROM {orders} GROUP BY 1",
    "index_cardinality": "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS d_order, count(DISTINCT l_suppkey) AS d_supp FROM {lineitem}",
    "table_stats": "SELECT count(*) AS n_rows, min(event_id) AS lo, max(event_id) AS hi, sum(octet_length(cast(props AS BINARY))) AS props_bytes FROM {events}",
}
SQL["table_stats"] = (SQL["table_stats"], SQL["table_stats"].replace("octet_length(cast(props AS BINARY))", "strlen(props)").replace("sum(strlen(props))", "sum(strlen(props))::BIGINT"))
