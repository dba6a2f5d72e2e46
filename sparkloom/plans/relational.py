"""Queries over the tables, written once in the front door's dialect.

Each text is run by :func:`sparkloom.sql.query` and, as it stands, by DuckDB; where
the two need different words the entry is a pair (ours, DuckDB's).
"""

from __future__ import annotations

L = "lineitem"

SCANS = {
    "scan_project": "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS v, upper(l_returnflag) AS f FROM lineitem",
    "scan_star": "SELECT * FROM orders",
    "scan_pruned_count": "SELECT count(*) AS n FROM orders WHERE o_orderkey < 1000",
    "no_from": "SELECT 1 + 2 AS a, 'x' || 'y' AS b, NULL IS NULL AS c",
    "values_from": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS v(a, b) WHERE a IS NULL OR a > 1",
    "derived_table": "SELECT s.f, s.n FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1) AS s WHERE s.n > 10",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus",
    "cte_chain": "WITH a AS (SELECT o_custkey, o_totalprice FROM orders), b AS (SELECT o_custkey, max(o_totalprice) AS m FROM a GROUP BY o_custkey) SELECT count(*) AS n, round(sum(m), 2) AS s FROM b",
    "cte_recursive": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(sum(n) AS BIGINT) AS s FROM r",
}

FILTERS = {
    "filter_three_valued": "SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END) > 0 OR c_nationkey = 1 AS keep FROM customer",
    "filter_in_list": "SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey NOT IN (1, 2, 3)",
    "filter_in_many": f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN ({', '.join(str(7 * k) for k in range(1, 101))})",
    "filter_not_in_null": "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (1, NULL)",
    "filter_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_orderkey NOT BETWEEN 100 AND 500",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_%' AND p_type NOT LIKE 'S%'",
    "filter_ilike": "SELECT count(*) AS n FROM part WHERE p_type ILIKE '%BRASS%' OR p_brand ILIKE 'brand#1_'",
    "filter_like_escape": "SELECT count(*) AS n FROM part WHERE p_name LIKE '%!%%' ESCAPE '!' OR p_brand LIKE 'Brand#1_' ESCAPE '!'",
    "filter_glob": "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[12]?' AND p_name NOT GLOB '*x*'",
    "filter_boolean_coercion": "SELECT count(*) AS n FROM lineitem WHERE CAST(l_linenumber - 1 AS BOOLEAN)",
    "filter_is_distinct": "SELECT count(*) AS n FROM customer WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 5",
    "filter_null_tests": "SELECT count(*) FILTER (WHERE nullif(l_linenumber, 2) IS NULL) AS a, count(*) FILTER (WHERE nullif(l_linenumber, 2) IS NOT NULL) AS b FROM lineitem",
    "filter_timestamp": "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
}

EXPRESSIONS = {
    "expr_arithmetic": "SELECT l_orderkey, l_linenumber, l_quantity * 2 - 1 AS a, -l_quantity + l_tax AS b, l_linenumber * 3 + 1 AS c, round(l_extendedprice * (1 - l_discount), 4) AS d FROM lineitem",
    "expr_division": "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS a, l_quantity / 3 AS b, l_orderkey / l_linenumber / 2 AS c FROM lineitem",
    "expr_division_float_zero": "SELECT o_orderkey, CASE WHEN o_orderkey / (o_orderkey % 2) > 1e300 THEN 'inf' ELSE 'fin' END AS d FROM orders",
    "expr_int_div_mod": "SELECT l_orderkey, l_linenumber, CAST(-l_orderkey // 7 AS BIGINT) AS a, CAST(l_orderkey % 5 AS BIGINT) AS b, CAST(-l_orderkey % 5 AS BIGINT) AS c FROM lineitem",
    "expr_concat_null": "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, c_name || nullif(c_mktsegment, c_mktsegment) AS b, concat(c_name, NULL, c_mktsegment) AS c, concat_ws('/', c_name, NULL, c_mktsegment) AS d FROM customer",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS c FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c FROM orders",
    "coalesce_nullif": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, ifnull(nullif(c_nationkey, 3), -1) AS b FROM customer",
    "cast_matrix": "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS a, CAST(l_quantity AS INTEGER) AS b, CAST(l_orderkey AS VARCHAR) AS c, CAST('12' AS INTEGER) AS d, l_linenumber::DOUBLE AS e, CAST(l_shipdate AS DATE) AS f FROM lineitem",
    "cast_decimal": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) AS a, CAST(1.5 AS INTEGER) AS b, CAST(2.5 AS DOUBLE)::INTEGER AS c FROM orders",
    "bit_ops": "SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 3 AS b, l_orderkey << 2 AS c, l_orderkey >> 1 AS d, ~l_orderkey AS e FROM lineitem",
    "scalar_min_max": ("SELECT l_orderkey, l_linenumber, min(l_quantity, l_linenumber, 5) AS a, max(l_quantity, 10) AS b FROM lineitem", "SELECT l_orderkey, l_linenumber, least(l_quantity, l_linenumber, 5) AS a, greatest(l_quantity, 10) AS b FROM lineitem"),
}

JOINS = {
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 7",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
    "join_full": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey",
    "join_cross_limited": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n ORDER BY r.r_name, n.n_name LIMIT 20",
    "join_comma": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_using": "SELECT k, a, b FROM (SELECT o_custkey AS k, o_orderkey AS a FROM orders) x JOIN (SELECT c_custkey AS k, c_name AS b FROM customer) y USING (k)",
    "join_natural": "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "join_theta": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_self": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_star": "SELECT r.r_name, count(*) AS n, round(sum(l.l_extendedprice), 2) AS v FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "join_chain": "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY n.n_name",
    "join_many_groups": "SELECT o.o_custkey AS k, count(*) AS n, round(sum(l.l_quantity), 2) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey",
    "join_null_keys": "SELECT a.k AS x, b.k AS y FROM (SELECT nullif(n_nationkey % 4, 0) AS k FROM nation) a JOIN (SELECT DISTINCT nullif(n_nationkey % 4, 0) AS k FROM nation) b ON a.k = b.k",
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "exists_correlated": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "not_exists": "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)",
    "in_multi_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_size FROM part)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "scalar_subquery_correlated": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "scalar_subquery_select": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
}

AGGREGATES = {
    "agg_global": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem",
    "agg_empty_input": "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS a, min(l_tax) AS lo FROM lineitem WHERE l_orderkey < 0",
    "agg_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_by_expr_ordinal_alias": "SELECT l_orderkey % 10 AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY k",
    "agg_group_by_expr": "SELECT substr(o_orderpriority, 1, 1) AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY substr(o_orderpriority, 1, 1), year(o_orderdate)",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 200000",
    "agg_filter_clause": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS a, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS b FROM lineitem GROUP BY l_returnflag",
    "agg_count_distinct_multi": "SELECT l_returnflag, count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_expr_over_agg": "SELECT l_linestatus, round(sum(l_extendedprice) / count(*), 4) AS a, max(l_quantity) - min(l_quantity) AS r FROM lineitem GROUP BY l_linestatus",
    "agg_null_group": "SELECT nullif(l_linenumber, 3) AS k, count(*) AS n, count(nullif(l_linenumber, 3)) AS m FROM lineitem GROUP BY 1",
    "agg_high_cardinality": "SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS m FROM lineitem GROUP BY l_orderkey",
    "agg_distinct_rows": "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) AS d",
}

WINDOWS = {
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank_dense": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS d FROM orders",
    "win_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders",
    "win_first_last": "SELECT o_orderkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM orders",
    "win_running_sum_avg_count": "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, round(avg(o_totalprice) OVER w, 4) AS a, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_filter": "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders",
    "win_whole_partition": "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem",
    "win_top_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
}

SORTS = {
    "sort_nulls_last": "SELECT k, v FROM (SELECT nullif(n_nationkey % 5, 0) AS k, n_nationkey AS v FROM nation) t ORDER BY k, v LIMIT 22",
    "sort_nulls_last_desc": "SELECT k, v FROM (SELECT nullif(n_nationkey % 5, 0) AS k, n_nationkey AS v FROM nation) t ORDER BY k DESC, v LIMIT 21",
    "sort_nulls_first": "SELECT k, v FROM (SELECT nullif(n_nationkey % 5, 0) AS k, n_nationkey AS v FROM nation) t ORDER BY k NULLS FIRST, v LIMIT 8",
    "sort_multi_hidden_key": "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50",
    "sort_by_aggregate": "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"),
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
}

SETS = {
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
}

TEXT = {
    "fn_text_case_trim": "SELECT c_custkey, upper(c_mktsegment) AS a, lower(c_name) AS b, trim('  x ') AS c, ltrim(c_name, 'Cu') AS d, rtrim(c_mktsegment, 'GY') AS e, upper('straße') AS f FROM customer",
    "fn_substr_left_right": "SELECT c_custkey, substr(c_name, 3) AS a, substr(c_name, 0, 3) AS b, substr(c_name, -4, 2) AS c, left(c_name, 4) AS d, left(c_name, -4) AS e, right(c_name, 3) AS f, right(c_name, -3) AS g FROM customer",
    "fn_pad_split": "SELECT c_custkey, lpad(c_mktsegment, 12, '*') AS a, rpad(c_mktsegment, 4, 'ab') AS b, split_part(c_name, '#', 1) AS c, split_part(c_name, '#', 2) AS d, split_part(c_name, '#', 9) AS e, split_part(c_name, '#', -1) AS f FROM customer",
    "fn_search": "SELECT p_partkey, instr(p_name, 'a') AS a, strpos(p_type, 'L') AS b, contains(p_type, 'BRASS') AS c, starts_with(p_brand, 'Brand#1') AS d, replace(p_brand, '#', '-') AS e, length(p_name) AS f FROM part",
    "fn_regexp": r"SELECT p_partkey, regexp_extract(p_brand, '(\d)(\d)', 1) AS a, regexp_extract(p_brand, 'zzz', 0) AS b, regexp_extract(p_name, '[a-z]+', 0) AS c FROM part",
    "fn_hex_blob": "SELECT p_partkey, hex(p_brand) AS a, decode(unhex('68656C6C6F')) AS b, octet_length(encode(p_name)) AS c FROM part".replace("octet_length(encode(p_name))", "strlen(p_name)"),
    "fn_format": "SELECT p_partkey, format('{}', p_brand) AS a FROM part".replace("format('{}', p_brand)", "printf('%s-%05d', p_brand, p_size)"),
    "fn_char_unicode": "SELECT p_partkey, chr(65 + p_size % 26) AS a, unicode(p_name) AS b FROM part",
}

MATH = {
    "fn_math": "SELECT p_partkey, round(sqrt(p_size), 9) AS a, round(ln(p_retailprice), 9) AS b, round(log10(p_retailprice), 9) AS c, round(log2(p_size), 9) AS d, round(exp(p_size / 50), 9) AS e, round(pow(p_size, 2), 6) AS f, round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 9) AS g, round(degrees(pi()), 6) AS h FROM part",
    "fn_round": "SELECT p_partkey, round(p_retailprice, 1) AS a, round(p_retailprice, -2) AS b, floor(p_retailprice / 7) AS c, ceil(p_retailprice / 7) AS d, abs(-p_size) AS e, CAST(sign(p_size - 25) AS INTEGER) AS f FROM part".replace("floor(p_retailprice / 7)", "CAST(floor(p_retailprice / 7) AS BIGINT)").replace("ceil(p_retailprice / 7)", "CAST(ceil(p_retailprice / 7) AS BIGINT)"),
}

_DATES = "SELECT event_id, {} FROM events"
DATES = {
    "fn_date_trunc": _DATES.format(", ".join(f"CAST(date_trunc('{p}', ts) AS TIMESTAMP) AS t_{p}" for p in ("second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium", "isoyear"))),
    "fn_date_part": _DATES.format(", ".join(f"date_part('{p}', ts) AS p_{p}" for p in ("year", "month", "day", "hour", "minute", "second", "quarter", "week", "dow", "isodow", "doy", "decade", "century", "millennium", "isoyear", "millisecond", "microsecond", "yearweek"))),
    "fn_extract": _DATES.format("EXTRACT(year FROM ts) AS y, EXTRACT(dow FROM ts) AS d, year(ts) AS a, month(ts) AS b, day(ts) AS c, hour(ts) AS e, minute(ts) AS f, second(ts) AS g"),
    "fn_strftime": _DATES.format("strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%a %A %b %B %d %y') AS b, strftime(ts, '%j %u %w %U %W %V %G') AS c, strftime(ts, '%I %p 100%%') AS d"),
    "fn_epoch": _DATES.format("epoch(ts) AS a, epoch_ms(date_trunc('millisecond', ts)) AS b, epoch_us(ts) AS c, CAST(ts AS DATE) AS d, CAST(CAST(ts AS DATE) AS VARCHAR) AS e"),
}

_WORDS = "string_split(lower(p_type), ' ')"
_SHORT = "SELECT p_partkey, {} FROM part"
NESTED = {
    "unnest_from": ("SELECT p_partkey, w FROM part, UNNEST(string_split(p_type, ' ')) AS u(w)",) * 2,
    "unnest_select": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part",
    "unnest_group": "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) t GROUP BY w",
    "split_unnest_rank": "SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS r FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) t GROUP BY w) s",
    "list_index_slice": _SHORT.format(f"{_WORDS}[1] AS a, {_WORDS}[9] AS b, list_extract({_WORDS}, -1) AS c, array_to_string(list_slice({_WORDS}, 2, 3), '|') AS d, len({_WORDS}) AS e"),
    "list_search": _SHORT.format(f"list_contains({_WORDS}, 'brass') AS a, list_position({_WORDS}, 'tin') AS b, list_has_any({_WORDS}, ['tin', 'steel']) AS c, list_has_all({_WORDS}, ['tin']) AS d, list_contains(['a', NULL], 'z') AS e"),
    "list_sort_distinct": _SHORT.format("array_to_string(list_sort(string_split('c a b a', ' ')), ',') AS a, array_to_string(list_sort(list_distinct(string_split('c a b a', ' '))), ',') AS b, array_to_string(list_reverse_sort(['x', 'z', 'y']), ',') AS c, CAST(list_unique(['a', 'a', NULL]) AS BIGINT) AS d, array_to_string(list_reverse(string_split(p_type, ' ')), ' ') AS e"),
    "list_aggr": _SHORT.format(f"list_aggregate({_WORDS}, 'min') AS a, list_aggregate({_WORDS}, 'max') AS b, CAST(list_aggregate({_WORDS}, 'count') AS BIGINT) AS c, list_aggregate({_WORDS}, 'string_agg', '-') AS d, list_aggregate({_WORDS}, 'first') AS e, list_aggregate({_WORDS}, 'last') AS f"),
    "list_set_ops": _SHORT.format(f"array_to_string(list_concat({_WORDS}, ['x']), ',') AS a, len(list_value('p', 'q')) AS b"),
    "map_lookup": ("SELECT event_id, map('k', event_type, 'B', NULL)['k'] AS a, map('k', event_type)['none'] AS b, map_get_ci(map('Key', event_type), 'KEY') AS c FROM events", "SELECT event_id, MAP {'k': event_type, 'B': NULL}['k'] AS a, CAST(NULL AS VARCHAR) AS b, event_type AS c FROM events"),
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.none') AS b, CAST(json_extract(props, '$.k') AS VARCHAR) AS c FROM events",
    "json_array": "SELECT event_id, json_array_length('[1, 2, {\"a\": 3}]') AS a, json_valid(props) AS b, json_valid('{') AS c, json_type(props) AS d FROM events".replace("json_array_length('[1, 2, {\"a\": 3}]')", "CAST(json_array_length('[1, 2, {\"a\": 3}]') AS BIGINT)"),
    "logfmt_extract": ("SELECT event_id, logfmt_extract(line, 'type') AS a, logfmt_extract(line, 'msg') AS b, logfmt_extract(line, 'none') AS c FROM (SELECT event_id, concat('ts=1 type=', event_type, ' msg=\"a b\" id=', CAST(user_id AS VARCHAR)) AS line FROM events) t", "SELECT event_id, event_type AS a, 'a b' AS b, CAST(NULL AS VARCHAR) AS c FROM events"),
    "json_edit": ("SELECT event_id, json_extract_string(json_set(props, '$.k', 5, '$.n', 'x'), '$.k') AS a, json_extract_string(json_set(props, '$.n', 'x'), '$.n') AS b, json_extract_string(json_remove(props, '$.k'), '$.k') AS c, json_patch('{\"a\":1,\"b\":2}', '{\"a\":null,\"c\":3}') AS d, json_element('[1,2,3]', '$[#-1]') AS e FROM events", "SELECT event_id, '5' AS a, 'x' AS b, CAST(NULL AS VARCHAR) AS c, '{\"b\":2,\"c\":3}' AS d, '3' AS e FROM events"),
    "fn_typeof": "SELECT p_partkey, typeof(p_size) AS a, typeof(p_name) AS b, typeof(p_retailprice) AS c, typeof(p_partkey) AS d FROM part",
    "array_floats": "SELECT vec_id, embedding[1] AS a, len(embedding) AS b FROM embeddings",
}

#: TPC-H style reports.
REPORTS = {
    "report_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_quantity), 6) AS aq, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2",
    "report_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "report_priority": "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "report_events": "SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1, 2",
    "report_text": "SELECT source, count(*) AS n, count(*) FILTER (WHERE text LIKE '%the%') AS t, CAST(sum(length(text)) AS BIGINT) AS c FROM documents GROUP BY source",
}

QUERIES: dict[str, str | tuple[str, str]] = SCANS | FILTERS | EXPRESSIONS | JOINS | AGGREGATES | WINDOWS | SORTS | SETS | TEXT | MATH | DATES | NESTED | REPORTS
