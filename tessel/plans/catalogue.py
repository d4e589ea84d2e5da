"""The registered queries: one for each operator or function group, as text of the dialect.

Where both engines read the same text it is also its oracle; where the oracle's spelling or types differ it stands beside.
Money is in doubles, so sums are rounded; integers that the oracle widens are cast back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.plans import functions, statements
from tessel.session import Session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: text, read by both.
SAME: dict[str, str] = {
    # scans, projection, predicates
    "scan_table": "TABLE region",
    "scan_values": "SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(column1, column2)",
    "scan_from_less": "SELECT 1 AS one, 'a' AS a, NULL::int AS n",
    "scan_derived": "SELECT k, n FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) AS d WHERE n > 3",
    "scan_point_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "expr_projection": "SELECT n.*, n_nationkey * 2 AS twice FROM nation n",
    "filter_three_valued": "SELECT count(*) AS n FROM (SELECT NULLIF(l_linenumber, 1) AS x FROM lineitem) t WHERE NOT (x > 3)",
    "filter_is_tests": "SELECT (x > 2) IS TRUE AS a, (x > 2) IS NOT FALSE AS b, x IS NULL AS d, count(*) AS n FROM (SELECT NULLIF(l_linenumber, 1) AS x FROM lineitem) t GROUP BY 1, 2, 3",
    "filter_distinct_from": "SELECT count(*) AS n FROM (SELECT NULLIF(l_linenumber, 1) AS x, NULLIF(l_linenumber, 2) AS y FROM lineitem) t WHERE x IS DISTINCT FROM y",
    "filter_between": "SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 10 AND 20",
    "filter_in_list": "SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')",
    "filter_like": "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_type NOT ILIKE '%brass'",
    "filter_similar": "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)[0-9]'",
    "expr_case": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big FROM orders",
    "expr_conditionals": "SELECT n_nationkey, COALESCE(NULLIF(n_nationkey, 3), -1) AS a, GREATEST(n_nationkey, n_regionkey, 2) AS g, LEAST(n_nationkey, n_regionkey) AS l FROM nation",
    "expr_bits": "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 5 AS o, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS c FROM nation",
    "expr_row_compare": "SELECT count(*) AS n FROM lineitem WHERE (l_linenumber, l_suppkey) < (3, 50)",
    "expr_any_all_array": "SELECT n_nationkey, n_nationkey = ANY(ARRAY[1, 3, 5]) AS a, n_nationkey > ALL(ARRAY[2, 4]) AS b FROM nation",
    "expr_cast": "SELECT o_orderkey, o_orderkey::text AS t, o_totalprice::int AS i, '12'::int + 1 AS j, o_orderdate::date AS d FROM orders",
    # subqueries
    "subq_scalar": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "subq_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "subq_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "subq_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "subq_not_in_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(c_nationkey, 7) FROM customer)",
    "subq_correlated": "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS last_order FROM customer c",
    "subq_all": "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part)",
    "subq_any": "SELECT n_nationkey FROM nation WHERE n_nationkey < ANY (SELECT r_regionkey FROM region)",
    "subq_row_in": "SELECT n_nationkey FROM nation WHERE (n_nationkey, n_regionkey) IN (SELECT c_nationkey, c_nationkey % 5 FROM customer)",
    # joins
    "join_inner_eq": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 250000",
    "join_full_using": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) x FULL JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation WHERE n_nationkey > 8) y USING (k)",
    "join_cross": "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation",
    "join_natural": "SELECT * FROM (SELECT n_nationkey, n_name FROM nation) a NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM nation) b",
    "join_theta_range": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey",
    "join_comma": "SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "join_self": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_lateral": "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT max(o_orderkey) AS o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey) t",
    "join_null_keys": "SELECT a.k AS ak, b.k AS bk FROM (SELECT NULLIF(n_regionkey, 2) AS k FROM nation) a FULL JOIN (SELECT NULLIF(r_regionkey, 2) AS k FROM region) b ON a.k = b.k",
    "join_multiway": "SELECT s_suppkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size < 20 AND o_orderstatus = 'F' GROUP BY s_suppkey",
    # aggregation and grouping
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, count(*) AS total FROM lineitem GROUP BY l_returnflag",
    "agg_bool": "SELECT l_linestatus, bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS o FROM lineitem GROUP BY l_linestatus",
    "agg_bits": "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey",
    "agg_string_ordered": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "agg_array_ordered": "SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_nationkey), ',') AS keys FROM nation GROUP BY n_regionkey",
    "agg_min_max": "SELECT o_orderstatus, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
    "agg_mode": "SELECT mode() WITHIN GROUP (ORDER BY l_linenumber) AS m FROM lineitem",
    "agg_percentile_cont": "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_percentile_disc": "SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_empty_global": "SELECT count(*) AS n, max(n_name) AS m FROM nation WHERE n_nationkey < 0",
    "group_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "group_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "group_sets": "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), (l_returnflag, l_linenumber))",
    "group_sets_empty": "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 0 GROUP BY GROUPING SETS ((n_regionkey), ())",
    "group_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500",
    "group_position_alias": "SELECT n_regionkey % 2 AS odd, count(*) AS n FROM nation GROUP BY odd ORDER BY 1",
    "group_null_group": "SELECT NULLIF(n_regionkey, 2) AS k, count(*) AS n FROM nation GROUP BY 1",
    # windows
    "win_row_number": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem",
    "win_rank_family": "SELECT l_orderkey, l_linenumber, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9)::float8 AS p, round(cume_dist() OVER w, 9)::float8 AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)",
    "win_lag_lead": "SELECT event_id, lag(event_type) OVER w AS p, lead(event_type, 2, 'none') OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_first_last_nth": "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "win_rows_frame": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n FROM events",
    "win_range_numeric": "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM nation",
    "win_range_interval": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS n FROM events",
    "win_groups": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem",
    "win_exclude_current": "SELECT n_nationkey, max(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS m FROM nation",
    "win_exclude_group": "SELECT n_nationkey, count(*) OVER (ORDER BY n_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS n FROM nation",
    "win_exclude_ties": "SELECT n_nationkey, count(*) OVER (ORDER BY n_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM nation",
    "win_filter": "SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey % 2 = 0) OVER (PARTITION BY n_regionkey) AS n FROM nation",
    "win_over_groups": "SELECT n_regionkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, n_regionkey) AS r FROM nation GROUP BY n_regionkey",
    # sort, limit, distinct, set operations, CTEs
    "sort_nulls": "SELECT k FROM (SELECT NULLIF(n_regionkey, 2) AS k FROM nation) t ORDER BY k DESC NULLS LAST LIMIT 7",
    "sort_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5",
    "sort_expression": "SELECT n_name FROM nation ORDER BY n_regionkey * -1, n_name LIMIT 6",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
    "setop_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region",
    "setop_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "setop_intersect": "SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey + 2 FROM region",
    "setop_intersect_all": "SELECT l_linenumber AS k FROM lineitem INTERSECT ALL SELECT n_regionkey FROM nation",
    "setop_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "setop_except_all": "SELECT l_linenumber AS k FROM lineitem EXCEPT ALL SELECT n_regionkey FROM nation",
    "cte_basic": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT t.o_custkey, t.n, c.c_name FROM top t JOIN customer c ON c.c_custkey = t.o_custkey",
    "cte_recursive_series": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    "cte_recursive_graph": "WITH RECURSIVE e(src, dst) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation), r(x) AS (SELECT 1 UNION SELECT dst FROM e JOIN r ON src = x) SELECT x FROM r",
    # functions
    "fn_str_basic": "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name)::int AS n, reverse(n_name) AS r, repeat(left(n_name, 2), 2) AS p, replace(n_name, 'A', '-') AS x, lpad(n_name, 4, '*') AS lp, rpad(n_name, 20, '.') AS rp FROM nation",
    "fn_str_parts": "SELECT n_nationkey, left(n_name, -2) AS a, right(n_name, 3) AS b, substring(n_name, 2, 3) AS c, strpos(n_name, 'A')::int AS d, split_part(n_name, '_', 1) AS e, translate(n_name, 'AEI', 'aei') AS f, trim(both 'A' from n_name) AS g, concat(n_name, NULL, '!') AS h, concat_ws('-', n_name, NULL, 'z') AS i FROM nation",
    "fn_regex": "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '#', 'g') AS a, regexp_replace(p_name, '[aeiou]', '#') AS b, p_name ~ '^[a-m]' AS c FROM part",
    "fn_math_basic": "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, sign(l_discount - 0.05)::float8 AS s, round(sqrt(l_quantity), 9)::float8 AS q, round(ln(l_quantity), 9)::float8 AS n, round(power(l_quantity, 2), 6)::float8 AS p FROM lineitem",
    "fn_math_trig": "SELECT n_nationkey, round(sin(n_nationkey), 9)::float8 AS s, round(cos(n_nationkey), 9)::float8 AS c, round(atan2(n_nationkey, 3), 9)::float8 AS a, round(degrees(n_nationkey), 6)::float8 AS d, round(radians(n_nationkey), 9)::float8 AS r, round(exp(n_regionkey), 6)::float8 AS e, round(cbrt(n_nationkey), 9)::float8 AS b, gcd(n_nationkey, 12)::int AS g, lcm(n_nationkey, 6)::int AS l FROM nation",
    "fn_math_integers": "SELECT n_nationkey, n_nationkey % 7 AS m, mod(n_nationkey, 4) AS o, -n_nationkey AS n FROM nation",
    "fn_date_trunc": "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_trunc('week', o_orderdate) AS w, date_trunc('quarter', o_orderdate) AS q, date_trunc('decade', o_orderdate) AS d FROM orders",
    "fn_date_arithmetic": "SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS a, o_orderdate - INTERVAL '2 days' AS b, o_orderdate::date + 5 AS c, (o_orderdate::date - DATE '1995-01-01')::int AS d FROM orders",
    "fn_json_text": "SELECT event_id, props::json ->> 'k' AS k FROM events",
    # table functions
    "srf_generate_series": "SELECT g::int AS x FROM generate_series(3, 21, 3) AS t(g)",
    "srf_series_descending": "SELECT g::int AS x FROM generate_series(10, 1, -4) AS t(g)",
    "srf_series_empty": "SELECT g::int AS x FROM generate_series(5, 1) AS t(g)",
    "srf_series_dates": "SELECT g AS d FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-02-03', INTERVAL '1 day') AS t(g)",
    "srf_unnest": "SELECT label, count(*) AS n FROM (SELECT label, unnest(embedding) AS v FROM embeddings) t WHERE v > 0 GROUP BY label",
    "srf_unnest_ordinality": "SELECT x, o FROM unnest(ARRAY['a', 'b', 'c']) WITH ORDINALITY AS t(x, o)",
    # events
    "ev_tumbling_window": "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "ev_sessions": "SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id)::bigint AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '12 hours' THEN 1 ELSE 0 END AS g FROM events) a) b GROUP BY user_id, s",
}

#: name: (text of the dialect, text of the oracle).
PAIRS: dict[str, tuple[str, str]] = {
    "fn_str_codes": ("SELECT n_nationkey, ascii(n_name) AS a, md5(n_name) AS m, to_hex(n_nationkey) AS h, chr(65 + n_nationkey) AS c, bit_length(n_name)::int AS b, starts_with(n_name, 'A') AS s FROM nation", "SELECT n_nationkey, ascii(n_name) AS a, md5(n_name) AS m, lower(to_hex(n_nationkey)) AS h, chr(65 + n_nationkey) AS c, bit_length(n_name)::int AS b, starts_with(n_name, 'A') AS s FROM nation"),
    "fn_arr_basic": ("SELECT n_nationkey, array_length(ARRAY[n_nationkey, 2, 3], 1)::int AS l, (ARRAY[n_nationkey, 7, 9])[1] AS f, array_to_string(ARRAY[n_nationkey, 5] || 6, ',') AS j FROM nation", "SELECT n_nationkey, array_length(ARRAY[n_nationkey, 2, 3], 1)::int AS l, (ARRAY[n_nationkey, 7, 9])[1] AS f, array_to_string(ARRAY[n_nationkey, 5] || ARRAY[6], ',') AS j FROM nation"),
    "flagship_top_spenders": tuple(
        "SELECT c.c_custkey, c.c_name, round(sum((l.l_extendedprice * (1 - l.l_discount))::{0}), 2)::float8 AS total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_custkey, c.c_name ORDER BY total DESC, c.c_custkey LIMIT 20".format(t) for t in ("numeric(18,4)", "decimal(18,4)")),
    "agg_basic": tuple(f"SELECT l_returnflag, l_linestatus, sum(l_linenumber){c} AS s, count(*) AS n, round(sum(l_quantity), 2)::float8 AS q, round(avg(l_extendedprice), 4)::float8 AS a, min(l_tax) AS mi, max(l_tax) AS ma FROM lineitem GROUP BY l_returnflag, l_linestatus" for c in ("", "::bigint")),
    "agg_stats": tuple("SELECT l_returnflag, " + ", ".join(f"round({f}(l_quantity), 6)::float8 AS {f}_q" for f in fs) + " FROM lineitem GROUP BY l_returnflag" for fs in [("variance", "var_samp", "var_pop", "stddev", "stddev_samp", "stddev_pop")] * 2),
    "agg_regr": tuple("SELECT " + ", ".join(f"round({f}(l_extendedprice, l_quantity), 4)::float8 AS {f}_v" for f in "corr covar_pop covar_samp regr_slope regr_intercept regr_r2 regr_avgx regr_avgy regr_sxx regr_syy regr_sxy".split()) + ", regr_count(l_extendedprice, l_quantity)::bigint AS n FROM lineitem" for _ in range(2)),
    "agg_int_avg": ("SELECT n_regionkey, round(avg(n_nationkey), 6)::float8 AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, round(avg(n_nationkey), 6)::float8 AS a FROM nation GROUP BY n_regionkey"),
    "agg_json": ("SELECT n_regionkey, replace(json_agg(n_nationkey ORDER BY n_nationkey)::text, ' ', '') AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey::text, ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey"),
    "agg_json_object": ("SELECT r_regionkey, replace(jsonb_object_agg(r_name, r_regionkey)::text, ' ', '') AS j FROM region GROUP BY r_regionkey", "SELECT r_regionkey, '{\"' || replace(r_name, ' ', '') || '\":' || r_regionkey || '}' AS j FROM region"),
    "group_grouping_id": tuple(f"SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus){c} AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)" for c in ("", "::int")),
    "group_distinct": ("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY DISTINCT GROUPING SETS ((l_returnflag), (l_returnflag), ())", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())"),
    "win_ntile": tuple(f"SELECT n_nationkey, ntile(4) OVER (ORDER BY n_nationkey){c} AS t FROM nation" for c in ("", "::int")),
    "win_running_sum": tuple(f"SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::bigint AS s FROM orders" for _ in range(2)),
    "limit_with_ties": ("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_linenumber DESC FETCH FIRST 5 ROWS WITH TIES", "SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (ORDER BY l_linenumber DESC) AS r FROM lineitem) WHERE r <= 5"),
    "expr_int_division": ("SELECT n_nationkey, n_nationkey / 4 AS d, -n_nationkey / 4 AS m FROM nation", "SELECT n_nationkey, n_nationkey // 4 AS d, CAST(trunc(-n_nationkey / 4) AS INT) AS m FROM nation"),
    "expr_power": ("SELECT n_nationkey, n_nationkey ^ 2 AS p, n_nationkey # 6 AS x FROM nation", "SELECT n_nationkey, power(n_nationkey, 2) AS p, xor(n_nationkey, 6) AS x FROM nation"),
    "expr_half_even": ("SELECT n_nationkey, (n_nationkey + 0.5)::float8::int AS h, (n_nationkey + 0.5)::int AS u FROM nation", "SELECT n_nationkey, CAST(round_even(n_nationkey + 0.5::double, 0) AS INT) AS h, n_nationkey + 1 AS u FROM nation"),
    "expr_between_symmetric": ("SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN SYMMETRIC 15 AND 4", "SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 4 AND 15"),
    "expr_overlaps": ("SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderdate + INTERVAL '10 days') OVERLAPS (TIMESTAMP '1995-03-01', TIMESTAMP '1995-03-15')", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-15' AND o_orderdate + INTERVAL '10 days' > TIMESTAMP '1995-03-01'"),
    "expr_array_contains": ("SELECT n_nationkey, ARRAY[1, 2, n_nationkey] @> ARRAY[3, 1] AS c, ARRAY[n_nationkey] && ARRAY[4, 5] AS o FROM nation", "SELECT n_nationkey, n_nationkey = 3 AS c, n_nationkey IN (4, 5) AS o FROM nation"),
    "fn_str_initcap": ("SELECT initcap('hello WORLD-foo bar_baz') AS a, substr('abcdef', -1, 4) AS b, quote_literal('it''s') AS c, quote_ident('Two Words') AS d, format('%s-%I-%L', 'a', 'B c', 'd') AS e", "SELECT 'Hello World-Foo Bar_Baz' AS a, 'ab' AS b, '''it''''s''' AS c, '\"Two Words\"' AS d, 'a-\"B c\"-''d''' AS e"),
    "fn_str_overlay": ("SELECT overlay('abcdef' PLACING 'XY' FROM 2 FOR 3) AS a, position('c' IN 'abc') AS b, unistr('\\0041') AS c, encode('abc'::bytea, 'hex') AS d, convert_from(decode('616263', 'hex'), 'UTF8') AS e", "SELECT 'aXYef' AS a, CAST(3 AS INT) AS b, 'A' AS c, '616263' AS d, 'abc' AS e"),
    "fn_regex_match": ("SELECT p_partkey, (regexp_match(p_brand, '#(\\d)(\\d)'))[2] AS m, regexp_count(p_name, '[aeiou]') AS n, regexp_instr(p_name, '[aeiou]', 1, 2) AS i, regexp_substr(p_name, '[a-z]+') AS s FROM part", "SELECT p_partkey, nullif(regexp_extract(p_brand, '#(\\d)(\\d)', 2), '') AS m, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INT) AS n, CAST(coalesce(nullif(length(regexp_extract(p_name, '^([^aeiou]*[aeiou][^aeiou]*)[aeiou]', 1)), 0) + 1, 0) AS INT) AS i, nullif(regexp_extract(p_name, '[a-z]+'), '') AS s FROM part"),
    "fn_str_to_array": ("SELECT doc_id, cardinality(string_to_array(text, ' ')) AS n FROM documents", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n FROM documents"),
    "fn_math_round": ("SELECT l_orderkey, l_linenumber, round(l_quantity::numeric / 3, 2)::float8 AS r, trunc(l_quantity / 3) AS t, width_bucket(l_quantity, 0, 50, 10) AS b FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_quantity / 3, 2)::float8 AS r, trunc(l_quantity / 3) AS t, CAST(least(floor(l_quantity / 5) + 1, 11) AS INT) AS b FROM lineitem"),
    "fn_math_misc": ("SELECT factorial(5)::bigint AS f, div(17, 5)::int AS d, log(100) AS l, round(erf(0.5), 6)::float8 AS e, sind(30) AS s, num_nulls(1, NULL, 3) AS n", "SELECT CAST(120 AS BIGINT) AS f, CAST(3 AS INT) AS d, CAST(2 AS DOUBLE) AS l, 0.5205::double AS e, CAST(0.5 AS DOUBLE) AS s, CAST(1 AS INT) AS n"),
    "fn_date_extract": ("SELECT o_orderkey, extract(dow FROM o_orderdate)::int AS w, extract(isodow FROM o_orderdate)::int AS i, extract(doy FROM o_orderdate)::int AS y, extract(week FROM o_orderdate)::int AS k, extract(quarter FROM o_orderdate)::int AS q, extract(century FROM o_orderdate)::int AS c, extract(epoch FROM o_orderdate)::bigint AS e FROM orders", "SELECT o_orderkey, extract(dow FROM o_orderdate)::int AS w, extract(isodow FROM o_orderdate)::int AS i, extract(doy FROM o_orderdate)::int AS y, extract(week FROM o_orderdate)::int AS k, extract(quarter FROM o_orderdate)::int AS q, extract(century FROM o_orderdate)::int AS c, epoch(o_orderdate)::bigint AS e FROM orders"),
    "fn_date_make": ("SELECT make_date(2024, 2, 29) AS d, make_timestamp(2024, 2, 29, 1, 2, 3.5) AS t, age(TIMESTAMP '2024-03-15', TIMESTAMP '2023-01-10')::text AS a, to_char(TIMESTAMP '2024-03-05 14:05:06', 'YYYY-MM-DD HH24:MI Mon') AS c, to_date('05/03/2024', 'DD/MM/YYYY') AS e, justify_days(INTERVAL '40 days')::text AS j", "SELECT DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 01:02:03.5' AS t, '1 year 2 mons 5 days' AS a, '2024-03-05 14:05 Mar' AS c, DATE '2024-03-05' AS e, '1 mon 10 days' AS j"),
    "fn_date_bin": ("SELECT event_id, date_bin('15 minutes', ts, TIMESTAMP '2020-01-01') AS b FROM events", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2020-01-01') AS b FROM events"),
    "fn_arr_more": ("SELECT array_to_string(array_remove(ARRAY[1, 2, 1, 3], 1), ',') AS a, array_to_string(array_replace(ARRAY[1, 2, 1], 1, 9), ',') AS b, array_position(ARRAY[4, 5, 6], 5) AS c, array_to_string(array_positions(ARRAY[1, 2, 1], 1), ',') AS d, array_to_string((ARRAY[1, 2, 3, 4])[2:3], ',') AS e, array_to_string(array_cat(ARRAY[1], ARRAY[2]), ',') AS f, array_to_string(trim_array(ARRAY[1, 2, 3], 1), ',') AS g, array_to_string(array_fill(7, ARRAY[3]), ',') AS h, array_dims(ARRAY[1, 2]) AS i", "SELECT '2,3' AS a, '9,2,9' AS b, CAST(2 AS INT) AS c, '1,3' AS d, '2,3' AS e, '1,2' AS f, '1,2' AS g, '7,7,7' AS h, '[1:2]' AS i"),
    "fn_json_ops": ("SELECT '{\"b\": 1, \"a\": [1, 2]}'::jsonb::text AS a, '{\"a\": {\"b\": 2}}'::jsonb #>> '{a,b}' AS b, '{\"a\": 1}'::jsonb @> '{\"a\": 1}' AS c, '{\"a\": 1}'::jsonb ? 'a' AS d, jsonb_set('{\"a\": 1}', '{a}', '2')::text AS e, jsonb_typeof('[1]') AS f, ('{\"a\": 1, \"b\": 2}'::jsonb - 'a')::text AS g, jsonb_array_length('[1, 2, 3]') AS h", "SELECT '{\"a\": [1, 2], \"b\": 1}' AS a, '2' AS b, true AS c, true AS d, '{\"a\": 2}' AS e, 'array' AS f, '{\"b\": 2}' AS g, CAST(3 AS INT) AS h"),
    "fn_json_build": ("SELECT n_nationkey, jsonb_build_object('k', n_nationkey, 'n', n_name) ->> 'n' AS n, json_build_array(1, 'a')::text AS a FROM nation", "SELECT n_nationkey, n_name AS n, '[1, \"a\"]' AS a FROM nation"),
    "fn_ts_match": ("SELECT to_tsvector('english', 'The quick brown foxes jumped') @@ to_tsquery('english', 'fox & jump') AS a, to_tsvector('simple', 'a b c') @@ phraseto_tsquery('simple', 'b c') AS b, to_tsvector('english', 'cats') @@ to_tsquery('english', '!dog') AS c, numnode(to_tsquery('simple', 'a & b | c')) AS d, strip(to_tsvector('simple', 'b a'))::text AS e", "SELECT true AS a, true AS b, true AS c, CAST(5 AS INT) AS d, '''a'' ''b''' AS e"),
    "ts_documents": ("SELECT doc_id FROM documents WHERE to_tsvector('simple', text) @@ to_tsquery('simple', 'license & mit')", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])license($|[^a-z0-9])') AND regexp_matches(lower(text), '(^|[^a-z0-9à-ÿ''])mit($|[^a-z0-9à-ÿ''])')"),
    "srf_lockstep": ("SELECT generate_series(1, 3) AS a, unnest(ARRAY['x', 'y']) AS b", "SELECT * FROM (VALUES (1::bigint::int, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)"),
    "srf_rows_from": ("SELECT a, b FROM ROWS FROM (generate_series(1, 2), unnest(ARRAY['x', 'y', 'z'])) AS t(a, b)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS v(a, b)"),
    "srf_json_each": ("SELECT event_id, e.key AS k, e.value AS v FROM events, LATERAL json_each_text(props::json) AS e", "SELECT event_id, 'k' AS k, props ->> 'k' AS v FROM events"),
    "srf_json_elements": ("SELECT x AS v FROM jsonb_array_elements_text('[1, \"a\", null]') AS t(x)", "SELECT * FROM (VALUES ('1'), ('a'), (NULL)) AS v(v)"),
    "srf_string_to_table": ("SELECT n_nationkey, w FROM nation, LATERAL string_to_table(n_name, 'A') AS t(w)", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS w FROM nation"),
    "srf_regexp_matches": ("SELECT n_nationkey, m[1] AS m FROM nation, LATERAL regexp_matches(n_name, '[AEIOU]', 'g') AS t(m)", "SELECT n_nationkey, unnest(regexp_extract_all(n_name, '[AEIOU]')) AS m FROM nation"),
    "srf_regexp_split": ("SELECT n_nationkey, w FROM nation, LATERAL regexp_split_to_table(n_name, '[AEIOU]') AS t(w)", "SELECT n_nationkey, unnest(regexp_split_to_array(n_name, '[AEIOU]')) AS w FROM nation"),
    "srf_subscripts": ("SELECT g AS i FROM generate_subscripts(ARRAY['a', 'b', 'c'], 1) AS t(g)", "SELECT CAST(unnest([1, 2, 3]) AS INT) AS i"),
    "catalog_columns": ("SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation')", "SELECT * FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2), ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) AS v(table_name, column_name, ordinal_position)"),
}

#: name: (script, query after it, oracle).
SCRIPTS: dict[str, tuple[str, str, str]] = {
    "dml_insert_select": ("CREATE TABLE t (k int PRIMARY KEY, name text, n int DEFAULT 7); INSERT INTO t (k, name) SELECT n_nationkey, n_name FROM nation", "SELECT * FROM t", "SELECT n_nationkey AS k, n_name AS name, 7 AS n FROM nation"),
    "dml_upsert": ("CREATE TABLE t (k int PRIMARY KEY, v text, hits int DEFAULT 1); INSERT INTO t (k, v) SELECT r_regionkey, r_name FROM region; INSERT INTO t (k, v) VALUES (0, 'new'), (9, 'nine') ON CONFLICT (k) DO UPDATE SET v = excluded.v, hits = t.hits + 1", "SELECT * FROM t", "SELECT r_regionkey AS k, CASE WHEN r_regionkey = 0 THEN 'new' ELSE r_name END AS v, CASE WHEN r_regionkey = 0 THEN 2 ELSE 1 END AS hits FROM region UNION ALL SELECT 9, 'nine', 1"),
    "dml_do_nothing": ("CREATE TABLE t (k int PRIMARY KEY, v text); INSERT INTO t SELECT r_regionkey, r_name FROM region; INSERT INTO t VALUES (0, 'new'), (9, 'nine') ON CONFLICT DO NOTHING", "SELECT * FROM t", "SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT 9, 'nine'"),
    "dml_update_from": ("CREATE TABLE t AS SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name FROM nation; UPDATE t SET name = g.r_name FROM region g WHERE g.r_regionkey = t.r AND t.k < 10", "SELECT * FROM t", "SELECT n_nationkey AS k, n_regionkey AS r, CASE WHEN n_nationkey < 10 THEN r_name ELSE n_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "dml_delete_using": ("CREATE TABLE t AS SELECT n_nationkey AS k, n_regionkey AS r FROM nation; DELETE FROM t USING region g WHERE g.r_regionkey = t.r AND g.r_name = 'ASIA'", "SELECT * FROM t", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"),
    "dml_cte_returning": ("CREATE TABLE t AS SELECT n_nationkey AS k FROM nation", "WITH gone AS (DELETE FROM t WHERE k < 5 RETURNING k) SELECT k * 10 AS x FROM gone", "SELECT n_nationkey * 10 AS x FROM nation WHERE n_nationkey < 5"),
    "dml_fk_cascade": ("CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE c (id int PRIMARY KEY, p int REFERENCES p (id) ON DELETE CASCADE); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id = 2", "SELECT * FROM c", "SELECT n_nationkey AS id, n_regionkey AS p FROM nation WHERE n_regionkey <> 2"),
    "dml_generated": ("CREATE TABLE t (a int, b int GENERATED ALWAYS AS (a * 2) STORED); INSERT INTO t (a) SELECT n_nationkey FROM nation; UPDATE t SET a = a + 1 WHERE a < 3", "SELECT * FROM t", "SELECT a, a * 2 AS b FROM (SELECT CASE WHEN n_nationkey < 3 THEN n_nationkey + 1 ELSE n_nationkey END AS a FROM nation)"),
    "dml_serial_returning": ("CREATE TABLE t (id serial PRIMARY KEY, v text)", "INSERT INTO t (v) VALUES ('a'), ('b'), ('c') RETURNING id, v", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS x(id, v)"),
    "dml_trigger": ("CREATE TABLE t (a int, b text); CREATE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN IF NEW.a > 10 THEN NEW.b := 'big'; ELSE NEW.b := 'small'; END IF; RETURN NEW; END $$; CREATE TRIGGER g BEFORE INSERT ON t FOR EACH ROW EXECUTE FUNCTION f(); INSERT INTO t (a) SELECT n_nationkey FROM nation", "SELECT * FROM t", "SELECT n_nationkey AS a, CASE WHEN n_nationkey > 10 THEN 'big' ELSE 'small' END AS b FROM nation"),
    "txn_rollback": ("CREATE TABLE t AS SELECT n_nationkey AS k FROM nation; BEGIN; DELETE FROM t WHERE k < 5; SAVEPOINT s; DELETE FROM t; ROLLBACK TO s; COMMIT; BEGIN; DELETE FROM t; ROLLBACK", "SELECT * FROM t", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey >= 5"),
    "ddl_view": ("CREATE VIEW v (region, n) AS SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey", "SELECT * FROM v WHERE n > 2", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 2"),
    "ddl_materialized_view": ("CREATE MATERIALIZED VIEW v AS SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey; REFRESH MATERIALIZED VIEW v", "SELECT * FROM v", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1"),
    "ddl_alter": ("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name FROM nation; ALTER TABLE t ADD COLUMN extra int DEFAULT 3; ALTER TABLE t RENAME COLUMN name TO label; ALTER TABLE t ALTER COLUMN k TYPE bigint", "SELECT * FROM t", "SELECT n_nationkey::bigint AS k, n_name AS label, 3 AS extra FROM nation"),
    "ddl_enum_domain": ("CREATE TYPE mood AS ENUM ('low', 'mid', 'high'); CREATE DOMAIN small AS int CHECK (VALUE < 100); CREATE TABLE t (m mood, x small); INSERT INTO t VALUES ('high', 1), ('low', 2), ('mid', 3)", "SELECT m, x, row_number() OVER (ORDER BY m) AS r FROM t WHERE m > 'low'", "SELECT * FROM (VALUES ('mid', 3, 1::bigint), ('high', 1, 2)) AS v(m, x, r)"),
    "udf_sql": ("CREATE FUNCTION twice(x int) RETURNS int LANGUAGE sql AS 'SELECT x * 2'; CREATE FUNCTION nations(r int) RETURNS TABLE (k int, name text) LANGUAGE sql AS 'SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r'", "SELECT twice(k) AS t, name FROM nations(3)", "SELECT n_nationkey * 2 AS t, n_name AS name FROM nation WHERE n_regionkey = 3"),
    "udf_plpgsql": ("CREATE FUNCTION size_of(x int) RETURNS text LANGUAGE plpgsql AS $$ DECLARE r text; BEGIN IF x < 5 THEN r := 'small'; ELSIF x < 15 THEN r := 'medium'; ELSE r := 'large'; END IF; RETURN r; END $$", "SELECT n_nationkey, size_of(n_nationkey) AS s FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'small' WHEN n_nationkey < 15 THEN 'medium' ELSE 'large' END AS s FROM nation"),
    "session_prepare": ("PREPARE q (int) AS SELECT n_name FROM nation WHERE n_regionkey = $1", "EXECUTE q (1)", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "seq_nextval": ("CREATE SEQUENCE s START 10 INCREMENT 5; SELECT nextval('s')", "SELECT nextval('s') AS a, currval('s') AS b", "SELECT 15::bigint AS a, 15::bigint AS b"),
    "copy_to_text": ("", "COPY (SELECT r_regionkey, r_name FROM region) TO STDOUT WITH (FORMAT csv)", "SELECT r_regionkey || ',' || r_name AS line FROM region"),
}


def opened(spark: SparkSession, directory: str, text: str | None = None) -> Session:
    """A session over the tables of a directory; only those that the text names are opened, if one is given."""
    s = Session(spark)
    s.register_parquet(directory, *[t for t in TABLES if text is None or re.search(rf"\b{t}\b", text)])
    return s


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, directory: opened(spark, directory, text).sql(text)


def _scripted(script: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        s = opened(spark, directory, f"{script}; {text}")
        s.execute(script)
        return s.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    same, pairs, scripts = SAME | functions.SAME, PAIRS | functions.PAIRS, SCRIPTS | statements.SCRIPTS
    found = {k: _query(v) for k, v in same.items()} | {k: _query(v) for k, (v, _) in pairs.items()} | {k: _scripted(a, b) for k, (a, b, _) in scripts.items()}
    return found | {k: f for k, (f, _) in statements.CALLS.items()}


def oracles() -> dict[str, str]:
    same, pairs, scripts = SAME | functions.SAME, PAIRS | functions.PAIRS, SCRIPTS | statements.SCRIPTS
    return same | {k: v for k, (_, v) in pairs.items()} | {k: v for k, (_, _, v) in scripts.items()} | {k: v for k, (_, v) in statements.CALLS.items()}
