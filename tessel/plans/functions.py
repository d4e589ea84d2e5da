"""Function groups over columns of whole tables: name -> (text of the dialect, text of the oracle).

Where both engines read the same text it stands once. Floats are rounded, and types that the oracle widens are cast.
"""

from __future__ import annotations


def _deg(f: str, x: str) -> str:
    return f"round({f}(radians({x})), 9)::float8"


_ERF = "round(2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: power(-1, k) * power(n_nationkey / 10, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))), 6)::float8"

SAME: dict[str, str] = {
    "fn_char_length": "SELECT p_partkey, char_length(p_name)::int AS a, character_length(p_type)::int AS b FROM part",
    "fn_trims": "SELECT p_partkey, ltrim(p_name, 'csl') AS a, rtrim(p_name, 'tegd') AS b, ltrim('  ' || p_type) AS c, rtrim(p_type || '  ') AS d FROM part",
    "fn_pow_log": """SELECT l_orderkey, l_linenumber, ceiling(l_extendedprice) AS c, round(log10(l_quantity), 9)::float8 AS g, pow(l_quantity, 2) AS p,
        round(pi() * l_quantity, 6)::float8 AS q FROM lineitem""",
    "fn_trig_all": """SELECT n_nationkey, round(tan(n_nationkey), 6)::float8 AS t, round(cot(n_nationkey + 1), 6)::float8 AS o, round(asin(n_nationkey / 25.0), 9)::float8 AS a,
        round(acos(n_nationkey / 25.0), 9)::float8 AS b, round(atan(n_nationkey), 9)::float8 AS c FROM nation""",
    "fn_hyperbolic": """SELECT n_nationkey, round(sinh(n_nationkey / 10.0), 8)::float8 AS s, round(cosh(n_nationkey / 10.0), 8)::float8 AS c, round(tanh(n_nationkey / 10.0), 9)::float8 AS t,
        round(asinh(n_nationkey), 9)::float8 AS x, round(acosh(n_nationkey + 1), 9)::float8 AS y, round(atanh(n_nationkey / 25.0), 9)::float8 AS z FROM nation""",
    "fn_isfinite": "SELECT o_orderkey, isfinite(o_orderdate) AS a, isfinite(o_totalprice) AS b FROM orders",
    "fn_date_part": """SELECT event_id, date_part('year', ts)::int AS y, date_part('month', ts)::int AS m, date_part('hour', ts)::int AS h, date_part('minute', ts)::int AS i,
        date_part('dow', ts)::int AS d FROM events""",
    "agg_every": "SELECT l_linestatus, every(l_quantity > 0) AS a, every(l_tax > 0.01) AS b FROM lineitem GROUP BY l_linestatus".replace("every", "bool_and"),
    "op_like_symbols": "SELECT p_partkey, p_name ~~ '%widget' AS a, p_name ~~* 'COLD%' AS b, p_name !~~ '%bolt' AS c, p_name !~~* 'SMALL%' AS d FROM part",
    "op_interval_times": "SELECT event_id, ts + INTERVAL '90 minutes' * 2 AS a, ts - INTERVAL '1 day' * 3 AS b FROM events",
    "win_exclude_sums": """SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS n,
        sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)::bigint AS s FROM lineitem""",
    "win_exclude_peers": """SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS n,
        sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES)::bigint AS s FROM lineitem""",
    "fetch_first": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 7 ROWS ONLY",
    "group_by_nothing": "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY ()",
    "op_array_query": "SELECT r_regionkey, array_to_string(ARRAY(SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey), ',') AS a FROM region",
}

PAIRS: dict[str, tuple[str, str]] = {
    # text
    "fn_octets": (
        "SELECT doc_id, octet_length(text) AS a, bit_length(text) AS b FROM documents",
        "SELECT doc_id, CAST(strlen(text) AS INT) AS a, CAST(8 * strlen(text) AS INT) AS b FROM documents"),
    "fn_btrim_quote": (
        "SELECT p_partkey, btrim(p_name, 'cd lt') AS a, quote_nullable(p_name) AS b, quote_nullable(NULLIF(p_type, 'PROMO')) AS c FROM part",
        "SELECT p_partkey, trim(p_name, 'cd lt') AS a, '''' || replace(p_name, '''', '''''') || '''' AS b, CASE WHEN p_type = 'PROMO' THEN 'NULL' ELSE '''' || p_type || '''' END AS c FROM part"),
    "fn_regexp_like": (
        "SELECT p_partkey, regexp_like(p_name, '^[a-m]') AS a, regexp_like(p_name, 'BOLT$', 'i') AS b, substring(p_name SIMILAR '%#\"(widget|bolt)#\"%' ESCAPE '#') AS c FROM part",
        "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS a, regexp_matches(p_name, 'BOLT$', 'i') AS b, CASE WHEN p_name LIKE '%widget%' THEN 'widget' WHEN p_name LIKE '%bolt%' THEN 'bolt' END AS c FROM part"),
    "fn_bytes": (
        "SELECT n_nationkey, encode(convert_to(n_name, 'UTF8'), 'hex') AS a, get_byte(n_name::bytea, 1) AS b, encode(set_byte(n_name::bytea, 0, 65), 'hex') AS c FROM nation",
        "SELECT n_nationkey, lower(hex(n_name)) AS a, ascii(substr(n_name, 2, 1)) AS b, lower(hex('A' || substr(n_name, 2))) AS c FROM nation"),
    "fn_overlay_unistr": (
        "SELECT n_nationkey, overlay(n_name PLACING '##' FROM 2 FOR 3) AS a, position('_' IN n_name) AS b, unistr(n_name || '\\0041') AS c, convert_from(decode(encode(n_name::bytea, 'hex'), 'hex'), 'UTF8') AS d FROM nation",
        "SELECT n_nationkey, n_name[1] || '##' || substr(n_name, 5) AS a, CAST(strpos(n_name, '_') AS INT) AS b, n_name || 'A' AS c, n_name AS d FROM nation"),
    "fn_format_quote": (
        "SELECT n_nationkey, initcap(n_name) AS a, substr(n_name, -1, 4) AS b, quote_literal(n_name) AS c, quote_ident(n_name) AS d, format('%s-%I-%L', n_nationkey, n_name, n_name) AS e FROM nation",
        "SELECT n_nationkey, 'Nation_' || n_nationkey AS a, substr(n_name, 1, 2) AS b, '''' || n_name || '''' AS c, '\"' || n_name || '\"' AS d, n_nationkey || '-\"' || n_name || '\"-''' || n_name || '''' AS e FROM nation"),
    # numbers
    "fn_degrees_all": (
        """SELECT n_nationkey, round(cosd(n_nationkey), 9)::float8 AS c, round(tand(n_nationkey), 9)::float8 AS t, round(cotd(n_nationkey + 1), 9)::float8 AS o,
            round(asind(n_nationkey / 25.0), 9)::float8 AS a, round(acosd(n_nationkey / 25.0), 9)::float8 AS b, round(atand(n_nationkey), 9)::float8 AS d, round(atan2d(n_nationkey, 3), 9)::float8 AS e FROM nation""",
        f"""SELECT n_nationkey, {_deg('cos', 'n_nationkey')} AS c, {_deg('tan', 'n_nationkey')} AS t, {_deg('cot', 'n_nationkey + 1')} AS o, round(degrees(asin(n_nationkey / 25.0)), 9)::float8 AS a,
            round(degrees(acos(n_nationkey / 25.0)), 9)::float8 AS b, round(degrees(atan(n_nationkey)), 9)::float8 AS d, round(degrees(atan2(n_nationkey, 3)), 9)::float8 AS e FROM nation"""),
    "fn_scales": (
        """SELECT n_nationkey, scale((n_nationkey * 0.5)::numeric(10,4)) AS s, min_scale((n_nationkey * 0.5)::numeric(10,4)) AS m,
            trim_scale((n_nationkey * 0.5)::numeric(10,4))::float8 AS t FROM nation""",
        "SELECT n_nationkey, CAST(4 AS INT) AS s, CAST(n_nationkey % 2 AS INT) AS m, n_nationkey * 0.5::double AS t FROM nation"),
    "fn_erf_all": (
        "SELECT n_nationkey, round(erf(n_nationkey / 10.0), 6)::float8 AS e, round(erfc(n_nationkey / 10.0), 6)::float8 AS c FROM nation",
        f"SELECT n_nationkey, {_ERF} AS e, round(1 - {_ERF}, 6)::float8 AS c FROM nation"),
    "fn_num_nulls": (
        "SELECT n_nationkey, num_nulls(NULLIF(n_regionkey, 1), NULLIF(n_nationkey, 4), n_name) AS a, num_nonnulls(NULLIF(n_regionkey, 1), n_name) AS b FROM nation",
        "SELECT n_nationkey, CAST((n_regionkey = 1)::int + (n_nationkey = 4)::int AS INT) AS a, CAST(2 - (n_regionkey = 1)::int AS INT) AS b FROM nation"),
    "fn_random": (
        "SELECT count(*) AS n, count(DISTINCT r) > 0.99 * count(*) AS many FROM (SELECT random() AS r FROM orders) t WHERE r >= 0 AND r < 1",
        "SELECT count(*) AS n, true AS many FROM orders"),
    "fn_factorial_div": (
        "SELECT n_nationkey, factorial(n_nationkey % 8)::bigint AS f, div(n_nationkey * 7, 3)::int AS d, sind(30 * n_nationkey) AS s, round(log(n_nationkey + 1), 9)::float8 AS l, gcd(n_nationkey, 12)::int AS g, lcm(n_nationkey, 4)::int AS c FROM nation",
        f"SELECT n_nationkey, CAST(factorial(n_nationkey % 8) AS BIGINT) AS f, CAST(n_nationkey * 7 // 3 AS INT) AS d, {_deg('sin', '30 * n_nationkey')} + 0.0 AS s, round(log10(n_nationkey + 1), 9)::float8 AS l, gcd(n_nationkey, 12)::int AS g, lcm(n_nationkey, 4)::int AS c FROM nation"),
    "numeric_division": (
        "SELECT n_nationkey, (n_nationkey::numeric / 3)::text AS t, (2 / (n_nationkey + 1)::numeric)::float8 AS f, (n_nationkey::numeric(10,2) / 7)::float8 AS g FROM nation",
        "SELECT n_nationkey, printf('%d.%s', n_nationkey // 3, CASE n_nationkey % 3 WHEN 0 THEN repeat('0', 16) WHEN 1 THEN repeat('3', 16) ELSE repeat('6', 15) || '7' END) AS t, 2 / (n_nationkey + 1) AS f, n_nationkey / 7 AS g FROM nation"),
    "op_unary": (
        "SELECT n_nationkey, - n_nationkey AS a, + n_nationkey AS b, @ (n_nationkey - 12) AS c, round((|/ n_nationkey)::numeric, 6)::float8 AS d, round((||/ n_nationkey)::numeric, 6)::float8 AS e, ~ n_nationkey AS f FROM nation",
        "SELECT n_nationkey, -n_nationkey AS a, n_nationkey AS b, abs(n_nationkey - 12) AS c, round(sqrt(n_nationkey), 6)::float8 AS d, round(cbrt(n_nationkey), 6)::float8 AS e, ~n_nationkey AS f FROM nation"),
    "expr_numeric_power": (
        "SELECT n_nationkey, round((n_nationkey::numeric ^ 2)::numeric, 4)::float8 AS a, round((2.5 ^ (n_nationkey % 5))::numeric, 4)::float8 AS b FROM nation",
        "SELECT n_nationkey, power(n_nationkey, 2)::float8 AS a, round(power(2.5, n_nationkey % 5), 4)::float8 AS b FROM nation"),
    # dates and times
    "fn_clocks": (
        """SELECT count(*) AS n FROM nation WHERE now() > TIMESTAMP '2020-01-01' AND current_timestamp >= transaction_timestamp() AND statement_timestamp() > TIMESTAMP '2020-01-01'
            AND clock_timestamp() > TIMESTAMP '2020-01-01' AND current_date > DATE '2020-01-01' AND localtimestamp > TIMESTAMP '2020-01-01'
            AND current_time IS NOT NULL AND localtime IS NOT NULL""",
        "SELECT count(*) AS n FROM nation"),
    "fn_make_times": (
        """SELECT n_nationkey, make_time(n_nationkey % 24, 30, 5)::text AS a, make_timestamptz(2024, 1, 1 + n_nationkey, 10, 0, 0) AS b,
            (TIMESTAMP '2024-01-01' + make_interval(days => n_nationkey, hours => 2)) AS c FROM nation""",
        """SELECT n_nationkey, printf('%02d:30:05', n_nationkey % 24) AS a, TIMESTAMP '2024-01-01 10:00:00' + n_nationkey * INTERVAL 1 DAY AS b,
            TIMESTAMP '2024-01-01 02:00:00' + n_nationkey * INTERVAL 1 DAY AS c FROM nation"""),
    "fn_justify": (
        """SELECT n_nationkey, justify_hours(INTERVAL '5 hours' * n_nationkey)::text AS a, extract(epoch FROM justify_interval(INTERVAL '1 day' * n_nationkey))::bigint AS b,
            justify_days(INTERVAL '3 days' * n_nationkey)::text AS c FROM nation WHERE n_nationkey > 0""",
        """SELECT n_nationkey, concat_ws(' ', CASE WHEN h // 24 = 1 THEN '1 day' WHEN h // 24 > 1 THEN (h // 24) || ' days' END, CASE WHEN h % 24 > 0 THEN printf('%02d:00:00', h % 24) END) AS a,
            CAST(86400 * n_nationkey AS BIGINT) AS b,
            concat_ws(' ', CASE WHEN d // 30 = 1 THEN '1 mon' WHEN d // 30 > 1 THEN (d // 30) || ' mons' END, CASE WHEN d % 30 = 1 THEN '1 day' WHEN d % 30 > 1 THEN (d % 30) || ' days' END) AS c
            FROM (SELECT n_nationkey, 5 * n_nationkey AS h, 3 * n_nationkey AS d FROM nation WHERE n_nationkey > 0)"""),
    "fn_to_timestamp": (
        """SELECT event_id, to_timestamp(1704067200 + event_id) AS a, to_number(event_id::text || ',500.5', '999,999,999.9')::float8 AS b, to_timestamp(to_char(ts, 'YYYY-MM-DD HH24:MI:SS'), 'YYYY-MM-DD HH24:MI:SS') AS c,
            to_date(to_char(ts, 'DD/MM/YYYY'), 'DD/MM/YYYY') AS d FROM events""",
        "SELECT event_id, TIMESTAMP '2024-01-01' + event_id * INTERVAL 1 SECOND AS a, event_id * 1000 + 500.5::double AS b, date_trunc('second', ts) AS c, CAST(ts AS DATE) AS d FROM events"),
    "fn_time_zones": (
        """SELECT event_id, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS a, timezone('UTC', timezone('Asia/Tokyo', ts)) AS b, ts::timestamptz + INTERVAL '1 day' AS c,
            (ts AT LOCAL) = ts::timestamptz AS d FROM events""",
        "SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) AS a, timezone('UTC', timezone('Asia/Tokyo', ts)) AS b, ts + INTERVAL 1 DAY AS c, true AS d FROM events"),
    "fn_age_rows": (
        "SELECT o_orderkey, extract(year FROM age(TIMESTAMP '2000-01-01', o_orderdate))::int AS a, to_char(o_orderdate, 'YYYY-MM-DD Mon') AS b, make_date(extract(year FROM o_orderdate)::int, 2, 28) AS c FROM orders",
        "SELECT o_orderkey, CAST(extract(year FROM age(TIMESTAMP '2000-01-01', o_orderdate)) AS INT) AS a, strftime(o_orderdate, '%Y-%m-%d %b') AS b, make_date(extract(year FROM o_orderdate), 2, 28) AS c FROM orders"),
    "op_date_times": (
        """SELECT o_orderkey, o_orderdate::date + 3 AS a, o_orderdate::date - 2 AS b, DATE '1998-01-01' - o_orderdate::date AS c, o_orderdate::date + TIME '03:04:05' AS d, INTERVAL '2 hours' + o_orderdate AS e,
            o_orderdate - INTERVAL '1 month' AS f, (o_orderdate - TIMESTAMP '1992-01-01') > INTERVAL '100 days' AS g FROM orders""",
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 3 AS a, CAST(o_orderdate AS DATE) - 2 AS b, CAST(DATE '1998-01-01' - CAST(o_orderdate AS DATE) AS INT) AS c,
            CAST(o_orderdate AS DATE) + TIME '03:04:05' AS d, o_orderdate + INTERVAL 2 HOUR AS e, o_orderdate - INTERVAL 1 MONTH AS f, date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) > 8640000 AS g FROM orders"""),
    # json
    "fn_json_make": (
        """SELECT event_id, to_json(event_type)::text AS a, to_jsonb(user_id)::text AS b, array_to_json(ARRAY[event_id, user_id])::text AS c, jsonb_build_array(event_id, event_type)::text AS d,
            json_build_object('id', event_id)::jsonb ->> 'id' AS e, json_object(ARRAY['a', event_type])::jsonb ->> 'a' AS f, jsonb_object(ARRAY['k'], ARRAY[event_type])::text AS g,
            row_to_json(ROW(event_id, event_type))::jsonb ->> 'f2' AS h FROM events""",
        """SELECT event_id, '"' || event_type || '"' AS a, user_id::text AS b, '[' || event_id || ',' || user_id || ']' AS c, '[' || event_id || ', "' || event_type || '"]' AS d,
            event_id::text AS e, event_type AS f, '{"k": "' || event_type || '"}' AS g, event_type AS h FROM events"""),
    "fn_json_inspect": (
        """SELECT event_id, json_typeof(props::json) AS a, jsonb_typeof(props::jsonb -> 'k') AS b, json_array_length('[1, 2]'::json) + event_id::int AS c, jsonb_path_exists(props::jsonb, '$.k') AS d,
            jsonb_path_query_first(props::jsonb, '$.k')::text AS e, json_extract_path(props::json, 'k')::text AS f, jsonb_extract_path(props::jsonb, 'k')::text AS g,
            json_extract_path_text(props::json, 'k') AS h, jsonb_extract_path_text(props::jsonb, 'k') AS i FROM events""",
        """SELECT event_id, 'object' AS a, 'number' AS b, CAST(2 + event_id AS INT) AS c, true AS d, props ->> '$.k' AS e, props ->> '$.k' AS f, props ->> '$.k' AS g, props ->> '$.k' AS h, props ->> '$.k' AS i FROM events"""),
    "fn_json_change": (
        """SELECT event_id, jsonb_set(props::jsonb, '{k}', '0')::text AS a, jsonb_set_lax(props::jsonb, '{k}', NULL, true, 'delete_key')::text AS b, jsonb_insert(props::jsonb, '{z}', to_jsonb(event_id))::text AS c,
            jsonb_strip_nulls(jsonb_set(props::jsonb, '{k}', 'null'))::text AS d, json_strip_nulls('{"a":null,"b":1}'::json)::text AS e, (props::jsonb #- '{k}')::text AS f,
            length(jsonb_pretty(props::jsonb)) > length(props) AS g, (props::jsonb - 'k')::text AS h, (props::jsonb || '{"q": 1}')::text AS i FROM events""",
        """SELECT event_id, '{"k": 0}' AS a, '{}' AS b, '{"k": ' || (props ->> '$.k') || ', "z": ' || event_id || '}' AS c, '{}' AS d, '{"b":1}' AS e, '{}' AS f, true AS g, '{}' AS h,
            '{"k": ' || (props ->> '$.k') || ', "q": 1}' AS i FROM events"""),
    "op_json_keys": (
        """SELECT event_id, props::jsonb ? 'k' AS a, props::jsonb ?| ARRAY['x', 'k'] AS b, props::jsonb ?& ARRAY['x', 'k'] AS c, props::jsonb <@ '{"k": 1, "z": 2}' AS d, props::jsonb @> '{"k": 1}' AS e,
            props::json #> '{k}' IS NOT NULL AS f, props::jsonb #>> '{k}' AS g FROM events""",
        "SELECT event_id, true AS a, true AS b, false AS c, (props ->> '$.k') = '1' AS d, (props ->> '$.k') = '1' AS e, true AS f, props ->> '$.k' AS g FROM events"),
    "agg_jsonb": (
        "SELECT n_regionkey, jsonb_agg(n_nationkey ORDER BY n_nationkey)::text AS a, length(json_object_agg(n_name, n_nationkey)::text) > 20 AS b FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, '[' || string_agg(n_nationkey::text, ', ' ORDER BY n_nationkey) || ']' AS a, true AS b FROM nation GROUP BY n_regionkey"),
    "srf_json_elements_all": (
        """SELECT n_nationkey, a.x::text AS a, b.x::text AS b, c.x AS c FROM nation, LATERAL json_array_elements(json_build_array(n_nationkey)) AS a(x),
            LATERAL jsonb_array_elements(jsonb_build_array(n_nationkey, 7)) AS b(x), LATERAL json_array_elements_text(json_build_array(n_name)) AS c(x)""",
        "SELECT n_nationkey, n_nationkey::text AS a, unnest([n_nationkey::text, '7']) AS b, n_name AS c FROM nation"),
    "srf_json_each_all": (
        """SELECT event_id, a.key AS ak, a.value::text AS av, b.key AS bk, b.value::text AS bv, c.key AS ck, c.value AS cv FROM events, LATERAL json_each(props::json) AS a,
            LATERAL jsonb_each(props::jsonb) AS b, LATERAL jsonb_each_text(props::jsonb) AS c""",
        "SELECT event_id, 'k' AS ak, props ->> '$.k' AS av, 'k' AS bk, props ->> '$.k' AS bv, 'k' AS ck, props ->> '$.k' AS cv FROM events"),
    "srf_json_keys": (
        "SELECT event_id, a.k AS a, b.k AS b FROM events, LATERAL json_object_keys(props::json) AS a(k), LATERAL jsonb_object_keys(props::jsonb) AS b(k)",
        "SELECT event_id, 'k' AS a, 'k' AS b FROM events"),
    # arrays
    "fn_arr_bounds": (
        """SELECT n_nationkey, array_upper(ARRAY[n_nationkey, 2, 3], 1) AS a, array_lower(ARRAY[n_nationkey], 1) AS b, array_ndims(ARRAY[n_nationkey]) AS c,
            array_to_string(array_append(ARRAY[n_nationkey], 5), ',') AS d, array_to_string(array_prepend(9, ARRAY[n_nationkey]), ',') AS e FROM nation""",
        "SELECT n_nationkey, CAST(3 AS INT) AS a, CAST(1 AS INT) AS b, CAST(1 AS INT) AS c, n_nationkey || ',5' AS d, '9,' || n_nationkey AS e FROM nation"),
    "fn_arr_order": (
        """SELECT n_nationkey, array_to_string(array_sort(ARRAY[n_nationkey, 7, 3]), ',') AS a, array_to_string(array_reverse(ARRAY[n_nationkey, 7, 3]), ',') AS b,
            array_to_string(array_sort(array_shuffle(ARRAY[n_nationkey, 7, 3])), ',') AS c, cardinality(array_sample(ARRAY[n_nationkey, 7, 3], 2)) AS d FROM nation""",
        """SELECT n_nationkey, array_to_string(list_sort([n_nationkey, 7, 3]), ',') AS a, '3,7,' || n_nationkey AS b, array_to_string(list_sort([n_nationkey, 7, 3]), ',') AS c, CAST(2 AS INT) AS d FROM nation"""),
    "fn_arr_change": (
        """SELECT n_nationkey, array_to_string(array_remove(ARRAY[n_regionkey, 2, n_nationkey], 2), ',') AS a, array_to_string(array_replace(ARRAY[n_regionkey, n_nationkey], 2, 99), ',') AS b,
            array_position(ARRAY[9, n_nationkey, 8], 8) AS c, array_to_string((ARRAY[n_nationkey, 2, 3, 4])[2:3], ',') AS d, array_to_string(trim_array(ARRAY[n_nationkey, 2, 3], 1), ',') AS e,
            array_to_string(array_fill(n_nationkey, ARRAY[2]), ',') AS f, array_to_string(array_positions(ARRAY[n_nationkey, n_regionkey, n_nationkey], n_nationkey), ',') AS g,
            array_dims(ARRAY[n_nationkey, 2]) AS h FROM nation""",
        """SELECT n_nationkey, array_to_string(list_filter([n_regionkey, 2, n_nationkey], lambda x: x <> 2), ',') AS a,
            array_to_string(list_transform([n_regionkey, n_nationkey], lambda x: CASE WHEN x = 2 THEN 99 ELSE x END), ',') AS b, CAST(list_position([9, n_nationkey, 8], 8) AS INT) AS c, '2,3' AS d,
            n_nationkey || ',2' AS e, n_nationkey || ',' || n_nationkey AS f, CASE WHEN n_nationkey = n_regionkey THEN '1,2,3' ELSE '1,3' END AS g, '[1:2]' AS h FROM nation"""),
    "op_array_parts": (
        "SELECT n_nationkey, ARRAY[n_nationkey] <@ ARRAY[1, 2, 3] AS a, (ARRAY[n_nationkey, 5] || ARRAY[n_regionkey])[3] AS b FROM nation",
        "SELECT n_nationkey, n_nationkey IN (1, 2, 3) AS a, n_regionkey AS b FROM nation"),
    # text search
    "ts_queries": (
        """SELECT p_partkey, to_tsvector('simple', p_name) @@ plainto_tsquery('simple', 'cold widget') AS a, ts_match_vq(to_tsvector('simple', p_name), to_tsquery('simple', 'bolt')) AS b,
            to_tsvector('simple', p_name) @@ phraseto_tsquery('simple', 'small bolt') AS c, numnode(plainto_tsquery('simple', p_name)) AS d FROM part""",
        """SELECT p_partkey, list_contains(w, 'cold') AND list_contains(w, 'widget') AS a, list_contains(w, 'bolt') AS b, p_name LIKE '%small bolt%' AS c, CAST(2 * len(w) - 1 AS INT) AS d
            FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)"""),
    "ts_ranks": (
        """SELECT p_partkey, ts_rank(to_tsvector('simple', p_name), to_tsquery('simple', 'widget')) > 0 AS a, ts_rank_cd(to_tsvector('simple', p_name), to_tsquery('simple', 'widget')) > 0 AS b,
            ts_headline('simple', p_name, to_tsquery('simple', 'widget')) AS c, tsvector_length(to_tsvector('simple', p_name)) AS d, setweight(to_tsvector('simple', p_type), 'A')::text AS e,
            strip(to_tsvector('simple', p_type))::text AS f FROM part""",
        """SELECT p_partkey, list_contains(string_split(p_name, ' '), 'widget') AS a, list_contains(string_split(p_name, ' '), 'widget') AS b,
            array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN x = 'widget' THEN '<b>widget</b>' ELSE x END), ' ') AS c,
            CAST(len(list_distinct(string_split(p_name, ' '))) AS INT) AS d, '''' || lower(p_type) || ''':1A' AS e, '''' || lower(p_type) || '''' AS f FROM part"""),
    # session and catalogue, asked for beside every row
    "fn_session": (
        """SELECT n_nationkey, version() LIKE 'PostgreSQL%' AS a, current_database() = current_catalog AS b, current_schema() AS c, cardinality(current_schemas(true)) AS d, current_user = session_user AS e,
            current_role = current_user AS f, pg_backend_pid() > 0 AS g, txid_current() > 0 AS h, pg_current_xact_id()::text <> '' AS i, pg_typeof(n_nationkey)::text AS j,
            pg_column_size(n_nationkey) AS k, pg_is_in_recovery() AS l FROM nation""",
        """SELECT n_nationkey, true AS a, true AS b, 'public' AS c, CAST(2 AS INT) AS d, true AS e, true AS f, true AS g, true AS h, true AS i, 'integer' AS j, CAST(4 AS INT) AS k, false AS l FROM nation"""),
    "fn_uuid": (
        "SELECT count(DISTINCT u) AS n, count(DISTINCT v) AS m, bool_and(uuid_extract_version(v) = 4) AS four FROM (SELECT gen_random_uuid() AS u, uuidv4() AS v FROM orders) t",
        "SELECT count(*) AS n, count(*) AS m, true AS four FROM orders"),
    "fn_catalog_helpers": (
        """SELECT n_nationkey, format_type(23, NULL) AS a, obj_description(n_nationkey, 'pg_class') AS b, col_description(n_nationkey, 1) AS c, shobj_description(n_nationkey, 'pg_database') AS d,
            pg_table_is_visible(n_nationkey) AS e, pg_function_is_visible(n_nationkey) AS f, pg_type_is_visible(n_nationkey) AS g, has_table_privilege('nation', 'SELECT') AS h,
            has_schema_privilege('public', 'USAGE') AS i, has_column_privilege('nation', 'n_name', 'SELECT') AS j, pg_encoding_to_char(6) AS k, pg_get_expr(NULL, 0) AS l,
            pg_get_userbyid(10) = current_user AS m FROM nation""",
        """SELECT n_nationkey, 'integer' AS a, NULL::varchar AS b, NULL::varchar AS c, NULL::varchar AS d, true AS e, true AS f, true AS g, true AS h, true AS i, true AS j, 'UTF8' AS k,
            NULL::varchar AS l, true AS m FROM nation"""),
    "fn_server_helpers": (
        """SELECT n_nationkey, pg_size_pretty((n_nationkey * 1048576 * 20)::bigint) AS a, pg_postmaster_start_time() <= now() AS b, pg_conf_load_time() <= now() AS c, inet_client_addr() IS NULL AS d,
            inet_server_addr() IS NULL AS e, pg_try_advisory_lock(n_nationkey) AS f, pg_advisory_unlock(n_nationkey) AS g, pg_notification_queue_usage() AS h, pg_total_relation_size('nation') >= 0 AS i,
            pg_relation_size('nation') >= 0 AS j, pg_table_size('nation') >= 0 AS k, pg_indexes_size('nation') >= 0 AS l, pg_database_size('postgres') >= 0 AS m, txid_current_if_assigned() IS NULL AS o
            FROM nation""",
        """SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN '0 bytes' ELSE (n_nationkey * 20) || ' MB' END AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, 0::double AS h, true AS i,
            true AS j, true AS k, true AS l, true AS m, true AS o FROM nation"""),
    # the rest of the language
    "op_collate": (
        "SELECT n_name COLLATE \"C\" AS a FROM nation ORDER BY n_name COLLATE \"C\" DESC LIMIT 5",
        "SELECT n_name AS a FROM nation ORDER BY n_name DESC LIMIT 5"),
    "op_record_field": (
        "SELECT n_nationkey, (r).f2 AS b FROM (SELECT n_nationkey, ROW(n_regionkey, n_name) AS r FROM nation) t",
        "SELECT n_nationkey, n_name AS b FROM nation"),
    "join_using_alias": (
        "SELECT k.n_nationkey AS key, b.n_name FROM nation a JOIN (SELECT n_nationkey, n_name FROM nation) b USING (n_nationkey) AS k",
        "SELECT n_nationkey AS key, n_name FROM nation"),
    "scan_for_update": ("SELECT n_nationkey FROM nation WHERE n_regionkey = 2 FOR UPDATE", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2"),
    "srf_in_expression": (
        "SELECT n_nationkey, generate_series(1, 3) * n_nationkey + 1 AS x FROM nation",
        "SELECT n_nationkey, unnest([n_nationkey + 1, 2 * n_nationkey + 1, 3 * n_nationkey + 1]) AS x FROM nation"),
    "win_exclude_strings": (
        """SELECT n_nationkey, string_agg(n_name, '; ') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS s,
            avg(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)::float8 AS a FROM nation""",
        """SELECT n_nationkey, string_agg(n_name, '; ') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS s,
            avg(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)::float8 AS a FROM nation"""),
    "seq_rows": (
        "SELECT count(*) AS n FROM nation", "SELECT count(*) AS n FROM nation"),
}
del PAIRS["seq_rows"]
