"""Queries in Presto's spelling by function family and scenario, each with the DuckDB SQL that it must agree with."""

from __future__ import annotations

_N = "(values (1, 2.5e0, 'ab'), (2, null, null), (null, 0e0, ''), (-7, -1.5e0, 'xyz')) as t(i, d, s)"
_A = "(values (1, array[3, 1, 2, 3], array[2, 9]), (2, array[5, null], array[5]), (3, array[], array[1]), (4, null, array[1])) as t(id, a, b)"
_DA = "(values (1, [3, 1, 2, 3], [2, 9]), (2, [5, null], [5]), (3, []::int[], [1]), (4, null, [1])) as t(id, a, b)"
_U = "(values (7, array[array[1, 2, 2], array[3]], array['p', 'q']), (8, array[array[4]], array['r']), (9, array[], null), (10, null, array['s'])) as t(x, aa, s)"
_DU = "(values (7, [[1, 2, 2], [3]], ['p', 'q']), (8, [[4]], ['r']), (9, []::int[][], null), (10, null, ['s'])) as t(x, aa, s)"
_M = "(values (1, map(array['a', 'b'], array[10, 20])), (2, map(array['c'], array[30])), (3, null)) as t(id, m)"
_DM = "(values (1, map {'a': 10, 'b': 20}), (2, map {'c': 30}), (3, null)) as t(id, m)"
_J = """(values (1, '{"a": {"b": [1, 2, 3]}, "s": "x"}'), (2, '{"a": null, "s": "y z"}'), (3, '[1, 2]')) as t(id, j)"""

#: name -> (Presto text, DuckDB text)
FAMILIES: dict[str, tuple[str, str]] = {
    # operators whose meaning differs
    "div_whole_large": (
        "select 9007199254740993 / 1 as a, -7 / 2 as b, 7 / -2 as c, 15 / 4 as d, o_orderkey / 3 as e from orders where o_orderkey < 50",
        "select 9007199254740993 as a, -3 as b, -3 as c, 3 as d, o_orderkey // 3 as e from orders where o_orderkey < 50",
    ),
    "div_double_by_zero": (
        "select i, is_nan(0e0 / d) as n, is_infinite(1e0 / d) as f, 1e0 / d > 0e0 as p, d / 2e0 as h from " + _N,
        "select i, case when d = 0 then true when d is null then null else false end as n, case when d = 0 then true when d is null then null else false end as f, case when d = 0 then true else 1 / d > 0 end as p, d / 2 as h from " + _N,
    ),
    "sort_default_nulls_last": ("select i from " + _N + " order by i desc limit 3", "select i from " + _N + " order by i desc nulls last limit 3"),
    "sort_default_asc_nulls": ("select i from " + _N + " order by i limit 3", "select i from " + _N + " order by i nulls last limit 3"),
    "sort_ordinal": ("select o_custkey, o_orderkey from orders order by 1, 2 desc limit 40", "select o_custkey, o_orderkey from orders order by 1, 2 desc limit 40"),
    "sort_duplicate_keys": ("select o_orderkey from orders order by o_custkey, o_orderkey, o_custkey desc limit 30", "select o_orderkey from orders order by o_custkey, o_orderkey limit 30"),
    "sort_last_wins": ("select k from (select o_orderkey as k from orders order by o_totalprice) t order by k desc limit 10", "select o_orderkey as k from orders order by 1 desc limit 10"),
    "group_drops_sort": ("select k, count(*) as n from (select o_custkey % 5 as k from orders order by o_orderkey) t group by k", "select o_custkey % 5 as k, count(*) as n from orders group by 1"),
    "filter_after_limit": ("select k from (select o_orderkey as k from orders order by o_orderkey limit 20) t where k % 2 = 0", "select k from (select o_orderkey as k from orders order by o_orderkey limit 20) t where k % 2 = 0"),
    "limit_fetch_first": ("select o_orderkey from orders order by o_orderkey offset 5 rows fetch first 4 rows only", "select o_orderkey from orders order by o_orderkey limit 4 offset 5"),
    "win_nulls_last": ("select i, row_number() over (order by i) as r from " + _N, "select i, row_number() over (order by i nulls last) as r from " + _N),
    "string_literals": ("select 'it''s' as a, 'back\\slash' as b, length('\\n') as c, 'x' like 'x' as d, 'a\\b' like 'a\\b' as e", "select 'it''s' as a, 'back\\slash' as b, length('\\n') as c, 'x' like 'x' as d, 'a\\b' like 'a\\b' as e"),
    "quoted_names": ('select "r_name" as "A b" from "region" where "r_regionkey" < 3', 'select r_name as "A b" from region where r_regionkey < 3'),
    # special forms
    "try_forms": (
        "select i, try(10 / (i - 1)) as a, try(cast(s as integer)) as b, try(array[1, 2][i]) as c, try_cast(s as double) as d from " + _N,
        "select i, 10 // nullif(i - 1, 0) as a, try_cast(s as integer) as b, case when i between 1 and 2 then i end as c, try_cast(s as double) as d from " + _N,
    ),
    "quantified_any_all": (
        "select n_nationkey, n_nationkey > all (select s_nationkey from supplier where s_nationkey < 9) as a, n_nationkey = any (select s_nationkey from supplier) as b, "
        "n_nationkey < any (select s_nationkey from supplier where s_acctbal < 0) as c, n_nationkey <> all (select s_nationkey from supplier) as d from nation",
        "select n_nationkey, n_nationkey > all (select s_nationkey from supplier where s_nationkey < 9) as a, n_nationkey = any (select s_nationkey from supplier) as b, "
        "n_nationkey < any (select s_nationkey from supplier where s_acctbal < 0) as c, n_nationkey <> all (select s_nationkey from supplier) as d from nation",
    ),
    "quantified_nulls_and_empty": (
        "select r_regionkey as k, r_regionkey > all (select i from " + _N + ") as a, r_regionkey > any (select i from " + _N + ") as b, r_regionkey > all (select i from " + _N + " where i > 99) as c, r_regionkey > any (select i from " + _N + " where i > 99) as d from region",
        "select r_regionkey as k, case when r_regionkey > 2 then null else false end as a, true as b, true as c, false as d from region",
    ),
    "row_and_field": ("select id, r.x as x, r.y as y, r.x + 1 as z from (select n_nationkey as id, cast(row(n_regionkey, n_name) as row(x bigint, y varchar)) as r from nation) t", "select n_nationkey as id, n_regionkey::bigint as x, n_name as y, n_regionkey::bigint + 1 as z from nation"),
    "subscripts": ("select id, a[1] as f, element_at(a, 9) as m, element_at(a, -1) as l, b[1] as b1 from " + _A + " where cardinality(a) > 0", "select id, a[1] as f, a[9] as m, a[-1] as l, b[1] as b1 from " + _DA + " where len(a) > 0"),
    "map_subscripts": ("select id, element_at(m, 'a') as a, m['c'] as c from " + _M + " where id = 2", "select 2 as id, null::int as a, 30 as c"),
    "if_nullif_coalesce": ("select i, if(i > 0, 'p') as a, if(i > 0, 'p', 'n') as b, nullif(s, '') as c, coalesce(s, cast(i as varchar), '?') as d from " + _N, "select i, case when i > 0 then 'p' end as a, case when i > 0 then 'p' else 'n' end as b, nullif(s, '') as c, coalesce(s, i::varchar, '?') as d from " + _N),
    "greatest_least_nulls": ("select i, greatest(i, 1) as g, least(i, 1, 5) as l, greatest(s, 'b') as s1 from " + _N, "select i, case when i is not null then greatest(i, 1) end as g, case when i is not null then least(i, 1, 5) end as l, case when s is not null then greatest(s, 'b') end as s1 from " + _N),
    "values_with_rows": ("select x, a, m['k'] as k, r.f as f from (values (1, array[1, 2], map(array['k'], array[5]), cast(row('q') as row(f varchar)))) as t(x, a, m, r)", "select 1 as x, [1, 2] as a, 5 as k, 'q' as f"),
    # strings
    "fn_string_more": (
        "select p_partkey, lower(p_brand) as a, strpos(p_name, 'a') as b, starts_with(p_name, 's') as c, ends_with(p_name, 'g') as d, chr(65) as e, codepoint('é') as f, hamming_distance('karolin', 'kathrin') as g, substr(p_name, -3) as h, ltrim('  x') as k, rtrim('x  ') as l, "
        "concat(p_brand, '-', p_type) as m, position('r' in p_name) as n, translate(p_name, 'aeiou', 'AEIOU') as o, cardinality(split(p_name, ' ')) as p, levenshtein_distance(p_name, p_brand) as q, to_utf8('é') = from_hex('C3A9') as r from part",
        "select p_partkey, lower(p_brand) as a, strpos(p_name, 'a') as b, starts_with(p_name, 's') as c, ends_with(p_name, 'g') as d, chr(65) as e, unicode('é') as f, 3 as g, substr(p_name, -3) as h, ltrim('  x') as k, rtrim('x  ') as l, "
        "concat(p_brand, '-', p_type) as m, strpos(p_name, 'r') as n, translate(p_name, 'aeiou', 'AEIOU') as o, len(string_split(p_name, ' ')) as p, levenshtein(p_name, p_brand) as q, true as r from part",
    ),
    "fn_regex_more": (
        "select p_partkey, regexp_like(p_name, '^s.*g$') as a, regexp_extract(p_name, '[a-z]+$') as b, regexp_extract(p_name, '(zz+)') as c, array_join(regexp_extract_all(p_name, '[aeiou]'), ',') as d, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) as e, "
        "array_join(regexp_split(p_name, '[ae]'), '|') as f, regexp_count(p_name, '[aeiou]') as g, regexp_replace(p_name, ' ') as h from part",
        "select p_partkey, regexp_matches(p_name, '^s.*g$') as a, regexp_extract(p_name, '[a-z]+$') as b, null::varchar as c, array_to_string(regexp_extract_all(p_name, '[aeiou]'), ',') as d, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) as e, "
        "array_to_string(regexp_split_to_array(p_name, '[ae]'), '|') as f, len(regexp_extract_all(p_name, '[aeiou]')) as g, regexp_replace(p_name, ' ', '', 'g') as h from part",
    ),
    "fn_normalize": ("select normalize('e\u0301') = 'é' as c, length(normalize('é', 'NFD')) as d", "select true as c, 2 as d"),
    # numbers
    "fn_math_more": (
        "select i, d, ceil(d) as a, floor(d) as b, round(cbrt(27e0), 6) as c, log2(8e0) as e, log10(1000e0) as f, truncate(d) as g, round(sin(1e0), 8) as h, round(atan2(1e0, 2e0), 8) as k, is_nan(nan()) as l, is_finite(d) as m, is_infinite(infinity()) as n, width_bucket(5e0, 0e0, 10e0, 4) as o, "
        "mod(i, 3) as p, pow(2e0, 3e0) as q, sign(i) as r, round(pi(), 6) as s1, round(e(), 6) as t1, to_base(255, 16) as u, from_base('ff', 16) as v from " + _N,
        "select i, d, ceil(d)::double as a, floor(d)::double as b, 3.0::double as c, 3.0::double as e, 3.0::double as f, trunc(d)::double as g, round(sin(1), 8) as h, round(atan2(1, 2), 8) as k, true as l, isfinite(d) as m, true as n, 3 as o, "
        "i % 3 as p, 8.0::double as q, sign(i)::double as r, round(pi(), 6) as s1, 2.718282::double as t1, 'ff' as u, 255 as v from " + _N,
    ),
    "fn_bitwise": (
        "select p_partkey, bitwise_and(p_size, 6) as a, bitwise_or(p_size, 8) as b, bitwise_xor(p_size, 5) as c, bitwise_not(p_size) as d, bitwise_left_shift(p_size, 2) as e, bit_count(p_size, 64) as f, bitwise_arithmetic_shift_right(p_size, 1) as g from part",
        "select p_partkey, p_size & 6 as a, p_size | 8 as b, xor(p_size, 5) as c, ~p_size as d, p_size << 2 as e, bit_count(p_size)::int as f, p_size >> 1 as g from part",
    ),
    # dates
    "fn_date_more": (
        "select event_id, date_format(ts, '%Y-%m-%d %H:%i:%s') as a, date_trunc('hour', ts) as b, date_diff('hour', timestamp '2024-01-01 00:00:00', ts) as c, date_add('day', 2, ts) as d, extract(year from ts) as e, minute(ts) as f, second(ts) as g, day_of_week(ts) as h, "
        "year_of_week(ts) as k, cast(last_day_of_month(cast(ts as date)) as varchar) as l, quarter(ts) as m, day_of_year(ts) as n, week(ts) as o, cast(ts as date) - interval '1' month as p from events",
        "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as a, date_trunc('hour', ts) as b, floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 3600)::bigint as c, ts + interval 2 day as d, year(ts) as e, minute(ts) as f, second(ts) as g, isodow(ts) as h, "
        "isoyear(ts) as k, last_day(ts::date)::varchar as l, quarter(ts) as m, dayofyear(ts) as n, week(ts) as o, (ts::date - interval 1 month)::date as p from events",
    ),
    "fn_date_parse": (
        "select date_parse('2024-02-29 13:05:09', '%Y-%m-%d %H:%i:%s') as a, from_iso8601_date('2024-03-01') as b, to_unixtime(from_unixtime(1700000000)) as c, date_diff('day', date '2024-02-28', date '2024-03-01') as d, extract(timezone_hour from timestamp '2024-01-01 00:00:00 UTC') as e, "
        "date '2024-01-31' + interval '1' month as f, to_unixtime(timestamp '2024-01-01 00:00:00') as g",
        "select timestamp '2024-02-29 13:05:09' as a, date '2024-03-01' as b, 1700000000.0::double as c, 2::bigint as d, 0 as e, date '2024-02-29' as f, 1704067200.0::double as g",
    ),
    # arrays, maps
    "fn_array_more": (
        "select id, array_position(a, 3) as p, array_remove(a, 3) as r, array_sort(array_intersect(a, b)) as x, array_sort(array_union(a, b)) as u, array_sort(array_except(a, b)) as e, arrays_overlap(a, b) as o, cardinality(a) as n, contains(a, 2) as c, slice(a, 2, 2) as s, reverse(a) as v, array_max(a) as m, "
        "any_match(a, y -> y > 2) as am, all_match(a, y -> y > 0) as al, none_match(a, y -> y > 9) as nm, reduce(filter(a, y -> y is not null), 0, (q, y) -> q + y, q -> q * 2) as rd, concat(a, b) as cc, trim_array(a, 1) as ta from " + _A + " where id = 1",
        "select 1 as id, 1::bigint as p, [1, 2] as r, [2] as x, [1, 2, 3, 9] as u, [1, 3] as e, true as o, 4 as n, true as c, [1, 2] as s, [3, 2, 1, 3] as v, 3 as m, true as am, true as al, true as nm, 18 as rd, [3, 1, 2, 3, 2, 9] as cc, [3, 1, 2] as ta",
    ),
    "fn_array_build": (
        "select flatten(array[array[1], array[2, 3]]) as f, sequence(1, 7, 3) as s, repeat('x', 3) as r, array_distinct(array[1, 1, 2]) as d, ngrams(array['a', 'b', 'c'], 2) as n, cardinality(combinations(array[1, 2, 3], 2)) as c, array_join(array['a', null, 'b'], '-') as j, array_join(array['a', null], '-', '?') as k, "
        "zip_with(array[1, 2], array[10, 20], (x, y) -> x + y) as z, transform(array[1, 2, 3], x -> x / 2) as t, array[1] || array[2] as o, remove_nulls(array[1, null]) as q",
        "select [1, 2, 3] as f, [1, 4, 7] as s, ['x', 'x', 'x'] as r, [1, 2] as d, [['a', 'b'], ['b', 'c']] as n, 3 as c, 'a-b' as j, 'a-?' as k, [11, 22] as z, [0, 1, 1] as t, [1, 2] as o, [1] as q",
    ),
    "fn_map_more": (
        "select id, array_sort(map_keys(m)) as k, array_sort(map_values(m)) as v, cardinality(m) as n, array_sort(map_keys(map_filter(m, (k, v) -> v > 10))) as f, element_at(transform_values(m, (k, v) -> v / 3), 'a') as t, element_at(map_concat(m, map(array['z'], array[1])), 'z') as z, "
        "array_sort(map_keys(transform_keys(m, (k, v) -> concat(k, '!')))) as tk, element_at(map_from_entries(array[row('p', 1)]), 'p') as e from " + _M + " where id < 3",
        "select * from (values (1, ['a', 'b'], [10, 20], 2, ['b'], 3, 1, ['a!', 'b!'], 1), (2, ['c'], [30], 1, ['c'], null, 1, ['c!'], 1)) t(id, k, v, n, f, t, z, tk, e)",
    ),
    # json, binary, url
    "fn_json_more": (
        "select id, json_extract_scalar(j, '$.s') as s, json_extract_scalar(j, '$.a.b[1]') as b, json_array_length(j) as n, json_extract(j, '$.a.b') as e, json_size(j, '$.a.b') as z from " + _J,
        "select * from (values (1, 'x', '2', null, '[1,2,3]', 3), (2, 'y z', null, null, null, 0), (3, null, null, 2, null, 0)) t(id, s, b, n, e, z)",
    ),
    "fn_hash_more": (
        "select p_partkey, lower(to_hex(md5(to_utf8(p_name)))) as m, lower(to_hex(sha1(to_utf8(p_name)))) as s1, lower(to_hex(sha256(to_utf8(p_name)))) as s2, to_base64(to_utf8(p_name)) as b, from_utf8(from_base64(to_base64(to_utf8(p_name)))) as r, from_utf8(from_hex('41')) as h, crc32(to_utf8('abc')) as c from part",
        "select p_partkey, md5(p_name) as m, sha1(p_name) as s1, sha256(p_name) as s2, to_base64(encode(p_name)) as b, p_name as r, 'A' as h, 891568578 as c from part",
    ),
    "fn_hash": ("select p_partkey, lower(to_hex(md5(to_utf8(p_name)))) as m from part", "select p_partkey, md5(p_name) as m from part"),
    "fn_url": (
        "select page_id, url_extract_host(url) as h, url_extract_path(url) as p, url_extract_protocol(url) as s, url_extract_parameter(url, 'utm_source') as u, url_encode('a b&c') as e, url_decode('a%20b') as d, url_extract_port('http://x.y:81/z') as o from pages",
        "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '^([a-z]+):', 1) as s, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') as u, 'a+b%26c' as e, 'a b' as d, 81 as o from pages",
    ),
    # aggregates
    "agg_more_moments": (
        "select l_returnflag, round(skewness(l_quantity), 4) + 0e0 as s, round(regr_intercept(l_extendedprice, l_quantity), 2) as r, round(geometric_mean(l_quantity), 4) as g, round(entropy(l_quantity), 4) as e, round(stddev_pop(l_tax), 6) as d, round(covar_samp(l_quantity, l_tax), 6) as c from lineitem group by l_returnflag",
        "select l_returnflag, round(m3 / power(m2, 1.5), 4) + 0 as s, r, g, e, d, c from (select l_returnflag, count(*) as n, avg(power(l_quantity - mu, 3)) as m3, avg(power(l_quantity - mu, 2)) as m2, round(regr_intercept(l_extendedprice, l_quantity), 2) as r, "
        "round(exp(avg(ln(l_quantity))), 4) as g, round((ln(sum(l_quantity)) - sum(l_quantity * ln(l_quantity)) / sum(l_quantity)) / ln(2), 4) as e, round(stddev_pop(l_tax), 6) as d, round(covar_samp(l_quantity, l_tax), 6) as c "
        "from (select *, avg(l_quantity) over (partition by l_returnflag) as mu from lineitem) group by l_returnflag)",
    ),
    "agg_maps": (
        "select o_orderstatus, element_at(histogram(o_orderpriority), '1-URGENT') as h, cardinality(map_agg(o_orderkey, o_custkey)) as n, cardinality(multimap_agg(o_orderpriority, o_orderkey)) as k, cardinality(element_at(multimap_agg(o_orderpriority, o_orderkey), '1-URGENT')) as u, cardinality(set_agg(o_orderpriority)) as s from orders where o_orderkey < 400 group by o_orderstatus",
        "select o_orderstatus, nullif(count(*) filter (where o_orderpriority = '1-URGENT'), 0) as h, count(*) as n, count(distinct o_orderpriority) as k, nullif(count(*) filter (where o_orderpriority = '1-URGENT'), 0) as u, count(distinct o_orderpriority) as s from orders where o_orderkey < 400 group by o_orderstatus",
    ),
    "agg_map_union": ("select array_sort(map_keys(map_union(m))) as k, cardinality(map_union(m)) as n from " + _M, "select ['a', 'b', 'c'] as k, 3 as n"),
    "agg_reduce": ("select o_orderstatus, reduce_agg(o_orderkey, cast(0 as bigint), (a, b) -> a + b, (a, b) -> a + b) as s from orders group by o_orderstatus", "select o_orderstatus, sum(o_orderkey)::bigint as s from orders group by o_orderstatus"),
    "agg_count_any": (
        "select o_orderstatus, count_if(o_totalprice > 100000e0) as c, arbitrary(o_orderstatus) as a, any_value(o_orderstatus) as v, every(o_orderkey >= 0) as e, array_sort(max(o_orderkey, 3)) as m, array_sort(min(o_orderkey, 2)) as n from orders group by o_orderstatus",
        "select o_orderstatus, count(*) filter (where o_totalprice > 100000) as c, o_orderstatus as a, o_orderstatus as v, true as e, list_sort(max(o_orderkey, 3)) as m, list_sort(min(o_orderkey, 2)) as n from orders group by o_orderstatus",
    ),
    "agg_array_modifiers": (
        "select o_orderstatus, array_join(array_agg(distinct o_orderpriority order by o_orderpriority desc) filter (where o_custkey < 100), ',') as p, array_join(array_agg(o_orderkey order by o_totalprice, o_orderkey), ',') as k from orders where o_orderkey < 500 group by o_orderstatus",
        "select o_orderstatus, coalesce(string_agg(distinct o_orderpriority, ',' order by o_orderpriority desc) filter (where o_custkey < 100), '') as p, string_agg(o_orderkey::varchar, ',' order by o_totalprice, o_orderkey) as k from orders where o_orderkey < 500 group by o_orderstatus",
    ),
    "agg_array_nulls": ("select array_agg(i order by i) as a, cardinality(array_agg(s)) as n from " + _N, "select [-7, 1, 2, null] as a, 4 as n"),
    "agg_checksum": (
        "select (select checksum(o_orderkey) from orders) = (select checksum(k) from (select o_orderkey as k from orders order by o_totalprice) t) as same, (select checksum(o_orderkey) from orders) = (select checksum(o_custkey) from orders) as other",
        "select true as same, false as other",
    ),
    "agg_approx": (
        "select abs(approx_distinct(o_custkey) - count(distinct o_custkey)) * 10 <= count(distinct o_custkey) as d, abs(approx_percentile(o_orderkey, 0.5) - avg(o_orderkey)) * 20 <= max(o_orderkey) as p, cardinality(approx_most_frequent(3, o_orderstatus, 100)) as f from orders",
        "select true as d, true as p, 3 as f",
    ),
    # unnest, in SQL and around other operators
    "unnest_sql": ("select x, s1 from " + _U + " cross join unnest(s) as u(s1)", "select x, unnest(s) as s1 from " + _DU),
    "unnest_sql_ordinality": ("select x, v, n from " + _U + " cross join unnest(s) with ordinality as u(v, n)", "select * from (values (7, 'p', 1::bigint), (7, 'q', 2), (8, 'r', 1), (10, 's', 1)) t(x, v, n)"),
    "unnest_sql_zip": ("select x, e, v from " + _U + " cross join unnest(aa, s) as u(e, v)", "select * from (values (7, [1, 2, 2], 'p'), (7, [3], 'q'), (8, [4], 'r'), (10, null, 's')) t(x, e, v)"),
    "unnest_sql_map": ("select id, k, v from " + _M + " cross join unnest(m) as u(k, v)", "select * from (values (1, 'a', 10), (1, 'b', 20), (2, 'c', 30)) t(id, k, v)"),
    "unnest_sql_chain": ("select x, y from " + _U + " cross join unnest(aa) as u(e) cross join unnest(e) as w(y)", "select x, unnest(e) as y from (select x, unnest(aa) as e from " + _DU + ")"),
    "unnest_sql_rows": ("select id, f, g from (values (1, array[row(1, 'a'), row(2, 'b')])) as t(id, r) cross join unnest(r) as u(f, g)", "select * from (values (1, 1, 'a'), (1, 2, 'b')) t(id, f, g)"),
    "unnest_sql_constant": ("select v * 2 as d from unnest(array[1, 2, 3]) as t(v)", "select * from (values (2), (4), (6)) t(d)"),
    "unnest_sql_left": ("select x, v from " + _U + " left join unnest(s) as u(v) on true", "select * from (values (7, 'p'), (7, 'q'), (8, 'r'), (9, null), (10, 's')) t(x, v)"),
    "unnest_filter_before": ("select x, v from (select * from " + _U + " where x > 7) q cross join unnest(s) as u(v)", "select x, v from (select x, unnest(s) as v from " + _DU + ") where x > 7"),
    "unnest_filter_after": ("select x, y from " + _U + " cross join unnest(aa) as u(e) cross join unnest(e) as w(y) where y > x - 6", "select x, y from (select x, unnest(e) as y from (select x, unnest(aa) as e from " + _DU + ")) where y > x - 6"),
    "unnest_project_before": ("select x2, v from (select x * 2 as x2, transform(s, z -> concat(z, '!')) as s2 from " + _U + ") q cross join unnest(s2) as u(v)", "select x * 2 as x2, unnest(list_transform(s, lambda z: z || '!')) as v from " + _DU),
    "unnest_group_before": ("select k, v from (select n_regionkey as k, array_agg(n_nationkey) as a from nation group by n_regionkey) q cross join unnest(a) as u(v)", "select n_regionkey as k, n_nationkey as v from nation"),
    "unnest_group_after": ("select y, count(*) as n, sum(x) as s from " + _U + " cross join unnest(aa) as u(e) cross join unnest(e) as w(y) group by y", "select y, count(*) as n, sum(x)::bigint as s from (select x, unnest(e) as y from (select x, unnest(aa) as e from " + _DU + ")) group by y"),
    "unnest_sort_limit_before": ("select x, v from (select * from " + _U + " order by x limit 2) q cross join unnest(s) as u(v)", "select * from (values (7, 'p'), (7, 'q'), (8, 'r')) t(x, v)"),
    "unnest_sort_limit_after": ("select x, v from " + _U + " cross join unnest(s) as u(v) order by v desc limit 2", "select * from (values (10, 's'), (8, 'r')) t(x, v)"),
    "unnest_join_before": ("select r_name, v from region join (select x - 7 as k, s from " + _U + ") q on r_regionkey = k cross join unnest(s) as u(v)", "select r_name, v from region join (select x - 7 as k, unnest(s) as v from " + _DU + ") on r_regionkey = k"),
    "unnest_join_key": ("select y, n_name from " + _U + " cross join unnest(aa) as u(e) cross join unnest(e) as w(y) join nation on n_nationkey = y", "select y, n_name from (select unnest(e) as y from (select unnest(aa) as e from " + _DU + ")) join nation on n_nationkey = y"),
    "unnest_both_sides": (
        "select a.v as v, b.y as y from (select x, v from " + _U + " cross join unnest(s) as u(v)) a join (select x, y from " + _U + " cross join unnest(aa) as u(e) cross join unnest(e) as w(y)) b on a.x = b.x",
        "select a.v as v, b.y as y from (select x, unnest(s) as v from " + _DU + ") a join (select x, unnest(e) as y from (select x, unnest(aa) as e from " + _DU + ")) b on a.x = b.x",
    ),
    "unnest_distinct": ("select distinct y from " + _U + " cross join unnest(aa) as u(e) cross join unnest(e) as w(y)", "select * from (values (1), (2), (3), (4)) t(y)"),
    "unnest_in_subquery": ("select n_nationkey from nation where n_nationkey in (select y from " + _U + " cross join unnest(aa) as u(e) cross join unnest(e) as w(y))", "select n_nationkey from nation where n_nationkey between 1 and 4"),
    # joins of unions, values and scans
    "join_union_values": ("select a.k as k, b.v as v from (select n_nationkey as k from nation where n_nationkey < 3 union all select * from (values 7, 8)) a join (values (1, 'x'), (7, 'y'), (99, 'z')) as b(k, v) on a.k = b.k", "select * from (values (1, 'x'), (7, 'y')) t(k, v)"),
    "join_union_union": ("select count(*) as n from (select n_nationkey as k from nation union all select r_regionkey from region) a join (select n_regionkey as k from nation union select 77) b on a.k = b.k", "select count(*) as n from (select n_nationkey as k from nation union all select r_regionkey from region) a join (select n_regionkey as k from nation union select 77) b on a.k = b.k"),
    "join_values_scans": ("select v.n as n, r_name, n_name from (values (0, 'a'), (3, 'b')) as v(k, n) join region on r_regionkey = v.k join nation on n_regionkey = r_regionkey and n_nationkey > 10", "select v.n as n, r_name, n_name from (values (0, 'a'), (3, 'b')) as v(k, n) join region on r_regionkey = v.k join nation on n_regionkey = r_regionkey and n_nationkey > 10"),
    "join_four_leaves": (
        "select count(*) as n, sum(c.k) as s from (select 1 as k union all select 2) a join (values 1, 2, 3) as b(k) on a.k = b.k join (select n_regionkey as k from nation) c on c.k = a.k join region on r_regionkey = c.k",
        "select count(*) as n, sum(n_regionkey)::bigint as s from nation where n_regionkey in (1, 2)",
    ),
    "rand_in_range": ("select count(*) as n from (select rand() as r from orders) t where r >= 0e0 and r < 1e0", "select count(*) as n from orders"),
    "rand_fence": ("select count(*) <= 1500000 as few from (select o_orderkey from orders where rand() < 0.5e0) t where o_orderkey >= 0", "select true as few"),
    "overflow_try": ("select try(9223372036854775807 + 1) as a, try(cast(300 as tinyint)) as b, try(2147483647 * 2) as c", "select null::bigint as a, null::tinyint as b, null::int as c"),
    "constant_folding": ("select o_orderkey + (1 + 2) * 3 as a, if(1 < 2, 'y', 'n') as b, cast('7' as integer) + 1 as c from orders where 5 in (1, 2 + 3) and o_orderkey < 4", "select o_orderkey + 9 as a, 'y' as b, 8 as c from orders where o_orderkey < 4"),
    "with_columns": ("with t(a, b) as (select r_regionkey, r_name from region), u as (select a / 2 as h, b from t) select h, count(*) as n from u group by h", "select r_regionkey // 2 as h, count(*) as n from region group by 1"),
    "table_and_values": ("select * from (table region) t union all values (9, 'X')", "select * from region union all values (9, 'X')"),
}
