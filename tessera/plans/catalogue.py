"""The engine's queries by operator family, with the DuckDB SQL that each must agree with.

SAME holds text that both engines run but for the spelling of whole-number division and timestamps (div, timestamp_ntz here);
the families hold text in Presto's spelling beside DuckDB's. Both run through the Presto translator. BUILT holds queries made
with the plan builder, DataFrame calls or statements, each with its own SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import presto
from tessera.operators.builder import Plan
from tessera.operators.windows import groups_frame
from tessera.plans.families import FAMILIES
from tessera.session import configure, load_tables, table
from tessera.sources.statistics import column_stats
from tessera.sql.presto import query

_V = "(values (1, 'a'), (2, 'b'), (2, 'b'), (cast(null as int), 'c'), (3, null), (cast(null as int), null)) v(k, s)"
_W = "(values (2, 'b'), (3, null), (4, 'd'), (cast(null as int), null)) w(k, s)"
_REV = "round(sum(l_extendedprice * (1 - l_discount)), 2)"

SAME = {
    # scans, values, projections
    "scan_select_columns": "select n_nationkey, n_name from nation",
    "scan_select_all": "select * from region",
    "scan_product_filtered": "select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_name <> 'ASIA'",
    "values_inline": f"select k, s from {_V}",
    "select_no_from": "select cast(1 as bigint) as one, cast(0.5 as double) as half, 'x' as x",
    "project_arith": "select o_orderkey, o_orderkey % 7 as m, o_orderkey div 7 as d, round(o_totalprice * 2 - 1, 4) as t, -o_custkey as neg from orders",
    "project_case_if": "select p_partkey, case when p_size > 30 then 'big' when p_size > 10 then 'mid' else 'small' end as c, case p_brand when 'Brand#1' then 1 else 0 end as b1 from part",
    "project_cast_try_cast": "select p_partkey, cast(p_size as bigint) as s, try_cast(p_name as bigint) as n, cast(p_partkey as varchar(20)) as t from part",
    "project_coalesce_nullif": f"select coalesce(k, -1) as k, coalesce(s, '?') as s, nullif(k, 2) as n from {_V}",
    "select_distinct": "select distinct c_nationkey, c_mktsegment from customer",
    "subquery_from_derived": "select n, count(*) as customers from (select c_nationkey as n from customer where c_acctbal > 0) t group by n",
    "column_aliases": "select t.a, t.b from (select r_regionkey, r_name from region) as t(a, b)",
    # predicates
    "filter_conjuncts": "select l_orderkey, l_linenumber from lineitem where l_quantity < 10 and l_discount >= 0.05 and l_returnflag = 'A'",
    "filter_or_common": "select l_orderkey, l_linenumber from lineitem where (l_returnflag = 'R' and l_quantity > 45) or (l_returnflag = 'R' and l_tax > 0.07)",
    "filter_in_list": "select p_partkey from part where p_size in (1, 5, 9) and p_brand not in ('Brand#1', 'Brand#2')",
    "filter_between": "select o_orderkey from orders where o_totalprice between 1000 and 50000 and o_custkey not between 10 and 1000",
    "filter_like_escape": "select p_partkey, p_name from part where p_name like '%ring' or p_name like 's_a%' or p_name like '%!%%' escape '!'",
    "filter_is_null": f"select s from {_V} where k is null and s is not null",
    "filter_is_distinct": f"select k, s from {_V} where k is distinct from 2",
    "filter_three_valued": f"select k, k > 1 as gt, not (k > 1) as le, k > 1 or s = 'c' as o, k > 1 and s = 'b' as a from {_V}",
    # joins
    "join_inner": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 100000",
    "join_left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000",
    "join_right": "select o_orderkey, c_custkey from orders right join customer on o_custkey = c_custkey and o_orderstatus = 'P'",
    "join_full": f"select v.k as vk, w.k as wk, v.s as vs, w.s as ws from {_V} full join {_W} on v.k = w.k",
    "join_cross": "select r_name, s.n from region cross join (select count(*) as n from supplier) s",
    "join_theta": "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey",
    "join_non_equi": "select a.r_regionkey as x, b.r_regionkey as y from region a join region b on a.r_regionkey > b.r_regionkey",
    "join_expr_key": "select n_name, r_name from nation join region on n_regionkey + 1 = r_regionkey + 1",
    "join_multi_key": "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber",
    "join_self_alias": "select n1.n_name as a, n2.n_name as b from nation n1, nation n2 where n1.n_regionkey = n2.n_regionkey and n1.n_nationkey = n2.n_nationkey + 5",
    "join_using": "select k, a.s as x, b.s as y from (select k, s from " + _V + ") a join (select k, s from " + _W + ") b using (k)",
    "join_natural": "select r_regionkey, n from region natural join (select n_regionkey as r_regionkey, count(*) as n from nation group by n_regionkey) t",
    "join_three_way_chain": "select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
    "join_of_unions": "select t.k, n_name from (select 1 as k union all select 2 union all select 7) t join nation on t.k = n_nationkey",
    "join_semi_in": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)",
    "join_semi_exists": "select o_orderkey from orders o where exists (select 1 from lineitem where l_orderkey = o.o_orderkey and l_returnflag = 'R')",
    "join_anti_exists": "select o_orderkey from orders o where not exists (select 1 from lineitem where l_orderkey = o.o_orderkey and l_returnflag = 'R')",
    "join_anti_not_in": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)",
    "join_anti_not_in_nulls": f"select count(*) as n from customer where c_custkey not in (select k from {_V})",
    "exists_as_value": "select r_regionkey, exists (select 1 from nation where n_regionkey = r_regionkey and n_nationkey > 22) as has from region",
    # aggregation
    "agg_global": "select count(*) as n, round(sum(l_quantity), 2) as q, round(avg(l_discount), 6) as d, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem",
    "agg_group": f"select l_returnflag, l_linestatus, count(*) as n, {_REV} as revenue from lineitem group by l_returnflag, l_linestatus",
    "agg_expr_key": "select o_orderkey % 10 as k, cast(sum(o_custkey) as bigint) as s from orders group by o_orderkey % 10",
    "agg_ordinal": "select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2",
    "agg_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15 and sum(o_totalprice) > 100000",
    "agg_having_no_group": "select count(*) as n from orders having count(*) > 1",
    "agg_filter_mask": "select l_returnflag, count(*) filter (where l_quantity > 25) as big, round(sum(l_tax) filter (where l_linestatus = 'O'), 4) as t from lineitem group by l_returnflag",
    "agg_distinct": "select l_returnflag, count(distinct l_suppkey) as s, cast(sum(distinct l_linenumber) as bigint) as l, count(distinct l_partkey) as p from lineitem group by l_returnflag",
    "agg_nested": "select n, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) t group by n",
    "agg_scalar_over_agg": "select l_linestatus, round(sum(l_tax) / sum(l_discount), 6) as r, 100 * count(*) as h from lineitem group by l_linestatus",
    "agg_empty_input": "select count(*) as n, sum(o_totalprice) as s, max(o_orderkey) as m from orders where o_orderkey < 0",
    "agg_grouping_sets": "select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as bigint) as g, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_cube": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "agg_rollup": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "agg_bool_bit": "select bool_and(k > 0) as a, bool_or(k > 2) as o, cast(bit_and(k) as bigint) as ba, cast(bit_or(k) as bigint) as bo, cast(bit_xor(k) as bigint) as bx from " + _V,
    "agg_min_by": "select p_brand, min_by(p_partkey, p_partkey + p_size * 100000) as lo, max_by(p_partkey, p_partkey + p_size * 100000) as hi from part group by p_brand",
    "agg_moments": "select round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_discount), 8) as v, round(corr(l_quantity, l_extendedprice), 6) as c, round(covar_pop(l_quantity, l_tax), 6) as cp, round(regr_slope(l_extendedprice, l_quantity), 4) as rs from lineitem",
    # sets
    "set_union_all": "select n_regionkey as k from nation union all select r_regionkey from region",
    "set_union": "select n_regionkey as k from nation union select r_regionkey + 2 from region",
    "set_intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "set_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000",
    "set_intersect_all": f"select k, s from {_V} intersect all select k, s from {_W}",
    "set_except_all": f"select k, s from {_V} except all select k, s from {_W}",
    "set_null_rows": f"select k, s from {_V} intersect select k, s from {_W}",
    "set_nary": "select n_nationkey as k from nation where n_nationkey < 21 intersect select n_nationkey from nation where n_nationkey > 11 intersect select n_nationkey from nation where n_nationkey > 12",
    "union_pushdown": "select k from (select n_nationkey as k from nation where n_nationkey < 11 union all select n_nationkey from nation where n_nationkey > 13) t where (k + 1) % 3 = 1",
    # CTEs and subqueries
    "cte_basic": "with big as (select * from orders where o_totalprice > 200000) select o_orderstatus, count(*) as n from big group by o_orderstatus",
    "cte_recursive": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t",
    "subquery_scalar_uncorrelated": "select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part)",
    "subquery_scalar_correlated": "select o_orderkey from orders o where o_totalprice > (select 1.5 * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "subquery_in_select": "select r_name, (select count(*) from nation where n_regionkey = r_regionkey) as n from region",
    "quantified_all": "select n_nationkey from nation where n_nationkey >= (select max(s_nationkey) from supplier)",
    # sorts and limits with a total order
    "sort_nulls_last": f"select k, s from {_V} order by k desc nulls last, s nulls last limit 4",
    "sort_topn": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "sort_offset": "select o_orderkey from orders order by o_orderkey limit 10 offset 95",
    # windows
    "win_row_number": "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders",
    "win_rank_dense": "select p_partkey, rank() over (partition by p_brand order by p_size) as r, dense_rank() over (partition by p_brand order by p_size) as d from part",
    "win_ntile": "select c_custkey, ntile(7) over (partition by c_nationkey order by c_custkey) as t from customer",
    "win_lag_lead": "select o_orderkey, lag(o_orderkey, 2) over w as a, lead(o_orderkey, 1, -1) over w as b from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "win_first_last": "select o_orderkey, first_value(o_orderkey) over w as f, last_value(o_orderkey) over w as l, nth_value(o_orderkey, 2) over w as n from orders window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following)",
    "win_running_sum_rows": "select o_orderkey, cast(sum(o_custkey) over (partition by o_orderpriority order by o_orderkey rows between 3 preceding and 1 following) as bigint) as s from orders",
    "win_range_frame": "select p_partkey, count(*) over (partition by p_brand order by p_size range between 2 preceding and 2 following) as n from part",
    "win_ignore_nulls": f"select k, s, last_value(k) ignore nulls over (order by coalesce(s, 'zz'), k nulls last rows between unbounded preceding and current row) as l from {_V}",
    "win_percent_cume": "select c_custkey, round(percent_rank() over w, 8) as p, round(cume_dist() over w, 8) as c from customer window w as (partition by c_mktsegment order by c_acctbal, c_custkey)",
    "win_over_aggregate": "select o_custkey, count(*) as n, rank() over (order by count(*) desc, o_custkey) as r from orders group by o_custkey",
    # functions
    "fn_string": "select p_partkey, upper(p_name) as u, length(p_name) as n, substr(p_name, 2, 3) as s, replace(p_name, 'a', '_') as r, reverse(p_name) as v, lpad(p_brand, 10, '*') as l, rpad(p_type, 9, '.') as rp, trim('  x ') as t, split_part(p_name, ' ', 2) as sp, concat(p_brand, '/', p_type) as c, p_brand || p_type as cc, levenshtein(p_name, p_type) as lev from part",
    "fn_math": "select p_partkey, abs(-p_size) as a, round(sqrt(p_size), 8) as q, round(power(p_size, 2), 4) as w, round(ln(p_size + 1), 8) as l, round(exp(p_size / 100.0e0), 8) as e, greatest(p_size, 10) as g, least(p_size, 10) as m, cast(sign(p_size - 10) as int) as s, round(degrees(radians(45.0e0)), 6) as d from part",
    "fn_date_parts": "select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, day(o_orderdate) as d, hour(o_orderdate) as h, dayofyear(o_orderdate) as doy, weekofyear(o_orderdate) as w from orders",
    # TPC-H shapes
    "tpch_q1": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, " + _REV + " as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp_ntz '1998-09-02' group by l_returnflag, l_linestatus",
    "tpch_q3": f"select l_orderkey, {_REV} as revenue, o_orderdate from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp_ntz '1998-03-15' and l_shipdate > timestamp_ntz '1998-03-15' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10",
    "tpch_q4": "select o_orderpriority, count(*) as n from orders where o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by o_orderpriority",
    "tpch_q5": f"select n_name, {_REV} as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name",
    "tpch_q6": "select round(sum(l_extendedprice * l_discount), 4) as revenue from lineitem where l_shipdate >= timestamp_ntz '1996-01-01' and l_shipdate < timestamp_ntz '1997-01-01' and l_discount between 0.05e0 and 0.07e0 and l_quantity < 24",
    "tpch_q7": f"select n1.n_name as supp, n2.n_name as cust, year(l_shipdate) as y, {_REV} as revenue from supplier, lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and ((n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1')) group by 1, 2, 3",
    "tpch_q8": "select year(o_orderdate) as y, round(sum(case when n2.n_name = 'NATION_2' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as share from part, supplier, lineitem, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey and p_type = 'ECONOMY' group by 1",
    "tpch_q9": "select n_name, year(o_orderdate) as y, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity / 10), 1) as profit from part, supplier, lineitem, orders, nation where s_suppkey = l_suppkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%ring%' group by 1, 2",
    "tpch_q10": f"select c_custkey, c_name, {_REV} as revenue, n_name from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= timestamp_ntz '1997-01-01' and o_orderdate < timestamp_ntz '1997-04-01' and l_returnflag = 'R' and c_nationkey = n_nationkey group by c_custkey, c_name, n_name order by revenue desc, c_custkey limit 20",
    "tpch_q12": "select l_returnflag, sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as high, count(*) as n from orders, lineitem where o_orderkey = l_orderkey and l_shipdate >= timestamp_ntz '1997-01-01' group by l_returnflag",
    "tpch_q13": "select n, count(*) as customers from (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus <> 'P' group by c_custkey) t group by n",
    "tpch_q14": "select round(100 * sum(case when p_type = 'PROMO' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp_ntz '1997-09-01' and l_shipdate < timestamp_ntz '1997-12-01'",
    "tpch_q17": "select round(sum(l_extendedprice) / 7, 2) as y from lineitem, part where p_partkey = l_partkey and p_brand = 'Brand#3' and l_quantity < (select 0.5e0 * avg(l_quantity) from lineitem where l_partkey = p_partkey)",
    "tpch_q18": "select c_custkey, o_orderkey, round(sum(l_quantity), 2) as q from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200) and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_custkey, o_orderkey",
    "tpch_q19": f"select {_REV} as revenue from lineitem, part where (p_partkey = l_partkey and p_brand = 'Brand#1' and l_quantity between 1 and 11 and p_size between 1 and 15) or (p_partkey = l_partkey and p_brand = 'Brand#2' and l_quantity between 10 and 20 and p_size between 1 and 30)",
    "tpch_q22": "select c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as b from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) group by c_nationkey",
    # joins with filters, repeated and pushed aggregates
    "join_left_on_filter": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' and c_acctbal > 5000",
    "agg_having_pushdown": "select o_custkey, count(*) as n from orders group by o_custkey having o_custkey < 100 and count(*) > 5",
    "agg_dedup": "select o_orderstatus as a, o_orderstatus as b, count(*) as n, count(*) as m from orders group by o_orderstatus, o_orderstatus",
    "agg_grouping_id": "select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) as bigint) as g, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "tpch_q15": f"with r as (select l_suppkey as k, {_REV} as revenue from lineitem where l_shipdate >= timestamp_ntz '1996-01-01' and l_shipdate < timestamp_ntz '1996-04-01' group by l_suppkey) select s_suppkey, s_name, revenue from supplier join r on s_suppkey = k where revenue = (select max(revenue) from r)",
    "tpch_q21": "select s_name, count(*) as n from supplier, lineitem l1, orders, nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_returnflag = 'R' and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R') and s_nationkey = n_nationkey and n_name = 'NATION_3' group by s_name",
    "tpch_q16": "select p_brand, p_size, count(distinct l_suppkey) as suppliers from (select distinct l_partkey, l_suppkey from lineitem) ps, part where p_partkey = l_partkey and p_brand <> 'Brand#4' and p_size in (3, 9, 14, 19) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_size",
}


def _presto(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        load_tables(configure(spark), sf_dir, text=text)
        return query(spark, text)

    return run


BUILT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def built(sql: str | None):
    def add(f):
        BUILT[f.__name__] = (f, sql)
        return f

    return add


_NEST = [(7, [1, 2, 2], {"a": 10, "b": 20}), (8, [3], {"c": 30}), (9, [], {}), (10, None, None), (10, [4, None], {"d": 1, "e": 2, "f": 3})]
_NEST_SQL = "(values (7, [1, 2, 2]), (8, [3]), (9, []::int[]), (10, null), (10, [4, null])) t(x, a)"


def nest(spark: SparkSession) -> Plan:
    return Plan.values(spark, _NEST, "x int, a array<int>, m map<string, int>")


@built("select n_regionkey, count(*) as n from nation where n_nationkey > 3 group by n_regionkey having count(*) > 2")
def builder_chain(spark, sf_dir):
    load_tables(spark, sf_dir, ["nation"])
    return Plan.scan(spark, "nation", ["n_nationkey", "n_regionkey"]).filter("n_nationkey > 3").aggregate(["n_regionkey"], ["count(*) as n"]).filter("n > 2").build()


@built("select n_nationkey from nation where n_nationkey between 7 and 9")
def limit_stacked(spark, sf_dir):
    load_tables(spark, sf_dir, ["nation"])
    return Plan.scan(spark, "nation", ["n_nationkey"]).sort("n_nationkey").limit(10).offset(7).limit(5).build()


@built("select n_nationkey from nation where n_nationkey >= 20")
def offset_only(spark, sf_dir):
    load_tables(spark, sf_dir, ["nation"])
    return Plan.scan(spark, "nation", ["n_nationkey"]).sort("n_nationkey").offset(20).build()


@built("select n_nationkey from nation where false")
def offset_huge(spark, sf_dir):
    load_tables(spark, sf_dir, ["nation"])
    return Plan.scan(spark, "nation", ["n_nationkey"]).sort("n_nationkey").offset(2**63 - 6).limit(100).build()


@built("select l_returnflag, l_linestatus, case when grouping(l_returnflag) = 0 and grouping(l_linestatus) = 0 then 0 when grouping(l_returnflag) = 0 then 1 else 2 end::bigint as set_index, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus))")
def grouping_set_index(spark, sf_dir):
    return Plan(table(spark, sf_dir, "lineitem")).grouping_sets([["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"]], ["count(*) as n"]).build()


@built("select r_regionkey, r_regionkey in (select n_regionkey from nation where n_nationkey > 22) as has from region")
def mark_join(spark, sf_dir):
    nation = Plan(table(spark, sf_dir, "nation")).filter("n_nationkey > 22")
    return Plan(table(spark, sf_dir, "region")).project("r_regionkey").mark_join(nation, "r_regionkey = n_regionkey", "has").build()


@built(f"select x, unnest(a) as y from {_NEST_SQL}")
def unnest_array(spark, sf_dir):
    return nest(spark).unnest("a", names=["y"]).project("x", "y").build()


@built("select * from (values (7, 'a', 10), (7, 'b', 20), (8, 'c', 30), (10, 'd', 1), (10, 'e', 2), (10, 'f', 3)) t(x, k, v)")
def unnest_map(spark, sf_dir):
    return nest(spark).unnest("m", names=["k", "v"]).project("x", "k", "v").build()


@built("select * from (values (7, 1, 'a', 10, 1::bigint), (7, 2, 'b', 20, 2), (7, 2, null, null, 3), (8, 3, 'c', 30, 1), (10, 4, 'd', 1, 1), (10, null, 'e', 2, 2), (10, null, 'f', 3, 3)) t(x, y, k, v, o)")
def unnest_zip_pad(spark, sf_dir):
    return nest(spark).unnest("a", "m", names=["y", "k", "v"], ordinality="o").project("x", "y", "k", "v", "o").build()


@built(f"select x, y from (select x, unnest(case when len(a) > 0 then a else [null] end) as y from {_NEST_SQL})")
def unnest_outer(spark, sf_dir):
    return nest(spark).unnest("a", names=["y"], outer=True).project("x", "y").build()


@built("select label, count(*) as n, round(sum(e), 3) as s from (select label, unnest(embedding)::double as e from embeddings where label < 5) where e > 0 group by label")
def unnest_filter_group(spark, sf_dir):
    return Plan(table(spark, sf_dir, "embeddings")).filter("label < 5").unnest("embedding", names=["e"]).filter("e > 0").aggregate(["label"], ["count(*) as n", "round(sum(cast(e as double)), 3) as s"]).build()


@built("select word, count(*) as n from (select unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) as word from benchmark) group by word having count(*) > 2")
def unnest_words(spark, sf_dir):
    return Plan(table(spark, sf_dir, "benchmark")).unnest("filter(split(text, ' '), w -> w <> '')", names=["word"]).aggregate(["word"], ["count(*) as n"]).filter("n > 2").build()


@built(f"select x, y, r_name from (select x, unnest(a) as y from {_NEST_SQL}) join region on y = r_regionkey")
def unnest_join_after(spark, sf_dir):
    return nest(spark).unnest("a", names=["y"]).join(Plan(table(spark, sf_dir, "region")), "y = r_regionkey").project("x", "y", "r_name").build()


@built("select vec_id, len(list_filter(embedding, lambda e: e > label / 10.0))::int as n, round(list_sum(list_transform(embedding, lambda e: e::double * 2)), 3) as s from embeddings")
def lambda_filter_capture(spark, sf_dir):
    return Plan(table(spark, sf_dir, "embeddings")).project("vec_id", "size(filter(embedding, e -> e > label / 10.0)) as n", "round(aggregate(transform(embedding, e -> cast(e as double) * 2), 0D, (a, b) -> a + b), 3) as s").build()


@built("select * from (values (7, 11, 10, null, 2), (8, null, null, 31, 1), (9, null, null, null, 0), (10, null, null, null, null), (10, null, null, null, 3)) t(x, a1, a0, c1, n)")
def map_access(spark, sf_dir):
    more = F.transform_values("m", lambda k, v: v + 1)
    row = presto.row_from_map(F.col("m"), ["a", "zz"], ["a0", "z0"])
    return nest(spark).project("x", more.alias("p"), row.alias("r"), "cardinality(m) as n").project("x", "try_element_at(p, 'a') as a1", "r.a0", "try_element_at(p, 'c') as c1", "n").build()


@built("select * from (values (7, 10, 0), (8, 0, 0), (9, 0, 0), (10, 0, 0), (10, 0, 0)) t(x, a0, z0)")
def padded_row_from_map(spark, sf_dir):
    return nest(spark).project("x", presto.row_from_map(F.col("m"), ["a", "zz"], ["a0", "z0"], F.lit(0)).alias("r")).project("x", "r.a0", "r.z0").build()


@built("select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_totalprice desc, o_orderkey) as keys from orders where o_custkey < 200 group by o_custkey")
def agg_array_ordered(spark, sf_dir):
    keys = presto.array_agg_ordered(F.col("o_orderkey"), (F.col("o_totalprice"), True), (F.col("o_orderkey"), False))
    return Plan(table(spark, sf_dir, "orders")).filter("o_custkey < 200").aggregate(["o_custkey"], [F.array_join(F.transform(keys, lambda x: x.cast("string")), ",").alias("keys")]).build()


@built("select p_partkey, count(*) over (partition by p_brand order by p_size groups between 1 preceding and 1 following) as n from part")
def win_groups_frame(spark, sf_dir):
    return groups_frame(table(spark, sf_dir, "part"), F.count("*"), "n", ["p_brand"], ["p_size"], -1, 1).select("p_partkey", "n")


@built("select event_id, isodow(ts)::int as dow, date_trunc('month', ts) as month, ts + interval 3 day as later, (props->>'$.k')::int as k, date_diff('day', date '2024-01-01', ts::date)::int as days from events")
def fn_date_json(spark, sf_dir):
    return Plan(table(spark, sf_dir, "events")).project("event_id", presto.day_of_week(F.col("ts")).alias("dow"), "cast(date_trunc('month', ts) as timestamp_ntz) as month", "ts + interval 3 days as later", "cast(get_json_object(props, '$.k') as int) as k", "datediff(cast(ts as date), date '2024-01-01') as days").build()


@built("select p_partkey, regexp_matches(p_name, '^s.*g$') as m, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) as second, regexp_replace(p_name, '[aeiou]', '', 'g') as cons from part")
def fn_regex(spark, sf_dir):
    return Plan(table(spark, sf_dir, "part")).project("p_partkey", "p_name rlike '^s.*g$' as m", "regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) as second", "regexp_replace(p_name, '[aeiou]', '') as cons").build()


@built("select x, list_contains(a, 2) as two, list_max(a) as mx, array_to_string(list_sort(list_distinct(a)), ',') as d, array_to_string(a[1:2], ',') as s from " + _NEST_SQL)
def fn_array(spark, sf_dir):
    text = lambda e: f"array_join(transform({e}, v -> cast(v as string)), ',')"
    return nest(spark).project("x", "coalesce(array_contains(a, 2), if(a is null, null, false)) as two", "array_max(a) as mx", text("filter(array_sort(array_distinct(a)), v -> v is not null)") + " as d", text("slice(a, 1, 2)") + " as s").build()


@built("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def event_tumbling(spark, sf_dir):
    from tessera.streaming.windows import tumbling

    rows = tumbling(table(spark, sf_dir, "events"), "1 day", ["event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@built(f"select x, y, z from (select x, y, unnest([y, x]) as z from (select x, unnest(a) as y from {_NEST_SQL})) where z is not null")
def unnest_chain(spark, sf_dir):
    return nest(spark).unnest("a", names=["y"]).unnest("array(y, x)", names=["z"]).filter("z is not null").project("x", "y", "z").build()


@built("select y, o from (values (1, 1::bigint), (2, 2), (3, 3)) t(y, o)")
def unnest_constant(spark, sf_dir):
    return Plan(spark.range(1)).unnest("sequence(1, 3)", names=["y"], ordinality="o").project("y", "o").build()


@built(f"select y, count(*) as n from (select x, unnest(a) as y from {_NEST_SQL} where x < 10) where y > 1 group by y")
def unnest_filter_before_after(spark, sf_dir):
    return nest(spark).filter("x < 10").unnest("a", names=["y"]).filter("y > 1").aggregate(["y"], ["count(*) as n"]).build()


@built("select vec_id, list_max(embedding)::double as s, len(list_filter(list_zip(embedding, embedding), lambda p: p[1] + p[2] > 0))::int as n from embeddings")
def lambda_reduce_zip_with(spark, sf_dir):
    return Plan(table(spark, sf_dir, "embeddings")).project("vec_id", "reduce(embedding, -1e9D, (a, e) -> greatest(a, cast(e as double))) as s", "size(filter(zip_with(embedding, embedding, (p, q) -> p + q), v -> v > 0)) as n").build()


@built("select p_partkey, p_size as x, p_name as y, 2 as n from part")
def map_from_arrays_row_access(spark, sf_dir):
    made = Plan(table(spark, sf_dir, "part")).project("p_partkey", "map_from_arrays(array('size', 'key'), array(p_size, 0)) as m", "named_struct('name', p_name) as r")
    return made.project("p_partkey", "element_at(m, 'size') as x", "r.name as y", "cardinality(m) as n").build()


@built("select o_orderkey, (o_orderdate + interval 1 month)::date as m, (o_orderdate + interval 1 year)::date as y, (o_orderdate - interval 90 day)::date as d from orders")
def fn_interval(spark, sf_dir):
    return Plan(table(spark, sf_dir, "orders")).project("o_orderkey", *[f"cast(o_orderdate {i} as date) as {c}" for i, c in (("+ interval 1 month", "m"), ("+ interval 1 year", "y"), ("- interval 90 days", "d"))]).build()


@built("select event_type, true as users, true as median from events group by event_type")
def agg_approx_distinct(spark, sf_dir):
    """Whether the estimates are near the exact values."""
    events = Plan(table(spark, sf_dir, "events"))
    near = "abs(approx_count_distinct(user_id) - count(distinct user_id)) <= 0.15 * count(distinct user_id) as users"
    return events.aggregate(["event_type"], [near, "abs(percentile_approx(value, 0.5) - percentile(value, 0.5)) <= 0.05 * (max(value) - min(value)) as median"]).build()


@built("select true as near, count(*) as whole from orders")
def tablesample(spark, sf_dir):
    """A tenth of the rows, give or take a third of it; 100 % is all."""
    orders = Plan(table(spark, sf_dir, "orders"))
    n, tenth = orders.aggregate([], ["count(*) as n"]), orders.sample(10).aggregate([], ["count(*) as k"])
    whole = orders.sample(100).aggregate([], ["count(*) as whole"])
    return n.cross_join(tenth).cross_join(whole).project("abs(k - n / 10) < n / 30 as near", "whole").build()


_STATS = "o_orderkey o_custkey o_orderstatus o_orderpriority".split()


@built(
    " union all ".join(
        f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as nulls, min({c})::varchar as min, max({c})::varchar as max, true as distinct_near, round(avg(length({c}::varchar)), 6) as mean_length, max(length({c}::varchar))::int as max_length from orders"
        for c in _STATS
    )
)
def statistics(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    exact = orders.agg(F.map_from_arrays(F.array(*map(F.lit, _STATS)), F.array(*[F.count_distinct(c) for c in _STATS])).alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")[F.col("column")]) <= F.col("exact")[F.col("column")] * 0.15
    return column_stats(orders, _STATS).crossJoin(exact).select("column", "rows", "nulls", "min", "max", near.alias("distinct_near"), F.round("mean_length", 6).alias("mean_length"), "max_length")


@built("select 'r_regionkey' as col_name, 'int' as data_type union all select 'r_name', 'string'")
def show_columns(spark, sf_dir):
    load_tables(spark, sf_dir, ["region"])
    return spark.sql("describe region").select("col_name", "data_type")



@built("select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, sum(o_custkey) over (partition by o_orderpriority order by o_orderkey rows between 2 preceding and current row)::bigint as s from orders")
def builder_window(spark, sf_dir):
    plan = Plan(table(spark, sf_dir, "orders")).window("row_number()", "rn", ["o_custkey"], ["o_totalprice desc", "o_orderkey"])
    return plan.window("sum(o_custkey)", "s", ["o_orderpriority"], ["o_orderkey"], ("rows", -2, 0)).project("o_orderkey", "rn", "s").build()


@built("select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part)")
def builder_scalar_subquery(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mean = Plan(part).aggregate([], ["avg(p_retailprice) as m"]).scalar()
    return Plan(part).filter(F.col("p_retailprice") > mean).project("p_partkey").build()


@built("select r_name from region where exists (select 1 from nation where n_regionkey = r_regionkey and n_nationkey > 22)")
def builder_exists(spark, sf_dir):
    nation = Plan(table(spark, sf_dir, "nation")).filter((F.col("n_regionkey") == F.col("r_regionkey").outer()) & (F.col("n_nationkey") > 22))
    return Plan(table(spark, sf_dir, "region")).filter(nation.exists()).project("r_name").build()


@built("select k, (k in (2, 3, null)) as has, (k in (2, 4)) as two from (values (1), (2), (null)) t(k)")
def builder_in_join(spark, sf_dir):
    rows = Plan.values(spark, [(1,), (2,), (None,)], "k int")
    withnull, plain = Plan.values(spark, [(2,), (3,), (None,)], "k int"), Plan.values(spark, [(2,), (4,)], "k int")
    return rows.in_join(withnull, "k", "k", "has").in_join(plain, "k", "k", "two").build()


@built("select n_nationkey, n_name, n_regionkey + 1 as up, length(n_name) as len from nation")
def builder_with(spark, sf_dir):
    return Plan(table(spark, sf_dir, "nation")).project("n_nationkey", "n_name", "n_regionkey").with_("n_regionkey + 1 as up", "length(n_name) as len").project("n_nationkey", "n_name", "up", "len").build()


@built("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_nationkey = b.n_regionkey and b.n_nationkey > 10")
def builder_as(spark, sf_dir):
    nation = Plan(table(spark, sf_dir, "nation"))
    return nation.as_("a").join(nation.as_("b"), "a.n_nationkey = b.n_regionkey and b.n_nationkey > 10").project("a.n_name as x", "b.n_name as y").build()


@built("select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_regionkey < 2")
def builder_from(spark, sf_dir):
    load_tables(spark, sf_dir, ["nation", "region"])
    return Plan.from_(spark, ["nation", "region"]).filter("n_regionkey = r_regionkey and r_regionkey < 2").project("n_name", "r_name").build()


@built("(select n_regionkey as k from nation where n_nationkey < 9 union select r_regionkey + 3 from region) except (select 4)")
def builder_set_operations(spark, sf_dir):
    a = Plan(table(spark, sf_dir, "nation")).filter("n_nationkey < 9").project("n_regionkey as k")
    b = Plan(table(spark, sf_dir, "region")).project("r_regionkey + 3 as k")
    return a.set_operation("union", b).set_operation("except", Plan.values(spark, [(4,)], "k int")).build()


@built("select * from (values (1, 10, 'p', 'p'), (2, 20, 'q', 'q')) t(id, x, y, z)")
def dereference_by_place(spark, sf_dir):
    df = Plan.values(spark, [(1, (10, "p")), (2, (20, "q"))], "id int, s struct<x: int, y: string>").build()
    return df.select("id", presto.dereference(df, "s", 0).alias("x"), presto.dereference(df, "s", 1).alias("y"), presto.dereference(df, "s", "y").alias("z"))


@built("select * from (values (1, 10, 'p'), (1, 11, 'q'), (2, 20, null)) t(id, x, y)")
def flatten_rows(spark, sf_dir):
    rows = [(1, [(10, "p"), (11, "q")]), (2, [(20, None)]), (3, []), (4, None)]
    return Plan.values(spark, rows, "id int, r array<struct<a: int, b: string>>").flatten_rows("r", ["x", "y"]).project("id", "x", "y").build()


@built("select * from (values (7, [1, 2], 0), (8, []::int[], 1)) t(x, a, n)")
def padded_row_of_collections(spark, sf_dir):
    df = Plan.values(spark, [(7, {"k": [1, 2]}, {}), (8, {"z": [3]}, {"m": {"q": 1}})], "x int, m map<string, array<int>>, o map<string, map<string, int>>").build()
    row = presto.row_from_map(F.col("m"), ["k"], ["a"], F.array().cast("array<int>"))
    inner = presto.row_from_map(F.col("o"), ["m"], ["i"], F.create_map().cast("map<string,int>"))
    return df.select("x", row["a"].alias("a"), F.size(inner["i"]).alias("n"))


@built("select o_orderstatus, o_orderpriority as p, count(*) as n from orders group by all")
def agg_histogram_two_steps(spark, sf_dir):
    maps = presto.histogram(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", "h")
    return Plan(maps).unnest("h", names=["p", "n"]).project("o_orderstatus", "p", "n").build()


@built("select * from (values ('F', 'c,b,a'), ('O', 'b,a')) t(g, v)")
def agg_array_distinct_filter(spark, sf_dir):
    rows = Plan.values(spark, [("F", "a", 1), ("F", "c", 3), ("F", "a", 1), ("F", "b", 2), ("F", "z", -1), ("O", "a", 1), ("O", "b", 5)], "g string, v string, k int")
    ordered = presto.array_agg_ordered(F.col("v"), (F.col("k"), True), distinct=True, where=F.col("k") > 0)
    return rows.aggregate(["g"], [F.array_join(ordered, ",").alias("v")]).build()


@built("select n_name, label from nation join (values (0, 'zero'), (3, 'three')) m(k, label) on n_regionkey = k")
def scan_several_connectors(spark, sf_dir):
    from tessera.session import Session
    from tessera.sources.connectors import FolderConnector, MemoryConnector
    from tessera.sources.tables import TableName

    session, memory = Session(spark), MemoryConnector(spark)
    session.add("folder", FolderConnector(spark, sf_dir))
    session.add("memory", memory)
    rows = spark.createDataFrame([(0, "zero"), (3, "three")], "k int, label string")
    memory.create(TableName.parse("m"), rows.schema)
    memory.append(TableName.parse("m"), rows)
    return session.sql("select n_name, label from folder.default.nation join memory.default.m on n_regionkey = k")


@built("select count(*) as n, min(r_name) as first from region")
def scan_tpch_connector(spark, sf_dir):
    from tessera.session import Session
    from tessera.sources.connectors import TpchConnector

    session = Session(spark)
    session.add("tpch", TpchConnector(spark, sf_dir.rsplit("/", 1)[0]))
    return session.sql('select count(*) as n, min(r_name) as first from tpch."sf0.001".region')


@built("select n_nationkey * 2 + 1 as a, upper(n_name) as b, n_nationkey + n_regionkey as c, length(n_name) as d from nation")
def user_functions(spark, sf_dir):
    from tessera.functions import registry

    registry.register_vectorized(spark, "genie_twice", lambda x: x * 2 + 1, "long")
    registry.register_simple(spark, "genie_sum", lambda *x: sum(x), "long")
    registry.register_rewrite("shout", "upper({0})")
    registry.register_rewrite("size_of", lambda a, types: f"length({a[0]})" if types and types[0].simpleString() == "string" else f"cardinality({a[0]})")
    load_tables(configure(spark), sf_dir, ["nation"])
    return query(spark, "select genie_twice(n_nationkey) as a, shout(n_name) as b, genie_sum(n_nationkey, n_regionkey) as c, size_of(n_name) as d from nation")


@built("select n_regionkey as k, max(n_nationkey) - min(n_nationkey) as spread from nation group by n_regionkey")
def user_aggregate(spark, sf_dir):
    from tessera.functions import registry

    registry.register_aggregate(spark, "spread", lambda x: int(x.max() - x.min()), "int")
    load_tables(configure(spark), sf_dir, ["nation"])
    return query(spark, "select n_regionkey as k, spread(n_nationkey) as spread from nation group by n_regionkey")


@built("select * from (values (1, 'a'), (2, 'b'), (2, 'b')) t(n, s)")
def user_table_function(spark, sf_dir):
    from tessera.functions import registry

    class Repeat:
        def eval(self, text: str):
            for n, s in enumerate(text, 1):
                for _ in range(n):
                    yield n, s

    registry.register_table_function(spark, "repeated", Repeat, "n int, s string")
    return query(spark, "select n, s from repeated('ab')")


@built("select * from (values ('n_nationkey', 'int', true), ('n_name', 'string', true), ('n_regionkey', 'int', true)) t(column_name, data_type, nullable)")
def show_columns_statement(spark, sf_dir):
    from tessera.session import Session
    from tessera.sources.connectors import FolderConnector

    session = Session(spark)
    session.add("folder", FolderConnector(spark, sf_dir))
    return session.sql("show columns from nation")


@built("select n_nationkey as k, case when n_nationkey = 3 then 'three' else n_name end as s from nation where n_nationkey between 2 and 8 union all select 99, null")
def write_insert_update_delete(spark, sf_dir):
    """A table made, added to, changed and thinned by statements; read whole, then dropped."""
    import uuid

    from tessera.session import Session
    from tessera.sources.connectors import FolderConnector

    session, name = Session(spark), f"t_{uuid.uuid4().hex}"
    session.add("folder", FolderConnector(spark, sf_dir))
    session.sql(f"create table {name} with (file_format = 'parquet') as select n_nationkey as k, n_name as s from nation where n_nationkey < 5")
    session.sql(f"insert into {name} select n_nationkey, n_name from nation where n_nationkey between 5 and 8")
    session.sql(f"insert into {name} (k) values (99)")
    session.sql(f"update {name} set s = 'three' where k = 3")
    session.sql(f"delete from {name} where k < 2")
    rows = [tuple(r) for r in spark.table(name).collect()]
    session.sql(f"drop table {name}")
    return spark.createDataFrame(rows, "k int, s string")


def _true(spark: SparkSession, **facts: bool) -> DataFrame:
    return spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} boolean" for k in facts))


@built("select count(*) as scanned, count(*) filter (where o_totalprice > 100000) as passed, count(distinct o_custkey) > 0 as some, min(o_orderkey)::varchar as lo from orders where o_totalprice > 100000 or o_totalprice <= 100000")
def sample_with_statistics(spark, sf_dir):
    """A sample of everything, so that its counts are exact."""
    from tessera.sources.statistics import sample_statistics

    orders = table(spark, sf_dir, "orders")
    scanned, passed, stats = sample_statistics(orders, "o_totalprice > 100000", ["o_custkey", "o_orderkey"], 100)
    some = stats.where("column = 'o_custkey'").first()["distinct"] > 0
    lo = orders.agg(F.min("o_orderkey").cast("string")).first()[0]
    return spark.createDataFrame([(scanned, passed, some, lo)], "scanned long, passed long, some boolean, lo string")


@built("select n_nationkey as k, n_name as s from nation where n_nationkey > 20")
def write_filtered(spark, sf_dir):
    from tessera.sources.connectors import MemoryConnector
    from tessera.sources.tables import TableName

    memory, name = MemoryConnector(spark), TableName("u")
    rows = Plan(table(spark, sf_dir, "nation")).filter("n_nationkey > 20").project("n_nationkey as k", "n_name as s").build()
    memory.create(name, rows.schema)
    memory.append(name, rows)
    return memory.table(name)


@built("select true as filters, true as merged, true as pruned")
def scan_pushdown(spark, sf_dir):
    """Filters of one column as a range, and the columns in use, reach the Parquet scan."""
    from tessera.operators.explain import plan_text

    load_tables(configure(spark), sf_dir, ["lineitem"])
    text = plan_text(query(spark, "select l_orderkey from lineitem where l_quantity > 2 and l_quantity < 10 and l_quantity >= 3"), "executable")
    return _true(spark, filters="PushedFilters: [" in text and "l_quantity" in text.split("PushedFilters")[1].split("ReadSchema")[0], merged="LessThan(l_quantity,10" in text, pruned="ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text)


@built("select 3 as expr, 'x' as expr_0, r_regionkey from region")
def output_names(spark, sf_dir):
    load_tables(configure(spark), sf_dir, ["region"])
    return query(spark, "select 1 + 2, 'x', r_regionkey from region")


@built("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)")
def join_right_semi(spark, sf_dir):
    """A semi join whose filtered side is the larger one and is hashed."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.hint("shuffle_hash").join(orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@built("select n_name, s_suppkey, true as hashed_left from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000")
def join_build_left(spark, sf_dir):
    """A left join that hashes its left side."""
    from tessera.operators.explain import plan_text

    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    joined = nation.hint("shuffle_hash").join(supplier, (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("s_acctbal") > 5000), "left")
    return joined.select("n_name", "s_suppkey", F.lit("BuildLeft" in plan_text(joined, "executable")).alias("hashed_left"))


@built("select * from (values (7, 10, 20), (8, null, null), (9, null, null), (10, null, null), (10, null, null)) t(x, ka, kb)")
def map_as_struct(spark, sf_dir):
    return presto.map_as_struct(nest(spark).build(), "m", ["a", "b"]).select("x", "m.ka", "m.kb")


@built("select n_nationkey as a, n_name as b from nation")
def exploding_function(spark, sf_dir):
    """Only the arguments that the fields in use hang on are computed."""
    from tessera.functions import registry

    made = registry.register_rewrite("genie", "named_struct('a', {0}, 'b', {1}, 'c', {2})", registry.Metadata(paths={"a": 0, "b": 1, "c": 2}, explode=True))
    load_tables(configure(spark), sf_dir, ["nation"])
    columns = registry.exploded("genie", made.metadata, ["n_nationkey", "n_name", "n_nationkey / 0"], ["a", "b"])
    return query(spark, f"select {', '.join(columns)} from nation")


@built("select true as logical, true as optimized, true as executable, true as cost, true as measured")
def explain_kinds(spark, sf_dir):
    from tessera.operators.explain import analyze, estimates, skeleton, summary

    load_tables(configure(spark), sf_dir, ["nation", "region"])
    df = query(spark, "select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name")
    return _true(
        spark, logical=skeleton(df).startswith("Aggregate"), optimized="Join: 1" in summary(df, "optimized"), executable="HashAggregate" in skeleton(df, "executable"),
        cost="Statistics(" in estimates(df), measured="numOutputRows=25" in analyze(df),
    )


@built("select count(*) as rows, 'finished' as state from orders")
def runner_batches(spark, sf_dir):
    from tessera.runner import Runner

    run = Runner(table(spark, sf_dir, "orders").select("o_orderkey"), batch=500)
    rows = run.wait()
    return spark.createDataFrame([(rows, run.state)], "rows long, state string")


@built("select n_nationkey, n_name, n_regionkey from nation")
def format_orc(spark, sf_dir):
    """A table written as ORC by the two-phase write and read back."""
    import uuid

    from tessera.sources.tables import create_table

    name = f"t_{uuid.uuid4().hex}"
    rows = [tuple(r) for r in create_table(spark, name, table(spark, sf_dir, "nation"), {"file_format": "orc"}).collect()]
    spark.sql(f"drop table {name}")
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int")


@built("select true as plan, true as rows, true as checked")
def golden_files(spark, sf_dir):
    """What --record keeps of a query is what --check finds again."""
    from tessera.cli import outcome
    from tessera.session import Session
    from tessera.sources.connectors import FolderConnector

    session = Session(spark)
    session.add("folder", FolderConnector(spark, sf_dir))
    text = "select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name"
    kept = outcome(session, text, 100)
    return _true(spark, plan=kept["plan"].startswith("Aggregate"), rows=len(kept["rows"]) == 5, checked=outcome(session, text, 100) == kept)


@built("select id, part, bucket from (values (1, 'a', 0), (2, 'a', 12), (3, 'b', null)) t(id, part, bucket)")
def read_partitions_and_buckets(spark, sf_dir):
    """A folder, in the warehouse, with partition folders, hidden files and bucket numbers in file names."""
    import uuid

    from tessera.sources.connectors import bucket_of
    from tessera.sources.tables import read_layout

    path = spark._jvm.org.apache.hadoop.fs.Path
    root = f"{spark.conf.get('spark.sql.warehouse.dir')}/layout-{uuid.uuid4().hex}"
    files = path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        for part, file, value in (("a", "000000_0.parquet", 1), ("a", "000012_0.parquet", 2), ("b", "data.parquet", 3), ("b", ".hidden.parquet", 4), ("b", "_skipped.parquet", 5)):
            made = f"{root}/made"
            spark.range(value, value + 1, 1, 1).selectExpr("cast(id as int) as id").write.mode("overwrite").parquet(made)
            files.mkdirs(path(f"{root}/part={part}"))
            files.rename(files.globStatus(path(f"{made}/part-*.parquet"))[0].getPath(), path(f"{root}/part={part}/{file}"))
            files.delete(path(made), True)
        rows = [tuple(r) for r in read_layout(spark, root).select("id", "part", bucket_of(F.input_file_name()).alias("bucket")).collect()]
    finally:
        files.delete(path(root), True)
    return spark.createDataFrame(rows, "id int, part string, bucket int")


#: Columns that are INTEGER in Spark and BIGINT (or wider) in DuckDB, by query: the SQL casts them.
WIDTHS = {
    "win_row_number": {"rn": "int"}, "win_rank_dense": {"r": "int", "d": "int"}, "win_ntile": {"t": "int"}, "win_over_aggregate": {"r": "int"}, "tpch_q12": {"high": "bigint"},
    "fn_date_parts": {c: "int" for c in ("y", "q", "m", "d", "h", "doy", "w")}, "tpch_q7": {"y": "int"}, "tpch_q8": {"y": "int"}, "tpch_q9": {"y": "int"},
}


def _oracle(name: str, text: str) -> str:
    text = text.replace("timestamp_ntz '", "timestamp '").replace(" div ", " // ").replace("(k) ignore nulls", "(k ignore nulls)")
    casts = ", ".join(f"{c}::{t} as {c}" for c, t in WIDTHS.get(name, {}).items())
    return f"select * replace ({casts}) from ({text})" if casts else text


QUERIES = {k: _presto(v.replace(" div ", " / ").replace("timestamp_ntz '", "timestamp '")) for k, v in SAME.items()} | {k: _presto(p) for k, (p, _) in FAMILIES.items()} | {k: f for k, (f, _) in BUILT.items()}
ORACLE = {k: _oracle(k, v) for k, v in SAME.items()} | {k: d for k, (_, d) in FAMILIES.items()} | {k: s for k, (_, s) in BUILT.items() if s}
