"""Queries of the record-store operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grading, reports, store
from ..functions import text as T
from ..sources.files import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("""
with f as (select o_orderkey, o_orderdate, o_totalprice from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1994-01-01')
select o_orderkey, o_orderdate, o_totalprice, (select count(*) from f) as total from f
order by o_orderdate desc nulls last, o_orderkey limit 25 offset 50
""")
def list_page(spark, d):
    orders = table(spark, d, "orders").where(store.all_of(F.col("o_orderstatus") == "F", None, F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp_ntz")))
    rows = orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return store.page(rows, "date", {"date": "o_orderdate", "price": "o_totalprice"}, "o_orderkey", limit=25, offset=50)


@query("""
select c_custkey, c_name, count(o_orderkey) as orders, count(o_orderkey) > 0 as has_orders
from customer left join orders on c_custkey = o_custkey group by c_custkey, c_name
""")
def list_with_counts(spark, d):
    return store.with_counts(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders"), "c_custkey", "o_custkey", "orders")


_SEARCH = """
with j as (
  select distinct s_suppkey, s_name, p_partkey, p_name, p_type
  from supplier {0} join lineitem on s_suppkey = l_suppkey {0} join part on l_partkey = p_partkey
), h as (
  select distinct s_suppkey, s_name, p_partkey,
    case when contains(lower(s_name), 'al') then 'Supplier Match' when contains(lower(p_name), 'al') then 'Part Match' else 'Content Match' end as reason,
    case when contains(lower(s_name), 'al') then s_name when contains(lower(p_name), 'al') then p_name
      else '...' || substring(coalesce(p_type, ''), greatest(0, strpos(lower(coalesce(p_type, '')), 'al') - 31) + 1,
        greatest(0, least(length(coalesce(p_type, '')), strpos(lower(coalesce(p_type, '')), 'al') + 31) - greatest(0, strpos(lower(coalesce(p_type, '')), 'al') - 31))) || '...' end as snippet
  from j where contains(lower(s_name), 'al') or contains(lower(p_name), 'al') or contains(lower(p_type), 'al')
), r as (select *, row_number() over (partition by s_suppkey, s_name order by p_partkey nulls first, reason, snippet) as rank from h)
select s_suppkey, s_name, rank, reason, snippet from r where rank <= 3
"""


def _search(spark, d, how):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name")
    joined = suppliers.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), how).join(parts, F.col("l_partkey") == F.col("p_partkey"), how)
    return store.search(joined, "al", ["s_suppkey", "s_name"], [("s_name", "Supplier Match"), ("p_name", "Part Match")], "p_type", ["p_partkey"])


@query(_SEARCH.format("inner"))
def search_jobs_inner(spark, d):
    return _search(spark, d, "inner")


@query(_SEARCH.format("left"))
def search_jobs_left(spark, d):
    return _search(spark, d, "left")


@query("""
select o_orderpriority, count(*) filter (where o_orderdate <= timestamp '1995-06-30') as until_bare,
  count(*) filter (where o_orderdate < timestamp '1995-06-30 23:59:59.999999') as until_day
from orders group by o_orderpriority
""")
def date_bounds(spark, d):
    bare, day = store.until("o_orderdate", "1995-06-30"), store.until("o_orderdate", "1995-06-30", whole_day=True)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(bare).alias("until_bare"), F.count_if(day).alias("until_day"))


@query("""
select o_custkey, o_orderkey, o_orderdate, o_totalprice from
  (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1
""")
def latest_per_key(spark, d):
    return store.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""
select n_name, s_name, row_number() over (partition by n_name order by s_name nulls first, s_suppkey nulls first) as place
from nation left join supplier on n_nationkey = s_nationkey
""")
def report_listing(spark, d):
    on = F.col("n_nationkey") == F.col("s_nationkey")
    return store.numbered_children(table(spark, d, "nation"), table(spark, d, "supplier"), on, ["n_name"], ["s_name", "s_suppkey"]).select("n_name", "s_name", "place")


@query("select event_type, count(*) as n from events group by event_type")
def status_counts(spark, d):
    return store.counted(table(spark, d, "events"), ["event_type"])


@query("""
select user_id, count(*) as total, count_if(event_type = 'purchase') as sent, count_if(event_type = 'error') as failed,
  count_if(event_type not in ('purchase', 'error')) as other from events group by user_id
""")
def log_partition(spark, d):
    kind = F.col("event_type")
    return store.partitioned_counts(table(spark, d, "events"), ["user_id"], sent=kind == "purchase", failed=kind == "error")


@query("""
select o_custkey as c_custkey, o_orderpriority, count(*) as n from orders
where o_custkey in (select c_custkey from customer where c_acctbal < 0) group by all
""")
def semi_anti(spark, d):
    """Orders of customers on the list (semi), by priority."""
    names = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    rows = store.listed(table(spark, d, "orders"), names, "o_custkey")
    return store.counted(rows.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey", "o_orderpriority"])


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def skip_anti(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return store.listed(table(spark, d, "customer"), urgent, "c_custkey", inside=False).select("c_custkey", "c_mktsegment")


@query("""
select o_orderkey, o_orderdate, o_orderdate < timestamp '1998-08-01' - interval 210 days as expired
from orders where o_orderstatus = 'F'
""")
def retention(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    old = store.older_than(orders, "o_orderdate", "1998-08-01 00:00:00")
    kept = orders.join(old.select("o_orderkey"), "o_orderkey", "left_anti")
    return old.withColumn("expired", F.lit(True)).unionByName(kept.withColumn("expired", F.lit(False)))


@query("""
with l as (select o_custkey, max(o_totalprice) as top from orders group by o_custkey)
select c_custkey, c_name, coalesce(l.top, c_acctbal) as c_acctbal, case when l.top is not null then 'PATCHED' else c_mktsegment end as c_mktsegment
from customer left join l on o_custkey = c_custkey
""")
def patch_update(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    top = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return store.patch(base, top.withColumn("c_name", F.lit(None).cast("string")).withColumn("c_mktsegment", F.lit("PATCHED")), "c_custkey")


@query("""
select p_partkey, p_brand, p_size from part where p_brand not in (select p_brand from part where p_size = 1)
union all select p_partkey, p_brand, 0 from part where p_size = 1
""")
def replace_by_key(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return store.replace_by_key(part, part.where("p_size = 1").withColumn("p_size", F.lit(0)), ["p_brand"])


@query("""
select user_id, string_agg(event_type, ',' order by event_type) as words
from (select distinct user_id, event_type from events union select distinct user_id, 'extra' from events) group by user_id
""")
def word_union(spark, d):
    words = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("w"))
    return words.select("user_id", F.array_join(store.merge_words(F.col("w"), F.array(F.lit("extra"))), ",").alias("words"))


@query("""
select event_id, case when event_id % 2 = 0 then 'new' else json_extract_string(props, '$.k') end as k, case when event_id % 2 = 1 then 'new' end as seen from events
""")
def map_merge(spark, d):
    """An entry set in each event's map: one that is there, or a further one."""
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    merged = F.when(F.col("event_id") % 2 == 0, store.set_entry(F.col("m"), "k", F.lit("new"))).otherwise(store.set_entry(F.col("m"), "seen", F.lit("new")))
    return rows.select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["seen"].alias("seen"))


@query("""
select o_orderkey, case o_orderstatus when 'O' then 'P' when 'P' then 'F' else o_orderstatus end as next_status from orders
""")
def status_advance(spark, d):
    return table(spark, d, "orders").select("o_orderkey", store.advance(F.col("o_orderstatus"), [("O", "P"), ("P", "F")]).alias("next_status"))


@query("""
select c_custkey, c_acctbal >= 0 and c_mktsegment = 'BUILDING' as changed, c_acctbal < 0 or c_mktsegment = 'BUILDING' as archived from customer
""")
def soft_delete(spark, d):
    customers = table(spark, d, "customer").withColumn("archived", F.col("c_acctbal") < 0)
    ids = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return store.archive(customers, ids, key="c_custkey").select("c_custkey", "changed", "archived")


@query("""
with c as (select c_custkey from customer where c_acctbal >= 0), o as (select o_orderkey from orders where o_custkey in (from c))
select 'customer' as store, c_custkey as id, count(*) as n from c group by all
union all select 'orders', o_orderkey, count(*) from o group by all
union all select 'lineitem', l_orderkey, count(*) from lineitem where l_orderkey in (from o) group by all
""")
def cascade_delete(spark, d):
    """Customers with a debt, their orders, and the lines of these."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = {"customer": table(spark, d, "customer").select("c_custkey", "c_acctbal"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"), "lineitem": table(spark, d, "lineitem").select("l_orderkey")}
    gone = tables["customer"].where("c_acctbal < 0").select("c_custkey")
    left = store.cascade(tables, {"customer": [("orders", "o_custkey")], "orders": [("lineitem", "l_orderkey")]}, "customer", "c_custkey", gone, keys)
    parts = [store.counted(left[name].select(F.lit(name).alias("store"), F.col(key).alias("id")), ["store", "id"]) for name, key in keys.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""
select doc_id, coalesce(nullif(cast(quality as varchar), '0'), nullif(cast(toxic as varchar), '0'), source) as label
from documents left join labels using (doc_id)
""")
def override_join(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    zero = lambda c: F.nullif(F.col(c).cast("string"), F.lit("0"))
    return joined.select("doc_id", T.first_filled(zero("quality"), zero("toxic"), "source").alias("label"))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def dedupe_ordered(spark, d):
    """Ordered distinct: first position of each text.  Texts meet by digest."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return store.first_seen(rows, ["h"], "doc_id").select("doc_id", "copies")


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def hist_map(spark, d):
    return store.counted(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""
select o_custkey, max_by(o_totalprice, o_orderkey) filter (where o_orderpriority = '1-URGENT') as urgent,
  max_by(o_totalprice, o_orderkey) filter (where o_orderpriority = '2-HIGH') as high,
  max_by(o_totalprice, o_orderkey) filter (where o_orderpriority = '5-LOW') as low from orders group by o_custkey
""")
def gradebook_pivot(spark, d):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    out = grading.pivot(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey", list(names))
    return out.select("o_custkey", *[F.col(k).alias(v) for k, v in names.items()])


@query("select c_custkey, coalesce(case when c_acctbal >= 0 then c_name end, cast(c_custkey as varchar)) as student_name from customer")
def identity_join(spark, d):
    customers = table(spark, d, "customer")
    keys = customers.select(F.col("c_custkey").cast("string").alias("k"), "c_custkey")
    names = customers.where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("student_name"))
    return reports.identify(keys, names, "k").select("c_custkey", "student_name")
