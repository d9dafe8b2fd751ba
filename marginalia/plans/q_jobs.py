"""Queries of jobs, replies and campaigns over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import grading, people, replies, reports, scrub, store
from ..sources.files import table
from .q_scoring import ORACLES as SCORING
from .q_scoring import QUERIES as SCORED

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("""
select n_nationkey, n_name, cast(count(c_custkey) as bigint) as customers, cast(coalesce(count_if(c_acctbal < 0), 0) as bigint) as debtors
from nation left join customer on c_nationkey = n_nationkey and n_nationkey > 3 group by all
""")
def counter_refresh(spark, d):
    """Counters of nations over their customers; some nations have none."""
    stale = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(-1).cast("long").alias("customers"), F.lit(None).cast("long").alias("debtors"))
    children = table(spark, d, "customer").where("c_nationkey > 3")
    return store.refreshed(stale, children, "n_nationkey", "c_nationkey", {"customers": F.lit(True), "debtors": F.col("c_acctbal") < 0})


@query("select c_custkey, cast(c_nationkey + coalesce(n, 0) as bigint) as opened from customer left join (select o_custkey, count(*) as n from orders group by all) on o_custkey = c_custkey")
def counter_increment(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("opened"))
    return store.incremented(base, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "opened")


@query("""
with w as (select distinct l_orderkey + (l_partkey % 2) * 100000000 as o_orderkey, case when l_linenumber = 1 then coalesce((select o_custkey from orders where o_orderkey = l_orderkey), 0) else l_suppkey end as o_custkey from lineitem)
select w.o_orderkey, w.o_custkey, case when o.o_orderkey is null then 'not found' when o.o_custkey = w.o_custkey then 'ok' else 'not owned' end as verdict from w left join orders o on o.o_orderkey = w.o_orderkey
""")
def ownership_check(spark, d):
    """Orders asked for under a customer: theirs, another's, or none."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    owner = F.when(F.col("l_linenumber") == 1, F.coalesce("o_custkey", F.lit(0).cast("long"))).otherwise(F.col("l_suppkey"))
    wanted = lines.select((F.col("l_orderkey") + (F.col("l_partkey") % 2) * 100000000).alias("o_orderkey"), owner.alias("o_custkey")).distinct()
    return store.owned(orders, "o_orderkey", "o_custkey", wanted)


@query("""
select c_custkey, case when c_acctbal < 0 then c_name when c_nationkey < 10 then upper(c_mktsegment) end as title, case when c_acctbal < 0 then 0 when c_nationkey < 10 then 1 end as found_in from customer
""")
def context_resolution(spark, d):
    """A customer's context: of the debtors' store, else of a region's."""
    customers = table(spark, d, "customer")
    first = customers.where("c_acctbal < 0").select("c_custkey", F.col("c_name").alias("title"))
    second = customers.where("c_nationkey < 10").select("c_custkey", F.upper("c_mktsegment").alias("title"))
    return store.resolved(customers.select("c_custkey"), [first, second], "c_custkey")


@query("""
select event_id, case when event_id % 5 <> 0 then printf('%04d-%02d-%02dT%02d:%02d:00Z', case when event_id % 7 = 0 then 2000 else year(ts) end, case when event_id % 11 = 0 then 1 else month(ts) end, day(ts),
  case when event_id % 3 = 0 then 23 else hour(ts) end, case when event_id % 3 = 0 then 59 else minute(ts) end) end as due from events
""")
def due_dates(spark, d):
    """Due dates of parts, some of which are missing."""
    n, but = F.col("event_id"), lambda c, k: F.when(n % k != 0, c).cast("int")
    due = F.when(n % 5 != 0, F.struct(but(F.year("ts"), 7).alias("year"), but(F.month("ts"), 11).alias("month"), F.dayofmonth("ts").cast("int").alias("day")))
    time = F.when(n % 3 != 0, F.struct(F.hour("ts").cast("int").alias("hours"), F.minute("ts").cast("int").alias("minutes")))
    rows = table(spark, d, "events").select("event_id", due.alias("due"), time.alias("time"))
    return rows.select("event_id", replies.due_time(F.col("due"), F.col("time")).alias("due"))


@query("""
select event_id, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) - interval 2 hours when 2 then cast(cast(ts as date) as timestamp) end as t,
  case event_id % 4 when 0 then hour(ts) when 1 then hour(ts) when 2 then 0 end as written_hour from events
""")
def iso_times(spark, d):
    """Times with ``Z``, with an offset, of a date alone, and unreadable."""
    n, at = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n == 0, F.concat(at, F.lit("Z"))).when(n == 1, F.concat(at, F.lit("+02:00"))).when(n == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.lit("at "), at))
    rows = table(spark, d, "events").select("event_id", text.alias("x"))
    moment = F.convert_timezone(F.current_timezone(), F.lit("UTC"), replies.parse_time(F.col("x")).cast("timestamp_ntz"))
    utc = F.when(F.col("x").rlike("T"), moment).otherwise(replies.wall_clock(F.col("x")))
    return rows.select("event_id", utc.alias("t"), F.hour(replies.wall_clock(F.col("x"))).cast("long").alias("written_hour"))


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'Given ' || o_orderkey else 'Your ' || case o_orderpriority when '1-URGENT' then 'Feedback Report' when '2-HIGH' then 'Feedback Report (PDF)' else 'Report' end
  || case when o_orderkey % 2 = 0 then ': Essay ' || o_custkey else '' end end as subject from orders
""")
def subject_lines(spark, d):
    orders = table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "student_html").when(F.col("o_orderpriority") == "2-HIGH", "student_pdf").otherwise("other")
    given = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Given "), F.col("o_orderkey"))).when(F.col("o_orderstatus") == "O", "")
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Essay "), F.col("o_custkey")))
    return orders.select("o_orderkey", people.subject(given, title, kind).alias("subject"))


@query("""
with o as (select distinct o_custkey from orders where o_orderstatus = 'F'), r as (select distinct o_custkey from orders)
select c_custkey, case when c_custkey in (from o) and c_nationkey < 12 then 'already_sent' when c_mktsegment = 'BUILDING' or c_nationkey = 3 then 'skipped'
  when c_acctbal < 0 then 'missing_email' when c_custkey not in (from r) then 'missing_report' else 'ready' end as class from customer
""")
def campaign_planned(spark, d):
    """A campaign with a list of whom to write to and one of whom not to."""
    customers = table(spark, d, "customer")
    names = customers.select("c_custkey", F.col("c_name").alias("name"))
    named = lambda df: df.select(F.col("c_name").alias("name"))
    orders = table(spark, d, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    only = customers.where("c_mktsegment <> 'BUILDING'").select(F.upper("c_name").alias("name"))
    return people.planned(names, named(orders.where("o_orderstatus = 'F' and c_nationkey < 12")), named(customers.where("c_acctbal >= 0")), named(orders), only, named(customers.where("c_nationkey = 3"))).select("c_custkey", "class")


@query("""
with gone as (select o_orderkey from orders where o_orderdate < timestamp '1996-01-01' - interval 210 days)
select 'orders' as store, o_orderkey, 1 as n from orders where o_orderkey not in (from gone)
union all select 'lineitem', l_orderkey, count(*) from lineitem where l_orderkey not in (from gone) group by all
""")
def purge_jobs(spark, d):
    """Orders past their retention go, and their lines with them."""
    tables = {"orders": table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "lineitem": table(spark, d, "lineitem").select("l_orderkey")}
    left, _ = store.purged(tables, {"orders": [("lineitem", "l_orderkey")]}, "orders", "o_orderkey", "o_orderdate", "1996-01-01 00:00:00")
    orders = store.counted(left["orders"].select(F.lit("orders").alias("store"), "o_orderkey"), ["store", "o_orderkey"])
    return orders.union(store.counted(left["lineitem"].select(F.lit("lineitem").alias("store"), "l_orderkey"), ["store", "l_orderkey"]))


@query(f"""
with s as ({SCORING["multi_select_score"]})
select count(*) as n, round(avg(cast(score as decimal(18,4))), 2) as mean_score, min(score) as min_score, max(score) as max_score from s
""")
def grade_job(spark, d):
    """A job's totals and their statistics."""
    return grading.score_stats(SCORED["multi_select_score"](spark, d).withColumn("score", F.col("score").cast("decimal(18,4)")), "score").select(
        "n", F.col("mean_score").cast("decimal(18,2)").cast("double").alias("mean_score"), F.col("min_score").cast("double").alias("min_score"), F.col("max_score").cast("double").alias("max_score")
    )


@query("""
select doc_id, 'quality' as name, case when quality = 1 then '1' else source end as score from documents left join labels using (doc_id)
union all select doc_id, 'tone', case when toxic = 1 then 'harsh' else lang end from documents left join labels using (doc_id)
""")
def teacher_override(spark, d):
    """Criteria of an evaluation in JSON, with a teacher's scores over them."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    one = lambda name, score: F.struct(F.lit(name).alias("name"), score.alias("score"))
    evaluation = F.to_json(F.struct(F.array(one("quality", F.col("source")), one("tone", F.col("lang"))).alias("criteria")))
    given = F.array(one("quality", F.col("quality").cast("string")), one("tone", F.when(F.col("toxic") == 1, "harsh").when(F.col("toxic") == 0, "")))
    essays = rows.select(F.lit("j").alias("job_id"), F.col("doc_id").alias("id"), evaluation.alias("evaluation"), F.to_json(F.struct(given.alias("criteria_overrides"))).alias("teacher_comments"))
    return grading.overridden(grading.criteria(essays), essays).select(F.col("id").alias("doc_id"), "name", "score")


@query("""
with f as (select l_orderkey as page, l_linenumber as number, cast(l_suppkey % 10 as varchar) as label, l_discount * 5 as score from lineitem),
g as (select page, number, max(struct_pack(score := score, label := label)) as top, count_if(score >= 0.35) as filled, max(case when score >= 0.35 then label end) as one, list_sort(list(score), 'DESC') as s from f group by all),
d as (select page, number, case when filled = 1 then one when s[1] < 0.08 then '?' when coalesce(s[2], 0) >= 0.6 * s[1] then '?' else top.label end as digit from g)
select page, case when bool_or(digit = '?') then 'ERROR' else string_agg(digit, '' order by number) end as student_id from d group by page
""")
def student_ids(spark, d):
    fills = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("number"), (F.col("l_suppkey") % 10).cast("string").alias("label"), (F.col("l_discount") * 5).alias("score"))
    return grading.decode_ids(fills)


@query(r"""
select c_custkey, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(lower(c_name || '-' || c_mktsegment || '_x'), '-_', '  '), '\s+'), lambda p: length(p) >= 2))) as parts from customer
""")
def name_parts(spark, d):
    name = F.concat(F.col("c_name"), F.lit("-"), F.col("c_mktsegment"), F.lit("_x"))
    return table(spark, d, "customer").select("c_custkey", F.array_sort(T.name_parts(name)).alias("parts"))


@query("select doc_id, case when length(trim(text, ' ')) > 180 then substring(trim(text, ' '), 1, 180) || '…' else trim(text, ' ') end as short from documents")
def truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate("text").alias("short"))


@query(r"select page_id, case when page_id % 2 = 0 then nullif(trim(regexp_extract(html, '<title>([^<\n]*)', 1), ' '), '') end as name from pages")
def continuation_headers(spark, d):
    title = F.regexp_extract("html", r"<title>([^<\n]*)", 1)
    text = F.concat(F.col("url"), F.lit("\n"), F.when(F.col("page_id") % 2 == 0, "Continue: ").otherwise("Goes on: "), title)
    return table(spark, d, "pages").select("page_id", T.continuation_name(text).alias("name"))


@query("""
select p_partkey, cast(floor(p_size * 0.5) as integer) as mcq, cast(floor(p_size * 0.3) as integer) as fib, cast(p_size - floor(p_size * 0.5) - floor(p_size * 0.3) as integer) as sa,
  cast(cast(round_even(p_size / 64.0 * 100, 0) as bigint) as varchar) || '%' as share from part
""")
def question_split(spark, d):
    split = S.default_split(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", *[split[t].cast("int").alias(t) for t in ("mcq", "fib", "sa")], S.percent_text(F.col("p_size") / 64.0).alias("share"))


@query("""
select event_id, case event_id % 5 when 0 then 1 when 1 then 1 when 2 then 2 when 3 then 1 else 0 end as n, case when event_id % 5 < 4 then json_extract_string(props, '$.k') end as k from events
""")
def reply_items(spark, d):
    """Objects of replies: an array, under either key, alone, or none."""
    p, n = F.col("props"), F.col("event_id") % 5
    text = (
        F.when(n == 0, F.concat(F.lit("Here: ["), p, F.lit("]")))
        .when(n == 1, F.concat(F.lit('{"criteria": ['), p, F.lit("]}")))
        .when(n == 2, F.concat(F.lit('```json\n{"criteria": [], "other": ['), p, F.lit(","), p, F.lit("]}\n```")))
        .when(n == 3, p)
        .otherwise(F.concat(F.lit('{"x": '), p, F.lit("}")))
    )
    rows = table(spark, d, "events").select("event_id", replies.items(text, ["criteria", "other"], "k").alias("i"))
    return rows.select("event_id", F.size("i").alias("n"), F.get_json_object(F.get("i", F.lit(0)), "$.k").alias("k"))


@query("""
select doc_id, case when doc_id % 4 = 0 then 0 else 1 end as n, case when doc_id % 4 > 0 then case when doc_id % 3 = 0 then 'evidence' else 'grammar' end end as category from documents
""")
def reply_highlights(spark, d):
    """Records of replies, of which some lack what they need."""
    n = F.col("doc_id")
    good = F.struct(F.lit("quote").alias("quote"), F.when(n % 3 == 0, "evidence").otherwise(F.col("lang")).alias("category"), F.when(n % 4 != 0, "better").alias("suggestion"))
    bad = F.struct(F.lit(" ").alias("quote"), F.lit("clarity").alias("category"), F.lit("x").alias("suggestion"))
    rows = table(spark, d, "documents").select("doc_id", replies.highlights(F.to_json(F.struct(F.array(good, bad).alias("highlights")))).alias("h"))
    return rows.select("doc_id", F.size("h").alias("n"), F.get("h", F.lit(0))["category"].alias("category"))


@query("select o_orderkey, o_orderdate, o_orderstatus as status from orders where o_custkey = 7 and o_orderstatus in ('F', 'O') union all select c_custkey, null, c_name from customer where c_custkey = 7")
def lookups(spark, d):
    """A customer by key, and their orders of some states."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderstatus").alias("status"), "o_totalprice")
    rows = store.without(store.children_of(orders, "o_custkey", 7, ["o_orderdate"], ["F", "O"]), ["o_totalprice", "o_custkey"])
    one = store.lookup(table(spark, d, "customer"), "c_custkey", 7)
    return rows.union(one.select("c_custkey", F.lit(None).cast("timestamp_ntz"), "c_name"))


@query("""
with q as (select p_brand, p_size, p_partkey as number, ['mcq', 'fib', 'sa', 'essay'][cast(p_size % 4 as integer) + 1] as t, case when p_size % 5 > 0 then cast(p_size as double) end as points from part)
select p_brand, case t when 'mcq' then 'Multiple Choice' when 'fib' then 'Fill in the Blank' else 'Short Answer' end as title, count(*) as n, min(number) as first, max(number) as last, sum(coalesce(points, 1)) as points from q where t <> 'essay' group by p_brand, t
""")
def test_sections(spark, d):
    """Sections of a brand's test, with their questions in order."""
    kinds = F.lit(["mcq", "fib", "sa", "essay"])
    questions = table(spark, d, "part").select(
        "p_brand",
        F.col("p_partkey").alias("question_number"),
        F.element_at(kinds, (F.col("p_size") % 4 + 1).cast("int")).alias("question_type"),
        F.col("p_name").alias("question_text"),
        F.lit(None).cast("array<struct<letter:string,text:string>>").alias("options"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("double")).alias("points"),
    )
    each = grading.sections(questions, "p_brand").select("p_brand", F.explode("sections").alias("s"))
    qs = F.col("s.questions")
    return each.select(
        "p_brand",
        F.col("s.title").alias("title"),
        F.size(qs).cast("long").alias("n"),
        F.get(qs, F.lit(0))["number"].alias("first"),
        F.element_at(qs, -1)["number"].alias("last"),
        F.aggregate(qs, F.lit(0.0), lambda n, q: n + q["points"]).alias("points"),
    )


test_sections.__test__ = False  # no test of pytest's


@query("select doc_id, replace(replace(text, 'the', '[STUDENT_NAME]'), '[STUDENT_NAME]', source) as text from documents")
def names_restored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("the"), F.lit(T.PLACEHOLDER)).alias("text"), "source")
    return docs.select("doc_id", scrub.restore(F.col("text"), F.col("source")).alias("text"))


@query("""
select o_orderkey, o_orderstatus in ('F', 'O') and o_orderstatus is not null as packaged from orders
""")
def report_packaging(spark, d):
    states = F.when(F.col("o_orderstatus") == "F", "GRADED").when(F.col("o_orderstatus") == "O", "APPROVED").otherwise("PENDING")
    ready, skipped = reports.packaged(table(spark, d, "orders").select("o_orderkey", states.alias("status")))
    return ready.select("o_orderkey", F.lit(True).alias("packaged")).union(skipped.select("o_orderkey", F.lit(False)))


@query("""
select c_custkey, c_acctbal < 0 and c_mktsegment = 'BUILDING' as changed, c_acctbal < 0 and c_mktsegment <> 'BUILDING' as archived from customer
""")
def restore_archived(spark, d):
    customers = table(spark, d, "customer").withColumn("archived", F.col("c_acctbal") < 0)
    return store.archive(customers, customers.where("c_mktsegment = 'BUILDING'").select("c_custkey"), to=False, key="c_custkey").select("c_custkey", "changed", "archived")


@query("select o_orderkey, case when o_orderpriority = '1-URGENT' then 'DONE' else o_orderstatus end as status, case when o_orderpriority = '1-URGENT' then timestamp '2024-01-01' else o_orderdate end as updated_at from orders")
def status_stamp(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"), "o_orderpriority")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return store.stamped(orders.drop("o_orderpriority"), urgent, "o_orderkey", "DONE", "2024-01-01 00:00:00")
