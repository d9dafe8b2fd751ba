"""Queries of the grading operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import grading
from ..sources.files import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_KEY = [("1", "a", 1.0), ("2", "r,o", 1.0), ("3", "n,o", 2.0), ("4", "n", 1.0), ("5", "a,f,r", 3.0), ("6", "o", 1.0), ("7", "n,f", 1.0)]


@query("""
with k(q, correct, points) as (values (1, ['a'], 1.0), (2, ['r','o'], 1.0), (3, ['n','o'], 2.0), (4, ['n'], 1.0), (5, ['a','f','r'], 3.0), (6, ['o'], 1.0), (7, ['n','f'], 1.0)),
a as (select l_orderkey, l_linenumber, list_distinct(list(lower(x))) as sel from (select l_orderkey, l_linenumber, unnest([l_returnflag, l_linestatus]) as x from lineitem) group by all),
e as (select o.l_orderkey, k.q, k.correct, k.points, coalesce(a.sel, []) as sel from (select distinct l_orderkey from lineitem) o cross join k left join a on a.l_orderkey = o.l_orderkey and a.l_linenumber = k.q),
s as (select *, case when len(correct) > 1 then round(greatest(0, (len(list_intersect(sel, correct)) - (len(sel) - len(list_intersect(sel, correct)))) * (cast(points as double) / len(correct))) + 1e-12, 2)
  when len(sel) = 1 and sel[1] = correct[1] then cast(points as double) else 0.0 end as score from e)
select l_orderkey as response_id, round(sum(score), 2) as score, round(round(sum(score), 2) / 10.0 * 100, 2) as percent from s group by l_orderkey
""")
def multi_select_score(spark, d):
    # one exchange serves the lines of an order and the order
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    lines = lines.select("l_orderkey", "l_linenumber", F.explode(F.array("l_returnflag", "l_linestatus")).alias("x"))
    marked = lines.groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("answer"))
    responses = marked.select(F.lit("j").alias("job_id"), F.col("l_orderkey").alias("response_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("Q0"), F.col("l_linenumber").cast("string")).alias("question"), "answer")
    values = ", ".join(f"('j', '{q}', '{a}', {p}D)" for q, a, p in _KEY)
    key = spark.sql(f"select * from values {values} as t(job_id, question, answer, points)")
    return grading.score_responses(responses, key).select("response_id", "score", "percent")


@query("""
with f as (select l_orderkey as page, l_linenumber as number, max(l_discount * 5) as a, max(l_tax * 5) as b, max(l_quantity / 100) as c, 0.0 as d from lineitem group by all),
u as (select page, number, unnest([struct_pack(label := 'a', score := a), struct_pack(label := 'b', score := b), struct_pack(label := 'c', score := c), struct_pack(label := 'd', score := cast(d as double))]) as o from f),
m as (select page, number, max(o.score) as best, count(*) filter (where o.score >= 0.35) as filled from u group by all)
select page, number, case when filled > 0 then string_agg(case when o.score >= 0.35 then o.label end, ',' order by o.label)
  when best < 0.08 then '' else coalesce(string_agg(case when o.score >= greatest(0.175, best * 0.6) then o.label end, ',' order by o.label), '') end as answer,
  case when filled > 0 then null when best < 0.08 then 'blank' else 'faint' end as warning
from u join m using (page, number) group by page, number, best, filled
""")
def bubble_decode(spark, d):
    best = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("number")).agg(
        F.max(F.col("l_discount") * 5).alias("a"), F.max(F.col("l_tax") * 5).alias("b"), F.max(F.col("l_quantity") / 100).alias("c"), F.lit(0.0).alias("d")
    )
    fills = best.unpivot(["page", "number"], ["a", "b", "c", "d"], "label", "score")
    return grading.decode_answers(fills)


@query("""
select o_orderpriority, count(o_totalprice) as n, round(avg(cast(o_totalprice as decimal(18,2))), 2) as mean_score,
  round(min(o_totalprice), 2) as min_score, round(max(o_totalprice), 2) as max_score from orders group by o_orderpriority
""")
def score_stats(spark, d):
    return grading.score_stats(table(spark, d, "orders"), "o_totalprice", by=["o_orderpriority"])


@query("""
with g as (select o_custkey, case when o_orderkey % 3 = 0 then o_orderpriority else cast(cast(floor(o_totalprice) as bigint) % 100 as varchar) || '/100' end as grade,
  case when o_orderstatus = 'F' then 'GRADED' else 'PENDING' end as status from orders),
v as (select *, case when status = 'GRADED' and regexp_full_match(string_split(grade, '/')[1], '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') then cast(string_split(grade, '/')[1] as double) end as x from g)
select o_custkey, count(*) as total, count_if(status = 'GRADED') as graded, count_if(status <> 'GRADED') as pending, count(x) as numeric, round(avg(x), 6) as mean_grade, min(x) as min_grade, max(x) as max_grade
from v group by o_custkey
""".replace("\\\\", "\\"))
def grade_stats(spark, d):
    number = F.concat((F.floor("o_totalprice") % 100).cast("string"), F.lit("/100"))
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(number).alias("grade"), F.when(F.col("o_orderstatus") == "F", "GRADED").otherwise("PENDING").alias("status"))
    return grading.grade_stats(rows, "grade", "status", ["o_custkey"]).withColumn("mean_grade", F.round("mean_grade", 6))


@query("""
select event_type, count(*) as n, round(avg(try_cast(json_extract_string(props, '$.k') as double)), 6) as mean_score,
  min(try_cast(json_extract_string(props, '$.k') as double)) as min_score, max(try_cast(json_extract_string(props, '$.k') as double)) as max_score
from events group by event_type having avg(try_cast(json_extract_string(props, '$.k') as double)) is not null
""")
def criteria_breakdown(spark, d):
    rows = table(spark, d, "events").select(F.lit("j").alias("job_id"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("score"))
    return grading.criteria_stats(rows).select(F.col("name").alias("event_type"), "n", F.round("mean_score", 6).alias("mean_score"), "min_score", "max_score")


@query("""
with c as (select p_type, count(*) filter (where p_size % 3 = 0) as mcq, count(*) filter (where p_size % 3 = 1) as fib, count(*) filter (where p_size % 3 = 2) as sa from part group by p_type),
w as (select *, mcq * 1.0e0 + fib * 1.5e0 + sa * 5.0e0 as weight from c)
select p_type, case when mcq > 0 then round_even(mcq * 1.0e0 / weight * 100 / mcq * 2, 0) / 2 else 0 end as mcq_points,
  case when fib > 0 then round_even(fib * 1.5e0 / weight * 100 / fib * 2, 0) / 2 else 0 end as fib_points,
  case when sa > 0 then round_even(sa * 5.0e0 / weight * 100 / sa * 2, 0) / 2 else 0 end as sa_points from w
""")
def point_allocation(spark, d):
    kind = F.col("p_size") % 3
    counts = table(spark, d, "part").groupBy("p_type").agg(*[F.count_if(kind == i).alias(t) for i, t in enumerate(S.WEIGHTS)])
    points = S.points_per_question({t: F.col(t) for t in S.WEIGHTS}, F.lit(100.0))
    return counts.select("p_type", *[c.alias(f"{t}_points") for t, c in points.items()])


@query("""
with q as (select p_brand, p_size % 3 as type, p_retailprice from part),
x as (select p_brand, t.type, 25 as expected from (select distinct p_brand from part), (values (0), (1), (2)) t(type)),
h as (select p_brand, type, count(*) as actual from q group by all),
c as (select p_brand, least(100, count(*) filter (where p_retailprice > 1200) * 1e0 / greatest(1, count(*)) * 100) as coverage from q group by p_brand)
select p_brand, cast(type as integer) as type, cast(25 as bigint) as expected, coalesce(actual, 0) as actual, greatest(0, 25 - coalesce(actual, 0)) as missing, round(coverage, 6) as coverage
from x left join h using (p_brand, type) left join c using (p_brand)
""")
def coverage(spark, d):
    part = table(spark, d, "part").select("p_brand", (F.col("p_size") % 3).cast("int").alias("type"), F.when(F.col("p_retailprice") > 1200, "source").alias("source_reference"))
    expected = part.select("p_brand").distinct().select("p_brand", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("type"), F.lit(25).cast("long").alias("expected"))
    return grading.coverage(part, expected, "p_brand").withColumn("coverage", F.round("coverage", 6))


@query("""
select p_brand, p_partkey, cast(row_number() over (partition by p_brand order by p_size % 3, p_partkey) as integer) as question_number from part
""")
def question_numbers(spark, d):
    kinds = F.element_at(F.lit(list(S.WEIGHTS)), F.col("p_size") % 3 + 1)
    rows = table(spark, d, "part").select("p_brand", "p_partkey", kinds.alias("question_type"), F.col("p_partkey").alias("position"))
    return grading.numbered(rows, "p_brand").select("p_brand", "p_partkey", "question_number")


@query("""
select p_brand, string_agg(p_name, '|' order by p_name) as words from (select distinct p_brand, p_name from part where p_size % 3 = 1) group by p_brand
""")
def word_bank(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") % 3 == 1, "fib").otherwise("mcq").alias("question_type"), F.col("p_name").alias("correct_answer"))
    return grading.word_bank(rows, "p_brand").select("p_brand", F.array_join(F.array_sort("words"), "|").alias("words"))


@query("""
select p_brand, string_agg(cast(p_partkey as varchar) || '. ' || p_name || ' (' || cast(p_size as varchar) || ')', chr(10) order by p_partkey) as text, sum(p_size) as total_points from part group by p_brand
""")
def answer_key_text(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("question_number"), F.col("p_name").alias("correct_answer"), F.lit(None).cast("string").alias("model_answer"), F.col("p_size").cast("long").alias("points"))
    return grading.answer_key_text(rows, "p_brand")
