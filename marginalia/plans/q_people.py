"""Queries of the roster and campaign operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import people
from ..sources.files import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _roster(spark, d):
    """Suppliers as a roster; those with a negative balance have no e-mail."""
    return table(spark, d, "supplier").select(
        F.lower("s_name").alias("name_key"), F.col("s_name").alias("full_name"), F.when(F.col("s_acctbal") >= 0, F.concat("s_name", F.lit("@example.org"))).alias("email"), F.col("s_suppkey").alias("position")
    )


@query("""
with r as (select distinct lower(s_name) as k, s_name from supplier), c as (select c_custkey as doc_id, replace(c_name, 'Customer', 'Supplier') as name from customer)
select doc_id, name, case when k is not null then 'matched' else 'mismatched' end as status from c left join r on lower(name) = k
union all select null, s_name, 'missing' from r where k not in (select lower(name) from c)
""")
def roster_validate(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.regexp_replace("c_name", "Customer", "Supplier").alias("name"))
    return people.validate(names, _roster(spark, d))


@query("""
with r as (select p_name as full_name, p_partkey as position, row_number() over (partition by p_name order by p_partkey) as i from part),
n as (select distinct p_name as name from part),
p as (select name, full_name from n, (select distinct full_name from r) where contains(lower(trim(name)), lower(trim(full_name))) or contains(lower(trim(full_name)), lower(trim(name)))),
k as (select name, full_name, row_number() over (partition by name order by position) as rank from p join r using (full_name) where i <= 5)
select name, full_name, rank from k where rank <= 5
""")
def containment_suggest(spark, d):
    """All part names against the whole table as roster."""
    part = table(spark, d, "part")
    roster = part.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("full_name"))
    return people.suggest(part.select(F.col("p_name").alias("name")), roster)


@query()
def fuzzy_match(spark, d):
    """Supplier names with their last but one digit gone, against the roster."""
    names = table(spark, d, "supplier").select(F.regexp_replace("s_name", r"\d(\d)$", "$1").alias("name"))
    return people.fuzzy_match(names, _roster(spark, d)).select("name", "full_name", F.round("score", 6).alias("score"))


@query("""
select c_custkey, c_name as name, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT') then 'already_sent'
  when c_acctbal < 0 then 'missing_email' when c_custkey not in (select o_custkey from orders where o_orderpriority = '5-LOW') then 'missing_report' else 'ready' end as class from customer
""")
def campaign_preview(spark, d):
    customers = table(spark, d, "customer")
    names = customers.select("c_custkey", F.col("c_name").alias("name"))
    orders = table(spark, d, "orders").join(names.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    sent = orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return people.campaign(names, sent, customers.where("c_acctbal >= 0").select(F.col("c_name").alias("name")), orders.where("o_orderpriority = '5-LOW'"))


@query("""
select c_custkey, c_name as name, case when c_nationkey > 20 then 'Student name not found in roster (possible OCR error or typo)' when c_acctbal < 0 then 'Student found in roster but has no email address'
  when c_custkey not in (select o_custkey from orders) then 'PDF not generated for this student' else 'ready' end as reason from customer where c_mktsegment <> 'BUILDING'
""")
def email_triage(spark, d):
    customers = table(spark, d, "customer")
    names = customers.select("c_custkey", F.col("c_name").alias("name"))
    roster = customers.where("c_nationkey <= 20").select(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, "x@example.org").alias("email"))
    reports = table(spark, d, "orders").join(names.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return people.triage(names, customers.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("name")), roster, reports)


@query("""
select o_orderpriority as job_id, 'html' as report_type, cast(o_custkey as varchar) as student_name, count_if(o_orderstatus = 'O') as failed from orders group by all
having count_if(o_orderstatus = 'O') > 0 and count_if(o_orderstatus = 'F') = 0
""")
def retry_failed(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "SENT").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("SKIPPED")
    log = table(spark, d, "orders").select(F.col("o_orderpriority").alias("job_id"), F.lit("html").alias("report_type"), F.col("o_custkey").cast("string").alias("student_name"), status.alias("status"))
    return people.retry(log)
