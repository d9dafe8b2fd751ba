"""Queries of the text operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knowledge, scrub
from ..sources.files import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(r"""
with b as (select regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') as w from benchmark),
d as (select distinct unnest(w) as w from b),
pairs as (select string_agg(distinct chr(2) || w[1] || chr(3) || ' ' || chr(2) || w[2] || chr(3) || '|' || chr(2) || w[3] || chr(3) || '-' || chr(2) || w[4] || chr(3), '|') as p from b where len(w) >= 4),
m as (select doc_id, regexp_replace(regexp_replace(text, '([\p{L}\p{M}\p{N}_]+)', chr(2) || '\1' || chr(3), 'g'), '(?i)(?:' || (select p from pairs) || ')', chr(4), 'g') as t from documents),
t as (select doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+')) as tok,
  generate_subscripts(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+'), 1) as i from m)
select doc_id, replace(replace(replace(string_agg(case when lower(tok) in (select w from d) then '[STUDENT_NAME]' else tok end, '' order by i), chr(2), ''), chr(3), ''), chr(4), '[STUDENT_NAME]') as scrubbed from t group by doc_id
""")
def scrub_documents(spark, d):
    """Names: all words of ``benchmark``, and of each of its texts the first
    two with a blank and the next two with a hyphen between them."""
    words = table(spark, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0)).alias("w"))
    pairs = words.where(F.size("w") >= 4).select(F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws("-", F.col("w")[2], F.col("w")[3]))).alias("name"))
    return scrub.scrub(table(spark, d, "documents").select("doc_id", "text"), words.select(F.explode("w").alias("name")).union(pairs)).select("doc_id", "scrubbed")


@query(r"""
with m as (select doc_id, regexp_replace(regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+', '[REDACTED]', 'g'),
  '([\p{L}\p{M}\p{N}_]+)', chr(2) || '\1' || chr(3), 'g') as t from documents)
select doc_id, replace(replace(regexp_replace(t, chr(2) || '[A-Z][a-z]+' || chr(3) || ' ' || chr(2) || '[A-Z][a-z]+' || chr(3), '[REDACTED]', 'g'), chr(2), ''), chr(3), '') as redacted from m
""")
def redact_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact_pii("text").alias("redacted"))


@query(r"""
select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r\x0B]+'), lambda x: x <> '')) as bigint) as n_words, cast(len(string_split(text, chr(10))) as bigint) as n_lines,
  case when length(text) > 300 then substring(text, 1, 300) || '...' else text end as preview from documents
""")
def manifest(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("n_words"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), T.preview("text").alias("preview"))


@query(r"select doc_id, lower(trim(regexp_replace(text, '[ \t\n\f\r\x0B]+', ' ', 'g'))) as normal from documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normal_name("text").alias("normal"))


@query(r"""
with a as (select doc_id, regexp_replace(text, '([ \t\n\f\r\x0B]*\n){3,}', chr(10) || chr(10), 'g') as t from documents),
b as (select doc_id, regexp_replace(t, '\n\n+', chr(1), 'g') as marked, regexp_extract_all(t, '\n\n+') as gaps from a)
select doc_id, trim(regexp_replace(replace(replace(marked, chr(10), ' '), chr(1), chr(10) || chr(10)), ' {2,}', ' ', 'g'), ' ' || chr(10)) as normal from b
""")
def normalize_pdf(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normal_pdf_text("text").alias("normal"))


@query(r"""
with p as (select page_id, 'Name: ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || url as t from pages)
select page_id, nullif(trim(regexp_replace(regexp_extract(t, '^[ \t\n\f\r\x0B]*(?:[Nn][Aa][Mm][Ee]|[Ii][Dd])[ \t\n\f\r\x0B]*[:\-][ \t\n\f\r\x0B]*(\p{L}[\p{L}''-]*(?:[ \t\n\f\r\x0B]+\p{L}[\p{L}''-]*)?)', 1), '[ \t\n\f\r\x0B]+', ' ', 'g')), '') as name from p
""")
def detect_headers(spark, d):
    text = F.concat(F.lit("Name: "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("\n"), F.col("url"))
    return table(spark, d, "pages").select("page_id", T.header_name(text).alias("name"))


@query("""
select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html from documents
""")
def html_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_html("text").alias("html"))


@query(r"""
select doc_id, list_aggregate(list_transform(string_split(text, ''), lambda c: case c when '\' then '\textbackslash{}' when '{' then '\{' when '}' then '\}'
  when '&' then '\&' when '%' then '\%' when '$' then '\$' when '#' then '\#' when '_' then '\_' when '~' then '\textasciitilde{}' when '^' then '\textasciicircum{}' else c end), 'string_agg', '') as tex
from documents
""")
def latex_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_latex("text").alias("tex"))


@query(r"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r\x0B]+'), lambda x: x <> '') as w from documents),
c as (select doc_id, w, unnest(range(0, cast(greatest(0, ceil((len(w) - 512) / 462.0)) as bigint) + 1)) as chunk from w where len(w) > 0)
select doc_id, chunk, cast(len(w[chunk * 462 + 1 : chunk * 462 + 512]) as bigint) as n_words, array_to_string(w[chunk * 462 + 1 : chunk * 462 + 512], ' ') as chunk_text from c
""")
def chunk_documents(spark, d):
    return knowledge.chunks(table(spark, d, "documents"))


@query("""
with q as (select vec_id as query_id, embedding as query from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, list_cosine_similarity(cast(query as double[]), cast(embedding as double[])) as sim from q, embeddings),
r as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s)
select query_id, vec_id, rank, round(sim, 6) as similarity from r where rank <= 5
""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return knowledge.top_k(queries, e, 5).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_extract(spark, d):
    """A fenced reply around each event's JSON, read back leniently."""
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", F.try_variant_get(T.lenient_json(fenced), "$.k", "string").alias("k"))


@query(r"""
select doc_id, '...' || substring(text, greatest(0, strpos(lower(text), 'tion') - 31) + 1,
  greatest(0, least(length(text), strpos(lower(text), 'tion') + 33) - greatest(0, strpos(lower(text), 'tion') - 31))) || '...' as snippet
from documents where contains(lower(text), 'tion')
""")
def content_snippets(spark, d):
    docs = table(spark, d, "documents").where(T.holds("text", "tion"))
    return docs.select("doc_id", T.snippet("text", "tion").alias("snippet"))


@query(r"select page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') as safe from pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name("url").alias("safe"))
