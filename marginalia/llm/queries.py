"""Registered queries of this subpackage: one per operator, with production
parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bwtdedup, exactdedup, htmltext, imatch, langid, orderhash, packing, pieces, sharding, urlrules
from .common import read


def tokenizer_file(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_histogram_shards(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_residual_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut, places = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), 2048, 0)
    digests = cut.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(places, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_host_suffix_text(spark, sf_dir):
    out = htmltext.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_merged_transforms(spark, sf_dir):
    out = bwtdedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_order_minhash(spark, sf_dir):
    return orderhash.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_cross_parsing(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_piece_rounds(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdedup.dedup_table(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
with n as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over w as keep_id, cast(count(*) over w as bigint) as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from n window w as (partition by text_sha256)
"""


def op7_imatch(spark, sf_dir):
    return imatch.edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_rules(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urlrules.judge_urls(pages, urlrules.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def _attribute_sql(name):
    found = rf"""'(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'"""
    value = " || ".join(f"regexp_extract(tag, {found}, {i})" for i in (1, 2, 3))
    return rf"""trim(array_to_string(list_transform(regexp_extract_all({value}, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z]+);|&|[^&]+'), lambda p:
      case p when '&amp;' then '&' when '&lt;' then '<' when '&gt;' then '>' when '&quot;' then '"' when '&apos;' then '''' else
        case when coalesce(code_of(p), 0) between 1 and 55295 or coalesce(code_of(p), 0) between 57344 and 1114111 then chr(code_of(p)) else p end end), ''))""".replace(
        "code_of(p)", "case when regexp_matches(p, '^&#[0-9]') then try_cast(regexp_extract(p, '([0-9]+)', 1) as int) when regexp_matches(p, '^&#[xX]') then try_cast('0x' || regexp_extract(p, '^&#.([0-9a-fA-F]+)', 1) as int) end"
    )


def _walked_sql(path):
    steps = f"string_split({path}, '/')[2:]"
    walked = f"list_reduce(list_prepend('', {steps}), lambda q, s: case s when '.' then q when '..' then regexp_replace(q, '/[^/]*$', '') else q || '/' || s end)"
    return f"(case when {path} = '' then '' else {walked} || case when regexp_matches({path}, '/\\.\\.?$') then '/' else '' end end)"


def _absolute_sql(url, target):
    base, path = f"regexp_extract({url}, '^([^/?#]*://[^/?#]*)', 1)", f"regexp_extract({url}, '://[^/?#]*([^?#]*)', 1)"
    own, rest = f"regexp_extract({target}, '^([^?#]*)', 1)", f"regexp_extract({target}, '^[^?#]*(.*)$', 1)"
    folder = f"coalesce(nullif(regexp_replace({path}, '[^/]*$', ''), ''), '/')"
    return rf"""case when regexp_matches({target}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://')
      then regexp_extract({target}, '^([^/?#]*://[^/?#]*)', 1) || {_walked_sql(f"regexp_extract({target}, '://[^/?#]*([^?#]*)', 1)")} || regexp_extract({target}, '://[^?#]*(.*)$', 1)
      when regexp_matches({target}, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') then null
      when starts_with({target}, '//') then regexp_extract({url}, '^([^/?#]*):', 1) || ':' || regexp_extract({target}, '^(//[^/?#]*)', 1) || {_walked_sql(f"regexp_extract({target}, '^//[^/?#]*([^?#]*)', 1)")} || {rest}
      when starts_with({target}, '/') then {base} || {_walked_sql(own)} || {rest}
      when starts_with({target}, '?') then {base} || {path} || {rest}
      when starts_with({target}, '#') or {target} = '' then {base} || {path} || regexp_extract({url}, '^[^?#]*(\?[^#]*)', 1) || {rest}
      else {base} || {_walked_sql(f"({folder} || {own})")} || {rest} end"""


OP10_SQL = rf"""
with recursive rules(rule_host, rule_path, v) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
found as (
  select url, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)', ' ', 'g'), '(?is)<(?:link|meta|base)\s(?:[^>"'']+|"[^"]*"|''[^'']*'')*>') as tags
  from pages where url is not null and regexp_matches(html, '(?i)canonical|refresh')),
bases as (
  select url, tags, list_filter(list_transform(list_filter(tags, lambda tag: regexp_matches(tag, '(?i)^<base')), lambda tag: {_attribute_sql("href")}), lambda v: v <> '')[1] as given
  from found),
each as (select url, coalesce({_absolute_sql("url", "given")}, url) as base, unnest(tags) as tag from bases),
targets as (
  select url, base, case
      when regexp_matches(tag, '(?i)^<link') and list_contains(regexp_split_to_array(lower({_attribute_sql("rel")}), '\s+'), 'canonical') then {_attribute_sql("href")}
      when regexp_matches(tag, '(?i)^<meta') and lower({_attribute_sql("http-equiv")}) = 'refresh' then regexp_extract({_attribute_sql("content")}, '(?is)\burl\s*=\s*["'']?([^"''\s]+)', 1) end as target
  from each),
links as (select url as from_url, to_url from (select url, {_absolute_sql("base", "target")} as to_url from targets where target <> '') where to_url is not null),
urls as (
  select url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from (select distinct url from pages union select from_url from links union select to_url from links)),
keyed as (select url, host, path, case when contains(url, '://') then regexp_extract(url, '^(.*?)://', 1) || '://' || host || regexp_extract(url, '://[^/?#]*(.*)', 1) end as key from urls),
fits as (
  select url, rule_host || rule_path as rule, v, row_number() over (partition by url order by length(rule_host || rule_path) desc, v) as n
  from keyed join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
ruled as (select k.*, f.rule, f.v from keyed k left join fits f on f.url is not distinct from k.url and f.n = 1),
e as (select distinct a.key as a, b.key as b from links l join keyed a on a.url = l.from_url join keyed b on b.url = l.to_url where a.key <> b.key),
both_ways as (select a, b from e union select b, a from e),
reach(a, b) as (select a, a from both_ways union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
aliased as (select reach.a as key from reach join ruled on ruled.key = reach.b where v is not null group by reach.a having bool_or(v = 'block') and not bool_or(v = 'allow'))
select page_id, r.host, r.path, r.rule, coalesce(r.v, case when r.key in (select key from aliased) then 'block' else 'allow' end) as verdict
from pages p left join ruled r on r.url is not distinct from p.url
"""


QUERIES = {"op1_histogram_shards": op1_histogram_shards, "op2_residual_packing": op2_residual_packing, "op3_exact_dedup": op3_exact_dedup, "op4_host_suffix_text": op4_host_suffix_text, "op5_merged_transforms": op5_merged_transforms, "op6_order_minhash": op6_order_minhash, "op8_cross_parsing": op8_cross_parsing, "op9_piece_rounds": op9_piece_rounds, "op7_imatch": op7_imatch, "op10_url_rules": op10_url_rules}

ORACLES = {"op3_exact_dedup": OP3_SQL, "op10_url_rules": OP10_SQL}
