"""The registered queries: each operator over its whole table with production parameters, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.cut import small_batches
from webloom.llm import chat, decontaminate, flac, hll_sets, jaccard_join, line_dedup, mixing, ngram_lm, pii, prefix_trie, quality, simhash, url_filter
from webloom.tables import table

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select -7L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from range(0, 2, 1, 1)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_examples(conversations))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The labelled URLs are those that the list decides: rules are mined for what it leaves open.
    labelled = pages.select("url", url_filter.listed_rule(F.col("url"), URL_RULES)[1].alias("verdict"))
    mined = url_filter.mine(labelled, min_support=0.002, min_confidence=0.8, min_lift=1.2)
    return url_filter.judge(pages, URL_RULES, mined)


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(flac.with_media(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(table(spark, sf_dir, "documents"), labels)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op11_hll_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hll_sets.window_algebra(table(spark, sf_dir, "clicks"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def _in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _in_small_batches(f)
    for f in (
        op1_decontaminate, op2_chat, op3_jaccard, op4_ngram_lm, op5_url_filter, op6_flac, op7_quality, op8_pii, op9_mixing, op10_line_dedup,
        op11_hll_sets, op12_simhash, op13_prefix_trie,
    )
}

_ESCAPED = r"regexp_replace({0}, '([\[<])(~*(?:\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]))', '\1~\2', 'g')"

ORACLES = {
    "op2_chat": rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
gathered as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
    sum(length('<|turn|>' || {_ESCAPED.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10) || {_ESCAPED.format("text")} || '<|end|>' || chr(10))) as formatted_chars,
    count(*) filter (role = 'assistant') as n_examples
  from turns group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  formatted_chars::bigint as formatted_chars, n_examples from gathered""",
    "op3_jaccard": r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from texts),
sizes as (select doc_id, len(s) as n from sets),
rows as (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from rows a join rows b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * common >= 85 * (p.n + q.n - common)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as r from sizes union select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.r)
select sizes.doc_id, n::bigint as n_shingles, min(r) as component_id from sizes join reach on reach.doc_id = sizes.doc_id group by all""",
    "op13_prefix_trie": r"""
with codes as (
  select list(c order by i) as code from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))),
turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as i, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
sizes as (select c, count(*) as n from turns group by c),
convs as (
  select s.c, s.c - s.c % 100 as lender, coalesce(b.n, 0) as lent,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s.c::varchar, ''), lambda x: ord(x)::bigint)), lambda c, x: xor(code[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 6 as h
  from sizes s cross join codes left join sizes b on b.c = s.c - s.c % 100),
rebuilt as (
  select c, least(h, lent) + i - h as pos, role, text from turns join convs using (c) where i >= h
  union all select v.c, i, role, text from convs v join turns t on t.c = lender where i < h),
members as (
  select c, 0 as d, '' as node, 0 as chars from convs
  union all select c, pos + 1, string_agg(md5(length(role) || ':' || role || text), '' order by pos) over (partition by c order by pos), length(text) from rebuilt),
placed as (select *, lag(node) over (partition by c order by d) as above, row_number() over (partition by c order by d desc) = 1 as ends from members),
nodes as (
  select node, min(c) as c, any_value(d) as d, any_value(above) as above, count(*) as n, any_value(chars) as chars, coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') as ended from placed group by node),
children as (select above as node, count(*) as n_children from nodes group by above),
counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node)),
subtrees as (
  select m.node, count(*) filter (x.n_children = 0) as n_leaves, sum((x.n - 1) * x.chars) as saved from counted x join members m on m.c = x.c and m.d <= x.d group by m.node)
select x.c as conv_id, x.d::bigint as depth, p.c as parent_conv_id, x.n as n_convs, x.n_children, n_leaves, saved::bigint as saved_tokens, sha256(x.ended) as ends_sha256
from counted x join subtrees using (node) left join nodes p on p.node = x.above""",
}
