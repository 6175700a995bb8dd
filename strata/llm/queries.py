"""One query an operator, with production parameters over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strata.llm import chat, graph_search, hamming, mixing, pieces, quality, secrets, simhash, toxicity, warc
from strata.llm.common import table


def op1_domain_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Rates that bring every document domain to its share of tokens; see :func:`mixing.mix`."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_toxicity_severity(spark: SparkSession, d: str) -> DataFrame:
    """Severity of every document, learned from the labels; see :func:`toxicity.score`."""
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, d, "labels")))


def op3_piece_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Token counts and digests of every document; see :func:`pieces.encode_documents`."""
    return pieces.encode_documents(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_warc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every page, written to archives and read back; see :func:`warc.round_trip`."""
    return warc.round_trip(table(spark, d, "pages"))


def op5_simhash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document; see :func:`simhash.near_duplicates`."""
    return simhash.near_duplicates(table(spark, d, "documents"))


def op6_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in every document; see :func:`secrets.scan`."""
    return secrets.scan(table(spark, d, "documents"))


def op7_quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out; see :func:`quality.score`."""
    docs = table(spark, d, "documents")
    return quality.score(docs, quality.train(docs, table(spark, d, "labels")))


def op8_chat_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation and one that holds the template's own marks, formatted and read back; see :func:`chat.round_trip`."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return chat.round_trip(rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")))


def op9_graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all; see :func:`graph_search.search`."""
    vectors = table(spark, d, "embeddings")
    return graph_search.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op10_embedding_groups(spark: SparkSession, d: str) -> DataFrame:
    """Links and component of every vector; see :func:`hamming.near_duplicates`."""
    return hamming.near_duplicates(table(spark, d, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_domain_mixing, op2_toxicity_severity, op3_piece_encoding, op4_warc_round_trip, op5_simhash_groups, op6_secret_scan, op7_quality_score, op8_chat_round_trip, op9_graph_neighbours, op10_embedding_groups)
} | {"pipeline": corpus_pipeline.run}

_OP4 = """with p as (select page_id, coalesce(html, '') as h from pages), q as (select page_id, strlen(h) as n, sha256(h) as g from p),
f as (select g, min(page_id) as first from q where n >= 100 group by g)
select page_id, cast(n as bigint) as payload_bytes, g as payload_digest, case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
case when page_id is distinct from first and first is not null then first end as refers_to from q left join f using (g)"""

_OP8 = r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, case when regexp_matches(text, '\\[\\\[<]|\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE[ \]]') or (role = 'assistant' and text like '%\') then len(regexp_replace(text, '[^\\\[<]', '', 'g')) else 0 end as escapes,
  case role when 'user' then 15 when 'assistant' then 7 when 'system' then 17 end as marks from t)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
cast(sum(len(text) + escapes + marks) as bigint) as formatted_chars from e group by conv_id"""

_OP10 = """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select vec_id, vec_id from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a), n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)"""

_OP9 = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])))) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op4_warc_round_trip": _OP4, "op6_secret_scan": secrets.ORACLE, "op8_chat_round_trip": _OP8, "op9_graph_neighbours": _OP9, "op10_embedding_groups": _OP10}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
