"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, langid, mixing, ngrams, oracles, probminhash, quality, repair, topk, toxicity, trie, warc
from .store import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.assemble(warc.read_records(spark, path)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs, tokenizer_path("piece_bpe_32k.model")))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"), 0.8)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(table(spark, sf_dir, "documents"), order=2)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(turns), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc, op2_language_id, op3_chat_collapse, op4_embedding_dedup, op5_quality, op6_minhash_dedup, op7_toxicity, op8_source_mixing, op9_exact_topk, op10_bpe, op11_lm_scoring, op12_conversation_trie,
        op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op11_lm_scoring": oracles.LM_SCORING,
    "op12_conversation_trie": oracles.CONVERSATION_TRIE,
    "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op1_warc": r"""
with p as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as hexed from pages
), d as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(0, 5),
    lambda b: (((instr('0123456789abcdef', substr(hexed, 1 + (5 * i + b) // 4, 1)) - 1) >> (3 - (5 * i + b) % 4)) & 1) << (4 - b))) as int), 1)), '') as payload_digest
  from p
), f as (select *, row_number() over w as nth, first_value(page_id) over w as first_id from d window w as (partition by hexed order by page_id nulls last, url nulls last))
select page_id, cast(strlen(html) as bigint) as payload_bytes, payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type,
  case when nth > 1 then first_id end as refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as target_uri
from f
""",
    "op3_chat_collapse": r"""
with t as (
  select conv_id, row_number() over w as place, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
  window w as (partition by conv_id order by turn nulls last, coalesce(role, ''), coalesce(text, ''))
), s as (
  select conv_id, place, md5(string_agg(length(role) || ':' || role || text || chr(30), '' order by place) over (partition by conv_id order by place rows between unbounded preceding and current row)) as h,
    max(place) over (partition by conv_id) as n_turns from t
), whole as (
  select min(conv_id) as conv_id, h, n_turns from s where place = n_turns group by h, n_turns
), kept as (
  select * from whole w where not exists (select 1 from s where s.h = w.h and s.place = w.n_turns and s.place < s.n_turns)
)
select k.conv_id, k.n_turns, string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10), '' order by t.place) as rendered
from kept k join t using (conv_id) group by k.conv_id, k.n_turns
""",
    "op4_embedding_dedup": r"""
with recursive r as materialized (select row_number() over () as n, vec_id, label, embedding from embeddings),
v as (
  select n, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from r
  where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as materialized (
  select a.n as x, b.n as y, b.vec_id as least from v a join v b on a.label = b.label and a.n <> b.n and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) as (select x, y from links union select reach.x, l.y from reach join links l on reach.y = l.x),
c as (select r.n, least(any_value(r.vec_id), min(o.vec_id)) as component_id from r left join reach on reach.x = r.n left join r o on o.n = reach.y group by r.n),
k as (select x, count(*) as n_links from links group by x)
select r.vec_id, coalesce(k.n_links, 0) as n_links, c.component_id, r.vec_id is not distinct from c.component_id as kept
from r join c using (n) left join k on k.x = r.n
""",
    "op8_source_mixing": r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), 'null')) as key from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source collate "binary" nulls last) - 1) % 3 as nth from d group by source
), c as (
  select *, case nth when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as budget from s
), r as (select *, cap / weight as ratio from c),
l as (
  select *, (budget - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) /
    sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r
), g as (
  select source, source_size, weight, budget, cap, coalesce(min(case when ratio >= level then level end) over (), max(ratio) over ()) as level from l
), e as (
  select d.*, g.source_size, g.weight, g.budget, least(g.cap, g.weight * g.level) as target,
    sum(d.size) over (partition by d.source order by d.key, d.size rows unbounded preceding) as stop
  from d join g on d.source is not distinct from g.source
), o as (
  select source, stop + pass * source_size as stop, budget,
    sum(size) over (order by (stop + pass * source_size) / weight, source nulls last, key, size rows unbounded preceding) as total
  from e, (values (0), (1)) p(pass) where size > 0
), cut as (select source, max(stop) as cut from o where total <= budget group by source)
select e.doc_id, e.size, e.source_size, e.target,
  cast(e.size * (case when e.stop <= cut.cut then 1 else 0 end + case when e.stop + e.source_size <= cut.cut then 1 else 0 end) as bigint) as taken
from e left join cut on e.source is not distinct from cut.source
""",
    "op9_exact_topk": r"""
with v as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.n, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.n <> c.n and len(q.x) = len(c.x)
), r as (select *, cast(row_number() over (partition by n order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
}
