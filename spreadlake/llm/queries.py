"""The contract queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k

    table = _table(spark, sf_dir, "embeddings")
    return top_k(table, table.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import verdicts

    judged = verdicts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), end_id=1, size=2048)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import toxic_passages, train

    docs = _table(spark, sf_dir, "documents")
    scored = toxic_passages(docs, train(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


SURROGATE_KEY = b"corpus surrogates"  # a deployment passes its own secret


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .surrogates import pseudonymise

    done = pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import report

    told = report(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontaminate import report

    told = report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return told.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    table = _table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull())
    table = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(table, table.where(F.col("vec_id") % 100 == 0), positives=5, negatives=5, low=(80, 100), scale=256)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import rebuilt, trie, turns

    return trie(rebuilt(turns(_table(spark, sf_dir, "conversations")), block=20, most=4))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_topk_search, op2_bpe, op3_sharding, op4_quality, op5_packing, op6_toxicity, op7_pii, op8_ngram_join, op9_token_counts, op10_line_dedup, op11_decontamination, op12_hard_negatives, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    from . import quality

    op1 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
    op8 = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as s from d),
e as (select doc_id, len(s) as n, unnest(s) as x from s), f as (select x, count(*) as f from e group by x),
p as (select * from (select doc_id, n, x, row_number() over (partition by doc_id order by f, x) as k from e join f using (x)) where k <= n - cast(ceil(n * 3 / 4.0) as bigint) + 1),
c as (select distinct a.doc_id as a, b.doc_id as b from p a join p b on a.x = b.x and a.doc_id < b.doc_id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
l as (select a, b from (select a, b, len(list_intersect(x.s, y.s)) as i, len(x.s) as m, len(y.s) as n from c join s x on x.doc_id = a join s y on y.doc_id = b) where 100 * i >= 75 * (m + n - i)),
both_ as (select a, b from l union all select b, a from l), r as (select doc_id as a, doc_id as b from s union select r.a, both_.b from r join both_ on both_.a = r.b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.b) as component_id from s join r on r.a = s.doc_id group by s.doc_id, s.s
"""
    op10 = """
with l as (select doc_id, i - 1 as line_no, string_split(text, chr(10))[i] as line from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
w as (select doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) as s from l), g as (select * from w where len(s) > 0),
q as (select s, row_number() over (order by min((doc_id, line_no))) as id, min((doc_id, line_no)) as at from g group by s), e as (select id, len(s) as n, unnest(s) as x from q), f as (select x, count(*) as f from e group by x),
p as (select * from (select id, n, x, row_number() over (partition by id order by f, x) as k from e join f using (x)) where k <= n - cast(ceil(n * 3 / 4.0) as bigint) + 1),
c as (select distinct a.id as a, b.id as b from p a join p b on a.x = b.x and a.id < b.id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
m as (select distinct b as id from (select b, len(list_intersect(x.s, y.s)) as i, len(x.s) as m, len(y.s) as n from c join q x on x.id = a join q y on y.id = b where x.at < y.at) where 4 * i >= 3 * (m + n - i)),
gone as (select g.doc_id, g.line_no from g join q using (s) where (g.doc_id, g.line_no) > q.at or q.id in (select id from m)),
r as (select doc_id, count(*) as n, string_agg(cast(line_no as varchar), ',' order by line_no) as removed from gone group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) as n_lines, cast(coalesce(r.n, 0) as bigint) as n_removed, coalesce(removed, '') as removed from documents d left join r using (doc_id)
"""
    op11 = """
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
k as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
g as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) as x from k),
sizes as (select distinct n from g),
places as (select r, n, unnest(range(1, len(w) - n + 2)) as i, w from d join sizes on len(w) >= n),
hit as (select r, i, p.n, item_id from places p join g on p.n = g.n and array_to_string(list_slice(w, i, i + p.n - 1), ' ') = x),
words as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from hit) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from hit where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""
    op12 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v c on c.vec_id <> a.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
    from . import prefix_trie

    return {"op11_decontamination": op11, "op12_hard_negatives": op12, "op13_prefix_trie": prefix_trie.ORACLE, "op1_topk_search": op1, "op4_quality": quality.ORACLE, "op8_ngram_join": op8, "op10_line_dedup": op10}
