"""The thin contract queries over this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, jaccard, language, main_text, nearest, quality, token_count, token_shards, warc_store
from .common import fresh_path, table

#: Where the vocabulary files of public tokenizers lie; a parameter of the operators.
PIECES, WORD_BPE, BYTE_BPE = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys give null, thus belong to no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    token_shards.write_shards(table(spark, sf_dir, "documents"), path, vocabulary(WORD_BPE), end_id=END_ID)
    return token_shards.read_documents(spark, path, ids=False)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_store.read_index(spark, path)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), pattern())


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold("k", 3) != 1)
    found = language.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), threshold=0.8, n=5)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_shards, op3_decontaminate, op4_nearest, op5_warc, op6_byte_bpe, op7_main_text, op8_quality, op9_language, op10_jaccard)}

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_ASCII}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op3_decontaminate": f"""
        with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
        bw as (select item, w[i : i + least(10, len(w)) - 1] as g, least(10, len(w)) as n
               from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
        sizes as (select distinct n from bw),
        dg as (select r, p, n, w[p : p + n - 1] as g
               from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
        hits as (select dg.r, dg.p, dg.n, bw.item from dg join bw on dg.n = bw.n and dg.g = bw.g),
        words_hit as (select r, count(distinct q) as n_hit
                      from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from hits)) group by r),
        items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join words_hit using (r) left join items using (r)""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        q as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest,
                     first_value(page_id) over w as owner, row_number() over w as place from p window w as (partition by html order by page_id nulls last))
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and place > 1 then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and place > 1 then owner end as refers_to
        from q""",
}
