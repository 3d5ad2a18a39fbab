"""The thin queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, lang_id, mixing, negatives, neighbours, packing, quality, shared, simhash, token_counts, token_files, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = lang_id.predict(docs, lang_id.train(docs))
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_folder(spark, "warc")
    index = warc.archive(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_folder(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read_token_digests(spark, folder)


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0)).select("query_id", "rank", "vec_id", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(_table(spark, sf_dir, "labels")))
    return quality.score(docs, model)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 get the next label, those divisible by 100 are the anchors."""
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_token_files": op4_token_files,
    "op5_near_vectors": op5_near_vectors,
    "op6_neighbours": op6_neighbours,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_packing": op13_packing,
}
#: SQL where it can express the query; tests hold the others against brute force, and op6's recall against exact search.
#: That of op5 is exact: the tables find all pairs there that are well above the threshold, and may miss one just at it.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as body, strlen(coalesce(html, '')) as payload_bytes from pages),
        d as (select page_id, payload_bytes, sha1(body) as payload_digest from p),
        m as (select *, max(page_id) over (partition by payload_digest) as original from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> original then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> original then original end as refers_to
        from m""",
    "op5_near_vectors": """
        with recursive e as (
            select vec_id, label, embedding::double[] as v from embeddings
            where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
              where list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, p.b from reach join p on p.a = reach.b),
        c as (select a as vec_id, min(b) as component_id from reach group by a),
        n as (select a as vec_id, count(*) as n_links from p group by a)
        select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
        from embeddings join c using (vec_id) left join n using (vec_id)""",
    "op11_hard_negatives": """
        with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
                   from embeddings where label is not null and embedding is not null and len(embedding) > 0
                   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        d as (select a.vec_id as anchor_id, e.vec_id, e.label = a.label as same,
                     list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2]))::bigint as score
              from e, e a where a.vec_id % 100 = 0 and a.vec_id <> e.vec_id and len(a.v) = len(e.v)),
        p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as turn from d where same),
        n as (select p.anchor_id, p.vec_id as positive_id, d.vec_id as negative_id, p.score as positive_score, d.score as negative_score,
                     row_number() over (partition by p.anchor_id, p.vec_id order by d.score desc, d.vec_id) as rank
              from p join d using (anchor_id)
              where p.turn <= 5 and not d.same and 30 * p.score <= 100 * d.score and 100 * d.score <= 90 * p.score)
        select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op12_filter_audit": """
        with recursive orders(filter_order) as (
            select '' union all
            select filter_order || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) letters(f) where not contains(filter_order, f)),
        steps as (select filter_order, step::int as step, filter_order[step] as f, filter_order[:step - 1] as earlier
                  from orders, range(1, 6) numbers(step) where length(filter_order) = 5),
        d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
                     regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
        l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
        x as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, doc_id,
                     case when len(words) < 200 then 'A' else '' end
                     || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
                     || case when 100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body) then 'C' else '' end
                     || case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end
                     || case when doc_id > min(doc_id) over (partition by body) then 'E' else '' end as failed
              from d left join l using (doc_id)),
        c as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from x group by all),
        y as (select part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) as fails,
                     len(list_filter(string_split(earlier, ''), lambda e: e <> '' and contains(failed, e))) > 0 as gone
              from c, steps),
        z as (select part, filter_order, step, f,
                     sum(case when not fails and not gone then n else 0 end)::bigint as kept,
                     sum(case when fails and not gone then n else 0 end)::bigint as removed,
                     sum(case when fails and gone then n else 0 end)::bigint as redundant,
                     sum(case when failed = f then n else 0 end)::bigint as unique_fails,
                     sum(case when fails and not gone then good else 0 end)::bigint as good_lost,
                     sum(case when fails and not gone then toxic else 0 end)::bigint as toxic_lost
              from y group by part, filter_order, step, f)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) over (partition by part, f)::bigint as shapley from z""",
}
