"""The queries opN_<name>: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, imatch, langid, licenses, lm, near, pii, toxicity, warc


#: DuckDB SQL of the queries that SQL can express.
ORACLES = {
    "op2_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
             d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
             f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
        select d.page_id, cast(d.payload_bytes as bigint) as payload_bytes, d.payload_digest,
               case when f.first is not null and d.page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
               case when d.page_id is distinct from f.first then f.first end as refers_to
        from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100
    """,
}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Of the other queries, the columns that SQL can express, by the queries base_<name>.
ORACLES |= {
    "base_licenses": rf"""
        with w as (select doc_id, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
             p as (select doc_id, i - 1 as p, case when w[i] = 'mit' and w[i + 1] = 'license' then 'mit' when w[i] = 'apache' and w[i + 1] = 'license' then 'apache'
                   when w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license' then 'gpl' end as label from w, unnest(range(1, len(w) + 1)) as u(i))
        select w.doc_id, len(any_value(w)) as n_words, count(label) as n_base, min(p) as first_word, max(p) as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
        from w left join (select * from p where label is not null) using (doc_id) group by w.doc_id
    """,
    "base_imatch": """
        with t as (select doc_id, coalesce(text, '') as text from documents),
             n as (select doc_id, text, length(text) as n, coalesce(lag(text) over (order by doc_id), (select max_by(text, doc_id) from t)) as next from t)
        select doc_id, n as n_chars, sha256(left(text, n - n // 3) || left(next, n // 3)) as edited_sha256 from n
    """,
    "base_near": rf"""
        with w as (select doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents)
        select doc_id, case when len(w) = 0 then 0 when len(w) < 4 then 1 else len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))) end as n_shingles from w
    """,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_back(index)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.filter(~lm.held_out()))
    return lm.score_documents(docs, model).withColumn("held_out", lm.held_out())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    scored = toxicity.score_documents(docs, model).withColumn("held_out", toxicity.held_out())
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).drop("detections")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_documents(table(spark, sf_dir, "documents")))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.filter(~langid.held_out()))
    return langid.label_documents(docs, net).withColumn("held_out", langid.held_out())


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(imatch.fingerprints(table(spark, sf_dir, "documents")))


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.link_components(table(spark, sf_dir, "documents"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_near(spark, sf_dir).select("doc_id", "n_shingles")


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {f.__name__: f for f in (base_licenses, base_imatch, base_near)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
