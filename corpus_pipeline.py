"""A training corpus from `documents`: toxic documents go, one document of each near-duplicate group stays, documents
with benchmark items go, personal data is masked, and what is left is encoded to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`, whatever
further columns these are. Every stage gives no rows for an empty table, takes whole texts of any length, and keeps rows
with null or empty texts (the last encodes them to no ids). Rows with null ids are kept by the stages that judge a text
by itself (toxicity, personal data, encoding) and by the others, which know documents by their ids. Equal rows are
judged alike; only near-duplicate removal makes them one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.llm import bpe, decontam, near, pii, toxicity
from quillfind.llm.shared import join_hot, session, stored, without_hot

#: Near duplicates share 80 of 100 five-word shingles.
SHINGLE, NUM, DEN = 5, 80, 100
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """The documents whose id is not in the one column of `ids`."""
    ids = stored(ids.toDF("gone id").filter("`gone id` is not null").distinct(), kind)
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), docs["doc_id"].cast("long") == F.col("gone id"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the threshold."""
    session(docs)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("kept row"))
    scored = toxicity.score_documents(rows, model, keep=["kept row"])
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("kept row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; texts without words stay. Where an id
    has several rows, equal ones become one, and each of its texts is a document of its own (known by a hash of both);
    which of a group stays is then decided by these hashes. An empty table stays empty."""
    session(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").groupBy("id").agg(F.count("*").alias("rows of id")).filter("`rows of id` > 1")
    ids = stored(ids, "near-twice")
    if not ids.limit(1).count():
        groups = near.link_components(docs, words=SHINGLE, num=NUM, den=DEN)
        return _without(docs, groups.filter("doc_id <> component_id").select("doc_id"), "near-gone")
    named = docs.select(F.struct(*docs.columns).alias("kept row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    once = without_hot(named, ids, "id", "rows of id").select("kept row", "text", F.col("id").alias("node"))
    twice = join_hot(named, ids, "id", "rows of id").select("kept row", "text", F.xxhash64("id", "text").alias("node")).dropDuplicates(["node"])
    nodes = stored(once.unionByName(twice), "near-nodes")
    groups = near.link_components(nodes, id_col="node", words=SHINGLE, num=NUM, den=DEN)
    gone = stored(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("node")), "near-gone")
    return nodes.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge"), "node", "left_anti").select("kept row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a copy of a benchmark item."""
    leaks = decontam.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, leaks.select("doc_id"), "leaks")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its spans of personal data replaced by their kinds in brackets."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("kept row"))
    found = pii.find_spans(rows, keep=["kept row"]).select("kept row", "spans", F.col("kept row.text").alias("whole"))
    masked = F.when(F.size("spans") > 0, pii.redacted("whole", "spans")).otherwise(F.col("whole"))
    found = found.select("kept row", masked.alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("masked").isNull(), F.col("kept row.n_chars") if "n_chars" in docs.columns else None).otherwise(F.char_length("masked").cast("long"))}
    return found.select(*[(new[c] if c in new else F.col("kept row")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (array), and the digest of the decoded ids."""
    encoded = bpe.encode_documents(docs)
    ids = F.when(F.col("n_tokens") > 0, F.split("ids_text", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return encoded.select("doc_id", "n_tokens", ids.alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

#: Training, alignment and tokenising are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is stored in the shared folder and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
