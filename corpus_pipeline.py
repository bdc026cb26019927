"""Training-data pipeline over ``documents``: five stages, each one operator of claimlens.llm.

Every stage takes the rows its predecessor kept; all but the last return the columns of ``documents``:

- toxicity: rows whose text scores as toxic go; null and empty texts stay.
- near_duplicates: of each group of near copies the row with the smallest doc_id stays (null ids last, then the smallest text digest);
  of rows that repeat both doc_id and text one stays. Wordless rows are near copies of nothing.
- decontamination: rows with a word inside a benchmark window go; wordless rows stay.
- personal_data: every found span of a text is replaced by its kind in brackets, n_chars is counted anew.
- packing: the pieces of the remaining texts (doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset).

Every row is judged by its own text, also where a doc_id repeats with other texts or is null: decisions are carried to the rows by
doc_id (null-safe) and the text's digest.
Empty tables give an empty result. Columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontaminate, minhash, packing, pii, toxicity
from claimlens.llm.common import broadcast_if_small, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def text_digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def keys_of(rows: DataFrame, name: str) -> DataFrame:
    """The distinct keys of ``rows``, stored and counted: few are sent to every executor, many are joined by sorting."""
    keys = stored(rows.distinct(), name)
    return broadcast_if_small(keys, keys.count(), 128)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The operator groups rows under (null id, doc_id, whether the text is null, digest), so that each text of an id is judged by itself."""
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("text").isNull().alias("void"), text_digest().alias("digest"))
    at = unused(docs, "key_")
    keyed = docs.withColumn(at, key)
    judged = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    kept = keys_of(judged.where("kept").select(F.col("doc_id").alias(at)), "kept-keys")
    out = keyed.join(kept, at, "left_semi")
    counts = judged.where("kept").groupBy(F.col("doc_id").alias(at)).agg(F.count("*").alias("n_rows_"))
    repeated = keys_of(counts.where("n_rows_ > 1").select(at), "repeated-keys")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    one = out.join(repeated, at, "left_semi").dropDuplicates([at])
    return out.join(repeated, at, "left_anti").unionByName(one).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    at = unused(docs, "digest_")
    judged = decontaminate.contamination(docs.select(text_digest().alias("doc_id"), "text"), benchmark)  # the digest stands for the id
    hit = keys_of(judged.where("contaminated").select(F.col("doc_id").alias(at)), "contaminated-digests")
    return docs.withColumn(at, text_digest()).join(hit, at, "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("packing", pack),
]

#: The learned toxicity grammar and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
