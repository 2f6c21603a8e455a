"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents.

Every stage but the last keeps the columns of documents (and any more that its input has); n_chars follows the text.

Nulls: a null text is kept as null by the first stages, loses no words, holds no secrets, and packs as an end id alone; of rows
with a null id each is a document of its own by its text. Repeated rows (one id, one text) become one in the second stage. Empty and
very long texts pass whole. Ties go to the smaller id, then to the digest of the text. Columns whose names clash inside an operator
travel in a struct. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common, near_dedup, packing, secret_scan, substring_dedup, toxicity

REDACTED = "[SECRET]"


def folded(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns in one struct, so that no name can clash inside an operator."""
    cols = docs.columns
    plain = docs.toDF(*[f"_p{i}" for i in range(len(cols))])
    rest = [F.col(f"_p{i}") for i, c in enumerate(cols) if c not in ("doc_id", "text")]
    at = {c: F.col(f"_p{cols.index(c)}").alias(c) for c in ("doc_id", "text")}
    return plain.select(at["doc_id"], at["text"], F.struct(*rest, F.lit(0).alias("_")).alias("rest"))


def unfolded(found: DataFrame, like: DataFrame, text: str = "text", counted: bool = False) -> DataFrame:
    """The columns of `like` again, with the text of column `text`; counted: n_chars follows it."""
    out = []
    for i, c in enumerate(like.columns):
        if c == "n_chars" and counted:
            out.append(F.length(text).cast("long").alias(c))
        elif c in ("doc_id", "text"):
            out.append(F.col(text if c == "text" else c).alias(c))
        else:
            out.append(F.col(f"rest._p{i}").alias(c))
    return found.select(*out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the cutoff. Learns from the labelled documents among its input."""
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(folded(docs), net, carry=("text", "rest"))
    return unfolded(scored.filter(F.col("score") < toxicity.CUTOFF), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class; of rows with one id and one text, one."""
    rows = common.written(near_dedup.classified(docs), "classes")
    gone = common.written(rows.filter("NOT is_kept").select(F.col("id").alias("gone"), F.col("key").alias("gone_key")).distinct(), "gone")
    repeated = not rows.filter("is_kept").groupBy("id", "key").count().filter("count > 1").isEmpty()
    few = gone.count() <= near_dedup.BROADCAST_KEYS
    whole = folded(docs).withColumn("key", near_dedup.key_of("text"))
    kept = whole.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("key") == F.col("gone_key")), "left_anti")
    return unfolded(kept.dropDuplicates(["doc_id", "key"]) if repeated else kept, docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier in the corpus; other texts stay as they are."""
    found = substring_dedup.dedup_substrings(folded(docs), carry=("rest",), keep_whole=True)
    return unfolded(found, docs, "kept", counted=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of every secret."""
    grammar = secret_scan.fit(docs)
    return unfolded(secret_scan.find_secrets(folded(docs), grammar, carry=("rest",), redact=REDACTED), docs, counted=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences."""
    return packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]
#: No stage but the third can be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents in order; each result but the last is written and read again, and what a stage wrote on
    its way is deleted then."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
