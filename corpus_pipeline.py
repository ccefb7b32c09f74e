"""A corpus pipeline of the operators in tessera.llm.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents (doc_id, text,
lang, source, n_chars; others that docs has pass through).

1. toxicity: documents predicted toxic go.
2. near_duplicates: of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the
   document with the least doc_id stays.
3. decontamination: documents that hold a benchmark window go.
4. secrets: found secrets become [SECRET]; n_chars follows the text. No document goes.
5. packing: the pieces of what is left, in sequences of 2048 tokens.

A filtering stage decides by a row's own text, never by its doc_id: rows with a null or repeated doc_id stay or go like
any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.decontamination import contamination
from tessera.llm.nearcopies import near_copies, text_key
from tessera.llm.packing import pack
from tessera.llm.secrets import blob_of, ledger_path, scan_new, spans_of
from tessera.llm.toxicity import score_texts, train

MARK = "[SECRET]"


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose own text isn't in bad (doc_id: a text_key)."""
    return docs.join(bad.select(F.col("doc_id").alias("_bad")).distinct(), text_key() == F.col("_bad"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    C.ship(spark)
    model = train(docs, C.table(spark, sf_dir, "labels"))
    scores = score_texts(docs.select(text_key().alias("doc_id"), "text"), model)
    return _without(docs, scores.where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, null after all others; of rows that repeat
    both doc_id and text, one."""
    C.ship(spark)
    keyed = docs.withColumn("_key", text_key())
    found = near_copies(docs.select("text")).withColumnRenamed("k", "_k")
    ids = keyed.select("_key", F.col("doc_id").alias("_id")).join(found, F.col("_key") == F.col("_k"), "left")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("_id"), F.col("_key").alias("_stays"))
    stays = ids.groupBy(F.coalesce("component", "_key").alias("_group")).agg(F.min(rank).alias("s")).select("s._id", "s._stays")
    kept = keyed.join(stays, (F.col("_key") == F.col("_stays")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    found = contamination(docs.select(text_key().alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that a rule finds, by the ledger, becomes MARK; spans that overlap become one."""
    C.ship(spark)
    known = spans_of(scan_new(docs.where("text is not null"), ledger_path(spark)))
    found = known.select(F.col("blob").alias("_blob"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_spans"))
    out = docs.join(found, blob_of(F.col("text")) == F.col("_blob"), "left")
    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    # from span to span: what lies between them, and one mark for each run of overlapping spans
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(MARK))).otherwise(a["text"]).alias("text"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    done = F.aggregate(F.array_sort("_spans"), empty, step, lambda a: F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.col("_spans").isNotNull(), done).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of every document that is left."""
    C.ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests/llm compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = C.table(spark, sf_dir, "documents")
    base = f"{C.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
