"""A corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the columns of ``documents``;
the last gives the packed pieces. ``run`` writes each stage's result to shared storage and reads it for the next; what a
stage has written besides, and the result before it, are deleted then.

Defined results: a document without text passes the first four stages as it is and is packed as its end token; an
empty table gives an empty result; columns beyond those of ``documents`` are carried along to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, neardup, packing, pii, toxicity
from textloom.llm._shared import discard, materialise, scratch, workdir

#: Probability of toxicity at which a document is rejected.
TOXIC_AT = 0.7
#: Percent of shared five-word shingles from which documents are near-duplicates.
NEAR_AT = 80

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC_AT``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.split(docs, labels, "toxic"))
    # The whole row travels as one column, so no column of it can clash with those of the operator.
    found = toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model, ["row"])
    return found.where(F.col("score") < TOXIC_AT).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    gone = neardup.near_duplicates(docs, k=5, percent=NEAR_AT).where("not kept").select("doc_id").distinct()
    return docs.join(materialise(gone, "gone"), "doc_id", "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontam.decontaminate(docs, benchmark).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(materialise(leaks, "leaks"), "doc_id", "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked, disclosing terms generalised or removed, and n_chars anew."""
    clean = pii.sanitise(docs)
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean")).cast("bigint")}
    return clean.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, stage in STAGES[:-1]:
        path = workdir(spark, name)
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        discard(spark, last)
        docs, last = spark.read.schema(found.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
