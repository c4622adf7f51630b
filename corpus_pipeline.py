"""From raw documents to packed training sequences, one stage per operator.

Every stage takes documents and returns documents with the same columns, but
the last, which returns the places of their pieces in packed sequences. Each
learns from all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ziplore.llm import near_dedup, packing, pii, quality
from ziplore.session import pin, scratch_path

#: Ids of documents to leave out are few next to the corpus; up to so many are
#: broadcast (some 16 MB), more are joined by shuffling the documents.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, out: DataFrame, keys: list[str]) -> DataFrame:
    """Documents whose keys are not in ``out``."""
    out = pin(out.distinct())
    return docs.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, keys, "left_anti")


def _kept(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents without an id or with one that is kept; rows of an id are all kept or none is.

    Ids to leave out are broadcast, or those to keep where these are fewer: of a
    corpus that is copies for the most part, the former are too many.
    """
    out = pin(classes.filter("NOT kept").select("doc_id").distinct())
    if out.count() > BROADCAST_IDS:
        kept = pin(classes.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct())
        if kept.count() <= BROADCAST_IDS:
            marked = docs.join(F.broadcast(kept.withColumn("ziplore_kept", F.lit(True))), "doc_id", "left")
            return marked.filter("ziplore_kept OR doc_id IS NULL").select(*docs.columns)
    return _without(docs, out, ["doc_id"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the robust outlier test keep.

    Equal texts of one language and source are judged alike, so rejected rows
    are found again by these columns and a hash of the text.
    """
    key = {"ziplore_h1": F.xxhash64("text"), "ziplore_h2": F.xxhash64("text", F.lit(1)), "ziplore_h3": F.xxhash64("lang", "source")}
    judged = quality.judge_documents(docs.withColumns(key).select("text", "lang", "source", *key))
    rejected = judged.filter("NOT kept").select(*key)
    return _without(docs.withColumns(key), rejected, list(key)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Rows that repeat an id with the same text are one document; with other texts
    they are documents of their own.
    """
    classes = pin(near_dedup.near_duplicates(docs))
    rest = _kept(docs, classes)
    repeated = classes.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rest
    # Rows that repeat an id: one of each text stays.
    text = {"ziplore_h1": F.xxhash64("text"), "ziplore_h2": F.xxhash64("text", F.lit(1))}
    again = rest.join(repeated, "doc_id", "left_semi").withColumns(text).dropDuplicates(["doc_id", *text])
    return _without(rest, repeated, ["doc_id"]).unionByName(again.select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    found = pii.find_personal_data(docs, pii.train(spark))
    return pii.redact(found).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("redact_personal_data", redact_personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn from the corpus, which SQL can't express; tests hold them
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
