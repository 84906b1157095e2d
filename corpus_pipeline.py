"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes the documents that the one before has kept and returns documents again, but for the
last, which returns bins. Stages decide by row, so rows that share a doc_id or have none are judged by
their own texts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralith.llm import ngram_join, packing, quality_model, quality_rules, suffix_dedup
from narralith.llm._shared import cut, drop_cut, table, text_batches

#: Ids of documents to leave out that may be broadcast; more are joined.
BROADCAST_IDS = 400_000

#: The labels that are the rules' holdout. The classifier never learns from these, so that what it lets through is a
#: fair sample for the rules' bounds.
FOR_RULES = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row that is the same whenever the rows are read again.

    Rows of files are numbered by file and place in it; only of other tables the numbers must be fixed by a copy.
    """
    spark = docs.sparkSession
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:  # not read from files that count their rows
        return cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    paths = placed.select("__path").distinct().select("__path", (F.row_number().over(Window.orderBy("__path")) - 1).cast("long").alias("__file"))
    paths = cut(paths)  # a row for each file
    few = paths.count() <= BROADCAST_IDS
    return placed.join(F.broadcast(paths) if few else paths, "__path").withColumn("__row", F.shiftleft("__file", 36) + F.col("__at")).drop("__path", "__file", "__at")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered ``rows`` less those whose number is in ``gone``, without their numbers."""
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, "__row", "left_anti").drop("__row")


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier finds likelier good than bad."""
    text_batches(spark)
    stats = cut(quality_model.with_statistics(docs))
    model = quality_model.fit(stats, table(spark, sf_dir, "labels").where(f"not {FOR_RULES}"))
    drop_cut(stats)
    return quality_model.keep_good(docs, model, 0.5)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    text_batches(spark)
    whole = docs.select(F.struct("*").alias("__doc"), "doc_id", "lang", "text")
    # the holdout is counted by itself, so that the documents need one pass and no copy
    labels = table(spark, sf_dir, "labels").where(FOR_RULES)
    known = whole.drop("__doc").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = cut(quality_rules.with_counts(known).drop("text"))
    cutoffs = cut(quality_rules.thresholds(counts, labels))
    drop_cut(counts)
    # No filter moves below a column of row numbers: the counts would be worked out anew in each of its terms.
    counted = quality_rules.with_counts(whole).withColumn("__at", F.monotonically_increasing_id())
    return quality_rules.verdicts(counted, cutoffs).where("kept and __at >= 0").select("__doc.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row of the document with the least id; one without id only if no other has one."""
    text_batches(spark)
    rows = numbered(docs)
    found = ngram_join.join_components(rows.select("__row", "text"), ngram_join.Settings(words=5, percent=80), "__row")
    placed = cut(found.select(F.col("id").alias("__row"), "component").join(rows.select("__row", "doc_id"), "__row"))
    stays = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best"), F.count("*").alias("c")).where("c > 1")
    return without(rows, cut(placed.join(stays, "component").where("__row <> best.__row").select("__row"))).select(docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that start elsewhere too; bytes of a character cut in two go as well."""
    text_batches(spark)
    kept = suffix_dedup.remove_repeats(docs, as_text=True)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' words in sequences of the permitted lengths."""
    text_batches(spark)
    return packing.pack_table(cut(docs.select("doc_id", packing.word_count("text").alias("n_tokens"))))


STAGES = [("quality classifier", classified), ("quality rules", ruled), ("n-gram Jaccard join", distinct), ("suffix-array dedup", unrepeated), ("best-fit packing", packed)]

#: The classifier's numerical fit and the induced sort have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
