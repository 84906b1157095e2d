"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralith.llm._shared import cut, table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import bpe

    return bpe.digest_texts(table(spark, sf_dir, "documents"), word_bpe_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import html_main

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


QUERIES["op4_html"] = op4_html


#: The fold whose labels are never learned from.
HELD_OUT = "coalesce(crc32(cast({} as string)) % 4 = 2, false)"


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import quality_model as Q

    stats = cut(Q.with_statistics(table(spark, sf_dir, "documents")))
    model = Q.fit(stats, table(spark, sf_dir, "labels").where("not " + HELD_OUT.format("doc_id")))
    scored = Q.score_statistics(stats, model)
    return scored.select(F.col("id").alias("doc_id"), F.expr(HELD_OUT.format("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES["op6_quality"] = op6_quality


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import quality_rules as R

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counts = cut(R.with_counts(docs).drop("text"))
    cutoffs = cut(R.thresholds(counts, table(spark, sf_dir, "labels")))
    return R.verdicts(counts, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op3_rules"] = op3_rules


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import ngram_join as J

    found = J.join_components(table(spark, sf_dir, "documents"), J.Settings(words=4, percent=85))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES["op9_ngram_join"] = op9_ngram_join


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import fingerprints as P

    s = P.Settings()
    df = P.with_next(table(spark, sf_dir, "documents"), "doc_id", "text", s)
    n = F.length("text")
    cut_at = F.floor(n / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut_at), F.substring(F.col("next_text"), F.lit(1), cut_at)))
    df = P.with_fingerprint(df.select("id", n.cast("long").alias("n_chars"), "fp", "next_fp", "edited"), F.col("edited"), "efp", s)
    return df.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        P.as_text(F.col("fp")).alias("fingerprint"),
        P.as_text(F.col("efp")).alias("edited_fingerprint"),
        P.likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        P.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        P.containment(F.col("fp"), F.col("efp")).alias("contained_in_edited"),
    )


QUERIES["op8_fingerprint"] = op8_fingerprint


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import suffix_dedup as D

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return D.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op5_suffix_dedup"] = op5_suffix_dedup


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import packing as K

    docs = table(spark, sf_dir, "documents").select("doc_id", K.word_count("text").alias("n_tokens"))
    return K.pack_table(cut(docs))


QUERIES["op1_packing"] = op1_packing


def op7_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import chaining as C

    found = C.passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("other").alias("other_doc_id"), F.col("other_start").cast("long"), F.col("other_end").cast("long"), F.round("identity", 6).alias("identity"))


QUERIES["op7_chaining"] = op7_chaining


#: How the transcripts of a conversation mark its speakers, by conv_id modulo the number of styles: fixed values.
STYLES = [("System: ", "User: ", "Assistant: ", "Tool: "), ("### Instruction\n", "### Human\n", "### Bot\n", "### Observation\n"), ("<|system|>", "<|user|>", "<|assistant|>", "<|tool|>"), ("[sys] ", "[customer] ", "[agent] ", "[function] "), ("System - ", "Q: ", "A: ", "Output: ")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narralith.llm import chat_format as C

    rows = table(spark, sf_dir, "conversations")
    style = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STYLES)))
    marks = F.array(*[F.array(*map(F.lit, x)) for x in STYLES])
    mark = F.coalesce(*[F.when(F.lower("role") == r, F.get(F.get(marks, style), F.lit(k))) for k, r in enumerate(C.ROLES)], F.lit(""))
    found = C.turns(rows.select("conv_id", "turn", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text")))
    return found.select(F.col("key").alias("conv_id"), F.col("row").alias("turn"), "line", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("long").alias("n_chars"))


QUERIES["op10_chat"] = op10_chat
