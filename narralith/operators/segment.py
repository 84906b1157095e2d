"""Segmentation of books: chains with the number, headers and matn that belong to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narralith.functions import lexicon
from narralith.functions import text as T
from narralith.operators import automata, tokens
from narralith.operators.joins import asof


@dataclass(frozen=True)
class BookParams:
    chain: automata.ChainParams = automata.ChainParams()
    # Markers and headers as patterns over normalized text.
    number: str = r"(\p{Nd}+)\s*-"
    kitab: str = r"كتاب\s+\S+(?:\s+\S+){0,3}"
    bab: str = r"باب\s+\S+(?:\s+\S+){0,4}"
    reach: int = 30  # characters between a number and its chain
    longest: int = 4000
    begin: str = ""


def records(books: DataFrame, params: BookParams = BookParams(), lexicon_only: bool = False) -> DataFrame:
    """(book_id, number, sanad_start, sanad_end, narrator_count, narrators, matn_start, matn_end, matn, kitab, bab) of raw books (book_id, raw)."""
    clean = books.select("book_id", T.normalize(F.col("raw")).alias("clean"))
    if params.begin:
        at = F.regexp_instr("clean", F.lit(params.begin))
        clean = clean.select("book_id", F.when(at > 0, F.substring(F.col("clean"), at, F.length("clean"))).otherwise(F.col("clean")).alias("clean"))
    marked = tokens.with_segments(tokens.analyzed(clean, ["book_id"], lexicon_only=lexicon_only), ["book_id"])
    found = automata.chains(marked, params=params.chain).withColumn("narrator_count", F.size("narrators").cast("long"))
    kept = found.where(F.col("narrator_count") >= params.chain.least).withColumn("pos", F.col("sanad_start"))
    spans = lambda pattern: T.regex_spans(clean, "clean", pattern, ["book_id"])
    numbers = spans(params.number).select("book_id", F.col("pos").cast("int").alias("pos"), T.to_int(F.regexp_extract("match", r"^\p{Nd}+", 0)).alias("number"))
    rows = asof(kept, numbers, ["book_id"], "pos", ["number"], tolerance=params.reach)
    for name, pattern in (("kitab", params.kitab), ("bab", params.bab)):
        headers = spans(pattern).select("book_id", F.col("pos").cast("int").alias("pos"), F.trim("match").alias(name))
        rows = asof(rows, headers, ["book_id"], "pos", [name], prefix=f"{name}_").withColumnRenamed(f"{name}_{name}", name).drop(f"{name}_pos")
    rows = rows.drop("pos", "m_pos").withColumn("pos", F.col("sanad_end"))
    rows = asof(rows, numbers, ["book_id"], "pos", ["number"], forward=True, strict=True, prefix="next_")
    rows = rows.join(clean.select("book_id", "clean"), "book_id")
    order = W.partitionBy("book_id").orderBy("seg_id", "seq")
    stop = F.least(F.coalesce(F.lead("sanad_start").over(order), F.length("clean")), F.coalesce("next_pos", F.length("clean")), F.col("sanad_end") + params.longest)
    rows = rows.withColumn("matn_end", stop)
    return rows.select("book_id", F.coalesce("m_number", F.lit(-1)).alias("number"), "sanad_start", "sanad_end", "ended_by", "narrator_count", "narrators", F.col("sanad_end").alias("matn_start"), "matn_end", F.trim(F.substring(F.col("clean"), F.col("sanad_end") + 1, F.greatest(F.lit(0), F.col("matn_end") - F.col("sanad_end")))).alias("matn"), F.coalesce("kitab", F.lit("")).alias("kitab"), F.coalesce("bab", F.lit("")).alias("bab"))


def signals(names: Column, any_rasoul: Column) -> dict[str, Column]:
    """What speaks for a real chain, from its narrators' names."""
    joined = F.array_join(names, " ")
    words = F.filter(F.split(joined, r"\s+"), lambda w: w != "")
    praise = F.lit(False)
    for p in lexicon.folded(lexicon.HONORIFIC):
        praise = praise | joined.contains(p)
    return {"has_ibn": F.exists(words, lambda w: lexicon.is_in(w, "ibn")), "has_rasoul": any_rasoul | F.exists(words, lambda w: lexicon.is_in(w, "rasoul")) | praise, "has_nrc": F.exists(words, lexicon.is_nrc)}


def judged(hadiths: DataFrame) -> DataFrame:
    """Add ``accepted`` and, for the rest, ``reason`` to rows with number, names and any_rasoul."""
    s = signals(F.col("names"), F.col("any_rasoul"))
    df = hadiths.withColumn("accepted", (F.col("number") != -1) | s["has_ibn"] | s["has_rasoul"] | s["has_nrc"])
    return df.withColumn("reason", F.when(~F.col("accepted"), F.concat(F.lit("no ibn, honorific or narration word; "), F.size("names"), F.lit(" narrators, number=-1"))))


def clean_only(hadiths: DataFrame) -> DataFrame:
    """The stricter choice: numbered and with three narrators or more."""
    return hadiths.where((F.col("number") != -1) & (F.col("narrator_count") >= 3))


def select_topic(hadiths: DataFrame, order: list[str], numbers: list[int] | None = None, contains: str | None = None, limit: int = 10) -> DataFrame:
    """Rows with given numbers, or the first that contain a word."""
    if numbers is not None:
        wanted = hadiths.sparkSession.createDataFrame([(n,) for n in set(numbers)], "number bigint")
        return hadiths.join(F.broadcast(wanted), "number", "left_semi")
    return (hadiths.where(F.col("matn").contains(contains)) if contains else hadiths).orderBy(*order).limit(limit)


def statistics(records: DataFrame, found: int | None = None) -> DataFrame:
    """One row of counters over records: how many, numbered, with a Prophet's name, under each header, narrators, longest chain, empty matn."""
    n = F.col("narrator_count")
    return records.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("number") != -1).alias("numbered"),
        F.count_if(F.exists("narrators", lambda x: x["is_rasoul"])).alias("with_rasoul"),
        F.count_if(F.col("kitab") != "").alias("with_kitab"),
        F.count_if(F.col("bab") != "").alias("with_bab"),
        F.coalesce(F.sum(n), F.lit(0)).alias("narrators"),
        F.max(n).alias("longest"),
        F.count_if(F.col("matn") == "").alias("without_matn"),
        *([F.lit(found).alias("chains_found")] if found is not None else []),
    )
