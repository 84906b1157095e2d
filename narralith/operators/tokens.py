"""Token enrichment by neighbours: windows over a book's tokens in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narralith.functions import lexicon
from narralith.functions import text as T

FLAGS = ["is_name", "is_nrc", "is_nmc", "is_ibn", "is_ab", "is_om", "is_rasoul", "is_relative", "is_punct", "is_number"]


def _order(keys: list[str]):
    return W.partitionBy(*keys).orderBy("tok_idx")


def with_classes(tokens: DataFrame, waw: bool = True) -> DataFrame:
    """Shape and class flags; a leading waw before a class word is stripped when ``waw``."""
    word = F.col("word")
    df = tokens.withColumn("is_punct", T.is_punctuation(word)).withColumn("is_number", T.is_number(word))
    plain = ~F.col("is_punct") & ~F.col("is_number")
    rest = F.expr("substring(word, 2)")
    cut = plain & word.startswith("و") & (F.length(word) > 2) & (lexicon.is_in(rest, "ibn") | lexicon.is_in(rest, "ab") | lexicon.is_nrc(rest) | lexicon.is_in(rest, "relative"))
    df = df.withColumn("has_waw", cut if waw else F.lit(False))
    df = df.withColumn("word", F.when(F.col("has_waw"), rest).otherwise(word)).withColumn("start", F.when(F.col("has_waw"), F.col("start") + 1).otherwise(F.col("start")))
    for name, flag in lexicon.flags(F.col("word")).items():
        df = df.withColumn(name, plain & flag)
    for name, kind in (("is_name", "boolean"), ("is_name_candidate", "boolean"), ("has_enclitic", "boolean"), ("lemma", "string"), ("pos", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(False if kind == "boolean" else None).cast(kind))
    closed = F.col("is_nrc") | F.col("is_nmc") | F.col("is_rasoul")
    return df.withColumn("is_name", F.col("is_name") & ~closed).withColumn("is_name_candidate", F.col("is_name_candidate") & ~closed)


def with_phrase_flags(tokens: DataFrame, hits: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """Stamp phrases (keys, p_start, p_end, kind) on the tokens they touch: rasoul first, then compound names."""
    from narralith.operators.joins import interval_pairs

    spans = hits.select(*keys, F.col("start").alias("p_s"), (F.col("end") - 1).alias("p_e"), "kind")
    t = tokens.select(*keys, "tok_idx", F.col("start").alias("t_s"), (F.col("end") - 1).alias("t_e"))
    touched = interval_pairs(t, spans, keys, width, "t_s", "t_e", "p_s", "p_e").groupBy(*keys, "tok_idx").agg(F.max(F.col("kind") == "rasoul").alias("__r"), F.max(F.col("kind") == "compound").alias("__c"))
    df = tokens.join(touched, [*keys, "tok_idx"], "left").fillna(False, ["__r", "__c"])
    df = df.withColumn("is_rasoul", F.col("is_rasoul") | F.col("__r")).withColumn("is_name", (F.col("is_name") & ~F.col("__r")) | F.col("__c")).withColumn("is_nrc", F.col("is_nrc") & ~F.col("__c"))
    return df.drop("__r", "__c")


def promote_candidates(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Name candidates whose surroundings expect a name become names.

    A nisba may lean on a name before it that was promoted in the same pass. Runs of such nisbas are
    resolved as islands: all of a run follow from the token before it.
    """
    o = _order(keys)
    plain = ~F.col("is_punct") & ~F.col("is_number")
    seen = F.when(plain, F.struct("is_nmc", "is_nrc", "is_name", "tok_idx"))
    df = tokens.withColumn("__p", F.last(seen, True).over(o.rowsBetween(W.unboundedPreceding, -1))).withColumn("__n", F.first(seen, True).over(o.rowsBetween(1, W.unboundedFollowing)))
    able = F.col("is_name_candidate") & ~F.col("is_name") & (F.length("word") >= 3) & ~F.col("has_enclitic")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    sure = able & (flag("__p.is_nmc") | flag("__p.is_nrc") | flag("__n.is_nmc"))
    df = df.withColumn("__sure", sure).withColumn("__may", able & T.is_nisba(F.col("word")) & ~sure)
    # The last token that is not itself a doubtful nisba decides for all that follow it directly.
    base = F.when(plain & ~F.col("__may"), F.col("is_name") | F.col("__sure"))
    df = df.withColumn("__base", F.last(base, True).over(o.rowsBetween(W.unboundedPreceding, -1)))
    df = df.withColumn("is_name", F.col("is_name") | F.col("__sure") | (F.col("__may") & flag("__base")))
    return df.drop("__p", "__n", "__sure", "__may", "__base")


def context_names(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Unclassed words beside name connectors become names; adjacent tokens count, punctuation too."""
    o = _order(keys)
    near = lambda c, k: F.coalesce(F.lag(c, k).over(o) if k > 0 else F.lead(c, -k).over(o), F.lit(False))
    none = ~(F.col("is_name") | F.col("is_nmc") | F.col("is_nrc") | F.col("is_punct") | F.col("is_number") | F.col("is_rasoul"))
    return tokens.withColumn("is_name", F.col("is_name") | (none & (near("is_ab", 1) | near("is_ibn", -1))))


def with_lookaround(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Columns the automata look up: whether a colon and no chain word follows, and paragraph marks."""
    o = _order(keys)
    chainy = F.when(~F.col("is_punct") & ~F.col("is_number"), F.col("is_nrc") | F.col("is_name") | F.col("is_nmc") | F.col("is_relative"))
    after = F.first(chainy, True).over(o.rowsBetween(2, W.unboundedFollowing))
    return tokens.withColumn("matn_start", F.coalesce((F.lead("word").over(o) == ":") & ~F.coalesce(after, F.lit(False)), F.lit(False))).withColumn("paragraph_at", F.when(F.col("is_number") & (F.lead("word").over(o) == "-"), F.coalesce(F.lead("start", 2).over(o), F.lead("start").over(o))))


def with_segments(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``seg_id``: numbers so far; between two of them the hadith automaton keeps no state."""
    return tokens.withColumn("seg_id", F.count_if("is_number").over(_order(keys)))


def analyzed(books: DataFrame, keys: list[str], text_col: str = "clean", lexicon_only: bool = False) -> DataFrame:
    """The whole enrichment of normalized texts, in its fixed order."""
    spark = books.sparkSession
    tokens = with_classes(T.with_tokens(books, text_col, keys), waw=not lexicon_only)
    phrases = spark.createDataFrame([(p, k) for k, c in (("rasoul", "rasoul"), ("compound", "compound")) for p in lexicon.folded(lexicon.CLASSES[c])], "phrase string, kind string")
    tokens = with_phrase_flags(tokens, T.phrase_hits(books.select(*keys, text_col), text_col, phrases, keys), keys)
    if not lexicon_only:
        tokens = promote_candidates(tokens, keys)
    return with_lookaround(context_names(tokens, keys), keys)
