"""Text functions as Spark columns: normalization, tokens with offsets, similarity.

All of them stay in the JVM. Offsets count code points, as Spark's length and substring do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the normal form: what is deleted, unified, and turned into a space.
DIACRITICS = "ًٌٍَُِّْٰٕٓٔ"
TATWEEL = "ـ"
ZERO_WIDTH_JOINER = "‍"
LETTERS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ا", "ؤ": "ء", "ئ": "ء", "ة": "ه"}
SYMBOLS = '"[](){}«»<>*'
#: Single-character tokens.
PUNCTUATION = ":،,.؛;؟?!()-*–—/"
#: What separates words when words in a span are counted.
DELIMITERS = " \t\r\n\u00a0:،,.؛;؟?!()[]{}-*–—/\"'"

SPACES = "\\t-\\r \\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def normalize(text: Column) -> Column:
    """Diacritics gone, letters unified, symbols as spaces, runs of white space as one space."""
    deleted = DIACRITICS + TATWEEL + ZERO_WIDTH_JOINER
    source = "".join(LETTERS) + SYMBOLS + deleted
    target = "".join(LETTERS.values()) + " " * len(SYMBOLS)
    return F.regexp_replace(F.translate(text, source, target), f"[{SPACES}]+", " ")


def normalize_word(text: Column) -> Column:
    return F.trim(normalize(text))


def index_map(text: Column) -> Column:
    """Place in the text of each character of its normal form."""
    gone = DIACRITICS + TATWEEL + ZERO_WIDTH_JOINER
    blank = F.lit("^[" + SPACES + "".join("\\" + c for c in SYMBOLS) + "]$")
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    kept = F.filter(chars, lambda x: ~F.lit(gone).contains(x["c"]))
    marked = F.transform(kept, lambda x: F.struct(x["i"].alias("i"), F.regexp_like(x["c"], blank).alias("s")))
    first = F.filter(marked, lambda x, k: ~x["s"] | (k == 0) | ~F.coalesce(F.get(marked, k - 1)["s"], F.lit(False)))
    return F.transform(first, lambda x: x["i"])


def fold_alef(word: Column) -> Column:
    """The leading alef without its carrier's form."""
    return F.regexp_replace(word, "^[أإآى]", "ا")


def is_nisba(word: Column) -> Column:
    """Adjective of origin by its shape."""
    return word.startswith("ال") & word.endswith("ي") & (F.length(word) > 3)


def is_diacritic(char: Column) -> Column:
    return char.rlike(f"^[{DIACRITICS}]$")


TOKEN = f"[{PUNCTUATION.replace('-', chr(92) + '-')}]|[^{SPACES}{PUNCTUATION.replace('-', chr(92) + '-')}]+"


def tokens_of(text: Column) -> Column:
    """Words in order; each punctuation mark is one."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def with_tokens(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """One row per token: keys, tok_idx, word, start, end.

    Between two tokens there is white space only, so offsets are running sums over the token and gap
    lengths of one split; nothing is searched for.
    """
    text = F.col(text_col)
    parts = F.regexp_extract_all(text, F.lit(f"[{SPACES}]+|{TOKEN}"), F.lit(0))
    df = df.select(*keys, F.posexplode(parts).alias("part", "word"))
    order = W.partitionBy(*keys).orderBy("part")
    df = df.withColumn("end", F.sum(F.length("word")).over(order).cast("int")).where(~F.col("word").rlike(f"^[{SPACES}]+$"))
    return df.select(*keys, (F.row_number().over(order) - 1).alias("tok_idx"), "word", (F.col("end") - F.length("word")).alias("start"), "end")


WORD_CHAR = f"[^{SPACES}{PUNCTUATION.replace('-', chr(92) + '-')}]"
#: One punctuation mark. As in the words of :func:`count_tokens`, letters are told first, since most characters are.
MARK = f"[[^a-z ]&&[{PUNCTUATION.replace('-', chr(92) + '-')}]]"
#: A token of ASCII digits only.
DIGITS = f"(?=[0-9])(?<!{WORD_CHAR})[0-9]++(?!{WORD_CHAR})"


def count_tokens(text: Column) -> Column:
    """The number of :func:`tokens_of` without making them."""
    # regexp_count would make an array of them: each becomes one character, with the white space about it
    one = F.regexp_replace(text, f"[{SPACES}]*+(?:[a-z{WORD_CHAR}]++|{MARK})[{SPACES}]*+", "x")
    return F.length(F.regexp_replace(one, f"[{SPACES}]+", ""))  # white space only where no token is


def count_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, MARK, ""))


def numbers_before(df: DataFrame, text_col: str, mark: str, keys: list[str]) -> DataFrame:
    """(keys, tok_idx, word): tokens of digits that the one-character token ``mark`` follows.

    Only these are rows: their places among the tokens are sums over the counts of the pieces between them.
    """
    pattern = f"{DIGITS}[{SPACES}]*+[{mark}]"
    df = df.withColumn("__row", F.monotonically_increasing_id()).where(F.col(text_col).rlike(pattern))
    df = df.select("__row", *keys, F.regexp_extract_all(text_col, F.lit(f"({pattern})"), F.lit(0)).alias("__m"), F.split(text_col, pattern, -1).alias("__between"))
    df = df.select("__row", *keys, F.posexplode(F.arrays_zip(F.col("__m").alias("match"), F.col("__between").alias("gap"))).alias("__part", "g")).where("g.match is not null")
    before = F.sum(count_tokens(F.col("g.gap"))).over(W.partitionBy("__row").orderBy("__part")) + 2 * F.col("__part")
    return df.select(*keys, before.cast("long").alias("tok_idx"), F.regexp_extract("g.match", "^[0-9]+", 0).alias("word"))


def is_punctuation(word: Column) -> Column:
    return (F.length(word) == 1) & F.lit(PUNCTUATION).contains(word)


def is_number(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}+$")


def to_int(digits: Column) -> Column:
    """Integer of a string of Arabic-Indic or ASCII digits."""
    return F.translate(digits, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789").try_cast("bigint")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in code points; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def cosine01(a: Column, b: Column) -> Column:
    """Cosine of two vectors moved to [0, 1]; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) / norm + 1) / 2)))


def phrase_hits(df: DataFrame, text_col: str, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, phrase): occurrences, overlapping ones too, that stand between non-letters.

    ``phrases`` (phrase, kind, ...) is a lexicon of fixed size and is broadcast; only texts that contain
    a phrase are searched for its places.
    """
    text, phrase = F.col(text_col), F.concat(F.lit("\\Q"), F.col("phrase"), F.lit("\\E(?![\\p{L}\\p{N}])"))
    # The text is split once before each place; of a text's pieces running sums give the places.
    pieces = F.split(text, F.concat(F.lit("(?<![\\p{L}\\p{N}])(?="), phrase, F.lit(")")), -1)
    joined = df.join(F.broadcast(phrases), text.contains(F.col("phrase")))
    parts = joined.select(*keys, *phrases.columns, F.regexp_like(text, F.concat(F.lit("^"), phrase)).alias("__first"), F.posexplode(pieces).alias("__part", "__piece"))
    before = F.sum(F.length("__piece")).over(W.partitionBy(*keys, *phrases.columns).orderBy("__part")) - F.length("__piece")
    hit = parts.withColumn("start", before.cast("int")).where("__part > 0 or __first")
    return hit.withColumn("end", F.col("start") + F.length("phrase")).drop("__first", "__part", "__piece")


def regex_spans(df: DataFrame, text_col: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, pos, match): matches of a pattern with their places, from the pieces between them."""
    text = F.col(text_col)
    df = df.where(text.rlike(pattern)).select(*keys, F.regexp_extract_all(text, F.lit(f"(?s)({pattern})"), F.lit(0)).alias("__m"), F.split(text, pattern, -1).alias("__between"))
    df = df.select(*keys, F.posexplode(F.arrays_zip(F.col("__m").alias("match"), F.col("__between").alias("gap"))).alias("__part", "g")).where("g.match is not null")
    before = F.sum(F.length("g.gap") + F.length("g.match")).over(W.partitionBy(*keys).orderBy("__part")) - F.length("g.match")
    return df.select(*keys, before.cast("int").alias("pos"), "g.match")


def words_inside(text: Column, s: Column, e: Column) -> Column:
    """:func:`words_between` of one span of the row's own text, in one pass over it: a word starts where a delimiter is followed by none."""
    gap = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in DELIMITERS) + "]"
    lead = F.when(s < 0, F.lit(" ")).otherwise(F.lit(""))  # the text's first character has none before it
    inside = F.concat(lead, F.substring(text, F.greatest(s, F.lit(0)).cast("int") + 1, (e - F.greatest(s, F.lit(0))).cast("int")))
    starts = F.regexp_count(inside, F.lit(f"{gap}[^{gap[1:]}"))
    return F.when(s < e, 1 + F.coalesce(starts, F.lit(0))).otherwise(0).cast("bigint")


def words_between(starts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``n_words`` to spans (keys, s, e): 1 and the word starts inside, 0 for an empty span.

    ``starts`` is (keys, pos), the places where a word begins.
    """
    from narralith.operators.joins import asof

    order = W.partitionBy(*keys).orderBy("pos")
    placed = starts.select(*keys, "pos").distinct().withColumn("nth", F.row_number().over(order))
    rows = spans.distinct()
    for side, strict in (("s", False), ("e", True)):
        rows = asof(rows, placed.withColumnRenamed("pos", side), keys, side, ["nth"], strict=strict, prefix=f"__{side}_").drop(f"__{side}_{side}")
    inside = F.coalesce("__e_nth", F.lit(0)) - F.coalesce("__s_nth", F.lit(0))
    return rows.select(*spans.columns, F.when(F.col("s") < F.col("e"), 1 + inside).otherwise(0).cast("bigint").alias("n_words"))
