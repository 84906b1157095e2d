"""Queries over texts: normal form, tokens, lexicon flags, phrases, windows over tokens."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narralith.functions import lexicon
from narralith.functions import text as T
from narralith.operators import tokens as K
from narralith.plans.registry import register, table, values

SOURCE = "".join(T.LETTERS) + T.SYMBOLS + T.DIACRITICS + T.TATWEEL + T.ZERO_WIDTH_JOINER
TARGET = "".join(T.LETTERS.values()) + " " * len(T.SYMBOLS)
SPACE = "[\\t-\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def sql_normal(x: str) -> str:
    return f"regexp_replace(translate({x}, '{SOURCE}', '{TARGET}'), '{SPACE}+', ' ', 'g')"


PUNCT = T.PUNCTUATION.replace("-", "\\-")
TOKEN = f"[{PUNCT}]|[^{SPACE[1:-1]}{PUNCT}]+"
TOKENS = f"regexp_extract_all(text, '{TOKEN}')"
#: Tokens of conversations with their places, as SQL.
TURN_TOKENS = f"""w AS (SELECT conv_id, turn, unnest({TOKENS}) AS word, generate_subscripts({TOKENS}, 1) - 1 AS tok_idx FROM conversations),
tok AS (SELECT *, length(word) = 1 AND contains('{T.PUNCTUATION}', word) AS is_punct, regexp_full_match(word, '\\d+') AS is_number, lower(word) IN ('the', 'la', 'die', 'de') AS is_ibn, lower(word) IN ('and', 'und', 'et', 'y') AS is_ab FROM w)"""


def turn_tokens(spark, d):
    """Tokens of conversations, with two small word classes in place of the Arabic ones."""
    df = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.tokens_of(F.col("text"))).alias("tok_idx", "word"))
    low = F.lower("word")
    return df.select("*", T.is_punctuation(F.col("word")).alias("is_punct"), F.col("word").rlike(r"^\d+$").alias("is_number"), low.isin("the", "la", "die", "de").alias("is_ibn"), low.isin("and", "und", "et", "y").alias("is_ab"))


@register(f"SELECT doc_id, sha256({sql_normal('text')}) AS digest, length({sql_normal('text')}) AS n FROM documents")
def normalize_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("n")).select("doc_id", F.sha2("n", 256).alias("digest"), F.length("n").cast("long").alias("n"))


WORDS = [(1, "أَحْمَدُ بْنُ  مُحَمَّدٍ"), (2, "الكوفي"), (3, "«عيسى»"), (4, "إبراهيم"), (5, "القمّي"), (6, "فاطمة"), (7, ""), (8, "رؤوف وئام"), (9, "آدم"), (10, "الي")]


@register(f"""SELECT id, trim({sql_normal('w')}) AS word, starts_with(trim({sql_normal('w')}), 'ال') AND ends_with(trim({sql_normal('w')}), 'ي') AND length(trim({sql_normal('w')})) > 3 AS nisba,
 regexp_replace(trim({sql_normal('w')}), '^[أإآى]', 'ا') AS folded FROM (VALUES {values(WORDS)}) t(id, w)""")
def normalize_arabic(spark, d):
    df = spark.createDataFrame(WORDS, "id int, w string").select("id", T.normalize_word(F.col("w")).alias("word"))
    return df.select("id", "word", T.is_nisba(F.col("word")).alias("nisba"), T.fold_alef(F.col("word")).alias("folded"))


@register(f"""WITH w AS (SELECT doc_id, unnest({TOKENS}) AS word FROM documents)
 SELECT doc_id, count(*) AS tokens, count(*) FILTER (length(word) = 1 AND contains('{T.PUNCTUATION}', word)) AS puncts, count(*) FILTER (regexp_full_match(word, '[0-9]+')) AS numbers FROM w GROUP BY doc_id""")
def token_stats(spark, d):
    text = F.col("text")
    counts = [T.count_tokens(text).alias("tokens"), T.count_marks(text).alias("puncts"), F.regexp_count(text, F.lit(T.DIGITS)).alias("numbers")]
    df = table(spark, d, "documents").select("doc_id", *counts)
    return df.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tokens", "puncts", "numbers")]).where("tokens > 0")


@register(f"""WITH p AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{SPACE}+|{TOKEN}')) AS word, generate_subscripts(regexp_extract_all(text, '{SPACE}+|{TOKEN}'), 1) AS i FROM conversations),
 e AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS BIGINT) AS e FROM p)
 SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS tok_idx, word, e - length(word) AS s, e FROM e WHERE NOT regexp_full_match(word, '{SPACE}+')""")
def token_offsets(spark, d):
    df = T.with_tokens(table(spark, d, "conversations"), "text", ["conv_id", "turn"])
    return df.select("conv_id", "turn", F.col("tok_idx").cast("long").alias("tok_idx"), "word", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


SAMPLE = [(1, "حدثنا محمد بن يحيا عن احمد بن محمد عن ابي عبد الله عليه السلام قال"), (2, "علي بن ابراهيم عن ابيه عن النوفلي"), (3, "وعنه رفعه الى رسول الله ص"), (4, "ام سلمه وعمه وجده اخبرتنا"), (5, "بلا كلمات")]


def in_list(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _cls(name: str) -> str:
    return in_list(lexicon.folded(lexicon.CLASSES[name]))


NRC_SQL = f"(word IN {_cls('nrc')} OR " + " OR ".join(f"starts_with(word, '{s}')" for s in lexicon.folded(lexicon.NRC_STEMS)) + ")"


@register(f"""WITH w AS (SELECT id, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) - 1 AS i FROM (VALUES {values(SAMPLE)}) x(id, t))
 SELECT id, i, word, {NRC_SQL} AS is_nrc, word IN {_cls('ibn')} AS is_ibn, word IN {_cls('ab')} AS is_ab, word IN {_cls('om')} AS is_om,
 word IN {_cls('ibn')} OR word IN {_cls('ab')} OR word IN {_cls('om')} OR word IN {_cls('family')} AS is_nmc, word IN {_cls('rasoul')} AS is_rasoul, word IN {_cls('relative')} AS is_relative FROM w""")
def lexicon_flags(spark, d):
    df = spark.createDataFrame(SAMPLE, "id int, t string").select("id", F.posexplode(F.split("t", " ")).alias("i", "word"))
    return df.select("id", F.col("i").cast("long").alias("i"), "word", *[c.alias(n) for n, c in lexicon.flags(F.col("word")).items()])


STEMS = ["th", "er", "on", "in", "qu", "aus"]


@register(f"""WITH w AS (SELECT DISTINCT lower(unnest({TOKENS})) AS word FROM conversations)
 SELECT stem, count(*) AS words FROM w JOIN (VALUES {values([(s,) for s in STEMS])}) s(stem) ON starts_with(word, stem) GROUP BY stem""")
def prefix_stem_match(spark, d):
    words = table(spark, d, "conversations").select(F.explode(T.tokens_of(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    stems = F.array(*map(F.lit, STEMS))  # a lexicon of fixed size: no join needed
    return words.select(F.explode(F.filter(stems, lambda s: F.col("word").startswith(s))).alias("stem")).groupBy("stem").agg(F.count("*").alias("words"))


PHRASES = ["of the", "in the", "de la", "and the", "the"]


@register(f"""WITH hit AS (SELECT conv_id, turn, phrase, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(phrase)) = phrase)) AS s, text FROM conversations, (VALUES {values([(p,) for p in PHRASES])}) p(phrase) WHERE contains(text, phrase))
 SELECT conv_id, turn, phrase, s, s + length(phrase) AS e FROM hit WHERE (s = 0 OR NOT regexp_full_match(substr(text, s, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_full_match(substr(text, s + length(phrase) + 1, 1), '[\\p{{L}}\\p{{N}}]')""")
def phrase_hits(spark, d):
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    hits = T.phrase_hits(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", phrases, ["conv_id", "turn"])
    return hits.select("conv_id", "turn", "phrase", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


@register(f"""WITH hit AS (SELECT conv_id, turn, phrase, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(phrase)) = phrase)) AS s, text FROM conversations, (VALUES {values([(p,) for p in PHRASES[:3]])}) p(phrase) WHERE contains(text, phrase)),
 ok AS (SELECT conv_id, turn, s, s + length(phrase) AS e FROM hit WHERE (s = 0 OR NOT regexp_full_match(substr(text, s, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_full_match(substr(text, s + length(phrase) + 1, 1), '[\\p{{L}}\\p{{N}}]')),
 p AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{SPACE}+|{TOKEN}')) AS word, generate_subscripts(regexp_extract_all(text, '{SPACE}+|{TOKEN}'), 1) AS i FROM conversations),
 t AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS BIGINT) AS te FROM p)
 SELECT t.conv_id, t.turn, t.word, te - length(word) AS s, count(*) AS phrases FROM t JOIN ok ON ok.conv_id = t.conv_id AND ok.turn = t.turn AND te - length(word) < ok.e AND te > ok.s WHERE NOT regexp_full_match(word, '{SPACE}+') GROUP BY ALL""")
def phrase_token_flags(spark, d):
    from narralith.operators.joins import interval_pairs

    conv, keys = table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"]
    hits = T.phrase_hits(conv, "text", spark.createDataFrame([(p,) for p in PHRASES[:3]], "phrase string"), keys).select(*keys, F.col("start").alias("p_s"), (F.col("end") - 1).alias("p_e"))
    toks = T.with_tokens(conv, "text", keys).select(*keys, "word", F.col("start").alias("t_s"), (F.col("end") - 1).alias("t_e"))
    both = interval_pairs(toks, hits, keys, 256, "t_s", "t_e", "p_s", "p_e")
    return both.groupBy(*keys, "word", F.col("t_s").cast("long").alias("s")).agg(F.count("*").alias("phrases"))


@register(f"""WITH {TURN_TOKENS}, n AS (SELECT *, coalesce(lag(is_ab) OVER o, false) AS pa, coalesce(lead(is_ibn) OVER o, false) AS ni FROM tok WINDOW o AS (PARTITION BY conv_id, turn ORDER BY tok_idx))
 SELECT conv_id, turn, tok_idx, word FROM n WHERE NOT (is_punct OR is_number OR is_ibn OR is_ab) AND (pa OR ni)""")
def context_name_rule(spark, d):
    df = turn_tokens(spark, d)
    for c in ("is_name", "is_nrc", "is_rasoul"):
        df = df.withColumn(c, F.lit(False))
    df = K.context_names(df.withColumn("is_nmc", F.col("is_ibn") | F.col("is_ab")), ["conv_id", "turn"])
    return df.where("is_name").select("conv_id", "turn", F.col("tok_idx").cast("long").alias("tok_idx"), "word")


@register(f"""WITH {TURN_TOKENS}, n AS (SELECT *, last_value(CASE WHEN NOT is_punct AND NOT is_number THEN word END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM tok)
 SELECT conv_id, turn, tok_idx, word, prev, coalesce(lower(prev) IN ('the', 'la', 'die', 'de'), false) AS after_connector FROM n WHERE is_punct""")
def prev_word_skip_punct(spark, d):
    w = W.partitionBy("conv_id", "turn").orderBy("tok_idx").rowsBetween(W.unboundedPreceding, -1)
    prev = F.last(F.when(~F.col("is_punct") & ~F.col("is_number"), F.col("word")), True).over(w)
    df = turn_tokens(spark, d).withColumn("prev", prev).where("is_punct")
    return df.select("conv_id", "turn", F.col("tok_idx").cast("long").alias("tok_idx"), "word", "prev", F.coalesce(F.lower("prev").isin("the", "la", "die", "de"), F.lit(False)).alias("after_connector"))


@register(f"""WITH {TURN_TOKENS}, c AS (SELECT *, NOT (is_punct OR is_number OR is_ibn OR is_ab) AND length(word) >= 3 AND word <> lower(word) AS cand,
  last_value(CASE WHEN NOT is_punct AND NOT is_number THEN is_ibn OR is_ab END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN NOT is_punct AND NOT is_number THEN is_ibn OR is_ab END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY tok_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM tok)
 SELECT conv_id, turn, tok_idx, word FROM c WHERE cand AND (coalesce(p, false) OR coalesce(n, false))""")
def candidate_promotion(spark, d):
    df = turn_tokens(spark, d).withColumn("is_nmc", F.col("is_ibn") | F.col("is_ab"))
    free = ~(F.col("is_punct") | F.col("is_number") | F.col("is_nmc"))
    df = df.withColumn("is_nrc", F.lit(False)).withColumn("is_name", F.lit(False)).withColumn("has_enclitic", F.lit(False)).withColumn("is_name_candidate", free & (F.col("word") != F.lower("word")))
    return K.promote_candidates(df, ["conv_id", "turn"]).where("is_name").select("conv_id", "turn", F.col("tok_idx").cast("long").alias("tok_idx"), "word")


@register(f"""WITH w AS (SELECT doc_id, unnest({TOKENS}) AS word, generate_subscripts({TOKENS}, 1) AS i FROM documents),
 n AS (SELECT doc_id, i, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM w) SELECT doc_id, i - 1 AS tok_idx, word AS number FROM n WHERE regexp_full_match(word, '[0-9]+') AND nxt = '-'""")
def paragraph_delims(spark, d):
    found = T.numbers_before(table(spark, d, "documents").select("doc_id", "text"), "text", "-", ["doc_id"])
    return found.select("doc_id", "tok_idx", F.col("word").alias("number"))


@register("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+)[ \\t\\n]*-', 0)) AS m, generate_subscripts(regexp_extract_all(text, '([0-9]+)[ \\t\\n]*-', 0), 1) AS i FROM documents)
 SELECT doc_id, i - 1 AS seq, m AS marker, TRY_CAST(regexp_extract(m, '^[0-9]+') AS BIGINT) AS number FROM m""")
def number_markers(spark, d):
    df = table(spark, d, "documents")
    pattern = r"[0-9]+[ \t\n]*-"
    spans = T.regex_spans(df, "text", pattern, ["doc_id"])
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return spans.select("doc_id", seq.cast("long").alias("seq"), F.col("match").alias("marker"), T.to_int(F.regexp_extract("match", "^[0-9]+", 0)).alias("number"))


@register("SELECT doc_id, substr(text, 1, 120) AS preview, md5(text) AS cache_key, text = '' AS blank FROM documents WHERE contains(text, 'token') ORDER BY doc_id LIMIT 10")
def select_topic_docs(spark, d):
    df = table(spark, d, "documents").where(F.col("text").contains("token")).orderBy("doc_id").limit(10)
    return df.select("doc_id", F.substring("text", 1, 120).alias("preview"), F.md5("text").alias("cache_key"), (F.col("text") == "").alias("blank"))


@register("""SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS verdict, CASE WHEN quality = 1 THEN NULL ELSE 'quality 0: ' || substr(text, 1, 120) END AS reason FROM documents JOIN labels USING (doc_id)""")
def accept_reject_split(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    good = F.col("quality") == 1
    return df.select("doc_id", F.when(good, "accepted").otherwise("rejected").alias("verdict"), F.when(~good, F.concat(F.lit("quality 0: "), F.substring("text", 1, 120))).alias("reason"))


HADITHS = [(1, 5, "زيد عمرو", False), (2, -1, "محمد بن علي", False), (3, -1, "زيد عمرو", False), (4, -1, "زيد", True), (5, -1, "جعفر عليه السلام", False), (6, -1, "اخبرنا زيد", False), (7, -1, "", False)]
OK = "number <> -1 OR ras OR len(list_filter(string_split(names, ' '), lambda word: word IN {ibn} OR word IN {ras} OR {nrc})) > 0 OR {praise}".format(ibn=_cls("ibn"), ras=_cls("rasoul"), nrc=NRC_SQL, praise=" OR ".join(f"contains(names, '{p}')" for p in lexicon.folded(lexicon.HONORIFIC)))


@register(f"SELECT id, number FROM (VALUES {values(HADITHS)}) t(id, number, names, ras) WHERE {OK}")
def quality_accept(spark, d):
    from narralith.operators.segment import judged

    df = spark.createDataFrame(HADITHS, "id int, number int, n string, any_rasoul boolean").withColumn("names", F.array("n"))
    return judged(df).where("accepted").select("id", "number")


@register(f"SELECT id, 'no ibn, honorific or narration word; 1 narrators, number=-1' AS reason FROM (VALUES {values(HADITHS)}) t(id, number, names, ras) WHERE NOT ({OK})")
def quality_reject(spark, d):
    from narralith.operators.segment import judged

    df = spark.createDataFrame(HADITHS, "id int, number int, n string, any_rasoul boolean").withColumn("names", F.array("n"))
    return judged(df).where("not accepted").select("id", "reason")


BOOK = "1 - حدثنا محمد بن يحيا عن احمد بن محمد بن عيسا عن ابن ابي عمير عن ابي عبد الله عليه السلام قال: الحمد لله رب العالمين . 2 - علي بن ابراهيم عن ابيه عن النوفلي عن السكوني عن رسول الله صلى الله عليه واله قال: طلب العلم . "


#: The records of the two books, read off the output and checked by hand. The second narration of each has two narrators before
#: five words without a name end it, fewer than a chain needs; a copy of the book is 218 characters further on.
FOUND = [(b, 1, 4 + at, 91 + at, "rasoul", 4, "محمد بن يحيا < احمد بن محمد بن عيسا < ابن ابي عمير < ابي عبد الله", "قال: الحمد لله رب العالمين .", "", "") for b, at in (("a", 0), ("b", 0), ("b", 218), ("b", 436))]


@register(f"SELECT * FROM (VALUES {values(FOUND)}) t(book_id, number, sanad_start, sanad_end, ended_by, narrator_count, chain, matn, kitab, bab)")
def hadith_segments(spark, d):
    from narralith.operators.segment import records

    books = spark.createDataFrame([("a", BOOK), ("b", BOOK * 3)], "book_id string, raw string")
    return records(books).select("book_id", "number", "sanad_start", "sanad_end", "ended_by", "narrator_count", F.array_join(F.transform("narrators", lambda n: n["name"]), " < ").alias("chain"), "matn", "kitab", "bab")
