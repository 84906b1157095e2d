"""Closed word classes of the narration profile, as data, and the flags they give to tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralith.functions.text import DIACRITICS, LETTERS

# The words and phrases of each class.
NRC_STEMS = ["حدث", "اخبر", "انبا", "نبا", "سمع", "روى", "روي", "ذكر"]
NRC_PARTICLES = ["عن", "قال", "يقول"]
NRC_SPECIAL = ["رفعه", "يرفعه", "باسناده"]
IBN = ["بن", "ابن", "ابنه", "بنت", "ابنة"]
AB = ["ابو", "ابي", "ابا"]
OM = ["ام"]
FAMILY = ["جد", "جده", "جدته", "عم", "عمه", "خال", "خاله", "اخو", "اخي", "اخيه", "مولى", "مولي"]
RASOUL = ["رسول الله", "الرسول", "النبي", "ص"]
HONORIFIC = ["صلى الله عليه وسلم", "صلى الله عليه وعلى اله", "صلى الله عليه واله", "عليه السلام", "عليهم السلام", "عليهما السلام", "عليها السلام", "رضي الله عنه", "رضي الله عنها", "رضي الله عنهما", "رحمه الله"]
IMAM_KUNYA = ["ابي عبد الله", "ابي جعفر", "ابي الحسن", "ابي ابراهيم", "ابي محمد"]
COMPOUND = ["عدة من اصحابنا", "بعض اصحابنا", "غير واحد", "جماعة"]
RELATIVE = ["ابيه", "ابيهم", "ابيهما", "جده", "عنه"]
RELATIVE_SUFFIXES = ["ه", "هم", "هما"]
PROPHET = ["رسول", "الرسول", "النبي", "ص"]
MATN_CUES = ["قال", "قالت", "قالوا", "يقول", "قلت", "سالته", "سالت", "كتبت", "سمعته"]

_FOLD = str.maketrans(LETTERS) | {ord(c): None for c in DIACRITICS}


def folded(words: list[str]) -> list[str]:
    """The words in normal form, without repeats."""
    return list(dict.fromkeys(w.translate(_FOLD) for w in words))


CLASSES = {
    "nrc_stem": NRC_STEMS,
    "nrc": NRC_PARTICLES + NRC_SPECIAL,
    "ibn": IBN,
    "ab": AB,
    "om": OM,
    "family": FAMILY,
    "rasoul": RASOUL + HONORIFIC,
    "compound": COMPOUND + IMAM_KUNYA,
    "relative": RELATIVE,
    "relative_suffix": RELATIVE_SUFFIXES,
    "prophet": PROPHET,
    "honorific": sorted({w for p in HONORIFIC for w in p.split()}),
}


def lexicon(spark: SparkSession) -> DataFrame:
    """(class, term, match): one row per term."""
    rows = [(c, t, "prefix" if c == "nrc_stem" else "suffix" if c == "relative_suffix" else "phrase" if " " in t else "word") for c, terms in CLASSES.items() for t in folded(terms)]
    return spark.createDataFrame(rows, "class string, term string, match string")


def is_in(word: Column, name: str) -> Column:
    return word.isin(folded(CLASSES[name]))


def is_nrc(word: Column) -> Column:
    """A narration word: a particle, or any word that begins with one of the verbs' stems."""
    return is_in(word, "nrc") | word.rlike("^(?:" + "|".join(folded(NRC_STEMS)) + ")")


def flags(word: Column) -> dict[str, Column]:
    """Class flags of a word in normal form."""
    ibn, ab, om = (is_in(word, c) for c in ("ibn", "ab", "om"))
    return {"is_nrc": is_nrc(word), "is_ibn": ibn, "is_ab": ab, "is_om": om, "is_nmc": ibn | ab | om | is_in(word, "family"), "is_rasoul": is_in(word, "rasoul"), "is_relative": is_in(word, "relative")}
