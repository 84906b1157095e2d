"""Books, narration records, graphs and gold annotations: readers with fixed schemas and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<text:string,start:int,end:int,learned:boolean,kind:string>"
NARRATOR = f"struct<name:string,start:int,end:int,is_rasoul:boolean,is_relative:boolean,parts:array<{PART}>>"
HADITH = f"number int, sanad struct<narrator_count:int,start:int,end:int,narrators:array<{NARRATOR}>>, matn struct<start:int,end:int,text:string>, kitab string, bab string"
GROUP = "struct<name:string,key:string,size:bigint,levels:array<array<array<string>>>,qualifiers:array<string>,is_rasoul:boolean,is_relative:boolean>"
PERSON = f"struct<id:bigint,primary_name:string,names:array<string>,rank:int,is_rasoul:boolean,occurrences:bigint,groups:array<{GROUP}>,parents:array<bigint>,children:array<bigint>,biography_refs:array<string>,books:array<string>>"
GRAPH = f"params struct<equality_threshold:double,equality_radius:int,qualifiers_mode:string,break_cycles:boolean,merged_books:boolean>, persons array<{PERSON}>"
GOLD = "format_version int, kind string, source string, text_sha256 string, reviewed boolean, annotator string, items array<struct<main:array<int>,names:array<array<int>>,persons:array<string>,note:string>>"
PAIRS = "source string, annotator string, reviewed boolean, pairs array<struct<a:string,b:string,equal:boolean>>"
MERGE = "source string, annotator string, reviewed boolean, note string, labels map<string,string>"
KINDS = ["ibn", "ab", "om", "family", "possessive", "other"]


class GoldError(Exception):
    """Gold that may not be scored against."""


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, raw): one whole text per file, any line end as a line feed, undecodable bytes replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("book_id"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("raw"))


def read_hadiths(spark: SparkSession, *paths: str) -> DataFrame:
    """Records with the file that each is from as ``book``."""
    df = spark.read.schema(HADITH).option("multiLine", True).json(list(paths))
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)*$", 1).alias("book"))


def occurrences(hadiths: DataFrame, order: list[str]) -> DataFrame:
    """(chain_id, position, name, parts, is_rasoul, is_relative, number, book): narrators in order; unknown kinds are 'other', none is a name."""
    from narralith.operators.graph import numbered

    df = numbered(hadiths.select("book", "number", F.col("sanad.start").alias("at"), "sanad.narrators"), ["book", *order], "chain_id")
    df = df.select("chain_id", "book", "number", F.posexplode("narrators").alias("position", "n"))
    kind = lambda p: F.when(p["kind"].isNull(), "name").when(p["kind"].isin(KINDS), p["kind"]).otherwise("other")
    return df.select("chain_id", "position", F.col("n.name").alias("name"), F.transform("n.parts", lambda p: F.struct(p["text"].alias("text"), kind(p).alias("kind"))).alias("parts"), F.col("n.is_rasoul").alias("is_rasoul"), F.col("n.is_relative").alias("is_relative"), "number", "book")


def write_hadiths(records: DataFrame, path: str) -> None:
    """JSON lines of the records' exchange form."""
    records.select("number", F.struct(F.col("narrator_count").alias("narrator_count"), F.col("sanad_start").alias("start"), F.col("sanad_end").alias("end"), "narrators").alias("sanad"), F.struct(F.col("matn_start").alias("start"), F.col("matn_end").alias("end"), F.col("matn").alias("text")).alias("matn"), "kitab", "bab").write.mode("overwrite").json(path)


def chain_lines(records: DataFrame) -> DataFrame:
    """(line): a readable form of each record, with tags and the matn's first 300 characters."""
    tag = lambda n: F.concat(n["name"], F.when(n["is_rasoul"], " [RASOUL]").otherwise(""), F.when(n["is_relative"], " [relative]").otherwise(""))
    return records.select(F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), F.array_join(F.transform("narrators", tag), " <- "), F.lit(" :: "), F.substring("matn", 1, 300)).alias("line"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """One row per person, of a graph's one document or of the lines that :func:`write_graph` writes."""
    jvm = spark._jvm
    lines = jvm.org.apache.hadoop.fs.Path(f"{path}/persons")
    if lines.getFileSystem(spark._jsc.hadoopConfiguration()).exists(lines):
        return spark.read.schema(f"p {PERSON}").json(f"{path}/persons").select("p.*")
    return spark.read.schema(GRAPH).option("multiLine", True).json(path).select(F.explode("persons").alias("p")).select("p.*")


def graph_edges(persons: DataFrame) -> DataFrame:
    return persons.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))


def person_forms(persons: DataFrame) -> DataFrame:
    """(person_id, canon): canonical forms exactly as saved."""
    item = lambda x: F.struct(F.get(x, F.lit(0)).alias("text"), F.get(x, F.lit(1)).alias("kind"))
    g = persons.select(F.col("id").alias("person_id"), F.explode("groups").alias("g"))
    return g.select("person_id", F.struct(F.transform("g.levels", lambda v: F.transform(v, item)).alias("levels"), F.col("g.qualifiers").alias("qualifiers"), F.coalesce("g.is_rasoul", F.lit(False)).alias("is_rasoul"), F.coalesce("g.is_relative", F.lit(False)).alias("is_relative"), F.col("g.name").alias("raw")).alias("canon"))


def index_counters(persons: DataFrame) -> DataFrame:
    """One row: persons, their forms, how many come exactly as saved, and how many must be read from the name again."""
    g = persons.select("id", F.explode_outer("groups").alias("g"))
    exact = F.coalesce(F.size("g.levels"), F.lit(0)) > 0
    named = F.coalesce(F.col("g.name"), F.lit("")) != ""
    return g.agg(F.countDistinct("id").alias("persons"), F.count("g").alias("forms"), F.count_if(exact).alias("exact"), F.count_if(F.col("g").isNotNull() & ~exact & named).alias("reparsed"))


def write_graph(persons: DataFrame, path: str, **params) -> None:
    """JSON lines of persons beside a line of parameters; a single document per graph is for small graphs only."""
    persons.select(F.struct("*").alias("p")).write.mode("overwrite").json(f"{path}/persons")
    persons.sparkSession.createDataFrame([(str(k), str(v)) for k, v in params.items()] or [("", "")], "name string, value string").write.mode("overwrite").json(f"{path}/params")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).option("multiLine", True).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MERGE).option("multiLine", True).json(path)


def checked(gold: DataFrame, text: str | None = None) -> DataFrame:
    """The gold itself, or an error when it was not reviewed, is for another text, or has no content."""
    import hashlib

    one = F.lit(1)
    tests = [F.count(one).alias("rows"), F.count_if(~F.coalesce("reviewed", F.lit(False))).alias("unreviewed")]
    if text is not None:
        tests.append(F.count_if(~F.coalesce(F.col("text_sha256") == hashlib.sha256(text.encode()).hexdigest(), F.lit(False))).alias("foreign"))
    if "pairs" in gold.columns:
        tests.append(F.count_if(F.coalesce(F.exists("pairs", lambda p: p["equal"].isNotNull()), F.lit(False))).alias("labelled"))
    if "labels" in gold.columns:
        tests.append(F.count_if(F.coalesce(F.size("labels"), F.lit(0)) > 0).alias("labelled"))
    found = gold.agg(*tests).first().asDict()
    if not found["rows"] or found["unreviewed"]:
        raise GoldError("the annotations have not been reviewed")
    if found.get("foreign"):
        raise GoldError("the annotations belong to another text")
    if found.get("labelled") == 0:
        raise GoldError("no pair or occurrence has a label")
    return gold


def gold_spans(gold: DataFrame) -> DataFrame:
    """(unit, s, e, names, persons, note)."""
    return gold.select(F.posexplode("items").alias("unit", "i")).select("unit", F.get("i.main", F.lit(0)).alias("s"), F.get("i.main", F.lit(1)).alias("e"), F.transform("i.names", lambda n: F.struct(F.get(n, F.lit(0)).alias("s"), F.get(n, F.lit(1)).alias("e"))).alias("names"), "i.persons", "i.note")


def seed(rows: DataFrame, kind: str, source: str, text: str) -> DataFrame:
    """Unreviewed gold from found units (s, e, names array<struct<s,e>>), for a person to correct."""
    item = F.struct(F.array("s", "e").alias("main"), F.transform("names", lambda n: F.array(n["s"], n["e"])).alias("names"), F.lit(None).cast("array<string>").alias("persons"), F.lit("").alias("note"))
    return rows.select(F.struct("s", item.alias("item")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items")).select(F.lit(1).alias("format_version"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.sha2(F.lit(text), 256).alias("text_sha256"), F.lit(False).alias("reviewed"), F.lit("").alias("annotator"), "items")


def imported_gold(spans: DataFrame, text: str, kind: str, source: str, annotator: str = "") -> DataFrame:
    """Reviewed gold from spans of annotation files: (main_start, main_end, names array<struct<start,end>>) or (start, end)."""
    if "names" in spans.columns:
        rows = spans.select(F.col("main_start").alias("s"), F.col("main_end").alias("e"), F.transform("names", lambda n: F.struct(n["start"].alias("s"), n["end"].alias("e"))).alias("names"))
    else:
        rows = spans.select(F.col("start").alias("s"), F.col("end").alias("e"), F.array().cast("array<struct<s:int,e:int>>").alias("names"))
    return seed(rows, kind, source, text).withColumns({"reviewed": F.lit(True), "annotator": F.lit(annotator)})


def save_gold(gold: DataFrame, path: str) -> None:
    """Gold as JSON; persons that are all unknown and empty notes are left out."""
    keep = lambda i: F.struct(i["main"].alias("main"), i["names"].alias("names"), F.when(F.exists(i["persons"], lambda p: p.isNotNull()), i["persons"]).alias("persons"), F.when(i["note"] != "", i["note"]).alias("note"))
    whole = gold.withColumn("items", F.transform("items", keep)) if "items" in gold.columns else gold
    whole.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def save_report(result: DataFrame, path: str, title: str) -> None:
    """An evaluation's figures twice: JSON rows in ``result``, and a line of text for each in ``report``."""
    result.write.mode("overwrite").json(f"{path}/result")
    figures = F.concat_ws("  ", *[F.concat(F.lit(f"{c} "), F.coalesce((F.round(c, 4) if k in ("double", "float") else F.col(f"`{c}`")).cast("string"), F.lit("-"))) for c, k in result.dtypes])
    result.select(F.concat(F.lit(f"{title}: "), figures).alias("value")).write.mode("overwrite").text(f"{path}/report")
