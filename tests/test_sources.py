import json
import struct

import pytest

from narralith.sources import annotation_binary as A
from narralith.sources import json_files as J


def qstr(s):
    return struct.pack(">I", A.NULL) if s is None else struct.pack(">I", 2 * len(s)) + s.encode("utf-16-be")


SPANS = struct.pack(">I", 2) + struct.pack(">iiii", 1, 5, 7, 9)
CHAIN = b"A" + struct.pack(">i", 2) + b"a" + b"\0" + struct.pack(">i", 2) + b"N\0" + struct.pack(">ii", 1, 3) + b"c" + struct.pack(">qqB", 0, 0, 1) + struct.pack(">ii", 4, 6) + b"p" + struct.pack(">qq", 7, 8)
TWO = struct.pack(">i", 1) + struct.pack(">ii", 0, 20) + SPANS + CHAIN


def test_binary_layouts(spark, tmp_path):
    (tmp_path / "a.tags").write_bytes(SPANS)
    (tmp_path / "b.tags").write_bytes(TWO)
    (tmp_path / "c.equal").write_bytes(struct.pack(">I", 1) + qstr("محمد") + qstr(None) + b"\1")
    assert sorted((r.s, r.e) for r in A.read(spark, f"{tmp_path}/a.tags", "flat").collect()) == [(1, 5), (7, 9)]
    r = A.read(spark, f"{tmp_path}/b.tags").first()
    assert (r.s, r.e, [(n.s, n.e) for n in r.names], [(c.s, c.e) for c in r.chain]) == (0, 20, [(1, 5), (7, 9)], [(1, 6)])
    r = A.read(spark, f"{tmp_path}/c.equal", "equal").first()
    assert (r.a, r.b, r.equal) == ("محمد", None, True)


@pytest.mark.parametrize("data,why", [(SPANS[:-1], "left"), (SPANS + b"x", "after the end")])
def test_broken_flat(data, why):
    with pytest.raises(A.FormatError, match=why):
        A.flat(data)


def test_broken_strings_and_tags():
    with pytest.raises(A.FormatError, match="odd"):
        A.Cursor(struct.pack(">I", 3) + b"abc").string()
    with pytest.raises(A.FormatError, match="tag"):
        A.Cursor(b"Z").chain()


def test_books_and_records(spark, tmp_path):
    (tmp_path / "k.txt").write_bytes("a\r\nb\rc".encode() + b"\xff")
    r = J.read_books(spark, f"{tmp_path}/k.txt").first()
    assert r.book_id == "k" and r.raw.startswith("a\nb\nc")
    rec = [{"number": 3, "sanad": {"narrator_count": 1, "start": 0, "end": 9, "narrators": [{"name": "علي بن محمد", "parts": [{"text": "علي"}, {"text": "بن", "kind": "ibn"}, {"text": "x", "kind": "odd"}], "is_rasoul": False}]}, "matn": {"start": 9, "end": 12, "text": "abc"}}]
    (tmp_path / "h.json").write_text(json.dumps(rec))
    occ = J.occurrences(J.read_hadiths(spark, f"{tmp_path}/h.json"), ["at"]).first()
    assert (occ.chain_id, occ.position, occ.book, [p.kind for p in occ.parts]) == (0, 0, "h", ["name", "ibn", "other"])


def test_graph_round_trip(spark, tmp_path):
    person = {"id": 1, "primary_name": "a", "groups": [{"name": "a", "key": "a", "levels": [[["a", "name"]]], "qualifiers": []}], "parents": [2], "children": []}
    (tmp_path / "g.json").write_text(json.dumps({"params": {"equality_threshold": 0.1}, "persons": [person]}))
    g = J.read_graph(spark, f"{tmp_path}/g.json")
    assert [(r.child, r.parent) for r in J.graph_edges(g).collect()] == [(1, 2)]
    assert J.person_forms(g).first().canon.levels[0][0].text == "a"


def test_gold_guard(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"reviewed": False, "items": []}))
    with pytest.raises(J.GoldError):
        J.checked(J.read_gold(spark, f"{tmp_path}/g.json"))
    (tmp_path / "g2.json").write_text(json.dumps({"reviewed": True, "text_sha256": "0", "items": []}))
    with pytest.raises(J.GoldError, match="another text"):
        J.checked(J.read_gold(spark, f"{tmp_path}/g2.json"), "text")


def test_streams(spark, tmp_path):
    from narralith.streaming import events as S

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(f"{tmp_path}/e")
    q = S.tumbling(S.read_events(spark, f"{tmp_path}/e", e.schema), late="0 seconds").writeStream.outputMode("complete").format("memory").queryName("tumbling_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from tumbling_out").first()[0] == 1000


def test_graph_written_and_read_back(spark, tmp_path):
    from narralith.sources import json_files as J

    rows = [(1, "a", ["a"], [2], [0]), (2, "b", ["b", "c"], [], [1])]
    persons = spark.createDataFrame(rows, "id bigint, primary_name string, names array<string>, parents array<bigint>, children array<bigint>")
    J.write_graph(persons, str(tmp_path / "g"), equality_threshold=0.5)
    got = J.read_graph(spark, str(tmp_path / "g")).orderBy("id").collect()
    assert [(r.id, r.primary_name, r.names, r.parents, r.children) for r in got] == rows and got[0].rank is None


def test_gold_is_checked_in_every_row(spark, tmp_path):
    from narralith.sources import json_files as J

    spans = spark.createDataFrame([(0, 9, [(0, 3), (4, 9)])], "main_start int, main_end int, names array<struct<start:int,end:int>>")
    good = J.imported_gold(spans, "some text", "hadith", "s", "me")
    assert J.checked(good, "some text").first().annotator == "me"
    for bad in (J.seed(J.gold_spans(good).select("s", "e", "names"), "hadith", "s", "some text"), J.imported_gold(spans, "other", "hadith", "s")):
        with pytest.raises(J.GoldError):
            J.checked(good.unionByName(bad), "some text")
    J.save_gold(good, str(tmp_path / "gold"))
    back = J.read_gold(spark, str(tmp_path / "gold"))
    assert back.first().reviewed and [tuple(n) for n in J.gold_spans(back).first().names] == [(0, 3), (4, 9)]
    J.save_report(spark.createDataFrame([(1, 0.51239)], "tp int, recall double"), str(tmp_path / "r"), "pairs")
    assert spark.read.text(str(tmp_path / "r/report")).first().value == "pairs: tp 1  recall 0.5124"


def test_index_counters(spark):
    from narralith.sources import json_files as J

    form = "struct<name:string,levels:array<array<array<string>>>>"
    rows = [(1, [("a", [[["a", "name"]]]), ("b", None)]), (2, [("c", [])]), (3, None), (4, [(None, None)])]
    got = J.index_counters(spark.createDataFrame(rows, f"id bigint, groups array<{form}>")).first()
    assert tuple(got) == (4, 4, 1, 2)
