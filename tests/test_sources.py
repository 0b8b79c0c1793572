"""TEI parsing, cleaning report and actor resolution edge cases."""

from pyspark.sql import functions as F

from tessel.operators import actors as AC
from tessel.operators import dedup as D
from tessel.session import scratch_path
from tessel.sources.runs import fresh, write_text
from tessel.sources.tei import scan_tei

TEI_FIXTURE = """<?xml version="1.0" encoding="utf-8"?>
<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">
 <TEI xml:id="d1">
  <teiHeader>
   <fileDesc><sourceDesc><biblStruct><idno type="url">http://a.fr/x</idno></biblStruct></sourceDesc></fileDesc>
   <profileDesc><langUsage><language ident="fr"/></langUsage>
    <textClass><keywords><term type="domain">a.fr</term><term type="crawl">crawl-a-2025</term>
     <term type="modality">web</term><term type="class">CORE</term></keywords></textClass></profileDesc>
   <revisionDesc><change>md5_text=0cc175b9c0f1b6a831c399e269772661 chars=17</change></revisionDesc>
  </teiHeader>
  <text><body><div><head>H</head><p>Hello <b>big</b> world &amp; more</p></div></body></text>
 </TEI>
 <TEI n="7"><teiHeader><profileDesc><textClass><keywords><term type="domain">  </term></keywords></textClass></profileDesc></teiHeader>
  <body>no text element</body></TEI>
 <TEI xml:id="bad"><teiHeader><unclosed></teiHeader></TEI>
</teiCorpus>
"""


def test_tei_scan_fixture(spark):
    d = scratch_path(spark, fresh("tei-test"))
    write_text(spark, f"{d}/corpus.xml", TEI_FIXTURE)
    rows = {r["id"]: r for r in scan_tei(spark, d, "web1", None).collect() if r["id"]}
    r1 = rows["d1"]
    assert r1["text"] == "H Hello big world & more"
    assert r1["modality"] == "web" and r1["url"] == "http://a.fr/x"
    assert r1["md5_text"] == "0cc175b9c0f1b6a831c399e269772661" and r1["chars"] == 17
    assert r1["langs"] == ["fr"] and r1["terms"]["crawl"] == ["crawl-a-2025"]
    assert r1["head_p_len"] == len("H") + len("Hello ")
    r7 = rows["7"]
    assert r7["modality"] == "unknown" and r7["text"] == "no text element"
    assert "domain" not in (r7["terms"] or {})  # blank term ignored
    corrupt = scan_tei(spark, d).where("_corrupt").count()
    assert corrupt == 1


PREFIXED = """<?xml version="1.0"?>
<tei:teiCorpus xmlns:tei="http://www.tei-c.org/ns/1.0" xmlns:x="urn:x">
<tei:TEI xml:id="p1"><tei:text><tei:body><tei:p x:k="1">one</tei:p></tei:body></tei:text></tei:TEI>
<tei:TEI><tei:text><tei:body><tei:p>same</tei:p></tei:body></tei:text></tei:TEI>
<tei:TEI><tei:text><tei:body><tei:p>same</tei:p></tei:body></tei:text></tei:TEI>
</tei:teiCorpus>
"""


def test_prefixed_corpus_and_documents_without_ids(spark):
    from tessel.sources.tei import export_kept
    d = scratch_path(spark, fresh("tei-test"))
    write_text(spark, f"{d}/corpus.xml", PREFIXED)
    rows = scan_tei(spark, d, with_record=True).collect()
    assert sorted(r["text"] for r in rows) == ["one", "same", "same"] and not any(r["_corrupt"] for r in rows)
    assert len({r["id"] for r in rows}) == 3
    assert all(r["record"].startswith("<tei:TEI") and r["record"].endswith("</tei:TEI>") for r in rows)
    write_text(spark, f"{d}/corpus.xml", TEI_FIXTURE)
    out = export_kept(spark, d, spark.createDataFrame([("7",), ("x",)], "id string"), d + "-kept")
    assert [(r["id"], r["text"]) for r in scan_tei(spark, out).collect()] == [("7", "no text element")]


def test_white_space_is_stripped_as_python_does(spark):
    from tessel.functions import text as T
    from tessel.operators.labels import label_fallback
    df = spark.createDataFrame([("\u00a0\tx\u00a0", "a\u00a0b"), ("\u00a0", "c")], "l string, t string")
    assert [r[0] for r in label_fallback(df, ["l", "t"]).select("label_raw").collect()] == ["x", "c"]
    assert df.select(T.token_count("t", "regex")).first()[0] == 2


def test_cleaning_report_reasons(spark):
    rows = [(1, "a.fr", "Title", 500, 10, 1), (2, "a.fr", " title ", 600, 10, 2), (3, "a.fr", "", 700, 10, 3),
            (4, "a.fr", "", 800, 10, 4), (5, "b.fr", "Title", 100, 10, 5), (6, "a.fr", "T2", 450, 9, 6),
            (7, "a.fr", "T2", 450, 11, 7)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, title string, text_len long, chars long, pos long")
    r = {x["doc_id"]: x["drop_reason"] for x in D.cleaning_report(df, 400).collect()}
    assert r == {1: "dup_title_domain", 2: "", 3: "", 4: "", 5: "short", 6: "dup_title_domain", 7: ""}


def test_actor_resolution_cases(spark):
    actors = AC.actors_frame(spark, [
        ("A", ["crawl-x"], ["x.fr"], "left", "left", "gauche", None),
        ("B", ["crawl-y"], [], "right", "right", None, "droite"),
        ("C", ["crawl-x"], [], "left", "far_left", "exgauche", None),  # later actor wins crawl-x
    ])
    docs = spark.createDataFrame([(1, "crawl-y", "x.fr"), (2, "crawl-x", None), (3, "none", None), (4, "crawl-y", "")],
                                 "id long, crawl string, domain string")
    out = {r["id"]: (r["actor"], r["label"], r["reason"])
           for r in AC.resolve_actors(docs, actors, "binary", "keep").collect()}
    assert out[1] == ("A", "left", "ok")  # domain beats crawl
    assert out[2] == ("C", "left", "ok")
    assert out[3] == (None, "unknown_actor", "unknown_actor_kept")
    assert out[4] == ("B", "right", "ok")
    left = {r["id"]: r["reason"] for r in AC.resolve_actors(docs, actors, "left_intra", "drop").collect()}
    assert left[4] == "actor_not_left" and left[3] == "unknown_actor_dropped"


def test_label_vote_conflict(spark):
    ac = spark.createDataFrame([("p", "c1"), ("p", "c2"), ("q", "c3"), ("q", "c4"), ("q", "c5")], "actor_id string, crawl string")
    raw = spark.createDataFrame([("c1", "gauche"), ("c2", "droite"), ("c3", "exgauche"), ("c4", "gauche"), ("c5", "Far Left")],
                                "crawl string, raw_label string")
    v = {r["actor_id"]: r for r in AC.label_vote(ac, raw).collect()}
    assert v["p"]["side_binary"] is None and v["p"]["global_five"] is None  # left + right conflict
    assert v["q"]["side_binary"] == "left" and v["q"]["global_five"] == "far_left"


def test_tsv_roundtrip_keeps_tabs_quotes_newlines(spark):
    from tessel.sources import tsv as TSV
    rows = [("d1", "a", "a", "web", "web1", 'he said "hi"\tthen\nleft'), ("d2", "b", "b", "web", "web2", "plain"),
            ("d3", "", "x", "web", "web1", "no label"), ("d4", "a", "a", "web", "web1", "  ")]
    df = spark.createDataFrame(rows, "id string, label string, label_raw string, modality string, source string, text string")
    path = scratch_path(spark, fresh("tsv-test"))
    back = TSV.read_labelled_tsv(spark, TSV.write_view_tsv(df, path))
    got = {r["id"]: r["text"] for r in back.collect()}
    assert got == {"d1": 'he said "hi"\tthen\nleft', "d2": "plain"}  # empty label / blank text dropped
