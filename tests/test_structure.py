from pyspark.sql import functions as F

from corpusloom.operators import relations as rel
from corpusloom.operators import structure as st

DOC = """# Regulation (EU) 2030/111

(1) Whereas this is so.

## **Article 2 - Scope**

1. This applies to market participants. See Articles 3, 7 and 9 of Regulation (EU) 2031/222.

(a) point

## **Article 7 - Obligations**

The operator shall refer to Article 2. "capacity" means power.

| A | B |
|---|---|
| 1 | Article 2 |
| 3 | 4 |

### Heading Level 3
"""


def test_marks():
    heads = st.article_heads(DOC)
    assert [(h["number"], h["title"], h["level"]) for h in heads] == [("2", "Scope", 2), ("7", "Obligations", 2)]
    assert not st.article_heads("Article 3 is plain prose.\nArticle 40 – also")
    assert [h["number"] for h in st.article_heads("_Article 5_\n**Article 9a**\n## _Article 30(3)_")] == ["5", "9a", "30"]
    b = st.table_blocks(DOC)[0]
    assert (b["rows"], b["cols"]) == (3, 2) and DOC[b["start"] : b["end"]].startswith("| A")
    assert [m[0] for m in st.marks_of(DOC)].count("recital") == 1
    assert st.marks_of("") == []


def test_tree_and_chunks(spark):
    docs = spark.createDataFrame([("d", DOC), ("n", None), ("e", "")], "doc_id string, text string")
    t = {r.lineage_id: r for r in st.syntax_tree(docs).collect()}
    assert {"d:document", "d:preamble", "d:article:2", "d:article:7", "d:article:2:para:1", "d:article:2:para:2", "d:table:1"} == set(t)
    assert t["d:article:2"].span_end == t["d:article:7"].span_start and t["d:table:1"].parent_lineage == "d:article:7"
    c = st.chunk_documents(docs).collect()
    assert all(DOC[r.span_start : r.span_end].strip() == r.text for r in c)
    m = st.structure_map(docs).first()
    assert (m.articles, m.tables, m.recitals, m.strategy) == (2, 1, 1, "article_based")


def test_documents_of_thin_parts_only(spark):
    text = "# Short act\n\n## **Article 1**\n\nOne.\n\n## **Article 2**\n\nTwo.\n\n## **Article 3**\n\nThree."
    docs = spark.createDataFrame([("d", text), ("e", text[text.index("## **Article 1") :]), ("one", "## **Article 4**\n\nAlone.")], "doc_id string, text string")
    c = {r.doc_id: r for r in st.chunk_documents(docs).collect()}
    assert len(c) == 3 and c["d"].text == text and (c["d"].span_start, c["d"].span_end) == (0, len(text)) and c["d"].thin
    assert (c["d"].lineage_id, c["d"].absorbed) == ("d:preamble", ["d:article:1", "d:article:2", "d:article:3"])
    assert (c["e"].lineage_id, c["e"].absorbed) == ("e:article:1", ["e:article:2", "e:article:3"]) and c["e"].text.endswith("Three.")
    assert (c["one"].lineage_id, c["one"].absorbed) == ("one:article:4", [])
    assert st.recover_oversized(st.syntax_tree(docs), st.chunk_documents(docs), docs).count() == 0


def test_folding_and_oversize(spark):
    long_ = "## **Article 1**\n\n" + "(a) " + "word " * 1000 + "\n\n(b) " + "word " * 1000 + "\n\n## **Article 2**\n\nshort"
    parts = st.article_parts("d", long_)
    assert all(p["end"] - p["start"] <= 8000 for p in parts) and parts[-1]["absorbed"] == ["d:article:2"]
    assert [p["lineage"] for p in st.article_parts("d", long_, drop_oversize=True)] == ["d:article:2"]
    docs = spark.createDataFrame([("d", long_)], "doc_id string, text string")
    got = st.recover_oversized(st.syntax_tree(docs), st.chunk_documents(docs, drop_oversize=True), docs).collect()
    assert [r.lineage_id for r in got] == ["d:article:1"] and got[0].text.endswith("word")


def test_sentence_packs():
    text = " ".join(f"This is sentence number {i} of the text." for i in range(200))
    parts = st.sentence_parts("d", text)
    assert all(p["end"] - p["start"] <= 1200 for p in parts) and len(parts) < 15
    assert "".join(text[p["start"] : p["end"]].replace(" ", "") for p in parts) == text.replace(" ", "")
    odd = st.sentence_parts("d", text, by_offset=True)
    assert len(odd) > 150  # beyond the limit's offset each sentence stands alone
    assert st.sentence_parts("d", "") == []


def test_lines_and_spans(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncd"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.line_no, r.line_start, r.line) for r in st.line_offsets(docs).orderBy("doc_id", "line_no").collect()] == [(1, 1, 0, "ab"), (1, 2, 3, ""), (1, 3, 4, "cd"), (3, 1, 0, "")]
    ch = spark.createDataFrame([("d", "a", 0, 100, "x"), ("d", "b", 50, 120, "y"), ("d", "c", 130, 130, None), ("d", "e", 140, 143, "z")], "doc_id string, lineage_id string, span_start int, span_end int, text string")
    assert {(r.lineage_id, r.problem) for r in st.span_problems(ch).collect()} == {("b", "overlap"), ("c", "inverted"), ("c", "blank"), ("e", "short")}


def test_relations(spark):
    other = "# Regulation\n\n## **Article 3**\n\nAmended by Regulation (EU) 2030/111.\n\nRegulation (EU) 2033/100 repeals Regulation (EU) 2030/100."
    docs = spark.createDataFrame([("1", DOC, "2030/111"), ("2", other, "2031/222"), ("3", None, None)], "doc_id string, text string, instrument string")
    e = {(r.src, r.dst, r.kind): r for r in rel.build_graph(docs).collect()}
    assert ("1:article:2", "2:article:3", "CROSS_REFERENCES") in e and e["1:article:2", "2:article:3", "CROSS_REFERENCES"].cites
    assert e["1:article:2", "ext:article:7", "CROSS_REFERENCES"].unresolved
    assert ("1:article:7", "1:article:2", "CROSS_REFERENCES") in e
    assert ("2:article:3", "1:document", "AMENDS") in e
    assert ("ext:instrument:2033-100", "ext:instrument:2030-100", "SUPERSEDES") in e
    assert ("1:term:capacity", "1:article:7", "DEFINED_IN") in e
    assert ("1:article:2", "corpus:entity:market_participants", "APPLIES_TO") in e
    assert ("1:article:7", "1:document", "PART_OF") in e
    docs2 = docs.filter("text is not null")
    nodes = {r.lineage_id: r.kind for r in rel.graph_nodes(docs2, rel.build_graph(docs2), st.syntax_tree(docs2)).collect()}
    assert nodes["1:article:7"] == "article" and nodes["1:preamble"] == "preamble" and nodes["1:term:capacity"] == "term" and nodes["ext:article:7"] == "external_article" and nodes["corpus:entity:market_participants"] == "entity"
    truth = spark.createDataFrame([("1", 2, None, 2, "Regulation (EU) 2030/111", None)], "doc_id string, articles int, chapters int, tables int, instrument string, publication_date string")
    cov = st.coverage_audit(st.structure_map(docs2), truth).first()
    assert (cov.articles, cov.chapters, cov.tables, cov.instrument) == (1.0, 1.0, 0.5, 1.0) and cov.coverage == 0.9
    assert rel.list_members("2, 3 and 4", 1) == ["3", "4"] and rel.list_members("2, 3 and 4", 1, whole=False) == ["3"]
    assert rel.instrument_after(" of Regulation (EU) 2016/679", 0) == "2016/679" and rel.instrument_after(" of a conflict", 0) is None
    assert rel.first_entity("the market operators and consumers") == "market operators"


def test_merge_and_first_wins(spark):
    s = "src string, dst string, kind string"
    old = spark.createDataFrame([("a", "b", "X"), ("a", "b", "PART_OF")], s)
    new = spark.createDataFrame([("a", "b", "X"), ("a", "c", "PART_OF"), ("a", "c", "PART_OF")], s)
    assert {tuple(r) for r in rel.merge_edges(old, new, ["PART_OF"]).collect()} == {("a", "b", "X"), ("a", "c", "PART_OF")}
    d = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first")], "k string, o int, v string")
    assert rel.first_wins(d, ["k"], ["o"]).first().v == "first"
    assert st.fold_islands(spark.createDataFrame([("d", "a", 0, 10, "x"), ("d", "b", 10, 400, "y" * 390), ("d", "c", 400, 410, "z")], "doc_id string, lineage_id string, span_start int, span_end int, text string")).select("span_start", "span_end", F.size("absorbed")).collect() == [(0, 410, 2)]
