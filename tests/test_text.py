from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.json_text import extract_json, first_json, verdict


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_search_terms(spark):
    t = one(spark, T.tokenize(F.col("a")), a="REMIT (2019/944/EU) applies to the 2019/944 operator")
    assert t == ["REMIT", "2019/944/eu", "2019/944", "operator"]
    t = one(spark, T.tokenize(F.col("a")), a="5(2) of 12 and section 34")
    assert t == ["5", "2", "12", "section", "34"]
    assert one(spark, T.tokenize(F.col("a")), a=None) == [] == one(spark, T.tokenize(F.col("a")), a="")
    assert one(spark, T.tokenize(F.col("a")), a="944NIS2 NIS2") == ["944", "nis", "2", "NIS2"]


def test_windows(spark):
    w = one(spark, T.sample_windows(F.col("a")), a="x" * 50_000)
    assert len(w) == 6 and (w[-1].start, w[-1].end) == (47_500, 50_000) and w[0].start == 0
    w = one(spark, T.sample_windows(F.col("a"), 2), a="x" * 10_000)
    assert [(x.start, x.end) for x in w] == [(0, 2500), (7500, 10_000)]
    assert one(spark, T.sample_windows(F.col("a")), a="") is None


def test_scalars(spark):
    assert one(spark, T.article_numbers(F.col("a")), a="Article 14a, Article 2 and Article 2") == ["2", "14a"]
    assert one(spark, T.instrument(F.col("a")), a="## **Regulation (EU) 2016/679**") == "Regulation (EU) 2016/679"
    assert one(spark, T.instrument(F.col("a")), a="Regulation No 910/2014") is None
    assert one(spark, T.celex(F.col("a")), a="CELEX 32019094400 and 32019R0944") == "32019094400"
    assert one(spark, T.dates(F.col("a")), a="2020-01-02 or 11 June 2019") == ["11 June 2019", "2020-01-02"]
    assert one(spark, T.definitions(F.col("a")), a='"capacity" means x. Market operator means y.') == ["capacity", "Market operator"]
    assert one(spark, T.obligation_count(F.col("a")), a="He shall, SHE MUST, it is required to") == 3
    assert one(spark, T.derogation_count(F.col("a")), a="Notwithstanding that, except where x") == 2
    assert one(spark, T.table_count(F.col("a")), a="| A | B |\n|---|---|\n| 1 | 2 |") == 1
    assert one(spark, T.table_headers(F.col("a")), a="| Name | Id |\n|---|---|\n| 1 | 2 |") == ["Name | Id"]
    assert one(spark, T.slug(F.col("a")), a=" Market  Operator! ") == "market_operator"
    assert one(spark, T.snippet(F.col("a")), a="a\n\n b" + "c" * 200) == ("a b" + "c" * 200)[:120]
    assert one(spark, T.headings(F.col("a")), a="# One \ntext\n### Two") == ["One", "Two"]
    assert one(spark, T.doc_of(F.col("a")), a="d:article:5a:para:1") == "d" and one(spark, T.doc_of(F.col("a")), a="ext:instrument:1") == "ext"
    assert one(spark, T.article_num_of(F.col("a")), a="d:article:5a") == 5
    assert [(r.num, r.letter) for r in one(spark, T.article_refs(F.col("a")), a="Article 5a and article 7 (b)")] == [(5, "a"), (7, "b")]
    assert one(spark, T.change_number(F.col("a")), a="within 5 days of 9 months") == "within 2 days of 9 months"
    assert one(spark, T.change_number(F.col("a"), True), a="Article 5 within 30 per cent") == "Article 5 within 60 per cent"
    assert one(spark, T.weaken(F.col("a")), a="It shall and shall") == "It may and shall"


def test_answers(spark):
    ab = (F.col("a"), F.col("b"))
    assert one(spark, T.exact_match(*ab), a="Article 4(2) applies", b="article 4 2 applies") == 1.0
    assert one(spark, T.exact_match(*ab), a=None, b="") == 1.0
    assert one(spark, T.token_f1(*ab), a="a b c", b="b c d d") == 2 * 2 / 6
    assert one(spark, T.token_f1(*ab), a="", b="x") == 0.0
    assert one(spark, T.cites_target(F.col("a"), F.col("b"), F.lit(7)), a="see Article 7", b="nis_x") is True
    assert one(spark, T.lenient_match(*ab), a="Regulation (EU) 1", b="regulation eu 1") == 1.0


def test_html(spark):
    h = "<p class='a'>One<br>Two</p><ul><li>x &amp; y</li></ul>\n\n\n\nend"
    assert one(spark, T.clean_html(F.col("a")), a=h) == "One\nTwo\n- x & y\n\nend"
    assert one(spark, T.clean_html(F.col("a")), a=None) == ""


def test_json(spark):
    assert first_json('Sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert first_json('so {"a": "}"} it is') == '{"a": "}"}'
    assert first_json("[1, 2] tail") == "[1, 2]" and first_json("garbage") is None and first_json(None) is None
    assert one(spark, extract_json(F.col("a")), a="x [1] y") == "[1]"
    v = one(spark, verdict(F.col("a")), a='{"score": 9, "correct": "T", "confidence": 1.7, "claims": [{"claim": "x", "supported": false}, {"claim": "y"}]}')
    assert (v.score, v.correct, v.confidence, v.unsupported_rate) == (5, True, 1.0, 0.5)
    v = one(spark, verdict(F.col("a")), a="no json")
    assert v.score is None and v.correct is None and v.unsupported_rate is None
