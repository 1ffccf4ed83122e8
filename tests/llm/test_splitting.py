import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import splitting as sp


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n漢", max_size=300), st.integers(1, 40), st.integers(0, 50), st.dictionaries(st.integers(-5, 320), st.integers(1, 7), max_size=10))
def test_pieces_cover_overlap_and_keep_the_limit(text, limit, overlap, marks):
    parts = sp.cut(text, limit, overlap, marks)
    share = min(overlap, limit - 1)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in parts)
    assert all(x[1] - y[0] == share for x, y in zip(parts, parts[1:]))
    assert all(y[0] > x[0] for x, y in zip(parts, parts[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 7), min_size=1, max_size=80), st.data())
def test_range_maximum_against_brute_force(strengths, data):
    s = np.array(strengths)
    t = sp.RangeMax(s, data.draw(st.integers(1, 100)))
    lo = data.draw(st.integers(0, len(s)))
    hi = data.draw(st.integers(0, len(s)))
    want = max(range(lo, hi), key=lambda i: (s[i], i)) if lo < hi else -1
    assert t.best(lo, hi) == want


def brute(text, limit, overlap, marks):
    """The same cut without a table: looks at every position of the window."""
    pos, strength = sp.boundaries(text, marks)
    at = dict(zip(pos.tolist(), strength.tolist()))
    overlap, out, start = min(overlap, limit - 1), [], 0
    while len(text) - start > limit:
        can = [p for p in range(start + overlap + 1, start + limit + 1) if p in at]
        end = max(can, key=lambda p: (at[p], p)) if can else start + limit
        out.append((start, end, at.get(end, 0) if can else 0))
        start = end - overlap
    return out + [(start, len(text), 0)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .,;\n漢", max_size=300), st.integers(1, 60), st.integers(0, 50), st.dictionaries(st.integers(-5, 320), st.integers(1, 7), max_size=10))
def test_cuts_against_brute_force(text, limit, overlap, marks):
    assert sp.cut(text, limit, overlap, marks) == brute(text, limit, overlap, marks)


def test_the_strongest_boundary_of_the_whole_window():
    text = "x" * 28 + "\n\n" + "y " * 60
    assert sp.cut(text, 100, 0)[0] == (0, 30, sp.BLANK_LINE)


def test_natural_boundaries():
    text = "One two three. Four five six seven.\n\nEight nine ten eleven twelve thirteen."
    parts = sp.cut(text, 45, 0)
    assert text[parts[0][0] : parts[0][1]].endswith("seven.\n\n") and parts[0][2] == sp.BLANK_LINE
    parts = sp.cut(text, 45, 0, {30: 7})
    assert parts[0][1] == 30 and parts[0][2] == 7
    assert [b - a for a, b, _ in sp.cut("x" * 100, 40, 10)] == [40, 40, 40]
    long_ = "word " * 200_000
    assert len(sp.cut(long_, 8000, 200)) > 100


C = "chunk_id long, lineage_id string, node_type string, text string, span_start int, ingested_at timestamp, max_chars int"
L = "node_type string, max_chars int, overlap_chars int, text string"
A = "parent_lineage string, node_type string, span_start int, span_end int, text string"


def test_operator(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    long_ = "aaaa bbbb. " * 10
    rows = [(1, "D:a", " Article ", "  " + long_, 100, t(1), 0), (1, "d:a", "article", "  " + long_, 100, t(1), 0), (2, "d:b", None, "x" * 31, 0, None, 0), (3, "d:c", "odd", "x" * 30, 0, t(1), 0), (4, "d:d", "article", None, None, t(1), 0),
            (5, "d:e", "article", "", 0, t(1), 0), (None, "d:f", "article", long_, 0, t(1), 0), (6, "d:g", "article", long_, None, t(1), 0), (6, "d:g", "article", "now short", None, t(2), 0), (7, "d:h", "article", " " * 90 + "short", 0, t(1), 0), (8, "d:i", "table", "y" * 99, 5, t(1), 0)]
    ch = spark.createDataFrame(rows, C)
    lim = spark.createDataFrame([("article", 50, 5, ""), ("any", 30, 3, ""), ("table", None, None, "")], L)
    ast = spark.createDataFrame([("d:a", "paragraph", 102, 140, ""), ("d:a", "paragraph", 102, 140, ""), ("d:a", "Article", None, 130, ""), (None, "x", 1, 2, "")], A)
    out = sp.split_oversized(ch, lim, ast).collect()
    assert {r.chunk_id for r in out} == {1, 2, 8}  # a null limit falls back to 'any'
    one = sorted((r for r in out if r.chunk_id == 1), key=lambda r: r.piece_no)
    assert one[0].span_start == 102 and all(r.span_end - r.span_start == len(r.text) <= 50 for r in one)
    assert one[0].span_end == 130 and one[0].boundary == "tree node"
    src = " " * 102 + long_
    assert all(src[r.span_start : r.span_end] == r.text for r in one)
    assert all(a.span_end - b.span_start == 5 for a, b in zip(one, one[1:]))
    assert sp.split_oversized(ch.limit(0), lim, ast.limit(0)).count() == 0


def test_a_parent_with_very_many_nodes_and_chunks(spark):
    text = "aaaa bbbb. " * 2000
    ch = spark.createDataFrame([(i, "d:hot", "article", text, i * 10, None, 0) for i in range(20)], C)
    nodes = [("D:HOT", k, 50 + 100 * (i % 300), 90 + 100 * (i % 300), "") for i in range(3000) for k in ("sentence", "paragraph")]
    out = sp.split_oversized(ch, spark.createDataFrame([("any", 500, 20, "")], L), spark.createDataFrame(nodes, A)).collect()
    for c in range(20):
        marks = {p - c * 10: 6 for i in range(300) for p in (50 + 100 * i, 90 + 100 * i) if 0 < p - c * 10 < len(text.strip())}
        want = brute(text.strip(), 500, 20, marks)
        assert sorted((r.span_start - c * 10, r.span_end - c * 10) for r in out if r.chunk_id == c) == [(a, b) for a, b, _ in want]
