import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import repetition as rp
from corpusloom.llm.trees import fit


def brute(words):
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - 4):
        g = tuple(words[i : i + 5])
        if g in seen:
            hit[i : i + 5] = [True] * 5
        seen.add(g)
    return sum(hit) / len(words) if words else 0.0


def share(words):
    return float(rp.repeated_shares_of(rp.Words.of([words]))[0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_share_against_brute_force(words):
    assert share(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=8), st.data())
def test_documents_side_by_side(texts, data):
    w = rp.Words.of(texts)
    assert list(rp.repeated_shares_of(w)) == [brute(t) for t in texts]
    keep = np.array([data.draw(st.booleans()) for _ in texts], dtype=bool)
    assert list(rp.repeated_shares_of(w.of_docs(keep))) == [brute(t) for t, k in zip(texts, keep) if k]


def test_words():
    assert rp.words_of("It's Ünï-x 12a½b² ÀB") == ["it", "s", "ünï", "x", "a", "b", "àb"]
    assert rp.words_of(None) == [] == rp.words_of("12 34")
    assert brute(rp.words_of("a b c d e " * 40_000)) == share(rp.words_of("a b c d e " * 40_000))


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=3000)) > 0.6).astype(float)
    f = fit(x, y, [1, 0, 0])
    test = rng.random((2000, 3))
    want = (test[:, 0] + 0.3 * np.sin(9 * test[:, 1])) > 0.6
    assert ((f.score(test) > 0) == want).mean() > 0.9
    for row in test[:50]:
        line = np.repeat(row[None, :], 40, axis=0)
        line[:, 0] = np.linspace(0, 1, 40)
        assert (np.diff(f.score(line)) >= -1e-9).all()
    one = fit(x[:50], np.ones(50), [1, 0, 0])
    assert len(set(one.score(x[:10]))) == 1
    assert np.isfinite(fit(np.zeros((0, 3)), np.zeros(0), [1, 0, 0]).score(x[:2])).all()


D = "doc_id long, text string, score double, share int"


def test_operator(spark):
    import random

    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "el", "ir", "os", "un", "ade")]
    fresh = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = []
    for i in range(400):
        phrase = fresh(12)
        rows.append((i, fresh(60) if i % 4 else phrase + ". " + fresh(10) + ". " + (phrase + ". ") * (i % 5), 0.0, 0))
    rows += [(1000, None, 0.0, 0), (1001, "", 0.0, 0), (1002, "1 2 3", 0.0, 0), (1003, "x y z v w " * 50_000, 0.0, 0), (None, "a b c d e f " * 9, 0.0, 0), (1, rows[1][1], 0.0, 0), (2**60 + 1, "a b c d e f " * 9, 0.0, 0)]
    df = spark.createDataFrame(rows, D)
    got = [(r.doc_id, r.share) for r in rp.repetition_scores(df).collect()]
    want = {i for i, t, *_ in rows if brute(rp.words_of(t)) >= 0.3}
    assert {i for i, s in got if s is not None and s >= 0.3} == want and len(got) == len(rows)
    exact = {r.doc_id: r.share for r in rp.repeated_shares(df).collect()}
    assert exact[1000] == exact[1001] == exact[1002] == 0.0 and exact[1003] > 0.99
    assert all(abs(exact[i] - brute(rp.words_of(t))) < 1e-12 for i, t, *_ in rows if i != 1)
    assert rp.repetition_scores(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_runs_of_two_and_four_cover_runs_of_five(words):
    w = rp.Words.of([words])
    assert w.seen(2)[0] >= w.seen(5)[0] and w.seen(4)[0] >= w.seen(5)[0]


def test_rare_positives_beyond_the_sample(spark):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(40)), 0.0, 0) for i in range(300)]
    drawn = {r.doc_id for r in spark.range(0, 300).selectExpr("id as doc_id").filter("pmod(xxhash64(doc_id, 'train'), 1048576) < 1048576 * 30 / 300").collect()}
    rare = [i for i in range(300) if i not in drawn][:3]
    for i in rare:
        rows[i] = (i, "once upon a time there was " * 4, 0.0, 0)
    df = spark.createDataFrame(rows, D)
    model = rp.train(df, 30)
    assert model[1] == -np.inf
    strict = (model[0], np.inf)  # trees that rule out everything
    for m in (model, strict):
        got = {r.doc_id for r in rp.repetition_scores(df, m).filter("share >= 0.3").collect()}
        assert got == {i for i, t, *_ in rows if brute(rp.words_of(t)) >= 0.3} and got >= set(rare)
