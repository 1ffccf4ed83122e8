import random

import pytest

from corpusloom.llm import scans
from corpusloom.llm.perceptron import CharacterEditor, corrupt

WORDS = "the market operator shall publish information on capacity within nine days of receipt notice authority tariff balance statement where competent national regulatory decision network system settlement calendar penalty each provider may suspend contract register confidential".split()


@pytest.fixture(scope="module")
def clean():
    rng = random.Random(1)
    return [" ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(12)) + " A cross-border plan." for _ in range(150)]


@pytest.fixture(scope="module")
def repairer(clean):
    from collections import Counter

    lex = Counter(w.strip(".").lower() for t in clean for w in t.split())
    for w in list(lex):
        for p in w.split("-") if "-" in w else []:
            lex[p] += lex[w]
    words = [w for w in lex if "-" not in w and len(w) > 1]
    tagger = scans.LineTagger(sorted(lex, key=lambda w: (-lex[w], w))[:10]).train(scans.synthetic_documents(clean))
    return scans.Repairer(dict(lex), tagger, CharacterEditor().train(words + [str(y) for y in range(2000, 2060)], dict(lex)))


def test_editor_on_held_out_errors(repairer):
    rng = random.Random(99)
    right = total = 0
    for w in WORDS * 6:
        if len(w) < 5:
            continue
        noisy = "".join(c for c, _ in corrupt(w, rng, 1))
        if noisy != w and noisy not in repairer.lex:
            total += 1
            right += (repairer.fix(noisy) or ("",))[0] == w
    assert total > 60 and right / total > 0.9
    assert repairer.fix("zzzzqqq") is None and repairer.fix("203B")[0] == "2038"


def test_tagger_on_held_out_pages(repairer, clean):
    hit = total = 0
    for lines, near, tags in scans.synthetic_documents(clean, seed=77)[:150]:
        got = repairer.tagger.tag(lines, near)
        for i, t in tags.items():
            total += 1
            hit += got[i] == t
    assert hit / total > 0.97


def other_pages(n=60, seed=5):
    """Pages of another make than the training pages: set by textwrap, in the manner of a report."""
    import textwrap

    rng = random.Random(seed)
    out = []
    for _ in range(n):
        report, chapter = (" ".join(rng.choice(WORDS) for _ in range(k)) for k in (4, 2))
        form, shift = rng.choice(["Page {}", "{}", "- {} -", "p. {}", "[{}]"]), rng.choice([0, 12])
        pages = []
        for p in range(1, rng.randint(3, 6)):
            lines = [(f"{report.title()}", "header"), ("", "")] if p > 1 else []
            marks = rng.randint(0, 2)
            for k in range(rng.randint(3, 5)):
                text = " ".join(" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(4)) + (f" See there({k + 1})." if k < marks else "")
                lines += [(x, "body") for x in textwrap.wrap(text, 70)] + [("", "")]
            lines += [x for k in range(marks) for x in [(f"({k + 1}) Cf. the {rng.choice(WORDS)} of the {chapter}, p. {rng.randint(2, 90)}.", "footnote")]]
            lines += [("", ""), (form.format(p + shift).center(rng.choice([0, 60])), "page_number")]
            pages.append(lines)
        texts = ["\n".join(x for x, _ in p) for p in pages]
        for p, lines in enumerate(pages):
            near = {d: scans.Zone.of(texts[p + d]) for d in (-2, -1, 1, 2) if 0 <= p + d < len(pages)}
            out.append(([x for x, _ in lines], near, {i: t for i, (x, t) in enumerate(lines) if x.strip()}))
    return out


def test_tagger_on_pages_of_another_make(repairer):
    hit, total, noise = 0, 0, [0, 0]
    for lines, near, tags in other_pages():
        got = repairer.tagger.tag(lines, near)
        for i, t in tags.items():
            total += 1
            hit += got[i] == t
            if t != "body":
                noise[0] += got[i] == t
                noise[1] += 1
    assert hit / total > 0.97 and noise[0] / noise[1] > 0.93, (hit / total, noise)


def test_page(repairer):
    text = "\n".join(["The market operator shall publish infor-", "mation on capacity. The cross-", "border plan of the nctwork.", "", "The authority shall publish the notice", "within nine days of receipt.", "", "- 2 -"])
    found, paras, on = repairer.page(text, {})
    assert (1, "hyphen") in found and (3, "misread") in found and (8, "page_number") in found and (2, "hyphen") not in found
    assert paras == ["The market operator shall publish information on capacity. The cross-border plan of the network.", "The authority shall publish the notice within nine days of receipt."] and not on
    assert repairer.page(None, {}) == ([], [], False) and repairer.page(" \n ", {}) == ([], [], False)
    # a word broken over the page: the next page's first line shows it
    end = "The market operator shall publish the noti-"
    nxt = scans.Zone.of("ce within nine days of receipt of the market\noperator.")
    assert (1, "hyphen") in repairer.page(end, {1: nxt})[0]
    assert not [x for x in repairer.page("ce within nine days of receipt of the market\noperator.", {-1: scans.Zone.of(end)})[0] if x[1] == "misread"]
    # nothing to be read behind it: half a word is noise, the first part of a compound is not
    assert (1, "hyphen") in repairer.page("The market operator shall publish the noti-", {})[0]
    assert not [x for x in repairer.page("The market operator shall publish the cross-", {})[0] if x[1] == "hyphen"]
    long_ = "\n".join(["The market operator shall publish the notice."] * 20_000)
    assert len(repairer.page(long_, {})[1]) == 1
    # words of any length are repaired, and numbers may be framed by anything
    joined = "informationsettlementconfidentialregistersuspended"
    repairer.lex[joined] = 9
    repairer.memo.clear()
    repairer.prefixes = None
    assert (1, "misread") in repairer.page("The " + joined.replace("settle", "scttle") + " applies.", {})[0]
    del repairer.lex[joined]
    repairer.prefixes = None
    assert scans.number_value("=" * 50_000 + " 12 " + "=" * 50_000) == 12


def test_numbers():
    for s, v in (("- 12 -", 12), ("[l18]", 118), ("Page lO of 12", 10), ("xiv", 14), ("p. 7", 7), ("3/14", 3), ("l2", 12)):
        assert scans.number_value(s) == v
    for s in ("2034.", "nine days", "Article 5 applies", ""):
        assert scans.number_value(s) is None


S = "chunk_id long, doc_id string, page_no int, text string, ingested_at timestamp, near int, at int"


def test_operator(spark, repairer):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    p1, p2 = "The market operator shall publish the noti-", "ce within nine days of receipt.\n\nThe nctwork."
    rows = [(1, "D", 1, p1, t(1), 0, 0), (1, "d", 1, p1, t(2), 0, 0), (2, "d", 2, p2, t(1), 0, 0), (3, "d", 2, p2, t(3), 0, 0), (4, None, 1, p1, t(1), 0, 0), (5, "e", 1, None, t(1), 0, 0), (6, "e", 2, "", None, 0, 0), (7, "f", None, p1, t(1), 0, 0), (None, "g", 1, p1, t(1), 0, 0)]
    df = spark.createDataFrame(rows, S)
    got = {tuple(r) for r in scans.page_noise(df, scans.Trained(repairer)).collect()}
    assert got == {(1, 1, "hyphen"), (2, 3, "misread"), (3, 3, "misread"), (4, 1, "hyphen")}
    text = [(r.doc_id, r.para_no, r.page_no, r.text) for r in scans.running_text(df, scans.Trained(repairer)).orderBy("doc_id", "para_no").collect()]
    assert text == [("d", 1, 1, "The market operator shall publish the notice within nine days of receipt."), ("d", 2, 2, "The network.")]
    assert scans.page_noise(df.limit(0), scans.Trained(repairer)).count() == 0 and scans.running_text(df.limit(0), scans.Trained(repairer)).count() == 0


def test_lexicon_is_bounded_and_clean(spark):
    rows = [("The tariff notice (a) applies. Cross-border tariff AbC9xYz+/ (l) notice",)] * 3 + [("rareword",), (None,)]
    df = spark.createDataFrame([(i, None, t) for i, (t,) in enumerate(rows)] + [(99, 1, "page words page words page words")], "chunk_id int, page_no int, text string")
    lex = scans.lexicon(df)
    assert {"tariff", "notice", "cross-border", "cross", "border"} <= set(lex) and not {"a", "l", "rareword", "page"} & set(lex)
    r = scans.train(df).repairer
    assert r.page("The tariff notjce.", {})[0] is not None


def test_rare_words_are_known_at_any_size(spark, clean, monkeypatch):
    monkeypatch.setattr(scans, "LEX_SHARE", 300)  # most words are beyond the lexicon of all workers
    texts = clean + ["The mentor placed the anchor."] * 4
    rows = [(i, "c", None, t, None) for i, t in enumerate(texts)] + [(9001, "s", 1, "The mentor placed thc anchor.\nThe rnentor placed the an-\nchor.", None), (9002, None, 2, "The anch0r.", None)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, page_no int, text string, ingested_at timestamp")
    t = scans.train(df)
    assert t.tail is not None and {"mentor", "placed", "anchor"} <= {r.w for r in t.tail.collect()} and "mentor" not in t.repairer.lex
    got = {tuple(r) for r in scans.page_noise(df, t).collect()}
    assert got == {(9001, 1, "misread"), (9001, 2, "misread"), (9001, 2, "hyphen"), (9002, 1, "misread")}
