"""Structure of markdown documents: headings, spans, a flat syntax tree, and chunks with lineage.

Match offsets are the one thing that column functions do not give, so each document's text passes once through an
Arrow worker, which emits rows; spans, counts, checks and joins on them are relational.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..scale import spread

#: Characters: longest article chunk, shortest chunk that stands alone, longest packed sentence chunk.
MAX_ARTICLE, MIN_CHUNK, MAX_SENTENCES = 8000, 200, 1200

_ARTICLE = re.compile("(?m)" + fixed.ARTICLE_LINE)
_CHAPTER = re.compile("(?m)" + fixed.CHAPTER_LINE)
_RECITAL = re.compile("(?m)" + fixed.RECITAL_LINE)
_HEADING = re.compile("(?m)" + fixed.HEADING_LINE)
_LETTERED = re.compile("(?m)" + fixed.LETTERED_PARA)
_NUMBERED = re.compile("(?m)" + fixed.NUMBERED_PARA)
_TABLE_LINE, _TABLE_RULE = re.compile(fixed.TABLE_LINE), re.compile(fixed.TABLE_RULE)
_SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s|$)|$(?![\s\S]))", re.S)


def article_heads(text: str) -> list[dict]:
    """Marked article headings in order: number, title, level, start, line_end. A line in plain prose is none."""
    out = []
    for m in _ARTICLE.finditer(text):
        if m[1] or m[2] or m[5]:
            title = re.sub(r"[*_`#]+", "", m[4]).strip()[:160] if m[4] else None
            out.append({"number": m[3], "title": title, "level": len(m[1] or "#"), "start": m.start(), "line_end": m.end()})
    return out


def table_blocks(text: str) -> list[dict]:
    """Pipe tables: start, end, rows and cols. As the line that rules off the head counts, two data rows make three."""
    out, lines, at = [], text.split("\n"), 0
    starts = []
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    i = 0
    while i + 1 < len(lines):
        if _TABLE_LINE.match(lines[i]) and _TABLE_RULE.match(lines[i + 1]):
            j = i + 2
            while j < len(lines) and lines[j].startswith("|"):
                j += 1
            out.append({"start": starts[i], "end": starts[j - 1] + len(lines[j - 1]), "rows": j - i - 1, "cols": max(x.count("|") - 1 for x in lines[i:j])})
            i = j
        else:
            i += 1
    return out


def marks_of(text: str) -> list[tuple]:
    """(mark, number, title, level, start, end, rows, cols) of everything in a text that shows structure."""
    heads = article_heads(text)
    out = []
    for k, a in enumerate(heads):
        end = heads[k + 1]["start"] if k + 1 < len(heads) else len(text)
        title = a["title"]
        if title is None and end - a["start"] <= 4000:
            for h in _HEADING.finditer(text, a["line_end"], end):
                name = re.sub(r"[*_`#]+", "", h[2]).strip()
                if len(h[1]) >= a["level"] and not re.match(r"(?i)(article|chapter|title|part|annex)\b|\(\d+\)", name):
                    title = name[:160] or None
                    break
        out.append(("article", a["number"], title, a["level"], a["start"], end, None, None))
    for m in _CHAPTER.finditer(text):
        rest = re.sub(r"\s+", " ", text[m.end() : m.end() + 160]).strip(" *_#-–—:")[:140]
        out.append(("chapter", m[2], rest or None, None, m.start(), m.end(), None, None))
    for m in list(_RECITAL.finditer(text))[: fixed.MOST_RECITALS]:
        out.append(("recital", m[1], None, None, m.start(), m.end(), None, None))
    for name, p in (("lettered", _LETTERED), ("numbered", _NUMBERED)):
        for m in p.finditer(text):
            label = re.search(r"\(([a-z])\)|(\d+)", m[0])
            out.append((name, label[1] or label[2], None, None, m.start(), m.end(), None, None))
    for b in table_blocks(text):
        out.append(("table", None, None, None, b["start"], b["end"], b["rows"], b["cols"]))
    return out


MARKS = "doc_id string, mark string, number string, title string, level int, span_start int, span_end int, n_rows int, n_cols int"


def structure_marks(docs: DataFrame) -> DataFrame:
    """Marks of each document (doc_id, text): MARKS. Null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *r) for d, t in zip(pdf["doc_id"], pdf["text"]) if t for r in marks_of(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "mark", "number", "title", "level", "span_start", "span_end", "n_rows", "n_cols"])
            yield out.astype({k: "Int32" for k in ("level", "span_start", "span_end", "n_rows", "n_cols")})

    return spread(docs.filter("text != ''").select(F.col("doc_id").cast("string").alias("doc_id"), "text")).mapInPandas(run, MARKS)


def structure_map(docs: DataFrame) -> DataFrame:
    """One row per document with text: counts of its marks, densities per 1000 words, and how it should be chunked."""
    t = F.col("text")
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    per = lambda n: F.when(words > 0, F.round(n * 1000.0 / words, 2)).otherwise(0.0)
    unit = lambda p: F.regexp_count(t, F.lit(p))
    base = docs.filter("text != ''").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.length(t).cast("long").alias("content_chars"), words.cast("long").alias("words"), T.title_heuristic(t).alias("document_title"),
        T.instrument(t).alias("instrument"), T.publication_date(t).alias("publication_date"), T.obligation_count(t).cast("long").alias("obligations"), per(T.obligation_count(t)).alias("obligation_density"),
        T.derogation_count(t).cast("long").alias("derogations"), per(T.derogation_count(t)).alias("derogation_density"),
        unit(fixed.UNITS["power"]).cast("long").alias("power_units"), unit(fixed.UNITS["energy"]).cast("long").alias("energy_units"), unit(fixed.UNITS["price"]).cast("long").alias("price_units"))
    m = structure_marks(docs)
    n = lambda k: F.sum(F.when(F.col("mark") == k, 1).otherwise(0))
    counts = m.groupBy("doc_id").agg(n("article").alias("articles"), n("chapter").alias("chapters"), n("recital").alias("recitals"), n("table").alias("tables"), n("lettered").alias("lettered"), n("numbered").alias("numbered"))
    x = base.join(counts, "doc_id", "left").na.fill(0, ["articles", "chapters", "recitals", "tables", "lettered", "numbered"])
    return x.withColumn("strategy", F.when((F.col("articles") > 0) & (F.col("chapters") > 0), "hierarchical").when(F.col("articles") > 0, "article_based").when(F.col("tables") > 0, "table_then_sentence").otherwise("sentence_512"))


def syntax_tree(docs: DataFrame) -> DataFrame:
    """Flat tree rows: doc_id, node_type, identifier, lineage_id, parent_lineage, title, span_start, span_end.

    A document has a preamble (if text precedes its first article), chapters beside its articles, and paragraphs and
    tables within articles. A number that comes again keeps its first span.
    """
    size = docs.filter("text != ''").select(F.col("doc_id").cast("string").alias("doc_id"), F.length("text").alias("size"))
    m = structure_marks(docs)
    root = F.concat("doc_id", F.lit(":document"))
    by_doc = Window.partitionBy("doc_id").orderBy("span_start")
    none = F.lit(None).cast("string")
    cols = ["doc_id", "node_type", "identifier", "lineage_id", "parent_lineage", "title", "span_start", "span_end"]
    art = m.filter("mark = 'article'").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("span_start"))).filter("nth = 1").select(
        "doc_id", F.lit("article").alias("node_type"), F.concat(F.lit("ART-"), "number").alias("identifier"), F.concat("doc_id", F.lit(":article:"), "number").alias("lineage_id"), root.alias("parent_lineage"), "title", "span_start", "span_end", "number")
    first = art.groupBy("doc_id").agg(F.min("span_start").alias("first"))
    doc = size.select("doc_id", F.lit("document").alias("node_type"), F.lit("DOC").alias("identifier"), root.alias("lineage_id"), none.alias("parent_lineage"), none.alias("title"), F.lit(0).alias("span_start"), F.col("size").alias("span_end"))
    pre = first.filter("first > 0").select("doc_id", F.lit("preamble").alias("node_type"), F.lit("PRE-0").alias("identifier"), F.concat("doc_id", F.lit(":preamble")).alias("lineage_id"), root.alias("parent_lineage"), none.alias("title"), F.lit(0).alias("span_start"), F.col("first").alias("span_end"))
    chap = m.filter("mark = 'chapter'").join(size, "doc_id").withColumn("span_end", F.coalesce(F.lead("span_start").over(by_doc), F.col("size"))).select(
        "doc_id", F.lit("chapter").alias("node_type"), F.concat(F.lit("CH-"), "number").alias("identifier"), F.concat("doc_id", F.lit(":chapter:"), "number").alias("lineage_id"), root.alias("parent_lineage"), "title", "span_start", "span_end")
    inner = m.filter("mark in ('lettered', 'numbered')").select("doc_id", "mark", F.col("number").alias("label"), F.col("span_start").alias("at"))
    holds = art.select("doc_id", F.col("lineage_id").alias("parent_lineage"), "number", F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    in_art = Window.partitionBy("parent_lineage").orderBy("at")
    para = inner.join(holds, "doc_id").filter("at >= a and at < b").withColumn("seq", F.row_number().over(in_art)).withColumn("span_end", F.coalesce(F.lead("at").over(in_art), F.col("b")))
    para = para.select("doc_id", F.lit("paragraph").alias("node_type"), F.concat(F.lit("P-"), "number", F.lit("."), F.col("seq").cast("string"), F.when(F.col("mark") == "lettered", F.concat(F.lit("("), "label", F.lit(")"))).otherwise(F.col("label"))).alias("identifier"), F.concat("parent_lineage", F.lit(":para:"), F.col("seq").cast("string")).alias("lineage_id"), "parent_lineage", none.alias("title"), F.col("at").alias("span_start"), "span_end")
    tabs = m.filter("mark = 'table'").withColumn("seq", F.row_number().over(by_doc)).select("doc_id", "seq", F.col("span_start").alias("at"), F.col("span_end").alias("till"))
    held = tabs.join(holds, "doc_id").filter("at >= a and at < b").select("doc_id", "seq", "parent_lineage")
    tab = tabs.join(held, ["doc_id", "seq"], "left").select("doc_id", F.lit("table").alias("node_type"), F.concat(F.lit("TAB-"), F.col("seq").cast("string")).alias("identifier"), F.concat("doc_id", F.lit(":table:"), F.col("seq").cast("string")).alias("lineage_id"), F.coalesce("parent_lineage", root).alias("parent_lineage"), none.alias("title"), F.col("at").alias("span_start"), F.col("till").alias("span_end"))
    out = doc.select(cols)
    for x in (pre, chap, art, para, tab):
        out = out.unionByName(x.select(cols))
    return out


def _fold(parts: list[dict], least: int) -> list[dict]:
    """Chunks shorter than ``least`` go into the one before; the first goes into the next. Where all are shorter, they become one."""
    out: list[dict] = []
    wait: list[dict] = []
    for p in parts:
        if p["end"] - p["start"] < least:
            if out:
                out[-1]["end"] = max(out[-1]["end"], p["end"])
                out[-1]["absorbed"].append(p["lineage"])
            else:
                wait.append(p)
            continue
        if wait:
            p = p | {"start": wait[0]["start"], "absorbed": [w["lineage"] for w in wait] + p["absorbed"]}
            wait = []
        out.append(p)
    if wait:
        # nothing is long enough to take the thin ones, so they become one chunk
        out = [wait[0] | {"end": max(w["end"] for w in wait), "absorbed": [*wait[0]["absorbed"], *(x for w in wait[1:] for x in [w["lineage"], *w["absorbed"]])]}]
    return out


def sentence_parts(doc: str, text: str, most: int = MAX_SENTENCES, least: int = MIN_CHUNK, by_offset: bool = False) -> list[dict]:
    """Packs of sentences of at most ``most`` characters; with ``by_offset`` the pack's absolute end is held against the limit instead of its length."""
    out: list[dict] = []
    pack: list[tuple[int, int]] = []

    def close() -> None:
        if pack:
            a, b = pack[0][0], pack[-1][1]
            out.append({"kind": "sentence", "start": a, "end": b, "lineage": f"{doc}:sentence:{a}-{b}", "absorbed": [f"{doc}:sentence:{x}-{y}" for x, y in pack[1:]], "node": f"SENT-{a}", "title": None})
            pack.clear()

    for m in _SENTENCE.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip())
        if b <= a:
            continue
        if b - a > most:
            close()
            pack.append((a, b))
            close()
            continue
        if pack and (pack[-1][1] + 1 + (b - a) if by_offset else b - pack[0][0]) > most:
            close()
        pack.append((a, b))
    close()
    return out if by_offset else _fold(out, least)


def article_parts(doc: str, text: str, most: int = MAX_ARTICLE, least: int = MIN_CHUNK, drop_oversize: bool = False) -> list[dict]:
    """The preamble and each article as chunks. Articles beyond ``most`` become their paragraphs, or are dropped with ``drop_oversize``."""
    heads, seen, parts = article_heads(text), set(), []
    if heads and text[: heads[0]["start"]].strip():
        parts.append({"kind": "preamble", "start": 0, "end": heads[0]["start"], "lineage": f"{doc}:preamble", "absorbed": [], "node": "PRE-0", "title": None})
    for k, a in enumerate(heads):
        end = heads[k + 1]["start"] if k + 1 < len(heads) else len(text)
        if a["number"] in seen:
            continue
        seen.add(a["number"])
        lineage = f"{doc}:article:{a['number']}"
        if end - a["start"] <= most:
            parts.append({"kind": "article", "start": a["start"], "end": end, "lineage": lineage, "absorbed": [], "node": f"ART-{a['number']}", "title": a["title"]})
        elif not drop_oversize:
            cuts = sorted({a["start"], *(m.start() for p in (_LETTERED, _NUMBERED) for m in p.finditer(text, a["start"], end))})
            for n, (x, y) in enumerate(zip(cuts, [*cuts[1:], end])):
                parts.append({"kind": "paragraph" if n else "article", "start": x, "end": y, "lineage": f"{lineage}:para:{n}" if n else lineage, "absorbed": [], "node": f"P-{a['number']}.{n}", "title": a["title"]})
    return _fold(parts, least)


CHUNKS = "lineage_id string, doc_id string, node_id string, node_type string, text string, span_start int, span_end int, chapter string, thin boolean, absorbed array<string>"


def chunk_documents(docs: DataFrame, drop_oversize: bool = False, by_offset: bool = False) -> DataFrame:
    """Chunks of each document: CHUNKS. Documents with articles are cut by article, others by sentences.

    Spans are half open; a chunk's text is its slice without outer blanks. ``drop_oversize`` and ``by_offset`` reproduce
    two known habits of such pipelines: losing articles beyond the limit, and packing by absolute offset.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                parts = article_parts(d, t, drop_oversize=drop_oversize) if article_heads(t) else sentence_parts(d, t, by_offset=by_offset)
                chapters = [(m.start(), m[2]) for m in _CHAPTER.finditer(t)]
                at = [c for c, _ in chapters]
                for p in parts:
                    k = bisect_right(at, p["start"]) - 1
                    s = t[p["start"] : p["end"]].strip()
                    rows.append((p["lineage"], d, p["node"], p["kind"], s, p["start"], p["end"], chapters[k][1] if k >= 0 else None, len(s) < MIN_CHUNK, p["absorbed"]))
            yield pd.DataFrame(rows, columns=["lineage_id", "doc_id", "node_id", "node_type", "text", "span_start", "span_end", "chapter", "thin", "absorbed"])

    return spread(docs.filter("text != ''").select(F.col("doc_id").cast("string").alias("doc_id"), "text")).mapInPandas(run, CHUNKS)


def recover_oversized(tree: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks for articles of the tree that no chunk holds, cut from the source: lineage_id, doc_id, text, recovered."""
    lost = tree.filter("node_type = 'article'").join(chunks.select("lineage_id"), "lineage_id", "left_anti").join(chunks.select(F.explode("absorbed").alias("lineage_id")), "lineage_id", "left_anti")
    x = lost.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("source")), "doc_id")
    return x.select("lineage_id", "doc_id", F.btrim(F.substring("source", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")), F.lit(" \t\r\n")).alias("text"), F.lit(True).alias("recovered"))


def line_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_start, line): lines from 1 and their offsets, by a running sum of lengths within the row."""
    x = docs.filter("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    starts = F.aggregate("lines", F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("at")), lambda a, l: F.struct(F.concat(a["s"], F.array(a["at"])).alias("s"), (a["at"] + F.length(l) + 1).alias("at")), lambda a: a["s"])
    z = x.select("doc_id", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), starts.alias("line_start"))).alias("pos", "z"))
    return z.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("z.line_start").alias("line_start"), F.col("z.line").alias("line"))


def span_problems(chunks: DataFrame) -> DataFrame:
    """(doc_id, lineage_id, problem): spans that are inverted, too short, or overlap the one before in their document; blank texts."""
    w = Window.partitionBy("doc_id").orderBy("span_start", "span_end", "lineage_id")
    x = chunks.withColumn("_before", F.lag("span_end").over(w))
    tests = [("inverted", F.col("span_end") <= F.col("span_start")), ("short", (F.col("span_end") - F.col("span_start")).between(1, 7)), ("overlap", F.col("span_start") < F.col("_before")), ("blank", F.coalesce(F.btrim("text", F.lit(" \t\r\n")), F.lit("")) == "")]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda p: p.isNotNull())
    return x.select("doc_id", "lineage_id", F.explode(found).alias("problem"))


def fold_islands(chunks: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """Folding of thin chunks as a running count: each chunk of ``least`` characters opens an island, the thin ones join the island before.

    Out: doc_id, island, span_start, span_end, n_chunks, absorbed. Thin chunks at the start join the first island.
    """
    w = Window.partitionBy("doc_id").orderBy("span_start", "lineage_id")
    x = chunks.withColumn("_big", (F.length(F.coalesce("text", F.lit(""))) >= least).cast("int"))
    x = x.withColumn("island", F.greatest(F.sum("_big").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)))
    return x.groupBy("doc_id", "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.count("*").alias("n_chunks"), F.sort_array(F.collect_list(F.when(F.col("_big") == 0, F.col("lineage_id")))).alias("absorbed"))


def coverage_audit(maps: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, articles, chapters, tables, instrument, date, coverage): how far structure maps meet what is expected of them.

    ``truth``: doc_id, articles, chapters, tables (counts), instrument, publication_date; a null expectation is met.
    ``coverage`` is the mean of the five.
    """
    x = truth.select("doc_id", *[F.col(c).alias(f"t_{c}") for c in ("articles", "chapters", "tables", "instrument", "publication_date")]).join(maps, "doc_id", "left")
    near = lambda c: T.closeness(F.col(c), F.col(f"t_{c}"))
    same = lambda c: T.lenient_match(F.col(c), F.col(f"t_{c}"))
    x = x.select("doc_id", near("articles").alias("articles"), near("chapters").alias("chapters"), near("tables").alias("tables"), same("instrument").alias("instrument"), same("publication_date").alias("date"))
    return x.withColumn("coverage", F.round((F.col("articles") + F.col("chapters") + F.col("tables") + F.col("instrument") + F.col("date")) / 5, 6))
