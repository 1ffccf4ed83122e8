"""Typed relations between articles, documents, terms and entities, extracted from text."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..scale import spread, write_table
from .structure import article_heads, table_blocks

_MENTION, _MORE = re.compile(fixed.ARTICLE_MENTION), re.compile(fixed.LIST_GOES_ON)
_LINK, _NUMBER = re.compile(fixed.CONNECTOR), re.compile(fixed.CONNECTED_NUMBER)
_PAIRS = {"AMENDS": re.compile(fixed.AMENDING), "IMPLEMENTS": re.compile(fixed.IMPLEMENTING), "SUPERSEDES": re.compile(fixed.SUPERSEDING)}
_SCOPE = re.compile(fixed.SCOPE_ANCHOR)
_ENTITIES = [(label, re.compile("(?i)" + p)) for label, p in fixed.ENTITIES]
_TERMS, _BARE = [re.compile(p) for p in fixed.QUOTED_TERM], re.compile(fixed.BARE_TERM)

MENTIONS = "doc_id string, kind string, host string, ref string, instrument string, char_offset int, snippet string, build_order int"


def list_members(text: str, at: int, whole: bool = True) -> list[str]:
    """Numbers that follow a mention in a list or range, however long; only the first without ``whole``. Ranges give their ends."""
    out: list[str] = []
    while m := _MORE.match(text, at):
        out.append(m[1])
        at = m.end()
        if not whole:
            break
    return out


def instrument_after(text: str, at: int) -> str | None:
    """Number of the instrument that a connector right after a mention leads to."""
    window = text[at : at + 120]
    for m in _LINK.finditer(window):
        n = _NUMBER.match(window, m.end(), m.end() + 30)
        if n:
            return n[1]
    return None


def first_entity(window: str) -> str | None:
    """Label of the entity named first in a text; of those at one place the longest."""
    hits = [(m.start(), -len(m[0]), label) for label, p in _ENTITIES for m in p.finditer(window)]
    return min(hits)[2] if hits else None


def mentions_of(doc: str, text: str, whole_lists: bool = True) -> list[tuple]:
    heads = article_heads(text)
    spans, first = [], {}
    for k, h in enumerate(heads):
        end = heads[k + 1]["start"] if k + 1 < len(heads) else len(text)
        spans.append((h["start"], end, h["number"], h["line_end"]))
        first.setdefault(h["number"], k)
    tables = [(b["start"], b["end"]) for b in table_blocks(text)]

    def host(at: int) -> str:
        for a, b, n, _ in spans:
            if a <= at < b:
                return f"{doc}:article:{n}"
        return f"{doc}:preamble" if spans and at < spans[0][0] else f"{doc}:article:{spans[-1][2]}" if spans else f"{doc}:document"

    out: list[tuple] = []

    def add(kind, at, ref, instrument, length, src=None):
        out.append((doc, kind, src or host(at), ref, instrument, at, re.sub(r"\s+", " ", text[at : at + length]).strip()[:120], len(out)))

    for a, b, n, line_end in spans:
        add("PART_OF", a, f"{doc}:document", None, 0, f"{doc}:article:{n}")
        for m in _MENTION.finditer(text, a, b):
            if (m[1] == n and m.start() <= line_end) or any(x <= m.start() < y for x, y in tables):
                continue
            instrument = instrument_after(text, m.end())
            for ref in dict.fromkeys([m[1], *list_members(text, m.end(), whole_lists)]):
                add("CROSS_REFERENCES", m.start(), ref, instrument, 240, f"{doc}:article:{n}")
    for m in _PAIRS["AMENDS"].finditer(text):
        add("AMENDS", m.start(), m[1], m[1], m.end() - m.start())
    for kind in ("IMPLEMENTS", "SUPERSEDES"):
        for m in _PAIRS[kind].finditer(text):
            x, y = m[1], m[2]
            if kind == "SUPERSEDES" and x[:4] < y[:4]:
                x, y = y, x  # the newer one supersedes, whichever is named first
            if x != y:
                add(kind, m.start(), y, x, m.end() - m.start())
    seen = set()
    definition = next(((a, b) for (a, b, n, _), h in zip(spans, heads) if h["title"] and re.search("(?i)definitions?", h["title"])), (0, spans[0][0]) if spans else (0, len(text)))
    for p in [*_TERMS, _BARE]:
        for m in p.finditer(text, *(definition if p is _BARE else (0, len(text)))):
            term = m[1].strip()
            if term not in seen:
                seen.add(term)
                add("DEFINED_IN", m.start(), term, None, 240)
    for m in _SCOPE.finditer(text):
        if label := first_entity(text[m.end() : m.end() + 90]):
            add("APPLIES_TO", m.start(), label, None, 140)
    return out


def mentions(docs: DataFrame, whole_lists: bool = True) -> DataFrame:
    """All mentions of each document (doc_id, text), unresolved: MENTIONS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for d, t in zip(pdf["doc_id"], pdf["text"]) if t for r in mentions_of(d, t, whole_lists)], columns=["doc_id", "kind", "host", "ref", "instrument", "char_offset", "snippet", "build_order"])

    return spread(docs.filter("text != ''").select(F.col("doc_id").cast("string").alias("doc_id"), "text")).mapInPandas(run, MENTIONS)


def instrument_index(docs: DataFrame, number: str = "instrument") -> DataFrame:
    """(number, target_doc): the first document of each instrument number, also under the number with year and serial swapped."""
    x = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.regexp_extract(number, r"(\d{2,5}/\d{2,5})", 1).alias("number")).filter("number != ''")
    swapped = F.concat_ws("/", F.element_at(F.split("number", "/"), 2), F.element_at(F.split("number", "/"), 1))
    both = x.select("doc_id", "number", F.lit(0).alias("p")).unionByName(x.select("doc_id", swapped.alias("number"), F.lit(1).alias("p")))
    return both.groupBy("number").agg(F.min(F.struct("p", F.length("doc_id").alias("n"), "doc_id")).alias("m")).select("number", F.col("m.doc_id").alias("target_doc"))


def resolve(found: DataFrame, articles: DataFrame, index: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, doc_id, char_offset, snippet, unresolved, ref_number, instrument, cites): one of each (src, dst, kind), the first mention.

    Numbers with an instrument go to that instrument's document, others to their own; articles that no document has
    become ``ext:article:{n}``, instruments ``ext:instrument:{yyyy-n}``. A self-reference without instrument is dropped.
    """
    by_number = found.filter("kind in ('CROSS_REFERENCES', 'AMENDS', 'IMPLEMENTS', 'SUPERSEDES')").join(index.withColumnRenamed("number", "instrument"), "instrument", "left")
    rest = found.filter("kind in ('PART_OF', 'DEFINED_IN', 'APPLIES_TO')").withColumn("target_doc", F.lit(None).cast("string"))
    x = by_number.select(*found.columns, "target_doc").unionByName(rest.select(*found.columns, "target_doc"))
    other = index.select(F.col("number").alias("ref"), F.col("target_doc").alias("ref_doc"))
    x = x.join(other, "ref", "left")
    there = F.when(F.col("kind") == "CROSS_REFERENCES", F.concat(F.when(F.col("instrument").isNull(), F.col("doc_id")).otherwise(F.col("target_doc")), F.lit(":article:"), F.col("ref")))
    x = x.withColumn("want", there).join(articles.select(F.col("lineage_id").alias("want"), F.lit(True).alias("known")).distinct(), "want", "left")
    stub = F.concat(F.lit("ext:instrument:"), F.lower(F.replace("ref", F.lit("/"), F.lit("-"))))
    other_doc = F.coalesce(F.concat("ref_doc", F.lit(":document")), stub)
    dst = (F.when(F.col("kind") == "PART_OF", F.col("ref")).when(F.col("kind") == "CROSS_REFERENCES", F.when(F.col("known"), F.col("want")).otherwise(F.concat(F.lit("ext:article:"), "ref")))
           .when(F.col("kind").isin("AMENDS", "IMPLEMENTS", "SUPERSEDES"), other_doc).when(F.col("kind") == "APPLIES_TO", F.concat(F.lit("corpus:entity:"), T.slug(F.col("ref")))).otherwise(F.col("host")))
    src = F.when(F.col("kind") == "DEFINED_IN", F.concat("doc_id", F.lit(":term:"), T.slug(F.col("ref")))).when(F.col("kind").isin("IMPLEMENTS", "SUPERSEDES"), F.coalesce(F.concat("target_doc", F.lit(":document")), F.concat(F.lit("ext:instrument:"), F.replace("instrument", F.lit("/"), F.lit("-"))))).otherwise(F.col("host"))
    e = x.select(src.alias("src"), dst.alias("dst"), "kind", "doc_id", "char_offset", "snippet", dst.startswith("ext:").alias("unresolved"), F.when(F.col("kind") == "CROSS_REFERENCES", F.col("ref")).alias("ref_number"), "instrument", "build_order")
    e = e.filter((F.col("src") != F.col("dst")) | F.col("instrument").isNotNull())
    first = e.groupBy("src", "dst", "kind").agg(F.min(F.struct("doc_id", "build_order", "char_offset", "snippet", "unresolved", "ref_number", "instrument")).alias("m"))
    return first.select("src", "dst", "kind", "m.doc_id", "m.char_offset", "m.snippet", "m.unresolved", "m.ref_number", "m.instrument", ((F.col("kind") == "CROSS_REFERENCES") & (T.doc_of(F.col("src")) != T.doc_of(F.col("dst")))).alias("cites"))


def build_graph(docs: DataFrame, whole_lists: bool = True) -> DataFrame:
    """Edges of a corpus (doc_id, text, instrument), see ``resolve``."""
    found, _ = write_table(mentions(docs, whole_lists), "mentions")  # texts are searched once
    articles = found.filter("kind = 'PART_OF'").select(F.col("host").alias("lineage_id"))
    return resolve(found, articles, instrument_index(docs))


def graph_nodes(docs: DataFrame, edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(lineage_id, kind, doc_id, title, term): nodes of the documents' trees and of all ends of edges, one row per key, the first source wins."""
    none = F.lit(None).cast("string")
    a = tree.filter("node_type in ('document', 'preamble', 'article')").select("lineage_id", F.col("node_type").alias("kind"), "doc_id", "title", none.alias("term"), F.lit(0).alias("prio"))
    ends = edges.select(F.col("src").alias("lineage_id")).unionByName(edges.select(F.col("dst").alias("lineage_id"))).distinct()
    last = F.element_at(F.split("lineage_id", ":"), -1)
    kind = (F.when(F.col("lineage_id").startswith("ext:article:"), "external_article").when(F.col("lineage_id").startswith("ext:"), "external_document").when(F.col("lineage_id").startswith("corpus:"), "entity")
            .when(F.col("lineage_id").contains(":term:"), "term").when(F.col("lineage_id").contains(":article:"), "article").when(F.col("lineage_id").endswith(":preamble"), "preamble").otherwise("document"))
    b = ends.select("lineage_id", kind.alias("kind"), T.doc_of(F.col("lineage_id")).alias("doc_id"), none.alias("title"), F.when(kind.isin("term", "entity"), last).alias("term"), F.lit(1).alias("prio"))
    first = a.unionByName(b).groupBy("lineage_id").agg(F.min(F.struct("prio", "kind", "doc_id", "title", "term")).alias("m"))
    return first.select("lineage_id", "m.kind", "m.doc_id", "m.title", "m.term")


def first_wins(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_edges(old: DataFrame, new: DataFrame, replaced: list[str]) -> DataFrame:
    """Additive migration: edges of the ``replaced`` kinds are dropped, the new ones added unless their key is there."""
    kept = old.filter(~F.col("kind").isin(replaced))
    return kept.unionByName(new.join(kept.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti").dropDuplicates(["src", "dst", "kind"]), allowMissingColumns=True)
