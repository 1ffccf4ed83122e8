"""What a reranker or a generator is shown, and the checks on what comes back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..scale import likely, write_table


def _labels(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _links(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, snip, ord): each link once, with its longest evidence cut to SNIPPET characters; links of a node to itself are left out."""
    text = F.trim(F.coalesce(F.col("snippet") if "snippet" in edges.columns else F.lit(None).cast("string"), F.lit("")))
    order = F.col("edge_ord") if "edge_ord" in edges.columns else F.lit(0)
    e = edges.filter("src is not null and dst is not null and src != dst").select("src", "dst", "kind", text.alias("t"), order.alias("o"))
    e = e.groupBy("src", "dst", "kind").agg(F.max_by("t", F.struct(F.length("t"), -F.col("o"))).alias("t"), F.min("o").alias("ord"))
    flat = F.regexp_replace("t", r"\s+", " ")
    return e.select("src", "dst", "kind", F.when(F.length(flat) <= SNIPPET, flat).otherwise(F.concat(F.substring(flat, 1, SNIPPET - 1), F.lit("…"))).alias("snip"), "ord")


#: Characters of evidence in a line.
SNIPPET = 120
DEFINING = ["DEFINED_IN", "APPLIES_TO"]


def context_lines(candidates: DataFrame, edges: DataFrame, names: DataFrame, most: int = 8, chars: int = 2000, kinds: list[str] | None = None, directions: tuple[str, ...] = ("out", "in"),
                  snippets: bool = True, paths: bool = True, definitions: bool = True, most_paths: int = 3) -> DataFrame:
    """(query_id, lineage_id, n_lines, context): typed lines of the graph around each candidate (query_id, lineage_id, question).

    Outgoing lines come before incoming, each ordered by how many words of the question the neighbour's name and the
    evidence share, then by the neighbour. One line per (kind, direction, neighbour), at most ``most`` lines (the first
    incoming one is shown even if outgoing ones reach it). Behind them up to ``most_paths`` lines 'VIA middle → end' show
    nodes two outgoing steps away that no line names yet, each by its best way. No line is added beyond ``chars``
    characters in all. ``kinds``, ``definitions`` (DEFINED_IN and APPLIES_TO) and ``directions`` restrict the lines of one step,
    ``snippets`` and ``paths`` leave out the evidence and the paths. Candidates that are no node, or have no line, give no row.
    """
    if not set(directions) <= {"out", "in"} or not directions:
        raise ValueError(f"unknown directions {directions!r}")
    known = names.select("node_id", T.node_label(F.col("kind"), F.col("title"), F.col("term"), F.col("art_number"), F.col("node_id")).alias("name"))
    seeds, _ = write_table(candidates.select("query_id", "lineage_id", "question").distinct().join(names.select(F.col("node_id").alias("lineage_id")), "lineage_id", "left_semi"), "seeds")
    no = F.lit(None).cast("string")
    # links are gathered only where they start or end at a candidate, or start one step behind one
    near = seeds.select(F.col("lineage_id").alias("node_id")).distinct()
    start_at = near.unionByName(likely(edges.select("src", F.col("dst").alias("node_id")), "src", near).select("node_id")) if paths else near
    ahead, _ = write_table(_links(likely(edges, "src", start_at)), "links")
    behind = _links(likely(edges, "dst", near))
    if not snippets:
        ahead, behind = ahead.withColumn("snip", F.lit("")), behind.withColumn("snip", F.lit(""))

    def named(x: DataFrame, node: str, out: str) -> DataFrame:
        x = x.join(known.select(F.col("node_id").alias(node), F.col("name").alias(out)), node, "left")
        return x.withColumn(out, F.coalesce(out, T.node_label(no, no, no, no, F.col(node))))

    quoted = F.when(F.col("snip") != "", F.concat(F.lit(' — "'), "snip", F.lit('"'))).otherwise("")
    shows = F.lit(True) if kinds is None else F.col("kind").isin(kinds)
    shows = shows if definitions else shows & ~F.col("kind").isin(DEFINING)
    way = lambda link, here, there, n, table: link.filter(shows).select(F.col(here).alias("lineage_id"), F.col(there).alias("other"), F.lit(n).alias("way"), F.coalesce(_labels(table)[F.col("kind")], F.col("kind")).alias("label"), "snip", "ord")
    shown = [w for d, w in (("out", way(ahead, "src", "dst", 0, fixed.OUT_LABEL)), ("in", way(behind, "dst", "src", 1, fixed.IN_LABEL))) if d in directions]
    x = named(seeds.join(shown[0] if len(shown) == 1 else shown[0].unionByName(shown[1]), "lineage_id"), "other", "name")
    x = x.withColumn("score", T.overlap_score(F.col("question"), F.concat("name", F.lit(" "), "snip")))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "lineage_id", "way").orderBy(F.col("score").desc(), "other", "ord"))).filter(F.col("n") <= most)
    x = x.withColumn("line", F.concat("label", F.lit(" "), "name", quoted))
    g = x.groupBy("query_id", "lineage_id").agg(F.array_sort(F.collect_list(F.struct("way", "n", "line", "other"))).alias("l"))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.array().cast("array<string>").alias("others"), F.lit(0).alias("used"), F.lit(0).alias("n_in"))

    def add(a: Column, i: Column) -> Column:
        room = (F.size(a["lines"]) < most) | ((i["way"] == 1) & (a["n_in"] == 0))
        fits = room & (a["used"] + F.length(i["line"]) + 2 <= chars)
        more = F.struct(F.array_append(a["lines"], i["line"]).alias("lines"), F.array_append(a["others"], i["other"]).alias("others"), (a["used"] + F.length(i["line"])).alias("used"), (a["n_in"] + (i["way"] == 1).cast("int")).alias("n_in"))
        return F.when(fits, more).otherwise(a)

    lines = g.select("query_id", "lineage_id", F.aggregate("l", start, add).alias("a")).select("query_id", "lineage_id", "a.lines", "a.others", "a.used")
    if paths:
        lines, _ = write_table(lines, "lines")
        steps = seeds.join(ahead.select(F.col("src").alias("lineage_id"), F.col("dst").alias("mid")).distinct(), "lineage_id").join(lines.select("query_id", "lineage_id", "others"), ["query_id", "lineage_id"], "left")
        to = named(ahead.select(F.col("src").alias("mid"), F.col("dst").alias("end"), "snip", "ord"), "end", "end_name")
        ends = named(steps, "mid", "mid_name").join(to, "mid").filter((F.col("end") != F.col("lineage_id")) & ~F.coalesce(F.array_contains("others", F.col("end")), F.lit(False))).drop("others").withColumn("via", F.concat("mid_name", F.lit(" → "), "end_name"))
        ends = ends.withColumn("score", T.overlap_score(F.col("question"), F.concat("via", F.lit(" "), "snip"))).withColumn("line", F.concat(F.lit("VIA "), "via", quoted))
        # an end among the first has at most most_paths - 1 ends before it behind its own middle node, so only so many leave it
        ends = ends.groupBy("mid", "query_id", "lineage_id", "end").agg(F.min(F.struct((-F.col("score")).alias("s"), "mid", "ord", "line")).alias("m"))
        ends = ends.withColumn("n", F.row_number().over(Window.partitionBy("mid", "query_id", "lineage_id").orderBy("m", "end"))).filter(F.col("n") <= most_paths)
        best = ends.groupBy("query_id", "lineage_id", "end").agg(F.min("m").alias("m"))
        best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "lineage_id").orderBy("m", "end"))).filter(F.col("n") <= most_paths)
        best = best.groupBy("query_id", "lineage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("m.line").alias("line")))), lambda y: y["line"]).alias("vias"))
        x = lines.join(best, ["query_id", "lineage_id"], "full_outer").select("query_id", "lineage_id", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("vias", F.array().cast("array<string>")).alias("vias"))
        begin = F.struct(F.col("lines"), F.col("used"), F.lit(True).alias("on"))
        put = lambda a, v: F.struct(F.when(a["on"] & (a["used"] + F.length(v) + 2 <= chars), F.array_append(a["lines"], v)).otherwise(a["lines"]).alias("lines"), (a["used"] + F.length(v)).alias("used"), (a["on"] & (a["used"] + F.length(v) + 2 <= chars)).alias("on"))
        lines = x.select("query_id", "lineage_id", F.aggregate("vias", begin, put)["lines"].alias("lines"))
    return lines.filter("size(lines) > 0").select("query_id", "lineage_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("context"))


def rerank(pool: DataFrame, order: DataFrame) -> DataFrame:
    """(query_id, lineage_id, rank, status): a model's order (query_id, order: positions from 1) applied to a ranked pool.

    It counts only if it is an exact permutation of the pool; else the pool's own order stays ('fallback').
    """
    size = pool.groupBy("query_id").agg(F.count("*").alias("size"))
    o = size.join(order, "query_id", "left")
    fair = F.coalesce(F.array_sort("order") == F.sequence(F.lit(1), F.col("size").cast("int")), F.lit(False))
    o = o.select("query_id", fair.alias("fair"), "order")
    x = pool.join(o, "query_id", "left")
    rank = F.when(F.col("fair"), F.array_position("order", F.col("rank").cast("int"))).otherwise(F.col("rank"))
    return x.select("query_id", "lineage_id", rank.cast("long").alias("rank"), F.when(F.col("fair"), "reranked").otherwise("fallback").alias("status"))


def lexical_order(pool: DataFrame) -> DataFrame:
    """Stand-in reranker: the order of a pool (query_id, question, rank, text) by shared words, then by rank."""
    w = Window.partitionBy("query_id").orderBy(T.overlap_score(F.col("question"), F.col("text")).desc(), "rank")
    x = pool.withColumn("n", F.row_number().over(w))
    return x.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("rank").cast("int").alias("r")))), lambda s: s["r"]).alias("order"))


def rerank_prompt(pool: DataFrame, cap: int = 20, chars: int = 500) -> DataFrame:
    """(query_id, prompt): a listwise prompt of the first ``cap`` candidates (query_id, question, rank, text)."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 1, chars), F.when(F.length("text") > chars, " …").otherwise(""))
    g = pool.filter(F.col("rank") <= cap).groupBy("query_id").agg(F.first("question").alias("q"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return g.select("query_id", F.concat(F.lit("Question: "), "q", F.lit("\nOrder these passages by relevance, best first, as a JSON list of their numbers.\n"), F.array_join("l.line", "\n")).alias("prompt"))


def parse_order(answer: Column) -> Column:
    """Positions in a model's answer: the integers of its first list, each once; null without a list."""
    raw = F.regexp_extract(answer, r"\[([\d,\s]+)\]", 1)
    return F.when(raw != "", F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))))


def answer_context(rows: DataFrame, lines: int = 20, provenance: int = 40) -> DataFrame:
    """(query_id, context, refused): the sections of a graph answer from ranked rows (query_id, rank, lineage_id, doc_id, text, edge).

    Sections: documents (in order, once each), passages, relations, provenance; '(none)' where one is empty. A query
    without rows is refused by ``refuse``.
    """
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lineage_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("edge", F.lit("")).alias("edge")))).alias("r"))
    r = F.col("r")
    part = lambda title, items, most: F.concat(F.lit(f"## {title}\n"), F.coalesce(F.nullif(F.array_join(F.slice(items, 1, most), "\n"), F.lit("")), F.lit("(none)")))
    passages = F.filter(F.transform(r, lambda x: F.concat(x["lineage_id"], F.lit(": "), T.truncate(x["text"], 300))), lambda s: s.isNotNull())
    relations = F.filter(F.transform(r, lambda x: F.when(x["edge"] != "", F.concat(x["lineage_id"], F.lit(" via "), x["edge"]))), lambda s: s.isNotNull())
    text = F.concat_ws("\n\n", part("Documents", F.array_distinct(F.filter(r["doc_id"], lambda d: d.isNotNull())), lines), part("Passages", passages, lines), part("Relations", relations, lines), part("Provenance", F.array_distinct(r["lineage_id"]), provenance))
    return g.select("query_id", text.alias("context"))


def refuse(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """All queries with their context; those without one get '[INSUFFICIENT CONTEXT]' and refused = true, and no model need be called."""
    x = queries.join(contexts, "query_id", "left")
    return x.withColumn("refused", F.col("context").isNull()).withColumn("context", F.coalesce("context", F.lit("[INSUFFICIENT CONTEXT]")))


def invented_citations(answer: Column, provenance: Column) -> Column:
    """Lineages that an answer names and its provenance does not hold."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(T.text_or_empty(answer), F.lit(r"[a-z0-9_]+:(?:article:\d+[a-z]?|preamble|table:\d+|document)"), F.lit(0))), F.coalesce(provenance, F.array().cast("array<string>"))))
