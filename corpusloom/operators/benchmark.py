"""Construction and audit of retrieval benchmarks from a graph and its chunks.

Items are (item_id, family, question, sources, target, path): ``path`` is an array of (src, kind, dst), ``target`` the
lineage that answers. Candidates are made by joins; allocation under quotas needs only a bounded head of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graphs import distractors, two_hop_chains

#: Items wanted of each family, in the order in which families choose.
QUOTAS = {"single_document": 15, "non_relational": 5, "one_hop": 10, "two_hop": 10, "relation_direction": 5, "temporal": 5, "graph_distractor": 5, "multi_doc": 5}
HELDOUT_QUOTAS = {"single_document": 50, "non_relational": 20, "one_hop": 30, "two_hop": 30, "relation_direction": 18, "temporal": 10, "graph_distractor": 18, "multi_doc": 20}

_COLS = ["family", "order_key", "question", "target", "path"]


def _label(c):
    return F.coalesce(F.when(c.contains(":article:"), F.concat(F.lit("Article "), F.regexp_extract(c, r":article:([^:]+)", 1), F.lit(" of "), T.doc_of(c))), F.element_at(F.split(c, ":"), -1))


def _hop(src, kind, dst):
    return F.struct(src.alias("src"), kind.alias("kind"), dst.alias("dst"))


def candidates(edges: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(family, order_key, question, target, path) of every family, from edges (src, dst, kind, edge_ord), nodes (node_id, kind, title, term) and chunks (lineage_id, node_type). Targets without a record are no candidates."""
    e = edges.filter("src is not null and dst is not null")
    src, dst, kind = F.col("src"), F.col("dst"), F.col("kind")
    pad = F.lpad(F.col("edge_ord").cast("string"), 20, "0")
    one_path = F.array(_hop(src, kind, dst))
    none = F.array().cast("array<struct<src:string,kind:string,dst:string>>")
    single = chunks.filter("node_type = 'article'").join(nodes.select(F.col("node_id").alias("lineage_id"), "title"), "lineage_id").select(
        F.lit("single_document").alias("family"), F.col("lineage_id").alias("order_key"), F.concat(F.lit("What does "), _label(F.col("lineage_id")), F.lit(" provide on "), F.coalesce("title", F.lit("its subject")), F.lit("?")).alias("question"), F.col("lineage_id").alias("target"), none.alias("path"))
    term = e.filter("kind = 'DEFINED_IN'").join(nodes.filter("length(term) >= 4").select(F.col("node_id").alias("src"), "term"), "src")
    term = term.groupBy(F.lower("term").alias("t")).agg(F.min(F.struct("edge_ord", "src", "dst", "kind", "term")).alias("m")).select("m.*")
    non_rel = term.select(F.lit("non_relational").alias("family"), pad.alias("order_key"), F.concat(F.lit("How is '"), "term", F.lit("' defined?")).alias("question"), dst.alias("target"), one_path.alias("path"))
    ask = F.when(kind == "AMENDS", F.concat(F.lit("Which act does "), _label(src), F.lit(" amend?"))).when(kind == "APPLIES_TO", F.concat(F.lit("To whom does "), _label(src), F.lit(" apply?"))).otherwise(F.concat(F.lit("Which provision does "), _label(src), F.lit(" refer to?")))
    cross_doc = T.doc_of(src) != T.doc_of(dst)
    pool = e.filter(kind.isin("AMENDS", "APPLIES_TO") | ((kind == "CROSS_REFERENCES") & cross_doc))
    one = pool.select(F.lit("one_hop").alias("family"), F.concat_ws("|", src, pad).alias("order_key"), ask.alias("question"), dst.alias("target"), one_path.alias("path"))
    ch = two_hop_chains(edges, ["CROSS_REFERENCES", "AMENDS"])
    two = ch.select(F.lit("two_hop").alias("family"), F.concat_ws("|", "a", "b", "c").alias("order_key"), F.concat(F.lit("What does the provision that "), _label(F.col("a")), F.lit(" refers to refer to in turn?")).alias("question"), F.col("c").alias("target"), F.array(_hop(F.col("a"), F.col("k1"), F.col("b")), _hop(F.col("b"), F.col("k2"), F.col("c"))).alias("path"))
    direction = pool.select(F.lit("relation_direction").alias("family"), F.concat_ws("|", dst, src, pad).alias("order_key"), F.concat(F.lit("Does "), _label(src), F.lit(" refer to "), _label(dst), F.lit(", or the other way round?")).alias("question"), src.alias("target"), one_path.alias("path"))
    temporal = e.filter(kind.isin("AMENDS", "SUPERSEDES")).select(F.lit("temporal").alias("family"), F.concat_ws("|", kind, dst, src).alias("order_key"), F.concat(F.lit("Which act changed "), _label(dst), F.lit("?")).alias("question"), src.alias("target"), one_path.alias("path"))
    wrong = distractors(edges, 1).select(F.lit("graph_distractor").alias("family"), F.concat_ws("|", "src", "dst", "other").alias("order_key"), F.concat(F.lit("Does "), _label(F.col("src")), F.lit(" refer to "), _label(F.col("dst")), F.lit(" or to "), _label(F.col("other")), F.lit("?")).alias("question"), F.col("dst").alias("target"), F.array(_hop(F.col("src"), F.lit("CROSS_REFERENCES"), F.col("dst"))).alias("path"))
    multi = e.filter((kind == "CROSS_REFERENCES") & cross_doc).select(F.lit("multi_doc").alias("family"), F.concat_ws("|", T.doc_of(dst), src, dst).alias("order_key"), F.concat(F.lit("What do "), _label(src), F.lit(" and "), _label(dst), F.lit(" say together?")).alias("question"), dst.alias("target"), one_path.alias("path"))
    out = single.select(_COLS)
    for x in (non_rel, one, two, direction, temporal, wrong, multi):
        out = out.unionByName(x.select(_COLS))
    return out.join(nodes.select(F.col("node_id").alias("target")).distinct(), "target", "left_semi").select(_COLS)


def allocate(cands: DataFrame, quotas: dict[str, int], used: list[str] = (), prefix: str = "q") -> DataFrame:
    """Items chosen family by family in ``order_key`` order, no target twice and none of ``used``; a family that falls short is an error.

    When a family chooses, at most sum(quotas) targets are taken, so the first sum(quotas) different free targets of
    each family are all that the sequential choice can touch: a bounded number of rows, whatever the corpus holds.
    """
    spark = cands.sparkSession
    head = sum(quotas.values())
    free = cands.filter(F.col("family").isin(list(quotas)))
    if used:
        free = free.join(F.broadcast(spark.createDataFrame([(u,) for u in used], "target string")), "target", "left_anti")
    best = free.groupBy("family", "target").agg(F.min(F.struct("order_key", "question", "path")).alias("m")).select("family", "target", "m.*")
    w = Window.partitionBy("family").orderBy("order_key", "target")
    rows = best.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= head).orderBy("order_key", "target").collect()
    taken, items = set(), []
    for family, want in quotas.items():
        got = 0
        for r in rows:
            if got < want and r["family"] == family and r["target"] not in taken:
                taken.add(r["target"])
                items.append((f"{prefix}{len(items) + 1}", family, r["question"], r["target"], [tuple(h) for h in r["path"]]))
                got += 1
        if got < want:
            raise ValueError(f"family {family}: {got} of {want} items")
    return spark.createDataFrame(items, "item_id string, family string, question string, target string, path array<struct<src:string,kind:string,dst:string>>")


def item_problems(items: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(item_id, problem): a target that is unknown, a hop that is no edge, a path that is not connected."""
    hops = items.select("item_id", F.posexplode("path").alias("pos", "h")).select("item_id", "pos", "h.*")
    gone = hops.join(edges.select("src", "kind", "dst").distinct(), ["src", "kind", "dst"], "left_anti").select("item_id", F.lit("missing_edge").alias("problem"))
    w = Window.partitionBy("item_id").orderBy("pos")
    torn = hops.withColumn("_b", F.lag("dst").over(w)).filter("_b is not null and _b != src").select("item_id", F.lit("not_connected").alias("problem"))
    lost = items.join(known.select(F.col("lineage_id").alias("target")).distinct(), "target", "left_anti").select("item_id", F.lit("unknown_target").alias("problem"))
    return gone.unionByName(torn).unionByName(lost).distinct()


def leakage(a: DataFrame, b: DataFrame) -> DataFrame:
    """(check, n_shared): exact questions, targets and facts (path ends) that two benchmarks share."""
    fact = lambda d: d.select(F.explode("path").alias("h")).select(F.concat_ws("|", "h.src", "h.kind", "h.dst").alias("x"))
    parts = [("question", *(d.select(F.lower(F.trim("question")).alias("x")) for d in (a, b))), ("target", *(d.select(F.col("target").alias("x")) for d in (a, b))), ("fact", fact(a), fact(b))]
    out = None
    for name, x, y in parts:
        n = x.intersect(y).agg(F.count("*").alias("n_shared")).select(F.lit(name).alias("check"), "n_shared")
        out = n if out is None else out.unionByName(n)
    return out


def target_audit(items: DataFrame, known: DataFrame) -> DataFrame:
    """(item_id, family, target, status): whether the target is what the question names.

    OK_GRAPH (end of the path), OK_NAMED (article named in the question), WRONG_LETTER (same number, other letter),
    WRONG_DOCUMENT (same article of another document), MISSING (no such record), UNVERIFIED (the question names none).
    """
    refs = T.article_refs(F.col("question"))
    num, letter = T.article_num_of(F.col("target")), F.regexp_extract("target", r":article:\d+([a-z]?)", 1)
    there = known.select(F.col("lineage_id").alias("target"), F.lit(True).alias("there")).distinct()
    x = items.join(there, "target", "left")
    end = F.get(F.transform("path", lambda h: h["dst"]), F.size("path") - 1)
    starts = F.transform("path", lambda h: h["src"])
    same = F.exists(refs, lambda r: (r["num"] == num) & (r["letter"] == letter))
    loose = F.exists(refs, lambda r: r["num"] == num)
    status = (F.when(F.col("there").isNull(), "MISSING").when((end == F.col("target")) | F.array_contains(starts, F.col("target")), "OK_GRAPH").when(F.size(refs) == 0, "UNVERIFIED")
              .when(same & F.col("question").contains(T.doc_of(F.col("target"))), "OK_NAMED").when(same, "WRONG_DOCUMENT").when(loose, "WRONG_LETTER").otherwise("UNVERIFIED"))
    return x.select("item_id", "family", "target", status.alias("status"))


def repair_targets(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """Items with targets replaced by ``fixes`` (item_id, target); a fix without target is an error."""
    if fixes.filter("target is null").limit(1).count():
        raise ValueError("a fix has no target")
    return items.join(fixes.select("item_id", F.col("target").alias("_t")), "item_id", "left").withColumn("target", F.coalesce("_t", "target")).drop("_t")


def priority_match(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(want, lineage_id, step): the best chunk for a wanted article: 1 the article itself, 2 same number with another letter, 3 any article of its document, 4 its preamble, 5 any chunk.

    Steps 1 and 2 meet by document and number; the fallbacks are one row per document, so a large document adds no pairs.
    """
    doc, num = T.doc_of(F.col("lineage_id")), T.article_num_of(F.col("lineage_id"))
    c = chunks.select("lineage_id", doc.alias("doc"), num.alias("num")).distinct()
    is_art, is_pre = F.col("lineage_id").contains(":article:"), F.col("lineage_id").endswith(":preamble")
    fall = c.groupBy("doc").agg(F.min(F.when(is_art, F.col("lineage_id"))).alias("s3"), F.min(F.when(is_pre, F.col("lineage_id"))).alias("s4"), F.min("lineage_id").alias("s5"))
    same = c.filter("num is not null").groupBy("doc", "num").agg(F.min("lineage_id").alias("s2"))
    w = wanted.select("want").distinct().select("want", T.doc_of(F.col("want")).alias("doc"), T.article_num_of(F.col("want")).alias("num"))
    x = w.join(c.select(F.col("lineage_id").alias("want"), F.lit(True).alias("s1")).distinct(), "want", "left").join(same, ["doc", "num"], "left").join(fall, "doc", "left")
    pick = F.when(F.col("s1"), F.col("want"))
    step = F.when(F.col("s1"), 1).when(F.col("s2").isNotNull(), 2).when(F.col("s3").isNotNull(), 3).when(F.col("s4").isNotNull(), 4).when(F.col("s5").isNotNull(), 5)
    return x.select("want", F.coalesce(pick, "s2", "s3", "s4", "s5").alias("lineage_id"), step.alias("step"))


def scenarios(docs: DataFrame, per_doc: int = 3, seed: int = 2024) -> DataFrame:
    """(scenario_id, doc_id, compliant, text, deviation): obligations of each document, chosen by a seeded hash, with a weakened twin of each."""
    s = docs.filter("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array_distinct(T.obligation_sentences(F.col("text")))).alias("text"))
    w = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", F.lit(seed)), "text")
    s = s.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_doc).withColumn("weak", T.weaken(F.col("text")))
    both = F.explode(F.array(F.struct(F.lit(True).alias("compliant"), F.col("text").alias("text"), F.lit(None).cast("string").alias("deviation")), F.struct(F.lit(False).alias("compliant"), F.col("weak").alias("text"), F.lit("weakened_duty").alias("deviation")))).alias("x")
    return s.filter("weak is not null").select("doc_id", "n", both).select(F.concat_ws(":", "doc_id", F.col("n").cast("string"), F.when(F.col("x.compliant"), "ok").otherwise("bad")).alias("scenario_id"), "doc_id", "x.compliant", "x.text", "x.deviation")


def rebuild_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(question, change) between two builds matched by question: 'removed', 'added', or 'retargeted'."""
    a = old.select(F.lower(F.trim("question")).alias("question"), F.col("target").alias("a")).dropDuplicates(["question"])
    b = new.select(F.lower(F.trim("question")).alias("question"), F.col("target").alias("b")).dropDuplicates(["question"])
    x = a.join(b, "question", "full_outer").filter("a is null or b is null or a != b")
    return x.select("question", F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("retargeted").alias("change"))


def legacy_flags(items: DataFrame) -> DataFrame:
    """(item_id, flag): questions that name no article where their family asks for one ('no_article'), or carry a null name ('null_name')."""
    q = F.col("question")
    flags = F.array(F.when(q.rlike(r"\b[Nn]one\b|\bnull\b"), F.lit("null_name")), F.when((F.col("family") == "single_document") & ~q.rlike(r"(?i)article\s+\d"), F.lit("no_article")))
    return items.select("item_id", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("flag"))
