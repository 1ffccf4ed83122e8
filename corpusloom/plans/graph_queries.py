"""Queries over the graph: summaries, validation, expansion, benchmark construction, merges."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..keys import norm_key
from ..operators import benchmark as bm
from ..operators import context as cx
from ..operators import expansion as ex
from ..operators import graphs as g
from ..operators import relations as rel
from ..scale import write_table
from ..sources import readers, sinks
from ..session import table
from . import common as c

KINDS = ["CROSS_REFERENCES", "AMENDS", "DEFINED_IN", "APPLIES_TO"]


def edge_summary_rollup(s, d):
    return g.edge_summary(c.edges(s, d, "doc_id", "unresolved"))


def edge_pivot(s, d):
    return g.edge_pivot(c.edges(s, d, "doc_id"), sinks.KINDS)


def degree_hubs(s, d):
    return g.hubs(g.degrees(c.nodes(s, d), c.edges(s, d)))


def degree_table(s, d):
    return g.degrees(c.nodes(s, d), c.edges(s, d))


def isolated_nodes(s, d):
    return g.isolated(g.degrees(c.nodes(s, d), c.edges(s, d)))


def document_citations(s, d):
    return g.citations(c.edges(s, d))


def edge_problems(s, d):
    return g.edge_problems(c.edges(s, d, "snippet", "unresolved"), c.nodes(s, d))


def dup_edges_check(s, d):
    return sinks.duplicate_keys(c.edges(s, d).filter("src is not null and dst is not null"), ["src", "dst", "kind"])


def dedupe_first_wins(s, d):
    return rel.first_wins(c.edges(s, d, "char_offset").filter("dst is not null").select("src", "dst", "kind", "edge_ord", "char_offset"), ["src", "dst", "kind"], ["edge_ord"])


def migrated_edges(s, d):
    e = c.edges(s, d).filter("dst is not null").select("src", "dst", "kind")
    n = c.nodes(s, d).filter("kind in ('article', 'preamble') and doc_id is not null")
    new = n.select(F.col("node_id").alias("src"), F.concat("doc_id", F.lit(":document")).alias("dst"), F.lit("PART_OF").alias("kind"))
    return rel.merge_edges(e.distinct(), new, ["PART_OF", "IMPLEMENTS", "SUPERSEDES"]).groupBy("kind").agg(F.count("*").alias("n"))


def two_hop_chain(s, d):
    return g.two_hop_chains(c.edges(s, d), ["CROSS_REFERENCES", "AMENDS"])


def pair_distractors(s, d):
    return g.distractors(c.edges(s, d))


def graph_expand_2hop(s, d):
    x = ex.expand(c.seeds(s, d), c.edges(s, d).filter("dst is not null"))
    return x.select("query_id", "node_id", "hop", F.array_join("kinds", "|").alias("kinds"))


def graph_mode(s, d):
    seeds = c.seeds(s, d).select("query_id", "node_id", F.lit(0).alias("hop"))
    far = ex.expand(c.seeds(s, d), c.edges(s, d).filter("dst is not null")).select("query_id", "node_id", "hop")
    x = seeds.unionByName(far.join(c.clean_chunks(s, d).select(F.col("lineage_id").alias("node_id")), "node_id", "left_semi"))
    return x.withColumn("score", F.when(F.col("hop") <= 1, 1.0).otherwise(0.5))


def two_hop_provenance(s, d):
    x = _paths(s, d)
    return x.select("query_id", "node_id", "hop", "ord", F.array_join("path", " ").alias("way"), F.array_join("relations", "|").alias("relations"))


def _paths(s, d, keep=None):
    real = c.clean_chunks(s, d).select(F.col("lineage_id").alias("node_id"))
    return ex.two_hop_paths(c.seeds(s, d), c.edges(s, d).filter("dst is not null"), real, ex.WALKED, keep)


def one_hop_candidates(s, d):
    real = c.clean_chunks(s, d).select(F.col("lineage_id").alias("node_id"))
    return ex.two_hop_paths(c.seeds(s, d), c.edges(s, d).filter("dst is not null"), real, ex.WALKED, keep=20, max_hops=1).select("query_id", "node_id", "ord")


def admission_split_12_9(s, d):
    return ex.admit(_paths(s, d), "split_12_9", 21).select("query_id", "node_id", "hop", "ord")


def admission_2hop_first(s, d):
    return ex.admit(_paths(s, d), "2hop_first", 10).select("query_id", "node_id", "hop", "ord")


def budget_sweep(s, d):
    p = _paths(s, d)
    grid = F.explode(F.array(F.lit(20), F.lit(30), F.lit(40))).alias("budget")
    hit = p.join(c.gold(s, d).select("query_id", F.col("lineage_id").alias("node_id")), ["query_id", "node_id"], "left_semi").select("query_id", "ord", grid).filter("ord <= budget")
    return hit.groupBy("budget").agg(F.count_distinct("query_id").alias("queries_rescued"), F.count("*").alias("targets_admitted"))


def two_hop_only(s, d):
    return ex.two_hop_only(c.seeds(s, d), c.edges(s, d).filter("dst is not null"))


def undirected_traversal(s, d):
    dense = c.lists(s, d).filter("method = 'dense'").select("query_id", F.col("lineage_id").alias("node_id"), F.round("score", 6).alias("score"))
    targets = c.nodes(s, d).filter("kind in ('article', 'preamble')").select("node_id")
    x = ex.undirected_search(ex.strong_seeds(dense, 0.0), c.edges(s, d).filter("dst is not null"), targets, KINDS)
    return x.select("query_id", "node_id", "hop", "score", "rank", F.array_join("seeds", "|").alias("seeds"), F.array_join("kinds", "|").alias("kinds"))


def bfs_distance(s, d):
    return ex.distances(c.seeds(s, d, None), c.edges(s, d).filter("dst is not null"), 3)


def admission_mechanism(s, d):
    t = c.gold(s, d).select("query_id", F.col("lineage_id").alias("node_id"))
    near = ex.target_distances(t, c.seeds(s, d, None), c.edges(s, d).filter("dst is not null"))
    return ex.admission_mechanism(t, near, c.nodes(s, d)).groupBy("mechanism").agg(F.count("*").alias("n"))


def graph_context(s, d):
    q = c.lists(s, d).filter("method = 'dense' and rank <= 3").select("query_id", "lineage_id", F.lit("Which access log or trading log rules apply?").alias("question"))
    return cx.context_lines(q, write_table(c.edges(s, d, "snippet"), "edges")[0], c.nodes(s, d))


def rerank_lexical(s, d):
    pool = c.lists(s, d).filter("method = 'dense' and rank <= 10").join(c.clean_chunks(s, d).select("lineage_id", "text"), "lineage_id", "left").withColumn("question", F.lit("access log and tariff notice"))
    return cx.rerank(pool, cx.lexical_order(pool))


def benchmark_candidates(s, d):
    x = bm.candidates(c.edges(s, d), c.nodes(s, d), c.clean_chunks(s, d))
    return x.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"))


def benchmark_items(s, d):
    return bm.allocate(bm.candidates(c.edges(s, d), c.nodes(s, d), c.clean_chunks(s, d)), bm.QUOTAS).drop("path")


def benchmark_problems(s, d):
    items = bm.allocate(bm.candidates(c.edges(s, d), c.nodes(s, d), c.clean_chunks(s, d)), bm.QUOTAS)
    known = c.nodes(s, d).select(F.col("node_id").alias("lineage_id"))
    return bm.item_problems(items, c.edges(s, d), known).groupBy("problem").agg(F.count("*").alias("n"))


def target_audit(s, d):
    items = bm.allocate(bm.candidates(c.edges(s, d), c.nodes(s, d), c.clean_chunks(s, d)), bm.QUOTAS)
    return bm.target_audit(items, c.nodes(s, d).select(F.col("node_id").alias("lineage_id"))).groupBy("family", "status").agg(F.count("*").alias("n"))


def leakage_overlap(s, d):
    cands = bm.candidates(c.edges(s, d), c.nodes(s, d), c.clean_chunks(s, d))
    a = bm.allocate(cands, bm.QUOTAS)
    b = bm.allocate(cands, bm.HELDOUT_QUOTAS, [r["target"] for r in a.select("target").collect()], "h")
    return bm.leakage(a, b)


def priority_fallback_match(s, d):
    want = c.edges(s, d).filter("kind = 'CROSS_REFERENCES' and dst like '%:article:%' and dst not like 'ext:%'").select(F.col("dst").alias("want"))
    return bm.priority_match(want, c.clean_chunks(s, d).select("lineage_id"))


def merge_upsert(s, d):
    n = table(s, d, "graph_nodes")
    key = norm_key(F.col("lineage_id")).alias("node_id")
    old = n.filter("deleted_at is not null").select(key, "title", "art_number").groupBy("node_id").agg(F.max("title").alias("title"), F.max("art_number").alias("art_number"))
    return sinks.merged(old, n.filter("deleted_at is null").select(key, "title", "art_number"), ["node_id"])


def metadata_completeness(s, d):
    a = table(s, d, "document_audits")
    fields = ["filename", "folder_key", "raw_present", "size_bytes", "page_count", "sha256", "pdf_valid", "multi_column", "has_footnotes", "has_tables", "has_headers", "hyphenation"]
    return readers.completeness(a.select("doc_id", *fields), fields).groupBy("n_missing", "n_empty", "score", "ok").agg(F.count("*").alias("n"))


def manifest_cross_check(s, d):
    listed = table(s, d, "document_audits").select(norm_key(F.col("doc_id")).alias("doc_id"))
    found = table(s, d, "chunks").select(norm_key(F.col("doc_id")).alias("doc_id"))
    return readers.cross_check(listed, found, "doc_id")


QUERIES = {f.__name__: f for f in (edge_summary_rollup, edge_pivot, degree_hubs, degree_table, isolated_nodes, document_citations, edge_problems, dup_edges_check, dedupe_first_wins, migrated_edges, two_hop_chain, pair_distractors, graph_expand_2hop, graph_mode, two_hop_provenance, one_hop_candidates, admission_split_12_9, admission_2hop_first, budget_sweep, two_hop_only, undirected_traversal, bfs_distance, admission_mechanism, graph_context, rerank_lexical, benchmark_candidates, benchmark_items, benchmark_problems, target_audit, leakage_overlap, priority_fallback_match, merge_upsert, metadata_completeness, manifest_cross_check)}

_E, _EN = f"WITH {c.EDGES}", f"WITH {c.EDGES}, {c.NODES}"
_DOC = "CASE WHEN contains({0}, ':article:') THEN split_part({0}, ':article:', 1) ELSE split_part({0}, ':', 1) END".format
_DEG = "deg AS (SELECT n.node_id, n.kind, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_distinct_out, 0) AS n_distinct_out FROM n LEFT JOIN (SELECT src, count(*) AS n_out, count(DISTINCT dst) AS n_distinct_out FROM e GROUP BY 1) o ON o.src = n.node_id LEFT JOIN (SELECT dst, count(*) AS n_in FROM e WHERE dst IS NOT NULL GROUP BY 1) i ON i.dst = n.node_id)"
_WALK = f"WITH {c.SEEDS}, w AS (SELECT * FROM e WHERE dst IS NOT NULL AND kind IN ('CROSS_REFERENCES', 'AMENDS'))"
_HOPS = """h1 AS (SELECT DISTINCT s.query_id, w.dst AS node_id, w.kind FROM seeds s JOIN w ON w.src = s.node_id ANTI JOIN seeds z ON z.query_id = s.query_id AND z.node_id = w.dst),
k1 AS (SELECT DISTINCT query_id, node_id FROM h1),
h2 AS (SELECT DISTINCT k1.query_id, w.dst AS node_id, w.kind FROM k1 JOIN w ON w.src = k1.node_id ANTI JOIN seeds z ON z.query_id = k1.query_id AND z.node_id = w.dst ANTI JOIN k1 y ON y.query_id = k1.query_id AND y.node_id = w.dst),
far AS (SELECT query_id, node_id, 1 AS hop, string_agg(kind, '|' ORDER BY kind) AS kinds FROM h1 GROUP BY 1, 2 UNION ALL SELECT query_id, node_id, 2, string_agg(kind, '|' ORDER BY kind) FROM h2 GROUP BY 1, 2)"""
_WAYS = f"""{c.CHUNKS},
ways AS (
  SELECT s.query_id, w.dst AS node_id, 1 AS hop, s.node_id AS seed, w.edge_ord AS o1, -1 AS o2, s.node_id || ' ' || w.kind || ' ' || w.dst AS way, w.kind AS relations FROM seeds s JOIN w ON w.src = s.node_id UNION ALL
  SELECT s.query_id, x.dst, 2, s.node_id, w.edge_ord, x.edge_ord, s.node_id || ' ' || w.kind || ' ' || w.dst || ' ' || x.kind || ' ' || x.dst, CASE WHEN w.kind = x.kind THEN w.kind ELSE w.kind || '|' || x.kind END FROM seeds s JOIN w ON w.src = s.node_id JOIN w x ON x.src = w.dst),
okay AS (SELECT * FROM ways y WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = y.query_id AND z.node_id = y.node_id) AND node_id IN (SELECT lineage_id FROM c) QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY hop, seed, o1, o2) = 1),
paths AS (SELECT query_id, node_id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, seed, o1, o2, node_id) AS ord, way, relations FROM okay)"""
_BFS = f"""WITH RECURSIVE {c.EDGES}, {c.NODES}, {c.LISTS}, sd AS (SELECT DISTINCT query_id, lineage_id AS node_id FROM l WHERE method = 'sparse' AND lineage_id IN (SELECT node_id FROM n)),
u AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
r AS (SELECT query_id, node_id, 0 AS hop FROM sd UNION SELECT r.query_id, u.b, r.hop + 1 FROM r JOIN u ON u.a = r.node_id WHERE r.hop < 3),
dist AS (SELECT query_id, node_id, min(hop) AS hop FROM r GROUP BY 1, 2)"""

ORACLE = {
    "edge_summary_rollup": _E + " SELECT CASE WHEN grouping(doc_id) = 1 THEN 'ALL' ELSE doc_id END AS doc_id, CASE WHEN grouping(kind) = 1 THEN 'ALL' ELSE kind END AS kind, count(*) AS n_edges, CAST(sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS BIGINT) AS n_unresolved FROM e GROUP BY ROLLUP (doc_id, kind)",
    "edge_pivot": _E + " SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.lower()}" for k in sinks.KINDS) + " FROM e GROUP BY 1",
    "degree_table": _EN + f", {_DEG} SELECT * FROM deg",
    "degree_hubs": _EN + f", {_DEG} SELECT kind, node_id, n_out + n_in AS degree FROM deg QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n_out + n_in DESC, node_id) = 1",
    "isolated_nodes": _EN + f", {_DEG} SELECT kind, count(*) AS n_isolated FROM deg WHERE n_out = 0 AND n_in = 0 GROUP BY 1",
    "document_citations": _E + f", x AS (SELECT {_DOC('src')} AS a, {_DOC('dst')} AS b FROM e WHERE kind = 'CROSS_REFERENCES' AND dst IS NOT NULL) SELECT doc_id, CAST(sum(o) AS BIGINT) AS cites_out, CAST(sum(i) AS BIGINT) AS cited_in FROM (SELECT a AS doc_id, 1 AS o, 0 AS i FROM x WHERE a <> b UNION ALL SELECT b, 0, 1 FROM x WHERE a <> b) GROUP BY 1",
    "edge_problems": _EN + ", p AS (SELECT 'duplicate_key' AS problem FROM e WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst, kind HAVING count(*) > 1 UNION ALL SELECT 'dangling_src' FROM e WHERE src IS NOT NULL AND src NOT IN (SELECT node_id FROM n WHERE node_id IS NOT NULL) UNION ALL SELECT 'dangling_dst' FROM e WHERE dst IS NOT NULL AND dst NOT IN (SELECT node_id FROM n WHERE node_id IS NOT NULL) UNION ALL SELECT 'no_evidence' FROM e WHERE snippet IS NULL OR trim(snippet) = '' UNION ALL SELECT 'long_snippet' FROM e WHERE length(snippet) > 120 UNION ALL SELECT 'wrong_flag' FROM e WHERE coalesce(starts_with(dst, 'ext:'), false) <> coalesce(unresolved, false)) SELECT problem, count(*) AS n FROM p GROUP BY 1",
    "dup_edges_check": _E + " SELECT src, dst, kind, count(*) AS n FROM e WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "dedupe_first_wins": _E + " SELECT src, dst, kind, edge_ord, char_offset FROM e WHERE dst IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY edge_ord) = 1",
    "migrated_edges": _EN + " SELECT kind, count(*) AS n FROM (SELECT src, dst, kind FROM e WHERE dst IS NOT NULL AND kind NOT IN ('PART_OF', 'IMPLEMENTS', 'SUPERSEDES') UNION SELECT node_id, doc_id || ':document', 'PART_OF' FROM n WHERE kind IN ('article', 'preamble') AND doc_id IS NOT NULL) GROUP BY 1",
    "two_hop_chain": _E + f", w AS (SELECT DISTINCT src, dst, kind FROM e WHERE kind IN ('CROSS_REFERENCES', 'AMENDS') AND dst IS NOT NULL) SELECT x.src AS a, x.dst AS b, y.dst AS c, x.kind AS k1, y.kind AS k2 FROM w x JOIN w y ON y.src = x.dst WHERE x.src <> y.dst AND {_DOC('x.src')} <> {_DOC('y.dst')}",
    "pair_distractors": _E + ", f AS (SELECT src, dst, min(edge_ord) AS o FROM e WHERE kind = 'CROSS_REFERENCES' AND dst IS NOT NULL GROUP BY 1, 2), x AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n FROM f), st AS (SELECT unnest([1, 2, 3]) AS d) SELECT a.src, a.dst, b.dst AS other FROM x a JOIN st ON d < a.n JOIN x b ON b.src = a.src AND b.pos = (a.pos + d) % a.n",
    "graph_expand_2hop": _WALK + f", {_HOPS} SELECT * FROM far",
    "graph_mode": _WALK + f", {c.CHUNKS}, {_HOPS} SELECT query_id, node_id, hop, CAST(CASE WHEN hop <= 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS score FROM (SELECT query_id, node_id, 0 AS hop FROM seeds UNION ALL SELECT query_id, node_id, hop FROM far WHERE node_id IN (SELECT lineage_id FROM c))",
    "two_hop_provenance": _WALK + f", {_WAYS} SELECT * FROM paths",
    "one_hop_candidates": _WALK + f", {_WAYS} SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS ord FROM paths WHERE hop = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ord) <= 20",
    "admission_split_12_9": _WALK + f", {_WAYS}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, hop ORDER BY ord) AS nn FROM paths) SELECT query_id, node_id, hop, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS ord FROM x WHERE (hop = 1 AND nn <= 12) OR (hop = 2 AND nn <= 9)",
    "admission_2hop_first": _WALK + f", {_WAYS} SELECT query_id, node_id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop DESC, ord) AS ord FROM paths QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop DESC, ord) <= 10",
    "budget_sweep": _WALK + f", {_WAYS}, b AS (SELECT unnest([20, 30, 40]) AS budget) SELECT budget, count(DISTINCT p.query_id) AS queries_rescued, count(*) AS targets_admitted FROM paths p SEMI JOIN gold g ON g.query_id = p.query_id AND g.lineage_id = p.node_id JOIN b ON p.ord <= budget GROUP BY 1",
    "two_hop_only": _WALK + f", {_HOPS} SELECT query_id, node_id FROM far WHERE hop = 2",
    "bfs_distance": _BFS + " SELECT * FROM dist",
    "admission_mechanism": _BFS + " SELECT CASE WHEN n.node_id IS NULL THEN 'OUT_OF_CORPUS' WHEN hop <= 2 THEN 'SEED_PRESENT' ELSE 'SEED_MISS' END AS mechanism, count(*) AS n FROM gold LEFT JOIN n ON n.node_id = gold.lineage_id LEFT JOIN dist ON dist.query_id = gold.query_id AND dist.node_id = gold.lineage_id GROUP BY 1",
    "undirected_traversal": f"WITH {c.EDGES}, {c.NODES}, {c.LISTS}, sd AS (SELECT query_id, lineage_id AS seed, round(score, 6) AS score FROM l WHERE method = 'dense' AND round(score, 6) >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, lineage_id) <= 15), f AS (SELECT * FROM e WHERE dst IS NOT NULL AND kind IN ('CROSS_REFERENCES', 'AMENDS', 'DEFINED_IN', 'APPLIES_TO')), u AS (SELECT edge_ord, src AS a, dst AS b, kind FROM f UNION ALL SELECT edge_ord, dst, src, kind FROM f WHERE src <> dst), t1 AS (SELECT query_id, seed, score, u.b AS node_id, [u.kind] AS ks, edge_ord FROM sd JOIN u ON u.a = seed), tr AS (SELECT query_id, seed, score, node_id, 1 AS hop, ks FROM t1 UNION ALL SELECT query_id, seed, score, u.b, 2, ks || [u.kind] FROM t1 JOIN u ON u.a = t1.node_id AND u.edge_ord <> t1.edge_ord), ok AS (SELECT * FROM tr WHERE node_id <> seed AND node_id IN (SELECT node_id FROM n WHERE kind IN ('article', 'preamble'))), got AS (SELECT query_id, node_id, min(hop) AS hop, max(score) AS score, array_to_string(list_sort(list(DISTINCT seed)), '|') AS seeds, array_to_string(list_sort(list_distinct(flatten(list(ks)))), '|') AS kinds FROM ok GROUP BY 1, 2), al AS (SELECT * FROM got UNION ALL SELECT query_id, seed, 0, max(score), seed, '' FROM sd WHERE seed IN (SELECT node_id FROM n WHERE kind IN ('article', 'preamble')) AND NOT EXISTS (SELECT 1 FROM got WHERE got.query_id = sd.query_id AND got.node_id = sd.seed) GROUP BY query_id, seed) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hop, node_id) AS rank FROM al QUALIFY rank <= 60",
    "priority_fallback_match": _E + f", {c.CHUNKS}, w AS (SELECT DISTINCT dst AS want, {_DOC('dst')} AS doc, CAST(nullif(regexp_extract(dst, ':article:([0-9]+)', 1), '') AS INT) AS num FROM e WHERE kind = 'CROSS_REFERENCES' AND dst LIKE '%:article:%' AND dst NOT LIKE 'ext:%'), cc AS (SELECT DISTINCT lineage_id, {_DOC('lineage_id')} AS doc, CAST(nullif(regexp_extract(lineage_id, ':article:([0-9]+)', 1), '') AS INT) AS num FROM c), f AS (SELECT doc, min(lineage_id) FILTER (contains(lineage_id, ':article:')) AS s3, min(lineage_id) FILTER (ends_with(lineage_id, ':preamble')) AS s4, min(lineage_id) AS s5 FROM cc GROUP BY 1), sm AS (SELECT doc, num, min(lineage_id) AS s2 FROM cc WHERE num IS NOT NULL GROUP BY 1, 2) SELECT want, coalesce(x.lineage_id, s2, s3, s4, s5) AS lineage_id, CASE WHEN x.lineage_id IS NOT NULL THEN 1 WHEN s2 IS NOT NULL THEN 2 WHEN s3 IS NOT NULL THEN 3 WHEN s4 IS NOT NULL THEN 4 WHEN s5 IS NOT NULL THEN 5 END AS step FROM w LEFT JOIN cc x ON x.lineage_id = w.want LEFT JOIN sm ON sm.doc = w.doc AND sm.num = w.num LEFT JOIN f ON f.doc = w.doc",
    "merge_upsert": f"WITH n0 AS (SELECT lower(trim(lineage_id, {c.B})) AS node_id, title, art_number, deleted_at IS NULL AS live FROM graph_nodes), o AS (SELECT node_id, max(title) AS title, max(art_number) AS art_number FROM n0 WHERE NOT live GROUP BY 1), w AS (SELECT node_id, max(title) AS title, max(art_number) AS art_number FROM n0 WHERE live GROUP BY 1) SELECT node_id, coalesce(w.title, o.title) AS title, coalesce(w.art_number, o.art_number) AS art_number FROM o FULL JOIN w USING (node_id)",
    "metadata_completeness": "WITH x AS (SELECT " + " + ".join(f"CASE WHEN {f} IS NULL THEN 1 ELSE 0 END" for f in ("filename", "folder_key", "raw_present", "size_bytes", "page_count", "sha256", "pdf_valid", "multi_column", "has_footnotes", "has_tables", "has_headers", "hyphenation")) + " AS n_missing, " + " + ".join(f"CASE WHEN trim({f}) = '' THEN 1 ELSE 0 END" for f in ("filename", "folder_key", "sha256")) + " AS n_empty FROM document_audits) SELECT n_missing, n_empty, greatest(0, round(1 - (n_missing + n_empty) / 14.0, 6)) AS score, round(1 - (n_missing + n_empty) / 14.0, 6) >= 0.9 AS ok, count(*) AS n FROM x GROUP BY ALL",
    "manifest_cross_check": f"WITH a AS (SELECT DISTINCT lower(trim(doc_id, {c.B})) AS doc_id FROM document_audits), b AS (SELECT DISTINCT lower(trim(doc_id, {c.B})) AS doc_id FROM chunks) SELECT doc_id, 'missing' AS problem FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT doc_id, 'untracked' FROM b ANTI JOIN a USING (doc_id)",
}
ORACLE["benchmark_candidates"] = f"""WITH {c.EDGES}, {c.NODES}, {c.CHUNKS}, v AS (SELECT *, {_DOC('src')} AS sd, {_DOC('dst')} AS td FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
pool AS (SELECT * FROM v WHERE kind IN ('AMENDS', 'APPLIES_TO') OR (kind = 'CROSS_REFERENCES' AND sd <> td)), w AS (SELECT DISTINCT src, dst, kind FROM v WHERE kind IN ('CROSS_REFERENCES', 'AMENDS')),
r AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS k FROM (SELECT DISTINCT src, dst FROM v WHERE kind = 'CROSS_REFERENCES')),
t AS (SELECT lower(n.term) AS term, v.dst, v.edge_ord FROM v JOIN n ON n.node_id = v.src WHERE v.kind = 'DEFINED_IN' AND length(n.term) >= 4 QUALIFY row_number() OVER (PARTITION BY lower(n.term) ORDER BY v.edge_ord) = 1),
x AS (SELECT 'single_document' AS family, lineage_id AS target FROM c JOIN n ON n.node_id = c.lineage_id WHERE node_type = 'article' UNION ALL SELECT 'non_relational', dst FROM t UNION ALL SELECT 'one_hop', dst FROM pool UNION ALL SELECT 'relation_direction', src FROM pool UNION ALL
  SELECT 'two_hop', b.dst FROM w a JOIN w b ON b.src = a.dst WHERE a.src <> b.dst AND {_DOC('a.src')} <> {_DOC('b.dst')} UNION ALL SELECT 'temporal', src FROM v WHERE kind IN ('AMENDS', 'SUPERSEDES') UNION ALL SELECT 'graph_distractor', dst FROM r WHERE k > 1 UNION ALL SELECT 'multi_doc', dst FROM v WHERE kind = 'CROSS_REFERENCES' AND sd <> td)
SELECT family, count(*) AS n, count(DISTINCT target) AS n_targets FROM x WHERE target IN (SELECT node_id FROM n) GROUP BY 1"""
