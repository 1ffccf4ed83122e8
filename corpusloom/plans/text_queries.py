"""Queries over texts: functions, structure, chunks, search, streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..keys import norm_key
from ..operators import benchmark as bm
from ..operators import evaluation as ev
from ..operators import expansion as ex
from ..operators import models
from ..operators import relations as rel
from ..operators import retrieval as rt
from ..operators import structure as st
from ..operators.modes import MODES, SHOWN, Retriever
from ..sources import readers, sinks
from ..streaming import incremental as inc
from ..session import table
from . import common as c


def _docs(s, d):
    return table(s, d, "documents")


def text_features(s, d):
    t = T.text_or_empty(F.col("text"))
    join = lambda x: F.array_join(x, "|")
    return _docs(s, d).select("doc_id", join(T.article_numbers(t)).alias("articles"), join(T.dates(t)).alias("dates"), join(T.headings(t)).alias("headings"),
                              T.paragraph_count(t).alias("paragraphs"), T.obligation_count(t).alias("obligations"), T.derogation_count(t).alias("derogations"), T.instrument(t).alias("instrument"), T.celex(t).alias("celex"), T.slug(t).alias("slug"), T.snippet(t).alias("snippet"))


def table_features(s, d):
    t = T.text_or_empty(F.col("text"))
    return _docs(s, d).select("doc_id", T.table_count(t).alias("n_tables"), F.array_join(T.table_headers(t), "/").alias("headers"), F.array_join(T.numbered_items(t), "/").alias("items"), F.array_join(T.definitions(t), "/").alias("definitions"))


def document_titles(s, d):
    return _docs(s, d).select("doc_id", T.title_heuristic(F.col("text")).alias("title"), T.publication_date(T.text_or_empty(F.col("text"))).alias("publication_date"))


def search_terms(s, d):
    return c.clean_chunks(s, d).select("lineage_id", F.array_join(T.tokenize(F.col("text")), " ").alias("terms"))


def _title_queries(s, d):
    """Titles of the articles of every chunk whose id is divisible by 20."""
    pick = table(s, d, "chunks").filter("page_no is null and chunk_id % 20 = 0").select("chunk_id", norm_key(F.col("lineage_id")).alias("lineage_id")).distinct()
    titles = table(s, d, "ast_nodes").filter("title is not null").groupBy(norm_key(F.col("lineage_id")).alias("lineage_id")).agg(F.min("title").alias("text"))
    return pick.join(titles, "lineage_id").select(F.col("chunk_id").alias("query_id"), "text", F.col("lineage_id").alias("target"))


def _bm25(s, d, k=10):
    corpus = c.clean_chunks(s, d).select("lineage_id", "text")
    return rt.InvertedIndex(corpus).search(_title_queries(s, d).select("query_id", "text"), k)


def bm25_topk(s, d):
    return _bm25(s, d).withColumn("score", F.round("score", 5)).select("query_id", "rank", "lineage_id", "score")


def bm25_recall(s, d):
    gold = _title_queries(s, d).select("query_id", F.col("target").alias("lineage_id"))
    return ev.aggregate(ev.metrics_at_k(_bm25(s, d, 20).withColumnRenamed("method", "system"), gold, gold.select("query_id")))


def _retriever(s, d, evidence):
    """``evidence``: whether lines of the graph are shown with it."""
    return Retriever(c.clean_chunks(s, d).select("lineage_id", "doc_id", "text", "span_start", "span_end"), c.nodes(s, d), c.edges(s, d, *["snippet"] * evidence))


def _mode(mode):
    def run(s, d):
        x = _retriever(s, d, mode in SHOWN and SHOWN[mode].get("snippets", True)).retrieve(_title_queries(s, d).select("query_id", "text"), mode)
        return x.withColumn("source_methods", F.array_join("source_methods", "|"))

    run.__name__ = f"retrieve_{mode}"
    return run


def _system(name):
    def run(s, d):
        return _retriever(s, d, name == "g2").frozen(_title_queries(s, d).select("query_id", "text"), name)

    run.__name__ = f"system_{name}"
    return run


def rag_contexts(s, d):
    return _retriever(s, d, False).answer_contexts(_title_queries(s, d).select("query_id", "text"))


def text_graph_nodes(s, d):
    docs = _docs(s, d)
    return rel.graph_nodes(docs, rel.build_graph(docs), st.syntax_tree(docs)).groupBy("kind").agg(F.count("*").alias("n"))


def coverage_audit(s, d):
    docs = _docs(s, d)
    truth = docs.filter("text != ''").select(F.col("doc_id").cast("string").alias("doc_id"), F.size(T.article_numbers(F.col("text"))).alias("articles"), F.lit(None).cast("int").alias("chapters"), T.table_count(F.col("text")).alias("tables"), F.col("instrument"), F.lit(None).cast("string").alias("publication_date"))
    return st.coverage_audit(st.structure_map(docs), truth)


def changed_numbers(s, d):
    x = table(s, d, "graph_edges").filter("snippet is not null").select("snippet").distinct()
    return x.select("snippet", T.change_number(F.col("snippet")).alias("changed")).filter("changed is not null")


def _dense(s, d, k=10):
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rt.dense_search(q, e.select(F.col("vec_id").alias("lineage_id"), "embedding"), k, exclude_self=True)


def dense_topk(s, d):
    return _dense(s, d).select("query_id", "rank", F.col("lineage_id").alias("vec_id"), F.round("score", 5).alias("score"))


def dense_label_metrics(s, d):
    e = table(s, d, "embeddings")
    x = _dense(s, d).join(e.select(F.col("vec_id").alias("lineage_id"), F.col("label").alias("got")), "lineage_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    per = x.groupBy("query_id", "label").agg(F.avg((F.col("got") == F.col("label")).cast("double")).alias("p"), F.min(F.when(F.col("got") == F.col("label"), F.col("rank"))).alias("first"))
    return per.groupBy("label").agg(F.round(F.avg("p"), 6).alias("precision_at_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"))


def vector_cosine(s, d):
    e = table(s, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(rt.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


def html_clean(s, d):
    html = F.concat(F.lit("<div><p class='x'>"), F.regexp_replace(T.text_or_empty(F.col("text")), "\n", "<br/>"), F.lit("</p><ul><li>a &amp; b</li></ul></div>"))
    return readers.html_pages(_docs(s, d).select("doc_id", html.alias("html"))).select("doc_id", "text")


def window_samples(s, d):
    w = F.explode(T.sample_windows(F.col("text"), 4, 400)).alias("w")
    return _docs(s, d).select("doc_id", w).select("doc_id", F.col("w.start").cast("long").alias("window_start"), F.col("w.end").cast("long").alias("window_end"))


def line_offsets(s, d):
    return st.line_offsets(_docs(s, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("line_start").cast("long").alias("line_start"), F.length("line").cast("long").alias("chars"))


def structure_marks(s, d):
    return st.structure_marks(_docs(s, d)).groupBy("mark").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def recital_counts(s, d):
    return st.structure_marks(_docs(s, d)).filter("mark = 'recital'").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.min("span_start").cast("long").alias("first_at"))


def structure_map(s, d):
    return st.structure_map(_docs(s, d))


def strategy_mix(s, d):
    return st.structure_map(_docs(s, d)).groupBy("strategy").agg(F.count("*").alias("n"))


def syntax_tree(s, d):
    return st.syntax_tree(_docs(s, d))


def document_chunks(s, d):
    return st.chunk_documents(_docs(s, d)).withColumn("absorbed", F.array_join("absorbed", "|"))


def recovered_articles(s, d):
    docs = _docs(s, d)
    return st.recover_oversized(st.syntax_tree(docs), st.chunk_documents(docs, drop_oversize=True), docs)


def span_overlap_check(s, d):
    return st.span_problems(c.clean_chunks(s, d).filter("span_end is not null"))


def thin_fold_islands(s, d):
    x = st.fold_islands(c.clean_chunks(s, d).filter("span_end is not null"))
    return x.select("doc_id", F.col("island").cast("long").alias("island"), F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), "n_chunks", F.array_join("absorbed", "|").alias("absorbed"))


def chunk_summary(s, d):
    return sinks.chunk_summary(c.clean_chunks(s, d))


def _intervals(s, d):
    n = table(s, d, "ast_nodes").filter("lower(trim(node_type)) in ('article', 'preamble')").groupBy(norm_key(F.col("doc_id")).alias("doc_id"), F.col("span_start").alias("a")).agg(F.min("span_end").alias("b"), F.min(norm_key(F.col("lineage_id"))).alias("interval_id"))
    pts = c.clean_chunks(s, d).select(F.col("lineage_id").alias("point_id"), "doc_id", F.col("span_start").alias("at"))
    return pts, n


def nearest_interval(s, d):
    pts, n = _intervals(s, d)
    return ex.nearest_interval(pts, n, "doc_id")


def answer_scores(s, d):
    a = table(s, d, "ast_nodes").groupBy(norm_key(F.col("lineage_id")).alias("lineage_id")).agg(F.min("title").alias("a"))
    b = table(s, d, "graph_nodes").groupBy(norm_key(F.col("lineage_id")).alias("lineage_id")).agg(F.min("title").alias("b"))
    return a.join(b, "lineage_id").select("lineage_id", F.round(T.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), T.exact_match(F.col("a"), F.col("b")).alias("em"), T.overlap_score(F.col("a"), F.col("b")).cast("long").alias("shared"))


def parser_scores(s, d):
    t = T.text_or_empty(F.col("text"))
    x = _docs(s, d).withColumn("found", T.instrument(t)).select("source", T.lenient_match(F.col("found"), F.col("instrument")).alias("m"), T.closeness(F.length(t), F.col("n_chars")).alias("cl"))
    return x.groupBy("source").agg(F.round(F.avg("m"), 6).alias("instrument_match"), F.round(F.avg("cl"), 6).alias("length_closeness"), F.count("*").alias("n"))


def node_labels(s, d):
    return c.nodes(s, d).select("node_id", T.node_label(F.col("kind"), F.col("title"), F.col("term"), F.col("art_number"), F.col("node_id")).alias("label"), T.search_text(F.col("kind"), F.col("title"), F.col("term"), F.col("art_number"), F.col("doc_id")).alias("search_text"))


def lineage_parts(s, d):
    x = c.nodes(s, d)
    return x.select("node_id", T.doc_of(F.col("node_id")).alias("doc"), T.article_num_of(F.col("node_id")).alias("article"))


def graph_from_text(s, d):
    return rel.build_graph(_docs(s, d)).groupBy("kind", "unresolved").agg(F.count("*").alias("n"), F.sum(F.col("cites").cast("long")).alias("n_cites"))


def cross_references_from_text(s, d):
    return rel.build_graph(_docs(s, d)).filter("kind = 'CROSS_REFERENCES'")


def obligation_sentences(s, d):
    x = _docs(s, d).filter("text is not null").select("doc_id", F.explode(T.obligation_sentences(F.col("text"))).alias("sentence"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


def weakened_obligations(s, d):
    return table(s, d, "graph_edges").filter("snippet is not null").select("snippet").distinct().select("snippet", T.weaken(F.col("snippet")).alias("weak")).filter("weak is not null")


def scenario_pairs(s, d):
    return bm.scenarios(_docs(s, d))


def page_flags(s, d):
    return readers.page_flags(table(s, d, "chunks").filter("page_no is not null and text is not null").select(norm_key(F.col("doc_id")).alias("doc_id"), "page_no", "text"))


def row_fingerprint(s, d):
    return sinks.fingerprint(table(s, d, "graph_edges"))


def answer_prompts(s, d):
    q = _title_queries(s, d).select("query_id", "text")
    return models.ask(models.generation_prompts(q, _bm25(s, d), c.clean_chunks(s, d)).select(F.col("id").alias("key"), "prompt"))


def missing_embeddings(s, d):
    n = c.nodes(s, d).select("node_id", T.search_text(F.col("kind"), F.col("title"), F.col("term"), F.col("art_number"), F.col("doc_id")).alias("search_text"))
    have = n.filter("node_id like '%:document'").select("node_id")
    return models.embed_missing(n, have, rt.embed).select("node_id", F.size("embedding").alias("dim"))


def query_segments(s, d):
    q = table(s, d, "graph_edges").filter("snippet is not null").groupBy("edge_id").agg(F.min("snippet").alias("text"))
    return rt.query_segments(q.select(F.col("edge_id").alias("query_id"), "text")).select("query_id", F.col("segment").cast("long").alias("segment"), "text")


def event_windows(s, d):
    return inc.windowed_counts(table(s, d, "events"))


def event_sessions(s, d):
    return inc.sessions(table(s, d, "events")).groupBy("user").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (text_features, table_features, document_titles, search_terms, bm25_topk, bm25_recall, dense_topk, dense_label_metrics, vector_cosine, html_clean, window_samples, line_offsets, structure_marks, recital_counts, structure_map, strategy_mix, syntax_tree, document_chunks, recovered_articles, span_overlap_check, thin_fold_islands, chunk_summary, nearest_interval, answer_scores, parser_scores, node_labels, lineage_parts, graph_from_text, cross_references_from_text, obligation_sentences, weakened_obligations, scenario_pairs, page_flags, row_fingerprint, answer_prompts, missing_embeddings, query_segments, event_windows, event_sessions, rag_contexts, text_graph_nodes, coverage_audit, changed_numbers, *map(_mode, MODES), *map(_system, ("b0", "g1", "g2", "g2_nogc")))}

_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(fixed.STOP_WORDS))) + "]"
_TOK = f"list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(translate(coalesce({{0}}, ''), chr(1) || chr(2), '  '), '(' || '\\b\\d{{{{4}}}}/\\d{{{{2,5}}}}(?:/\\w{{{{2,3}}}})?\\b|\\b[A-Z][A-Z0-9]{{{{1,}}}}\\b' || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1) || '[^' || chr(2) || ']+' || chr(2) || '|[A-Za-z]+|\\d+'), lambda t: CASE WHEN NOT starts_with(t, chr(1)) THEN lower(t) WHEN regexp_matches(t, '^.[0-9]') THEN lower(trim(t, chr(1) || chr(2))) ELSE chr(1) || trim(t, chr(1) || chr(2)) END), lambda t: starts_with(t, chr(1)) OR (NOT list_contains({_STOP}, t) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]')))), lambda t: replace(t, chr(1), ''))"
_TOK = _TOK.replace("{{{{", "{{").replace("}}}}", "}}")
_tok = _TOK.format
_DOCX = "CASE WHEN contains({0}, ':article:') THEN split_part({0}, ':article:', 1) ELSE split_part({0}, ':', 1) END".format
_TQ = f"tq AS (SELECT DISTINCT chunk_id AS query_id, lower(trim(lineage_id, {c.B})) AS target FROM chunks WHERE page_no IS NULL AND chunk_id % 20 = 0), ti AS (SELECT lower(trim(lineage_id, {c.B})) AS target, min(title) AS text FROM ast_nodes WHERE title IS NOT NULL GROUP BY 1), q AS (SELECT query_id, target, text FROM tq JOIN ti USING (target))"
_BM = f"""WITH {c.CHUNKS}, {_TQ},
t AS (SELECT lineage_id, {_tok('text')} AS terms FROM c), dd AS (SELECT lineage_id, len(terms) AS dl, terms FROM t), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dd),
po AS (SELECT term, lineage_id, dl, count(*) AS tf FROM (SELECT lineage_id, dl, unnest(terms) AS term FROM dd) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM po, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok('text')}) AS term FROM q) GROUP BY 1, 2),
sc AS (SELECT query_id, lineage_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM po JOIN qt USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
runs AS (SELECT query_id, 'sparse' AS system, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, lineage_id) AS rank, lineage_id, score FROM sc WHERE score > 0)"""
_DN = "WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, label, round(list_dot_product(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[])) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS score FROM q JOIN embeddings ON vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)"
_SENT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 61 AND 599 AND regexp_matches(x, '(?i)shall|must'))"

ORACLE = {
    "text_features": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, list_distinct(regexp_extract_all(t, '\\bArticle\\s+(\\d+[a-z]?)\\b', 1)) AS an, list_slice(list_distinct_ordered, 1, 8) AS ds FROM (SELECT *, list_reduce(list_prepend([], list_transform(regexp_extract_all(t, '\\d{1,2}\\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{4}') || regexp_extract_all(t, '\\b\\d{4}-\\d{2}-\\d{2}\\b') || list_transform(list_filter(regexp_extract_all(t, '(?:^|[^0-9])\\d{1,2}\\.\\d{1,2}\\.\\d{4}(?:[^0-9]|$)'), lambda v: true), lambda v: regexp_extract(v, '\\d{1,2}\\.\\d{1,2}\\.\\d{4}')), lambda v: [v])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_ordered FROM d))
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(an, lambda v: {'n': length(v), 'x': v})), lambda v: v.x), '|') AS articles, array_to_string(ds, '|') AS dates,
array_to_string(list_slice(list_transform(regexp_extract_all(t, '(?m)^#{1,6}[ \\t]+(.+)$', 1), lambda v: trim(v)), 1, 10), '|') AS headings,
CAST(len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: length(trim(p, ' ' || chr(9) || chr(10) || chr(13))) > 50)) AS INT) AS paragraphs,
CAST(len(regexp_extract_all(t, '(?i)\\b(shall|must|is\\s+required\\s+to)\\b')) AS INT) AS obligations, CAST(len(regexp_extract_all(t, '(?i)\\b(notwithstanding|except\\s+(where|when|if|as)|without\\s+prejudice\\s+to)\\b')) AS INT) AS derogations,
CASE WHEN regexp_extract(t, i, 1) <> '' THEN regexp_extract(t, i, 1) || ' (' || regexp_extract(t, i, 2) || ') ' || regexp_extract(t, i, 3) || '/' || regexp_extract(t, i, 4) || CASE WHEN regexp_extract(t, i, 5) <> '' THEN '/' || regexp_extract(t, i, 5) ELSE '' END
  WHEN regexp_extract(t, b, 1) <> '' THEN regexp_extract(t, b, 1) || ' ' || regexp_extract(t, b, 2) || '/' || regexp_extract(t, b, 3) END AS instrument,
nullif(regexp_extract(t, '\\b3\\d{10}\\b'), '') AS celex, trim(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, substring(trim(regexp_replace(t, '\\s+', ' ', 'g')), 1, 120) AS snippet
FROM x, (SELECT '(?i)(Regulation|Directive|Decision)[*_ ]*\\(?[ ]*(EU|EC|EURATOM)[*_ ]*\\)?[*_ ]*(?:No[._ ]*)?[*_ ]*(\\d{4})[ ]*/[ ]*(\\d+)(?:\\s*/\\s*(EC|EEC))?' AS i, '(?i)(Regulation|Directive|Decision)[*_ ]*No?[._ ]*[*_ ]*(\\d{4})[\\s/]+(\\d+)' AS b)""",
    "search_terms": f"WITH {c.CHUNKS} SELECT lineage_id, array_to_string({_tok('text')}, ' ') AS terms FROM c",
    "bm25_topk": _BM + " SELECT query_id, rank, lineage_id, round(score, 5) AS score FROM runs WHERE rank <= 10",
    "retrieve_sparse": _BM + " SELECT query_id, rank, lineage_id, round(1 / (60 + rank), 6) AS score, 'sparse' AS source_methods, CAST(NULL AS VARCHAR) AS graph_edge_type FROM runs WHERE rank <= 10",
    "dense_topk": _DN + " SELECT query_id, rank, vec_id, round(score, 5) AS score FROM r",
    "dense_label_metrics": _DN + ", p AS (SELECT query_id, e.label, avg(CASE WHEN r.label = e.label THEN 1.0 ELSE 0 END) AS p, min(CASE WHEN r.label = e.label THEN rank END) AS first FROM r JOIN embeddings e ON e.vec_id = r.query_id GROUP BY 1, 2) SELECT label, round(avg(p), 6) AS precision_at_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) AS n FROM p GROUP BY 1",
    "vector_cosine": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "html_clean": "SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)<br\\s*/?>|</p>|</li>', chr(10), 'g'), '(?i)<p\\b[^>]*>', '', 'g'), '(?i)<li\\b[^>]*>', '- ', 'g'), '<[^>]+>', '', 'g') || chr(10) || '- a & b' || chr(10), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\n{3,}', chr(10) || chr(10), 'g'), '^$', ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents",
    "window_samples": "WITH d AS (SELECT doc_id, length(text) AS n, greatest(length(text) - 400, 0) AS last FROM documents WHERE text <> ''), s AS (SELECT doc_id, n, last, least(400, n // 3) AS sec FROM d), w AS (SELECT doc_id, n, unnest(list_distinct([least(0, last), least(sec, last), least(CAST(floor(sec + (last - sec) * 1 / 2) AS BIGINT), last), last])) AS a FROM s) SELECT doc_id, CAST(a AS BIGINT) AS window_start, CAST(least(a + 400, n) AS BIGINT) AS window_end FROM w",
    "line_offsets": "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS l FROM x) SELECT doc_id, line_no, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start, length(l) AS chars FROM y",
    "recital_counts": "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS l FROM x), z AS (SELECT doc_id, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM y) SELECT doc_id, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_at FROM z WHERE regexp_matches(l, '^[ \\t]*([-*][ \\t]*)?\\(\\d+\\)[ \\t]+[A-Z\"''‘(]') GROUP BY 1",
    "span_overlap_check": f"WITH {c.CHUNKS}, x AS (SELECT *, lag(span_end) OVER (PARTITION BY doc_id ORDER BY span_start, span_end, lineage_id) AS b FROM c WHERE span_end IS NOT NULL) SELECT doc_id, lineage_id, 'inverted' AS problem FROM x WHERE span_end <= span_start UNION ALL SELECT doc_id, lineage_id, 'short' FROM x WHERE span_end - span_start BETWEEN 1 AND 7 UNION ALL SELECT doc_id, lineage_id, 'overlap' FROM x WHERE span_start < b UNION ALL SELECT doc_id, lineage_id, 'blank' FROM x WHERE coalesce(trim(text, {c.B}), '') = ''",
    "thin_fold_islands": f"WITH {c.CHUNKS}, x AS (SELECT *, CASE WHEN length(coalesce(text, '')) >= 200 THEN 1 ELSE 0 END AS big FROM c WHERE span_end IS NOT NULL), y AS (SELECT *, greatest(sum(big) OVER (PARTITION BY doc_id ORDER BY span_start, lineage_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS island FROM x) SELECT doc_id, CAST(island AS BIGINT) AS island, CAST(min(span_start) AS BIGINT) AS span_start, CAST(max(span_end) AS BIGINT) AS span_end, count(*) AS n_chunks, coalesce(string_agg(lineage_id, '|' ORDER BY lineage_id) FILTER (big = 0), '') AS absorbed FROM y GROUP BY 1, 2",
    "chunk_summary": f"WITH {c.CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(CASE WHEN thin THEN 1 ELSE 0 END) AS BIGINT) AS n_thin, CAST(sum(coalesce(len(absorbed), 0)) AS BIGINT) AS n_absorbed, min(length(coalesce(text, ''))) AS min_chars, CAST(floor(avg(length(coalesce(text, '')))) AS BIGINT) AS mean_chars, max(length(coalesce(text, ''))) AS max_chars FROM c GROUP BY 1",
    "nearest_interval": f"WITH {c.CHUNKS}, iv AS (SELECT lower(trim(doc_id, {c.B})) AS doc_id, span_start AS a, min(span_end) AS b, min(lower(trim(lineage_id, {c.B}))) AS interval_id FROM ast_nodes WHERE lower(trim(node_type)) IN ('article', 'preamble') AND span_start IS NOT NULL GROUP BY 1, 2), p AS (SELECT lineage_id AS point_id, doc_id, span_start AS pos FROM c), x AS (SELECT p.point_id, iv.interval_id, a, a <= pos AND pos < b AS inside, CASE WHEN a <= pos AND pos < b THEN 0 ELSE least(abs(pos - a), abs(pos - b)) END AS dist FROM p JOIN iv USING (doc_id)) SELECT point_id, interval_id, inside, CAST(dist AS BIGINT) AS distance FROM x QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, a) = 1",
    "answer_scores": f"WITH a AS (SELECT lower(trim(lineage_id, {c.B})) AS lineage_id, trim(regexp_replace(lower(coalesce(min(title), '')), '[^a-z0-9]+', ' ', 'g')) AS a FROM ast_nodes GROUP BY 1), b AS (SELECT lower(trim(lineage_id, {c.B})) AS lineage_id, trim(regexp_replace(lower(coalesce(min(title), '')), '[^a-z0-9]+', ' ', 'g')) AS b FROM graph_nodes GROUP BY 1), x AS (SELECT lineage_id, a, b, list_distinct(list_filter(string_split(a, ' '), lambda t: t <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda t: t <> '')) AS y FROM a JOIN b USING (lineage_id)) SELECT lineage_id, CAST(round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS DOUBLE) AS f1, CAST(CASE WHEN a = b THEN 1 ELSE 0 END AS DOUBLE) AS em, len(list_intersect(list_filter(x, lambda t: length(t) >= 3), list_filter(y, lambda t: length(t) >= 3))) AS shared FROM x",
    "lineage_parts": f"WITH {c.NODES} SELECT node_id, {_DOCX('node_id')} AS doc, CAST(nullif(regexp_extract(node_id, ':article:([0-9]+)', 1), '') AS INT) AS article FROM n",
    "obligation_sentences": f"WITH x AS (SELECT doc_id, unnest({_SENT}) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM x GROUP BY 1",
    "weakened_obligations": "WITH x AS (SELECT DISTINCT snippet FROM graph_edges WHERE snippet IS NOT NULL) SELECT snippet, CASE WHEN contains(snippet, 'shall') THEN regexp_replace(snippet, 'shall', 'may') ELSE regexp_replace(snippet, 'must', 'should') END AS weak FROM x WHERE contains(snippet, 'shall') OR contains(snippet, 'must')",
    "missing_embeddings": f"WITH {c.NODES} SELECT node_id, CAST(64 AS INT) AS dim FROM n WHERE kind IN ('term', 'article', 'preamble', 'document', 'entity') AND node_id NOT LIKE '%:document' AND trim(concat_ws(' ', title, term, art_number, doc_id)) <> ''",
    "query_segments": "WITH q AS (SELECT edge_id, min(snippet) AS s FROM graph_edges WHERE snippet IS NOT NULL GROUP BY 1), x AS (SELECT edge_id, list_slice(list_filter(list_transform(string_split(s, '.'), lambda v: trim(v)), lambda v: length(v) BETWEEN 16 AND 399), 1, 3) AS p FROM q) SELECT edge_id AS query_id, generate_subscripts(p, 1) - 1 AS segment, unnest(p) AS text FROM x",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events), y AS (SELECT user_id, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sn FROM x), z AS (SELECT user_id, sn, count(*) AS n FROM y GROUP BY 1, 2) SELECT user_id AS user, count(*) AS n_sessions, max(n) AS longest FROM z GROUP BY 1",
    "node_labels": f"WITH {c.NODES}, x AS (SELECT *, lower(coalesce(kind, 'node')) AS low, coalesce(nullif(trim(term), ''), nullif(trim(title), '')) AS named FROM n), y AS (SELECT *, trim(regexp_replace(CASE WHEN low = 'article' AND art_number IS NOT NULL THEN 'Article ' || art_number || coalesce(' ' || named, '') ELSE coalesce(named, CASE WHEN low = 'preamble' THEN 'Preamble' END, upper(low[1]) || low[2:] || ' ' || list_last(string_split(node_id, ':'))) END, '\\s+', ' ', 'g')) AS l FROM x) SELECT node_id, CASE WHEN length(l) <= 80 THEN l ELSE rtrim(l[:79]) || '…' END AS label, CASE WHEN kind = 'term' THEN concat_ws(' ', term, doc_id) WHEN kind = 'article' THEN concat_ws(' ', 'Article ' || art_number, title, doc_id) WHEN kind IN ('preamble', 'document', 'entity') THEN concat_ws(' ', title, doc_id) END AS search_text FROM y",
    "changed_numbers": "WITH x AS (SELECT DISTINCT snippet AS s, '(\\d+)(\\s*(?:%|per\\s+cent|days?|months?|years?|hours?|weeks?|units?|megawatts?|[kMG]W))' AS p FROM graph_edges WHERE snippet IS NOT NULL), y AS (SELECT s, regexp_extract(s, p, 0) AS w, regexp_extract(s, p, 1) AS k, regexp_extract(s, p, 2) AS u FROM x) SELECT s AS snippet, s[:strpos(s, w) - 1] || CAST(CAST(round_even(CAST(k AS DOUBLE) / 2, 0) AS BIGINT) AS VARCHAR) || u || s[strpos(s, w) + length(w):] AS changed FROM y WHERE w <> ''",
    "page_flags": f"WITH p AS (SELECT lower(trim(doc_id, {c.B})) AS doc_id, page_no, regexp_matches(text, '(?m)^\\s*[(\\[]\\d{{1,2}}[)\\]]\\s+\\S') AS n, regexp_matches(text, '(?m)\\p{{L}}[-‐­¬]\\s*$') AS h, regexp_matches(text, '(?m)\\S {{4,}}\\S.*\\n.*\\S {{4,}}\\S') AS c, regexp_matches(text, '(?m)^\\|.+\\|') AS tb, lower(regexp_extract(text, '^\\s*([^\\n]+)', 1)) AS first FROM chunks WHERE page_no <= 3 AND text IS NOT NULL), hd AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, first FROM p WHERE length(first) BETWEEN 5 AND 90 GROUP BY 1, 2 HAVING count(DISTINCT page_no) > 1)) SELECT doc_id, bool_or(n) AS has_footnotes, doc_id IN (SELECT doc_id FROM hd) AS has_headers, bool_or(h) AS hyphenation, bool_or(c) AS multi_column, bool_or(tb) AS has_tables FROM p GROUP BY doc_id",
}
_FOUND = ORACLE["text_features"]
_INSTRUMENT = _FOUND[_FOUND.index("CASE WHEN regexp_extract(t, i, 1)"):_FOUND.index(" AS instrument")]
_PATTERNS = _FOUND[_FOUND.index("(SELECT '(?i)(Regulation"):]
_form = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))".format
ORACLE["parser_scores"] = f"WITH d AS (SELECT source, coalesce(text, '') AS t, instrument AS want, n_chars FROM documents), f AS (SELECT source, t, want, n_chars, {_INSTRUMENT} AS found FROM d, {_PATTERNS}), m AS (SELECT source, {_form('found')} AS a, {_form('want')} AS b, CASE WHEN n_chars IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - abs(length(t) - n_chars) / CAST(greatest(1, n_chars) AS DOUBLE))) END AS cl FROM f) SELECT source, round(avg(CASE WHEN b = '' THEN 1.0 WHEN a = '' THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE 0.0 END), 6) AS instrument_match, round(avg(cl), 6) AS length_closeness, count(*) AS n FROM m GROUP BY 1"
