"""One entry point for retrieval: ``Retriever.retrieve(queries, mode, k)`` for many queries at once."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import write_table
from . import context as cx
from . import expansion as ex
from . import retrieval as rt

MODES = ["sparse", "dense", "graph", "neo4j_graph", "hybrid", "hybrid_graph", "hybrid_rerank", "hybrid_graph_rerank", "hybrid_gr_1hop", "hybrid_gr_relations", "hybrid_gr_expand"]
#: What the graph adds to the reranker's view in each mode that shows it.
SHOWN = {"hybrid_graph_rerank": {}, "hybrid_gr_1hop": {"paths": False}, "hybrid_gr_relations": {"paths": False, "snippets": False}, "hybrid_gr_expand": {}}
#: Candidates a reranker is shown without the graph; with it, it is shown all. Seeds and edge kinds of the undirected search.
RERANKED, UNDIRECTED_SEEDS, UNDIRECTED_KINDS = 20, 15, ["CROSS_REFERENCES", "AMENDS", "DEFINED_IN", "APPLIES_TO"]
#: Items of the fixed systems' common pool, and of the pool that one step of the graph fills up.
FROZEN_POOL, G1_POOL = 30, 50
OUT = ["query_id", "rank", "lineage_id", "score", "source_methods", "graph_edge_type"]


class Retriever:
    """Search over chunks (lineage_id, doc_id, text, span_start), graph nodes (node_id, kind, doc_id, …) and edges (src, dst, kind, edge_ord).

    ``embedder`` turns a text column into unit vectors, ``reranker`` a pool (query_id, question, rank, text, context)
    into orders (query_id, order); the defaults need no model. Postings and vectors are built once, on first use, and so
    are copies of the three tables, which many joins read. Queries of the same text are one search.
    """

    def __init__(self, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, embedder=rt.embed, reranker: Callable[[DataFrame], DataFrame] = cx.lexical_order):
        self._given = {"chunks": chunks, "nodes": nodes, "edges": edges.filter("src is not null and dst is not null")}
        self.embedder, self.reranker = embedder, reranker
        self._index: rt.InvertedIndex | None = None
        self._vectors: DataFrame | None = None
        self._ranked: tuple[DataFrame | None, int, DataFrame | None] = (None, 0, None)

    @cached_property
    def chunks(self) -> DataFrame:
        return write_table(self._given["chunks"], "chunks")[0]

    @cached_property
    def nodes(self) -> DataFrame:
        return write_table(self._given["nodes"], "nodes")[0]

    @cached_property
    def edges(self) -> DataFrame:
        return write_table(self._given["edges"], "edges")[0]

    @staticmethod
    def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each distinct text under the id of one of its queries (query_id, text), and the queries of each (query_id, one): results depend on the text alone."""
        asked, _ = write_table(queries.select("query_id", "text").distinct(), "asked")
        texts, _ = write_table(asked.groupBy("text").agg(F.min("query_id").alias("query_id")), "texts")
        who = asked.join(texts.select(F.col("query_id").alias("one"), F.col("text").alias("of")), F.col("text").eqNullSafe(F.col("of"))).select("query_id", "one")
        return texts, who

    @staticmethod
    def _for_all(x: DataFrame, who: DataFrame) -> DataFrame:
        return x.withColumnRenamed("query_id", "one").join(who, "one").select(x.columns)

    def sparse(self, queries: DataFrame, k: int) -> DataFrame:
        if self._index is None:
            self._index = rt.InvertedIndex(self.chunks)
        of, most, ranked = self._ranked
        if of is not queries or most < k:  # shorter lists of the same queries are the start of the longer
            self._ranked = (queries, k, ranked := self._index.search(queries, k))
        return ranked.filter(F.col("rank") <= k)

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        if self._vectors is None:
            self._vectors, _ = write_table(self.chunks.select("lineage_id", self.embedder(F.col("text")).alias("embedding")), "vectors")
        return rt.dense_search(queries.select("query_id", self.embedder(F.col("text")).alias("embedding")), self._vectors, k)

    def seed_nodes(self, ranked: DataFrame) -> DataFrame:
        """(query_id, node_id, ord, score): the node of each ranked chunk, itself or the article whose span holds it or is nearest; the best rank of a node stays."""
        own = ranked.join(self.nodes.select(F.col("node_id").alias("lineage_id")), "lineage_id", "left_semi").select("query_id", F.col("lineage_id").alias("node_id"), "rank", "score")
        rest = ranked.join(self.nodes.select(F.col("node_id").alias("lineage_id")), "lineage_id", "left_anti")
        spans = self.chunks.filter("lineage_id like '%:article:%' and lineage_id not like '%:para:%'").join(self.nodes.select(F.col("node_id").alias("lineage_id")), "lineage_id", "left_semi").select("doc_id", F.col("span_start").alias("a"), F.col("span_end").alias("b"), F.col("lineage_id").alias("interval_id"))
        at = self.chunks.join(rest.select("lineage_id").distinct(), "lineage_id", "left_semi").select(F.col("lineage_id").alias("point_id"), "doc_id", F.col("span_start").alias("at"))
        near = ex.nearest_interval(at, spans, "doc_id").select(F.col("point_id").alias("lineage_id"), F.col("interval_id").alias("node_id"))
        both = own.unionByName(rest.join(near, "lineage_id").select("query_id", "node_id", "rank", "score"))
        return both.groupBy("query_id", "node_id").agg(F.min("rank").alias("ord"), F.max("score").alias("score"))

    def graph(self, queries: DataFrame, k: int = 50, n_seeds: int = 10) -> DataFrame:
        """(query_id, rank, lineage_id, hop, edge): seeds from the sparse search in its order, then what the graph reaches, nearest first; only chunks."""
        seeds, _ = write_table(self.seed_nodes(self.sparse(queries, n_seeds)), "seeds")
        far = ex.expand(seeds, self.edges)
        x = seeds.select("query_id", "node_id", F.lit(0).alias("hop"), "ord", F.lit("seed").alias("edge")).unionByName(far.select("query_id", "node_id", "hop", F.lit(0).cast("long").alias("ord"), F.concat(F.array_join("kinds", ";"), F.lit("@"), F.col("hop").cast("string"), F.lit("hop")).alias("edge")))
        x = x.join(self.chunks.select(F.col("lineage_id").alias("node_id")), "node_id", "left_semi")
        w = Window.partitionBy("query_id").orderBy("hop", "ord", "node_id")
        return x.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("node_id").alias("lineage_id"), "hop", "edge")

    def undirected(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """(query_id, rank, lineage_id, hop, edge): seeds from the dense search, then trails of one or two edges in either direction; only chunks."""
        seeds, _ = write_table(self.seed_nodes(self.dense(queries, UNDIRECTED_SEEDS)).select("query_id", "node_id", F.round("score", 6).alias("score")), "seeds")
        targets = self.nodes.filter("kind in ('article', 'preamble')").join(self.chunks.select(F.col("lineage_id").alias("node_id")), "node_id", "left_semi").select("node_id")
        x = ex.undirected_search(ex.strong_seeds(seeds, 0.0, UNDIRECTED_SEEDS), self.edges, targets, UNDIRECTED_KINDS, cap=k)
        return x.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("node_id").alias("lineage_id"), "hop", F.when(F.col("hop") == 0, "seed").otherwise(F.concat(F.array_join("kinds", ";"), F.lit("@"), F.col("hop").cast("string"), F.lit("hop"))).alias("edge"))

    def _list(self, df: DataFrame, method: str) -> DataFrame:
        return df.select("query_id", F.lit(method).alias("method"), "rank", "lineage_id", F.lit(0.0).alias("score"))

    def pool(self, queries: DataFrame, n: int, graph: bool) -> DataFrame:
        """The ``n`` best fused chunks of each query: (query_id, rank, lineage_id, score, source_methods, graph_edge_type)."""
        lists = self.sparse(queries, n).unionByName(self.dense(queries, n))
        edge = None
        if graph:
            g = self.graph(queries, max(3 * n, 30)).filter("hop >= 1")
            g = g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
            edge, _ = write_table(g, "neighbours")
            lists = lists.unionByName(self._list(edge, "graph"))
        x = rt.hybrid(lists, n).select("query_id", "rank", "lineage_id", "score", F.col("methods").alias("source_methods"))
        if edge is None:
            return x.withColumn("graph_edge_type", F.lit(None).cast("string"))
        return x.join(edge.select("query_id", "lineage_id", F.col("edge").alias("graph_edge_type")), ["query_id", "lineage_id"], "left").select(OUT)

    def expanded(self, pool: DataFrame, per_seed: int = 2) -> DataFrame:
        """The pool and, behind it, up to ``per_seed`` new chunks within two hops of each of its nodes, nearest first; nodes choose in order of their key, and what one took no later one takes."""
        pool, _ = write_table(pool, "pool")
        seeds, _ = write_table(self.seed_nodes(pool).select("query_id", F.col("node_id").alias("seed")), "seeds")
        near = ex.expand(seeds.select(F.col("seed").alias("query_id"), F.col("seed").alias("node_id")).distinct(), self.edges).withColumnRenamed("query_id", "seed")
        near = near.join(self.chunks.select(F.col("lineage_id").alias("node_id")), "node_id", "left_semi")
        new = seeds.join(near, "seed").join(pool.select("query_id", F.col("lineage_id").alias("node_id")), ["query_id", "node_id"], "left_anti")
        # the nodes before the nth took at most per_seed * (n - 1), so it never needs more than its first per_seed * n
        new = new.withColumn("nth", F.dense_rank().over(Window.partitionBy("query_id").orderBy("seed")))
        new = new.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("hop", "node_id"))).filter(F.col("n") <= per_seed * F.col("nth"))
        one = F.struct("node_id", "hop", "kinds")
        by_seed = new.groupBy("query_id", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("c")))), lambda x: x["c"]).alias("c"))
        turns = by_seed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seed", "c"))).alias("turns"))
        none = F.array().cast(by_seed.schema["c"].dataType)
        taken = F.aggregate("turns", none, lambda had, s: F.concat(had, F.slice(F.filter(s["c"], lambda x: ~F.exists(had, lambda y: y["node_id"] == x["node_id"])), 1, per_seed)))
        size = pool.groupBy("query_id").agg(F.max("rank").alias("size"))
        more = turns.select("query_id", F.posexplode(taken).alias("pos", "x")).join(size, "query_id").select("query_id", (F.col("size") + F.col("pos") + 1).alias("rank"), F.col("x.node_id").alias("lineage_id"), F.lit(0.0).alias("score"), F.array(F.lit("graph:expand")).alias("source_methods"), F.concat(F.array_join("x.kinds", ";"), F.lit("@"), F.col("x.hop").cast("string"), F.lit("hop")).alias("graph_edge_type"))
        return pool.select(OUT).unionByName(more.select(OUT))

    def boosted_pool(self, queries: DataFrame, n: int) -> DataFrame:
        """The hybrid pool with the graph's boost on scores and its edge types; items and order stay those of the hybrid pool."""
        p = self.pool(queries, n, False)
        g, _ = write_table(self.graph(queries, max(3 * n, 30)).filter("hop >= 1").select("query_id", "lineage_id", "hop", "edge"), "neighbours")
        return rt.boosted(p.drop("graph_edge_type"), g).join(g.select("query_id", "lineage_id", F.col("edge").alias("graph_edge_type")), ["query_id", "lineage_id"], "left").select(OUT)

    def reranked(self, queries: DataFrame, pool: DataFrame, shown: dict | None, most: int | None = RERANKED) -> DataFrame:
        """A pool in the reranker's order; orders that are no permutation leave it as it was.

        Without ``shown`` the reranker sees the first ``most`` items only and the rest keep their places behind them; with
        it (options of ``context_lines``) it sees all items with their lines of the graph.
        """
        behind = None
        if shown is None and most is not None:
            pool, _ = write_table(pool, "pool")
            behind, pool = pool.filter(F.col("rank") > most), pool.filter(F.col("rank") <= most)
        p = pool.join(self.chunks.select("lineage_id", "text"), "lineage_id", "left").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
        if shown is not None:
            lines = cx.context_lines(p.select("query_id", "lineage_id", "question"), self.edges, self.nodes, **shown).select("query_id", "lineage_id", "context")
            p = p.join(lines, ["query_id", "lineage_id"], "left")
        else:
            p = p.withColumn("context", F.lit(None).cast("string"))
        p, _ = write_table(p, "pool")
        new = cx.rerank(p, self.reranker(p)).select("query_id", "lineage_id", F.col("rank").alias("new_rank"))
        x = p.join(new, ["query_id", "lineage_id"]).select("query_id", F.col("new_rank").alias("rank"), "lineage_id", "score", F.array_append("source_methods", "rerank").alias("source_methods"), "graph_edge_type")
        return x if behind is None else x.unionByName(behind.select(OUT))

    def retrieve(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, pool_n: int | None = None) -> DataFrame:
        """Ranked results of ``queries`` (query_id, text): OUT, ranks from 1, at most ``k`` per query.

        The pool of fused modes has max(k, 5) items, or ``pool_n``. Printed scores are those of the fusion, raised by the
        graph's boost in mode 'hybrid' without a new order. Queries that nothing matches give no row.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        texts, who = self._asked(queries)
        return self._for_all(self._retrieve(texts, mode, k, pool_n or max(k, 5)), who)

    def _retrieve(self, queries: DataFrame, mode: str, k: int, n: int) -> DataFrame:
        if mode in ("sparse", "dense"):
            x = rt.hybrid(getattr(self, mode)(queries, n), n).select("query_id", "rank", "lineage_id", F.round("score", 6).alias("score"), F.col("methods").alias("source_methods"), F.lit(None).cast("string").alias("graph_edge_type"))
        elif mode in ("graph", "neo4j_graph"):
            g = self.graph(queries, 3 * k) if mode == "graph" else self.undirected(queries, 3 * k)
            x = g.select("query_id", "rank", "lineage_id", F.when(F.col("hop") <= 1, 1.0).otherwise(0.5).alias("score"), F.array(F.lit(mode)).alias("source_methods"), F.col("edge").alias("graph_edge_type"))
        elif mode == "hybrid_graph":
            x = self.pool(queries, n, True)
        else:
            x = self.boosted_pool(queries, n)
            if mode == "hybrid_gr_expand":
                x = self.expanded(x)
            if mode != "hybrid":
                x = self.reranked(queries, x, SHOWN.get(mode))
        return x.filter(F.col("rank") <= k).select(OUT)

    def frozen(self, queries: DataFrame, system: str) -> DataFrame:
        """(query_id, rank, lineage_id, source, hybrid_rank, before, graph_distance, graph_path, score): the whole pool of a fixed system, reranked, with the provenance of each candidate.

        All start from the hybrid pool of FROZEN_POOL items. 'b0' adds nothing, 'g1' chunks one step away until the pool has
        G1_POOL items, 'g2' and 'g2_nogc' up to 12 of one and 9 of two steps; only 'g2' shows the reranker the graph's lines.
        ``before`` is the place before reranking.
        """
        if system not in ("b0", "g1", "g2", "g2_nogc"):
            raise ValueError(f"unknown system {system!r}")
        texts, who = self._asked(queries)
        return self._for_all(self._frozen(texts, system), who)

    def _frozen(self, queries: DataFrame, system: str) -> DataFrame:
        pool, _ = write_table(self.boosted_pool(queries, FROZEN_POOL), "pool")
        none = F.lit(None)
        both = pool.select(*OUT, F.lit("hybrid").alias("source"), F.col("rank").alias("hybrid_rank"), none.cast("int").alias("graph_distance"), none.cast("string").alias("graph_path"))
        if system != "b0":
            seeds, _ = write_table(self.seed_nodes(pool).select("query_id", "node_id"), "seeds")
            real = self.chunks.select(F.col("lineage_id").alias("node_id"))
            ways = ex.two_hop_paths(seeds, self.edges, real, ex.WALKED, max_hops=1 if system == "g1" else 2)
            ways = ways.join(pool.select("query_id", F.col("lineage_id").alias("node_id")), ["query_id", "node_id"], "left_anti")
            size = pool.groupBy("query_id").agg(F.count("*").alias("size"))
            new = ex.admit(ways, "first", G1_POOL) if system == "g1" else ex.admit(ways, "split_12_9", 21)
            new = new.join(size, "query_id")
            new = new.filter(F.col("ord") <= G1_POOL - F.col("size")) if system == "g1" else new
            both = both.unionByName(new.select("query_id", (F.col("size") + F.col("ord")).cast("long").alias("rank"), F.col("node_id").alias("lineage_id"), F.lit(0.0).alias("score"), F.array(F.lit("graph:new")).alias("source_methods"), none.cast("string").alias("graph_edge_type"),
                                               F.lit("graph").alias("source"), none.cast("long").alias("hybrid_rank"), F.col("hop").alias("graph_distance"), F.array_join("path", " ").alias("graph_path")))
        both, _ = write_table(both, "candidates")
        final = self.reranked(queries, both.select(OUT), {} if system == "g2" else None, None).select("query_id", "lineage_id", F.col("rank").alias("final"))
        return both.withColumnRenamed("rank", "before").join(final, ["query_id", "lineage_id"]).select("query_id", F.col("final").alias("rank"), "lineage_id", "source", "hybrid_rank", "before", "graph_distance", "graph_path", F.round("score", 8).alias("score"))

    def answer_contexts(self, queries: DataFrame, mode: str = "hybrid_graph", k: int = 10) -> DataFrame:
        """(query_id, context, refused): what a generator is shown for each query; those without results are refused."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        texts, who = self._asked(queries)
        r = self._retrieve(texts, mode, k, max(k, 5)).join(self.chunks.select("lineage_id", "doc_id", "text"), "lineage_id", "left").withColumnRenamed("graph_edge_type", "edge")
        return cx.refuse(queries.select("query_id"), self._for_all(cx.answer_context(r), who))
