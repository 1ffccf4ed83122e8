"""Calls of language models behind a cache table. The client is injected; without one, a stub answers."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]
WAITS = (5, 10, 15)


def stub_client(prompt: str) -> str:
    """A fixed answer that depends on the prompt alone."""
    return '{"answer": "no model", "chars": %d}' % len(prompt)


def ask(prompts: DataFrame, client: Client = stub_client, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """(key, answer, error) of (key, prompt); failures are tried again after ``waits`` seconds, then kept as an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf["key"], pdf["prompt"]):
                answer = error = None
                for wait in (*waits, None):
                    try:
                        answer, error = client(p), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"[:300]
                        if wait:
                            time.sleep(wait)
                rows.append((k, answer, error))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    return prompts.select("key", "prompt").mapInPandas(run, "key string, answer string, error string")


def ask_cached(prompts: DataFrame, cache_path: str, model: str, client: Client = stub_client, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """(id, answer, error) of (id, prompt): only prompts that the cache lacks reach the model, equal prompts once.

    The cache is a table of (key, model, answer) at ``cache_path``; the key is a hash of model and prompt. Errors are
    not cached. Answers are appended before the join, so a rerun asks nothing twice.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("key", F.sha1(F.concat(F.lit(model + "\u0001"), F.coalesce("prompt", F.lit("")))))
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    schema = "key string, model string, answer string"
    todo = keyed.select("key", "prompt").dropDuplicates(["key"])
    if there:
        todo = todo.join(spark.read.schema(schema).parquet(cache_path).select("key"), "key", "left_anti")
    from ..scale import write_table

    fresh, _ = write_table(ask(todo, client, waits), "answers")
    fresh.filter("error is null").select("key", F.lit(model).alias("model"), "answer").write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path).dropDuplicates(["key"]).select("key", "answer", F.lit(None).cast("string").alias("error"))
    return keyed.join(known.unionByName(fresh.filter("error is not null").select("key", "answer", "error")), "key", "left").select("id", "answer", "error")


def embed_missing(nodes: DataFrame, have: DataFrame, embedder) -> DataFrame:
    """(node_id, embedding) of nodes (node_id, search_text) that ``have`` lacks: distinct texts are embedded once and joined back."""
    todo = nodes.filter("search_text is not null and trim(search_text) != ''").join(have.select("node_id"), "node_id", "left_anti")
    texts = todo.select("search_text").distinct().withColumn("embedding", embedder(F.col("search_text")))
    return todo.select("node_id", "search_text").join(texts, "search_text").select("node_id", "embedding")


def generation_prompts(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(id, prompt) of queries (query_id, text): the question and its first ``k`` passages."""
    x = ranked.filter(F.col("rank") <= k).join(chunks.select("lineage_id", F.col("text").alias("passage")), "lineage_id", "left")
    g = x.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lineage_id", F.coalesce("passage", F.lit("")).alias("p")))), lambda s: F.concat(F.lit("["), s["lineage_id"], F.lit("] "), s["p"])), "\n").alias("passages"))
    return queries.join(g, "query_id", "left").select(F.col("query_id").cast("string").alias("id"), F.concat(F.lit("Answer from the passages alone and cite them.\nQuestion: "), "text", F.lit("\n"), F.coalesce("passages", F.lit("(no passages)"))).alias("prompt"))


def escalate(first: DataFrame, second: DataFrame, least: float = 0.7) -> DataFrame:
    """Verdicts (id, correct, confidence) of a first judge, replaced by the second's where the first is unsure, silent or failed.

    Adds decision: 'first', 'second', or 'none' where neither judged; no verdict is made up.
    """
    s = second.select("id", F.col("correct").alias("c2"), F.col("confidence").alias("f2"))
    x = first.join(s, "id", "left")
    sure = F.coalesce((F.col("confidence") >= least) & F.col("correct").isNotNull(), F.lit(False))
    return x.select("id", F.when(sure, F.col("correct")).otherwise(F.coalesce("c2", "correct")).alias("correct"), F.when(sure, F.col("confidence")).otherwise(F.coalesce("f2", "confidence")).alias("confidence"),
                    F.when(sure, "first").when(F.col("c2").isNotNull(), "second").when(F.col("correct").isNotNull(), "first").otherwise("none").alias("decision"))


def voted_scenarios(drafts: DataFrame, votes: DataFrame, least: int = 3) -> DataFrame:
    """(scenario_id, drafter, decision): of drafts (scenario_id, drafter, text) the one with the best vote (scenario_id, drafter, score) of at least ``least``.

    Drafts under 40 characters do not stand. 'both' or 'single' tells how many qualified; 'escalate' that none did.
    """
    x = drafts.filter(F.length("text") >= 40).join(votes, ["scenario_id", "drafter"], "left").withColumn("ok", F.coalesce(F.col("score") >= least, F.lit(False)))
    g = x.groupBy("scenario_id").agg(F.sum(F.col("ok").cast("int")).alias("n"), F.max_by("drafter", F.when(F.col("ok"), F.struct("score", "drafter"))).alias("drafter"))
    every = drafts.select("scenario_id").distinct().join(g, "scenario_id", "left")
    return every.select("scenario_id", F.when(F.col("n") > 0, F.col("drafter")).alias("drafter"), F.when(F.col("n") > 1, "both").when(F.col("n") == 1, "single").otherwise("escalate").alias("decision"))


def structure_prompts(docs: DataFrame, windows: int = 6, chars: int = 2500) -> DataFrame:
    """(id, prompt): asks a model for title, instrument, date, articles and definitions of each document, shown by sampled windows."""
    from ..functions.text import sample_windows

    w = F.transform(sample_windows(F.col("text"), windows, chars), lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]))
    return docs.filter("text != ''").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Give title, instrument, publication_date, articles and definitions of this document as a JSON object.\n"), F.array_join(w, "\n[...]\n")).alias("prompt"))


def reviewed(extracted: DataFrame, answers: DataFrame, fields: list[str]) -> DataFrame:
    """Extracted fields (id, …) overruled by a model's answers (id, answer) wherever those give a value that is not blank."""
    from ..functions.json_text import extract_json

    j = answers.select("id", extract_json(F.col("answer")).alias("j"))
    x = extracted.join(j, "id", "left")
    return x.select("id", *[F.coalesce(F.nullif(F.trim(F.get_json_object("j", f"$.{f}")), F.lit("")), F.col(f)).alias(f) for f in fields])
