"""Encoding of a corpus with a public tokenizer through a table of distinct words."""
from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import spread, write_table

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")

# fixed value: the split of texts before merges, published with the vocabulary; (?U) gives \s its Unicode meaning
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A word is sent to all workers if at least one in HEAD of all words of the corpus is that word: at most HEAD words, of HEAD_CHARS.
HEAD, HEAD_CHARS = 1 << 18, 32


def word_encoder(file: str):
    """A function for mapInPandas: (word, n) batches to (word, n, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(file)
        t.encode_special_tokens = True
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                yield pd.DataFrame({"word": part["word"], "n": part["n"], "ids": [e.ids for e in t.encode_batch(list(part["word"]), add_special_tokens=False)]})

    return run


def words_of(text: Column) -> Column:
    """The words of a text in order; null for null.

    A text with characters that the JVM's Unicode tables do not know stays one word, which the encoder splits itself.
    """
    return F.when(text.rlike("\\p{Cn}"), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0)))


def word_table(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """Each distinct word of the corpus once: word, n (its number), ids, head (whether it may go to all workers)."""
    counts = spread(docs.select(text)).select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    table, _ = write_table(counts.mapInPandas(word_encoder(file), "word string, n long, ids array<int>"), "words")
    total = table.agg(F.sum("n")).first()[0] or 0
    return table.withColumn("head", (F.col("n") * HEAD >= total) & (F.length("word") <= HEAD_CHARS))


def head_lookup(words: pa.Array, ids: pa.Array, keep: list[str], with_ids: bool):
    """A function for mapInArrow that looks up the words of each row in the head of the word table.

    Out: the columns ``keep``, ``ids`` of the known words (or their number ``n_known``), and the unknown words with the
    number of ids that stand before each (``gap_words``, ``gap_at``).
    """
    lens = np.concatenate([pc.list_value_length(ids).to_numpy(zero_copy_only=False), [0]]).astype(np.int64)
    out_schema = [("gap_words", pa.list_(pa.string())), ("gap_at", pa.list_(pa.int32()))]

    def offsets(n: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten()
            if pa.types.is_large_string(flat.type):
                flat = flat.cast(pa.string())
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            found = pc.index_in(flat, value_set=words)
            at = pc.fill_null(found, len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(lens[at])])
            rare = np.flatnonzero(at == len(words))
            row = np.searchsorted(ends, rare, "right") - 1
            rares = offsets(np.bincount(row, minlength=len(n)))
            cols = [batch.column(c) for c in keep]
            if with_ids:
                values = ids.take(found.drop_null()).flatten()
                cols.append(pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), values))
            else:
                cols.append(pa.array(before[ends[1:]] - before[ends[:-1]]))
            cols += [pa.ListArray.from_arrays(rares, flat.take(pa.array(rare))), pa.ListArray.from_arrays(rares, pa.array((before[rare] - before[ends[row]]).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ids" if with_ids else "n_known", *[c for c, _ in out_schema]])

    return run


def resolved(docs: DataFrame, table: DataFrame, text: str, with_ids: bool) -> DataFrame:
    """Rows of ``docs`` without the text, with row_id and the results of ``head_lookup``; written once, so that row_id stays."""
    head = table.filter("head").select("word", "ids").toArrow().combine_chunks()
    words, ids = (head.column(c).chunk(0) if head.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("ids", pa.list_(pa.int32()))))
    keep = [c for c in docs.columns if c != text]
    x = spread(docs).select(F.monotonically_increasing_id().alias("row_id"), *keep, words_of(F.col(text)).alias("words"))
    schema = T.StructType([x.schema["row_id"], *[x.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())) if with_ids else T.StructField("n_known", T.LongType()), T.StructField("gap_words", T.ArrayType(T.StringType())), T.StructField("gap_at", T.ArrayType(T.IntegerType()))])
    out, _ = write_table(x.mapInArrow(head_lookup(words.cast(pa.string()), ids, ["row_id", *keep], with_ids), schema), "resolved")
    return out


def encode(docs: DataFrame, file: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each row of ``docs``, special tokens' strings being ordinary text.

    Null and empty texts have the empty list. Rows with equal or null keys stay separate rows. Each distinct word of
    the corpus is encoded once; ids go back to their places by position: those of the bounded head within the row, all
    others by a join on the word. Only rows with a word beyond the head are shuffled.
    """
    file = file or os.path.join(TOKENIZERS, "byte_bpe_50k.json")
    docs = docs.select(key, text)
    table = word_table(docs, file, text)
    rows = resolved(docs, table, text, True)
    open_ = rows.filter("size(gap_words) > 0")
    gaps = open_.select("row_id", F.posexplode("gap_words").alias("i", "word")).join(table.filter("not head").select("word", F.col("ids").alias("own")), "word")
    gaps = gaps.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("i", "own"))).alias("gaps"))
    a = lambda i: F.when(i == 0, 0).otherwise(F.get("gap_at", i - 1))
    piece = lambda i: F.concat(F.slice("ids", a(i) + 1, F.coalesce(F.get("gap_at", i), F.size("ids")) - a(i)), F.coalesce(F.get("gaps.own", i), F.array().cast("array<int>")))
    filled = open_.join(gaps, "row_id").select(key, F.flatten(F.transform(F.sequence(F.lit(0), F.size("gap_at")), piece)).alias("ids"))
    return rows.filter("size(gap_words) = 0").select(key, "ids").unionByName(filled)


def token_counts(docs: DataFrame, file: str | None = None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` (without the text) with row_id and n_tokens; null and empty texts have 0."""
    file = file or os.path.join(TOKENIZERS, "byte_bpe_50k.json")
    table = word_table(docs, file, text)
    rows = resolved(docs, table, text, False)
    gaps = rows.select("row_id", F.explode("gap_words").alias("word")).join(table.filter("not head").select("word", F.size("ids").alias("k")), "word")
    gaps = gaps.groupBy("row_id").agg(F.sum("k").alias("n_gaps"))
    return rows.join(gaps, "row_id", "left").withColumn("n_tokens", F.col("n_known") + F.coalesce("n_gaps", F.lit(0))).drop("n_known", "n_gaps", "gap_words", "gap_at")


def piece_table(spark, file: str | None = None) -> DataFrame:
    """(id, piece): the bytes of each id of a rank file; as many rows as the vocabulary has."""
    file = file or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    lines = spark.read.text("file://" + file).filter("length(value) > 0")
    two = F.split("value", " ")
    return lines.select(two[1].cast("int").alias("id"), F.unbase64(two[0]).alias("piece"))


def decode(encoded: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows (key, ids) by a join of ids with their pieces; the empty list gives the empty text."""
    x = encoded.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", key, F.posexplode_outer("ids").alias("pos", "id"))
    x = x.join(F.broadcast(pieces), "id", "left")
    x = x.groupBy("row_id").agg(F.first(key).alias(key), F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))).alias("at"))
    return x.select(key, F.decode(F.unhex(F.array_join("at.h", "")), "UTF-8").alias("text"))
