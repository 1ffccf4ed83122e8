"""Repetition inside a document: exact share, document statistics, and boosted trees on them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import spread
from .trees import Forest, fit

WORD = regex.compile(r"\p{L}+")
#: Words in a run, and the share from which a document counts as repetitive.
RUN, SHARE = 5, 0.3
#: Documents, at most, whose statistics are labelled to train the trees.
SAMPLE = 4000
#: The trees send a document straight to the exact check if its predicted share is at least one part in SLACK of the least prediction
#: for a repetitive document of the sample. All others are checked exactly only if two proven bounds leave it open that they are repetitive:
#: repeated runs of two words, and then of four, cover every repeated run of five.
SLACK = 10.0
#: Characters, at most, of the texts that are worked on at once, unless one text has more.
PIECE = 4_000_000

FEATURES = ["seen_words", "seen_pairs", "top_word", "log_words", "mean_word"]
#: The score never falls when more of a document was seen before.
MONOTONE = [1, 1, 0, 0, 0]


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, in lower case."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


class Words:
    """The words of several documents as one array of codes, with the document of each; runs never reach over a document's end."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, n: np.ndarray):
        self.codes, self.doc, self.n = codes, doc, n
        self._runs = {1: codes}

    @staticmethod
    def of(texts: list[list[str]]) -> "Words":
        ids: dict[str, int] = {}
        codes = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], dtype=np.int64)
        n = np.array([len(t) for t in texts], dtype=np.int64)
        return Words(codes, np.repeat(np.arange(len(texts)), n), n)

    def of_docs(self, keep: np.ndarray) -> "Words":
        """Only the documents that ``keep`` marks, numbered anew."""
        new = np.cumsum(keep) - 1
        at = keep[self.doc]
        return Words(_dense(self.codes[at]), new[self.doc[at]], self.n[keep])

    def runs(self, k: int) -> np.ndarray:
        """Codes of the runs of ``k`` words (1, 2, 4 or 5) that begin at each place, without collisions."""
        if k not in self._runs:
            half, rest = {2: (1, 1), 4: (2, 2), 5: (4, 1)}[k]
            a, b = self.runs(half), self.runs(rest)
            n = max(len(self.codes) - k + 1, 0)
            self._runs[k] = _dense(a[:n] * (int(b.max(initial=0)) + 1) + b[half : half + n])
        return self._runs[k]

    def seen(self, k: int) -> np.ndarray:
        """For each document, the share of words that lie in a run of ``k`` words that began earlier in it as well."""
        g, size = self.runs(k), len(self.codes)
        at = np.flatnonzero(self.doc[: len(g)] == self.doc[size - len(g) :])
        key = self.doc[at] * (int(g.max(initial=0)) + 1) + g[at]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        starts = at[first[inverse] < np.arange(len(at))]
        step = np.bincount(starts, minlength=size + 1) - np.bincount(starts + k, minlength=size + 1)
        return np.bincount(self.doc, weights=np.cumsum(step)[:size] > 0, minlength=len(self.n)) / np.maximum(self.n, 1)


def repeated_shares_of(words: Words) -> np.ndarray:
    """For each document: words in a run of five whose same five words began earlier, by all words; 0 for fewer than six words."""
    return words.seen(RUN)


def statistics(lists: list[list[str]], words: Words) -> np.ndarray:
    """The values of FEATURES of each document; all 0 for a text without words."""
    n, top = np.maximum(words.n, 1), int(words.codes.max(initial=0)) + 1
    key, count = np.unique(words.doc * top + words.codes, return_counts=True)
    owner = key // top
    most = np.zeros(len(n))
    np.maximum.at(most, owner, count)
    distinct = np.bincount(owner, minlength=len(n))
    chars = np.bincount(words.doc, weights=np.array([len(w) for t in lists for w in t], dtype=float), minlength=len(n)) if len(words.codes) else np.zeros(len(n))
    x = np.stack([1 - distinct / n, words.seen(2), most / n, np.log1p(words.n), chars / n], axis=1)
    return np.where(words.n[:, None] > 0, x, 0.0)


def _pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in pieces of PIECE characters, so that memory does not depend on how long the texts of a batch are."""
    at = (pdf["text"].str.len().fillna(0).cumsum() // PIECE).to_numpy()
    for k in np.unique(at):
        yield pdf[at == k]


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in _pieces(pdf):
            lists = [words_of(t) for t in part["text"]]
            words = Words.of(lists)
            yield pd.DataFrame(np.column_stack([statistics(lists, words), repeated_shares_of(words)]), columns=[*FEATURES, "share"])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Forest, float]:
    """Trees that predict the repeated share from statistics, and the least prediction of a candidate.

    Learnt from at most ``sample`` documents drawn by a hash of the id. The threshold is SHARE, or the least prediction
    for a repetitive document of the sample if that is less, divided by SLACK. A sample without a repetitive document
    (or an empty one) makes every document a candidate.
    """
    total = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(min(1.0, sample / max(total, 1)) * (1 << 20)))
    pdf = some.select("text").limit(sample).repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInPandas(_labelled, ", ".join(f"{c} double" for c in [*FEATURES, "share"])).toPandas()
    x, y = pdf[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), pdf["share"].to_numpy(float)
    forest = fit(x, y, MONOTONE, squared=True)
    if not (y >= SHARE).any():
        return forest, -np.inf
    least = float(forest.score(x[y >= SHARE]).min(initial=SHARE))
    return forest, least / SLACK


def repetition_scores(docs: DataFrame, model: tuple[Forest, float] | None = None) -> DataFrame:
    """(doc_id, n_words, score, candidate, share): ``score`` is the predicted share; ``share`` is exact, and null for documents that are
    ruled out, whose share is below SHARE.

    Null, empty and wordless texts have no words and share 0; rows with equal ids stay separate. One pass without a shuffle.
    """
    forest, least = model or train(docs)

    def scored(part: pd.DataFrame) -> pd.DataFrame:
        lists = [words_of(t) for t in part["text"]]
        words = Words.of(lists)
        x = statistics(lists, words)
        score = forest.score(x)
        hit = (score >= least) & (words.n > 0)
        open_ = ~hit & (x[:, FEATURES.index("seen_pairs")] >= SHARE)
        if open_.any():
            hit[np.flatnonzero(open_)[words.of_docs(open_).seen(4) >= SHARE]] = True
        share = np.full(len(x), np.nan)
        share[words.n == 0] = 0.0
        if hit.any():
            share[hit] = repeated_shares_of(words.of_docs(hit))
        return pd.DataFrame({"doc_id": part["doc_id"], "n_words": words.n, "score": score, "candidate": hit, "share": pd.array(np.where(np.isnan(share), None, share), dtype="Float64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from (scored(part) for part in _pieces(pdf))

    kind = dict(docs.dtypes)["doc_id"]
    # ids pass the worker as strings: a null among integers would turn them all into floats
    out = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).mapInPandas(run, "doc_id string, n_words long, score double, candidate boolean, share double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def repeated_shares(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, share): the exact repeated share of every document."""
    every = (Forest(np.array([0]), np.array([np.inf]), np.array([0]), np.array([0]), np.array([0.0]), np.array([0]), 1, 0.0), -np.inf)
    return repetition_scores(docs, every).select("doc_id", "n_words", "share")
