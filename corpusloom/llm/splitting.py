"""Splitting oversized texts at natural boundaries, with overlap."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import BLANKS, norm_key

#: Strength of boundaries; nodes of the syntax tree beat what the text itself shows.
NODE_STRENGTH = {"document": 7, "article": 7, "preamble": 7, "table": 7, "paragraph": 6, "sentence": 5}
NAMES = ["none", "blank", "clause", "sentence", "line", "tree sentence", "tree paragraph", "tree node"]
BLANK_LINE = 6
_MARKS = re.compile(r"(?P<para>\n[ \t\r]*\n\s*)|(?P<line>\r\n|\r|\n)|(?P<sent>(?<=[.!?])[\"')\]»”]*[ \t]+)|(?P<clause>(?<=[,;:])[ \t]+)|(?P<blank>[ \t  - 　]+)")
_OF = {"para": BLANK_LINE, "line": 4, "sent": 3, "clause": 2, "blank": 1}


def boundaries(text: str, marks: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions inside ``text`` in order, and their strengths; a cut lies after the blanks that make it."""
    found = {m.end(): _OF[m.lastgroup] for m in _MARKS.finditer(text)}
    for p, s in marks.items():
        found[p] = max(s, found.get(p, 0))
    pos = np.array(sorted(p for p in found if 0 < p < len(text)), dtype=np.int64)
    return pos, np.array([found[p] for p in pos], dtype=np.int64)


class RangeMax:
    """Sparse table: the strongest boundary of any index range, the rightmost of equals, in two look-ups."""

    def __init__(self, strength: np.ndarray, widest: int):
        n = len(strength)
        self.n = n
        self.rows = [strength * (n + 1) + np.arange(n)]
        width = 1
        while 2 * width <= min(n, widest):
            prev = self.rows[-1]
            self.rows.append(np.maximum(prev[:-width], prev[width:]))
            width *= 2

    def best(self, lo: int, hi: int) -> int:
        """Index of the strongest boundary in [lo, hi), -1 if the range is empty."""
        if hi <= lo:
            return -1
        k = min((hi - lo).bit_length() - 1, len(self.rows) - 1)
        w, row = 1 << k, self.rows[k]
        top = int(row[lo])
        for at in range(lo + w, hi - w, w):  # at most once, unless the range is wider than the table
            top = max(top, int(row[at]))
        return max(top, int(row[hi - w])) % (self.n + 1)


def cut(text: str, limit: int, overlap: int, marks: dict[int, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, strength) of pieces of at most ``limit`` characters; neighbours share exactly ``overlap`` of them.

    Each piece ends at the strongest boundary of all permissible lengths (more than ``overlap``, at most ``limit``), the
    rightmost of equals; where there is no boundary at all it is cut at the limit. A text within the limit is one piece.
    """
    n, limit = len(text), max(int(limit), 1)
    overlap = min(max(int(overlap), 0), limit - 1)
    if n <= limit:
        return [(0, n, 0)]
    pos, strength = boundaries(text, marks or {})
    table = RangeMax(strength, limit) if len(pos) else None
    out, start = [], 0
    while n - start > limit:
        end, s = start + limit, 0
        i = table.best(int(np.searchsorted(pos, start + overlap + 1)), int(np.searchsorted(pos, end, "right"))) if table else -1
        if i >= 0:
            end, s = int(pos[i]), int(strength[i])
        out.append((start, end, s))
        start = end - overlap
    out.append((start, n, 0))
    return out


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds _limit and _overlap of a chunk's node_type; row 'any' serves null, blank and unlisted types."""
    lim = limits.select(F.coalesce(norm_key(F.col("node_type")), F.lit("any")).alias("_t"), F.col("max_chars").alias("_m"), F.col("overlap_chars").alias("_o")).dropDuplicates(["_t"])
    rest = lim.filter("_t = 'any'").select(F.col("_t").alias("_any"), F.col("_m").alias("_am"), F.col("_o").alias("_ao"))
    x = chunks.withColumn("_t", F.coalesce(F.nullif(norm_key(F.col("node_type")), F.lit("")), F.lit("any"))).join(lim, "_t", "left")
    x = x.withColumn("_any", F.when(F.col("_m").isNull(), F.lit("any"))).join(rest, "_any", "left")
    return x.withColumn("_limit", F.coalesce("_m", "_am")).withColumn("_overlap", F.coalesce("_o", "_ao", F.lit(0))).drop("_t", "_any", "_m", "_o", "_am", "_ao")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks whose text without outer blanks is longer than its limit; of rows sent again the latest counts.

    Only rows beyond the limit carry their text into the shuffle; recency is settled on (chunk_id, ingested_at) alone.
    Null texts and null ids are never oversized; a null ``ingested_at`` is the oldest.
    """
    at = F.coalesce(F.col("ingested_at"), F.lit("0001-01-02").cast("timestamp")).alias("_at")
    slim = chunks.select("chunk_id", norm_key(F.col("lineage_id")).alias("lineage_id"), "node_type", F.btrim("text", F.lit(BLANKS)).alias("text"),
                         (F.coalesce("span_start", F.lit(0)) + F.length("text") - F.length(F.ltrim(F.translate("text", "\t\r\n", "   ")))).alias("span_start"), at)
    big = with_limits(slim, limits).filter((F.col("_limit") > 0) & (F.length("text") > F.col("_limit")))
    last = chunks.filter("chunk_id is not null").select("chunk_id", at).groupBy("chunk_id").agg(F.max("_at").alias("_at"))
    return big.join(last, ["chunk_id", "_at"]).drop("_at").dropDuplicates(["chunk_id"])


PIECES = "chunk_id long, piece_no int, n_pieces int, lineage_id string, node_type string, text string, span_start int, span_end int, boundary string"

#: Characters of the source for which chunks and node boundaries meet in one key.
STRETCH = 8192


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            marks = {int(m["at"]): int(m["s"]) for m in r.marks} if r.marks is not None else {}
            parts = cut(r.text, r.max_chars, r.overlap_chars, marks)
            rows += [(r.chunk_id, i, len(parts), r.lineage_id, r.node_type, r.text[a:b], r.span_start + a, r.span_start + b, NAMES[s] if i + 1 < len(parts) else "end") for i, (a, b, s) in enumerate(parts)]
        yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "n_pieces", "lineage_id", "node_type", "text", "span_start", "span_end", "boundary"])


def node_marks(big: DataFrame, ast_nodes: DataFrame) -> DataFrame:
    """(chunk_id, marks): boundaries of child nodes inside each chunk's text, as (at, s): offset in the text and strength.

    Boundaries of a parent are reduced to one per position before they meet the chunks, by stretches of the source, so a
    parent with any number of nodes is spread over the tasks, and a chunk gathers at most one mark per character it has.
    """
    kind = norm_key(F.col("node_type"))
    strength = F.coalesce(*[F.when(kind == k, v) for k, v in NODE_STRENGTH.items()], F.lit(5))
    ends = ast_nodes.select(norm_key(F.col("parent_lineage")).alias("lineage_id"), strength.alias("s"), F.explode(F.array("span_start", "span_end")).alias("p")).filter("lineage_id is not null and p is not null")
    ends = ends.groupBy("lineage_id", "p").agg(F.max("s").alias("s")).withColumn("stretch", F.floor(F.col("p") / STRETCH))
    last = F.col("span_start") + F.length("text") - 1
    spans = big.select("chunk_id", "lineage_id", F.col("span_start").alias("a"), last.alias("b"), F.explode(F.sequence(F.floor(F.col("span_start") / STRETCH), F.floor(last / STRETCH))).alias("stretch"))
    inside = spans.join(ends, ["lineage_id", "stretch"]).filter("p > a and p <= b")
    return inside.groupBy("chunk_id").agg(F.collect_list(F.struct((F.col("p") - F.col("a")).alias("at"), "s")).alias("marks"))


def split_oversized(chunks: DataFrame, limits: DataFrame, ast_nodes: DataFrame) -> DataFrame:
    """Pieces of the oversized chunks (see PIECES): within the limit, each with its span in the source.

    Boundaries come from the text and from the child nodes in ``ast_nodes`` (strength by node_type). Nodes with null or
    foreign spans are ignored; of several nodes at one position the strongest counts. Chunks within their limit give no row.
    """
    big = oversized(chunks, limits)
    x = big.join(node_marks(big, ast_nodes), "chunk_id", "left")
    return x.select("chunk_id", "lineage_id", "node_type", "text", "span_start", F.col("_limit").alias("max_chars"), F.col("_overlap").alias("overlap_chars"), "marks").mapInPandas(_pieces, PIECES)
