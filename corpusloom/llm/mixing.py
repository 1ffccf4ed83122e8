"""Mixing sources to target weights by iterative proportional fitting with capped repeats."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import norm_label
from ..scale import drop_table, heavy_keys, lookup, running_totals, write_table
from .encoding import token_counts

#: Cells (source x language x topic) the driver rakes and holds, at most. More are raked as a table, each by itself all the same.
#: In ``Mix.cells`` alone, the driver's view of them, labels too rare for that number of cells appear as one label, OTHER, of their margin.
MAX_CELLS = 1_000_000
OTHER = "(other)"
#: Weights are lifted to this before they are scaled, so that a cell set to 0 by one margin can come back by another.
LEAST = 1e-12
#: Binary digits of the part of a record that is wanted.
UNIT_BITS = 30


def fill_each(group: np.ndarray, tokens: np.ndarray, weights: np.ndarray, caps: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Weights scaled by one factor a group, each at most its cap, so that group k carries ``targets[k]`` tokens; all at the cap if it can't."""
    def add(x: np.ndarray) -> np.ndarray:
        return np.bincount(group, x, len(targets))

    zero, full = targets <= 0, add(tokens * caps) <= targets
    w, free, scale = np.maximum(weights, LEAST), np.ones(len(tokens), dtype=bool), ~(zero | full)[group]
    while True:
        rest, load = targets - add(np.where(free, 0.0, tokens * caps)), add(np.where(free, tokens * w, 0.0))
        scaled = w * np.divide(rest, load, out=np.zeros(len(targets)), where=load > 0)[group]
        over = scale & free & (scaled > caps)
        if not over.any():
            return np.where(zero[group], 0.0, np.where(free & ~full[group], scaled, caps))
        free &= ~over


def fill(tokens: np.ndarray, weights: np.ndarray, caps: np.ndarray, target: float) -> np.ndarray:
    """``fill_each`` of one group."""
    return fill_each(np.zeros(len(tokens), dtype=int), tokens, weights, caps, np.array([target], dtype=float))


def rake(cells: pd.DataFrame, targets: dict[str, float], rounds: int = 60, tolerance: float = 1e-7) -> np.ndarray:
    """Weights (mean repeats) of cells (source, lang, topic, tokens, max_repeats).

    ``targets``: tokens wanted of each source. Languages and topics keep the shares they have in the cells. Marginals
    are fitted in turn, source last, so that a source that can reach its target does so exactly; weights never exceed
    ``max_repeats``.
    """
    t, cap = cells["tokens"].to_numpy(float), cells["max_repeats"].to_numpy(float)
    w, want = np.minimum(np.ones(len(cells)), cap), sum(targets.values())
    margins = []
    for name in ("lang", "topic"):
        group, labels = pd.factorize(cells[name])
        own = np.bincount(group, t, len(labels))
        margins.append((group, want * own / max(own.sum(), 1)))
    margins.append((pd.Index(list(targets), dtype=object).get_indexer(cells["source"]), np.array(list(targets.values()), dtype=float)))
    for _ in range(rounds):
        before = w.copy()
        for group, goals in margins:
            at = group >= 0
            w[at] = fill_each(group[at], t[at], w[at], cap[at], goals)
        if np.abs(w - before).max(initial=0) < tolerance:
            break
    return w


def _factors(cells: DataFrame, name: str, goal: Column, goals: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """(``name``, factor): the factor of ``fill_each`` for each label, 0 for none and infinity for all at the cap; and the paths written.

    ``goal`` may use ``own``, the tokens of a label, and the columns of ``goals``, joined by label. The tokens a label carries are a
    concave function of its factor, so steps along the tangent from 1 upwards reach the goal from below; a step is the
    last one if no further weight meets its cap on the way. Each pass is one sum by label, so no label has to fit a task.
    """
    t, cap, w = F.col("tokens").cast("double"), F.col("max_repeats").cast("double"), _lifted()
    ratio = F.when(w > 0, cap / w).otherwise(0.0)

    def sums(x: DataFrame, *more: Column) -> DataFrame:
        x = x.select("*", ratio.alias("_ratio"), (F.col("_ratio") > F.col("factor")).alias("_free"))
        return x.groupBy(name).agg(F.sum(F.when(F.col("_free"), 0.0).otherwise(t * cap)).alias("fixed"), F.sum(F.when(F.col("_free"), t * w).otherwise(0.0)).alias("load"), F.min(F.when(F.col("_free"), F.col("_ratio"))).alias("room"), *more)

    step = F.when(F.col("load") > 0, (F.col("goal") - F.col("fixed")) / F.col("load")).otherwise(float("inf"))
    x = sums(cells.withColumn("factor", F.lit(1.0)), F.sum(t).alias("own"), F.sum(t * cap).alias("most"), F.sum(t * w).alias("now"))
    x = (x if goals is None else x.join(goals, name)).withColumn("goal", goal)
    down, full = F.col("goal") <= F.col("now"), F.col("most") <= F.col("goal")
    x = x.withColumn("factor", F.when(F.col("goal") <= 0, 0.0).when(full, float("inf")).when(down, F.col("goal") / F.col("now")).otherwise(step))
    x, path = write_table(x.select(name, "goal", "factor", (down | full | F.coalesce(F.col("factor") <= F.col("room"), F.lit(True))).alias("done")), "factors")
    done, paths = x.filter("done"), [path]
    while x.filter("not done").limit(1).count():
        x = sums(cells.join(x.filter("not done").select(name, "goal", "factor"), name), F.first("goal").alias("goal"), F.first("factor").alias("factor"))
        x = x.withColumn("factor", F.greatest("factor", step))
        x, path = write_table(x.select(name, "goal", "factor", F.coalesce(F.col("factor") <= F.col("room"), F.lit(True)).alias("done")), "factors")
        done, paths = done.unionByName(x.filter("done")), [*paths, path]
    return done.select(name, "factor"), paths


def _lifted() -> Column:
    """The weight that is scaled: at least LEAST, at most the cap."""
    return F.least(F.greatest(F.col("weight"), F.lit(LEAST)), F.col("max_repeats").cast("double"))


def rake_table(cells: DataFrame, targets: DataFrame, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """``cells`` with their weights: ``rake`` for any number of cells, labels and sources, with nothing but one-row sums on the driver.

    ``targets``: source, target_tokens. The weights are those of ``rake`` but for the order of summation. Each round is written
    once, and what the round before wrote is deleted.
    """
    want, total = targets.agg(F.sum("target_tokens")).first()[0] or 0.0, cells.agg(F.sum("tokens")).first()[0] or 0
    share = F.lit(float(want)) * F.col("own") / F.lit(float(max(total, 1)))
    x, path = cells.withColumn("weight", F.least(F.lit(1.0), F.col("max_repeats").cast("double"))), None
    for _ in range(rounds):
        y, used = x.withColumn("before", F.col("weight")), [path] if path else []
        for name, goal, goals in (("lang", share, None), ("topic", share, None), ("source", F.col("target_tokens"), targets.select("source", "target_tokens"))):
            factors, paths = _factors(y, name, goal, goals)
            y, used = y.join(factors, name).withColumn("weight", F.least(F.col("max_repeats").cast("double"), F.col("factor") * _lifted())).drop("factor"), used + paths
        y, path = write_table(y, "raked")
        moved = y.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0
        x = y.drop("before")
        for p in used:
            drop_table(x.sparkSession, p)
        if moved < tolerance:
            break
    return x


class Mix:
    """A plan for a mix: ``report`` (one row per source of the targets), ``margins`` and ``records`` (rows taken, with repeats)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, file: str | None = None, seed: int = 13, size: float | None = None):
        """``docs``: doc_id, text, source, lang, doc_kind; ``targets``: source_name, target_weight, max_repeats.

        Source names are equal if they differ in case, outer blanks, or in blank, hyphen and underscore. Documents of
        other or null sources stay out. A language counts by the part before its first separator (en-GB is en). Null
        languages and topics are a label of their own; a null or negative weight is 0, a null or negative cap 0; of
        repeated targets the weights add up and the largest cap holds. ``size`` is the size of the mix in tokens, by
        default that of all documents of the sources in ``targets``. Every language, topic and source is raked by itself,
        up to MAX_CELLS cells on the driver, more of them as a table.
        """
        self.spark, self.seed = docs.sparkSession, seed
        wanted = targets.filter("source_name is not null").groupBy(norm_label(F.col("source_name")).alias("source")).agg(
            F.min("source_name").alias("source_name"), F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.least(F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))), F.lit(2**31 - 1)).cast("int").alias("max_repeats"))
        wanted, _ = write_table(wanted, "targets")
        n_sources, weight = wanted.agg(F.count("*"), F.sum("weight")).first()
        lang, topic = F.split_part(norm_label(F.col("lang")), F.lit("_"), F.lit(1)), norm_label(F.col("doc_kind"))
        x = docs.select("doc_id", "text", norm_label(F.col("source")).alias("source"), F.coalesce(F.nullif(lang, F.lit("")), F.lit("(none)")).alias("lang"), F.coalesce(topic, F.lit("(none)")).alias("topic"),
                        F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"))
        x = x.join(F.broadcast(wanted.select("source")) if n_sources <= 10_000 else wanted.select("source"), "source", "left_semi")
        self.sizes, _ = write_table(token_counts(x, file), "sizes")
        fine, _ = write_table(self.sizes.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "cells")
        n_cells, tokens = fine.agg(F.count("*"), F.sum("tokens")).first()
        total = float(tokens or 0) if size is None else float(size)
        share = F.col("weight") / F.lit(max(weight or 0.0, 1e-300))
        self._n_sources, self._targets = n_sources, wanted.withColumn("target_share", share).withColumn("target_tokens", share * F.lit(total))
        fine = fine.join(wanted.select("source", "max_repeats"), "source")
        self._small = max(n_cells, n_sources) <= MAX_CELLS
        if self._small:
            goal, cells = self._targets.toPandas(), fine.toPandas().sort_values(["source", "lang", "topic"], ignore_index=True)
            cells["weight"] = rake(cells, dict(zip(goal["source"], goal["target_tokens"])))
            cells = cells[["source", "lang", "topic", "tokens", "n_docs", "max_repeats", "weight"]].astype({"tokens": "int64", "n_docs": "int64", "max_repeats": "int32"})
            self._cells = self.spark.createDataFrame(cells, "source string, lang string, topic string, tokens long, n_docs long, max_repeats int, weight double")
        else:
            self._cells = rake_table(fine, self._targets)

    @property
    def cells(self) -> pd.DataFrame:
        """The driver's view of the cells and their weights; of more than MAX_CELLS, rare labels are shown as OTHER with their mean weight. Nothing else is computed from it."""
        x = self._cells
        if not self._small:
            most = max(int((MAX_CELLS / max(self._n_sources, 1)) ** 0.5) - 1, 1)
            tokens = x.agg(F.sum("tokens")).first()[0] or 0
            for name in ("lang", "topic"):
                held = self._cells.groupBy(name).agg(F.sum("tokens").alias("t")).filter((F.col("t") > 0) & (F.col("t") * most >= tokens)).select(name, F.col(name).alias("_held"))  # at most ``most`` labels
                x = x.join(F.broadcast(held), name, "left").withColumn(name, F.coalesce("_held", F.lit(OTHER))).drop("_held")
            mean = F.when(F.sum("tokens") > 0, F.sum(F.col("tokens") * F.col("weight")) / F.sum("tokens")).otherwise(F.avg("weight"))
            x = x.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("n_docs"), F.max("max_repeats").alias("max_repeats"), mean.alias("weight"))
        return x.toPandas()

    @property
    def _goal(self) -> DataFrame:
        by = self._cells.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("n_docs"), F.sum(F.col("tokens") * F.col("weight")).alias("raked_tokens"))
        x = self._targets.join(by, "source", "left").fillna(0, ["tokens", "n_docs", "raked_tokens"])
        # raked tokens below the target mean that all records are at their cap
        return x.withColumn("reachable", F.col("raked_tokens") >= F.col("target_tokens") * (1 - 1e-9))

    @property
    def goal(self) -> pd.DataFrame:
        """The report with weights, target and raked tokens, on the driver: a row for each source of the targets."""
        return self._goal.toPandas()

    @property
    def report(self) -> DataFrame:
        """source_name, tokens, n_docs, target_share, max_repeats, reachable: what each source has and shall give."""
        return self._goal.select("source", "source_name", "tokens", "n_docs", "target_share", "max_repeats", "reachable")

    @property
    def margins(self) -> DataFrame:
        """margin, label, wanted_tokens, raked_tokens, met: what raking reached; ``met`` allows for one in a thousand of the wanted tokens."""
        want, total = self._targets.agg(F.sum("target_tokens")).first()[0] or 0.0, self._cells.agg(F.sum("tokens")).first()[0] or 0
        rows = self._goal.select(F.lit("source").alias("margin"), F.col("source").alias("label"), F.col("target_tokens").alias("wanted_tokens"), "raked_tokens")
        for name in ("lang", "topic"):
            by = self._cells.groupBy(F.lit(name).alias("margin"), F.col(name).alias("label")).agg((F.lit(float(want)) * F.sum("tokens") / F.lit(float(max(total, 1)))).alias("wanted_tokens"), F.sum(F.col("tokens") * F.col("weight")).alias("raked_tokens"))
            rows = rows.unionByName(by)
        return rows.withColumn("met", F.abs(F.col("raked_tokens") - F.col("wanted_tokens")) <= F.col("wanted_tokens") * 1e-3 + 1e-6)

    @property
    def records(self) -> DataFrame:
        """doc_id, source, n_tokens, repeats of the records taken.

        All records of a cell are taken floor(weight) times; those that come first by a hash of their id and text are taken
        once more, until they carry the fraction of the cell's tokens that is still wanted. The record of a cell that is wanted
        in part is taken where the running sum of these parts, over the source's cells by length of that record, passes
        the next half. So the tokens drawn of a cell, and those drawn of a source however many cells it has, differ from the
        raked ones by at most its longest record, and the draw does not depend on partitions. Weights count to 12 decimals
        here, so that the order in which raking summed decides no draw.
        """
        key = ["source", "lang", "topic"]
        c = self._cells.select(*key, F.col("tokens").alias("cell_tokens"), "n_docs", F.round("weight", 12).alias("weight"), "max_repeats")
        x = running_totals(self.sizes, key, ["draw", "doc_id", "row_id"], "n_tokens", "before")
        if self._small:
            x = x.join(F.broadcast(c), key)  # MAX_CELLS rows
        else:
            total, parts = c.agg(F.sum("n_docs")).first()[0] or 0, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            x = lookup(x, c, key, heavy_keys(c, key, "n_docs", total, parts), "inner")
        extra, end = F.col("weight") - F.floor("weight"), F.col("before") + F.col("n_tokens")
        x = x.withColumn("quota", extra * F.col("cell_tokens")).withColumn("part", (F.col("before") < F.col("quota")) & (end > F.col("quota")))
        whole = x.filter("not part").withColumn("once", (extra > 0) & (end <= F.col("quota")))
        # parts are counted in units, so that their sums are exact in any order
        part = x.filter("part").withColumn("units", F.round((F.col("quota") - F.col("before")) / F.col("n_tokens") * 2**UNIT_BITS).cast("long"))
        part = running_totals(part, ["source"], ["n_tokens", "lang", "draw", "topic"], "units", "_sum")
        half = F.lit(2 ** (UNIT_BITS - 1))
        part = part.withColumn("once", F.shiftright(F.col("_sum") + F.col("units") + half, UNIT_BITS) > F.shiftright(F.col("_sum") + half, UNIT_BITS)).drop("units", "_sum")
        x = whole.unionByName(part).withColumn("repeats", F.least(F.floor("weight") + F.col("once").cast("int"), F.col("max_repeats")).cast("int"))
        return x.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")

    @property
    def shares(self) -> DataFrame:
        """The report with mixed_tokens and actual_share of each source in the drawn mix."""
        got = self.records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
        got, _ = write_table(got, "mixed")
        all_tokens = max(got.agg(F.sum("mixed_tokens")).first()[0] or 0, 1)
        x = self.report.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
        return x.withColumn("actual_share", F.col("mixed_tokens") / float(all_tokens))
