"""M8: a forest over coded rows. Rows with equal codes, label and weight are one cell; a tree's resample gives a cell of n rows a Poisson count of mean n, which is
what Poisson counts of its rows add up to. All trees grow a level at a time in the same scans, as those of ``boosting`` do.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.boosting import MOST_PARTS, Node, Trees, best_split, coded, leaves, spread, with_children
from riskloom.operators.fits import arrays_of, packed, unpacked_values
from riskloom.sources.staging import staged

#: Cells that draw from one generator, about.
SHARD_CELLS = 8192
#: Numbers of a scan's sums at most; trees beyond take another scan.
SCAN_SUMS = 1 << 22


def in_shards(cells: DataFrame, columns: int) -> DataFrame:
    """``shard, block``: cells in shards by hash, each sorted, so that a shard's draws are the same in every run."""
    order = ["__y", *[f"__b{i}" for i in range(columns)], "__w"]
    cells = cells.select(*order, F.col("__n").cast("double").alias("__n"))
    shards = max(1, -(-cells.count() // SHARD_CELLS))

    def pack(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in order]).combine_chunks()
        (batch,) = packed(table.to_batches())
        return pa.table({"shard": table.column("__shard")[:1], "block": batch.column(0)})

    dealt = cells.withColumn("__shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    return staged(spread(staged(dealt.groupBy("__shard").applyInArrow(pack, "shard int, block binary"), "shards")), "shards")


def sums(shards: DataFrame, growing: Sequence[tuple[int, list[Node], list[int]]], sizes: Sequence[int], seed: int) -> dict[tuple[int, int], list[np.ndarray]]:
    """For wanted leaves of (number, tree, wanted) for each column a row for each code: weight of events, weight, count of the tree's resample."""
    ends = np.cumsum([3 * s for s in sizes])
    length = int(ends[-1])
    whole = sum(len(wanted) for _, _, wanted in growing) * length
    columns = [f"__b{i}" for i in range(len(sizes))]

    def run(part):
        total = np.zeros(whole)
        for shard, block in part:
            for batch in unpacked_values([block]):
                a = arrays_of(batch, [*columns, "__y", "__w", "__n"])
                b, y, w, n, begin = [a[c] for c in columns], a["__y"], a["__w"], a["__n"], 0
                for number, tree, wanted in growing:
                    k = np.random.default_rng([seed, number, shard]).poisson(n)
                    slot = np.full(len(tree), -1)
                    slot[wanted] = np.arange(len(wanted))
                    at = slot[leaves(tree, b)]
                    on = np.flatnonzero((at >= 0) & (k > 0))
                    at, k = at[on], k[on]
                    kw = k * w[on]
                    own = total[begin : begin + len(wanted) * length].reshape(len(wanted), length)
                    for c, s, e in zip(b, sizes, ends, strict=True):
                        place = at * s + c[on]
                        for v, value in enumerate((kw * y[on], kw, k)):
                            own[:, e - 3 * s + v : e : 3] += np.bincount(place, value, len(wanted) * s).reshape(len(wanted), s)
                    begin += own.size
        yield total

    parts = shards.rdd.mapPartitions(run)
    total = parts.treeReduce(np.add) if parts.getNumPartitions() > MOST_PARTS else sum_of(parts.collect(), whole)
    out, begin = {}, 0
    for number, _, wanted in growing:
        for i in wanted:
            flat = total[begin : begin + length]
            out[number, i] = [flat[e - 3 * s : e].reshape(s, 3) for s, e in zip(sizes, ends, strict=True)]
            begin += length
    return out


def sum_of(parts: list[np.ndarray], whole: int) -> np.ndarray:
    total = np.zeros(whole)
    for x in parts:
        total += x
    return total


def fit_forest(df: DataFrame, numeric: Sequence[str], label: str, weight: str | None = None, trees: int = 300, depth: int = 6, least_rows: int = 50, bins: int = 255, seed: int = 1, fills: Mapping[str, float] | None = None, start: Trees | None = None) -> Trees:
    """``trees`` trees on resamples, Gini splits among about the root of the number of columns, chosen for each node (the others only if none of these splits it);
    a leaf's value is its share of events, and the forest's probability the mean over trees. Rows without a label are no training rows. ``start``: what ``coded`` gives for the same rows and settings."""
    model = replace(start or coded(df, numeric, [], label, weight=weight, bins=bins, fills=fills), votes=True)
    sizes = model.sizes
    shards = in_shards(model.cells, len(sizes))
    some = math.ceil(math.sqrt(len(sizes)))
    forest, wanted = [[Node(0.0, 0.0, 0)] for _ in range(trees)], [[0] for _ in range(trees)]
    for _ in range(depth):
        growing = [(t, forest[t], wanted[t]) for t in range(trees) if wanted[t]]
        wanted = [[] for _ in range(trees)]
        while growing:
            now, numbers = [], 0
            while growing and (not now or numbers + 3 * sum(sizes) * len(growing[0][2]) <= SCAN_SUMS):
                now.append(growing.pop(0))
                numbers += 3 * sum(sizes) * len(now[-1][2])
            found = sums(shards, now, sizes, seed)
            for t, tree, looked in now:
                for i in looked:
                    hist = found[t, i]
                    g, h, n = hist[0].sum(axis=0)
                    tree[i].gradient, tree[i].hessian, tree[i].n = float(g), float(h), int(n)
                    order = np.random.default_rng([seed, t, i, 1]).permutation(len(sizes))
                    for among in (order[:some], *order[some:, None]):
                        tree[i].split = best_split(hist, len(sizes), 0.0, least_rows, among)
                        if tree[i].split is not None:
                            wanted[t] += with_children(tree, i)
                            break
    for tree in forest:
        for x in tree:
            x.value = x.gradient / x.hessian if x.children is None and x.hessian else 0.0
    model.trees = forest
    return model
