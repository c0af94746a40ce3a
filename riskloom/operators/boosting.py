"""M8: gradient boosting of histograms, grown leaf by leaf, with missing values as a way of their own and splits of categories.

Numbers are cut once into bins of equal count of the training rows; from then on a row is a few small codes, and rows with equal codes and label are one
row with their number and weight, so scans grow with the distinct codes. A scan adds up, for each open leaf, column and code, gradients, Hessians and counts; Spark sums them by place and the driver, which gets a histogram for each leaf and column, looks for
the best splits. Trees grow by gain: a scan is made only for leaves whose children the order of gains needs next, and for all of them together, so a
tree takes about as many scans as it is deep. A part of the rows, chosen by hash within each class, is left out of growth and
says when to stop.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.audit import unpivoted
from riskloom.operators.fits import arrays_of, blocks, logistic, packed, unpacked, unpacked_values
from riskloom.operators.ordered import cut_points
from riskloom.sources.staging import staged

#: Trees after which rows are written anew with the sum of all trees.
RESTAGE = 10
#: Smallest Hessian of a side of a split, and what smooths the order of categories.
LEAST_HESSIAN, CATEGORY_SMOOTHING = 1e-3, 10.0
#: Partial sums of a scan that go to the driver as they are; more are summed in a tree first.
MOST_PARTS = 64
#: Models with no more combinations of codes than this have their scores in a table that is made once.
FEW_CELLS = 1 << 18


@dataclass
class Split:
    """Rows whose code of ``column`` is in ``left`` (a flag for each code, the last for missing values) go left."""

    column: int
    left: np.ndarray
    gain: float
    #: Gradient, Hessian and count of the two sides.
    sides: tuple[np.ndarray, np.ndarray]


@dataclass
class Node:
    gradient: float
    hessian: float
    n: int
    split: Split | None = None
    children: tuple[int, int] | None = None
    value: float = 0.0
    depth: int = 0


@dataclass
class Trees:
    """A fitted model: how columns become codes, the first score and the trees. A missing number has a code of its own, or the value that ``fills`` gives
    its column. Trees with ``votes`` hold probabilities, and their mean is the model's."""

    numeric: list[str]
    categorical: list[str]
    edges: list[list[float]]
    levels: list[list[str]]
    base: float
    trees: list[list[Node]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    fills: dict[str, float] = field(default_factory=dict)
    votes: bool = False
    #: The rows with a label that it was fitted on and those held out, as cells: ``__y``, codes and the number of rows ``__n``.
    cells: DataFrame | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"cells": None}  # tasks don't get it

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def sizes(self) -> list[int]:
        """Codes of each column; the last is for missing values and unknown categories."""
        return [len(e) + 2 for e in self.edges] + [len(x) + 1 for x in self.levels]

    def plain(self, df: DataFrame) -> DataFrame:
        """Adds numbers as ``__x0, ...`` and places of categories as ``__c0, ...``."""
        out = {f"__x{i}": known_number(c, self.fills) for i, c in enumerate(self.numeric)}
        for j, c in enumerate(self.categorical):
            place = F.array_position(F.array(*map(F.lit, self.levels[j])).cast("array<string>"), F.col(f"`{c}`").cast("string"))
            out[f"__c{j}"] = F.when(place > 0, place - 1).otherwise(len(self.levels[j])).cast("int")
        return df.withColumns(out)

    def inputs(self) -> list[str]:
        return [*[f"__x{i}" for i in range(len(self.numeric))], *[f"__c{j}" for j in range(len(self.categorical))]]

    def codes(self, batch) -> list[np.ndarray]:
        """Codes of a batch of ``plain`` rows: a number's is how many edges lie below it."""
        a, out = arrays_of(batch, self.inputs()), []
        for i, edges in enumerate(self.edges):
            x = a[f"__x{i}"]
            out.append(np.where(np.isnan(x), len(edges) + 1, np.searchsorted(np.array(edges, float), x)).astype(np.int32))
        return out + [a[f"__c{j}"] for j in range(len(self.categorical))]

    def raw(self, codes: list[np.ndarray], start: int = 0) -> np.ndarray:
        """Sum of the trees from ``start`` on for rows given by their codes."""
        out = np.zeros(len(codes[0]))
        for tree in self.trees[start:]:
            out += np.array([n.value for n in tree])[leaves(tree, codes)]
        return out

    def probability(self, codes: list[np.ndarray]) -> np.ndarray:
        raw = self.raw(codes)
        return raw / len(self.trees) if self.votes else logistic(self.base + raw)

    def table(self, spark: SparkSession) -> np.ndarray | None:
        """The probability of each combination of codes, if they are few: rows look it up then and go through no tree."""
        sizes = self.sizes
        cells = math.prod(sizes)
        if not sizes or cells > FEW_CELLS:
            return None

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                at = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(self.probability([c.astype(np.int32) for c in np.unravel_index(at, sizes)]))], ["id", "p"])

        found = spark.range(cells).mapInArrow(run, "id long, p double").toArrow()
        out = np.empty(cells)
        out[found.column("id").to_numpy()] = found.column("p").to_numpy()
        return out

    def scored_cells(self, name: str = "p") -> DataFrame:
        """``__y, __n`` and the probability of each cell of the rows that the model was fitted with: a score is a function of the codes, so measures over
        rows need no pass over them."""
        codes = [f"__b{i}" for i in range(len(self.columns))]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                a = arrays_of(batch, codes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(self.probability([a[c] for c in codes]))], ["__y", "__n", name])

        return self.cells.select(F.col("__y").cast("int").alias("__y"), F.col("__n").cast("long").alias("__n"), *codes).mapInArrow(run, f"__y int, __n long, `{name}` double")

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Probability for every row, whatever is missing in it."""
        if missing := [c for c in self.columns if c not in df.columns]:
            raise ValueError(f"features are missing: {missing}")
        inputs, sizes, table = self.inputs(), self.sizes, self.table(df.sparkSession)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                codes = self.codes(batch)
                p = self.probability(codes) if table is None else table[np.ravel_multi_index(codes, sizes)]
                keep = [i for i, n in enumerate(batch.schema.names) if n not in inputs]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(p)], [*[batch.schema.names[i] for i in keep], name])

        return self.plain(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def known_number(c: str, fills: Mapping[str, float]) -> Column:
    """A column as a double without NaN; what is missing has its value of ``fills``, if there is one."""
    x = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    return F.coalesce(x, F.lit(float(fills[c]))) if c in fills else x


def leaves(tree: list[Node], codes: list[np.ndarray]) -> np.ndarray:
    """The node that each row ends in. Children come after their parent."""
    at = np.zeros(len(codes[0]), np.int32)
    for i, node in enumerate(tree):
        if node.children is not None:
            here = np.flatnonzero(at == i)
            at[here] = np.where(node.split.left[codes[node.split.column][here]], *node.children)
    return at


def best_split(hist: list[np.ndarray], numeric: int, l2: float, least_rows: int, among: Sequence[int] | None = None) -> Split | None:
    """The split of a leaf with the largest gain; of equal ones that of the first column and the first cut. ``hist``: for each column a row for each
    code, with gradient, Hessian and count; ``among``: the columns that are tried."""
    best = None
    for c in range(len(hist)) if among is None else sorted(among):
        h = hist[c]
        whole = h.sum(axis=0)
        missing, seen = h[-1], h[:-1]
        if c < numeric:
            order = np.arange(len(seen))
            tries = (False, True) if missing[2] else (False,)
        else:  # categories in the order of their mean gradient; missing is one of them
            order = np.array([k for k in range(len(h)) if h[k, 2]], int)
            order = order[np.argsort(h[order, 0] / (h[order, 1] + CATEGORY_SMOOTHING), kind="stable")]
            seen, tries = h, (False,)
        for missing_left in tries:
            run = np.cumsum(seen[order], axis=0)
            left = run + missing if missing_left else run
            if not (c < numeric and missing[2] and not missing_left):
                left = left[:-1]  # the last cut has nothing on its right
            if not len(left):
                continue
            right = whole - left
            fine = (left[:, 2] >= least_rows) & (right[:, 2] >= least_rows) & (left[:, 1] >= LEAST_HESSIAN) & (right[:, 1] >= LEAST_HESSIAN)
            if not fine.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):  # of sides that aren't fine
                gain = np.where(fine, left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (right[:, 1] + l2) - whole[0] ** 2 / (whole[1] + l2), -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > 1e-12 and (best is None or gain[at] > best.gain * (1 + 1e-12)):
                flags = np.zeros(len(h), bool)
                flags[order[: at + 1]] = True
                if missing_left:
                    flags[-1] = True
                best = Split(c, flags, float(gain[at]), (left[at], right[at]))
    return best


def histograms(rows: DataFrame, model: Trees, tree: list[Node], wanted: Sequence[int], label: str, weight: str | None, summed: int = 0) -> tuple[dict[int, list[np.ndarray]], float, float]:
    """Histograms of the wanted leaves of a growing tree over the training rows (in blocks); loss and weight of the rows that are left out. ``__raw`` of the rows holds
    the first score and the sum of the first ``summed`` trees, ``__n`` how many rows they stand for, and the weight is that of all of them.

    A fit has hundreds of short scans, so they run as jobs on the table's RDD: its plan is made once, and tasks get only the trees that rows lack."""
    sizes = model.sizes
    ends = np.cumsum([3 * s for s in sizes])
    length = int(ends[-1])
    slot = np.full(len(tree), -1)
    slot[list(wanted)] = np.arange(len(wanted))
    codes = [f"__b{i}" for i in range(len(sizes))]
    fields = [*codes, label, "__held", "__raw", "__n", *([weight] if weight else [])]
    root, wanted = list(wanted) == [0], list(wanted)
    recent = Trees([], [], [], [], 0.0, model.trees[summed:])

    def run(part):
        total = np.zeros(len(wanted) * length + 2)
        found = [np.zeros((3, len(wanted) * s)) for s in sizes]
        for batch in unpacked_values(x[0] for x in part):
            a = arrays_of(batch, fields)
            b = [a[c] for c in codes]
            y, n = a[label].astype(float), a["__n"].astype(float)
            w = a[weight] if weight else n
            p = logistic(a["__raw"] + recent.raw(b))
            held = a["__held"] == 1
            if root and held.any():
                q = np.clip(p[held], 1e-15, 1 - 1e-15)
                total[-2] += -(w[held] * (y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q))).sum()
                total[-1] += w[held].sum()
            at = slot[leaves(tree, b)]
            on = np.flatnonzero((at >= 0) & ~held)
            at, p, y, w, n = at[on], p[on], y[on], w[on], n[on]
            values = (w * (p - y), w * p * (1 - p), n)
            for j, s in enumerate(sizes):
                place = at * s + b[j][on]
                for k, v in enumerate(values):
                    found[j][k] += np.bincount(place, v, len(wanted) * s)
        for j, s in enumerate(sizes):
            for i in range(len(wanted)):
                begin = i * length + int(ends[j]) - 3 * s
                total[begin : begin + 3 * s] = found[j][:, i * s : (i + 1) * s].T.ravel()
        yield total

    parts = rows.rdd.mapPartitions(run)
    total = parts.treeReduce(np.add) if parts.getNumPartitions() > MOST_PARTS else sum(parts.collect(), np.zeros(len(wanted) * length + 2))
    out = {}
    for i, node in enumerate(wanted):
        flat = total[i * length : (i + 1) * length]
        out[node] = [flat[int(e) - 3 * s : int(e)].reshape(s, 3) for s, e in zip(sizes, ends, strict=True)]
    return out, float(total[-2]), float(total[-1])


def chosen(tree: list[Node], most_leaves: int) -> tuple[set[int], list[int], int | None]:
    """Which nodes are split if the largest gain goes first, as far as gains are known, the leaves whose children aren't known though they
    would be split next, and the node whose split fills the tree."""
    split: set[int] = set()
    open_, unknown, top = [0], [], None
    while len(split) + 1 < most_leaves:
        able = [i for i in open_ if tree[i].split is not None]
        if not able:
            break
        top = max(able, key=lambda i: (tree[i].split.gain, -i))
        open_.remove(top)
        split.add(top)
        if tree[top].children is None:
            unknown.append(top)
        else:
            open_ += tree[top].children
    return split, unknown, top if len(split) + 1 == most_leaves else None


def with_children(tree: list[Node], i: int) -> tuple[int, int]:
    """Adds the two sides of a node's split, with their sums."""
    tree[i].children = (len(tree), len(tree) + 1)
    tree += [Node(float(g), float(h), int(n), depth=tree[i].depth + 1) for g, h, n in tree[i].split.sides]
    return tree[i].children


def grown(rows: DataFrame, model: Trees, label: str, weight: str | None, rate: float, most_leaves: int, least_rows: int, l2: float, summed: int, depth: int | None = None) -> tuple[list[Node], float, float]:
    """One tree, best gain first; also loss and weight of the held-out rows before it. Leaves that can't be split further aren't scanned: their sums are those
    of a side of their parent's split."""

    def find(i, hist):
        g, h, n = hist[0].sum(axis=0)
        tree[i].gradient, tree[i].hessian, tree[i].n = float(g), float(h), int(n)
        tree[i].split = best_split(hist, len(model.numeric), l2, least_rows)

    tree = [Node(0.0, 0.0, 0)]
    hist, loss, held = histograms(rows, model, tree, [0], label, weight, summed)
    find(0, hist[0])
    while True:
        split, unknown, last = chosen(tree, most_leaves)
        if not unknown:
            break
        wanted = []
        for i in unknown:
            if i == last and len(unknown) > 1:
                continue  # what is found about the others may put another in its place
            both = with_children(tree, i)
            if i != last and (depth is None or tree[i].depth + 1 < depth):
                wanted += both
        if wanted:
            found, _, _ = histograms(rows, model, tree, wanted, label, weight, summed)
            for i in wanted:
                find(i, found[i])
    # splits that were looked at but lost are undone; nodes keep their order and get new places
    keep, out = [0], []
    for i in keep:
        if i in split:
            keep += tree[i].children
    places = {i: k for k, i in enumerate(keep)}
    for i in keep:
        x = tree[i]
        out.append(Node(x.gradient, x.hessian, x.n, x.split if i in split else None, tuple(places[c] for c in x.children) if i in split else None, -rate * x.gradient / (x.hessian + l2) if i not in split else 0.0, x.depth))
    return out, loss, held


def with_sums(rows: DataFrame, model: Trees, summed: int) -> DataFrame:
    """Adds the trees from ``summed`` on to ``__raw``."""
    codes = [f"__b{i}" for i in range(len(model.columns))]

    def added(batches):
        import pyarrow as pa

        for batch in unpacked(batches):
            a = arrays_of(batch, [*codes, "__raw"])
            raw = pa.array(a["__raw"] + model.raw([a[c] for c in codes], summed))
            yield batch.set_column(batch.schema.get_field_index("__raw"), "__raw", raw)

    return rows.mapInArrow(lambda batches: packed(added(batches)), rows.schema)


def coded(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, key: str | None = None, weight: str | None = None, bins: int = 255, held_out: float = 0.0, seed: int = 42, fills: Mapping[str, float] | None = None) -> Trees:
    """A model without trees, with its cells: how many rows have a label, weight and codes, ``__y, __held, __w, __b0, ..., __n``. Rows without a label are left
    out; those that are held out, a fixed share of each class by hash of ``key``, have no say in the edges. Several models may start from it."""
    known = df.where(F.col(f"`{label}`").isNotNull()).withColumn("__y", F.col(f"`{label}`").cast("double"))
    # the same rows in every run
    held = (F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(seed)), F.lit(1_000_000)) < int(held_out * 1_000_000)).cast("int") if held_out else F.lit(0)
    known, fills = known.withColumn("__held", held), dict(fills or {})
    levels = [[] for _ in categorical]
    if categorical:
        for variable, value in unpivoted(known, categorical).where("value is not null").distinct().collect():  # few
            levels[list(categorical).index(variable)].append(value)
    edges = cut_points(known.where("__held = 0").select(*[known_number(c, fills).alias(c) for c in numeric]), numeric, bins) if numeric else {}
    model = Trees(list(numeric), list(categorical), [edges[c] for c in numeric], [sorted(x) for x in levels], 0.0, fills=fills)
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    plain = model.plain(known).select(w.alias("__w"), "__y", "__held", *model.inputs())

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            got = model.codes(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, got)], ["__w", "__y", "__held", *[f"__b{i}" for i in range(len(got))]])

    codes = [f"__b{i}" for i in range(len(model.columns))]
    rows = plain.mapInArrow(code, "__w double, __y double, __held int" + "".join(f", {c} int" for c in codes))
    cells = staged(rows.groupBy("__y", "__held", "__w", *codes).agg(F.count("*").alias("__n")), "cells")
    return replace(model, cells=cells)


def spread(rows: DataFrame) -> DataFrame:
    """A table of few rows that many scans read, in at least as many parts as tasks run at a time."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def fit_boosting(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, key: str | None, weight: str | None = None, iterations: int = 100, rate: float = 0.1, most_leaves: int = 15, least_rows: int = 100, l2: float = 1.0, bins: int = 255, held_out: float = 0.1, patience: int = 10, seed: int = 42, depth: int | None = None, fills: Mapping[str, float] | None = None, start: Trees | None = None) -> Trees:
    """Trees until the held-out loss hasn't fallen for ``patience`` of them, or ``iterations``; trees after the best one are dropped.

    ``held_out`` of 0 turns early stopping off, and no ``key`` is needed then. Rows without a label are no training rows; missing features are values of
    their own, or those of ``fills``. ``depth`` bounds the splits above a leaf. ``start``: what ``coded`` gives for the same rows and settings.
    """
    model = replace(start or coded(df, numeric, categorical, label, key, weight, bins, held_out, seed, fills), trees=[], losses=[])
    codes = [f"__b{i}" for i in range(len(model.columns))]
    rows = staged(model.cells.groupBy("__y", "__held", *codes).agg(F.sum(F.col("__w") * F.col("__n")).alias("__w"), F.sum("__n").alias("__n")), "codes")
    total, positive = rows.where("__held = 0").agg(F.sum("__w"), F.sum(F.col("__w") * F.col("__y"))).first()
    if not total or not 0 < positive < total:
        raise ValueError("training rows need both classes")
    model.base = float(np.log(positive / (total - positive)))
    best, at, summed = np.inf, 0, 0
    rows = blocks(spread(rows).withColumn("__raw", F.lit(model.base)), "codes")
    for k in range(iterations + 1 if held_out else iterations):  # the last round finds the loss only
        if len(model.trees) - summed == RESTAGE:
            # rows take their sums along, so that a scan looks at few trees however many there are
            rows, summed = staged(with_sums(rows, model, summed), "codes"), len(model.trees)
        tree, loss, left_out = grown(rows, model, "__y", "__w", rate, most_leaves if k < iterations else 1, least_rows, l2, summed, depth)
        if left_out:
            model.losses.append(loss / left_out)
            if model.losses[-1] < best - 1e-7:
                best, at = model.losses[-1], k
            elif k - at >= patience:
                break
        if k == iterations or len(tree) == 1:
            break
        model.trees.append(tree)
    if model.losses:
        model.trees = model.trees[:at]
    return model
