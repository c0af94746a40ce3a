"""Dealings of columns as blocks of numbers, and the AUC of each from sorted ranges of scores.

Places lie in blocks. A task undoes the dealing for the places that it holds, so it knows where each value goes, and sends what a block gets
as one value; a block's task lays the values out, scores them and sends its distinct scores on by range. No step sees more than a block or a range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places of a block: they and their counts fit 16 bits.
BLOCK = 65_535
#: Rows times dealings that a task sends at a time, and rows of a range of scores.
SENT_CELLS, RANGE_ROWS = 1 << 23, 1 << 21
#: Rows whose scores set the ranges; results don't depend on them.
EDGE_ROWS = 20_000
#: Rounds of the keyed permutation.
ROUNDS = 4
#: Dealings that go through the exchanges at a time where the table is large, and rows times dealings up to which it isn't: what the exchanges hold on disk is a few
#: times the table's columns, however many dealings there are.
DEALS_AT_A_TIME, FEW_CELLS = 10, 1 << 27
#: What numbers are sent as when that loses nothing: a type, and what they are multiplied by.
KINDS = ((np.uint8, 1), (np.uint8, 100), (np.uint16, 1), (np.uint16, 100), (np.uint32, 1), (np.uint32, 100), (np.float32, 1), (np.float64, 1))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(values: np.ndarray, *ints: int) -> np.ndarray:
    """``xxhash64`` of a long and further ints, as Spark has it."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        x = values.astype(np.int64).view(np.uint64)
        h = mixed(_rotated((np.uint64(42 + 8) + p5) ^ (_rotated(x * p2, 31) * p1), 27) * p1 + p4)
        for i in ints:
            h = mixed(_rotated((h + p5 + np.uint64(4)) ^ (np.uint64(i & 0xFFFFFFFF) * p1), 23) * p2 + p3)
    return h.view(np.int64)


class Dealing:
    """The permutation that ``evaluate.dealt`` describes, for one int ``salt``, over arrays; hashes of a side of the grid are looked up."""

    def __init__(self, n: int, salt: int):
        self.n = n
        self.wide = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.high = max(1, -(-n // self.wide))
        self.tables = []
        for k in range(0, 2 * ROUNDS, 2):
            by_col = hashed(np.arange(self.wide), salt, k) % self.high
            by_row = hashed(np.arange(self.high), salt, k + 1) % self.wide
            self.tables.append((by_col.astype(np.int32), by_row.astype(np.int32)))

    def _turned(self, x: np.ndarray) -> np.ndarray:
        row, col = (a.astype(np.int32) for a in np.divmod(x, self.wide))
        for by_col, by_row in self.tables:
            row += by_col[col]
            row -= (row >= self.high) * np.int32(self.high)
            col += by_row[row]
            col -= (col >= self.wide) * np.int32(self.wide)
        return row.astype(np.int64) * self.wide + col

    def _turned_back(self, x: np.ndarray) -> np.ndarray:
        row, col = (a.astype(np.int32) for a in np.divmod(x, self.wide))
        for by_col, by_row in reversed(self.tables):
            col -= by_row[row]
            col += (col < 0) * np.int32(self.wide)
            row -= by_col[col]
            row += (row < 0) * np.int32(self.high)
        return row.astype(np.int64) * self.wide + col

    def _inside(self, x: np.ndarray, turn) -> np.ndarray:
        x = turn(x)
        out = np.flatnonzero(x >= self.n)
        for _ in range(40):
            if not len(out):
                return x
            x[out] = turn(x[out])
            out = out[x[out] >= self.n]
        if len(out):
            raise RuntimeError("a place wasn't dealt")
        return x

    def source(self, place: np.ndarray) -> np.ndarray:
        """Where a place's value is taken from."""
        return self._inside(place, self._turned)

    def target(self, place: np.ndarray) -> np.ndarray:
        """The place that takes a place's value."""
        return self._inside(place, self._turned_back)


def narrowed(x: np.ndarray) -> tuple[int, np.ndarray]:
    """The first of ``KINDS`` that holds every number exactly, and the numbers in it."""
    for kind, (of, scale) in enumerate(KINDS[:-1]):
        with np.errstate(over="ignore", invalid="ignore"):
            if np.issubdtype(of, np.integer):
                y = np.rint(x * scale)
                if not ((y >= 0) & (y <= np.iinfo(of).max)).all():
                    continue
            else:
                y = x
            y = y.astype(of)
        if np.array_equal(y.astype(np.float64) / scale, x, equal_nan=True):
            return kind, y
    return len(KINDS) - 1, x


def widened(kind: int, x) -> np.ndarray:
    of, scale = KINDS[kind]
    return np.frombuffer(x, of).astype(np.float64) / scale


def planes(p: np.ndarray) -> bytes:
    """Numbers in order as differences of their bits, first bytes first: those are nearly all zero, and the exchange's compression takes them."""
    return np.diff(p.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def of_planes(x) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64).view(np.float64)


@dataclass(frozen=True)
class ArrayScore:
    """A logistic model's probability over arrays of its columns, missing values filled, as the fitted model computes it."""

    fills: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def __call__(self, arrays: Sequence[np.ndarray]) -> np.ndarray:
        z = np.zeros(len(arrays[0]))
        for x, fill, b in zip(arrays, self.fills, self.coefficients, strict=True):
            z += np.where(np.isnan(x), fill, x) * b
        with np.errstate(over="ignore"):
            return 1.0 - 1.0 / (1.0 + np.exp(z + self.intercept))


def _sent(names: Sequence[str], label: str, place: str, n: int, some: Sequence[tuple[int, int]], size: int, cells: int):
    """Rows to pieces: ``block``, own columns of its places, what they are sent as, and for each dealing (column, salt) how many values come, their places and
    the values."""

    def run(batches):
        import pyarrow as pa

        from riskloom.operators.fits import arrays_of

        deals = [(c, Dealing(n, salt)) for c, salt in some]
        most = max(1, cells // max(1, len(deals)))

        def pieces(held):
            a = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            at, y = a[place].astype(np.int64), a[label].astype(np.uint8)
            kinds, values = zip(*[narrowed(a[c].astype(np.float64)) for c in names], strict=True)

            def cut(target):
                order = np.argsort(target)
                target = target[order]
                block = target // size
                return order, (target - block * size).astype(np.uint16), block

            parts: dict[int, tuple[list, list, list, list]] = {}
            order, offset, block = cut(at)
            ids, starts = np.unique(block, return_index=True)
            for b, i, j in zip(ids.tolist(), starts, [*starts[1:], len(block)], strict=True):
                mine = order[i:j]
                parts.setdefault(b, ([], [], [], []))[0].extend([offset[i:j].tobytes(), y[mine].tobytes(), *[v[mine].tobytes() for v in values]])
            for k, (c, deal) in enumerate(deals):
                order, offset, block = cut(deal.target(at))
                value = values[c][order]
                ids, starts = np.unique(block, return_index=True)
                for b, i, j in zip(ids.tolist(), starts, [*starts[1:], len(block)], strict=True):
                    _, counts, places, moved = parts.setdefault(b, ([], [], [], []))
                    counts.append((k, j - i, kinds[c]))
                    places.append(offset[i:j].tobytes())
                    moved.append(value[i:j].tobytes())
            blocks = list(parts)
            for i in range(0, len(blocks), 64):
                some = [parts.pop(b) for b in blocks[i : i + 64]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks[i : i + 64], pa.int32()), pa.array([b"".join(p[0]) for p in some], pa.binary()), pa.array([bytes(kinds)] * len(some), pa.binary()), pa.array([np.array(p[1], np.int32).tobytes() for p in some], pa.binary()), pa.array([b"".join(p[2]) for p in some], pa.binary()), pa.array([b"".join(p[3]) for p in some], pa.binary())],
                    ["block", "own", "kinds", "counts", "places", "moved"],
                )

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(arrays_of(batch.slice(at, most), [place, label, *names]))
                rows += len(held[-1][place])
                if rows >= most:
                    yield from pieces(held)
                    held, rows = [], 0
        if rows:
            yield from pieces(held)

    return run


def _scored(score, columns: int, n: int, of_deal: Sequence[int], edges: Sequence[np.ndarray], most: int, first: int):
    """A block's pieces to distinct scores with their labels' counts, by dealing and range; dealings are numbered from ``first``, and with 0 comes -1, the rows as
    they are."""

    def run(key, table):
        import pyarrow as pa

        size = min(most, n - key[0].as_py() * most)
        own, y = [np.full(size, np.nan) for _ in range(columns)], np.zeros(size, np.uint8)
        filled = 0
        for x, kinds in zip(table.column("own"), table.column("kinds"), strict=True):
            x, kinds = x.as_buffer(), kinds.as_py()
            widths = [np.dtype(KINDS[k][0]).itemsize for k in kinds]
            m, begin = x.size // (3 + sum(widths)), 0
            if not m:
                continue
            at = np.frombuffer(x, np.uint16, m)
            filled += m
            y[at] = np.frombuffer(x, np.uint8, m, 2 * m)
            begin = 3 * m
            for i, (kind, width) in enumerate(zip(kinds, widths, strict=True)):
                # values aren't aligned to their size here
                own[i][at] = widened(kind, np.frombuffer(x, np.uint8, width * m, begin).tobytes())
                begin += width * m
        dealt = np.full((len(of_deal), size), np.nan)
        got = np.zeros(len(of_deal), np.int64)
        for counts, places, moved in zip(table.column("counts"), table.column("places"), table.column("moved"), strict=True):
            counts = np.frombuffer(counts.as_buffer(), np.int32).reshape(-1, 3)
            places, moved = np.frombuffer(places.as_buffer(), np.uint16), moved.as_buffer()
            begin = taken = 0
            for k, m, kind in counts.tolist():
                width = m * np.dtype(KINDS[kind][0]).itemsize
                dealt[k, places[begin : begin + m]] = widened(kind, moved.slice(taken, width).to_pybytes())
                got[k] += m
                begin, taken = begin + m, taken + width
        if filled != size or (got != size).any():
            raise RuntimeError("a block lacks values")
        out = []
        for k in range(-1 if first == 0 else 0, len(of_deal)):
            arrays = list(own)
            if k >= 0:
                arrays[of_deal[k]] = dealt[k]
            p = score(arrays) + 0.0  # no negative zero
            order = np.argsort(p)
            p, ones = p[order], y[order]
            starts = np.flatnonzero(np.r_[True, ~((p[1:] == p[:-1]) | (np.isnan(p[1:]) & np.isnan(p[:-1])))])
            n1 = np.add.reduceat(ones, starts, dtype=np.int64)
            n0 = np.diff(np.r_[starts, size]) - n1
            p = p[starts]
            cuts = np.r_[0, np.searchsorted(p, edges[of_deal[k] if k >= 0 else columns]), len(p)]
            for b in np.flatnonzero(np.diff(cuts)):
                i, j = cuts[b], cuts[b + 1]
                out.append((first + k, int(b), planes(p[i:j]), n1[i:j].astype(np.uint16).tobytes(), n0[i:j].astype(np.uint16).tobytes()))
        k, b, p, n1, n0 = zip(*out, strict=True)
        return pa.table({"deal": pa.array(k, pa.int32()), "range": pa.array(b, pa.int32()), "scores": pa.array(p, pa.binary()), "n1": pa.array(n1, pa.binary()), "n0": pa.array(n0, pa.binary())})

    return run


def _counted(key, table):
    """Of a range: events, non-events, and twice the pairs in it whose event has the higher score (ties: one)."""
    import pyarrow as pa

    whole = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).view(kind) for x in table.column(c)])
    p = np.concatenate([of_planes(x.as_buffer()) for x in table.column("scores")])
    order = np.argsort(p)
    p, n1, n0 = p[order], whole("n1", np.uint16)[order].astype(np.int64), whole("n0", np.uint16)[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, ~((p[1:] == p[:-1]) | (np.isnan(p[1:]) & np.isnan(p[:-1])))])
    n1, n0 = np.add.reduceat(n1, starts), np.add.reduceat(n0, starts)
    twice = int((n1 * (2 * (np.cumsum(n0) - n0) + n0)).sum())
    return pa.table({"deal": pa.array([key[0].as_py()], pa.int32()), "range": pa.array([key[1].as_py()], pa.int32()), "pos": [int(n1.sum())], "neg": [int(n0.sum())], "twice": [twice]})


def dealt_aucs(ranked: DataFrame, n: int, place: str, columns: Sequence[str], label: str, salts: Sequence[Sequence[int]], score) -> DataFrame:
    """``deal, auc``: exact AUC of the rows as they are (-1) and with each column dealt by each of its salts, numbered in their order.

    ``place`` numbers the rows from 0. Ranges of scores are cut by the scores of a few rows, which only spreads the work evenly.
    """
    numbers: list[Column] = [F.col(f"`{c}`").cast("double").alias(f"__v{i}") for i, c in enumerate(columns)]
    names = [f"__v{i}" for i in range(len(columns))]
    rows = ranked.select(F.col(place).cast("long").alias("__at"), F.col(f"`{label}`").cast("int").alias("__y"), *numbers)
    few = rows.where(F.pmod(F.xxhash64("__at"), F.lit(max(1, n // EDGE_ROWS))) == 0).limit(4 * EDGE_ROWS).toArrow()
    some = [few.column(c).to_numpy().astype(float) for c in names]
    share = np.arange(1, -(-n // RANGE_ROWS)) / -(-n // RANGE_ROWS)
    edges = []
    for c in range(len(columns) + 1):
        arrays = list(some)
        if c < len(columns) and len(some[c]):
            arrays[c] = np.random.default_rng(c).permutation(some[c])
        p = score(arrays) if len(some[0]) else np.zeros(1)
        edges.append(np.unique(np.quantile(p[~np.isnan(p)], share)) if len(share) and not np.isnan(p).all() else np.zeros(0))
    deals = [(c, salt) for c, of in enumerate(salts) for salt in of]
    step = max(DEALS_AT_A_TIME, FEW_CELLS // max(1, n))
    found = []
    with cleaned_exchanges(ranked.sparkSession):
        for first in range(0, max(1, len(deals)), step):
            some = deals[first : first + step]
            pieces = rows.mapInArrow(_sent(names, "__y", "__at", n, some, BLOCK, SENT_CELLS), "block int, own binary, kinds binary, counts binary, places binary, moved binary")
            scores = pieces.groupBy("block").applyInArrow(_scored(score, len(columns), n, [c for c, _ in some], edges, BLOCK, first), "deal int, range int, scores binary, n1 binary, n0 binary")
            ranges = scores.groupBy("deal", "range").applyInArrow(_counted, "deal int, range int, pos long, neg long, twice long")
            below = F.coalesce(F.sum("neg").over(Window.partitionBy("deal").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            # a row for each dealing and range
            pairs = ranges.select("deal", "pos", "neg", (F.col("twice") / 2.0 + F.col("pos").cast("double") * below).alias("pairs"))
            auc = (F.sum("pairs") / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc")
            found += pairs.groupBy("deal").agg(auc, F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0 and neg > 0").select("deal", "auc").collect()  # a row a dealing
    return ranked.sparkSession.createDataFrame(found, "deal int, auc double")


@contextmanager
def cleaned_exchanges(spark: SparkSession):
    """Queries inside give the disk of their exchanges back when they end, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
