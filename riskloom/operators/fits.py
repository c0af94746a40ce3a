"""Many logistic fits from few scans: fits of folds, arms, years and replicates take their Newton steps together.

A scan lets each task add up gradient and information matrix of every fit over its rows; Spark sums these by place, and the driver, which gets a few
hundred numbers a fit, solves for the steps. Preparation (missing values, scales, modes) belongs to the fit: it comes from the rows that
the fit is made on and from no others, by statistics of disjoint groups of rows that are combined for each fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.audit import unpivoted
from riskloom.operators.ordered import prefix_sums, value_counts, with_totals
from riskloom.sources.staging import staged

#: Rows of a task's arrays that are worked on at a time.
SLICE = 8192
TOLERANCE, MOST_STEPS = 1e-9, 60


@dataclass(frozen=True)
class Model:
    """A fit of ``target`` on the rows whose group is among ``members``, on all columns or on those of ``variables``."""

    members: frozenset[int]
    target: str
    variables: frozenset[str] | None = None


@dataclass
class Preparation:
    """What a fit learns about its columns: for numbers the value for missing ones, mean and spread; for categories the mode's place."""

    fill: list[float]
    mean: list[float]
    spread: list[float]
    mode: list[int]


@dataclass
class Encoded:
    """Rows with numbers as ``__x0, ...`` and categories as places in ``levels`` as ``__c0, ...``; ``__g`` is the group."""

    rows: DataFrame
    numeric: list[str]
    categorical: list[str]
    levels: list[list[str]]
    drop_first: bool = False

    @property
    def names(self) -> list[str]:
        out = ["(intercept)"]
        for c in self.numeric:
            out += [f"{c}_z", f"{c}_missing"]
        for c, levels in zip(self.categorical, self.levels, strict=True):
            out += [f"{c}={x}" for x in levels[int(self.drop_first) :]]
        return out

    @property
    def variables(self) -> list[str]:
        out = [""]
        for c in self.numeric:
            out += [c, c]
        for c, levels in zip(self.categorical, self.levels, strict=True):
            out += [c] * (len(levels) - int(self.drop_first))
        return out

    def columns(self) -> list[str]:
        return [*[f"__x{i}" for i in range(len(self.numeric))], *[f"__c{i}" for i in range(len(self.categorical))]]

    def matrix(self, arrays: dict[str, np.ndarray], prep: Preparation) -> np.ndarray:
        """Design matrix of some rows under a fit's preparation."""
        n = len(next(iter(arrays.values())))
        out = np.empty((n, len(self.names)), order="F")
        out[:, 0], at = 1.0, 1
        for i in range(len(self.numeric)):
            x = arrays[f"__x{i}"]
            missing = np.isnan(x)
            out[:, at] = (np.where(missing, prep.fill[i], x) - prep.mean[i]) / prep.spread[i]
            out[:, at + 1] = missing
            at += 2
        for j, levels in enumerate(self.levels):
            code = arrays[f"__c{j}"]
            code = np.where(code < 0, prep.mode[j], code)
            for k in range(int(self.drop_first), len(levels)):
                out[:, at] = code == k
                at += 1
        return out


def encoded(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], drop_first: bool = False) -> Encoded:
    """Adds the coded columns. A category's levels are few and go to the driver; NaN counts as missing."""
    levels = [[] for _ in categorical]
    if categorical:
        for variable, value in unpivoted(df, categorical).where("value is not null").distinct().collect():
            levels[list(categorical).index(variable)].append(value)
    levels = [sorted(x) for x in levels]
    added = {f"__x{i}": F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for i, c in enumerate(numeric)}
    for j, c in enumerate(categorical):
        place = F.array_position(F.array(*[F.lit(x) for x in levels[j]]).cast("array<string>"), F.col(f"`{c}`").cast("string")) - 1
        added[f"__c{j}"] = F.coalesce(place, F.lit(-1)).cast("int")
    return Encoded(df.withColumns(added) if added else df, list(numeric), list(categorical), levels, drop_first)


def merged_moments(parts: Iterable[tuple[float, float, float]]) -> tuple[float, float, float]:
    """Count, mean and sum of squared deviations of disjoint samples taken together."""
    n = mean = squares = 0.0
    for k, m, s in parts:
        if k:
            d = m - mean
            squares += s + d * d * n * k / (n + k)
            mean += d * k / (n + k)
            n += k
    return n, mean, squares


def medians(rows: DataFrame, numeric: Sequence[str], members: Sequence[frozenset[int]]) -> list[dict[str, float]]:
    """Exact median of each column over each union of groups, from one pass over counts per value: a value has a count for each union, and
    running sums of all of them find the middle rows."""
    if not numeric:
        return [{} for _ in members]
    counts = rows.select("__g", *[F.col(f"__x{i}").alias(c) for i, c in enumerate(numeric)])
    per = value_counts(counts, ["__g"], numeric).where("value is not null")
    sums = [f"k{m}" for m in range(len(members))]
    wide = per.groupBy("variable", "value").agg(*[F.sum(F.when(F.col("__g").isin(*sorted(of)), F.col("n")).otherwise(0)).alias(s) for s, of in zip(sums, members, strict=True)])
    run = with_totals(prefix_sums(wide, ["variable"], ["value"], sums), ["variable"], {f"all_{s}": F.sum(s) for s in sums})

    def at(s: str, place: Column) -> Column:
        return F.max(F.when((F.col(f"{s}_before") <= place) & (place < F.col(f"{s}_before") + F.col(s)), F.col("value")))

    found = run.groupBy("variable").agg(*[((at(s, F.floor((F.col(f"all_{s}") - 1) / 2)) + at(s, F.ceil((F.col(f"all_{s}") - 1) / 2))) / 2).alias(s) for s in sums]).collect()
    return [{x["variable"]: x[s] for x in found} for s in sums]


def preparations(data: Encoded, members: Sequence[frozenset[int]]) -> list[Preparation]:
    """Preparation for each union of groups, from statistics of single groups: a row for each group and column on the driver."""
    rows, moments = data.rows, {}
    if data.numeric:
        fields = [f(f"__x{i}").alias(f"{n}{i}") for i in range(len(data.numeric)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
        moments = {x["__g"]: x for x in rows.groupBy("__g").agg(F.count("*").alias("all"), *fields).collect()}
    # medians stand for missing values: where no row lacks a number, nothing depends on them
    gaps = any(x[f"n{i}"] < x["all"] for x in moments.values() for i in range(len(data.numeric)))
    middle = medians(rows, data.numeric, members) if gaps else [{} for _ in members]
    levels: dict[int, dict[tuple[int, int], int]] = {}
    if data.categorical:
        codes = rows.select("__g", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"__c{j}").alias("c")) for j in range(len(data.categorical))])))
        for g, j, c, n in codes.where("c >= 0").groupBy("__g", "j", "c").agg(F.count("*")).collect():
            levels.setdefault(g, {})[j, c] = n
    out = []
    for of, med in zip(members, middle, strict=True):
        prep = Preparation([], [], [], [])
        for i, c in enumerate(data.numeric):
            fill = med.get(c)
            fill = 0.0 if fill is None else float(fill)
            own = [moments[g] for g in of if g in moments]
            n, mean, squares = merged_moments([*[(x[f"n{i}"], x[f"m{i}"], (x[f"v{i}"] or 0.0) * x[f"n{i}"]) for x in own], (sum(x["all"] - x[f"n{i}"] for x in own), fill, 0.0)])
            prep.fill.append(fill)
            prep.mean.append(mean)
            prep.spread.append((squares / n) ** 0.5 or 1.0 if n else 1.0)
        for j in range(len(data.categorical)):
            total: dict[int, int] = {}
            for g in of:
                for (k, c), n in levels.get(g, {}).items():
                    if k == j:
                        total[c] = total.get(c, 0) + n
            prep.mode.append(min(total, key=lambda c: (-total[c], c)) if total else 0)
        out.append(prep)
    return out


@dataclass
class Fits:
    """Coefficients of each fit, and how it ended."""

    beta: np.ndarray
    converged: np.ndarray
    steps: np.ndarray
    failure: list[str | None] = field(default_factory=list)
    #: Information and gradient at a fit's last step, by its place.
    information: dict[int, np.ndarray] = field(default_factory=dict)
    gradient: dict[int, np.ndarray] = field(default_factory=dict)


def arrays_of(batch, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of an Arrow batch; missing numbers are NaN."""
    import pyarrow as pa

    out = {}
    for c in columns:
        x = batch.column(batch.schema.get_field_index(c))
        out[c] = x.to_numpy(zero_copy_only=False) if not pa.types.is_floating(x.type) else x.fill_null(float("nan")).to_numpy()
    return out


def packed(batches):
    """Each Arrow batch as one value: a compressed stream of its own."""
    import pyarrow as pa

    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def unpacked_values(values):
    """The batches of single values that ``packed`` has made."""
    import pyarrow as pa

    for value in values:
        yield from pa.ipc.open_stream(pa.py_buffer(value))


def unpacked(batches):
    """The batches that ``packed`` has made values of."""
    for batch in batches:
        yield from unpacked_values(block.as_buffer() for block in batch.column(0))


def blocks(df: DataFrame, label: str = "blocks") -> DataFrame:
    """A written table of Arrow batches of ``df``. Scans that read the same rows many times get a few thousand rows as one value, where turning each
    row into Arrow's columns anew would take most of their time."""
    return staged(df.mapInArrow(packed, "block binary"), label)


def newton(rows: DataFrame, columns: Sequence[str], sums: Callable, models: int, width: int, ridge: np.ndarray, used: np.ndarray | None = None, start: np.ndarray | None = None) -> Fits:
    """Newton steps of ``models`` fits until each has come to rest.

    ``sums(arrays, beta, active)`` yields (fit, information, gradient) of some rows. ``ridge`` and ``used`` have a row for each fit: the penalty of
    each coefficient, and which ones the fit has; ``start`` is where all begin. A fit whose matrix is singular, or that doesn't come to rest, is marked.
    """
    upper = np.triu_indices(width)
    size = len(upper[0]) + width
    fits = Fits(np.zeros((models, width)) + (0.0 if start is None else start), np.zeros(models, bool), np.zeros(models, int), [None] * models)
    used = np.ones((models, width), bool) if used is None else used
    rows = blocks(rows.select(*columns))
    for _ in range(MOST_STEPS):
        active = ~fits.converged & np.array([f is None for f in fits.failure], bool)
        if not active.any():
            break
        beta = fits.beta

        def run(batches, beta=beta, active=active):
            import pyarrow as pa

            total: dict[int, np.ndarray] = {}
            for batch in unpacked(batches):
                for at in range(0, batch.num_rows, SLICE):
                    for m, info, gradient in sums(arrays_of(batch.slice(at, SLICE), columns), beta, active):
                        flat = np.concatenate([info[upper], gradient])
                        total[m] = total[m] + flat if m in total else flat
            if total:
                models = np.fromiter(total, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(models, size)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(models))), pa.array(np.concatenate(list(total.values())))], ["model", "place", "value"])

        got = rows.mapInArrow(run, "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).toArrow()
        flat = np.zeros((models, size))
        flat[got["model"].to_numpy(), got["place"].to_numpy()] = got["value"].to_numpy()
        fresh = beta.copy()
        for m in np.flatnonzero(active):
            on = np.flatnonzero(used[m])
            info = np.zeros((width, width))
            info[upper] = flat[m, : len(upper[0])]
            info = info + np.triu(info, 1).T
            gradient = flat[m, len(upper[0]) :] - ridge[m] * beta[m]
            # a column without a value in these rows has no information, and its coefficient stays 0
            on = on[np.diag(info)[on] + ridge[m][on] > 0]
            if not len(on):
                fits.failure[m] = "no rows"
                continue
            try:
                step = np.linalg.solve(info[np.ix_(on, on)] + np.diag(ridge[m][on]), gradient[on])
            except np.linalg.LinAlgError:
                fits.failure[m] = "singular"
                continue
            if not np.isfinite(step).all() or np.abs(step).max() > 1e6:
                fits.failure[m] = "diverged"
                continue
            fresh[m, on] += step
            fits.steps[m] += 1
            fits.converged[m] = bool(np.abs(step).max() < TOLERANCE * max(1.0, np.abs(fresh[m]).max()))
            if fits.converged[m]:
                fits.information[m], fits.gradient[m] = info, gradient
        fits.beta = fresh
    for m in range(models):
        # a fit that separates its rows comes to "rest" where probabilities can't change any more
        if fits.failure[m] is None and np.abs(fits.beta[m]).max() > 30:
            fits.failure[m] = "separated"
        if fits.failure[m] is not None:
            fits.converged[m] = False
        elif not fits.converged[m]:
            fits.failure[m] = "no rest"
    return fits


def logistic(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.exp(-z)
    out += 1.0
    return np.reciprocal(out, out=out)


def fit_models(data: Encoded, models: Sequence[Model], penalty: float = 1.0, weight: str | None = None) -> tuple[Fits, list[Preparation]]:
    """All fits at once, each on its own rows, preparation and columns. ``penalty``: of each coefficient but the first (1 / C)."""
    unions = list(dict.fromkeys(m.members for m in models))
    preps = dict(zip(unions, preparations(data, unions), strict=True))
    width = len(data.names)
    ridge = np.full((len(models), width), float(penalty))
    ridge[:, 0] = 0.0
    used = np.array([[v == "" or m.variables is None or v in m.variables for v in data.variables] for m in models], bool).reshape(len(models), width)
    targets = sorted({m.target for m in models})
    columns = ["__g", *data.columns(), *targets, *([weight] if weight else [])]
    shape = Encoded(None, data.numeric, data.categorical, data.levels, data.drop_first)

    def sums(arrays, beta, active):
        for of in unions:
            mine = [i for i, m in enumerate(models) if m.members == of and active[i]]
            rows = np.isin(arrays["__g"], list(of)) if mine else None
            if rows is None or not rows.any():
                continue
            part = {c: x[rows] for c, x in arrays.items()}
            x = shape.matrix(part, preps[of])
            for i in mine:
                y = part[models[i].target].astype(float)
                known = ~np.isnan(y)
                p = logistic(x @ beta[i])
                w = np.where(known, part[weight] if weight else 1.0, 0.0)
                yield i, (x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * np.where(known, y - p, 0.0))

    return newton(data.rows, columns, sums, len(models), width, ridge, used), [preps[m.members] for m in models]


def score(data: Encoded, prep: Preparation, beta: np.ndarray) -> Column:
    """Probability of a fit as an expression over the coded columns."""
    z, at = F.lit(float(beta[0])), 1
    for i in range(len(data.numeric)):
        x = F.col(f"__x{i}")
        z = z + (F.coalesce(x, F.lit(prep.fill[i])) - prep.mean[i]) / prep.spread[i] * float(beta[at]) + F.when(x.isNull(), float(beta[at + 1])).otherwise(0.0)
        at += 2
    for j, levels in enumerate(data.levels):
        skipped = int(data.drop_first)
        values = [0.0] * min(skipped, len(levels)) + [float(b) for b in beta[at : at + len(levels) - skipped]]
        at += len(levels) - skipped
        if values:
            place = F.when(F.col(f"__c{j}") < 0, prep.mode[j]).otherwise(F.col(f"__c{j}"))
            z = z + F.element_at(F.array(*map(F.lit, values)), place + 1)
    return 1.0 / (1.0 + F.exp(-z))


def score_by_group(data: Encoded, fits: Fits, preps: Sequence[Preparation], model_of: dict[int, int]) -> Column:
    """The probability of the fit that ``model_of`` names for a row's group; null for a fit that failed and for other groups.

    One formula takes its numbers from arrays by group: one for each group would be a method too long for the JVM to compile.
    """
    groups = [g for g, m in model_of.items() if fits.failure[m] is None]
    if not groups:
        return F.lit(None).cast("double")
    place = F.array_position(F.array(*map(F.lit, groups)), F.col("__g").cast("int")) - 1

    def own(value: Callable, at: Column = place) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for g in groups for v in np.atleast_1d(value(model_of[g]))]), at.cast("int"))

    z, at = own(lambda m: fits.beta[m][0]), 1
    for i in range(len(data.numeric)):
        x = F.col(f"__x{i}")
        z = z + (F.coalesce(x, own(lambda m, i=i: preps[m].fill[i])) - own(lambda m, i=i: preps[m].mean[i])) / own(lambda m, i=i: preps[m].spread[i]) * own(lambda m, at=at: fits.beta[m][at]) + F.when(x.isNull(), own(lambda m, at=at: fits.beta[m][at + 1])).otherwise(0.0)
        at += 2
    for j, levels in enumerate(data.levels):
        skipped = min(int(data.drop_first), len(levels))
        if levels:
            mode = own(lambda m, j=j: preps[m].mode[j])
            code = F.when(F.col(f"__c{j}") < 0, mode).otherwise(F.col(f"__c{j}"))
            values = lambda m, at=at, k=len(levels), skipped=skipped: np.concatenate([np.zeros(skipped), fits.beta[m][at : at + k - skipped]])
            # -1 is outside: groups without a fit have no value
            z = z + own(values, F.when(place >= 0, place * len(levels) + code).otherwise(-1))
        at += len(levels) - skipped
    return 1.0 / (1.0 + F.exp(-z))
