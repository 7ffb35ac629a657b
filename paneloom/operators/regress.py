"""Regression over the panel from sufficient statistics.

Spark reduces the rows to cross-product matrices per source; the solves run on
those p x p results, one source per task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paneloom.functions import tails
from paneloom.functions.scalars import stars
from paneloom.operators.pairing import attach_single
from paneloom.session import materialise

def centre(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_centered: minus the grand mean."""
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    out = attach_single(df, means).withColumns({f"{c}_centered": F.col(c) - F.col(f"_mean_{c}") for c in columns})
    return out.drop(*[f"_mean_{c}" for c in columns])


def binary_by_label(value: Column, label: str, other: str = "Other") -> Column:
    """Keep one label, call everything else Other; nulls stay null."""
    return F.when(value.isNull(), None).when(value == label, value).otherwise(other)


def dominance(df: DataFrame, columns: list[str], share: float = 0.80) -> DataFrame:
    """Adds <column>_grouped: 0 for the modal level, 1 for others; null where no level dominates."""
    parts = []
    for c in columns:
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(
            F.max_by(c, F.struct("n", c)).alias("modal"), (F.max("n") / F.sum("n")).alias("share"))
        parts.append((c, top))
    out = df
    for c, top in parts:
        one = top.select(F.when(F.col("share") >= share, F.col("modal")).alias("_modal"))
        out = attach_single(out, one).withColumn(
            f"{c}_grouped", F.when(F.col("_modal").isNotNull(), (F.col(c) != F.col("_modal")).cast("int"))).drop("_modal")
    return out


def pool_rare(df: DataFrame, column: str, least: int = 5, other: str = "Other") -> DataFrame:
    """Levels with fewer rows than `least` become one level.

    Levels are counted with map-side combine and joined back: a window by level
    would bring a frequent level into one task.
    """
    rare = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") < least)
    return df.join(rare, column, "left").withColumn(
        column, F.when(F.col("_n").isNotNull(), other).otherwise(F.col(column))).drop("_n")


def levels_of(df: DataFrame, column: str, reference: str | None = None) -> list[str]:
    """Distinct levels, the reference first; each but that becomes a column of the model."""
    rows = df.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct().collect()
    found = sorted(r.v for r in rows)
    return ([reference] if reference in found else []) + [v for v in found if v != reference]


def dummies(df: DataFrame, column: str, levels: list[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every level but the first."""
    names = {f"C({column})[T.{v}]": (F.col(column).cast("string") == v).cast("double") for v in levels[1:]}
    return df.withColumns(names), list(names)


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Predictors that are not constant."""
    row = df.agg(*[(F.min(f"`{c}`") < F.max(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(columns)]).collect()[0]
    return [c for i, c in enumerate(columns) if row[i]]


def cross_products(df: DataFrame, group: list[str], columns: list[str], at_once: int = 300) -> DataFrame:
    """(group, i, j, value): sums of products of columns i <= j.

    Every sum is a column of one aggregation with map-side combine; designs with
    very many columns take their sums in blocks of `at_once`.
    """
    value = [F.col(f"`{c}`").cast("double") for c in columns]
    upper = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    out = None
    for low in range(0, len(upper), at_once):
        block = upper[low:low + at_once]
        sums = df.groupBy(*group).agg(*[F.sum(value[i] * value[j]).alias(f"_{i}_{j}") for i, j in block])
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}_{j}").alias("value"))
                                    for i, j in block]))
        part = sums.select(*group, cells.alias("x")).select(*group, "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def _square(part: pd.DataFrame, width: int) -> np.ndarray:
    m = np.zeros((width, width))
    i, j = part["i"].to_numpy(), part["j"].to_numpy()
    m[i, j] = part["value"].to_numpy()
    m[j, i] = part["value"].to_numpy()
    return m


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


_FIT = "variable string, coefficient double, std_error double, z_value double, p_value double, n double, theta double"


def _table(names, beta, se, n, theta) -> pd.DataFrame:
    z = beta / se
    return pd.DataFrame({"variable": names, "coefficient": beta, "std_error": se, "z_value": z,
                         "p_value": [_two_sided(v) for v in z], "n": float(n), "theta": float(theta)})


def _tidy(fit: DataFrame, group: str) -> DataFrame:
    return fit.select(group, "variable", "coefficient", "std_error", "z_value", "p_value",
                      stars(F.col("p_value")).alias("significance"), F.col("n").cast("long").alias("n"), "theta")


def ols(df: DataFrame, group: str, predictors: list[str], y: str) -> DataFrame:
    """Least squares per group on complete cases; 'Intercept' is added.

    Collinear predictors get the minimum-norm solution, with the rank as parameter count.
    """
    use = _complete(df, predictors, y)
    names = ["Intercept", *predictors]
    sums = cross_products(use.withColumn("Intercept", F.lit(1.0)), [group], [*names, y])
    width = len(names)

    def solve(key, part):
        g = _square(part, width + 1)
        xx, xy, yy, n = g[:width, :width], g[:width, width], g[width, width], g[0, 0]
        inverse = np.linalg.pinv(xx, hermitian=True)
        beta = inverse @ xy
        sigma2 = max(yy - beta @ xy, 0.0) / (n - np.linalg.matrix_rank(xx, hermitian=True))
        out = _table(names, beta, np.sqrt(np.diag(inverse) * sigma2), n, 0.0)
        out.insert(0, group, key[0])
        return out

    kind = df.schema[group].dataType.simpleString()
    return _tidy(sums.groupBy(group).applyInPandas(solve, f"{group} {kind}, {_FIT}"), group)


def _complete(df: DataFrame, predictors: list[str], y: str) -> DataFrame:
    keep = F.col(y).isNotNull()
    for c in predictors:
        keep = keep & F.col(f"`{c}`").isNotNull()
    return df.where(keep)


class SizeClasses:
    """What a random-intercept fit needs of the rows: sums by subject size, kept as a table.

    With theta the variance ratio, the weighted cross products of a subject of m
    rows are those of its rows minus theta / (1 + theta m) times the outer
    product of its sums. Outer products are added up per m. For any theta, one
    aggregation over the classes gives the weighted matrices of every group and
    their two derivatives, p x p numbers each; the classes never meet in one task.
    """

    def __init__(self, df: DataFrame, group: str, subject: str, predictors: list[str], y: str):
        self.group, self.names = group, ["Intercept", *predictors]
        columns = [*self.names, y]
        use = _complete(df, predictors, y).withColumn("Intercept", F.lit(1.0))
        sums = use.groupBy(group, subject).agg(
            F.count("*").alias("m"), *[F.sum(f"`{c}`").alias(c) for c in columns])
        self.sizes = materialise(sums.groupBy(group, "m").agg(F.count("*").alias("k")), "sizes")
        self.outer = materialise(cross_products(sums, [group, "m"], columns), "outer")
        self.width = len(columns)
        self.base: dict = {}
        for r in cross_products(use, [group], columns).collect():  # p x p numbers per group
            matrix = self.base.setdefault(r[group], np.zeros((self.width, self.width)))
            matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["value"]

    def at(self, points: list[tuple]) -> dict:
        """(group, theta): (three weighted matrices, three sums of size terms), for a few points per group."""
        spark = self.outer.sparkSession
        kind = self.outer.schema[self.group].dataType.simpleString()
        # A few values of theta per group, made here.
        asked = F.broadcast(spark.createDataFrame([(g, t) for g, t in points], f"{self.group} {kind}, theta double"))
        share = 1 / (1 + F.col("theta") * F.col("m"))
        weight = [F.col("theta") * share, share * share, -2 * F.col("m") * share * share * share]
        cells = self.outer.join(asked, self.group).groupBy(self.group, "theta", "i", "j").agg(
            *[F.sum(w * F.col("value")).alias(f"s{d}") for d, w in enumerate(weight)])
        k, m = F.col("k"), F.col("m")
        terms = self.sizes.join(asked, self.group).groupBy(self.group, "theta").agg(
            F.sum(k * F.log1p(F.col("theta") * m)).alias("s0"), F.sum(k * m * share).alias("s1"), F.sum(-k * m * m * share * share).alias("s2"))
        out: dict = {}
        for r in terms.collect():
            out[r[self.group], r["theta"]] = (np.zeros((3, self.width, self.width)), np.array([r["s0"], r["s1"], r["s2"]]))
        for r in cells.collect():  # p x p numbers per group and point
            matrices = out[r[self.group], r["theta"]][0]
            matrices[:, r["i"], r["j"]] = matrices[:, r["j"], r["i"]] = [r["s0"], r["s1"], r["s2"]]
        return out


def _profile(base: np.ndarray, weighted: np.ndarray, terms: np.ndarray):
    """REML deviance with its first two derivatives in theta, the coefficients, the variance, and the matrix behind their errors."""
    width, n = len(base) - 1, base[0, 0]
    g = [base - weighted[0], -weighted[1], -weighted[2]]
    (a, da, dda), (b, db, ddb), (c, dc, ddc) = ([x[:width, :width] for x in g], [x[:width, width] for x in g], [x[width, width] for x in g])
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rest = max(c - beta @ b, 1e-300)
    turn = db - da @ beta
    drest, ddrest = dc - 2 * beta @ db + beta @ da @ beta, ddc - 2 * beta @ ddb + beta @ dda @ beta - 2 * turn @ inverse @ turn
    moved = inverse @ da
    deviance = (n - width) * math.log(rest / (n - width)) + terms[0] + np.linalg.slogdet(a)[1]
    first = (n - width) * drest / rest + terms[1] + np.trace(moved)
    second = (n - width) * (ddrest / rest - (drest / rest) ** 2) + terms[2] + np.trace(inverse @ dda) - np.trace(moved @ moved)
    return deviance, first, second, beta, rest / (n - width), inverse


LOG_THETA = (-12.0, 8.0)  # range of the variance ratio; at its low end the variance component is 0


def random_intercept(df: DataFrame, group: str, subject: str, predictors: list[str], y: str, steps: int = 40) -> DataFrame:
    """Random-intercept model per group by REML.

    The deviance is profiled over log theta: first on a grid, then by Newton steps held
    inside the bracket around the best point; all groups take a step in one aggregation.
    """
    classes = SizeClasses(df, group, subject, predictors, y)
    grid = [math.exp(x) for x in np.linspace(*LOG_THETA, 41)]
    points = [0.0, *grid]
    values = classes.at([(g, t) for g in classes.base for t in points])
    fits = {key: _profile(classes.base[key[0]], *found) for key, found in values.items()}
    state = {}
    for g in classes.base:
        best = min(range(len(grid)), key=lambda i: fits[g, grid[i]][0])
        low, high = math.log(grid[max(best - 1, 0)]), math.log(grid[min(best + 1, len(grid) - 1)])
        state[g] = [low, high, math.log(grid[best]), False]
    for _ in range(steps):
        moving = [g for g, (*_, done) in state.items() if not done]
        if not moving:
            break
        asked = {g: math.exp(state[g][2]) for g in moving}
        values = classes.at(list(asked.items()))
        for g, theta in asked.items():
            fits[g, theta] = fit = _profile(classes.base[g], *values[g, theta])
            low, high, x, _ = state[g]
            slope, curve = theta * fit[1], theta * fit[1] + theta * theta * fit[2]
            low, high = (x, high) if slope < 0 else (low, x)
            after = x - slope / curve if curve > 0 else math.inf
            if not low < after < high:
                after = (low + high) / 2
            state[g] = [low, high, after, abs(after - x) < 1e-11 or high - low < 1e-11]
    out = []
    for g in classes.base:
        theta = min((t for h, t in fits if h == g), key=lambda t: (fits[g, t][0], t))
        _, _, _, beta, sigma2, inverse = fits[g, theta]
        table = _table(classes.names, beta, np.sqrt(np.diag(inverse) * sigma2), classes.base[g][0, 0], theta)
        out += [(g, *map(_plain, row)) for row in table.itertuples(index=False)]
    kind = df.schema[group].dataType.simpleString()
    return _tidy(df.sparkSession.createDataFrame(out, f"{group} {kind}, {_FIT}"), group)


def _plain(value):
    return value.item() if isinstance(value, np.generic) else value


def profile_deviance(df: DataFrame, group: str, subject: str, predictors: list[str], y: str, log_thetas: list[float]) -> DataFrame:
    """(group, log_theta, deviance): the REML profile at given points."""
    classes = SizeClasses(df, group, subject, predictors, y)
    values = classes.at([(g, math.exp(x)) for g in classes.base for x in log_thetas])
    rows = [(g, x, float(_profile(classes.base[g], *values[g, math.exp(x)])[0])) for g in classes.base for x in log_thetas]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{group} {kind}, log_theta double, deviance double")


def _term(column: str, level: Column) -> Column:
    return F.concat(F.lit(f"C({column})[T."), level, F.lit("]"))


def sparse_entries(numeric: list[str], categorical: dict[str, str]) -> Column:
    """A row's nonzero design entries as (term, value): numeric columns, and a 1 for the level of each categorical column.

    Terms are named by the levels that occur; nobody lists the levels. A column's reference level has no entry.
    """
    parts = [F.struct(F.lit(c).alias("term"), F.col(f"`{c}`").cast("double").alias("value")) for c in numeric]
    for column, reference in categorical.items():
        level = F.col(f"`{column}`").cast("string")
        parts.append(F.struct(F.when(level != reference, _term(column, level)).alias("term"), F.lit(1.0).alias("value")))
    return F.filter(F.array(*parts), lambda x: x["term"].isNotNull())


def _pairs(entries: str) -> Column:
    """Products of two entries, each unordered pair of terms once, in the order of the terms."""
    products = F.transform(entries, lambda a: F.transform(
        F.filter(entries, lambda b: a["term"] <= b["term"]),
        lambda b: F.struct(a["term"].alias("i"), b["term"].alias("j"), (a["value"] * b["value"]).alias("value"))))
    return F.explode(F.flatten(products)).alias("x")


def absorbed_ols(df: DataFrame, group: str, numeric: list[str], categorical: dict[str, str], absorbed: str, reference: str,
                 y: str) -> DataFrame:
    """Least squares per group with a categorical column of any number of levels; equal to `ols` with its dummies.

    The levels' block of the normal equations is diagonal, their counts. It is eliminated level by level where the
    level's sums are: what is left to solve has the other terms only, cross products of co-occurring entries, and the
    effects of the levels follow from it row by row. So nothing grows with the levels but tables.
    """
    y_term = "\u0000y"
    use = df.where(F.col(y).isNotNull() & F.col(f"`{absorbed}`").isNotNull())
    for c in [*numeric, *categorical]:
        use = use.where(F.col(f"`{c}`").isNotNull())
    entries = F.concat(sparse_entries(numeric, categorical), F.array(F.struct(F.lit(y_term).alias("term"), F.col(y).cast("double").alias("value"))))
    rows = use.select(group, F.col(f"`{absorbed}`").cast("string").alias("level"), entries.alias("e"))
    cross = rows.select(group, _pairs("e")).groupBy(group, "x.i", "x.j").agg(F.sum("x.value").alias("value"))
    sums = rows.select(group, "level", F.explode("e").alias("e")).groupBy(group, "level", F.col("e.term").alias("term")).agg(
        F.sum("e.value").alias("value"), F.count("*").alias("rows"))
    # Every row has an entry for y, so that term's count is the level's. A level has an entry per term that occurs with it.
    levels = materialise(sums.groupBy(group, "level").agg(
        F.collect_list(F.struct("term", "value")).alias("s"), F.max(F.when(F.col("term") == y_term, F.col("rows"))).alias("n")), "levels")
    taken = levels.select(group, "n", _pairs("s")).groupBy(group, "x.i", "x.j").agg(F.sum(-F.col("x.value") / F.col("n")).alias("value"))
    counts = levels.groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("n_levels"))
    reduced = cross.unionByName(taken).groupBy(group, "i", "j").agg(F.sum("value").alias("value")).join(counts, group)
    kind = df.schema[group].dataType.simpleString()

    def solve(key, part):
        terms = sorted(set(part["i"]) | set(part["j"]))
        place = {t: k for k, t in enumerate(terms)}
        g = np.zeros((len(terms), len(terms)))
        i, j = part["i"].map(place).to_numpy(), part["j"].map(place).to_numpy()
        g[i, j] = g[j, i] = part["value"].to_numpy()
        yy, xy, xx = g[0, 0], g[0, 1:], g[1:, 1:]  # the term of y sorts first
        inverse = np.linalg.pinv(xx, hermitian=True)
        beta = inverse @ xy
        n, n_levels = int(part["n"].iat[0]), int(part["n_levels"].iat[0])
        rank = np.linalg.matrix_rank(xx, hermitian=True) if len(xx) else 0
        sigma2 = max(yy - beta @ xy, 0.0) / max(n - n_levels - rank, 1)
        return pd.DataFrame({group: [key[0]], "terms": [terms[1:]], "beta": [beta.tolist()], "inverse": [inverse.tolist()],
                             "sigma2": [sigma2], "n": [n]})

    solved = materialise(reduced.groupBy(group).applyInPandas(
        solve, f"{group} {kind}, terms array<string>, beta array<double>, inverse array<array<double>>, sigma2 double, n bigint"), "solved")
    slopes = solved.select(group, "sigma2", "n", F.posexplode("terms").alias("k", "variable"), "beta", "inverse").select(
        group, "variable", F.element_at("beta", F.col("k") + 1).alias("coefficient"),
        F.sqrt(F.element_at(F.element_at("inverse", F.col("k") + 1), F.col("k") + 1) * F.col("sigma2")).alias("std_error"), "n")

    # A level's effect is its mean of y less that of the other terms; its error adds the uncertainty of these.
    sum_of = F.map_from_entries("s")
    means = levels.join(solved.withColumnRenamed("n", "n_all"), group).select(
        group, "level", "n", "n_all", "beta", "inverse", "sigma2", (F.element_at(sum_of, y_term) / F.col("n")).alias("mean_y"),
        F.transform("terms", lambda t: F.coalesce(F.try_element_at(sum_of, t), F.lit(0.0)) / F.col("n")).alias("mean"))
    base = means.where(F.col("level") == reference).select(group, F.col("n").alias("n_0"), F.col("mean_y").alias("y_0"), F.col("mean").alias("mean_0"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda acc, x: acc + x)

    both = means.join(base, group)
    is_base = F.col("level") == reference
    shift = F.zip_with("mean", "mean_0", lambda x, z: F.when(is_base, x).otherwise(x - z))
    spread = dot(F.transform("inverse", lambda row: dot(row, F.col("shift"))), F.col("shift"))
    effects = both.withColumn("shift", shift).select(
        group, F.when(is_base, "Intercept").otherwise(_term(absorbed, F.col("level"))).alias("variable"),
        (F.col("mean_y") - F.when(is_base, 0.0).otherwise(F.col("y_0")) - dot(F.col("shift"), F.col("beta"))).alias("coefficient"),
        F.sqrt((1 / F.col("n") + F.when(is_base, 0.0).otherwise(1 / F.col("n_0")) + spread) * F.col("sigma2")).alias("std_error"),
        F.col("n_all").alias("n"))
    table = slopes.unionByName(effects).withColumn("z_value", F.col("coefficient") / F.col("std_error"))
    return _tidy(table.withColumns({"p_value": tails.normal_two_sided(F.col("z_value")), "theta": F.lit(0.0)}), group)


def notable(table: DataFrame, threshold: float = 2.0, only: str | None = None) -> DataFrame:
    """Terms with a large z in any source, or in one named source; the intercept never counts.

    `table` is a coefficient table: sources x terms rows.
    """
    from pyspark.sql.window import Window

    large = F.abs("z_value") > threshold
    if only is not None:
        large = large & (F.col("source") == only)
    flag = F.max(large.cast("int")).over(Window.partitionBy("variable"))
    return (table.where(F.col("variable") != "Intercept").withColumn("_any", flag)
            .where(F.col("_any") == 1).drop("_any"))


def compare(table: DataFrame, sources: list[str], value: str) -> DataFrame:
    """Terms down, sources across."""
    return table.groupBy("variable").pivot("source", sources).agg(F.first(value, ignorenulls=True))
