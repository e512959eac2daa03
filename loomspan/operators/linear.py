"""Least squares from moment matrices, on the JVM.

Spark sums the products of columns, map-side first, so that what is shuffled is one small matrix a key and task. A sweep over the sums
gives coefficients, their covariance and the squared error in one fold; no row and no matrix goes to Python or the driver. Matrices
are arrays, row by row. Columns that the others explain get coefficient 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.special import normal_two_sided, t_two_sided
from loomspan.operators.returns import by_time

#: The share of a column's square that others leave, below which it counts as explained by them.
LEAST = 1e-10


def products(columns: list[Column]) -> Column:
    """Sums of products of all pairs of columns: an aggregate."""
    sums = {(i, j): F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))}
    return F.array(*[sums[min(i, j), max(i, j)] for i in range(len(columns)) for j in range(len(columns))])


def cell(matrix: Column, m: int, i: int, j: int) -> Column:
    return F.get(matrix, F.lit(i * m + j))


def swept(matrix: Column, m: int, pivots: Column) -> Column:
    """The m x m matrix after exchanging each pivot: among pivots the inverse, in their rows of other columns the coefficients, among the
    others what is left. pivots: array of ints."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(m) for j in range(m)])
    at = lambda a, i, j: F.get(a, i * m + j)

    def step(a: Column, p: Column) -> Column:
        d = at(a, p, p)

        def one(c: Column) -> Column:
            i, j = c["i"], c["j"]
            across, down = at(a, p, j) / d, at(a, i, p) / d
            return F.when((i == p) & (j == p), 1 / d).when(i == p, across).when(j == p, -down).otherwise(at(a, i, j) - down * at(a, p, j))

        gone = F.transform(cells, lambda c: F.when((c["i"] == p) | (c["j"] == p), 0.0).otherwise(at(a, c["i"], c["j"])))
        return F.when(d > LEAST * at(matrix, p, p), F.transform(cells, one)).otherwise(gone)

    return F.aggregate(pivots, matrix, step)


def to(n: int, first: int = 0) -> Column:
    """The pivots from `first` up to n, which is left out."""
    return F.array(*[F.lit(i) for i in range(first, n)]).cast("array<int>")


def least_squares(rows: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """(by..., n, beta, sse, sst, swept) of y on a constant and xs, for each key; rows with a null don't count."""
    terms = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    m = len(terms) + 1
    full = rows.dropna(subset=[y, *xs])
    sums = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), products([*terms, F.col(y).cast("double")]).alias("g"))
    done = sums.withColumn("swept", swept(F.col("g"), m, to(m - 1)))
    mean_part = cell(F.col("g"), m, 0, m - 1) ** 2 / F.col("n")
    beta = F.array(*[cell(F.col("swept"), m, i, m - 1) for i in range(m - 1)])
    return done.select(*by, "n", beta.alias("beta"), cell(F.col("swept"), m, m - 1, m - 1).alias("sse"), (cell(F.col("g"), m, m - 1, m - 1) - mean_part).alias("sst"), "swept")


def factor_regression(rows: DataFrame, factors: list[str], key: str = "asset", y: str = "r") -> DataFrame:
    """Least squares of y on a constant and factors: a row a key and term with beta, robust (HC1) error, t and p, and R squared.

    The robust middle is a second aggregation over the rows, joined with their key's coefficients."""
    terms = ["const", *factors]
    k, m = len(terms), len(terms) + 1
    fitted = least_squares(rows, y, factors, [key])
    x = rows.dropna(subset=[y, *factors]).withColumn("const", F.lit(1.0)).join(fitted.select(key, "beta"), key)
    e = F.col(y) - sum((F.col(t) * F.col("beta")[i] for i, t in enumerate(terms)), F.lit(0.0))
    middle = x.withColumn("_e", e).groupBy(key).agg(products([F.col(t) * F.col("_e") for t in terms]).alias("mid"))
    s, mid, n = F.col("swept"), F.col("mid"), F.col("n")
    both = fitted.join(middle, key)

    def error(i: int) -> Column:
        total = sum((cell(s, m, i, a) * cell(mid, k, a, b) * cell(s, m, b, i) for a in range(k) for b in range(k)), F.lit(0.0))
        return F.sqrt(F.greatest(F.lit(0.0), total * n / (n - k)))

    each = F.array(*[F.struct(F.lit(t).alias("term"), F.col("beta")[i].alias("beta"), error(i).alias("se")) for i, t in enumerate(terms)])
    out = both.select(key, "n", (1 - F.col("sse") / F.col("sst")).alias("r2"), F.explode(each).alias("t")).select(key, "n", "r2", "t.*")
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("beta") / F.col("se")).otherwise(0.0))
    return out.select(key, "term", "beta", "se", "t", t_two_sided(F.col("t"), F.col("n") - k).alias("p_value"), "r2", (1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - k)).alias("adj_r2"))


def wide_products(panel: DataFrame, names: list[str], value: str = "r", key: str = "asset") -> DataFrame:
    """One row: g, the products of the named keys' values over the dates that all of them have."""
    wide = panel.groupBy("dt").pivot(key, names).agg(F.first(value)).dropna()
    return wide.agg(products([F.col(f"`{n}`") for n in names]).alias("g"))


def variance_inflation(panel: DataFrame, names: list[str], value: str = "r", key: str = "asset") -> DataFrame:
    """(key, vif) without constant, of the named series against the others."""
    m = len(names)
    inverse = wide_products(panel, names, value, key).select("g", swept(F.col("g"), m, to(m)).alias("s"))
    each = F.array(*[F.struct(F.lit(n).alias(key), (cell(F.col("g"), m, i, i) * cell(F.col("s"), m, i, i)).alias("vif")) for i, n in enumerate(names)])
    return inverse.select(F.explode(each).alias("v")).select("v.*")


def inflation_selection(panel: DataFrame, names: list[str], threshold: float = 10.0, value: str = "r", key: str = "asset") -> DataFrame:
    """(key, dropped, vif): the worst series is dropped again and again until all are at or below the threshold or two are left. dropped:
    in which round, null if it stays; vif: when it was dropped, or among those that stay."""
    m = len(names)
    g = F.col("g")

    def inflation(left: Column) -> Column:
        s = swept(g, m, left)
        return F.transform(left, lambda i: F.struct((F.get(g, i * (m + 1)) * F.get(s, i * (m + 1))).alias("vif"), (-i).alias("i")))

    def step(s: Column, k: Column) -> Column:
        worst = F.array_max(inflation(s["left"]))
        drop = (F.size(s["left"]) > 2) & (worst["vif"] > threshold)
        gone = F.concat(s["gone"], F.array(F.struct((-worst["i"]).alias("i"), k.alias("dropped"), worst["vif"].alias("vif"))))
        return F.when(drop, F.struct(F.filter(s["left"], lambda i: i != -worst["i"]).alias("left"), gone.alias("gone"))).otherwise(s)

    start = F.struct(to(m).alias("left"), F.array().cast("array<struct<i:int,dropped:int,vif:double>>").alias("gone"))
    done = wide_products(panel, names, value, key).select("g", F.aggregate(F.sequence(F.lit(1), F.lit(max(1, m - 2))), start, step).alias("s"))
    kept = F.transform(inflation(F.col("s.left")), lambda x: F.struct((-x["i"]).alias("i"), F.lit(None).cast("int").alias("dropped"), x["vif"].alias("vif")))
    rows = done.select(F.explode(F.concat(F.col("s.gone"), kept)).alias("r")).select("r.*")
    return rows.select(F.get(F.array(*map(F.lit, names)), F.col("i")).alias(key), "dropped", "vif")


def ridge(matrix: Column, n: Column, k: int, l2: float) -> Column:
    """Coefficients (constant first) of k standardised columns with penalty l2, back in the columns' units. matrix: products of a
    constant, the columns and the label."""
    m = k + 2
    centred = swept(matrix, m, to(1))
    heavier = F.zip_with(centred, F.array(*[F.lit(i == j and 0 < i <= k) for i in range(m) for j in range(m)]), lambda v, on: F.when(on, v * (1 + l2 / n) if l2 else v).otherwise(v))
    solved = F.transform(F.array(swept(heavier, m, to(k + 1, 1))), lambda s: F.array(*[cell(s, m, i, k + 1) for i in range(k + 1)]))
    return F.get(solved, F.lit(0))


def period(months: int) -> Column:
    return F.floor((F.year("dt") * 12 + F.month("dt") - 1) / months).cast("long")


def walk_forward(table: DataFrame, features: list[str], every_months: int = 3, least: int = 100, horizon: int = 0, l2: float = 1.0, key: str = "asset", state: str | None = None, least_state: int = 100) -> DataFrame:
    """(key, dt, p): a linear model retrained at the start of each period on the key's rows that end `horizon` rows before it.

    The products of each period's new rows are summed once and added up over the periods, so the work doesn't grow with the history
    that a model sees. With `state` (a boolean column), rows of a state are scored by the model of its rows where there are more than
    least_state of them, else by that of all rows; a row without a state counts in neither and is scored by that of all."""
    k, m = len(features), len(features) + 2
    w = by_time(key)
    t = table.withColumn("_m", period(every_months)).withColumn("_from", F.lead("_m", horizon).over(w))
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col("y").cast("double")]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    parts = {"all": F.lit(True)} if state is None else {"all": F.lit(True), "on": F.col(state), "off": ~F.col(state)}
    # What a row adds counts from the period after that of the row `horizon` rows ahead.
    sums = t.where(F.col("_from").isNotNull()).groupBy(key, F.col("_from").alias("_m")).agg(*[F.sum(F.when(c, columns[i] * columns[j])).alias(f"_{p}{i}_{j}") for p, c in parts.items() for i, j in pairs])
    # A key's last periods may add nothing, for want of rows ahead: they are there all the same.
    sums = t.select(key, "_m").distinct().join(sums, [key, "_m"], "left")
    before = Window.partitionBy(key).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    seen = sums.select(key, "_m", *[F.coalesce(F.sum(f"_{p}{i}_{j}").over(before), F.lit(0.0)).alias(f"_{p}{i}_{j}") for p in parts for i, j in pairs])
    matrix = lambda p: F.array(*[F.col(f"_{p}{min(i, j)}_{max(i, j)}") for i in range(m) for j in range(m)])
    models = seen.where(F.col("_all0_0") >= least).select(key, "_m", *[matrix(p).alias(f"_{p}") for p in parts], *[F.col(f"_{p}0_0").alias(f"_n_{p}") for p in parts])
    models = models.select(key, "_m", *[ridge(F.col(f"_{p}"), F.col(f"_n_{p}"), k, l2).alias(f"_b_{p}") for p in parts], *[f"_n_{p}" for p in parts])
    beta = F.col("_b_all")
    if state is not None:
        own = lambda p: F.when(F.col(f"_n_{p}") > least_state, F.col(f"_b_{p}")).otherwise(F.col("_b_all"))
        beta = F.when(F.col(state), own("on")).when(~F.col(state), own("off")).otherwise(F.col("_b_all"))
    scored = t.join(models, [key, "_m"]).withColumn("_beta", beta)
    p = sum((F.col("_beta")[i + 1] * F.col(f) for i, f in enumerate(features)), F.col("_beta")[0])
    return scored.select(key, "dt", p.alias("p"))


def bartlett(lag: Column, lags: Column) -> Column:
    return 1 - lag / (lags + 1)


def long_run_variance(values: Column, lags: Column) -> Column:
    """Variance of the mean times n of a centred series (an array in order), with Bartlett weights: one fold a lag."""
    n = F.size(values)
    dot = lambda k: F.aggregate(F.zip_with(F.slice(values, k + 1, n - k), F.slice(values, 1, n - k), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    at_zero = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / n
    rest = F.aggregate(F.when(lags > 0, F.sequence(F.lit(1), lags)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + 2 * bartlett(k, lags) * dot(k) / n)
    return at_zero + rest


def sharpe_difference(pairs: DataFrame) -> DataFrame:
    """(a, b, diff, se, z, p_value) of the Sharpe ratios of each pair (dt, a, b, ra, rb). The variance is that of the ratios' gradient
    times the four moments, a series of one number a date, with Bartlett weights up to the cube root of n."""
    x, y = F.col("ra"), F.col("rb")
    m = pairs.groupBy("a", "b").agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.count(F.lit(1)).alias("n"))
    vx, vy = F.col("xx") - F.col("mx") ** 2, F.col("yy") - F.col("my") ** 2
    m = m.withColumns({"sx": F.sqrt(vx), "sy": F.sqrt(vy)})
    u = F.col("xx") / F.col("sx") ** 3 * (x - F.col("mx")) - F.col("yy") / F.col("sy") ** 3 * (y - F.col("my")) - F.col("mx") / F.col("sx") ** 3 / 2 * (x * x - F.col("xx")) + F.col("my") / F.col("sy") ** 3 / 2 * (y * y - F.col("yy"))
    series = pairs.join(m, ["a", "b"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("dt", u.alias("u")))).alias("s"))
    out = series.join(m, ["a", "b"]).withColumn("_lags", F.floor(F.pow(F.col("n").cast("double"), F.lit(1 / 3)) + 1e-9).cast("int"))
    out = out.withColumn("_v", long_run_variance(F.col("s.u"), F.col("_lags")))
    out = out.withColumns({"diff": F.col("mx") / F.col("sx") - F.col("my") / F.col("sy"), "se": F.sqrt(F.greatest(F.lit(0.0), F.col("_v")) / F.col("n"))})
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("diff") / F.col("se")).otherwise(0.0))
    return out.select("a", "b", "diff", "se", "z", normal_two_sided(F.col("z")).alias("p_value"))


