"""Aggregates over scored songs; each function returns the rows that a chart of it would draw."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resources import GROUPS
from ..functions.text import split_words
from .songs import without_outliers


def _unpivot(row: DataFrame, groups: list[str], value: str, name: str = "group") -> DataFrame:
    return row.unpivot([], [F.col(f"`{g}`") for g in groups], name, value)


def group_totals(df: DataFrame, groups: list[str] = GROUPS) -> DataFrame:
    """(group, total): emotion words of each group over all songs."""
    return _unpivot(df.agg(*(F.sum(f"count_{g}").alias(g) for g in groups)), groups, "total")


def group_mean_ratio(df: DataFrame, groups: list[str] = GROUPS) -> DataFrame:
    """(group, mean_ratio): mean over songs, not weighted."""
    return _unpivot(df.agg(*(F.avg(f"ratio_{g}").alias(g) for g in groups)), groups, "mean_ratio")


def group_mean_score(df: DataFrame, groups: list[str] = GROUPS, digits: int | None = 2) -> DataFrame:
    """(group, mean_score): mean score of the songs with a word of the group; null if there is none."""
    means = {g: F.avg(F.when(F.col(f"count_{g}") > 0, F.col("emotion_score"))) for g in groups}
    return _unpivot(df.agg(*((m if digits is None else F.bround(m, digits)).alias(g) for g, m in means.items())), groups, "mean_score")


def _pearson(a: str, b: str):
    """corr() raises an error on a constant column in ANSI mode; this is null there."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) for each two of the count columns: Pearson's r in one pass over the songs; null for a constant column."""
    columns = [c for c in df.columns if c.startswith("count_")] if columns is None else columns
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(_pearson(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    at = {p: i for i, p in enumerate(pairs)}
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{at.get((a, b), at.get((b, a)))}`").alias("r")) for a in columns for b in columns))
    return row.select(F.inline(cells))


def histogram(df: DataFrame, column: str = "emotion_score", bins: int = 30, exclude_outliers: bool = False) -> DataFrame:
    """(bin, lo, hi, n): equal widths between the least and the greatest value, the last bin closed; empty bins too. A
    constant column lies in the middle of a width of 1. No values give no rows."""
    if exclude_outliers:
        df = without_outliers(df, column)
    x = F.col(column).cast("double")
    df = df.where(x.isNotNull()).select(x.alias("x"))
    ends = df.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo is not null")
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    ends = F.broadcast(ends)  # one row
    place = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counts = df.crossJoin(ends).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density(df: DataFrame, column: str = "emotion_score", points: int = 200, bins: int = 30) -> DataFrame:
    """(x, y): Gaussian density with Scott's bandwidth on a grid from the least to the greatest value, scaled to the bins'
    counts. Equal values are counted first, so the work is points times different values. A column without spread has
    no rows."""
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("c"))
    shape = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")).where("sd > 0")
    shape = shape.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    grid = shape.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    bell = F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2)))
    scale = (F.col("hi") - F.col("lo")) / bins / (F.col("h") * F.sqrt(2 * F.pi()))
    met = values.crossJoin(F.broadcast(grid))  # `points` rows
    return met.groupBy("i", "x", "lo", "hi", "h").agg(F.sum(bell).alias("s")).select("x", (F.col("s") * scale).alias("y")).orderBy("x")


def regression(df: DataFrame, group: str, column: str = "emotion_score", exclude_outliers: bool = False) -> DataFrame:
    """One row: the line of ratio_group over the score, (slope, intercept, r, r2, stderr, p_value, n); null where it has none.
    p_value is that of a slope of zero, by Student's t with n - 2 degrees of freedom on both sides."""
    if exclude_outliers:
        df = without_outliers(df, column)
    x, y = F.col(column).cast("double"), F.col(f"ratio_{group}").cast("double")
    pairs = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    row = pairs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), _pearson("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.count("*").alias("n"))
    r2 = F.col("r") * F.col("r")
    error = F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.greatest(1 - r2, F.lit(0.0)) * F.col("vy"), F.col("vx") * (F.col("n") - 2))))
    # the chance that |t| is at least as large is I_x(a, 1/2), of x = 1 - r^2 and a = (n - 2) / 2
    p = F.when((F.col("n") > 2) & F.col("r").isNotNull(), _beta_half(F.greatest(1 - r2, F.lit(0.0)), (F.col("n") - 2) / 2))
    return row.select("slope", "intercept", "r", r2.alias("r2"), error.alias("stderr"), p.alias("p_value"), "n")


def _beta_half(x: Column, a: Column) -> Column:
    """The regularised incomplete beta function I_x(a, 1/2). With s = sqrt(1 - x) = sin(phi), 2a degrees of freedom n and t the
    quotient that has s^2 = t^2 / (n + t^2), it is 1 less Student's probability within t, for which finite series in
    cos(phi)^2 = x exist (Abramowitz and Stegun, 26.7.3 and 26.7.4). Above 1000 degrees of freedom, where they are long, the
    normal deviate of t is used (Wallace), whose error is below 1e-6 there."""
    s, n = F.sqrt(F.greatest(1 - x, F.lit(0.0))), (2 * a).cast("long")
    terms = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(F.floor((n - 1) / 2), F.lit(500).cast("long"))))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def series(factor) -> Column:
        """1 + sum of the terms, each the one before times x times factor(k)."""
        step = lambda acc, k: F.struct((acc["term"] * x * factor(k)).alias("term"), (acc["total"] + acc["term"] * x * factor(k)).alias("total"))
        return F.aggregate(terms, start, step)["total"]

    # even n: s * (1 + 1/2 x + 1*3/(2*4) x^2 + ...), to x^((n-2)/2); odd n: 2/pi * (phi + s * cos * (1 + 2/3 x + ...)), to x^((n-3)/2)
    even = s * F.when(n > 2, series(lambda k: F.when(k <= (n - 2) / 2, (2.0 * k - 1) / (2.0 * k)).otherwise(F.lit(0.0)))).otherwise(F.lit(1.0))
    odd_sum = F.when(n > 3, series(lambda k: F.when(k <= (n - 3) / 2, (2.0 * k) / (2.0 * k + 1)).otherwise(F.lit(0.0)))).otherwise(F.lit(1.0))
    odd = 2 / F.pi() * (F.asin(F.least(s, F.lit(1.0))) + F.when(n > 1, s * F.sqrt(x) * odd_sum).otherwise(F.lit(0.0)))
    z = (8.0 * n + 1) / (8.0 * n + 3) * F.sqrt(-n * F.log(F.greatest(x, F.lit(1e-300))))
    few = F.greatest(1 - F.when(n % 2 == 0, even).otherwise(odd), F.lit(0.0))
    return F.when(n > 1000, _normal_tails(z)).otherwise(few)


def _normal_tails(z: Column) -> Column:
    """The chance of a normal deviate beyond z on either side, by the continued fraction's approximation of erfc (Numerical
    coefficients: Abramowitz and Stegun, 7.1.26; error below 1.5e-7)."""
    y = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * y)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-y * y)


def regression_line(df: DataFrame, group: str, column: str = "emotion_score", points: int = 100) -> DataFrame:
    """(x, y, low, high): points of the line, and twice its standard error around it; no values give no points."""
    line = regression(df, group, column)
    x = F.col(column).cast("double")
    ends = F.broadcast(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.var_pop(x).alias("vx")))  # one row
    grid = line.crossJoin(ends).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    y = F.col("intercept") + F.col("slope") * F.col("x")
    band = 2 * F.col("stderr") * F.sqrt(F.col("vx") + F.pow(F.col("x") - F.col("mean"), F.lit(2)))
    return grid.select("x", y.alias("y"), (y - band).alias("low"), (y + band).alias("high"))


def word_frequencies(df: DataFrame, top: int | None = 200, words: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """(word, freq, weight): emotion words of all songs, or those of one group of words(word, groups); weight is relative to
    the most frequent. The `top` most frequent; None for all."""
    rows = df.where("emotion_words is not null").select(F.explode(split_words(F.col("emotion_words"))).alias("word")).where("word <> ''")
    counts = rows.groupBy("word").agg(F.count("*").alias("freq"))
    if group is not None:
        mine = words.where(F.array_contains("groups", group)).select("word")
        counts = counts.join(mine, "word", "left_semi")
    most = F.broadcast(counts.agg(F.max("freq").alias("most")))  # one row
    if top is not None:
        counts = counts.orderBy(F.desc("freq"), "word").limit(top)
    return counts.crossJoin(most).select("word", "freq", (F.col("freq") / F.col("most")).alias("weight"))


def value_counts(df: DataFrame, column: str, by_key: bool = False, top: int | None = None) -> DataFrame:
    """(column, n) of values that are not null, the most frequent first, or by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    out = out.orderBy(column) if by_key else out.orderBy(F.desc("n"), column)
    return out if top is None else out.limit(top)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Adds column_scaled, from 0 to 1; 0 in a constant column."""
    ends = F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))  # one row
    scaled = F.coalesce(F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.when(F.col(column).isNotNull(), F.lit(0.0)))
    return df.crossJoin(ends).withColumn(f"{column}_scaled", scaled).drop("__lo", "__hi")


def trend(df: DataFrame, keys: list[str], decade: bool = True) -> DataFrame:
    """Songs, and means of score, normalised score and ratio of emotion words, by keys and decade (from year)."""
    by = [F.col(k) for k in keys] + ([(F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")] if decade else [])
    return df.groupBy(*by).agg(F.count("*").alias("songs"), F.avg("emotion_score").alias("mean_score"), F.avg("normalized_emotion_score").alias("mean_normalized"), F.avg("emotion_word_ratio").alias("mean_ratio"))


def top_groups(df: DataFrame, title: str | None = None, n: int = 5) -> DataFrame:
    """(row_id, title, group, cnt, rank): each song's n largest count columns above 0, ties in the order of columns. With a
    title, those of the first song that has it; none if there is none."""
    columns = [c for c in df.columns if c.startswith("count_")]
    if title is not None:
        df = df.where(F.col("title") == title).orderBy("row_id").limit(1)
    cells = F.array(*(F.struct(F.negative(F.col(c)).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("group"), F.col(c).cast("long").alias("cnt")) for i, c in enumerate(columns)))
    best = F.slice(F.array_sort(F.filter(cells, lambda x: x["cnt"] > 0)), 1, n)  # a sort inside the row: no shuffle
    rows = df.select("row_id", "title", F.posexplode(best).alias("pos", "x"))
    return rows.select("row_id", "title", F.col("x.group").alias("group"), F.col("x.cnt").alias("cnt"), (F.col("pos") + 1).alias("rank"))


def top_songs(df: DataFrame, column: str = "emotion_score", n: int = 5, bottom: bool = False, exclude_outliers: bool = False) -> DataFrame:
    """The n songs with the largest (or smallest) value; songs without a value last, ties by row_id."""
    if exclude_outliers:
        df = without_outliers(df, column)
    order = F.col(column).asc_nulls_last() if bottom else F.col(column).desc_nulls_last()
    more = ["emotion_score"] if column != "emotion_score" else []
    return df.orderBy(order, "row_id").limit(n).select("row_id", "title", "artist", column, *more, "emotion_score_detail")


def running_rank(df: DataFrame, column: str, partition: list[str]) -> DataFrame:
    """Rank of each song by a column within its partition."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*partition).orderBy(F.col(column).desc_nulls_last(), "row_id")))
