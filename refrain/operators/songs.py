"""Projections, filters, repairs, keep-first deduplication and exact samples of song tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resources import TRANSLATION_MARK, TRANSLATIONS_ARTIST
from ..functions.text import SPACE, strip
from .ranges import numbered

# Column names of the two sources and what they become.
RENAME_A = {"tag": "genre"}
RENAME_B = {"Song Title": "title", "Artist": "artist", "Release Date": "release date", "Year": "year", "Rank": "rank", "Lyrics": "lyrics"}
COLUMNS_A = ["title", "artist", "genre", "year", "views", "lyrics", "language"]
COLUMNS_B = ["title", "artist", "release date", "year", "rank", "lyrics"]


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def project(df: DataFrame, columns: list[str], strict: bool = True, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The columns in this order; a missing one is an error if strict, else left out. Columns of `keep` stay if there."""
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise KeyError(f"missing columns: {missing}")
    chosen = [c for c in keep if c in df.columns] + [c for c in columns if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in chosen))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows in which any of the columns is null."""
    return df.na.drop("any", subset=columns)


def year_number(year: Column) -> Column:
    """The whole number that a text or number holds; null if there is none."""
    y = F.trim(year.cast("string")).try_cast("double")
    return F.when((y == F.floor(y)) & F.abs(y).between(0, 2_000_000_000), y).cast("int")


def year_range(df: DataFrame, start_year: int = 1980, end_year: int = 2024) -> DataFrame:
    """Rows of these years, both included, with year as a number."""
    return df.withColumn("year", year_number(F.col("year"))).where(F.col("year").between(start_year, end_year))


def language_is(df: DataFrame, language: str = "en") -> DataFrame:
    return df.where(F.col("language") == language)


def fix_translations(df: DataFrame, strict_titles: bool = False) -> DataFrame:
    """Artist and title of translated songs, from titles such as `Artist - Title (English Translation)`: the artist is what
    stands before the first ` - `; the title loses the mark, the artist and the dash, and outer spaces. Other rows and
    rows without a title are as they were. strict_titles also removes the mark's parentheses, and strips the artist."""
    mine = F.coalesce(F.col("artist") == TRANSLATIONS_ARTIST, F.lit(False)) & F.col("title").isNotNull()
    artist = F.split("title", " - ", -1)[0]
    title = F.col("title")
    if strict_titles:
        title = F.replace(title, F.lit(f"({TRANSLATION_MARK})"), F.lit(""))
        artist = strip(artist)
    title = F.replace(title, F.lit(TRANSLATION_MARK), F.lit(""))
    rest = F.substr(title, F.length(artist) + 1)
    dash = rf"^[{SPACE}]*-[{SPACE}]*"
    title = F.when(F.startswith(title, artist) & rest.rlike(dash), F.regexp_replace(rest, dash, "")).otherwise(title)
    return df.withColumns({"artist": F.when(mine, artist).otherwise(F.col("artist")), "title": F.when(mine, strip(title)).otherwise(F.col("title"))})


def keep_first(df: DataFrame, columns: tuple[str, ...] = ("title", "artist"), order: str = "row_id") -> DataFrame:
    """The first row, by `order`, of each combination; nulls are equal to each other."""
    rank = F.row_number().over(Window.partitionBy(*columns).orderBy(order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def non_empty(df: DataFrame, tokens: str = "lyrics_tokens") -> DataFrame:
    return df.where(F.size(tokens) > 0)


def default_columns(df: DataFrame, order: str = "row_id") -> DataFrame:
    """With title and artist where df lacks these columns: `Unknown 1` and so on by `order`, and `Unknown`. Nulls in columns
    that are there stay."""
    if "artist" not in df.columns:
        df = df.withColumn("artist", F.lit("Unknown"))
    if "title" not in df.columns:
        df = numbered(df, order, "title").withColumn("title", F.concat(F.lit("Unknown "), F.col("title").cast("string")))
    return df


def sample_exactly(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """n rows without replacement, the same for the same rows and seed however they are dealt; more than there are is an
    error. Those with the least MD5 of seed and key: one top-n, no full sort."""
    picked = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("__h", key).limit(n)
    if df.limit(n).count() < n:
        raise ValueError(f"the table has fewer than {n} rows")
    return picked.drop("__h")


#: Share of the values on each side of a quartile that are looked at one by one. The sketch that finds them is ten times as fine.
#: Up to _FEW values all are.
_NEAR, _FEW = 1e-4, 100_000


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """One row (q1, q3), interpolated, exact; null without values. A sketch of bounded size brackets each quartile; the
    values below the bracket are counted, those inside it are counted by value and summed up in order. So no task holds
    more than a few ten thousandths of the different values. df is read three times: give a stored stage."""
    x = F.col(column).cast("double")
    values = df.select(x.alias("v")).where("v is not null and not isnan(v)")
    marks = [max(0.0, q - _NEAR) for q in (0.25, 0.75)] + [min(1.0, q + _NEAR) for q in (0.25, 0.75)]
    cuts = values.agg(F.percentile_approx("v", marks, int(10 / _NEAR)).alias("c"), F.count("*").alias("n"))
    sides = F.array(*(F.struct(F.lit(q).alias("q"), F.when(F.col("n") > _FEW, F.col("c")[i]).otherwise(F.lit(float("-inf"))).alias("lo"), F.when(F.col("n") > _FEW, F.col("c")[i + 2]).otherwise(F.lit(float("inf"))).alias("hi"), ((F.col("n") - 1) * q).alias("at")) for i, q in enumerate((0.25, 0.75))))
    brackets = F.broadcast(cuts.where("n > 0").select(F.inline(sides)))  # two rows
    met = values.crossJoin(brackets).where("v <= hi")
    counted = met.groupBy("q", "at", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.col("v").asc_nulls_first())))
    found = upto.groupBy("q", "at").agg(F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.agg(F.max(F.when(F.col("q") == 0.25, value)).alias("q1"), F.max(F.when(F.col("q") == 0.75, value)).alias("q3"))


def iqr_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: the quartiles, moved out by one and a half times their distance."""
    spread = F.col("q3") - F.col("q1")
    return quartiles(df, column).select((F.col("q1") - 1.5 * spread).alias("lower"), (F.col("q3") + 1.5 * spread).alias("upper"))


def without_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows within the bounds, both included; rows without a value go."""
    bounds = F.broadcast(iqr_bounds(df, column))  # one row
    return df.crossJoin(bounds).where(F.col(column).between(F.col("lower"), F.col("upper"))).drop("lower", "upper")
