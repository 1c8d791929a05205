"""Queries over the given tables, and their DuckDB twins.

There are no songs among the tables, so `documents` stand for them; both engines derive the same song columns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.resources import FILLERS, GROUP_OF, GROUPS, MISSING, SLANG, STOPWORDS, TRANSLATION_MARK, TRANSLATIONS_ARTIST, WEIGHTS
from .operators import language, lemmas, lexicon, scoring, similarity, songs, stats
from .plans import pipelines
from .sources import io
from .sources.stages import fresh_path, spread, stored

# ---- inputs -------------------------------------------------------------------------------------------------------

LEXICON_ROWS = [
    ("hug", "joy", 1),
    ("hug", "trust", 1),
    ("fight", "anger", 1),
    ("fight", "fear", 1),
    ("kill", "sadness", 1),
    ("wish", "anticipation", 1),
    ("wish", "positive", 1),
    ("wow", "surprise", 1),
    ("desk", "joy", 0),
    ("odd", "zzz", 1),
    ("null", "joy", 1),
    ("trash", "anger", 1),
    ("idiot", "disgust", 1),
    ("moron", "anger", 1),
    ("loser", "disgust", 1),
    ("loser", "sadness", 1),
    ("stupid", "anger", 1),
    ("worthless", "negative", 1),
    ("worthless", "disgust", 1),
    ("disgusting", "disgust", 1),
    ("rest", "trust", 1),
    ("rest", "positive", 1),
    ("heat", "anticipation", 1),
    ("thin", "sadness", 1),
    ("anti", "surprise", 1),
    ("thou", "joy", 1),
    ("thing", "anticipation", 1),
    ("thing", "joy", 1),
    ("hehely", "trust", 1),
    ("orantion", "fear", 1),
]

TEXT_ROWS = [
    (1, "la la\n  la la \n\nOh no\nla la"),
    (2, "[Verse 1\nhello] World's cafe 99!"),
    (3, "rock-n-roll ain't gonna die, y'all"),
    (4, "go 'til x'til dawn"),
    (5, "'cause yo y'all ain't gonna"),
    (6, "x" * 25 + " " + "y" * 24),
    (7, "A [b] C [d"),
    (8, "   "),
    (9, ""),
    (10, None),
    (11, "I can't stop lovin' you 'cause it's gonna hurt"),
    (12, "cannot gimme wanna go lemme wanna"),
    (13, "'tis 'twas we'll they're I've don't d'ye more'n"),
    (14, "it''s ''quoted'' said dogs' tails"),
    (15, "kinda outta lotta dunno wassup cuz cause imma gotta"),
]

#: A small dictionary, irregular words, and texts that need both.
LEMMA_WORDS = ["dog", "knife", "box", "buzz", "church", "wish", "man", "fly", "bus", "glass", "loaf", "mouse", "news", "new", "axis", "axe"]
LEMMA_EXCEPTIONS = [("mice", "mouse"), ("axes", "axis"), ("geese", "goose"), ("dogs", "hound")]
LEMMA_TEXTS = [(1, "dogs boxes buzzes churches wishes men flies buses"), (2, "glasses loaves mice news axes geese knives"), (3, "dog dog Dogs unknowns s es flies"), (4, "mans womens loafs wish")]

TRANSLATION_ROWS = [
    (1, "BTS - Spring Day (English Translation)", TRANSLATIONS_ARTIST),
    (2, "A - B - C English Translation", TRANSLATIONS_ARTIST),
    (3, "Solo English Translation", TRANSLATIONS_ARTIST),
    (4, "X.Y+ -Z English Translation", TRANSLATIONS_ARTIST),
    (5, "A-ha - Take On English Translation", TRANSLATIONS_ARTIST),
    (6, " Keep English Translation ", "Someone"),
    (7, None, TRANSLATIONS_ARTIST),
    (8, "No artist - English Translation", None),
]


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Song columns of documents; row_id is the table's own key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("t"), (F.col("doc_id") % 300).cast("string")).alias("title"),
        F.col("source").alias("tag"),
        F.col("source").alias("artist"),
        F.when(F.col("doc_id") % 97 == 0, "abc").otherwise((1970 + F.col("doc_id") % 60).cast("string")).alias("year"),
        F.col("n_chars").alias("views"),
        F.col("text").alias("lyrics"),
        F.col("lang").alias("language"),
    )


def _songs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spread(_songs(spark, sf_dir))  # for cleaning, beside which the shuffle costs little
    return s.select("row_id", F.col("title").alias("Song Title"), F.col("artist").alias("Artist"), F.col("year").alias("Year"), (F.col("row_id") % 100 + 1).cast("int").alias("Rank"), F.col("lyrics").alias("Lyrics"))


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, "word string, emotion string, association int")


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXT_ROWS, "row_id bigint, lyrics string")


def _translations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSLATION_ROWS, "row_id bigint, title string, artist string")


def _with_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_songs(spark, sf_dir).select("row_id", "lyrics"))
    return docs.union(_texts(spark).select((-F.col("row_id")).alias("row_id"), "lyrics"))


def _scored(spark: SparkSession, sf_dir: str, digits: int | None = None) -> DataFrame:
    clean = pipelines.clean_b(_songs_b(spark, sf_dir))
    return scoring.score(clean, lexicon.word_groups(_lexicon(spark)), keys=("row_id", "title", "artist", "year"), digits=digits)


def _stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores, stored, for what reads them more than once."""
    return stored(_scored(spark, sf_dir), "scores")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(pipelines.clean_b(_songs_b(spark, sf_dir)), "clean")


# ---- queries ------------------------------------------------------------------------------------------------------

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def dedupe_lines(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", text.dedupe_lines(F.col("lyrics")).alias("lyrics"))


@query
def dedupe_lines_twice(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", text.dedupe_lines(F.col("lyrics"), 2).alias("lyrics"))


@query
def clean_text(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", text.clean(F.col("lyrics")).alias("lyrics"))


@query
def slang(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", text.slang(text.clean(F.col("lyrics"))).alias("lyrics"))


@query
def long_words(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", text.drop_long_words(text.clean(F.col("lyrics")), 7, text.ONE_SPACE).alias("lyrics"))


@query
def preprocess(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", text.preprocess(F.col("lyrics")).alias("lyrics"))


@query
def treebank_tokens(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", F.array_join(text.treebank(text.preprocess(F.col("lyrics")), text.ONE_SPACE), " ").alias("tokens"))


@query
def stopword_filter(spark, sf_dir):
    return _with_fixture(spark, sf_dir).select("row_id", F.array_join(text.tokenize(text.preprocess(F.col("lyrics")), space=text.ONE_SPACE), " ").alias("tokens"))


@query
def lemma_lookup(spark, sf_dir):
    lemmas = {"haha": "ha", "things": "thing", "dogs": "dog", "tails": "tail", "erest": "er"}
    return _with_fixture(spark, sf_dir).select("row_id", F.array_join(text.tokenize(text.preprocess(F.col("lyrics")), lemmas=lemmas, space=text.ONE_SPACE), " ").alias("tokens"))


@query
def year_filter(spark, sf_dir):
    return songs.year_range(_songs(spark, sf_dir)).select("row_id", "year")


@query
def language_filter(spark, sf_dir):
    return songs.language_is(_songs(spark, sf_dir)).select("row_id", "language")


@query
def null_drop(spark, sf_dir):
    df = _songs(spark, sf_dir).withColumn("year", songs.year_number(F.col("year")))
    return songs.drop_missing(df, ["lyrics", "year", "language"]).select("row_id", "year")


@query
def projection_a(spark, sf_dir):
    return songs.project(songs.rename(_songs(spark, sf_dir), songs.RENAME_A), songs.COLUMNS_A).drop("lyrics")


@query
def projection_b(spark, sf_dir):
    df = songs.project(songs.rename(_songs_b(spark, sf_dir), songs.RENAME_B), songs.COLUMNS_B, strict=False)
    return df.drop("lyrics")


@query
def translation_fix(spark, sf_dir):
    return songs.fix_translations(_translations(spark))


@query
def translation_fix_strict(spark, sf_dir):
    return songs.fix_translations(_translations(spark), strict_titles=True)


@query
def dedupe_first(spark, sf_dir):
    return songs.keep_first(_songs(spark, sf_dir)).select("row_id", "title", "artist")


@query
def clean_a(spark, sf_dir):
    df = pipelines.clean_a(spread(_songs(spark, sf_dir)), load=None)
    return df.withColumn("lyrics_tokens", F.array_join("lyrics_tokens", " "))


@query
def clean_b(spark, sf_dir):
    df = pipelines.clean_b(_songs_b(spark, sf_dir))
    return df.withColumn("lyrics_tokens", F.array_join("lyrics_tokens", " "))


@query
def lexicon_emotion_counts(spark, sf_dir):
    return lexicon.emotion_counts(_lexicon(spark))


@query
def lexicon_group_counts(spark, sf_dir):
    return lexicon.group_counts(_lexicon(spark))


@query
def lexicon_groups(spark, sf_dir):
    return lexicon.with_group(_lexicon(spark)).select("word", "emotion", "group")


@query
def word_groups(spark, sf_dir):
    return lexicon.word_groups(_lexicon(spark)).select("word", F.array_join("groups", ",").alias("groups"))


@query
def group_names(spark, sf_dir):
    return lexicon.word_groups(_lexicon(spark)).select(F.explode("groups").alias("group")).distinct()


@query
def song_stats(spark, sf_dir):
    df = _scored(spark, sf_dir)
    return df.select("row_id", "title", "artist", "total_tokens", "emotion_word_count", F.round("emotion_word_ratio", 6).alias("emotion_word_ratio"), "emotion_words", *(f"count_{g}" for g in GROUPS), *(F.round(f"ratio_{g}", 6).alias(f"ratio_{g}") for g in GROUPS))


@query
def emotion_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_id", "emotion_score", F.round("normalized_emotion_score", 6).alias("normalized_emotion_score"))


@query
def score_detail(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_id", F.explode("emotion_score_detail").alias("group", "n"))


@query
def matched_tokens(spark, sf_dir):
    df = pipelines.clean_b(_songs_b(spark, sf_dir))
    words = sorted({w for w, _, a in LEXICON_ROWS if a == 1})
    return df.select("row_id", F.array_join(scoring.matched_words(F.col("lyrics_tokens"), words), ", ").alias("words"))


@query
def sentiment_class(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_id", scoring.sentiment().alias("sentiment"))


@query
def group_totals(spark, sf_dir):
    return stats.group_totals(_scored(spark, sf_dir))


@query
def group_mean_ratio(spark, sf_dir):
    return stats.group_mean_ratio(_scored(spark, sf_dir)).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query
def group_mean_score(spark, sf_dir):
    return stats.group_mean_score(_scored(spark, sf_dir), digits=None).withColumn("mean_score", F.round("mean_score", 6))


@query
def count_correlation(spark, sf_dir):
    return stats.correlation(_scored(spark, sf_dir)).withColumn("r", F.round("r", 6))


@query
def ratio_regression(spark, sf_dir):
    row = stats.regression(_scored(spark, sf_dir), "anger")
    return _line(row)


def _line(row):
    return row.select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r", "r2", "stderr", "p_value")), "n")


@query
def ratio_regression_normalized(spark, sf_dir):
    row = stats.regression(_scored(spark, sf_dir), "love", "normalized_emotion_score")
    return _line(row)


@query
def iqr_filter(spark, sf_dir):
    return songs.without_outliers(_stage(spark, sf_dir), "emotion_score").select("row_id", "emotion_score")


@query
def score_histogram(spark, sf_dir):
    return _rounded_bins(stats.histogram(_stage(spark, sf_dir), "emotion_score", exclude_outliers=True))


@query
def norm_histogram(spark, sf_dir):
    return _rounded_bins(stats.histogram(_stage(spark, sf_dir), "normalized_emotion_score", 7))


def _rounded_bins(df):
    return df.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query
def word_freq(spark, sf_dir):
    return stats.word_frequencies(_stage(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query
def word_freq_group(spark, sf_dir):
    df = stats.word_frequencies(_stage(spark, sf_dir), words=lexicon.word_groups(_lexicon(spark)), group="anger")
    return df.withColumn("weight", F.round("weight", 6))


@query
def top_songs(spark, sf_dir):
    return _top(stats.top_songs(_scored(spark, sf_dir)))


@query
def bottom_songs(spark, sf_dir):
    return _top(stats.top_songs(_scored(spark, sf_dir), bottom=True))


@query
def top_songs_no_outliers(spark, sf_dir):
    return _top(stats.top_songs(_stage(spark, sf_dir), n=20, exclude_outliers=True))


@query
def top_songs_norm(spark, sf_dir):
    return _top(stats.top_songs(_scored(spark, sf_dir), "normalized_emotion_score", n=10)).withColumn("normalized_emotion_score", F.round("normalized_emotion_score", 6))


def _top(df):
    return df.drop("emotion_score_detail")


@query
def top_groups_per_song(spark, sf_dir):
    return stats.top_groups(_scored(spark, sf_dir), n=3)


@query
def top_groups_for_title(spark, sf_dir):
    return stats.top_groups(_scored(spark, sf_dir), title="t52")


@query
def genre_counts(spark, sf_dir):
    return stats.value_counts(_songs(spark, sf_dir), "tag")


@query
def top_artists(spark, sf_dir):
    return stats.value_counts(_songs(spark, sf_dir), "artist", top=10)


@query
def year_counts(spark, sf_dir):
    return stats.value_counts(songs.year_range(_songs(spark, sf_dir)), "year", by_key=True)


@query
def distinct_artists(spark, sf_dir):
    return stats.distinct_count(_songs(spark, sf_dir), "artist")


@query
def distinct_years(spark, sf_dir):
    return stats.distinct_values(songs.year_range(_songs(spark, sf_dir)), "year")


@query
def table_shape(spark, sf_dir):
    df = _songs(spark, sf_dir)
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


@query
def trend_genre_decade(spark, sf_dir):
    df = stats.trend(_scored(spark, sf_dir), ["artist"])
    return df.select("artist", "decade", "songs", *(F.round(c, 6).alias(c) for c in ("mean_score", "mean_normalized", "mean_ratio")))


@query
def trend_artist(spark, sf_dir):
    df = stats.trend(_scored(spark, sf_dir), ["artist"], decade=False)
    return df.select("artist", "songs", *(F.round(c, 6).alias(c) for c in ("mean_score", "mean_normalized", "mean_ratio")))


@query
def minmax_score(spark, sf_dir):
    return stats.min_max(_stage(spark, sf_dir), "emotion_score").select("row_id", F.round("emotion_score_scaled", 6).alias("scaled"))


@query
def kde(spark, sf_dir):
    return stats.density(_stage(spark, sf_dir)).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def regression_line(spark, sf_dir):
    return stats.regression_line(_stage(spark, sf_dir), "anger").select(*(F.round(c, 6).alias(c) for c in ("x", "y", "low", "high")))


@query
def sample_n(spark, sf_dir):
    return songs.sample_exactly(_songs(spark, sf_dir), 100, seed=42).select("row_id")


@query
def langid_filter(spark, sf_dir):
    return language.english_only(_songs(spark, sf_dir)).select("row_id", "language")


@query
def tfidf_similar(spark, sf_dir):
    return similarity.similar(_cleaned(spark, sf_dir).where("row_id is not null"), 52).withColumn("cosine", F.round("cosine", 6))


@query
def kmeans(spark, sf_dir):
    return similarity.clusters(_cleaned(spark, sf_dir)).groupBy("cluster").agg(F.count("*").alias("n"))


# ---- rounded as published, sources and sinks ----------------------------------------------------------------------


@query
def song_stats_rounded(spark, sf_dir):
    df = _scored(spark, sf_dir, digits=2)
    return df.select("row_id", "emotion_word_ratio", *(f"ratio_{g}" for g in GROUPS))


@query
def group_mean_score_rounded(spark, sf_dir):
    return stats.group_mean_score(_scored(spark, sf_dir))


@query
def lemma_rules(spark, sf_dir):
    known = spark.createDataFrame([(w,) for w in LEMMA_WORDS], "word string")
    odd = spark.createDataFrame(LEMMA_EXCEPTIONS, "word string, lemma string")
    rows = spark.createDataFrame([(i, t.split(" ")) for i, t in LEMMA_TEXTS], "row_id bigint, lyrics_tokens array<string>")
    return lemmas.lemmatize(rows, known, odd).select("row_id", F.array_join("lyrics_tokens", " ").alias("tokens"))


@query
def default_columns(spark, sf_dir):
    return songs.default_columns(_songs(spark, sf_dir).select("row_id", "tag")).select("row_id", "title", "artist")


def _written(spark: SparkSession, df: DataFrame, write) -> str:
    path = fresh_path(spark, "table")
    write(df, path)
    return path


@query
def csv_songs_a(spark, sf_dir):
    path = _written(spark, _songs(spark, sf_dir).drop("row_id"), io.write_csv)
    return io.read_songs_a(spark, path).select("title", "tag", "artist", "year", "views", F.sha2(F.coalesce("lyrics", F.lit("")), 256).alias("lyrics_sha256"), "language")


@query
def csv_songs_b(spark, sf_dir):
    path = _written(spark, _songs_b(spark, sf_dir).drop("row_id"), io.write_csv)
    back = io.read_songs_b(spark, path)
    return songs.rename(back, songs.RENAME_B).select("title", "artist", F.col("release date").alias("released"), "year", "rank", F.sha2(F.coalesce("lyrics", F.lit("")), 256).alias("lyrics_sha256"))


@query
def csv_lists(spark, sf_dir):
    df = _songs(spark, sf_dir).select("row_id", F.slice(F.split("lyrics", " ", -1), 1, 5).alias("words")).where("words is not null")
    back = io.parse_list(spark.read.schema("row_id bigint, words string").csv(_written(spark, df, io.write_csv), header=True, multiLine=True, escape='"'), "words")
    return back.select("row_id", F.size("words").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("words_sha256"))


@query
def stage_parquet(spark, sf_dir):
    path = _written(spark, songs.year_range(_songs(spark, sf_dir)).select("row_id", "year"), io.write_stage)
    io.replace_stage(io.read_stage(spark, path).withColumn("next_year", F.col("year") + 1), path)
    return io.read_stage(spark, path)


@query
def lexicon_tsv(spark, sf_dir):
    lines = _lexicon(spark).select(F.concat_ws("\t", "word", "emotion", F.col("association").cast("string")).alias("value"))
    return io.read_lexicon(spark, _written(spark, lines, lambda df, path: df.write.text(path)))


@query
def filler_words(spark, sf_dir):
    lines = spark.createDataFrame([(f" {w} ",) for w in [*FILLERS, "", FILLERS[0]]], "value string")
    return io.read_words(spark, _written(spark, lines, lambda df, path: df.write.text(path)))


# ---- DuckDB twins -------------------------------------------------------------------------------------------------


def _q(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        parts = ["'" + p.replace("'", "''") + "'" for p in x.split("\n")]
        return "(" + " || chr(10) || ".join(parts) + ")"
    return str(x)


def _values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)})"


_SONGS = """songs AS (SELECT doc_id AS row_id, 't' || CAST(doc_id % 300 AS VARCHAR) AS title, source AS tag, source AS artist,
 CASE WHEN doc_id % 97 = 0 THEN 'abc' ELSE CAST(1970 + doc_id % 60 AS VARCHAR) END AS year, n_chars AS views, text AS lyrics, lang AS language FROM documents),
 numbered AS (SELECT * REPLACE (CAST(try_cast(year AS DOUBLE) AS INTEGER) AS year) FROM songs)"""
_TEXTS = _values(TEXT_ROWS, "texts", "row_id, lyrics")
_BOTH = f"WITH {_SONGS}, {_TEXTS}, both_ AS (SELECT row_id, lyrics FROM songs UNION ALL SELECT -row_id, lyrics FROM texts)"
_BACK = "\\"


def _lines(c: str, keep: int = 1) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '\\r\\n|[\\n\\r]'), lambda x: trim(x)), lambda x: x <> '')"
    test = "list_position(l, x) = i" if keep == 1 else f"len(list_filter(l[1:i], lambda y: y = x)) <= {keep}"
    return f"(SELECT coalesce(array_to_string(list_filter(l, lambda x, i: {test}), ' '), '') FROM (SELECT {lines} AS l))"


def _clean(c: str) -> str:
    c = f"translate(coalesce({c}, ''), '’‘', '''''')"
    c = f"regexp_replace({c}, '{_BACK}[.*?{_BACK}]', ' ', 'g')"
    c = f"regexp_replace({c}, '[^a-zA-Z{_BACK}s'']', '', 'g')"
    return f"lower(trim(regexp_replace({c}, '{_BACK}s+', ' ', 'g')))"


def _slang(c: str) -> str:
    for k, v in SLANG.items():
        k = k.replace("'", "''")
        c = f"regexp_replace({c}, '{_BACK}b{k}{_BACK}b', '{v}', 'g')"
    return c


def _short(c: str, longest: int = text.LONGEST_WORD) -> str:
    return f"coalesce(array_to_string(list_filter(string_split({c}, ' '), lambda x: x <> '' AND len(x) <= {longest}), ' '), '')"


def _pre(c: str) -> str:
    return _short(_slang(_clean(_lines(c))))


def _tokens(c: str) -> str:
    for pattern, to in text.TREEBANK_OPEN:
        c = _rule(c, pattern, to)
    c = f"(' ' || {c} || ' ')"
    for pattern, to in text.TREEBANK:
        c = _rule(c, pattern, to)
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def _rule(c: str, pattern: str, to: str) -> str:
    if pattern.endswith(r"(?=\s)"):  # no lookahead in this dialect
        pattern, to = pattern.replace(r"(?=\s)", r"(\s)"), to.rstrip() + r" $3"
    p, t = pattern.replace("'", "''"), to.replace("'", "''").replace("$", _BACK)
    return f"regexp_replace({c}, '{p}', '{t}', 'g')"


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({*STOPWORDS, *FILLERS})) + "]"


def _stopped(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: NOT list_contains({_STOP}, lower(w)))"


def _joined(tokens: str) -> str:
    return f"coalesce(array_to_string({tokens}, ' '), '')"


_LEXICON = ", ".join([_values(LEXICON_ROWS, "lexicon", "word, emotion, association"), _values(list(GROUP_OF.items()), "grouping_", 'emotion, "group"'), 'mapped AS (SELECT word, l.emotion, "group" FROM lexicon l LEFT JOIN grouping_ g ON l.emotion = g.emotion WHERE association = 1)', 'wg AS (SELECT DISTINCT word, "group" FROM mapped WHERE "group" IS NOT NULL)'])

_TOKENS_B = f"""pre AS (SELECT row_id, title, artist, year, {_pre("lyrics")} AS lyrics FROM numbered WHERE year BETWEEN 1980 AND 2024 AND lyrics IS NOT NULL),
 tok AS (SELECT *, {_stopped(_tokens("lyrics"))} AS tokens FROM pre),
 clean AS (SELECT * FROM tok WHERE len(tokens) > 0 QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY row_id) = 1)"""

_counts = ", ".join(f"count(*) FILTER (WHERE list_contains(gs, '{g}')) AS count_{g}" for g in GROUPS)
_ratios = ", ".join(f"count_{g} * 1.0 / total_tokens * 100 AS ratio_{g}" for g in GROUPS)
_score = " + ".join(f"count_{g} * {WEIGHTS[g]}" for g in GROUPS)
_SCORED = f"""WITH {_SONGS}, {_TOKENS_B}, {_LEXICON},
 words AS (SELECT word, list("group") AS gs FROM wg GROUP BY word),
 e AS (SELECT row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM clean),
 m AS (SELECT row_id, count(*) AS emotion_word_count, string_agg(token, ', ' ORDER BY pos) AS emotion_words, {_counts} FROM e JOIN words ON token = word GROUP BY row_id),
 w AS (SELECT c.row_id, c.title, c.artist, c.year, CAST(len(tokens) AS BIGINT) AS total_tokens, coalesce(emotion_word_count, 0) AS emotion_word_count, coalesce(emotion_words, '') AS emotion_words, {", ".join(f"coalesce(count_{g}, 0) AS count_{g}" for g in GROUPS)} FROM clean c LEFT JOIN m USING (row_id)),
 s0 AS (SELECT *, CAST(emotion_word_count AS DOUBLE) / total_tokens * 100 AS emotion_word_ratio, {_ratios.replace("* 1.0 /", "::DOUBLE /")}, CAST({_score} AS DOUBLE) AS emotion_score FROM w),
 scored AS (SELECT *, CASE WHEN emotion_word_count > 0 THEN emotion_score / emotion_word_count ELSE 0.0::DOUBLE END AS normalized_emotion_score FROM s0)"""
_BOUNDS = "bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS lower_, q3 + 1.5 * (q3 - q1) AS upper_ FROM (SELECT quantile_cont(emotion_score, 0.25) AS q1, quantile_cont(emotion_score, 0.75) AS q3 FROM scored))"
_INSIDE = f"{_BOUNDS}, inside AS (SELECT scored.* FROM scored, bounds WHERE emotion_score BETWEEN lower_ AND upper_)"


def _histogram(source: str, column: str, bins: int) -> str:
    return f"""ends AS (SELECT CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5 ELSE min({column}) END AS lo, CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5 ELSE max({column}) END AS hi FROM {source}),
 wide AS (SELECT lo, (hi - lo) / {bins} AS w FROM ends), put AS (SELECT CAST(least(floor(({column} - lo) / w), {bins - 1}) AS INTEGER) AS bin FROM {source}, wide)
 SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS lo, round(lo + (b.bin + 1) * w, 6) AS hi, (SELECT count(*) FROM put WHERE put.bin = b.bin) AS n FROM (SELECT unnest(range({bins})) AS bin) b, wide"""


def _regression(group: str, column: str) -> str:
    x, y = column, f"ratio_{group}"
    even = "sqrt(r * r) * (SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * pow(1 - r * r, k)) FROM (SELECT unnest(range((n - 2) // 2)) AS k))"
    odd = "2 / pi() * (asin(sqrt(r * r)) + sqrt(r * r) * sqrt(1 - r * r) * (SELECT coalesce(sum(exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(1 - r * r, k)), 0) FROM (SELECT unnest(range((n - 3) // 2)) AS k)))"
    return f"""{_SCORED}, r AS (SELECT regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, corr({y}, {x}) AS r, var_pop({x}) AS vx, var_pop({y}) AS vy, count(*) AS n FROM scored)
 SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(r * r, 6) AS r2, round(sqrt((1 - r * r) * vy / (vx * (n - 2))), 6) AS stderr, round(greatest(1 - CASE WHEN n % 2 = 0 THEN {even} ELSE {odd} END, 0), 6) AS p_value, n FROM r"""


def _missing(c: str) -> str:
    return f"{c} IN ({', '.join(_q(x) for x in MISSING)})"


def _frequencies(where: str) -> str:
    return f"""{_SCORED}, f AS (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(emotion_words, ', ')) AS word FROM scored) WHERE word <> '' {where} GROUP BY word)
 SELECT word, freq, round(freq::DOUBLE / (SELECT max(freq) FROM f), 6) AS weight FROM f ORDER BY freq DESC, word LIMIT 200"""


_TRANSLATED = f"""WITH {_values(TRANSLATION_ROWS, "t", "row_id, title, artist")},
 a AS (SELECT row_id, title, artist, coalesce(artist = '{TRANSLATIONS_ARTIST}', false) AND title IS NOT NULL AS mine, string_split(title, ' - ')[1] AS first, replace(title, '{TRANSLATION_MARK}', '') AS cut, replace(replace(title, '({TRANSLATION_MARK})', ''), '{TRANSLATION_MARK}', '') AS cut2 FROM t)
"""


def _fixed(artist: str, cut: str) -> str:
    rest = f"substr({cut}, len({artist}) + 1)"
    return f"{_TRANSLATED} SELECT row_id, CASE WHEN mine THEN {artist} ELSE artist END AS artist, CASE WHEN mine THEN trim(CASE WHEN starts_with({cut}, {artist}) AND regexp_matches({rest}, '^\\s*-\\s*') THEN regexp_replace({rest}, '^\\s*-\\s*', '') ELSE {cut} END) ELSE title END AS title FROM a"


_PAIRS = " UNION ALL ".join(f"SELECT 'count_{a}' AS a, 'count_{b}' AS b, corr(count_{a}, count_{b}) AS r FROM scored" for a in GROUPS for b in GROUPS)
_COUNTS_LONG = " UNION ALL ".join(f"SELECT row_id, title, 'count_{g}' AS \"group\", CAST(count_{g} AS BIGINT) AS cnt, {i} AS col FROM scored WHERE count_{g} > 0" for i, g in enumerate(GROUPS))
_means = "count(*) AS songs, round(avg(emotion_score), 6) AS mean_score, round(avg(normalized_emotion_score), 6) AS mean_normalized, round(avg(emotion_word_ratio), 6) AS mean_ratio"
_LEMMAS = {"haha": "ha", "things": "thing", "dogs": "dog", "tails": "tail", "erest": "er"}
_lemma = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEMMAS.items()) + " ELSE w END"
_PRE_A = f"""pre AS (SELECT row_id, title, artist, tag AS genre, year, views, {_pre("lyrics")} AS lyrics FROM numbered WHERE year BETWEEN 1980 AND 2024 AND lyrics IS NOT NULL AND language = 'en'),
 tok AS (SELECT *, {_stopped(_tokens("lyrics"))} AS tokens FROM pre),
 clean AS (SELECT * FROM tok WHERE len(tokens) > 0 QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY row_id) = 1)"""

ORACLES = {
    "dedupe_lines": f"{_BOTH} SELECT row_id, {_lines('lyrics')} AS lyrics FROM both_",
    "dedupe_lines_twice": f"{_BOTH} SELECT row_id, {_lines('lyrics', 2)} AS lyrics FROM both_",
    "clean_text": f"{_BOTH} SELECT row_id, {_clean('lyrics')} AS lyrics FROM both_",
    "slang": f"{_BOTH} SELECT row_id, {_slang(_clean('lyrics'))} AS lyrics FROM both_",
    "long_words": f"{_BOTH} SELECT row_id, {_short(_clean('lyrics'), 7)} AS lyrics FROM both_",
    "preprocess": f"{_BOTH} SELECT row_id, {_pre('lyrics')} AS lyrics FROM both_",
    "treebank_tokens": f"{_BOTH}, p AS (SELECT row_id, {_pre('lyrics')} AS lyrics FROM both_) SELECT row_id, {_joined(_tokens('lyrics'))} AS tokens FROM p",
    "stopword_filter": f"{_BOTH}, p AS (SELECT row_id, {_pre('lyrics')} AS lyrics FROM both_) SELECT row_id, {_joined(_stopped(_tokens('lyrics')))} AS tokens FROM p",
    "lemma_lookup": f"{_BOTH}, p AS (SELECT row_id, {_pre('lyrics')} AS lyrics FROM both_) SELECT row_id, {_joined(f'list_transform({_stopped(_tokens("lyrics"))}, lambda w: {_lemma})')} AS tokens FROM p",
    "year_filter": f"WITH {_SONGS} SELECT row_id, year FROM numbered WHERE year BETWEEN 1980 AND 2024",
    "language_filter": f"WITH {_SONGS} SELECT row_id, language FROM songs WHERE language = 'en'",
    "null_drop": f"WITH {_SONGS} SELECT row_id, year FROM numbered WHERE lyrics IS NOT NULL AND year IS NOT NULL AND language IS NOT NULL",
    "projection_a": f"WITH {_SONGS} SELECT row_id, title, artist, tag AS genre, year, views, language FROM songs",
    "projection_b": f"WITH {_SONGS} SELECT row_id, title, artist, year, CAST(row_id % 100 + 1 AS INTEGER) AS rank FROM songs",
    "translation_fix": _fixed("first", "cut"),
    "translation_fix_strict": _fixed("trim(first)", "cut2"),
    "dedupe_first": f"WITH {_SONGS} SELECT row_id, title, artist FROM songs QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY row_id) = 1",
    "clean_a": f"WITH {_SONGS}, {_PRE_A} SELECT row_id, title, artist, genre, year, views, lyrics, array_to_string(tokens, ' ') AS lyrics_tokens FROM clean",
    "clean_b": f"WITH {_SONGS}, {_TOKENS_B} SELECT row_id, title, artist, year, CAST(row_id % 100 + 1 AS INTEGER) AS rank, lyrics, array_to_string(tokens, ' ') AS lyrics_tokens FROM clean",
    "lexicon_emotion_counts": f"WITH {_LEXICON} SELECT emotion, count(*) AS n FROM lexicon WHERE association = 1 GROUP BY emotion",
    "lexicon_group_counts": f'WITH {_LEXICON} SELECT "group", count(*) AS n FROM mapped WHERE "group" IS NOT NULL GROUP BY "group"',
    "lexicon_groups": f'WITH {_LEXICON} SELECT word, l.emotion, "group" FROM lexicon l LEFT JOIN grouping_ g ON l.emotion = g.emotion',
    "word_groups": f"""WITH {_LEXICON} SELECT word, string_agg("group", ',' ORDER BY "group") AS groups FROM wg GROUP BY word""",
    "group_names": f'WITH {_LEXICON} SELECT DISTINCT "group" FROM wg',
    "song_stats": f"{_SCORED} SELECT row_id, title, artist, total_tokens, emotion_word_count, round(emotion_word_ratio, 6) AS emotion_word_ratio, emotion_words, {', '.join(f'count_{g}' for g in GROUPS)}, {', '.join(f'round(ratio_{g}, 6) AS ratio_{g}' for g in GROUPS)} FROM scored",
    "emotion_scores": f"{_SCORED} SELECT row_id, emotion_score, round(normalized_emotion_score, 6) AS normalized_emotion_score FROM scored",
    "score_detail": f"{_SCORED}, long AS ({_COUNTS_LONG}) SELECT row_id, substr(\"group\", 7) AS \"group\", cnt AS n FROM long",
    "matched_tokens": f"WITH {_SONGS}, {_TOKENS_B}, {_LEXICON} SELECT row_id, coalesce(array_to_string(list_filter(tokens, lambda t: list_contains([{', '.join(_q(w) for w in sorted({w for w, _, a in LEXICON_ROWS if a == 1}))}], t)), ', '), '') AS words FROM clean",
    "sentiment_class": f"{_SCORED} SELECT row_id, CASE WHEN emotion_score > 0 THEN 'positive' WHEN emotion_score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM scored",
    "group_totals": f"{_SCORED} " + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", CAST(sum(count_{g}) AS BIGINT) AS total FROM scored" for g in GROUPS),
    "group_mean_ratio": f"{_SCORED} " + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", round(avg(ratio_{g}), 6) AS mean_ratio FROM scored" for g in GROUPS),
    "group_mean_score": f"{_SCORED} " + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", round(avg(emotion_score) FILTER (WHERE count_{g} > 0), 6) AS mean_score FROM scored" for g in GROUPS),
    "count_correlation": f"{_SCORED} SELECT a, b, CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END AS r FROM ({_PAIRS})",
    "ratio_regression": _regression("anger", "emotion_score"),
    "ratio_regression_normalized": _regression("love", "normalized_emotion_score"),
    "iqr_filter": f"{_SCORED}, {_INSIDE} SELECT row_id, emotion_score FROM inside",
    "score_histogram": f"{_SCORED}, {_INSIDE}, {_histogram('inside', 'emotion_score', 30)}",
    "norm_histogram": f"{_SCORED}, {_histogram('scored', 'normalized_emotion_score', 7)}",
    "word_freq": _frequencies(""),
    "word_freq_group": _frequencies("AND word IN (SELECT word FROM wg WHERE \"group\" = 'anger')"),
    "top_songs": f"{_SCORED} SELECT row_id, title, artist, emotion_score FROM scored ORDER BY emotion_score DESC, row_id LIMIT 5",
    "bottom_songs": f"{_SCORED} SELECT row_id, title, artist, emotion_score FROM scored ORDER BY emotion_score, row_id LIMIT 5",
    "top_songs_no_outliers": f"{_SCORED}, {_INSIDE} SELECT row_id, title, artist, emotion_score FROM inside ORDER BY emotion_score DESC, row_id LIMIT 20",
    "top_songs_norm": f"{_SCORED} SELECT row_id, title, artist, round(normalized_emotion_score, 6) AS normalized_emotion_score, emotion_score FROM scored ORDER BY scored.normalized_emotion_score DESC, row_id LIMIT 10",
    "top_groups_per_song": f'{_SCORED}, long AS ({_COUNTS_LONG}) SELECT row_id, title, "group", cnt, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cnt DESC, col) AS rank FROM long) WHERE rank <= 3',
    "top_groups_for_title": f"{_SCORED}, long AS ({_COUNTS_LONG}) SELECT row_id, title, \"group\", cnt, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cnt DESC, col) AS rank FROM long WHERE row_id = (SELECT min(row_id) FROM scored WHERE title = 't52')) WHERE rank <= 5",
    "genre_counts": f"WITH {_SONGS} SELECT tag, count(*) AS n FROM songs WHERE tag IS NOT NULL GROUP BY tag",
    "top_artists": f"WITH {_SONGS} SELECT artist, count(*) AS n FROM songs WHERE artist IS NOT NULL GROUP BY artist ORDER BY n DESC, artist LIMIT 10",
    "year_counts": f"WITH {_SONGS} SELECT year, count(*) AS n FROM numbered WHERE year BETWEEN 1980 AND 2024 GROUP BY year",
    "distinct_artists": f"WITH {_SONGS} SELECT count(DISTINCT artist) AS n FROM songs",
    "distinct_years": f"WITH {_SONGS} SELECT DISTINCT year FROM numbered WHERE year BETWEEN 1980 AND 2024",
    "table_shape": f"WITH {_SONGS} SELECT count(*) AS n_rows, 8::INTEGER AS n_columns FROM songs",
    "trend_genre_decade": f"{_SCORED} SELECT artist, CAST(floor(year / 10.0) * 10 AS INTEGER) AS decade, {_means} FROM scored GROUP BY 1, 2",
    "trend_artist": f"{_SCORED} SELECT artist, {_means} FROM scored GROUP BY 1",
    "minmax_score": f"{_SCORED} SELECT row_id, round((emotion_score - (SELECT min(emotion_score) FROM scored)) / (SELECT max(emotion_score) - min(emotion_score) FROM scored), 6) AS scaled FROM scored",
    "kde": f"""{_SCORED}, sh AS (SELECT stddev_samp(emotion_score) * pow(count(*), -0.2) AS h, min(emotion_score) AS lo, max(emotion_score) AS hi FROM scored),
 g AS (SELECT lo + (hi - lo) * i / 199 AS x, h, lo, hi FROM sh, (SELECT unnest(range(200)) AS i)), v AS (SELECT emotion_score AS v, count(*) AS c FROM scored GROUP BY 1)
 SELECT round(x, 6) AS x, round(sum(c * exp(-0.5 * pow((x - v) / h, 2))) * (any_value(hi) - any_value(lo)) / 30 / (any_value(h) * sqrt(2 * pi())), 6) AS y FROM g, v GROUP BY x""",
    "regression_line": f"""{_SCORED}, r AS (SELECT regr_slope(ratio_anger, emotion_score) AS slope, regr_intercept(ratio_anger, emotion_score) AS intercept, corr(ratio_anger, emotion_score) AS r, var_pop(emotion_score) AS vx, var_pop(ratio_anger) AS vy, count(*) AS n, min(emotion_score) AS lo, max(emotion_score) AS hi, avg(emotion_score) AS mean FROM scored),
 g AS (SELECT *, lo + (hi - lo) * i / 99 AS x, sqrt((1 - r * r) * vy / (vx * (n - 2))) AS e FROM r, (SELECT unnest(range(100)) AS i))
 SELECT round(x, 6) AS x, round(intercept + slope * x, 6) AS y, round(intercept + slope * x - 2 * e * sqrt(vx + pow(x - mean, 2)), 6) AS low, round(intercept + slope * x + 2 * e * sqrt(vx + pow(x - mean, 2)), 6) AS high FROM g""",
    "sample_n": f"WITH {_SONGS} SELECT row_id FROM songs ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 100",
    "langid_filter": f"""WITH {_SONGS}, w AS (SELECT row_id, language, list_filter(regexp_split_to_array(lower(lyrics), '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+'), lambda x: x <> '') AS ws FROM songs WHERE lyrics IS NOT NULL)
 SELECT row_id, language FROM w WHERE len(ws) > 0 AND len(list_filter(ws, lambda x: list_contains([{", ".join(_q(w) for w in language.COMMON_ENGLISH)}], x))) >= 0.05::DOUBLE * len(ws)""",
    "tfidf_similar": f"""WITH {_SONGS}, {_TOKENS_B}, c AS (SELECT row_id, token, count(*) AS tf FROM (SELECT row_id, unnest(tokens) AS token FROM clean) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM c GROUP BY token),
 w AS (SELECT row_id, token, tf * ln(((SELECT count(*) FROM clean) + 1) / (df + 1)) AS weight FROM c JOIN d USING (token)), one AS (SELECT token, weight AS own FROM w WHERE row_id = 52),
 s AS (SELECT row_id, sqrt(sum(weight * weight)) AS norm, coalesce(sum(weight * own), 0) AS dot FROM w LEFT JOIN one USING (token) WHERE row_id <> 52 GROUP BY row_id)
 SELECT row_id, title, round(coalesce(dot / (norm * (SELECT sqrt(sum(own * own)) FROM one)), 0), 6) AS cosine FROM clean LEFT JOIN s USING (row_id) WHERE row_id <> 52 AND EXISTS (SELECT 1 FROM one) ORDER BY coalesce(dot / (norm * (SELECT sqrt(sum(own * own)) FROM one)), 0) DESC, row_id LIMIT 10""",
    "song_stats_rounded": f"{_SCORED} SELECT row_id, {', '.join(f'round_even({c}, 2) AS {c}' for c in ['emotion_word_ratio', *(f'ratio_{g}' for g in GROUPS)])} FROM scored",
    "group_mean_score_rounded": f"{_SCORED} " + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", round_even(avg(emotion_score) FILTER (WHERE count_{g} > 0), 2) AS mean_score FROM scored" for g in GROUPS),
    "lemma_rules": f"""WITH {_values([(w,) for w in LEMMA_WORDS], "known", "word")}, {_values(LEMMA_EXCEPTIONS, "odd", "word, lemma")}, {_values(LEMMA_TEXTS, "texts", "row_id, t")}, {_values(list(lemmas.NOUN_SUFFIXES.items()), "rules", "suffix, instead")},
 e AS (SELECT row_id, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS pos FROM texts), ws AS (SELECT DISTINCT word FROM e),
 forms AS (SELECT word, word AS lemma FROM ws UNION SELECT word, lemma FROM ws JOIN odd USING (word) UNION SELECT word, left(word, len(word) - len(suffix)) || instead FROM ws, rules WHERE ends_with(word, suffix) AND word NOT IN (SELECT word FROM odd)),
 best AS (SELECT word, arg_min(lemma, (len(lemma), lemma)) AS lemma FROM forms WHERE lemma IN (SELECT word FROM known) GROUP BY word)
 SELECT row_id, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS tokens FROM e LEFT JOIN best USING (word) GROUP BY row_id""",
    "default_columns": f"WITH {_SONGS} SELECT row_id, 'Unknown ' || CAST(row_number() OVER (ORDER BY row_id) AS VARCHAR) AS title, 'Unknown' AS artist FROM songs",
    "csv_songs_a": f"WITH {_SONGS} SELECT title, tag, artist, year, views, sha256(CASE WHEN {_missing('lyrics')} THEN '' ELSE coalesce(lyrics, '') END) AS lyrics_sha256, CASE WHEN {_missing('language')} THEN NULL ELSE language END AS language FROM songs",
    "csv_songs_b": f"WITH {_SONGS} SELECT title, artist, CAST(NULL AS VARCHAR) AS released, year, CAST(row_id % 100 + 1 AS INTEGER) AS rank, sha256(CASE WHEN {_missing('lyrics')} THEN '' ELSE coalesce(lyrics, '') END) AS lyrics_sha256 FROM songs",
    "csv_lists": f"WITH {_SONGS} SELECT row_id, CAST(len(string_split(lyrics, ' ')[1:5]) AS INTEGER) AS n, sha256(array_to_string(string_split(lyrics, ' ')[1:5], ' ')) AS words_sha256 FROM songs WHERE lyrics IS NOT NULL",
    "stage_parquet": f"WITH {_SONGS} SELECT row_id, year, year + 1 AS next_year FROM numbered WHERE year BETWEEN 1980 AND 2024",
    "lexicon_tsv": f"WITH {_values(LEXICON_ROWS, 'lexicon', 'word, emotion, association')} SELECT word, emotion, association FROM lexicon",
    "filler_words": f"WITH {_values([(w,) for w in FILLERS], 'words', 'word')} SELECT DISTINCT word FROM words",
}
