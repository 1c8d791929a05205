"""Lyric cleaning and tokens as Column functions: no Python runs on the executors."""

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .resources import FILLERS, SLANG, STOPWORDS

#: White space and line ends as Unicode has them; Java's \s and . know fewer.
SPACE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LONGEST_WORD = 24

#: What separates words: any white space; in a text that went through clean(), where no other is left, a single space is found without a
#: pattern.
ANY_SPACE, ONE_SPACE = f"[{SPACE}]+", " "

_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: What clean() drops of ASCII: all but letters, apostrophes and white space.
_DROPPED = "".join(c for c in map(chr, range(128)) if not (c.isalpha() or c == "'" or c in _SPACES))

#: Penn Treebank splitting, of the published rules those that can match letters, spaces and apostrophes.
TREEBANK_OPEN = [(r"([ ])('{2})", "$1 `` "), (r"([^'])' ", "$1 ' ")]
TREEBANK = [
    (r"''", " '' "),
    (r"([^' ])('s|'m|'d|') ", "$1 $2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", "$1 $2 "),
    (r"\b(can)(not)\b", " $1 $2 "),
    (r"\b(d)('ye)\b", " $1 $2 "),
    (r"\b(gim)(me)\b", " $1 $2 "),
    (r"\b(gon)(na)\b", " $1 $2 "),
    (r"\b(got)(ta)\b", " $1 $2 "),
    (r"\b(lem)(me)\b", " $1 $2 "),
    (r"\b(more)('n)\b", " $1 $2 "),
    (r"\b(wan)(na)(?=\s)", " $1 $2 "),
    (r" ('t)(is)\b", " $1 $2 "),
    (r" ('t)(was)\b", " $1 $2 "),
]


def _replace(c: Column, pattern: str, to: str, needle: str) -> Column:
    """regexp_replace() where the text has the needle, which every match has: a plain search costs far less than the pattern.
    The lambda evaluates c once."""
    return F.get(F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit(needle)), F.regexp_replace(x, pattern, to)).otherwise(x)), 0)


def _needle(pattern: str) -> str:
    """The letters of a contraction's two groups; an apostrophe for the other rules."""
    groups = re.match(r"(?:\\b| )\(([a-z']+)\)\(([a-z']+)\)", pattern)
    return groups[1] + groups[2] if groups else "'"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def dedupe_lines(c: Column, keep: int = 1) -> Column:
    """Stripped lines, the first `keep` of each different one, joined by a space; null gives an empty text."""
    lines = F.filter(F.transform(F.split(_or_empty(c), LINE_END, -1), strip), lambda x: x != "")
    if keep == 1:
        kept = F.array_distinct(lines)
    elif keep < 1:
        kept = F.array().cast("array<string>")
    else:
        kept = F.filter(lines, lambda x, i: F.size(F.filter(F.slice(lines, F.lit(1), i + 1), lambda y: y == x)) <= keep)
    return F.array_join(kept, " ")


def clean(c: Column) -> Column:
    """Without bracketed tags; ASCII letters, spaces and apostrophes only; spaces collapsed; lower case.

    Characters are mapped, and patterns have one range at most: a class that joins several, as [^a-zA-Z'] does, took eight times the
    CPU time on eight threads (it seems that Java 17 checks a type for each character, in a cache line that all threads write to)."""
    x = F.regexp_replace(_or_empty(c), r"(?d)\[.*?\]", " ")
    x = F.translate(x, "’‘" + _SPACES + _DROPPED, "''" + " " * len(_SPACES))
    x = F.regexp_replace(x, r"[^\x00-\x7f]+", "")
    return F.lower(F.trim(F.regexp_replace(x, " +", " ")))


def slang(c: Column, table: dict[str, str] = SLANG) -> Column:
    """Whole-word replacements, one after the other."""
    for word, standard in table.items():
        c = _replace(c, rf"\b{word}\b", standard, word)
    return c


def drop_long_words(c: Column, longest: int = LONGEST_WORD, space: str = ANY_SPACE) -> Column:
    return F.array_join(F.filter(F.split(c, space, -1), lambda w: (w != "") & (F.length(w) <= longest)), " ")


def preprocess(c: Column) -> Column:
    """Lines, cleaning, slang, long words, in this order; null gives an empty text."""
    return drop_long_words(slang(clean(dedupe_lines(c))), space=ONE_SPACE)


def treebank(c: Column, space: str = ANY_SPACE) -> Column:
    """Tokens of a cleaned text."""
    for pattern, to in TREEBANK_OPEN:
        c = _replace(c, pattern, to, "'")
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, to in TREEBANK:
        c = _replace(c, pattern, to, _needle(pattern))
    return F.filter(F.split(c, space, -1), lambda w: w != "")


def drop_stopwords(tokens: Column, stopwords: Iterable[str] | None = None) -> Column:
    """Without the words of a set (English stopwords and fillers by default), whatever their case."""
    words = sorted({*STOPWORDS, *FILLERS} if stopwords is None else set(stopwords))
    return F.filter(tokens, lambda w: ~F.lower(w).isin(words))


def lemmatize(tokens: Column, lemmas: dict[str, str] | Column | None = None) -> Column:
    """Each token's lemma where the map has one. Without a map, tokens stay as they are."""
    if lemmas is None:
        return tokens
    if isinstance(lemmas, dict):
        if not lemmas:
            return tokens
        lemmas = F.create_map(*(F.lit(x) for pair in sorted(lemmas.items()) for x in pair))
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(lemmas, w), w))


def tokenize(c: Column, stopwords: Iterable[str] | None = None, lemmas: dict[str, str] | Column | None = None, space: str = ANY_SPACE) -> Column:
    """Tokens, without stopwords, then lemmas, which are not filtered again; null gives no tokens."""
    return F.coalesce(lemmatize(drop_stopwords(treebank(c, space), stopwords), lemmas), F.array().cast("array<string>"))


def join_words(words: Column) -> Column:
    return F.array_join(words, ", ")


def split_words(c: Column) -> Column:
    return F.split(c, ", ", -1)


def capitalize(c: Column) -> Column:
    """First character in upper, all others in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2_147_483_647)))
