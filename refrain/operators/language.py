"""Detected language as a filter. The model is the caller's: anything with detect(texts) -> labels."""

import sys
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the fallback: frequent English words. It is no substitute for a trained model.
COMMON_ENGLISH = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was"]


class Detector(Protocol):
    def detect(self, texts: list[str]) -> list[str]: ...


class CommonWords:
    """`en` if at least `share` of the words are frequent English words, else `other`."""

    def __init__(self, share: float = 0.05):
        self.share = share

    def detect(self, texts: list[str]) -> list[str]:
        known = set(COMMON_ENGLISH)
        out = []
        for t in texts:
            words = t.lower().split()
            out.append("en" if words and sum(w in known for w in words) >= self.share * len(words) else "other")
        return out


_loaded: dict[Callable, Detector] = {}


def _detector(load: Callable[[], Detector]) -> Detector:
    """Made once in each Python worker, if `load` has an importable name; else once in each pass. A model's file reaches
    the executors with SparkContext.addFile, and load() finds it with SparkFiles.get."""
    if getattr(sys.modules.get(load.__module__), getattr(load, "__qualname__", ""), None) is not load:
        return load()
    if load not in _loaded:
        _loaded[load] = load()
    return _loaded[load]


def is_language(load: Callable[[], Detector] = CommonWords, language: str = "en") -> Callable[[Column], Column]:
    """A Column function: whether the detector's label is `language`. The detector gets the texts of a batch at once, and one by
    one if it fails on them. Null and texts on which it fails are False. Line ends reach it as spaces."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = _detector(load)

        def single(text: str) -> str | None:
            try:
                return detector.detect([text])[0]
            except Exception:  # a text that the model can't take is not of the language
                return None

        for batch in batches:
            out = pd.Series(False, index=batch.index)
            texts = batch.dropna().str.replace("\n", " ")
            try:
                labels = detector.detect(texts.tolist()) if len(texts) else []
                if len(labels) != len(texts):
                    raise ValueError("not a label for each text")
            except Exception:  # some text stops the batch
                labels = [single(t) for t in texts]
            out[texts.index] = [x == language for x in labels]
            yield out

    return F.pandas_udf(run, "boolean")


def english_only(df: DataFrame, column: str = "lyrics", load: Callable[[], Detector] = CommonWords) -> DataFrame:
    """Rows whose text is English. Native filters belong before this one: Catalyst moves them below it in any case."""
    return df.where(is_language(load)(F.col(column)))
