"""The plain functions as Arrow UDFs, for DataFrames and for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import normalize, ocr, sentences
from glyphmill.operators import slots
from glyphmill.shared import ship

STRING, LONG, STRINGS = T.StringType(), T.LongType(), T.ArrayType(T.StringType())
#: SQL name -> (function of one text, type of its result).
TEXT: dict[str, tuple[Callable, T.DataType]] = {
    "normalize_transliteration_a": (lambda t: normalize.transliteration(t, "A"), STRING),
    "normalize_transliteration_b": (lambda t: normalize.transliteration(t, "B"), STRING),
    "normalize_transliteration_c": (lambda t: normalize.transliteration(t, "C"), STRING),
    "normalize_translation": (normalize.translation, STRING),
    "normalize_output": (normalize.output, STRING),
    "nfkc": (normalize.nfkc, STRING),
    "lookup_form": (ocr.lookup_form, STRING),
    "block_hash": (ocr.block_hash, STRING),
    "lemma": (ocr.lemma, STRING),
    "gloss": (ocr.gloss, STRING),
    "without_line_numbers": (ocr.without_line_numbers, STRING),
    "translation_page": (lambda t: ocr.translation_page(t)[0], STRING),
    "transliteration_page": (lambda t: ocr.transliteration_page(t)[0], STRING),
    "slot_text": (lambda t: slots.slotted(t)[0], STRING),
    "split_sentences": (sentences.split, STRINGS),
    "sentence_endings": (sentences.endings, LONG),
    "sentence_count": (sentences.count, LONG),
    "single_sentence": (sentences.single, STRING),
    "first_sentence": (lambda t: sentences.single(t, "truncate"), STRING),
    "pack_sentences": (sentences.packed, STRINGS),
}


def wrapped(function: Callable, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action=None) if len(texts) else texts

    return run


def transliterations(c: Column) -> Column:
    """A struct of the variants A, B and C of a text, made at once."""

    @F.pandas_udf("A string, B string, C string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalize.transliterations(t) for t in texts], columns=["A", "B", "C"])

    return run(c)


def apply(name: str, c: Column) -> Column:
    """The function of that SQL name on a column."""
    return wrapped(*TEXT[name])(c)


def register(spark: SparkSession) -> None:
    """Make every function callable from SQL."""
    ship(spark)
    for name, spec in TEXT.items():
        spark.udf.register(name, wrapped(*spec))
