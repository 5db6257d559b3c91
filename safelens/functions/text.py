"""Normalisation of texts. Native expressions, with Arrow functions only for the rows that need them."""

from __future__ import annotations

import base64
import binascii
import html
import re
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace as Unicode has it, with U+001C..U+001F.
SPACE, NOT_SPACE = r"(?U)[\s\x1c-\x1f]", r"(?U)[^\s\x1c-\x1f]"
# What the normaliser removes, counts and looks for.
ZERO_WIDTH = "[​‌‍﻿]"
TAG_CHARACTERS = r"[\x{E0000}-\x{E007F}]"
SEPARATORS = r"([\-=_*~#.])\1{9,}"
BASE64_SPAN = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=])"
EXCESSIVE_ZERO_WIDTH = 5
DECODED_SPANS, DECODED_CHARACTERS, PRINTABLE = 4, 512, 0.8
_ZERO_WIDTH, _TAGS = re.compile(ZERO_WIDTH), re.compile("[\U000e0000-\U000e007f]")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE.replace('(?U)', '(?U)^')}+|{SPACE.removeprefix('(?U)')}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(NOT_SPACE)


def decode_text(text: str) -> dict:
    """NFKC, removal of invisible characters, HTML entities, percent escapes."""
    work = unicodedata.normalize("NFKC", text)
    work, invisible = _ZERO_WIDTH.subn("", work)
    work, tags = _TAGS.subn("", work)
    return {"work": urllib.parse.unquote(html.unescape(work)), "invisible": invisible, "tags": tags}


@F.pandas_udf(T.StructType([T.StructField("work", T.StringType()), T.StructField("invisible", T.IntegerType()), T.StructField("tags", T.IntegerType())]))
def _decoded(texts: pd.Series) -> pd.DataFrame:
    empty = {"work": None, "invisible": None, "tags": None}
    return pd.DataFrame([empty if t is None else decode_text(t) for t in texts], columns=list(empty)).astype({"invisible": "Int32", "tags": "Int32"})


def decode_spans(spans) -> list[str]:
    out = []
    for span in list(spans)[:DECODED_SPANS]:
        if len(span) % 4:
            continue
        try:
            text = base64.b64decode(span, validate=True).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError):
            continue
        if text and sum(c.isprintable() or c in " \n\t" for c in text) >= PRINTABLE * len(text):
            out.append(text[:DECODED_CHARACTERS])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spans_decoded(spans: pd.Series) -> pd.Series:
    return spans.map(lambda s: None if s is None else decode_spans(s))


FLAGS = ("zero_width_removed", "tag_chars_removed", "excessive_zero_width", "excessive_separators", "base64_span_count", "suspicious_base64", "base64_decoded_count")


def normalize(df: DataFrame, text: str = "text") -> DataFrame:
    """Add model_text, detection_text, text_hash and flags to the rows; blank texts get nulls.

    Plain ASCII without ``&`` and ``%`` never leaves the JVM.
    """
    valid = F.when(~is_blank(F.col(text)), F.col(text))
    needs = F.col("__text").rlike(r"[^\x00-\x7F]|[&%]")
    out = df.withColumn("__text", valid).withColumn("__decoded", _decoded(F.when(needs, F.col("__text"))))
    work = F.coalesce("__decoded.work", "__text")
    out = out.withColumn("__work", work).withColumn("__model", F.trim(F.regexp_replace("__work", SPACE + "+", " ")))
    out = out.withColumn("__spans", F.regexp_extract_all("__model", F.lit(BASE64_SPAN), 0))
    out = out.withColumn("__plain", _spans_decoded(F.when(F.size("__spans") > 0, F.slice("__spans", 1, DECODED_SPANS))))
    found = F.coalesce(F.size("__plain"), F.lit(0))
    found = F.when(F.col("__plain").isNull(), 0).otherwise(found)
    flags = F.struct(
        F.coalesce("__decoded.invisible", F.lit(0)).alias("zero_width_removed"),
        F.coalesce("__decoded.tags", F.lit(0)).alias("tag_chars_removed"),
        (F.coalesce("__decoded.invisible", F.lit(0)) >= EXCESSIVE_ZERO_WIDTH).alias("excessive_zero_width"),
        F.col("__work").rlike(SEPARATORS).alias("excessive_separators"),
        F.size("__spans").alias("base64_span_count"),
        (F.size("__spans") > 0).alias("suspicious_base64"),
        F.when(found > 0, found).alias("base64_decoded_count"),
    )
    detection = F.when(found > 0, F.concat_ws(" ", F.lower("__model"), F.lower(F.array_join("__plain", " ")))).otherwise(F.lower("__model"))
    out = out.withColumns({"model_text": F.col("__model"), "detection_text": detection, "text_hash": F.sha2("__model", 256), "flags": F.when(F.col("__text").isNotNull(), flags)})
    return out.drop("__text", "__decoded", "__work", "__model", "__spans", "__plain")


def split_valid(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason)."""
    blank = is_blank(F.col(text))
    return df.filter(~blank), df.filter(blank).withColumn("reason", F.lit("text is empty"))
