"""The text and header rules as column functions: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DEFAULT_STOP_WORDS


def normalized(text: Column) -> Column:
    """Compatibility forms, letters and numbers only, lower case."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        from .text import normalize

        return values.map(normalize, na_action="ignore")

    return run(text)


def analyzed(word: Column, stop: frozenset[str] = DEFAULT_STOP_WORDS) -> Column:
    """The stem of a word, empty if it is a stop word or has none."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        from .text import analyze_word

        return values.map(lambda w: analyze_word(w, stop), na_action="ignore")

    return run(word)


def resolved(base: Column, href: Column) -> Column:
    """The absolute http(s) address of a link on a page, else null."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        from .page import resolve

        return pd.Series([resolve(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    return run(base, href)


def modified_at(headers: Column, now: datetime) -> Column:
    """When a response with these headers (map) was modified."""

    @F.pandas_udf("timestamp")
    def run(values: pd.Series) -> pd.Series:
        from .page import modified

        return pd.Series([modified(dict(v or {}), now) for v in values], dtype="datetime64[us, UTC]")

    return run(headers)


def media_type(header: Column) -> Column:
    """A content type as struct of kind and params (map)."""

    @F.pandas_udf("kind string, params map<string,string>")
    def run(values: pd.Series) -> pd.DataFrame:
        from .page import content_type

        return pd.DataFrame([content_type(v or "") for v in values], columns=["kind", "params"])

    return run(header)


def decoded(body: Column, header: Column) -> Column:
    """S3: the text of a body, by its header, its own declaration, or UTF-8."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        from .page import decode

        return pd.Series([decode(bytes(b), h or "") for b, h in zip(bodies, headers, strict=True)], dtype=object)

    return run(body, header)
