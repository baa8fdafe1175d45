"""Named plug-ins and their SQL names."""

from __future__ import annotations

import inspect
import unicodedata
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text, unicode


class Registry:
    """Names, whatever their case, to things that make something."""

    def __init__(self, what: str):
        self.what, self._made = what, {}

    def register(self, name: str, made: Callable, *, override: bool = False) -> Callable:
        key = name.strip().lower()
        if key in self._made and not override:
            raise ValueError(f"{self.what} {name!r} is there already")
        self._made[key] = made
        return made

    def get(self, name: str) -> Callable:
        key = name.strip().lower()
        if key not in self._made:
            raise KeyError(f"no {self.what} {name!r}; there are {self.keys()}")
        return self._made[key]

    def create(self, name: str, **options: Any) -> Any:
        made = self.get(name)
        known = inspect.signature(made).parameters
        if unknown := [o for o in options if o not in known]:
            raise TypeError(f"{self.what} {name!r} takes no {unknown}")
        return made(**options)

    def from_config(self, config: str | dict) -> Any:
        """A name, or a mapping of `type` and options."""
        if isinstance(config, str):
            return self.create(config)
        options = dict(config)
        return self.create(options.pop("type"), **options)

    def unregister(self, name: str) -> None:
        self._made.pop(name.strip().lower())

    def keys(self) -> list[str]:
        return sorted(self._made)


normalizers = Registry("normalizer")
for _form in ("nfc", "nfd", "nfkc", "nfkd"):
    normalizers.register(_form, lambda form=_form.upper(): lambda c: unicode.normal_form(c, form))
normalizers.register("lowercase", lambda: unicode.casefold)
normalizers.register("whitespace", lambda: text.clean_whitespace)
normalizers.register("strip_accents", lambda: unicode.strip_accents)
normalizers.register("digits", lambda: text.ascii_digits)


def normalize(column, *steps: str | dict):
    """A chain of normalizers over a column."""
    for step in steps:
        column = normalizers.from_config(step)(column)
    return column


def register_sql(spark: SparkSession) -> None:
    """SQL functions: expressions over columns as SQL macros need no registering; these need Python."""

    @F.pandas_udf("array<string>")
    def sentences(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [t[a:b] for a, b in unicode.sentence_spans(t)])

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    spark.udf.register("sentences", sentences)
    spark.udf.register("nfc", nfc)
