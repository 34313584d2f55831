"""Normalization, keys and predicates of loosely typed text columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.scales import ALPHABET


#: Characters but the sharp s whose upper case is several characters, and the one that each becomes where a text keeps its length.
LONG_UPPER = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1 and c != "\u00df")
ONE_UPPER = "".join(c.title() if len(c.title()) == 1 else c for c in LONG_UPPER)


def upper(c: Column) -> Column:
    """Upper case, character by character, so that a text keeps its length (``F.upper`` makes two letters of a sharp s)."""

    def whole(t: Column) -> Column:
        pieces = F.split(t, f"(?<=[{LONG_UPPER}])|(?=[{LONG_UPPER}])")  # few texts have any of them
        one = F.transform(pieces, lambda s: F.when(s.rlike(f"^[{LONG_UPPER}]"), F.translate(s, LONG_UPPER, ONE_UPPER)).otherwise(F.upper(s)))
        return F.when(F.length(F.upper(t)) > F.length(t), F.array_join(one, "")).otherwise(F.upper(t))

    return F.element_at(F.transform(F.array(F.replace(c, F.lit("\u00df"), F.lit("\u1e9e"))), whole), 1)  # the lambda's variable is worked out once


def lower(c: Column) -> Column:
    """Lower case, character by character: a sigma is the same at a word's end, and a dotted I becomes one letter."""
    return F.lower(F.translate(c, "\u03a3\u0130", "\u03c3i"))


def canonical_text(c: Column) -> Column:
    """Trimmed, upper-case, without blanks; null if nothing is left."""
    return F.nullif(upper(F.replace(F.trim(c), F.lit(" "), F.lit(""))), F.lit(""))


def is_sequence(c: Column, alphabet: str = ALPHABET, at_least: int = 1) -> Column:
    return F.coalesce(c.rlike(f"^[{alphabet}]+$") & (F.length(c) >= at_least), F.lit(False))


def slug(c: Column) -> Column:
    """Lower case; every run of other characters becomes one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def finite(c: Column) -> Column:
    """The number, or null where the text is none or isn't finite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def binary_label(c: Column, positive: tuple[str, ...] = ("1", "1.0", "true", "yes", "fail", "failure", "positive"), negative: tuple[str, ...] = ("0", "0.0", "false", "no", "pass", "working", "negative")) -> Column:
    token = F.lower(F.trim(c.cast("string")))
    return F.when(token.isin(*positive), 1).when(token.isin(*negative), 0)


def mapped(c: Column, table: dict[str, str], default: Column | None = None, trimmed: bool = True) -> Column:
    """The table's value for the trimmed (or else the whole) lower-case text."""
    key = lower(F.trim(c) if trimmed else c)
    if not table:
        return key if default is None else default
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return F.coalesce(found, key if default is None else default)


def content_key(*parts: Column, length: int = 64) -> Column:
    """Hex sha256 of the parts joined by a zero character (null as empty)."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def paired_key(a: Column, b: Column, length: int = 16, separator: str = "|") -> Column:
    """A key of two texts that are both there, else null."""
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(both, F.substring(F.sha2(F.concat_ws(separator, a, b), 256), 1, length))


def study_and_metric(file: Column) -> tuple[Column, Column]:
    """What stands before the first and after the last underscore of a file's stem."""
    stem = F.regexp_replace(F.regexp_replace(file, "^.*/", ""), r"\.[^.]*$", "")
    return F.substring_index(stem, "_", 1), F.substring_index(stem, "_", -1)


VOLATILE = ("timestamp", "created_at", "updated_at", "fetched_at", "fetch_timestamp_utc", "ingested_at")


def canonical_json(payload: dict, exclude: tuple[str, ...] = VOLATILE) -> str:
    """Compact ASCII JSON with sorted keys, without the excluded keys at any depth."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in exclude}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(payload), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_hash(json_text: Column) -> Column:
    """sha256 of the canonical form of a JSON object (built-in JSON writing differs in numbers, nulls and escapes)."""

    def canon(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical_json(json.loads(t)))

    return F.sha2(F.pandas_udf(canon, "string")(json_text), 256)
