"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLING = "bcdfghjkmnpqrtv"


def tokens(text: Column) -> Column:
    """Stretches between line breaks, Unicode separators and punctuation; symbols and tabs do not split."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\n\r\p{Z}\p{P}]+"), lambda t: t != "")


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def undouble(w: Column) -> Column:
    return F.regexp_replace(w, rf"([{DOUBLING}])\1$", "$1")


def stem(word: Column) -> Column:
    """A light stem: plural endings first, then -ing and -ed; words of up to three letters are only lowered."""
    w = F.lower(word)
    plural = (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(_cut(w, 3), F.lit("y")))
        .when(w.endswith("sses"), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1))
        .otherwise(w)
    )
    verb = lambda p: F.when(p.endswith("ing") & (F.length(p) > 5), undouble(_cut(p, 3))).when(p.endswith("ed") & (F.length(p) > 4), undouble(_cut(p, 2))).otherwise(p)
    return F.when(F.length(w) <= 3, w).otherwise(verb(plural))


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def edit_bound(term: Column) -> Column:
    """How many edits a query term tolerates."""
    return F.least(F.lit(6), F.round(F.length(term) * F.lit(0.2)).cast("int"))


def match_weight(query: Column, term: Column) -> Column:
    """1 for equal terms; a longer term that begins with the query weighs by its excess; else by edit distance."""
    n = F.length(term).cast("double")
    bound = edit_bound(query)
    near = F.levenshtein(query, term)
    prefix = F.lit(0.375) * n / (n + F.lit(0.3) * (n - F.length(query)))
    close = (bound > 0) & (F.abs(F.length(term) - F.length(query)) <= bound)
    fuzzy = F.when(close & (near <= bound) & (near > 0), F.lit(0.45) * n / (n + near)).otherwise(0.0)
    return F.when(query == term, 1.0).when(term.startswith(query), prefix).otherwise(fuzzy)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalized(text: Column, unicode: bool = True) -> Column:
    """Compatibility form, lowered, white space collapsed, controls dropped, trailing punctuation cut.

    Spark has no NFKC; the Arrow function runs only with `unicode`, which ASCII columns can turn off.
    """
    base = _nfkc(text) if unicode else text
    spaced = F.regexp_replace(F.lower(base), r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(spaced, r"\p{Cc}", "")), r"\p{P}+$", ""))


def slug(name: Column, prefix: str = "", owner: Column | None = None) -> Column:
    """Lower-case letters and digits, other runs as one underscore, none at the ends."""
    body = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    parts = [F.lit(prefix), body] + ([F.lit("_"), owner] if owner is not None else [])
    return F.concat(*parts)


def normalize_isbn(text: Column) -> Column:
    """Digits and X, upper case, if they have the shape of an ISBN-10 or ISBN-13; else null."""
    kept = F.regexp_replace(F.upper(text), "[^0-9X]", "")
    return F.when(kept.rlike("^([0-9]{9}[0-9X]|[0-9]{13})$"), kept)


def cover_by_isbn(isbn: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/isbn/"), isbn, F.lit("-L.jpg"))


def cover_by_id(cover: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/id/"), cover.cast("string"), F.lit("-L.jpg"))


def membership_id(collection: Column, note: Column) -> Column:
    return F.concat(collection, F.lit(":"), note)


def iso_millis(ms: Column) -> Column:
    """UTC with milliseconds; the session's zone has to be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def string_items(json: Column) -> Column:
    """The string elements of a JSON array; anything else is an empty array."""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    kept = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def truthy(json: Column) -> Column:
    """Of a JSON value: true, a number other than 0, or a string other than '', 'false' and '0'."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    as_text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", ~as_text.isin("", "false", "0"))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def token_subject(token: Column) -> Column:
    """`sub` of a signed token's middle part; null if it can't be read."""
    part = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.sub")


def remap_tags(tags: Column, renames: dict[str, str]) -> Column:
    """Each tag under its new name, repeats dropped, the first kept."""
    if not renames:
        return F.array_distinct(tags)
    table = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
    return F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t)))
