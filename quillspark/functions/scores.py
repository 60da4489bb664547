"""Importance, recency and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def source_prior(source: Column) -> Column:
    """How much a note's origin says about its worth before it is used."""
    return (
        F.when(source.isin("handwritten", "readwise_annotation"), 0.9).when(source == "share", 0.75).when(source == "manual", 0.7).when(source == "image", 0.6).otherwise(0.5)
    )


def importance(prior: Column, visits: Column, annotated: Column, spawns: Column) -> Column:
    """Earned worth, plus the prior fading with a half-life of 1.5 earned points."""
    earned = F.lit(0.1) * visits + F.lit(0.3) * annotated.cast("double") + F.lit(0.5) * spawns
    return prior * F.exp(F.lit(-LN2) * F.greatest(earned, F.lit(0.0)) / F.lit(1.5)) + earned


def dot(x: Column, y: Column) -> Column:
    """In double, left to right."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalize(x: Column) -> Column:
    """The vector at length one, in float; null if its length is 0 or not finite."""
    length = F.sqrt(dot(x, x))
    ok = (length > 0) & (length < F.lit(float("inf"))) & ~F.isnan(length)
    return F.when(ok, F.transform(x, lambda v: (v.cast("double") / length).cast("float")))


def corpus_key(model: Column, dims: Column, quantization: Column, layout: Column) -> Column:
    return F.concat(model, F.lit("|"), dims.cast("string"), F.lit("|"), quantization, F.lit("|"), layout)


def content_token(tag: Column, updated_at: Column) -> Column:
    """What a stored vector was made from: the content tag, or the row's stamp."""
    return F.coalesce(tag, F.concat(F.lit("u:"), F.coalesce(updated_at, F.lit(0)).cast("string")))
