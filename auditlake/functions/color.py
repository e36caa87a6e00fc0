"""Colours as struct<r, g, b, a>: parsing, compositing, WCAG luminance and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(css: Column) -> Column:
    """#rgb, #rrggbb, rgb() and rgba(); null for anything else."""
    text = F.lower(F.trim(css))
    hex6 = F.when(text.rlike("^#[0-9a-f]{6}$"), F.substring(text, 2, 6)).when(
        text.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(text, 2, 3), "(.)", "$1$1")
    )
    channel = lambda k: F.conv(F.substring(hex6, 2 * k + 1, 2), 16, 10).cast("double")
    numbers = F.regexp_extract_all(text, F.lit(r"([0-9.]+)"), F.lit(1))
    part = lambda k: F.get(numbers, F.lit(k)).try_cast("double")
    struct = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))
    return F.when(hex6.isNotNull(), struct(channel(0), channel(1), channel(2), F.lit(1.0))).when(
        text.rlike(r"^rgba?\("), struct(part(0), part(1), part(2), F.coalesce(part(3), F.lit(1.0)))
    )


def over(front: Column, back: Column) -> Column:
    """front composited on an opaque back."""
    mix = lambda k: front[k] * front["a"] + back[k] * (1 - front["a"])
    return F.struct(mix("r").alias("r"), mix("g").alias("g"), mix("b").alias("b"), F.lit(1.0).alias("a"))


def luminance(color: Column) -> Column:
    def linear(v: Column) -> Column:
        s = v / 255.0
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(color["r"]) + 0.7152 * linear(color["g"]) + 0.0722 * linear(color["b"])


def contrast(one: Column, two: Column) -> Column:
    a, b = luminance(one), luminance(two)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def hexed(color: Column) -> Column:
    return F.format_string("#%02x%02x%02x", *[F.round(color[k]).cast("int") for k in "rgb"])


def required(size: Column, weight: Column) -> Column:
    """3 for large text (24 px, or 18.66 px and bold), else 4.5."""
    heavy = F.when(F.lower(weight) == "bold", 700).otherwise(F.coalesce(weight.try_cast("int"), F.lit(400)))
    return F.when((size >= 24) | ((size >= 18.66) & (heavy >= 700)), 3.0).otherwise(4.5)


def accessible(front: Column, back: Column, norm: Column) -> Column:
    """The nearest colour towards black or white, in steps of one hundredth, whose contrast reaches the norm."""
    toward = F.when(luminance(back) > 0.18, 0.0).otherwise(255.0)
    step = lambda i: F.struct(*[(front[k] + (toward - front[k]) * i / 100).alias(k) for k in "rgb"], F.lit(1.0).alias("a"))
    return hexed(F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(100)), step), lambda c: contrast(c, back) >= norm), F.lit(0)))
