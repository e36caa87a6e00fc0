"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's character classes and common words are counted in one pass over its whole text. The
documents of a language give that language's reference. A document fails if the Jensen-Shannon distance (square
root of the divergence in bits) of either histogram to the nearest reference is too large and the document is
long enough for the histogram to mean something.

Defined cases: a null or empty text has no words and fails the base rules; a null or unlisted language adds to
no reference, yet its documents are judged against the nearest one; without any reference (empty table) the
method rejects nothing; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, without, words, written

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Common words of the four languages.
COMMON = (
    "the of and to in is that for "
    "der die und den von zu das mit "
    "le les des et la un est que "
    "de el en los las y se del"
).split()
LANGUAGES = ("en", "de", "fr", "es")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20  # base rule
    max_repeat_percent: int = 30  # base rule
    window: int = 8
    guard_words: int = 100  # from here on the next two limits hold
    max_char_distance: float = 0.19
    max_word_distance: float = 0.255
    short_char_distance: float = 0.33  # limit for shorter documents, whose histograms are noisy


def features(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: the base measures and the two histograms, without the text."""
    k = rules.window
    common = "array(" + ",".join(f"'{w}'" for w in COMMON) + ")"
    listed = ",".join(f"'{w}'" for w in COMMON)
    step = only(docs, "doc_id", "lang", "text").select(
        "doc_id",
        "lang",
        F.expr("coalesce(text, '')").alias("t"),
        F.expr(words()).alias("w"),
        F.expr(r"regexp_replace(coalesce(text, ''), '\\p{Ll}+', '')").alias("r"),
    )
    step = step.select(
        "doc_id",
        "lang",
        F.expr("char_length(t)").alias("n_all"),
        F.expr("char_length(r)").alias("n_rest"),
        F.expr(r"char_length(regexp_replace(r, '[^\\x20\\x09-\\x0D]+', ''))").alias("n_space"),
        F.expr(r"char_length(regexp_replace(r, '[^#*$%&|<>]+', ''))").alias("n_sym"),
        F.expr(r"char_length(regexp_replace(r, '\\P{Lu}+', ''))").alias("n_upper"),
        F.expr(r"char_length(regexp_replace(r, '\\P{Nd}+', ''))").alias("n_digit"),
        F.expr("size(w)").alias("n_words"),
        F.expr(f"filter(w, x -> x in ({listed}))").alias("c"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("l"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    )
    step = step.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("n_all") - F.col("n_space")).alias("word_chars"),
        F.col("n_sym").alias("n_symbols"),
        F.expr("size(l) - size(array_distinct(l))").alias("n_dup_lines"),
        F.expr(
            "array(n_all - n_rest, n_upper, n_digit, n_space, n_sym, n_rest - n_upper - n_digit - n_space - n_sym)"
        ).alias("chars"),
        F.expr(f"transform({common}, x -> size(filter(c, y -> y = x)))").alias("listed"),
        F.expr(
            f"case when size(h) >= {k} then transform(sequence(1, size(h) - {k - 1}), i -> xxhash64(slice(h, i, {k}))) else array() end"
        ).alias("g"),
    )
    # Only a text with a repeated window is sorted: (hash, start), neighbours of equal hash kept, their starts in order.
    step = step.withColumn(
        "s",
        F.expr(
            "case when size(array_distinct(g)) < size(g) then array_sort(transform(g, (x, i) -> struct(x as h, i as i))) end"
        ),
    ).drop("g")
    step = step.withColumn(
        "p",
        F.expr(
            "array_sort(transform(filter(s, (x, i) -> (i > 0 and s[i - 1].h = x.h) or (i < size(s) - 1 and s[i + 1].h = x.h)), x -> x.i))"
        ),
    ).drop("s")
    return step.select(
        "doc_id",
        "lang",
        *[F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        F.expr(
            f"cast(coalesce({k} + aggregate(zip_with(slice(p, 2, greatest(size(p) - 1, 0)), slice(p, 1, greatest(size(p) - 1, 0)), (a, b) -> least({k}, a - b)), 0, (x, y) -> x + y), 0) as long)"
        ).alias("n_repeat_words"),
        F.expr("transform(chars, x -> cast(x as long))").alias("chars"),
        F.expr(
            "transform(concat(listed, array(n_words - aggregate(listed, 0, (x, y) -> x + y))), x -> cast(x as long))"
        ).alias("common"),
    ).withColumn(
        "base_failed",
        F.expr(
            f"n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words"
        ),
    )


def references(found: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> list[dict]:
    """Each listed language's histograms: the median share of every bin, over all its documents that pass the base rules.

    Medians of shares in thousandths: junk of less than half the documents doesn't move them, and the exact
    percentile keeps at most 1001 counts a bin. At most one row a language reaches the driver.
    """
    kinds = {"chars": 6, "common": len(COMMON) + 1}
    permille = "transform({0}, x -> cast(round(1000D * x / aggregate({0}, 0L, (p, q) -> p + q)) as int))"
    shares = found.where(F.col("lang").isin(*languages) & ~F.col("base_failed")).select(
        "lang", *[F.expr(permille.format(k)).alias(k) for k in kinds]
    )
    bins = [F.percentile(F.col(k)[i], 0.5).alias(f"{k}{i}") for k, n in kinds.items() for i in range(n)]
    rows = shares.groupBy("lang").agg(*bins).orderBy("lang").collect()
    scaled = lambda v: [x / (sum(v) or 1) for x in v]
    return [
        {"lang": r["lang"]} | {k: scaled([r[f"{k}{i}"] or 0.0 for i in range(n)]) for k, n in kinds.items()} for r in rows
    ]


def distance(counts: str, share: list[float]) -> str:
    """SQL: Jensen-Shannon distance of a count array to fixed shares; null without counts."""
    q = "array(" + ",".join(f"{x!r}D" for x in share) + ")"
    total = f"aggregate({counts}, 0L, (x, y) -> x + y)"
    half = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0D end"
    return (
        f"case when {total} > 0 then sqrt(greatest(0D, 0.5D * aggregate(zip_with(transform({counts}, x -> x / {total}), {q}, "
        f"(p, q) -> {half('p', 'q')} + {half('q', 'p')}), 0D, (x, y) -> x + y))) end"
    )


def judged(found: DataFrame, refs: list[dict], rules: Rules = Rules()) -> DataFrame:
    nearest = lambda kind: (
        "least(" + ",".join([distance(kind, r[kind]) for r in refs] + ["null"]) + ")" if refs else "cast(null as double)"
    )
    return (
        found.withColumn("char_distance", F.expr(nearest("chars")))
        .withColumn("word_distance", F.expr(nearest("common")))
        .withColumn(
            "kept",
            F.expr(
                f"not base_failed"
                f" and not (n_words >= {rules.guard_words} and coalesce(char_distance > {rules.max_char_distance}D, false))"
                f" and not (n_words >= {rules.guard_words} and coalesce(word_distance > {rules.max_word_distance}D, false))"
                f" and not coalesce(char_distance > {rules.short_char_distance}D, false)"
            ),
        )
    )


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document: the measures, both distances and the verdict."""
    found = written(features(docs, rules), "quality")
    return judged(found, references(found), rules).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("char_distance", 6).alias("char_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


def kept(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns. A null doc_id is judged as its own key; equal ids with different texts are each judged, and a text stays if any row of its id passes."""
    verdicts = quality(docs, rules).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return without(docs, verdicts.where("not kept"))
