"""Mechanical checks of translations and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.core import let

RATIO = (0.85, 1.6)
BACK_LEAST = 0.4
REASONS = ("numeric_mismatch", "length_ratio_outlier", "source_lang_bleed", "ngram_repetition", "lid_failed")
CHECKLIST = (
    "layout: tables, images and boxes of output and input match",
    "spot check: 10-15 % of the segments that were not flagged",
    "typography: guillemets and no-break spaces",
    "sign off if all of these pass",
)


def numbers(text: Column) -> Column:
    """Distinct digit runs that are words of their own."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\d+\b"), F.lit(0)))


def numeric_mismatch(source: Column, target: Column) -> Column:
    return F.size(F.array_except(numbers(source), numbers(target))) > 0


def length_ratio(source: Column, target: Column) -> Column:
    """Words of the target over words of the source; null for a source without words."""
    n = F.size(T.tokens(source))
    return F.when(n > 0, F.size(T.tokens(target)) / n)


def length_outlier(source: Column, target: Column, band: tuple[float, float] = RATIO) -> Column:
    ratio = length_ratio(source, target)
    return F.coalesce((ratio < band[0]) | (ratio > band[1]), F.lit(False))


def source_bleed(target: Column, language: Column) -> Column:
    return (language == "ru") & F.rlike(target, F.lit("[OoGg]['ʻ]|[Nn]g"))


def repeats(target: Column) -> Column:
    """Three equal words in a row."""

    def thrice(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) >= 3, F.exists(at, lambda i: (F.get(w, i) == F.get(w, i + 1)) & (F.get(w, i) == F.get(w, i + 2)))).otherwise(F.lit(False))

    return let(T.tokens(target), thrice)


def identified(text: Column, language: Column, identify=None, least: float = 0.8) -> Column:
    """Is the text in the language? Null, not false, without a model; ``identify(text)`` gives (label, confidence), or None if it can't tell."""
    if identify is None:
        return F.lit(None).cast("boolean")

    @F.pandas_udf("boolean")
    def run(texts, languages):
        import pandas as pd

        found = (identify(t) for t in texts)
        return pd.Series([None if f is None else f[0] == want and f[1] >= least for f, want in zip(found, languages, strict=True)], dtype=object)

    return run(text, language)


def reasons(source: Column, target: Column, language: Column, in_language: Column | None = None, unknown_fails: bool = False) -> Column:
    """Array of reasons, in a fixed order. ``unknown_fails`` flags rows whose language nobody could tell."""
    known = F.lit(None).cast("boolean") if in_language is None else in_language
    failed = (numeric_mismatch(source, target), length_outlier(source, target), source_bleed(target, language), repeats(target), ~F.coalesce(known, F.lit(not unknown_fails)))
    return F.array_compact(F.array(*(F.when(f, F.lit(name)) for f, name in zip(failed, REASONS, strict=True))))


def tier1(df: DataFrame, source: str = "src", target: str = "tgt", language: Column | None = None, **options) -> DataFrame:
    """Adds reasons, flagged and tier2_required."""
    language = F.lit("ru") if language is None else language
    out = df.withColumn("reasons", reasons(F.col(source), F.col(target), language, **options))
    return out.withColumn("flagged", F.size("reasons") > 0).withColumn("tier2_required", F.size("reasons") > 0)


def tier2(checked: DataFrame, back: str = "back", source: str = "src", clears_all: bool = False) -> DataFrame:
    """Second look at flagged rows by their back-translation in ``back``; null where it failed or did not run.

    A poor overlap adds a reason. A good one clears soft reasons: what a language
    model could get wrong, never a number that is missing. ``clears_all`` clears every flag.
    """
    score = F.when(F.col("tier2_required") & F.col(back).isNotNull(), T.char_overlap(F.col(source), F.col(back)))
    hard = F.array(F.lit("numeric_mismatch"))
    out = checked.withColumn("overlap_score", score).withColumn("tier2_executed", F.col("overlap_score").isNotNull())
    good = F.coalesce(F.col("overlap_score") >= BACK_LEAST, F.lit(False))
    poor = F.coalesce(F.col("overlap_score") < BACK_LEAST, F.lit(False))
    kept = F.filter("reasons", lambda r: r != "lid_failed")
    out = out.withColumn("reasons", F.when(good, kept).when(poor, F.array_append("reasons", F.lit("back_translation_mismatch"))).otherwise(F.col("reasons")))
    cleared = F.lit(False) if clears_all else F.arrays_overlap("reasons", hard)
    return out.withColumn("flagged", F.when(good, cleared).otherwise(F.col("flagged")))


def glossary_kept(source: Column, target: Column, locks: Column) -> Column:
    """Does the target have every locked term whose source term occurs? ``locks``: array of struct (source, target)."""
    return F.forall(locks, lambda k: ~F.contains(source, k["source"]) | F.contains(target, k["target"]))


def glossary_target(terms: DataFrame, glossary: DataFrame, term: str = "term") -> DataFrame:
    """Terms with their locked translation, null if they are not locked."""
    return terms.join(glossary.select(F.col("source").alias(term), F.col("target").alias("locked")), term, "left")


def release_gate(report: DataFrame) -> DataFrame:
    """One row: passed, n_flagged, n_rows, summary."""
    flagged = F.lower(F.col("flagged").cast("string")) == "true"
    out = report.agg(F.count_if(flagged).alias("n_flagged"), F.count("*").alias("n_rows"))
    passed = F.col("n_flagged") == 0
    summary = F.when(passed, F.concat(F.lit("PASS: 0 unresolved flags across "), F.col("n_rows").cast("string"), F.lit(" segments."))).otherwise(
        F.concat(F.lit("FAIL: Unresolved flags: "), F.col("n_flagged").cast("string"), F.lit(" / "), F.col("n_rows").cast("string"))
    )
    return out.select(passed.alias("passed"), "n_flagged", "n_rows", summary.alias("summary"))


def mean_confidence(logits: Column) -> Column:
    """Mean over steps of the largest softmax share; 1 for none. ``logits``: array of arrays."""
    top = lambda row: let(F.array_max(row).cast("double"), lambda most: 1.0 / F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - most)))
    n = F.size(logits)
    return F.when(n > 0, F.aggregate(F.transform(logits, top), F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(1.0))
