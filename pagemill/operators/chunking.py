"""Sentences, chunks under a token budget, and batches for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.core import let

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "г.", "ул.", "др.", "пр.", "т.", "стр.", "с.", "п.", "доц.", "проф.", "акад.", "канд.", "док.", "тел.", "факс",
    "e.g.", "i.e.", "etc.", "vs.", "p.", "pp.", "vol.", "ed.", "dept.", "st.", "ave.", "blvd.",
    "Dr.", "Mr.", "Mrs.", "Ms.", "Jr.", "Sr.", "Inc.", "Ltd.", "Co.",
)
#: A full stop that is no end of a sentence, while splitting.
HELD = "․"
#: Fixed value: where a sentence ends and the next begins.
BOUNDARY = r"""(?<=[.!?…])\s+(?=[A-ZА-ЯЁ0-9"'`(«])"""
BUDGET_SHARE = 0.78
#: Values of a numeric order that one window ranks.
STRETCH = 1 << 16


def sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Trimmed, non-empty sentences. An abbreviation counts as a whole word only."""
    held = text
    if abbreviations:
        words = "|".join(a[:-1].replace(".", "\\.") for a in abbreviations if a.endswith("."))
        held = F.regexp_replace(held, rf"(?<![\p{{L}}\p{{N}}])({words})\.", f"$1{HELD}")
    parts = F.transform(F.split(held, BOUNDARY), lambda s: T.strip_ends(F.replace(s, F.lit(HELD), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def word_length(text: Column) -> Column:
    """Default token length: words between white space."""
    return F.size(T.tokens(text))


def budget(most: int) -> int:
    return int(BUDGET_SHARE * most)


def pack(units: Column, length, most: int) -> Column:
    """Joins units greedily, in order, while a chunk has at most ``most`` tokens; a longer unit stands alone.

    The fold runs over lengths and keeps where chunks begin; texts are joined once.
    """
    start = F.struct(F.array().cast("array<int>").alias("first"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["first"]) > 0) & (a["n"] + x["n"] <= most)
        return F.when(fits, F.struct(a["first"].alias("first"), (a["n"] + x["n"]).alias("n"))).otherwise(F.struct(F.concat(a["first"], F.array(x["i"])).alias("first"), x["n"].alias("n")))

    def cut(p: Column) -> Column:
        end = lambda k: F.coalesce(F.get(p["first"], k + 1), F.size(p["units"]))
        return F.transform(p["first"], lambda i, k: F.array_join(F.slice(p["units"], i + 1, end(k) - i), " "))

    def fold(u: Column) -> Column:
        lengths = F.transform(u, lambda s, i: F.struct(i.alias("i"), length(s).alias("n")))
        return let(F.struct(u.alias("units"), F.aggregate(lengths, start, step)["first"].alias("first")), cut)

    return let(units, fold)


def sentence_chunks(text: Column, most: int = 512, length=word_length, limit: int | None = None) -> Column:
    """The text itself if it is within the budget, else its sentences packed."""
    limit = budget(most) if limit is None else limit
    return F.when(length(text) <= limit, F.array(text)).otherwise(pack(sentences(text), length, limit))


def token_chunks(text: Column, most: int) -> Column:
    """Runs of ``most`` words."""

    def cut(words: Column) -> Column:
        count = F.ceil(F.size(words) / most).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i * most + 1, F.lit(most)), " "))

    return let(T.tokens(text), cut)


def _ranked(df: DataFrame, key: tuple[str, ...], part: Column, order: list) -> DataFrame:
    """Adds ``_rank`` (from 0) by ``part`` and then ``order`` within each key: a part is one window, ranks go on from the parts before.

    Only counts by (key, part) are ordered as a whole.
    """
    rows = df.withColumn("_part", part)
    counts = rows.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"_key_{k}") for k in key), F.col("_part").alias("_of"), before.alias("_before"))
    same = F.col("_part").eqNullSafe(F.col("_of"))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    inside = F.row_number().over(W.partitionBy(*key, "_part").orderBy(*order))
    return rows.join(counts, same).withColumn("_rank", F.col("_before") + inside - 1).select(*df.columns, "_rank")


def length_batches(df: DataFrame, length: Column, order: str, size: int = 8, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds batch_id: rows of like length together, ties in order, within each key."""
    return _ranked(df, key, length, [order]).withColumn("batch_id", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def count_batches(df: DataFrame, order: str, size: int = 8, key: tuple[str, ...] = ()) -> DataFrame:
    """Adds batch_id: runs of ``size`` rows in order, within each key (a language pair, so a batch has one).

    Numbers are ordered in stretches of ``STRETCH``; anything else in one window a key.
    """
    number = df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long", "double", "float", "decimal")
    part = F.floor(F.col(order) / STRETCH) if number else F.lit(0)
    return _ranked(df, key, part, [order]).withColumn("batch_id", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")
