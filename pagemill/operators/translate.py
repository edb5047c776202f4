"""Content-addressed translation: probe the cache, translate what is missing once, write it back.

The model is injected: ``translate(texts, source, target) -> texts``, called once for
each Arrow batch on the executors, on distinct texts only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import chunking
from pagemill.sources import tables


class EngineError(RuntimeError):
    """A model gave no usable output."""


class ModelLoadError(EngineError):
    """A model could not be loaded."""


#: Models that this process has loaded, by the name of their loader.
_LOADED: dict[str, Callable[[list[str], str, str], list[str]]] = {}


def loaded_once(load: Callable[[], Callable[[list[str], str, str], list[str]]]) -> Callable[[list[str], str, str], list[str]]:
    """A model for ``run_model`` that each Python worker loads at its first text and then keeps; a failure is a ``ModelLoadError``."""
    name = uuid.uuid4().hex

    def translate(texts: list[str], source: str, target: str) -> list[str]:
        from pagemill.operators import translate as own

        if name not in own._LOADED:
            try:
                own._LOADED[name] = load()
            except Exception as error:
                raise ModelLoadError(f"the model could not be loaded: {error}") from error
        return own._LOADED[name](texts, source, target)

    return translate


def mock_translation(text: Column, target: str) -> Column:
    """The deterministic stand-in: the target's code in brackets, and the text."""
    return F.concat(F.lit(f"[{T.LANGUAGE_CODES[target]}]"), text)


def keyed(items: DataFrame, source: str, target: str, text: str = "text", glossary: str | None = None, composed: bool = False) -> DataFrame:
    """Adds ``key``; ``composed`` says that texts are in NFKC already."""
    value = F.col(text) if composed else T.nfkc(F.col(text))
    return items.withColumn("key", T.cache_key(F.lit(source), F.lit(target), value, None if glossary is None else F.lit(glossary)))


def probe(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with their cached translation, null where there is none."""
    return items.join(cache.select("key", F.col("translated_text").alias("cached")), "key", "left")


def misses(items: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) that the cache lacks, each key once."""
    return items.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min(text).alias(text))


def upsert(cache: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The cache with new rows; of equal keys the new one counts, of several new ones that of the greatest ``order``, a column of ``new``."""
    extra = F.lit(None).cast("string") if order is None else F.col(order)
    both = cache.withColumn("_v", F.struct(F.lit(0).alias("new"), F.lit(None).cast(new.schema[order].dataType if order else "string").alias("at")))
    both = both.unionByName(new.withColumn("_v", F.struct(F.lit(1).alias("new"), extra.alias("at"))).select(*cache.columns, "_v"))
    row = F.struct(*cache.columns)
    return both.groupBy("key").agg(F.max_by(row, F.struct("_v", "translated_text")).alias("r")).select("r.*")


def write_cache(cache: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and returns its path; readers of the old one are not disturbed."""
    place = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    cache.write.parquet(place)
    return place


def run_model(texts: DataFrame, translate: Callable[[list[str], str, str], list[str]], source: str, target: str, text: str = "text", batch: int = 8, most: int | None = 512, length=chunking.word_length) -> DataFrame:
    """(key, translated_text): chunks of sentences within ``most`` tokens, as ``length`` counts them, go to the model in batches of like length.

    An empty output is an error. A text of several chunks is their translations, in order.
    """
    src, tgt = T.LANGUAGE_CODES[source], T.LANGUAGE_CODES[target]
    parts = F.array(F.col(text)) if most is None else chunking.sentence_chunks(F.col(text), most, length)
    chunks = texts.select("key", F.posexplode(parts).alias("chunk_no", "chunk"))

    def run(batches):
        import pandas as pd

        for rows in batches:
            rows = rows.iloc[rows["chunk"].str.len().argsort(kind="stable")]
            out: list[str] = []
            for i in range(0, len(rows), batch):
                part = rows["chunk"].iloc[i : i + batch].tolist()
                got = translate(part, src, tgt)
                if len(got) != len(part) or any(not g for g, p in zip(got, part, strict=True) if p.strip()):
                    raise EngineError("the model returned an empty translation")
                out += got
            yield pd.DataFrame({"key": rows["key"].to_numpy(), "chunk_no": rows["chunk_no"].to_numpy(), "out": out})

    made = chunks.mapInPandas(run, "key string, chunk_no int, out string")
    if most is None:
        return made.select("key", F.col("out").alias("translated_text"))
    grouped = made.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "out"))).alias("all"))
    return grouped.select("key", F.array_join(F.transform("all", lambda c: c["out"]), " ").alias("translated_text"))


def run_model_with_confidence(texts: DataFrame, translate: Callable[[list[str], str, str], list[tuple[str, float | None]]], source: str, target: str, text: str = "text") -> DataFrame:
    """(key, translated_text, confidence) of whole texts, cut to sentences within the budget: the mean over a text's chunks, 1 where the model gives none."""
    src, tgt = T.LANGUAGE_CODES[source], T.LANGUAGE_CODES[target]
    chunks = texts.select("key", F.posexplode(chunking.sentence_chunks(F.col(text))).alias("chunk_no", "chunk"))

    def run(batches):
        import pandas as pd

        for rows in batches:
            got = translate(rows["chunk"].tolist(), src, tgt)
            yield pd.DataFrame({"key": rows["key"], "chunk_no": rows["chunk_no"], "out": [g for g, _ in got], "sure": [1.0 if c is None else float(c) for _, c in got]})

    made = chunks.mapInPandas(run, "key string, chunk_no int, out string, sure double")
    grouped = made.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "out"))).alias("all"), F.avg("sure").alias("confidence"))
    joined = grouped.select("key", F.array_join(F.transform("all", lambda c: c["out"]), " ").alias("translated_text"), "confidence")
    return texts.select("key").join(joined, "key", "left").select("key", "translated_text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def finish(translated: Column, original: Column, target: str) -> Column:
    """Case of the original, and typography where the target is Russian."""
    cased = T.restore_case(original, translated)
    return T.strip_ends(T.russian_typography(cased) if target == "ru" else cased)


def translate_cached(items: DataFrame, cache: DataFrame, translate, source: str, target: str, text: str = "text", batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """(items with ``translation``, new cache rows)."""
    known = keyed(items, source, target, text)
    new = run_model(misses(known, cache, text), translate, source, target, text, batch)
    new = new.select("key", "translated_text", F.lit(1).alias("schema_version"), F.lit(None).cast("string").alias("glossary_hash"))
    merged = cache.select("key", "translated_text").unionByName(new.select("key", "translated_text"))
    out = known.join(merged, "key", "left").withColumn("translation", finish(F.col("translated_text"), F.col(text), target))
    return out.drop("translated_text"), new


def skip_translated(items: DataFrame, in_language: Column) -> tuple[DataFrame, DataFrame]:
    """(to translate, already in the target language): split by a filter, so no model runs on the second."""
    known = F.coalesce(in_language, F.lit(False))
    return items.filter(~known), items.filter(known)


def benchmark(corpus: DataFrame, engines: list[str], text: str = "text") -> DataFrame:
    """(engine, item, output): every engine on every pair; mock engines put their name in front."""
    names = F.explode(F.array(*map(F.lit, engines)))
    return corpus.select("*", names.alias("engine")).withColumn("output", F.concat(F.lit("["), F.col("engine"), F.lit("] "), F.col(text)))


def validation_pairs(spark: SparkSession, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """A corpus of checked pairs (source text, reference, languages)."""
    rows = spark.createDataFrame(pairs, "source_text string, reference_translation string, source_lang string, target_lang string")
    return rows.withColumn("domain", F.lit("legal")).withColumn("verified_by", F.lit("manual"))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_cache(spark, path)
