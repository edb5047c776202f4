"""Exact dedup by two passes over a Bloom filter.

Pass one sends the filter cells of every row's text hash and keeps the cells hit
twice. Pass two shuffles only rows whose cells were all hit twice; every other
row is provably alone and passes straight through. Shuffled rows are grouped by
SHA-256, so false positives of the filter cost time and never change a result.

Nulls: a null text is the empty text. Ties: of rows with equal text and equal id
one stays. A null id is below every other. An empty table gives an empty result.
Extra columns are carried along; helper columns are named ``__pm_...``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bloom
from pagemill.llm.common import HIDE, cut, table, text_or_empty

#: Cells of the filter: 8 MB as a bitmap, 64 MB in a task that counts, whatever the input.
BITS = 1 << 26

HASH, SHA, MAYBE = HIDE + "hash", HIDE + "sha", HIDE + "maybe"


def _hash(text: str):
    return F.xxhash64(text_or_empty(text))


def candidates(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with the boolean column ``__pm_maybe``: can another row have this text?"""
    bitmap = bloom.repeated(docs.select(_hash(text).alias(HASH)), HASH, bits)
    return docs.withColumn(MAYBE, bloom.test(docs, bitmap, _hash(text)))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """One whole row for each distinct text: that of the largest id."""
    marked = candidates(docs, text, bits)
    alone = marked.filter(~F.col(MAYBE)).select(*docs.columns)
    order = F.struct(F.col(id_col).isNotNull(), F.col(id_col))
    # max_by has a map-side partial: a group with a third of all rows sends one row for each task
    kept = (
        marked.filter(MAYBE)
        .groupBy(F.sha2(text_or_empty(text), 256).alias(SHA))
        .agg(F.max_by(F.struct(*docs.columns), order).alias(HIDE + "row"))
        .select(*(F.col(HIDE + "row")[c].alias(c) for c in docs.columns))
    )
    return alone.unionByName(kept)


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """Every row's decision: id, keep_id, group_size, kept, text_sha256."""
    uid, best = HIDE + "uid", HIDE + "best"
    marked = cut(
        candidates(docs.select(id_col, text), text, bits).select(
            F.col(id_col), MAYBE, F.unhex(F.sha2(text_or_empty(text), 256)).alias(SHA), F.monotonically_increasing_id().alias(uid)
        )
    )
    shuffled = marked.filter(MAYBE)
    sizes = shuffled.groupBy(SHA).agg(
        F.max(F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col(uid).alias("uid"))).alias(best), F.count("*").alias("group_size")
    )
    # a plain join of two tables: adaptive execution splits the rows of a hot group
    joined = shuffled.join(cut(sizes), SHA, "left")
    out = joined.select(id_col, F.col(best)["id"].alias("keep_id"), "group_size", (F.col(best)["uid"] == F.col(uid)).alias("kept"), SHA)
    alone = marked.filter(~F.col(MAYBE)).select(id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), SHA)
    return out.unionByName(alone).select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex(SHA)).alias("text_sha256"))


def query(spark, sf_dir) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
