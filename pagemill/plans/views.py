"""Derived views that the catalog's queries share, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.tables import lines as split_lines
from pagemill.sources.tables import table

PAGE_WIDTH, PAGE_HEIGHT, PER_PAGE = 612.0, 792.0, 40

LINES_SQL = """lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents)"""

#: Geometry from line numbers; every value is exact in binary. Every third document has two columns.
LAYOUT_SQL = (
    LINES_SQL
    + """, placed AS (
  SELECT doc_id, lang, line, line_no, line_no // 40 AS page_no, line_no % 40 AS slot,
         CASE WHEN doc_id % 3 = 0 THEN (line_no % 40) // 20 ELSE 0 END AS c,
         CASE WHEN doc_id % 3 = 0 THEN (line_no % 40) % 20 ELSE line_no % 40 END AS r
  FROM lines), boxed AS (
  SELECT *, (72 + 300 * c)::DOUBLE AS x0, (72 + 300 * c + least(2.5::DOUBLE * length(line), 100.0::DOUBLE))::DOUBLE AS x1,
         (20 + 16 * r + 25 * (r // 8))::DOUBLE AS y0,
         CASE WHEN length(line) < 40 THEN 14.0::DOUBLE ELSE 11.0::DOUBLE END AS fontsize
  FROM placed), layout AS (
  SELECT doc_id, lang, line, line_no, page_no, x0, y0, x1, y0 + fontsize AS y1, fontsize FROM boxed)"""
)

#: Each document with the one of the next id, as source and target of a translation.
PAIRS_SQL = """pairs AS (
  SELECT a.doc_id, a.text AS src, b.text AS tgt FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
  UNION ALL SELECT doc_id + 1000000000, text, text FROM documents WHERE doc_id % 10 = 0)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return split_lines(documents(spark, folder))


def layout(spark: SparkSession, folder: str) -> DataFrame:
    found = lines(spark, folder)
    slot = F.col("line_no") % PER_PAGE
    two = F.col("doc_id") % 3 == 0
    placed = found.select(
        "doc_id", "lang", "line", "line_no", F.expr(f"line_no div {PER_PAGE}").alias("page_no"),
        F.when(two, F.floor(slot / 20)).otherwise(0).alias("c"), F.when(two, slot % 20).otherwise(slot).alias("r"),
        F.when(F.length("line") < 40, 14.0).otherwise(11.0).alias("fontsize"),
    )
    x0, y0 = (F.col("c") * 300 + 72).cast("double"), (F.col("r") * 16 + F.expr("r div 8") * 25 + 20).cast("double")
    boxed = placed.select("doc_id", "lang", "line", "line_no", "page_no", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.length("line") * F.lit(2.5), F.lit(100.0))).alias("x1"), (y0 + F.col("fontsize")).alias("y1"), "fontsize")
    return boxed


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("tgt"))
    shifted = docs.select("doc_id", F.col("text").alias("src")).join(following, "doc_id").select("doc_id", "src", "tgt")
    same = docs.filter("doc_id % 10 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.col("text").alias("src"), F.col("text").alias("tgt"))
    return shifted.unionByName(same)
