"""Articles: runs of paragraphs of a page, found by numbered headings or by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.layout import PAGE, upper_median

#: How a numbered article begins, number first or word first.
NUMBERED = (r"(?iu)^(\d+)[-]?\s*(?:modda|модда)[.\s]", r"(?iu)^(?:modda|модда)\s+(\d+)[.\s]")
HEADING_RATIO = 1.2


def article_number(text: Column) -> Column:
    """Number of the article that the text opens, or null."""
    own = F.trim(text)
    found = F.concat(*(F.regexp_extract(own, p, 1) for p in NUMBERED))
    return F.when(found != "", found)


def by_number(paragraphs: DataFrame, order: str = "para_no", text: str = "text") -> DataFrame:
    """Adds article_seq, article_id and method where the page has numbered articles; drops other pages."""
    page = W.partitionBy(*PAGE)
    upto = page.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = paragraphs.withColumn("_number", article_number(F.col(text)))
    marked = marked.withColumn("_any", F.count("_number").over(page)).filter("_any > 0")
    n = F.count("_number").over(upto)
    first_orphan = F.min(F.when(F.col("_number").isNotNull(), F.col(order))).over(page) > F.min(order).over(page)
    out = marked.withColumn("_n", n).withColumn("_orphan", first_orphan).withColumn("_last", F.last("_number", ignorenulls=True).over(upto))
    # paragraphs before the first heading are an article of their own
    return (
        out.withColumn("article_seq", F.col("_n") - F.when(F.col("_orphan"), 0).otherwise(1))
        .withColumn("article_id", F.when(F.col("_n") == 0, F.lit("block_0")).otherwise(F.concat("_last", F.lit("-modda"))))
        .withColumn("method", F.when(F.col("_n") == 0, F.lit("undetected")).otherwise(F.lit("regex")))
        .drop("_number", "_any", "_n", "_orphan", "_last")
    )


def by_heading(paragraphs: DataFrame, order: str = "para_no", fontsize: str = "fontsize", font: str | None = "font", ratio: float = HEADING_RATIO) -> DataFrame:
    """Adds article_seq, article_id, is_heading and method: a large or bold paragraph opens an article, if one is open."""
    page = W.partitionBy(*PAGE)
    w = page.orderBy(order)
    sizes = F.collect_list(fontsize).over(page)
    heading = F.col(fontsize) >= F.col("_median") * ratio
    if font:
        heading = heading | F.contains(F.lower(F.coalesce(F.col(font), F.lit(""))), F.lit("bold"))
    out = paragraphs.withColumn("_median", upper_median(sizes, 11.0)).withColumn("is_heading", heading).withColumn("_first", F.row_number().over(w) == 1)
    seq = F.sum(F.when(F.col("is_heading") & ~F.col("_first"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = out.withColumn("article_seq", seq)
    return out.withColumn("article_id", F.concat(F.lit("block_"), F.col("article_seq").cast("string"))).withColumn("method", F.lit("heading_heuristic")).drop("_median", "_first")


def segment(paragraphs: DataFrame, order: str = "para_no", text: str = "text", fontsize: str = "fontsize", font: str | None = None) -> DataFrame:
    """Numbered articles on pages that have them, headings on the others."""
    numbered = by_number(paragraphs, order, text)
    others = paragraphs.join(numbered.select(*PAGE).distinct(), list(PAGE), "left_anti")
    return numbered.unionByName(by_heading(others, order, fontsize, font).drop("is_heading"))


def article_texts(segmented: DataFrame, order: str = "para_no", text: str = "text") -> DataFrame:
    """(page, article): the text of all its paragraphs in order, as translation context."""
    grouped = segmented.groupBy(*PAGE, "article_seq", "article_id", "method").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("all"))
    return grouped.select(*PAGE, "article_seq", "article_id", "method", F.size("all").cast("long").alias("n_paragraphs"), F.array_join(F.transform("all", lambda p: p[text]), " ").alias("article_text"))
