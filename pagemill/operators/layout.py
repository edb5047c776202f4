"""Page layout: noise filters, reading order, de-hyphenation, paragraphs, tables.

Everything is keyed by (doc_id, page_no) with explicit ordinals; a page is a bounded
group, so page-wide rules run on arrays inside one row after one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T

HEADER, FOOTER = 0.05, 0.95
WATERMARK_OPACITY, WATERMARK_LIGHT = 0.5, 0.85
LINE_GAP, INDENT, INDENT_LEAST = 1.2, 3.0, 20.0
COLUMN_GAP, COLUMN_GAP_LEAST, SPANNING = 2.0, 30.0, 1.5

PAGE = ("doc_id", "page_no")


def is_header_or_footer(y0: Column, y1: Column, height: Column | float) -> Column:
    height = F.lit(height) if isinstance(height, float) else height
    return (y0 < height * F.lit(HEADER)) | (y1 > height * F.lit(FOOTER))


def is_watermark(opacity: Column, color: Column | None = None) -> Column:
    """Faint, or nearly white in all channels; a missing opacity is 1, a missing color black."""
    faint = F.coalesce(opacity, F.lit(1.0)) < WATERMARK_OPACITY
    if color is None:
        return faint
    light = [F.coalesce(color[c], F.lit(0.0)) > WATERMARK_LIGHT for c in "rgb"]
    return faint | (light[0] & light[1] & light[2])


def spans(pages: DataFrame) -> DataFrame:
    """One row a span of the text blocks that are no header, footer or watermark; span watermarks and spans without box go."""
    blocks = pages.select(*PAGE, "height", F.explode("blocks").alias("b")).filter(F.col("b.lines").isNotNull())
    blocks = blocks.filter(~is_header_or_footer(F.col("b.bbox.y0"), F.col("b.bbox.y1"), F.col("height")) & ~is_watermark(F.col("b.opacity"), F.col("b.color")))
    found = blocks.select(*PAGE, F.col("b.block_no").alias("block_no"), F.explode("b.lines").alias("l"))
    found = found.select(*PAGE, "block_no", F.col("l.line_no").alias("line_no"), F.explode("l.spans").alias("s"))
    return found.filter(F.col("s.bbox").isNotNull() & ~is_watermark(F.col("s.opacity"), F.col("s.color")))


def lines_of_spans(found: DataFrame) -> DataFrame:
    """Lines from spans in order; lines without text go. A line with a formula font or formula characters is math."""
    own = F.col("s")
    math = T.is_math_font(own["font"]) | T.has_math_unicode(own["text"])
    keyed = found.withColumn("m", math)
    grouped = keyed.groupBy(*PAGE, "block_no", "line_no").agg(
        F.array_sort(F.collect_list("s")).alias("spans"), F.bool_or("m").alias("is_math"),
        F.min("s.bbox.x0").alias("x0"), F.min("s.bbox.y0").alias("y0"), F.max("s.bbox.x1").alias("x1"), F.max("s.bbox.y1").alias("y1"),
    )
    text = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    first = F.element_at("spans", 1)
    return grouped.withColumn("text", text).filter(F.length(F.trim("text")) > 0).withColumn("fontsize", first["size"]).withColumn("font", first["font"])


def merge_drop_cap(spans_: Column) -> Column:
    """Joins a large first letter with the span it belongs to."""
    a, b = F.element_at(spans_, 1), F.element_at(spans_, 2)
    drop = (F.size(spans_) >= 2) & (F.length(a["text"]) == 1) & (a["size"] >= b["size"] * 1.5) & (a["y1"] >= b["y0"])
    joined = F.struct(
        F.concat(a["text"], b["text"]).alias("text"), b["size"].alias("size"), F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"),
        F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"),
    )
    return F.when(drop, F.concat(F.array(joined), F.slice(spans_, F.lit(3), F.greatest(F.size(spans_) - 2, F.lit(0))))).otherwise(spans_)


def upper_median(values: Column, default: float) -> Column:
    """The middle value, the upper of two; ``values`` is an array."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(default))


def reading_order(blocks: DataFrame, ordinal: str = "block_no") -> DataFrame:
    """(doc_id, page_no, ordinal, col, is_spanning, reading_pos): columns found by gaps between block centres."""
    item = F.struct(F.col(ordinal).alias("no"), "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), (F.col("x1") - F.col("x0")).alias("w"))
    pages = blocks.groupBy(*PAGE).agg(F.collect_list(item).alias("all"))
    pages = pages.withColumn("gap", F.greatest(upper_median(F.transform("all", lambda b: b["w"]), 50.0) * COLUMN_GAP, F.lit(COLUMN_GAP_LEAST)))
    pages = pages.withColumn("cs", F.array_sort(F.transform("all", lambda b: b["cx"])))
    middle = F.transform("cs", lambda c, i: F.when((i > 0) & (c - F.get("cs", i - 1) > F.col("gap")), (c + F.get("cs", i - 1)) / 2))
    pages = pages.withColumn("seps", F.filter(middle, lambda s: s.isNotNull()))
    # the column of a block is the number of separators left of its centre
    pages = pages.withColumn("all", F.transform("all", lambda b: F.struct(b["no"].alias("no"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["w"].alias("w"), F.size(F.filter("seps", lambda s: s <= b["cx"])).alias("col"))))
    of = lambda k, c: F.transform(F.filter("all", lambda b: b["col"] == k), lambda b: b[c])
    extents = F.transform(F.sequence(F.lit(0), F.size("seps")), lambda k: F.array_max(of(k, "x1")) - F.array_min(of(k, "x0")))
    pages = pages.withColumn("extent", F.aggregate(extents, F.lit(0.0), lambda a, x: a + x) / (F.size("seps") + 1))
    wide = lambda b: (F.size("seps") > 0) & (b["w"] > F.col("extent") * SPANNING)
    # spanning blocks come first, top down; then columns from the left
    key = lambda b: F.struct(F.when(wide(b), 0).otherwise(1).alias("r"), F.when(wide(b), 0).otherwise(b["col"]).alias("c"), b["y0"].alias("y0"), b["x0"].alias("x0"), b["no"].alias("no"), b["col"].alias("col"))
    return pages.select(*PAGE, F.posexplode(F.array_sort(F.transform("all", key))).alias("p", "b")).select(
        *PAGE, F.col("b.no").alias(ordinal), F.col("b.col").cast("long").alias("col"), (F.col("b.r") == 0).alias("is_spanning"), F.col("p").cast("long").alias("reading_pos")
    )


def dehyphenate(lines: DataFrame, key: tuple[str, ...] = ("doc_id",), order: str = "line_no", text: str = "line", carry: dict[str, Column] | None = None) -> DataFrame:
    """Chains of lines joined over word-breaking hyphens: (key, first ordinal, n_lines, text) and what ``carry`` aggregates of a chain.

    A line that is nothing but a hyphen ends its chain.
    """
    w = W.partitionBy(*key).orderBy(order)
    flagged = lines.withColumn("m", F.coalesce(T.joins_next(F.lag(text).over(w), F.col(text)), F.lit(False)))
    flagged = flagged.withColumn("next_m", F.coalesce(F.lead("m").over(w), F.lit(False)))
    flagged = flagged.withColumn("chain", F.sum(F.when(F.col("m"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    part = F.when(F.col("next_m"), T.hyphen_core(F.col(text))).otherwise(F.col(text))
    part = F.when(F.col("m"), T.left_stripped(part)).otherwise(part)
    more = [c.alias(n) for n, c in (carry or {}).items()]
    grouped = flagged.withColumn("part", part).groupBy(*key, "chain").agg(F.array_sort(F.collect_list(F.struct(order, "part"))).alias("parts"), F.min(order).alias("_first"), *more)
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text")
    return grouped.select(*key, F.col("_first").alias(order), F.size("parts").cast("long").alias("n_lines"), joined, *(carry or {}))


def merged_lines(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """Lines of a page with broken words joined: a chain has the box of all its lines, the first one's size and every other attribute of the first.

    A formula line is no part of a chain.
    """
    first = {c: F.min_by(c, order) for c in lines.columns if c not in (*PAGE, order, text, "x0", "y0", "x1", "y1")}
    box = {"x0": F.min("x0"), "y0": F.min("y0"), "x1": F.max("x1"), "y1": F.max("y1")}
    # an ordinal of its own for each side of a formula keeps chains apart
    turn = F.sum(F.when(F.col("is_math"), 1).otherwise(0)).over(W.partitionBy(*PAGE).orderBy(order))
    apart = lines.withColumn("_turn", F.when(F.col("is_math"), -turn).otherwise(turn))
    return dehyphenate(apart, (*PAGE, "_turn"), order, text, box | first).drop("_turn", "n_lines").withColumnRenamed("text", text)


def ordered(lines: DataFrame, block: str = "block_no") -> DataFrame:
    """Lines renumbered over the page in reading order: by their blocks' places, then inside the block."""
    blocks = lines.groupBy(*PAGE, block).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    places = reading_order(blocks, block).select(*PAGE, block, "reading_pos")
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("reading_pos", "line_no")) - 1
    return lines.join(places, [*PAGE, block]).withColumn("line_no", place.cast("long")).drop("reading_pos")


def cluster_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Adds ``para_no`` (from 0 on each page): a new paragraph starts after a gap or a change of indent."""
    w = W.partitionBy(*PAGE).orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("x0", "y1", "fontsize")}
    near = (F.col("y0") - before["y1"] < before["fontsize"] * LINE_GAP) & (F.abs(F.col("x0") - before["x0"]) < F.greatest(before["fontsize"] * INDENT, F.lit(INDENT_LEAST)))
    starts = F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)
    return lines.withColumn("_starts", starts).withColumn("para_no", F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1).drop("_starts")


def build_paragraphs(clustered: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """One row a paragraph: box, first line's font size, text without list marker, and the marker.

    Where lines have them, also font, colour and direction of the first line. Where lines
    are told to be formulas, a paragraph of nothing else ``is_math``; in others each
    formula line is a placeholder, and ``math_spans`` has the originals in their order.
    """
    extra = [c for c in ("font", "color", "dir") if c in clustered.columns]
    math = "is_math" in clustered.columns
    part = F.struct(order, F.trim(text).alias("t"), *(["is_math"] if math else []))
    grouped = clustered.groupBy(*PAGE, "para_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("fontsize", order).alias("fontsize"), F.count("*").alias("n_lines"),
        F.array_sort(F.collect_list(part)).alias("parts"), *(F.min_by(c, order).alias(c) for c in extra), *([F.bool_and("is_math").alias("is_math")] if math else []),
    )
    found = F.filter("parts", lambda p: p["t"] != "")
    if not math:
        grouped = grouped.withColumn("whole", F.array_join(F.transform(found, lambda p: p["t"]), " "))
        return grouped.select(*PAGE, "para_no", "x0", "y0", "x1", "y1", "fontsize", "n_lines", T.list_marker(F.col("whole")).alias("marker"), T.without_marker(F.col("whole")).alias("text"), *extra)
    # the private-use places of formulas, in the order of a paragraph's lines
    mark = lambda i: F.decode(F.unhex(F.concat(F.hex(F.shiftright(i + 0xE000, 12) + 0xE0), F.hex(F.shiftright(i + 0xE000, 6).bitwiseAND(0x3F) + 0x80), F.hex((i + 0xE000).bitwiseAND(0x3F) + 0x80))), "UTF-8")
    masked = F.transform(found, lambda p, i: F.struct(F.when(p["is_math"] & ~F.col("is_math"), mark(i % 2048)).alias("placeholder"), p["t"].alias("original")))
    grouped = grouped.withColumn("found", masked)
    grouped = grouped.withColumn("whole", F.array_join(F.transform("found", lambda p: F.coalesce(p["placeholder"], p["original"])), " ")).withColumn("math_spans", F.filter("found", lambda p: p["placeholder"].isNotNull()))
    return grouped.select(*PAGE, "para_no", "x0", "y0", "x1", "y1", "fontsize", "n_lines", T.list_marker(F.col("whole")).alias("marker"), T.without_marker(F.col("whole")).alias("text"), "is_math", "math_spans", *extra)


def first_span_of_cell(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Each cell with the first span, in page order, whose box meets its own; null if none.

    An equi-join on the page with the rectangles as residual; ``min_by`` keeps one
    row a cell on the map side.
    """
    c, s = cells.alias("c"), found.alias("s")
    met = c.join(s, [F.col(f"c.{k}") == F.col(f"s.{k}") for k in PAGE] + [G.intersects(G.rect("c."), G.rect("s."))], "left")
    keys = [F.col(f"c.{k}") for k in (*PAGE, "cell_no")]
    return met.groupBy(*keys).agg(F.min("s.span_no").alias("span_no"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that no table box of their page contains."""
    b, t = blocks.alias("b"), tables.alias("t")
    return b.join(t, [F.col(f"b.{k}") == F.col(f"t.{k}") for k in PAGE] + [G.contains(G.rect("t."), G.rect("b."))], "left_anti")


def over_images(boxes: DataFrame, images: DataFrame, share: float = 0.1) -> DataFrame:
    """Boxes of which an image of their page covers at least ``share``."""
    b, i = boxes.alias("b"), images.alias("i")
    covered = G.overlap_area(G.rect("b."), G.rect("i.")) >= G.area(G.rect("b.")) * share
    return b.join(i, [F.col(f"b.{k}") == F.col(f"i.{k}") for k in PAGE] + [covered, G.area(G.rect("b.")) > 0], "left_semi")


def table_boxes(cells: DataFrame) -> DataFrame:
    """Box, rows and columns of each table; cells without width do not count for the box."""
    own = F.col("x1") > F.col("x0")
    pick = lambda f, c: f(F.when(own, F.col(c))).alias(c)
    return cells.groupBy(*PAGE, "table_no").agg(
        pick(F.min, "x0"), pick(F.min, "y0"), pick(F.max, "x1"), pick(F.max, "y1"), (F.max("row_no") + 1).alias("num_rows"), (F.max("col_no") + 1).alias("num_cols")
    )
