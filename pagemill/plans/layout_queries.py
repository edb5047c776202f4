"""Queries on pages: filters, order, paragraphs, articles, tables, geometry, re-layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import articles, layout, render
from pagemill.plans import views
from pagemill.sources import tables

BOXED = f"WITH {views.LAYOUT_SQL}"
MARK_SQL = r"""CASE WHEN regexp_matches({0}, '^\s*[•‣◦⁃∙]\s*') THEN trim(regexp_extract({0}, '^\s*[•‣◦⁃∙]\s*'))
 WHEN regexp_matches({0}, '^\s*(?:\d{{1,3}}[.)]|[a-zA-Z][.)])\s*') THEN trim(regexp_extract({0}, '^\s*(?:\d{{1,3}}[.)]|[a-zA-Z][.)])\s*'))
 WHEN regexp_matches({0}, '^\s*[-*]\s*') THEN trim(regexp_extract({0}, '^\s*[-*]\s*')) END"""
REST_SQL = r"""CASE WHEN regexp_matches({0}, '^\s*[•‣◦⁃∙]\s*') THEN trim(regexp_replace({0}, '^\s*[•‣◦⁃∙]\s*', ''))
 WHEN regexp_matches({0}, '^\s*(?:\d{{1,3}}[.)]|[a-zA-Z][.)])\s*') THEN trim(regexp_replace({0}, '^\s*(?:\d{{1,3}}[.)]|[a-zA-Z][.)])\s*', ''))
 WHEN regexp_matches({0}, '^\s*[-*]\s*') THEN trim(regexp_replace({0}, '^\s*[-*]\s*', '')) ELSE {0} END"""
CLUSTER_SQL = """, marked AS (
  SELECT *, CASE WHEN y0 - lag(y1) OVER w < 1.2::DOUBLE * lag(fontsize) OVER w
                  AND abs(x0 - lag(x0) OVER w) < greatest(3 * lag(fontsize) OVER w, 20.0::DOUBLE) THEN 0 ELSE 1 END AS starts
  FROM layout WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)), clustered AS (
  SELECT *, (sum(starts) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS para_no FROM marked)"""
PARAGRAPH_SQL = (
    CLUSTER_SQL
    + """, grouped AS (
  SELECT doc_id, page_no, para_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(fontsize, line_no) AS fontsize, count(*) AS n_lines,
         coalesce(string_agg(trim(line), ' ' ORDER BY line_no) FILTER (trim(line) <> ''), '') AS whole
  FROM clustered GROUP BY doc_id, page_no, para_no)"""
)
FONTS = ["ABCDEF+CambriaMath-Bold", "Times New Roman", "STIX Two Text", "Arial-BoldItalic", "CMMI10", "Courier New Oblique", "Georgia", "Unknown Sans"]
FONT_SQL = "[" + ", ".join(f"'{f}'" for f in FONTS) + "]"

#: Width of a word at a size, and the greedy line fill, as SQL over a list of words.
WRAP_SQL = """list_reduce(list_transform({words}, lambda w: {{'n': 1, 'w': length(w) * {size} * 0.5::DOUBLE, 'm': 0.0::DOUBLE}}),
  lambda a, x: CASE WHEN a.w + {size} * 0.3::DOUBLE + x.w > {width} THEN {{'n': a.n + 1, 'w': x.w, 'm': greatest(a.m, a.w)}}
               ELSE {{'n': a.n, 'w': a.w + {size} * 0.3::DOUBLE + x.w, 'm': a.m}} END)"""
WORDS_SQL = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


CHAIN_SQL = r"string_agg(CASE WHEN m THEN regexp_replace(part, '^\s+', '') ELSE part END, '' ORDER BY line_no)"


def order_ctes(source: str) -> str:
    """CTEs that end in ``placed_blocks``: each line of ``source`` as a block with its place in reading order."""
    return f"""b AS (SELECT doc_id, page_no, line_no AS block_no, x0, y0, x1, y1, (x0 + x1) / 2 AS cx, x1 - x0 AS w FROM {source}),
      p AS (SELECT doc_id, page_no, list_sort(list(w)) AS ws, list_sort(list(cx)) AS cs FROM b GROUP BY ALL),
      g AS (SELECT *, greatest(ws[len(ws) // 2 + 1] * 2.0::DOUBLE, 30.0::DOUBLE) AS gap FROM p),
      s AS (SELECT doc_id, page_no, list_transform(list_filter(range(2, len(cs) + 1), lambda i: cs[i] - cs[i - 1] > gap), lambda i: (cs[i] + cs[i - 1]) / 2) AS seps FROM g),
      c AS (SELECT b.*, len(list_filter(seps, lambda x: x <= cx)) AS col, len(seps) AS ns FROM b JOIN s USING (doc_id, page_no)),
      e AS (SELECT doc_id, page_no, col, max(x1) - min(x0) AS ext FROM c GROUP BY ALL),
      a AS (SELECT doc_id, page_no, avg(ext) AS extent FROM e GROUP BY ALL),
      z AS (SELECT c.*, ns > 0 AND w > extent * 1.5::DOUBLE AS is_spanning FROM c JOIN a USING (doc_id, page_no)),
      placed_blocks AS (SELECT doc_id, page_no, block_no, col, is_spanning, row_number() OVER (PARTITION BY doc_id, page_no
        ORDER BY CASE WHEN is_spanning THEN 0 ELSE 1 END, CASE WHEN is_spanning THEN 0 ELSE col END, y0, x0, block_no) - 1 AS reading_pos FROM z)"""


def hyphen_ctes(source: str, key: str) -> str:
    """CTEs that end in ``chains``: the lines of ``source`` with the chain of broken words that each belongs to."""
    kept = " OR ".join(f"suffix(rtrim(line), '{e}')" for e in T.KEPT_ENDINGS)
    return rf"""hf AS (SELECT *, lead(line) OVER (PARTITION BY {key} ORDER BY line_no) AS following, regexp_replace(line, '-\s*$', '') AS core FROM {source}),
      hg AS (SELECT *, regexp_replace(coalesce(following, ''), '^\s+', '') AS rest FROM hf),
      hj AS (SELECT *, regexp_matches(line, '-\s*$') AND length(core) > 0 AND length(rest) > 0 AND right(core, 1) NOT IN ('—', '–') AND NOT ({kept})
              AND (instr('{T.VOWELS}', lower(right(core, 1))) > 0) <> (instr('{T.VOWELS}', lower(left(rest, 1))) > 0) AS next_m FROM hg),
      hm AS (SELECT *, coalesce(lag(next_m) OVER (PARTITION BY {key} ORDER BY line_no), false) AS m FROM hj),
      chains AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chain,
              CASE WHEN next_m THEN core ELSE line END AS part FROM hm)"""


def _numbered(spark, folder):
    """Lines as paragraphs, some of which open a numbered article."""
    found = views.layout(spark, folder)
    head = F.concat(F.col("line_no").cast("string"), F.lit("-modda. "), F.col("line"))
    return found.withColumn("text", F.when((F.col("line_no") % 7 == 3) & (F.col("doc_id") % 2 == 0), head).otherwise(F.col("line")))


def register(catalog) -> None:
    add = catalog.add

    @add("scan_lines", f"WITH {views.LINES_SQL} SELECT doc_id, line_no, line FROM lines WHERE length(trim(line)) > 0")
    def scan_lines(spark, folder):
        return views.lines(spark, folder).filter(F.length(F.trim("line")) > 0).select("doc_id", "line_no", "line")

    @add("header_footer_filter", BOXED + " SELECT doc_id, line_no, page_no, y0, y1 FROM layout WHERE NOT (y0 < 792.0::DOUBLE * 0.05::DOUBLE OR y1 > 792.0::DOUBLE * 0.95::DOUBLE)")
    def header_footer_filter(spark, folder):
        found = views.layout(spark, folder)
        return found.filter(~layout.is_header_or_footer(F.col("y0"), F.col("y1"), views.PAGE_HEIGHT)).select("doc_id", "line_no", "page_no", "y0", "y1")

    @add("watermark_filter", BOXED + " SELECT doc_id, line_no FROM layout WHERE NOT (line_no % 4 = 0 OR line_no % 3 = 0)")
    def watermark_filter(spark, folder):
        light = F.when(F.col("line_no") % 3 == 0, 0.9).otherwise(0.0)
        found = views.layout(spark, folder).withColumn("opacity", F.when(F.col("line_no") % 4 == 0, 0.25)).withColumn("color", F.struct(*(light.alias(c) for c in "rgb")))
        return found.filter(~layout.is_watermark(F.col("opacity"), F.col("color"))).select("doc_id", "line_no")

    @add("math_font_flag", f"SELECT doc_id, {FONT_SQL}[doc_id % 8 + 1] AS font, doc_id % 8 IN (0, 2, 4) AS is_math FROM documents")
    def math_font_flag(spark, folder):
        fonts = F.element_at(T.keyword_list(FONTS), (F.col("doc_id") % 8 + 1).cast("int"))
        return views.documents(spark, folder).select("doc_id", fonts.alias("font"), T.is_math_font(fonts).alias("is_math"))

    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.MATH_RANGES)
    math_sql = f"""WITH {views.LINES_SQL}, m AS (SELECT doc_id, line_no, line || CASE WHEN line_no % 5 = 0 THEN '∑∫∂≤' ELSE '' END AS t FROM lines)
      SELECT doc_id, line_no, length(t) > 0 AND length(regexp_replace(t, '[^{ranges}]', '', 'g'))::DOUBLE / greatest(length(t), 1) >= 0.15::DOUBLE AS is_math FROM m"""

    @add("math_unicode_flag", math_sql)
    def math_unicode_flag(spark, folder):
        text = F.concat("line", F.when(F.col("line_no") % 5 == 0, F.lit("∑∫∂≤")).otherwise(F.lit("")))
        return views.lines(spark, folder).select("doc_id", "line_no", T.has_math_unicode(text).alias("is_math"))

    order_sql = BOXED + ", " + order_ctes("layout") + " SELECT doc_id, page_no, block_no, col, is_spanning, reading_pos FROM placed_blocks"

    @add("reading_order", order_sql)
    def reading_order(spark, folder):
        return layout.reading_order(views.layout(spark, folder).withColumn("block_no", F.col("line_no")))

    hyphen_sql = f"""WITH {views.LINES_SQL}, h AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN line || '-' ELSE line END AS line FROM lines WHERE length(trim(line)) > 0), {hyphen_ctes('h', 'doc_id')}
      SELECT doc_id, min(line_no) AS line_no, count(*) AS n_lines, {CHAIN_SQL} AS text FROM chains GROUP BY doc_id, chain"""

    @add("dehyphenate", hyphen_sql)
    def dehyphenate(spark, folder):
        found = views.lines(spark, folder).filter(F.length(F.trim("line")) > 0)
        return layout.dehyphenate(found.withColumn("line", F.when(F.col("line_no") % 5 == 0, F.concat("line", F.lit("-"))).otherwise(F.col("line"))))

    @add("cluster_paragraphs", BOXED + CLUSTER_SQL + " SELECT doc_id, page_no, line_no, para_no FROM clustered")
    def cluster_paragraphs(spark, folder):
        return layout.cluster_lines(views.layout(spark, folder)).select("doc_id", "page_no", "line_no", "para_no")

    @add("build_paragraphs", BOXED + PARAGRAPH_SQL + f" SELECT doc_id, page_no, para_no, x0, y0, x1, y1, fontsize, n_lines, {MARK_SQL.format('whole')} AS marker, {REST_SQL.format('whole')} AS text FROM grouped")
    def build_paragraphs(spark, folder):
        return layout.build_paragraphs(layout.cluster_lines(views.layout(spark, folder)))

    @add("total_paragraphs", BOXED + CLUSTER_SQL + " SELECT doc_id, count(DISTINCT (page_no, para_no)) AS n_paragraphs, count(DISTINCT page_no) AS n_pages FROM clustered GROUP BY doc_id")
    def total_paragraphs(spark, folder):
        found = layout.cluster_lines(views.layout(spark, folder))
        return found.groupBy("doc_id").agg(F.count_distinct("page_no", "para_no").alias("n_paragraphs"), F.count_distinct("page_no").alias("n_pages"))

    numbered_sql = (
        BOXED
        + r""", t AS (SELECT *, CASE WHEN line_no % 7 = 3 AND doc_id % 2 = 0 THEN line_no || '-modda. ' || line ELSE line END AS text FROM layout),
      n AS (SELECT *, nullif(regexp_extract(trim(text), '(?i)^(\d+)[-]?\s*(?:modda|модда)[.\s]', 1) || regexp_extract(trim(text), '(?i)^(?:modda|модда)\s+(\d+)[.\s]', 1), '') AS num FROM t),
      p AS (SELECT *, count(num) OVER (PARTITION BY doc_id, page_no) AS total, count(num) OVER u AS upto, last_value(num IGNORE NULLS) OVER u AS latest,
              min(CASE WHEN num IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id, page_no) > min(line_no) OVER (PARTITION BY doc_id, page_no) AS orphan
            FROM n WINDOW u AS (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
      r AS (SELECT doc_id, page_no, line_no, text, fontsize, upto - CASE WHEN orphan THEN 0 ELSE 1 END AS article_seq,
              CASE WHEN upto = 0 THEN 'block_0' ELSE latest || '-modda' END AS article_id, CASE WHEN upto = 0 THEN 'undetected' ELSE 'regex' END AS method FROM p WHERE total > 0)"""
    )

    @add("articles_regex", numbered_sql + " SELECT doc_id, page_no, line_no, article_seq, article_id, method FROM r")
    def articles_regex(spark, folder):
        return articles.by_number(_numbered(spark, folder), "line_no").select("doc_id", "page_no", "line_no", "article_seq", "article_id", "method")

    heading_cte = """, med AS (SELECT doc_id, page_no, list_sort(list(fontsize))[count(*) // 2 + 1] AS median FROM {0} GROUP BY doc_id, page_no),
      hd AS (SELECT q.*, fontsize >= median * 1.2::DOUBLE AS is_heading, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) = 1 AS first FROM {0} q JOIN med USING (doc_id, page_no)),
      hs AS (SELECT *, (sum(CASE WHEN is_heading AND NOT first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS article_seq FROM hd)"""

    @add("articles_heading", BOXED + heading_cte.format("layout") + " SELECT doc_id, page_no, line_no, is_heading, article_seq, 'block_' || article_seq AS article_id FROM hs")
    def articles_heading(spark, folder):
        found = articles.by_heading(views.layout(spark, folder), "line_no", font=None)
        return found.select("doc_id", "page_no", "line_no", "is_heading", "article_seq", "article_id")

    article_sql = (
        numbered_sql
        + ", o AS (SELECT * FROM t WHERE (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM r))"
        + heading_cte.format("o")
        + """, whole AS (SELECT doc_id, page_no, line_no, text, article_seq, article_id, method FROM r
             UNION ALL SELECT doc_id, page_no, line_no, text, article_seq, 'block_' || article_seq, 'heading_heuristic' FROM hs)
      SELECT doc_id, page_no, article_seq, article_id, method, count(*) AS n_paragraphs, string_agg(text, ' ' ORDER BY line_no) AS article_text FROM whole GROUP BY ALL"""
    )

    @add("article_context", article_sql)
    def article_context(spark, folder):
        found = _numbered(spark, folder).select("doc_id", "page_no", "line_no", "text", "fontsize")
        return articles.article_texts(articles.segment(found, "line_no"), "line_no")

    cell_sql = (
        BOXED
        + """, c AS (SELECT doc_id, page_no, line_no AS cell_no, x0 - 1 AS x0, y0 - 20 AS y0, x1 + 1 AS x1, y1 + 1 AS y1 FROM layout WHERE line_no % 7 = 3)
      SELECT c.doc_id, c.page_no, c.cell_no, min(s.line_no) AS span_no FROM c LEFT JOIN layout s
      ON c.doc_id = s.doc_id AND c.page_no = s.page_no AND c.x0 < s.x1 AND s.x0 < c.x1 AND c.y0 < s.y1 AND s.y0 < c.y1 GROUP BY ALL"""
    )

    @add("cell_first_span", cell_sql)
    def cell_first_span(spark, folder):
        found = views.layout(spark, folder)
        cells = found.filter("line_no % 7 = 3").select("doc_id", "page_no", F.col("line_no").alias("cell_no"), (F.col("x0") - 1).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 1).alias("x1"), (F.col("y1") + 1).alias("y1"))
        return layout.first_span_of_cell(cells, found.withColumn("span_no", F.col("line_no")))

    @add("block_not_in_table", BOXED + " SELECT doc_id, page_no, line_no FROM layout WHERE NOT (page_no % 2 = 0 AND x0 >= 0 AND y0 >= 100 AND x1 <= 612 AND y1 <= 250)")
    def block_not_in_table(spark, folder):
        found = views.layout(spark, folder)
        boxes = found.filter("page_no % 2 = 0").select(*layout.PAGE).distinct().selectExpr("*", "0D as x0", "100D as y0", "612D as x1", "250D as y1")
        return layout.outside_tables(found, boxes).select("doc_id", "page_no", "line_no")

    image_sql = BOXED + """ SELECT doc_id, page_no, line_no FROM layout WHERE page_no % 2 = 0 AND x1 > x0
      AND greatest(least(x1, 120) - greatest(x0, 72), 0) * greatest(least(y1, 205) - greatest(y0, 60), 0) >= (x1 - x0) * (y1 - y0) * 0.1::DOUBLE"""

    @add("image_overlap", image_sql)
    def image_overlap(spark, folder):
        found = views.layout(spark, folder)
        images = found.filter("page_no % 2 = 0").select(*layout.PAGE).distinct().selectExpr("*", "72D as x0", "60D as y0", "120D as x1", "205D as y1")
        return layout.over_images(found, images).select("doc_id", "page_no", "line_no")

    @add("drop_cap", BOXED + " SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN 1 ELSE 2 END AS n_spans, CASE WHEN line_no % 3 = 0 THEN line ELSE left(line, 1) END AS first_text FROM layout WHERE length(line) > 0")
    def drop_cap(spark, folder):
        found = views.layout(spark, folder).filter(F.length("line") > 0)
        r = [F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")]
        first = F.struct(F.left("line", F.lit(1)).alias("text"), (F.col("fontsize") * F.when(F.col("line_no") % 3 == 0, 2.0).otherwise(1.0)).alias("size"), *r)
        rest = F.struct(F.substr("line", F.lit(2)).alias("text"), F.col("fontsize").alias("size"), *r)
        merged = layout.merge_drop_cap(F.array(first, rest))
        return found.select("doc_id", "line_no", F.size(merged).cast("long").alias("n_spans"), F.element_at(merged, 1)["text"].alias("first_text"))

    table_sql = BOXED + """ SELECT doc_id, page_no, line_no // 8 AS table_no, min(CASE WHEN x1 > x0 THEN x0 END) AS x0, min(CASE WHEN x1 > x0 THEN y0 END) AS y0,
      max(CASE WHEN x1 > x0 THEN x1 END) AS x1, max(CASE WHEN x1 > x0 THEN y1 END) AS y1, max(line_no % 8 // 2) + 1 AS num_rows, max(line_no % 2) + 1 AS num_cols FROM layout GROUP BY ALL"""

    @add("table_boxes", table_sql)
    def table_boxes(spark, folder):
        cells = views.layout(spark, folder).selectExpr("*", "line_no div 8 as table_no", "(line_no % 8) div 2 as row_no", "line_no % 2 as col_no")
        return layout.table_boxes(cells)

    @add("rotation", "SELECT vec_id, CASE WHEN abs(dx) > 0.5 AND abs(dy) < 0.5 THEN CASE WHEN dx > 0 THEN 0.0 ELSE 180.0 END WHEN abs(dy) > 0.5 AND abs(dx) < 0.5 THEN CASE WHEN dy > 0 THEN 90.0 ELSE -90.0 END ELSE round(degrees(atan2(dy, dx)), 6) END::DOUBLE AS angle FROM (SELECT vec_id, embedding[1]::DOUBLE AS dx, embedding[2]::DOUBLE AS dy FROM embeddings)")
    def rotation(spark, folder):
        found = tables.table(spark, folder, "embeddings")
        angle = G.rotation(F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double"))
        return found.select("vec_id", F.round(angle, 6).alias("angle"))

    subtract_sql = BOXED + """, h AS (SELECT doc_id, line_no, x0 AS ax0, y0 AS ay0, x1 + 100 AS ax1, y1 + 60 AS ay1, x0 + 10 AS bx0, y0 + 5 AS by0, x0 + 40 AS bx1, y0 + 30 AS by1, x0 + 30 AS cx0, y0 + 20 AS cy0, x0 + 80 AS cx1, y0 + 50 AS cy1 FROM layout)
      SELECT doc_id, line_no, (ax1 - ax0) * (ay1 - ay0) - 30 * 25 - 50 * 30 + 10 * 10 AS area FROM h"""

    @add("rect_subtract", subtract_sql)
    def rect_subtract(spark, folder):
        box = lambda a, b, c, d: F.struct(*(v.cast("double").alias(n) for v, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)))
        x, y = F.col("x0"), F.col("y0")
        outer = box(x, y, F.col("x1") + 100, F.col("y1") + 60)
        rest = G.subtract(outer, F.array(box(x + 10, y + 5, x + 40, y + 30), box(x + 30, y + 20, x + 80, y + 50)))
        area = F.aggregate(rest, F.lit(0.0), lambda a, r: a + (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
        return views.layout(spark, folder).select("doc_id", "line_no", area.alias("area"))

    variants = ["LiberationSerif-Bold", "LiberationSerif-Regular", "DejaVuSans", "DejaVuSans-Bold", "DejaVuSans", "LiberationMono-Italic", "LiberationSerif-Regular", "DejaVuSans"]
    bolder = ["LiberationSerif-Bold", "LiberationSerif-Bold", "DejaVuSans-Bold", "DejaVuSans-Bold", "DejaVuSans-Bold", "LiberationMono-BoldItalic", "LiberationSerif-Bold", "DejaVuSans-Bold"]
    as_sql = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    font_sql = f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {as_sql(bolder)}[doc_id % 8 + 1] ELSE {as_sql(variants)}[doc_id % 8 + 1] END AS variant FROM documents)
      SELECT doc_id, variant, '/usr/share/fonts/truetype/' || CASE WHEN variant LIKE 'DejaVu%' THEN 'dejavu/' ELSE 'liberation/' END
        || CASE WHEN variant = 'LiberationMono-Italic' THEN 'LiberationMono-Regular' ELSE variant END || '.ttf' AS font_file FROM f"""

    @add("font_resolve", font_sql)
    def font_resolve(spark, folder):
        fonts = F.element_at(T.keyword_list(FONTS), (F.col("doc_id") % 8 + 1).cast("int"))
        flags = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
        wanted = views.documents(spark, folder).select("doc_id", render.font_variant(fonts, flags).alias("variant"))
        return render.font_files(wanted, tables.font_catalog(spark), missing=("LiberationMono-Italic",)).select("doc_id", "variant", "font_file")

    wrap = WRAP_SQL.format(words="ws", size="fontsize", width="150.0::DOUBLE")
    wrap_sql = f"{BOXED}, w AS (SELECT doc_id, line_no, fontsize, {WORDS_SQL.format('line')} AS ws FROM layout), z AS (SELECT doc_id, line_no, {wrap} AS f FROM w WHERE len(ws) > 0) SELECT doc_id, line_no, f.n AS n_lines, greatest(f.w, f.m) AS widest FROM z"

    @add("wrap_lines", wrap_sql)
    def wrap_lines(spark, folder):
        made = views.layout(spark, folder).withColumn("made", render.wrap(F.col("line"), F.lit(150.0), F.col("fontsize"))).filter(F.size("made") > 0)
        return made.select("doc_id", "line_no", F.size("made").cast("long").alias("n_lines"), F.array_max(F.transform("made", lambda x: x["width"])).alias("widest"))

    justify_sql = f"""{BOXED}, w AS (SELECT doc_id, line_no, fontsize, {WORDS_SQL.format('line')} AS ws FROM layout),
      u AS (SELECT doc_id, line_no, len(ws) AS n, list_sum(list_transform(ws, lambda x: length(x) * fontsize * 0.5::DOUBLE)) AS used FROM w WHERE len(ws) > 0)
      SELECT doc_id, line_no, n AS n_words, round(CASE WHEN n > 1 AND used < 400 THEN (400 - used) / (n - 1) ELSE 0 END, 6)::DOUBLE AS spacing FROM u"""

    @add("justify_spacing", justify_sql)
    def justify_spacing(spark, folder):
        found = views.layout(spark, folder).withColumn("words", T.tokens(F.col("line"))).filter(F.size("words") > 0)
        words = F.col("words")
        used = F.aggregate(F.transform(words, lambda w: render.word_width(w, F.col("fontsize"))), F.lit(0.0), lambda a, x: a + x)
        spaces = render.justify(words, used, F.lit(400.0))
        return found.select("doc_id", "line_no", F.size(words).cast("long").alias("n_words"), F.round(F.get(spaces, F.lit(0)), 6).alias("spacing"))

    fit = WRAP_SQL.format(words="ws", size="s", width="(x1 + 20 - x0)")
    shrink_sql = f"""{BOXED}, w AS (SELECT *, {WORDS_SQL.format('line')} AS ws FROM layout), t AS (SELECT *, unnest(range(0, 2 * (fontsize - 5.0)::BIGINT + 1)) AS k FROM w),
      c AS (SELECT *, fontsize - k * 0.5::DOUBLE AS s FROM t), n AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0 ELSE ({fit}).n END AS lines FROM c),
      f AS (SELECT *, lines = 0 OR y0 + s + (lines - 1) * s * 1.2::DOUBLE <= y1 + s * 1.2::DOUBLE AS fits FROM n)
      SELECT doc_id, line_no, coalesce(max(CASE WHEN fits THEN s END), 5.0::DOUBLE) AS fontsize, bool_or(fits) AS fit, NOT bool_or(fits) AS bled FROM f GROUP BY doc_id, line_no"""

    @add("shrink_to_fit", shrink_sql)
    def shrink_to_fit(spark, folder):
        r = G.rect()
        made = render.shrink_to_fit(F.col("line"), r._replace(x1=r.x1 + 20), F.col("fontsize"))
        return views.layout(spark, folder).withColumn("made", made).select("doc_id", "line_no", "made.fontsize", "made.fit", "made.bled")

    @add("draw_commands")
    def draw_commands(spark, folder):
        found = layout.build_paragraphs(layout.cluster_lines(views.layout(spark, folder)))
        return render.commands(found, ["doc_id", "page_no", "para_no"])

    @add("background_colour", "SELECT vec_id, coalesce(avg(CASE WHEN r + g + b > 100 THEN r END) / 255, 1.0)::DOUBLE AS r, coalesce(avg(CASE WHEN r + g + b > 100 THEN g END) / 255, 1.0)::DOUBLE AS g, coalesce(avg(CASE WHEN r + g + b > 100 THEN b END) / 255, 1.0)::DOUBLE AS b FROM (SELECT vec_id, k, (vec_id * 7 + k * 31) % 256 AS r, (vec_id * 11 + k * 17) % 256 AS g, (vec_id * 13 + k * 5) % 256 AS b FROM embeddings, range(9) t(k)) GROUP BY vec_id")
    def background_colour(spark, folder):
        pixels = tables.table(spark, folder, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
        v, k = F.col("vec_id"), F.col("k")
        pixels = pixels.select("vec_id", ((v * 7 + k * 31) % 256).alias("r"), ((v * 11 + k * 17) % 256).alias("g"), ((v * 13 + k * 5) % 256).alias("b"))
        return render.background(pixels, ["vec_id"])

    @add("redaction_rects", BOXED + " SELECT doc_id, line_no, (x1 + 100 - x0) * (y1 + 60 - y0) - 600 AS area FROM layout")
    def redaction_rects(spark, folder):
        hole = F.struct((F.col("x0") + 10).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x0") + 40).alias("x1"), (F.col("y0") + 25).alias("y1"))
        boxes = views.layout(spark, folder).withColumn("holes", F.array(hole)).withColumn("x1", F.col("x1") + 100).withColumn("y1", F.col("y1") + 60)
        made = render.redactions(boxes, ["doc_id", "line_no"], "holes")
        return made.groupBy("doc_id", "line_no").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
