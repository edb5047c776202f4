import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import articles, layout, render, translate
from pagemill.sources import tables

LINE = "doc_id long, page_no long, line_no long, x0 double, y0 double, x1 double, y1 double, fontsize double, line string"


def line(no, x, y, text, size=11.0, width=100.0):
    return (1, 0, no, float(x), float(y), x + width, y + size, size, text)


def test_lines_cluster_to_paragraphs(spark):
    rows = spark.createDataFrame([line(0, 72, 100, "First line of paragraph one."), line(1, 72, 112, "Second line of paragraph one."), line(2, 72, 300, "1. A separate second paragraph.")], LINE)
    got = layout.build_paragraphs(layout.cluster_lines(rows)).orderBy("para_no").collect()
    assert [(r.text, r.marker) for r in got] == [("First line of paragraph one. Second line of paragraph one.", None), ("A separate second paragraph.", "1.")]


def test_columns_are_read_one_after_the_other(spark):
    rows = [Row(doc_id=1, page_no=0, block_no=i, x0=float(x), y0=float(y), x1=x + 60.0, y1=y + 11.0) for i, (x, y) in enumerate([(72, 100), (400, 100), (72, 200), (400, 200)])]
    got = layout.reading_order(spark.createDataFrame(rows)).orderBy("reading_pos").collect()
    assert [r.block_no for r in got] == [0, 2, 1, 3]
    title = Row(doc_id=1, page_no=0, block_no=9, x0=60.0, y0=50.0, x1=500.0, y1=70.0)
    got = layout.reading_order(spark.createDataFrame([*rows, *[r.__class__(**{**r.asDict(), "block_no": r.block_no + 20, "y0": r.y0 + 20}) for r in rows], title])).orderBy("reading_pos").collect()
    assert got[0].block_no == 9 and got[0].is_spanning


def test_page_dicts(spark):
    span = lambda no, text, y, **more: {"span_no": no, "text": text, "font": more.get("font", "Arial"), "size": 11.0, "color": more.get("color"), "bbox": {"x0": 1.0, "y0": y, "x1": 9.0, "y1": y + 11}, "matrix": None, "dir": None, "is_math": None, "opacity": more.get("opacity")}
    block = lambda no, y, *spans: {"block_no": no, "bbox": {"x0": 0.0, "y0": y, "x1": 10.0, "y1": y + 11}, "opacity": None, "color": None, "lines": [{"line_no": 0, "bbox": None, "spans": list(spans)}] if spans else None}
    blocks = [block(0, 10.0, span(0, "HEADER TEXT", 10.0)), block(1, 300.0, span(0, "Body ", 300.0), span(1, "text", 300.0), span(2, "DRAFT", 300.0, opacity=0.2)), block(2, 780.0, span(0, "FOOTER", 780.0)), block(3, 400.0), block(4, 500.0, span(0, "white", 500.0, color={"r": 0.9, "g": 0.9, "b": 0.9})), block(5, 600.0, span(0, "x", 600.0, font="CMMI10"))]
    pages = spark.createDataFrame([(1, 0, 612.0, 792.0, blocks)], tables.PAGE_DICTS)
    got = layout.lines_of_spans(layout.spans(pages)).orderBy("block_no").collect()
    assert [(r.text, r.is_math) for r in got] == [("Body text", False), ("x", True)]


def test_numbered_articles(spark):
    texts = ["orphan", "1-modda. Birinchi", "body", "2-модда Ikkinchi", "МОДДА 3. Uchinchi", "see 4-modda. inside"]
    rows = spark.createDataFrame([(1, 0, i, t, 11.0) for i, t in enumerate(texts)] + [(1, 1, 0, "plain", 11.0)], "doc_id long, page_no long, para_no long, text string, fontsize double")
    got = articles.segment(rows).orderBy("page_no", "para_no").collect()
    assert [r.article_id for r in got] == ["block_0", "1-modda", "1-modda", "2-modda", "3-modda", "3-modda", "block_0"]
    assert [r.method for r in got] == ["undetected"] + ["regex"] * 5 + ["heading_heuristic"]


def test_headings(spark):
    rows = spark.createDataFrame([(1, 0, i, s, f) for i, (s, f) in enumerate([(14.0, "A"), (11.0, "A"), (11.0, "A"), (14.0, "A"), (11.0, "Arial-Bold")])], "doc_id long, page_no long, para_no long, fontsize double, font string")
    assert [r.article_seq for r in articles.by_heading(rows).orderBy("para_no").collect()] == [0, 0, 0, 1, 2]


def test_first_of_two_spans_wins(spark):
    cells = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 10.0, 10.0), (1, 0, 8, 50.0, 50.0, 60.0, 60.0)], "doc_id long, page_no long, cell_no long, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 0, 5, 1.0, 1.0, 2.0, 2.0), (1, 0, 3, 9.0, 9.0, 12.0, 12.0)], "doc_id long, page_no long, span_no long, x0 double, y0 double, x1 double, y1 double")
    assert {r.cell_no: r.span_no for r in layout.first_span_of_cell(cells, spans).collect()} == {7: 3, 8: None}


@pytest.mark.parametrize(("d", "angle"), [((1.0, 0.0), 0.0), ((0.0, 1.0), 90.0), ((-1.0, 0.0), 180.0), ((0.0, -1.0), -90.0), ((0.7, 0.7), 45.0)])
def test_rotation(spark, d, angle):
    got = spark.createDataFrame([d], "dx double, dy double").select(G.rotation(F.col("dx"), F.col("dy"))).first()[0]
    assert abs(got - angle) < 1e-9


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def _subtract(spark, outer, holes):
    frame = spark.createDataFrame([(outer, holes)], f"o {BOX}, h array<{BOX}>")
    return [tuple(r) for r in frame.select(G.subtract(F.col("o"), F.col("h")).alias("r")).first().r]


def test_subtract_rectangles(spark):
    assert _subtract(spark, (0.0, 0.0, 100.0, 100.0), []) == [(0.0, 0.0, 100.0, 100.0)]
    got = _subtract(spark, (0.0, 0.0, 100.0, 100.0), [(10.0, 40.0, 90.0, 60.0)])
    assert (0.0, 0.0, 100.0, 40.0) in got and len(got) == 4
    # two holes side by side leave each other uncovered nowhere
    got = _subtract(spark, (0.0, 0.0, 100.0, 100.0), [(10.0, 40.0, 30.0, 60.0), (50.0, 40.0, 90.0, 60.0)])
    assert (30.0, 40.0, 50.0, 60.0) in got and sum((r[2] - r[0]) * (r[3] - r[1]) for r in got) == 100 * 100 - 20 * 20 - 40 * 20


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=12), max_size=30), st.floats(20, 200))
@settings(max_examples=200, deadline=None)
def test_lines_keep_words_and_width(words, width):
    lines = render.fill(words, width, 10.0)
    assert [w for ws, _ in lines for w in ws] == words
    assert all(used <= width or len(ws) == 1 for ws, used in lines)
    assert render.count_lines([render.half(w, 10.0) for w in words], width, 10.0) == len(lines)


def test_shrinking(spark):
    rows = [("a long text that needs some room in the box", 72.0, 100.0, 200.0, 130.0, 14.0), ("far too long for this box " * 5, 72.0, 100.0, 90.0, 108.0, 11.0), ("", 0.0, 0.0, 10.0, 10.0, 11.0)]
    frame = spark.createDataFrame(rows, "t string, x0 double, y0 double, x1 double, y1 double, fontsize double")
    got = [r.f for r in frame.select(render.shrink_to_fit(F.col("t"), G.rect(), F.col("fontsize"), 6.0).alias("f")).collect()]
    assert got[0].fit and got[0].fontsize < 14 and got[1].bled and got[1].fontsize == 6.0 and got[2].fit and got[2].fontsize == 11.0


def test_fonts(spark):
    names = {"TimesNewRoman": "LiberationSerif-Regular", "Arial": "DejaVuSans", "Arial-BoldItalic": "DejaVuSans-Bold", "AB+Courier New Oblique": "LiberationMono-Italic", "Georgia Bold Italic": "LiberationSerif-BoldItalic"}
    frame = spark.createDataFrame([(n,) for n in names], "f string")
    assert {r.f: r.v for r in frame.select("f", render.font_variant(F.col("f"), F.lit(0)).alias("v")).collect()} == names
    files = render.font_files(spark.createDataFrame([("LiberationMono-Italic",), ("Nothing-Bold",)], "variant string"), tables.font_catalog(spark), ("LiberationMono-Italic",))
    assert {r.variant: r.font_file.rsplit("/", 1)[1] for r in files.collect()} == {"LiberationMono-Italic": "LiberationMono-Regular.ttf", "Nothing-Bold": "DejaVuSans.ttf"}


def test_cache_makes_the_second_run_free(spark, tmp_path):
    items = spark.createDataFrame([(1, "Birinchi matn."), (2, "Ikkinchi."), (3, "Birinchi matn.")], "i long, text string")
    fake = lambda texts, s, t: [f"[{t}]{x}" for x in texts]
    cache = translate.open_cache(spark, str(tmp_path / "none"))
    out, new = translate.translate_cached(items, cache, fake, "uz", "ru")
    assert {r.i: r.translation for r in out.collect()} == {1: "[rus_Cyrl]Birinchi matn.", 2: "[Rus_Cyrl]Ikkinchi.", 3: "[rus_Cyrl]Birinchi matn."}
    place = translate.write_cache(translate.upsert(cache, new), str(tmp_path / "cache"))

    def never(texts, s, t):
        raise AssertionError("the model was called")

    again, nothing = translate.translate_cached(items, translate.open_cache(spark, place), never, "uz", "ru")
    assert again.count() == 3 and again.filter("translation is null").count() == 0 and nothing.count() == 0
    other, _ = translate.translate_cached(items, translate.open_cache(spark, place), fake, "ru", "uz")
    assert other.filter("translation like '[uzn_Latn]%' or translation like '[Uzn_Latn]%'").count() == 3


def test_empty_output_is_an_error(spark):
    texts = spark.createDataFrame([("k", "a")], "key string, text string")
    with pytest.raises(Exception, match="empty translation"):
        translate.run_model(texts, lambda t, s, u: [""] * len(t), "uz", "ru").collect()


def test_metric_and_justified_lines(spark):
    """Widths by a metric of one's own; justified lines are spread to the box, but for the last."""
    wide = lambda word, size: len(word) * size
    assert [w for w, _ in render.fill(["aa", "bb", "cc"], 50.0, 10.0, wide)] == [["aa", "bb"], ["cc"]]
    text = " ".join(["abcd"] * 14)
    frame = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 200.0, 10.0, text, "Arial"), (2, 0.0, 0.0, 500.0, 9.0, 10.0, "x " * 400, "Times")], "k long, x0 double, y0 double, x1 double, y1 double, fontsize double, text string, font string")
    rows = render.commands(frame, ["k"], keep=("font",)).filter("cmd = 'TEXT'").orderBy("k", "cmd_no").collect()
    one = [r for r in rows if r.k == 1]
    # four words and three spaces take 89 of 100 points
    assert [round(r.word_space, 6) for r in one] == [round(11 / 3, 6)] * (len(one) - 1) + [0.0] and len(one) == 4 and not any(r.bled for r in one)
    assert all(r.bled and r.font == "Times" and r.fontsize == 5.0 for r in rows if r.k == 2)


def test_models_are_loaded_once_and_failures_named(spark, tmp_path):
    note = str(tmp_path / "loads")

    def load():
        with open(note, "a") as out:
            out.write("x")
        return lambda texts, source, target: [t.upper() for t in texts]

    texts = spark.createDataFrame([(str(i), f"t{i}") for i in range(40)], "key string, text string").repartition(1)
    model = translate.loaded_once(load)
    for _ in range(2):
        assert translate.run_model(texts, model, "uz", "ru").filter("translated_text = 'T7'").count() == 1
    assert len(open(note).read()) <= 2  # one for each worker process

    def broken():
        raise OSError("no weights")

    with pytest.raises(Exception, match="could not be loaded: no weights"):
        translate.run_model(texts, translate.loaded_once(broken), "uz", "ru").collect()


def test_newest_row_of_the_cache_counts(spark):
    new = spark.createDataFrame([("a", "z", 1, None, 1), ("a", "b", 1, None, 2)], tables.CACHE + ", at int")
    assert [r.translated_text for r in translate.upsert(spark.createDataFrame([("a", "zz", 1, None)], tables.CACHE), new, "at").collect()] == ["b"]


def test_missing_pdf_is_named(spark, tmp_path):
    for path in (str(tmp_path / "none.pdf"), str(tmp_path / "note.txt")):
        with pytest.raises(tables.SourceError):
            tables.pdf_pages(spark, path, lambda data: [])
