import pytest
from pyspark.sql import functions as F

from pagemill import __main__ as cli
from pagemill.operators import translate
from pagemill.plans import document_pipeline, views
from pagemill.sources import tables
from pagemill.streaming import pages as streaming


def _span(no, text, x, y):
    return {"span_no": no, "text": text, "font": "Arial", "size": 11.0, "color": None, "bbox": {"x0": x, "y0": y, "x1": x + 400, "y1": y + 11}, "matrix": None, "dir": None, "is_math": None, "opacity": None}


def _page(doc, no, *lines):
    blocks = [{"block_no": i, "bbox": {"x0": 72.0, "y0": y, "x1": 472.0, "y1": y + 11}, "opacity": None, "color": None, "lines": [{"line_no": 0, "bbox": None, "spans": [_span(0, t, 72.0, y)]}]} for i, (y, t) in enumerate(lines)]
    return (doc, no, 612.0, 792.0, blocks)


PAGES = [_page(1, 0, (100.0, "Birinchi sahifadagi BMT matni 12.05.2024."), (150.0, "1. Ikkinchi paragraf.")), _page(1, 1, (10.0, "HEADER"), (100.0, "Uchinchi sahifadagi matn."))]


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(PAGES, tables.PAGE_DICTS).write.parquet(str(tmp_path / "in"))
    code = cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--target", "ru"])
    rows = {r.source_preview: r.translation_preview for r in tables.report(spark, str(tmp_path / "out/report")).collect()}
    assert rows["Ikkinchi paragraf."] == "1. [Rus_Cyrl]Ikkinchi paragraf." or rows["Ikkinchi paragraf."] == "1. [rus_Cyrl]Ikkinchi paragraf."
    assert rows["Birinchi sahifadagi BMT matni 12.05.2024."].endswith("BMT matni 12.05.2024.") and "HEADER" not in rows
    assert code in (0, 1) and ("PASS" in capsys.readouterr().out) == (code == 0)
    assert spark.read.parquet(str(tmp_path / "out/commands")).filter("cmd = 'TEXT'").count() >= 3


def test_masked_entities_never_reach_the_model(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def model(texts, source, target):
        for t in texts:
            if "BMT" in t or "12.05.2024" in t:
                seen.add(1)
        return [f"<{t}>" for t in texts]

    lines = spark.createDataFrame([(1, 0, i, 72.0, 100.0 + 40 * i, 172.0, 111.0 + 40 * i, 11.0, t) for i, t in enumerate(["BMT va 12.05.2024 haqida", "BMT"])], "doc_id long, page_no long, line_no long, x0 double, y0 double, x1 double, y1 double, fontsize double, line string")
    made = document_pipeline.run(lines, spark.createDataFrame([], tables.CACHE), model, "ru", 792.0)
    assert sorted(r.tgt for r in made.paragraphs.select("tgt").collect()) == ["<BMT va 12.05.2024 haqida>", "<BMT>"]
    assert seen.value == 0
    assert made.counters.first().masked == 2


LINE = "doc_id long, page_no long, block_no long, line_no long, x0 double, y0 double, x1 double, y1 double, fontsize double, is_math boolean, line string"


def _lines(spark, rows):
    """(block, x, y, text, formula?) of one page, as lines."""
    return spark.createDataFrame([(1, 0, b, i, x, y, x + 150.0, y + 11.0, 11.0, m, t) for i, (b, x, y, t, m) in enumerate(rows)], LINE)


def test_page_goes_through_all_steps(spark, tmp_path):
    """Columns, broken words, a formula in a paragraph, one on its own, LaTeX, a table, a language, by hand."""
    rows = [
        (0, 400.0, 100.0, "o'ng ustun matni", False), (1, 60.0, 100.0, "chap ustun so-", False), (1, 60.0, 112.0, "zlari bor", False), (1, 60.0, 124.0, "x = y + 1", True), (1, 60.0, 136.0, "va $a^2$ davom", False),
        (2, 60.0, 300.0, "E = mc^2", True), (3, 60.0, 400.0, "jadval ichida", False), (4, 60.0, 500.0, "ru bu tarjima", False), (5, 60.0, 10.0, "sarlavha", False),
    ]
    cells = spark.createDataFrame([(1, 0, 0, 0, k, k, 50.0 + 100 * k, 390.0, 150.0 + 150 * k, 420.0, t) for k, t in enumerate(["katak bir", " "])], document_pipeline.CELLS)
    sent = spark.sparkContext.accumulator(0)

    def model(texts, source, target):
        sent.add(len(texts))
        return [f"<{t}>" for t in texts]

    identify = lambda t: ("ru", 0.9) if t.startswith("ru ") else None
    made = document_pipeline.run(_lines(spark, rows), spark.createDataFrame([], tables.CACHE), model, "ru", 792.0, cells=cells, identify=identify, cache_path=str(tmp_path / "cache"))
    got = {r.src: (r.tgt, r.skip) for r in made.paragraphs.collect()}
    assert got == {
        "chap ustun sozlari bor x = y + 1 va $a^2$ davom": ("<chap ustun sozlari bor x = y + 1 va $a^2$ davom>", None), "oʻng ustun matni": ("<oʻng ustun matni>", None),
        "E = mc^2": ("E = mc^2", "math"), "ru bu tarjima": ("ru bu tarjima", "language"),
    }
    assert {(r.cell_no, r.text, r.translation) for r in made.cells.collect()} == {(0, "katak bir", "<katak bir>"), (1, " ", " ")}
    counters = made.counters.first()
    assert (counters.processed, counters.skipped_math, counters.skipped_language, counters.cells, counters.pure_placeholder) == (4, 1, 1, 1, 0)
    # the model ran once for all of that, and not for what is skipped
    assert made.report.count() == 3 and made.commands.count() > 0 and sent.value == 3
    again = document_pipeline.run(_lines(spark, rows), translate.open_cache(spark, next(str(p) for p in (tmp_path / "cache").iterdir())), model, "ru", 792.0, cells=cells, identify=identify)
    assert again.paragraphs.count() == 4 and sent.value == 3


def test_reading_order_of_columns(spark):
    rows = [(0, 400.0, 100.0, "to'rt", False), (1, 60.0, 100.0, "bir", False), (2, 60.0, 200.0, "ikki", False), (3, 400.0, 60.0, "uch", False)]
    made = document_pipeline.run(_lines(spark, rows), spark.createDataFrame([], tables.CACHE), lambda t, a, b: t, "ru", 792.0)
    assert [r.src for r in made.paragraphs.orderBy("para_no").collect()] == ["bir", "ikki", "uch", "toʻrt"]


def test_long_paragraphs_reach_the_model_in_chunks(spark):
    text = " ".join(f"Gap {i} shu yerda tugaydi." for i in range(60))
    seen = spark.sparkContext.accumulator(0)

    def model(texts, source, target):
        for t in texts:
            seen.add(1000 if len(t.split()) > 39 else 1)
        return [f"<{t}>" for t in texts]

    made = document_pipeline.run(_lines(spark, [(0, 60.0, 100.0, text, False)]), spark.createDataFrame([], tables.CACHE), model, "ru", 792.0, most=50)
    row = made.paragraphs.collect()
    # at most int(0.78 * 50) words, whole sentences
    assert len(row) == 1 and row[0].tgt.replace("<", "").replace(">", "") == text
    assert 1 < seen.value < 1000


def test_paragraphs_keep_the_look_of_their_first_line(spark):
    from pagemill.operators import layout

    found = _lines(spark, [(0, 60.0, 100.0, "bir", False), (0, 60.0, 112.0, "ikki", True)]).selectExpr("*", "if(line = 'bir', 'Arial', 'Math') as font", "named_struct('dx', 1D, 'dy', 0D) as dir")
    (row,) = layout.build_paragraphs(layout.cluster_lines(found)).collect()
    assert (row.font, row.dir.dx, row.is_math, row.text, [s.original for s in row.math_spans]) == ("Arial", 1.0, False, "bir \ue001", ["ikki"])


def test_empty_document_is_an_error_when_asked(spark):
    import pytest

    lines = spark.createDataFrame([], "doc_id long, page_no long, line_no long, x0 double, y0 double, x1 double, y1 double, fontsize double, line string")
    with pytest.raises(document_pipeline.PipelineError):
        document_pipeline.run(lines, spark.createDataFrame([], tables.CACHE), None, "ru", 792.0, strict=True)


def test_stream_equals_batch_and_restarts(spark, folder, tmp_path):
    docs = views.documents(spark, folder)
    for part in range(2):
        docs.filter(F.col("doc_id") % 2 == part).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        streaming.run_available(streaming.stream_files(spark, str(tmp_path / "in"), docs.schema, "*.parquet"), tables.lines, out, state)
        return spark.read.parquet(out).count()

    want = tables.lines(docs).count()
    assert run() == want and run() == want
    docs.limit(3).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    assert run() == want + tables.lines(docs.limit(3)).count()


@pytest.mark.parametrize("as_folder", [False, True])
def test_stream_of_a_table_of_one_or_many_files(spark, folder, tmp_path, as_folder):
    from pagemill.plans import catalog

    where = folder
    if as_folder:
        where = str(tmp_path)
        views.documents(spark, folder).repartition(3).write.parquet(f"{where}/documents.parquet")
    got, want = ({tuple(r) for r in catalog.QUERIES[name](spark, where).collect()} for name in ("streaming_pages", "flagship_report"))
    assert got == want and len(got) == 4


def test_cache_versions_do_not_disturb_each_other(spark, tmp_path):
    row = lambda k, t: spark.createDataFrame([(k, t, 1, None)], tables.CACHE)
    first = translate.write_cache(row("a", "x"), str(tmp_path))
    second = translate.write_cache(translate.upsert(translate.open_cache(spark, first), row("a", "y")), str(tmp_path))
    assert [r.translated_text for p in (first, second) for r in translate.open_cache(spark, p).collect()] == ["x", "y"]


def test_commands_are_made_without_a_pandas_group_for_each_document(spark, folder):
    from pagemill.plans import catalog

    assert "FlatMapGroupsInPandas" not in catalog.QUERIES["document_commands"](spark, folder)._jdf.queryExecution().toString()
