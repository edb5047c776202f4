import re
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import masking


@given(st.text(alphabet="ab AB12.,%$€@:/-\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_entities_come_back(text):
    for source in ("uz", "ru"):
        masked, entries = masking.mask_text(text, masking.Registry(), source)
        for e in entries:
            masked = masked.replace(e["placeholder"], e["original"])
        assert masked == text


@given(st.text(alphabet="a$^\n ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_latex_comes_back(text):
    masked, entries = masking.protect_text(text, masking.Registry())
    # the last first, as restore() does: an inline block may hold the placeholder of a displayed one
    for e in reversed(entries):
        masked = masked.replace(e["placeholder"], e["original"])
    assert masked == text


@pytest.mark.parametrize(
    ("text", "found"),
    [("on 12.05.2024", ["12.05.2024"]), ("5 мая 2024 г", ["5 мая 2024"]), ("May 5, 2024", ["May 5, 2024"]), ("$12.50 €7", ["$12.50", "€7"]), ("1.234.567", ["1.234.567"]), ("3,14", ["3,14"]), ("50% x", []), ("50%a", ["50%"]), ("a.b@c.uz", ["a.b@c.uz"]), ("see https://x.uz/a?b=1", ["https://x.uz/a?b=1"]), ("BMT va BMT", ["BMT"])],
)
def test_entity_kinds(text, found):
    assert [e["original"] for e in masking.mask_text(text, masking.Registry(), "uz")[1]] == found


def test_latin_words_depend_on_the_source():
    assert masking.mask_text("Salom dunyo", masking.Registry(), "uz")[1] == []
    assert [e["original"] for e in masking.mask_text("Salom dunyo", masking.Registry(), "ru")[1]] == ["Salom"]


def test_colliding_hashes_get_places_of_their_own():
    registry = masking.Registry()
    marks = [registry.entity(f"E{i}") for i in range(masking.SLOTS)]
    assert len(set(marks)) == masking.SLOTS and registry.entity("E5") == marks[5]
    with pytest.raises(masking.PlaceholdersExhausted):
        registry.entity("one more")


def test_a_document_beyond_its_placeholders_is_no_error():
    text = " ".join(f"AA{chr(65 + i // 676)}{chr(65 + i // 26 % 26)}{chr(65 + i % 26)}" for i in range(masking.SLOTS + 50)) + " AAAAA"
    masked, entries = masking.mask_text(text, masking.Registry(), "uz")
    # what finds no place stays as it is, and what has one keeps it
    assert len(entries) == masking.SLOTS and masked.split()[-1] == masked.split()[0] != "AAAAA" and len(re.findall("[A-Z]{5}", masked)) == 50
    for e in reversed(entries):
        masked = masked.replace(e["placeholder"], e["original"])
    assert masked == text
    blocks = "$a$ " * (masking.SLOTS + 3)
    masked, entries = masking.protect_text(blocks, masking.Registry())
    assert len(entries) == masking.SLOTS and masked.count("$a$") == 3


def test_one_entity_has_one_placeholder_in_a_document(spark):
    rows = spark.createDataFrame([(1, 0, "BMT 12.05.2024"), (1, 1, "va BMT"), (2, 0, "BMT")], "doc_id long, line_no long, line string")
    got = masking.mask_entities(rows).orderBy("doc_id", "line_no").collect()
    marks = [{e.original: e.placeholder for e in r.entries}["BMT"] for r in got]
    assert marks[0] == marks[1] and all("BMT" not in r.masked for r in got)
    restored = masking.mask_entities(rows).select(masking.restore(F.col("masked"), F.col("entries")).alias("t"))
    assert sorted(r.t for r in restored.collect()) == sorted(["BMT 12.05.2024", "va BMT", "BMT"])


def test_latex_counts(spark):
    rows = spark.createDataFrame([(1, 0, "Solve $x^2 + y^2 = z^2$ for x."), (1, 1, "$a^2$ and $b^2$ and $$\\sum_{i=1}^n i$$")], "doc_id long, line_no long, line string")
    got = masking.protect_latex(rows).orderBy("line_no").collect()
    assert [len(r.entries) for r in got] == [1, 3]
    assert len({e.placeholder for r in got for e in r.entries}) == 4


def test_formulas_return_in_order_of_place(spark):
    spans = F.array(*(F.struct(F.lit(p).alias("placeholder"), F.lit(o).alias("original")) for p, o in (("", "x"), ("", "long formula"), ("", ""))))
    frame = spark.createDataFrame([("a  b  c ",)], "t string").select(masking.mask_formulas(F.col("t"), spans).alias("m"), spans.alias("s"))
    row = frame.select("m", masking.unmask_formulas(F.col("m"), F.col("s")).alias("t")).first()
    assert row.m == "a ▨ b ▨ c ▨" and row.t == "a x b long formula c "


def test_many_documents_share_no_placeholders_across_batches(spark):
    """Documents lie whole in their order, whatever the batches; their rows are no groups of pandas rows, and other columns pass as they are."""
    rows = [(None if d == 0 else d, n, f"Doc {d % 7}.5 and IBM{'X' * (d % 3)} on line {n}, 1,{n:03d} items", [n, None], None) for d in range(40) for n in (3, 0, 2, 1)]
    rows.append((41, None, "ABC last", None, 7))
    rows.append((41, 0, None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, line_no int, line string, more array<int>, n int")
    want = {}
    for doc in {r[0] for r in rows}:
        registry = masking.Registry()
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1] is None, r[1] or 0)):
            text, found = masking.mask_text(r[2] or "", registry, "uz")
            want[doc, r[1]] = (r[2], r[3], r[4], text, [(e["placeholder"], e["original"]) for e in found])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        made = masking.mask_entities(df)
        got = {(r.doc_id, r.line_no): (r.line, r.more, r.n, r.masked, [tuple(e) for e in r.entries]) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
