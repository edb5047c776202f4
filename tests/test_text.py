import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import chunking, layout, masking, verify


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("line", "marker", "rest"), [("1. First item", "1.", "First item"), ("• Bullet item", "•", "Bullet item"), ("No marker here", None, "No marker here"), ("-5", "-", "5"), ("3.14", "3.", "14"), ("b) x", "b)", "x")])
def test_list_marker(spark, line, marker, rest):
    assert one(spark, T.list_marker(F.col("t")), t=line) == marker
    assert one(spark, T.without_marker(F.col("t")), t=line) == rest


@pytest.mark.parametrize(
    ("a", "b", "joined"),
    [("кни-", "га", True), ("кн-", "ига", True), ("а-", "2000", True), ("199-", "2000", False), ("ко-", "автор", False), ("-", "x", False), ("слово—-", "и", False), ("This is a hyphenated-", "word", False), ("em dash—", "it", False), ("rea-", "ding", True), ("x-", " ", False)],
)
def test_hyphens(spark, a, b, joined):
    assert one(spark, T.joins_next(F.col("a"), F.col("b")), a=a, b=b) is joined


def test_dehyphenation_chain(spark):
    rows = spark.createDataFrame([(1, 0, "rea-"), (1, 1, "da- "), (1, 2, " bly done"), (1, 3, "next")], "doc_id long, line_no long, line string")
    got = layout.dehyphenate(rows).orderBy("line_no").collect()
    assert [(r.line_no, r.n_lines, r.text) for r in got] == [(0, 3, "readably done"), (3, 1, "next")]


@pytest.mark.parametrize(
    ("original", "translated", "want"),
    [("HELLO", "translated", "TRANSLATED"), ("Hello World", "translated text", "Translated Text"), ("Salom", "privet", "Privet"), ("hello", "TRANSLATED", "TRANSLATED"), ("O'Zbek", "hello-world", "Hello-World"), ("Salom dunyo", "[x]abc", "[x]abc"), ("", "a", "a"), ("МИР", "мир", "МИР")],
)
def test_case(spark, original, translated, want):
    assert one(spark, T.restore_case(F.col("a"), F.col("b")), a=original, b=translated) == want


def test_typography(spark):
    assert one(spark, T.russian_typography(F.col("t")), t="\"Hello\" 'x' в доме и на мосту") == "«Hello» ‘x’ в доме и на мосту"


def test_normal_forms(spark):
    assert one(spark, T.normalize(F.col("t"), "uz"), t="o' o’ oʼ oʻ ﬁ") == "oʻ oʻ oʻ oʻ fi"
    assert one(spark, T.normalize(F.col("t"), "ru"), t="o' ﬁ") == "o' fi"


@pytest.mark.parametrize(("font", "math"), [("Cambria Math", True), ("ABC+CambriaMath-Bold", True), ("Times New Roman", False), ("CMMI10", True), (None, False)])
def test_math_fonts(spark, font, math):
    frame = spark.createDataFrame([(font,)], "t string")
    assert frame.select(T.is_math_font(F.col("t"))).first()[0] is math


@pytest.mark.parametrize(("text", "math"), [("∑∫∂", True), ("plain text", False), ("»", True), ("ﬁ", True), ("", False), ("tenglamaning butun sonlardan iborat", False)])
def test_math_characters(spark, text, math):
    assert one(spark, T.has_math_unicode(F.col("t")), t=text) is math


def test_unknown_language_is_an_error(spark):
    frame = spark.createDataFrame([("xx",)], "t string")
    with pytest.raises(Exception, match="unsupported language"):
        frame.select(T.language_code(F.col("t"))).collect()
    assert one(spark, T.language_code(F.col("t"), cyrillic=True), t="uz") == "uzn_Cyrl"


def test_word_chunks(spark):
    text = " ".join(f"word{i}" for i in range(50))
    chunks = one(spark, chunking.token_chunks(F.col("t"), 10), t=text)
    assert len(chunks) == 5 and all(len(c.split()) <= 10 for c in chunks) and " ".join(chunks) == text
    assert one(spark, chunking.token_chunks(F.col("t"), 10), t=" ") == []


def test_sentence_chunks(spark):
    text = "W0 w1. W2 w3. W4 w5. W6 w7. W8 w9. W10 w11."
    chunks = one(spark, chunking.sentence_chunks(F.col("t"), 5, limit=5), t=text)
    assert chunks == ["W0 w1. W2 w3.", "W4 w5. W6 w7.", "W8 w9. W10 w11."]
    assert one(spark, chunking.sentence_chunks(F.col("t"), 512), t=text) == [text]
    long = "A b c d e f g. H i."
    assert one(spark, chunking.sentence_chunks(F.col("t"), 5, limit=5), t=long) == ["A b c d e f g.", "H i."]


def test_abbreviations_end_no_sentence(spark):
    assert one(spark, chunking.sentences(F.col("t")), t="Dr. Smith came. See г. Москва! Yes… No? 5 x") == ["Dr. Smith came.", "See г. Москва!", "Yes…", "No?", "5 x"]


def test_batches(spark):
    frame = spark.createDataFrame([(i, "a" * (9 - i)) for i in range(9)], "i long, t string")
    by_length = {r.i: r.batch_id for r in chunking.length_batches(frame, F.length("t"), "i", 3).collect()}
    assert by_length == {8: 0, 7: 0, 6: 0, 5: 1, 4: 1, 3: 1, 2: 2, 1: 2, 0: 2}
    assert [r.batch_id for r in chunking.count_batches(frame, "i", 3).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize(
    ("src", "tgt", "reasons"),
    [
        ("a 12 b", "a 12 b", []), ("a 12 b", "a b c", ["numeric_mismatch"]), ("a b", "a b c d", ["length_ratio_outlier"]), ("", "x", []), ("a b", "kingda b", ["source_lang_bleed"]),
        ("a b c d", "x x x d", ["ngram_repetition"]), ("a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q", []),
    ],
)
def test_first_check(spark, src, tgt, reasons):
    assert verify.tier1(spark.createDataFrame([(src, tgt)], "src string, tgt string")).first().reasons == reasons


def test_second_check_keeps_hard_flags(spark):
    rows = [("abcdefghij 5", "x y", "abcdefghij 5"), ("abcde fgh", "x", "abcde fgh"), ("abcdefghij k", "x", "zz"), ("a b", "a b", None)]
    got = verify.tier2(verify.tier1(spark.createDataFrame(rows, "src string, tgt string, back string"))).collect()
    assert [r.flagged for r in got] == [True, False, True, False]
    assert got[2].reasons[-1] == "back_translation_mismatch" and got[3].overlap_score is None
    compat = verify.tier2(verify.tier1(spark.createDataFrame(rows, "src string, tgt string, back string")), clears_all=True).collect()
    assert [r.flagged for r in compat] == [False, False, True, False]


def test_unknown_language_is_no_failure(spark):
    frame = spark.createDataFrame([("a b", "a b")], "src string, tgt string")
    assert verify.tier1(frame).first().reasons == []
    assert verify.tier1(frame, unknown_fails=True).first().reasons == ["lid_failed"]


def test_release_gate(spark):
    frame = spark.createDataFrame([("False",), ("false",)], "flagged string")
    assert verify.release_gate(frame).first().summary == "PASS: 0 unresolved flags across 2 segments."
    assert verify.release_gate(frame.union(spark.createDataFrame([("True",)], "flagged string"))).first().summary == "FAIL: Unresolved flags: 1 / 3"


def test_confidence(spark):
    frame = spark.createDataFrame([([[0.0, 0.0], [10.0, -10.0]],), ([],)], "l array<array<double>>")
    got = [r[0] for r in frame.select(verify.mean_confidence(F.col("l"))).collect()]
    assert abs(got[0] - 0.75) < 1e-6 and got[1] == 1.0
    assert masking.tokenizer_report(lambda s: 1 / 0, str)["MATH"] is False
