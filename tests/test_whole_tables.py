"""Queries that leave out no row, against a version of their operator in plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagemill.plans import catalog, views

HARD = ["Straße", "STRAßE", "ß", "ßen Weg", "GRÜßE AUS İZMİR", "İzmir Bey", "cost $5 and $6", "$x$ $$y$$", "a $ b", "$$", "o'zbek", "O’zbek G'oya", "a ▨ b", "▨", "", " ", "ﬁn ｘ\u00a0y"]
UZBEK = str.maketrans(dict.fromkeys("’'ʼ", "ʻ"))


@pytest.fixture(scope="module")
def whole(spark, folder, tmp_path_factory):
    """The documents of the table, and one of hard lines and one for each of them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # the last has more LaTeX blocks than a document has placeholders
    texts = ["\n".join(HARD), *HARD, "\n".join(["$a$ $b$ $c$ $d$ $e$"] * 300)]
    more = [(10_000_000 + i, t, "de", "hard", len(t)) for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("whole"))
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(f.name).cast(f.dataType) for f in docs.schema))).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def lines(spark, whole):
    rows = spark.read.parquet(f"{whole}/documents.parquet").select("doc_id", "text").collect()
    return {(r.doc_id, i): line for r in rows if r.text is not None for i, line in enumerate(r.text.split("\n"))}


def _got(spark, whole, name):
    return {(r.doc_id, r.line_no): r for r in catalog.QUERIES[name](spark, whole).collect()}


def _cased(original, translated):
    if not original or not translated:
        return translated
    if original.isupper():
        return translated.upper()
    if original.istitle():
        return translated.title()
    return translated[0].upper() + translated[1:] if original[0].isupper() else translated


def test_case_of_all_lines(spark, whole, lines):
    got = {k: r.text for k, r in _got(spark, whole, "restore_case").items()}
    assert any("ß" in t for k, t in lines.items() if k[0] < 10_000_000)
    assert got == {k: _cased(t, t.lower()) for k, t in lines.items()}


def test_latex_of_all_lines(spark, whole, lines):
    got = _got(spark, whole, "latex_round_trip")
    assert any("$" in t for k, t in lines.items() if k[0] < 10_000_000)

    def blocks(line):
        line, shown = re.subn(r"\$\$(?:.|\n)+?\$\$", "#", f"$a^2$ and $$\\sum_i i$$ {line} $b_1$")
        return shown + len(re.findall(r"\$[^$\n]+\$", line))

    assert {k: (r.restored, r.n_blocks) for k, r in got.items()} == {k: (True, blocks(t)) for k, t in lines.items()}


def test_normal_form_of_all_lines(spark, whole, lines):
    got = {k: r.text for k, r in _got(spark, whole, "normalize_text").items()}
    assert got == {k: unicodedata.normalize("NFKC", f"o' {t}".translate(UZBEK) if k[1] % 2 == 0 else f"o' {t}") for k, t in lines.items()}


def test_formulas_of_all_lines(spark, whole, lines):
    got = {k: (r.shown, r.filled) for k, r in _got(spark, whole, "math_round_trip").items()}

    def filled(line, no):
        # a mark of the line's own has the place of a formula, as in the reference
        text = f"{line} ▨ = ▨"
        for original in (f"x² + {no}", chr(0xE001)):
            text = text.replace("▨", original, 1)
        return text

    assert got == {k: (f"{t} ▨ = ▨", filled(t, k[1])) for k, t in lines.items()}


def test_overlap_of_all_pairs(spark, whole):
    got = {r.doc_id: r.score for r in catalog.QUERIES["char_overlap"](spark, whole).collect()}
    pairs = {r.doc_id: (r.src, r.tgt) for r in views.pairs(spark, whole).collect()}
    assert any("ß" in src for k, (src, _) in pairs.items() if k < 10_000_000)
    want = {k: len(set(a.lower()) & set(b.lower())) / len(set(a.lower())) if a else 0.0 for k, (a, b) in pairs.items()}
    assert got == pytest.approx(want)


def test_keys_are_of_the_normal_form(spark, tmp_path):
    import hashlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["ﬁn", "fin", "ｘ", "x", "a\u00a0b", "a b", "e\u0301", "\u00e9"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pq.write_table(pa.table({"doc_id": [1], "text": ["\n".join(texts)], "lang": ["en"], "source": ["a"], "n_chars": [9]}), f"{tmp_path}/documents.parquet")
    got = {r.turn: r.key for r in catalog.QUERIES["cache_key"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(f"uz|ru|{unicodedata.normalize('NFKC', t)}|null".encode()).hexdigest() for i, t in enumerate(texts)}
    # every second text is in the cache, and the others are equal to them
    assert catalog.QUERIES["cache_misses"](spark, str(tmp_path)).count() == 0
    assert [r.cached is None for r in catalog.QUERIES["cache_probe"](spark, str(tmp_path)).collect()] == [False] * 8
    assert catalog.QUERIES["cache_upsert"](spark, str(tmp_path)).count() == 4
    made = {r.turn: (r.was_cached, r.raw) for r in catalog.QUERIES["translate_cached"](spark, str(tmp_path)).collect()}
    assert made == {i: (True, f"[rus_Cyrl]{t}") for i, t in enumerate(texts)}
    for name in ("flagship_report", "streaming_pages"):
        assert [r.n_keys for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == [4]


def test_dictionary_and_usage_of_all_documents(spark, whole, lines):
    """The entities of each document, found by the patterns one after the other, and how many placeholders they take."""
    from pagemill.operators import masking

    found = {}
    for (doc, _), text in sorted(lines.items()):
        own = found.setdefault(doc, set())
        for pattern in masking.entity_patterns("uz"):
            hits = [m for m in re.findall(pattern, text) if "" not in m]
            own.update(hits)
            text = re.sub(pattern, lambda m: m[0] if "" in m[0] else "", text)
    got = {}
    for r in catalog.QUERIES["ner_dictionary"](spark, whole).collect():
        got.setdefault(r.doc_id, {})[r.original] = r.placeholder
    assert {d: set(o) for d, o in got.items()} == {d: o for d, o in found.items() if o}
    # a placeholder stands for one text
    assert all(len(set(o.values())) == len(o) and all(0xE800 <= ord(p) < 0xF000 for p in o.values()) for o in got.values())
    used = {r.doc_id: (r.allocated, r.capacity, r.exhausted) for r in catalog.QUERIES["placeholder_usage"](spark, whole).collect()}
    assert used == {d: (len(o), 2048, False) for d, o in found.items() if o}
