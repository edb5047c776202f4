"""Queries on text: markers, normal forms, entities, masking, sentences, chunks, batches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import chunking, masking
from pagemill.plans import views
from pagemill.plans.layout_queries import MARK_SQL, REST_SQL, WORDS_SQL
from pagemill.sources import tables

LINES = f"WITH {views.LINES_SQL}"
#: RE2 knows ASCII word boundaries only: letters beyond ASCII become an ASCII word character first, one that the pattern has no use for.
ASCII_WORDS = r"regexp_replace({0}, '[\x{{{{00C0}}}}-\x{{{{00D6}}}}\x{{{{00D8}}}}-\x{{{{00F6}}}}\x{{{{00F8}}}}-\x{{{{024F}}}}\x{{{{0400}}}}-\x{{{{04FF}}}}]', '{{mark}}', 'g')"
ENTITIES = {
    "dates": masking.DATES[0], "month_dates": masking.DATES[2], "percents": masking.NUMBERS[0], "dollars": masking.NUMBERS[1], "grouped_numbers": masking.NUMBERS[3],
    "decimals": masking.NUMBERS[4], "emails": masking.EMAIL, "urls": masking.URL, "capitals": masking.CAPITALS, "capitalised": masking.CAPITALISED,
}

BOUNDARY_SQL = r"""([.!?…])\s+([A-ZА-ЯЁ0-9"''`(«])"""
ABBREVIATION_SQL = "|".join(a[:-1].replace(".", "\\.") for a in chunking.ABBREVIATIONS)
SENTENCES_SQL = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}])({ABBREVIATION_SQL})\.', '\1\2{chunking.HELD}', 'g'), '{BOUNDARY_SQL}', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda s: regexp_replace(replace(s, '{chunking.HELD}', '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


def register(catalog) -> None:
    add = catalog.add

    @add("list_marker", LINES + f" SELECT doc_id, line_no, {MARK_SQL.format('line')} AS marker, {REST_SQL.format('line')} AS rest FROM lines")
    def list_marker(spark, folder):
        return views.lines(spark, folder).select("doc_id", "line_no", T.list_marker(F.col("line")).alias("marker"), T.without_marker(F.col("line")).alias("rest"))

    @add("marker_reattach", LINES + f", m AS (SELECT doc_id, line_no, {MARK_SQL.format('line')} AS marker, {REST_SQL.format('line')} AS rest FROM lines) SELECT doc_id, line_no, CASE WHEN marker IS NULL THEN rest ELSE marker || ' ' || rest END AS text FROM m")
    def marker_reattach(spark, folder):
        line = F.col("line")
        return views.lines(spark, folder).select("doc_id", "line_no", T.with_marker(T.without_marker(line), T.list_marker(line)).alias("text"))

    @add("uz_normalize", LINES + " SELECT doc_id, line_no, translate('o’zbek ' || line || ' g''oya oʼ', '’''ʼ', 'ʻʻʻ') AS text FROM lines")
    def uz_normalize(spark, folder):
        text = F.concat(F.lit("o’zbek "), "line", F.lit(" g'oya oʼ"))
        return views.lines(spark, folder).select("doc_id", "line_no", T.canonical_apostrophes(text).alias("text"))

    @add("nfkc", LINES + " SELECT doc_id, line_no, 'fi ' || line AS text FROM lines")
    def nfkc(spark, folder):
        return views.lines(spark, folder).select("doc_id", "line_no", T.nfkc(F.concat(F.lit("ﬁ "), "line")).alias("text"))

    # DuckDB has no NFKC; the tests compare lines that it changes
    normalize_sql = LINES + " SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN translate('o'' ' || line, '’''ʼ', 'ʻʻʻ') ELSE 'o'' ' || line END AS text FROM lines"

    @add("normalize_text", normalize_sql)
    def normalize_text(spark, folder):
        source = F.when(F.col("line_no") % 2 == 0, F.lit("uz")).otherwise(F.lit("ru"))
        return views.lines(spark, folder).select("doc_id", "line_no", T.normalize(F.concat(F.lit("o' "), "line"), source).alias("text"))

    for name, pattern in ENTITIES.items():
        # the oracle sees the same matches on its ASCII copy: the patterns match ASCII only
        copy = ASCII_WORDS.format("text").format(mark="_" if name.startswith("capital") else "q")
        sql = f"SELECT doc_id, len(regexp_extract_all({copy}, '{pattern}')) AS n, array_to_string(regexp_extract_all({copy}, '{pattern}'), ' ') AS found FROM documents"

        @add(f"ner_{name}", sql)
        def ner(spark, folder, pattern=pattern):
            found = masking.entities(F.col("text"), pattern)
            return views.documents(spark, folder).select("doc_id", found.alias("f")).select("doc_id", F.size("f").cast("long").alias("n"), F.array_join("f", " ").alias("found"))

    # what the masking looks for, as matches on the line's ASCII copy
    ascii_line = ASCII_WORDS.format("line").format(mark="_")
    any_entity = " OR ".join(f"regexp_matches({ascii_line}, '{p}')" for p in masking.entity_patterns("uz"))

    @add("ner_round_trip", LINES + f" SELECT doc_id, line_no, {any_entity} AS masked, true AS restored FROM lines")
    def ner_round_trip(spark, folder):
        masked = masking.mask_entities(views.lines(spark, folder), "uz")
        back = masking.restore(F.col("masked"), F.col("entries")) == F.col("line")
        return masked.select("doc_id", "line_no", ((F.col("masked") != F.col("line")) & (F.size("entries") > 0)).alias("masked"), back.alias("restored"))

    @add("ner_dictionary")
    def ner_dictionary(spark, folder):
        masked = masking.mask_entities(views.lines(spark, folder), "uz")
        return masked.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.original", "e.placeholder").distinct()

    @add("placeholder_usage")
    def placeholder_usage(spark, folder):
        masked = masking.mask_entities(views.lines(spark, folder), "uz")
        rows = masked.select("doc_id", F.lit("NER").alias("kind"), F.explode("entries").alias("e")).select("doc_id", "kind", "e.placeholder")
        return masking.usage(rows)

    # displayed blocks first, then inline ones; every placeholder is shown as the same mark
    shown_sql = rf"regexp_replace('$a^2$ and $$\sum_i i$$ ' || line || ' $b_1$', '\$\$[\s\S]+?\$\$', '¤', 'g')"
    latex_sql = LINES + rf", d AS (SELECT doc_id, line_no, {shown_sql} AS t, length({shown_sql}) - length(replace({shown_sql}, '¤', '')) - (length(line) - length(replace(line, '¤', ''))) AS displayed FROM lines) SELECT doc_id, line_no, true AS restored, displayed + len(regexp_extract_all(t, '\$[^$\n]+\$')) AS n_blocks, regexp_replace(t, '\$[^$\n]+\$', '¤', 'g') AS shown FROM d"

    @add("latex_round_trip", latex_sql)
    def latex_round_trip(spark, folder):
        found = views.lines(spark, folder).withColumn("line", F.concat(F.lit("$a^2$ and $$\\sum_i i$$ "), "line", F.lit(" $b_1$")))
        # three blocks more in each line: a page of lines has the placeholders that a document would have
        pages = found.withColumn("page", F.concat_ws(" ", "doc_id", F.expr(f"line_no div {views.PER_PAGE}")))
        masked = masking.protect_latex(pages, "page")
        back = masking.restore(F.col("masked"), F.col("entries")) == F.col("line")
        shown = F.regexp_replace("masked", "[\uf000-\uf7ff]", "¤")
        return masked.select("doc_id", "line_no", back.alias("restored"), F.size("entries").cast("long").alias("n_blocks"), shown.alias("shown"))

    formula = "'x² + ' || {0}"
    # a mark of the line's own has the place of a formula
    put = "regexp_replace({0}, '▨', {1})"
    math_sql = LINES + f" SELECT doc_id, line_no, line || ' ▨ = ▨' AS shown, {put.format(put.format("line || ' ▨ = ▨'", formula.format('line_no')), 'chr(57345)')} AS filled FROM lines"

    @add("math_round_trip", math_sql)
    def math_round_trip(spark, folder):
        first, second = "\ue000", "\ue001"
        text = F.concat("line", F.lit(f" {first} = {second}"))
        own = F.concat(F.lit("x² + "), F.col("line_no").cast("string"))
        entry = lambda mark, original: F.struct(F.lit(mark).alias("placeholder"), original.alias("original"))
        spans = F.array(entry(first, own), entry(second, F.lit("")))
        found = views.lines(spark, folder).select("doc_id", "line_no", masking.mask_formulas(text, spans).alias("shown"), spans.alias("spans"))
        return found.select("doc_id", "line_no", "shown", masking.unmask_formulas(F.col("shown"), F.col("spans")).alias("filled"))

    placeholder_sql = "WITH " + views.LINES_SQL + ", n AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k FROM lines) SELECT doc_id, line_no, chr((57344 + k)::INTEGER) AS placeholder FROM n"

    @add("sequential_placeholders", placeholder_sql)
    def sequential_placeholders(spark, folder):
        return masking.sequential(views.lines(spark, folder), "MATH", "doc_id", ["line_no"]).select("doc_id", "line_no", "placeholder")

    @add("sentence_split", f"SELECT doc_id, len({SENTENCES_SQL}) AS n_sentences, array_to_string({SENTENCES_SQL}, '|') AS sentences FROM documents")
    def sentence_split(spark, folder):
        found = views.documents(spark, folder).select("doc_id", chunking.sentences(F.col("text")).alias("s"))
        return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))

    chunk_sql = f"""WITH s AS (SELECT doc_id, text, len({WORDS_SQL.format('text')}) AS total, {SENTENCES_SQL} AS parts FROM documents),
      w AS (SELECT doc_id, text, total, list_transform(parts, lambda p: {{'k': 1, 'n': len(list_filter(string_split_regex(p, '\\s+'), lambda q: q <> '')), 'm': 0, 't': p}}) AS ws FROM s),
      f AS (SELECT doc_id, text, total, CASE WHEN len(ws) > 0 THEN list_reduce(ws, lambda a, x: CASE WHEN a.n + x.n <= 39 THEN {{'k': a.k, 'n': a.n + x.n, 'm': a.m, 't': a.t || ' ' || x.t}} ELSE {{'k': a.k + 1, 'n': x.n, 'm': greatest(a.m, a.n), 't': a.t || '|' || x.t}} END) END AS r FROM w)
      SELECT doc_id, CASE WHEN total <= 39 THEN 1 ELSE r.k END AS n_chunks, CASE WHEN total <= 39 THEN total ELSE greatest(r.m, r.n) END AS longest, CASE WHEN total <= 39 THEN text ELSE r.t END AS chunks FROM f"""

    @add("sentence_chunks", chunk_sql)
    def sentence_chunks(spark, folder):
        found = views.documents(spark, folder).select("doc_id", chunking.sentence_chunks(F.col("text"), 50).alias("c"))
        return found.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.array_max(F.transform("c", chunking.word_length)).cast("long").alias("longest"), F.array_join("c", "|").alias("chunks"))

    token_sql = f"WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS ws FROM documents), c AS (SELECT doc_id, ws, unnest(range((len(ws) + 63) // 64)) AS chunk_no FROM w) SELECT doc_id, chunk_no, array_to_string(ws[chunk_no * 64 + 1:chunk_no * 64 + 64], ' ') AS chunk FROM c"

    @add("token_chunks", token_sql)
    def token_chunks(spark, folder):
        found = views.documents(spark, folder).select("doc_id", F.posexplode(chunking.token_chunks(F.col("text"), 64)).alias("chunk_no", "chunk"))
        return found.withColumn("chunk_no", F.col("chunk_no").cast("long"))

    batch_sql = "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {0}) - 1) // 8 AS batch_id FROM documents"

    @add("length_batches", batch_sql.format("length(text), doc_id"))
    def length_batches(spark, folder):
        return chunking.length_batches(views.documents(spark, folder), F.length("text"), "doc_id", 8, ("lang",)).select("doc_id", "lang", "batch_id")

    @add("count_batches", batch_sql.format("doc_id"))
    def count_batches(spark, folder):
        return chunking.count_batches(views.documents(spark, folder), "doc_id", 8, ("lang",)).select("doc_id", "lang", "batch_id")

    @add("restore_batches", batch_sql.format("length(text), doc_id").replace("AS batch_id", "AS batch_id, length(text) AS n_chars"))
    def restore_batches(spark, folder):
        docs = views.documents(spark, folder).select("doc_id", "lang", "text")
        sent = chunking.length_batches(docs, F.length("text"), "doc_id", 8, ("lang",)).select("doc_id", "batch_id")
        return docs.join(sent, "doc_id").select("doc_id", "lang", "batch_id", F.length("text").cast("long").alias("n_chars"))

    # DuckDB leaves the sharp s as it is in upper case
    up = "replace(upper({0}), 'ß', 'SS')"
    title_sql = f"""array_to_string(list_transform(string_split(lower(line), ''), lambda c, i: CASE WHEN i = 1 OR NOT regexp_matches(string_split(lower(line), '')[i - 1], '\\p{{L}}') THEN {up.format('c')} ELSE c END), '')"""
    case_sql = (
        LINES
        + rf""" SELECT doc_id, line_no, CASE WHEN line = '' THEN lower(line) WHEN {up.format('line')} = line AND lower(line) <> line THEN {up.format('line')}
      WHEN regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(line, '\p{{L}}\p{{Lu}}') THEN {title_sql}
      WHEN {up.format('left(line, 1)')} = left(line, 1) AND lower(left(line, 1)) <> left(line, 1) THEN {up.format('left(lower(line), 1)')} || substr(lower(line), 2) ELSE lower(line) END AS text FROM lines"""
    )

    @add("restore_case", case_sql)
    def restore_case(spark, folder):
        return views.lines(spark, folder).select("doc_id", "line_no", T.restore_case(F.col("line"), F.lower("line")).alias("text"))

    short = "|".join(T.SHORT_WORDS)
    once = rf"regexp_replace({{0}}, '(^|[^\p{{{{L}}}}\p{{{{N}}}}_])({short})\s+', '\1\2' || chr(160), 'g')"
    quoted = r"""regexp_replace(regexp_replace('и в доме "мир" под ''дом'' ' || line || ' я', '"([^"]*)"', '«\1»', 'g'), '''([^'']*)''', '‘\1’', 'g')"""

    @add("ru_typography", LINES + f" SELECT doc_id, line_no, {once.format(once.format(quoted))} AS text FROM lines")
    def ru_typography(spark, folder):
        text = F.concat(F.lit("и в доме \"мир\" под 'дом' "), "line", F.lit(" я"))
        return views.lines(spark, folder).select("doc_id", "line_no", T.russian_typography(text).alias("text"))

    @add("language_codes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'rus_Cyrl' ELSE 'uzn_Latn' END AS code, CASE WHEN doc_id % 2 = 0 THEN 'uz' ELSE 'ru' END AS source FROM documents")
    def language_codes(spark, folder):
        target = F.when(F.col("doc_id") % 2 == 0, F.lit("ru")).otherwise(F.lit("uz"))
        return views.documents(spark, folder).select("doc_id", T.language_code(target).alias("code"), T.source_language(target).alias("source"))

    @add("placeholder_survival", "SELECT doc_id, doc_id % 3 <> 1 AS survives FROM documents")
    def placeholder_survival(spark, folder):
        marks = F.element_at(T.keyword_list([chr(b) for b in masking.BASE.values()]), (F.col("doc_id") % 3 + 1).cast("int"))
        # a tokenizer that knows no character of the second kind
        encode = lambda s: "".join("?" if 0xE800 <= ord(c) < 0xF000 else c for c in s)
        return views.documents(spark, folder).select("doc_id", masking.survives(marks, encode, lambda s: s).alias("survives"))

    fonts = ", ".join(f"('{variant}', '{path}')" for variant, path in tables.FONTS)

    @add("font_catalog", f"SELECT variant, path FROM (VALUES {fonts}) AS f(variant, path)")
    def font_catalog(spark, folder):
        return tables.font_catalog(spark)
