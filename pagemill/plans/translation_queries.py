"""Queries on translation: cache, models, verification, reports, pipeline, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import report, translate, verify
from pagemill.plans import document_pipeline, views
from pagemill.plans.layout_queries import BOXED, CHAIN_SQL, CLUSTER_SQL, MARK_SQL, REST_SQL, WORDS_SQL, hyphen_ctes, order_ctes
from pagemill.sources import tables
from pagemill.streaming import pages as streaming

KEY_SQL = "md5('uz|ru|' || trim({0}) || '|null')"
PAIRS = f"WITH {views.PAIRS_SQL}"
#: RE2 digit runs with Unicode word boundaries, by way of an ASCII copy of the text.
NUMBERS_SQL = r"list_distinct(regexp_extract_all(regexp_replace({0}, '[\x{{00C0}}-\x{{00D6}}\x{{00D8}}-\x{{00F6}}\x{{00F8}}-\x{{024F}}]', 'q', 'g'), '\b\d+\b'))"
CHECK_SQL = (
    PAIRS
    + f""", w AS (SELECT doc_id, src, tgt, {WORDS_SQL.format('src')} AS sw, {WORDS_SQL.format('tgt')} AS tw, {NUMBERS_SQL.format('src')} AS sn, {NUMBERS_SQL.format('tgt')} AS tn FROM pairs),
  c AS (SELECT doc_id, src, tgt, len(list_filter(sn, lambda x: NOT list_contains(tn, x))) > 0 AS numeric,
    CASE WHEN len(sw) > 0 THEN len(tw)::DOUBLE / len(sw) END AS ratio, regexp_matches(tgt, '[OoGg][''ʻ]|[Nn]g') AS bleed,
    len(list_filter(range(1, len(tw) - 1), lambda i: tw[i] = tw[i + 1] AND tw[i] = tw[i + 2])) > 0 AS repeats FROM w),
  r AS (SELECT *, coalesce(ratio < 0.85::DOUBLE OR ratio > 1.6::DOUBLE, false) AS outlier,
    list_filter([CASE WHEN numeric THEN 'numeric_mismatch' END, CASE WHEN coalesce(ratio < 0.85::DOUBLE OR ratio > 1.6::DOUBLE, false) THEN 'length_ratio_outlier' END,
      CASE WHEN bleed THEN 'source_lang_bleed' END, CASE WHEN repeats THEN 'ngram_repetition' END], lambda x: x IS NOT NULL) AS reasons FROM c)"""
)
OVERLAP_SQL = "len(list_intersect(list_distinct(string_split(lower({0}), '')), list_distinct(string_split(lower({1}), ''))))::DOUBLE / len(list_distinct(string_split(lower({0}), '')))"


def _mock(texts: list[str], source: str, target: str) -> list[str]:
    return [f"[{target}]{t}" for t in texts]


def _checked(spark, folder):
    return verify.tier1(views.pairs(spark, folder))


def _second(spark, folder):
    # the stand-in for a back-translation: the source without its first half, where the id is odd
    back = F.when(F.col("doc_id") % 2 == 0, F.col("src")).otherwise(F.lit("xqz"))
    return verify.tier2(_checked(spark, folder).withColumn("back", back))


def _cache(spark, folder):
    talk = tables.table(spark, folder, "conversations").filter("turn % 2 = 0").select("text").distinct()
    made = talk.select(T.cache_key(F.lit("uz"), F.lit("ru"), T.nfkc(F.col("text"))).alias("key"), F.concat(F.lit("[rus_Cyrl]"), "text").alias("translated_text"))
    made = made.groupBy("key").agg(F.min("translated_text").alias("translated_text"))
    return made.select("key", "translated_text", F.lit(1).alias("schema_version"), F.lit(None).cast("string").alias("glossary_hash"))


def _talk(spark, folder):
    return translate.keyed(tables.table(spark, folder, "conversations"), "uz", "ru")


CACHE_SQL = f"cache AS (SELECT {KEY_SQL.format('text')} AS key, min('[rus_Cyrl]' || text) AS translated_text FROM conversations WHERE turn % 2 = 0 GROUP BY ALL), talk AS (SELECT *, {KEY_SQL.format('text')} AS key FROM conversations)"


def register(catalog) -> None:
    add = catalog.add

    flagship = f"""WITH {views.LINES_SQL}, m AS (SELECT doc_id, lang, line_no, {MARK_SQL.format('line')} AS marker, {REST_SQL.format('line')} AS src FROM lines WHERE length(trim(line)) > 0),
      t AS (SELECT *, {KEY_SQL.format('src')} AS key, '[rus_Cyrl]' || src AS tgt FROM m), w AS (SELECT *, {WORDS_SQL.format('src')} AS sw, {WORDS_SQL.format('tgt')} AS tw FROM t)
      SELECT lang, count(*) AS n_lines, count(marker) AS n_marked, count(DISTINCT key) AS n_keys,
        count_if(regexp_matches(tgt, '[OoGg][''ʻ]|[Nn]g'))::BIGINT AS n_bleed, count_if(len(sw) > 0 AND (len(tw)::DOUBLE / len(sw) < 0.85::DOUBLE OR len(tw)::DOUBLE / len(sw) > 1.6::DOUBLE))::BIGINT AS n_ratio,
        count_if(len(list_filter(range(1, len(tw) - 1), lambda i: tw[i] = tw[i + 1] AND tw[i] = tw[i + 2])) > 0)::BIGINT AS n_repeats FROM w GROUP BY lang"""

    @add("flagship_report", flagship)
    def flagship_report(spark, folder):
        line = F.col("line")
        found = views.lines(spark, folder).filter(F.length(F.trim("line")) > 0).select("lang", T.list_marker(line).alias("marker"), T.without_marker(line).alias("src"))
        found = translate.keyed(found, "uz", "ru", "src").withColumn("tgt", translate.mock_translation(F.col("src"), "ru"))
        src, tgt = F.col("src"), F.col("tgt")
        return found.groupBy("lang").agg(
            F.count("*").alias("n_lines"), F.count("marker").alias("n_marked"), F.count_distinct("key").alias("n_keys"), F.count_if(verify.source_bleed(tgt, F.lit("ru"))).alias("n_bleed"),
            F.count_if(verify.length_outlier(src, tgt)).alias("n_ratio"), F.count_if(verify.repeats(tgt)).alias("n_repeats"),
        )

    @add("cache_key", f"SELECT conv_id, turn, {KEY_SQL.format('text')} AS key FROM conversations")
    def cache_key(spark, folder):
        return _talk(spark, folder).select("conv_id", "turn", "key")

    @add("cache_probe", f"WITH {CACHE_SQL} SELECT conv_id, turn, translated_text AS cached FROM talk LEFT JOIN cache USING (key)")
    def cache_probe(spark, folder):
        return translate.probe(_talk(spark, folder), _cache(spark, folder)).select("conv_id", "turn", "cached")

    @add("cache_misses", f"WITH {CACHE_SQL} SELECT key, min(text) AS text FROM talk WHERE key NOT IN (SELECT key FROM cache) GROUP BY key")
    def cache_misses(spark, folder):
        return translate.misses(_talk(spark, folder), _cache(spark, folder))

    upsert_sql = f"WITH {CACHE_SQL}, n AS (SELECT key, max('new ' || text) AS translated_text FROM talk WHERE turn % 3 = 0 GROUP BY key) SELECT key, coalesce(n.translated_text, c.translated_text) AS translated_text FROM cache c FULL JOIN n USING (key)"

    @add("cache_upsert", upsert_sql)
    def cache_upsert(spark, folder):
        new = _talk(spark, folder).filter("turn % 3 = 0").groupBy("key").agg(F.max(F.concat(F.lit("new "), "text")).alias("translated_text"))
        new = new.select("key", "translated_text", F.lit(1).alias("schema_version"), F.lit(None).cast("string").alias("glossary_hash"))
        return translate.upsert(_cache(spark, folder), new).select("key", "translated_text")

    @add("translate_cached", f"WITH {CACHE_SQL} SELECT conv_id, turn, key IN (SELECT key FROM cache) AS was_cached, '[rus_Cyrl]' || text AS raw FROM talk")
    def translate_cached(spark, folder):
        cache = _cache(spark, folder)
        known = _talk(spark, folder)
        new = translate.run_model(translate.misses(known, cache), _mock, "uz", "ru")
        merged = cache.select("key", "translated_text", F.lit(True).alias("was_cached")).unionByName(new.withColumn("was_cached", F.lit(False)))
        # texts of one key are the same but for outer white space and normal form: the raw output is given the item's own text
        out = known.join(merged, "key", "left")
        return out.select("conv_id", "turn", "was_cached", F.when(F.contains(T.nfkc(F.col("translated_text")), F.trim(T.nfkc(F.col("text")))), F.concat(F.lit("[rus_Cyrl]"), "text")).alias("raw"))

    @add("verify_numeric", CHECK_SQL + " SELECT doc_id, numeric AS mismatch FROM r")
    def verify_numeric(spark, folder):
        return views.pairs(spark, folder).select("doc_id", verify.numeric_mismatch(F.col("src"), F.col("tgt")).alias("mismatch"))

    @add("verify_length", CHECK_SQL + " SELECT doc_id, ratio, outlier FROM r")
    def verify_length(spark, folder):
        src, tgt = F.col("src"), F.col("tgt")
        return views.pairs(spark, folder).select("doc_id", verify.length_ratio(src, tgt).alias("ratio"), verify.length_outlier(src, tgt).alias("outlier"))

    @add("verify_bleed", CHECK_SQL + " SELECT doc_id, bleed FROM r")
    def verify_bleed(spark, folder):
        return views.pairs(spark, folder).select("doc_id", verify.source_bleed(F.col("tgt"), F.lit("ru")).alias("bleed"))

    @add("verify_ngram", CHECK_SQL + " SELECT doc_id, repeats FROM r")
    def verify_ngram(spark, folder):
        return views.pairs(spark, folder).select("doc_id", verify.repeats(F.col("tgt")).alias("repeats"))

    @add("verify_language", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'false' WHEN length(text) % 3 = 0 THEN 'unknown' ELSE 'true' END AS in_language FROM documents")
    def verify_language(spark, folder):
        # the stand-in for a language model says what the text's first word says, and nothing of some lengths
        known = F.when(F.col("doc_id") % 4 == 0, F.lit("uz ")).when(F.length("text") % 3 == 0, F.lit("?? ")).otherwise(F.lit("ru "))
        found = verify.identified(F.concat(known, "text"), F.lit("ru"), lambda t: None if t[:2] == "??" else (t[:2], 0.9))
        return views.documents(spark, folder).select("doc_id", F.coalesce(found.cast("string"), F.lit("unknown")).alias("in_language"))

    @add("verify_tier1", CHECK_SQL + " SELECT doc_id, array_to_string(reasons, '|') AS reasons, len(reasons) > 0 AS flagged FROM r")
    def verify_tier1(spark, folder):
        return _checked(spark, folder).select("doc_id", F.array_join("reasons", "|").alias("reasons"), "flagged")

    @add("char_overlap", PAIRS + f" SELECT doc_id, CASE WHEN src = '' THEN 0 ELSE {OVERLAP_SQL.format('src', 'tgt')} END AS score FROM pairs")
    def char_overlap(spark, folder):
        return views.pairs(spark, folder).select("doc_id", T.char_overlap(F.col("src"), F.col("tgt")).alias("score"))

    tier2 = CHECK_SQL + ", z AS (SELECT doc_id, src, reasons, len(reasons) > 0 AS due, doc_id % 2 = 0 AS good FROM r) SELECT doc_id, due AND (NOT good OR list_contains(reasons, 'numeric_mismatch')) AS flagged, due AS tier2_executed, array_to_string(CASE WHEN due AND NOT good THEN list_append(reasons, 'back_translation_mismatch') ELSE reasons END, '|') AS reasons FROM z"

    @add("verify_tier2", tier2)
    def verify_tier2(spark, folder):
        return _second(spark, folder).select("doc_id", "flagged", "tier2_executed", F.array_join("reasons", "|").alias("reasons"))

    @add("report_rows", CHECK_SQL + " SELECT doc_id % 100 AS page, left(src, 80) AS source_preview, left(tgt, 80) AS translation_preview, len(reasons) > 0 AS flagged, array_to_string(reasons, '|') AS reasons, false AS tier2_executed, '{}' AS tier2_metrics FROM r")
    def report_rows(spark, folder):
        return report.rows(_checked(spark, folder).withColumn("page", F.col("doc_id") % 100))

    @add("annotations", CHECK_SQL + " SELECT doc_id, 1.0::DOUBLE AS r, 0.8::DOUBLE AS g, 0.8::DOUBLE AS b FROM r WHERE len(reasons) > 0")
    def annotations(spark, folder):
        return report.annotations(_checked(spark, folder).withColumn("tier2_executed", F.lit(False)), ["doc_id"])

    gate = CHECK_SQL + ", g AS (SELECT count_if(len(reasons) > 0)::BIGINT AS n_flagged, count(*) AS n_rows FROM r) SELECT n_flagged = 0 AS passed, n_flagged, n_rows, CASE WHEN n_flagged = 0 THEN 'PASS: 0 unresolved flags across ' || n_rows || ' segments.' ELSE 'FAIL: Unresolved flags: ' || n_flagged || ' / ' || n_rows END AS summary FROM g"

    @add("release_gate", gate)
    def release_gate(spark, folder):
        return verify.release_gate(_checked(spark, folder))

    @add("glossary_enforce", PAIRS + " SELECT doc_id, NOT (contains(src, 'the') AND NOT contains(tgt, 'the')) AND NOT (contains(src, 'de') AND NOT contains(tgt, 'le')) AS kept FROM pairs")
    def glossary_enforce(spark, folder):
        locks = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("the", "the"), ("de", "le"))))
        return views.pairs(spark, folder).select("doc_id", verify.glossary_kept(F.col("src"), F.col("tgt"), locks).alias("kept"))

    @add("glossary_lookup", "WITH g(term, locked) AS (VALUES ('en', 'inglizcha'), ('fr', 'fransuzcha')) SELECT doc_id, lang AS term, locked FROM documents LEFT JOIN g ON lang = term")
    def glossary_lookup(spark, folder):
        glossary = spark.createDataFrame([("en", "inglizcha"), ("fr", "fransuzcha")], "source string, target string")
        return verify.glossary_target(views.documents(spark, folder).select("doc_id", F.col("lang").alias("term")), glossary).select("doc_id", "term", "locked")

    @add("benchmark_matrix", "SELECT item_id, engine, '[' || engine || '] ' || text AS output FROM benchmark, (VALUES ('small'), ('medium'), ('large')) e(engine)")
    def benchmark_matrix(spark, folder):
        return translate.benchmark(tables.table(spark, folder, "benchmark"), ["small", "medium", "large"]).select("item_id", "engine", "output")

    steps = ", ".join(f"1.0 / list_sum(list_transform(embedding[{a}:{a + 15}], lambda x: exp(x::DOUBLE - list_max(embedding[{a}:{a + 15}])::DOUBLE)))" for a in (1, 17, 33, 49))

    @add("confidence_mean", f"SELECT vec_id, round(list_avg([{steps}]), 6) AS confidence FROM embeddings")
    def confidence_mean(spark, folder):
        logits = F.array(*(F.slice("embedding", a, 16) for a in (1, 17, 33, 49)))
        return tables.table(spark, folder, "embeddings").select("vec_id", F.round(verify.mean_confidence(logits), 6).alias("confidence"))

    counters = f"WITH {views.LINES_SQL} SELECT doc_id, count(*) AS n_lines, count_if(trim(line) = '')::BIGINT AS n_blank, count_if(line_no % 9 = 4)::BIGINT AS n_math, count_if(trim(line) <> '' AND line_no % 9 <> 4)::BIGINT AS n_sent FROM lines GROUP BY doc_id"

    @add("pipeline_counters", counters)
    def pipeline_counters(spark, folder):
        blank, math = F.trim("line") == "", F.col("line_no") % 9 == 4
        return views.lines(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(math).alias("n_math"), F.count_if(~blank & ~math).alias("n_sent"))

    @add("streaming_pages", flagship)
    def streaming_pages(spark, folder):
        schema = tables.table(spark, folder, "documents").schema
        out = streaming.scratch_folder(spark)

        def work(batch):
            line = F.col("line")
            found = tables.lines(batch).filter(F.length(F.trim("line")) > 0).select("lang", T.list_marker(line).alias("marker"), T.without_marker(line).alias("src"))
            return translate.keyed(found, "uz", "ru", "src").withColumn("tgt", translate.mock_translation(F.col("src"), "ru"))

        streaming.run_available(streaming.stream_table(spark, folder, "documents.parquet", schema), work, f"{out}/rows", f"{out}/checkpoint")
        rows, src, tgt = spark.read.parquet(f"{out}/rows"), F.col("src"), F.col("tgt")
        return rows.groupBy("lang").agg(
            F.count("*").alias("n_lines"), F.count("marker").alias("n_marked"), F.count_distinct("key").alias("n_keys"), F.count_if(verify.source_bleed(tgt, F.lit("ru"))).alias("n_bleed"),
            F.count_if(verify.length_outlier(src, tgt)).alias("n_ratio"), F.count_if(verify.repeats(tgt)).alias("n_repeats"),
        )

    # every ninth line is a formula; the SQL goes from lines to paragraphs as the pipeline does
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.MATH_RANGES)
    formula = f"length(line) > 0 AND length(regexp_replace(line, '[^{ranges}]', '', 'g'))::DOUBLE / greatest(length(line), 1) >= 0.15::DOUBLE"
    pipeline_sql = f"""{BOXED}, formulas AS (SELECT * REPLACE (CASE WHEN line_no % 9 = 4 THEN '∑x ∫y ∂z' ELSE line END AS line) FROM layout),
      kept AS (SELECT *, {formula} AS is_math FROM formulas WHERE NOT (y0 < 792.0::DOUBLE * 0.05::DOUBLE OR y1 > 792.0::DOUBLE * 0.95::DOUBLE) AND length(trim(line)) > 0), {order_ctes('kept')},
      o AS (SELECT kept.* REPLACE (reading_pos AS line_no) FROM kept JOIN placed_blocks ON kept.doc_id = placed_blocks.doc_id AND kept.page_no = placed_blocks.page_no AND kept.line_no = block_no),
      u AS (SELECT *, sum(CASE WHEN is_math THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS t FROM o),
      v AS (SELECT *, CASE WHEN is_math THEN -t ELSE t END AS turn FROM u), {hyphen_ctes('v', 'doc_id, page_no, turn')},
      joined AS (SELECT doc_id, page_no, min(line_no) AS line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(fontsize, line_no) AS fontsize, {CHAIN_SQL} AS line, arg_min(is_math, line_no) AS is_math FROM chains GROUP BY doc_id, page_no, turn, chain)
      {CLUSTER_SQL.replace("FROM layout", "FROM joined")},
      q AS (SELECT *, bool_and(is_math) OVER (PARTITION BY doc_id, page_no, para_no) AS whole_math FROM clustered),
      y AS (SELECT doc_id, page_no, para_no, any_value(whole_math) AS whole_math, string_agg(CASE WHEN is_math AND NOT whole_math THEN '▨' ELSE trim(line) END, ' ' ORDER BY line_no) AS whole FROM q GROUP BY ALL),
      r AS (SELECT doc_id, whole_math, {REST_SQL.format('whole')} AS text FROM y)
      SELECT doc_id, count(*) AS processed, count_if(whole_math)::BIGINT AS skipped_math, sum(length(text))::BIGINT AS n_chars, count_if(NOT whole_math AND length(trim(replace(text, '▨', ''))) = 0)::BIGINT AS pure_placeholder FROM r GROUP BY doc_id"""

    def with_formulas(spark, folder):
        found = views.layout(spark, folder)
        return found.withColumn("line", F.when(F.col("line_no") % 9 == 4, F.lit("∑x ∫y ∂z")).otherwise(F.col("line")))

    @add("document_pipeline_counters", pipeline_sql)
    def document_pipeline_counters(spark, folder):
        made = document_pipeline.run(with_formulas(spark, folder), _cache(spark, folder), _mock, "ru", views.PAGE_HEIGHT)
        return made.counters.select("doc_id", "processed", "skipped_math", "n_chars", "pure_placeholder")

    @add("document_pipeline")
    def document_pipeline_report(spark, folder):
        made = document_pipeline.run(views.layout(spark, folder), _cache(spark, folder), _mock, "ru", views.PAGE_HEIGHT, glossary=[("the", "the")], back_fn=_mock)
        return made.report

    @add("document_commands")
    def document_commands(spark, folder):
        images = views.layout(spark, folder).filter("page_no % 2 = 0").select("doc_id", "page_no").distinct().selectExpr("*", "0D as x0", "0D as y0", "612D as x1", "300D as y1")
        return document_pipeline.run(views.layout(spark, folder), _cache(spark, folder), _mock, "ru", views.PAGE_HEIGHT, images=images).commands

    # the stand-in is surer of texts of an even number of characters
    @add("translate_with_confidence", f"SELECT {KEY_SQL.format('text')} AS key, CASE WHEN min(text) = '' THEN NULL ELSE '[rus_Cyrl]' || min(text) END AS translated_text, CASE WHEN min(text) = '' THEN 1 WHEN length(min(text)) % 2 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM conversations GROUP BY ALL")
    def translate_with_confidence(spark, folder):
        items = _talk(spark, folder).groupBy("key").agg(F.min("text").alias("text"))
        sure = lambda texts, source, target: [(f"[{target}]{t}", 0.5 + 0.25 * (len(t) % 2 == 0)) for t in texts]
        return translate.run_model_with_confidence(items, sure, "uz", "ru")
