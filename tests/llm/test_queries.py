import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from pagemill.llm import op01_mixing, op03_quality, op06_exact_dedup, queries
from pagemill.llm.common import HIDE, table

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))
import oracle
from test_dedup import brute
from test_mix_pack import WORD, filled, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    want = oracle.connect(folder).execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_every_row_is_there(spark, folder, name):
    key = "page_id" if name == "op7_pages" else "doc_id"
    got = {r[0] for r in queries.QUERIES[name](spark, folder).select(key).collect()}
    assert got == {r[0] for r in table(spark, folder, "pages" if name == "op7_pages" else "documents").select(key).collect()}


def test_reruns_agree(spark, folder):
    for name in ("op1_mixing", "op3_quality"):
        one, two = (sorted(map(str, queries.QUERIES[name](spark, folder).collect())) for _ in range(2))
        assert one == two


def test_pipeline_against_brute_force(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    kept, rows = [], {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, exact, near, mixed, packed = kept

    labels = table(spark, folder, "labels").filter(~op03_quality.held_out())
    scores = op03_quality.classify(table(spark, folder, "documents"), labels).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in scores if r.score >= 0.3}
    assert len(clean) < len(rows)

    largest = {}
    for r in clean:
        largest[r.text] = max(largest.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in exact} == set(largest.values()) and len(exact) == len(largest)

    want = brute([(r.doc_id, r.text) for r in exact], 5, 80, 100)
    assert {r.doc_id for r in near} == {d for d, n, c in want if d == c}

    sizes, taken = defaultdict(int), Counter()
    for r in near:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in mixed:
        assert rows[r.doc_id] == r
        taken[r.source] += len(WORD.findall(r.text))
    target = filled(sizes)
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 2
    for s in sizes:
        # no document that is not taken in the last epoch would still fit, or hardly any is missing
        spare = [len(WORD.findall(r.text)) for r in near if r.source == s and times[r.doc_id] <= target[s] // sizes[s]]
        assert taken[s] <= target[s] + 1e-6 and target[s] - taken[s] < max(0.01 * target[s], min(spare))

    encode = plain()
    whole = sum(len(encode.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert len({(r.row, r.piece) for r in packed}) == len(packed) and len({r.row for r in packed}) == len(mixed)
    assert sum(r.length for r in packed) == whole
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= whole // 2048 * 1.03 + 2


def test_pipeline_runs_in_one_call(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_checkpoint_folder_of_the_session_is_used(spark, folder):
    from pagemill.llm.common import scratch

    assert scratch(spark) == spark.sparkContext.getCheckpointDir()


def test_digest_of_equal_texts_is_equal(spark, folder):
    got = op06_exact_dedup.query(spark, folder).collect()
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    assert all(r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    assert op01_mixing.SHARDS > 1 and HIDE
