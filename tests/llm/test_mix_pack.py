import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import op01_mixing, op05_packing
from pagemill.llm.common import HIDE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, share=1.5, most=2.0, weights=(5.0, 2.0, 1.0)):
    """Targets by sharing again and again what is above the limits."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while rest > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / w
        rest = 0.0
        for s in list(free):
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def mixed(frame, **options):
    return op01_mixing.mix(op01_mixing.sized(frame), **options).collect()


def test_targets_and_words_taken(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s, n in (("a", 4000), ("b", 900), ("c", 300), ("d", 50), (None, 3), ("é", 700)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.integers(0, 120))), s) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(frame, block_words=2000)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want = filled(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert want[s] - 12 <= taken[s] <= want[s] + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixed(frame.repartition(7), block_words=2000)))
    # an epoch ends before a document comes again
    places = [r.places for r in got if r.source == "a"]
    if want["a"] <= sizes["a"]:
        assert all(p.epoch == 0 for ps in places for p in ps)


def test_repeated_rows_and_long_documents_come_near_the_target(spark, monkeypatch):
    monkeypatch.setattr(op01_mixing, "CHUNK", 7)
    monkeypatch.setattr(op01_mixing, "RANGE_ROWS", 3)
    rng = np.random.default_rng(8)
    rows = [(1, "w " * 10, "a")] * 40 + [(None, "v " * 5, "b")] * 200 + [(1000 + i, "u " * int(rng.integers(1, 40)), "c") for i in range(300)]
    rows += [(2000, "x " * 20000, "d"), *((3000 + i, "y " * int(rng.integers(1, 60)), "d") for i in range(400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want = filled(sizes)
    got = mixed(frame, block_words=60, share=1.1)
    want = filled(sizes, share=1.1)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert want[s] - max(10, 0.01 * want[s]) <= taken[s] <= want[s] + 1e-6
    out = Counter()
    for r in op01_mixing.mix_rows(frame, block_words=60, share=1.1).collect():
        out[r.source] += len(WORD.findall(r.text))
    assert out == taken


def test_shards_have_equal_numbers_of_blocks(spark):
    quotas = spark.createDataFrame([([100, 300, 0, 7],)], "quota array<long>")
    leaves = op01_mixing.splitting_tree(quotas, 24).collect()
    assert len(leaves) == 24 and {sum(r.quota) for r in leaves} <= {16, 17}
    assert [sum(r.quota[i] for r in leaves) for i in range(4)] == [100, 300, 0, 7] and all(q >= 0 for r in leaves for q in r.quota)


def test_draws_follow_the_distribution(spark):
    from math import comb

    n = 20000
    draws = spark.range(n).select(op01_mixing.hypergeometric(F.lit(7), F.lit(20), F.lit(8), op01_mixing.uniform(F.col("id"))).alias("k"))
    seen = Counter(r.k for r in draws.collect())
    for k in range(8):
        p = comb(7, k) * comb(13, 8 - k) / comb(20, 8)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_mixing_awkward_rows(docs, empty):
    got = mixed(docs)
    assert len(got) == docs.count() and all(r.size == 0 or r.taken in (0, r.size, 2 * r.size) for r in got)
    assert mixed(empty) == []
    rows = op01_mixing.mix_rows(docs)
    assert [c for c in rows.columns if not c.startswith(HIDE)] == docs.columns
    copies = Counter(r.doc_id for r in rows.collect())
    for r in got:
        assert r.size == 0 or r.doc_id == 10 or copies[r.doc_id] == r.taken // r.size
    assert copies[10] == sum(r.taken for r in got if r.doc_id == 10)


def test_shards_on_disk(docs, tmp_path, spark):
    op01_mixing.write_shards(docs, str(tmp_path / "mix"), shards=4)
    assert spark.read.parquet(str(tmp_path / "mix")).count() == op01_mixing.mix_rows(docs, shards=4).count()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
@settings(max_examples=150, deadline=None)
def test_plan_uses_every_piece_once(lengths):
    counts = np.zeros(65, np.int64)
    for n, c in lengths.items():
        counts[n] = c
    plan = op05_packing.plan(counts)
    used = Counter()
    for times, pattern in plan:
        assert times > 0 and sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            used[n] += times * k
    assert dict(used) == lengths
    total, made = sum(n * c for n, c in lengths.items()), sum(t for t, _ in plan)
    # no more than best-fit decreasing, which the plan starts from
    gaps = []
    for n in sorted((n for n, c in lengths.items() for _ in range(c)), reverse=True):
        fit = [g for g in gaps if g >= n]
        gaps.remove(min(fit)) if fit else None
        gaps.append((min(fit) if fit else 64) - n)
    assert -(-total // 64) <= made <= len(gaps) + max(1, len(gaps) // 10)


@pytest.mark.parametrize(("there", "gap", "combo"), [({5: 1}, 5, (5,)), ({3: 1, 2: 1}, 5, (3, 2)), ({2: 1}, 4, ()), ({2: 2}, 4, (2, 2)), ({4: 1, 3: 1, 1: 1}, 8, (4, 3, 1)), ({3: 2}, 9, ()), ({3: 3}, 9, (3, 3, 3))])
def test_complements(there, gap, combo):
    left = np.zeros(20, np.int64)
    for n, c in there.items():
        left[n] = c
    assert op05_packing.complement(left, gap) == combo


def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows, texts, encode, size):
    """Pieces cut as agreed, sequences gapless and not too long; number of sequences."""
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == size for r in parts[1:]) and 1 <= parts[0].length <= size
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_packing_of_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = op05_packing.query(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    made = check_packing(got, texts, plain(), 2048)
    assert made <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1


def test_ids_are_those_of_the_plain_call():
    """Against the tokenizers library on whole texts, no flag set."""
    tok, encode = plain(), op05_packing.Encoder(op05_packing.vocabulary_path())
    texts = ["", " ", "  a\n\n b\t", "it's We'LL 1234 --- <|endoftext|>", "a <|endoftext|> b", "<|endoftext", "é ß 中文😀 слово  　x", "\x00\x1f\x1c a\x1d\x85b", "a" * 5000, "é" * 999, "x  \n  y \u00a0 z\u3000 \u3000w"]
    texts += ["".join(f"{a}{chr(c)}{b}" for c in range(start, min(start + 4096, 0x30000)) if not 0xD800 <= c < 0xE000) for start in range(0, 0x30000, 4096) for a, b in (("a", "b"), (" ", " "), ("1", ""))]
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("ab1'sté -.\n\t \u00a0\u2003😀"), 200)) for _ in range(300)]
    for _ in range(2):
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(op05_packing, "MEMORY", 300)
    tok, encode = plain(), op05_packing.Encoder(op05_packing.vocabulary_path())
    for k in range(20):
        texts = [" ".join(f"word{k * 7 + i}" for i in range(30)), "again and again", f"word{k} " * 3]
        assert [x.tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encode.runs) < 200


def test_packing_awkward_rows(spark, docs, empty):
    unique = docs.filter("doc_id is not null and doc_id != 10")
    got = op05_packing.pack_documents(unique, size=64).collect()
    texts = {r.doc_id: r.text for r in unique.collect()}
    check_packing(got, texts, plain(), 64)
    few = op05_packing.pack(op05_packing.pieces(unique, size=64).withColumn(HIDE + "uid", F.monotonically_increasing_id()), 64, bucket_rows=3).collect()
    check_packing(few, texts, plain(), 64)
    assert op05_packing.pack_documents(docs, size=64).filter("doc_id = 10").count() == 2
    assert op05_packing.pack_documents(empty).count() == 0
    ids = op05_packing.pack_documents(unique, size=64, keep_ids=True).first()
    assert len(ids.ids) == ids.length


def test_mixed_texts_do_not_shuffle_to_their_draws(spark):
    rows = [(None if i % 97 == 0 else i, " ".join(["w"] * (i % 50)), None if i % 7 == 0 else "ab"[i % 2], i) for i in range(3000)]
    once = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    twice = once.unionByName(once.filter("block < 40"))
    shown = lambda frame, **options: sorted(map(str, op01_mixing.mix_rows(frame, block_words=500, **options).collect()))
    got = shown(twice)
    assert len(got) > 3000 and got == shown(twice.repartition(5), placed_rows=0)
    assert "hashpartitioning" not in op01_mixing.mix_rows(once, block_words=500)._jdf.queryExecution().executedPlan().toString()


def test_number_of_blocks_has_a_bound(spark):
    rows = [(i, " ".join(["w"] * 40), "abc"[i % 3]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, placed = op01_mixing.plan(op01_mixing.sized(frame), block_words=100, most_blocks=50)
    assert 20 < got.select("__pm_rank", "block").distinct().count() <= 103
    words = sum(r.taken for r in mixed(frame, block_words=100, most_blocks=50))
    assert 0 <= 1.5 * 120_000 - words <= 3 * 40
