import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import bloom, links, op06_exact_dedup, op09_near, rtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, num, den):
    """{row number: (set size, smallest id of its component)}."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) * den >= num * len(a | b):
            up[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def near(frame, **options):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op09_near.components(frame, **options).collect()), key=key)


def test_exact_groups(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = op06_exact_dedup.groups(docs, bits=1 << 15).collect()
    assert len(got) == len(rows)
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t or "", []).append(d)
    for r in got:
        own = next(v for t, v in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        assert r.group_size == len(own) and r.keep_id == max((d for d in own if d is not None), default=None)
    assert sum(r.kept for r in got) == len(by_text)
    kept = op06_exact_dedup.exact_dedup(docs, bits=1 << 15)
    assert kept.columns == docs.columns and kept.count() == len(by_text)
    assert {r.doc_id for r in kept.filter("text like 'the quick%town'").collect()} == {2}
    assert kept.filter("hash = 'x' and n = 1").count() == len(by_text)


def test_full_filter_changes_nothing(docs):
    few, many = (sorted(map(str, op06_exact_dedup.groups(docs, bits=b).collect())) for b in (1 << 15, 1 << 20))
    assert few == many


def test_exact_empty(empty):
    assert op06_exact_dedup.groups(empty, bits=1 << 15).count() == 0 and op06_exact_dedup.exact_dedup(empty, bits=1 << 15).count() == 0


def test_filter_has_what_is_repeated(spark):
    frame = spark.range(2000).selectExpr("id % 1500 as h").selectExpr("xxhash64(h) as h")
    bitmap = bloom.repeated(frame, "h", 1 << 17)
    values = [r.h for r in frame.collect()]
    import numpy as np

    hit = bloom.lookup(bitmap, np.array(values))
    twice = {v for v in values if values.count(v) > 1}
    assert all(h for v, h in zip(values, hit, strict=True) if v in twice)
    assert sum(hit) < len(twice) * 2 + 50


@pytest.mark.parametrize("block", [2048, 4])
@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_near_matches_brute_force(spark, k, num, block):
    rng = random.Random(k)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for group in range(12):
        base = [f"g{group}w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 6, 30, 120, 1400]))]
        for _ in range(rng.choice([1, 3, 14])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(50)}"
            if rng.random() < 0.3:
                own += passage
            text = " ".join(own)
            rows.append((rng.choice([len(rows), 1000 - len(rows)]), text.upper() if rng.random() < 0.2 else text))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "x"), (5004, "X"), (None, "lonely words without id here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: tuple((x is None, x) for x in r)
    assert near(frame, k=k, num=num, den=100, block=block) == sorted(brute(rows, k, num, 100), key=key)


def test_near_awkward_rows(docs, empty):
    got = near(docs)
    assert len(got) == docs.count()
    by_id = {d: c for d, _, c in got}
    assert by_id[2] == by_id[3] == by_id[4] == 1 and by_id[8] == by_id[9] == 8 and by_id[5] == 5 and by_id[6] == 6 and by_id[7] == 7
    assert near(empty) == []
    kept = op09_near.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 5, 6, 7, 8, 10, 11, 12]


def test_near_dedup_judges_rows_by_text(spark):
    base = [f"w{i}" for i in range(60)]
    a, near_a, b = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (2, near_a), (2, b), (3, b + " end"), (4, "alone here"), (4, "alone here"), (None, a), (5, None), (5, "")]
    kept = op09_near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as copies", "1 as mark"))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, a), (2, b), (4, "alone here"), (5, ""), (5, "")])
    assert kept.columns == ["doc_id", "text", "copies", "mark"]


@pytest.mark.parametrize("shape", ["star", "chain", "ring"])
def test_near_edges_stay_linear(spark, monkeypatch, shape):
    """Copies of one text: links and candidate links that Spark handles are a small multiple of the nodes."""
    seen = []
    inner = links.components
    monkeypatch.setattr(links, "components", lambda e: (seen.append((e := e.checkpoint()).count()), inner(e))[1])
    per_node = []
    for n in (300, 1200):
        rng, rows, own = random.Random(n), [], [f"w{i}" for i in range(150)]
        for i in range(n):
            text = list(own)
            text[rng.randrange(150) if shape == "star" else i % 150] = f"e{rng.randrange(10**6)}" if shape != "ring" else f"e{i % 7}"
            if shape == "chain":
                own = text
            rows.append((i, " ".join(text)))
        seen.clear()
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = near(frame, k=4, num=85, den=100, block=64)
        assert len(got) == n and (shape == "chain" or {c for *_, c in got} == {0})
        per_node.append(sum(seen) / n)
    assert per_node[1] < 8 and per_node[1] < per_node[0] * 1.5 + 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 21), (21, 22), (22, 20), (7, 7)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}


@pytest.mark.parametrize("last", [0, 10, 1 << 14])
def test_components_of_odd_shapes_and_extension(spark, monkeypatch, last):
    monkeypatch.setattr(links, "LAST", last)
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 112)] + [(200, i) for i in range(180, 220)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u != v:
            up.setdefault(u, u), up.setdefault(v, v)
            a, b = sorted((find(u), find(v)))
            up[b] = a
    want = {x: find(x) for x in up}
    first, second = (spark.createDataFrame(e, "u long, v long") for e in (edges[::2], edges[1::2]))
    assert {r.node: r.root for r in links.components(first.unionByName(second)).collect()} == want
    assert {r.node: r.root for r in links.extend(links.components(first), second).collect()} == want


def test_tree_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    upper = rng.integers(0, 9, (300, 16))
    upper[150:] = np.maximum(0, upper[:150] + rng.integers(-1, 2, (150, 16)))
    size, part = upper.sum(axis=1), np.arange(300) // 2
    found = {(min(x, y), max(x, y)) for a, b in rtree.Tree(upper, size, part).pairs(80, 100) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for x, y in itertools.combinations(range(300), 2):
        bound = int(np.minimum(upper[x], upper[y]).sum())
        if part[x] != part[y] and min(size[x], size[y]) * 100 >= 80 * max(size[x], size[y]) and bound * 180 >= 80 * (size[x] + size[y]):
            assert (x, y) in found


def test_size_estimates_stay_small_in_a_loop_of_joins(spark):
    """A kept estimate doubles its digits each round; a table that is beyond a long keeps its rows and what is known of its order."""
    from pagemill.llm.common import cut

    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    chain = cut(spark.range(500).select(F.col("id").alias("node"), F.greatest(F.col("id") - 1, F.lit(0)).alias("to")))
    for _ in range(9):
        up = chain.select(F.col("node").alias("to"), F.col("to").alias("next"))
        chain = cut(chain.join(up.hint("merge"), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        assert size(chain) < 1 << 63
    assert {(r.node, r.to) for r in chain.collect()} == {(n, 0) for n in range(500)}


def test_near_dedup_keeps_no_size_estimate_beyond_a_long(spark, docs, monkeypatch):
    """Nothing that is cut on the way multiplies its estimate into the next joins."""
    seen, plain = [], op09_near.cut

    def watched(df):
        out = plain(df)
        seen.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return out

    monkeypatch.setattr(links, "LAST", 0)
    for module in (links, op09_near):
        monkeypatch.setattr(module, "cut", watched)
    assert op09_near.near_dedup(docs).count() > 0
    assert len(seen) > 8 and max(seen) < 1 << 63
