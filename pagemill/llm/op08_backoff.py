"""Stupid-backoff language model scores, from counts over the whole corpus.

Two forms with equal results. ``score_rows`` is the relational one: an n-gram is a row,
the count table is a sum by hash, joined back to the exploded n-grams, whose scores are
summed for each document. A row of an n-gram takes far more room on its way than its
text, so the query uses ``score``, which joins tables of packed rows.

In ``score`` the count table of all n-grams (orders 1 to ``ORDER``) is partitioned by
hash. Documents are dealt to buckets by a hash; a bucket explodes its texts to n-grams
and sends each partition of the count table its distinct n-grams with their counts, as
one sorted packed row. A partition adds up what all buckets sent (the count table),
joins it back to what each bucket asked for, and returns the counts in that order.
The bucket then has the corpus count of each of its n-grams, scores every word, and
sums for each document. A frequent n-gram is one entry of each bucket's row, so no
key is hot; nothing is collected on the driver.

score(w | history) = count(history w) / count(history) if the n-gram was seen at
least ``CUTOFF`` times, else 0.4 times the score with a shorter history; words come
last, as count / all words. The cutoff is part of the model: every n-gram of a scored
text is in the corpus once, as the text's own.

N-grams are known by ``BITS`` bits of a hash in ``score``, by 64 in ``score_rows``.
Nulls: a null text is empty; a text without words has n_words 0, log_score 0 and no
mean. A very long text is part of one bucket, read a slice at a time. Repeated rows
each add to the counts and each get a score; rows equal in id and text share a bucket.
An empty table gives an empty result. Extra columns are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm import words
from pagemill.llm.common import HIDE, cut, table

ORDER, CUTOFF, BACKOFF, BITS = 3, 2, 0.4, 48
#: Buckets of documents for each shuffle partition: what a task holds at once is one bucket.
BUCKETS = 4


def _ngrams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the truncated hashes of all n-grams and the place of each one's last word; where texts begin."""
    h, place = words.words(texts)
    of = np.repeat(np.arange(len(place) - 1), np.diff(place))
    grams, last = [], []
    for k in range(1, order + 1):
        g = words.grams(h, k) >> np.uint64(64 - BITS)
        inside = of[: len(g)] == of[k - 1 :][: len(g)] if len(g) else np.zeros(0, bool)
        # 0 is kept for the number of all words
        grams.append(np.maximum(g[inside], np.uint64(1)))
        last.append(np.flatnonzero(inside) + k - 1)
    return grams, last, place


def _slices(texts: pa.Array):
    for part in words.slices(pa.RecordBatch.from_arrays([texts], names=["t"])):
        yield part.column(0)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _pack(sorted_hashes: np.ndarray) -> tuple[int, bytes]:
    """Gaps of sorted hashes, in 4 bytes each if they fit, else 8."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    narrow = len(gaps) < 2 or int(gaps[1:].max()) < 1 << 32
    return int(sorted_hashes[0]), (b"\4" + gaps[1:].astype("<u4").tobytes()) if narrow else (b"\10" + gaps[1:].astype("<u8").tobytes())


def _unpack(first: int, packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, "<u4" if packed[0] == 4 else "<u8", offset=1).astype(np.uint64)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), gaps]), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte each; those of 255 and more follow in eight."""
    large = counts[counts >= 255]
    return len(counts).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def _unpack_counts(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    out = np.frombuffer(packed, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(packed, "<i8", offset=4 + n)
    return out


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so what is sorted by hash is sorted by part."""
    return (hashes >> np.uint64(BITS - 24)).astype(np.int64) * parts >> 24


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, cutoff: int = CUTOFF, backoff: float = BACKOFF, parts: int | None = None) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) of every row."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = HIDE + "bucket"
    dealt = docs.select(F.col(id_col), F.col(text), F.pmod(F.xxhash64(id_col, text), F.lit(BUCKETS * parts)).cast("int").alias(bucket))
    kind = docs.schema[id_col].dataType.simpleString()

    def ask(rows: pa.Table) -> pa.Table:
        """What a bucket sends to each part: its distinct n-grams and how often it has them."""
        found = [_ngrams(texts, order)[0] for texts in _slices(_flat(rows.column(1)))]
        total = sum(len(grams[0]) for grams in found)
        h, n = np.unique(np.concatenate([g for grams in found for g in grams]), return_counts=True)
        h, n = np.concatenate([np.zeros(1, np.uint64), h]), np.concatenate([[total], n])
        cuts = np.searchsorted(_part_of(h, parts), np.arange(parts + 1))
        out = []
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                out.append((part, rows.column(2)[0].as_py(), *_pack(h[a:b]), _pack_counts(n[a:b])))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", bucket, "first", "hashes", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        """The part's count table joined to what each bucket asked for."""
        asked = [_unpack(f, h) for f, h in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
        counts = np.concatenate([_unpack_counts(c) for c in rows.column(4).to_pylist()])
        _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        whole = np.bincount(inverse, counts).astype(np.int64)[inverse]
        ends = np.cumsum([len(a) for a in asked])
        blobs = [_pack_counts(whole[e - len(a) : e]) for a, e in zip(asked, ends, strict=True)]
        return pa.table([rows.column(1), rows.column(0), pa.array(blobs, pa.binary())], names=[bucket, "part", "counts"])

    def mark(rows: pa.Table, replies: pa.Table) -> pa.Table:
        """Scores of a bucket's documents from the corpus counts of its n-grams."""
        by_part = sorted(zip(replies.column(1).to_pylist(), replies.column(2).to_pylist(), strict=True))
        count = np.concatenate([_unpack_counts(c) for _, c in by_part]).astype(np.float64)
        found = [_ngrams(t, order) for t in _slices(_flat(rows.column(1)))]
        _, inverse = np.unique(np.concatenate([g for grams, _, _ in found for g in grams]), return_inverse=True)
        of_gram, used = count[1:][inverse], 0  # the first count is that of all words
        n_words, log_score = [], []
        for grams, last, place in found:
            seen = []
            for g in grams:
                seen.append(of_gram[used : used + len(g)])
                used += len(g)
            n = len(grams[0])
            best = np.log(seen[0]) - np.log(count[0])
            # from bigrams up: an n-gram that was seen replaces the score, one that was not multiplies it by the back-off
            for k in range(2, order + 1):
                c, at = seen[k - 1], last[k - 1]
                # the history is the n-gram of one order less that ends a word earlier
                longer = np.zeros(n)
                longer[last[k - 2]] = seen[k - 2]
                history = longer[at - 1]
                ok = c >= cutoff
                best[at] = np.where(ok, np.log(c) - np.log(np.maximum(history, 1)), best[at] + np.log(backoff))
            run = np.concatenate([[0.0], np.cumsum(best)])
            n_words.append(np.diff(place))
            log_score.append(run[place[1:]] - run[place[:-1]])
        words_, logs = np.concatenate(n_words), np.concatenate(log_score)
        mean = pa.array(np.round(logs / np.maximum(words_, 1), 7), mask=words_ == 0)
        return pa.table([rows.column(0), pa.array(words_, pa.int64()), pa.array(np.round(logs, 4)), mean], names=[id_col, "n_words", "log_score", "mean_log_score"])

    asked = dealt.groupBy(bucket).applyInArrow(ask, f"part int, {bucket} int, first long, hashes binary, counts binary")
    replies = asked.groupBy("part").applyInArrow(answer, f"{bucket} int, part int, counts binary")
    return dealt.groupBy(bucket).cogroup(replies.groupBy(bucket)).applyInArrow(mark, f"`{id_col}` {kind}, n_words long, log_score double, mean_log_score double")


def score_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cutoff: int = CUTOFF, backoff: float = BACKOFF) -> DataFrame:
    """What ``score`` gives with trigrams, by rows: n-grams exploded, counted by hash, joined back, summed for each document."""
    upper = "".join(map(chr, range(65, 91)))
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    whole = cut(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), found.alias("ws")))
    at = lambda i, back: F.when(i > back, F.element_at("ws", F.greatest(F.lit(1), i - back)))
    gram = lambda i, k: F.when(i >= k, F.xxhash64(*(at(i, back) for back in range(k - 1, -1, -1))))
    places = F.when(F.size("ws") > 0, F.transform(F.sequence(F.lit(1), F.size("ws")), lambda i: F.struct(i.alias("i"), *(gram(i, k).alias(f"h{k}") for k in (1, 2, 3)))))
    rows = whole.select("uid", F.explode(places).alias("p")).select("uid", "p.*")
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in (1, 2, 3)))
    grams = rows.select("uid", "i", F.explode(kinds).alias("g")).select("uid", "i", "g.*").filter("h is not null")
    counts = grams.groupBy("h", "k").agg(F.count("*").alias("c"))
    total = rows.agg(F.count("*").alias("total"))
    counted = grams.join(counts, ["h", "k"]).groupBy("uid", "i").agg(*(F.max(F.when(F.col("k") == k, F.col("c"))).alias(f"c{k}") for k in (1, 2, 3)))
    by = W.partitionBy("uid").orderBy("i")
    counted = counted.withColumn("b1", F.lag("c1").over(by)).withColumn("b2", F.lag("c2").over(by)).join(F.broadcast(total))
    one = F.log(F.col("c1").cast("double")) - F.log(F.col("total").cast("double"))
    two = F.when(F.col("c2") >= cutoff, F.log("c2") - F.log("b1")).otherwise(one + F.when(F.col("c2").isNotNull(), math.log(backoff)).otherwise(0.0))
    three = F.when(F.col("c3") >= cutoff, F.log("c3") - F.log("b2")).otherwise(two + F.when(F.col("c3").isNotNull(), math.log(backoff)).otherwise(0.0))
    sums = counted.groupBy("uid").agg(F.sum(three).alias("s"))
    n = F.size("ws").cast("long")
    out = whole.join(sums, "uid", "left")
    return out.select(F.col("id").alias(id_col), n.alias("n_words"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("log_score"), F.round(F.col("s") / F.when(n > 0, n), 7).alias("mean_log_score"))


def query(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3 FROM p),
c1 AS (SELECT g1, count(*) AS c FROM g GROUP BY g1), c2 AS (SELECT g2, count(*) AS c FROM g WHERE g2 IS NOT NULL GROUP BY g2),
c3 AS (SELECT g3, count(*) AS c FROM g WHERE g3 IS NOT NULL GROUP BY g3), n AS (SELECT count(*) AS n FROM g),
h AS (SELECT g.r, i, c1.c AS a, c2.c AS b, c3.c AS t, lag(c1.c) OVER w AS ha, lag(c2.c) OVER w AS hb FROM g JOIN c1 USING (g1) LEFT JOIN c2 USING (g2) LEFT JOIN c3 USING (g3) WINDOW w AS (PARTITION BY g.r ORDER BY i)),
s AS (SELECT r, CASE WHEN t >= 2 THEN ln(t) - ln(hb) WHEN b >= 2 THEN CASE WHEN t IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END + ln(b) - ln(ha)
        ELSE (CASE WHEN t IS NOT NULL THEN 2 WHEN b IS NOT NULL THEN 1 ELSE 0 END) * ln(0.4::DOUBLE) + ln(a) - ln(n) END AS x FROM h, n),
f AS (SELECT r, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, len(ws) AS n_words, round(coalesce(x, 0), 4)::DOUBLE AS log_score, CASE WHEN len(ws) > 0 THEN round(x / len(ws), 7) END::DOUBLE AS mean_log_score FROM d LEFT JOIN f USING (r)
"""
