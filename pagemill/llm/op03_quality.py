"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, of their character
n-grams (hashed into buckets) and of two tokens that mark repetition; a softmax
layer turns the average into classes.
Training is stochastic gradient descent in numpy, on the driver, over a bounded
sample of the labelled rows: ``SAMPLE`` documents, those with the smallest hash of
their id. Scoring reads every whole text; since the output is linear in the
average, the model sent to executors is one number for each bucket (1 MB).

Nulls: a null text is empty; an empty text gets the score of the bias alone. Rows
with a null label or id are not learned from. Several labels of one id are
averaged, and of several texts of one id that of the smallest hash is learned from.
Very long texts are read whole, a slice of a batch at a time. Repeated rows and ties
get equal scores. Without labels every score is 0.5; an empty table gives no rows.
Extra columns stay, but for one named as the result, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import words
from pagemill.llm.common import HIDE, table

#: The most labelled documents that training reads.
SAMPLE = 2000
BUCKETS, DIMS, EPOCHS, BATCH, RATE = 1 << 18, 8, 6, 16, 10.0
SIZES = (3, 4, 5)
#: Two more tokens with vectors of their own: a word that repeats the one before, and words that begin a repeated run of RUN words.
MARKS, RUN = 2, 4
THRESHOLD, SEED = 0.3, 7
#: Bytes of text whose distinct words are worked on at a time; each byte takes some hundred on the way.
SLICE = 1 << 20


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its character n-grams (bytes, with marks for the word's ends), and how many each word has; ``whole`` has the words' hashes."""
    n = ends - starts
    # each word as <word>, one after the other
    size = n + 2
    at = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(at[-1], np.uint8)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    body[np.repeat(at[:-1] + 1, n) + place] = words._LOWER[data[np.repeat(starts, n) + place]]
    body[at[:-1]], body[at[1:] - 1] = 60, 62
    owner = np.repeat(np.arange(len(n)), size)
    end = at[1:][owner]
    whole = (whole % np.uint64(BUCKETS)).astype(np.int64)
    found, owners = [whole], [np.arange(len(n))]
    wide = body.astype(np.uint64)
    for k in SIZES:
        ok = np.flatnonzero(np.arange(len(body)) + k <= end)
        h = np.full(len(ok), k, np.uint64)
        for j in range(k):
            h = h << np.uint64(8) | wide[ok + j]
        found.append((words.mix(h) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[ok])
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return np.concatenate(found)[order], np.bincount(who, minlength=len(n))


def _parts(texts: pa.Array):
    """Distinct words of the texts with their features, which distinct word each word is, where texts begin, and their marks."""
    data, offsets = words.raw(texts)
    starts, ends = words.bounds(data, offsets)
    h = words.hashes(data, starts, ends)
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    ids, counts = features(data, starts[first], ends[first], distinct)
    place = np.searchsorted(starts, offsets)
    marks = np.zeros((len(texts), MARKS), np.int64)
    gram = words.grams(h, RUN)
    same = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])]) if len(h) else np.zeros(1, np.int64)
    for d, (a, b) in enumerate(zip(place[:-1].tolist(), place[1:].tolist(), strict=True)):
        if b - a > 1:
            marks[d, 0] = same[b] - same[a + 1]
        if b - a > RUN:
            run = np.sort(gram[a : b - RUN + 1])
            marks[d, 1] = (run[1:] == run[:-1]).sum()
    return ids, counts, which, place, marks


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    ids, counts, which, place, marks = _parts(texts)
    ends = np.cumsum(counts)
    out = []
    for d, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
        word, times = np.unique(which[a:b], return_counts=True)
        own = [ids[ends[w] - counts[w] : ends[w]] for w in word]
        flat = np.concatenate([*own, np.arange(BUCKETS, BUCKETS + MARKS)])
        weight = np.concatenate([np.repeat(times, counts[word]), marks[d]])
        bucket, inverse = np.unique(flat, return_inverse=True)
        share = np.bincount(inverse, weight, minlength=len(bucket))
        out.append((bucket, (share / max(1.0, share.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    """``weight`` of each bucket and ``bias``, as the margin of label 1 over label 0."""

    weight: np.ndarray
    bias: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        ids, counts, which, place, marks = _parts(texts)
        total = np.concatenate([[0.0], np.cumsum(self.weight[ids], dtype=np.float64)])
        ends = np.cumsum(counts)
        of_word = total[ends] - total[ends - counts]
        run = np.concatenate([[0.0], np.cumsum(of_word[which])])
        number = np.concatenate([[0], np.cumsum(counts[which])])
        n = number[place[1:]] - number[place[:-1]] + marks.sum(axis=1)
        whole = run[place[1:]] - run[place[:-1]] + marks @ self.weight[BUCKETS:].astype(np.float64)
        return whole / np.maximum(n, 1) + self.bias


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> Model:
    """SGD over (buckets, shares) of documents with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (BUCKETS + MARKS, DIMS)).astype(np.float32)
    out, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * -(-len(docs) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            hidden = np.stack([docs[d][1] @ embed[docs[d][0]] for d in pick])
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            back = p @ out.T
            out -= rate / len(pick) * (hidden.T @ p)
            bias -= rate / len(pick) * p.sum(axis=0)
            for d, g in zip(pick, back, strict=True):
                # buckets of one document are distinct
                embed[docs[d][0]] -= (rate * docs[d][1])[:, None] * g
    return Model(embed @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from ``labels`` rows; the caller leaves out what is held out."""
    lab, rank = HIDE + "label", HIDE + "rank"
    chosen = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(HIDE + "id"))
    chosen = chosen.agg((F.avg(label) >= 0.5).cast("int").alias(lab)).withColumn(rank, F.xxhash64(HIDE + "id")).orderBy(rank, HIDE + "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole, 2, SLICE):
                rows = [(ids.astype("<u4").tobytes(), shares.astype("<f4").tobytes()) for ids, shares in bags(batch.column(2))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], names=["rank", "label", "ids", "shares"])

    # the sample has a fixed number of ids
    picked = docs.select(id_col, text).join(F.broadcast(chosen), F.col(id_col) == F.col(HIDE + "id"), "inner")
    picked = picked.groupBy(rank, lab, HIDE + "id").agg(F.min_by(text, F.xxhash64(text)).alias(HIDE + "text")).select(rank, lab, HIDE + "text")
    found = []
    # at most SAMPLE rows of a few thousand buckets
    for r in picked.mapInArrow(run, "rank long, label int, ids binary, shares binary").collect():
        found.append((r["rank"], r["label"], np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["shares"], "<f4")))
    found.sort(key=lambda r: (r[0], r[1], len(r[2]), r[3].tobytes()))
    return fit([(ids, shares) for _, _, ids, shares in found], np.array([label for _, label, _, _ in found], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``into``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for part in words.slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0, SLICE):
            parts.append(1 / (1 + np.exp(-np.clip(sent.value.margins(part.column(0)), -500, 500))))
        return pa.array(np.concatenate(parts))

    return docs.withColumn(into, probability(F.col(text)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on labels that are not held out and scores all ``docs``."""
    return score(docs, train(docs, labels.filter(~held_out(id_col)), id_col, text), text)


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
