"""Best-fit packing by exact-complement hashing.

Documents are cut into pieces of at most ``size`` tokens. There are at most
``size`` different lengths, so the packing is planned on the histogram of lengths
alone: a fixed-size table, whatever the corpus. The plan indexes the lengths
there are and the sums of pairs and triples; a gap takes the combination that
fills it exactly, as often as the counts allow at once; what has no exact
complement is filled best-fit. Each pattern is repeated, so the plan has a few
thousand rows. Pieces find their place by their rank among pieces of equal length:
ranks come from counts by (length, bucket) and a window inside a bucket; a length
has as many buckets as its rows need.

Ids are those of the tokenizers library for a file of its own, also where a text
spells a token that was added to the vocabulary. A very long text is many pieces.
Extra columns are not touched.

Nulls: a null text is empty, and an empty text is the end token alone. Repeated
rows are packed each. A null id is kept. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm import words
from pagemill.llm.common import HIDE, cut, table

SIZE, END = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of one length that one task ranks, and the number of buckets beyond which buckets grow instead.
BUCKET_ROWS, MOST_BUCKETS = 1 << 13, 1 << 16
#: Runs tokenised in one go, and bytes of runs that a task remembers the ids of.
TOGETHER = 2000
MEMORY = 6 << 20
#: The characters with the property White_Space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that no token of a byte-level vocabulary crosses: its words take one space in front and have no other.
_RUN = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


class _Runs(dict):
    """Numbers runs in the order of first sight; ``new`` has those whose ids are not known yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, run: str) -> int:
        self[run] = number = len(self)
        self.new.append(run)
        return number


class Encoder:
    """Ids of texts by a tokenizers file, without special tokens added; each distinct run is tokenised once.

    The ids of a text are those of its runs, in order. A text in which a token that
    was added to the vocabulary occurs is handed to the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab()
        # tokens that begin with a space, as the byte-level alphabet writes it
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.runs, self.bytes = _Runs(), 0
        self.ids = np.zeros(0, "<u4")
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _tokenise(self, runs: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of the runs, in pieces; where each run's begin, and how many it has."""
        sizes = np.zeros(len(runs), np.int64)
        # words with a space in front go in one text: their first tokens, and no others, begin with a space
        plain = np.array([r[0] == " " and not r[-1].isspace() for r in runs], bool)
        spaced = np.flatnonzero(plain)
        groups = [spaced[k : k + TOGETHER] for k in range(0, len(spaced), TOGETHER)]
        texts = ["".join([runs[i] for i in g.tolist()]) for g in groups]
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        for g, e in zip(groups, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            found = np.array(e.ids, "<u4")
            start = np.flatnonzero(self.spaced[found])
            if len(start) == len(g):
                ids.append((g, found))
                sizes[g] = np.diff(start, append=len(found))
            else:  # not a byte-level vocabulary
                plain[g] = False
        other = np.flatnonzero(~plain)
        for i, e in zip(other, self.whole.encode_batch_fast([runs[i] for i in other.tolist()], add_special_tokens=False), strict=True):
            ids.append((np.array([i]), np.array(e.ids, "<u4")))
            sizes[i] = len(e.ids)
        first = np.zeros(len(runs), np.int64)
        at = 0
        for g, found in ids:
            first[g] = at + np.cumsum(sizes[g]) - sizes[g]
            at += len(found)
        return [found for _, found in ids], first, sizes

    def _learn(self) -> None:
        new, self.runs.new = self.runs.new, []
        ids, first, sizes = self._tokenise(new)
        self.bytes += sum(map(len, new))
        self.first = np.concatenate([self.first, first + len(self.ids)])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, *ids])

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.bytes > MEMORY:
            self._forget()
        runs, ends, own = [], [], {}
        for n, text in enumerate(texts):
            if any(t in text for t in self.added):
                own[n] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                runs += _RUN.findall(text)
            ends.append(len(runs))
        which = np.fromiter(map(self.runs.__getitem__, runs), np.int32, len(runs))
        if self.runs.new:
            self._learn()
        first, sizes = self.first[which], self.size[which]
        upto = np.zeros(len(runs) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        flat = self.ids[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        for n, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            yield own[n] if n in own else flat[upto[a] : upto[b]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, and token ids if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path())
        for whole in batches:
            for batch in words.slices(whole, 1, 1 << 20):
                ids, rows = batch.column(0), []
                for n, found in enumerate(encode(batch.column(1).fill_null("").to_pylist())):
                    tokens = np.append(found, np.uint32(END)).astype("<u4")
                    head = (len(tokens) - 1) % size + 1
                    cuts = [0, *range(head, len(tokens) + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = tokens[a:b]
                        rows.append((n, k, a, b - a, zlib.crc32(part.tobytes()), part if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                out = [ids.take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array([p.astype(np.int32) for p in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text).mapInArrow(run, schema)


def plan(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns for ``counts[length]`` pieces of each length: (times, [(length, how many in one sequence)]).

    Every round opens a sequence with the longest length left and looks for an
    exact complement of one, two or three lengths, else the best fit, going on
    until nothing fits; the pattern is then used as often as its counts allow.
    """
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        pattern: dict[int, int] = {}
        gap = size

        def take(length: int, pattern: dict[int, int] = pattern) -> None:
            pattern[length] = pattern.get(length, 0) + 1
            left[length] -= 1

        longest = int(have[-1])
        take(longest)
        gap -= longest
        while gap:
            found = complement(left, gap)
            if not found:
                fit = np.flatnonzero(left[: gap + 1])
                if not len(fit):
                    break
                found = (int(fit[-1]),)
            for length in found:
                take(length)
                gap -= length
        # the first use is taken; how many more uses do all its lengths allow?
        more = min(int(left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * more
        out.append((1 + more, sorted(pattern.items(), reverse=True)))


def complement(left: np.ndarray, gap: int) -> tuple[int, ...]:
    """One, two or three lengths that sum to ``gap`` exactly and are there often enough; () if none.

    Tables over lengths up to the gap act as the hash of sums: a single is
    looked up at gap, a pair at gap minus its longer part, a triple likewise.
    """
    if left[gap]:
        return (gap,)
    there = left[: gap + 1] > 0
    a = np.flatnonzero(there[: gap])[::-1]
    a = a[a > 0]
    longer = a[a * 2 >= gap]
    for first in longer[there[gap - longer]]:
        second = gap - int(first)
        if second != first or left[first] > 1:
            return (int(first), second)
    for first in a:
        rest = gap - int(first)
        if 3 * first < gap:
            break
        b = a[(a <= min(first, rest - 1)) & (a * 2 >= rest)]
        for second in b[there[rest - b]]:
            third = rest - int(second)
            combo = (int(first), int(second), third)
            if all(left[x] >= combo.count(x) for x in combo):
                return combo
    return ()


def slots(patterns) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in one sequence, offset of the first copy), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for length, n in pattern:
            first = used.get(length, 0)
            out.setdefault(length, []).append((first, sequence, n, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(cut_pieces: DataFrame, size: int = SIZE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length`` and a unique ``__pm_uid``."""
    uid, bucket, rank = HIDE + "uid", HIDE + "bucket", HIDE + "rank"
    spark = cut_pieces.sparkSession
    totals = np.zeros(size + 1, np.int64)
    for length, n in cut_pieces.groupBy("length").count().collect():
        totals[length] = n
    # a length has as many buckets as its rows need: size + MOST_BUCKETS counts at most
    buckets = np.maximum(1, -(-totals // max(bucket_rows, -(-int(totals.sum()) // MOST_BUCKETS))))
    of_length = spark.createDataFrame([(int(n), int(buckets[n])) for n in np.flatnonzero(totals)], f"{HIDE}length long, {HIDE}buckets long")
    rows = cut_pieces.join(F.broadcast(of_length), F.col("length") == F.col(HIDE + "length"))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(uid), F.col(HIDE + "buckets"))).drop(HIDE + "length", HIDE + "buckets")
    bases: dict[int, np.ndarray] = {int(n): np.zeros(buckets[n] + 1, np.int64) for n in np.flatnonzero(totals)}
    for length, b, n in rows.groupBy("length", bucket).count().collect():
        bases[length][b + 1] = n
    bases = {length: np.cumsum(n) for length, n in bases.items()}
    sent = spark.sparkContext.broadcast((slots(plan(totals)), bases))

    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy("length", bucket).orderBy(uid)) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, bucket_no, local):
        import pandas as pd

        where, before = sent.value
        length, bucket_no, local = (x.to_numpy(np.int64) for x in (length, bucket_no, local))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for one in np.unique(length):
            own = length == one
            r = local[own] + before[one][bucket_no[own]]
            slot = where[one][np.searchsorted(where[one][:, 0], r, side="right") - 1]
            k = r - slot[:, 0]
            sequence[own] = slot[:, 1] + k // slot[:, 2]
            offset[own] = slot[:, 3] + k % slot[:, 2] * one
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn(HIDE + "place", place("length", bucket, rank))
    return placed.select(*cut_pieces.columns, F.col(HIDE + "place")["sequence_id"].alias("sequence_id"), F.col(HIDE + "place")["offset"].alias("offset")).drop(uid)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs: a row a piece, with token ids if asked for."""
    parts = pieces(docs, id_col, text, path, size, keep_ids).withColumn(HIDE + "uid", F.monotonically_increasing_id())
    return pack(cut(parts), size)


def query(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
