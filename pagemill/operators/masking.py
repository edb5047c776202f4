"""Reversible masking of entities, formulas and LaTeX by private-use characters.

A document has 2,048 placeholders of each kind. Entities take the place that a hash
of their text names, or the next free one, so a text has one placeholder in its
document; formulas and LaTeX take the next in order. What finds no place left stays
as it is, and ``usage`` reports the document. A document's rows are small and are
masked together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T

if TYPE_CHECKING:
    import pyarrow as pa

#: First private-use character of each kind, and how many each has.
BASE = {"MATH": 0xE000, "NER": 0xE800, "LATEX": 0xF000}
SLOTS = 2048
MATH_MARK = "▨"

#: Entity patterns, applied in this order.
DATES = (
    r"\b\d{2,4}[-/.]\d{1,2}[-/.]\d{2,4}\b",
    r"(?i)\b\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\s+\d{4}\b",
    r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
)
NUMBERS = (r"\b\d+[.,]?\d*%\b", r"\$\d+[.,]?\d*\b", r"€\d+[.,]?\d*\b", r"\b\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?\b", r"\b\d+[.,]\d+\b")
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"\b(?:https?://|ftp://|www\.)[A-Za-z0-9./?=&%#_~-]+\b"
CAPITALS, CAPITALISED = r"\b[A-Z]{2,}\b", r"\b[A-Z][a-zA-Z]+\b"
#: LaTeX blocks, displayed and inline.
LATEX = (r"\$\$[\s\S]+?\$\$", r"\$[^$\n]+\$")

ENTRIES = "array<struct<placeholder:string,original:string>>"


class PlaceholdersExhausted(RuntimeError):
    """A document has more distinct entities than placeholders."""


def entity_patterns(source: str) -> tuple[str, ...]:
    return (*DATES, *NUMBERS, EMAIL, URL, CAPITALS if source == "uz" else CAPITALISED)


def entities(text: Column, pattern: str) -> Column:
    """All matches of one entity pattern."""
    return F.regexp_extract_all(text, F.lit(pattern.replace("(?i)", "(?iu)")), F.lit(0))


class Registry:
    """Placeholders of one document."""

    def __init__(self) -> None:
        self.by_text: dict[str, str] = {}
        self.used: set[int] = set()
        self.next = {"MATH": 0, "LATEX": 0}

    def entity(self, text: str) -> str:
        """The text's own placeholder, taken at first sight."""
        if text not in self.by_text:
            if len(self.used) == SLOTS:
                raise PlaceholdersExhausted(f"more than {SLOTS} entities")
            at = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=2).digest(), "big") % SLOTS
            while at in self.used:
                at = (at + 1) % SLOTS
            self.used.add(at)
            self.by_text[text] = chr(BASE["NER"] + at)
        return self.by_text[text]

    def following(self, kind: str) -> str:
        if self.next[kind] == SLOTS:
            raise PlaceholdersExhausted(f"more than {SLOTS} of kind {kind}")
        self.next[kind] += 1
        return chr(BASE[kind] + self.next[kind] - 1)


_TAKEN = re.compile("[\ue000-\uefff]")


def mask_text(text: str, registry: Registry, source: str) -> tuple[str, list[dict[str, str]]]:
    """Masked text and its entries, in the order of first use; matches that hold a placeholder stay."""
    found: dict[str, str] = {}

    def put(m: re.Match) -> str:
        if _TAKEN.search(m[0]):
            return m[0]
        try:
            return found.setdefault(m[0], registry.entity(m[0]))
        except PlaceholdersExhausted:
            return m[0]

    for pattern in entity_patterns(source):
        text = re.sub(pattern, put, text)
    return text, [{"placeholder": p, "original": o} for o, p in found.items()]


def protect_text(text: str, registry: Registry) -> tuple[str, list[dict[str, str]]]:
    """LaTeX blocks, displayed before inline, each replaced by a placeholder of its own."""
    entries: list[dict[str, str]] = []

    def put(m: re.Match) -> str:
        try:
            mark = registry.following("LATEX")
        except PlaceholdersExhausted:
            return m[0]
        entries.append({"placeholder": mark, "original": m[0]})
        return mark

    for pattern in LATEX:
        text = re.sub(pattern, put, text)
    return text, entries


def _by_document(df: DataFrame, key: str, order: str, text: str, work) -> DataFrame:
    """Runs ``work(text, registry)`` on the rows of each document in order; adds masked and entries.

    Documents follow each other in sorted batches, whose other columns pass as they are:
    a group of pandas rows for each of many small documents takes far longer than the work.
    """
    names = df.columns
    at_key, at_text = names.index(key), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("placeholder", pa.string()), ("original", pa.string())]))
        registry, last = Registry(), None
        for batch in batches:
            masked, entries = [], []
            for own, value in zip(batch.column(at_key).to_pylist(), batch.column(at_text).to_pylist(), strict=True):
                if own != last:
                    registry, last = Registry(), own
                new, found = work(value or "", registry)
                masked.append(new)
                entries.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masked, pa.string()), pa.array(entries, kind)], names=[*names, "masked", "entries"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order)).mapInArrow(run, f"{schema}, masked string, entries {ENTRIES}")


def mask_entities(df: DataFrame, source: str = "uz", key: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    return _by_document(df, key, order, text, lambda t, registry: mask_text(t, registry, source))


def protect_latex(df: DataFrame, key: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    return _by_document(df, key, order, text, protect_text)


def mask_all(df: DataFrame, source: str = "uz", key: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """LaTeX blocks and then entities of each document, in one pass."""

    def work(value: str, registry: Registry) -> tuple[str, list[dict[str, str]]]:
        value, blocks = protect_text(value, registry)
        value, found = mask_text(value, registry, source)
        return value, blocks + found

    return _by_document(df, key, order, text, work)


def restore(masked: Column, entries: Column) -> Column:
    """Puts originals back, the last masked first: an inline LaTeX block may hold the placeholder of a displayed one."""
    return T.replace_all(masked, F.reverse(entries), "placeholder", "original")


def mask_formulas(text: Column, spans: Column) -> Column:
    """Shows each formula placeholder of ``spans`` to the model as the same mark."""
    return F.aggregate(spans, text, lambda t, s: F.replace(t, s["placeholder"], F.lit(MATH_MARK)))


def unmask_formulas(text: Column, spans: Column) -> Column:
    """Fills the marks, from the left, with the originals in order of their place in the source."""
    pieces = F.split(text, MATH_MARK, -1)
    value = lambda i: F.coalesce(F.when(F.get(spans, i)["original"] != "", F.get(spans, i)["original"]), F.get(spans, i)["placeholder"], F.lit(MATH_MARK))
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(value(i - 1), p))), "")


def sequential(df: DataFrame, kind: str, key: str, order: list[str]) -> DataFrame:
    """Adds ``placeholder``: the next of its kind in each document; beyond the last it is an error."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    char = F.decode(F.unhex(F.concat(F.hex(F.shiftright(n + BASE[kind], 12) + 0xE0), F.hex(F.shiftright(n + BASE[kind], 6).bitwiseAND(0x3F) + 0x80), F.hex((n + BASE[kind]).bitwiseAND(0x3F) + 0x80))), "UTF-8")
    return df.withColumn("placeholder", F.when(n < SLOTS, char).otherwise(F.raise_error(F.lit(f"placeholders of kind {kind} exhausted"))))


def usage(placeholders: DataFrame) -> DataFrame:
    """(doc_id, kind, allocated, capacity, pct, exhausted) from rows (doc_id, kind, placeholder)."""
    grouped = placeholders.groupBy("doc_id", "kind").agg(F.count_distinct("placeholder").alias("allocated"))
    return grouped.select("doc_id", "kind", "allocated", F.lit(SLOTS).cast("long").alias("capacity"), (F.col("allocated") * 100.0 / SLOTS).alias("pct"), (F.col("allocated") >= SLOTS).alias("exhausted"))


def survives(text: Column, encode, decode) -> Column:
    """Does a placeholder come through an injected tokenizer?"""

    @F.pandas_udf("boolean")
    def run(column):
        return column.map(lambda s: s is not None and s in decode(encode(s)))

    return run(text)


def tokenizer_report(encode, decode) -> dict[str, bool | str]:
    """Whether one placeholder of each kind survives a tokenizer; an error means none does."""
    try:
        return {kind: chr(base) in decode(encode(chr(base))) for kind, base in BASE.items()}
    except Exception as error:  # noqa: BLE001 - the tokenizer is foreign code, and its failure is the finding
        return dict.fromkeys(BASE, False) | {"error": str(error)}
