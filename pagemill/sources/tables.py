"""Sources: Parquet tables, nested page dictionaries, documents as lines, fixed dimension tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
RGB = "struct<r:double,g:double,b:double>"
SPAN = f"struct<span_no:int,text:string,font:string,size:double,color:{RGB},bbox:{RECT},matrix:array<double>,dir:struct<dx:double,dy:double>,is_math:boolean,opacity:double>"
#: A page with its blocks; image blocks have no lines.
PAGE_DICTS = f"doc_id long, page_no int, width double, height double, blocks array<struct<block_no:int,bbox:{RECT},opacity:double,color:{RGB},lines:array<struct<line_no:int,bbox:{RECT},spans:array<{SPAN}>>>>>"
REPORT = "page int, source_preview string, translation_preview string, flagged string, reasons string, tier2_executed string, tier2_metrics string"
CACHE = "key string, translated_text string, schema_version int, glossary_hash string"

#: Font files by variant.
FONTS = (
    ("DejaVuSans", "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"),
    ("DejaVuSans-Bold", "/usr/share/fonts/truetype/dejavu/DejaVuSans-Bold.ttf"),
    ("DejaVuSerif", "/usr/share/fonts/truetype/dejavu/DejaVuSerif.ttf"),
    ("DejaVuSerif-Bold", "/usr/share/fonts/truetype/dejavu/DejaVuSerif-Bold.ttf"),
    ("DejaVuSansMono", "/usr/share/fonts/truetype/dejavu/DejaVuSansMono.ttf"),
    ("DejaVuSansMono-Bold", "/usr/share/fonts/truetype/dejavu/DejaVuSansMono-Bold.ttf"),
    ("LiberationSerif-Regular", "/usr/share/fonts/truetype/liberation/LiberationSerif-Regular.ttf"),
    ("LiberationSerif-Bold", "/usr/share/fonts/truetype/liberation/LiberationSerif-Bold.ttf"),
    ("LiberationSerif-Italic", "/usr/share/fonts/truetype/liberation/LiberationSerif-Italic.ttf"),
    ("LiberationSerif-BoldItalic", "/usr/share/fonts/truetype/liberation/LiberationSerif-BoldItalic.ttf"),
    ("LiberationSans-Regular", "/usr/share/fonts/truetype/liberation/LiberationSans-Regular.ttf"),
    ("LiberationSans-Bold", "/usr/share/fonts/truetype/liberation/LiberationSans-Bold.ttf"),
    ("LiberationSans-Italic", "/usr/share/fonts/truetype/liberation/LiberationSans-Italic.ttf"),
    ("LiberationSans-BoldItalic", "/usr/share/fonts/truetype/liberation/LiberationSans-BoldItalic.ttf"),
    ("LiberationMono-Regular", "/usr/share/fonts/truetype/liberation/LiberationMono-Regular.ttf"),
    ("LiberationMono-Bold", "/usr/share/fonts/truetype/liberation/LiberationMono-Bold.ttf"),
    ("LiberationMono-Italic", "/usr/share/fonts/truetype/liberation/LiberationMono-Italic.ttf"),
    ("LiberationMono-BoldItalic", "/usr/share/fonts/truetype/liberation/LiberationMono-BoldItalic.ttf"),
    ("NotoSans", "/usr/share/fonts/truetype/noto/NotoSans-Regular.ttf"),
    ("NotoSans-Bold", "/usr/share/fonts/truetype/noto/NotoSans-Bold.ttf"),
    ("NotoSerif", "/usr/share/fonts/truetype/noto/NotoSerif-Regular.ttf"),
    ("NotoSerif-Bold", "/usr/share/fonts/truetype/noto/NotoSerif-Bold.ttf"),
)


class SourceError(ValueError):
    """An input that is missing or of the wrong kind."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, line_no, line) of every line of every document."""
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def page_dicts(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Pages with nested blocks, lines and spans, from Parquet or JSON."""
    return spark.read.schema(PAGE_DICTS).format(kind).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def pdf_pages(spark: SparkSession, path: str, parse) -> DataFrame:
    """Pages of PDF files; ``parse(bytes)`` yields (page_no, width, height, blocks).

    The decoder is the caller's: this engine has none. Files are read where the
    executors are, one Arrow batch at a time.
    """
    if not path.lower().endswith(".pdf") and "*" not in path and not path.endswith("/"):
        raise SourceError(f"not a PDF file: {path}")
    if "*" not in path and not _exists(spark, path):
        raise SourceError(f"no such file: {path}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *page) for page in parse(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "page_no", "width", "height", "blocks"])

    blocks = PAGE_DICTS.split("blocks ")[1]
    return files.select("path", "content").mapInPandas(run, f"path string, page_no int, width double, height double, blocks {blocks}")


def font_catalog(spark: SparkSession) -> DataFrame:
    """(variant, path): a fixed dimension table of 22 rows."""
    return spark.createDataFrame(FONTS, "variant string, path string")


def report(spark: SparkSession, path: str) -> DataFrame:
    """A verification report written as CSV with a header."""
    return spark.read.schema(REPORT).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The translation cache at ``path``, or an empty one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)
