"""Command line: translates page dictionaries and writes report, annotations, draw commands and cache."""

from __future__ import annotations

import argparse
import importlib
import sys

from pagemill.operators import layout, report, translate, verify
from pagemill.plans import document_pipeline
from pagemill.sources import tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    out.add_argument("input", help="page dictionaries (Parquet or JSON)")
    out.add_argument("output", help="folder for the results")
    out.add_argument("--format", choices=("parquet", "json"), default="parquet")
    out.add_argument("--target", choices=("ru", "uz"), default="ru")
    out.add_argument("--source", choices=("ru", "uz"))
    out.add_argument("--height", type=float, default=792.0, help="page height in points")
    out.add_argument("--cache", help="folder of an existing cache version")
    out.add_argument("--batch-size", type=int, default=8)
    out.add_argument("--model", help="module:function(texts, source, target) that translates; a stand-in if not given")
    out.add_argument("--back-model", help="module:function that translates back for the second look at flagged paragraphs")
    out.add_argument("--identify", help="module:function(text) that gives (language, confidence) or None; what is in the target language is left alone")
    out.add_argument("--glossary", help="CSV with a header and columns source and target: terms that have to be kept")
    out.add_argument("--cells", help="Parquet of table cells with their text")
    out.add_argument("--max-tokens", type=int, default=512, help="tokens of a chunk for the model")
    return out


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    args = parser().parse_args(argv)

    def named(path: str | None):
        if not path:
            return None
        module, _, name = path.partition(":")
        return getattr(importlib.import_module(module), name)

    model = named(args.model) or (lambda texts, source, target: [f"[{target}]{t}" for t in texts])
    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    pages = tables.page_dicts(spark, args.input, args.format)
    lines = layout.lines_of_spans(layout.spans(pages)).withColumnRenamed("text", "line")
    # lines are numbered over the page; blocks keep their own numbers
    first = F.element_at("spans", 1)
    lines = lines.withColumn("line_no", F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("block_no", "line_no")) - 1)
    lines = lines.select("doc_id", "page_no", "block_no", "line_no", "x0", "y0", "x1", "y1", "fontsize", "font", first["color"].alias("color"), first["dir"].alias("dir"), "is_math", "line")
    glossary = [(r["source"], r["target"]) for r in spark.read.option("header", True).csv(args.glossary).collect()] if args.glossary else ()
    cache = translate.open_cache(spark, args.cache or f"{args.output}/cache-none")
    # the model runs once, for the cache that all outputs read
    made = document_pipeline.run(
        lines, cache, model, args.target, args.height, args.source, args.batch_size, glossary, named(args.identify), named(args.back_model),
        cells=spark.read.parquet(args.cells) if args.cells else None, cache_path=f"{args.output}/cache", most=args.max_tokens,
    )
    if args.cells:
        made.cells.write.parquet(f"{args.output}/cells")
    report.write(made.report, f"{args.output}/report")
    made.annotations.write.parquet(f"{args.output}/annotations")
    made.commands.write.parquet(f"{args.output}/commands")
    gate = verify.release_gate(tables.report(spark, f"{args.output}/report")).first()
    print(gate.summary)
    if gate.passed:
        print("\n".join(f"- {line}" for line in verify.CHECKLIST))
    return 0 if gate.passed else 1


if __name__ == "__main__":
    sys.exit(main())
