"""Command lines: `quillfind-benchmark` runs pipelines over a data set and writes a run folder; `quillfind-report` makes
the report of a run folder again. Also `python -m quillfind.cli benchmark|report`."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from . import config as settings
from .operators import sampling
from .plans import run_folder
from .plans.pipelines import REGISTRY, Benchmark, Context, selected
from .sources import datasets


def plug_in(name: str | None):
    """`module:function` as a function."""
    if name is None:
        return None
    module, _, function = name.partition(":")
    if not function:
        raise argparse.ArgumentTypeError(f"{name!r} is not module:function")
    return getattr(importlib.import_module(module), function)


def benchmark_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillfind-benchmark", description="Run retrieval pipelines and write a run folder.")
    p.add_argument("--dataset", default="scifact", help="data set name or folder name below --data-dir")
    p.add_argument("--data-dir", default="./data")
    p.add_argument("--tables", help="folder of Parquet tables (documents, benchmark) instead of a data set")
    p.add_argument("--max-queries", type=int, default=100)
    p.add_argument("--max-docs", type=int, help="judged documents are always kept")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--output-dir", default="./experiments/runs")
    p.add_argument("--skip-heavy", action="store_true", help="leave two-stage and graph retrieval out")
    p.add_argument("--skip-colbert", action="store_true", help="leave late interaction out")
    p.add_argument("--skip-raptor", action="store_true", help="leave tree pipelines out")
    p.add_argument("--pipelines", nargs="+", help=f"of {', '.join(sorted(REGISTRY))}")
    p.add_argument("--colbert-checkpoint", type=plug_in, metavar="MODULE:FUNCTION", help="token encoder: function of (DataFrame, key)")
    p.add_argument("--encode-batch-size", type=int, help="rows of an Arrow batch that encoders see at once")
    p.add_argument("--hyde-llm", type=plug_in, metavar="MODULE:FUNCTION", help="generator of made-up answers: function of a column (default: templates)")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--config", help="JSON or YAML settings; options given here go before it")
    return p


def experiment(args: argparse.Namespace) -> settings.Experiment:
    base = settings.load(args.config) if args.config else settings.Experiment()
    changes = {"dataset": args.dataset, "max_queries": args.max_queries or None, "max_docs": args.max_docs, "seed": args.seed, "output_dir": args.output_dir, "retrieval.top_k": args.top_k}
    if args.pipelines:
        changes["pipelines"] = list(args.pipelines)
    return settings.with_overrides(base, **changes).validate(set(REGISTRY))


def benchmark(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where every pipeline failed; the run folder is written in both cases, and its path printed last."""
    parser = benchmark_parser()
    args = parser.parse_args(argv)
    try:
        config = experiment(args)
        names = selected(config.pipelines, args.skip_heavy, args.skip_colbert, args.skip_raptor)
    except ValueError as e:
        parser.error(str(e))
    if not names:
        parser.error("no pipeline is left")
    spark = spark or SparkSession.builder.appName("quillfind-benchmark").getOrCreate()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", f"{args.output_dir.rstrip('/')}/.checkpoints"))
    if args.encode_batch_size:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", args.encode_batch_size)
    corpus, queries, qrels = datasets.load_tables(spark, args.tables) if args.tables else datasets.load_dataset(spark, datasets.folder(args.dataset, args.data_dir))
    if config.max_queries:
        queries, qrels = sampling.subsample_queries(queries, qrels, config.max_queries, config.seed)
    if config.max_docs:
        corpus = sampling.subsample_corpus(corpus, qrels, config.max_docs, config.seed)
    options = {"token_encoder": args.colbert_checkpoint} | ({"generate": args.hyde_llm} if args.hyde_llm else {})
    bench = Benchmark(Context(corpus, config, **options), queries.persist(), qrels.persist())
    failed = False
    try:
        bench.run(names)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        failed = True
    print(run_folder.save(bench, args.output_dir))
    return int(failed)


def report(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillfind-report", description="Make report.md and dashboard.html of a run folder again.")
    p.add_argument("run_dir")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillfind-report").getOrCreate()
    print(run_folder.rewrite_report(spark, args.run_dir))
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    commands = {"benchmark": benchmark, "report": report}
    if not argv or argv[0] not in commands:
        print(f"usage: python -m quillfind.cli {{{','.join(commands)}}} ...", file=sys.stderr)
        return 2
    return commands[argv[0]](argv[1:])


if __name__ == "__main__":
    sys.exit(main())
