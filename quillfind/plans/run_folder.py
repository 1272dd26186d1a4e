"""One benchmark run as a folder: result tables as Parquet, small records as JSON, report and dashboard."""

from __future__ import annotations

import os
import platform
import time
from importlib import metadata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import datasets
from . import report
from .pipelines import Benchmark


def hardware(spark: SparkSession) -> dict:
    """What the run had: driver machine, cores of the cluster, memory settings, Spark and Python versions."""
    memory = "unknown"
    if os.path.exists("/proc/meminfo"):
        with open("/proc/meminfo") as f:
            memory = next((line.split(":")[1].strip() for line in f if line.startswith("MemTotal")), memory)
    conf = spark.sparkContext.getConf()
    return {
        "cpu": platform.processor() or platform.machine(), "ram": memory, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism,
        "executor_memory": conf.get("spark.executor.memory", "default"), "driver_memory": conf.get("spark.driver.memory", "default"), "spark": spark.version, "python": platform.python_version(),
    }


def packages() -> list[str]:
    """name==version of every installed distribution."""
    return sorted({f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions() if d.metadata["Name"]})


def new_run_id(dataset: str) -> str:
    return f"{dataset}_{int(time.time())}"


def save(bench: Benchmark, folder: str, run_id: str | None = None) -> str:
    """Write everything of a finished run below `folder`: metrics, per_query, significance (with two pipelines or more)
    and timings as tables; errors (if any), config and metadata as JSON; report.md and dashboard.html. Returns the
    run's folder."""
    config = bench.context.config
    spark = bench.qrels.sparkSession
    at = f"{folder.rstrip('/')}/{run_id or new_run_id(config.dataset)}"
    if bench.errors:
        datasets.save_json(spark, bench.errors, f"{at}/errors.json")
    datasets.save_json(spark, config.to_dict() | {"ran": list(bench.runs)}, f"{at}/config.json")
    datasets.save_json(spark, {"run_id": at.rsplit("/", 1)[1], "seed": config.seed, "hardware": hardware(spark), "packages": packages()}, f"{at}/metadata.json")
    if not bench.runs:
        return at
    per_query = bench.per_query().persist()
    datasets.save_table(per_query, at, "per_query")
    metrics = per_query.groupBy("pipeline", "metric", "k").agg(F.round(F.avg("value"), 5).alias("value")).persist()
    datasets.save_table(metrics, at, "metrics")
    tests: list[dict] = []
    if len(bench.runs) > 1:
        significance = bench.significance().persist()
        datasets.save_table(significance, at, "significance")
        tests = [r.asDict() for r in significance.collect()]
    datasets.save_table(spark.createDataFrame(bench.timings), at, "timings")
    m = report.collected(metrics)
    datasets.save_text(spark, report.report(m, bench.timings, tests), f"{at}/report.md")
    datasets.save_text(spark, report.dashboard(m, bench.timings, tests), f"{at}/dashboard.html")
    return at


def rewrite_report(spark: SparkSession, at: str) -> str:
    """report.md and dashboard.html of a run folder made again from its tables; returns the report's text."""
    found = datasets.load_run(spark, at)
    if "metrics" not in found:
        raise ValueError(f"no metrics in {at}")
    m = report.collected(found["metrics"])
    timings, tests = ([r.asDict() for r in found[name].collect()] if name in found else [] for name in ("timings", "significance"))
    text = report.report(m, timings, tests)
    datasets.save_text(spark, text, f"{at.rstrip('/')}/report.md")
    datasets.save_text(spark, report.dashboard(m, timings, tests), f"{at.rstrip('/')}/dashboard.html")
    return text
