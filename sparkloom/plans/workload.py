"""Join workloads from options, their relations, and their runs: what `python -m sparkloom` offers."""

from __future__ import annotations

import argparse
import csv
import json
import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import joins, partition, sealing
from ..sources import generators
from . import pipeline
from .metrics import JoinMetrics, measured

LOG = logging.getLogger("sparkloom")
DEFAULT_ROWS, R_SEED, S_SEED = 2_097_152, 11111, 22222


@dataclass(frozen=True)
class JoinWorkload:
    """R has keys 1 .. r_rows, S foreign keys; skew (Zipf) goes before selectivity, files before both."""

    algorithm: str = "RHO"
    r_rows: int = DEFAULT_ROWS
    s_rows: int = DEFAULT_ROWS
    selectivity: float = 100
    skew: float = 0
    sort_r: bool = False
    sort_s: bool = False
    seal: bool = False
    three_way: bool = False
    r_path: str | None = None
    s_path: str | None = None
    seed: int = S_SEED

    def __post_init__(self) -> None:
        joins.strategy(self.algorithm)
        if not 0 <= self.selectivity <= 100:
            raise ValueError("selectivity is a percentage from 0 to 100")
        if self.r_rows < 1 or self.s_rows < 0 or self.skew < 0:
            raise ValueError("sizes and skew cannot be negative, nor R empty")

    @classmethod
    def of_options(cls, dataset: str | None = None, r_rows: int | None = None, s_rows: int | None = None, r_mb: float | None = None, s_mb: float | None = None, **rest) -> "JoinWorkload":  # noqa: ANN003  fields
        """Sizes by data set, rows or MB; a data set excludes the others."""
        own = {"r_rows": generators.rows_of_megabytes(r_mb) if r_mb is not None else r_rows, "s_rows": generators.rows_of_megabytes(s_mb) if s_mb is not None else s_rows}
        if dataset is not None:
            if any(x is not None for x in own.values()):
                raise ValueError("a data set has its sizes; give either")
            if dataset not in generators.DATASETS:
                raise ValueError(f"no data set {dataset!r}; there are {', '.join(generators.DATASETS)}")
            own = dict(zip(own, generators.DATASETS[dataset], strict=True))
        return cls(**{k: v for k, v in own.items() if v is not None}, **rest)

    def relations(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        r = generators.keys_from_file(spark, self.r_path) if self.r_path else generators.primary_keys(spark, self.r_rows)
        if self.s_path:
            s = generators.keys_from_file(spark, self.s_path)
        elif self.skew:
            s = generators.zipf_keys(spark, self.s_rows, self.r_rows, self.skew, self.seed)
        else:
            s = generators.foreign_keys_selective(spark, self.s_rows, generators.domain_of_selectivity(self.r_rows, self.selectivity))
        return (partition.range_partition(r) if self.sort_r else r), (partition.range_partition(s) if self.sort_s else s)

    def rows(self, spark: SparkSession, key: bytes = b"0123456789abcdef") -> DataFrame:
        """The join's rows; of the three-way join (key, payload), and sealed if asked for."""
        r, s = self.relations(spark)
        if self.three_way:
            t = generators.foreign_keys(spark, self.s_rows, self.r_rows)
            out = pipeline.three_way(r, s, t, joins.ALIASES.get(self.algorithm, self.algorithm))
        else:
            out = joins.join_rows(self.algorithm, r, s)
        return sealing.seal_chunks(out.select("key", out.columns[1]).toDF("key", "payload"), key) if self.seal else out

    def run(self, spark: SparkSession) -> JoinMetrics:
        LOG.info("%s: %d x %d rows", self.algorithm, self.r_rows, self.s_rows)
        sizes = [x.count() if p else n for x, p, n in zip(self.relations(spark), (self.r_path, self.s_path), (self.r_rows, self.s_rows), strict=True)]
        out = measured(self.algorithm, self.rows(spark), *sizes)
        LOG.info("%s: %d rows out in %.3f s, %.3f M rows/s", out.algorithm, out.matches, out.seconds, out.mrec_per_s)
        return out


def append_csv(path: str, workload: JoinWorkload, metrics: JoinMetrics, threads: int) -> None:
    """A row (algorithm, threads, r_rows, s_rows, selectivity, skew, matches, seconds, throughput) at the file's end; a header if it is new."""
    fields = {"algorithm": workload.algorithm, "threads": threads, "r_rows": metrics.r_rows, "s_rows": metrics.s_rows, "selectivity": workload.selectivity, "skew": workload.skew, "matches": metrics.matches, "seconds": metrics.seconds, "throughput": metrics.mrec_per_s}
    with open(path, "a", newline="") as f:
        out = csv.DictWriter(f, fields)
        if not f.tell():
            out.writeheader()
        out.writerow(fields)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description="Run an equi-join on a generated workload and print its metrics as JSON.")
    p.add_argument("-a", "--algorithm", default="RHO", help=f"one of {', '.join([*joins.STRATEGIES, *joins.ALIASES])}")
    p.add_argument("-d", "--dataset", help=", ".join(generators.DATASETS))
    p.add_argument("-n", "--threads", type=int, default=os.cpu_count())
    for flag, name, kind, text in (("-r", "r_rows", int, "rows of R"), ("-s", "s_rows", int, "rows of S"), ("-x", "r_mb", float, "MB of R"), ("-y", "s_mb", float, "MB of S")):
        p.add_argument(flag, dest=name, type=kind, help=text)
    p.add_argument("-l", "--selectivity", type=float, default=100, help="percent of S that finds a partner")
    p.add_argument("-z", "--skew", type=float, default=0, help="Zipf exponent of S")
    p.add_argument("-e", "--seed", type=int, default=S_SEED)
    p.add_argument("-v", "--verbose", action="store_true")
    for flag in ("--seal", "--sort-r", "--sort-s", "--three-way-join"):
        p.add_argument(flag, dest=flag[2:].replace("-", "_").removesuffix("_join"), action="store_true")
    p.add_argument("--r-path")
    p.add_argument("--s-path")
    p.add_argument("--csv", help="append a row to this file")
    return p


def main(argv: list[str] | None = None) -> None:
    options = vars(parser().parse_args(argv))
    threads, verbose, path = (options.pop(x) for x in ("threads", "verbose", "csv"))
    logging.basicConfig(level=logging.INFO if verbose else logging.WARNING, format="[%(asctime)s][%(levelname)s] %(message)s")
    workload = JoinWorkload.of_options(**options)
    spark = SparkSession.builder.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", threads).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    metrics = workload.run(spark)
    if path:
        append_csv(path, workload, metrics, threads)
    print(json.dumps(metrics.as_dict()))
