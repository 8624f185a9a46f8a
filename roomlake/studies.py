"""Studies: cases by configurations, what is measured of them, and tables and reports of the results.

A study is a DataFrame from end to end: a small table of configurations meets the
cases, what an earlier run has stored is left out, rows are measured side by side,
and summaries are aggregates. Only finished tables of a few rows reach the driver,
for the report.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlake.operators import agg, sampling
from roomlake.operators.ranking import join_on
from roomlake.sources import exports, tables


@dataclass(frozen=True)
class Outputs:
    """Tables of a study by name, and numbers that describe the run."""

    tables: Mapping[str, DataFrame]
    about: Mapping[str, object] = field(default_factory=dict)


def configurations(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    """The configurations of a study, a row each; they are few by nature."""
    return spark.createDataFrame([dict(r) for r in rows])


def cases(plans: DataFrame, configured: DataFrame, *, trials: int = 1) -> DataFrame:
    """Every plan's case under every configuration and trial. The configurations are a table of a few rows that Spark sends to all tasks."""
    return plans.crossJoin(configured).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))


def measured(asked: DataFrame, measure: Callable[[DataFrame], DataFrame], *, keys: Sequence[str], path: str | None = None, mark: str = "") -> DataFrame:
    """Rows of ``measure`` for the cases that ``path`` has none of yet under ``mark``, added there; all rows of the mark."""
    if path is None:
        return measure(asked)
    spark = asked.sparkSession
    key = F.sha2(F.to_json(F.struct(*keys)), 256)
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = None
    keyed = asked.withColumn("_key", key)
    if stored is not None:
        _, keyed = tables.resume(keyed, stored, mark, "_key")
    fresh = measure(keyed.drop("_key")).withColumn("_key", key)
    tables.append_checkpoint(fresh, path, mark)
    done = spark.read.parquet(path).where(F.col("signature") == mark).dropDuplicates(["_key"])
    return done.drop("signature", "_key")


def stratified_cases(profiles: DataFrame, *, key: str, area: str, index: str, calibration: int, validation: int, seed: int) -> DataFrame:
    """Plans of both splits with their profile: strata of equal count by area, disjoint."""
    split = sampling.stratified_split(profiles, key, area=area, index=index, calibration=calibration, validation=validation, seed=seed)
    return split.join(profiles.drop(area, key), index)


def judged(rows: DataFrame, keys: Sequence[str], *, plan: str, error: str, correct: Column, local: Column, count: str, iterations: int = 200) -> Outputs:
    """Metrics of each group, intervals over plans, and for each key the smallest configuration that will do."""
    metrics = agg.group_metrics(rows, [*keys, count], plan=plan, error=error, correct=correct, local=local)
    ci = agg.bootstrap_cluster_ci(rows, [*keys, count], cluster=plan, value=error, iterations=iterations)
    recommended = agg.recommend(metrics, list(keys), count=count)
    return Outputs({"metrics": join_on(metrics, ci, [*keys, count], "left"), "recommended": recommended})


def stratified_study(profiles: DataFrame, configured: DataFrame, measure: Callable[[DataFrame], DataFrame], *, key: str, area: str, index: str, count: str, calibration: int = 5, validation: int = 3, seed: int = 17, trials: int = 1, path: str | None = None, mark: str = "") -> Outputs:
    """From profiles to recommendations: split, measure what isn't stored, summarise the validation rows, and keep those of the recommended configurations.

    ``measure`` adds error, correct (boolean) and local (boolean) to the rows of its cases.
    """
    split = stratified_cases(profiles, key=key, area=area, index=index, calibration=calibration, validation=validation, seed=seed)
    asked = cases(split, configured, trials=trials)
    rows = measured(asked, measure, keys=[index, *configured.columns, "trial"], path=path, mark=mark)
    held = rows.where("split = 'validation'")
    found = judged(held, [key], plan=index, error="error", correct=F.col("correct"), local=F.col("local"), count=count)
    chosen = join_on(held, found.tables["recommended"].select(key, count), [key, count])
    by_area = agg.group_metrics(chosen, [key, "area_bin"], plan=index, error="error", correct=F.col("correct"), local=F.col("local"))
    summary = agg.population_summary(profiles, key, area=area, connected=F.lit(True), valid=F.lit(True))
    return Outputs({**found.tables, "population": summary, "by_area": by_area, "rows": rows}, {"calibration": calibration, "validation": validation, "seed": seed, "trials": trials})


def compared(rows: DataFrame, keys: Sequence[str], *, strategy: str, baseline: str, metrics: Sequence[str], improved: str) -> Outputs:
    """Strategies side by side: means and shares, and each against the baseline's row of the same case."""
    return Outputs({"strategies": agg.positive_share(rows, [strategy], metrics, improved), "paired": agg.paired_comparison(rows, keys, strategy=strategy, baseline=baseline, metrics=metrics)})


def rebuilt(rows: DataFrame, recommended: DataFrame, *, key: str, count: str, area_bin: str, plan: str) -> DataFrame:
    """Metrics by area of stored rows, for the recommended configuration of each key."""
    chosen = join_on(rows, recommended.select(key, count), [key, count])
    return agg.group_metrics(chosen, [key, area_bin], plan=plan, error="error", correct=F.col("correct"), local=F.col("local"))


def report(outputs: Outputs, title: str, shown: Sequence[str]) -> str:
    """Markdown of the run's numbers and of the tables ``shown``."""
    lines = [f"# {title}", "", *[f"* {k}: {v}" for k, v in outputs.about.items()], ""]
    for name in shown:
        table = outputs.tables[name]
        lines += [f"## {name.replace('_', ' ')}", "", exports.markdown(table.orderBy(*[c for c, t in table.dtypes if not t.startswith(("array", "map", "struct"))][:2])), ""]
    return "\n".join(lines)


def write(outputs: Outputs, path: str, title: str, *, shown: Sequence[str]) -> None:
    """Each table as CSV with a header in a folder of its name, summary.json, report.md and report.html, wherever Spark can write.

    Tables that aren't ``shown`` may be large and are written in parts.
    """
    spark = next(iter(outputs.tables.values())).sparkSession
    for name, table in outputs.tables.items():
        flat = table.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in table.dtypes])
        (flat.coalesce(1) if name in shown else flat).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    counts = {name: outputs.tables[name].count() for name in shown}
    text = report(outputs, title, shown)
    for name, content in (("summary.json", json.dumps({"title": title, **outputs.about, "rows": counts}, default=str)), ("report.md", text), ("report.html", exports.html(text, title))):
        exports.write_text(spark, content, f"{path}/{name}")
