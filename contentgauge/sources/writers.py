"""Sinks: partitioned content and scores, run export, raw snapshots, manifest, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgauge.sources import stage


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that df has are replaced. Rows meet by partition, so that files don't multiply; AQE splits a large one."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_content(df: DataFrame, root: str) -> None:
    _write(df, f"{root}/content", ["brand_id", "src", "run_id"])


def write_scores(df: DataFrame, root: str) -> None:
    _write(df, f"{root}/scores", ["brand_id", "src", "run_id"])


def export_run(runs: DataFrame, assets: DataFrame, scores: DataFrame, brands: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """One run, its assets and their scores, with the partition columns of the analytics tables."""
    run = runs.filter(F.col("run_id") == run_id).join(F.broadcast(brands.select("brand_id", "slug")), "brand_id", "left")
    day = lambda form: F.date_format("started_at", form)
    run = run.withColumns({"brand_slug": F.coalesce("slug", F.lit("unknown")), "year": day("yyyy"), "month": day("MM"), "day": day("dd")}).drop("slug")
    parts = F.broadcast(run.select("run_id", "brand_slug", "year", "month", "day"))
    own = assets.join(parts, "run_id")
    return {"runs": run, "assets": own, "scores": scores.join(own.select("asset_id"), "asset_id", "left_semi").join(parts, F.lit(True)).drop("run_id")}


def write_export(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        _write(df, f"{root}/{name}", ["brand_slug", "year", "month", "day"])


def export_raw(assets: DataFrame, root: str) -> None:
    assets.hint("rebalance", "brand_slug", "run_id", "source_type").write.mode("overwrite").partitionBy("brand_slug", "run_id", "source_type").json(root)


def run_manifest(content: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of each run, brand, source and file in both tables."""
    count = lambda df, label: df.withColumn("file", F.col("_metadata.file_path")).groupBy("run_id", "brand_id", "src", "file").agg(F.count("*").alias("n")).withColumn("table", F.lit(label))
    return count(content, "content").unionByName(count(scores, "scores"))


def prune_runs(tables: dict[str, DataFrame], as_of, days: int) -> tuple[dict[str, DataFrame], int]:
    """runs, assets, scores and summary without runs that started more than days before as_of; how many runs went."""
    old = tables["runs"].filter(F.col("started_at") < F.lit(as_of) - F.make_dt_interval(F.lit(days))).select("run_id")
    gone = tables["assets"].join(old, "run_id", "left_semi").select("asset_id")
    kept = {n: tables[n].join(old, "run_id", "left_anti") for n in ("runs", "assets", "summary") if n in tables}
    kept["scores"] = tables["scores"].join(gone, "asset_id", "left_anti")
    return kept, old.count()


def delete_rows(spark: SparkSession, path: str, gone: DataFrame, on: str, by: list[str], hits: DataFrame | None = None) -> int:
    """Deletes the rows of a table, partitioned by some columns, whose key is in gone; returns how many went.

    Only partitions that hold such rows are written again, and swapped by Spark's committer; those that hold nothing else
    are removed; the files of all others stay as they are. gone must not read the table. Doing it again deletes nothing.
    hits, where they are known, has the partition columns of each row that goes, so that the table is dealt once less.
    """
    df = spark.read.parquet(path)
    if hits is None:
        hits = df.join(gone.select(on).distinct().hint("shuffle_hash"), on, "left_semi")
    both = df.select(*by, F.lit(1).alias("_n"), F.lit(0).alias("_old")).unionByName(hits.select(*by, F.lit(0).alias("_n"), F.lit(1).alias("_old")))
    held = both.groupBy(*by).agg(F.sum("_n").alias("_n"), F.sum("_old").alias("_old")).filter("_old > 0")
    touched = stage.written(held.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n", "_old"))  # a row for each partition
    emptied = touched.filter("_n = _old").select(*[F.col(f"_by_{c}").alias(c) for c in by]).collect()
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    rest = df.join(F.broadcast(touched.filter("_n > _old")), same, "left_semi").join(gone.select(on).distinct().hint("shuffle_hash"), on, "left_anti")
    _write(rest, path, by)
    for part in emptied:
        stage.delete_path(spark, "/".join([path, *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if part[c] is None else part[c]}" for c in by)]))
    return touched.agg(F.sum("_old")).first()[0] or 0


def prune_written(spark: SparkSession, root: str, by: dict[str, list[str]], as_of, days: int) -> dict[str, int]:
    """Deletes runs that started more than days before as_of, with their assets, scores and summary, from the tables under root; rows deleted by table.

    by has the partition columns of each table, whose values need no escaping in a path. Scores go first and runs last,
    so a cascade that was cut off is carried on by the next call. Assets meet old runs once, for their own partitions and
    for the scores.
    """
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    old = stage.written(read("runs").filter(F.col("started_at") < F.lit(as_of) - F.make_dt_interval(F.lit(days))).select("run_id"))
    gone = stage.written(read("assets").join(old.hint("shuffle_hash"), "run_id", "left_semi").select(*dict.fromkeys(["asset_id", *by.get("assets", [])])))
    ids = {"scores": (gone, "asset_id"), "assets": (old, "run_id"), "summary": (old, "run_id"), "runs": (old, "run_id")}
    return {name: delete_rows(spark, f"{root}/{name}", *ids[name], by[name], gone if name == "assets" else None) for name in ids if name in by}
