"""A versioned cache of scores, changed partition by partition.

The cache has two tables in the shared folder. `cells` holds the observations with their scores in a partition for each
indicator; `sums` holds one row per company (exact sums of scores and weights, company_sums) in partitions by a hash of
its code. A version is a manifest: a small file that names, for each partition, the version that wrote it.

A change writes new partitions for its own indicators and for the companies that hold them, and then the manifest. It
reads the cells of its indicators alone: sums are whole numbers, so a company's row is its old one, less what the old cells
gave, plus what the new ones give, and equals a full rescore bit for bit. Until the manifest is there, nothing has
changed: a change that failed is written anew under the same version, and one that is repeated is recognised by its
source and number. Older versions stay readable until expire() removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.operators.scoring import MINIMUM_POPULATION, SUMS, company_sums, dense_ranks, grades, latest_rows, population_stats, scored_cells, scores
from verdigris.schemas import KEY
from verdigris.sources.shared import file_names, read_file, remove_folder, shared_dir, staged, write_file_once

CHANGE_COLUMNS = [*KEY, "company_name", "value", "status", "_ord"]
CELLS = "company_code string, report_year int, indicator_code string, company_name string, value double, status string, _ord long, live boolean, score double, v int, slot int"
COMPANIES_A_BUCKET = 200_000
ADDED = ["confirmed", *SUMS]
ROW = f"company_code string, company_name string, {', '.join(f'{c} long' for c in ADDED)}, v int, bucket int"


class ScoreCache:
    """One version of the cache: immutable; apply() makes the next one."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict, indicators: DataFrame, strategy: str, minimum: int = MINIMUM_POPULATION):
        self.spark, self.root, self.manifest, self.indicators, self.strategy, self.minimum = spark, root, manifest, indicators, strategy, minimum

    @classmethod
    def build(cls, obs: DataFrame, indicators: DataFrame, strategy: str, minimum: int = MINIMUM_POPULATION, root: str | None = None) -> ScoreCache:
        """The cache of one year's observations, as version 0."""
        spark = obs.sparkSession
        root = root or f"{shared_dir(spark)}/verdigris/cache-{uuid.uuid4().hex}"
        obs = staged(obs.select(*CHANGE_COLUMNS), "observations")
        companies = obs.select(F.approx_count_distinct("company_code")).first()[0]
        self = cls(spark, root, {"version": 0, "buckets": 1 + companies // COMPANIES_A_BUCKET, "applied": {}, "cells": {}, "sums": {}}, indicators, strategy, minimum)
        slots = self._write_cells(self._scored(obs), 0)
        cells = self._read("cells", {s: 0 for s in slots})
        sums = self._sums(cells, "min_by(company_name, _ord) AS company_name")
        buckets = self._write("sums", sums.withColumn("bucket", self._bucket()), "bucket", 0)
        return self._commit({**self.manifest, "cells": {s: 0 for s in slots}, "sums": {b: 0 for b in buckets}})

    @classmethod
    def open(cls, spark: SparkSession, root: str, indicators: DataFrame, strategy: str, minimum: int = MINIMUM_POPULATION) -> ScoreCache:
        """The last version that was committed under a folder."""
        names = [n for n in file_names(spark, f"{root}/manifests") if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"no score cache under {root}")
        manifest = json.loads(read_file(spark, f"{root}/manifests/{names[-1]}"))
        return cls(spark, root, manifest, indicators, strategy, minimum)

    def ranking(self) -> DataFrame:
        """All companies' scores, grades and ranks, from their sums."""
        rows = staged(scores(self.sums(), self.indicators, (self.strategy,)), "scores")
        return dense_ranks(grades(rows), within=("strategy",))

    def cells(self, *codes: str) -> DataFrame:
        """Observations with scores, of some indicators or all."""
        slots = self._slots()
        return self._read("cells", {slots[c]: self.manifest["cells"][str(slots[c])] for c in codes or slots if str(slots[c]) in self.manifest["cells"]})

    def sums(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read("sums", {b: v for b, v in self.manifest["sums"].items() if buckets is None or int(b) in buckets})

    def apply(self, changes: DataFrame, source: str | None = None, number: int = 0) -> ScoreCache:
        """The version in which `changes` replace the observations of their keys (the last of a key counts) or join them.

        With a source, changes of one number are applied once; a number that the source has passed changes nothing.
        """
        if source is not None and self.manifest["applied"].get(source, -1) >= number:
            return self
        version = self.manifest["version"] + 1
        applied = {**self.manifest["applied"], **({source: number} if source is not None else {})}
        changes = latest_rows(changes.select(*CHANGE_COLUMNS)).filter(F.col("indicator_code").isin(*self._slots())).persist()
        codes = [r[0] for r in changes.select("indicator_code").distinct().collect()]  # indicators of one methodology: 80 at most
        if not codes:
            return self._commit({**self.manifest, "version": version, "applied": applied})
        before = self.cells(*codes)
        after = before.select(*CHANGE_COLUMNS).join(changes.select(*KEY), KEY, "left_anti").unionByName(changes)
        after = after.persist()  # the moved indicators' rows: made again from tables if an executor is lost
        slots = self._write_cells(self._scored(after), version)
        fresh = self._read("cells", {s: version for s in slots})
        signed = [(before, -1), (fresh, 1)]
        moved = None
        for cells, sign in signed:
            part = self._sums(cells).select("company_code", *[(F.col(c) * sign).alias(c) for c in ADDED])
            moved = part if moved is None else moved.unionByName(part)
        moved = moved.groupBy("company_code").agg(*[F.sum(c).alias(c) for c in ADDED]).withColumn("bucket", self._bucket())
        moved = moved.persist()  # one row per company that holds a changed indicator
        buckets = [r[0] for r in moved.select("bucket").distinct().collect()]  # one per COMPANIES_A_BUCKET companies
        names = self._names(changes, fresh, codes)
        old = self.sums(buckets).drop("v", "bucket")
        joined = old.join(moved.drop("bucket").withColumnsRenamed({c: f"+{c}" for c in ADDED}), "company_code", "full").join(names, "company_code", "left")
        rows = joined.select("company_code", F.coalesce("new_name", "company_name").alias("company_name"), *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"+{c}", F.lit(0))).alias(c) for c in ADDED], self._bucket().alias("bucket"))
        written = self._write("sums", rows, "bucket", version)
        for used in (changes, after, moved):
            used.unpersist()
        current = {"cells": {s: version for s in slots}, "sums": {b: version for b in written}}
        return self._commit({**self.manifest, "version": version, "applied": applied, **{t: {**self.manifest[t], **{str(k): v for k, v in current[t].items()}} for t in current}})

    def expire(self) -> None:
        """Remove what this version does not need, older manifests first."""
        for name in file_names(self.spark, f"{self.root}/manifests"):
            if name < self._manifest_name(self.manifest["version"]):
                remove_folder(self.spark, f"{self.root}/manifests/{name}")
        for table, folder in (("cells", "slot"), ("sums", "bucket")):
            for version in range(self.manifest["version"]):
                for name in file_names(self.spark, f"{self.root}/{table}/v={version}"):
                    if name.startswith(f"{folder}=") and self.manifest[table].get(name.partition("=")[2]) != version:
                        remove_folder(self.spark, f"{self.root}/{table}/v={version}/{name}")

    # How the tables are made and kept.

    def _slots(self) -> dict[str, int]:
        """Indicators numbered in the order of their codes: folders have plain names."""
        if not hasattr(self, "_numbered"):
            self._numbered = {c: i for i, c in enumerate(sorted(r[0] for r in self.indicators.select("code").distinct().collect()))}
        return self._numbered

    def _named(self) -> DataFrame:
        return self.spark.createDataFrame([(c, i) for c, i in self._slots().items()], "indicator_code string, slot int")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("company_code"), F.lit(self.manifest["buckets"])).cast("int")

    def _scored(self, obs: DataFrame) -> DataFrame:
        """Cells of staged observations: `live` marks the row that counts for its key, the last; others are in the population only."""
        last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("_ord"))) == 1
        scored = scored_cells(obs.withColumn("live", last), self.indicators, population_stats(obs, self.minimum))
        return scored.join(F.broadcast(self._named()), "indicator_code").select(*CHANGE_COLUMNS, "live", "score", "slot")

    def _sums(self, cells: DataFrame, *others: str) -> DataFrame:
        meta = F.broadcast(self.indicators.selectExpr("code AS indicator_code", "kind", "dimension", "weight"))
        return company_sums(cells.filter("live").join(meta, "indicator_code"), *others)

    def _names(self, changes: DataFrame, fresh: DataFrame, codes: list[str]) -> DataFrame:
        """company_code, new_name of the companies of the changes: that of a company's first row, over all its cells."""
        others = [c for c in self._slots() if c not in codes]
        cells = fresh.unionByName(self.cells(*others)) if others else fresh
        found = cells.filter("live").select("company_code", "company_name", "_ord").join(changes.select("company_code").distinct(), "company_code", "left_semi")
        return found.groupBy("company_code").agg(F.min_by("company_name", "_ord").alias("new_name"))

    def _read(self, table: str, versions: dict) -> DataFrame:
        schema, folder = (CELLS, "slot") if table == "cells" else (ROW, "bucket")
        paths = [f"{self.root}/{table}/v={v}/{folder}={k}" for k, v in versions.items()]
        reader = self.spark.read.schema(schema)
        return reader.option("basePath", f"{self.root}/{table}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write_cells(self, cells: DataFrame, version: int) -> list[int]:
        return self._write("cells", cells, "slot", version)

    def _write(self, table: str, df: DataFrame, folder: str, version: int) -> list[int]:
        """Partitions of a version; what a failed attempt left under it goes. Returns the partitions that have rows."""
        path = f"{self.root}/{table}/v={version}"
        df.hint("rebalance", folder).write.partitionBy(folder).mode("overwrite").parquet(path)
        return [int(n.partition("=")[2]) for n in file_names(self.spark, path) if n.startswith(f"{folder}=")]

    @staticmethod
    def _manifest_name(version: int) -> str:
        return f"{version:012d}.json"

    def _commit(self, manifest: dict) -> ScoreCache:
        manifest = json.loads(json.dumps(manifest))
        if not write_file_once(self.spark, f"{self.root}/manifests/{self._manifest_name(manifest['version'])}", json.dumps(manifest)):
            raise RuntimeError(f"version {manifest['version']} of {self.root} was committed by another writer")
        done = ScoreCache(self.spark, self.root, manifest, self.indicators, self.strategy, self.minimum)
        done._numbered = self._slots()
        return done
