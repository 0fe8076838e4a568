"""Text sources: benchmark output, comparison CSV, metadata and auth files, configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value. A file is one value of one task, so it must stay below 2 GB: benchmark
    output is small, and its sections need their order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def bench_sections(lines: DataFrame) -> DataFrame:
    """Lines by package. goos, goarch and cpu lines lead into the section that the next
    `pkg:` line starts; others belong to the last one; lines without a section are dropped.
    Sections of one package merge by having its name, in file order."""
    pkg = F.when(F.startswith("value", F.lit("pkg: ")), F.trim(F.substring("value", 6, 1 << 20)))
    lead = F.col("value").rlike("^(goos|goarch|cpu):")
    down = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("file").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(lead, F.last(pkg, ignorenulls=True).over(back)).otherwise(F.last(pkg, ignorenulls=True).over(down))
    return lines.withColumn("pkg", own).where("pkg is not null").select("file", "pkg", "line_no", "value")


def bench_results(sections: DataFrame) -> DataFrame:
    """Benchmark lines as rows: pkg, name, iterations, value, unit (one per measured unit)."""
    parts = F.split(F.trim("value"), r"\s+")
    x = sections.where(F.startswith("value", F.lit("Benchmark"))).withColumn("p", parts).where(F.size("p") >= 4)
    pairs = F.transform(F.sequence(F.lit(2), F.size("p") - 2, F.lit(2)), lambda i: F.struct(F.element_at("p", i + 1).try_cast("double").alias("value"), F.element_at("p", i + 2).alias("unit")))
    return x.select("pkg", F.col("p")[0].alias("name"), F.col("p")[1].try_cast("long").alias("iterations"), F.explode(pairs).alias("r")).select("pkg", "name", "iterations", "r.*")


def benchstat_rows(lines: DataFrame) -> DataFrame:
    """Comparison rows: name, metric, status, significant, delta_pct, warned.

    A row without a name whose second cell ends in /op is a header: it names the metric and
    sets the width of its table. geomean is no benchmark. A shorter row is missing from the
    baseline if its second cell is empty, else from the new run. The delta is the last cell
    but one: `~` or nothing is not significant, `?` warns.
    """
    x = lines.withColumn("c", F.split("value", ",", -1)).where(F.size("c") >= 3)
    first, second = F.col("c")[0], F.col("c")[1]
    header = F.when((first == "") & F.endswith(second, F.lit("/op")), F.struct(second.alias("metric"), F.size("c").alias("width")))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("h", F.last(header, ignorenulls=True).over(w)).where((first != "") & (first != "geomean"))
    short = F.coalesce(F.size("c") < F.col("h.width"), F.lit(False))
    status = F.when(short & (second == ""), "missing-from-baseline").when(short, "missing-from-new").otherwise("compared")
    delta = F.when(~short, F.element_at("c", -2))
    pct = F.regexp_replace(delta, "[+%]", "").try_cast("double")
    return x.select("file", first.alias("name"), F.col("h.metric").alias("metric"), status.alias("status"), pct.isNotNull().alias("significant"), F.coalesce(pct, F.lit(0.0)).alias("delta_pct"), F.coalesce(delta == "?", F.lit(False)).alias("warned"))


def read_metadata(spark: SparkSession, root: str, kind: str, schema: str, one_a_file: bool = False) -> DataFrame:
    """The entities of a kind, as write_metadata() left them, or from files of one JSON document
    each, of any number of lines."""
    path = f"{root}/{kind}"
    return spark.read.schema(schema).json(f"{path}/*.json", multiLine=True) if one_a_file else spark.read.schema(schema).json(path)


def write_metadata(rows: DataFrame, root: str, kind: str) -> None:
    """Replace a kind's table in one commit: a JSON document a line, one line an entity."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/{kind}")


AUTH_SCHEMA = (
    "users array<struct<username:string, password_hash:string, loopback_only:boolean, vhost_permissions:array<struct<vhost:string, permission:struct<configure:string, write:string, read:string>>>, "
    "permissions:array<struct<resource:string, action:string, pattern:string>>>>"
)


def read_auth(spark: SparkSession, path: str) -> DataFrame:
    """One row per user of an auth file."""
    return spark.read.schema(AUTH_SCHEMA).json(path, multiLine=True).select(F.explode("users").alias("u")).select("u.*")


@dataclass
class Config:
    """Settings that change results; read from JSON and the environment, environment first."""

    prefetch_default: int = 2000
    ring_size: int = 262144
    spill_percent: int = 80
    depth_override: int = 0
    shared_body_bytes: int = 4096
    compaction_ratio: float = 0.5
    pending_ack_age_ms: int = 3_600_000
    memory_high: float = 0.4
    disk_floor_bytes: int = 50_000_000
    hysteresis: float = 0.1
    extra: dict = field(default_factory=dict)

    def validated(self) -> Config:
        for name, low, high in (("prefetch_default", 1, 65535), ("spill_percent", 1, 100), ("compaction_ratio", 0, 1), ("memory_high", 0, 1), ("hysteresis", 0, 0.99)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        return self


def load_config(path: str | None = None, environ: dict | None = None, prefix: str = "FLOWMILL_") -> Config:
    raw: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    env = os.environ if environ is None else environ
    known = {f.name: f.type for f in fields(Config) if f.name != "extra"}
    for name in known:
        if prefix + name.upper() in env:
            raw[name] = env[prefix + name.upper()]
    own = {k: (float(v) if "float" in str(known[k]) else int(v)) for k, v in raw.items() if k in known}
    return Config(**own, extra={k: v for k, v in raw.items() if k not in known}).validated()
