"""Sinks: ranking exports, nested JSON, revisions and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.numeric import plain_number, rounded
from verdigris.schemas import KEY


def two_row_export(ranked: DataFrame, details: DataFrame, codes: list[str], top: int = 0) -> DataFrame:
    """Two lines for each company, raw values and weighted scores of the key indicators, in rank order; top 0: all."""
    order = [F.desc("total_score"), "company_code"]
    chosen = ranked.orderBy(*order).limit(top) if top > 0 else ranked
    picked = details.filter(F.col("indicator_code").isin(*codes)).join(chosen.select("company_code", "rank", "total_score"), "company_code")
    raw = F.when(F.col("status") == "confirmed", F.col("raw"))
    wide = picked.groupBy("company_code", "rank", "total_score").pivot("indicator_code", codes).agg(F.first(F.struct(raw.alias("value"), F.col("weighted").alias("score"))))
    lines = wide.withColumn("line", F.explode(F.array(F.lit("value"), F.lit("score"))))
    cell = lambda c: rounded(F.when(F.col("line") == "value", F.col(f"`{c}`")["value"]).otherwise(F.col(f"`{c}`")["score"]), 4)
    return lines.select("company_code", "rank", "line", *[cell(c).alias(f"k{i + 1}") for i, c in enumerate(codes)])


def nested_json(details: DataFrame) -> DataFrame:
    """company_code with its details as one JSON array, in order of the indicators."""
    cells = F.struct(*[c for c in ("indicator_code", *[c for c in details.columns if c not in ("company_code", "indicator_code")])])
    return details.groupBy("company_code").agg(F.to_json(F.sort_array(F.collect_list(cells))).alias("details"))


def upsert_revisions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append-only: each incoming row becomes its key's next revision; order among them by _ord."""
    latest = current.groupBy(*KEY).agg(F.max("revision").alias("_last"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("_ord"))
    numbered = incoming.withColumn("_place", place).join(latest, KEY, "left").withColumn("revision", F.coalesce("_last", F.lit(0)) + F.col("_place")).drop("_last", "_place")
    return current.unionByName(numbered.select(*current.columns))


def latest_revisions(history: DataFrame) -> DataFrame:
    """The row of the largest revision of each key."""
    rest = [c for c in history.columns if c not in KEY]
    return history.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "revision").alias("r")).select(*KEY, "r.*").select(*history.columns)


def write_csv(df: DataFrame, path: str, digits: int = 12) -> None:
    """CSV with a header, quotes doubled, numbers in plain decimals."""
    shown = df.select(*[plain_number(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    shown.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_with_summary(df: DataFrame, summary: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_year_partitions(obs: DataFrame, path: str) -> None:
    """Observations by report year, so that a year's scoring reads its own files; large years go to several tasks."""
    obs.hint("rebalance", "report_year").write.mode("overwrite").partitionBy("report_year").parquet(path)


def ranking_html(rows: list, title: str = "Ranking") -> str:
    """A page for a small collected ranking."""
    from html import escape

    if not rows:
        return f"<html><body><h1>{escape(title)}</h1></body></html>"
    names = list(rows[0].asDict())
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<html><body><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"
