"""Report files, keyed upserts, row ranges and the log and alert sinks."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.functions import fixed_values as fv


#: byte order mark that some exports start with
MARK = "\ufeff"


def normalize_header(name: str) -> str:
    return name.lstrip("﻿").strip().replace(" ", "_").lower()


def report_header(line: str) -> tuple[list[str], T.StructType]:
    """The header's texts and a schema of their normalised names."""
    raw = next(csv.reader([line]))
    return raw, T.StructType([T.StructField(normalize_header(h), T.StringType()) for h in raw])


def without_headers(rows: DataFrame, raw: Sequence[str]) -> DataFrame:
    """Rows that do not repeat the header, which several files each bring along."""
    is_header = F.lit(True)
    for n, h in zip(rows.columns, raw, strict=True):
        is_header &= F.trim(F.translate(f"`{n}`", MARK, "")) == F.lit(h.replace(MARK, "").strip())
    return rows.where(~F.coalesce(is_header, F.lit(False)))


def read_report_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Report with a junk first row and the header in the second.

    Only the two leading lines come to the driver, for the column names. The
    CSV source drops one header line per file itself; the real header line is
    left in the data and recognised by its text.
    """
    lead = [r.value for r in spark.read.text(path).limit(2).collect()]
    if len(lead) < 2:
        raise ValueError("report has fewer than 2 lines: a junk row and a header are needed")
    raw, schema = report_header(lead[1])
    rows = without_headers(spark.read.schema(schema).csv(path, header=True, enforceSchema=True), raw)
    return infer_types(rows) if infer else rows


def report_from_lines(lines: DataFrame, header: str, infer: bool = True) -> DataFrame:
    """The same for lines of text (`value`) without the files' junk rows."""
    raw, schema = report_header(header)
    parsed = lines.where(F.trim("value") != "").select(F.from_csv("value", schema.toDDL()).alias("row")).select("row.*")
    rows = without_headers(parsed, raw)
    return infer_types(rows) if infer else rows


def infer_types(df: DataFrame) -> DataFrame:
    """Longs and doubles where every value of a text column is one.

    One aggregate over all columns decides; leading zeros stay text. The casts
    may run before earlier filters, so that they do not fail on dropped rows.
    """
    names = df.columns

    def all_match(c: str, pattern: str) -> Column:
        v = F.trim(F.col(f"`{c}`"))
        bad = (v != "") & ~v.rlike(pattern)
        return F.max(F.when(bad, 1).otherwise(0)) == 0

    def any_value(c: str) -> Column:
        return F.max(F.when(F.trim(F.col(f"`{c}`")) != "", 1).otherwise(0)) == 1

    checks = []
    for i, c in enumerate(names):
        checks += [
            (any_value(c) & all_match(c, r"^-?(0|[1-9]\d{0,17})$")).alias(f"l{i}"),
            (any_value(c) & all_match(c, r"^-?\d+\.\d+$")).alias(f"d{i}"),
        ]
    found = df.agg(*checks).first()
    cols = []
    for i, c in enumerate(names):
        kind = "bigint" if found[f"l{i}"] else "double" if found[f"d{i}"] else "string"
        v = F.col(f"`{c}`")
        cols.append((F.nullif(F.trim(v), F.lit("")).try_cast(kind) if kind != "string" else v).alias(c))
    return df.select(*cols)


def upsert(target: DataFrame | None, staging: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staging rows replace target rows of the same key, the rest is kept.

    A key that is NULL matches nothing, as in a merge. Repeated staging keys
    that match would make a merge ambiguous and raise here when evaluated.
    Without a target, staging is the result.
    """
    if target is None:
        return staging
    same_key = Window.partitionBy(*keys)
    complete = F.lit(True)
    for k in keys:
        complete &= F.col(k).isNotNull()
    marked = staging.withColumn("_copies", F.count(F.lit(1)).over(same_key))
    # marking matches keeps the check to keys the target really holds
    present = target.select(*keys).distinct().withColumn("_hit", F.lit(True))
    checked = marked.join(present, list(keys), "left").withColumn(
        "_ok",
        F.when(
            complete & F.col("_hit").isNotNull() & (F.col("_copies") > 1),
            F.raise_error(F.lit("upsert: several staging rows match one target key")),
        ).otherwise(F.lit(True)),
    )
    fresh = checked.where(F.col("_ok")).select(*staging.columns)
    kept = target.join(staging.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*staging.columns).unionByName(fresh)


def write_upsert(
    spark: SparkSession, target_path: str | None, staging: DataFrame, keys: Sequence[str], out_path: str
) -> None:
    """Upsert parquet into a new location; readers switch over afterwards."""
    target = spark.read.parquet(target_path) if target_path else None
    upsert(target, staging, keys).write.mode("errorifexists").parquet(out_path)


#: a generated row id keeps the row's place in its partition in the lower bits
PARTITION_SHIFT = 33
ROW_ID = "__row_id"


def row_range(df: DataFrame, start: int, n: int) -> DataFrame:
    """``n`` rows from the 1-based row ``start`` on, in file order.

    A row id holds the partition and the row's place in it, so ids grow in file
    order; counts per partition tell the ids at both ends and one comparison
    keeps the rows between them. The count reads no column. `df` is a scan or
    row-wise steps on one: what a shuffle deals out has no file order.
    """
    row_id = F.monotonically_increasing_id()
    sizes = (
        df.select(F.shiftright(row_id, PARTITION_SHIFT).alias("part"))
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("part")
    )
    skip, last, before = max(0, start - 1), max(0, start - 1) + n - 1, 0
    bounds: list[int] = []
    for part, size in sizes.toLocalIterator():  # one row a partition
        inside = max(skip, before), min(last, before + size - 1)
        if inside[0] <= inside[1]:
            bounds += [(part << PARTITION_SHIFT) + place - before for place in inside]
        before += size
        if before > last:
            break
    if not bounds:
        return df.limit(0)
    numbered = df.withColumn(ROW_ID, row_id)
    return numbered.where(F.col(ROW_ID).between(bounds[0], bounds[-1])).drop(ROW_ID)


REFUND_COLUMNS = ("account_cd", "subscription_guid", "refund_dt", "account_note")


def refund_requests(raw: DataFrame) -> DataFrame:
    """Refund requests: marks and blanks around headers tolerated, NULL is ''."""
    out = raw.toDF(*[c.replace(MARK, "").strip() for c in raw.columns])
    for needed in REFUND_COLUMNS:
        if needed not in out.columns:
            raise ValueError(f"CSV must have column: {needed}")
    return out.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in out.columns])


def read_refund_csv(spark: SparkSession, path: str) -> DataFrame:
    return refund_requests(spark.read.csv(path, header=True, encoding="UTF-8"))


def refunds_from_lines(lines: DataFrame, header: str) -> DataFrame:
    """Refund requests from lines of text (`value`); lines that repeat the header are dropped."""
    raw = next(csv.reader([header]))
    schema = T.StructType([T.StructField(h, T.StringType()) for h in raw])
    parsed = lines.where(F.trim("value") != "").select(F.from_csv("value", schema.toDDL()).alias("row")).select("row.*")
    return refund_requests(without_headers(parsed, raw))


LOG_COLUMNS = (
    "account_cd", "subscription_guid", "subscription_state", "note_added", "billing_cleared",
    "refunded_invoice_numbers", "dry_run", "error",
)


def log_rows(entries: DataFrame) -> DataFrame:
    """Log layout: fixed column order, yes/no for booleans, ';'-joined lists."""
    cols = []
    for name in LOG_COLUMNS:
        kind = dict(entries.dtypes)[name]
        c = F.col(name)
        if kind == "boolean":
            c = F.when(c, "yes").otherwise("no")
        elif kind.startswith("array"):
            c = F.array_join(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""), ";")
        cols.append(c.alias(name))
    return entries.select(*cols)


def write_log(entries: DataFrame, path: str) -> None:
    log_rows(entries).write.mode("overwrite").csv(path, header=True, emptyValue="")


# alert column -> report column (fixed values)
ALERT_COLUMNS = {
    "trans_dt": "dt",
    "trans_hr": "hr",
    "cc_first_6_nbr": "BIN",
    "baseline_avg_ct": "Average Count",
    "baseline_stddev_ct": "Std Deviation",
    "hourly_ct": "Hourly Count",
    "vol_diff": "Diff",
    "vol_z_score": "Z Score",
}


def alert_projection(alerts: DataFrame) -> DataFrame:
    """Readable columns and the geography of the source system."""
    geo = F.lit(fv.GEO_OTHER)
    for source, label in fv.GEO_BY_SOURCE.items():
        geo = F.when(F.col("src_system_id") == source, label).otherwise(geo)
    return alerts.select(
        geo.alias("geo"), *[F.col(c).alias(n) for c, n in ALERT_COLUMNS.items()]
    )


def alert_rows(alerts: DataFrame, max_rows: int, order: Sequence[str] = ()) -> DataFrame:
    """The first ``max_rows`` alerts and, in each, the number of all as `total`.

    Without an order all columns give one, so that the page is always the same.
    """
    shown = alerts.orderBy(*(order or alerts.columns)).limit(max_rows)
    return shown.withColumn("total", alerts.agg(F.count(F.lit(1))).scalar())


def alert_report(
    alerts: DataFrame, max_rows: int = 25, order: Sequence[str] = ()
) -> Mapping[str, object]:
    """First rows, total count and a message in one job; never more than
    ``max_rows`` rows reach the driver."""
    rows = [r.asDict() for r in alert_rows(alerts, max_rows, order).collect()]
    if not rows:
        return {"message": "No anomalies.", "total": 0, "rows": []}
    total = rows[0]["total"]
    rows = [{k: v for k, v in r.items() if k != "total"} for r in rows]
    cut = f" (first {min(max_rows, total)} of {total} rows)" if total > max_rows else ""
    return {"message": f"Rows: {total}{cut}", "total": total, "rows": rows}
