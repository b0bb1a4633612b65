"""Bar files: daily CSV of two layouts, own CSV and Parquet, zipped minute archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
#: The twelve unnamed columns of a minute archive.
MINUTE_COLUMNS = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_base double, taker_quote double, ignore double"


class BarFileError(ValueError):
    """A file that holds no bars of one series."""


class BlockedDownload(BarFileError):
    """A page where data was asked for."""


def payload_kind(raw: bytes) -> str:
    """What a download is: 'csv', 'empty', 'html', 'limit' (a refusal in words) or 'text'."""
    head = raw.lstrip()[:2000].lower()
    if not head:
        return "empty"
    if head.startswith((b"<!doctype", b"<html", b"<script", b"<head")):
        return "html"
    if b"limit" in head and b"," not in head.split(b"\n")[0]:
        return "limit"
    return "csv" if b"," in head.split(b"\n")[0] else "text"


def plain_name(header: str) -> str:
    name = header.strip().strip("<>").strip().lower()
    return {"vol": "volume"}.get(name, name)


def daily_csv(spark: SparkSession, path: str, asset: str | None = None) -> DataFrame:
    """(asset, ts, open, high, low, close, volume) of a per-symbol or bulk daily CSV, in order of time.

    Dates are yyyyMMdd if all of a file's are, else ISO.  A ticker column must
    hold a single ticker.
    """
    raw = spark.read.csv(path, header=True)
    rows = raw.toDF(*[plain_name(c) for c in raw.columns])
    lacking = [c for c in ["date", *PRICES] if c not in rows.columns]
    if lacking:
        raise BarFileError(f"columns missing: {', '.join(lacking)}")
    facts = rows.agg(F.count("*").alias("n"), F.bool_and(F.trim("date").rlike("^[0-9]{8}$")).alias("compact"), (F.count_distinct(F.upper(F.trim("ticker"))) if "ticker" in rows.columns else F.lit(1)).alias("tickers"), (F.max(F.upper(F.trim("ticker"))) if "ticker" in rows.columns else F.lit(None)).alias("ticker")).first()
    if not facts["n"]:
        raise BarFileError("no rows")
    if facts["tickers"] > 1:
        raise BarFileError("more than one ticker")
    ts = F.to_timestamp(F.trim("date"), "yyyyMMdd") if facts["compact"] else F.to_timestamp(F.to_date(F.trim("date")))
    number = lambda c: F.col(c).cast("double").alias(c)
    volume = number("volume") if "volume" in rows.columns else F.lit(None).cast("double").alias("volume")
    return rows.select(F.lit(asset or facts["ticker"] or "").alias("asset"), ts.alias("ts"), *[number(c) for c in PRICES], volume).orderBy("ts")


def ingest(spark: SparkSession, path: str, cache: str, asset: str, expect_ticker: str | None = None) -> dict:
    """Parses a file once into ``cache`` (Parquet by asset) and returns asset, rows and the sha256 of the raw bytes."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
    rows = daily_csv(spark, path)
    found = rows.select("asset").first()["asset"]
    if expect_ticker and found and found != expect_ticker.upper():
        raise BarFileError(f"ticker {found} where {expect_ticker} was expected")
    rows = rows.withColumn("asset", F.lit(asset))
    rows.withColumn("raw_sha256", F.lit(digest)).write.mode("overwrite").parquet(f"{cache}/{asset}")
    return {"asset": asset, "rows": rows.count(), "raw_sha256": digest}


def cached(spark: SparkSession, cache: str, asset: str) -> DataFrame:
    return spark.read.parquet(f"{cache}/{asset}")


def own_csv(spark: SparkSession, path: str, asset: str, timestamp: str = "timestamp", zone: str | None = None) -> DataFrame:
    """A CSV of any case of column names; local times of ``zone`` become UTC."""
    raw = spark.read.csv(path, header=True)
    rows = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if timestamp.lower() not in rows.columns or "close" not in rows.columns:
        raise BarFileError("a time and a close column are needed")
    ts = F.to_timestamp(timestamp.lower())
    have = [c for c in [*PRICES, "volume"] if c in rows.columns]
    return rows.select(F.lit(asset).alias("asset"), (F.to_utc_timestamp(ts, zone) if zone else ts).alias("ts"), *[F.col(c).cast("double").alias(c) for c in have]).orderBy("ts")


def own_parquet(spark: SparkSession, path: str, asset: str) -> DataFrame:
    rows = spark.read.parquet(path)
    if not {"ts", "close"} <= set(rows.columns):
        raise BarFileError("columns ts and close are needed")
    return rows.withColumn("asset", F.lit(asset))


def epoch(t: str = "open_time"):
    """Milliseconds or microseconds since 1970, told apart row by row."""
    return F.when(F.col(t) > F.lit(10**14), F.timestamp_micros(t)).otherwise(F.timestamp_millis(t))


def minutes(rows: DataFrame, asset: str) -> DataFrame:
    """Minute bars of archive rows: one for each minute, the first by file order."""
    timed = rows.withColumn("ts", epoch()).withColumn("__o", F.monotonically_increasing_id())
    w = Window.partitionBy("ts").orderBy("__o")
    return timed.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(F.lit(asset).alias("asset"), "ts", *PRICES, "volume")


def minute_csv(spark: SparkSession, path: str, asset: str) -> DataFrame:
    return minutes(spark.read.csv(path, schema=MINUTE_COLUMNS), asset)


def minute_zip(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Minute bars of zip archives that hold one CSV each."""
    names = [c.split()[0] for c in MINUTE_COLUMNS.split(", ")]

    def unzip(parts):
        for pdf in parts:
            for raw in pdf.content:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    if len(z.namelist()) != 1:
                        raise BarFileError("an archive holds one file")
                    text = z.read(z.namelist()[0])
                if not text.strip():
                    raise BarFileError("an archive's file is empty")
                yield pd.read_csv(io.BytesIO(text), header=None, names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return minutes(files.mapInPandas(unzip, MINUTE_COLUMNS), asset)
