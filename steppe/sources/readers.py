"""Sources: declared schemas, verified reads, incremental loads."""

from __future__ import annotations

import hashlib
import json
import random
import ssl
import subprocess
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steppe.config import month_index
from steppe.sources import versions
from steppe.storage import replace_text

GRID = "cell_id long, lon double, lat double, i double, j double, crop_frac double, in_basin boolean, in_lobe boolean"
PRECIPITATION = "cell_id long, date date, month int, precip_mm double, n_pentads int, n_obs int"

#: HTTP codes, and phrases in messages of services, that are worth another try.
TRANSIENT_STATUS = frozenset((408, 429, 500, 502, 503, 504))
TRANSIENT_PHRASES = ("timed out", "deadline", "rate limit", "quota", "too many requests", "internal error", "temporarily unavailable", "connection reset", "connection aborted", "remote end closed")


class TruncatedReadError(RuntimeError):
    """Fewer or more rows than the source or the caller counts."""


def read_csv(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """CSV files by a declared schema, with nulls for NaN and the file of each row."""
    df = spark.read.schema(schema).option("header", True).csv(pattern)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            df = df.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    return df.withColumn("source_file", F.input_file_name())


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def schema_fingerprint(columns: list[str]) -> str:
    """First 16 hex digits of SHA-256 of the comma-joined names."""
    return hashlib.sha256(",".join(columns).encode()).hexdigest()[:16]


def require_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    if df.columns != columns:
        raise ValueError(f"columns {df.columns}, expected {columns}")
    return df


def verified(df: DataFrame, expected: int, what: str) -> DataFrame:
    """``df`` if it has as many rows as the caller counts."""
    n = df.count()
    if n != expected:
        raise TruncatedReadError(f"{what}: {n} rows, expected {expected}")
    return df


def fetch_pages(spark: SparkSession, fetch: Callable[[int, int], list], total: int, expected: int, what: str, schema: str, page_size: int = 5000) -> DataFrame:
    """The rows of a paged remote source, one page in each task, checked against its count and the caller's.

    ``fetch(first, size)`` gives a list of tuples; it runs in tasks, with retries,
    and no page passes the driver. The rows are counted once; write them before further use.
    """
    if total != expected:
        raise TruncatedReadError(f"{what}: the source counts {total}, the caller {expected}")
    names = T.StructType.fromDDL(schema).names
    pages = spark.range(0, total, page_size, max(1, -(-total // page_size)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"]:
                first = int(at)
                yield pd.DataFrame(with_retry(lambda: fetch(first, page_size), f"{what} from {first}"), columns=names)  # noqa: B023

    return verified(pages.mapInPandas(run, schema), expected, what)


def is_transient(error: BaseException) -> bool:
    """By type and status, then by what a service says; numbers inside a message mean nothing."""
    status = getattr(error, "status_code", None) or getattr(error, "code", None) or getattr(error, "status", None)
    if status is not None and not isinstance(status, str):
        return status in TRANSIENT_STATUS
    if isinstance(error, (TimeoutError, ConnectionError, ssl.SSLError)):
        return True
    return any(phrase in str(error).lower() for phrase in TRANSIENT_PHRASES)


def with_retry(run: Callable, what: str, tries: int = 5, base: float = 2.0, sleep: Callable[[float], None] = time.sleep, jitter: float = 0.5):
    """Runs again after transport faults, waiting longer each time, and a little by chance so that tasks part."""
    for attempt in range(tries):
        try:
            return run()
        except Exception as error:
            if attempt == tries - 1 or not is_transient(error):
                raise
            wait = base**attempt + random.uniform(0, jitter)
            print(f"{what}: {error}; again in {wait:.1f} s")
            sleep(wait)
    raise AssertionError("unreachable")


def load_years(spark: SparkSession, read: Callable[[int], DataFrame], path: str, years: list[int], columns: list[str]) -> list[int]:
    """Loads the years that are missing or were written with other columns.

    Every year is one commit to a versioned table: its rows and the note of its
    columns become visible together. Returns the years that were loaded.
    """
    own = schema_fingerprint(columns)
    found = versions.snapshot(spark, path)
    done = {int(k) for k, p in found.parts.items() if p.note == own} if found else set()
    loaded = []
    for year in [y for y in years if y not in done]:
        df = require_schema(read(year), columns).withColumn("year", F.lit(year))
        versions.commit(spark, path, {str(year): df}, {str(year): own})
        loaded.append(year)
    return loaded


def read_years(spark: SparkSession, path: str, schema: str, years: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The loaded years of a version, the latest if none is given."""
    return versions.read(spark, path, f"{schema}, year int", version, None if years is None else [str(y) for y in years])


@dataclass(frozen=True)
class Source:
    """A source to probe: places to try in order, its day column, the columns it must have."""

    name: str
    candidates: tuple[str, ...]
    day: str
    columns: tuple[str, ...] = ()
    core: bool = True


def resolve_source(candidates: list[str], probe: Callable[[str], DataFrame], core: bool = True) -> tuple[str | None, str]:
    """The first candidate that can be read, and ok, warn or fail."""
    for name in candidates:
        try:
            probe(name).limit(1).count()
        except Exception as error:
            print(f"{name}: {error}")
        else:
            return name, "ok"
    return None, "fail" if core else "warn"


def coverage(df: DataFrame, day: str, start: date, end: date) -> DataFrame:
    """First and last date and number of rows in a window."""
    inside = F.col(day).between(F.lit(start), F.lit(end))
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_if(inside).alias("n_in_window"))


def coverage_shortfall(last: date, end: date, tolerance: int = 3) -> bool:
    """Whether a record ends more than some months before the period does."""
    return month_index(end) - month_index(last) > tolerance


def probe_sources(sources: list[Source], probe: Callable[[str], DataFrame], start: date, end: date, tolerance: int = 3) -> DataFrame:
    """source, resolved, first, last, n_in_window, missing, short and status: one row for each source.

    The first candidate that can be read stands for its source; one aggregation
    gives its range and what lies in the window. A source that can't be read, lacks
    a column, or has no row in the window fails where it is core and warns
    elsewhere; one that ends more than ``tolerance`` months early warns.
    """
    spark, rows = SparkSession.active(), []
    for source in sources:
        name, status = resolve_source(list(source.candidates), probe, source.core)
        bad = "fail" if source.core else "warn"
        if name is None:
            rows.append((source.name, None, None, None, 0, [], None, status))
            continue
        df = probe(name)
        missing = sorted(set(source.columns) - set(df.columns))
        if source.day not in df.columns:
            rows.append((source.name, name, None, None, 0, sorted({*missing, source.day}), None, bad))
            continue
        found = coverage(df.select(F.col(source.day).cast("date").alias("day")), "day", start, end).first()
        short = None if found["last"] is None else coverage_shortfall(found["last"], end, tolerance)
        status = bad if missing or not found["n_in_window"] else "warn" if short else "ok"
        rows.append((source.name, name, found["first"], found["last"], found["n_in_window"], missing, short, status))
    return spark.createDataFrame(rows, "source string, resolved string, first date, last date, n_in_window long, missing array<string>, short boolean, status string")


def provenance(paths: list[str], root: str = ".") -> dict:
    """Commit, unsaved changes and a digest of the files that made a table."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True).stdout.strip()

    joined = hashlib.sha256()
    for p in sorted(paths):
        with open(p, "rb") as f:
            joined.update(p.encode() + b"\0" + f.read())
    dirty = [line[3:] for line in git("status", "--porcelain").splitlines()]
    return {"git_sha": git("rev-parse", "HEAD"), "producer_digest": joined.hexdigest(), "producers_dirty": sorted(set(dirty) & set(paths))}


def write_json(path: str, value: dict) -> None:
    """A local file that appears with its whole content."""
    replace_text(path, json.dumps(value, indent=2, default=str, sort_keys=True))
