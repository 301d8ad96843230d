"""Pages of a table in (time, key) order: resumable cursors with a fixed end, tokens, totals and a marker of more."""

from __future__ import annotations

import base64
import datetime as dt
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cursor:
    """Positions are (time, key).  ``upper`` is fixed when a run starts; an incremental run begins after ``lower`` and
    takes rows from ``since`` on again, for those that came late."""

    upper: tuple
    after: tuple | None = None
    lower: tuple | None = None
    since: dt.datetime | None = None

    def token(self) -> str:
        """Text that ``of_token`` reads back."""
        return base64.urlsafe_b64encode(json.dumps(asdict(self), default=lambda x: {"at": x.isoformat()}).encode()).decode()

    @staticmethod
    def of_token(text: str) -> Cursor:
        raw = json.loads(base64.urlsafe_b64decode(text), object_hook=lambda d: dt.datetime.fromisoformat(d["at"]) if d.keys() == {"at"} else d)
        return Cursor(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    total: int  # of the rows that the cursor's range holds beyond ``after``
    more: bool
    cursor: Cursor | None  # where the next page begins; None at the end


def begin(df: DataFrame, ts: str, key: str, watermark: tuple | None = None, overlap: dt.timedelta = dt.timedelta(days=2), now: dt.datetime | None = None) -> Cursor | None:
    """A cursor up to the newest row there is: over everything, or after ``watermark`` with the overlap; None without rows."""
    newest = df.agg(F.max(F.struct(ts, key)).alias("m")).first()["m"]
    if newest is None:
        return None
    return Cursor(tuple(newest), None, watermark, (now or newest[0]) - overlap if watermark else None)


def _beyond(ts: str, key: str, at: tuple) -> Column:
    return F.struct(F.col(ts), F.col(key)) > F.struct(F.lit(at[0]), F.lit(at[1]))


def in_range(df: DataFrame, ts: str, key: str, cursor: Cursor) -> DataFrame:
    """Rows of the cursor's range beyond its position; the bounds on time alone reach the scan."""
    out = df.filter((F.col(ts) <= F.lit(cursor.upper[0])) & ~_beyond(ts, key, cursor.upper))
    if cursor.lower is not None:
        fresh = _beyond(ts, key, cursor.lower)
        out = out.filter(fresh | (F.col(ts) >= F.lit(cursor.since)) if cursor.since is not None else fresh)
    if cursor.after is not None:
        out = out.filter((F.col(ts) >= F.lit(cursor.after[0])) & _beyond(ts, key, cursor.after))
    return out


def page(df: DataFrame, ts: str, key: str, cursor: Cursor, limit: int) -> Page:
    """The next ``limit`` rows, how many the range still holds and whether more follow, from one scan."""
    seen = Observation("page")
    rows = in_range(df, ts, key, cursor).observe(seen, F.count("*").alias("total")).orderBy(ts, key).limit(limit + 1).collect()
    more = len(rows) > limit
    kept = rows[:limit]
    return Page(kept, seen.get["total"], more, replace(cursor, after=(kept[-1][ts], kept[-1][key])) if more else None)


def sorted_by(df: DataFrame, order: list[tuple[str, str]], allowed: set[str], tie: str) -> DataFrame:
    """Order by allowed columns, NULLs last in either direction, then by ``tie``."""
    for name, way in order:
        if name not in allowed or way not in ("asc", "desc"):
            raise ValueError(f"cannot sort by {name} {way}")
    return df.orderBy(*[F.col(n).asc_nulls_last() if way == "asc" else F.col(n).desc_nulls_last() for n, way in order], tie)


def ladder(c: Column, *steps: str) -> Column:
    """The place of a state on a ladder; unknown states come last."""
    out = F.lit(len(steps))
    for i in reversed(range(len(steps))):
        out = F.when(c == steps[i], i).otherwise(out)
    return out


def page_with_total(df: DataFrame, order: list[tuple[str, str]], allowed: set[str], tie: str, limit: int, offset: int = 0) -> DataFrame:
    """A page as a table: each row with the total of the filtered set and whether rows follow the page."""
    total = df.agg(F.count("*").alias("total"))
    rows = sorted_by(df, order, allowed, tie).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("more", F.col("total") > offset + limit)  # the total is one row
