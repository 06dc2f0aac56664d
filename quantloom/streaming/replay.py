"""Disclosure replay as a stream: one state per company, one output per release day."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("bps", "revenue", "ocfps", "net_profit", "roe", "gross_margin")
OUTPUT = (
    "symbol string, available_date date, bps double, revenue_ttm double, ocfps_ttm double, revenue_yoy double, "
    "net_profit_yoy double, roe_stability double, gross_margin_stability double"
)


def _known(state: dict, field: str) -> list[tuple[pd.Timestamp, float]]:
    """Periods with a value, oldest first."""
    found = [(pd.Timestamp(d), v[field]) for d, v in state.items() if v[field] is not None]
    return sorted(found)


def outcome(state: dict) -> dict:
    """The released figures of one company given the newest revision of every known period."""
    nan = float("nan")
    out = dict.fromkeys(("bps", "revenue_ttm", "ocfps_ttm", "revenue_yoy", "net_profit_yoy", "roe_stability", "gross_margin_stability"), nan)
    for field in FIELDS:
        entries = _known(state, field)
        if not entries:
            continue
        by_date = dict(entries)
        day, value = entries[-1]
        year_ago = by_date.get(day - pd.DateOffset(years=1), nan)
        if field == "bps":
            out["bps"] = value
        if field in ("revenue", "ocfps"):
            full = by_date.get(pd.Timestamp(day.year - 1, 12, 31), nan)
            out[f"{field}_ttm"] = value if day.month == 12 else value + full - year_ago
        if field in ("revenue", "net_profit"):
            out[f"{field}_yoy"] = value / abs(year_ago) - 1 if year_ago else nan
        if field in ("roe", "gross_margin"):
            tail = pd.Series([v for _, v in entries[-8:]])
            out[f"{field}_stability"] = -tail.std(ddof=1) if len(tail) >= 6 else nan
    return out


def replay(disclosures: DataFrame) -> DataFrame:
    """Figures after each release day, whatever order the filings arrive in.

    The state is a company's filings so far with their release days: bounded by its
    reporting periods and revisions. A filing that arrives late changes the figures of
    its release day and later ones, and those days are put out again with a larger
    ``filings``; ``newest`` keeps the last word. A day never sees a later release, and
    an older release never replaces a newer one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches))
        for r in rows.to_dict("records"):
            released = known.setdefault(str(r["available_date"]), {})
            released[str(r["stat_date"])] = {f: None if pd.isna(r[f]) else float(r[f]) for f in FIELDS}
        changed = str(rows["available_date"].min())
        seen: dict = {}
        filings = sum(map(len, known.values()))
        out = []
        for day in sorted(known):
            seen.update(known[day])
            if day >= changed:
                out.append({"symbol": key[0], "available_date": pd.Timestamp(day).date(), **outcome(seen), "filings": filings})
        state.update((json.dumps(known),))
        frame = pd.DataFrame(out)
        yield frame.astype(object).where(frame.notna(), None)

    return disclosures.select("symbol", "stat_date", "available_date", *FIELDS).groupBy("symbol").applyInPandasWithState(
        step, f"{OUTPUT}, filings long", "known string", "append", "NoTimeout"
    )


def newest(out: DataFrame) -> DataFrame:
    """Per company and release day the figures put out last."""
    figures = [c for c in out.columns if c not in ("symbol", "available_date", "filings")]
    last = F.max_by(F.struct(*figures), "filings").alias("last")
    return out.groupBy("symbol", "available_date").agg(last).select("symbol", "available_date", "last.*")
