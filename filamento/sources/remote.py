"""Seams for remote sources: protocols a batch source plugs into, and the daily call quota."""

from __future__ import annotations

import datetime
import json
from pathlib import Path
from typing import Protocol, runtime_checkable


class QuotaExceeded(RuntimeError):
    """The calls of the day are used up."""


class MissingApiKey(RuntimeError):
    """A remote source was used without its key."""


class MarketCapSourceUnavailable(RuntimeError):
    """No market value source is configured; a guess would be silent."""


@runtime_checkable
class FilingSource(Protocol):
    """What a remote filing source offers; the package itself calls no network."""

    def search(self, corp_code: str, begin: str, end: str) -> list[dict]: ...

    def download(self, rcept_no: str) -> bytes: ...


class DailyQuota:
    """Calls per day, counted in a JSON file; raises before the limit would be passed."""

    def __init__(self, path: str | Path, limit: int):
        self.path, self.limit = Path(path), limit

    def _counts(self) -> dict[str, int]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def used(self, day: str | None = None) -> int:
        return self._counts().get(day or datetime.date.today().isoformat(), 0)

    def consume(self, n: int = 1, day: str | None = None) -> int:
        day = day or datetime.date.today().isoformat()
        counts = self._counts()
        if counts.get(day, 0) + n > self.limit:
            raise QuotaExceeded(f"{counts.get(day, 0)} of {self.limit} calls used on {day}")
        counts[day] = counts.get(day, 0) + n
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(counts, sort_keys=True))
        return self.limit - counts[day]
