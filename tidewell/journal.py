"""The run history of a runner: an append-only file of JSON lines, folded into what the gates ask for."""

from __future__ import annotations

import json
import threading
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from pathlib import Path

from .functions.masking import clean
from .operators.adaptive import Streak
from .operators.tasks import stem_of


@dataclass
class Run:
    task_id: str
    status: str
    exit_code: int | None
    duration_s: float
    output_tail: str


class History:
    """Runs and streaks.  With a ``path`` every entry is appended to that file, and what the file holds is there again after a restart.

    A line that was cut short by a crash is left out.  Threads may share one history.
    """

    def __init__(self, path: str | Path | None = None):
        self.path, self.runs, self.streaks = Path(path) if path else None, [], {}
        self._latest: dict[str, str] = {}
        self._lock = threading.RLock()
        if self.path and self.path.exists():
            for line in self.path.read_text(encoding="utf-8").splitlines():
                try:
                    self._fold(json.loads(line))
                except json.JSONDecodeError:
                    continue

    def _fold(self, entry: dict) -> None:
        if "run" in entry:
            run = entry["run"] | {"started_at": datetime.fromisoformat(entry["run"]["started_at"])}
            self.runs.append(run)
            if not run["status"].startswith("skipped"):
                self._latest[run["task_id"]] = self._latest[run["stem"]] = run["status"]
        if "streak" in entry:
            self.streaks[entry["task_id"]] = Streak(**entry["streak"])

    def _append(self, entry: dict) -> None:
        with self._lock:
            if self.path:
                self.path.parent.mkdir(parents=True, exist_ok=True)
                with self.path.open("a", encoding="utf-8") as out:
                    out.write(json.dumps(entry) + "\n")
            self._fold(entry)

    def record(self, task: dict, started: datetime, run: Run) -> None:
        with self._lock:
            facts = {"id": len(self.runs) + 1, "stem": stem_of(task["command"]), "command": clean(task["command"]), "started_at": started.isoformat(timespec="seconds")}
            self._append({"run": facts | asdict(run)})

    def keep_streak(self, task_id: str, streak: Streak) -> None:
        self._append({"task_id": task_id, "streak": asdict(streak)})

    def last_status(self, ref: str) -> str | None:
        """Of the last real run whose task id or stem is ``ref``."""
        return self._latest.get(ref)

    def ran_within(self, task_id: str, window: timedelta, now: datetime) -> bool:
        since = (now - window).replace(microsecond=0)
        with self._lock:
            return any(r["task_id"] == task_id and r["started_at"] >= since and not r["status"].startswith("skipped") for r in self.runs)

    def recent(self, limit: int = 20) -> list[dict]:
        with self._lock:
            return self.runs[: -limit - 1 : -1]

    def table(self, spark):
        """The run-history relation."""
        from .schema import RUNS

        return spark.createDataFrame([tuple(r[c] for c in RUNS.names) for r in self.runs], RUNS)
