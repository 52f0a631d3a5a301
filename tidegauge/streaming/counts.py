"""Line counts of a running query, from the pass it makes anyway."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidegauge.plans.report import Counts

METRIC = "tidegauge_scan"


def observed(parsed: DataFrame) -> DataFrame:
    """Parsed lines of all outcomes, counted on their way."""
    of = lambda s: F.count_if(F.col("parse_status") == s).alias(s)
    return parsed.observe(METRIC, F.count(F.lit(1)).alias("lines"), of("parsed"), of("skipped"), of("malformed"))


class ScanCounter(StreamingQueryListener):
    """Counts of all queries that read ``observed`` lines, and requests dropped as late, by query.

    A trigger that is repeated after a failure replaces what it told before. Add it by ``spark.streams.addListener``.
    A request dropped as late is one for each stateful operator that dropped it.
    """

    def __init__(self) -> None:
        self._told: dict[str, dict[int, tuple[int, ...]]] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        seen = p.get("observedMetrics", {}).get(METRIC)
        late = sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in p.get("stateOperators", []))
        if seen is None and not late:
            return
        row = tuple(int((seen or {}).get(c) or 0) for c in ("lines", "parsed", "skipped", "malformed"))
        with self._lock:
            self._told.setdefault(p["id"], {})[int(p["batchId"])] = (*row, late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def counts(self, query_id: str | None = None) -> tuple[Counts, int]:
        """Lines by outcome, and late rows; of one query or of all."""
        with self._lock:
            rows = [r for q, by in self._told.items() if query_id in (None, q) for r in by.values()]
        sums = [sum(c) for c in zip(*rows)] if rows else [0] * 5
        return Counts(*sums[:4]), sums[4]
