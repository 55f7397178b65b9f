"""Progress of a run as events: weighted stages, a percentage that never falls, at most ten events a second."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

# Stages with labels and weights, for raw logs and for datasets.
RAW = (("read", "Reading flight files", 12), ("match", "Matching detections to telemetry", 8), ("georeference", "Georeferencing detections", 15), ("cluster", "Clustering sightings", 10), ("align", "Aligning overlapping frames", 45), ("report", "Building map report", 10))
DATASET = (("read", "Reading dataset", 10), ("georeference", "Georeferencing detections", 20), ("cluster", "Clustering sightings", 10), ("align", "Aligning overlapping frames", 50), ("report", "Building map report", 10))


def print_event(event: dict) -> None:
    print(json.dumps(event), flush=True)


class Progress:
    def __init__(self, stages, sink: Callable[[dict], None] | None = None, interval_s: float = 0.1, clock: Callable[[], float] = time.monotonic):
        total = sum(w for *_, w in stages)
        self.stages, self.sink, self.interval, self.clock = stages, sink, interval_s, clock
        self.spans, at = {}, 0.0
        for i, (name, _, weight) in enumerate(stages):
            self.spans[name] = (i, at, weight / total)
            at += weight / total
        self.percent, self.counts, self.last, self.began = 0.0, {}, None, clock()

    @property
    def labels(self) -> list[str]:
        return [label for _, label, _ in self.stages]

    def __call__(self, stage: str, share: float, message: str | None = None, **counts) -> None:
        """A stage's share done, 0 to 1; the ends of a stage are always told."""
        if stage not in self.spans:
            return
        self.counts |= {k: v for k, v in counts.items() if v is not None}
        index, start, width = self.spans[stage]
        share = min(max(share, 0.0), 1.0)
        now = self.clock()
        if self.sink is None or (0 < share < 1 and self.last is not None and now - self.last < self.interval):
            return
        self.last, self.percent = now, max(self.percent, 100 * (start + width * share))
        self.sink({"event": "progress", "stage": stage, "stage_label": self.labels[index], "stage_index": index, "stage_count": len(self.stages), "stages": self.labels, "stage_percent": round(100 * share, 1), "percent": round(self.percent, 1),
                   "message": message or self.labels[index], "counts": dict(self.counts), "elapsed_s": round(now - self.began, 3)})

    def done(self, message: str, **more) -> None:
        if self.sink:
            self.sink({"event": "done", "percent": 100, "stages": self.labels, "counts": dict(self.counts), "message": message, "elapsed_s": round(self.clock() - self.began, 3)} | more)
