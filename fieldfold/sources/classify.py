"""What a file is, by its name and first lines: telemetry, detections, a dataset, or none of them."""

from __future__ import annotations

import re

from ..functions.text import Headers
from . import detections as boxes
from . import telemetry as logs

_YOLO = re.compile(r"\s*\d+(\s+-?\d*\.?\d+(e-?\d+)?){4,5}\s*", re.IGNORECASE)


def classify(name: str, head: str) -> str:
    kind, text = name.lower().rpartition(".")[2], head.replace("﻿", "")
    if kind == "srt":
        return "telemetry"
    if kind == "csv":
        h = Headers(text.splitlines()[0].split(",") if text else [])
        place, layout = h.find(logs.LATITUDE) and h.find(logs.LONGITUDE), boxes.layout(h)
        if place:
            return "dataset" if layout and h.find(("image_width",)) and h.find(("fov_deg",)) else "telemetry"
        return "detections" if layout and any(map(h.find, (boxes.FRAME_ID, boxes.FRAME_NUMBER, boxes.TIME_S))) else "unknown"
    if kind == "json":
        if re.search(r'"frames"\s*:', text):
            return "dataset"
        return "detections" if re.search(r'"(annotations|bbox|box|xmin|x1|cx|detections|predictions)"\s*:', text) else "unknown"
    if kind == "txt":
        first = next((x for x in text.splitlines() if x.strip()), "")
        return "detections" if _YOLO.fullmatch(first) else "unknown"
    return "unknown"
