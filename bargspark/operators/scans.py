"""Lines and words of a scan from its pixels alone: a numpy kernel over grey pages, one page per row, nothing shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bargspark.functions.batches import slices

# Margins, gaps and sizes in pixels or shares of the page.
MARGIN, ROW_INK, GAP_ROWS, WORD_GAP = 0.04, 0.003, 1, 0.20
LEAST_HEIGHT, LEAST_WIDTH, THIN, EDGE, NARROW = 3, 10, 50, (0.04, 0.92), 0.15
INK, HEIGHTS = (70, 190), (0.65, 1.5)


def ink_level(grey: np.ndarray) -> int:
    """The grey that separates ink from paper best (the largest variance between the two classes), within 70..190."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    split = below * (below[-1] - below)
    gain = np.divide((mass[-1] * below - mass * below[-1]) ** 2, split, out=np.zeros(256), where=split > 0)
    return int(np.clip(gain.argmax(), *INK))


def spans(on: np.ndarray, gap: int = 0) -> np.ndarray:
    """The half-open runs of true values; runs at most `gap` apart are one. (n, 2)"""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))).reshape(-1, 2)
    if len(edge) < 2:
        return edge
    apart = edge[1:, 0] - edge[:-1, 1] > gap
    return np.column_stack([edge[np.concatenate([[True], apart]), 0], edge[np.concatenate([apart, [True]]), 1]])


def page_lines(grey: np.ndarray, scale: float = 1.5) -> list[dict]:
    """The lines from top to bottom: rect, words from right to left, and weight, the width in units of the line's own height."""
    height, width = grey.shape
    ink = grey < ink_level(grey)
    a, b = int(width * MARGIN), int(width * (1 - MARGIN))
    rows = ink[:, a:b].sum(axis=1) >= max(3, int(width * ROW_INK))
    out = []
    for y0, y1 in spans(rows, GAP_ROWS):
        columns = ink[y0:y1, a:b].any(axis=0)
        x = np.flatnonzero(columns)
        if not len(x):
            continue
        x0, x1, tall = a + x[0], a + x[-1] + 1, y1 - y0
        wide = x1 - x0
        at = (y0 + y1) / 2 / height
        lone = (at < EDGE[0] or at > EDGE[1]) and wide / width < NARROW  # a page number
        if tall < LEAST_HEIGHT or wide < LEAST_WIDTH or wide / tall > THIN or lone:
            continue
        words = spans(columns, max(3, round(tall * WORD_GAP)))[::-1] + a
        out.append({"rect": tuple(float(v) / scale for v in (x0, y0, x1, y1)), "words": [(float(u) / scale, float(y0) / scale, float(v) / scale, float(y1) / scale) for u, v in words]})
    out.sort(key=lambda r: (r["rect"][1], -r["rect"][2]))
    tall = [r["rect"][3] - r["rect"][1] for r in out]
    middle = float(np.median(tall)) or 1.0 if tall else 1.0
    for r, h in zip(out, tall):
        r["weight"] = max(1e-6, (r["rect"][2] - r["rect"][0]) / min(max(h, middle * HEIGHTS[0]), middle * HEIGHTS[1]))
    return out


def scan_lines(images: DataFrame, scale: float = 1.5) -> DataFrame:
    """Of (rec_id, height, width, grey binary): (rec_id, line, x0, y0, x1, y1, weight, words). Null or misshapen pixels have no lines."""
    rect = pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])

    def run(batches):
        for batch in slices(batches, "grey", 32 << 20):
            rows = []
            for r in batch.to_pylist():
                if not r["grey"] or len(r["grey"]) != (r["height"] or 0) * (r["width"] or 0):
                    continue
                page = np.frombuffer(r["grey"], np.uint8).reshape(r["height"], r["width"])
                for i, line in enumerate(page_lines(page, scale)):
                    rows.append((r["rec_id"], i, *line["rect"], line["weight"], [dict(zip(("x0", "y0", "x1", "y1"), w)) for w in line["words"]]))
            columns = list(zip(*rows)) or [[]] * 8
            types = [pa.int64(), pa.int32(), *[pa.float64()] * 5, pa.list_(rect)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["rec_id", "line", "x0", "y0", "x1", "y1", "weight", "words"])

    return images.select("rec_id", "height", "width", "grey").mapInArrow(run, "rec_id bigint, line int, x0 double, y0 double, x1 double, y1 double, weight double, words array<struct<x0: double, y0: double, x1: double, y1: double>>")


def strip_rect(lines: list[dict], low: int, high: int, page: tuple[float, float]) -> tuple:
    """The padded rectangle over lines low..high, within the page: a quarter of the middle height above and below, 2 % of the width at the sides."""
    boxes = [r["rect"] for r in lines[low : high + 1]]
    pad = 0.25 * float(np.median([r["rect"][3] - r["rect"][1] for r in lines]))
    side = 0.02 * page[0]
    return max(0.0, min(b[0] for b in boxes) - side), max(0.0, min(b[1] for b in boxes) - pad), min(page[0], max(b[2] for b in boxes) + side), min(page[1], max(b[3] for b in boxes) + pad)
