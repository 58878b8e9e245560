"""Page geometry: staff lines, staves, systems, crop boxes, normalised lines. Dense arithmetic, one page a task row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the detector: ink below, least run in page widths, gaps' tolerance, ink of a connecting column.
INK, MIN_RUN, TOLERANCE, CONNECTED = 0.6, 0.10, 0.45, 0.8
#: Fixed values of the normalised line: spacing, height, first staff line.
SPACING, HEIGHT = 10.0, 128

BOXES = "page long, staff int, system int, voice int, x int, y int, w int, h int, line_spacing double, pad_up int, pad_down int"


def longest_runs(ink: np.ndarray) -> np.ndarray:
    """Longest run of ink in each row, from the places where runs begin and end."""
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    out = np.zeros(len(ink), np.int64)
    np.maximum.at(out, row, end - start)
    return out


def line_runs(ink: np.ndarray) -> np.ndarray:
    """First and last row of each group of neighbouring rows with a long run."""
    need = MIN_RUN * ink.shape[1]
    long = np.zeros(len(ink), bool)
    some = ink.sum(axis=1) >= need  # no run is longer than its row's ink
    long[some] = longest_runs(ink[some]) >= need
    edge = np.diff(np.pad(long.astype(np.int8), 1))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def group_staves(runs: np.ndarray) -> list[dict]:
    """Staves of five runs at even distances by their middles, tops or bottoms; one run between them may be left out."""
    runs = np.asarray(runs, float).reshape(-1, 2)
    readings = [runs.mean(axis=1), runs[:, 0], runs[:, 1]]

    def gaps(five: list[int]) -> list[np.ndarray]:
        return [np.diff(r[five]) for r in readings]

    def even(five: list[int]) -> bool:
        return any(g.min() > 0 and np.ptp(g) <= TOLERANCE * g.mean() for g in gaps(five))

    out, i, n = [], 0, len(runs)
    while n - i >= 5:
        tries = [list(range(i, i + 5))]
        if n - i >= 6:
            tries += [[j for j in range(i, i + 6) if j != i + left_out] for left_out in range(6)]
        five = next((t for t in tries if even(t)), None)
        if five is None:
            i += 1
            continue
        best = min(gaps(five), key=np.ptp)  # the first of equally even readings
        out.append({"top": int(runs[five[0], 0]), "bottom": int(runs[five[-1], 1]), "line_spacing": float(best.mean()), "line_centers": readings[0][five].tolist()})
        i = five[-1] + 1
    return out


def group_systems(ink: np.ndarray, staves: list[dict]) -> list[list[int]]:
    """Neighbouring staves that a column of ink connects."""
    out: list[list[int]] = []
    for k, staff in enumerate(staves):
        between = ink[staves[k - 1]["bottom"] + 1 : staff["top"]] if k else ink[:0]
        if len(between) > 1 and (between.mean(axis=0) >= CONNECTED).any():
            out[-1].append(k)
        else:
            out.append([k])
    return out


def clear_rows(inked: np.ndarray, spacing: float, limit: float | None) -> int:
    """How many rows beside a staff belong to it; ``inked`` tells of the rows from the staff outwards whether they hold ink.

    At least 2 and at most 3 spacings, the latter bounded by ``limit`` and by the page: up to the first gap of 0.8
    spacings that begins there.
    """
    least, most, gap = (int(round(x * spacing)) for x in (2.0, 3.0, 0.8))
    most = max(least, most if limit is None else min(most, int(limit)))
    empty = np.concatenate([[0], np.cumsum(~inked[least:most])])
    gap = max(1, gap)
    begins = np.flatnonzero(empty[gap:] - empty[:-gap] == gap) if len(empty) > gap else empty[:0]
    return least + int(begins[0]) if len(begins) else max(least, min(most, len(inked)))


def page_boxes(gray: np.ndarray) -> list[dict]:
    """Crop boxes of all staves of a gray page."""
    ink = gray < INK
    staves = group_staves(line_runs(ink))
    if not staves:
        return []
    systems = group_systems(ink, staves)
    system = np.repeat(np.arange(len(systems)), [len(x) for x in systems])
    tops, bottoms = (np.array([s[k] for s in staves]) for k in ("top", "bottom"))
    # Half the gap to the next staff bounds what is added, where that one is of the same system.
    halves = np.where(system[1:] == system[:-1], (tops[1:] - bottoms[:-1]) / 2, np.nan)
    first, out = np.searchsorted(system, np.arange(len(systems))), []
    for k, s in enumerate(staves):
        members = np.flatnonzero(system == system[k])
        columns = np.flatnonzero(ink[tops[members[0]] : bottoms[members[-1]] + 1].any(axis=0))
        left, right = (int(columns[0]), int(columns[-1]) + 1) if len(columns) else (0, ink.shape[1])
        inked = ink[:, left:right].any(axis=1)
        sides = ((inked[: tops[k]][::-1], halves[k - 1] if k else np.nan), (inked[bottoms[k] + 1 :], halves[k] if k + 1 < len(staves) else np.nan))
        up, down = (clear_rows(rows, s["line_spacing"], None if np.isnan(half) else float(half)) for rows, half in sides)
        y, end = max(0, s["top"] - up), min(len(ink), s["bottom"] + down)
        out.append({"staff": k, "system": int(system[k]), "voice": int(k - first[system[k]]), "x": left, "y": y, "w": right - left, "h": end - y, "line_spacing": s["line_spacing"], "pad_up": up, "pad_down": down})
    return out


def page_stats(gray: np.ndarray) -> tuple[float, float]:
    """Share of white pixels, and the mean longest run of the 20 inkiest rows (of 30 % ink or more) in page widths."""
    ink = gray < INK
    amount = ink.sum(axis=1)
    rows = np.flatnonzero(amount >= 0.30 * ink.shape[1])
    rows = rows[np.argsort(-amount[rows], kind="stable")][:20]
    run = float(longest_runs(ink[rows]).mean()) / ink.shape[1] if len(rows) else 0.0
    return float((gray >= 0.99).mean()), run


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with half-pixel centres, edges repeated."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m, dtype=np.float32) + np.float32(0.5)) * np.float32(n / m) - np.float32(0.5), 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    rows = image[y0] * (1 - fy)[:, None] + image[y1] * fy[:, None]
    return (rows[:, x0] * (1 - fx) + rows[:, x1] * fx).astype(np.float32)


def normalise(crop: np.ndarray, spacing: float, top: float | None = None) -> np.ndarray:
    """A crop scaled to the fixed spacing on a white band of the fixed height.

    ``top`` is the staff's distance from the crop's upper edge: with it the staff stands at a fixed height, without it
    the crop is centred.
    """
    scale = SPACING / spacing
    small = resize(crop, max(1, round(crop.shape[0] * scale)), max(1, round(crop.shape[1] * scale)))
    out = np.ones((HEIGHT, small.shape[1]), np.float32)
    shift = (HEIGHT - len(small)) // 2 if top is None else round((HEIGHT - 4 * SPACING) / 2 - top * scale)
    a, b = max(0, shift), min(HEIGHT, shift + len(small))
    if a < b:
        out[a:b] = small[a - shift : b - shift]
    return out


def _gray(row) -> np.ndarray:
    return (np.frombuffer(row.gray, np.uint8).astype(np.float32) / np.float32(255)).reshape(row.height, row.width)


def detect_pages(pages: DataFrame) -> DataFrame:
    """Boxes of all staves of pages ``page, height, width, gray`` (bytes, row by row). No shuffle: a page is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BOXES.split(", ")]
        for batch in batches:
            yield pd.DataFrame([{"page": r.page, **box} for r in batch.itertuples() for box in page_boxes(_gray(r))], columns=names)

    return pages.select("page", "height", "width", "gray").mapInPandas(run, BOXES)


def stats_pages(pages: DataFrame) -> DataFrame:
    """``page, white_frac, run_frac``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(r.page, *page_stats(_gray(r))) for r in batch.itertuples()], columns=["page", "white_frac", "run_frac"])

    return pages.select("page", "height", "width", "gray").mapInPandas(run, "page long, white_frac double, run_frac double")


def crop_lines(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Normalised lines as bytes: ``page, staff, width, pixels``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                line = normalise(_gray(r)[r.y : r.y + r.h, r.x : r.x + r.w], r.line_spacing, float(r.pad_up))
                out.append((r.page, r.staff, line.shape[1], (np.clip(line, 0, 1) * 255 + 0.5).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["page", "staff", "width", "pixels"])

    return boxes.join(pages.select("page", "height", "width", "gray"), "page").mapInPandas(run, "page long, staff int, width int, pixels binary")
