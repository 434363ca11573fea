"""Page images as arrays: what a recognition provider may do before it reads them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

PIXELS = "height int, width int, channels int, pixels binary"


def to_gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image.astype(np.uint8)
    return (image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def prepare(image: np.ndarray) -> np.ndarray:
    """Three 8-bit channels: grey is repeated, transparency dropped."""
    image = image if image.dtype == np.uint8 else np.clip(image * (255 if image.max(initial=0) <= 1 else 1), 0, 255).astype(np.uint8)
    return np.stack([image] * 3, axis=-1) if image.ndim == 2 else image[..., :3]


def otsu(gray: np.ndarray) -> int:
    """The threshold with the largest variance between both classes."""
    count = np.bincount(gray.ravel(), minlength=256).astype(float)
    low = np.cumsum(count)
    total = np.cumsum(count * np.arange(256))
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (total / low - (total[-1] - total) / high) ** 2
    return int(np.nanargmax(np.nan_to_num(between, nan=-1.0)))


def binarize(gray: np.ndarray, method: str = "otsu", window: int = 11, offset: int = 2) -> np.ndarray:
    if method == "otsu":
        return np.where(gray > otsu(gray), 255, 0).astype(np.uint8)
    if method == "adaptive":
        return np.where(gray > _box_mean(gray, window) - offset, 255, 0).astype(np.uint8)
    raise ValueError(f"unknown method {method!r}")


def _windows(gray: np.ndarray, size: int) -> np.ndarray:
    pad = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(gray, pad, mode="edge"), (size, size))


def _box_mean(gray: np.ndarray, size: int) -> np.ndarray:
    return _windows(gray.astype(float), size).mean(axis=(-1, -2))


def remove_noise(gray: np.ndarray) -> np.ndarray:
    """Median of 3 x 3, then a morphological opening."""
    median = np.median(_windows(gray, 3), axis=(-1, -2)).astype(np.uint8)
    return _windows(_windows(median, 3).min(axis=(-1, -2)), 3).max(axis=(-1, -2))


def enhance_contrast(gray: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation by tiles, blended between tile centres."""
    h, w = gray.shape
    ys, xs = np.linspace(0, h, grid + 1).astype(int), np.linspace(0, w, grid + 1).astype(int)
    maps = np.empty((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            tile = gray[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            count = np.bincount(tile.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * tile.size / 256)
            count = np.minimum(count, limit) + np.maximum(count - limit, 0).sum() / 256
            maps[i, j] = np.cumsum(count) * 255 / max(tile.size, 1)
    fy = np.clip((np.arange(h) + 0.5) * grid / h - 0.5, 0, grid - 1)
    fx = np.clip((np.arange(w) + 0.5) * grid / w - 0.5, 0, grid - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[y[:, None], x[None, :], gray]
    return np.clip((1 - ay) * ((1 - ax) * at(y0, x0) + ax * at(y0, x1)) + ay * ((1 - ax) * at(y1, x0) + ax * at(y1, x1)), 0, 255).astype(np.uint8)


def skew_angle(gray: np.ndarray, most: float = 10.0) -> float:
    """Degrees by which rows of ink lean: the rotation with the sharpest row profile."""
    y, x = np.nonzero(gray <= otsu(gray))
    if len(y) == 0:
        return 0.0

    def sharp(angle: float) -> float:
        rows = np.round(y * np.cos(np.radians(angle)) - x * np.sin(np.radians(angle))).astype(int)
        return float((np.diff(np.bincount(rows - rows.min()).astype(float)) ** 2).sum())

    return float(max(np.arange(-most, most + 0.25, 0.25), key=lambda a: (sharp(a), -abs(a))))


def deskew(gray: np.ndarray, most: float = 10.0) -> np.ndarray:
    """Rotate by the skew; below half a degree the image is left alone."""
    angle = skew_angle(gray, most)
    if abs(angle) < 0.5:
        return gray
    h, w = gray.shape
    yy, xx = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    sy, sx = np.round(c * yy + s * xx + (h - 1) / 2).astype(int), np.round(-s * yy + c * xx + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.full_like(gray, 255)
    out[inside] = gray[sy[inside], sx[inside]]
    return out


def remove_borders(gray: np.ndarray, size: int = 10) -> np.ndarray:
    return gray[size:-size, size:-size] if size > 0 and min(gray.shape) > 2 * size else gray


def resize_to_dpi(gray: np.ndarray, dpi: float, target: float = 300.0) -> np.ndarray:
    """Nearest neighbour; an unknown or equal resolution leaves the image alone."""
    if not dpi or dpi == target:
        return gray
    h, w = (max(1, round(n * target / dpi)) for n in gray.shape)
    return gray[np.minimum((np.arange(h) * dpi / target).astype(int), gray.shape[0] - 1)][:, np.minimum((np.arange(w) * dpi / target).astype(int), gray.shape[1] - 1)]


def preprocess(image: np.ndarray) -> np.ndarray:
    """Grey, straight, contrasted, clean, black and white."""
    return binarize(remove_noise(enhance_contrast(deskew(to_gray(image)))))


#: Steps by name, for ``transform_pages``.
STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "gray": to_gray,
    "deskew": lambda x: deskew(to_gray(x)),
    "contrast": lambda x: enhance_contrast(to_gray(x)),
    "noise": lambda x: remove_noise(to_gray(x)),
    "binarize": lambda x: binarize(to_gray(x)),
    "borders": lambda x: remove_borders(to_gray(x)),
    "preprocess": preprocess,
    "prepare": prepare,
}


def transform_pages(pages: DataFrame, steps: list[str], dpi: float | None = None) -> DataFrame:
    """Page images (keys, height, width, channels, pixels as 8-bit rows) after the named steps, in order.

    ``dpi`` is the images' own resolution: where it is given they are first brought to 300.
    Columns besides the image's stay; an image without pixels stays without. One pass over
    Arrow batches, no shuffle; an unknown step fails before any task runs.
    """
    import pyarrow as pa

    unknown = [x for x in steps if x not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}")
    own = ("height", "width", "channels", "pixels")
    keys = [c for c in pages.columns if c not in own]

    def one(height: int, width: int, channels: int, pixels: bytes | None) -> tuple:
        if not pixels:
            return height, width, channels, pixels
        image = np.frombuffer(pixels, dtype=np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))
        if dpi:
            image = resize_to_dpi(to_gray(image), dpi)
        for step in steps:
            image = STEPS[step](image)
        return image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], np.ascontiguousarray(image).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # a few images at a time: pages are large
                part = batch.slice(at, 16)
                rows = [one(*r) for r in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in own))]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), *made], names=[*keys, *own])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema), PIXELS])
    return pages.select(*keys, *own).mapInArrow(run, ddl)
