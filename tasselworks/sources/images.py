"""Image decoding, integrity, dimensions, quality, perceptual hashes and tensor transforms.

Decoding is Spark's own ``image`` source (bmp, gif, jpeg, png, tiff, wbmp); what it cannot read, webp among them, is
an unreadable row of width -1. Pixel work is numpy inside mapInPandas, a batch of pictures at a time; the few result
columns leave Python, never the pixels.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CHANNEL_MEAN, CHANNEL_STD

BLUR_BELOW, DARK_BELOW, BRIGHT_ABOVE = 100.0, 40.0, 230.0


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """(path, width, height, n_channels, data). Unreadable files have width -1, or are left out (S-19 to S-22)."""
    df = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", drop_invalid).load(path)
    return df.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def integrity(images: DataFrame) -> DataFrame:
    """readable and corrupt counts in one row (S-22)."""
    return images.agg(F.count_if(F.col("width") >= 0).alias("readable"), F.count_if(F.col("width") < 0).alias("corrupt"))


def dimensions(images: DataFrame) -> DataFrame:
    """width, height, megapixels and aspect of readable pictures (S-20, P-16)."""
    w, h = F.col("width"), F.col("height")
    return images.where(w >= 0).select("path", "width", "height", F.bround(w * h / 1e6, 3).alias("mpx"), F.bround(F.try_divide(w, h), 3).alias("aspect"))


def header_dimensions(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the first bytes of a png, gif, bmp or jpeg, without decoding; None if there are none."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def exif_orientation(content: bytes) -> int:
    """Orientation 1 to 8 of a jpeg's APP1 segment; 1 where there is none."""
    if content[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\x00\x00" and len(body) >= 14:
            tiff = body[6:]
            order = "<" if tiff[:2] == b"II" else ">"
            ifd = struct.unpack(order + "I", tiff[4:8])[0]
            if ifd + 2 <= len(tiff):
                for k in range(struct.unpack(order + "H", tiff[ifd : ifd + 2])[0]):
                    entry = tiff[ifd + 2 + 12 * k : ifd + 14 + 12 * k]
                    if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                        value = struct.unpack(order + "H", entry[8:10])[0]
                        return value if 1 <= value <= 8 else 1
            return 1
        at += 2 + size
    return 1


def file_headers(files: DataFrame) -> DataFrame:
    """(path, width, height, orientation) from files (path, content) by their headers alone; sizes are null where no
    header is understood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [header_dimensions(bytes(c)) or (None, None) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "width": pd.array([w for w, _ in sizes], "Int32"), "height": pd.array([h for _, h in sizes], "Int32"), "orientation": [exif_orientation(bytes(c)) for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, orientation int")


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned by an EXIF orientation."""
    if orientation in (2, 3, 4):
        return {2: pixels[:, ::-1], 3: pixels[::-1, ::-1], 4: pixels[::-1]}[orientation]
    if orientation in (5, 6, 7, 8):
        t = pixels.swapaxes(0, 1)
        return {5: t, 6: t[:, ::-1], 7: t[::-1, ::-1], 8: t[::-1]}[orientation]
    return pixels


def to_rgb(data: bytes, width: int, height: int, n_channels: int) -> np.ndarray:
    """height x width x 3, red first, from the source's blue-first rows; grey is repeated, alpha dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, n_channels)
    return np.repeat(a, 3, axis=2) if n_channels == 1 else a[:, :, 2::-1]


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma as whole numbers."""
    return np.floor(rgb[:, :, 0] * 0.299 + rgb[:, :, 1] * 0.587 + rgb[:, :, 2] * 0.114 + 0.5)


def laplacian_variance(g: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders reflected without their edge."""
    pad = [(1, 1) if n > 1 else (0, 0) for n in g.shape]
    p = np.pad(g, pad, mode="reflect")
    if p.shape[0] < 3:
        p = np.vstack([p] * 3)
    if p.shape[1] < 3:
        p = np.hstack([p] * 3)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with the support widened when shrinking (no aliasing), by two matrix products."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        centre = (np.arange(m) + 0.5) * n / m - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / scale)
        return w / w.sum(1, keepdims=True)

    out = np.tensordot(weights(a.shape[0], height), a.astype(float), (1, 0))
    return np.moveaxis(np.tensordot(weights(a.shape[1], width), out, (1, 1)), 0, 1)


def perceptual_hash(rgb: np.ndarray) -> int:
    """64 bits: 32 x 32 grey, two-dimensional DCT, its 8 x 8 low corner against the corner's median (U-03)."""
    g = resize(gray(rgb), 32, 32)
    n = np.arange(32)
    dct = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 64)
    low = (dct @ g @ dct.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


def quality(images: DataFrame) -> DataFrame:
    """(path, blur_var, brightness, is_blurry, is_dark, is_bright, phash) of readable pictures (S-21, A-34, P-06).

    Flags are decided on the exact values, which are then stored with two digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rgb = to_rgb(r.data, r.width, r.height, r.n_channels)
                g = gray(rgb)
                blur, light = laplacian_variance(g), float(g.mean())
                rows.append((r.path, round(blur, 2), round(light, 2), blur < BLUR_BELOW, light < DARK_BELOW, light > BRIGHT_ABOVE, f"{perceptual_hash(rgb):016x}"))
            yield pd.DataFrame(rows, columns=["path", "blur_var", "brightness", "is_blurry", "is_dark", "is_bright", "phash"])

    return images.where("width > 0 AND height > 0").mapInPandas(run, "path string, blur_var double, brightness double, is_blurry boolean, is_dark boolean, is_bright boolean, phash string")


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big"))


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the centre, bilinear, black outside."""
    h, w = a.shape[:2]
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx
    sy = np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(a.shape, float)
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            weight = (1 - np.abs(sy - yy)) * (1 - np.abs(sx - xx)) * ok
            out += weight[..., None] * a[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
    return out


def jitter(a: np.ndarray, rng: np.random.Generator, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    """Random brightness, contrast and saturation factors around 1."""
    a = np.clip(a * rng.uniform(1 - brightness, 1 + brightness), 0, 255)
    level = gray(a).mean()
    a = np.clip(level + (a - level) * rng.uniform(1 - contrast, 1 + contrast), 0, 255)
    if saturation:
        own = gray(a)[..., None]
        a = np.clip(own + (a - own) * rng.uniform(1 - saturation, 1 + saturation), 0, 255)
    return a


def shift_hue(a: np.ndarray, turn: float) -> np.ndarray:
    """Hue turned by a share of the circle, in the luma-chroma plane."""
    t = 2 * np.pi * turn
    yiq = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]])
    spin = np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
    return np.clip(a @ (np.linalg.inv(yiq) @ spin @ yiq).T, 0, 255)


def blur3(a: np.ndarray, sigma: float) -> np.ndarray:
    """3 x 3 Gaussian, borders reflected."""
    k = np.exp(-np.array([-1, 0, 1]) ** 2 / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (1, 1)
        p = np.pad(a, pad, mode="reflect" if a.shape[axis] > 1 else "edge")
        n = a.shape[axis]
        a = sum(k[d] * np.take(p, np.arange(d, d + n), axis=axis) for d in range(3))
    return a


def normalise(a: np.ndarray) -> np.ndarray:
    """Channels first, (x / 255 - mean) / deviation."""
    return ((a / 255 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)).transpose(2, 0, 1).astype(np.float32)


def transform(rgb: np.ndarray, stage: str, key: str, size: tuple[int, int] = (224, 224), seed: int = 42, epoch: int = 0) -> np.ndarray:
    """Tensor of one picture for a stage: train, minority, or val, test, inference (I-02 to I-05). Random choices come
    from a hash of seed, key and epoch."""
    stage = stage.lower()
    if stage not in ("train", "minority", "val", "test", "inference"):
        raise ValueError(f"unknown stage {stage!r}")
    h, w = size
    if stage in ("val", "test", "inference"):
        return normalise(resize(rgb, h, w))
    rng = _rng(seed, key, epoch)
    a = rgb
    if stage == "minority":
        share, aspect = rng.uniform(0.7, 1.0), np.exp(rng.uniform(np.log(3 / 4), np.log(4 / 3)))
        area = rgb.shape[0] * rgb.shape[1] * share
        ch, cw = (int(np.clip(round(x), 1, n)) for x, n in ((np.sqrt(area / aspect), rgb.shape[0]), (np.sqrt(area * aspect), rgb.shape[1])))
        top, left = rng.integers(0, rgb.shape[0] - ch + 1), rng.integers(0, rgb.shape[1] - cw + 1)
        a = rgb[top : top + ch, left : left + cw]
    a = resize(a, h, w)
    if rng.random() < 0.5:
        a = a[:, ::-1]
    if rng.random() < 0.5:
        a = a[::-1]
    strong = stage == "minority"
    a = rotate(a, rng.uniform(-30, 30) if strong else rng.uniform(-15, 15))
    a = jitter(a, rng, 0.3, 0.3, 0.2) if strong else jitter(a, rng, 0.1, 0.1, 0.0)
    if strong:
        a = blur3(shift_hue(a, rng.uniform(-0.05, 0.05)), rng.uniform(0.1, 1.5))
    return normalise(a)


def tensors(images: DataFrame, stage: str, size: tuple[int, int] = (224, 224), seed: int = 42, epoch: int = 0) -> DataFrame:
    """(path, channels, height, width, tensor array<float>) of readable pictures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.path, 3, size[0], size[1], transform(to_rgb(r.data, r.width, r.height, r.n_channels), stage, r.path, size, seed, epoch).ravel()) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "channels", "height", "width", "tensor"])

    return images.where("width > 0 AND height > 0").mapInPandas(run, "path string, channels int, height int, width int, tensor array<float>")


def upright_rgb(images: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, width, height, rgb binary) of readable pictures, turned by their orientation, three channels (I-01)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.ascontiguousarray(upright(to_rgb(r.data, r.width, r.height, r.n_channels), r.orientation))
                out.append((r.path, a.shape[1], a.shape[0], a.tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "rgb"])

    plain = lambda df: df.withColumn("__p", F.regexp_replace("path", "^file:/+", "/"))
    turned = plain(images.where("width > 0")).join(plain(headers).select("__p", "orientation"), "__p", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1))).drop("__p")
    return turned.mapInPandas(run, "path string, width int, height int, rgb binary")
