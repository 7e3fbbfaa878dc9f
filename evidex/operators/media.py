"""Media evidence that needs no codec: 16-bit WAV sound and RGB arrays, in Arrow batches; summaries stay native."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME, HOP = 2048, 512


def sound_frames(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rate, and level (dB), zero-crossing rate, spectral centroid (Hz) and pitch (Hz, 0: none) of each frame of a WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width != 2:
        raise ValueError("16-bit samples only")
    y = np.frombuffer(raw, "<i2").astype(np.float64).reshape(-1, channels).mean(1) / 32768
    if len(y) < FRAME:
        y = np.pad(y, (0, FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    level = 20 * np.log10(np.maximum(np.sqrt((frames**2).mean(1)), 1e-5))
    crossings = (np.diff(np.signbit(frames), axis=1) != 0).mean(1)
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1))
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    centroid = (spectrum * bins).sum(1) / np.maximum(spectrum.sum(1), 1e-12)
    power = np.fft.irfft(np.abs(np.fft.rfft(frames, 2 * FRAME, axis=1)) ** 2, axis=1)[:, :FRAME]
    low, high = max(2, rate // 1000), min(FRAME - 1, rate // 65)
    lag = power[:, low:high].argmax(1) + low
    sure = power[np.arange(len(lag)), lag] > 0.3 * np.maximum(power[:, 0], 1e-12)
    return rate, level, crossings, centroid, np.where(sure & (level > -60), rate / lag, 0.0)


def acoustic_frames(files: DataFrame, key: str = "path") -> DataFrame:
    """key, frame, at (s), level, zero_crossings, centroid, pitch (null: none): a row a frame, so that summaries are ordinary aggregates."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    rate, level, zc, centroid, pitch = sound_frames(bytes(data))
                except (wave.Error, EOFError, ValueError):
                    continue
                n = np.arange(len(level))
                yield pd.DataFrame({key: path, "frame": n.astype("int32"), "at": n * HOP / rate, "level": level, "zero_crossings": zc, "centroid": centroid, "pitch": np.where(pitch > 0, pitch, np.nan)})

    return files.select(key, "content").mapInPandas(read, f"{key} string, frame int, at double, level double, zero_crossings double, centroid double, pitch double")


def acoustic_summary(frames: DataFrame, key: str = "path", quiet: float = -35.0) -> DataFrame:
    """Levels, brightness, pitch and the share of quiet frames of each file; pitch is null where none was found."""
    p = F.nanvl("pitch", F.lit(None).cast("double"))
    loudest = frames.groupBy(key).agg(F.max("level").alias("peak"))
    q = lambda c, x: F.percentile(c, F.lit(x))
    return frames.join(loudest, key).groupBy(key).agg(F.avg("level").alias("level_mean"), F.stddev_pop("level").alias("level_std"), q("level", 0.1).alias("level_p10"), q("level", 0.9).alias("level_p90"), F.avg("centroid").alias("centroid_mean"), F.avg("zero_crossings").alias("zero_crossings_mean"), q(p, 0.5).alias("pitch_median"), q(p, 0.1).alias("pitch_p10"), q(p, 0.9).alias("pitch_p90"), F.avg(F.when(F.col("level") < F.col("peak") + quiet, 1.0).otherwise(0.0)).alias("quiet_share"))


def image_metrics_of(rgb: np.ndarray) -> dict[str, float]:
    """Light, colour, edges, sharpness, balance of an RGB array (height, width, 3) of 0 to 255."""
    x = rgb.astype(np.float64)
    gray = x @ np.array([0.299, 0.587, 0.114])
    top, low = x.max(2), x.min(2)
    dy, dx = np.gradient(gray) if min(gray.shape) > 1 else (np.zeros_like(gray), np.zeros_like(gray))
    edge = np.hypot(dx, dy)
    lap = np.gradient(dx, axis=1) + np.gradient(dy, axis=0) if min(gray.shape) > 1 else np.zeros_like(gray)
    weight = edge + 1e-9
    h, w = gray.shape
    return {
        "brightness": gray.mean() / 255, "brightness_p10": np.quantile(gray, 0.1) / 255, "brightness_p90": np.quantile(gray, 0.9) / 255, "contrast": gray.std() / 255,
        "saturation": ((top - low) / np.maximum(top, 1)).mean(), "warm_balance": (x[..., 0] - x[..., 2]).mean() / 255, "edge_density": (edge > 24).mean(), "sharpness": lap.var(),
        "centroid_x": (weight.sum(0) * np.arange(w)).sum() / weight.sum() / max(1, w - 1), "centroid_y": (weight.sum(1) * np.arange(h)).sum() / weight.sum() / max(1, h - 1),
        "symmetry": 1 - np.abs(gray - gray[:, ::-1]).mean() / 255, "neutral_share": ((top - low) < 18).mean(),
    }


IMAGE_METRICS = list(image_metrics_of(np.zeros((2, 2, 3), np.uint8)))


def palette_of(rgb: np.ndarray, colours: int = 6) -> list[tuple[str, float]]:
    """Up to six colours and their shares, by splitting the widest box of pixels at its median."""
    boxes = [rgb.reshape(-1, 3)]
    while len(boxes) < colours:
        wide = max(range(len(boxes)), key=lambda i: int(np.ptp(boxes[i], axis=0).max()) if len(boxes[i]) > 1 else -1)
        box = boxes[wide]
        if len(box) < 2 or not np.ptp(box, axis=0).max():
            break
        axis = int(np.ptp(box, axis=0).argmax())
        box = box[np.argsort(box[:, axis], kind="stable")]
        cut = int(np.searchsorted(box[:, axis], np.median(box[:, axis]), "right"))
        cut = len(box) // 2 if cut in (0, len(box)) else cut
        boxes[wide : wide + 1] = [box[:cut], box[cut:]]
    total = sum(map(len, boxes))
    return sorted((("#%02x%02x%02x" % tuple(int(v) for v in b.mean(0).round()), len(b) / total) for b in boxes if len(b)), key=lambda p: (-p[1], p[0]))


def image_metrics(images: DataFrame, key: str = "id") -> DataFrame:
    """key, the metrics, palette and a difference hash of rows (key, width, height, pixels: RGB bytes by row)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, w, h, data in batch.itertuples(index=False, name=None):
                rgb = np.frombuffer(bytes(data), np.uint8)[: w * h * 3].reshape(h, w, 3)
                gray = rgb.mean(2)
                cells = gray[np.linspace(0, h - 1, 8).astype(int)][:, np.linspace(0, w - 1, 9).astype(int)]
                bits = (cells[:, 1:] > cells[:, :-1]).ravel()
                dhash = int(np.packbits(bits).view(">i8")[0])
                rows.append((i, *map(float, image_metrics_of(rgb).values()), [{"colour": c, "share": s} for c, s in palette_of(rgb)], dhash))
            yield pd.DataFrame(rows, columns=[key, *IMAGE_METRICS, "palette", "dhash"])

    kind = images.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{m} double" for m in IMAGE_METRICS) + ", palette array<struct<colour:string,share:double>>, dhash bigint"
    return images.select(key, "width", "height", "pixels").mapInPandas(measure, schema)


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").when(width < height, "portrait").otherwise("square")


def polygon_area(points: Column) -> Column:
    """Area of a polygon given as an array of (x, y)."""
    n = F.size(points)
    cross = F.transform(points, lambda p, i: p["x"] * F.element_at(points, (i + 1) % n + 1)["y"] - F.element_at(points, (i + 1) % n + 1)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def shift_of(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Global shift from one gray frame to the next by phase correlation, as shares of width and height; positive x: the content moved left."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    peak = np.unravel_index(int(np.abs(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-9))).argmax()), a.shape)
    dy, dx = (p - s if p > s // 2 else p for p, s in zip(peak, a.shape, strict=True))
    return dx / a.shape[1], dy / a.shape[0]


def infer_kind(reference: Column, candidate: Column) -> Column:
    """The kind both paths' endings belong to: image, video or text; null if there is none."""
    from evidex.sources.files import KINDS

    texts = [*KINDS["document"][:4], *KINDS["document"][4:6], ".csv", ".json", ".yaml", ".yml"]
    ending = lambda p: F.regexp_extract(F.lower(p), r"(\.[^./]+)$", 1)
    both = lambda kinds: ending(reference).isin(kinds) & ending(candidate).isin(kinds)
    return F.when(both(KINDS["image"]), "image").when(both(KINDS["video"]), "video").when(both(texts), "text")


#: Measures whose distribution a collection of images is described by.
COLLECTION_METRICS = ["brightness", "contrast", "saturation", "warm_balance", "edge_density", "sharpness", "symmetry", "neutral_share"]


def image_collection(images: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts by orientation (of width and height), and the distribution of each measure over the images."""
    from evidex.operators.corpus import distributions

    return images.groupBy(orientation(F.col("width"), F.col("height")).alias("orientation")).agg(F.count("*").alias("images")), distributions(images, names or COLLECTION_METRICS)


# How much each likeness of two images weighs.
IMAGE_WEIGHTS = {
    "faithful": {"aspect_ratio": 1.0, "color_distribution": 1.5, "brightness": 1.0, "contrast": 1.0, "saturation": 1.0, "edge_density": 1.0, "spatial_layout": 2.0, "perceptual_hash": 2.0},
    "style": {"aspect_ratio": 0.8, "color_distribution": 2.0, "brightness": 1.2, "contrast": 1.2, "saturation": 1.2, "edge_density": 1.2, "spatial_layout": 0.7, "perceptual_hash": 0.0},
}


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; null where one is constant."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))
    whole = lambda x: total(F.transform(x, lambda v: v.cast("double")))
    cross = lambda x, y: product(x, y) - whole(x) * whole(y) / n
    spread = cross(a, a) * cross(b, b)
    return F.when(spread > 0, cross(a, b) / F.sqrt(spread))


def compare_images(pairs: DataFrame, features: DataFrame, mode: str = "style") -> DataFrame:
    """A row of likenesses (per cent) and their weighted score for each pair (reference, candidate).

    features: id, aspect, brightness, contrast, saturation, edge_density, histogram and layout (arrays), dhash.
    """
    from evidex.functions import text as T
    from evidex.operators.compare import weighted_score

    left, right = (features.select(F.col("id").alias(side), F.struct("*").alias(name)) for side, name in (("reference", "a"), ("candidate", "b")))
    both = pairs.join(left, "reference").join(right, "candidate")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    like = lambda c: unit(F.coalesce((correlation(a(c), b(c)) + 1) / 2, F.lit(0.0)))
    measures = {
        "aspect_ratio": T.closeness(a("aspect"), b("aspect")),
        "color_distribution": like("histogram"),
        **{m: T.bounded_similarity(a(m), b(m)) for m in ("brightness", "contrast", "saturation")},
        "edge_density": T.closeness(a("edge_density"), b("edge_density")),
        "spatial_layout": like("layout"),
        "perceptual_hash": 1 - F.bit_count(a("dhash").bitwiseXOR(b("dhash"))) / 64,
    }
    return both.select("reference", "candidate", weighted_score(measures, IMAGE_WEIGHTS[mode]).alias("form_proxy_score"), *[F.round(c * 100, 2).alias(m) for m, c in measures.items()])


def motion_pairs(frames: DataFrame, group: str, order: str) -> DataFrame:
    """group, start, end, dx, dy (shares of width and height a second) of successive gray frames (group, order, width, height, pixels); frames of two sizes are no pair."""

    def moved(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(order)
        out, last = [], None
        for g, at, w, h, data in table[[group, order, "width", "height", "pixels"]].itertuples(index=False, name=None):
            now = (at, np.frombuffer(bytes(data), np.uint8).reshape(h, w).astype(np.float64))
            if last is not None and last[1].shape == now[1].shape and at > last[0]:
                dx, dy = shift_of(last[1], now[1])
                out.append((g, last[0], at, dx / (at - last[0]), dy / (at - last[0])))
            last = now
        return pd.DataFrame(out, columns=[group, "start", "end", "dx", "dy"])

    kind = frames.schema[group].dataType.simpleString()
    return frames.groupBy(group).applyInPandas(moved, f"{group} {kind}, start double, end double, dx double, dy double")
