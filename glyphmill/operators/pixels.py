"""Pixel statistics.

Set-based forms work on a table of pixels (image_id, x, y, grey) and stay in the JVM. Array kernels work on images as
bytes: one mapInPandas pass computes all kernels of a list, each isolated, so a failing one gives NaN and not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entropy(pixels: DataFrame, keys: list[str], value: str = "grey", scale: float = 8.0) -> DataFrame:
    """Shannon entropy of the values, in bits over `scale`."""
    c = pixels.groupBy(*keys, value).agg(F.count("*").alias("c"))
    # -sum(p log p) = log N - sum(c log c) / N
    return c.groupBy(*keys).agg(((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")) / scale).alias("entropy"))


def cooccurrence(pixels: DataFrame, dx: int, dy: int, levels: int = 64, top: int = 256) -> DataFrame:
    """Symmetric co-occurrence of quantised greys at an offset: contrast and homogeneity per image."""
    q = F.floor(F.col("grey") * levels / top).cast("int")
    a = pixels.select("image_id", "x", "y", q.alias("q"))
    b = a.select("image_id", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("q").alias("r"))
    d = F.col("q") - F.col("r")
    return a.join(b, ["image_id", "x", "y"]).groupBy("image_id").agg(F.avg(d * d).alias("contrast"), F.avg(1 / (1 + d * d)).alias("homogeneity"))


def box_dimension(pixels: DataFrame, on: str, sizes: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Box-counting dimension of the pixels where `on` holds: the slope of log count against log 1 / size."""
    k = F.explode(F.array(*(F.lit(s) for s in sizes))).alias("k")
    boxes = pixels.where(on).select("image_id", "x", "y", k).select("image_id", "k", F.floor(F.col("x") / F.col("k")).alias("bx"), F.floor(F.col("y") / F.col("k")).alias("by")).distinct()
    n = boxes.groupBy("image_id", "k").agg(F.count("*").alias("n"))
    return n.groupBy("image_id").agg(F.regr_slope(F.log("n"), -F.log("k")).alias("dimension"))


def box_slopes(pixels: DataFrame, on: str, sizes: tuple[int, ...], skip: int = 0) -> DataFrame:
    """Mean and deviation of the local slopes of log count against log 1 / size, without the first `skip` (from the smallest boxes)."""
    k = F.explode(F.array(*(F.lit(s) for s in sizes))).alias("k")
    boxes = pixels.where(on).select("image_id", "x", "y", k).select("image_id", "k", F.floor(F.col("x") / F.col("k")).alias("bx"), F.floor(F.col("y") / F.col("k")).alias("by")).distinct()
    n = boxes.groupBy("image_id", "k").agg(F.count("*").alias("n"))
    own = W.partitionBy("image_id").orderBy("k")
    d = n.select("image_id", F.row_number().over(own).alias("i"), ((F.log("n") - F.log(F.lead("n").over(own))) / (F.log(F.lead("k").over(own)) - F.log("k"))).alias("d"))
    return d.where((F.col("i") > skip) & F.col("d").isNotNull()).groupBy("image_id").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"))


def mirror_symmetry(pixels: DataFrame, width: int) -> DataFrame:
    """Correlation of the left half with the mirrored right half, as (c + 1) / 2; mean squared difference of the two."""
    left = pixels.where(F.col("x") < width // 2).select("image_id", "x", "y", F.col("grey").alias("a"))
    right = pixels.select("image_id", (width - 1 - F.col("x")).alias("x"), "y", F.col("grey").alias("b"))
    return left.join(right, ["image_id", "x", "y"]).groupBy("image_id").agg(((F.corr("a", "b") + 1) / 2).alias("symmetry"), F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2))).alias("mse"))


def luminance(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg("grey").alias("mean"), F.stddev_pop("grey").alias("rms"), F.skewness("grey").alias("skewness"), F.kurtosis("grey").alias("kurtosis"))


def tile_density(pixels: DataFrame, on: str, size: int) -> DataFrame:
    """Spread over tiles of the share of pixels where `on` holds."""
    t = pixels.groupBy("image_id", F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")).agg(F.avg(F.expr(f"cast(({on}) as double)")).alias("d"))
    return t.groupBy("image_id").agg(F.stddev_pop("d").alias("clutter"), F.avg("d").alias("density"))


def edge_pixels(pixels: DataFrame, threshold: int) -> DataFrame:
    """Pixels with `edge`: a forward difference to the right or below over the threshold."""
    base = pixels.select("image_id", "x", "y", "grey")
    right = base.select("image_id", (F.col("x") - 1).alias("x"), "y", F.col("grey").alias("r"))
    below = base.select("image_id", "x", (F.col("y") - 1).alias("y"), F.col("grey").alias("b"))
    j = base.join(right, ["image_id", "x", "y"], "left").join(below, ["image_id", "x", "y"], "left")
    step = F.greatest(F.coalesce(F.abs(F.col("r") - F.col("grey")), F.lit(0)), F.coalesce(F.abs(F.col("b") - F.col("grey")), F.lit(0)))
    return j.select("image_id", "x", "y", "grey", (step > threshold).alias("edge"))


# --- array kernels: float image [h, w, 3] in 0..255 -> named values


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5)


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value in 0..1."""
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    d = top - low
    safe = np.where(d > 0, d, 1)
    r, g, b = (rgb[..., i] for i in range(3))
    h = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    return np.where(d > 0, h, 0), np.where(top > 0, d / np.where(top > 0, top, 1), 0), top / 255


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIELAB (D65) of sRGB."""
    c = rgb / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def k_basic(rgb: np.ndarray) -> dict[str, float]:
    g = grey(rgb)
    p = np.bincount(g.astype(int).ravel(), minlength=256) / g.size
    return {"brightness_mean": g.mean() / 255, "brightness_sd": g.std() / 255, "rms_contrast": g.std() / 100, "entropy": float(-(p[p > 0] * np.log2(p[p > 0])).sum())}


def k_colour(rgb: np.ndarray) -> dict[str, float]:
    rg, yb = rgb[..., 0] - rgb[..., 1], (rgb[..., 0] + rgb[..., 1]) / 2 - rgb[..., 2]
    colourful = np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())
    h, s, v = hsv(rgb)
    lab_ = lab(rgb)
    top = rgb.argmax(axis=2)
    hue = np.exp(1j * np.radians(h)).mean()
    out = {"colourfulness": colourful, "saturation_mean": s.mean(), "saturation_sd": s.std(), "value_mean": v.mean(), "hue_mean": float(np.angle(hue)), "hue_sd": float(np.sqrt(-2 * np.log(max(abs(hue), 1e-12)))), "lightness": lab_[..., 0].mean() / 100, "lightness_contrast": min(lab_[..., 0].std() / 50, 1.0), "warmth": float(((lab_[..., 1] > 0) | (lab_[..., 2] > 0)).mean())}
    return out | {f"dominant_{c}": float((top == i).mean()) for i, c in enumerate("rgb")} | {f"lab_{c}_{n}": getattr(lab_[..., i], f)() for i, c in enumerate("lab") for n, f in (("mean", "mean"), ("sd", "std"))}


def k_naturalness(rgb: np.ndarray) -> dict[str, float]:
    h, s, v = hsv(rgb)
    green, blue, earth = (((h >= a) & (h <= b) & (s > t) & (v > 0.15)).mean() for a, b, t in ((70, 170, 0.15), (180, 260, 0.15), (20, 60, 0.2)))
    c = rgb / 255
    return {"green": green, "blue": blue, "earth": earth, "naturalness": 0.55 * green + 0.30 * blue + 0.15 * earth, "green_view": float((2 * c[..., 1] - c[..., 0] - c[..., 2] > 0.08).mean())}


def k_frequency(rgb: np.ndarray) -> dict[str, float]:
    g = grey(rgb)
    power = np.abs(np.fft.fftshift(np.fft.fft2(g - g.mean()))) ** 2
    y, x = (np.arange(n) - n // 2 for n in g.shape)
    r = np.hypot(y[:, None] / max(g.shape[0] / 2, 1), x[None, :] / max(g.shape[1] / 2, 1))
    total = power.sum()
    low, mid, high = (float(power[m].sum() / total) if total else 0.0 for m in (r < 0.33, (r >= 0.33) & (r < 0.66), r >= 0.66))
    return {"power_low": low, "power_mid": mid, "power_high": high, "power_ratio": low / high if high else float("nan"), "mean_power": float(power.mean())}


def k_edges(rgb: np.ndarray) -> dict[str, float]:
    g = np.pad(grey(rgb), 1, mode="edge")
    gx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
    gy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
    m = np.hypot(gx, gy) > 100
    a = np.degrees(np.arctan2(gy, gx)) % 90
    straight = m & ((a < 10) | (a > 80))
    return {"edge_density": m.mean(), "straight_edges": straight.mean(), "other_edges": (m & ~straight).mean()}


def k_symmetry(rgb: np.ndarray) -> dict[str, float]:
    g = grey(rgb)
    w = g.shape[1] // 2
    a, b = g[:, :w], g[:, ::-1][:, :w]
    za, zb = a - a.mean(), b - b.mean()
    n = np.sqrt((za * za).sum() * (zb * zb).sum())
    ma, mb, cov = a.mean(), b.mean(), (za * zb).mean()
    ssim = (2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma**2 + mb**2 + 6.5025) * (a.var() + b.var() + 58.5225))
    return {"symmetry": float(((za * zb).sum() / n + 1) / 2) if n else float("nan"), "mirror_mse": float(((a - b) ** 2).mean()), "mirror_ssim": float(ssim)}


def k_channels(rgb: np.ndarray) -> dict[str, float]:
    """Entropy in bits and edge density of hue, saturation, value and the three of CIELAB, each stretched to 0..255."""
    out = {}
    for name, c in zip(("h", "s", "v", "l", "a", "b"), (*hsv(rgb), *np.moveaxis(lab(rgb), -1, 0)), strict=True):
        g = np.floor((c - c.min()) / max(np.ptp(c), 1e-9) * 255)
        p = np.bincount(g.astype(int).ravel(), minlength=256) / g.size
        e = np.abs(np.diff(g, axis=0))[:, :-1] + np.abs(np.diff(g, axis=1))[:-1]
        out |= {f"{name}_entropy": float(-(p[p > 0] * np.log2(p[p > 0])).sum()), f"{name}_edges": float((e > 50).mean()) if e.size else 0.0}
    return out


def k_patches(rgb: np.ndarray, size: int = 64) -> dict[str, float]:
    """Mean and variance over tiles of the mean power in three bands of frequency; nothing for an image smaller than a tile."""
    g = grey(rgb)
    y, x = np.indices((size, size)) - size // 2
    r = np.hypot(y, x) / np.hypot(size // 2, size // 2)
    bands = {"low": r < 0.33, "mid": (r >= 0.33) & (r < 0.66), "high": r >= 0.66}
    power = [np.abs(np.fft.fftshift(np.fft.fft2(g[a : a + size, b : b + size]))) ** 2 for a in range(0, g.shape[0] - size + 1, size) for b in range(0, g.shape[1] - size + 1, size)]
    return {f"{n}_{k}": float(f([p[m].mean() for p in power])) for n, m in bands.items() for k, f in (("mean", np.mean), ("var", np.var))} if power else {}


def k_texture(rgb: np.ndarray) -> dict[str, float]:
    """Entropy of local binary patterns: which of the eight neighbours are at least as bright."""
    g = np.pad(grey(rgb), 1, mode="edge")
    code = sum((g[1 + dy : g.shape[0] - 1 + dy, 1 + dx : g.shape[1] - 1 + dx] >= g[1:-1, 1:-1]).astype(int) << i for i, (dy, dx) in enumerate(((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))))
    p = np.bincount(code.ravel(), minlength=256) / code.size
    return {"lbp_entropy": float(-(p[p > 0] * np.log2(p[p > 0])).sum()) / 8}


def k_openness(rgb: np.ndarray, n: int = 36) -> dict[str, float]:
    """Mean length of rays from the middle up to an edge, over half the shorter side, at most 1."""
    g = grey(rgb)
    e = np.hypot(np.gradient(g, axis=0) if g.shape[0] > 1 else 0 * g, np.gradient(g, axis=1) if g.shape[1] > 1 else 0 * g) > 50
    h, w = g.shape
    reach = 0
    for i in range(n):
        dx, dy = np.cos(2 * np.pi * i / n), np.sin(2 * np.pi * i / n)
        r = np.arange(1, int(np.hypot(h, w) / 2))
        x, y = np.trunc(w // 2 + dx * r).astype(int), np.trunc(h // 2 + dy * r).astype(int)
        out = (x < 0) | (x >= w) | (y < 0) | (y >= h)
        stop = out | e[y.clip(0, h - 1), x.clip(0, w - 1)]
        reach += int(stop.argmax()) if stop.any() else len(r)
    return {"openness": min(reach / n / (min(h, w) / 2), 1.0)}


def k_window_energy(rgb: np.ndarray) -> dict[str, float]:
    """Mean log power under a Hamming window of the image's middle square, of 256 pixels at most."""
    g = grey(rgb)
    n = min(256, *g.shape)
    a, b = (g.shape[0] - n) // 2, (g.shape[1] - n) // 2
    win = np.outer(np.hamming(n), np.hamming(n))
    power = np.abs(np.fft.fft2((g[a : a + n, b : b + n] - g.mean()) * win)) ** 2
    return {"window_energy": float(np.log1p(power).mean())}


KERNELS: dict[str, Callable[[np.ndarray], dict[str, float]]] = {"basic": k_basic, "colour": k_colour, "naturalness": k_naturalness, "frequency": k_frequency, "edges": k_edges, "symmetry": k_symmetry, "channels": k_channels, "patches": k_patches, "texture": k_texture, "openness": k_openness, "window": k_window_energy}


def extract(images: DataFrame, kernels: list[str] | dict[str, Callable[[np.ndarray], dict[str, float]]] | None = None) -> DataFrame:
    """images: the columns of Spark's image source (bytes in BGR order) and id. Rows (id, key, value, error): one pass, all kernels.

    A kernel that raises gives one row with its error; values that aren't finite are left out.
    """
    chosen = kernels if isinstance(kernels, dict) else {k: KERNELS[k] for k in kernels or KERNELS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., :3][..., ::-1].astype(float) if r.nChannels >= 3 else np.repeat(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 1), 3, axis=2).astype(float)
                for name, f in chosen.items():
                    try:
                        out += [(r.id, f"{name}.{k}", float(v), None) for k, v in f(img).items() if np.isfinite(v)]
                    except Exception as e:  # noqa: BLE001  isolated: told in the row
                        out.append((r.id, name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "key", "value", "error"]).astype({"value": "float64"})

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "height", "width", "nChannels", "data").mapInPandas(run, f"id {kind}, key string, value double, error string")
