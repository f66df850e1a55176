"""Image kernels as Arrow functions over rows of numbers: resizing, patches, convolution and position tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

VALUES = T.ArrayType(T.DoubleType())
# What pads a letterboxed image, and the scale that maps bytes to -1 to 1.
PAD, SCALE = 127.0, 127.5


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Samples at pixel centres: (i + 0.5) * old / new - 0.5, clamped to the image."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    r0, r1, fr = axis(image.shape[0], height)
    c0, c1, fc = axis(image.shape[1], width)
    top = image[r0][:, c0] * (1 - fc) + image[r0][:, c1] * fc
    bottom = image[r1][:, c0] * (1 - fc) + image[r1][:, c1] * fc
    return top * (1 - fr)[:, None] + bottom * fr[:, None]


def letterbox(image: np.ndarray, canvas: int) -> np.ndarray:
    """The image scaled to fit a square canvas and centred on grey, as values from -1 to 1."""
    h, w = image.shape
    scale = min(canvas / w, canvas / h)
    nw, nh = int(np.floor(w * scale + 0.5)), int(np.floor(h * scale + 0.5))
    out = np.full((canvas, canvas), PAD)
    x, y = (canvas - nw) // 2, (canvas - nh) // 2
    out[y : y + nh, x : x + nw] = resize_bilinear(image, nh, nw)
    return out / SCALE - 1


def im2col(image: np.ndarray, size: int, stride: int) -> np.ndarray:
    """One row of values for each patch, patches in reading order."""
    windows = np.lib.stride_tricks.sliding_window_view(image, (size, size))[::stride, ::stride]
    return windows.reshape(-1, size * size)


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size correlation with zeros beyond the edges."""
    k = kernel.shape[0]
    return (im2col(np.pad(image, k // 2), k, 1) @ kernel.ravel()).reshape(image.shape)


def interpolate(table: np.ndarray, length: int) -> np.ndarray:
    """A table's rows at ``length`` evenly spaced centres, linearly."""
    return resize_bilinear(table, length, table.shape[1])


def cubic_weights(n: int, length: int) -> np.ndarray:
    """``length`` x ``n`` weights that resample n values by Keys' cubic (a = -1/2), widened when there are fewer than n.

    Centres are evenly spaced; weights beyond the edges are left out, and each row sums up to one.
    """
    scale = n / length
    wide = max(scale, 1.0)
    centre = (np.arange(length) + 0.5) * scale - 0.5
    t = np.abs(np.arange(n)[None, :] - centre[:, None]) / wide
    near, far = 1.5 * t**3 - 2.5 * t**2 + 1, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2
    w = np.where(t < 1, near, np.where(t < 2, far, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resize_bicubic(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images (any leading axes) resampled by cubic weights, rows and columns apart."""
    return cubic_weights(images.shape[-2], height) @ images @ cubic_weights(images.shape[-1], width).T


def relative_positions(size: int, table: np.ndarray) -> np.ndarray:
    """R[q, k] = table[q - k + size - 1] for a table of 2 size - 1 rows, interpolated if it has another number."""
    if len(table) != 2 * size - 1:
        table = interpolate(table, 2 * size - 1)
    q = np.arange(size)
    return table[q[:, None] - q[None, :] + size - 1]


def squares(x: pa.Array) -> np.ndarray:
    """Arrays of one length as square images, what is beyond a square left out."""
    if not len(x):
        return np.zeros((0, 1, 1))
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    side = int(np.sqrt(flat.shape[1]))
    return flat[:, : side * side].reshape(len(x), side, side)


def lists(images: np.ndarray) -> pa.Array:
    flat = images.reshape(len(images), -1)
    ends = np.arange(0, flat.size + 1, max(1, flat.shape[1] if flat.size else 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))


@arrow_udf(VALUES)
def resized(x: pa.Array) -> pa.Array:
    """A square image of values at 3/2 of its side."""
    images = squares(x)
    side = images.shape[1] * 3 // 2
    across = resize_bilinear(images.transpose(1, 2, 0).reshape(images.shape[1], -1), side, images.shape[2] * len(images)).reshape(side, images.shape[2], len(images))
    down = resize_bilinear(across.transpose(1, 0, 2).reshape(images.shape[2], -1), side, side * len(images)).reshape(side, side, len(images))
    return lists(down.transpose(2, 1, 0))


@arrow_udf(VALUES)
def shrunk(x: pa.Array) -> pa.Array:
    """A square image of values at 5/8 of its side, by cubic weights."""
    images = squares(x)
    side = images.shape[1] * 5 // 8
    return lists(resize_bicubic(images, side, side))


@arrow_udf(VALUES)
def sharpened(x: pa.Array) -> pa.Array:
    """A square image convolved with a fixed 3 x 3 kernel."""
    kernel = np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]], dtype=np.float64)
    images = squares(x)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(images, ((0, 0), (1, 1), (1, 1))), (3, 3), axis=(1, 2))
    return lists((windows * kernel).sum(axis=(3, 4)))


@arrow_udf(VALUES)
def patch_sums(x: pa.Array) -> pa.Array:
    """The sum of each 2 x 2 patch of a square image."""
    images = squares(x)
    half = images.shape[1] // 2
    return lists(images[:, : 2 * half, : 2 * half].reshape(len(images), half, 2, half, 2).sum(axis=(2, 4)))
