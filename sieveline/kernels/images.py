"""Kernels on single images: strict decoders, the gradient signature, costs, in numpy.

Spark runs them inside mapInPandas, one image a row; see `sieveline.operators.image_jobs`.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from sieveline.kernels.statistics import features, stack_features

#: Profile of images (fixed values).
SIDE, AREA = (256, 8192), (262_144, 16_777_216)
_PNG = b"\x89PNG\r\n\x1a\n"


def check_size(height: int, width: int) -> None:
    if not (SIDE[0] <= height <= SIDE[1] and SIDE[0] <= width <= SIDE[1] and AREA[0] <= height * width <= AREA[1]):
        raise ValueError("image size is outside the profile")


def _chunks(data: bytes):
    at = len(_PNG)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("PNG ends inside a chunk")
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("PNG chunk is cut or damaged")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + size
    raise ValueError("PNG has no end")


def decode_png(data: bytes, any_size: bool = False) -> np.ndarray:
    """Pixels of a single-frame 8-bit grayscale PNG; anything else is a ValueError.

    The size is checked from the header, before any pixel is unpacked. Interlaced files are refused.
    """
    if not data or not data.startswith(_PNG):
        raise ValueError("not a PNG")
    packed, shape = [], None
    for name, body in _chunks(data):
        if shape is None:
            if name != b"IHDR" or len(body) != 13:
                raise ValueError("PNG has no header")
            width, height, depth, color, method, filtering, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, color, method, filtering, interlaced) != (8, 0, 0, 0, 0):
                raise ValueError("only plain 8-bit grayscale is supported")
            if not any_size:
                check_size(height, width)
            shape = (height, width)
        elif name == b"acTL":
            raise ValueError("only single-frame files are supported")
        elif name == b"IDAT":
            packed.append(body)
    if shape is None:
        raise ValueError("PNG has no header")
    height, width = shape
    inflater = zlib.decompressobj()
    try:
        raw = inflater.decompress(b"".join(packed), height * (width + 1) + 1)
    except zlib.error as e:
        raise ValueError("PNG data is damaged") from e
    if len(raw) != height * (width + 1):
        raise ValueError("PNG data has the wrong length")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _unfilter(rows: np.ndarray) -> np.ndarray:
    height, width = rows.shape[0], rows.shape[1] - 1
    out, above = np.empty((height, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line, dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            left = corner = 0
            for x, (v, up) in enumerate(zip(line.tolist(), above.tolist())):
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                left, corner = (v + guess) & 255, up
                out[y, x] = left
        else:
            raise ValueError("unknown PNG filter")
        above = out[y]
    return out


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grayscale PNG; its pixels are exact, its bytes are this encoder's own (no filter, level 6)."""
    height, width = image.shape
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = image
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_pgm(data: bytes) -> np.ndarray:
    """Pixels of a binary PGM with at most 255 levels."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("PGM header is cut")
        fields.append(data[at:end])
        at = end
    if fields[0] != b"P5" or not all(f.isdigit() for f in fields[1:]) or not 0 < int(fields[3]) <= 255:
        raise ValueError("not an 8-bit binary PGM")
    width, height = int(fields[1]), int(fields[2])
    body = data[at + 1 :]
    if len(body) < width * height:
        raise ValueError("PGM pixels are cut")
    return np.frombuffer(body, np.uint8, width * height).reshape(height, width).copy()


def _triangle(n: int, out: int) -> list[tuple[int, np.ndarray]]:
    """For each output sample where its input window starts, and the window's 22-bit fixed-point weights."""
    scale = n / out
    reach, rows = max(scale, 1.0), []
    for i in range(out):
        center = (i + 0.5) * scale
        low, high = max(0, int(center - reach + 0.5)), min(n, int(center + reach + 0.5))
        w = np.maximum(0.0, 1.0 - np.abs((np.arange(low, high) - center + 0.5) / reach))
        rows.append((low, np.floor(w / w.sum() * (1 << 22) + 0.5).astype(np.int64)))
    return rows


def reduce_image(image: np.ndarray, height: int = 8, width: int = 9) -> np.ndarray:
    """The image reduced by a triangle filter as wide as the step, columns first, each pass rounded to 8 bits."""
    fixed = lambda v: np.clip((v + (1 << 21)) >> 22, 0, 255)
    x = image.astype(np.int64)
    x = np.stack([fixed(x[:, a : a + len(w)] @ w) for a, w in _triangle(x.shape[1], width)], 1)
    return np.stack([fixed(w @ x[a : a + len(w)]) for a, w in _triangle(x.shape[0], height)]).astype(np.uint8)


def signature(small: np.ndarray) -> int:
    """64 bits, high bit first: a bit is set where a pixel is brighter than its left neighbour; as signed bigint."""
    word = int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")
    return word - (1 << 64) if word >> 63 else word


def box_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the 5 x 5 neighbourhood of every pixel, mirrored at the edge."""
    p = np.pad(x.astype(np.int64), 2, mode="symmetric")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[5:, 5:] - c[:-5, 5:] - c[5:, :-5] + c[:-5, :-5]


#: Low-pass taps of the wavelet whose residuals the costs are made of (fixed values).
WAVELET = (
    -0.00011747678412476953, 0.0006754494064505693, -0.00039174037337694705, -0.004870352993451574, 0.008746094047405777, 0.013981027917398282,
    -0.044088253930794755, -0.017369301001807547, 0.12874742662047847, 0.0004724845739132828, -0.2840155429615824, -0.015829105256349306,
    0.5853546836542067, 0.6756307362972898, 0.3128715909144659, 0.05441584224310401,
)
#: Cost of a pixel that must not change, width of the border kept dry of changes, bound of a flat neighbourhood.
WET, BORDER, FLAT = 0xFFFFFFFF, 16, 625


def _along(x: np.ndarray, taps: np.ndarray, before: int, axis: int) -> np.ndarray:
    """Correlation with taps along an axis, `before` of them ahead of the pixel, the edge mirrored with its own pixel."""
    lines = np.moveaxis(x, axis, -1)
    wide = np.pad(lines, [(0, 0), (before, len(taps) - 1 - before)], mode="symmetric")
    return np.moveaxis(np.lib.stride_tricks.sliding_window_view(wide, len(taps), axis=-1) @ taps, -1, axis)


def costs(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of lowering and of raising each pixel, as uint32 with WET where it must not be done.

    A pixel is dear where the wavelet's detail bands around it are smooth: the sum over the three bands of |filter| against
    1 / (1 + |band|). Filters are products of a low and a high pass; what two bands have in common is filtered once.
    """
    low = np.array(WAVELET)
    high = np.where(np.arange(len(low)) % 2, low[::-1], -low[::-1])
    smooth, rough = (_along(image.astype(float), f, 7, 0) for f in (low, high))
    inverse = lambda band: 1 / (1 + np.abs(band))
    of_low, of_high = (np.abs(f[::-1]) for f in (low, high))
    across_high = _along(inverse(_along(smooth, high, 7, 1)), of_high, 8, 1)
    across_both = _along(inverse(_along(rough, low, 7, 1)), of_low, 8, 1) + _along(inverse(_along(rough, high, 7, 1)), of_high, 8, 1)
    total = _along(across_high, of_low, 8, 0) + _along(across_both, of_high, 8, 0)
    if not (np.isfinite(total) & (total > 0)).all():
        raise ValueError("a cost is not positive")
    price = np.floor(total * 1e6 + 0.5).clip(1).astype(np.uint32)
    dry = 25 * box_sums(image.astype(np.int64) ** 2) - box_sums(image) ** 2 > FLAT
    for edge in (np.s_[:BORDER], np.s_[-BORDER:], np.s_[:, :BORDER], np.s_[:, -BORDER:]):
        dry[edge] = False
    return tuple(np.where(dry & (image != bound), price, np.uint32(WET)) for bound in (0, 255))


def features_with_container(image: np.ndarray, encoded: bytes | None = None) -> np.ndarray:
    """The features and the container's bytes per pixel; the latter depends on the encoder."""
    return np.r_[features(image), len(encoded or encode_png(image)) / image.size].astype(np.float32)


#: How many features those of an image and of its container are.
FEATURES = 8_177


def stack_features_with_container(stack: np.ndarray) -> np.ndarray:
    """The same for every image of a stack, a row each, by this library's own encoder."""
    size = [len(encode_png(image)) / image.size for image in stack]
    return np.c_[stack_features(stack), np.array(size, np.float32)]


def lsb_control(image: np.ndarray, identifier: int, share: float = 0.4) -> np.ndarray:
    """Positive control: that share of pixels gets a random low bit, seeded by the image's number."""
    rng = np.random.default_rng(identifier + 721)
    hit = rng.random(image.shape) < share
    out = image.copy()
    out[hit] = (out[hit] & 254) | rng.integers(0, 2, int(hit.sum()), dtype=np.uint8)
    return out
