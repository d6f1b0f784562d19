"""Statistics of residuals, for stacks of images of one size (image, row, column).

A statistic is a stream of parts: (filter, step, stratum, values, chosen) says which value every place of every
image has, and which places count (None: all). Features, balance objectives and the statistics over whole
corpora are counts of such parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np

#: Residual filters of the features (fixed values).
FILTERS = (
    ((-1, 1),),
    ((-1,), (1,)),
    ((1, -2, 1),),
    ((1,), (-2,), (1,)),
    ((-1, 3, -3, 1),),
    ((-1,), (3,), (-3,), (1,)),
    ((0, 1, 0), (1, -4, 1), (0, 1, 0)),
    ((-1, 2, -1), (2, -4, 2), (-1, 2, -1)),
    ((-1, 0), (0, 1)),
    ((0, -1), (1, 0)),
)
#: Residual filters that balancing matches: taps (down, across, weight) around a pixel (fixed values).
BALANCE_FILTERS = (
    ((0, 0, -1), (0, 1, 1)),
    ((0, 0, -1), (1, 0, 1)),
    ((0, -1, 1), (0, 0, -2), (0, 1, 1)),
    ((-1, 0, 1), (0, 0, -2), (1, 0, 1)),
    ((0, 0, -1), (1, 1, 1)),
    ((0, 0, -1), (1, -1, 1)),
    ((-1, 0, 1), (0, -1, 1), (0, 0, -4), (0, 1, 1), (1, 0, 1)),
    ((-1, -1, -1), (-1, 0, 2), (-1, 1, -1), (0, -1, 2), (0, 0, -4), (0, 1, 2), (1, -1, -1), (1, 0, 2), (1, 1, -1)),
)
#: Steps of quantization, variance bounds of the strata, masks toggled in groups of four pixels (fixed values).
STEPS, BOUNDS, MASKS = (1, 2, 4), (16, 64, 256), ((1, 0, 1, 0), (0, 1, 0, 1), (1, 1, 1, 1))
#: Pixels at each side that residuals and strata leave out; filters whose classes are told apart by stratum (fixed values).
RIM, MASKED = 2, 4

Part = tuple[int, int, int, np.ndarray, np.ndarray | None]
Taps = tuple[tuple[int, int, int], ...]


@cache
def feature_taps() -> tuple[Taps, ...]:
    """The feature filters as taps, each centred at half its size."""
    grids = [np.array(f) for f in FILTERS]
    return tuple(tuple((int(i) - g.shape[0] // 2, int(j) - g.shape[1] // 2, int(g[i, j])) for i, j in np.argwhere(g)) for g in grids)


def residual(x: np.ndarray, taps: Taps) -> np.ndarray:
    """Weighted sum of the taps around every pixel inside the rim."""
    inside = [slice(RIM, n - RIM) for n in x.shape[1:]]
    moved = lambda s, by: slice(s.start + by, s.stop + by)
    return sum(weight * x[:, moved(inside[0], down), moved(inside[1], across)] for down, across, weight in taps)


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squares of the 5 x 5 pixels around every pixel inside the rim."""

    def around(v: np.ndarray) -> np.ndarray:
        total = np.zeros((len(v), v.shape[1] + 1, v.shape[2] + 1), np.int64)
        total[:, 1:, 1:] = v.cumsum(1, np.int64).cumsum(2)
        return total[:, 5:, 5:] - total[:, :-5, 5:] - total[:, 5:, :-5] + total[:, :-5, :-5]

    return around(x), around(x * x)


def strata(x: np.ndarray) -> np.ndarray:
    """Variance stratum 0 to 3 of every pixel inside the rim, compared without rounding."""
    total, squares = moments(x)
    return np.digitize(25 * squares - total * total, [625 * b for b in BOUNDS])


def level(r: np.ndarray, step: int, most: int) -> np.ndarray:
    """Residuals in steps, rounded half away from zero and cut to -most to most."""
    return np.sign(r) * np.minimum((2 * np.abs(r) + step) // (2 * step), most)


def fours(levels: np.ndarray, axis: int) -> np.ndarray:
    """Code, in base 5, of every four successive levels (-2 to 2) along an axis."""
    n = max(levels.shape[axis] - 3, 0)
    part = [np.s_[:]] * levels.ndim
    code = np.int16(312)  # four levels of 0
    for i, weight in enumerate((125, 25, 5, 1)):
        part[axis] = np.s_[i : i + n]
        code = code + levels[tuple(part)].astype(np.int16) * np.int16(weight)
    return code


@cache
def class_of() -> np.ndarray:
    """For each of the 625 codes the least code that mirroring and change of sign make of it."""
    digits = np.indices((5,) * 4).reshape(4, -1)
    alike = [np.ravel_multi_index(d, (5,) * 4) for d in (digits, digits[::-1], 4 - digits, 4 - digits[::-1])]
    return np.min(alike, axis=0)


@cache
def classes() -> np.ndarray:
    """The codes that name the 169 classes, in order."""
    return np.unique(class_of())


@cache
def class_number() -> np.ndarray:
    """For each of the 625 codes the number of its class, in the order of `classes`."""
    return np.searchsorted(classes(), class_of())


def class_shares(r: np.ndarray, step: int, chosen: Sequence[np.ndarray | None] = (None,)) -> list[np.ndarray]:
    """For each mask of pixels (None: all) every image's shares of the 169 classes of four levels along rows and columns; 0 where nothing is chosen.

    A four counts where its second pixel is chosen.
    """
    levels, counts = level(r, step, 2), [0] * len(chosen)
    for axis in (2, 1):
        numbers = class_number()[fours(levels, axis)] + np.arange(len(r)).reshape(-1, 1, 1) * len(classes())
        for i, mask in enumerate(chosen):
            some = numbers if mask is None else numbers[_second(mask, axis)]
            counts[i] = counts[i] + np.bincount(some.ravel(), minlength=len(r) * len(classes()))
    counts = [n.reshape(len(r), -1) for n in counts]
    return [n / np.maximum(n.sum(1, keepdims=True), 1) for n in counts]


def _second(chosen: np.ndarray, axis: int) -> np.ndarray:
    """The mask at the second of every four."""
    return chosen.take(range(1, chosen.shape[axis] - 2), axis)


def toggled(x: np.ndarray, axis: int, mask: tuple[int, ...]) -> np.ndarray:
    """For every group of four pixels along an axis 1, -1 or 0: toggling low bits roughens it, smooths it, or neither."""
    lines = np.moveaxis(x, axis, -1)
    groups = lines[..., : lines.shape[-1] // 4 * 4].reshape(len(x), -1, 4)
    rough = lambda g: np.abs(np.diff(g, axis=-1)).sum(-1)
    return np.sign(rough(groups ^ np.array(mask)) - rough(groups))


def toggle_shares(x: np.ndarray) -> np.ndarray:
    """18 shares of every image: along rows and columns, for each mask, how often groups roughen, smooth or stay."""
    kinds = [toggled(x, axis, m) for axis in (2, 1) for m in MASKS]
    return np.stack([np.mean(k == sign, 1) if k.size else np.zeros(len(x)) for k in kinds for sign in (1, -1, 0)], 1)


def stack_features(images: np.ndarray) -> np.ndarray:
    """8,176 features of every image of a stack: classes of ten residuals at three steps and of four by stratum, histogram, its pairs' differences, toggles."""
    x = images.astype(np.int32)
    rs = [residual(x, taps) for taps in feature_taps()]
    where = strata(x)
    plain = [n for r in rs for step in STEPS for n in class_shares(r, step)]
    masked = [n for r in rs[:MASKED] for n in class_shares(r, 1, [where == s for s in range(len(BOUNDS) + 1)])]
    bins = (x + np.arange(len(x), dtype=np.int32).reshape(-1, 1, 1) * 256).ravel()
    hist = np.bincount(bins, minlength=len(x) * 256).reshape(-1, 256) / images[0].size
    return np.concatenate([*plain, *masked, hist, hist[:, ::2] - hist[:, 1::2], toggle_shares(x)], 1, dtype=np.float32)


def features(image: np.ndarray) -> np.ndarray:
    """The features of one image."""
    return stack_features(image[None])[0]


# parts of whole corpora


def pixel_parts(x: np.ndarray) -> Iterator[Part]:
    """The pixels themselves."""
    yield 0, 0, -1, x, None


def residual_parts(x: np.ndarray) -> Iterator[Part]:
    """Residuals of all ten filters, as they are (step 0)."""
    for f, taps in enumerate(feature_taps()):
        yield f, 0, -1, residual(x, taps), None


def code_parts(x: np.ndarray) -> Iterator[Part]:
    """Codes of four successive levels of all ten filters at step 1, along rows and columns."""
    for f, taps in enumerate(feature_taps()):
        for axis in (2, 1):
            yield f, 1, -1, fours(level(residual(x, taps), 1, 2), axis), None


def class_parts(x: np.ndarray) -> Iterator[Part]:
    """Classes of four levels of all ten filters at three steps."""
    for f, taps in enumerate(feature_taps()):
        for step in STEPS:
            for axis in (2, 1):
                yield f, step, -1, class_of()[fours(level(residual(x, taps), step, 2), axis)], None


def masked_parts(x: np.ndarray) -> Iterator[Part]:
    """Classes of four levels of the first four filters at step 1, by the stratum of the second tap."""
    where = strata(x)
    for f, taps in enumerate(feature_taps()[:MASKED]):
        for axis in (2, 1):
            values = class_of()[fours(level(residual(x, taps), 1, 2), axis)]
            for s in range(len(BOUNDS) + 1):
                yield f, 1, s, values, _second(where == s, axis)


def balance_parts(x: np.ndarray) -> Iterator[Part]:
    """Bins -8 to 8 of the eight balance filters at three steps, for each stratum."""
    where = strata(x)
    for f, taps in enumerate(BALANCE_FILTERS):
        r = residual(x, taps)
        for step in STEPS:
            for s in range(len(BOUNDS) + 1):
                yield f, step, s, level(r, step, 8), where == s


def toggle_parts(x: np.ndarray) -> Iterator[Part]:
    """What toggling does to groups: filter 0 along rows and 1 along columns, step the mask's number."""
    for f, axis in enumerate((2, 1)):
        for k, mask in enumerate(MASKS):
            yield f, k, -1, toggled(x, axis, mask), None


Parts = Callable[[np.ndarray], Iterator[Part]]
