"""Per-image jobs: kernels run inside mapInPandas, one image a row, a fault kept as that row's status."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.signatures import gradient_signature
from sieveline.kernels import codec, images

#: Bytes of results that a task gathers before it hands them on.
PIECE = 4 << 20
#: Pixels of images whose features are computed together.
STACK = 1 << 16
DECODED = "width int, height int, pixels binary, fault string"


def _per_row(df: DataFrame, schema: str, job: Callable[[dict], dict], keep: list[str]) -> DataFrame:
    """Run job on every row: columns keep and those of schema; a ValueError becomes the row's fault.

    Columns of df that clash with the schema's names are replaced. Results are handed on in pieces of about PIECE bytes,
    however many rows a batch brings: one row's result may be hundreds of times what the row was.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    keep = [c for c in keep if c not in names]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows, waiting, done = [], 0, 0
            for row in map(dict, (zip(pdf.columns, values) for values in zip(*(pdf[c] for c in pdf.columns)))):
                try:
                    got = job(row)
                except ValueError as e:
                    got = {"fault": str(e)}
                rows.append([got.get(n) for n in names])
                waiting += sum(_bytes(v) for v in rows[-1]) + sum(_bytes(row[c]) for c in keep)
                if waiting >= PIECE:
                    yield piece(pdf, rows, done)
                    rows, waiting, done = [], 0, done + len(rows)
            if rows:
                yield piece(pdf, rows, done)

    def piece(pdf: pd.DataFrame, rows: list[list], done: int) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return pd.concat([pdf[keep].iloc[done : done + len(rows)].reset_index(drop=True), out], axis=1)

    return df.mapInPandas(run, f"{kept}, {schema}" if kept else schema)


def _bytes(value: object) -> int:
    """Bytes of a value of some length; 8 for any other."""
    return value.nbytes if isinstance(value, np.ndarray) else len(value) if isinstance(value, (bytes, bytearray, str)) else 8


def decode(files: DataFrame, content: str = "content", kind: str = "png", any_size: bool = False) -> DataFrame:
    """Strictly decoded images of a table of files: width, height, pixels and the fault, other columns kept.

    kind: png or pgm. A null or faulty file keeps its row with null pixels and the fault's text.
    """

    def job(row: dict) -> dict:
        if row[content] is None:
            raise ValueError("no content")
        data = bytes(row[content])
        image = images.decode_png(data, any_size) if kind == "png" else images.decode_pgm(data)
        if kind == "pgm" and not any_size:
            images.check_size(*image.shape)
        return {"width": image.shape[1], "height": image.shape[0], "pixels": image.tobytes()}

    return _per_row(files, DECODED, job, [c for c in files.columns if c != content])


def _image(row: dict) -> np.ndarray:
    if row["pixels"] is None:
        raise ValueError("no pixels")
    return np.frombuffer(bytes(row["pixels"]), np.uint8).reshape(int(row["height"]), int(row["width"]))


def hashes(rasters: DataFrame) -> DataFrame:
    """Digest of the pixels, gradient signature and reduced raster of every image (width, height, pixels).

    The digest and the signature's bits are built-in functions; the kernel only reduces.
    """
    reduced = _per_row(rasters, "small binary, fault string", lambda row: {"small": images.reduce_image(_image(row)).tobytes()}, list(rasters.columns))
    return reduced.withColumns({"pixel_sha256": F.sha2("pixels", 256), "signature": gradient_signature(F.col("small"))}).drop("pixels")


def png_files(rasters: DataFrame) -> DataFrame:
    """Every image (width, height, pixels) as the bytes of a PNG, in content."""
    return _per_row(rasters, "content binary, fault string", lambda row: {"content": images.encode_png(_image(row))}, [c for c in rasters.columns if c != "pixels"])


def extract_features(rasters: DataFrame) -> DataFrame:
    """The 8,177 features of every image, the last one by this library's own PNG encoder.

    Images of one size are computed together, as many as make PIECE bytes of features and STACK pixels.
    """
    keep = [c for c in rasters.columns if c not in ("pixels", "features", "fault")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keep).schema.fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sizes, most = pdf["height"].fillna(0) * pdf["width"].fillna(0), PIECE // (4 * images.FEATURES)
            at = 0
            while at < len(pdf):
                n = int(np.searchsorted(sizes.iloc[at : at + most].cumsum(), STACK, "right"))
                part = pdf.iloc[at : at + max(n, 1)]
                yield part[keep].reset_index(drop=True).assign(**_features(part))
                at += len(part)

    return rasters.mapInPandas(run, f"{kept}, features array<float>, fault string" if kept else "features array<float>, fault string")


def _features(pdf: pd.DataFrame) -> dict[str, list]:
    features, fault, stacks = [None] * len(pdf), [None] * len(pdf), {}
    for i, row in enumerate(pdf[["pixels", "height", "width"]].to_dict("records")):
        try:
            image = _image(row)
            stacks.setdefault(image.shape, []).append((i, image))
        except ValueError as e:
            fault[i] = str(e)
    for same in stacks.values():
        try:
            for (i, _), f in zip(same, images.stack_features_with_container(np.stack([x for _, x in same]))):
                features[i] = f
        except ValueError as e:
            for i, _ in same:
                fault[i] = str(e)
    return {"features": features, "fault": fault}


EMBEDDED = (
    "stego binary, gross_bits bigint, stored_bytes bigint, message_bytes bigint, changed_pixels bigint, distortion bigint, psnr double, "
    "balance_flips bigint, balance_objective_before double, balance_objective_after double, failure string"
)


def embed(jobs: DataFrame, balanced: bool = True) -> DataFrame:
    """Embed `message` into every image (image_id, width, height, pixels, message, key, num, den).

    key may be null (public mode). Salt and padding come from a stream seeded by the image's id and rate, so
    a lost task gives the same image again. Rows that cannot be embedded keep their failure.
    """

    def job(row: dict) -> dict:
        seed = hashlib.sha256(f"experiment-salt:{row['image_id']}:{row['num']}/{row['den']}".encode()).digest()
        try:
            if row["message"] is None:
                raise ValueError("no message")
            key = None if row["key"] is None else bytes(row["key"])
            rate = (int(row["num"]), int(row["den"]))
            stego, info = codec.embed(_image(row), bytes(row["message"]), rate, key, balanced, codec.Stream(seed).take)
        except ValueError as e:
            return {"failure": str(e)}
        return {"stego": stego.tobytes(), **info}

    return _per_row(jobs, EMBEDDED, job, [c for c in jobs.columns if c != "pixels"])


def extract(stegos: DataFrame) -> DataFrame:
    """The message of every image (width, height, stego, key, num, den): adds recovered, null where there is none."""

    def job(row: dict) -> dict:
        if row["stego"] is None:
            return {}
        image = np.frombuffer(bytes(row["stego"]), np.uint8).reshape(int(row["height"]), int(row["width"]))
        key = None if row["key"] is None else bytes(row["key"])
        return {"recovered": codec.extract(image, (int(row["num"]), int(row["den"])), key)}

    return _per_row(stegos, "recovered binary, fault string", job, [c for c in stegos.columns if c != "stego"])


def synthetic_cover(seed: int, height: int = 512, width: int = 512) -> np.ndarray:
    """A textured test image: smooth waves and noise that depend on the seed alone."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    waves = sum(rng.uniform(8, 24) * np.sin(y / rng.uniform(9, 60) + x / rng.uniform(9, 60) + rng.uniform(0, 6)) for _ in range(4))
    return np.clip(128 + waves + rng.normal(0, 6, (height, width)), 0, 255).astype(np.uint8)


def synthetic_covers(ids: DataFrame, image: str = "image_id") -> DataFrame:
    """A synthetic image for every id of digits, of the columns width and height where ids has them, else 512 x 512."""

    def job(row: dict) -> dict:
        width, height = int(row.get("width", 512)), int(row.get("height", 512))
        return {"width": width, "height": height, "pixels": synthetic_cover(int(row[image]), height, width).tobytes()}

    return _per_row(ids.filter(F.col(image).rlike("^[0-9]+$")), DECODED, job, [image])
