"""Problem 8: texts cut off by field limits, by a backward character n-gram model.

A text is read as a row of blocks (cues) parted by blank lines. The model looks backward from a place in a
text: for the characters before it (orders ORDERS, together with the text's style and the marks still
open there) it counts how often a block ended and how often it went on. The counts of all texts are kept
in hashed tables of fixed size; a task adds up its texts before anything is sent, so neither the
model nor what reaches the driver grows with the data.

A value's score is the log-odds of its final context: end of text against continuation, interpolated
from short to long contexts. Ends inside texts are certain; the last ends of texts are doubtful and
only count where at least three different texts end alike, beyond what cuts at random places would give
(credits and the like stand nowhere else). Texts are the same where their SHA-256 is.
Where a text stops with an ellipsis or a bracket, which may be the sign of a cut, the context before these marks is
scored too, against contexts that inner ends have before theirs: no list says which signs there are. The threshold of each
language (and column, one call each) is where inner ends and places inside blocks, all of every text and each
scored without itself, are told apart best. They are scored in a second pass over the texts, once the counts
are whole, and only histograms of their scores leave a task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.mixing import source_name
from sieveline.operators.joins import small_or_skew_join
from sieveline.session import materialize

#: Characters of context; 0 knows style and open marks alone.
ORDERS = (0, 2, 4, 7, 11, 16)
#: Cells of each order's table, as a power of two.
CELL_BITS = (8, 16, 18, 20, 20, 20)
#: Rows of a table: inner ends, places within a block, inner ends before their closing marks, last ends.
ENDS, PLACES, BEFORE_MARKS, LAST = range(4)
#: Weight of the shorter context's estimate.
BACKOFF = 3.0
#: Cells in one message of a task's counts.
SLAB = 1 << 16
#: Texts handled at once, by characters.
BATCH_CHARS = 200_000
#: Places whose cells wait until they are added up.
FLUSH = 4_000_000
#: Places after which a task sends its counts, which are 32-bit numbers there.
SEND = 1 << 30
#: What stands at the end of a sentence (fixed values).
STOPS = ".!?…"
_BLOCK, _DOC = "\x1e", "\x1f"
_BLANK = re.compile(r"\n[ \t]*\n\s*")
#: What stands for something left out: the ellipsis, and the character for bytes that make none (fixed values).
ELLIPSIS, BROKEN = "…", "\ufffd"
_IS_STOP, _OPEN, _SHUT, _LT, _SLASH, _MUSIC, _BROKEN = 1, 2, 4, 8, 16, 32, 64


def _classes() -> np.ndarray:
    table = np.zeros(65_536, np.uint8)
    for chars, bit in ((STOPS, _IS_STOP), ("([{<", _OPEN), (")]}>", _SHUT), ("<", _LT), ("/", _SLASH), ("♪", _MUSIC), (BROKEN, _BROKEN)):
        table[[ord(x) for x in chars]] |= bit
    return table


_CLASS = _classes()


def clean(text: str) -> str:
    """A text as the model reads it: lower case, one kind of line end, blocks parted by one character."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "").replace(_BLOCK, " ").replace(_DOC, " ")
    return _BLANK.sub(_BLOCK, text.strip()).replace("\n", " ").lower()


class Batch:
    """Texts laid end to end: character codes, style, open marks and, by order, the hashes of contexts."""

    def __init__(self, texts: list[str]):
        c = np.frombuffer((_DOC + _DOC.join(texts) + _DOC).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        c[(c >= 48) & (c <= 57)] = 48
        same = c[1:] == c[:-1]
        drawn = np.zeros(len(c), bool)
        drawn[3:] = same[2:] & same[1:-1] & same[:-2] & (c[3:] > 57)
        c = c[~drawn]  # a letter drawn out longer than three is read as three
        kind = _CLASS[np.minimum(c, 65_535)]
        self.c, self.n, self.stop = c, len(texts), (kind & _IS_STOP) > 0
        self.block, doc = c == ord(_BLOCK), c == ord(_DOC)
        self.edge = self.block | doc
        at = np.flatnonzero(doc)
        self.first, self.last = at[:-1] + 1, at[1:] - 1
        # style: whether blocks mostly end with a stop; with fewer than two inner ends, whether there is any
        ends = np.flatnonzero(self.block) - 1
        owner = np.searchsorted(at, ends, "right") - 1
        n_ends = np.bincount(owner, minlength=self.n)
        n_stops = np.bincount(owner, self.stop[ends], minlength=self.n)
        any_stop = np.add.reduceat(self.stop, at[:-1], dtype=np.int64) > 0
        style = np.where(n_ends >= 2, n_stops >= 0.35 * n_ends, any_stop)
        # marks open since the block's start
        where = np.arange(len(c), dtype=np.int32)
        start = np.maximum.accumulate(np.where(self.edge, where, 0))
        self.start, self.shut, self.broken = start, (kind & _SHUT) > 0, (kind & _BROKEN) > 0
        self.opening = np.maximum.accumulate(np.where((kind & _OPEN) > 0, where, -1))

        def open_(step: np.ndarray) -> np.ndarray:
            total = np.cumsum(step, dtype=np.int32)
            return total - total[start]

        state = np.repeat(style.astype(np.uint32), np.diff(at))
        state = np.r_[state, np.uint32(0)] + np.uint32(1)
        marks = kind & (_OPEN | _SHUT | _MUSIC)
        if marks.any():
            opened = ((kind & _OPEN) > 0).view(np.int8) - ((kind & _SHUT) > 0).view(np.int8)
            state |= (open_(opened) > 0).astype(np.uint32) << np.uint32(2)
            slash = np.r_[(kind[1:] & _SLASH) > 0, False]
            lt = (kind & _LT) > 0
            state |= (open_((lt & ~slash).view(np.int8) - (lt & slash).view(np.int8)) > 0).astype(np.uint32) << np.uint32(3)
            state |= (open_(((kind & _MUSIC) > 0).view(np.int8)) & 1).astype(np.uint32) << np.uint32(4)
        self.state = state

    def cells(self) -> Iterator[np.ndarray]:
        """For each order the table cell of the context that ends at each position."""
        base, mult = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
        code = self.c * mult
        code ^= code >> np.uint32(15)
        code *= np.uint32(0xC2B2AE3D)
        h, order, power = np.zeros(len(code), np.uint32), 0, 1
        seed = self.state * np.uint32(0x27D4EB2F)
        for want, bits in zip(ORDERS, CELL_BITS):
            while order < want:  # one more character to the left
                h[order:] += code[: len(code) - order] * np.uint32(power)
                power = power * int(base) & 0xFFFFFFFF
                order += 1
            x = h ^ seed
            x ^= x >> np.uint32(16)
            x *= mult
            x ^= x >> np.uint32(13)
            x *= base
            yield x >> np.uint32(32 - bits)


def before_marks(b: Batch, at: np.ndarray) -> np.ndarray:
    """From each position back over the stops, brackets and blanks that close a block; the same position where nothing is left of it."""
    began, to = at, at.copy()
    while True:
        moved = to != began
        left = np.where(b.stop[to] | b.broken[to] | (moved & (b.c[to] == 32)), to - 1, to)
        left = np.where(b.shut[to] & (b.opening[to] > b.start[to]), b.opening[to] - 1, left)
        back = (left != to) & (left >= b.start[to]) & ~b.edge[left]
        if not back.any():
            return to
        to = np.where(back, left, to)


def places(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of inner ends, of places within a block, and of inner ends before (or without) their closing marks."""
    before_block = np.flatnonzero(b.block) - 1
    ends = before_block[~b.edge[before_block]]
    goes_on = np.flatnonzero(~b.edge[:-1] & ~b.edge[1:])
    return ends, goes_on, before_marks(b, ends)


def _before_signs(b: Batch) -> np.ndarray:
    """Of each text the position before a final ellipsis, bracket or broken character, or -1 where there is none to doubt.

    A bracket behind the end of a sentence is not doubted.
    """
    c, last = b.c, b.last
    dots = lambda at: (c[at] == ord(ELLIPSIS)) | ((c[at] == 46) & (c[at - 1] == 46))
    inside = b.shut[last] & (b.opening[last] > b.start[last])
    ahead = np.maximum(b.opening[last] - 1, 0)
    ahead = np.where(c[ahead] == 32, np.maximum(ahead - 1, 0), ahead)
    doubt = dots(last) | b.broken[last] | (inside & (~b.stop[ahead] | dots(ahead)))
    at = before_marks(b, last)
    return np.where(doubt & (at != last) & ~b.edge[last], at, -1)


class Counter:
    """Counts of a task, and the last contexts of its texts."""

    def __init__(self):
        self.tables = [np.zeros((4, 1 << bits), np.int32) for bits in CELL_BITS]
        self.waiting: list[list[list[np.ndarray]]] = [[[], [], [], []] for _ in CELL_BITS]
        self.n_waiting = self.n_counted = 0

    def flush(self) -> None:
        """Add the waiting cells to the tables."""
        for table, kinds in zip(self.tables, self.waiting):
            for row, cells in zip(table, kinds):
                if cells:
                    row += np.bincount(np.concatenate(cells), minlength=len(row)).astype(np.int32)
                    cells.clear()
        self.n_waiting = 0

    def add(self, texts: list[str]) -> np.ndarray:
        """Count texts; returns by text the cells of its last end (rows of -1 where there is none)."""
        b = Batch(texts)
        kinds = places(b)
        whole = b.last >= b.first
        out = []
        for waiting, cell in zip(self.waiting, b.cells()):
            for cells, at in zip(waiting, kinds):
                cells.append(cell[at])
            out.append(np.where(whole, cell[b.last].astype(np.int32), -1))
        self._count(len(kinds[PLACES]))
        return np.stack(out, 1)

    def add_last(self, cells: np.ndarray) -> None:
        """Count last ends, a row of cells each."""
        for waiting, cell in zip(self.waiting, cells.T):
            waiting[LAST].append(cell)
        self._count(len(cells))

    def _count(self, n: int) -> None:
        self.n_waiting += n
        self.n_counted += n
        if self.n_waiting >= FLUSH:
            self.flush()

    def slabs(self) -> pd.DataFrame:
        """The counts in compressed pieces that hold any: rows (slab, counts)."""
        self.flush()
        flat = np.concatenate([t.ravel() for t in self.tables])
        pieces = ((k, flat[k : k + SLAB]) for k in range(0, len(flat), SLAB))
        rows = [(k // SLAB, zlib.compress(x.tobytes(), 1)) for k, x in pieces if x.any()]
        return pd.DataFrame(rows, columns=["slab", "counts"])


def log_odds(cells: list[np.ndarray], model: list[np.ndarray], row: int, own: int | None = None) -> np.ndarray:
    """Log-odds of an end (row ENDS or BEFORE_MARKS) against continuation, above those of any place.

    cells: by order the cells of the contexts. own: the row among whose counts the context itself is, so that
    it is left out.
    """
    whole = [float(x) for x in model[0].sum(0, np.float64)]
    p0 = (whole[row] + 1) / (whole[row] + whole[PLACES] + 2)
    # were every text cut anywhere, so many last ends would fall on a place; thrice that is still chance
    chance = np.float32(3 * whole[LAST] / max(whole[PLACES], 1.0))
    p, n = np.full(len(cells[0]), p0, np.float32), None
    back = np.float32(BACKOFF)
    for t, cell in zip(model, cells):
        # the four counts of a cell are fetched as one number
        here = t.view(np.complex128).ravel().take(cell).view(np.float32).reshape(-1, 4)
        if own is not None:
            here[:, own] -= 1
        # a longer context cannot be more frequent than the shorter one; more is a collision in the table
        n = np.maximum(here, 0, out=here) if n is None else np.minimum(np.maximum(here, 0, out=here), n, out=here)
        e, g = n[:, row], n[:, PLACES]
        if row == ENDS:  # three texts that end alike are the least that counts, the text itself among them
            e = e + np.maximum(n[:, LAST] - 2 - chance * g, 0)
        p = (e + back * p) / (e + g + back)
    p = np.clip(p, 1e-9, 1 - 1e-6)
    return np.log(p / (1 - p)) - np.float32(np.log(p0 / (1 - p0)))


_READ = "kind string, digest binary, last array<int>, slab int, counts binary"


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in pieces of about BATCH_CHARS characters of text."""
    size = pdf["text"].str.len().fillna(0).to_numpy()
    for _, chunk in pdf.groupby((np.cumsum(size) // BATCH_CHARS).astype(np.int64)):
        yield chunk


def _cleaned(texts: Iterable[str | None]) -> list[str]:
    return [clean(t) if t else "" for t in texts]


def _reader(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per text with its last context, and at a task's end (and every SEND places) its counts in compressed slabs."""
    counter = Counter()

    def counts() -> Iterator[pd.DataFrame]:
        slabs = counter.slabs()
        if len(slabs):
            none = pd.Series([None] * len(slabs), dtype=object)
            yield pd.DataFrame({"kind": "counts", "digest": none, "last": none, "slab": slabs["slab"], "counts": slabs["counts"]})

    for pdf in it:
        for chunk in _chunks(pdf):
            last = counter.add(_cleaned(chunk["text"]))
            yield pd.DataFrame({"kind": "text", "digest": chunk["digest"].to_numpy(), "last": [x if x[0] >= 0 else None for x in last], "slab": None, "counts": None})
            if counter.n_counted >= SEND:
                yield from counts()
                counter = Counter()
    yield from counts()


def _count_last(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task's last ends in compressed slabs."""
    counter = Counter()
    for pdf in it:
        if len(pdf):
            counter.add_last(np.stack(pdf["last"].to_numpy()))
    yield counter.slabs()


def _add_slabs(key: tuple, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of one slab over all tasks, taken as they come: 64-bit numbers, since the shortest contexts are counted in billions."""
    total = np.zeros(1, np.int64)
    for pdf in it:
        for x in pdf["counts"]:
            total = total + np.frombuffer(zlib.decompress(x), np.int32)
    yield pd.DataFrame({"slab": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _model(slabs: dict[int, bytes]) -> list[np.ndarray]:
    """Tables of each order, one row of counts per cell, from summed slabs."""
    flat = np.zeros(sum(4 << bits for bits in CELL_BITS), np.float32)
    for k, data in slabs.items():
        piece = np.frombuffer(zlib.decompress(data), np.int64)
        flat[k * SLAB : k * SLAB + len(piece)] = piece
    cuts = np.cumsum([4 << bits for bits in CELL_BITS])[:-1]
    # by cell, so that a context's counts lie together
    return [np.ascontiguousarray(t.reshape(4, -1).T, np.float32) for t in np.split(flat, cuts)]


_SCORED = "kind string, doc_id bigint, lang string, source string, score double, label string, bin bigint, n bigint"

#: Width of the steps in which thresholds are sought, the range they lie in (scores beyond it are counted in the
#: outermost bins), and how many labelled places of all languages each language's own are joined by.
STEP, RANGE, PRIOR = 0.25, (-8.0, 4.0), 200
#: First bin of a histogram of scores, which takes all below the range, and the number of bins.
LOW = round(RANGE[0] / STEP) - 1
BINS = round(RANGE[1] / STEP) - LOW + 1


def _histograms(score: np.ndarray, lang: np.ndarray, n_langs: int) -> np.ndarray:
    """Scores by language number and bin."""
    b = np.floor(np.clip(score, RANGE[0] - STEP, RANGE[1]) / STEP).astype(np.int64) - LOW
    return np.bincount(lang * BINS + b, minlength=n_langs * BINS).reshape(n_langs, BINS)


def _score_texts(texts: Iterable[str | None], lang: np.ndarray, n_langs: int, model: list[np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Scores of the texts' ends (nan where there is no text), and histograms by language number of all inner
    ends and all places within blocks, each scored without itself."""
    b = Batch(_cleaned(texts))
    ends, on, _ = places(b)
    signs, whole = _before_signs(b), b.last >= b.first
    cells = [x.view(np.int32) for x in b.cells()]
    at_ = lambda at: [x[at] for x in cells]
    score = log_odds(at_(b.last), model, ENDS)
    doubted = whole & (signs >= 0)
    score[doubted] = np.minimum(score[doubted], log_odds(at_(signs[doubted]), model, BEFORE_MARKS))
    owner = lambda at: lang[np.searchsorted(b.first, at, "right") - 1]
    found = {}
    for label, at, row in (("end", ends, ENDS), ("place", on, PLACES)):
        found[label] = _histograms(log_odds(at_(at), model, ENDS, row), owner(at), n_langs)
    return np.where(whole, score, np.nan), found


def _scorer(packed):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(packed.value)
        for pdf in it:
            code, langs = pd.factorize(pdf["lang"])
            total = {label: np.zeros((len(langs), BINS), np.int64) for label in ("end", "place")}
            for chunk in _chunks(pdf.assign(code=code)):
                score, found = _score_texts(chunk["text"], chunk["code"].to_numpy(), len(langs), model)
                yield chunk[["doc_id", "lang", "source"]].assign(kind="text", score=score, label=None, bin=None, n=None)
                for label, x in found.items():
                    total[label] += x
            for label, x in total.items():
                at, b = np.nonzero(x)
                yield pd.DataFrame({"kind": "labelled", "doc_id": None, "lang": langs[at], "source": None, "score": np.nan, "label": label, "bin": b + LOW, "n": x[at, b]})

    return run


def score_ends(docs: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scores of the texts' ends, and the histograms that thresholds are fitted on.

    docs: doc_id bigint, lang, source and the text column; it is read twice. Scores: one row (doc_id, lang,
    source, score) per document; null and empty texts have a null score. lang is lower-cased; null becomes
    'und'. Histograms: rows (lang, label, bin, n) that count by score all inner ends (label 'end') and all
    places within a block (label 'place') of all texts.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), source_name("source").alias("source"), F.col(column).alias("text")
    )
    read = materialize(rows.select("text", F.unhex(F.sha2("text", 256)).alias("digest")).mapInPandas(_reader, _READ), "contexts")
    # the last end of every different text once
    last = read.filter("last is not null").groupBy("digest").agg(F.min("last").alias("last")).select("last")
    counts = read.filter("kind = 'counts'").select("slab", "counts").unionByName(last.mapInPandas(_count_last, "slab int, counts binary"))
    slabs = counts.groupBy("slab").applyInPandas(_add_slabs, "slab int, counts binary")
    # the tables' size is fixed: 112 MB before compression, whatever the data
    packed = spark.sparkContext.broadcast({r["slab"]: bytes(r["counts"]) for r in slabs.collect()})
    scored = materialize(rows.mapInPandas(_scorer(packed), _SCORED), "scored")
    texts = scored.filter("kind = 'text'").select("doc_id", "lang", "source", F.nanvl("score", F.lit(None)).alias("score"))
    labelled = scored.filter("kind = 'labelled'").groupBy("lang", "label", "bin").agg(F.sum("n").alias("n"))
    return texts, labelled


def _best_step(ends: np.ndarray, places_: np.ndarray) -> float:
    """The middle of where the shares of ends kept and of places found are greatest together; bins in order."""
    kept = np.cumsum(ends[::-1])[::-1] / max(ends.sum(), 1e-9)  # from each bin on
    found = (np.cumsum(places_) - places_) / max(places_.sum(), 1e-9)  # below each bin
    good = (kept + found)[1:]  # the first bin has no bound of its own
    best = np.flatnonzero(good >= good.max() - 1e-3)
    return float((best.mean() + 1 + LOW) * STEP)


def thresholds(labelled: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Threshold of every language: rows (lang, threshold); no rows without labelled places.

    Each language's histograms are joined by those of all languages together, scaled to `prior` ends and as many
    places: a language with many of its own decides by these, one with few leans on all, and nothing
    depends on a least number.
    """
    labelled = materialize(labelled, "labelled")
    common = labelled.groupBy("label", "bin").agg(F.sum("n").alias("all"))  # two kinds of a fixed number of bins
    kinds = common.toPandas()

    def dense(x: pd.DataFrame, n: str, label: str) -> np.ndarray:
        out, x = np.zeros(BINS), x[x["label"] == label]
        out[x["bin"].to_numpy(int) - LOW] = x[n]
        return out

    shared = {label: dense(kinds, "all", label) for label in ("end", "place")}
    shared = {label: x * prior / max(x.sum(), 1e-9) for label, x in shared.items()}

    def one(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        own = {label: dense(x, "n", label) + shared[label] for label in shared}
        return pd.DataFrame({"lang": [key[0]], "threshold": [_best_step(own["end"], own["place"])]})

    return labelled.groupBy("lang").applyInPandas(one, "lang string, threshold double")


def flag_cut(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, source, score, cut): cut is true below the language's threshold, null without a text.

    A language without a threshold, whose texts have neither an inner end nor two characters, is cut below 0.
    """
    rows = small_or_skew_join(scored, limits, "lang", "left")
    return rows.select("doc_id", "lang", "source", "score", (F.col("score") < F.coalesce("threshold", F.lit(0.0))).alias("cut"))


def find_cut(docs: DataFrame, column: str = "text") -> DataFrame:
    """Every document with its score and whether its text was cut before its end."""
    scored, labelled = score_ends(docs, column)
    return flag_cut(scored, materialize(thresholds(labelled), "thresholds"))


def cut_shares(flags: DataFrame) -> DataFrame:
    """Texts, cut texts and their share for each source (trimmed, lower case; null is a source too)."""
    seen = flags.filter("cut is not null").groupBy("source")
    return seen.agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts")).withColumn("share", F.col("cut_texts") / F.col("texts"))
