"""Problem 5: near-duplicate records by T-occurrence search over inverted lists (DivideSkip).

A signature of 64 bits is cut into 7 chunks and described by its 21 pairs of chunks (tokens of about 18
bits). Two signatures that differ in at most 4 bits agree in at least 3 chunks, so they share at least
T = 3 tokens: a T-occurrence problem over the inverted lists of the tokens of one archive.

DivideSkip is used twice. The index is sharded by the lists of single chunks, of which two near signatures share at
least 3 too: every record sets its 2 longest aside and visits the shard of each of the others, so it is sent 5 times and not
once for each of its tokens. Lengths are true counts, joined back to the records, and (length, chunk's number) orders the lists that
two records share alike for both, which is what makes it safe to set lists aside: the shortest of them is set aside by neither. In a
shard each record is a query over the tokens' lists. It sets the L = T - 1 longest of them aside; the short ones are merged by a
priority queue of their heads (one queue a query, all queries of a batch a step at a time), which counts the occurrences of every record
met; those that reach T - L are probed by binary search in the query's long lists; those that reach T in all are
compared by their bits. A chunk's list of more than BLOCK records is cut into blocks, and each pair of blocks is a
shard of its own, so no list is ever held whole, however many records share its chunk.

Lists of one record meet nothing and are left out. Equal signatures of one archive are one representative; copies are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.signatures import gradient_signature
from sieveline.operators.components import connected_components
from sieveline.operators.joins import skew_join, small_or_skew_join
from sieveline.session import input_partitions, materialize

BITS = 4
CHUNKS = 7
#: The pairs of chunks, in the order of their numbers.
PAIRS = tuple(combinations(range(CHUNKS), 2))
#: Where chunks begin and end, in bits.
CUTS = tuple(round(64 * i / CHUNKS) for i in range(CHUNKS + 1))
#: Records in a block of a long list.
BLOCK = 16_384
#: Lists whose lengths are broadcast at most.
LENGTHS = 100_000
#: Copies in a block of a class, where classes are expanded into pairs.
COPIES = 1_024


def signed_images(images: DataFrame) -> DataFrame:
    """Distinct rows (archive, image_id, signature); a null signature is computed from `small`.

    An image that was ingested again counts once for each different signature. Rows without an archive, an
    id or any way to a signature are left out.
    """
    s = F.coalesce("signature", F.when(F.col("signature").isNull(), gradient_signature(F.col("small"))))
    return images.select("archive", "image_id", s.alias("signature")).dropna().distinct()


def required_overlap(bits: int) -> int:
    """T: the tokens that signatures differing in at most `bits` bits share at least."""
    agree = CHUNKS - bits
    return agree * (agree - 1) // 2


def _chunk(signature: Column, i: int) -> Column:
    return F.shiftrightunsigned(signature, CUTS[i]).bitwiseAND((1 << (CUTS[i + 1] - CUTS[i])) - 1)


def postings(reps: DataFrame) -> DataFrame:
    """The inverted lists of chunks: rows (token, k, v, archive, signature), one per record and chunk k with its bits v.

    A token is a hash of the archive, the chunk's number and its bits; two lists that fall together by chance only
    cost comparisons, since shards tell the archive and the bits apart.
    """
    each = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("k"), _chunk(F.col("signature"), k).cast("int").alias("v")) for k in range(CHUNKS)])
    rows = reps.select("archive", "signature", F.explode(each).alias("p")).select("p.k", "p.v", "archive", "signature")
    return rows.withColumn("token", F.xxhash64("k", "archive", "v"))


def shards(reps: DataFrame, agree: int, block: int | None = None) -> DataFrame:
    """The sharded index: rows (token, cell, side, k, aside, archive, signature).

    Every record once for each short list of a chunk and, where that list is cut into n blocks, for each of the n pairs that
    hold its block; side tells which block of the pair is its own. aside is the set of its long lists as bits. A record with
    fewer than `agree` lists of two or more records has no partner and is left out.
    """
    block = block or BLOCK
    lists = postings(reps)
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialize(sizes, "lists")  # at most 7 x 1,024 an archive
    long = small_or_skew_join(lists, sizes, "token", "inner", LENGTHS)
    # 7 lists a record
    own = long.groupBy("archive", "signature").agg(F.sort_array(F.collect_list(F.struct("n", "k", "v")), False).alias("lists"))
    own = own.filter(F.size("lists") >= agree)
    aside = F.aggregate(F.slice("lists", 1, agree - 1), F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["k"].cast("int")))) if agree > 1 else F.lit(0)
    rows = own.select("archive", "signature", aside.alias("aside"), F.explode(F.slice("lists", agree, CHUNKS)).alias("x"))
    blocks = F.ceil(F.col("x.n") / block).cast("int")
    token = F.xxhash64("x.k", "archive", "x.v").alias("token")
    rows = rows.select("archive", "signature", "aside", token, "x.k", blocks.alias("blocks"), F.pmod(F.xxhash64("signature"), blocks).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return rows.select("token", cell.alias("cell"), (F.col("own") > F.col("other")).cast("tinyint").alias("side"), "k", "aside", "archive", "signature")


class Shards:
    """A batch of whole shards: for every record its lists, sorted postings of them, and the search.

    A record's long lists are those that a column skip names, as bits; without it the `skipped` longest in its shard.
    """

    def __init__(self, pdf: pd.DataFrame, skipped: int = 0):
        token, cell = pdf["token"].to_numpy(), pdf["cell"].to_numpy()
        new = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
        self.shard = np.r_[0, np.cumsum(new)]
        self.sig, self.archive = pdf["signature"].to_numpy().view(np.uint64), pdf["archive"].to_numpy()
        self.side, self.k = pdf["side"].to_numpy(), pdf["k"].to_numpy()
        # in a shard of two blocks only pairs across them count: pairs within a block meet in its own shard
        self.mixed = np.zeros(self.shard[-1] + 1, np.int8)
        np.maximum.at(self.mixed, self.shard, self.side)
        c = [(self.sig >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(CUTS, CUTS[1:])]
        #: the list of each record and pair of chunks, within its shard
        self.key = np.stack([(self.shard.astype(np.uint64) << np.uint64(25)) | np.uint64(k << 20) | (c[i] << np.uint64(10)) | c[j] for k, (i, j) in enumerate(PAIRS)], 1)
        flat = self.key.ravel()
        order = np.argsort(flat, kind="stable")  # records stay in order within a list
        self.post = order // len(PAIRS)
        starts = np.r_[True, flat[order][1:] != flat[order][:-1]]
        number = np.cumsum(starts) - 1
        ends = np.r_[np.flatnonzero(starts)[1:], len(order)]
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        self.at = at.reshape(self.key.shape)
        self.list = number[self.at]
        self.end = ends[self.list]
        if "skip" in pdf:
            self.long = (pdf["skip"].to_numpy()[:, None] >> np.arange(len(PAIRS)) & 1).astype(bool)
        else:
            self.long = np.zeros(self.key.shape, bool)
            length = np.diff(np.r_[0, ends])[self.list]
            np.put_along_axis(self.long, np.argpartition(-length, skipped, 1)[:, :skipped], True, 1)
            aside = pdf["aside"].to_numpy()[:, None] >> np.arange(CHUNKS) & 1
            #: the chunks of each record, and which of their lists are short
            self.chunk, self.short = np.stack(c, 1), aside == 0
        #: lists and records as one sorted array, for binary search
        self.sorted = number * len(pdf) + self.post

    def merge(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge each record's short lists from behind its own entry: (query, record, occurrences) of at least `least`."""
        who, at, end = np.arange(len(self.sig)), self.at + 1, np.where(self.long, 0, self.end)
        none = len(self.sig)
        while len(who):
            head = np.where(at < end, self.post[np.minimum(at, len(self.post) - 1)], none)
            top = head.min(1)  # the least head of every queue
            live = top < none
            who, at, end, head, top = who[live], at[live], end[live], head[live], top[live]
            popped = head == top[:, None]
            n = popped.sum(1)
            ok = n >= least
            yield who[ok], top[ok], n[ok]
            at = at + popped

    def probe(self, query: np.ndarray, record: np.ndarray) -> np.ndarray:
        """In how many of the query's long lists the record stands, by binary search."""
        pair, k = np.nonzero(self.long[query])
        want = self.list[query[pair], k] * len(self.sig) + record[pair]
        found = self.sorted[np.minimum(np.searchsorted(self.sorted, want), len(self.sorted) - 1)] == want
        return np.bincount(pair, found, len(query)).astype(int)

    def search(self, overlap: int, bits: int) -> Iterator[pd.DataFrame]:
        """Pairs (archive, a, b) that share at least `overlap` tokens and differ in at most `bits` bits.

        A pair is reported in one shard only: that of the first chunk whose list is short for both.
        """
        set_aside = max(overlap - 1, 0)
        for q, r, n in self.merge(overlap - set_aside):
            ok = (self.mixed[self.shard[q]] == 0) | (self.side[q] != self.side[r])
            q, r, n = q[ok], r[ok], n[ok]
            ok = (n + self.probe(q, r) >= overlap) & (self.archive[q] == self.archive[r]) & (self.sig[q] != self.sig[r])
            q, r = q[ok], r[ok]
            ok = np.bitwise_count(self.sig[q] ^ self.sig[r]) <= bits
            q, r = q[ok], r[ok]
            if not len(q):
                continue
            both = (self.chunk[q] == self.chunk[r]) & self.short[q] & self.short[r]
            ok = both.argmax(1) == self.k[q]
            a, b = self.sig[q[ok]].view(np.int64), self.sig[r[ok]].view(np.int64)
            yield pd.DataFrame({"archive": self.archive[q[ok]], "a": np.minimum(a, b), "b": np.maximum(a, b)})


def _search(overlap: int, bits: int):
    """Search shards that arrive sorted by (token, cell); a shard that a batch cuts waits for its rest."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            end = (pdf["token"].iat[-1], pdf["cell"].iat[-1])
            last = ((pdf["token"] == end[0]) & (pdf["cell"] == end[1])).to_numpy()
            if last.all() and waiting and (waiting[-1]["token"].iat[-1], waiting[-1]["cell"].iat[-1]) == end:
                waiting.append(pdf)
                continue
            yield from whole([*waiting, pdf[~last]])
            waiting = [pdf[last]]
        yield from whole(waiting)

    def whole(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
        if len(pdf) > 1:
            alone = ~(pdf.duplicated(["token", "cell"], keep=False).to_numpy())
            pdf = pdf[~alone].reset_index(drop=True)
        if len(pdf) > 1:
            yield from Shards(pdf, max(overlap - 1, 0)).search(overlap, bits)

    return run


def near_signatures(reps: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (archive, a, b), a < b, each once, of signatures of one archive that differ in 1 to `bits` bits.

    reps: distinct rows (archive bigint, signature bigint). bits may be up to 5: with 7 chunks two must agree.
    """
    overlap = required_overlap(bits)
    if overlap < 1:
        raise ValueError("too many bits for the number of chunks")
    rows = shards(materialize(reps.select("archive", "signature"), "signatures"), CHUNKS - bits)
    pairs = rows.repartition(input_partitions(reps), "token", "cell").sortWithinPartitions("token", "cell")
    return pairs.mapInPandas(_search(overlap, bits), "archive bigint, a bigint, b bigint")


def near_classes(images: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal signatures and the links between them.

    Returns members (archive, class, signature, image_id), archive by name and class its hash, and links (class, a,
    b), a < b: representatives of one archive that differ in 1 to `bits` bits.
    """
    own = materialize(signed_images(images).withColumn("class", F.xxhash64("archive")), "signed")
    reps = own.select(F.col("class").alias("archive"), "signature").distinct()
    return own, materialize(near_signatures(reps, bits), "near").withColumnRenamed("archive", "class")


def near_image_pairs(images: DataFrame, bits: int = BITS) -> DataFrame:
    """All pairs (image_a, image_b), image_a < image_b, of one archive whose signatures differ in at most `bits` bits.

    The result's form asks for the pairs of equal signatures too; they are expanded only here. The copies of a class
    are dealt to blocks of about COPIES: one side keeps its block, the other visits all, so no task pairs a whole class.
    """
    own, links = near_classes(images, bits)
    many = own.groupBy("class", "signature").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("blocks"))
    own = materialize(own.join(many, ["class", "signature"]), "members")
    block = lambda c: F.pmod(F.xxhash64(c), "blocks").cast("int").alias("block")
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    kept = own.select("class", "archive", F.col("signature").alias("a"), "blocks", F.col("image_id").alias("x"))
    visit = own.select("class", F.col("archive").alias("other"), F.col("signature").alias("a"), F.col("image_id").alias("y"), all_blocks)
    within = kept.select("class", "archive", "a", "x", block("x")).join(visit, ["class", "a", "block"]).filter("x < y")
    size = lambda c: many.select("class", F.col("signature").alias(c), F.col("blocks").alias(f"blocks_{c}"))
    links = links.join(size("a"), ["class", "a"]).join(size("b"), ["class", "b"])
    first = links.select("class", "a", "b", "blocks_b", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("block"))
    first = first.join(kept.select("class", "archive", "a", "x", block("x")), ["class", "a", "block"])
    across = first.select("class", "archive", F.col("b").alias("a"), "x", F.pmod(F.xxhash64("x"), "blocks_b").cast("int").alias("block"))
    across = across.join(visit, ["class", "a", "block"]).filter("x <> y")
    cols = ["archive", "other", "x", "y"]
    both = within.select(*cols).unionByName(across.select(*cols)).filter("archive = other")  # two names of one hash are told apart here
    return both.select(F.least("x", "y").alias("image_a"), F.greatest("x", "y").alias("image_b")).distinct()


def near_image_groups(images: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per image: archive, image_id, group_id, copies and links.

    group_id is the smallest image id of all classes linked directly or through others in the archive,
    copies the images with the same signature (itself included), links the other classes it is near to.
    """
    own, links = near_classes(images, bits)
    name = lambda s: F.concat_ws(":", F.col("class").cast("string"), F.col(s).cast("string"))
    parts = connected_components(links.select(name("a").alias("src"), name("b").alias("dst")))
    ends = links.select("class", F.col("a").alias("signature")).unionByName(links.select("class", F.col("b").alias("signature")))
    degree = ends.groupBy("class", "signature").agg(F.count(F.lit(1)).alias("links"))
    classes = own.groupBy("class", "signature").agg(F.count(F.lit(1)).alias("copies"), F.min("image_id").alias("first"))
    classes = classes.join(degree, ["class", "signature"], "left").withColumn("id", name("signature"))
    classes = materialize(classes.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "classes")
    groups = classes.groupBy("component").agg(F.min("first").alias("group_id"))
    classes = skew_join(classes, groups, "component").select("id", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    rows = own.withColumn("id", name("signature"))
    return skew_join(rows, materialize(classes, "named"), "id").select("archive", "image_id", "group_id", "copies", "links")
