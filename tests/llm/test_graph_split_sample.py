"""Problems 1, 2, 3 and 5 on small inputs with every kind of dirt, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.functions.signatures import gradient_signature
from sieveline.llm import components, neardup, sampling, splits


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("per_cell", [60, 10**6])
def test_components_of_chains_and_hubs(spark, per_cell):
    random.seed(1)
    links = [(i, i + 1) for i in range(150)] + [(1000, 1001 + i) for i in range(200)] + [(random.randrange(2000, 2300), random.randrange(2000, 2300)) for _ in range(200)]
    links = [(a, b) for a, b in links if a != b]
    rows = links + links[:30] + [(b, a) for a, b in links[:30]] + [(None, 3), (4, None), (7, 7)]
    df = spark.createDataFrame(rows, "src long, dst long").selectExpr("*", "1 as u", "2 as cell")
    assert {r["id"]: r["component"] for r in components.connected_components(df, edges_per_cell=per_cell).collect()} == brute(links)
    text = spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for a, b in links], "src string, dst string")
    got = {r["id"]: r["component"] for r in components.connected_components(text, edges_per_cell=per_cell).collect()}
    assert {int(k): int(v) for k, v in got.items()} == brute(links)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_image_groups(spark):
    pairs = spark.createDataFrame(
        [("100000002", " 100000001.pgm", True), ("covers/100000003", "100000002", True), ("100000004", "100000001", False), ("100000004", "100000003", None),
         ("100000005", "100000005", True), (None, "100000001", True), ("100000006", "999999999", True), ("x", "", True)],
        "left_image string, right_image string, accepted boolean",
    )
    images = spark.createDataFrame([(f"10000000{i}",) for i in range(1, 8)] + [("100000001",), (None,)], "image_id string")
    got = {tuple(r) for r in components.image_groups(pairs, images).collect()}
    assert got == {(f"10000000{i}", "100000001") for i in (1, 2, 3)}


def test_balance_is_even_and_complete():
    rng = np.random.default_rng(2)
    for weights in (rng.integers(1, 100, 500), np.r_[np.ones(997, int), [300, 55]], np.array([5]), np.array([], int), np.array([0, 0, 3]), rng.integers(1, 10**6, 77)):
        to = splits.balance(weights, 16)
        sums = np.bincount(to, weights, 16)
        assert len(to) == len(weights) and (len(to) == 0 or to.max() < 16)
        if len(weights):
            rest = sums.copy()
            if weights.max() >= weights.sum() / 16:
                rest = np.sort(rest)[: -int((weights >= weights.sum() / 16).sum())]
            assert np.ptp(rest) <= max(weights[weights < weights.sum() / 16], default=weights.max())
    assert (splits.balance(weights, 16) == splits.balance(weights, 16)).all()


def test_differencing_is_tight():
    weights = np.random.default_rng(3).integers(1, 10**6, 4000)
    sums = np.bincount(splits.balance(weights, 8), weights, 8)
    assert np.ptp(sums) <= 20


def test_parts_keep_groups_and_shares(spark):
    random.seed(4)
    rows = [(f"i{k}", f"g{k % 700}" if k % 3 else "hot") for k in range(3000)]
    rows += [(f"n{k}", None) for k in range(300)] + rows[:50] + [(None, "g1"), ("i1", "g2"), ("i2", "hot")]
    groups = spark.createDataFrame(rows, "image_id string, group_id string").withColumn("unit", F.lit("clash")).withColumn("key", F.lit(1))
    own = splits.members(groups)
    units = splits.assign_parts(own, {"train": 0.5, "test": 0.3, "reserve": 0.2}, bins=32, chunk_items=150)
    of = {r["unit"]: r["part"] for r in units.collect()}
    unit = {}
    for r in own.collect():
        unit.setdefault(r["image_id"], set()).add(r["unit"])
    assert all(len(u) == 1 for u in unit.values()) and set(of) == {next(iter(u)) for u in unit.values()}
    assert unit["i1"] == {x for r in own.filter("group_id = 'g2'").collect() for x in [r["unit"]]}
    share = {r["part"]: r["w"] / 3300 for r in units.groupBy("part").agg(F.sum("weight").alias("w")).collect()}
    assert abs(share["train"] - 0.5) < 0.03 and abs(share["test"] - 0.3) < 0.03
    again = {r["unit"]: r["part"] for r in splits.assign_parts(own.repartition(7), {"train": 0.5, "test": 0.3, "reserve": 0.2}, bins=32, chunk_items=150).collect()}
    assert again == of
    empty = splits.members(groups.limit(0))
    assert splits.assign_parts(empty, {"a": 1.0}).count() == 0


def test_torn_groups(spark):
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h"), ("d", "k"), ("e", None)], "image_id string, group_id string")
    split = spark.createDataFrame([("a", "train"), ("b", "TEST"), ("c", "train"), ("c", "train"), ("d", "?"), ("d", None), ("e", "train"), ("e", "test")], "image_id string, part string")
    parts = spark.createDataFrame([("train", "train", 0.6), ("TEST", "test", 0.4), ("test", "test", 0.4)], "spelling string, part string, target_share double")
    own = splits.members(groups)
    got = {r["group_id"]: r["old_parts"] for r in splits.group_report(own, split, parts, splits.assign_parts(own, splits.part_shares(parts))).collect()}
    assert got == {"g": 2, "h": 1, "k": 0}


def test_positions_are_a_bijection_of_each_block(spark):
    df = spark.range(0, 5 * 1024).select("id", sampling.place(F.col("id")).alias("p")).collect()
    for b in range(5):
        assert sorted(r["p"] for r in df[b * 1024 : (b + 1) * 1024]) == list(range(1024))
    assert [r["p"] for r in df[:1024]] != [r["p"] for r in df[1024:2048]]


def test_sample_only_grows(spark):
    df = spark.range(1000, 9000).selectExpr("id", "1 as block")
    small = {r["id"] for r in sampling.block_sample(df.filter("id % 3 = 0"), F.col("id")).collect()}
    large = {r["id"] for r in sampling.block_sample(df.repartition(9), F.col("id")).collect()}
    assert small <= large and {x for x in large if x % 3 == 0} == small
    full = sampling.block_sample(spark.range(0, 8 * 1024), F.col("id"))
    assert full.count() == 8 * sampling.CHOSEN
    assert sampling.block_sample(spark.createDataFrame([(None,)], "id long"), F.col("id")).count() == 0


def test_audit_of_draws(spark):
    rows = [("100000064", 2, 1), ("x/100000064.pgm", 2, 1), (" 100000063", 1, 1), ("100000063", 1, 2), ("100000063", 3, 1), (None, 1, 1), ("100000070", None, 1), ("100000071", 4, 1), ("junk", 1, 2)]
    got = {tuple(r) for r in sampling.audit_draws(spark.createDataFrame(rows, "image_id string, draw_no int, rerun int").withColumn("block", F.lit(1))).collect()}
    want, held = set(), {}
    for i, d, r in rows:
        if i and i != "junk" and d:
            held.setdefault(i.strip()[-9:] if not i.endswith(".pgm") else i[-13:-4], set()).add((d, r))
    for i, h in held.items():
        want |= {(i, d, r) for d in range(min(d for d, _ in h), 5) for r in (1, 2) if (d, r) not in h}
    assert got == want
    assert sampling.audit_draws(spark.createDataFrame([], "image_id string, draw_no int, rerun int")).count() == 0


def near_brute(rows):
    ids = {}
    for a, i, s in rows:
        if None not in (a, i, s):
            ids.setdefault((a, i), set()).add(s)
    keys = sorted(ids)
    return {
        (min(i, j), max(i, j)) for (a, i) in keys for (b, j) in keys
        if a == b and i < j and any(((s ^ t) & (2**64 - 1)).bit_count() <= 4 for s in ids[a, i] for t in ids[b, j])
    }


@pytest.mark.parametrize("block", [4, 2048])
def test_near_signatures_with_hot_lists(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "COPIES", 3)
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(25)]
    sigs = base + [b ^ sum(1 << k for k in random.sample(range(64), random.randrange(1, 7))) for b in base for _ in range(6)]
    sigs += [0] * 12 + [1 << k for k in range(30)] + [(1 << 63) | (1 << k) for k in range(10)]
    rows = [(random.choice("AAAB"), f"{i:09d}", s - 2**64 if s >> 63 else s) for i, s in enumerate(sigs)]
    rows += rows[:20] + [(None, "1", 1), ("A", None, 1)]
    df = spark.createDataFrame(rows, "archive string, image_id string, signature long").withColumn("small", F.lit(None).cast("binary")).withColumn("token", F.lit(1))
    got = {tuple(r) for r in neardup.near_image_pairs(df).collect()}
    assert got == near_brute(rows)
    groups = {(r["archive"], r["image_id"]): r["group_id"] for r in neardup.near_image_groups(df).collect()}
    same = brute(list(got) + [(i, i) for a, i, s in rows if a and i])
    assert {k[1]: v for k, v in groups.items()} == same


def test_merge_and_probe_count_shared_tokens():
    """Occurrences in short lists and in long ones add up to the tokens that two records of a shard share."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 4)
    sig = np.unique(np.concatenate([base[k % 4] ^ (rng.integers(0, 2, (1, 8)) << rng.integers(0, 63, (1, 8))).sum(1) for k in range(160)]))
    skip = [sum(1 << int(k) for k in rng.choice(21, 2, replace=False)) for _ in sig]
    pdf = pd.DataFrame({"token": np.arange(len(sig)) // 40, "cell": 0, "side": 0, "k": 0, "skip": skip, "archive": 1, "signature": sig})
    s = neardup.Shards(pdf)
    got = {}
    for q, r, n in s.merge(1):
        got |= {(int(a), int(b)): (int(c), int(p)) for a, b, c, p in zip(q, r, n, s.probe(q, r))}
    met = 0
    for a in range(len(sig)):
        for b in range(a + 1, len(sig)):
            same = (s.key[a] == s.key[b]) if a // 40 == b // 40 else np.zeros(21, bool)
            want = (int((same & ~s.long[a]).sum()), int((same & s.long[a]).sum()))
            met += want[0] > 0
            assert got.get((a, b), (0, want[1])) == want
    assert met > 100 and len(got) == met


def test_lists_over_a_block_are_cut(spark, monkeypatch):
    """Every list of more than a block's records is cut, whatever its share of all records, and no pair is lost."""
    rng = random.Random(10)
    hot = [(0b101 << 40) | rng.getrandbits(16) for _ in range(90)]
    rows = [("A", s) for s in set(hot)] + [("A", rng.getrandbits(62)) for _ in range(3000)]
    reps = spark.createDataFrame([(1, s) for _, s in rows], "archive bigint, signature bigint").distinct()
    monkeypatch.setattr(neardup, "BLOCK", 8)
    index = neardup.shards(reps, 3)
    most = index.groupBy("token", "cell").count().agg(F.max("count")).head()[0]
    assert most <= 40 and index.agg(F.max("cell")).head()[0] > 0
    got = {(r["a"], r["b"]) for r in neardup.near_signatures(reps).collect()}
    sig = sorted({s for _, s in rows})
    want = {(a, b) for i, a in enumerate(sig) for b in sig[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert got == want


def test_index_holds_each_record_once_for_each_short_list_of_a_chunk(spark):
    """Five rows a record, not one for each token: the index is what fills disks at size."""
    rng = random.Random(11)
    reps = spark.createDataFrame([(1, rng.getrandbits(62)) for _ in range(6000)], "archive bigint, signature bigint").distinct()
    rows = neardup.shards(reps, 3)
    assert rows.groupBy("signature").count().agg(F.max("count")).head()[0] == 5
    assert rows.groupBy("signature").agg(F.first("aside").alias("aside")).filter("bit_count(aside) <> 2").count() == 0


def test_signature_follows_from_the_raster(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(20):
        small = rng.integers(0, 256, (8, 9)).astype(np.uint8)
        word = int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")
        rows.append((small.tobytes(), word - 2**64 if word >> 63 else word))
    df = spark.createDataFrame([*rows, (b"short", None), (None, None)], "small binary, want long")
    assert all(r["got"] == r["want"] for r in df.select("want", gradient_signature(F.col("small")).alias("got")).collect())


def test_empty_images(spark):
    df = spark.createDataFrame([], "archive string, image_id string, signature long, small binary")
    assert neardup.near_image_pairs(df).count() == 0 and neardup.near_image_groups(df).count() == 0


def test_too_many_bits_are_refused(spark):
    with pytest.raises(ValueError):
        neardup.near_signatures(spark.createDataFrame([("A", 1)], "archive string, signature long"), bits=6)
