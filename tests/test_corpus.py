import hashlib
import random

import pytest

from sieveline.functions.signatures import described
from sieveline.operators import corpus
from sieveline.operators.joins import heavy_keys, skew_join


def brute_components(links):
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


def test_components_of_chains_hubs_and_noise(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(80)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(60)]
    links += links[:10] + [(b, a) for a, b in links[:10]]
    df = spark.createDataFrame(links + [(None, 1), (2, None), (500, 500)], "src int, dst int")
    got = {r["id"]: r["root"] for r in corpus.components(df).collect()}
    assert got == brute_components(links + [(500, 500)])
    assert corpus.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [None, 6, 7])
def test_near_pairs_with_a_hot_token(spark, monkeypatch, parts):
    monkeypatch.setattr(corpus, "BLOCK", 8)
    random.seed(2)
    sigs = [0] + [1 << k for k in range(40)] + [random.getrandbits(64) - 2**63 for _ in range(60)]
    rows = [(f"{100 + i}", s) for i, s in enumerate(sigs)] + [("999", sigs[0]), (None, 5), ("998", None)]
    classes = corpus.signature_classes(spark.createDataFrame(rows, "image_id string, signature bigint"))
    got = {(r[0], r[1], r[2]) for r in corpus.near_pairs(classes, parts).collect()}
    reps = {}
    for i, s in rows:
        if i and s is not None:
            reps[s] = min(reps.get(s, i), i)
    want = {(min(a, b), max(a, b), d) for s, a in reps.items() for t, b in reps.items() if a != b and (d := ((s ^ t) & (2**64 - 1)).bit_count()) <= 4}
    assert got == want


def test_greedy_split_equals_the_loop(spark):
    random.seed(3)
    groups = [(f"g{i}", f"{i:03d}", random.choice([1, 1, 1, 2, 5, 40])) for i in range(200)]
    targets = {"train": 120, "validation": 40, "test": 100}
    size, want = dict.fromkeys([*targets, "reserve"], 0), {}
    for g, first, n in sorted(groups, key=lambda x: hashlib.sha256(("split-93191:" + x[1]).encode()).digest()):
        part = next((p for p in targets if size[p] < targets[p]), "reserve")
        size[part] += n
        want[g] = part
    df = spark.createDataFrame(groups, "group_id string, first string, size bigint")
    assert {r["group_id"]: r["part"] for r in corpus.greedy_split(df, targets).collect()} == want
    few = df.limit(3)
    assert {r["part"] for r in corpus.greedy_split(few, {"train": 10**6, "validation": 1}).collect()} == {"train"}


def test_leakage_and_exact_links(spark):
    rows = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "train"), ("h", None), (None, "test"), (None, "train")], "group_id string, part string")
    assert [r["group_id"] for r in corpus.leakage(rows).collect()] == ["g"]
    images = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "x"), ("c", "y"), ("d", None)], "image_id string, pixel_sha256 string")
    assert [tuple(r) for r in corpus.exact_links(images).collect()] == [("a", "b")]


def test_leakage_report_tells_images_groups_and_the_total(spark):
    rows = spark.createDataFrame([("a", "g", "train"), ("a", "g", "test"), ("b", "h", "train"), ("c", "h", "test"), ("d", None, "train"), ("d", None, None), (None, "h", "test")], "image_id string, group_id string, part string")
    got = {tuple(r) for r in corpus.leakage_report(rows, 4).collect()}
    assert got == {("image", "a", 2), ("group", "g", 2), ("group", "h", 2), ("total", None, 4)}
    with pytest.raises(Exception, match="expected 5 images"):
        corpus.leakage_report(rows, 5).collect()
    assert [corpus.parts_for(n) for n in (0, 10**5, 10**6, 10**12)] == [5, 5, 6, 7]


def test_what_is_null_follows_from_the_raster(spark):
    raster = bytes(range(72))
    rows = [("a", raster, 5, "x"), ("b", raster, None, None), ("c", None, None, None), ("d", b"short", None, None)]
    got = {r["image_id"]: r for r in described(spark.createDataFrame(rows, "image_id string, small binary, signature bigint, pixel_sha256 string")).collect()}
    assert (got["a"]["signature"], got["a"]["pixel_sha256"]) == (5, "x") and (got["b"]["signature"], got["b"]["pixel_sha256"]) == (-1, hashlib.sha256(raster).hexdigest())
    assert got["c"]["signature"] is None and got["c"]["pixel_sha256"] is None and got["d"]["signature"] is None


def test_skew_join_equals_join(spark):
    facts = spark.createDataFrame([(0 if i % 2 else i % 50, i) for i in range(500)] + [(None, -1)], "k int, v int").selectExpr("*", "9 as _hot", "8 as w")
    dim = spark.createDataFrame([(i, i * 10, i) for i in range(0, 40)], "k int, x int, w int")
    for how in ("left", "inner", "left_semi"):
        a, b = skew_join(facts, dim, "k", how), facts.join(dim.drop("w"), "k", how)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    assert heavy_keys(facts, "k", 4).count() <= 4


def test_first_images_are_ranked_by_known_part(spark, tables):
    from sieveline.plans import corpus as plans

    known = {r["spelling"]: r["part"] for r in spark.read.parquet(tables + "/split_part.parquet").collect()}
    least, exact = {}, True
    for r in spark.read.parquet(tables + "/manifest_split.parquet").select("image_id", "part", "ordinal").collect():
        part = known.get(r["part"])
        if r["image_id"] is not None and r["ordinal"] is not None and part in ("train", "validation", "test"):
            exact = exact and r["part"] == part
            least[part, r["image_id"]] = min(r["ordinal"], least.get((part, r["image_id"]), r["ordinal"]))
    want = set()
    for part, k in (("train", 120), ("validation", 60), ("test", 120)):
        order = sorted((o, i) for (p, i), o in least.items() if p == part)[:k]
        want |= {(i, part, o, n + 1) for n, (o, i) in enumerate(order)}
    got = plans.QUERIES["w2_first_k"](spark, tables).select("image_id", "part", "ordinal", "rank").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) and not exact
