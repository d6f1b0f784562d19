from math import gcd

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import planner as pl

N = 512 * 512


def plan(spark, stored, keyed, rate, message=None):
    df = spark.createDataFrame([(message or stored, stored, False, N, keyed, rate)], "message_bytes long, stored_bytes long, compressed boolean, pixels long, keyed boolean, rate string")
    return pl.plan(df).head()


@pytest.mark.parametrize(("rate", "room"), [("0.05", 1572), ("0.025", 753), ("0.01", 261), ("0.005", 97), ("0.2", 6487)])
def test_capacities(spark, rate, room):
    assert plan(spark, 5, True, rate)["chosen"]["capacity_bytes"] == room


def test_known_rates(spark):
    p = plan(spark, 32, True, "auto")
    assert p["chosen"]["chosen_rate"] == "49/16384" and p["chosen"]["fits"] and p["chosen"]["supported"]
    assert not plan(spark, 7000, True, "auto")["suggested"]["supported"]
    df = spark.createDataFrame([("43/16384", N, "0.00262452"), ("9163/119200", 953600, "0.07687081"), ("0.05", N, "0.05000000")], "r string, n long, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", pl.decimal_rate(pl.rate_of(F.col("r")), F.col("n")).alias("got")).collect())
    assert plan(spark, 7000, True, "auto")["suggested"]["suggested_rate"] == "3533/16384"


def test_components_sum_to_the_frame(spark):
    for keyed in (True, False):
        for rate, n in (("0.05", 5), ("auto", 5), ("0.01", 20)):
            c = plan(spark, n, keyed, rate)["chosen"]
            assert c["frame_bytes"] == c["salt_bytes"] + c["header_bytes"] + c["stored_bytes"] + c["padding_bytes"] + c["authentication_tag_bytes"] + c["checksum_bytes"]
    c = plan(spark, 20, True, "0.01")["chosen"]
    assert (round(c["net_bpp"], 8), round(c["gross_bpp"], 8), round(c["capacity_used_percent"], 2)) == (0.00061035, 0.00997925, 7.66)
    assert plan(spark, 5, True, "0.05")["chosen"]["padding_bytes"] == 1567 and plan(spark, 5, True, "auto")["chosen"]["frame_bytes"] == 81


def test_odd_rates_and_nulls(spark):
    df = spark.createDataFrame([("x",), ("1/0",), (None,), ("",), ("0.05 ",), ("1/400",)], "r string")
    assert [r[0] is None for r in df.select(pl.rate_of(F.col("r"))).collect()] == [True, True, True, True, True, False]
    assert plan(spark, 5, True, "none")["chosen"] is None


def test_gcd_and_psnr(spark):
    pairs = [(12, 18), (7, 13), (2**40, 2**33), (5, 5), (1, 10**12)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert [r[0] for r in df.select(pl.gcd(F.col("a"), F.col("b"))).collect()] == [gcd(*p) for p in pairs]
    df = spark.createDataFrame([(72,), (0,)], "c long")
    assert [r[0] for r in df.select(pl.psnr(F.lit(N), F.col("c"))).collect()] == [pytest.approx(83.742877863883), float("inf")]


def test_representation(spark):
    rows = [(b"compressible" * 1000,), (bytes(range(256)),), (b"",), (None,)]
    got = spark.createDataFrame(rows, "m binary").select(pl.choose_representation(F.col("m")).alias("c")).collect()
    assert [r["c"] and r["c"]["flag"] for r in got][:3] == [1, 0, 0]
    assert got[3]["c"] is None or got[3]["c"]["data"] is None


def test_analysis_of_messages_equals_the_command(spark):
    from sieveline import cli
    from sieveline.kernels import images

    cover = images.encode_png(np.zeros((512, 512), np.uint8))
    for message, key in ((b"HELLO" * 400, bytes(32)), (bytes(range(256)) * 8, None), (b"", None)):
        df = spark.createDataFrame([(message, N, key is not None, "0.05")], "message binary, pixels long, keyed boolean, rate string")
        got, want = pl.analyze(df).head(), cli.analyze(cover, message, key, "0.05")
        assert (got["message_bytes"], got["stored_bytes"], got["compressed"]) == (want["message_bytes"], want["stored_bytes"], want["compressed"])
        for side in ("chosen", "suggested"):
            for name in ("frame_bytes", "capacity_bytes", "fits", "supported"):
                assert got[side][name] == want[side][name]
        one = pl.prepare(df.drop("message").selectExpr("*", f"{got['message_bytes']}L as message_bytes", f"{got['stored_bytes']}L as stored_bytes", f"{str(got['compressed']).lower()} as compressed")).head()
        assert all(one[name] == got["chosen"][name] for name in (*pl.SUMMARY, "supported"))
