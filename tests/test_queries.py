"""Every query against its SQL, over whole small tables."""

import pytest

from sieveline.plans import catalogue
from tests.helpers import connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, tables, con, name):
    df = catalogue.QUERIES[name](spark, tables)
    want, columns = sql_rows(con, catalogue.ORACLE[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == want


#: What the rows of queries without SQL must hold.
CLAIMS = {
    "e_evaluate": lambda rows: len(rows) == 8 and all(r["low"] <= r["auc"] <= r["high"] and r["passes"] == (r["upper"] <= 0.55) for r in rows),
    "q_p8_analysis": lambda rows: any(r["compressed"] for r in rows) and all(r["stored_bytes"] <= r["message_bytes"] and r["fits"] == (r["deficit_bytes"] == 0) for r in rows),
    "k1_cover_hashes": lambda rows: len({r["pixel_sha256"] for r in rows}) == 12,
    "k5_features": lambda rows: all(r["n"] == 8177 and r["adjacent_bins"] <= 0 for r in rows) and len(rows) > 100,
    "k5_cover_features": lambda rows: len(rows) == 12 and all(r["n"] == 8177 for r in rows),
    "k6_control": lambda rows: all(r["low_bit_only"] for r in rows) and 0.15 < sum(r["changed"] for r in rows) / (72 * len(rows)) < 0.25,
    "k15_balance": lambda rows: len(rows) == 12 and all(r["lowered"] and r["turns"] > 0 for r in rows),
    "m3_subspace": lambda rows: len({r["vec_id"] for r in rows}) == len(rows) and any(r["score"] for r in rows),
    "m4_forest": lambda rows: len(rows) > 10 and all(0 <= r["score"] <= 1 for r in rows),
    "m8_harness": lambda rows: len(rows) == 1 and 0 <= rows[0]["equal_prior_error"] <= 1,
    "p4_commit": lambda rows: len(rows) == 1 and rows[0]["rows"] > 100 and rows[0]["files"] >= 1,
    "q_p7_stored_sizes": lambda rows: all(r["flag"] in (0, 1) for r in rows) and any(r["flag"] for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows_hold_what_they_claim(spark, tables, name):
    assert CLAIMS[name](catalogue.QUERIES[name](spark, tables).collect())


def test_entry_works_with_and_without_the_optional_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
