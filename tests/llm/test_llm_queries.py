"""Every query of the subpackage against its SQL, or run over whole tables."""

import pytest

from sieveline.llm import queries
from tests.helpers import connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, tables, con, name):
    df = queries.QUERIES[name](spark, tables)
    want, columns = sql_rows(con, queries.ORACLE[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == want


#: What the rows of queries without SQL must hold.
CLAIMS = {
    "p2_assign": lambda rows: len({r["image_id"] for r in rows}) == len(rows) > 100 and {r["part"] for r in rows} == {"train", "validation", "test", "reserve"},
    "p2_shares": lambda rows: abs(sum(r["share"] for r in rows) - 1) < 1e-9 and all(abs(r["share"] - r["target_share"]) < 0.05 for r in rows),
    "p2_spread": lambda rows: len(rows) == 1 and 0 < rows[0]["bins"] <= 256 and rows[0]["least"] <= rows[0]["mean"] <= rows[0]["most"],
    "p6_pack": lambda rows: max(_sums(rows, "container", "tokens").values()) <= 4096 and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) > 50,
    "p6_fill": lambda rows: sum(r["tokens"] for r in rows) / sum(4096 * r["containers"] for r in rows) > 0.8,
    "p7_mix": lambda rows: len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) > 20 and all(r["tokens"] > 0 for r in rows),
    "p7_shares": lambda rows: len(rows) == 20 and abs(sum(r["share"] for r in rows) - 1) < 1e-9 and abs(sum(r["attainable_share"] for r in rows) - 1) < 1e-6,
    "p8_found": lambda rows: 0 < len({r["doc_id"] for r in rows}) == len(rows) < 40,
    "p8_shares": lambda rows: all(0 <= r["share"] <= 1 and r["cut_texts"] <= r["texts"] for r in rows) and sum(r["texts"] for r in rows) > 80,
}


def _sums(rows, key, value):
    out = {}
    for r in rows:
        out[r[key]] = out.get(r[key], 0) + r[value]
    return out


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows_hold_what_they_claim(spark, tables, name):
    assert CLAIMS[name](queries.QUERIES[name](spark, tables).collect())
