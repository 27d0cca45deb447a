"""Keys as large tables have them, and rows that an order leaves open."""

import duckdb

from plumbline.plans import ORACLES, QUERIES

LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"


def against_sql(spark, d, name, tables):
    got = QUERIES[name](spark, str(d))
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, got.collect())), sorted(c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall())


def test_outlines_whose_printed_numbers_are_the_same(spark, tmp_path):
    lines = [(3 * k + j, p, n, 5.0, 0.02, 0.01, "N") for k in range(4) for j in range(3) for n, p in ((1, 1000005), (2, 5), (2, 1000007), (3, 7), (4, 9))]
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(p, 10, "PROMO") for p in (5, 7, 9, 1000005, 1000007)], "p_partkey long, p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got, want = against_sql(spark, tmp_path, "deleted_outlines", ["lineitem", "part"])
    assert got == want and len(got) == 12 * 4


def test_attempts_that_tie_are_taken_in_one_order(spark, tmp_path):
    tied = [(k, 8, n, 5.0, disc, 0.0, "N") for k in range(40) for n in (1, 2) for disc in (0.01, 0.09, 0.04)]
    found = []
    for name, rows in (("up", tied), ("down", tied[::-1])):
        spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        found.append(sorted(map(tuple, QUERIES["accepted_attempts"](spark, str(tmp_path / name)).collect())))
    assert found[0] == found[1] and {r[:3] for r in found[0]} == {(k, 3, 0) for k in range(40)}
