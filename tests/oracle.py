"""Spark's rows against DuckDB's over the same files."""

from pathlib import Path

import duckdb


def rows_of(table):
    return sorted(zip(*(table[c] for c in sorted(table)), strict=True), key=repr)


def check(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    own = {k: list(v) for k, v in run(spark, sf_dir).toArrow().to_pydict().items()}
    other = {k: list(v) for k, v in con.execute(sql).to_arrow_table().to_pydict().items()}
    assert sorted(own) == sorted(other)
    a, b = rows_of(own), rows_of(other)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
    return len(a)
