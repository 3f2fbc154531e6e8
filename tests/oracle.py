"""Runs a registered query and its DuckDB statement on the same tables and compares the rows."""

import glob
import os

import duckdb

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


def duck(sf_dir=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return con


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        if type(v).__name__ == "Decimal":
            return round(float(v), 9) + 0.0
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(df, sql, sf_dir=SF):
    con = duck(sf_dir)
    rel = con.sql(sql)
    want, wcols = norm(rel.fetchall(), rel.columns)
    got, gcols = norm([tuple(r) for r in df.collect()], df.columns)
    assert gcols == wcols, (gcols, wcols)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
