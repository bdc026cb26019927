"""Check that the DataFrame fixture views equal the SQL text on DuckDB."""
import sys
import duckdb
from claimlens.session import local_session
from claimlens.sources import fixtures

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = local_session()
con = duckdb.connect()
for t in ["orders", "customer", "lineitem"]:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
for name, fn, sql in [("claims", fixtures.claims, fixtures.CLAIMS_SQL),
                      ("diagnoses", fixtures.diagnoses, fixtures.DIAGNOSES_SQL),
                      ("procedures", fixtures.procedures, fixtures.PROCEDURES_SQL)]:
    sdf = fn(spark, sf).toPandas()
    ddf = con.execute(sql).df()
    cols = sorted(sdf.columns)
    a = sdf[cols].astype(str).sort_values(cols).reset_index(drop=True)
    b = ddf[cols].astype(str).sort_values(cols).reset_index(drop=True)
    print(name, len(sdf), len(ddf), (a.values == b.values).all() if len(a) == len(b) else "len differ")
