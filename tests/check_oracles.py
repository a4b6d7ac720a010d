"""Runs registered queries next to their oracles: python tests/check_oracles.py [sf_dir] [name part ...]."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import duckdb
import pandas as pd

import __spark_entry__ as entry
from sensitext.settings import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def plain(value):
    if pd.isna(value):
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            t1 = time.time()
            note = f"{name:38s} {len(got):7d} rows  spark {t1 - t0:6.2f}s"
            if name in oracles:
                want = con.execute(oracles[name]).df()
                a, b = rows(got), rows(want)
                note += f"  duck {time.time() - t1:6.2f}s  " + ("ok" if a == b else "DIFFERENT")
                types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if c in want}
                odd = {c: t for c, t in types.items() if t[0] != t[1] and "datetime" not in t[0]}
                if odd:
                    note += f" types {odd}"
                if a != b:
                    failed.append(name)
                    print(a[0], b[0], len(a[1]), len(b[1]))
                    print(" spark only", [r for r in a[1] if r not in set(b[1])][:3])
                    print(" duck only ", [r for r in b[1] if r not in set(a[1])][:3])
            print(note, flush=True)
        except Exception as error:
            failed.append(name)
            print(name, "ERROR", str(error)[:1500], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
