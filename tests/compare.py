"""Run registered queries against their SQL twins: ``python tests/compare.py [names]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(x):
        return round(x + 0.0, 6) if isinstance(x, float) else x
    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr), sorted(columns)


def main(names, sf_dir):
    import __spark_entry__ as e

    spark, con = session(), duck(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got, cols = normal(df.collect(), df.columns)
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(err).__name__} {str(err)[:600]}", flush=True)
            continue
        took, line = time.time() - t, f"{name}: {len(got)} rows"
        if name in oracle:
            t = time.time()
            try:
                res = con.execute(oracle[name])
                want, wcols = normal(res.fetchall(), [c[0] for c in res.description])
                same = got == want and cols == wcols
                bad += not same
                line = ("ok   " if same else "DIFF ") + line + f", sql {len(want)} in {time.time() - t:.1f}s"
                if not same:
                    extra = [r for r in got if r not in set(want)][:3]
                    missing = [r for r in want if r not in set(got)][:3]
                    line += f"\n     {cols} {wcols}\n     extra {extra}\n     missing {missing}"
            except Exception as err:  # noqa: BLE001
                bad += 1
                line = f"SQL? {line} {str(err)[:600]}"
        else:
            line = "rows " + line
        print(f"{line} ({took:.1f}s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01"))))
