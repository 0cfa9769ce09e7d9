from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same(rows: list[dict], sql: str, folder: str) -> None:
    """The rows are those of the SQL over the Parquet tables of a folder."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if Path(f'{folder}/{t}.parquet').is_dir() else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    plain = lambda v: round(float(v), 9) + 0.0 if isinstance(v, (int, float)) else v if v is None else str(v)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in got.fetchall()), key=repr)
    assert all(sorted(r) == sorted(names) for r in rows)
    assert sorted((tuple(plain(v) for _, v in sorted(r.items())) for r in rows), key=repr) == want
