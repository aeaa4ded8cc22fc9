import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="reviewlane-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Assert that a query gives the rows of its SQL, columns sorted by name, rows in any order."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")

    def plain(x):
        if isinstance(x, float):
            return ("f", repr(x + 0.0))
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        return ("n", "") if x is None else (type(x).__name__, str(x))

    def check(query, sql, at=sf):
        found = query(spark, at)
        columns = sorted(found.columns)
        got = sorted(tuple(map(plain, r)) for r in found.select(columns).collect())
        asked = con.execute(sql)
        names = [d[0] for d in asked.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        want = sorted(tuple(plain(r[i]) for i in order) for r in asked.fetchall())
        assert len(got) == len(want)
        wrong = [(g, w) for g, w in zip(got, want) if g != w]
        assert not wrong, wrong[:3]

    return check
