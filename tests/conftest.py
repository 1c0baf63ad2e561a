import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    def norm(rows, columns, order):
        def one(v):
            if v is None or isinstance(v, (bool, str, bytes)):
                return repr(v)
            return repr(float(v)) if isinstance(v, (int, float)) else str(v)

        at = [columns.index(c) for c in order]
        return sorted(tuple(one(r[i]) for i in at) for r in rows)

    def check(df, relation):
        order = sorted(df.columns)
        assert order == sorted(relation.columns)
        want = norm(relation.fetchall(), relation.columns, order)
        assert norm([tuple(r) for r in df.collect()], df.columns, order) == want
        return len(want)

    return check
