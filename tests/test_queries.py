"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from heddle.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float)):
        return (2, f"{round(float(x), 6) + 0.0:.6f}")
    return (3, str(list(x)) if isinstance(x, (list, tuple)) else str(x))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    expected = sorted(tuple(map(plain, r)) for r in want.select(*[f'"{n}"' for n in names]).fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1


@pytest.mark.parametrize("name", ["argmin_over_k", "best_per_algorithm", "global_scores", "iteration_statistics"])
def test_runs_at_midnight_and_at_ties(spark, tmp_path, name):
    """Events of a day's last half second are of that day; means that tie at the last decimal agree to it."""
    import duckdb

    at = str(tmp_path / "events.parquet")
    late = "SELECT u AS user_id, TIMESTAMP '2024-01-07 23:59:59.7' AS ts, CASE WHEN u % 2 = 0 THEN -1.0 ELSE 100.0 * u END AS value FROM range(1, 40) r(u)"
    early = "SELECT u, TIMESTAMP '2024-01-02 03:00:00' + to_days(d::INT), 1.0 + u * d FROM range(1, 40) r(u), range(3) s(d)"
    ties = "SELECT u, TIMESTAMP '2024-01-03 03:00:00', ((u * 37 * i) % 1009) / 100.0 FROM range(100, 400) r(u), range(1, 33) s(i)"
    c = duckdb.connect()
    c.sql(f"COPY ({late} UNION ALL {early} UNION ALL {ties}) TO '{at}' (FORMAT parquet)")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{at}'")
    df, want = catalogue.QUERIES[name](spark, str(tmp_path)), c.sql(catalogue.SQL[name])
    names = sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(want.select(*names).fetchall())
