"""Every registered core query beside its SQL on the smallest data, where that is there."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest

from inkgrove.plans import registry

ROOT, SF = Path(__file__).parents[1], Path("/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("compare", ROOT / "tools/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not SF.exists():
        pytest.skip("no data")
    con = duckdb.connect()
    for p in sorted(SF.iterdir()):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = Counter(tuple(compare.plain(r[c]) for c in cols) for r in df.collect())
    rows = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rows.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(compare.plain(r[names.index(c)]) for c in cols) for r in rows.fetchall())


def test_entry_runs_on_any_session(spark):
    import sys

    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    if SF.exists():
        assert e.entry(spark).columns == ["raw_id", "reason"]
    assert set(e.oracle_sql()) <= set(e.queries())
