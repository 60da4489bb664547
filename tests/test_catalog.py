import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quillspark.plans.catalog import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    answer = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in answer.fetchall())


def test_stem_tally_is_of_the_whole_archive(spark, duck):
    import regex

    def stem(w):
        if len(w) <= 3:
            return w
        w = w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-2] if w.endswith("sses") else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
        n = 3 if w.endswith("ing") and len(w) > 5 else 2 if w.endswith("ed") and len(w) > 4 else 0
        return regex.sub(r"([bcdfghjkmnpqrtv])\1$", r"\1", w[:-n]) if n else w

    texts = duck.execute("SELECT text FROM documents UNION ALL SELECT p_name FROM part").fetchall()
    want = Counter(stem(w.lower()) for (t,) in texts for w in regex.split(r"[\n\r\p{Z}\p{P}]+", t or "") if w)
    got = {r["stem"]: r["n"] for r in QUERIES["stem_tokens_all"](spark, str(SF)).collect()}
    assert got == want
    foreign = duck.execute("SELECT count(*) FROM documents WHERE lang IS DISTINCT FROM 'en'").fetchone()[0]
    assert foreign and any(not x.isascii() for x in got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["live_count"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" in plan.split("ReadSchema")[1] and "o_totalprice" not in plan.split("ReadSchema")[1]
