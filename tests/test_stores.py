import datetime as dt

import pytest

from graphloom.operators import store
from graphloom.sources import stores


def test_parquet_store_prunes_by_predicate(spark, tmp_path):
    rows = [(f"s{i}", "knows" if i % 2 else "likes", f"o{i}", 1.0, dt.datetime(2024, 1, 1)) for i in range(20)]
    t = store.triples(spark.createDataFrame(rows, "s string, p string, o string, w double, ts timestamp_ntz"))
    stores.save(t, str(tmp_path / "kg"))
    back = stores.load(spark, str(tmp_path / "kg"))
    assert sorted(r.id for r in back.collect()) == sorted(r.id for r in t.collect())
    plan = store.match(back, predicate="knows")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predicate" in plan and store.match(back, predicate="knows").count() == 10


def test_json_and_functions(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert stores.to_json(df).first().json == '{"n":1,"s":"a"}'
    stores.register_functions(spark)
    r = spark.sql("SELECT cosine_sim(array(1D, 0D), array(1D, 1D)) AS c, cosine_sim(array(0D), array(1D)) AS z, unit_score(0D) AS u, nearness_score(5) AS n, support_score(30) AS s").first()
    assert tuple(r) == pytest.approx((2**-0.5, 0, 0.5, 0.5, 1))


def test_settings(tmp_path):
    f = tmp_path / "x.toml"
    f.write_text("[graphloom]\nmax_triples = 7\ndamping = 0.5\n")
    s = stores.settings(str(f), {"GRAPHLOOM_DAMPING": "0.6"}, iterations=3)
    assert (s.max_triples, s.damping, s.iterations, s.target) == (7, 0.6, 3, 0.8)
    for bad in ({"target": 2.0}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            stores.settings(None, {}, **bad)
