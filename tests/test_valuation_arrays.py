"""Monte Carlo figures of a group are made from its draws as arrays; no draw becomes a row."""

import numpy as np
import pytest

from marketlens.plans import valuation as va

BASE = ("ticker string, base_fcff double, net_debt double, shares_outstanding double, price double, status string")
ROWS = [("A", 100.0, 10.0, 5.0, 20.0, "ok"), ("A", 90.0, 10.0, 5.0, 20.0, "ok"), ("B", None, None, None, 3.0, "no_ebit"),
        ("C", 80.0, None, 5.0, 1.0, "ok"), ("D", -70.0, 1.5, 4.0, None, "ok"), (None, 60.0, 1.0, 2.0, 5.0, "ok")]
SCENARIOS = [{"sims": 300}, {"scenario_id": 2, "sims": 70, "wacc_min": 1.0, "wacc_mode": 2.0, "wacc_max": 4.0}, {"scenario_id": 3, "sims": 0}]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_rows(base):
    got = {}
    for r in va.intrinsic_values(va.draws(base, SCENARIOS)).collect():
        got.setdefault((r.ticker, r.scenario_id), []).append(r.intrinsic_value)
    return got


def test_summary_of_arrays_is_that_of_rows(spark, monkeypatch):
    monkeypatch.setattr(va, "CHUNK", 64)
    base = spark.createDataFrame(ROWS, BASE)
    want, out = by_rows(base), va.monte_carlo_dcf(base, SCENARIOS)
    assert "sha2(" not in plan(out)
    got = {(r.ticker, r.scenario_id): r for r in out.collect()}
    assert len(got) == out.count() == 5 * 3 and got["A", 1].n_valid == 600
    for key, r in got.items():
        v = want.get(key, [])
        assert r.n_valid == len(v), key
        if v:
            assert (r.mean, r.p10, r.median, r.p90) == pytest.approx((np.mean(v), *np.percentile(v, [10, 50, 90])), rel=1e-12)
            assert r.status == "ok"
        else:
            assert r.mean is None and r.status == ("no_ebit" if r.ticker == "B" else va.NO_VALUE)


def test_histogram_of_arrays_is_that_of_rows(spark):
    base = spark.createDataFrame(ROWS, BASE)
    out = va.histogram(base, SCENARIOS, bins=7)
    assert "sha2(" not in plan(out)
    got = {}
    for r in out.collect():
        got.setdefault((r.ticker, r.scenario_id), {})[r.bin] = (r.n, r.bin_start)
    want = {k: v for k, v in by_rows(base).items() if k[0] is not None}
    assert got.keys() == want.keys()
    for key, v in want.items():
        lo, hi = min(v), max(v)
        bins = [min(int(np.floor((x - lo) / (hi - lo) * 7)) + 1, 7) if hi > lo else 1 for x in v]
        assert got[key] == {b: (bins.count(b), pytest.approx(lo + (b - 1) * (hi - lo) / 7)) for b in set(bins)}
