"""Pooling, power audit and the scorecard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.operators import pooling, power, scorecard

SCHEMA = "g string, pair_id string, nct_id string, registration_date string, log_hr double, se_log_hr double"


def grid_posterior(y, s):
    """Two-dimensional brute force over (mu, tau)."""
    mu = np.linspace(-3, 3, 3001)[:, None]
    tau = ((np.arange(600) + 0.5) * 3 / 600)[None, :]
    lp = -(mu**2) / (2 * 0.25) - tau**2 / (2 * 0.25)
    for yi, si in zip(y, s):
        v = si**2 + tau**2
        lp = lp - 0.5 * np.log(v) - (yi - mu) ** 2 / (2 * v)
    p = np.exp(lp - lp.max())
    p /= p.sum()
    marginal = p.sum(axis=1)
    order = np.argsort(-marginal)
    kept = order[np.concatenate([[0.0], np.cumsum(marginal[order])[:-1]]) < 0.95]
    return (p * mu).sum(), mu[kept.min(), 0], mu[kept.max(), 0], (p * tau).sum()


@pytest.fixture(scope="module")
def effects(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        g = "a" if i % 3 else "b"
        rows.append((g, f"p{i:03d}", f"n{i:03d}", f"20{i // 6:02d}-01-01", float(rng.normal(-0.2, 0.4)), float(rng.uniform(0.05, 0.4))))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_pool_equals_two_dimensional_integration(effects):
    df, rows = effects
    for g in "ab":
        y, s = zip(*[(r[4], r[5]) for r in rows if r[0] == g])
        mu, low, high, tau = grid_posterior(y, s)
        r = pooling.pool(df, ["g"]).filter(F.col("g") == g).first()
        assert r["n_trials"] == len(y)
        assert np.log(r["pooled_hr"]) == pytest.approx(mu, abs=1e-4)
        assert r["tau_mean"] == pytest.approx(tau, abs=1e-3)
        assert np.log(r["pooled_hr_cri_lower"]) == pytest.approx(low, abs=6e-3)
        assert np.log(r["pooled_hr_cri_upper"]) == pytest.approx(high, abs=6e-3)


@pytest.mark.parametrize("ranges", [1, 4, 13])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_prefixes_equal_full_pooling_of_first_rows(effects, ranges, group):
    df, rows = effects
    out = pooling.pool_prefixes(df, group, ranges=ranges).collect()
    assert len(out) == len(rows)
    position = {}
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        key = r[0] if group else None
        position.setdefault(key, []).append(r[1])
    for key, order in position.items():
        numbered = {r["pair_id"]: r for r in out if r["pair_id"] in set(order)}
        assert [numbered[p]["n_trials"] for p in order] == list(range(1, len(order) + 1))
        for n in (1, 7, len(order)):
            first = df.filter(F.col("pair_id").isin(order[:n]))
            want = pooling.pool(first).first()
            got = numbered[order[n - 1]]
            assert got["mu_mean"] == pytest.approx(want["pooled_hr"], rel=1e-9)
            assert got["tau_mean"] == pytest.approx(want["tau_mean"], rel=1e-9)
            assert got["mu_hdi_lower"] == pytest.approx(want["pooled_hr_cri_lower"], rel=1e-6)
            assert got["mu_hdi_upper"] == pytest.approx(want["pooled_hr_cri_upper"], rel=1e-6)


def fine_tau(y, s):
    """Mean and deviation of tau by a grid around the mode, mu integrated analytically."""
    def log_p(tau):
        w = 1 / (s[None, :] ** 2 + tau[:, None] ** 2)
        prec = 4 + w.sum(axis=1)
        m = (w * y).sum(axis=1) / prec
        return 0.5 * np.log(w).sum(axis=1) - 0.5 * np.log(prec) - 0.5 * ((w * y * y).sum(axis=1) - prec * m * m) - tau**2 / 0.5

    low, high = 0.0, 3.0
    points, weights = np.polynomial.legendre.leggauss(600)
    for _ in range(4):
        tau = low + (points + 1) / 2 * (high - low)
        lp = np.concatenate([log_p(tau[a : a + 50]) for a in range(0, 600, 50)])
        p = weights * np.exp(lp - lp.max())
        p /= p.sum()
        mean = (p * tau).sum()
        sd = np.sqrt((p * (tau - mean) ** 2).sum())
        live = tau[lp > lp.max() - 50]
        first, last = np.searchsorted(tau, live[0]), np.searchsorted(tau, live[-1])
        low, high = tau[first - 1] if first else low, tau[last + 1] if last < 599 else high
    return mean, sd


@pytest.mark.parametrize("n", [20, 2_000, 20_000, 100_000])
@pytest.mark.parametrize("true_tau", [0.3, 0.02])
def test_posterior_of_tau_at_any_size(n, true_tau):
    rng = np.random.default_rng(n)
    s = rng.uniform(0.05, 0.4, n)
    y = rng.normal(-0.2, true_tau, n) + rng.normal(0, s)
    sums = sum(pooling._terms(y[a : a + 1000], s[a : a + 1000]).sum(axis=1) for a in range(0, n, 1000))
    got = pooling._summaries(sums[:, None, :], True).iloc[0]
    mean, sd = fine_tau(y, s)
    assert got["tau_mean"] == pytest.approx(mean, abs=5e-6) and got["tau_sd"] == pytest.approx(sd, abs=5e-6)
    assert got["mu_hdi_lower"] < got["mu_mean"] < got["mu_hdi_upper"]


def test_single_normal_interval(frame):
    # With one very precise trial mu is close to normal around the shrunken mean.
    r = pooling.pool(frame(SCHEMA, [("a", "p", "n", "2020-01-01", -0.2, 0.05)])).first()
    assert r["pooled_hr_cri_lower"] < r["pooled_hr"] < r["pooled_hr_cri_upper"]


def test_empty_input(frame):
    empty = frame(SCHEMA, [])
    assert pooling.pool(empty).count() == 0
    assert pooling.pool(empty, ["g"]).count() == 0
    assert pooling.pool_prefixes(empty).count() == 0


def test_poolable(frame):
    effects = frame("pair_id string, v int", [("a", 1), ("b", 2), ("c", 3)])
    log = frame("pair_id string, human_poolable string, human_decision string", [("a", "True", "confirm"), ("b", "TRUE", "defer"), ("c", "", "")])
    assert {r["pair_id"] for r in pooling.poolable_effects(effects, log).collect()} == {"a", "b"}
    assert {r["pair_id"] for r in pooling.poolable_effects(effects, log, ["confirm"]).collect()} == {"a"}


def test_back_calculation(frame):
    df = frame("n long, r double", [(5000, 0.15), (200, 0.15), (1000, 0.20), (1000, 0.15), (0, 0.15)])
    got = [r[0] for r in df.select(power.implied_ratio(F.col("n"), F.col("r"))).collect()]
    assert got == [0.8150, 0.3595, 0.6729, 0.6329, None]


def test_power_audit(frame):
    posts = frame("registration_date string, n_trials long, mu_mean double", [("2020-01-01", 1, 0.9), ("2020-06-01", 2, 0.8), ("2020-06-01", 3, 0.7), ("2020-08", 4, 0.1)])
    trials = frame(
        "nct_id string, enrollment string, registration_date string",
        [("a", "1000", "2020-01-01"), ("b", "1000.0", "2020/06/01"), ("c", "1000", "2020-06-02T00:00"), ("d", "1000", "2020-07"), ("e", "abc", "2021-01-01"), ("f", "0", "2021-01-01"), ("g", None, "2021-01-01"), ("h", "0.5", "2021-01-01")],
    )
    out = power.power_audit(trials, posts)
    got = {r["nct_id"]: r for r in out.collect()}
    assert [got[k]["posterior_hr_at_registration"] for k in "abcd"] == [None, 0.9, 0.7, None]
    assert got["b"]["optimism_bias"] == pytest.approx(round(0.6329 - 0.9, 4))
    for k in "efgh":
        assert (got[k]["excluded_reason"], got[k]["enrollment"], got[k]["assumed_hr"], got[k]["optimism_bias"]) == ("missing_or_invalid_enrollment", 1, 1.0, None)
    k = power.power_kpis(out).first()
    assert (k["audited"], k["included"], k["excluded"], k["below_evidence"]) == (8, 4, 4, 2)
    assert power.scatter_pairs(out).count() == 2


def test_power_audit_by_group(frame):
    posts = frame("g string, registration_date string, n_trials long, mu_mean double", [("x", "2020-01-01", 1, 0.9), ("y", "2020-01-01", 1, 0.5)])
    trials = frame("g string, nct_id string, enrollment string, registration_date string, event_rate double", [("x", "a", "1000", "2021-01-01", 0.2), ("y", "b", "1000", "2021-01-01", None), ("z", "c", "1000", "", None)])
    got = {r["nct_id"]: (r["posterior_hr_at_registration"], r["assumed_event_rate"]) for r in power.power_audit(trials, posts, ["g"]).collect()}
    assert got == {"a": (0.9, 0.2), "b": (0.5, 0.15), "c": (None, 0.15)}


STRENGTH = [
    (0.8, 0.7, 0.9, 0, 0.0, "Gap"), (None, None, None, 9, 0.0, "Gap"), (0.8, 0.7, 0.9, 5, 19.9, "Strong"), (0.8, 0.7, 0.9, 5, 20.0, "Moderate"),
    (0.8, 0.7, 1.0, 9, 0.0, "Weak"), (0.8, 0.7, 0.9, 2, 0.0, "Weak"), (0.8, 0.7, 0.9, 1, 0.0, "Gap"), (1.5, 1.2, 1.8, 5, 0.0, "Weak"),
]


def test_evidence_strength(frame):
    df = frame("p double, l double, u double, n int, s double, want string", STRENGTH)
    got = df.select("want", scorecard.evidence_strength(*[F.col(c) for c in "plu"], F.col("n"), F.col("s")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_scorecard(frame):
    log = frame(
        "pair_id string, human_poolable string, human_reviewed string, human_decision string, ssi string, llm_switch_type string, human_final_class string",
        [
            ("N1_1", "True", "yes", "confirm", "10", "concordant", "concordant"),
            ("N2_2", "False", "yes", "override", "30", "concordant", "major_switch"),
            ("N3_3", "", "no", "", "x", "", ""),
        ],
    )
    log = log.withColumn("endpoint_cluster", F.lit("os")).unionByName(log.limit(0).withColumn("endpoint_cluster", F.lit("")))
    other = frame("pair_id string, endpoint_cluster string", [("N9_9", "only_here")])
    log = log.unionByName(other, allowMissingColumns=True)
    links = frame("nct_id string, linkage_confidence string", [("N3", "Unlinked"), ("N3", "Unlinked"), ("N1", "High"), ("N7", "Unlinked")])
    pooled = frame("endpoint_cluster string, pooled_hr double, pooled_hr_cri_lower double, pooled_hr_cri_upper double, tau_mean double", [("os", 0.8, 0.7, 0.9, 0.2)])
    effects = frame("pair_id string, se_log_hr double", [("N1_1", 0.1), ("N2_2", 0.3)])
    bias = frame("nct_id string, optimism_bias string, audit_timestamp string", [("N1", "0.5", "1"), ("N1", "0.1", "2"), ("N2", "0.3", "1"), ("N3", "", "1")])
    got = {r["endpoint_cluster"]: r for r in scorecard.build_scorecard(log, links, pooled, effects, bias).collect()}
    r = got["os"]
    assert (r["trials_included"], r["trials_excluded"], r["trials_unlinked"], r["human_override_rate_pct"]) == (1, 1, 2, 50.0)
    assert (r["mean_ssi"], r["human_confirmed_switch_rate_pct"], r["ai_human_agreement_rate_pct"]) == (20.0, 33.3, 50.0)
    assert r["i_squared_pct"] == pytest.approx(round(0.04 / 0.09 * 100, 1)) and r["mean_optimism_bias"] == 0.2
    assert r["evidence_strength"] == "Gap"
    assert got["only_here"]["trials_included"] == 0 and got["only_here"]["evidence_strength"] == "Gap"
    parity = scorecard.build_scorecard(log, links, parity=True).filter("endpoint_cluster = 'os'").first()
    assert parity["ai_human_agreement_rate_pct"] == 66.7
