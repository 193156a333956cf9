"""Random-effects pooling by quadrature: full-data and prefix (sequential) posteriors.

Model: y_i ~ N(theta_i, s_i^2), theta_i ~ N(mu, tau^2), mu ~ N(m0, sd0^2), tau ~ HalfNormal.
With theta integrated out, y_i ~ N(mu, s_i^2 + tau^2), and mu given tau is normal. At each of a fixed
set of tau nodes every quantity is a function of four sums over the trials (w, w*y, w*y^2, ln w with
w = 1 / (s^2 + tau^2)). Sums combine, so pooling needs one aggregation and no sampler.

The posterior of tau narrows with the number of trials, the nodes do not. So the log posterior, which
is smooth between nodes however large it gets, is interpolated to a grid of its own around each
posterior's bulk. Both kinds of pooling share that one summary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from attestor import presets
from attestor.functions.text import truthy
from attestor.operators.ordered import PART, ROW, split_by_range
from attestor.session import materialise

TAU_NODES = 400
TAU_MAX = 3.0
#: Points of a posterior's own tau grid; it ends where the log density is this far below its top.
TAU_POINTS = 128
NEGLIGIBLE = 50.0
MU_CELLS = 400
MU_SPREAD = 5.0
HDI_MASS = 0.95
#: Rows of one range: with intervals a prefix costs a pass over the tau x mu grid.
PREFIXES_PER_RANGE = 5_000
MEANS_PER_RANGE = 100_000
#: Groups a task sums up before it passes them on.
HELD_GROUPS = 200
SUMS = ("sw", "swy", "swyy", "slw")

#: Nodes are even in asinh(tau / TAU_SCALE): dense near 0, where small errors make the posterior bend, wide further out.
TAU_SCALE = 0.005
_STEP = math.asinh(TAU_MAX / TAU_SCALE) / TAU_NODES
_NODES = TAU_SCALE * np.sinh((np.arange(TAU_NODES) + 0.5) * _STEP)
_V0, _M0 = presets.PRIOR_MU_SD**2, presets.PRIOR_MU_MEAN


def poolable_effects(effects: DataFrame, log: DataFrame, decisions: Sequence[str] | None = None) -> DataFrame:
    """Effects whose pair a reviewer approved; optionally only under the given decisions."""
    approved = log.filter(F.lower(F.col("human_poolable")) == "true")
    if decisions:
        approved = approved.filter(F.col("human_decision").isin(*decisions))
    return effects.join(approved.select("pair_id"), "pair_id", "left_semi")


def _terms(y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The four additive terms of each trial: shape (4, trials, nodes)."""
    w = 1.0 / (s[:, None] ** 2 + _NODES[None, :] ** 2)
    wy = w * y[:, None]
    return np.stack([w, wy, wy * y[:, None], np.log(w)])


def _interpolated(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Degree-5 interpolation of node values (posteriors, nodes) at ``at`` (posteriors, points), in units of asinh.

    Everything here is even in tau, so nodes below 0 mirror those above.
    """
    x = at / _STEP - 0.5
    first = np.minimum(np.floor(x).astype(int) - 2, TAU_NODES - 6)
    t = x - first
    out = np.zeros_like(at)
    for j in range(6):
        weight = np.ones_like(t)
        for k in range(6):
            if k != j:
                weight *= (t - k) / (j - k)
        node = first + j
        out += weight * np.take_along_axis(values, np.where(node < 0, -1 - node, node), axis=1)
    return out


_POINTS, _WEIGHTS = np.polynomial.legendre.leggauss(TAU_POINTS)


def _points(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Gauss-Legendre points between ``low`` and ``high``."""
    return low[:, None] + 0.5 * (_POINTS + 1.0)[None, :] * (high - low)[:, None]


def _summaries(sums: np.ndarray, interval: bool) -> pd.DataFrame:
    """Posterior summaries from sums of shape (4, posteriors, nodes)."""
    sw, swy, swyy, slw = sums
    prec = 1.0 / _V0 + sw
    m = (_M0 / _V0 + swy) / prec
    lp = 0.5 * slw - 0.5 * np.log(prec) - 0.5 * (swyy + _M0 * _M0 / _V0 - prec * m * m)
    lp = lp - _NODES**2 / (2 * presets.PRIOR_TAU_SD**2)
    lp = lp - lp.max(axis=1, keepdims=True)

    def bulk(values: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The borders around all values that are not negligible."""
        live = values > values.max(axis=1, keepdims=True) - NEGLIGIBLE
        rows = np.arange(len(live))
        return border[rows, live.argmax(axis=1)], border[rows, live.shape[1] + 1 - live[:, ::-1].argmax(axis=1)]

    ends = np.concatenate(([0.0], (np.arange(TAU_NODES) + 0.5) * _STEP, [TAU_NODES * _STEP]))
    low, high = bulk(lp, np.broadcast_to(ends, (len(lp), len(ends))))
    for _ in range(2):  # a posterior may be narrower than the nodes are apart
        u = _points(low, high)
        low, high = bulk(_interpolated(lp, u), np.concatenate([low[:, None], u, high[:, None]], axis=1))
    u = _points(low, high)
    tau = TAU_SCALE * np.sinh(u)
    p = _interpolated(lp, u)
    p = np.exp(p - p.max(axis=1, keepdims=True)) * np.cosh(u) * _WEIGHTS[None, :]
    p /= p.sum(axis=1, keepdims=True)
    tau_mean = (p * tau).sum(axis=1)
    tau_sd = np.sqrt(np.maximum((p * (tau - tau_mean[:, None]) ** 2).sum(axis=1), 0.0))
    m, prec = _interpolated(m, u), _interpolated(prec, u)
    mu = (p * m).sum(axis=1)
    sd = np.sqrt(np.maximum((p * (1.0 / prec + (m - mu[:, None]) ** 2)).sum(axis=1), 1e-300))
    out = {"mu_mean": np.exp(mu)}
    if interval:
        step = sd * (2 * MU_SPREAD / MU_CELLS)
        k = np.arange(MU_CELLS)
        at = mu[:, None] + (k + 0.5 - MU_CELLS / 2)[None, :] * step[:, None]
        gap = at[:, :, None] - m[:, None, :]
        density = (np.exp(-0.5 * prec[:, None, :] * gap * gap) * (p * np.sqrt(prec / (2 * math.pi)))[:, None, :]).sum(axis=2)
        # Densest cells first until they hold the mass, then their ends.
        order = np.argsort(-density, axis=1, kind="stable")
        ranked = np.take_along_axis(density, order, axis=1)
        before = (np.cumsum(ranked, axis=1) - ranked) / density.sum(axis=1, keepdims=True)
        kept = np.zeros(density.shape, bool)
        np.put_along_axis(kept, order, before < HDI_MASS, axis=1)
        first, last = kept.argmax(axis=1), MU_CELLS - 1 - kept[:, ::-1].argmax(axis=1)
        out["mu_hdi_lower"] = np.exp(mu + (first - MU_CELLS / 2) * step)
        out["mu_hdi_upper"] = np.exp(mu + (last + 1 - MU_CELLS / 2) * step)
    return pd.DataFrame({**out, "tau_mean": tau_mean, "tau_sd": tau_sd})


def _long(count: int, sums: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of shape (4, nodes) as columns, one row per node."""
    return {"cell": np.arange(TAU_NODES, dtype=np.int32), "n": np.full(TAU_NODES, count), **dict(zip(SUMS, sums, strict=True))}


_LONG = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in SUMS]])


def node_sums(effects: DataFrame, group: Sequence[str], y: str = "log_hr", se: str = "se_log_hr") -> DataFrame:
    """Per group and node: the number of trials and the four sums, added up in each task first."""
    rows = effects.select(*group, F.col(y).cast("double").alias("_y"), F.col(se).cast("double").alias("_s"))
    schema = T.StructType([*[rows.schema[c] for c in group], *_LONG])
    names = list(group)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}

        def passed_on() -> Iterator[pd.DataFrame]:
            for key, (count, sums) in held.items():
                yield pd.DataFrame({**{c: [v] * TAU_NODES for c, v in zip(names, key, strict=True)}, **_long(count, sums)})

        for frame in frames:
            parts = frame.groupby(names, dropna=False, sort=False) if names else [((), frame)]
            for key, part in parts:
                key = tuple(None if pd.isna(v) else v for v in (key if isinstance(key, tuple) else (key,)))
                count, sums = held.get(key, (0, np.zeros((4, TAU_NODES))))
                for a in range(0, len(part), 512):
                    chunk = part.iloc[a : a + 512]
                    sums = sums + _terms(chunk["_y"].to_numpy(float), chunk["_s"].to_numpy(float)).sum(axis=1)
                held[key] = (count + len(part), sums)
                if len(held) > HELD_GROUPS:
                    yield from passed_on()
                    held.clear()
        yield from passed_on()

    sums = rows.mapInPandas(run, schema)
    return sums.groupBy(*group, "cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])


def pool(effects: DataFrame, group: Sequence[str] = (), y: str = "log_hr", se: str = "se_log_hr") -> DataFrame:
    """Full-data posterior summary per group, on the ratio scale, with the 95 % HDI."""
    totals = node_sums(effects, group, y, se)
    names = list(group)
    values = ("pooled_hr", "pooled_hr_cri_lower", "pooled_hr_cri_upper", "tau_mean", "tau_sd")
    schema = T.StructType(
        [*[totals.schema[c] for c in group], T.StructField("n_trials", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in values]]
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell")  # one row per node
        out = _summaries(frame[list(SUMS)].to_numpy(float).T[:, None, :], True)
        out = out.rename(columns={"mu_mean": "pooled_hr", "mu_hdi_lower": "pooled_hr_cri_lower", "mu_hdi_upper": "pooled_hr_cri_upper"})
        out["n_trials"] = int(frame["n"].iloc[0])
        for c in names:
            out[c] = frame[c].iloc[:1].to_numpy()
        return out[[*names, "n_trials", *values]]

    keyed = totals if group else totals.withColumn("_all", F.lit(0))
    return keyed.groupBy(*(group or ["_all"])).applyInPandas(one, schema)


# --- prefix posteriors -------------------------------------------------------------------------


def _segments(frame: pd.DataFrame, group: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal group values, in row order."""
    if not group:
        yield (), frame
        return
    keys = frame[list(group)].astype(object).where(frame[list(group)].notna(), None)
    change = (keys != keys.shift()).any(axis=1) & ~(keys.isna() & keys.shift().isna()).all(axis=1)
    change.iloc[0] = True
    starts = np.flatnonzero(change.to_numpy())
    for a, b in zip(starts, [*starts[1:], len(frame)]):
        yield tuple(keys.iloc[a]), frame.iloc[a:b]


def _range_ends(split: DataFrame, group: Sequence[str], y: str, se: str) -> DataFrame:
    """Per range: its first and last group, and the node sums of the last one's rows in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = part = None
        total, count = np.zeros((4, TAU_NODES)), 0
        for frame in frames:
            for key, rows in _segments(frame, group):
                if last is None or key != last:
                    total, count = np.zeros((4, TAU_NODES)), 0
                    first = key if first is None else first
                    last, part = key, int(rows[PART].iloc[0])
                for a in range(0, len(rows), 512):
                    chunk = rows.iloc[a : a + 512]
                    total += _terms(chunk[y].to_numpy(float), chunk[se].to_numpy(float)).sum(axis=1)
                count += len(rows)
        if last is not None:
            yield pd.DataFrame({"part": np.full(TAU_NODES, part, np.int32), "first": repr(first), "last": repr(last), **_long(count, total)})

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), *_LONG])
    return split.mapInPandas(run, schema)


def _carried(ends: DataFrame) -> DataFrame:
    """``part, carried``: per range, the node sums of its first group's rows in earlier ranges.

    Ranges are sorted, so the ranges whose last group is g come right before the one in which g ends.
    """
    before = Window.partitionBy("last", "cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    added = ("n", *SUMS)
    inside = ends.select("part", "first", "last", "cell", *[F.sum(c).over(before).alias(c) for c in added])
    inside = inside.filter((F.col("first") == F.col("last")) & F.col("n").isNotNull()).select("part", "cell", *added)
    totals = ends.groupBy(F.col("last").alias("first"), "cell").agg(*[F.sum(c).alias(c) for c in added])
    ending = ends.filter(F.col("first") != F.col("last")).select("part", "first", "cell").join(totals, ["first", "cell"])
    both = inside.unionByName(ending.select("part", "cell", *added))
    return both.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("cell", *added))).alias("carried"))


def pool_prefixes(
    effects: DataFrame,
    group: Sequence[str] = (),
    order: Sequence[str] = ("registration_date", "pair_id"),
    carry: Sequence[str] = ("pair_id", "nct_id", "registration_date"),
    y: str = "log_hr",
    se: str = "se_log_hr",
    interval: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """One posterior per prefix of each group in ``order`` (which must end in a unique key).

    ``interval=False`` leaves out the HDI, by far the costliest column, for users of the mean only.

    Rows are range-partitioned by (group, order), as many ranges as there are rows for, so a group of any
    size is spread over tasks. A first pass sums the last group of each range; these sums are added
    up over the ranges by windows, and each range starts from what came before it.
    """
    columns = list(dict.fromkeys([*group, *order, *carry, y, se]))
    rows = materialise(effects.select(*columns))
    if ranges is None:
        ranges = max(1, -(-rows.count() // (PREFIXES_PER_RANGE if interval else MEANS_PER_RANGE)))
    split = split_by_range(rows, [*group, *order], ranges)
    carried = _carried(_range_ends(split, group, y, se))

    shown = list(dict.fromkeys([*group, *carry]))
    values = ("mu_mean", *(("mu_hdi_lower", "mu_hdi_upper") if interval else ()), "tau_mean", "tau_sd")
    out = T.StructType([*[split.schema[c] for c in shown], T.StructField("n_trials", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in values]])

    def sweep(frame: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=out.names)
        done, begun = [], False
        for _, run in _segments(frame.sort_values(ROW), group):
            state, count = np.zeros((4, TAU_NODES)), 0
            if not begun and len(before):
                known = before["carried"].iloc[0]
                count = int(known[0]["n"])
                state = np.array([[float(row[c]) for row in known] for c in SUMS])
            begun = True
            for a in range(0, len(run), 64):
                chunk = run.iloc[a : a + 64]
                sums = np.cumsum(_terms(chunk[y].to_numpy(float), chunk[se].to_numpy(float)), axis=1) + state[:, None, :]
                state = sums[:, -1, :]
                part = chunk[shown].reset_index(drop=True)
                part["n_trials"] = np.arange(count + 1, count + len(chunk) + 1)
                count += len(chunk)
                done.append(pd.concat([part, _summaries(sums, interval)], axis=1))
        return pd.concat(done, ignore_index=True)[out.names]

    return split.groupBy(PART).cogroup(carried.withColumnRenamed("part", PART).groupBy(PART)).applyInPandas(sweep, out)


def broadcast_posterior(clusters: DataFrame, log: DataFrame, posterior: DataFrame) -> DataFrame:
    """Give the one full-data posterior to every cluster that has an approved pair."""
    approved = log.filter(truthy("human_poolable")).select("pair_id")
    eligible = clusters.join(approved, "pair_id", "left_semi").select("endpoint_cluster").distinct()
    one = posterior.first()
    if one is None:
        return eligible.limit(0)
    return eligible.withColumns({k: F.lit(v) for k, v in one.asDict().items()})
