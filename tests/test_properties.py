"""Property tests: Spark quota allocation against an independent exact brute force."""

import math
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowprep.operators.split import split_quotas, passed_on

RATES = [[0.8, 0.2], [0.6, 0.2, 0.2], [0.25, 0.75], [0.08, 0.92], [0.5, 0.3, 0.2], [0.7, 0.3]]


def brute_quotas(counts: dict[str, int], rates) -> dict[str, list[int]]:
    """Peel parts off one at a time; each step keeps n - ceil(t * n) rows (t as a float, like the
    reference), shared by largest remainder with exact fractions, ties by label text."""
    rem = dict(counts)
    out = {k: [] for k in counts}
    for t in passed_on(rates):
        n = sum(rem.values())
        keep = n - math.ceil(t * n)
        exact = {k: Fraction(v * keep, n) if n else Fraction(0) for k, v in rem.items()}
        fl = {k: int(math.floor(x)) for k, x in exact.items()}
        need = keep - sum(fl.values())
        order = sorted(rem, key=lambda k: (-(exact[k] - fl[k]), k))
        for i, k in enumerate(order):
            q = fl[k] + (1 if i < need else 0)
            out[k].append(q)
            rem[k] -= q
    for k in counts:
        out[k].append(rem[k])
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=st.lists(st.integers(min_value=1, max_value=5000), min_size=1, max_size=8),
       rates=st.sampled_from(RATES))
def test_quotas_match_brute_force(spark, counts, rates):
    labels = {f"c{i}": c for i, c in enumerate(counts)}
    df = spark.createDataFrame(list(labels.items()), "label string, n long") \
        .withColumn("_lk", F.col("label")).withColumn("_ln", F.lit(False))
    got = {r["label"]: [r[f"q{i}"] for i in range(len(rates))] for r in split_quotas(df, rates).collect()}
    want = brute_quotas(labels, rates)
    assert got == want
    for k, qs in got.items():
        assert sum(qs) == labels[k] and min(qs) >= 0


def simulate_stop(losses, patience):
    """Patience-based early stopping, simulated epoch by epoch (strict improvement)."""
    if patience <= 0:
        return None
    best, wait = math.inf, 0
    for e, loss in enumerate(losses, start=1):
        if loss < best:
            best, wait = loss, 0
        else:
            wait += 1
            if wait >= patience:
                return e
    return None


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(runs=st.lists(st.lists(st.integers(min_value=0, max_value=6), min_size=1, max_size=30), min_size=1, max_size=5),
       patience=st.integers(min_value=0, max_value=6))
def test_early_stop_matches_simulation(spark, runs, patience):
    from flowprep.operators import history
    rows = [(f"r{i}", e, float(v)) for i, losses in enumerate(runs) for e, v in enumerate(losses)]
    df = spark.createDataFrame(rows, "run string, ts int, val_loss double")
    h = history.number_epochs(df, "run", ["ts"], keep_partition=True)
    got = {r["run"]: r["stop_epoch"] for r in history.early_stop_epoch(h, "run", patience).collect()}
    want = {f"r{i}": simulate_stop(losses, patience) for i, losses in enumerate(runs)}
    assert got == want


def numpy_metrics(y_true, y_pred):
    import numpy as np
    labels = sorted(set(y_true) | set(y_pred))
    idx = {k: i for i, k in enumerate(labels)}
    cm = np.zeros((len(labels), len(labels)), dtype=np.int64)
    for t, p in zip(y_true, y_pred):
        cm[idx[t], idx[p]] += 1
    tp = np.diag(cm).astype(float)
    fp = cm.sum(axis=0) - tp
    fn = cm.sum(axis=1) - tp
    tn = cm.sum() - tp - fp - fn
    support = tp + fn

    def div(a, b):
        return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)
    tpr, ppv = div(tp, tp + fn), div(tp, tp + fp)
    per = {"tpr": tpr, "tnr": div(tn, tn + fp), "ppv": ppv, "npv": div(tn, tn + fn), "fpr": div(fp, fp + tn),
           "fnr": div(fn, tp + fn), "fdr": div(fp, tp + fp), "acc": div(tp + tn, tp + fp + fn + tn),
           "f1": div(2 * ppv * tpr, ppv + tpr)}
    s = lambda a: float(a.sum())
    sd = lambda a, b: a / b if b else 0.0  # noqa: E731  (0/0 -> 0, the library's documented choice)
    m_tpr, m_ppv = sd(s(tp), s(tp + fn)), sd(s(tp), s(tp + fp))
    micro = {"tpr": m_tpr, "tnr": sd(s(tn), s(tn + fp)), "ppv": m_ppv, "npv": sd(s(tn), s(tn + fn)),
             "fpr": sd(s(fp), s(fp + tn)), "fnr": sd(s(fn), s(tp + fn)), "fdr": sd(s(fp), s(tp + fp)),
             "acc": float(np.trace(cm)) / cm.sum(), "f1": sd(2 * m_ppv * m_tpr, m_ppv + m_tpr)}
    macro = {k: float(v.mean()) for k, v in per.items()}
    weighted = {k: float((v * support).sum() / support.sum()) for k, v in per.items()}
    return labels, per, {"micro": micro, "macro": macro, "weighted": weighted}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcdef")), min_size=1, max_size=60))
def test_metrics_match_numpy(spark, pairs):
    import pytest as _pt

    from flowprep.operators import metrics
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    cm = metrics.class_metrics(metrics.confusion(df))
    labels, per, avgs = numpy_metrics([t for t, _ in pairs], [p for _, p in pairs])
    got = {r["label"]: r for r in cm.collect()}
    assert sorted(got) == labels
    for i, lab in enumerate(labels):
        for k in metrics.RATIOS:
            assert got[lab][k] == _pt.approx(per[k][i], abs=1e-12)
    am = {r["avg_type"]: r for r in metrics.average_metrics(cm).collect()}
    for t in ("micro", "macro", "weighted"):
        for k in metrics.RATIOS:
            assert am[t][k] == _pt.approx(avgs[t][k], abs=1e-12)
