"""Plain-Python counterparts of the operators, slow and simple."""

import itertools

import numpy as np

EDGES = np.linspace(0, 1, 11)


def rate(values):
    return float(np.mean(values)) if len(values) else 0.0


def metrics(y_true, y_pred, score, groups, privileged):
    t, p, s, g = map(np.asarray, (y_true, y_pred, score, groups))
    priv = g == privileged
    names = sorted(set(g))

    def over(fn):
        values = [fn(g == n) for n in names]
        return max(values) - min(values), max(values), min(values)

    def tpr(m):
        return rate(p[m & (t == 1)])

    def fpr(m):
        return rate(p[m & (t == 0)])

    def select(m):
        return rate(p[m])

    def precision(m):
        return rate(t[m & (p == 1)])

    out = {}
    gap, top, low = over(select)
    out["demographic_parity_difference"] = gap
    out["equalized_odds_difference"] = max(over(tpr)[0], over(fpr)[0])
    out["equal_opportunity_difference"] = abs(tpr(priv) - tpr(~priv))
    base = select(priv) if priv.any() else 1e-10
    out["disparate_impact_ratio"] = select(~priv) / max(base, 1e-10)
    out["average_odds_difference"] = abs(0.5 * (fpr(~priv) - fpr(priv) + tpr(~priv) - tpr(priv)))
    out["statistical_parity_subgroup_lift"] = top / max(low, 1e-10)
    out["predictive_parity_difference"] = abs(precision(priv) - precision(~priv))
    out["counterfactual_fairness"] = abs(select(priv) - select(~priv))
    gaps = []
    for lo, hi in zip(EDGES, EDGES[1:]):
        inside = (s >= lo) & (s < hi)
        if (inside & priv).any() and (inside & ~priv).any():
            gaps.append(abs(rate(t[inside & priv]) - rate(t[inside & ~priv])))
    out["calibration_gap"] = float(np.mean(gaps)) if gaps else 0.0
    return out


def pair_score(y_true, score, groups):
    distances = [
        abs(score[i] - score[j])
        for i, j in itertools.combinations(range(len(score)), 2)
        if y_true[i] == y_true[j] and groups[i] != groups[j]
    ]
    return 1.0 if not distances else min(1.0, max(0.0, 1 - float(np.mean(distances))))


def cusum(values, target=None, slack=0.05):
    if len(values) < 3:
        return 0.0
    goal = min(values) if target is None else target
    up = down = top = 0.0
    for x in values[1:]:
        up = max(0.0, up + x - goal - slack)
        down = max(0.0, down - (x - goal) - slack)
        top = max(top, up, down)
    return top


def temporal(y_pred, groups, privileged):
    n = len(y_pred)
    size = max(n // 10, 50)
    gaps = []
    for start in range(0, n - size + 1, size // 2):
        p = np.asarray(y_pred[start : start + size])
        m = np.asarray(groups[start : start + size]) == privileged
        if m.any() and (~m).any():
            gaps.append(abs(p[m].mean() - p[~m].mean()))
    return cusum(gaps) if len(gaps) > 2 else 0.0


def segments(values, penalty, jump, shortest):
    """Best penalised segmentation by trying every allowed previous cut."""
    n = len(values)
    ends = [e for e in range(jump, n, jump)] + [n]
    best, back = {0: -penalty}, {}
    for e in ends:
        options = []
        for s in best:
            if s < e and e - s >= shortest:
                part = np.asarray(values[s:e])
                options.append((best[s] + ((part - part.mean()) ** 2).sum() + penalty, s))
        if options:
            cost, start = min(options)
            best[e], back[e] = cost, start
    cuts, at = [], back[n]
    while at > 0:
        cuts.append(at)
        at = back[at]
    return cuts[::-1]
