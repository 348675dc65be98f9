"""Plain sequential versions of the clustering operators, for small inputs."""

from __future__ import annotations

import numpy as np


def pairwise(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def density(x, mcs, min_samples):
    """Labels by cutting a sequential dendrogram from the top."""
    n = len(x)
    far = pairwise(x)
    core = np.sort(far, axis=1)[:, min(n - 1, min_samples)]
    reach = np.maximum(far, np.maximum(core[:, None], core[None, :]))
    pairs = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    group = list(range(n))
    members = {i: [i] for i in range(n)}
    node = {i: i for i in range(n)}
    tree = {}
    fresh = n
    for w, i, j in pairs:
        a, b = group[i], group[j]
        if a == b:
            continue
        tree[fresh] = (w, node[a], node[b], list(members[a]), list(members[b]))
        for p in members[b]:
            group[p] = a
        members[a] = members[a] + members.pop(b)
        node[a] = fresh
        fresh += 1
    clusters = {0: {"parent": None, "birth": 0.0, "falls": []}}
    out = np.zeros(n, int)
    todo = [(fresh - 1, 0)]
    while todo:
        at, c = todo.pop()
        if at < n:
            continue
        w, left, right, lm, rm = tree[at]
        lam = np.inf if w == 0 else 1.0 / w
        both = len(lm) >= mcs and len(rm) >= mcs
        for child, mem in ((left, lm), (right, rm)):
            if both:
                new = len(clusters)
                clusters[new] = {"parent": c, "birth": lam, "falls": []}
                clusters[c]["falls"].append((lam, len(mem)))
                out[mem] = new
                todo.append((child, new))
            elif len(mem) >= mcs:
                todo.append((child, c))
            else:
                clusters[c]["falls"].append((lam, len(mem)))
    stability = {
        c: sum((lam - v["birth"]) * s for lam, s in v["falls"]) for c, v in clusters.items()
    }
    kids = {c: [k for k, v in clusters.items() if v["parent"] == c] for c in clusters}
    value, keep = {}, {}
    for c in sorted(clusters, reverse=True):
        below = sum(value[k] for k in kids[c])
        keep[c] = c != 0 and not below > stability[c]
        value[c] = max(below, stability[c])
    chosen = {}
    for c in sorted(clusters):
        above = chosen.get(clusters[c]["parent"])
        chosen[c] = above if above is not None else (c if keep[c] else None)
    return [chosen[c] for c in out]


def average_linkage(x, k):
    """Greedy average linkage on cosine distance of unit vectors."""
    far = 1.0 - x @ x.T
    parts = [[i] for i in range(len(x))]
    while len(parts) > k:
        best = min(
            (far[np.ix_(a, b)].mean(), i, j)
            for i, a in enumerate(parts)
            for j, b in enumerate(parts)
            if i < j
        )
        _, i, j = best
        parts[i] = parts[i] + parts.pop(j)
    out = [0] * len(x)
    for c, part in enumerate(parts):
        for i in part:
            out[i] = c
    return out


def same_partition(a, b, noise_a=-1, noise_b=None):
    """Whether two labelings group the rows alike, noise included."""
    forth, back = {}, {}
    for p, q in zip(a, b):
        if (p == noise_a) != (q == noise_b):
            return False
        if p == noise_a:
            continue
        if forth.setdefault(p, q) != q or back.setdefault(q, p) != p:
            return False
    return True


def silhouette(x, label):
    far = pairwise(x)
    label = np.asarray(label)
    scores = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = far[i, own].sum() / (own.sum() - 1)
        b = min(far[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def blobs(seed, n=220, noise=40, centres=4, width=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width)) * 4
    rows = [middle[i % centres] + rng.normal(size=width) * 0.4 for i in range(n)]
    rows += list(rng.uniform(-9, 9, size=(noise, width)))
    return np.array(rows)
