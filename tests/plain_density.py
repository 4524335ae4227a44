"""Clusters by density in plain Python, top down: the single-linkage tree of all pairs, condensed, and its most stable clusters."""

from __future__ import annotations

import numpy as np


def tree(x: np.ndarray, min_samples: int) -> list[tuple[float, int, int]]:
    """The spanning tree of mutual reachability by Kruskal over all pairs."""
    far = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in x])
    core = np.sort(far, axis=1)[:, min(min_samples, len(x)) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), far)
    up = list(range(len(x)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    a, b = np.triu_indices(len(x), 1)
    order = np.lexsort((b, a, reach[a, b]))
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if find(i) != find(j):
            up[find(i)] = find(j)
            out.append((float(reach[i, j]), i, j))
    return out


def plain(x: np.ndarray, min_cluster_size: int, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (numbered by their first row) and memberships."""
    n = len(x)
    labels, shares = np.full(n, -1), np.zeros(n)
    edges = tree(x, min_samples)
    # the binary tree: node n + k joins the nodes of edge k
    top, kids, height, size = {i: i for i in range(n)}, {}, {}, {i: 1 for i in range(n)}
    group = list(range(n))

    def find(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for k, (w, i, j) in enumerate(edges):
        i, j = find(i), find(j)
        kids[n + k], height[n + k], size[n + k] = (top[i], top[j]), w, size[top[i]] + size[top[j]]
        group[j], top[i] = i, n + k

    def rows(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            out += [v] if v < n else []
            todo += kids.get(v, ())
        return out

    # condensed clusters, from the root: rows that leave with their density, and the two clusters it splits into
    inverse = lambda w: 1 / w if w > 0 else np.inf
    clusters: list[dict] = []

    def condense(node: int, birth: float) -> int:
        own = {"birth": birth, "leave": [], "kids": [], "sizes": []}
        clusters.append(own)
        me = len(clusters) - 1
        while True:
            if node < n:
                own["leave"].append((node, birth))
                break
            lam, (a, b) = inverse(height[node]), kids[node]
            big = [v for v in (a, b) if size[v] >= min_cluster_size]
            for v in (a, b):
                if v not in big:
                    own["leave"] += [(r, lam) for r in rows(v)]
            own["death"] = lam
            if len(big) == 1:
                node = big[0]
                continue
            if len(big) == 2:
                own["sizes"] = [(size[v], lam) for v in big]
                own["kids"] = [condense(v, lam) for v in big]
            break
        return me

    if size.get(n + len(edges) - 1, 0) < min_cluster_size:
        return labels, shares
    condense(n + len(edges) - 1, 0.0)
    gain = lambda lam, birth, k: 0.0 if birth == np.inf else (lam - birth) * k
    chosen, best = {}, {}
    for c in reversed(range(len(clusters))):
        own = clusters[c]
        parts = [(lam, 1) for _, lam in own["leave"]] + [(lam, s) for s, lam in own["sizes"]]
        stable, inner = sum(gain(lam, own["birth"], s) for lam, s in parts), sum(best[k] for k in own["kids"])
        sums = sum(lam * s for lam, s in parts)
        chosen[c] = c > 0 and (stable == np.inf or inner != np.inf and stable >= inner - 1e-9 * sums)
        best[c] = stable if chosen[c] else inner
    found = []

    def assign(c: int, cluster: int | None) -> None:
        if cluster is None and chosen[c]:
            cluster = c
            found.append([])
        if cluster is not None:
            death = clusters[cluster]["death"]
            found[-1].extend((r, 1.0 if lam >= death else 0.0 if death == np.inf else lam / death) for r, lam in clusters[c]["leave"])
        for k in clusters[c]["kids"]:
            assign(k, cluster)

    assign(0, None)
    for number, held in enumerate(sorted(found, key=lambda f: min(r for r, _ in f))):
        for r, share in held:
            labels[r], shares[r] = number, share
    return labels, shares
