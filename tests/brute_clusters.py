"""Plain versions of the cluster searches and the topic sampler, everything in memory."""

import hashlib
import heapq
import math

import numpy as np

SEED, EPSILON = 12345, 1e-12


def rand(tag, *ids):
    text = "|".join(map(str, (SEED, tag, *ids)))
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def dense(rows, ords):
    """Unit vectors of (ord, feature, w) as a matrix, a row per ord."""
    places, names = {o: i for i, o in enumerate(ords)}, {f: i for i, f in enumerate(sorted({f for _, f, _ in rows}))}
    out = np.zeros((len(ords), len(names)))
    for o, f, w in rows:
        out[places[o], names[f]] = w
    return out


def refine(u, child, k, passes=30):
    """Passes of gaining moves; a pass that lowers the objective is replaced by its best single move."""
    child, own = child.copy(), (u * u).sum(axis=1)

    def state(child):
        sums = np.stack([u[child == j].sum(axis=0) for j in range(k)])
        norms = np.sqrt((sums * sums).sum(axis=1))
        return sums, norms, norms.sum()

    sums, norms, total = state(child)
    for _ in range(passes):
        dots, squares = u @ sums.T, norms**2
        rows = np.arange(len(u))
        leave = np.sqrt(np.maximum(0, squares[child] + own - 2 * dots[rows, child]))
        gains = leave[:, None] + np.sqrt(np.maximum(0, squares[None] + own[:, None] + 2 * dots)) - norms[child][:, None] - norms[None]
        gains = np.round(gains, 12)
        gains[rows, child] = -np.inf
        gains[own == 0] = -np.inf
        to, best = gains.argmax(axis=1), gains.max(axis=1)
        if not (best > EPSILON).any():
            break
        tried = np.where(best > EPSILON, to, child)
        new = state(tried)
        if new[2] < total - EPSILON:
            i = best.argmax()
            tried = child.copy()
            tried[i] = to[i]
            new = state(tried)
        rose = new[2] > total + EPSILON
        if new[2] > total:
            child, (sums, norms, total) = tried, new
        if not rose:
            break
    return child


def kmeans(u, ords, k):
    """{ord: cluster_id}."""
    seeds, closest = [min(range(len(ords)), key=lambda i: (rand("smart-0", ords[i]), ords[i]))], None
    for i in range(1, k):
        distance = 1 - u @ u[seeds[-1]]
        closest = np.maximum(0, distance if closest is None else np.minimum(closest, distance))
        race = [-math.log(rand(f"smart-{i}", o)) / c if c > EPSILON else math.inf for o, c in zip(ords, closest)]
        seeds.append(min(range(len(ords)), key=lambda j: (race[j], ords[j])))
    child = refine(u, np.round(u @ u[seeds].T, 9).argmax(axis=1), k)
    ids = {c: i for i, c in enumerate(sorted(set(child.tolist())), 1)}
    return {o: ids[c] for o, c in zip(ords, child.tolist())}


def split(u, ords, path):
    first = min(range(len(ords)), key=lambda i: (rand("first", path, ords[i]), ords[i]))
    near = u @ u[first]
    race = [-math.log(rand("second", o)) / (1 - s) if 1 - s > EPSILON else 1e300 for o, s in zip(ords, near)]
    second = min(range(len(ords)), key=lambda i: (race[i], ords[i]))
    child = refine(u, (np.round(u @ u[second], 9) > np.round(near, 9)).astype(int), 2)
    norm = lambda x: np.sqrt((x.sum(axis=0) ** 2).sum())
    return child, round(norm(u[child == 0]) + norm(u[child == 1]) - norm(u), 12)


def bisect(u, ords, n=None, limit=None):
    """{ord: cluster_id} by best-first bisection."""
    ords = np.array(ords)
    members, known = {1: np.arange(len(ords))}, {}

    def gain(path):
        if path not in known:
            child, g = split(u[members[path]], ords[members[path]].tolist(), path) if len(members[path]) > 1 else (None, 0.0)
            known[path] = g
            if child is not None:
                members[2 * path], members[2 * path + 1] = members[path][child == 0], members[path][child == 1]
        return known[path]

    heap = [(-gain(1), 1)]
    while (n is None or len(heap) < n) and -heap[0][0] > EPSILON and (limit is None or -heap[0][0] >= limit):
        _, path = heapq.heappop(heap)
        for c in (2 * path, 2 * path + 1):
            heapq.heappush(heap, (-gain(c), c))
    leaves = sorted((known[p], p) for _, p in heap if len(members[p]))
    return {int(ords[i]): c for c, (_, p) in enumerate(leaves, 1) for i in members[p]}


def gibbs(tokens, k, sweeps, alpha, beta, seed=SEED):
    """{(ord, feature, i): topic} of one bucket, all counts kept in dictionaries."""
    order = sorted(tokens)
    topics = dict(tokens)
    vocabulary = len({f for _, f, _ in order})
    for sweep in range(sweeps):
        draws = {}
        for o in sorted({o for o, _, _ in order}):
            mine = [t for t in order if t[0] == o]
            draws.update(zip(mine, np.random.default_rng([(seed + sweep) & 0xFFFFFFFF, o & 0xFFFFFFFF]).random(len(mine))))
        by_word, by_topic, by_doc = {}, [0] * k, {}
        for (o, f, i), z in topics.items():
            by_word.setdefault(f, [0] * k)[z] += 1
            by_doc.setdefault(o, [0] * k)[z] += 1
            by_topic[z] += 1
        for t in order:
            o, f, _ = t
            z = topics[t]
            for counts in (by_word[f], by_doc[o], by_topic):
                counts[z] -= 1
            p = np.cumsum([(by_word[f][j] + beta) / (by_topic[j] + vocabulary * beta) * (by_doc[o][j] + alpha) for j in range(k)])
            z = min(k - 1, int(np.searchsorted(p, draws[t] * p[-1], "right")))
            for counts in (by_word[f], by_doc[o], by_topic):
                counts[z] += 1
            topics[t] = z
    return topics


def gibbs_buckets(tokens, bucket, k, sweeps, alpha, beta, seed=SEED):
    """The same with documents in buckets (bucket: of an ord): each sees the counts of a sweep's start and its own moves."""
    topics = dict(tokens)
    vocabulary = len({f for _, f, _ in topics})
    for sweep in range(sweeps):
        start = dict(topics)
        for b in sorted(set(map(bucket, {o for o, _, _ in topics}))):
            by_word, by_topic, by_doc, draws = {}, [0] * k, {}, {}
            for (o, f, _), z in start.items():
                by_word.setdefault(f, [0] * k)[z] += 1
                by_doc.setdefault(o, [0] * k)[z] += 1
                by_topic[z] += 1
            mine = sorted(t for t in start if bucket(t[0]) == b)
            for t in mine:
                o, f, _ = t
                if o not in draws:
                    draws[o] = iter(np.random.default_rng([(seed + sweep) & 0xFFFFFFFF, o & 0xFFFFFFFF]).random(sum(x[0] == o for x in mine)))
                for counts in (by_word[f], by_doc[o], by_topic):
                    counts[topics[t]] -= 1
                p = np.cumsum([(by_word[f][j] + beta) / (by_topic[j] + vocabulary * beta) * (by_doc[o][j] + alpha) for j in range(k)])
                topics[t] = min(k - 1, int(np.searchsorted(p, next(draws[o]) * p[-1], "right")))
                for counts in (by_word[f], by_doc[o], by_topic):
                    counts[topics[t]] += 1
    return topics
