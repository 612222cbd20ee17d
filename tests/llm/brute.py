"""Independent brute-force versions of the operators' contracts."""

import hashlib
import math
import re
import statistics
from collections import Counter, defaultdict
from statistics import NormalDist

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return SPACE.findall(text or "")


def shingle_set(text, width=2):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(rows, width=2, threshold=80):
    """{doc_id: smallest reachable doc_id} by comparing all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t, width))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= threshold * len(x | y):
                        p, q = find(a), find(b)
                        parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def without_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


SECRETS = [
    ("assign", re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secret_spans(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(SECRETS):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [s for *_, s in sorted(found)]


RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = (846, 162, 320, 450, 1400, 141, 191, 308, 682, 43, 57, 447, 277, 758, 615, 191, 59, 664, 738, 677, 404, 120, 109, 21, 93, 50)


def tests_of(token):
    """(k, n, uniformity z, runs, serial, like random) of a run, by the textbook formulas; None if too short."""
    bare = token.replace("=", "")
    k, t, symbols = 64, bare.replace("-", "+").replace("_", "/"), UPPER + UPPER.lower() + "0123456789+/"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare):
        k, t, symbols = 16, bare.lower(), "0123456789abcdef"
    elif re.fullmatch("[A-Z2-7]+", bare):
        k, t, symbols = 32, bare, UPPER + "234567"
    if len(t) < 16:
        return None
    x, n = [symbols.index(c) for c in t], len(t)
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    side = [2 * v >= k for v in x]
    high, changes = sum(side), sum(a != b for a, b in zip(side, side[1:]))
    expected = 1 + 2 * high * (n - high) / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = (changes + 1 - expected) / math.sqrt(variance) if variance > 0 else 99.0
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    serial = (sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / spread + 1 / n) * math.sqrt(n) if spread > 1e-9 else 99.0
    if k == 64:
        excess = (n - 1) * (k * 0.065 - 1)
        z = (excess + k - 1 - chi) / math.sqrt(2 * (k - 1) + 4 * excess)
        fits = True
    else:
        letters = [c.lower() for c in t if c.isalpha()]
        digits = n - len(letters)
        ratio = sum(math.log10(LETTERS[ord(c) - 97] / sum(LETTERS)) for c in letters) - digits + n * math.log10(k)
        ratio += sum(c * math.log10(c / n) for c in (len(letters), digits) if c)
        z = -37.0 if ratio >= 0 else 36.0 if ratio < -290 else NormalDist().inv_cdf(1 - 10**ratio) if ratio > -9 else -NormalDist().inv_cdf(10**ratio)
        fits = ((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1))) <= 3
    return k, n, max(-37.0, min(37.0, z)), runs, serial, fits and abs(runs) <= 3 and abs(serial) <= 3


def random_spans(texts, q=0.01):
    """The spans that the test battery adds, [(start, end)] by text: all candidates in memory, p-values in bins of 1/20 of a decade."""
    normal, held = NormalDist(), lambda v: max(-37.0, min(37.0, v))
    found = []
    for i, text in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in secret_spans(text)]
        for m in RUN.finditer(text or ""):
            if not any(a < m.end() and m.start() < b for a, b in base) and (t := tests_of(m[0])):
                found.append((i, m.start(), m.end(), t, sum(t[1] > top for top in (23, 31, 47, 95))))
    groups, bins = defaultdict(list), defaultdict(list)
    for *_, t, layer in found:
        groups[t[0], layer].append((held(t[3]), held(t[4])))
    rated = []
    for i, a, b, t, layer in found:
        zs = [t[2]]
        for j, v in enumerate(t[3:5]):
            values = [g[j] for g in groups[t[0], layer]]
            mean, sd = statistics.fmean(values), max(1.0, statistics.pstdev(values))
            p = normal.cdf((abs(v) - mean) / sd) - normal.cdf((-abs(v) - mean) / sd)
            zs.append(held(-normal.inv_cdf(max(1e-12, min(1 - 1e-12, p)))))
        z = (6 * zs[0] + zs[1] + zs[2]) / math.sqrt(38)
        p = max(1e-300, math.erfc(z / math.sqrt(2)) / 2) if z > 0 else 1.0
        rated.append((i, a, b, layer, min(600, math.floor(-math.log10(p) * 20)), t[5]))
        bins[layer].append(rated[-1][4])
    least = {}
    for layer, each in bins.items():
        able = [x for x in set(each) if x > 0 and 10 ** (-x / 20) <= q * sum(y >= x for y in each) / len(each)]
        if able:
            least[layer] = min(able)
    out = [[] for _ in texts]
    for i, a, b, layer, x, like in rated:
        if like and layer in least and x >= least[layer]:
            out[i].append((a, b))
    return out
