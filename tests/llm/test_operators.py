"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import html as html_module
import math
import random
import re
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quillon.llm import chat_format, common, components, decontaminate, html_text, mixing, near_dedup, quality, queries, repeated_bytes, secrets, token_files, toxicity
from quillon.llm.common import draw_labels, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, sig string, component_id long, rank int, n int"
WORDS = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeiou" for c in ("", "n", "st", "rk")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, odd texts, repeated rows, null ids and ties."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    out = [(i, prose(rng, rng.randint(5, 120))) for i in range(40)]
    base = prose(rng, 100).split()
    for i in range(40, 60):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((i, " ".join(w)))
    out += [(60 + i, f"{prose(rng, 10)} {passage} {prose(rng, 10)}") for i in range(6)]
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "One"), (75, "one two"), (76, "é" * 30_000), (77, "x " * 20_000), (78, out[3][1]), (78, out[3][1]), (79, out[4][1].upper()), (None, out[5][1]), (None, None)]
    return out


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, None if i == 3 else "en", None if i == 4 else f"src{(i or 0) % 3}", None, 0.5, "k", "s", 7, 1, 2) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def test_near_duplicates(spark, rows):
    found = near_dedup.near_duplicates(frame(spark, rows), 2).collect()
    want = brute.components([r for r in rows if r[0] is not None])
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == want.get(r["doc_id"]))
    sizes = sorted((r["doc_id"], r["n_shingles"]) for r in found if r["doc_id"] is not None)
    assert sizes == sorted((i, len(brute.shingle_set(t))) for i, t in rows if i is not None)
    kept = near_dedup.drop_near_duplicates(frame(spark, rows), 2)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, c in want.items() if i == c)
    assert near_dedup.near_duplicates(frame(spark, []), 2).count() == 0


def test_different_texts_of_one_id_all_stay(spark, rows):
    """Rows are judged by text: ids may repeat, be null, or both."""
    a, b, c = rows[0][1] + " " + prose(random.Random(1), 30), prose(random.Random(2), 40), prose(random.Random(3), 40)
    mine = [(1, a), (1, b), (1, a), (None, c), (None, c + " end"), (None, a), (2, b), (5, None), (5, None), (5, ""), (6, " "), (7, a.upper())]
    docs = frame(spark, mine)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (None, min((c, c + " end"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])), (5, None), (5, None), (5, ""), (6, " ")], key=repr)


def test_components_with_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60, 2)] + [(900, i + 300) for i in range(40)] + [(339, 59)]
    found = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(found.values()) == {0} and len(found) == 60 + 30 + 41


def test_near_duplicates_of_one_family(spark):
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 22)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        rows.append((i, " ".join(w)))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), 2).collect()}
    assert found == brute.components(rows)


def test_bitmap_bound_holds():
    rng = np.random.default_rng(1)
    for n in (3, 50, 400):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        x, y = near_dedup.parity_bitmap(a), near_dedup.parity_bitmap(b)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, 0), (5, None)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    found = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for a, b in edges if b is not None and a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("most", "chunk"), [(2_000, 2 << 20), (3, 2 << 20), (0, 1_500)])
def test_repeated_bytes(spark, rows, monkeypatch, most, chunk):
    monkeypatch.setattr(repeated_bytes, "SORTED", most)
    monkeypatch.setattr(repeated_bytes, "CHUNK", chunk)
    mine = [(i, t if i not in (76, 77) else t[:900]) for i, t in rows] + [(200, "ab" * 300), (201, "a" * 199), (202, "a" * 201)]
    found = sorted(map(tuple, repeated_bytes.remove_repeats(frame(spark, mine), False).drop("kept").collect()), key=repr)
    assert found == sorted(((i, *r) for (i, _), r in zip(mine, brute.without_repeats([t for _, t in mine]), strict=True)), key=repr)


def test_repeated_bytes_keeps_bytes(spark):
    got = repeated_bytes.remove_repeats(frame(spark, [(1, "x" * 250 + "é")])).first()
    assert got["kept"] == bytearray("é".encode()) and got["n_spans"] == 1
    assert repeated_bytes.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    """With a useless hash every comparison is wrong; the byte check must notice and sort by bytes."""
    rng = random.Random(4)
    core = bytes(rng.choices(b"ab", k=repeated_bytes.K))
    data = [bytes(rng.choices(b"ab", k=152)) + core + bytes(rng.choices(b"ab", k=152)) for _ in range(12)]
    data += [data[0][:200] + b"z" * 152, b"y" * 100 + data[1][100:]]
    anchor, group = np.full(len(data), 152), np.zeros(len(data), np.int64)
    right = repeated_bytes.repeated_windows(repeated_bytes.PrefixHashes(), data, anchor, group)
    assert any(right)
    monkeypatch.setattr(repeated_bytes.PrefixHashes, "of", lambda self, prefix, start, size: np.zeros(len(start), np.uint64))
    assert repeated_bytes.repeated_windows(repeated_bytes.PrefixHashes(), data, anchor, group) == right


def test_decontamination(spark, rows):
    rng = random.Random(8)
    items = [(1, prose(rng, 30)), (2, prose(rng, 16)), (3, "alpha beta gamma"), (4, None), (5, ""), (6, rows[2][1]), (6, rows[2][1])]
    broken = items[0][1].split()
    broken[3] = "changed"
    docs = [*rows, (300, f"{prose(rng, 200)} {' '.join(broken)} {prose(rng, 200)}"), (301, "Alpha, BETA -- gamma!"), (302, " ".join(items[1][1].split()[:9]))]
    benchmark = spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, n int, width string")
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.find_contaminated(frame(spark, docs), benchmark).collect()}

    def grams(text, k):
        import re

        w = [x for x in re.split(r"[^\w]+", (text or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for i, t in docs:
        for j, s in items:
            k = min(5, len((s or "").split()))
            if k and (q := grams(s, k)) and len(q & grams(t, k)) >= 0.8 * len(q):
                want[i, j] = len(q & grams(t, k)) / len(q)
    assert found == pytest.approx(want) and (300, 1) in want and (301, 3) in want and (302, 2) not in want
    clean = decontaminate.decontaminate(frame(spark, docs), benchmark)
    assert clean.columns == frame(spark, docs).columns and clean.count() == len(docs) - len([1 for i, _ in docs if i in {i for i, _ in want}])
    assert decontaminate.find_contaminated(frame(spark, docs), benchmark.limit(0)).count() == 0
    assert decontaminate.decontaminate(frame(spark, []), benchmark).count() == 0


def test_decontamination_shuffled_joins(spark, rows, monkeypatch):
    benchmark = spark.createDataFrame([(6, rows[2][1])], "item_id long, text string")
    with_broadcast = sorted(map(tuple, decontaminate.find_contaminated(frame(spark, rows), benchmark).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, decontaminate.find_contaminated(frame(spark, rows), benchmark).collect()), key=repr) == with_broadcast != []


def test_clean_rows_survive_contaminated_ids(spark, rows):
    """Rows without an id, or of one id, are judged by their own texts."""
    item = rows[2][1]
    docs = frame(spark, [(None, f"x {item} y"), (None, "clean text"), (7, item), (7, "another clean text"), (8, None)])
    clean = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(repr, (r["text"] for r in clean.collect()))) == ["'another clean text'", "'clean text'", "None"]


def test_size_partitions(spark, rows, monkeypatch):
    """Partitions have their own signature sizes and thresholds; these change the candidates but not the result."""
    rng = random.Random(12)
    items = [(i, prose(rng, n)) for i, n in enumerate((1, 3, 5, 6, 9, 12, 20, 36, 70, 140, 300))]
    docs = []
    for i, t in items:
        for lost in (0, 1, 2, 5):
            w = t.split()
            for _ in range(lost):
                w[rng.randrange(len(w))] = "lost"
            docs.append((len(docs), f"{prose(rng, 40)} {' '.join(w)} {prose(rng, 40)}"))
        docs.append((len(docs), " ".join(t.split()[: max(1, len(t.split()) // 3)])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.index_items(benchmark).collect()
    assert len({r["part"] for r in index}) >= 5 and all(2 ** r["part"] <= r["n"] < 2 ** (r["part"] + 1) for r in index)
    assert len({(r["part"], r["needed"]) for r in index}) == len({r["part"] for r in index}) and len({r["needed"] for r in index}) > 2
    seen = {}
    for extra in (4, 1, 40):
        monkeypatch.setattr(decontaminate, "EXTRA", extra)
        texts = frame(spark, docs).select("text", decontaminate.text_key(F.col("text")).alias("key"))
        n = decontaminate.find_candidates(texts, decontaminate.index_items(benchmark)).count()
        seen[extra] = n, sorted(map(tuple, decontaminate.find_contaminated(frame(spark, docs), benchmark).collect()))
    assert seen[4][1] == seen[1][1] == seen[40][1] and len(seen[4][1]) >= 15
    assert seen[1][0] > seen[40][0]


def test_quality_statistics(spark, rows):
    extra = [(400, "a b c a b c a b c"), (401, "x y z x y z q"), (402, "# l\n# l\n\n \nk|&"), (403, "a a a"), (404, "a a a a")]
    found = sorted(tuple(r)[:6] for r in quality.statistics(frame(spark, [*rows, *extra])).collect() if r["doc_id"] is not None)
    assert found == sorted((i, *brute.quality_counts(t)) for i, t in [*rows, *extra] if i is not None)


def test_quality_rules(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    found = quality.apply_rules(docs, labels)
    judged = found.join(labels, "doc_id").collect()
    assert found.count() == docs.count()
    assert sum(r["kept"] == bool(r["quality"]) for r in judged) / len(judged) > 0.9
    none = quality.apply_rules(docs, labels.limit(0))
    assert none.filter("kept = base_failed").count() == 0
    assert quality.apply_rules(docs.limit(0), labels).count() == 0


def test_decision_list():
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        x = [rng.random() for _ in quality.FEATURES]
        rows.append((*x, int(x[2] > 0.7 and x[4] < 0.5 or x[6] > 0.9)))
    rules = quality.learn(rows)
    wrong = sum(any(quality.covers(r, row) for r in rules) != bool(row[-1]) for row in rows)
    assert rules and wrong < 60 and all(rules)
    assert quality.learn([]) == [] and quality.learn([(*[0.0] * len(quality.FEATURES), 1)] * 9) == []


def test_one_acceptance_rule_at_every_size():
    """The same shares of classes give the same kind of list from 60 rows to 6,000."""
    for n in (60, 600, 6_000):
        rng = random.Random(n)
        rows = [(*[rng.random() for _ in quality.FEATURES[:-1]], i % 4 / 4 + rng.random() / 8, int(i % 4 == 3)) for i in range(n)]
        rng.shuffle(rows)
        rules = quality.learn(rows)
        assert len(rules) == 1 and rules[0][0].feature == len(quality.FEATURES) - 1
        noise = [(*r[:-1], rng.random() < 0.7) for r in rows]  # 0.7 of the rows low-quality, whatever the statistics
        found = quality.learn(noise)
        assert sum(any(quality.covers(r, row) for r in found) for row in noise) <= 0.2 * n


def test_contradicting_labels(spark):
    """Documents labelled both ways are never drawn, repeated labels count once, and the sample bounds the rows."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(7, 0, 1), (8, 0, 0), (None, 1, 1), (9, 5, None)], "doc_id long, quality int, toxic int")
    assert {r["l_id"] for r in draw_labels(labels, "quality", 1_000, 11).collect()} == set(range(400)) - {7}
    assert {r["l_id"] for r in draw_labels(labels, "toxic", 1_000, 5).collect()} == set(range(400)) - {7}
    some = [r["l_id"] for r in draw_labels(labels, "quality", 100, 11).collect()]
    assert 60 <= len(some) <= 100 and len(set(some)) == len(some)
    docs = frame(spark, [(i, f"{'vilefoo ' if i % 2 else ''}{prose(random.Random(i), 60)}") for i in range(400)])
    plain = labels.filter("doc_id <> 7")
    assert quality.apply_rules(docs, labels).exceptAll(quality.apply_rules(docs, plain)).count() == 0
    assert toxicity.learn(docs, labels).weights == toxicity.learn(docs, plain).weights


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randint(20, 80)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilefoo", "grimbar", "zulybaz" + rng.choice(WORDS)])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(901, None), (902, ""), (None, "vilefoo grimbar"), (1, rows[1][1])]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (903, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    held = {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    scored = toxicity.score_documents(docs, model).collect()
    assert len(scored) == len(rows)
    right = [(r["score"] >= 0.7) == (r["doc_id"] % 6 == 0) for r in scored if r["doc_id"] in held]
    assert sum(right) / len(right) > 0.97
    texts = dict(rows)
    found = [texts[r["doc_id"]][p["start"] : p["end"]] for r in scored for p in r["passages"]]
    named = [any(x in f for x in ("vilefoo", "grimbar", "zulybaz")) for f in found]
    assert len(named) > 150 and sum(named) / len(named) > 0.9  # a word may look toxic by chance
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] < 0.7 for r in scored if r["doc_id"] in (901, 902))
    kept = docs.filter(toxicity.evidence_of(model)(F.col("text"))["score"] < 0.7)
    assert kept.columns == docs.columns
    assert toxicity.learn(docs, marks.limit(0)).weights == {} and toxicity.learn(docs.limit(0), marks).weights == {}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_segments_match_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        places = sorted(rng.sample(range(60), rng.randint(1, 25)))
        hits = [(p, rng.uniform(-1, 2)) for p in places]
        dense = [-0.3] * 60
        for p, v in hits:
            dense[p] = v if v > 0 else v - 0.3

        def maximal(lo, hi):
            best = max(((sum(dense[a : b + 1]), -a, b) for a in range(lo, hi) for b in range(a, hi)), default=None)
            if not best or best[0] <= 0:
                return []
            a, b = -best[1], best[2]
            return [*maximal(lo, a), (a, b, best[0]), *maximal(b + 1, hi)]

        found = toxicity.segments(hits, 0.3)
        assert [x[:2] for x in found] == [x[:2] for x in maximal(0, 60)]
        assert [x[2] for x in found] == pytest.approx([x[2] for x in maximal(0, 60)])


def test_segments_take_linear_time():
    """Hits far apart, where no segment can be joined with one before."""

    def seconds(n):
        hits = [(i * 1_000, 0.5) for i in range(n)]
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert len(toxicity.segments(hits, 0.02)) == n
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(80_000) < 8 * seconds(20_000)


def test_toxicity_query(spark):
    """The registered query against a plain version of its scores, and against held-out labels."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.learn(docs, labels)
    found = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for d in rows:
        words = re.findall(r"\w+", d["text"] or "")
        dense, seen = [], Counter()
        for w in words:
            stems = [w.lower()] * (len(w) <= toxicity.LONGEST_WORD) + ["^" + w.lower()[:k] for k in (4, 5, 6) if len(w) >= k]
            each = [model.weights.get(f, 0.0) for f in stems] or [0.0]
            v = max(each) if max(each) > 0 else min(each)
            seen[w] += v != 0
            v = v / seen[w] if v else 0.0
            dense.append(v if v > 0 else v - model.gap)
        scores, todo = [], [(0, len(dense))]
        while todo:
            lo, hi = todo.pop()
            best = (0.0, 0, 0)
            low = (0.0, lo)
            total = 0.0
            for i in range(lo, hi):
                total += dense[i]
                best = max(best, (total - low[0], -low[1], i + 1))
                low = min(low, (total, -i - 1), key=lambda x: x[0]) if total < low[0] else low
                low = (low[0], abs(low[1]))
            if best[0] > 1e-12:
                scores.append(best[0])
                todo += [(lo, -best[1]), (best[2], hi)]
        logs = [math.log(model.k * max(1, len(words))) - model.decay * s for s in scores] if model.weights else []
        good = [-x for x in logs if x < math.log(toxicity.SIGNIFICANT)]
        evidence = sum(good) if good else min(0.0, -min([max(0.0, math.log(model.k * max(1, len(words) if model.weights else 0))), *logs]))
        score = 1 / (1 + math.exp(-(model.intercept + model.slope * evidence)))
        r = found[d["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["n_passages"] == len(good)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_of_a_very_long_text(spark):
    model = toxicity.Model({"vile": 3.0, "mild": -1.0}, k=0.01, decay=2.0)
    text = "mild words go on and on " * 200_000 + "vile vile"
    (row,) = toxicity.score_documents(frame(spark, [(1, text)]), model).collect()
    assert [text[p["start"] : p["end"]] for p in row["passages"]] in ([], ["vile vile"])


PAGES = [
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>One &amp; two&#33;</p><p>Three <b>bold</b>\n text<br>more</p></article><div class='comments'><p>hi there</p></div><footer>c</footer>", "Title\nOne & two!\nThree bold text more"),
    ("<div id=main><p>First paragraph is long enough.<p>Second one is, too.</div><div class=sidebar><p>Buy now</p></div><script>var a='<p>no</p>'</script>", "First paragraph is long enough.\nSecond one is, too."),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("no markup at all", "no markup at all"),
    ("<form><p>x</p></form>", ""),
    ("<!-- never closed", ""),
    ("<div>" * 3000 + "deep", "deep"),
    ("a < b and c > d", "a < b and c > d"),
    (None, ""),
    ("", ""),
]


FIRST, SECOND = "This is the first paragraph of a short page, with a sentence.", "And here is a second one, also with some words."
PROBES = [
    (f"<body><div><a href='/'>Home</a></div><div><p>{FIRST}</p><p>{SECOND}</p></div><div>Copyright 2024</div></body>", f"{FIRST}\n{SECOND}"),
    (f"<body><a href=/>Home</a> <a href=/a>About</a><div><p>{FIRST}</p></div><div>Copyright 2024</div></body>", FIRST),
    (f"<body><div><a href='/'>Home</a></div><div><h1>Title</h1><p>{FIRST}</p></div><div>Copyright 2024</div></body>", f"Title\n{FIRST}"),
    ("<body><article><h2 id='search-algorithms'>Search algorithms</h2><p id='notice-board'>The notice board hangs here in the hall.</p><section id='social-history'><p>Social history is long and winding, they say.</p></section><div class='share-price'>The share price rose by two.</div><p>End of it.</p></article><div class='comment-list'><p>first! what a lovely article this is, thanks for writing such a long one</p></div></body>", "Search algorithms\nThe notice board hangs here in the hall.\nSocial history is long and winding, they say.\nThe share price rose by two.\nEnd of it."),
    (f"<body><div class=ad>Buy now</div><article><p>{FIRST}</p><div class='ad-slot-1'>Buy cheap things</div><p>Text two.</p><ul><li><a href=1>Related one</a><li><a href=2>Related two</a></ul><p>The end.</p></article></body>", f"{FIRST}\nText two.\nThe end."),
    (f"<body><div class='ad'>{SECOND} {SECOND}</div><article><p>{FIRST}</p></article></body>", FIRST),
    (f"<body><div class='comments'><p>{FIRST}</p></div></body>", FIRST),
]


@pytest.mark.parametrize(("page", "text"), PROBES)
def test_html_by_density(page, text):
    assert html_text.main_text(page) == text


def test_densities_match_brute_force():
    """Counts by walking each subtree, and the formula as the paper states it."""
    rng = random.Random(5)

    def grow(depth):
        inside = "".join(grow(depth - 1) if depth and rng.random() < 0.7 else prose(rng, rng.randint(1, 9)) + " " for _ in range(rng.randint(1, 4)))
        tag = rng.choice(["div", "section", "b", "a", "span"])
        return f"<{tag}>{inside}</{tag}>"

    for _ in range(60):
        nodes = html_text.ordered(html_text.parse(f"<body>{grow(4)}{grow(3)}</body>"), False)
        html_text.measure(nodes)

        def walk(n, linked=False):
            """Characters, tags, link characters, link tags under a node."""
            total = np.zeros(4, int)
            for p in n.parts:
                if isinstance(p, str):
                    k = len(" ".join(p.split()))
                    total += (k, 0, k * linked, 0)
                else:
                    counted = p.tag not in html_text.INLINE or p.tag == "a"
                    within = linked or p.tag == "a"
                    total += walk(p, within) + (0, counted, 0, counted and within)
            return total

        body = walk(nodes[0])
        for n in nodes:
            c, t, lc, lt = walk(n, n.tag == "a") + (0, 0, 0, n.tag == "a")
            if any(x.tag == "a" for x in nodes if x is not n and n.tag == "a"):
                continue  # links in links count once each
            if c > lc:
                t, one, lt = max(1, t), max(1, lc), max(1, lt)
                base = math.log(c * one / (c - one if c > one else 1) + c * max(1, body[2]) / max(1, body[0]) + math.e)
                assert (n.chars, n.link_chars) == (c, lc) and n.density == pytest.approx(c / t * max(0.0, math.log(c / one * t / lt, base)))
            else:
                assert n.density == 0.0


def test_html_takes_linear_time():
    deep = 20_000
    pages = ["<b>" * deep + "x" + "</i>" * deep, "<b>" * deep + "<div></div>" * deep, "<i><div>" + "<b>" * deep + "</i>" * deep + "y", "<table><tr><td>" * deep + "w", "<div>" * deep + "a" + "</p>" * deep, "<p>" + "long " * 2_000_000 + "</p>"]
    began = time.time()
    assert [len(html_text.main_text(p)) for p in pages] == [1, 0, 1, 1, 1, 9_999_999]
    assert time.time() - began < 20


def test_html_query(spark):
    """The article of every page of the table: its blocks are in the page, in order, and the parts around it are not."""
    pages = {r["page_id"]: r["html"] for r in table(spark, SMALL, "pages").collect()}
    found = queries.op6_html_text(spark, SMALL).collect()
    assert len(found) == len(pages)
    for r in found:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)
        if inner:
            plain = lambda x: " ".join(html_module.unescape(re.sub(r"<[^>]*>", " ", x)).split())
            assert "".join(r["text"].split()) in "".join(plain(inner[1]).split())
            headings = re.findall(r"<h1>(.*?)</h1>", inner[1], re.S)
            assert all(plain(h) in r["text"] for h in headings)


def test_html(spark):
    pages = spark.createDataFrame([(i, None, h, "t", 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    found = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert {i: r["text"] for i, r in found.items()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_mixing(spark, rows):
    docs = frame(spark, rows)
    found = mixing.mix_sources(docs).collect()
    clashing = docs.select("doc_id", "source", "text", F.lit(1).alias("copy"), F.lit("x").alias("shuffle_key"), F.lit(2).alias("d"), F.lit(3).alias("rate"))
    same = mixing.mixed_documents(clashing)
    assert same.columns == clashing.columns and same.count() == len(found) and {(r["copy"], r["shuffle_key"], r["d"], r["rate"]) for r in same.collect()} == {(1, "x", 2, 3)}
    assert [r["shuffle_key"] for r in found] == sorted(r["shuffle_key"] for r in found)
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "mid").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix_sources(many).groupBy("source").count().collect()}
    assert all(abs(n - 20_000 / 3) < 4 * (20_000 / 3) ** 0.5 for n in counts.values()) and set(counts) == {"hot", "mid", None}
    weighted = {r["source"]: r["count"] for r in mixing.mix_sources(many, {"hot": 1, "mid": 3}, budget=8_000).groupBy("source").count().collect()}
    assert set(weighted) == {"hot", "mid"} and abs(weighted["mid"] - 6_000) < 400
    rare = spark.createDataFrame([(i, "common") for i in range(3_000)] + [(9_999, "rare")], "doc_id long, source string")
    assert abs(mixing.mix_sources(rare).filter("source = 'rare'").count() - 1_500) < 200
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_salted(spark, monkeypatch):
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").alias("source"))
    with_broadcast = mixing.mix_sources(many).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert mixing.mix_sources(many).collect() == with_broadcast


def test_secrets(spark, rows):
    key = "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64))
    extra = [(500, "Password: 'abcdef1' token=abc token=token: abcdefgh api_key = \"x.y/z==\""), (501, "AKIA" + "Z" * 16 + " AKIA" + "Z" * 15), (502, "é" * 9 + "deadbeef" * 3 + " " + "0" * 23), (503, "secret:" + "ab12" * 8), (504, "token=a " * 300 + "token=abcdef " * 300), (505, f"see {key} there"), (506, "internationalization" * 3)]
    every = [*rows, *extra]
    found = secrets.find_secrets(frame(spark, every)).select("doc_id", secrets.written(F.col("base")).alias("base"), secrets.written(F.col("spans")).alias("spans")).collect()
    assert sorted((r["doc_id"], r["base"]) for r in found if r["doc_id"] is not None) == sorted((i, ",".join(brute.secret_spans(t))) for i, t in every if i is not None)
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert spans[505] == "random:4:68" and spans[506] == "" and all(set(r["base"].split(",")) <= {"", *r["spans"].split(",")} for r in found)
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def test_secrets_of_every_encoding(spark):
    rng = random.Random(11)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = {"HEX": "0123456789ABCDEF", "hex": "0123456789abcdef", "base32": upper + "234567", "base64": upper + upper.lower() + "0123456789+/"}
    keys = [(name, n, "".join(rng.choices(symbols, k=n))) for name, symbols in alphabets.items() for n in (20, 23, 31, 47, 95, 128) if name != "hex" or n < 24 for _ in range(20)]
    words = "the house of their father stands near an old river and nobody remembers when it was built there".upper().split()
    plain = ["".join(rng.choices(words, k=12))[:n] for n in (20, 31, 47) for _ in range(20)] + [w.lower() for w in ("".join(rng.choices(words, k=12))[:30] for _ in range(20))]
    plain += ["".join(rng.choices("0123456789", k=n)) for n in (20, 22, 23) for _ in range(5)] + ["DE89370400440532013000", "DEADBEEF" * 3, "F" * 30, "0123456789ABCDEF" * 2, "FFFFF0FFFFFFFF0FFF0FFFF"]
    found = {r["doc_id"] for r in secrets.find_secrets(frame(spark, list(enumerate([f"see {t} there" for *_, t in keys] + [f"see {t} there" for t in plain])))).filter("exists(spans, s -> s.kind = 3)").collect()}
    hits = {(name, n): sum(i in found for i, key in enumerate(keys) if key[:2] == (name, n)) for name, n, _ in keys}
    assert min(hits.values()) >= 16, hits
    assert not [t for i, t in enumerate(plain, len(keys)) if i in found]


def test_added_spans_match_brute_force(spark):
    """Keys of all encodings among ordinary runs, beside and across pattern matches."""
    rng = random.Random(21)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = ["0123456789ABCDEF", "0123456789abcdef", upper + "234567", upper + upper.lower() + "0123456789+/", upper.lower() + "-_"]
    texts = []
    for i in range(300):
        key = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(18, 130)))
        plain = "".join(w.title() if rng.random() < 0.5 else w for w in prose(rng, 14).split())[: rng.randint(18, 80)]
        texts.append(f"{prose(rng, 5)} é {key} {prose(rng, 3)} {plain}" + rng.choice(["", f" token={key[:30]}", f" {plain}AKIA{upper[:20]}{plain}", f" {key}deadbeef0123456789abcdef{key}", " AAAAAAAAAAAAAAAAAAAAAAAAAAAA", " /a/b/c/d/e/f/g/h/i/j/k/l"]))
    texts += [None, "", "x" * 9_000, "".join(rng.choices(alphabets[3], k=9_001))]
    want = brute.random_spans(texts)
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame(spark, list(enumerate(texts)))).collect()}
    got = [[(s["start"], s["end"]) for s in found[i] if s["kind"] == 3] for i in range(len(texts))]
    assert sum(map(len, want)) > 100
    assert got == want


def test_secrets_in_a_long_text(spark):
    """10 MB with many runs and spans, and one run of 3 MB: time and memory stay linear in the text."""
    rng = random.Random(1)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40))
    text = f"see {key} token=abcdef01 internationalizationsandmore " * 100_000 + key * 75_000
    began = time.time()
    (row,) = secrets.find_secrets(frame(spark, [(1, text)])).collect()
    assert sum(s["kind"] == 0 for s in row["spans"]) == 100_000 and sum(s["kind"] == 3 for s in row["spans"]) >= 100_000
    assert time.time() - began < 120


def test_battery(spark):
    rng = random.Random(2)
    tokens = {"hex": "".join(rng.choices("0123456789abcdef", k=400)), "flat": "A" * 400, "rising": "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 16}
    got = {n: spark.range(1).select(secrets.battery(F.lit(t)).alias("t")).first()["t"] for n, t in tokens.items()}
    counts = np.bincount([int(c, 16) for c in tokens["hex"]], minlength=16)
    x = np.array([int(c, 16) for c in tokens["hex"]], float)
    d = x - x.mean()
    assert got["hex"]["k"] == 16 and got["hex"]["chi"] == pytest.approx(((counts - 25) ** 2 / 25).sum())
    assert got["hex"]["serial"] == pytest.approx(((d[:-1] * d[1:]).sum() / (d**2).sum() + 1 / 400) * 20)
    assert abs(got["hex"]["runs"]) < 3 and got["flat"]["runs"] == 99 and got["rising"]["serial"] > 10


TEXTS = ["a  b", "", " x", "x ", "a \nb c", "foo<|endoftext|> bar <|endoftext|>", "don't we'll", "a  b　 c", "é è 日本 語 😀 😀", "1 2 33 444", " " * 70, "x" * 3000 + " y"]


def test_piece_encoder():
    encode = token_files.PieceEncoder(queries.tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in encode(pa.array(TEXTS))] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    encode = token_files.PieceEncoder(queries.tokenizer_path(name))
    assert not encode.cuts
    texts = [*TEXTS, "The quick  brown fox", "Don't SHOUT at me , please"]
    assert [x.tolist() for x in encode(pa.array(texts))] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_in_file_order(spark, rows, tmp_path):
    mixed = mixing.mixed_documents(frame(spark, [r for r in rows if r[0] is not None]))
    mixed.write.parquet(str(tmp_path / "mixed"))
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    folder = token_files.write_token_files(docs, str(tmp_path / "out"), queries.tokenizer_path(), order=token_files.file_order(docs))
    found = [r["doc_id"] for r in token_files.read_documents(spark, folder).orderBy("start").collect()]
    assert found == [r["doc_id"] for r in mixed.collect()] and found != sorted(found)


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    mine = [*rows, *((600 + i, t) for i, t in enumerate(TEXTS))]
    folder = token_files.write_token_files(frame(spark, mine), str(tmp_path / "out"), queries.tokenizer_path(), 2, 64)
    found = token_files.read_documents(spark, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {(i, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in mine}
    at = 0
    for r in found:
        assert r["start"] == at and r["n_masked"] == r["n_tokens"]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in mine), key=lambda i: (i is not None, i))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((i or -1, len(want[i, t]), crc(want[i, t])) for i, t in mine)
    ids, mask = token_files.read_sequence(folder, 0, 0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and not mask.flags.owndata and mask.dtype == np.uint8
    last = token_files.open_part(*token_files.open_store(f"{folder}/part-00000.arrow"))
    total = sum(len(last.get_batch(j)) for j in range(last.num_record_batches))
    tail = [token_files.read_sequence(folder, 0, j)[1].sum() for j in range(total)]
    assert all(x == 64 for x in tail[:-1]) and 1 <= tail[-1] <= 64 and total > 1
    empty = token_files.write_token_files(frame(spark, []), str(tmp_path / "none"), queries.tokenizer_path())
    assert token_files.read_documents(spark, empty).count() == 0


def test_chat(spark, tmp_path):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "### x </turn>\n\\h"), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "user", "only"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, None, "sys: ###\n", "first"), (None, 1, None, "lost"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.format_conversations(df)
    shuffled = chat_format.read_examples(spark, chat_format.write_examples(examples.repartition(7, "formatted"), str(tmp_path / "chat")))
    assert sorted(map(tuple, chat_format.digest(shuffled).collect()), key=repr) == sorted(map(tuple, chat_format.digest(examples).collect()), key=repr)
    found = {r["conv_id"]: r for r in chat_format.digest(examples).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv, r in found.items():
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert sorted((r["conv_id"], r["example"]) for r in examples.collect() if r["conv_id"]) == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_of_very_long_texts(spark):
    long = "x </turn> ### \\ " * 100_000
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", long) for i in range(4)], "conv_id long, turn long, role string, text string")
    (row,) = chat_format.digest(chat_format.format_conversations(df)).collect()
    assert row["n_turns"] == 4 and row["loss_chars"] == 2 * len(long) and row["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest()


def test_escapes_round_trip():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choices(["\\", "#", "###", "</turn>", "<", "\n", "h", "e", ":", "é"], k=rng.randint(0, 12)))
        body = chat_format.escape(text)
        assert chat_format.unescape(body) == text and "###" not in body and "</turn>" not in body
