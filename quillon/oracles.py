"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from quillon.functions.strings import CHARACTERS
from quillon.queries import TOPICS

# Common table expressions, each relying on those before it.
CTES = {
    "feats": "SELECT doc_id AS ord, feature, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS feature FROM documents) GROUP BY ALL",
    "firsts": "SELECT feature, min(ord) AS first FROM feats GROUP BY feature",
    "u": "SELECT ord, feature, CASE WHEN n > 0 THEN value / sqrt(n) ELSE 0.0 END AS w FROM (SELECT *, sum(value * value) OVER (PARTITION BY ord) AS n FROM feats)",
    "langs": "SELECT doc_id AS ord, list_position(['de', 'en', 'es', 'fr'], lang)::BIGINT AS cluster_id FROM documents",
    "comp": "SELECT cluster_id, feature, sum(w) AS s FROM u JOIN langs USING (ord) GROUP BY ALL",
    "cent": "SELECT cluster_id, feature, CASE WHEN q > 0 THEN s / sqrt(q) ELSE 0.0 END AS w FROM (SELECT *, sum(s * s) OVER (PARTITION BY cluster_id) AS q FROM comp)",
    "pts": "SELECT l.cluster_id, l.ord, l.ord::VARCHAR AS doc_id, coalesce(p.point, 0.0) AS point FROM langs l LEFT JOIN (SELECT u.ord, sum(u.w * c.w) AS point FROM u JOIN langs USING (ord) JOIN cent c USING (cluster_id, feature) GROUP BY u.ord) p USING (ord)",
    "ctop": "SELECT cluster_id, feature, w, row_number() OVER (PARTITION BY cluster_id ORDER BY round(abs(w), 9) DESC, first DESC, feature DESC) AS rank FROM cent JOIN firsts USING (feature) QUALIFY rank <= 50",
    "emb": "SELECT vec_id AS ord, (i - 1)::VARCHAR AS feature, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] <> 0",
    "evs": "SELECT user_id AS ord, event_type AS feature, count(*)::DOUBLE AS value FROM events GROUP BY ALL",
    "rawc": "SELECT regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS cent_ord, source AS cluster, feature, sum(w) AS w_raw FROM u JOIN documents d ON d.doc_id = u.ord GROUP BY ALL",
    "cents": "SELECT *, w_raw / sqrt(sum(w_raw * w_raw) OVER (PARTITION BY cent_ord)) AS w FROM rawc",
    "post": "SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY round(abs(w_raw), 9) DESC, cent_ord DESC) AS rank, cent_ord, w_raw FROM cents",
    "inv": "SELECT * FROM post WHERE rank <= 5",
    "keys": "SELECT ord, feature, row_number() OVER (PARTITION BY ord ORDER BY round(abs(w), 9) DESC, first DESC, feature DESC) AS k FROM u JOIN firsts USING (feature)",
    "cands": "SELECT DISTINCT ord, cent_ord FROM keys JOIN inv USING (feature) WHERE k <= 5",
    "defc": "SELECT DISTINCT ord, cent_ord FROM keys JOIN post USING (feature) WHERE k <= 20 AND rank <= 100",
    "start": "SELECT ord, feature, least(2, floor(r * 3))::INT AS topic FROM (SELECT ord, feature, (('0x' || substr(md5('12345|lda|' || ord || '|' || feature || '|' || i), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS r FROM (SELECT ord, feature, unnest(range(1, ceil(value)::INT + 1)) AS i FROM evs))",
    "theta": "SELECT ord, topic, (count(s.topic) + 50.0 / 3) / (any_value(t) + 50.0) AS p FROM (SELECT ord, count(*) AS t, unnest(range(3))::INT AS topic FROM start GROUP BY ord) LEFT JOIN start s USING (ord, topic) GROUP BY ord, topic",
    "phi": "SELECT topic, feature, (count(s.topic) + 0.01) / (any_value(n) + any_value(v) * 0.01) AS p FROM (SELECT z AS topic, feature, (SELECT count(*) FROM start WHERE topic = z) AS n, (SELECT count(DISTINCT feature) FROM start) AS v FROM (SELECT DISTINCT feature FROM start), (SELECT unnest(range(3))::INT AS z)) LEFT JOIN start s USING (topic, feature) GROUP BY topic, feature",
    "sims": "SELECT u.ord, c.cent_ord, c.cluster, sum(u.w * c.w) AS point FROM u JOIN cents c USING (feature) GROUP BY ALL HAVING sum(u.w * c.w) <> 0",
    "idfs": "SELECT ord, feature, value * ln((SELECT count(*) FROM documents)::DOUBLE / df) AS value FROM feats JOIN (SELECT feature, count(*) AS df FROM feats GROUP BY feature) USING (feature)",
    "rnd": "SELECT doc_id AS ord, (('0x' || substr(md5('12345|random|' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS r FROM documents",
    "parts": "SELECT doc_id AS ord, regexp_extract(source, '([0-9]+)$', 1)::INT % 4 AS child FROM documents",
    "pc": "SELECT child, feature, sum(w) AS s FROM u JOIN parts USING (ord) GROUP BY ALL",
    "pn": "SELECT child, sqrt(sum(s * s)) AS norm FROM pc GROUP BY child",
    "pd": "SELECT u.ord, c.child AS j, sum(u.w * c.s) AS d FROM u JOIN pc c USING (feature) GROUP BY ALL",
    "one": "SELECT ord, sum(w * w) AS n FROM u GROUP BY ord",
    "opts": "SELECT p.ord, p.child, b.child AS \"to\", round(sqrt(greatest(0.0, a.norm * a.norm + o.n - 2 * coalesce(x.d, 0))) + sqrt(greatest(0.0, b.norm * b.norm + o.n + 2 * coalesce(y.d, 0))) - a.norm - b.norm, 12) AS gain FROM parts p JOIN one o USING (ord) JOIN pn a ON a.child = p.child JOIN pn b ON b.child <> p.child LEFT JOIN pd x ON x.ord = p.ord AND x.j = p.child LEFT JOIN pd y ON y.ord = p.ord AND y.j = b.child",
    "best": "SELECT * FROM opts QUALIFY row_number() OVER (PARTITION BY ord ORDER BY gain DESC, \"to\") = 1",
    "pairs": "SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1",
    "sq": "SELECT ord, sum(value * value) AS q FROM feats GROUP BY ord",
    "inn": "SELECT a, b, coalesce(prod, 0.0) AS prod, sqrt(coalesce(x.q, 0)) AS na, sqrt(coalesce(y.q, 0)) AS nb FROM pairs LEFT JOIN (SELECT a, b, sum(f.value * g.value) AS prod FROM pairs JOIN feats f ON f.ord = a JOIN feats g ON g.ord = b AND g.feature = f.feature GROUP BY ALL) USING (a, b) LEFT JOIN sq x ON x.ord = a LEFT JOIN sq y ON y.ord = b",
    "uni": "SELECT a, b, sum((coalesce(x, 0) - coalesce(y, 0)) ** 2) AS e FROM (SELECT a, b, feature, sum(x) AS x, sum(y) AS y FROM (SELECT a, b, feature, value AS x, 0.0 AS y FROM pairs JOIN feats ON ord = a UNION ALL SELECT a, b, feature, 0.0, value FROM pairs JOIN feats ON ord = b) GROUP BY ALL) GROUP BY ALL",
    "evp": "SELECT a.ord, coalesce(a.feature, b.feature) AS feature, a.value AS x, b.value AS y FROM (SELECT * FROM evs WHERE ord + 1 IN (SELECT ord FROM evs)) a FULL JOIN (SELECT ord - 1 AS ord, feature, value FROM evs WHERE ord - 1 IN (SELECT ord FROM evs)) b USING (ord, feature)",
}
NEEDS = {"firsts": ["feats"], "u": ["feats"], "comp": ["u", "langs"], "cent": ["comp"], "pts": ["cent", "u", "langs"], "ctop": ["cent", "firsts"], "rawc": ["u"], "cents": ["rawc"], "post": ["cents"], "inv": ["post"], "keys": ["u", "firsts"], "cands": ["keys", "inv"], "defc": ["keys", "post"], "start": ["evs"], "theta": ["start"], "phi": ["start"], "sims": ["u", "cents"], "idfs": ["feats"], "pc": ["u", "parts"], "pn": ["pc"], "pd": ["u", "pc"], "one": ["u"], "opts": ["parts", "one", "pn", "pd"], "best": ["opts"], "sq": ["feats"], "inn": ["pairs", "feats", "sq"], "uni": ["pairs", "feats"], "evp": ["evs"]}


def sql(select: str, *needs: str) -> str:
    """The select with the expressions that it needs in front."""
    parts: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if (text := f"{n} AS MATERIALIZED ({CTES[n]})") not in parts:
            parts.append(text)

    for n in needs:
        add(n)
    return f"WITH {', '.join(parts)} {select}" if parts else select


def _top(k: int, source: str = "sims") -> str:
    return f"SELECT ord, rank, cluster, round(point, 6) + 0.0 AS point FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(point, 9) DESC, cent_ord DESC) AS rank FROM {source}) WHERE rank <= {k}"


SIX = "regexp_replace(regexp_replace(regexp_replace(printf('%.6g', w), '(\\.[0-9]*?)0+$', '\\1'), '(\\.[0-9]*?)0+e', '\\1e'), '\\.(e|$)', '\\1')"


def _number(tag: str, key: str) -> str:
    return f"((('0x' || substr(md5('12345|{tag}|' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _plsi(steps: int) -> str:
    """pLSI by unrolled EM steps; frames d{i}, w{i} (wide) and z{i} (one row)."""
    ks = range(TOPICS)
    parts = [f"feats AS MATERIALIZED ({CTES['feats']})"]
    for name, key, table in (("d", "ord", "d"), ("w", "feature", "w")):
        draws = ", ".join(f"{_number(f'plsi-{name}-{z}', key)} AS r{z}" for z in ks)
        total = " + ".join(f"r{z}" for z in ks)
        parts.append(f"{table}0 AS MATERIALIZED (SELECT {key}, {', '.join(f'r{z} / ({total}) AS {name}{z}' for z in ks)} FROM (SELECT {key}, {draws} FROM (SELECT DISTINCT {key} FROM feats)))")
    parts.append("z0 AS MATERIALIZED (SELECT " + ", ".join(f"1.0::DOUBLE / {TOPICS} AS p{z}" for z in ks) + ")")
    parts.append("tot AS MATERIALIZED (SELECT sum(value) AS v FROM feats)")
    for i in range(1, steps + 1):
        j = i - 1
        numer = ", ".join(f"p{z} * pow(w{z} * d{z}, 0.75) AS n{z}" for z in ks)
        total = " + ".join(f"n{z}" for z in ks)
        parts.append(f"x{i} AS MATERIALIZED (SELECT ord, feature, {', '.join(f'value * n{z} / ({total}) AS x{z}' for z in ks)} FROM (SELECT ord, feature, value, {numer} FROM feats JOIN d{j} USING (ord) JOIN w{j} USING (feature), z{j}) WHERE {total} > 0)")
        parts.append(f"s{i} AS MATERIALIZED (SELECT {', '.join(f'sum(x{z}) AS t{z}' for z in ks)} FROM x{i})")
        for name, key in (("d", "ord"), ("w", "feature")):
            parts.append(f"{name}{i} AS MATERIALIZED (SELECT {key}, {', '.join(f'sum(x{z}) / any_value(t{z}) AS {name}{z}' for z in ks)} FROM x{i}, s{i} GROUP BY {key})")
        parts.append(f"z{i} AS MATERIALIZED (SELECT {', '.join(f't{z} / v AS p{z}' for z in ks)} FROM s{i}, tot)")
    return "WITH " + ", ".join(parts)


def _members(normalized: bool, digits: int | None = 9) -> str:
    total = " + ".join(f"d{z} * p{z}" for z in range(TOPICS))
    value = lambda z: f"d{z} * p{z}" + (f" / ({total})" if normalized else "")
    each = [f"SELECT ord, {z} AS topic, {value(z) if digits is None else f'round({value(z)}, {digits})'} AS p FROM d2, z2" for z in range(TOPICS)]
    return f"{_plsi(2)} {' UNION ALL '.join(each)}"


CLASSIFIED = "d.doc_id || coalesce(chr(9) || string_agg(t.cluster || chr(9) || printf('%.6f', t.point), chr(9) ORDER BY t.rank), '') AS line FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(point, 9) DESC, cent_ord DESC) AS rank FROM sims QUALIFY rank <= 3) t ON t.ord = d.doc_id GROUP BY d.doc_id"

def _smart_seeds(k: int) -> str:
    """The weighted draw by unrolled steps: seed s{i} and the smallest distances c{i} after it."""
    parts = [f"u AS MATERIALIZED ({CTES['u']})", f"s0 AS MATERIALIZED (SELECT arg_min(doc_id, {_number('smart-0', 'doc_id')}) AS s FROM documents)", "c0 AS MATERIALIZED (SELECT doc_id AS ord, 2.0::DOUBLE AS c FROM documents)"]
    parts.insert(0, f"feats AS MATERIALIZED ({CTES['feats']})")
    for i in range(1, k):
        sim = f"SELECT u.ord, sum(u.w * o.w) AS sim FROM u JOIN u o USING (feature) WHERE o.ord = (SELECT s FROM s{i - 1}) GROUP BY u.ord"
        parts.append(f"c{i} AS MATERIALIZED (SELECT c.ord, greatest(0.0, least(c.c, 1 - coalesce(x.sim, 0.0))) AS c FROM c{i - 1} c LEFT JOIN ({sim}) x ON x.ord = c.ord)")
        parts.append(f"s{i} AS MATERIALIZED (SELECT arg_min(ord, -ln({_number(f'smart-{i}', 'ord')}) / c) AS s FROM c{i} WHERE c > 1e-12)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {i} AS idx, s AS ord FROM s{i}" for i in range(k))


MEASURES = {
    "inner": "prod",
    "cosine": "CASE WHEN na * nb <> 0 THEN prod / (na * nb) ELSE 0.0 END",
    "jaccard": "CASE WHEN na + nb - prod <> 0 THEN prod / (na + nb - prod) ELSE 0.0 END",
}

ORACLES: dict[str, str] = {
    "tsv_parse": sql("SELECT ord, 'doc' || ord AS doc_id, feature, value FROM feats", "feats"),
    "vocab_codes": sql("SELECT feature, row_number() OVER (ORDER BY first, feature) - 1 AS code FROM firsts", "firsts"),
    "vec_norm": sql("SELECT ord, count(*) AS n, round(sum(value * value), 6) AS norm_squared, round(sqrt(sum(value * value)), 6) AS norm FROM feats GROUP BY ord", "feats"),
    "vec_normalize": sql("SELECT ord, feature, round(w, 6) + 0.0 AS w FROM u", "u"),
    "vec_scale": sql("SELECT ord, feature, round(value * 2.5, 6) + 0.0 AS value FROM emb", "emb"),
    "vec_sorted": sql("SELECT ord, feature, round(value, 6) + 0.0 AS value, row_number() OVER (PARTITION BY ord ORDER BY emb.value DESC, feature DESC) AS rank FROM emb", "emb"),
    "vec_sorted_abs": sql("SELECT ord, feature, round(value, 6) + 0.0 AS value, row_number() OVER (PARTITION BY ord ORDER BY abs(emb.value) DESC, feature DESC) AS rank FROM emb", "emb"),
    "vec_topn": sql("SELECT ord, feature, value, row_number() OVER (PARTITION BY ord ORDER BY abs(value) DESC, first DESC, feature DESC) AS rank FROM feats JOIN firsts USING (feature) QUALIFY rank <= 10", "firsts", "feats"),
    "vec_add": sql("SELECT ord, feature, round(sum(value), 6) + 0.0 AS value FROM (SELECT ord, feature, value FROM emb UNION ALL SELECT ord - 1, feature, value FROM emb) GROUP BY ALL", "emb"),
    "vec_sub": sql("SELECT ord, feature, round(sum(value), 6) + 0.0 AS value FROM (SELECT ord, feature, value FROM emb UNION ALL SELECT ord - 1, feature, -value FROM emb) GROUP BY ALL", "emb"),
    "vec_get_default": sql("SELECT doc_id AS ord, coalesce(value, 0.0) AS value FROM documents LEFT JOIN feats ON ord = doc_id AND feature = 'the'", "feats"),
    **{f"pair_{n}": sql(f"SELECT a, b, round({e}, 6) + 0.0 AS \"{n}\" FROM inn", "inn") for n, e in MEASURES.items()},
    "pair_euclid": sql("SELECT a, b, round(sqrt(coalesce(e, 0)), 6) + 0.0 AS euclid FROM pairs LEFT JOIN uni USING (a, b)", "uni"),
    "pair_euclid_sq": sql("SELECT a, b, round(coalesce(e, 0), 6) + 0.0 AS euclid_sq FROM pairs LEFT JOIN uni USING (a, b)", "uni"),
    "vec_map_measures": sql(
        "SELECT ord, round(p, 6) + 0.0 AS \"inner\", round(CASE WHEN na * nb <> 0 THEN p / (na * nb) ELSE 0.0 END, 6) + 0.0 AS cosine, round(CASE WHEN na + nb - p <> 0 THEN p / (na + nb - p) ELSE 0.0 END, 6) + 0.0 AS jaccard, round(sqrt(e), 6) + 0.0 AS euclid, round(e, 6) + 0.0 AS euclid_sq FROM (SELECT ord, coalesce(sum(x * y), 0.0) AS p, sqrt(sum(coalesce(x, 0) ** 2)) AS na, sqrt(sum(coalesce(y, 0) ** 2)) AS nb, sum((coalesce(x, 0) - coalesce(y, 0)) ** 2) AS e FROM evp GROUP BY ord)",
        "evp",
    ),
    "vec_map_functions": sql(
        "SELECT ord, count(x) AS size, round(sqrt(sum(x * x)), 6) + 0.0 AS norm, 1.0::DOUBLE AS unit_norm, round(9 * sum(x * x) + 2.25, 6) + 0.0 AS edited_norm_squared, coalesce(max(x) FILTER (feature = 'click'), 0.0) AS click, 0.0::DOUBLE AS absent, string_agg(feature, ',' ORDER BY x DESC, feature DESC) FILTER (x IS NOT NULL) AS sorted_keys, 'extra' AS least_abs_key, least(2, count(x)) AS resized, round(sum((coalesce(x, 0) + coalesce(y, 0)) ** 2), 6) + 0.0 AS sum_norm_squared, 0::BIGINT AS cleared FROM evp GROUP BY ord",
        "evp",
    ),
    "doc_freq": sql("SELECT feature, count(*) AS df FROM feats GROUP BY feature", "feats"),
    "idf_weight": sql("SELECT ord, feature, round(value, 6) + 0.0 AS value FROM idfs", "idfs"),
    "standard_score": sql("SELECT ord, feature, round(10 * CASE WHEN sd > 0 THEN (value - mean) / sd ELSE 0.0 END + 50, 6) + 0.0 AS value FROM feats, (SELECT avg(value) AS mean, stddev_pop(value) AS sd FROM feats)", "feats"),
    "cluster_composite": sql("SELECT cluster_id, feature, round(s, 6) + 0.0 AS s FROM comp", "comp"),
    "cluster_centroid": sql("SELECT cluster_id, feature, round(w, 6) + 0.0 AS w FROM cent", "cent"),
    "cluster_points": sql("SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(pts.point, 9) DESC, ord) AS pos, ord, doc_id, round(point, 6) + 0.0 AS point FROM pts", "pts"),
    "centroid_topn": sql("SELECT cluster_id, rank, feature, round(w, 6) + 0.0 AS w FROM ctop", "ctop"),
    "cluster_size": sql("SELECT cluster_id, count(*) AS size FROM langs GROUP BY cluster_id", "langs"),
    "choose_random_seeds": sql("SELECT ord, round(r, 6) + 0.0 AS r FROM (SELECT * FROM rnd ORDER BY rnd.r, ord LIMIT 10)", "rnd"),
    "smart_seeds": _smart_seeds(4),
    "section_assign": sql(
        "SELECT ord, cluster_id FROM (SELECT d.doc_id AS ord, s.i AS cluster_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY round(coalesce(x.sim, 0), 9) DESC, s.i) AS k FROM documents d CROSS JOIN (SELECT ord, row_number() OVER (ORDER BY r, ord) - 1 AS i FROM rnd QUALIFY i < 5) s LEFT JOIN (SELECT u.ord, o.ord AS seed, sum(u.w * o.w) AS sim FROM u JOIN u o USING (feature) WHERE o.ord IN (SELECT ord FROM rnd ORDER BY r, ord LIMIT 5) GROUP BY ALL) x ON x.ord = d.doc_id AND x.seed = s.ord) WHERE k = 1",
        "u",
        "rnd",
    ),
    "section_gain": sql("SELECT 1::BIGINT AS cluster_id, round((SELECT sum(n) FROM (SELECT sqrt(sum(s * s)) AS n FROM comp GROUP BY cluster_id)) - (SELECT sqrt(sum(t * t)) FROM (SELECT sum(w) AS t FROM u GROUP BY feature)), 6) + 0.0 AS gain", "comp", "u"),
    "refine_delta": sql('SELECT ord, child, "to", round(gain, 6) + 0.0 AS gain FROM best', "best"),
    "refine_one_pass": sql('SELECT p.ord, CASE WHEN b.gain > 1e-12 THEN b."to" ELSE p.child END AS child FROM parts p LEFT JOIN best b USING (ord)', "best", "parts"),
    "cluster_text": sql("SELECT cluster_id, cluster_id || chr(9) || string_agg(doc_id || chr(9) || printf('%.6f', point), chr(9) ORDER BY round(point, 9) DESC, ord) AS line FROM pts GROUP BY cluster_id", "pts"),
    "cluster_text_plain": sql("SELECT cluster_id, cluster_id || chr(9) || string_agg(doc_id, chr(9) ORDER BY round(point, 9) DESC, ord) AS line FROM pts GROUP BY cluster_id", "pts"),
    "cluster_member_text": sql("SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(point, 9) DESC, ord) AS pos, cluster_id || chr(9) || doc_id || chr(9) || printf('%.6f', point) AS line FROM pts", "pts"),
    "clusters_by_size": sql("SELECT cluster_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS place FROM langs GROUP BY cluster_id", "langs"),
    "composite_after_removal": sql("SELECT cluster_id, feature, round(sum(w), 6) + 0.0 AS s FROM u JOIN langs USING (ord) WHERE ord % 10 <> 0 GROUP BY ALL", "u", "langs"),
    "vec_entries": sql("SELECT ord, feature AS key, x AS value FROM evp WHERE x IS NOT NULL", "evp"),
    "text_corpus": sql("SELECT o AS ord, 'doc' || f.ord AS doc_id, feature, value FROM feats f JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) d ON d.doc_id = f.ord", "feats"),
    "stream_classified": sql(f"SELECT line FROM (SELECT {CLASSIFIED}) UNION ALL SELECT '' AS line FROM documents WHERE doc_id % 10 = 0", "sims"),
    "centroid_count": sql("SELECT count(DISTINCT cent_ord) AS n FROM cents", "cents"),
    "lda_start_theta": sql("SELECT ord, topic, round(p, 9) AS p FROM theta", "theta"),
    "lda_start_phi": sql("SELECT topic, feature, round(p, 9) AS p FROM phi", "phi"),
    "theta_text": sql("SELECT ord, 'user' || ord || chr(9) || string_agg(printf('%.6f', p), chr(9) ORDER BY topic) AS line FROM theta GROUP BY ord", "theta"),
    "phi_text": sql("SELECT topic, topic || chr(9) || string_agg(feature || chr(9) || printf('%.6f', p), chr(9) ORDER BY first, feature) AS line FROM phi JOIN (SELECT feature, min(ord) AS first FROM evs GROUP BY feature) USING (feature) GROUP BY topic", "phi", "evs"),
    "plsi_pdz": f"{_plsi(1)} SELECT ord, {', '.join(f'round(d{z}, 9) AS d{z}' for z in range(TOPICS))} FROM d1",
    "plsi_pz": f"{_plsi(2)} {' UNION ALL '.join(f'SELECT {z} AS topic, round(p{z}, 9) AS p FROM z2' for z in range(TOPICS))}",
    "random_strings": f"SELECT id, string_agg(substr('{CHARACTERS}', floor(r * {len(CHARACTERS)})::INT + 1, 1), '' ORDER BY i) AS s FROM (SELECT id, i, {_number('character', "id || '|' || i")} AS r FROM (SELECT id, unnest(range(1, size + 1)) AS i FROM (SELECT n_nationkey::BIGINT AS id, greatest(1, floor({_number('size', 'n_nationkey')} * 20))::INT AS size FROM nation))) GROUP BY id",
    "centroid_text": sql(f"SELECT cluster_id, cluster_id || chr(9) || string_agg(feature || chr(9) || {SIX}, chr(9) ORDER BY rank) AS line FROM ctop GROUP BY cluster_id", "ctop"),
    "classified_text": sql(f"SELECT d.doc_id AS ord, {CLASSIFIED}", "sims"),
    "stream_batch_lines": sql(f"SELECT {CLASSIFIED}", "sims"),
    "vector_text": sql("SELECT ord, string_agg(feature || chr(9) || printf('%.4f', x), chr(9) ORDER BY feature) AS line FROM evp WHERE x IS NOT NULL GROUP BY ord", "evp"),
    "membership_text": f"SELECT ord, ord || chr(9) || string_agg(printf('%.6f', p), chr(9) ORDER BY topic) AS line FROM ({_members(True, None)}) GROUP BY ord",
    "inverted_index": sql("SELECT feature, rank, cent_ord, round(w_raw, 6) + 0.0 AS w_raw FROM inv", "inv"),
    "index_candidates": sql("SELECT ord, cent_ord FROM cands", "cands"),
    "classify_indexed": sql(_top(20, "(SELECT * FROM sims SEMI JOIN defc USING (ord, cent_ord))"), "sims", "defc"),
    "classify_truncated": sql(_top(5, "(SELECT * FROM sims SEMI JOIN cands USING (ord, cent_ord))"), "sims", "cands"),
    "classify_all": sql(_top(5), "sims"),
    "classify_idf": sql(
        _top(5, "(SELECT i.ord, c.cent_ord, c.cluster, sum(i.w * c.w) AS point FROM (SELECT ord, feature, CASE WHEN n > 0 THEN value / sqrt(n) ELSE 0.0 END AS w FROM (SELECT *, sum(value * value) OVER (PARTITION BY ord) AS n FROM idfs)) i JOIN cents c USING (feature) GROUP BY ALL HAVING sum(i.w * c.w) <> 0)"),
        "idfs",
        "cents",
    ),
    "plsi_em_step": f"{_plsi(1)} SELECT feature, {', '.join(f'round(w{z}, 9) AS w{z}' for z in range(TOPICS))} FROM w1",
    "plsi_membership": _members(False),
    "plsi_membership_norm": _members(True),
    "lda_tokens": f"SELECT ord, feature, i::INT AS i, least({TOPICS - 1}, floor(r * {TOPICS}))::INT AS topic FROM (SELECT ord, feature, i, {_number('lda', "ord || '|' || feature || '|' || i")} AS r FROM (SELECT ord, feature, unnest(range(1, ceil(value)::INT + 1)) AS i FROM (SELECT l_suppkey AS ord, l_partkey::VARCHAR AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)))",
    "file_extension": "SELECT page_id, regexp_extract(url, '\\.([^.]*)$', 1) AS extension FROM pages",
    "split_tokens": "SELECT page_id, (generate_subscripts(t, 1) - 1)::INT AS pos, unnest(t) AS token FROM (SELECT page_id, list_filter(string_split_regex(url, '[/.:?&=]'), lambda x: x <> '') AS t FROM pages)",
}
