"""SQL equivalents of the core queries, run by DuckDB on the same tables.

Every statement covers the whole tables.  Sentences are cut by inserting a private-use character
behind each terminator, since the regular expressions there have no lookbehind.
"""

from __future__ import annotations

from ..functions.text import STOP_WORDS

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}+', ' ', 'g'))"


def _split(x: str) -> str:
    cut = f"regexp_replace({_collapsed(x)}, '([.!?。！？]) *', '\\1' || chr(57345), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(57345)), lambda p: trim(p)), lambda p: p <> '')"


def _n(x: str) -> str:
    return f"len(string_split({x}, ' '))"


def _kept(x: str) -> str:
    return f"list_filter({_split(x)}, lambda p: {_n('p')} >= 3)"


def _long(table: str, key: str, column: str, name: str) -> str:
    return f"SELECT {key}, CAST(generate_subscripts({column}, 1) - 1 AS BIGINT) AS pos, unnest({column}) AS {name} FROM {table}"


_D = f"d AS (SELECT doc_id, {_kept('text')} AS sents FROM documents)"
_S = f"{_D}, s0 AS ({_long('d', 'doc_id', 'sents', 'sentence')}), s AS (SELECT doc_id, pos, sentence, {_n('sentence')} AS n, count(*) OVER (PARTITION BY doc_id) AS cnt FROM s0)"
_PLAIN = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' '), lambda t: t <> '')"


def _plain(x: str) -> str:
    return f"list_filter({_PLAIN.format(x)}, lambda t: NOT list_contains({_STOPS}, t) AND length(t) > 1)"


def _pairs(tokens: str, joint: str) -> str:
    return f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || '{joint}' || {tokens}[i + 1])"


_VECTOR = "regexp_extract_all(lower(sentence), '[\\p{L}\\p{N}_]{2,}')"


def _tf_isf(tokens: str, weight: str, norm: str) -> str:
    """CTEs up to raw(doc_id, pos, raw)."""
    return f"""tk AS (SELECT doc_id, pos, cnt, {tokens} AS toks FROM s),
    t1 AS (SELECT doc_id, pos, cnt, len(toks) AS m, unnest(toks) AS tok FROM tk),
    c1 AS (SELECT doc_id, pos, cnt, m, tok, count(*) AS c FROM t1 GROUP BY ALL),
    c2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, tok) AS f FROM c1),
    r1 AS (SELECT doc_id, pos, sum(({weight}) * ln(cnt / (1.0 + f)::DOUBLE)) / {norm} AS raw FROM c2 GROUP BY doc_id, pos, m),
    raw AS (SELECT s.doc_id, s.pos, s.n, s.cnt, round(coalesce(r1.raw, 0.0), 12) AS raw FROM s LEFT JOIN r1 ON s.doc_id = r1.doc_id AND s.pos = r1.pos)"""


_W = "PARTITION BY doc_id"


def _over_max(x: str) -> str:
    return f"({x}) / (CASE WHEN max({x}) OVER ({_W}) = 0 THEN 1.0 ELSE max({x}) OVER ({_W}) END)"


def _minmax(x: str, constant: str = "0.5", small: str = "< 1e-9") -> str:
    low, high = f"min({x}) OVER ({_W})", f"max({x}) OVER ({_W})"
    return f"(CASE WHEN {high} - {low} {small} THEN {constant} ELSE (({x}) - {low}) / ({high} - {low}) END)"


_V1 = _tf_isf("string_split(lower(sentence), ' ')", "c", "1.0")
_POSITION = "(CASE WHEN cnt = 1 THEN 1.0 ELSE 1.0 - pos::DOUBLE / (cnt - 1) END)"
_PARTS = f"""WITH {_S}, {_V1}, parts AS (SELECT doc_id, pos, n, {_over_max('raw')} AS importance, {_over_max('least(n, 40)::DOUBLE')} AS length, {_POSITION} AS position FROM raw)"""
_BASE = f"{_PARTS}, base AS (SELECT doc_id, pos, n, {_over_max('importance + 0.3 * length + 0.3 * position')} AS score FROM parts)"


def _vectors(tokens: str, tf: str) -> str:
    """CTEs up to w(doc_id, pos, tok, w): unit rows."""
    return f"""vt AS (SELECT doc_id, pos, cnt, unnest({tokens}) AS tok FROM s),
    v1 AS (SELECT doc_id, pos, cnt, tok, count(*) AS c FROM vt GROUP BY ALL),
    v2 AS (SELECT *, ({tf}) * (ln((1.0 + cnt) / (1.0 + count(*) OVER (PARTITION BY doc_id, tok))) + 1.0) AS u FROM v1),
    w AS (SELECT doc_id, pos, tok, u / sqrt(sum(u * u) OVER (PARTITION BY doc_id, pos)) AS w FROM v2)"""


_UNI = f"WITH {_S}, {_vectors(_VECTOR, 'c')}"
_BI = f"WITH {_S.replace('s AS (', 's AS MATERIALIZED (')}, {_vectors(f'list_concat({_VECTOR}, ' + _pairs(_VECTOR, ' ') + ')', '1.0 + ln(c)')}"
_SUMS = """tot AS (SELECT doc_id, tok, sum(w) AS t FROM w GROUP BY ALL),
    rs0 AS (SELECT w.doc_id, w.pos, sum(w.w * tot.t) AS r FROM w JOIN tot ON w.doc_id = tot.doc_id AND w.tok = tot.tok GROUP BY ALL),
    rs AS (SELECT s.doc_id, s.pos, s.cnt, coalesce(r, 0.0) AS r FROM s LEFT JOIN rs0 ON s.doc_id = rs0.doc_id AND s.pos = rs0.pos)"""
_CENTROID = """len2 AS (SELECT doc_id, sqrt(sum(t * t)) AS l FROM (SELECT doc_id, tok, sum(w) AS t FROM w GROUP BY ALL) GROUP BY doc_id),
    cc AS (SELECT rs.doc_id, rs.pos, coalesce(r / l, 0.0) AS c FROM rs LEFT JOIN len2 ON rs.doc_id = len2.doc_id)"""
_SIM = "sim AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.w * b.w) AS x FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.tok = b.tok GROUP BY ALL)"


def _top(order: str, source: str, k: int = 5) -> str:
    return f"SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER ({_W} ORDER BY {order}, pos) AS r FROM {source}) WHERE r <= {k}"


_P = "p AS (SELECT id, max_by({0}, {0}) AS v FROM processed WHERE id IS NOT NULL GROUP BY id), pd AS (SELECT id, list_filter(v.sentences, lambda s: s IS NOT NULL) AS sents FROM p WHERE v.sentences IS NOT NULL)".format("struct_pack(sentences := sentences, highlights := highlights)")


def _view(k: int) -> str:
    # as in the query, a null selection counts as the last one too
    return f"v{k} AS (SELECT id, arg_max(struct_pack(s := selected_indices), struct_pack(a := written_at, b := pred_id)).s AS sel FROM predictions WHERE run_id = (SELECT run_id FROM runs WHERE stage_name = 'stage1' AND keep_k = 10 ORDER BY run_no LIMIT 1 OFFSET {k}) AND id IS NOT NULL GROUP BY id)"


def _union(cut: str) -> str:
    joins = " ".join(f"LEFT JOIN v{k} ON v{k}.id = pd.id" for k in range(3))
    parts = ", ".join(f"coalesce(v{k}.sel{cut}, [])" for k in range(3))
    every = f"list_concat(list_concat({parts.split(', coalesce')[0]}, coalesce{parts.split(', coalesce')[1]}), coalesce{parts.split(', coalesce')[2]})"
    return f"""WITH {_P}, {_view(0)}, {_view(1)}, {_view(2)},
    u AS (SELECT pd.id, pd.sents, list_sort(list_distinct(list_filter({every}, lambda i: i >= 0 AND i < len(pd.sents)))) AS places FROM pd {joins})"""


# base scores of processed records: tokens by white space, sentences as they are
_PS = f"ps AS ({_long('pd', 'id AS doc_id', 'sents', 'raw')}), s AS (SELECT doc_id, pos, list_filter(string_split(lower({_collapsed('raw')}), ' '), lambda t: t <> '') AS words, count(*) OVER (PARTITION BY doc_id) AS cnt FROM ps)"
_PBASE = f"""{_PS.replace("AS words, count", "AS words, len(list_filter(string_split(lower(" + _collapsed('raw') + "), ' '), lambda t: t <> '')) AS n, count")}, {_tf_isf('words', 'c', '1.0')},
    parts AS (SELECT doc_id, pos, {_over_max('raw')} AS importance, {_over_max('least(n, 40)::DOUBLE')} AS length, {_POSITION} AS position FROM raw),
    base AS (SELECT doc_id, pos, {_over_max('importance + 0.3 * length + 0.3 * position')} AS score FROM parts)"""


def _steps(n: int) -> str:
    """CTEs p0 to pn of the damped iteration over e(doc_id, i, j, x)."""
    out = ["p0 AS MATERIALIZED (SELECT doc_id, pos, cnt, 1.0::DOUBLE / cnt AS p FROM s)"]
    for k in range(n):
        out.append(f"""p{k + 1} AS MATERIALIZED (SELECT a.doc_id, a.pos, a.cnt, coalesce(b.q, 0.0) * 0.85 + 0.15::DOUBLE / a.cnt AS p FROM p{k} a
            LEFT JOIN (SELECT e.doc_id, e.j, sum(e.x * p{k}.p) AS q FROM e JOIN p{k} ON e.doc_id = p{k}.doc_id AND e.i = p{k}.pos GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.pos = b.j)""")
    return ", ".join(out)


def _fused() -> str:
    """Half base score, half centroid cosine of the pool's own 1-2-gram vectors, both rescaled."""
    pairs = f"list_concat({_VECTOR}, {_pairs(_VECTOR, ' ')})"
    own = f"{_vectors(pairs, '1.0 + ln(c)')}, {_SUMS}, {_CENTROID}".replace("FROM s)", "FROM s2)").replace("FROM s LEFT", "FROM s2 LEFT").replace("s.doc_id, s.pos, s.cnt", "s2.doc_id, s2.pos, s2.cnt").replace("s.doc_id = rs0.doc_id AND s.pos = rs0.pos", "s2.doc_id = rs0.doc_id AND s2.pos = rs0.pos")
    a, b = _minmax("score", "0.0", "<= 1e-12"), _minmax("c", "0.0", "<= 1e-12")
    return f"""pool AS (SELECT *, row_number() OVER ({_W} ORDER BY score DESC, pos) AS r FROM base),
    s2 AS (SELECT pool.doc_id, pool.pos, pool.n, pool.score, s.sentence, count(*) OVER (PARTITION BY pool.doc_id) AS cnt FROM pool JOIN s ON s.doc_id = pool.doc_id AND s.pos = pool.pos WHERE r <= 15),
    {own}, j AS (SELECT s2.doc_id, s2.pos, s2.n, s2.score, cc.c FROM s2 JOIN cc ON cc.doc_id = s2.doc_id AND cc.pos = s2.pos),
    fused AS (SELECT doc_id, pos, n, 0.5::DOUBLE * {a} + 0.5::DOUBLE * {b} AS score FROM j)"""


def _greedy(cost: str, limit: int, scored: str | None = None, source: str = "base") -> str:
    """Greedy marginal relevance over the pool of the 15 best scores; selections grow in a list."""
    base = _BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{base}, {scored or _vectors(_VECTOR, 'c')}, {_SIM},
    c AS MATERIALIZED (SELECT doc_id, pos, {cost} AS n, round(score * 1e10) / 1e10 AS score FROM (SELECT *, row_number() OVER ({_W} ORDER BY score DESC, pos) AS r FROM {source}) WHERE r <= 15),
    x AS MATERIALIZED (SELECT sim.doc_id, i, j, round(x * 1e10) / 1e10 AS x FROM sim JOIN c a ON a.doc_id = sim.doc_id AND a.pos = i JOIN c b ON b.doc_id = sim.doc_id AND b.pos = j),
    g AS (SELECT doc_id, CAST([] AS BIGINT[]) AS sel, CAST(0 AS BIGINT) AS used FROM d
        UNION ALL SELECT doc_id, list_append(any_value(sel), arg_max(pos, o)), any_value(used) + arg_max(n, o)
        FROM (SELECT g.doc_id, any_value(g.sel) AS sel, any_value(g.used) AS used, c.pos, any_value(c.n) AS n,
                struct_pack(u := round((0.7::DOUBLE * any_value(c.score) - (1 - 0.7::DOUBLE) * coalesce(max(x.x) FILTER (WHERE list_contains(g.sel, x.j)), 0.0)) * 1e10), p := -c.pos) AS o
            FROM g JOIN c ON c.doc_id = g.doc_id AND NOT list_contains(g.sel, c.pos) AND g.used + c.n <= {limit} LEFT JOIN x ON x.doc_id = c.doc_id AND x.i = c.pos GROUP BY g.doc_id, c.pos) q
        GROUP BY doc_id),
    w2 AS (SELECT doc_id, list_sort(arg_max(sel, len(sel))) AS sel FROM g GROUP BY doc_id)
    SELECT CAST(d.doc_id AS VARCHAR) AS id, array_to_string(sel, ',') AS places, coalesce(array_to_string(list_transform(sel, lambda i: d.sents[i + 1]), ' '), '') AS summary FROM d JOIN w2 ON w2.doc_id = d.doc_id"""


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


def _rouge(n: int) -> str:
    def grams(c: str) -> str:
        words = _WORDS.format(c)
        return words if n == 1 else f"list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])"

    return f"""a AS (SELECT pred_id, run_id, {grams('summary')} AS p, {grams('reference')} AS r FROM predictions),
    pc AS (SELECT pred_id, g, count(*) AS c FROM (SELECT pred_id, unnest(p) AS g FROM a) GROUP BY ALL),
    rc AS (SELECT pred_id, g, count(*) AS c FROM (SELECT pred_id, unnest(r) AS g FROM a) GROUP BY ALL),
    h AS (SELECT pc.pred_id, sum(least(pc.c, rc.c)) AS h FROM pc JOIN rc ON pc.pred_id = rc.pred_id AND pc.g = rc.g GROUP BY ALL),
    q AS (SELECT a.pred_id, a.run_id, coalesce(h, 0)::DOUBLE / greatest(len(p), 1) AS p, coalesce(h, 0)::DOUBLE / greatest(len(r), 1) AS r FROM a LEFT JOIN h ON a.pred_id = h.pred_id),
    f AS (SELECT pred_id, run_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS rouge{n} FROM q)"""


_NUM = "n::DOUBLE"
_PAIR = "list_transform(string_split({0}, ' '), lambda t: t)"

ORACLES = {
    "sentence_split": f"WITH d AS (SELECT doc_id, {_split('text')} AS sents FROM documents) {_long('d', 'doc_id', 'sents', 'sentence')}",
    "token_count": f"SELECT doc_id, CAST(len(list_filter(string_split({_collapsed('text')}, ' '), lambda t: t <> '')) AS BIGINT) AS n_tokens FROM documents",
    "min_token_filter": f"WITH {_D} {_long('d', 'doc_id', 'sents', 'sentence')}",
    "max_sentence_cap": f"WITH {_S} SELECT doc_id, pos, sentence FROM s WHERE pos < 5",
    "tokens_v2": f"WITH {_S} SELECT doc_id, pos, array_to_string({_plain('sentence')}, ' ') AS tokens FROM s",
    "bigrams": f"WITH {_S}, t AS (SELECT doc_id, pos, {_plain('sentence')} AS toks FROM s) SELECT doc_id, pos, array_to_string({_pairs('toks', '_')}, ' ') AS bigrams FROM t",
    "vectorizer_tokens": f"WITH {_S} SELECT doc_id, pos, array_to_string({_VECTOR}, ' ') AS tokens FROM s",
    "separator_clean": "SELECT row_id, replace(article, '|||||', ' ') AS article, regexp_replace(highlights, '^- ', '') AS highlights FROM articles",
    "report_sentences": f"WITH d AS (SELECT row_id AS doc_id, flatten(list_transform(string_split(coalesce(article, ''), '|||||'), lambda a: {_split('a')})) AS sents FROM articles) {_long('d', 'doc_id', 'sents', 'sentence')}",
    "summary_assembly": f"""WITH {_P}, x AS (SELECT pred_id, p.v.sentences AS sents, list_sort(list_distinct(list_filter(coalesce(selected_indices, []), lambda i: i >= 0 AND i < len(p.v.sentences)))) AS places FROM predictions JOIN p USING (id))
        SELECT pred_id, coalesce(array_to_string(list_transform(places, lambda i: sents[i + 1]), ' '), '') AS assembled FROM x""",
    "tf_isf_v1": f"{_PARTS} SELECT doc_id, pos, round(importance, 6) AS score FROM parts",
    "tf_isf_v2": f"WITH {_S}, {_tf_isf(_plain('sentence'), '1.0 + ln(c)', 'sqrt(m)')} SELECT doc_id, pos, round({_minmax('raw')}, 6) AS score FROM raw",
    "tf_isf_v2_bigrams": f"WITH {_S}, b AS (SELECT doc_id, pos, cnt, n, {_plain('sentence')} AS q FROM s), {_tf_isf('list_concat(q, ' + _pairs('q', '_') + ')', '1.0 + ln(c)', 'sqrt(m)').replace('AS toks FROM s', 'AS toks FROM b')} SELECT doc_id, pos, round({_minmax('raw')}, 6) AS score FROM raw",
    "length_score": f"WITH {_S} SELECT doc_id, pos, round({_over_max('least(n, 40)::DOUBLE')}, 6) AS score FROM s",
    "position_v1": f"WITH {_S} SELECT doc_id, pos, round({_POSITION}, 6) AS score FROM s",
    "position_inverse": f"WITH {_S} SELECT doc_id, pos, round(1.0::DOUBLE / (1 + pos), 6) AS score FROM s",
    "position_exponential": f"WITH {_S} SELECT doc_id, pos, round(exp(-0.1::DOUBLE * pos), 6) AS score FROM s",
    "base_scores_v1": f"{_BASE} SELECT doc_id, pos, round(score, 6) AS score FROM base",
    "base_scores_v2_interactions": f"""{_PARTS}, m AS (SELECT doc_id, pos, {_minmax('importance')} AS a, {_minmax('length')} AS b, {_minmax('position')} AS c FROM parts),
        t AS (SELECT doc_id, pos, a + 0.3 * b + 0.3 * c + 0.5 * a * c AS t FROM m) SELECT doc_id, pos, round({_minmax('t')}, 6) AS score FROM t""",
    "minmax_half": f"WITH {_S} SELECT doc_id, pos, round({_minmax(_NUM)}, 6) AS score FROM s",
    "minmax_zero": f"WITH {_S} SELECT doc_id, pos, round({_minmax(_NUM, '0.0', '<= 1e-12')}, 6) AS score FROM s",
    "minmax_unit": f"WITH {_S} SELECT doc_id, pos, round((n - min(n) OVER ({_W}))::DOUBLE / greatest(max(n) OVER ({_W}) - min(n) OVER ({_W}), 1), 6) AS score FROM s",
    "zscore": f"WITH {_S} SELECT doc_id, pos, round((n - avg(n) OVER ({_W})) / coalesce(nullif(stddev_samp(n) OVER ({_W}), 0), 1), 6) AS score FROM s",
    "tfidf_weights": f"{_UNI} SELECT doc_id, pos, tok AS term, round(w, 6) AS weight FROM w",
    "tfidf_bigram_sublinear": f"{_BI} SELECT doc_id, pos, tok AS term, round(w, 6) AS weight FROM w",
    "pairwise_cosine": f"{_UNI}, {_SIM}, m AS (SELECT doc_id, i, max(x) AS x FROM sim WHERE i <> j GROUP BY ALL) SELECT s.doc_id, s.pos, round(coalesce(x, 0.0), 6) AS score FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.pos = m.i",
    "centroid_cosine": f"{_BI}, {_SUMS}, {_CENTROID} SELECT doc_id, pos, round(c, 6) AS score FROM cc",
    "centrality": f"{_UNI}, {_SUMS}, c AS (SELECT doc_id, pos, round(r / cnt, 12) AS c FROM rs) SELECT doc_id, pos, round({_minmax('c')}, 6) AS score FROM c",
    "novelty": f"{_UNI}, {_SUMS}, c AS (SELECT doc_id, pos, cnt, CASE WHEN cnt = 1 THEN 1.0 ELSE round(1 - (r - 1) / (cnt - 1), 12) END AS c FROM rs) SELECT doc_id, pos, CASE WHEN cnt = 1 THEN 1.0 ELSE round({_minmax('c')}, 6) END AS score FROM c",
    "embedding_centroid_rank": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label IS NOT NULL),
        m AS (SELECT label, k, avg(x) AS m FROM e GROUP BY ALL), l AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY ALL)
        SELECT CAST(e.label AS BIGINT) AS label, vec_id, round(sum(x * m) / ((sqrt(sum(x * x)) + 1e-12) * (any_value(l) + 1e-12)), 5) AS score FROM e JOIN m ON e.label = m.label AND e.k = m.k JOIN l ON e.label = l.label GROUP BY e.label, vec_id""",
    "topk_score": f"{_BASE}, r AS (SELECT doc_id, pos, round(score, 9) AS score FROM base) {_top('score DESC', 'r')}",
    "topk_position": f"WITH {_S} SELECT doc_id, pos FROM s WHERE pos < 5",
    "topk_centrality": f"{_UNI}, {_SUMS}, {_CENTROID}, r AS (SELECT doc_id, pos, round(c, 9) AS c FROM cc) {_top('c DESC', 'r')}",
    "candidate_union": f"""{_BASE}, {_vectors(_VECTOR, 'c')}, {_SUMS}, {_CENTROID}, r1 AS (SELECT doc_id, pos, round(score, 9) AS score FROM base), r2 AS (SELECT doc_id, pos, round(c, 9) AS c FROM cc)
        SELECT DISTINCT doc_id, pos FROM ({_top('score DESC', 'r1')} UNION ALL {_top('c DESC', 'r2')} UNION ALL SELECT doc_id, pos FROM s WHERE pos < 5)""".replace("r1 AS (SELECT doc_id, pos, sum(", "r0 AS (SELECT doc_id, pos, sum(").replace("coalesce(r1.raw", "coalesce(r0.raw").replace("LEFT JOIN r1 ON s.doc_id = r1.doc_id AND s.pos = r1.pos", "LEFT JOIN r0 ON s.doc_id = r0.doc_id AND s.pos = r0.pos"),
    "soft_boost": f"{_BASE}, r AS (SELECT *, row_number() OVER ({_W} ORDER BY round(score, 9) DESC, pos) AS k FROM base) SELECT doc_id, pos, round(CASE WHEN k <= 5 THEN score * 1.05 ELSE score END, 6) AS score FROM r",
    "trim_tokens": f"WITH {_S}, t AS (SELECT doc_id, pos, sum(n) OVER ({_W} ORDER BY pos) AS total FROM s) SELECT doc_id, pos FROM t WHERE total <= 100",
    "greedy_mmr_tokens": _greedy("n", 100),
    "greedy_mmr_sentences": _greedy("CAST(1 AS BIGINT)", 3),
    "fast_fused": _greedy("n", 100, _fused(), "fused"),
    "word_budget_fill": f"""{_BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, r AS MATERIALIZED (SELECT doc_id, pos, n, row_number() OVER ({_W} ORDER BY round(score, 9) DESC, pos DESC) AS k FROM base),
        f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS used, false AS taken FROM r
            UNION ALL SELECT r.doc_id, r.k, r.pos, f.used + CASE WHEN f.used + r.n <= 100 THEN r.n ELSE 0 END, f.used + r.n <= 100 FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)
        SELECT doc_id, pos FROM f WHERE taken""",
    "textrank_steps": f"""{_UNI}, {_SIM}, t AS (SELECT doc_id, i, sum(x) AS t FROM sim GROUP BY ALL), e AS MATERIALIZED (SELECT sim.doc_id, sim.i, sim.j, sim.x / t.t AS x FROM sim JOIN t ON sim.doc_id = t.doc_id AND sim.i = t.i), {_steps(8)}
        SELECT doc_id, pos, round(CASE WHEN cnt = 1 THEN 1.0 ELSE p END, 6) AS score FROM p8""",
    "feature_dump": f"""WITH {_P}, {_PBASE}, a AS (SELECT doc_id, string_agg(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS base_scores FROM base GROUP BY doc_id)
        SELECT pd.id, coalesce(a.base_scores, '') AS base_scores, CAST(len(pd.sents) AS BIGINT) AS n_sentences FROM pd LEFT JOIN a ON a.doc_id = pd.id""",
    "union_capped": f"""{_union('')}, {_PBASE}, m AS (SELECT id, unnest(places) AS pos FROM u), r AS (SELECT m.id, m.pos, row_number() OVER (PARTITION BY m.id ORDER BY round(base.score, 10) DESC, m.pos) AS k FROM m JOIN base ON base.doc_id = m.id AND base.pos = m.pos)
        SELECT id, CAST(pos AS BIGINT) AS pos FROM r WHERE k <= 4""",
    "union_views": f"{_union('')} SELECT id, CAST(unnest(places) AS BIGINT) AS pos FROM u",
    "union_first_k": f"{_union('[1:2]')} SELECT id, CAST(unnest(places) AS BIGINT) AS pos FROM u",
    "ordered_union": f"""WITH {_P}, {_view(0)}, {_view(1)}, x AS (SELECT p.id, list_concat(coalesce(v0.sel, []), coalesce(v1.sel, [])) AS l FROM p LEFT JOIN v0 ON v0.id = p.id LEFT JOIN v1 ON v1.id = p.id),
        y AS (SELECT id, list_filter(l, lambda a, i: list_position(l, a) = i)[1:6] AS l FROM x) SELECT id, array_to_string(l, ',') AS places FROM y""",
    "rouge1": f"WITH {_rouge(1)} SELECT pred_id, rouge1 FROM f",
    "rouge2": f"WITH {_rouge(2)} SELECT pred_id, rouge2 FROM f",
    "rouge1_mean": f"WITH {_rouge(1)} SELECT run_id, CAST(sum(CAST(round(rouge1 * 1000000) AS BIGINT)) AS BIGINT) AS micro, count(*) AS n FROM f GROUP BY run_id",
    "jsonl_to_csv": "SELECT pred_id, coalesce(summary, '') AS article, coalesce(nullif(reference, ''), '') AS reference FROM predictions",
    "run_summary_union": "SELECT run_id, selector, CAST(keep_k AS VARCHAR) AS keep_k, '' AS max_tokens FROM runs WHERE stage_name = 'stage1' UNION ALL SELECT run_id, '', '', CAST(max_tokens AS VARCHAR) FROM runs WHERE stage_name <> 'stage1'",
    "preprocessed": f"""WITH k AS (SELECT row_id, {_kept('article')}[1:25] AS k, highlights FROM articles) SELECT CAST(row_id AS VARCHAR) AS id, CAST(len(k) AS BIGINT) AS n_sentences, array_to_string(k, chr(10)) AS kept, coalesce(highlights, '') AS highlights FROM k""",
    "rerank_fuse": """WITH c AS (SELECT id, pred_id, summary, coalesce(len(selected_indices), 0)::DOUBLE AS b, length(summary)::DOUBLE AS c, row_number() OVER (PARTITION BY id ORDER BY pred_id) - 1 AS k FROM predictions WHERE id IS NOT NULL AND summary IS NOT NULL),
        m AS (SELECT *, (c - min(c) OVER (PARTITION BY id)) / (CASE WHEN max(c) OVER (PARTITION BY id) <= min(c) OVER (PARTITION BY id) THEN 1.0 ELSE max(c) OVER (PARTITION BY id) - min(c) OVER (PARTITION BY id) END) AS mc,
            (b - min(b) OVER (PARTITION BY id)) / (CASE WHEN max(b) OVER (PARTITION BY id) <= min(b) OVER (PARTITION BY id) THEN 1.0 ELSE max(b) OVER (PARTITION BY id) - min(b) OVER (PARTITION BY id) END) AS mb FROM c),
        f AS (SELECT *, round(mc * 0.7::DOUBLE + mb * 0.3::DOUBLE, 10) AS f FROM m)
        SELECT id, string_agg(k, ',' ORDER BY f DESC, k) AS rerank_order, first(summary ORDER BY f DESC, k) AS summary FROM f GROUP BY id""",
}
