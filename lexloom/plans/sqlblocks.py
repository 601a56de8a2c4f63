"""Blocks of SQL (CTEs) for the equivalents of whole runs: scores, pools, selectors, fusion, ROUGE.

A block is a list of (name, statement); names begin with the block's prefix, so that several
stages can stand in one query.  Relations of sentences are ``(doc_id, pos, sentence, n, cnt)``, of
scored members ``(doc_id, pos, n, score)``, of similarities ``(doc_id, i, j, x)``, and of selections
``(doc_id, sel)`` with a row for every document.
"""

from __future__ import annotations

from ..operators import rouge as R
from .oracles import _VECTOR, _collapsed, _minmax, _over_max, _pairs

Block = list[tuple[str, str]]
_TOKENS = "list_filter(string_split({}, ' '), lambda t: t <> '')"
_W = "PARTITION BY doc_id"


def query(blocks: Block, final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in blocks) + "\n" + final


def sentences(p: str, docs: str) -> Block:
    """Sentences of ``docs(doc_id, sents)``; null ones are empty."""
    return [
        (f"{p}s0", f"SELECT doc_id, CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS pos, unnest(list_transform(sents, lambda t: coalesce(t, ''))) AS sentence FROM {docs}"),
        (f"{p}s1", f"SELECT *, {_TOKENS.format(_collapsed('sentence'))} AS words FROM {p}s0"),
        (f"{p}s", f"SELECT doc_id, pos, sentence, CAST(len(words) AS BIGINT) AS n, count(*) OVER ({_W}) AS cnt FROM {p}s1"),
    ]


def base(p: str, s: str, a: str = "1.0", b: str = "0.3", c: str = "0.3") -> Block:
    """Importance, length and position of the sentences, combined and over the maximum."""
    words = _TOKENS.format("lower(" + _collapsed("sentence") + ")")
    return [
        (f"{p}b1", f"SELECT doc_id, pos, cnt, unnest({words}) AS tok FROM {s}"),
        (f"{p}b2", f"SELECT doc_id, pos, any_value(cnt) AS cnt, tok, count(*) AS c FROM {p}b1 GROUP BY doc_id, pos, tok"),
        (f"{p}b3", f"SELECT *, count(*) OVER (PARTITION BY doc_id, tok) AS f FROM {p}b2"),
        (f"{p}b4", f"SELECT doc_id, pos, sum(c * ln(cnt / (1.0 + f)::DOUBLE)) AS raw FROM {p}b3 GROUP BY doc_id, pos"),
        (f"{p}b5", f"SELECT s.doc_id, s.pos, s.n, s.cnt, round(coalesce(b.raw, 0.0), 12) AS raw FROM {s} s LEFT JOIN {p}b4 b ON s.doc_id = b.doc_id AND s.pos = b.pos"),
        (f"{p}b6", f"SELECT doc_id, pos, n, {_over_max('raw')} AS importance, {_over_max('least(n, 40)::DOUBLE')} AS length, CASE WHEN cnt = 1 THEN 1.0 ELSE 1.0 - pos::DOUBLE / (cnt - 1) END AS position FROM {p}b5"),
        (f"{p}base", f"SELECT doc_id, pos, n, {_over_max(f'{a} * importance + {b} * length + {c} * position')} AS score FROM {p}b6"),
    ]


def vectors(p: str, s: str, pairs: bool = False) -> Block:
    """Unit term vectors ``w(doc_id, pos, tok, w)``: counts, or one- and two-grams with 1 + ln."""
    tokens, tf = (f"list_concat({_VECTOR}, {_pairs(_VECTOR, ' ')})", "1.0 + ln(c)") if pairs else (_VECTOR, "c")
    return [
        (f"{p}v0", f"SELECT doc_id, pos, cnt, unnest({tokens}) AS tok FROM {s}"),
        (f"{p}v1", f"SELECT doc_id, pos, any_value(cnt) AS cnt, tok, count(*) AS c FROM {p}v0 GROUP BY doc_id, pos, tok"),
        (f"{p}v2", f"SELECT *, ({tf}) * (ln((1.0 + cnt) / (1.0 + count(*) OVER (PARTITION BY doc_id, tok))) + 1.0) AS u FROM {p}v1"),
        (f"{p}w", f"SELECT doc_id, pos, tok, u / sqrt(sum(u * u) OVER (PARTITION BY doc_id, pos)) AS w FROM {p}v2"),
    ]


def similarity(p: str, members: str | None = None, grid: bool = True, least: float = 0.0) -> Block:
    """Cosines from ``w``, of ``members`` only if given; on the grid of 1e-10, and none below ``least``."""
    x = "round(sum(a.w * b.w) * 1e10) / 1e10" if grid else "sum(a.w * b.w)"
    w, out = f"{p}w", []
    if members:
        out.append((f"{p}wm", f"SELECT w.* FROM {p}w w JOIN {members} m ON m.doc_id = w.doc_id AND m.pos = w.pos"))
        w = f"{p}wm"
    having = f" HAVING sum(a.w * b.w) >= {least}" if least else ""
    return [*out, (f"{p}x", f"SELECT a.doc_id, a.pos AS i, b.pos AS j, {x} AS x FROM {w} a JOIN {w} b ON a.doc_id = b.doc_id AND a.tok = b.tok GROUP BY a.doc_id, a.pos, b.pos{having}")]


def centroid(p: str, s: str) -> Block:
    """Cosine of each sentence and the mean one: ``cc(doc_id, pos, c)``."""
    return [
        (f"{p}c1", f"SELECT doc_id, tok, sum(w) AS t FROM {p}w GROUP BY doc_id, tok"),
        (f"{p}c2", f"SELECT w.doc_id, w.pos, sum(w.w * t.t) AS r FROM {p}w w JOIN {p}c1 t ON w.doc_id = t.doc_id AND w.tok = t.tok GROUP BY w.doc_id, w.pos"),
        (f"{p}c3", f"SELECT doc_id, sqrt(sum(t * t)) AS l FROM {p}c1 GROUP BY doc_id"),
        (f"{p}cc", f"SELECT s.doc_id, s.pos, coalesce(r / l, 0.0) AS c FROM {s} s LEFT JOIN {p}c2 r ON s.doc_id = r.doc_id AND s.pos = r.pos LEFT JOIN {p}c3 l ON s.doc_id = l.doc_id"),
    ]


def pool(p: str, scored: str, k: int | str, order: str = "score") -> Block:
    """The ``k`` best members by falling score."""
    return [(f"{p}pool", f"SELECT doc_id, pos, n, score FROM (SELECT *, row_number() OVER ({_W} ORDER BY {order} DESC, pos) AS r FROM {scored}) WHERE r <= {k}")]


def fused(p: str, members: str, s: str, w: str = "0.5", rest: str = "0.5") -> Block:
    """Scores of the members as a document of their own: base and centroid cosine, both rescaled."""
    own = [(f"{p}m", f"SELECT m.doc_id, m.pos, m.n, m.score, s.sentence, count(*) OVER (PARTITION BY m.doc_id) AS cnt FROM {members} m JOIN {s} s ON s.doc_id = m.doc_id AND s.pos = m.pos")]
    a, b = _minmax("score", "0.0", "<= 1e-12"), _minmax("c", "0.0", "<= 1e-12")
    joined = f"SELECT m.doc_id, m.pos, m.n, m.score, c.c FROM {p}m m JOIN {p}cc c ON c.doc_id = m.doc_id AND c.pos = m.pos"
    return [*own, *vectors(p, f"{p}m", True), *centroid(p, f"{p}m"), (f"{p}j", joined), (f"{p}f", f"SELECT doc_id, pos, n, {w}::DOUBLE * {a} + {rest}::DOUBLE * {b} AS score FROM {p}j")]


def greedy(p: str, docs: str, scored: str, x: str | None, limit: int, cost: str = "n", alpha: str = "0.7") -> Block:
    """Greedy marginal relevance: ``sel`` grows by the best fitting member."""
    near = "coalesce(max(x.x) FILTER (WHERE list_contains(g.sel, x.j)), 0.0)" if x else "0.0"
    join = f"LEFT JOIN {x} x ON x.doc_id = c.doc_id AND x.i = c.pos" if x else ""
    step = f"""SELECT doc_id, list_append(any_value(sel), arg_max(pos, o)), any_value(used) + arg_max(n, o)
        FROM (SELECT g.doc_id, any_value(g.sel) AS sel, any_value(g.used) AS used, c.pos, any_value(c.n) AS n,
                struct_pack(u := round(({alpha}::DOUBLE * any_value(c.score) - (1 - {alpha}::DOUBLE) * {near}) * 1e10), p := -c.pos) AS o
            FROM {p}g g JOIN {p}c c ON c.doc_id = g.doc_id AND NOT list_contains(g.sel, c.pos) AND g.used + c.n <= {limit} {join} GROUP BY g.doc_id, c.pos) q
        GROUP BY doc_id"""
    return [
        (f"{p}c", f"SELECT doc_id, pos, CAST({cost} AS BIGINT) AS n, round(score * 1e10) / 1e10 AS score FROM {scored}"),
        (f"{p}g", f"SELECT doc_id, CAST([] AS BIGINT[]) AS sel, CAST(0 AS BIGINT) AS used FROM {docs} UNION ALL {step}"),
        (f"{p}sel", f"SELECT doc_id, list_sort(arg_max(sel, len(sel))) AS sel FROM {p}g GROUP BY doc_id"),
    ]


def local_search(p: str, start: str, x: str, limit: int, alpha: str = "0.7") -> Block:
    """First improving swap, else addition, else removal, over ``{p}c`` (grid scores) from the selection ``start``."""
    w = f"(1 - {alpha}::DOUBLE)"

    def state() -> str:
        return f"""(SELECT *, sum(n) FILTER (WHERE inside) OVER ({_W}) AS used, count(*) FILTER (WHERE inside) OVER ({_W}) AS held FROM (
            SELECT h.doc_id, h.k, h.sel, c.pos, c.n, c.score, list_contains(h.sel, c.pos) AS inside,
                coalesce(sum(x.x) FILTER (WHERE list_contains(h.sel, x.j)), 0.0) AS pull, coalesce(max(x.x) FILTER (WHERE x.j = c.pos), 0.0) AS own
            FROM {p}h h JOIN {p}c c ON c.doc_id = h.doc_id AND h.k < 200 LEFT JOIN {x} x ON x.doc_id = c.doc_id AND x.i = c.pos GROUP BY ALL))"""

    moves = f"""SELECT a.doc_id, a.k, CASE WHEN a.pos <> b.pos THEN list_append(list_filter(a.sel, lambda t: t <> a.pos), b.pos) WHEN a.inside THEN list_filter(a.sel, lambda t: t <> a.pos) ELSE list_append(a.sel, a.pos) END AS next,
            struct_pack(kind := CASE WHEN a.pos <> b.pos THEN 1 WHEN NOT a.inside THEN 2 ELSE 3 END, a := a.pos, b := b.pos) AS o,
            CASE WHEN a.pos <> b.pos THEN CASE WHEN a.used - a.n + b.n <= {limit} THEN b.score - {w} * b.pull + {w} * coalesce(y.x, 0.0) - (a.score - {w} * (a.pull - a.own)) ELSE -1 END
                WHEN NOT a.inside THEN CASE WHEN a.used + a.n <= {limit} THEN a.score - {w} * a.pull ELSE -1 END
                WHEN a.held > 1 THEN {w} * (a.pull - a.own) - a.score ELSE -1 END AS gain
        FROM {state()} a JOIN {state()} b ON a.doc_id = b.doc_id AND (a.pos = b.pos OR a.inside AND NOT b.inside)
        LEFT JOIN {x} y ON y.doc_id = a.doc_id AND y.i = a.pos AND y.j = b.pos"""
    return [
        (f"{p}h", f"SELECT doc_id, 0 AS k, sel FROM {start} WHERE len(sel) > 0 UNION ALL SELECT doc_id, any_value(k) + 1, arg_min(next, o) FROM ({moves}) WHERE gain > 1e-9 GROUP BY doc_id"),
        (f"{p}found", f"SELECT s.doc_id, coalesce(list_sort(h.sel), s.sel) AS sel FROM {start} s LEFT JOIN (SELECT doc_id, arg_max(sel, k) AS sel FROM {p}h GROUP BY doc_id) h ON h.doc_id = s.doc_id"),
    ]


def textrank(p: str, s: str, x: str) -> Block:
    """Damped iteration with early stop over the edges ``x``: ``tr(doc_id, pos, p)``."""
    return [
        (f"{p}t1", f"SELECT doc_id, i, sum(x) AS t FROM {x} GROUP BY doc_id, i"),
        (f"{p}t2", f"SELECT x.doc_id, x.i, x.j, x.x / t.t AS x FROM {x} x JOIN {p}t1 t ON x.doc_id = t.doc_id AND x.i = t.i WHERE t.t > 0"),
        (f"{p}t3", f"""SELECT doc_id, pos, cnt, 1.0::DOUBLE / cnt AS p, false AS done, 0 AS k FROM {s} WHERE cnt > 1 UNION ALL
            SELECT doc_id, pos, cnt, p1, sum(abs(p1 - p)) OVER ({_W}) < 1e-6, k + 1 FROM (
                SELECT r.doc_id, r.pos, r.cnt, r.p, r.k, coalesce(q.q, 0.0) * 0.85::DOUBLE + 0.15::DOUBLE / r.cnt AS p1
                FROM {p}t3 r LEFT JOIN (SELECT e.doc_id, e.j, sum(e.x * o.p) AS q FROM {p}t2 e JOIN {p}t3 o ON e.doc_id = o.doc_id AND e.i = o.pos GROUP BY e.doc_id, e.j) q ON q.doc_id = r.doc_id AND q.j = r.pos
                WHERE NOT r.done AND r.k < 100)"""),
        (f"{p}tr", f"SELECT doc_id, pos, arg_max(p, k) AS p FROM {p}t3 GROUP BY doc_id, pos UNION ALL SELECT doc_id, pos, 1.0 FROM {s} WHERE cnt = 1"),
    ]


def near_dropped(p: str, docs: str, members: str, x: str, threshold: float) -> Block:
    """Members in order, without those too similar to a kept one: ``kept(doc_id, pos)``."""
    return [
        (f"{p}o", f"SELECT doc_id, pos, row_number() OVER ({_W} ORDER BY pos) AS r FROM {members}"),
        (f"{p}k", f"""SELECT doc_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS sel FROM {docs} UNION ALL
            SELECT k.doc_id, k.r + 1, CASE WHEN coalesce(bool_or(x.x >= {threshold}), false) THEN k.sel ELSE list_append(k.sel, o.pos) END
            FROM {p}k k JOIN {p}o o ON o.doc_id = k.doc_id AND o.r = k.r + 1 LEFT JOIN {x} x ON x.doc_id = k.doc_id AND x.i = o.pos AND list_contains(k.sel, x.j) GROUP BY k.doc_id, k.r, k.sel, o.pos"""),
        (f"{p}kept", f"SELECT doc_id, unnest(arg_max(sel, r)) AS pos FROM {p}k GROUP BY doc_id"),
    ]


def encoder(p: str, members: str, s: str) -> Block:
    """Cosine to the centroid of the stand-in embedding of the members: ``en(doc_id, pos, n, score)``."""
    return [
        (f"{p}e1", f"SELECT m.doc_id, m.pos, unnest({_VECTOR}) AS tok FROM {members} m JOIN {s} s ON s.doc_id = m.doc_id AND s.pos = m.pos"),
        (f"{p}e2", f"SELECT doc_id, pos, CAST('0x' || substr(md5(tok), 1, 2) AS INTEGER) % 64 AS d, sum(CASE WHEN substr(md5(tok), 3, 1) IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM {p}e1 GROUP BY ALL"),
        (f"{p}e3", f"SELECT doc_id, count(*) AS c FROM {members} GROUP BY doc_id"),
        (f"{p}e4", f"SELECT e.doc_id, d, sum(v) / any_value(c) AS m FROM {p}e2 e JOIN {p}e3 USING (doc_id) GROUP BY e.doc_id, d"),
        (f"{p}e5", f"SELECT doc_id, sqrt(sum(m * m)) AS l FROM {p}e4 GROUP BY doc_id"),
        (f"{p}e6", f"SELECT e.doc_id, e.pos, sum(e.v * m.m) AS dot, sqrt(sum(e.v * e.v)) AS l FROM {p}e2 e JOIN {p}e4 m ON m.doc_id = e.doc_id AND m.d = e.d GROUP BY e.doc_id, e.pos"),
        (f"{p}en", f"SELECT m.doc_id, m.pos, m.n, coalesce(round(dot / ((e.l + 1e-12) * (t.l + 1e-12)) * 1e10) / 1e10, 0.0) AS score FROM {members} m LEFT JOIN {p}e6 e ON e.doc_id = m.doc_id AND e.pos = m.pos LEFT JOIN {p}e5 t ON t.doc_id = m.doc_id"),
    ]


def skip_fill(p: str, docs: str, scored: str, limit: int, order: str = "score DESC, pos") -> Block:
    """Best first, skipping what does not fit."""
    return [
        (f"{p}q", f"SELECT doc_id, pos, n, row_number() OVER ({_W} ORDER BY {order}) AS k FROM {scored}"),
        (f"{p}z", f"""SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS sel FROM {docs} UNION ALL
            SELECT z.doc_id, q.k, z.used + CASE WHEN z.used + q.n <= {limit} THEN q.n ELSE 0 END, CASE WHEN z.used + q.n <= {limit} THEN list_append(z.sel, q.pos) ELSE z.sel END FROM {p}z z JOIN {p}q q ON q.doc_id = z.doc_id AND q.k = z.k + 1"""),
        (f"{p}sel", f"SELECT doc_id, list_sort(arg_max(sel, k)) AS sel FROM {p}z GROUP BY doc_id"),
    ]


def best_subset(p: str, docs: str, scored: str, x: str, limit: int, most: int, weights=("1.0", "0.8", "0.7"), diversity: bool = False) -> Block:
    """The best of all subsets of at most ``most`` members by weighted importance, coverage and redundancy."""
    wi, wc, wr = weights
    return [
        (f"{p}o", f"SELECT doc_id, pos, n, score, row_number() OVER ({_W} ORDER BY pos) - 1 AS r, count(*) OVER ({_W}) AS cnt FROM {scored}"),
        (f"{p}sub", f"SELECT d.doc_id, d.cnt, m.m FROM (SELECT doc_id, any_value(cnt) AS cnt FROM {p}o GROUP BY doc_id) d JOIN (SELECT unnest(range(1, {1 << most})) AS m) m ON m.m < (1::BIGINT << d.cnt)"),
        (f"{p}mem", f"SELECT u.doc_id, u.m, o.pos, o.n, o.score FROM {p}sub u JOIN {p}o o ON o.doc_id = u.doc_id AND (u.m >> o.r) & 1 = 1"),
        (f"{p}a", f"SELECT doc_id, m, sum(score) AS imp, sum(n) AS used, count(*) AS k FROM {p}mem GROUP BY doc_id, m HAVING sum(n) <= {limit}"),
        (f"{p}ci", f"SELECT i.doc_id, i.m, x.i, max(x.x) AS x FROM {p}mem i JOIN {x} x ON x.doc_id = i.doc_id AND x.j = i.pos GROUP BY i.doc_id, i.m, x.i"),
        (f"{p}cv", f"SELECT doc_id, m, sum(x) AS c FROM {p}ci GROUP BY doc_id, m"),
        (f"{p}rd", f"SELECT a.doc_id, a.m, sum(x.x) AS r FROM {p}mem a JOIN {p}mem b ON a.doc_id = b.doc_id AND a.m = b.m AND a.pos < b.pos JOIN {x} x ON x.doc_id = a.doc_id AND x.i = a.pos AND x.j = b.pos GROUP BY a.doc_id, a.m"),
        (f"{p}val", f"""SELECT a.doc_id, a.m, imp, coalesce(c.c, 0.0) / u.cnt AS cov, CASE WHEN k > 1 THEN coalesce(r.r, 0.0) / (k * (k - 1) / 2.0) ELSE 0.0 END AS red FROM {p}a a JOIN (SELECT DISTINCT doc_id, cnt FROM {p}o) u ON u.doc_id = a.doc_id
            LEFT JOIN {p}cv c ON c.doc_id = a.doc_id AND c.m = a.m LEFT JOIN {p}rd r ON r.doc_id = a.doc_id AND r.m = a.m"""),
        # only what no other subset dominates is in the front
        (f"{p}obj", f"SELECT doc_id, m, imp, {'cov - 0.3::DOUBLE * red' if diversity else 'cov'} AS cov, red FROM {p}val UNION ALL SELECT DISTINCT doc_id, 0, 0.0, 0.0, 0.0 FROM {p}o"),
        (f"{p}best", f"SELECT doc_id, arg_max(m, struct_pack(v := round(({wi}::DOUBLE * imp + {wc}::DOUBLE * cov - {wr}::DOUBLE * red) * 1e10), m := -m)) AS m FROM {p}obj GROUP BY doc_id"),
        (f"{p}sel", f"SELECT d.doc_id, coalesce(list_sort(list(o.pos) FILTER (WHERE (b.m >> o.r) & 1 = 1)), []) AS sel FROM {docs} d LEFT JOIN {p}best b ON b.doc_id = d.doc_id LEFT JOIN {p}o o ON o.doc_id = d.doc_id GROUP BY d.doc_id"),
    ]


# ---- stems and ROUGE ----

_FROM = "abcdefghijklmnopqrstuvwxz0123456789"
_TO = "".join("v" if c in "aeiou" else "c" for c in _FROM)
WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


def _shape(x: str) -> str:
    """Vowels and consonants of a word; y is a vowel behind a consonant."""
    out = f"regexp_replace(translate({x}, '{_FROM}', '{_TO}'), '^y', 'c')"
    for _ in range(3):
        out = f"replace(replace({out}, 'cy', 'cv'), 'vy', 'vc')"
    return out


def _m1(x: str) -> str:
    return f"contains({_shape(x)}, 'vc')"


def _m2(x: str) -> str:
    return f"regexp_matches({_shape(x)}, 'vc+v+c')"


def _less(x: str, n: int) -> str:
    return f"substr({x}, 1, greatest(length({x}) - {n}, 0))"


def _short(x: str) -> str:
    return f"(length({x}) = 2 AND {_shape(x)} = 'vc' OR length({x}) > 2 AND ends_with({_shape(x)}, 'cvc') AND NOT regexp_matches({x}, '[wxy]$'))"


def _replaced(x: str, rules: str) -> str:
    cases = "".join(
        f" WHEN ends_with({x}, '{end}') THEN CASE WHEN {_m1(_less(x, len(end) - (end == 'logi')))} THEN {_less(x, len(end))} || '{to}' ELSE {x} END" for end, to in R._rules(rules)
    )
    return f"CASE{cases} ELSE {x} END"


def stems(p: str, vocabulary: str) -> Block:
    """``stem(tok, stem)`` of the distinct words ``vocabulary(tok)``; words of up to three letters stay."""
    own = "".join(f" WHEN '{a}' THEN '{b}'" for a, b in (r.split(":") for r in R.IRREGULAR.split()))
    four = "".join(f" WHEN ends_with(w, '{e}') THEN CASE WHEN {_m2(_less('w', 3 if e in ('sion', 'tion') else len(e)))} THEN {_less('w', 3 if e in ('sion', 'tion') else len(e))} ELSE w END" for e in R._FOUR)
    cut = f"CASE WHEN ends_with(w, 'ed') AND contains({_shape(_less('w', 2))}, 'v') THEN {_less('w', 2)} WHEN ends_with(w, 'ing') AND contains({_shape(_less('w', 3))}, 'v') THEN {_less('w', 3)} END"
    return [
        (f"{p}p0", f"SELECT DISTINCT tok, tok AS w FROM {vocabulary}"),
        (f"{p}p1", f"SELECT tok, CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {_less('w', 1)} WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_less('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_less('w', 1)} ELSE w END AS w FROM {p}p0"),
        (f"{p}p2", f"SELECT tok, w, CASE WHEN ends_with(w, 'ied') OR ends_with(w, 'eed') THEN NULL ELSE {cut} END AS c FROM {p}p1"),
        (f"{p}p3", f"""SELECT tok, CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_less('w', 1)} ELSE {_less('w', 2)} END
            WHEN ends_with(w, 'eed') THEN CASE WHEN {_m1(_less('w', 3))} THEN {_less('w', 1)} ELSE w END
            WHEN c IS NULL THEN w WHEN ends_with(c, 'at') OR ends_with(c, 'bl') OR ends_with(c, 'iz') THEN c || 'e'
            WHEN length(c) > 1 AND c[-1] = c[-2] AND ends_with({_shape('c')}, 'c') THEN CASE WHEN c[-1] IN ('l', 's', 'z') THEN c ELSE {_less('c', 1)} END
            WHEN {_m1('c')} AND NOT {_m2('c')} AND {_short('c')} THEN c || 'e' ELSE c END AS w FROM {p}p2"""),
        (f"{p}p4", f"SELECT tok, CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND ends_with({_shape(_less('w', 1))}, 'c') THEN {_less('w', 1)} || 'i' ELSE w END AS w FROM {p}p3"),
        (f"{p}p5", f"SELECT tok, w AS v, {_replaced('w', R.STEP2)} AS w FROM {p}p4"),
        (f"{p}p6", f"SELECT tok, CASE WHEN ends_with(v, 'alli') AND v <> w THEN {_replaced('w', R.STEP2)} ELSE w END AS w FROM {p}p5"),
        (f"{p}p7", f"SELECT tok, {_replaced('w', R.STEP3)} AS w FROM {p}p6"),
        (f"{p}p8", f"SELECT tok, CASE{four} ELSE w END AS w FROM {p}p7"),
        (f"{p}p9", f"SELECT tok, CASE WHEN ends_with(w, 'e') AND ({_m2(_less('w', 1))} OR {_m1(_less('w', 1))} AND NOT {_short(_less('w', 1))}) THEN {_less('w', 1)} ELSE w END AS w FROM {p}p8"),
        (f"{p}stem", f"SELECT tok, CASE WHEN length(tok) <= 3 THEN tok ELSE CASE tok{own} ELSE CASE WHEN ends_with(w, 'll') AND {_m2(_less('w', 1))} THEN {_less('w', 1)} ELSE w END END END AS stem FROM {p}p9"),
    ]


def _f(hit: str, a: str, b: str) -> str:
    p, r = f"({hit})::DOUBLE / greatest({a}, 1)", f"({hit})::DOUBLE / greatest({b}, 1)"
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * ({p}) * ({r}) / ({p} + {r}) ELSE 0.0 END"


def rouge(p: str, pairs: str) -> Block:
    """Stemmed ROUGE-1, -2 and -L of ``pairs(key, a, b)`` (texts): ``rouge(key, rouge1, rouge2, rougeL)``."""

    def hits(n: int) -> Block:
        gram = "{0}" if n == 1 else "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
        count = lambda c: f"SELECT key, g, count(*) AS c FROM (SELECT key, unnest({gram.format(c)}) AS g FROM {p}l) GROUP BY key, g"
        return [(f"{p}h{n}", f"SELECT x.key, sum(least(x.c, y.c)) AS h FROM ({count('a')}) x JOIN ({count('b')}) y ON x.key = y.key AND x.g = y.g GROUP BY x.key")]

    side = lambda c: f"SELECT key, '{c}' AS side, unnest({WORDS.format(c)}) AS tok, generate_subscripts({WORDS.format(c)}, 1) AS k FROM {p}d"
    return [
        (f"{p}d", f"SELECT DISTINCT key, a, b FROM {pairs}"),
        (f"{p}u", f"{side('a')} UNION ALL {side('b')}"),
        *stems(p, f"{p}u"),
        (f"{p}l", f"SELECT d.key, coalesce(list(stem ORDER BY k) FILTER (WHERE side = 'a'), []) AS a, coalesce(list(stem ORDER BY k) FILTER (WHERE side = 'b'), []) AS b FROM {p}d d LEFT JOIN (SELECT u.*, s.stem FROM {p}u u JOIN {p}stem s USING (tok)) t ON t.key = d.key GROUP BY d.key"),
        *hits(1), *hits(2),
        (f"{p}lc", f"""SELECT key, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda t: CAST(0 AS BIGINT)) AS row FROM {p}l WHERE len(a) > 0 AND len(b) > 0 UNION ALL
            SELECT key, a, b, i + 1, list_concat([CAST(0 AS BIGINT)], list_transform(range(1, len(b) + 1), lambda j: list_max(t[1:j]))) FROM (
                SELECT key, a, b, i, list_transform(range(1, len(b) + 1), lambda j: greatest(row[j + 1], CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE 0 END)) AS t FROM {p}lc WHERE i < len(a))"""),
        (f"{p}ll", f"SELECT key, row[-1] AS h FROM {p}lc WHERE i = len(a)"),
        (f"{p}rouge", f"""SELECT l.key, round({_f('coalesce(x.h, 0)', 'len(a)', 'len(b)')}, 6) AS rouge1, round({_f('coalesce(y.h, 0)', 'len(a) - 1', 'len(b) - 1')}, 6) AS rouge2, round({_f('coalesce(z.h, 0)', 'len(a)', 'len(b)')}, 6) AS "rougeL"
            FROM {p}l l LEFT JOIN {p}h1 x ON x.key = l.key LEFT JOIN {p}h2 y ON y.key = l.key LEFT JOIN {p}ll z ON z.key = l.key"""),
    ]


def rouge_oracle(p: str, s: str, reference: str, limit: int) -> Block:
    """Greedy ROUGE-1 oracle of the sentences ``s`` against ``reference(doc_id, text)``: ``sel``."""
    return [
        (f"{p}u", f"SELECT doc_id, pos, n, unnest({WORDS.format('sentence')}) AS tok FROM {s}"),
        (f"{p}ru", f"SELECT doc_id, unnest({WORDS.format('text')}) AS tok FROM {reference}"),
        (f"{p}vo", f"SELECT tok FROM {p}u UNION SELECT tok FROM {p}ru"),
        *stems(p, f"{p}vo"),
        (f"{p}len", f"SELECT s.doc_id, s.pos, s.n, len({WORDS.format('sentence')}) AS m FROM {s} s"),
        (f"{p}want", f"SELECT doc_id, stem, count(*) AS c FROM {p}ru JOIN {p}stem USING (tok) GROUP BY doc_id, stem"),
        (f"{p}rl", f"SELECT doc_id, sum(c) AS m FROM {p}want GROUP BY doc_id"),
        (f"{p}tc", f"SELECT u.doc_id, u.pos, t.stem, count(*) AS c, any_value(w.c) AS want FROM {p}u u JOIN {p}stem t USING (tok) JOIN {p}want w ON w.doc_id = u.doc_id AND w.stem = t.stem GROUP BY u.doc_id, u.pos, t.stem"),
        (f"{p}g", f"""SELECT doc_id, CAST([] AS BIGINT[]) AS sel, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS size, 0.0::DOUBLE AS f FROM {p}rl UNION ALL
            SELECT doc_id, list_append(any_value(sel), arg_max(pos, o)), any_value(used) + arg_max(n, o), any_value(size) + arg_max(m, o), max(nf) FROM (
                SELECT h.*, {_f('hit', 'h.size + h.m', 'r.m')} AS nf, struct_pack(f := {_f('hit', 'h.size + h.m', 'r.m')}, p := -h.pos) AS o FROM (
                    SELECT doc_id, any_value(sel) AS sel, any_value(used) AS used, any_value(size) AS size, any_value(f) AS f, pos, any_value(n) AS n, any_value(m) AS m, sum(least(c, want)) AS hit FROM (
                        SELECT g.doc_id, any_value(g.sel) AS sel, any_value(g.used) AS used, any_value(g.size) AS size, any_value(g.f) AS f, l.pos, any_value(l.n) AS n, any_value(l.m) AS m, t.stem, sum(t.c) AS c, any_value(t.want) AS want
                        FROM {p}g g JOIN {p}len l ON l.doc_id = g.doc_id AND NOT list_contains(g.sel, l.pos) AND g.used + l.n <= {limit}
                        JOIN {p}tc t ON t.doc_id = g.doc_id AND (t.pos = l.pos OR list_contains(g.sel, t.pos)) GROUP BY g.doc_id, l.pos, t.stem)
                    GROUP BY doc_id, pos) h JOIN {p}rl r ON r.doc_id = h.doc_id)
            WHERE nf - f > 1e-12 GROUP BY doc_id"""),
        (f"{p}sel", f"SELECT doc_id, list_sort(arg_max(sel, len(sel))) AS sel FROM {p}g GROUP BY doc_id"),
    ]
