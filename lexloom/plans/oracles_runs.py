"""SQL equivalents of whole runs, made of the blocks of :mod:`sqlblocks`."""

from __future__ import annotations

from . import sqlblocks as B
from .oracles import _P, ORACLES, _collapsed, _kept, _minmax, _split, _view

_DOCS = [("d", f"SELECT doc_id, {_kept('text')} AS sents FROM documents")]
_P1, _P2 = (part + ")" if not part.endswith(")") else part for part in _P.split("), pd AS (", 1))
#: Processed records, the last of each id, with null sentences as empty ones.
_RECORDS = [
    ("p", _P1.removeprefix("p AS (").removesuffix(")")),
    ("d", "SELECT id AS doc_id, list_transform(v.sentences, lambda t: coalesce(t, '')) AS sents, v.highlights AS highlights FROM p WHERE v.sentences IS NOT NULL"),
]
_PICKED = "coalesce(array_to_string(list_transform(sel, lambda i: d.sents[i + 1]), ' '), '')"
#: Without the null sentences, as the union reads them.
_PLAIN = [_RECORDS[0], ("d", "SELECT id AS doc_id, list_filter(v.sentences, lambda t: t IS NOT NULL) AS sents FROM p WHERE v.sentences IS NOT NULL")]


def _shown(sel: str, more: str = "") -> str:
    return f"SELECT CAST(d.doc_id AS VARCHAR) AS id, array_to_string(sel, ',') AS places, {_PICKED} AS summary{more} FROM d JOIN {sel} w ON w.doc_id = d.doc_id"


_SCORED = [*_DOCS, *B.sentences("", "d"), *B.base("", "s")]
_POOLED = [*_SCORED, *B.pool("", "base", 15)]
_UNI = [*B.vectors("", "s"), *B.similarity("", "pool")]
_RANKED = [*_DOCS, *B.sentences("", "d"), *B.vectors("", "s"), *B.similarity("a", None, False, 0.2)]


def _graph(threshold: bool) -> B.Block:
    x = B.similarity("", None, False, 0.2 if threshold else 0.0)
    return [*_DOCS, *B.sentences("", "d"), *B.vectors("", "s"), *x, *B.textrank("", "s", "x")]


def _union(names: tuple[str, ...]) -> B.Block:
    """Members of the union of stored views: ``un(doc_id, pos)``."""
    every = "[]"
    for n in names:
        every = f"list_concat({every}, coalesce({n}.sel, []))"
    joins = " ".join(f"LEFT JOIN {n} ON {n}.id = d.doc_id" for n in names)
    views = [(n, _view(int(n[1:])).removeprefix(f"{n} AS (").removesuffix(")")) for n in names]
    return [*views, ("un", f"SELECT doc_id, unnest(places) AS pos FROM (SELECT d.doc_id, list_sort(list_distinct(list_filter({every}, lambda i: i >= 0 AND i < len(d.sents)))) AS places FROM d {joins})")]


def _dropped(threshold: float) -> B.Block:
    """Near-duplicates of the union dropped: ``kept``."""
    return [
        *B.sentences("", "d"), ("us", "SELECT s.doc_id, s.pos, s.sentence, s.n, count(*) OVER (PARTITION BY s.doc_id) AS cnt FROM s JOIN un ON un.doc_id = s.doc_id AND un.pos = s.pos"),
        *B.vectors("u", "us", True), *B.similarity("u"), *B.near_dropped("", "d", "un", "ux", threshold),
    ]


def _fast(p: str, members: str, s: str, limit: int, cost: str, alpha: str = "0.7", w: str = "0.5", rest: str = "0.5", docs: str = "d") -> B.Block:
    """The fused greedy selection of members as a document of their own."""
    return [*B.fused(p, members, s, w, rest), *B.similarity(p), *B.greedy(p, docs, f"{p}f", f"{p}x", limit, cost, alpha)]


def _resized(p: str, members: str, s: str, order: str = "pos") -> B.Block:
    """Members as the sentences of a new document ``{p}s`` with their first places ``{p}at``, and base scores of their own."""
    return [
        (f"{p}at", f"SELECT m.doc_id, s.sentence, s.n, m.pos AS old, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.{order}) - 1 AS pos, count(*) OVER (PARTITION BY m.doc_id) AS cnt FROM {members} m JOIN {s} s ON s.doc_id = m.doc_id AND s.pos = m.pos"),
        (f"{p}s", f"SELECT doc_id, pos, sentence, n, cnt FROM {p}at"), *B.base(p, f"{p}s"),
    ]


def _means(blocks: B.Block, runs: list[tuple[str, str]], pairs: str, labels: tuple[str, ...]) -> str:
    """Mean ROUGE of several selections: ``runs`` is (labels as SQL, relation ``doc_id, summary, reference``)."""
    union = " UNION ALL ".join(f"SELECT {k} AS run, doc_id, summary AS a, reference AS b FROM ({r})" for k, (_, r) in enumerate(runs))
    keyed = [("runs0", union), ("runs1", "SELECT run, doc_id, a, b, dense_rank() OVER (ORDER BY a, b) AS key FROM runs0"), *B.rouge("z", "runs1")]
    named = " UNION ALL ".join(f"SELECT {k} AS run, {label}" for k, (label, _) in enumerate(runs))
    final = f'SELECT {", ".join(labels)}, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2, round(avg("rougeL"), 6) AS "rougeL" FROM runs1 JOIN zrouge USING (key) JOIN ({named}) n USING (run) GROUP BY {", ".join(labels)}'
    return B.query([*blocks, *keyed], final)


def _picked(sel: str) -> str:
    return f"SELECT d.doc_id, {_PICKED} AS summary, d.highlights AS reference FROM d JOIN {sel} w ON w.doc_id = d.doc_id"


_PRED = [("pr", "SELECT pred_id, run_id, dense_rank() OVER (ORDER BY summary, reference) AS key, summary AS a, reference AS b FROM predictions"), *B.rouge("z", "pr")]
_BYRUN = 'SELECT run_id, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2, round(avg("rougeL"), 6) AS "rougeL" FROM pr JOIN zrouge USING (key) GROUP BY run_id'
_TOTAL = 'SELECT coalesce(avg(rouge1), 0.0) AS rouge1, coalesce(avg(rouge2), 0.0) AS rouge2, coalesce(avg("rougeL"), 0.0) AS "rougeL" FROM pr JOIN zrouge USING (key)'
_METRICS = f"SELECT unnest(['rouge1', 'rouge2', 'rougeL']) AS metric, round(unnest([rouge1, rouge2, \"rougeL\"]), 6) AS value FROM ({_TOTAL})"


def _recall() -> str:
    ref = [("rf", "SELECT doc_id, array_to_string(sents[1:3], ' ') AS text FROM d")]
    sizes, k = [], 3
    while k < 1 << 22:
        sizes.append(k)
        k = max(k + 1, -(-3 * k // 2))
    ranked = f"""SELECT b.doc_id, b.pos, b.n, b.score, row_number() OVER (PARTITION BY b.doc_id ORDER BY score DESC, b.pos) AS r, count(*) OVER (PARTITION BY b.doc_id) AS cnt FROM base b"""
    need = f"""SELECT q.doc_id, min(least(k, cnt)) AS k FROM (SELECT r.doc_id, any_value(r.cnt) AS cnt, list(r.r) FILTER (WHERE list_contains(o.sel, r.pos)) AS held, any_value(len(o.sel)) AS total FROM rk r LEFT JOIN osel o ON o.doc_id = r.doc_id GROUP BY r.doc_id) q,
        (SELECT unnest({sizes}) AS k) z WHERE k >= cnt OR coalesce(total, 0) = 0 OR len(list_filter(held, lambda t: t <= k)) / total::DOUBLE >= 0.8 - 1e-12 GROUP BY q.doc_id"""
    blocks = [*_SCORED, *ref, *B.rouge_oracle("o", "s", "rf", 100), ("rk", ranked), ("nd", need), ("pool", "SELECT rk.doc_id, pos, n, score FROM rk JOIN nd ON nd.doc_id = rk.doc_id AND r <= k")]
    return B.query([*blocks, *_UNI, *B.greedy("", "d", "pool", "x", 100)], _shown("sel"))


def _graph_preset() -> str:
    blocks = [*_DOCS, *B.sentences("", "d"), *B.vectors("", "s")]
    full = [("ax", B.similarity("", None, False)[0][1])]
    cut = [("bx", B.similarity("", None, False, 0.2)[0][1])]
    rank = [("pool", "SELECT doc_id, pos, n, score FROM (SELECT s.doc_id, s.pos, s.n, a.p / max(a.p) OVER (PARTITION BY s.doc_id) AS score, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(b.p, 10) DESC, s.pos) AS r FROM s JOIN atr a ON a.doc_id = s.doc_id AND a.pos = s.pos JOIN btr b ON b.doc_id = s.doc_id AND b.pos = s.pos) WHERE r <= 40")]
    return B.query([*blocks, *full, *cut, *B.textrank("a", "s", "ax"), *B.textrank("b", "s", "bx"), *rank, ("cx", "SELECT b.doc_id, i, j, round(x * 1e10) / 1e10 AS x FROM bx b JOIN pool p ON p.doc_id = b.doc_id AND p.pos = b.i JOIN pool q ON q.doc_id = b.doc_id AND q.pos = b.j"), *B.greedy("", "d", "pool", "cx", 300)], _shown("sel"))


def _two_stage() -> str:
    docs = [("d", f"SELECT row_id AS doc_id, flatten(list_transform(string_split(coalesce(article, ''), '|||||'), lambda a: {_split('a')})) AS sents FROM articles")]
    one = [*docs, *B.sentences("", "d"), *B.base("", "s"), *B.pool("", "base", 25), *_UNI, *B.greedy("", "d", "pool", "x", 25, "1")]
    two = [*B.encoder("e", "pool", "s"), ("epick", "SELECT doc_id, list(pos ORDER BY pos) AS sel FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM een) WHERE r <= 25 GROUP BY doc_id")]
    union = [
        ("ul", "SELECT d.doc_id, list_concat(g.sel, coalesce(e.sel, [])) AS l FROM d JOIN sel g ON g.doc_id = d.doc_id LEFT JOIN epick e ON e.doc_id = d.doc_id"),
        ("uo", "SELECT doc_id, list_filter(l, lambda a, i: list_position(l, a) = i)[1:15] AS places FROM ul"),
        ("um", "SELECT doc_id, unnest(places) AS pos, generate_subscripts(places, 1) AS ord FROM uo"),
    ]
    last = [*_resized("f", "um", "s", "ord"), *_fast("g", "fbase", "fs", 3, "1")]
    final = """SELECT CAST(d.doc_id AS VARCHAR) AS id, array_to_string(list_transform(g.sel, lambda i: u.places[i + 1]), ',') AS places, array_to_string(u.places, ',') AS candidates,
        coalesce(array_to_string(list_transform(g.sel, lambda i: d.sents[u.places[i + 1] + 1]), ' '), '') AS summary FROM d JOIN gsel g ON g.doc_id = d.doc_id JOIN uo u ON u.doc_id = d.doc_id"""
    return B.query([*one, *two, *union, *last], final)


def _stage2(cap: int, w: float, rest: float, alpha: float, tag: str) -> B.Block:
    capped = [(f"{tag}cp", f"SELECT doc_id, pos FROM (SELECT k.doc_id, k.pos, row_number() OVER (PARTITION BY k.doc_id ORDER BY round(b.score, 10) DESC, k.pos) AS r FROM kept k JOIN base b ON b.doc_id = k.doc_id AND b.pos = k.pos) WHERE r <= {cap}")]
    return [*capped, *_resized(f"{tag}q", f"{tag}cp", "s"), *_fast(tag, f"{tag}qbase", f"{tag}qs", 3, "1", str(alpha), str(w), str(rest)), (f"{tag}out", f"SELECT g.doc_id, coalesce(list(a.sentence ORDER BY a.pos) FILTER (WHERE list_contains(g.sel, a.pos)), []) AS picked FROM {tag}sel g LEFT JOIN {tag}qat a ON a.doc_id = g.doc_id GROUP BY g.doc_id")]


def _joined(tag: str) -> str:
    return f"SELECT d.doc_id, array_to_string(o.picked, ' ') AS summary, d.highlights AS reference FROM d JOIN {tag}out o ON o.doc_id = d.doc_id"


def _stage2_grid() -> str:
    views = [(n, _view(int(n[1:])).removeprefix(f"{n} AS (").removesuffix(")")) for n in ("v0", "v1")]
    cut = "SELECT doc_id, unnest(places) AS pos FROM (SELECT d.doc_id, list_sort(list_distinct(list_filter(list_concat(coalesce(v0.sel, [])[1:10], coalesce(v1.sel, [])[1:10]), lambda i: i >= 0 AND i < len(d.sents)))) AS places FROM d LEFT JOIN v0 ON v0.id = d.doc_id LEFT JOIN v1 ON v1.id = d.doc_id)"
    blocks, runs = [*_RECORDS, *views, ("un", cut), *_dropped(0.95), *B.base("", "s")], []
    for cap in (4, 8):
        for w in (0.3, 0.7):
            for alpha in (0.5, 0.9):
                tag = f"r{len(runs)}"
                blocks += _stage2(cap, w, 1 - w, alpha, tag)
                runs.append((f"'10' AS k1, '10' AS k2, '{cap}' AS cap, 'fast' AS method, '{w}' AS w_base, '{alpha}' AS alpha", _joined(tag)))
    return _means(blocks, runs, "", ("k1", "k2", "cap", "method", "w_base", "alpha"))


def _selector_grid() -> str:
    blocks, runs = [*_RECORDS, *B.sentences("", "d"), *B.base("", "s"), *B.pool("", "base", 15)], []
    for w in (0.3, 0.7):
        for alpha in (0.5, 0.7):
            tag = f"r{len(runs)}"
            blocks += _fast(tag, "pool", "s", 3, "1", str(alpha), str(w), str(1 - w))
            runs.append((f"'{w}' AS w_base, '{alpha}' AS alpha", _picked(f"{tag}sel")))
    return _means(blocks, runs, "", ("w_base", "alpha"))


_NAME = "CASE lower(regexp_replace(split_name, '^\\s+|\\s+$', '', 'g')) WHEN 'training' THEN 'train' WHEN 'valid' THEN 'validation' WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' ELSE lower(regexp_replace(split_name, '^\\s+|\\s+$', '', 'g')) END"


def _by_split() -> str:
    docs = [("d", f"SELECT row_id AS doc_id, {_kept('article')}[1:25] AS sents, coalesce(highlights, '') AS highlights, {_NAME} AS split FROM articles WHERE {_NAME} IN ('train', 'validation', 'test')")]
    blocks = [*docs, *B.sentences("", "d"), *B.base("", "s"), *B.pool("", "base", 15), *_UNI, *B.greedy("", "d", "pool", "x", 3, "1"), *_fast("f", "pool", "s", 3, "1")]
    runs0 = " UNION ALL ".join(f"SELECT '{m}' AS method, d.split, {_PICKED} AS a, d.highlights AS b FROM d JOIN {sel} w ON w.doc_id = d.doc_id" for m, sel in (("greedy", "sel"), ("fast", "fsel")))
    keyed = [("runs0", runs0), ("runs1", "SELECT *, dense_rank() OVER (ORDER BY a, b) AS key FROM runs0"), *B.rouge("z", "runs1")]
    return B.query([*blocks, *keyed], 'SELECT split, method, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2, round(avg("rougeL"), 6) AS "rougeL" FROM runs1 JOIN zrouge USING (key) GROUP BY split, method')


def _greedy_records(limit: int) -> B.Block:
    return [*_RECORDS, *B.sentences("", "d"), *B.base("", "s"), *B.pool("", "base", 15), *_UNI, *B.greedy(f"k{limit}", "d", "pool", "x", limit, "1")]


def _timed() -> str:
    pairs = [("pr", f"SELECT *, dense_rank() OVER (ORDER BY a, b) AS key FROM (SELECT summary AS a, reference AS b FROM ({_picked('k3sel')}))"), *B.rouge("z", "pr")]
    return B.query([*_greedy_records(3), *pairs], _METRICS)


def _tuned() -> str:
    blocks = [*_greedy_records(1), *B.greedy("k3", "d", "pool", "x", 3, "1")]
    one = lambda k: f"SELECT 'k{k}' AS name, summary AS a, reference AS b FROM ({_picked(f'k{k}sel')})"
    pairs = [("r0", f"{one(1)} UNION ALL {one(3)}"), ("pr", "SELECT *, dense_rank() OVER (ORDER BY a, b) AS key FROM r0"), *B.rouge("z", "pr")]
    return B.query([*blocks, *pairs], "SELECT name, name = 'k1' AS ran_first, name = 'k3' AS ran_second, round(avg(rouge1), 6) AS rouge1 FROM pr JOIN zrouge USING (key) GROUP BY name")


_FUSION_FAST = B.query(
    [*_PLAIN, *_union(("v0", "v1", "v2")), *_dropped(0.95), *B.base("", "s"),
     ("cp", "SELECT doc_id, pos FROM (SELECT k.doc_id, k.pos, row_number() OVER (PARTITION BY k.doc_id ORDER BY round(b.score, 10) DESC, k.pos) AS r FROM kept k JOIN base b ON b.doc_id = k.doc_id AND b.pos = k.pos) WHERE r <= 6"),
     *_resized("q", "cp", "s"), *_fast("f", "qbase", "qs", 60, "n")],
    "SELECT g.doc_id AS id, any_value(array_to_string(g.sel, ',')) AS places, coalesce(string_agg(a.sentence, ' ' ORDER BY a.pos) FILTER (WHERE list_contains(g.sel, a.pos)), '') AS summary FROM fsel g LEFT JOIN qat a ON a.doc_id = g.doc_id GROUP BY g.doc_id",
)
_LEAD = "pos % 2 = 0"
_MARK = "md5('2024|' || CAST(row_id AS VARCHAR))"
_STREAM = B.query([*_POOLED, *_UNI, *B.greedy("", "d", "pool", "x", 100)], _shown("sel"))
_EDGES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

RUNS = {
    "textrank": B.query(_graph(False), "SELECT doc_id, pos, round(p, 6) AS score FROM tr"),
    "textrank_threshold": B.query(_graph(True), "SELECT doc_id, pos, round(p, 6) AS score FROM tr"),
    "topk_graph": B.query(_graph(True), "SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 10) DESC, pos) AS r FROM tr) WHERE r <= 5"),
    "graph_preset": _graph_preset(),
    "oracle_candidates": B.query([*_DOCS, *B.sentences("", "d"), ("rf", "SELECT doc_id, array_to_string(sents[1:3], ' ') AS text FROM d"), *B.rouge_oracle("o", "s", "rf", 60)], "SELECT doc_id, unnest(sel) AS pos FROM osel"),
    "recall_target": _recall(),
    "weight_gates": B.query([*_DOCS, *B.sentences("", "d"), *B.base("", "s", "0.0", "1.0", "1.0")], "SELECT doc_id, pos, round(score + 1e-9, 6) AS score FROM base"),
    "centroid_centrality": B.query([*_DOCS, *B.sentences("", "d"), *B.vectors("", "s"), *B.centroid("", "s"), ("r", "SELECT doc_id, pos, round(c, 12) AS c FROM cc")], f"SELECT doc_id, pos, round({_minmax('c')}, 6) AS score FROM r"),
    "words_preset": B.query([*_POOLED, *B.skip_fill("", "d", "pool", 400, "round(score * 1e10) DESC, pos DESC")], _shown("sel")),
    "encoder_rank": B.query([*_SCORED, *B.pool("", "base", 40), *B.encoder("", "pool", "s"), *B.skip_fill("", "d", "en", 300)], _shown("sel")),
    "grasp_plain": B.query([*_POOLED, *_UNI, *B.greedy("", "d", "pool", "x", 100), *B.local_search("", "sel", "x", 100)], _shown("found")),
    "fast_grasp_plain": B.query([*_POOLED, *_fast("f", "pool", "s", 100, "n"), *B.local_search("f", "fsel", "fx", 100)], _shown("ffound")),
    "nsga2_small_pool": B.query([*_SCORED, *B.pool("", "base", 6), *B.vectors("", "s"), *B.similarity("", "pool", False), *B.best_subset("", "d", "pool", "x", 100, 6)], _shown("sel")),
    "nsga2_diversity_small_pool": B.query([*_SCORED, *B.pool("", "base", 6), *B.vectors("", "s"), *B.similarity("", "pool", False), *B.best_subset("", "d", "pool", "x", 100, 6, diversity=True)], _shown("sel")),
    "fast_nsga2_small_pool": B.query([*_SCORED, *B.pool("", "base", 6), *B.fused("f", "pool", "s"), *B.similarity("f", None, False), *B.best_subset("f", "d", "ff", "fx", 245, 6, ("1.0", "2.5", "1.2"))], _shown("fsel")),
    "fallback_without_similarity": B.query([*_POOLED, *B.greedy("", "d", "pool", None, 100)], _shown("sel", ", CASE WHEN len(d.sents) > 0 THEN 'nsga2 without similarity' END AS fallback_reason")),
    "grasp_objective": B.query([*_SCORED, ("lead", "SELECT doc_id, pos FROM s WHERE pos < 10"), *B.vectors("", "s"), *B.similarity("", "lead", False), ("r", "SELECT doc_id, sum(x) AS x FROM x WHERE i < j GROUP BY doc_id"), ("o", "SELECT doc_id, sum(score) AS o FROM base WHERE pos < 10 GROUP BY doc_id")], "SELECT o.doc_id, round(o - (1 - 0.7::DOUBLE) * coalesce(x, 0.0) + 1e-9, 6) AS value FROM o LEFT JOIN r ON o.doc_id = r.doc_id"),
    "coverage_of_lead": B.query(
        [*_DOCS, *B.sentences("", "d"), *B.vectors("", "s"), *B.similarity("", None, False),
         ("m", "SELECT doc_id, i, max(x) AS x FROM x WHERE j % 2 = 0 GROUP BY doc_id, i"), ("c", "SELECT s.doc_id, count(*) FILTER (WHERE s.pos % 2 = 0) AS k, avg(coalesce(x, 0.0)) AS c FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.pos = m.i GROUP BY s.doc_id"),
         ("r", "SELECT doc_id, sum(x) AS x FROM x WHERE i < j AND i % 2 = 0 AND j % 2 = 0 GROUP BY doc_id"),
         ("q", "SELECT c.doc_id, k, c, CASE WHEN k > 1 THEN coalesce(x, 0.0) / (k * (k - 1) / 2.0) ELSE 0.0 END AS r FROM c LEFT JOIN r ON c.doc_id = r.doc_id")],
        "SELECT doc_id, round(c, 6) AS coverage, round(c, 6) AS coverage_set, round(CASE WHEN k > 1 THEN c - 0.3::DOUBLE * r ELSE c END, 6) AS coverage_diversity, round(r, 6) AS redundancy FROM q",
    ),
    "near_dup_drop": B.query([*_PLAIN, *_union(("v0", "v1", "v2")), *_dropped(0.9)], "SELECT doc_id AS id, CAST(pos AS BIGINT) AS pos FROM kept"),
    "union_documents": B.query([*_PLAIN, *_union(("v0", "v1", "v2"))], "SELECT d.doc_id AS id, coalesce(string_agg(d.sents[un.pos + 1], ' | ' ORDER BY un.pos), '') AS members FROM d LEFT JOIN un ON un.doc_id = d.doc_id GROUP BY d.doc_id"),
    "fusion_fast": _FUSION_FAST,
    "service_two_stage": _two_stage(),
    "rouge_stemmed": B.query(_PRED, 'SELECT pred_id, rouge1, rouge2, "rougeL" FROM pr JOIN zrouge USING (key)'),
    "rouge_mean": B.query(_PRED, _BYRUN),
    "metric_rows": B.query(_PRED, _METRICS),
    "metrics_file": B.query(_PRED, _METRICS),
    "best_runs": B.query(_PRED, f'SELECT * FROM ({_BYRUN}) ORDER BY rouge1 DESC, rouge2 DESC, "rougeL" DESC, run_id LIMIT 10'),
    "selector_grid": _selector_grid(),
    "stage2_grid": _stage2_grid(),
    "selectors_by_split": _by_split(),
    "timed_two_phases": _timed(),
    "tune_with_skip": _tuned(),
    "rerank_files": """WITH c AS (SELECT id, pred_id, summary, coalesce(len(selected_indices), 0)::DOUBLE AS b, min(reference) OVER (PARTITION BY id) AS article, row_number() OVER (PARTITION BY id ORDER BY pred_id) - 1 AS k FROM predictions WHERE id IS NOT NULL AND summary IS NOT NULL),
        w AS (SELECT *, len(list_intersect(list_distinct(list_filter(string_split(lower({0}), ' '), lambda t: t <> '')), list_distinct(list_filter(string_split(lower({1}), ' '), lambda t: t <> ''))))::DOUBLE AS c FROM c),
        f AS (SELECT *, round(c * 0.6::DOUBLE + b * 0.4::DOUBLE, 10) AS f FROM w)
        SELECT id, string_agg(k, ',' ORDER BY f DESC, k) AS rerank_order, first(summary ORDER BY f DESC, k) AS summary FROM f GROUP BY id""".format(_collapsed("summary"), _collapsed("article")),
    "csv_scan": "SELECT CAST(row_id AS VARCHAR) AS id, coalesce(article, '') AS article, coalesce(highlights, '') AS highlights FROM articles",
    "jsonl_scan": "SELECT id, CASE WHEN sentences IS NULL THEN NULL ELSE CAST(len(sentences) AS BIGINT) END AS n, CASE WHEN sentences IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(sentences, lambda t: t IS NOT NULL), chr(10)), '') END AS joined, highlights FROM processed",
    "tagged_scan": "SELECT lang AS id, lang || ' again' || chr(10) || lang_title AS article, CASE WHEN lang > 'e' THEN lang_title ELSE '' END AS highlights FROM languages",
    "run_sidecars": "SELECT run_id AS id, selector AS summary, CAST(run_no AS VARCHAR) AS places, 'greedy' AS method, true AS timed, '3' AS k FROM runs",
    "run_layouts": """SELECT * FROM (SELECT CASE WHEN stage_name = 'stage1' THEN 'tune1-' || selector || '-k' || keep_k || '-20240101-101010' ELSE 'fast2-fast_grasp-k1' || run_no || '-k2' || keep_k || '-cap' || max_tokens || '-20240101-101010-x' END AS name,
        CASE WHEN stage_name <> 'stage1' THEN 'stage2' WHEN selector IN ('greedy', 'grasp', 'nsga2', 'bert') THEN 'stage1' END AS stage,
        CASE WHEN stage_name <> 'stage1' THEN 'fast_grasp' WHEN selector IN ('greedy', 'grasp', 'nsga2', 'bert') THEN selector END AS method,
        CASE WHEN stage_name <> 'stage1' THEN run_no WHEN selector IN ('greedy', 'grasp', 'nsga2', 'bert') THEN keep_k END AS k1,
        CASE WHEN stage_name <> 'stage1' THEN keep_k END AS k2, CASE WHEN stage_name <> 'stage1' THEN max_tokens END AS cap,
        CASE WHEN stage_name <> 'stage1' OR selector IN ('greedy', 'grasp', 'nsga2', 'bert') THEN '20240101-101010' END AS stamp FROM runs)""",
    "summary_files": "SELECT run_id, selector, CAST(keep_k AS VARCHAR) AS keep_k, '' AS max_tokens FROM runs WHERE stage_name = 'stage1' UNION ALL SELECT run_id, '', '', CAST(max_tokens AS VARCHAR) FROM runs WHERE stage_name <> 'stage1'",
    "split_files": f"SELECT CAST(row_id AS VARCHAR) AS id, {_NAME} AS split, {_NAME} AS wanted FROM articles WHERE {_NAME} IN ('train', 'validation', 'test')",
    "dashed_documents": f"""WITH p AS (SELECT row_id, list_filter(list_transform(string_split(article, '|||||'), lambda t: regexp_replace(t, '^{_EDGES}+|{_EDGES}+$', '', 'g')), lambda t: t <> '') AS l FROM articles)
        SELECT row_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS document FROM p""",
    "stage1_configs": "SELECT run_id, selector AS method, 'sentences' AS unit, keep_k AS max_sentences, keep_k AS k, true AS use_candidates FROM runs WHERE stage_name = 'stage1'",
    "yaml_configs": "SELECT run_id, selector AS method, max_tokens, keep_k AS k, 'score,position' AS sources, seed FROM runs WHERE selector NOT IN ('bert', 'xlnet')",
    "sample_then_limit": f"""WITH r AS (SELECT row_id, {_kept('article')} AS k, highlights FROM articles WHERE substr({_MARK}, 1, 8) < '80000000' ORDER BY row_id LIMIT 100)
        SELECT CAST(row_id AS VARCHAR) AS id, CAST(len(k) AS BIGINT) AS n_sentences, coalesce(highlights, '') AS highlights FROM r""",
    "sample_n": f"SELECT row_id FROM articles ORDER BY {_MARK}, row_id LIMIT 100",
    "split_70_20_10": f"""WITH r AS (SELECT row_id, row_number() OVER (ORDER BY {_MARK}, row_id) - 1 AS k, count(*) OVER () AS n FROM articles)
        SELECT row_id, CASE WHEN k < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN k < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM r""",
    "hub_rows": f"""SELECT 'train_' || row_id AS id, array_to_string({_kept("replace(article, '|||||', ' ')")}, chr(10)) AS kept, regexp_replace(trim(coalesce(highlights, '')), '^- ', '') AS highlights FROM articles""",
    "hub_limit": f"""SELECT 'test_' || row_id AS id, array_to_string({_kept("replace(article, '|||||', ' ')")}, chr(10)) AS kept, regexp_replace(trim(coalesce(highlights, '')), '^- ', '') AS highlights FROM (SELECT * FROM articles ORDER BY row_id LIMIT 50)""",
    "trim_sentences": B.query([*_DOCS, *B.sentences("", "d")], "SELECT doc_id, pos, sentence FROM s WHERE pos < 3"),
    "sql_functions": B.query(
        [("pr", "SELECT pred_id, dense_rank() OVER (ORDER BY summary, reference) AS key, summary AS a, reference AS b FROM predictions"), *B.rouge("z", "pr")],
        f"SELECT pred_id, CAST(len(list_filter(string_split({_collapsed('a')}, ' '), lambda t: t <> '')) AS INTEGER) AS n_tokens, coalesce(array_to_string({_split('a')}, '|'), '') AS sentences, rouge1 FROM pr JOIN zrouge USING (key)",
    ),
    "sentence_token_function": "WITH t AS (SELECT pred_id, regexp_extract_all(lower(coalesce(summary, '')), '[\\p{L}\\p{N}_]{2,}') AS l FROM predictions) SELECT pred_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS token FROM t",
    "streamed_summaries": _STREAM,
}

ORACLES.update(RUNS)
