"""Near-duplicates, overlaps, subsets, encoding and containers."""

import random

import numpy as np
import pytest

from lexloom.llm import binpack, bpe, countvectors, forms, nearcopies, overlap, prefixes, routes, varied
from lexloom.sources.tables import settled

WORDS = [a + b + c for a in ("ba", "ko", "ri", "tu") for b in ("len", "mor", "sip", "vak") for c in ("d", "sto", "ri", "nem")]


def passage(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus(seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(30):
        base = passage(rng)
        rows += [base] + [edited(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(0, 4))]
    rows += [rows[0]] * 80 + [None, "", "   ", "too short", rows[1].upper(), rows[2].replace("o", "о")]
    return [(k + 1, t) for k, t in enumerate(rows)]


def brute_pairs(rows, threshold=0.6):
    sets = [(k, countvectors.tokens(t)) for k, t in rows]
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if countvectors.similarity(x, y) >= threshold}


def test_near_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id bigint, article string, n string")
    found = [tuple(r) for r in nearcopies.near_pairs(df).select("row_a", "row_b").collect()]
    want = brute_pairs(rows)
    assert len(found) == len(set(found)) and set(found) == want
    assert nearcopies.near_pairs(df.limit(0)).count() == 0


def test_hot_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    rng = random.Random(1)
    base = passage(rng, 60)
    rows = [(k, edited(rng, base, 1)) for k in range(25)]
    df = spark.createDataFrame(rows, "row_id bigint, article string")
    assert {tuple(r)[:2] for r in nearcopies.near_pairs(df).collect()} == brute_pairs(rows)


def test_keys_meet_in_every_class():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for chars in (170, 300, 900):
        a, b, near = [], [], []
        for _ in range(400):
            x = "".join(rng.choice(letters) for _ in range(chars))
            cut = int(chars * rng.uniform(0.08, 0.26))
            at = rng.randrange(chars - cut)
            y = x[:at] + "".join(rng.choice(letters) for _ in range(cut)) + x[at + cut :]
            s = countvectors.similarity(countvectors.tokens(x), countvectors.tokens(y))
            if s >= 0.6:
                a.append(x)
                b.append(y)
        met = (countvectors.Sketches(a).keys == countvectors.Sketches(b).keys).any(axis=1)
        assert len(a) > 150 and met.mean() >= 0.985, chars


def test_short_values_and_classes(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghijkl") for _ in range(n)) for n in (45, 60, 80, 120) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        at = rng.randrange(len(t) - 4)
        rows.append((1000 + k, t[:at] + "zz" + t[at + 1 :]))
        rows.append((2000 + k, t[: int(len(t) * 0.8)] + "q" * 9))
        if k % 3 == 0:
            rows.append((3000 + k, t))
    want = brute_pairs(rows)
    df = spark.createDataFrame(rows, "row_id bigint, article string")
    assert {tuple(r)[:2] for r in nearcopies.near_pairs(df).collect()} == want
    links = {}
    for a, b in want:
        links[a] = links.get(a, 0) + 1
        links[b] = links.get(b, 0) + 1
    found = {r.row: r for r in nearcopies.near_classes(df).collect()}
    assert {k: r.links for k, r in found.items()} == {k: links.get(k, 0) for k, _ in rows}
    assert found[3000].class_id == 0 and found[3000].copies == 2 and nearcopies.near_classes(df.limit(0)).count() == 0



def test_tree_bound_loses_nothing():
    rng = random.Random(9)
    texts = [passage(rng) for _ in range(60)]
    texts += [edited(rng, t, 2) for t in texts[:30]]
    found = countvectors.Sketches(texts)
    counts = countvectors.unpacked([bytes(x) for x in found.packed])
    tree = countvectors.CountRTree(counts, found.excess, found.n, 0.6)
    q, v = tree.search(counts, found.excess, found.n)
    pairs = {(int(a), int(b)) for a, b in zip(q, v) if a < b}
    sets = [countvectors.tokens(t) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if countvectors.similarity(sets[a], sets[b]) >= 0.6}
    assert want and want <= pairs


def test_overlaps_against_brute_force(spark):
    rows = corpus(8)
    rng = random.Random(2)
    names = ["train", " Training ", "valid", "TEST", "dev", None, "other"]
    full = [(k, t, passage(rng, 12) if k % 5 else "same highlights for many rows of the whole table " * 2, rng.choice(names), "s1" if k % 3 else None) for k, t in rows]
    df = spark.createDataFrame(full, "row_id bigint, article string, highlights string, split_name string, source string")
    found = [tuple(r) for r in overlap.overlap_pairs(overlap.overlaps(df)).collect()]
    kind = {" Training ": "train", "train": "train", "valid": "validation", "dev": "validation", "TEST": "test"}
    want = set()
    for field in (1, 2):
        for a, b in brute_pairs([(r[0], r[field]) for r in full]):
            x, y = full[a - 1], full[b - 1]
            for e, t in ((x, y), (y, x)):
                if kind.get(t[3]) == "train" and kind.get(e[3]) in ("validation", "test"):
                    want.add((kind[e[3]], e[4], a, b))
    assert len(found) == len(set(found)) and set(found) == want
    counts = overlap.overlap_counts(overlap.overlaps(df)).collect()
    assert sum(r.pairs for r in counts) == len(want)
    assert overlap.overlaps(df.limit(0)).count() == 0


def short_pairs(count=300):
    """Pairs of 31 runs each that share 24 of them: similarity 24 / 38."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(count):
        common = "".join(rng.choice(letters) for _ in range(33))
        yield common + "".join(rng.choice(letters[:13]) for _ in range(7)), common + "".join(rng.choice(letters[13:]) for _ in range(7))


def test_overlaps_of_short_highlights_are_all_found(spark):
    rows = []
    for k, (x, y) in enumerate(short_pairs()):
        rows += [(2 * k, None, x, "train", "s"), (2 * k + 1, None, y, "test", "s")]
    df = spark.createDataFrame(rows, "row_id bigint, article string, highlights string, split_name string, source string")
    found = overlap.overlap_pairs(overlap.overlaps(df)).collect()
    assert {(r.row_a, r.row_b) for r in found} == {(2 * k, 2 * k + 1) for k in range(300)}


def test_coverage_unites_all_training_texts(spark):
    rng = random.Random(21)
    a, b, c, own = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(4))
    rows = [
        (1, a + "".join(rng.choice("abcdefghij") for _ in range(900)), None, "train", "s"),  # holds a, far longer
        (2, b, None, "train", "s"), (3, c, None, "train", "s"),
        (4, a, None, "test", "s"), (5, b + c, None, "test", "s"), (6, own, None, "test", "s"), (7, own + own + b, a, "dev", None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, article string, highlights string, split_name string, source string")
    train = {k[i : i + 10] for _, k, *_ in rows[:3] for i in range(len(k) - 9)}

    def share(text):
        marked = {j for i in range(len(text) - 9) if text[i : i + 10] in train for j in range(i, i + 10)}
        return len(marked) / len(text)

    found = {(r.eval_row, r.field): r.coverage for r in overlap.coverages(df).collect()}
    want = {(k, "article"): share(text) for k, text, *_ in rows[3:]} | {(7, "highlights"): 0.0}
    assert found == pytest.approx(want) and found[4, "article"] == found[5, "article"] == 1.0
    means = {(r.eval_split, r.source): r for r in overlap.overlap_counts(overlap.overlaps(df), overlap.coverages(df)).collect()}
    assert means["test", "s"].mean_coverage == pytest.approx(2 / 3, abs=1e-5) and means["validation", None].mean_coverage == pytest.approx(1 / 3, abs=1e-5)


def test_encoding_equals_the_library_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.tokenizer()
    rng = random.Random(4)
    letters = "abc ÉñßжЩ年人ハひก้هأ 0123456789.,!'’“\n\t​🙂"
    texts = ["don't we'll THEY'RE I'd", "<|endoftext|>", "a" * 4000, "在康玉与天雪之间投入4048元后，工程师", "   x  \n\n y "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == other.encode_ordinary(t) and own.decode(ids) == t and own.count(t) == len(ids)
    df = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "one two"])], "doc_id bigint, text string")
    assert {r.doc_id: len(r.ids) for r in bpe.encode_ids(df).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_ids(df)).collect()} == {0: "", 1: "", 2: "one two"}


def optimum(sizes, capacity):
    """Least number of containers by branching."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[k] and rooms[j] not in rooms[:j]:
                place(k + 1, rooms[:j] + [rooms[j] - sizes[k]] + rooms[j + 1 :])
        place(k + 1, rooms + [capacity - sizes[k]])

    place(0, [])
    return best


def test_bound_and_packing_against_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.randrange(8, 30)
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        used = max(binpack.best_fit_decreasing(sizes, capacity)) + 1
        assert binpack.lower_bound(np.array(sizes), capacity) <= optimum(sizes, capacity) <= used


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(binpack, "PARTITION_ITEMS", 40)
    rng = random.Random(7)
    sizes = {k: rng.choice([0, 1, 7, 30, 55, 99, 250]) for k in range(200)}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()], "doc_id bigint, n_tokens bigint, bin string")
    asked = spark.createDataFrame([(1, 100), (2, 512)], "capacity_id int, capacity_tokens int")
    rows = binpack.containers(df, asked).collect()
    for number, capacity in ((1, 100), (2, 512)):
        own = [r for r in rows if r.capacity_id == number]
        total, fill = {}, {}
        for r in own:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            fill[r.container_no] = fill.get(r.container_no, 0) + r.n_tokens
            assert (r.piece == 0 and r.n_tokens == sizes[r.doc_id]) or sizes[r.doc_id] > capacity
        assert total == sizes and max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert all(fill[r.container_no] == r.container_tokens for r in own)
    assert binpack.containers(df.limit(0), asked).count() == 0


def test_exchange_goes_on_while_containers_fall(spark, monkeypatch):
    monkeypatch.setattr(binpack, "PARTITION_ITEMS", 20)
    rng = random.Random(1)
    df = spark.createDataFrame([(k, rng.randrange(26, 50)) for k in range(4000)], "doc_id bigint, n_tokens bigint")
    asked = spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")
    used = [binpack.containers(df, asked, **rounds).agg({"container_no": "max"}).first()[0] + 1 for rounds in ({"rounds": 3}, {})]
    assert used[1] < used[0]


def test_subsets(spark):
    rng = random.Random(3)
    topics = [[f"{w} and {rng.choice(WORDS)} went to {w} with {rng.choice(WORDS)}." for _ in range(30)] for w in WORDS[:6]]
    lists = [[s for t in topics for s in t[k : k + 2]] + ["same sentence everywhere."] * (k % 4) for k in range(0, 30, 2)]
    processed = spark.createDataFrame([(f"train_{k}", x, "h") for k, x in enumerate(lists)] + [("none", None, ""), ("empty", [], ""), ("few", ["Only one here.", None, "…"], "")], "id string, sentences array<string>, highlights string")
    articles = spark.createDataFrame([(f"train_{k}", "test" if k % 2 else "valid", "s1") for k in range(15)], "id string, split_name string, source string")
    predictions = spark.createDataFrame([("r", "train_0", [0, 2, 2, 99]), ("r", "train_0", [0, 2, 2, 99]), ("r", "train_0", [0]), ("r", "train_1", None)], "run_id string, id string, selected_indices array<int>")
    requests = spark.createDataFrame([(1, "all", None, 6), (2, "each_record", None, 3), (3, "split", "test", 4), (4, "source", "s1", 500), (5, "source", "nobody", 5)], "request_id int, scope_kind string, scope_name string, pick_count int")
    base = varied.records(processed, articles, predictions, requests)
    picked = varied.subsets(base, requests)
    rows = picked.collect()
    by = {q: [r for r in rows if r.request_id == q] for q in range(1, 6)}
    assert len(by[1]) == 6 and len({r.sentence for r in by[1]}) == 6
    assert len({r.sentence.split()[0] for r in by[1]} | {"x"}) >= 5  # the topics, not one of them
    assert len(by[2]) == 15 * 3 + 1 and len(by[3]) == 4 and by[5] == []
    every = {" ".join(s.split()) for x in lists for s in x}
    assert len(by[4]) == min(500, len(every)) and {r.sentence for r in by[4]} == every
    assert {r.id for r in by[3]} <= {f"train_{k}" for k in range(1, 15, 2)}
    shares = {(r.id, r.pos): r.selected_by for r in rows}
    assert shares.get(("train_0", 0), 1.0) == 1.0
    measured = {r.request_id: r for r in varied.comparison(picked, base).collect()}
    assert measured[2].picks == 46 and 0 < measured[2].cover <= 1.0001
    whole = {r.request_id: r for r in varied.scope_comparison(picked, base, varied.whole_scopes(requests)).collect()}
    assert set(whole) == {1, 3, 4} and whole[4].cover > 0.999 and whole[1].cover > whole[1].cover_predicted


def test_scope_of_alike_sentences_gives_the_whole_count(spark):
    lists = [[f"Flight {k} landed at gate {k + n}." for n in range(3)] for k in range(10)] * 2 + [["One other sentence stands here."]] * 40
    processed = spark.createDataFrame([(f"train_{k}", x) for k, x in enumerate(lists)], "id string, sentences array<string>")
    articles = spark.createDataFrame([(f"train_{k}", "test" if k < 15 else "train", "s1") for k in range(len(lists))], "id string, split_name string, source string")
    predictions = spark.createDataFrame([("r", "train_0", [0])], "run_id string, id string, selected_indices array<int>")
    requests = spark.createDataFrame([(1, "all", None, 25), (2, "split", "test", 30), (3, "source", "s1", 900)], "request_id int, scope_kind string, scope_name string, pick_count int")
    rows = varied.subsets(varied.records(processed, articles, predictions, requests), requests).collect()
    for request, count in ((1, 25), (2, 30), (3, 31)):
        own = [r for r in rows if r.request_id == request]
        assert len(own) == count == len({r.sentence for r in own})


def test_ward_merges_like_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, varied.DIM))
    merges = varied.ward(np.ones(12), x)
    groups = [[k] for k in range(12)]

    def cost(a, b):
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()

    while len(groups) > 4:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[a] += groups.pop(b)
    found = varied.groups_at(12, merges, 4)
    assert sorted(sorted(np.flatnonzero(found == g).tolist()) for g in range(4)) == sorted(sorted(g) for g in groups)


def test_cf_tree_keeps_mass_and_bounds_entries():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(5000, varied.DIM))
    tree = varied.CFTree(200)
    tree.add(np.ones(5000), points, (points**2).sum(axis=1))
    assert len(tree.n) <= 200 and tree.n.sum() == 5000 and np.allclose(tree.sums.sum(axis=0), points.sum(axis=0))


def test_many_buckets_find_the_same_in_small_heads(spark, monkeypatch):
    """p4 at size: a set with few tokens in each of many buckets; equal sets still collapse."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(20)]
    rows = [(k, texts[k % 20] if k % 3 else texts[k % 20][:330], None, "test" if k // 20 % 2 else "train", "s") for k in range(80)]
    df = spark.createDataFrame(rows, "row_id long, article string, highlights string, split_name string, source string").repartition(3)
    few = sorted(map(tuple, overlap.overlap_pairs(overlap.overlaps(df)).collect()))
    monkeypatch.setattr(prefixes, "BUCKET_TOKENS", 20)
    assert few and sorted(map(tuple, overlap.overlap_pairs(overlap.overlaps(df)).collect())) == few

    sets = countvectors.TokenSets(texts * 50)
    n = np.arange(len(sets.n))
    made = list(prefixes._dealt(sets, n * 2 + 10**9, np.ones(len(n), np.int64), np.zeros(1 << 24, bool), np.zeros(1 << 22, np.uint8), 0.6, 400))
    size, tokens = sum(len(d) for _, d in made), prefixes.prefixes(sets, np.zeros(1 << 22, np.uint8), 0.6)[1].sum()
    assert len(made) == 400 and size < 8.5 * tokens
    told = list(prefixes._dealt(sets, n[::-1] * 2, n % 3 + 1, None, np.zeros(1 << 22, np.uint8), 0.6, 4))
    back = [prefixes._unpacked(d) for _, d in told]
    assert all(((n % 3 + 1)[len(n) - 1 - r[0] // 2] == r[3]).all() and (sets.n[len(n) - 1 - r[0] // 2] == r[1]).all() and r[5].all() for r in back)
    assert sum(r[2].sum() for r in back) == tokens == sum(len(r[6]) for r in back)


def test_shuffle_files_of_a_last_use_are_gone_at_once(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    df = spark.range(5000).repartition(7, "id")
    kept = settled(df, last=True)
    shuffles = list(df._jdf.queryExecution().executedPlan().context().shuffleIds().keySet())
    names = disk.getAllFiles().mkString(" ")
    assert shuffles and not any(f"shuffle_{k}_" in names for k in shuffles) and kept.count() == 5000


def test_token_sets_are_made_in_blocks(monkeypatch):
    """Arrays as long as a block, not as a batch; the sets of each text are those of the text alone."""
    rng = random.Random(3)
    texts = [None, "", "short", *(passage(rng, rng.randrange(5, 60)) for _ in range(60)), passage(rng, 400)]
    sizes, plain = [], countvectors.bare_batch
    monkeypatch.setattr(countvectors, "bare_batch", lambda some: (sizes.append(sum(len(t or "") for t in some)), plain(some))[1])
    monkeypatch.setattr(forms, "BLOCK", 1000)
    found = countvectors.TokenSets(texts)
    assert max(sizes[:-1]) <= 1000 < sizes[-1] == len(texts[-1]) and sum(sizes) == sum(len(t or "") for t in texts)
    want = [countvectors.tokens(t) for t in texts]
    assert found.which.tolist() == [k for k, t in enumerate(want) if len(t)] and found.n.tolist() == [len(want[k]) for k in found.which]
    assert all((found.tokens[a : a + n] == want[k]).all() for k, a, n in zip(found.which, found.start, found.n))
    assert len(countvectors.TokenSets([]).fp_a) == 0 == len(countvectors.TokenSets([None]).tokens)


@pytest.mark.parametrize("sides", [True, False])
def test_meetings_by_brute_force(monkeypatch, sides):
    """Who meets whom on a bucket's tokens, in steps of any size."""
    rng = np.random.default_rng(4)
    m = 60
    sizes, held, of = rng.integers(5, 40, m), rng.integers(1, 9, m), rng.integers(1, 4, m)
    tokens = rng.integers(0, 25, held.sum()).astype(np.uint32)
    rows = rng.permutation(1000)[:m] * 2
    data = prefixes._packed(rows, sizes, held, of, np.arange(m, dtype=np.uint64), np.zeros(m, bool), tokens)
    own = np.repeat(np.arange(m), held)
    want = []
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            if tokens[i] == tokens[j] and a != b and min(sizes[a], sizes[b]) >= 0.6 * max(sizes[a], sizes[b]) - 1e-9:
                if of[a] & 2 and of[b] & 1 if sides else rows[a] < rows[b]:
                    want.append((rows[a], rows[b]))
    for step, most in ((7, 50), (1 << 16, 4_000_000)):
        monkeypatch.setattr(prefixes, "SLICE", step)
        monkeypatch.setattr(prefixes, "HELD", most)
        bucket = prefixes._Bucket([data], 0.6, sides)
        parts = list(bucket.meetings())
        assert len(parts) == 1 or max(map(len, parts)) <= most + step + m
        e, t = np.divmod(np.concatenate(parts), m)
        assert want and sorted(zip(bucket.rows[e], bucket.rows[t])) == sorted(want)


def test_texts_of_the_same_phrases_are_not_routed(spark, monkeypatch):
    """p4 at size: texts that share a third of their phrases meet on rare tokens, yet only near ones come out of any round."""
    rng = random.Random(6)
    phrases = [passage(rng, 5) for _ in range(12)]
    texts = []
    for k in range(90):
        text = edited(rng, rng.choice(texts), rng.randrange(0, 12)) if k % 3 == 2 else " ".join(rng.choice(phrases) if j % 3 == 0 else passage(rng, 5) for j in range(rng.randrange(3, 30)))
        texts.append(text)
    rows = [(k, t, texts[-k] if k % 5 == 0 else None, k % 2 == 0) for k, t in enumerate(texts)] + [(90, texts[3], None, True), (91, texts[4], "", False), (92, "too short", None, True)]
    df = spark.createDataFrame(rows, "row_id bigint, article string, highlights string, asked boolean").repartition(3)
    sets = [(2 * r[0] + f, frozenset(countvectors.tokens(r[1 + f] or "").tolist()), r[3]) for r in rows for f in (0, 1)]
    sets = [x for x in sets if x[1]]
    least, sides = {}, {}
    for row, s, asked in sorted(sets):
        least.setdefault((row % 2, s), row)
        sides.setdefault((row % 2, s), set()).add(asked)
    want = {(a, b) for (f, x), a in least.items() for (g, y), b in least.items() if f == g and a != b and True in sides[f, x] and False in sides[g, y] and len(x & y) >= 0.6 * max(len(x), len(y)) - 1e-9}
    base = settled(prefixes.fingerprints(df.withColumn("tag", df.asked), "row_id", ["article", "highlights"], "tag"))
    repeated = base.groupBy("field", "fp_a", "fp_b").count().where("count > 1")
    met = prefixes.prefix_pairs(df, base, "row_id", ["article", "highlights"], 0.6, df.asked, ~df.asked).count()
    for most in (8_000_000, 3_000):
        monkeypatch.setattr(routes, "ROUND_TOKENS", most)
        found = [tuple(r) for r in routes.routed_pairs(df, len(sets), "row_id", ["article", "highlights"], 0.6, df.asked, ~df.asked, repeated).collect()]
        assert want and want <= set(found) and len(found) == len(set(found)) and len(found) < 2 * len(want) < met
    monkeypatch.setattr(routes, "ROUND_TOKENS", 150)
    assert list(routes._rounds([(3, 100), (5, 60), (9, 400)])) == [(3, 3, 1, 0), (5, 5, 1, 0), (9, 9, 3, 0), (9, 9, 3, 1), (9, 9, 3, 2)]
