"""A varied subset of sentences: cluster-feature tree, Ward linkage, nearest record to each centre.

Sentences become unit vectors of hashed character runs and words.  For requests over a whole scope

1. every task condenses its sentences into a cluster-feature tree (entries of count, linear sum and
   squared sum; two levels, absorbing within a radius that grows when there are too many entries),
2. the entries of ``MERGE`` tasks at a time are merged into one tree, until few summaries are left,
3. Ward linkage agglomerates the leaf entries, and the tree of merges is cut at k groups,
4. a second pass finds the sentences nearest each centre; the nearest one with a text that no other
   centre has taken is returned,
5. a request that is still short takes, in one more pass over its scope, the different texts least
   alike to the chosen ones.

For requests within each record every sentence is a leaf entry of its own (condensed first if the
record is very long), and the record's own merges are cut at k.

Defined results: null and wordless sentences and null lists give nothing; equal texts count once;
a scope with at most k different sentences gives all of them; a request with a null or
non-positive count, or an unknown scope, gives nothing; equal records count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled
from .language import folded, hashed
from .overlap import split_of

DIM = 64
LEAVES, FAN = 512, 32
MERGED_LEAVES = 2048
MERGE = 16
RUNNERS_UP = 4


def vectors(lines: list[str]) -> np.ndarray:
    """Unit vector of each line (all zero for a line without letters)."""
    out = np.zeros((len(lines), DIM), np.float32)
    at = 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and (size < 100_000 or stop == at):
            size += len(lines[stop]) + 1
            stop += 1
        c = folded(lines[at:stop])
        owner = np.cumsum(c == 10) - (c == 10)
        letters = c > 32
        total = np.zeros((stop - at) * DIM)
        for h in hashed(c)[1:]:
            h = h[letters]
            sign = np.where(h & 0x8000, 1.0, -1.0)
            total += np.bincount(owner[letters] * DIM + (h & (DIM - 1)), sign, minlength=len(total))
        out[at:stop] = total.reshape(-1, DIM)
        at = stop
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


class CFTree:
    """Cluster-feature tree of two levels: nodes of leaf entries, entries of (n, sum, squares)."""

    def __init__(self, most: int, radius: float = 0.05):
        self.most, self.radius = most, radius
        self.n = np.zeros(0)
        self.sums = np.zeros((0, DIM))
        self.squares = np.zeros(0)

    def add(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        """Insert entries; points are entries of n = 1."""
        for at in range(0, len(n), 4096):
            self._insert(n[at : at + 4096], sums[at : at + 4096], squares[at : at + 4096])
            while len(self.n) > self.most:
                self._condense()

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest leaf entry of each point, descending from the nearest node, and its squared distance."""
        centres = self.sums / self.n[:, None]
        nodes = max(1, len(centres) // FAN)
        roots = centres[np.linspace(0, len(centres) - 1, nodes).astype(int)]
        home = (-2 * centres @ roots.T + (roots**2).sum(axis=1)).argmin(axis=1)
        roots = np.stack([centres[home == k].mean(axis=0) if (home == k).any() else roots[k] for k in range(nodes)])
        went = (-2 * points @ roots.T + (roots**2).sum(axis=1)).argmin(axis=1)
        best, far = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
        for k in np.unique(went):
            own = np.flatnonzero(home == k)
            if not len(own):
                own = np.arange(len(centres))
            mine = np.flatnonzero(went == k)
            d = (points[mine] ** 2).sum(axis=1)[:, None] - 2 * points[mine] @ centres[own].T + (centres[own] ** 2).sum(axis=1)
            best[mine], far[mine] = own[d.argmin(axis=1)], d.min(axis=1)
        return best, far

    def _insert(self, n, sums, squares) -> None:
        if len(self.n):
            best, far = self._nearest(sums / n[:, None])
            near = far <= self.radius
            np.add.at(self.n, best[near], n[near])
            np.add.at(self.sums, best[near], sums[near])
            np.add.at(self.squares, best[near], squares[near])
            n, sums, squares = n[~near], sums[~near], squares[~near]
        # new entries: equal points open one entry together
        if len(n):
            _, first, back = np.unique(np.round(sums / n[:, None], 6), axis=0, return_index=True, return_inverse=True)
            back = back.ravel()
            fresh = [np.zeros(len(first)), np.zeros((len(first), DIM)), np.zeros(len(first))]
            for store, value in zip(fresh, (n, sums, squares)):
                np.add.at(store, back, value)
            self.n, self.sums, self.squares = (np.concatenate([a, b]) for a, b in zip((self.n, self.sums, self.squares), fresh))

    def _condense(self) -> None:
        """Raise the radius and insert the entries into an empty tree again, largest first."""
        centres = self.sums / self.n[:, None]
        take = np.linspace(0, len(centres) - 1, min(len(centres), 256)).astype(int)
        d = (centres[take] ** 2).sum(axis=1)[:, None] - 2 * centres[take] @ centres.T + (centres**2).sum(axis=1)
        d[np.arange(len(take)), take] = np.inf
        self.radius = max(self.radius * 1.3, float(np.quantile(d.min(axis=1), 0.4)))
        order = np.argsort(-self.n, kind="stable")
        old = self.n[order], self.sums[order], self.squares[order]
        self.n, self.sums, self.squares = np.zeros(0), np.zeros((0, DIM)), np.zeros(0)
        # entries of one step don't absorb each other, so a step is small against the limit
        step = max(1, min(256, self.most // 4))
        for at in range(0, len(order), step):
            self._insert(*(x[at : at + step] for x in old))


def ward(n: np.ndarray, centres: np.ndarray) -> list[tuple[int, int]]:
    """Merges of Ward linkage in order of growing cost; entry numbers stand for their groups."""
    m = len(n)
    n, c = n.astype(float).copy(), centres.astype(float).copy()
    square = (c**2).sum(axis=1)
    d = np.maximum(square[:, None] - 2 * c @ c.T + square, 0)
    d *= n[:, None] * n / (n[:, None] + n)
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(m, bool), [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain.pop(), chain.pop()
        merges.append((float(d[a, b]), a, b))
        total = n + n[a] + n[b]
        new = ((n + n[a]) * d[a] + (n + n[b]) * d[b] - n * d[a, b]) / total
        n[a] += n[b]
        alive[b] = False
        new[~alive] = np.inf
        new[a] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
    merges.sort(key=lambda x: x[0])
    return [(a, b) for _, a, b in merges]


def groups_at(m: int, merges: list[tuple[int, int]], k: int) -> np.ndarray:
    """Group number of each entry when the merges are cut at ``k`` groups."""
    parent = np.arange(m)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in merges[: max(0, m - k)]:
        parent[root(b)] = root(a)
    return np.unique([root(x) for x in range(m)], return_inverse=True)[1].ravel()


def _centres(n: np.ndarray, sums: np.ndarray, group: np.ndarray) -> np.ndarray:
    total, weight = np.zeros((group.max() + 1, DIM)), np.zeros(group.max() + 1)
    np.add.at(total, group, sums)
    np.add.at(weight, group, n)
    return total / weight[:, None]


def pick_in_record(v: np.ndarray, counts: list[int]) -> list[list[int]]:
    """For each count the rows of ``v`` nearest the centres of that many Ward groups, in order."""
    m = len(v)
    merges = None
    out = []
    for k in counts:
        if m <= k:
            out.append(list(range(m)))
            continue
        if merges is None:
            if m > LEAVES:
                tree = CFTree(LEAVES)
                tree.add(np.ones(m), v.astype(float), (v**2).sum(axis=1))
                n, sums = tree.n, tree.sums
            else:
                n, sums = np.ones(m), v.astype(float)
            merges = ward(n, sums / n[:, None])
        group = groups_at(len(n), merges, k)
        d = -2 * v @ _centres(n, sums, group).T + (_centres(n, sums, group) ** 2).sum(axis=1)
        chosen: list[int] = []
        for g in range(d.shape[1]):
            column = d[:, g].copy()
            column[chosen] = np.inf
            chosen.append(int(column.argmin()))
        spare = [i for i in range(m) if i not in set(chosen)]
        out.append(sorted(chosen + spare[: k - len(chosen)]))
    return out


def _different(sentences: list[str | None] | None) -> tuple[list[int], list[str]]:
    """Places and texts of the sentences with words, each text once."""
    seen, places, texts = set(), [], []
    for k, s in enumerate(sentences or ()):
        if s is not None and any(ch.isalnum() for ch in s):
            plain = " ".join(s.split())
            if plain not in seen:
                seen.add(plain)
                places.append(k)
                texts.append(plain)
    return places, texts


def records(processed: DataFrame, articles: DataFrame, predictions: DataFrame, requests: DataFrame) -> DataFrame:
    """``rec, id, sentences, asked, votes, voters``: each record with the requests that ask for it.

    ``votes`` has how many predictions of the id selected each sentence; indices out of range
    don't count, repeated ones count once a prediction, and a selection that a run wrote twice
    counts once.  Records are told apart by two hashes, so that none is dropped by chance.
    """
    marked = processed.select("id", "sentences", F.xxhash64("id", "sentences").alias("rec"), F.hash("sentences", "id").alias("rec2")).where("sentences IS NOT NULL")
    base = marked.dropDuplicates(["rec", "rec2"]).drop("rec2")
    predictions = predictions.select("run_id", "id", "selected_indices").where("id IS NOT NULL AND selected_indices IS NOT NULL").distinct()
    kinds = requests.select("request_id", "scope_kind", "scope_name")
    own = articles.select("id", split_of(F.col("split_name")).alias("split"), "source").where("id IS NOT NULL").distinct()
    # one equi-join for each kind of scope; the requests are a stated table that does not grow
    of = lambda kind: own.join(kinds.where(F.col("scope_kind") == kind).select("request_id", F.col("scope_name").alias(kind)), kind).select("id", "request_id")
    scoped = of("split").unionByName(of("source")).groupBy("id").agg(F.collect_set("request_id").alias("named"))
    sizes = base.groupBy("id").agg(F.max(F.size("sentences")).alias("n"))
    marks = predictions.select("id", F.explode(F.array_distinct("selected_indices")).alias("k")).where("k >= 0").groupBy("id", "k").agg(F.count(F.lit(1)).alias("c"))
    votes = marks.join(sizes, "id").where("k < n").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("votes"))
    voters = predictions.groupBy("id").agg(F.count(F.lit(1)).alias("voters"))
    everyone = [r[0] for r in kinds.where("scope_kind = 'all'").collect()]
    asked = F.concat(F.array(*map(F.lit, everyone)).cast("array<int>"), F.coalesce("named", F.expr("CAST(array() AS array<int>)")))
    joined = base.join(scoped, "id", "left").join(votes, "id", "left").join(voters, "id", "left")
    return settled(joined.select("rec", "id", "sentences", asked.alias("asked"), "votes", F.coalesce("voters", F.lit(0)).alias("voters")))


_PICK = "request_id int, rec bigint, id string, pos int, sentence string, selected_by double"


def _rows(schema, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _chunks(batches, records: int = 256):
    """The rows of the batches, a few records at a time, so that memory stays flat."""
    for batch in batches:
        for at in range(0, batch.num_rows, records):
            yield batch.slice(at, records).to_pylist()


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _share(votes, voters, k):
    return None if not voters else dict(votes or ()).get(k, 0) / voters


def within_records(base: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """Picks of every record for the requests (id, count) that ask within each record."""
    schema = _arrow(_PICK)

    def run(batches):
        for rows in _chunks(batches):
            found = [_different(r["sentences"]) for r in rows]
            v = vectors([s for _, texts in found for s in texts])
            out, at = [], 0
            for r, (places, texts) in zip(rows, found):
                own = v[at : at + len(texts)]
                at += len(texts)
                for (request, _), picked in zip(wanted, pick_in_record(own, [k for _, k in wanted])):
                    for i in picked:
                        k = places[i]
                        out.append((request, r["rec"], r["id"], k, r["sentences"][k], _share(r["votes"], r["voters"], k)))
            yield _rows(schema, out)

    return base.select("rec", "id", "sentences", "votes", "voters").mapInArrow(run, _PICK)


_ENTRY = "request_id int, part int, n double, sums array<double>, squares double"


def _summaries(base: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """Leaf entries of one cluster-feature tree for each task and scope."""
    schema = _arrow(_ENTRY)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        trees: dict[int, CFTree] = {}
        for rows in _chunks(batches):
            found = [_different(r["sentences"])[1] for r in rows]
            v = vectors([s for texts in found for s in texts]).astype(float)
            owner = np.repeat(np.arange(len(rows)), [len(t) for t in found])
            for request in sorted({q for r in rows for q in r["asked"]}):
                member = np.array([request in r["asked"] for r in rows], bool)
                own = v[member[owner]] if len(owner) else v
                trees.setdefault(request, CFTree(max(LEAVES, wanted.get(request, 0)))).add(np.ones(len(own)), own, (own**2).sum(axis=1))
        for request, tree in trees.items():
            yield _rows(schema, [(request, part, *x) for x in zip(tree.n.tolist(), tree.sums.tolist(), tree.squares.tolist())])

    return base.select("sentences", "asked").mapInArrow(run, _ENTRY)


def _entries(table: pa.Table, most: int) -> CFTree:
    tree = CFTree(most)
    n = table.column("n").to_numpy()
    sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    order = np.lexsort((sums[:, 0], -n))
    tree.add(n[order], sums[order], table.column("squares").to_numpy()[order])
    return tree


def centres(base: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """``request_id, centre, at``: the centres of the requested number of groups of each scope."""
    parts = base.rdd.getNumPartitions()
    entries = _summaries(base, wanted)
    schema = _arrow(_ENTRY)

    def merge(table: pa.Table) -> pa.Table:
        request, part = table.column("request_id")[0].as_py(), table.column("part")[0].as_py()
        tree = _entries(table, max(MERGED_LEAVES, wanted.get(request, 0)))
        rows = [(request, part, *x) for x in zip(tree.n.tolist(), tree.sums.tolist(), tree.squares.tolist())]
        return pa.Table.from_batches([_rows(schema, rows)])

    while parts > MERGE:
        entries = entries.withColumn("part", F.floor(F.col("part") / MERGE).cast("int")).groupBy("request_id", "part").applyInArrow(merge, _ENTRY)
        parts = -(-parts // MERGE)
    final = _arrow("request_id int, centre int, at array<double>")

    def cut(table: pa.Table) -> pa.Table:
        request = table.column("request_id")[0].as_py()
        tree = _entries(table, max(MERGED_LEAVES, wanted[request]))
        k = min(wanted[request], len(tree.n))
        at = tree.sums / tree.n[:, None]
        group = groups_at(len(tree.n), ward(tree.n, at), k)
        rows = [(request, g, c) for g, c in enumerate(_centres(tree.n, tree.sums, group).tolist())]
        return pa.Table.from_batches([_rows(final, rows)])

    return entries.groupBy("request_id").applyInArrow(cut, "request_id int, centre int, at array<double>")


def across_records(base: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """Picks of whole scopes: the sentence nearest each centre whose text no other centre took."""
    found = centres(base, wanted).orderBy("request_id", "centre").collect()  # at most the sum of the requested counts
    by = {q: np.array([r.at for r in found if r.request_id == q], np.float32) for q in {r.request_id for r in found}}
    shared = base.sparkSession.sparkContext.broadcast(by)
    ddl = "request_id int, centre int, far double, text bigint, rec bigint, id string, pos int, sentence string, selected_by double"
    schema = _arrow(ddl)

    def run(batches):
        best: dict[tuple[int, int], list] = {}
        for rows in _chunks(batches):
            flat = [(r, k, t) for r in rows for k, t in zip(*_different(r["sentences"]))]
            v = vectors([t for _, _, t in flat])
            names = np.array([_name(t) for _, _, t in flat], np.int64)
            for q, at in shared.value.items():
                own = np.array([i for i, (r, _, _) in enumerate(flat) if q in r["asked"]], np.int64)
                if not len(own):
                    continue
                own = own[_first_places(names[own], [flat[i] for i in own])]
                d = 1 - 2 * v[own] @ at.T + (at**2).sum(axis=1)
                few = min(len(own), 4 * RUNNERS_UP)
                for g in range(len(at)):
                    column = d[:, g]
                    for i in np.argpartition(column, few - 1)[:few]:
                        r, k, t = flat[own[i]]
                        best.setdefault((q, g), []).append((round(float(column[i]), 9), int(names[own[i]]), r["rec"], r["id"], k, r["sentences"][k], _share(r["votes"], r["voters"], k)))
                    best[q, g] = _front(best[q, g])
        yield _rows(schema, [(q, g, *x) for (q, g), held in best.items() for x in held])

    near = base.select("rec", "id", "sentences", "asked", "votes", "voters").mapInArrow(run, ddl)
    picked_schema = _arrow(_PICK)

    def choose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["far"], r["centre"], r["text"], r["rec"], r["pos"]))
        k = wanted[rows[0]["request_id"]]
        done, taken, out = set(), set(), []
        for whole in (True, False):  # first one for each centre, then the nearest of what is left
            for r in rows:
                if len(out) < k and r["text"] not in taken and not (whole and r["centre"] in done):
                    done.add(r["centre"])
                    taken.add(r["text"])
                    out.append(tuple(r[f.name] for f in picked_schema))
        return pa.Table.from_batches([_rows(picked_schema, out)])

    from pyspark.sql import Window

    # the few nearest of each centre over all tasks; then one request's candidates are few
    best = near.groupBy("request_id", "centre", "text").agg(F.min(F.struct("far", "rec", "pos", "id", "sentence", "selected_by")).alias("best"))
    order = Window.partitionBy("request_id", "centre").orderBy("far", "text", "rec", "pos")
    few = best.select("request_id", "centre", "text", "best.*").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 8 * RUNNERS_UP).drop("nth")
    picked = settled(few.groupBy("request_id").applyInArrow(choose, _PICK))
    chosen: dict[int, list[str]] = {}  # at most the sum of the requested counts
    for r in picked.select("request_id", "sentence").collect():
        chosen.setdefault(r.request_id, []).append(" ".join(r.sentence.split()))
    missing = {q: wanted[q] - len(texts) for q, texts in chosen.items() if len(texts) < wanted[q]}
    return picked.unionByName(_rest(base, chosen, missing)) if missing else picked


def _name(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _first_places(names: np.ndarray, flat: list) -> np.ndarray:
    """The first place, by record and position, of each different text."""
    order = np.lexsort(([k for _, k, _ in flat], [r["rec"] for r, _, _ in flat], names))
    ordered = names[order]
    return order[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def _rest(base: DataFrame, chosen: dict[int, list[str]], missing: dict[int, int]) -> DataFrame:
    """The ``missing`` different texts of each scope least alike to its chosen ones, none of them chosen."""
    held = {q: (vectors(chosen[q]), {_name(t) for t in chosen[q]}) for q in missing}
    shared = base.sparkSession.sparkContext.broadcast(held)
    ddl = "request_id int, near double, text bigint, rec bigint, pos int, id string, sentence string, selected_by double"
    schema = _arrow(ddl)

    def run(batches):
        best: dict[int, dict[int, tuple]] = {q: {} for q in missing}
        for rows in _chunks(batches):
            flat = [(r, k, t) for r in rows for k, t in zip(*_different(r["sentences"]))]
            names = [_name(t) for _, _, t in flat]
            v = vectors([t for _, _, t in flat])
            for q, (at, taken) in shared.value.items():
                own = [i for i, (r, _, _) in enumerate(flat) if q in r["asked"] and names[i] not in taken]
                if not own:
                    continue
                found = best[q]
                for i, near in zip(own, (v[own] @ at.T).max(axis=1).round(4).tolist()):
                    r, k, _ = flat[i]
                    old = found.get(names[i])
                    if old is None or (r["rec"], k) < old[2:4]:
                        found[names[i]] = (near if old is None else old[0], names[i], r["rec"], k, r["id"], r["sentences"][k], _share(r["votes"], r["voters"], k))
                if len(found) > 2 * missing[q] + 4096:
                    best[q] = {x[1]: x for x in sorted(found.values(), key=lambda x: x[:2])[: missing[q]]}
        yield _rows(schema, [(q, *x) for q, found in best.items() for x in sorted(found.values(), key=lambda x: x[:2])[: missing[q]]])

    from pyspark.sql import Window

    each = base.select("rec", "id", "sentences", "asked", "votes", "voters").mapInArrow(run, ddl)
    best = each.groupBy("request_id", "text").agg(F.min(F.struct("rec", "pos", "near", "id", "sentence", "selected_by")).alias("best")).select("request_id", "text", "best.*")
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("near", "text"))
    left = F.coalesce(*(F.when(F.col("request_id") == q, F.lit(n)) for q, n in missing.items()))
    return best.withColumn("nth", nth).where(F.col("nth") <= left).select("request_id", "rec", "id", "pos", "sentence", "selected_by")


def _front(held: list) -> list:
    """The nearest few with different texts."""
    seen, out = set(), []
    for x in sorted(held, key=lambda x: (x[0], x[1], x[2], x[4])):
        if x[1] not in seen:
            seen.add(x[1])
            out.append(x)
            if len(out) == RUNNERS_UP:
                break
    return out


def subsets(base: DataFrame, requests: DataFrame) -> DataFrame:
    """The chosen sentences of every request: ``request_id, rec, id, pos, sentence, selected_by``.

    ``selected_by`` is the share of the predictions for the record that selected the sentence too.
    """
    asked = [(r.request_id, r.scope_kind, r.pick_count) for r in requests.select("request_id", "scope_kind", "pick_count").collect() if r.pick_count and r.pick_count > 0]
    inside = sorted((q, k) for q, kind, k in asked if kind == "each_record")
    whole = {q: k for q, kind, k in asked if kind in ("all", "split", "source")}
    return within_records(base, inside).unionByName(across_records(base, whole))


def comparison(picked: DataFrame, base: DataFrame) -> DataFrame:
    """Per request: picks, how many predictions agree, coverage and redundancy of both selections.

    Coverage is the mean, over a record's sentences, of the similarity to the nearest selected
    sentence of the record; redundancy the mean similarity of two selected ones.  Both are taken
    over the records with picks and with at least one usable predicted index.
    """
    ours = picked.groupBy("request_id", "rec").agg(F.collect_list("pos").alias("picked"), F.count("selected_by").alias("known"), F.sum("selected_by").alias("agree"))
    both = ours.join(base.select("rec", "sentences", "votes"), "rec")
    ddl = "request_id int, picks int, known bigint, agree double, cover double, cover_predicted double, repeat double, repeat_predicted double"
    schema = _arrow(ddl)

    def measures(v, chosen):
        s = v @ v[chosen].T
        m = len(chosen)
        pairs = (s[chosen].sum() - m) / (m * (m - 1)) if m > 1 else 0.0
        return float(s.max(axis=1).mean()), float(pairs)

    def run(batches):
        for rows in _chunks(batches):
            v = vectors([s or "" for r in rows for s in r["sentences"]])
            out, at = [], 0
            for r in rows:
                own = v[at : at + len(r["sentences"])]
                at += len(r["sentences"])
                theirs = sorted(k for k, _ in r["votes"] or () if k < len(own))
                values = (None,) * 4
                if theirs:
                    (a, b), (c, d) = measures(own, sorted(r["picked"])), measures(own, theirs)
                    values = (a, c, b, d)
                out.append((r["request_id"], len(r["picked"]), r["known"], r["agree"], *values))
            yield _rows(schema, out)

    each = both.mapInArrow(run, ddl)
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return each.groupBy("request_id").agg(
        F.sum("picks").alias("picks"), F.count(F.lit(1)).alias("records"), F.round(F.sum("agree") / F.sum("known"), 4).alias("selected_by"),
        mean("cover"), mean("cover_predicted"), mean("repeat"), mean("repeat_predicted"),
    )


def scope_comparison(picked: DataFrame, base: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """Per request over a whole scope: how well the picks and the predictions cover it.

    The other selection has as many sentences: those of the scope that most predictions selected.
    ``cover`` is the mean, over all different sentences of each record of the scope, of the
    similarity to the nearest selected one; ``repeat`` the mean similarity of two selected ones.
    Both selections are bounded by the requested counts, and only they reach the driver.
    """
    from pyspark.sql import Window

    ours = [(r.request_id, r.sentence) for r in picked.where(F.col("request_id").isin(list(wanted))).select("request_id", "sentence").collect()]
    votes = base.where("votes IS NOT NULL").select(F.explode("asked").alias("request_id"), "rec", "sentences", F.explode("votes").alias("k", "c"))
    most = Window.partitionBy("request_id").orderBy(F.desc("c"), "rec", "k")
    top = votes.withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= max([1, *wanted.values()]))
    theirs = [(r.request_id, r.sentence) for r in top.select("request_id", "nth", F.get("sentences", F.col("k")).alias("sentence")).collect() if r.nth <= wanted.get(r.request_id, 0)]
    sets = {}
    for name, rows in (("ours", ours), ("theirs", theirs)):
        for q in wanted:
            texts = [t or "" for r, t in rows if r == q]
            if texts:
                sets[name, q] = vectors(texts)
    shared = base.sparkSession.sparkContext.broadcast(sets)
    ddl = "request_id int, n bigint, ours double, theirs double"
    schema = _arrow(ddl)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for rows in _chunks(batches):
            found = [_different(r["sentences"])[1] for r in rows]
            v = vectors([t for texts in found for t in texts])
            owner = np.repeat(np.arange(len(rows)), [len(t) for t in found])
            for q in sorted({q for r in rows for q in r["asked"]}):
                own = v[np.array([q in r["asked"] for r in rows], bool)[owner]] if len(owner) else v
                if len(own):
                    near = [(own @ shared.value[k, q].T).max(axis=1).sum() if (k, q) in shared.value else 0.0 for k in ("ours", "theirs")]
                    total[q] = total.get(q, np.zeros(3)) + [len(own), *near]
        yield _rows(schema, [(q, int(t[0]), float(t[1]), float(t[2])) for q, t in total.items()])

    sums = base.select("sentences", "asked").mapInArrow(run, ddl).groupBy("request_id").agg(F.sum("n").alias("n"), F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"))

    def repeat(name, q):
        x = sets.get((name, q))
        m = 0 if x is None else len(x)
        return float(((x @ x.T).sum() - (x * x).sum()) / (m * (m - 1))) if m > 1 else 0.0

    known = base.sparkSession.createDataFrame(
        [(q, len(sets.get(("ours", q), ())), round(repeat("ours", q), 4), round(repeat("theirs", q), 4)) for q in wanted] or [(None, 0, 0.0, 0.0)],
        "request_id int, picks int, repeat double, repeat_predicted double",
    ).where("request_id IS NOT NULL")
    return sums.join(known, "request_id").select(
        "request_id", "picks", F.col("n").alias("sentences"), F.round(F.col("ours") / F.col("n"), 4).alias("cover"),
        F.round(F.col("theirs") / F.col("n"), 4).alias("cover_predicted"), "repeat", "repeat_predicted",
    )


def whole_scopes(requests: DataFrame) -> dict[int, int]:
    """Requested counts of the requests over whole scopes."""
    rows = requests.where("scope_kind IN ('all', 'split', 'source') AND pick_count > 0").select("request_id", "pick_count").collect()
    return {r.request_id: r.pick_count for r in rows}
