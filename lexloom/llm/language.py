"""Language of every document and of every stretch of a document in several languages.

The classifier averages hashed sub-word embeddings (character runs of 1, 3 and 4 and whole words
in the folded, lower-cased text) and feeds them to a linear softmax; both are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled documents (``SAMPLE_DOCS``), twice: the
second time without the sentences whose label the first model contradicts, because labels are
noisy.  A temperature is fitted on held-out sentences, and a confidence below which a sentence is
rejected; rejected sentences take the language of their neighbours.

Since the embedding is averaged and the softmax linear, embedding and weights fold into one table
of logits by hash bucket, which is what the executors apply (4 MB, whatever the data).

Defined results: null, empty and blank texts and texts without a letter have no stretch.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_columns
from .forms import _DIRECT, _IGNORABLE, _TOP, codes
from .sentences import spans

#: Upper bound of labelled documents the classifier is fitted on, and of sentences of each.
SAMPLE_DOCS, SAMPLE_SENTENCES = 2500, 8
BUCKETS, WIDTH, LANES, SEEN = 1 << 16, 16, 16, 15
ORDERS = (1, 3, 4)
KINDS = len(ORDERS) + 1  # and whole words
#: Sentences with a smaller share of correct answers than this stay undecided (held-out data).
ACCEPTED_ACCURACY = 0.995
SEED = 20240229
#: Characters valued at a time: what they gather (1 MB) stays in the cache.
BLOCK = 16_000
#: Price of a change of language between sentences, least log confidence of a sentence, and least
#: letters of one that can make a stretch (an ideograph or kana counts thrice).
CHANGE, FLOOR, LEAST_LETTERS = 2.5, -9.0, 32
#: A line with a smaller share of character runs that the training sample has is rejected.
LEAST_KNOWN = 0.45
#: A line with at most so many different characters has no words.
LEAST_VARIETY = 6

# Two- and three-letter codes of the languages by ISO 639-1 code, and English name.
CODES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish",
    "pt": "pt por portuguese", "it": "it ita italian", "nl": "nl nld dut dutch", "ru": "ru rus russian",
    "zh": "zh zho chi cmn chinese", "ja": "ja jpn japanese", "th": "th tha thai", "hi": "hi hin hindi",
    "ar": "ar ara arb arabic",
}
NAMED = {name: code for code, names in CODES.items() for name in names.split()}


def names_of(languages) -> dict[str, str]:
    """Name -> code of the rows ``lang, lang_title`` of a language table: codes, titles, and known three-letter codes."""
    out = {}
    for code, title in languages:
        for name in [code.lower(), *([title.strip().lower()] if title else []), *CODES.get(code.lower(), "").split()]:
            out[name] = code.lower()
    return out


def named_language(label: str | None, named: dict[str, str] = NAMED) -> str | None:
    """The code a label names, or None: a code with or without a region, or the English name."""
    if label is None:
        return None
    name = label.strip().lower()
    found = named.get(name)
    if found is None:
        head, _, region = name.replace("_", "-").partition("-")
        if region and len(head) <= 3:
            found = named.get(head)
    return found


def _lowered() -> np.ndarray:
    out = np.full(_TOP, 32, np.uint32)
    for cp in range(_TOP):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    out[10] = 10
    return out


_LOWER: np.ndarray | None = None


def folded(lines: list[str]) -> np.ndarray:
    """Code points of the lines in folded, lower-case form, each line ended by a line feed."""
    global _LOWER
    if _LOWER is None:
        _LOWER = _lowered()
    text = "\n".join(x.replace("\n", " ") for x in lines) + "\n"
    if not text.isascii():
        text = unicodedata.normalize("NFD", _IGNORABLE.sub("", text))
    c = np.minimum(codes(text), _TOP - 1)
    to = _DIRECT[c]
    return _LOWER[np.where(to == 0, c, to)]


def _scramble(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)


def hashed(c: np.ndarray) -> list[np.ndarray]:
    """Bucket at each place of the run that starts there, for each order, and of the word it is in.

    Every place has one bucket of each kind, so a word counts by its length.
    """
    padded = np.concatenate([c, np.full(max(ORDERS), 10, np.uint32)])
    n = len(c)
    out = []
    for order in ORDERS:
        h = np.full(n, 0x811C9DC5 + order, np.uint32)
        for k in range(order):
            h = (h ^ padded[k : k + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append(_scramble(h))
    blank = c <= 32
    first = np.flatnonzero(blank | np.concatenate([[True], blank[:-1]]))
    size = np.diff(np.append(first, n))
    within = np.minimum(np.arange(n) - np.repeat(first, size), len(_POWERS) - 1)
    whole = np.add.reduceat(c.astype(np.uint32) * _POWERS[within], first).astype(np.uint32)
    out.append(np.repeat(_scramble(whole), size))
    return out


_POWERS = np.array([pow(0x01000193, k + 1, 1 << 32) for k in range(64)], np.uint32)


class Model:
    """Folded logits by bucket, bias, temperature and rejection threshold."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, names: list[str], temperature: float, reject: float):
        self.table, self.bias, self.names, self.temperature, self.reject = table, bias, names, temperature, reject
        self.noise = 0.0  # share of wrong labels among the held-out sentences, as estimated

    def logits(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated logits of each line, its number of letters, and its share of known runs."""
        known = np.zeros(len(lines), np.float32)
        out = np.zeros((len(lines), len(self.names)), np.float32)
        letters = np.zeros(len(lines), np.int64)
        at = 0
        while at < len(lines):  # blocks of bounded size, so that memory stays flat
            stop, size = at, 0
            while stop < len(lines) and (size < BLOCK or stop == at):
                size += len(lines[stop]) + 1
                stop += 1
            c = folded(lines[at:stop])
            starts = np.concatenate([[0], np.flatnonzero(c == 10)[:-1] + 1])
            first, *others = hashed(c)
            sums = np.take(self.table, first, axis=0)
            for h in others:
                sums += np.take(self.table, h, axis=0)
            total = np.add.reduceat(sums, starts, axis=0)
            size = np.diff(np.append(starts, len(c)))
            out[at:stop] = total[:, : len(self.names)] / (size[:, None] * KINDS) + self.bias
            letters[at:stop] = np.add.reduceat((c > 32).astype(np.int64) + 2 * ((c >= 0x3040) & (c < 0xA000)), starts)
            known[at:stop] = total[:, SEEN] / (size * KINDS)
            at = stop
        return out / self.temperature, letters, known


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(runs: list[np.ndarray], y: np.ndarray, classes: int, rng, epochs: int, batch: int = 64, rate: float = 0.25):
    """Embedding and weights by stochastic gradient descent on (hash runs, class) examples.

    Steps are scaled by the root of the squared gradients so far, a scalar for each bucket.
    """
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.5, (WIDTH, classes)).astype(np.float32)
    b = np.zeros(classes, np.float32)
    seen_e, seen_w, seen_b = np.full(BUCKETS, 1e-12, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(classes, 1e-4, np.float32)
    # rare classes weigh as much as frequent ones
    share = np.bincount(y, minlength=classes) / max(1, len(y))
    weight = np.clip(1 / np.maximum(share * classes, 1e-6), 0.7, 2).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            size = np.array([len(runs[i]) for i in pick])
            flat = np.concatenate([runs[i] for i in pick])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            x = np.add.reduceat(emb[flat], starts, axis=0) / size[:, None]
            g = softmax(x @ w + b)
            g[np.arange(len(pick)), y[pick]] -= 1
            g *= weight[y[pick]][:, None] / len(pick)
            back = (g @ w.T / size[:, None]).astype(np.float32)
            gw, gb = x.T @ g, g.sum(axis=0)
            seen_w += gw**2
            seen_b += gb**2
            w -= step * gw / np.sqrt(seen_w)
            b -= step * gb / np.sqrt(seen_b)
            # embeddings: one summed gradient for each bucket of the batch
            sorting = np.argsort(flat, kind="stable")
            buckets = flat[sorting]
            first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
            owner = np.repeat(np.arange(len(pick)), size)[sorting]
            ge = np.add.reduceat(back[owner], first, axis=0)
            hit = buckets[first]
            seen_e[hit] += (ge**2).mean(axis=1)
            emb[hit] -= step * ge / np.sqrt(seen_e[hit])[:, None]
    return emb, w, b


def sampled(text: str, seed: int, most: int = SAMPLE_SENTENCES) -> list[str]:
    """Up to ``most`` sentences with at least eight letters, drawn from the whole text."""
    found = [s for s in (text[a:b] for a, b in spans(text)) if sum(ch.isalpha() for ch in s) >= 8]
    if len(found) <= most:
        return found
    rng = np.random.default_rng(seed)
    return [found[k] for k in np.sort(rng.choice(len(found), most, replace=False))]


def calibrated(z: np.ndarray, answer: np.ndarray) -> tuple[float, float, float]:
    """Temperature, share of wrong labels, and rejection threshold from held-out sentences with noisy labels.

    A label is right with probability 1 - noise and else any of the languages, so its likelihood is
    (1 - noise) p + noise / K; temperature and noise maximise it over all held-out sentences; of
    temperatures within a standard error of the best the one nearest 1 is taken.  The threshold is
    the least confidence above which the accuracy, corrected for the noise, is ``ACCEPTED_ACCURACY``.
    """
    k, every = z.shape[1], np.arange(len(z))
    tried = []
    for t in np.geomspace(0.2, 5, 57):  # 1 is the middle one
        own = softmax(z / t)[every, answer]
        likely = [np.log((1 - noise) * own + noise / k + 1e-12) for noise in np.linspace(0, 0.5, 51)]
        at = int(np.argmax([x.mean() for x in likely]))
        tried.append((float(likely[at].mean()), float(t), at / 100, float(likely[at].std()) / len(z) ** 0.5))
    best = max(tried)
    # wrong labels and low confidence explain much the same, so the data must speak against 1
    _, t, noise, _ = min((x for x in tried if x[0] >= best[0] - best[3]), key=lambda x: abs(np.log(x[1])))
    p = softmax(z / t)
    sure, agrees = p.max(axis=1), p.argmax(axis=1) == answer
    order = np.argsort(-sure)
    agreement = np.cumsum(agrees[order]) / np.arange(1, len(order) + 1)
    accuracy = (agreement - noise / k) / (1 - noise)
    good = np.flatnonzero(accuracy >= ACCEPTED_ACCURACY)
    return t, noise, float(min(0.9, max(0.5, sure[order][good[-1]]))) if len(good) else 0.9


def fit(texts: list[list[str]] | list[str], labels: list[str], seed: int = SEED) -> Model:
    """A calibrated model from labelled texts or their sampled sentences; ``labels`` are language codes.

    Labels may be wrong: training sentences are cleaned by models of the other half of the documents;
    calibration uses all sentences of the held-out documents, clean or not (:func:`calibrated`).
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    index = {n: k for k, n in enumerate(names)}
    lines, y, owner = [], [], []
    for k, (text, label) in enumerate(zip(texts, labels)):
        found = sampled(text, seed + k) if isinstance(text, str) else text
        lines += found
        y += [index[label]] * len(found)
        owner += [k] * len(found)
    y, owner = np.array(y, np.int64), np.array(owner, np.int64)
    c = folded(lines)
    stops = np.flatnonzero(c == 10) + 1
    by_order = hashed(c)
    runs = [np.concatenate([h[a:b] for h in by_order]) for a, b in zip(np.concatenate([[0], stops[:-1]]), stops)]
    part = rng.integers(0, 20, len(texts))[owner]
    held, left = part < 3, part % 2 == 0

    def train(keep: np.ndarray, epochs: int) -> Model:
        chosen = np.flatnonzero(keep)
        emb, w, b = _descend([runs[i] for i in chosen], y[chosen], len(names), rng, epochs)
        table = np.zeros((BUCKETS, LANES), np.float32)
        table[:, : len(names)] = emb @ w
        for i in chosen:
            table[runs[i], SEEN] = 1
        return Model(table, b, names, 1.0, 0.0)

    # each half is judged by a model of the other half, so that no label speaks for itself
    clean = np.zeros(len(y), bool)
    for half in (left, ~left):
        if half.any() and (~half).any():
            z = train(~half, 2).logits([lines[i] for i in np.flatnonzero(half)])[0]
            clean[half] = z.argmax(axis=1) == y[half]
    if not held.any() or not (~held & clean).any():
        return train(np.ones(len(y), bool), 3)
    model = train(~held & clean, 3)
    z = model.logits([lines[i] for i in np.flatnonzero(held)])[0]
    model.temperature, model.noise, model.reject = calibrated(z, y[held])
    return model


def train(df: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id", most: int = SAMPLE_DOCS, named: dict[str, str] = NAMED) -> Model:
    """Fit on at most about ``most`` labelled documents, drawn by a hash of their id.

    Only the sample's sentences (``SAMPLE_SENTENCES`` of each document, from the whole text) reach
    the driver; their number is bounded whatever the table's size.
    """
    head = F.split(F.lower(F.trim(F.col(label_column))), "[-_]")[0]
    labelled = df.where(head.isin(sorted(named)) & F.col(text_column).isNotNull())
    there = labelled.select(label_column).count()
    share = min(1.0, most / max(1, there))
    picked = labelled.where(F.pmod(F.xxhash64(id_column), F.lit(1_000_000)) < int(share * 1_000_000))

    def make(columns):
        return {"l": columns["l"], "s": [sampled(t, SEED) for t in columns["t"].to_pylist()]}

    rows = map_columns(picked.select(F.col(text_column).alias("t"), F.col(label_column).alias("l")), "l string, s array<string>", make).limit(2 * most).collect()
    pairs = [(r.s, code) for r in rows if (code := named_language(r.l, named))]
    if not pairs:
        raise ValueError("no document carries a label that names a known language")
    return fit([s for s, _ in pairs], [c for _, c in pairs])


def stretches(model: Model, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
    """For each text its stretches in order: language, start, end, confidence."""
    lines, cuts, counts = [], [], []
    for text in texts:
        found = pieces(text)
        counts.append(len(found))
        cuts += found
        lines += [text[a:b] for a, b in found]
    z, letters, known = model.logits(lines)
    # a run of one or two characters is no word of any language
    letters *= np.array([len(set(line)) > LEAST_VARIETY for line in lines], bool) if lines else 1
    p = softmax(z) if len(lines) else z
    told = (p.max(axis=1) >= model.reject) & (letters >= LEAST_LETTERS) & (known >= LEAST_KNOWN) if len(lines) else letters > 0
    out, at = [], 0
    for n in counts:
        out.append(_join(model, z[at : at + n], p[at : at + n], letters[at : at + n], known[at : at + n], told[at : at + n], cuts[at : at + n]))
        at += n
    return out


def pieces(text: str | None) -> list[tuple[int, int]]:
    """Sentences, cut once more where Thai, which has no end mark, meets a long run of another script."""
    found = spans(text)
    if not text or text.isascii() or not _THAI.search(text):
        return found
    out = []
    for a, b in found:
        begin = a
        for m in _THAI_EDGE.finditer(text, a, b):
            out.append((begin, m.start()))
            begin = m.end()
        out.append((begin, b))
    return out


_THAI = regex.compile(r"\p{Thai}")
_THAI_EDGE = regex.compile(r"(?<=\p{Thai})\s+(?=[^\p{Thai}]{25})|(?<=[^\p{Thai}]{25})\s+(?=\p{Thai}{4})")


def _join(model: Model, z, p, letters, known, told, cuts) -> list[tuple[str, int, int, float]]:
    """The best sequence of languages: log confidence of each sentence less a price for each change.

    Rejected sentences and those with too few letters to tell weigh nothing, so they follow their
    neighbours.
    """
    if not len(z) or letters.sum() == 0:
        return []
    if not told.any():
        if (known * letters).sum() < LEAST_KNOWN * letters.sum():
            return []  # letters that form no words of any language
        gain = np.tile((z * letters[:, None]).sum(axis=0) / letters.sum(), (len(z), 1))
    else:
        firm = p[told].argmax(axis=1)
        if (firm == firm[0]).all():  # nothing speaks for a change
            weight = np.maximum(letters, 1)
            return [(model.names[firm[0]], cuts[0][0], cuts[-1][1], float((p[:, firm[0]] * weight).sum() / weight.sum()))]
        gain = np.maximum(np.log(np.maximum(p, 1e-9)), FLOOR)
        gain[~told] = 0
    score, back = gain[0], []
    for row in gain[1:]:
        top = int(score.argmax())
        stay = score >= score[top] - CHANGE
        back.append(np.where(stay, np.arange(len(score)), top))
        score = np.where(stay, score, score[top] - CHANGE) + row
    best = [int(score.argmax())]
    for step in reversed(back):
        best.append(int(step[best[-1]]))
    best.reverse()
    out = []
    begin = 0
    for k in range(1, len(best) + 1):
        if k == len(best) or best[k] != best[begin]:
            weight = np.maximum(letters[begin:k], 1)
            confidence = float((p[begin:k, best[begin]] * weight).sum() / weight.sum())
            out.append((model.names[best[begin]], cuts[begin][0], cuts[k - 1][1], confidence))
            begin = k
    return out


def languages(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", named: dict[str, str] = NAMED) -> DataFrame:
    """One row per stretch: ``seg_no, lang, start_char, end_char, confidence, is_case``.

    ``is_case`` holds for documents with more than one stretch and for those whose label does not
    name their language.  Narrow: the model is broadcast (its size is fixed), nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(columns):
        out = {k: [] for k in (id_column, "seg_no", "lang", "start_char", "end_char", "confidence", "is_case")}
        keys, labels = columns["key"].to_pylist(), columns["label"].to_pylist()
        for key, label, found in zip(keys, labels, stretches(shared.value, columns["text"].to_pylist())):
            case = len(found) > 1 or len(found) == 1 and named_language(label, named) != found[0][0]
            for k, (lang, a, b, sure) in enumerate(found):
                for name, value in zip(out, (key, k, lang, a, b, sure, case)):
                    out[name].append(value)
        return out

    chosen = df.selectExpr(f"`{id_column}` AS key", f"`{text_column}` AS text", f"`{label_column}` AS label").where("text IS NOT NULL")
    schema = f"`{id_column}` bigint, seg_no int, lang string, start_char int, end_char int, confidence double, is_case boolean"
    return map_columns(chosen, schema, make)
