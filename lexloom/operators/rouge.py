"""ROUGE-1, ROUGE-2 and ROUGE-L F-measures over stemmed ASCII words, and the Porter stemmer."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_GAP = re.compile(r"[^a-z0-9]+")


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    shape = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", shape))


def _vowel(word: str, i: int) -> bool:
    c = word[i]
    return c in "aeiou" or c == "y" and i > 0 and not _vowel(word, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y; or is vowel, consonant."""
    n = len(word)
    if n == 2:
        return _vowel(word, 0) and not _vowel(word, 1)
    return n > 2 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


# Suffixes of the published stemmer with its common extensions, what replaces them,
# and the words with stems of their own.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize"
IRREGULAR = "skies:sky sky:sky dying:die lying:lie tying:tie news:news innings:inning inning:inning outings:outing outing:outing cannings:canning canning:canning howe:howe proceed:proceed exceed:exceed succeed:succeed"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_TWO, _THREE = _rules(STEP2), _rules(STEP3)
_FOUR = sorted(STEP4.split(), key=len, reverse=True)
_OWN = dict(_rules(IRREGULAR))
_KNOWN: dict[str, str] = {}


def stem(word: str) -> str:
    """Porter's stem of a lower-case word, with the common extensions."""
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        found = _KNOWN[word] = _stem(word)
    return found


def _replaced(w: str, rules: list[tuple[str, str]]) -> str:
    """The word with the longest of the suffixes replaced, if what precedes it has a measure."""
    for end, to in rules:
        if w.endswith(end):
            # "logi" is measured with its first letter
            if _measure(w[: -len(end)] + ("l" if end == "logi" else "")) == 0:
                return w
            w = w[: -len(end)] + to
            return _replaced(w, rules) if end == "alli" else w
    return w


def _stem(w: str) -> str:
    if w in _OWN:
        return _OWN[w]
    if len(w) <= 2:
        return w
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and len(w) > 2 and not _vowel(w, len(w) - 2):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _TWO), _THREE)
    for end in _FOUR:
        if w.endswith(end):
            base = w[:-3] if end in ("sion", "tion") else w[: -len(end)]
            if _measure(base) > 1:
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def words(text: str | None, stemmed: bool = True) -> list[str]:
    """Lower-case runs of ASCII letters and digits; words of more than three letters are stemmed."""
    found = [t for t in _GAP.split((text or "").lower()) if t]
    return [stem(t) if len(t) > 3 else t for t in found] if stemmed else found


def _f(hit: int, predicted: int, wanted: int) -> float:
    p, r = hit / max(1, predicted), hit / max(1, wanted)
    return 2 * p * r / (p + r) if p + r else 0.0


def ngram_f(predicted: list[str], wanted: list[str], n: int) -> float:
    a = Counter(zip(*(predicted[k:] for k in range(n))))
    b = Counter(zip(*(wanted[k:] for k in range(n))))
    return _f(sum(min(k, b[g]) for g, k in a.items() if g in b), sum(a.values()), sum(b.values()))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    code = {t: k for k, t in enumerate(dict.fromkeys(b))}
    other = np.array([code[t] for t in b])
    row = np.zeros(len(b) + 1, np.int64)
    for t in a:
        k = code.get(t, -1)
        if k < 0:
            continue
        # value with a match at j, then the running maximum takes the left neighbour in
        new = np.maximum(row[1:], (row[:-1] + 1) * (other == k))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def scores(predicted: str | None, wanted: str | None, stemmed: bool = True) -> tuple[float, float, float]:
    """ROUGE-1, ROUGE-2 and ROUGE-L F; null texts count as empty."""
    a, b = words(predicted, stemmed), words(wanted, stemmed)
    return ngram_f(a, b, 1), ngram_f(a, b, 2), _f(common_length(a, b), len(a), len(b))
