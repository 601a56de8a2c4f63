"""Consistent form of text: the confusables skeleton, and hashed character runs.

The skeleton follows the shape of the public look-alike procedure (decompose, replace every
character by its prototype, decompose again).  The prototype table is built by rule from the
Unicode character database and the public look-alike table (:mod:`prototypes`).

Two texts have equal skeletons when a reader sees the same letters, marks, digits and
punctuation: width, invisible characters, stored or combined accents and voicing marks, joined
or variant code points of one letter or ideograph, the alphabet of an identical letter and the
kind of white space do not matter.  Accents, capitals, raised digits and circled or fraction
forms are visible and stay.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

from .prototypes import letters_of_one_shape

# Characters of identical shape that the public table joins with something else or
# not at all (l, I and 1; hyphens; one Hiragana and Katakana letter), each followed by its prototype.
LOOK_ALIKE = (
    # Cyrillic, Greek, Armenian, Lisu
    "һh ԁd ԛq ӏl ІI ԚQ ЗЗ νv ΙI ϹC ϲc հh ոn ցg ꓲI "
    # Latin letters encoded twice, hyphens of one shape
    "ɡg ‐- ‑- "
    # Katakana with the shape of a Hiragana letter
    "ヘへ"
)

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
#: Compatibility decompositions that keep what a reader sees.
_SAME_LOOK = {"<wide>", "<narrow>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"}


def _prototypes() -> dict[int, str]:
    table: dict[int, str] = {}
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        if unicodedata.category(ch) == "Cc" and not ch.isspace():
            table[cp] = ""
            continue
        kind, _, parts = unicodedata.decomposition(ch).partition(" ")
        if kind in _SAME_LOOK or (kind == "<compat>" and unicodedata.category(ch)[0] == "L" and cp != 0x17F) or (
            kind == "<compat>" and (0x2E80 <= cp <= 0x2FDF or 0x2160 <= cp <= 0x217F)
        ):
            table[cp] = unicodedata.normalize("NFD", "".join(chr(int(p, 16)) for p in parts.split()))
    table.update(letters_of_one_shape())
    for pair in LOOK_ALIKE.split():
        table[ord(pair[0])] = pair[1:]
    table[0x309B], table[0x309C] = "゙", "゚"
    # a variant that leads to a letter that itself has a prototype ends at that prototype
    for _ in range(2):
        table = {cp: "".join(table.get(ord(c), c) for c in to) for cp, to in table.items()}
    return table


PROTOTYPE = _prototypes()
_CONTROL = regex.compile(r"[\x00-\x08\x0e-\x1b\x7f]+")
_TOP = 0x20000


def _direct() -> np.ndarray:
    """Prototype of each code point below ``_TOP``; 0 where it is not exactly one plain character."""
    out = np.arange(_TOP, dtype=np.uint32)
    for cp, to in PROTOTYPE.items():
        out[cp] = ord(to) if len(to) == 1 and not unicodedata.combining(to) else 0
    return out


_DIRECT = _direct()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def skeleton(text: str) -> str:
    """The consistent form of ``text``; white-space runs become one space, none at either end.

    Total for every string; the empty and the blank text give the empty string.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFD", _IGNORABLE.sub("", text))
        c = codes(text)
        if len(c) and c.max() < _TOP and (to := _DIRECT[c]).all():
            if (to != c).any():
                text = to.tobytes().decode("utf-32-le", "surrogatepass")
        else:
            text = unicodedata.normalize("NFD", text.translate(PROTOTYPE))
    if not text.isprintable():
        text = _CONTROL.sub("", text)
    return " ".join(text.split())


def _classes(top: int = 0x40000) -> np.ndarray:
    """1 letter, 2 digit, 3 mark, 0 anything else, for code points below ``top``."""
    kinds = {"L": 1, "M": 3}
    out = np.zeros(top, np.uint8)
    for cp in range(top):
        c = unicodedata.category(chr(cp))
        out[cp] = 2 if c == "Nd" else kinds.get(c[0], 0)
    return out


_CLASS: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class table, built once for each Python worker."""
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    return _CLASS


_SMALL: np.ndarray | None = None


def _lower_table() -> np.ndarray:
    """Lower case of each code point below ``_TOP`` that is one character, built once a worker."""
    global _SMALL
    if _SMALL is None:
        low = [chr(cp).lower() for cp in range(_TOP)]
        _SMALL = np.array([ord(x) if len(x) == 1 else cp for cp, x in enumerate(low)], np.uint32)
    return _SMALL


def lowered(c: np.ndarray) -> np.ndarray:
    """Code points in lower case."""
    return np.where(c < _TOP, _lower_table()[np.minimum(c, _TOP - 1)], c)


def bare(text: str) -> np.ndarray:
    """Code points of the lower-cased consistent form, letters, marks and digits only."""
    c = lowered(codes(skeleton(text)))
    table = classes()
    return c[table[np.minimum(c, len(table) - 1)] > 0]


def bare_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`bare` of every text, end to end, and the number of code points of each.

    The same result as text by text: what :func:`bare` drops (white space, controls) need not be
    brought to one form first, and texts with characters of several prototypes go one by one.
    """
    big = "\n".join("" if t is None else t.replace("\n", " ") for t in texts) + "\n"
    if not big.isascii():
        big = unicodedata.normalize("NFD", _IGNORABLE.sub("", big))
    c = codes(big)
    to = np.where(c < _TOP, _DIRECT[np.minimum(c, _TOP - 1)], c)
    owner = np.cumsum(c == 10) - (c == 10)
    odd = np.unique(owner[to == 0])
    c = lowered(to)
    table = classes()
    keep = table[np.minimum(c, len(table) - 1)] > 0
    if len(odd):
        keep &= ~np.isin(owner, odd)
    c, owner = c[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    if len(odd):
        stops = np.cumsum(sizes)
        pieces, begin = [], 0
        for k in odd.tolist():
            one = bare(texts[k])
            pieces += [c[begin : stops[k]], one]
            begin = stops[k]
            sizes[k] = len(one)
        c = np.concatenate([*pieces, c[begin:]])
    return c, sizes


#: Characters of texts that are handled at a time: their arrays stay in the cache.
BLOCK = 60_000


def blocks(texts: list[str | None]):
    """First and last place of consecutive texts of about ``BLOCK`` characters; a longer one is by itself."""
    begin = size = 0
    for k, text in enumerate(texts):
        more = len(text or "")
        if size and size + more > BLOCK:
            yield begin, k
            begin, size = k, 0
        size += more + 1
    if begin < len(texts):
        yield begin, len(texts)


def visible_count(c: np.ndarray) -> int:
    """Letters and digits (no marks) among code points made by :func:`bare`."""
    table = classes()
    return int((table[np.minimum(c, len(table) - 1)] != 3).sum())


_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial hash
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def run_hashes(c: np.ndarray, width: int = 10) -> np.ndarray:
    """64-bit hash of every run of ``width`` successive code points, by doubling."""
    if len(c) < width:
        return np.empty(0, np.uint64)
    h = c.astype(np.uint64) + np.uint64(1)
    have, rest = 1, width
    done = None
    with np.errstate(over="ignore"):
        offset = 0
        while rest:
            if rest & 1:
                n = len(c) - width + 1
                piece = h[offset : offset + n] * _power(offset)
                done = piece if done is None else done + piece
                offset += have
            rest >>= 1
            if rest:
                h = h[:-have] + h[have:] * _power(have)
                have *= 2
    return mixed(done)
