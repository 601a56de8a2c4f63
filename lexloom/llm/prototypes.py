"""The public look-alike table, read from the Unicode library that comes with Spark.

Its binary form is big-endian: a header with its size in the first two bytes, then offsets and
sizes of sorted keys (code point and, in the top byte, the length of the prototype less one),
values (the prototype itself or its place among the strings), and strings in UTF-16.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from functools import lru_cache

import regex

#: Names a folder with the library's archive, where it is not among Spark's own.
FOLDER = "LEXLOOM_CONFUSABLES"
_MEMBER = "com/ibm/icu/impl/data/icudata/confusables.cfu"
#: Small letters that are their capitals drawn smaller.
_SCALED = frozenset("cosuvwxz")
_ALPHABETS = ("Latin", "Greek", "Cyrillic")
_ALPHABET = [regex.compile(rf"\p{{Script={name}}}") for name in _ALPHABETS]


def _archive() -> str:
    import pyspark

    folders = [os.environ.get(FOLDER, ""), os.path.join(os.environ.get("SPARK_HOME", ""), "jars"), os.path.join(os.path.dirname(pyspark.__file__), "jars")]
    for folder in folders:
        found = sorted(glob.glob(os.path.join(folder, "icu4j-*.jar"))) if folder else []
        if found:
            return found[-1]
    raise FileNotFoundError(f"no icu4j archive among Spark's; name its folder in {FOLDER}")


@lru_cache(maxsize=1)
def public_table() -> dict[int, str]:
    """Every code point with a prototype other than itself."""
    with zipfile.ZipFile(_archive()) as z:
        whole = z.read(_MEMBER)
    data = whole[struct.unpack(">H", whole[:2])[0] :]
    magic, _, _, keys_at, keys, values_at, values, strings_at, strings = struct.unpack(">9i", data[:36])
    if magic != 0x3845FDEF or keys != values:
        raise ValueError("not the known form of the look-alike table")
    key = struct.unpack(f">{keys}I", data[keys_at : keys_at + 4 * keys])
    value = struct.unpack(f">{values}H", data[values_at : values_at + 2 * values])
    text = data[strings_at : strings_at + 2 * strings]
    out = {}
    for k, v in zip(key, value):
        n = (k >> 24) + 1
        out[k & 0xFFFFFF] = chr(v) if n == 1 else text[2 * v : 2 * (v + n)].decode("utf-16-be")
    return out


def _alphabet(ch: str) -> int:
    return next((k for k, p in enumerate(_ALPHABET) if p.match(ch)), -1)


def letters_of_one_shape() -> dict[int, str]:
    """Letters of another alphabet, or small capitals, with the shape of a Latin, Greek or Cyrillic letter.

    The public table also joins what is merely alike at a glance, and digits with letters.  Kept are
    single letters of the same case whose capitals look alike too (so neither г and r nor σ and o),
    letters without case that look like a capital, and small capitals of the shape of the small
    letter.  Ideographs and syllables, and letters of one script, stay what they are.
    """
    table, out = public_table(), {}

    def shape(ch: str) -> str:
        return table.get(ord(ch), ch)

    for cp, to in table.items():
        ch = chr(cp)
        if len(to) != 1 or _alphabet(to) < 0 or unicodedata.category(to) not in ("Lu", "Ll") or unicodedata.decomposition(ch):
            continue
        kind, goal = unicodedata.category(ch), unicodedata.category(to)
        if _alphabet(ch) == _alphabet(to):
            if kind == goal == "Ll" and "SMALL CAPITAL" in unicodedata.name(ch, "") and to in _SCALED:
                out[cp] = to
        elif kind == goal == "Lu" or kind == "Lo" and goal == "Lu":
            out[cp] = to
        elif kind == goal == "Ll":
            big, wanted = ch.upper(), to.upper()
            if len(big) == len(wanted) == 1 and shape(big) == shape(wanted):
                out[cp] = to
    return out
