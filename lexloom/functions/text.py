"""Text rules as Column expressions: sentence split, tokens, filters.

Everything stays inside one row of one document, so none of these needs a shuffle.  Null texts
count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space (Unicode White_Space and the four information separators),
# sentence terminators, and the report separator of multi-report records.
SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TERMINATORS = ".!?。！？"
SEPARATOR = "|||||"

# English stop-words of the second token rule.
STOP_WORDS = (
    "a about above after again against all am an and any are aren as at be because been before "
    "being below between both but by can could d did didn do does doesn doing don down during "
    "each few for from further get got had hadn has hasn have haven having he her here hers "
    "herself him himself his how i if in into is isn it its itself just ll m ma may me might "
    "more most must mustn my myself need no nor not now o of off on once only or other our ours "
    "ourselves out over own re s said same shan she should shouldn so some such t than that the "
    "their theirs them themselves then there these they this those through to too under until up "
    "ve very was wasn we were weren what when where which while who whom why will with won would "
    "wouldn y you your yours yourself yourselves also like new one two"
).split()


def collapsed(text: Column) -> Column:
    """Trimmed text with every run of white space as one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def split_sentences(text: Column) -> Column:
    """Cut behind every terminator; pieces are trimmed and empty ones dropped."""
    parts = F.split(collapsed(text), f"(?<=[{TERMINATORS}]) *")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(collapsed(text), " "), lambda t: t != "")


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def at_least(sentences: Column, n: int = 3) -> Column:
    """Sentences with at least ``n`` tokens."""
    return F.filter(sentences, lambda s: count_tokens(s) >= n)


def first_sentences(sentences: Column, n: int | None) -> Column:
    """The first ``n`` sentences; a null or non-positive ``n`` keeps all."""
    return sentences if not n or n <= 0 else F.slice(sentences, 1, n)


def lower_tokens(sentence: Column) -> Column:
    """First token rule: lower case, cut at white space, punctuation kept."""
    return tokens(F.lower(sentence))


def plain_tokens(sentence: Column, stop_words: bool = False) -> Column:
    """Second token rule: lower case, anything but word characters is a gap.

    With ``stop_words`` the listed words and one-character tokens go.
    """
    found = tokens(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}_]", " "))
    if stop_words:
        stops = F.array(*map(F.lit, STOP_WORDS))
        found = F.filter(found, lambda t: ~F.array_contains(stops, t) & (F.length(t) > 1))
    return found


def bigrams(found: Column, joint: str = "_") -> Column:
    """Neighbouring tokens joined, in order."""
    pairs = F.zip_with(found, F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda a, b: F.concat_ws(joint, a, b))
    return F.when(F.size(found) > 1, F.slice(pairs, 1, F.greatest(F.size(found) - 1, F.lit(1)))).otherwise(F.expr("CAST(array() AS array<string>)"))


def vectorizer_tokens(sentence: Column) -> Column:
    """Third token rule: lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def without_separators(text: Column) -> Column:
    return F.replace(text, F.lit(SEPARATOR), F.lit(" "))


def without_dash(summary: Column) -> Column:
    """A summary without a leading dash and blank."""
    return F.regexp_replace(summary, "^- ", "")


def joined(sentences: Column, picked: Column) -> Column:
    """The picked sentences (0-based places, in the given order) joined by one space."""
    return F.array_join(F.transform(picked, lambda i: F.get(sentences, i)), " ")


def within(picked: Column, n: Column) -> Column:
    """Places from 0 up to ``n``."""
    return F.filter(picked, lambda i: (i >= 0) & (i < n))


def dashed_documents(text: Column) -> Column:
    """Documents of a text parted by lines of at least three dashes."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n-{3,}\n")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, f"^{SPACE}+|{SPACE}+$", "")), lambda p: p != "")


#: The sentence split and the token count as SQL expressions over ``{0}``.
_PLAIN = "trim(regexp_replace(coalesce({0}, ''), r'" + SPACE.replace("{", "{{").replace("}", "}}") + "+', ' '))"
SQL_SPLIT = "filter(transform(split(" + _PLAIN + ", r'(?<=[" + TERMINATORS + "]) *'), s -> trim(s)), s -> s <> '')"
SQL_COUNT = "size(filter(split(" + _PLAIN + ", ' '), t -> t <> ''))"
