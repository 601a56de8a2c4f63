"""Sentence boundaries across languages and scripts.

The rules are the character-property sentence-break rules (every script's terminators, closing
marks belong to the sentence they close) with three tailorings: suppression of full stops of
abbreviations by language (told by the script, or by closed-class words of the block or the text;
where these don't tell, every language's abbreviations count), no break inside a pair of quotation
marks or brackets, and the rule for Thai, which has no end mark.

Defined results: a null, empty or blank text, and a text without a letter or digit, has no
sentence.  Every end is the offset, in code points, behind the last visible character of the
sentence.  Unmatched quotation marks and brackets are plain characters.  Whole texts are used,
however long.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import regex
import unicodedata
from pyspark.sql import DataFrame

from .batches import map_columns
from .forms import skeleton


@lru_cache(maxsize=1 << 16)
def _fold(token: str) -> str:
    return skeleton(token).lower()


def _words(*lists: str) -> frozenset[str]:
    return frozenset(_fold(w) for words in lists for w in words.split())


def _by_language(lists: dict[str, str]) -> dict[str, frozenset[str]]:
    """Folded word -> the languages that list it."""
    out: dict[str, set[str]] = {}
    for lang, words in lists.items():
        for w in _words(words):
            out.setdefault(w, set()).add(lang)
    return {w: frozenset(langs) for w, langs in out.items()}


# Abbreviations by language, without their last full stop.
#: Never the end of a sentence: something always follows.
NEVER = _by_language({
    "en": "mr mrs ms dr prof capt lt sgt col gen maj cmdr rev hon sen gov rep pres mt st ft messrs cpl adm approx vs incl eg ie viz cf i.e e.g",
    "de": "hr fr hrn frl dr prof nr ca bzw insb inkl exkl evtl ggf sog mio mrd tsd vgl dipl ing bd hl str st z.b d.h u.a z.t i.d.r",
    "fr": "m mm mme mmes mlle mgr dr prof env cf p.ex c.-à-d av boul bd st",
    "es": "sr sra srta sres dr dra d dña ud uds av avda pág págs pag pags núm aprox fig ee gral gen prof profa ing cap p.ej",
    "pt": "sr sra srta sres dr dra d aprox av pág págs pag pags núm fig gen prof profa eng exmo exma pe p.ej",
    "it": "sig sigg sig.ra sig.na dr dott dott.ssa prof prof.ssa avv ing geom arch gen ca pag pagg",
    "nl": "dhr mevr mw dr drs ir prof bijv nr mln mld ca st o.a d.w.z m.b.t i.v.m t.a.v",
    "ru": "ул пл пр просп пер обл р-н тыс млн млрд трлн проф акад доц инж гл напр см ср стр табл т.е",
    "hi": "डॉ प्रो श्री सुश्री कु",
    "ar": "أ.د",
})
#: English titles are written with a capital; the same letters in small ones are words.
TITLES = _words("rep gen col sen gov hon rev pres mt ft")
#: Measures behind a number may end a sentence.
MEASURES = _words("ft mm m см г тыс млн млрд трлн")
#: Not the end before a number.
NUMBERED = _words(
    "no nos nr fig figs pp pop vol ch sec ed jan feb mar apr jun jul aug sep sept oct nov dec p pt",
    "n n.o núm num pág art cap tel ca circa jan febr mrt abs",
    "янв февр мар апр авг сент окт нояб дек стр рис",
)
#: The end only if a new sentence follows.
MAYBE = _words(
    "inc corp ltd co llc plc jr sr esq ave blvd rd sq bros dept univ assn a.m p.m u.s u.k u.n d.c ph.d m.d b.a etc al",
    "usw etc einw ecc n.chr v.chr u.s.w enz uu т.д т.п др пр г гг в вв н.э руб коп чел",
)
#: After these a capital does not show a new sentence.
_DAYS = _words("monday tuesday wednesday thursday friday saturday sunday")
_CLOCK = _words("a.m p.m")
_STATES = _words("u.s u.k u.n d.c")
# Words of the closed classes (articles, pronouns, prepositions, conjunctions, the
# commonest verbs).  They tell the language of a text, and as capitalised words open a sentence.
FUNCTION_WORDS = {
    "en": "the a an it he she they we this that these those there in on at but and or nor so yet for of to from with by as if when while after before since until because although though "
    "i you his her its our their my your who what which where why how all both each every either neither no not none some any many much more most few several other another such "
    "one two three everyone everybody everything someone somebody something anyone anybody anything nobody nothing is was were are be been has have had will would could should may might can do does did",
    "de": "der die das den dem des ein eine einen einem einer und oder aber denn weil dass wenn als wie auf aus bei mit nach seit von vor zu zum zur im am in an für über unter "
    "ich du er sie es wir ihr man sich sein seine ihre dieser diese dieses jeder alle viele einige keiner niemand nicht kein keine ist war waren sind hat haben hatte wird wurde werden auch noch nur",
    "fr": "le la les un une des du de et ou mais car donc que qui quoi dont où au aux dans sur sous par pour sans avec chez vers depuis après avant pendant selon "
    "je tu il elle on nous vous ils elles ce cet cette ces son sa ses leur leurs notre votre tout tous toute toutes plusieurs personne rien ne pas plus est sont était ont a été",
    "es": "el la los las un una unos unas y o pero porque que quien cual donde cuando como de del al a en con por para sin sobre entre desde hasta tras según "
    "yo tú él ella nosotros ellos ellas usted ustedes este esta estos estas ese esa su sus se lo le les todo todos nadie nada muchos varios no ni es son era fue han ha está",
    "pt": "o a os as um uma uns umas e ou mas porque que quem qual onde quando como de do da dos das ao à em no na nos nas com por para sem sobre entre desde até após segundo "
    "eu tu ele ela nós eles elas você este esta estes estas esse essa seu sua seus suas se lhe todo todos ninguém nada muitos vários não nem é são era foi foram tem há está",
    "it": "il lo la i gli le un uno una e o ma perché che chi cui dove quando come di del della dei delle al alla ai alle in nel nella con per senza su sul sulla tra fra da dal dalla dopo prima secondo "
    "io tu lui lei noi voi loro questo questa questi queste quello suo sua suoi sue si ci tutto tutti nessuno nulla molti alcuni non né è sono era ha hanno fu",
    "nl": "de het een en of maar want omdat dat die wie wat waar wanneer als van in op aan met voor door bij uit naar om over onder tussen tot sinds na volgens "
    "ik jij hij zij ze we wij jullie men zich zijn haar hun deze dit alle veel enkele niemand niets niet geen is was waren heeft hebben had wordt werd worden ook nog",
}
_VOTES = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _VOTES.setdefault(unicodedata.normalize("NFC", _w), []).append(_lang)
_OPENERS = _words(*FUNCTION_WORDS.values())
_MONTHS = _words("januar jänner februar märz april mai juni juli august september oktober november dezember")
_RU_YEAR = _words("г гг в вв")
_T, _DP = _fold("т"), _words("д п")
# Words that name a speaker after a quotation.
_SAY_ZH = regex.compile(r"[^。！？!?“”「」\n]+?(?:说道|说|问道|问|喊道|喊|表示|答道|答|回答|称|指出|补充道|写道|道|认为|强调|解释|承认|警告|宣布|透露)[。！!]")
_SAY_HI = regex.compile(r"[^।?!“”\n]+? ने (?:कहा|पूछा|बताया|लिखा|चिल्लाया|जोड़ा|चिल्लाकर कहा|जवाब दिया|स्वीकार किया|समझाया)")
_SAY_AR = _words("قال قالت سأل سألت صاح صاحت أضاف أضافت أجاب أجابت أوضح أوضحت أكد أكدت ذكر ذكرت صرح صرحت كتب كتبت")
_SAY_JA = ("と", "って", "などと")

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "｢": "｣", "«": "»", "‹": "›", "“": "”", "„": "“", "‚": "‘"}
_CLOSE = {v: k for k, v in _OPEN.items() if v not in "“‘"}
_BRACKETS = frozenset("([{（［【")
_STRAIGHT = frozenset('"＂')
_WORD = re.compile(r"[^\W\d_]+")
#: Every script's terminators by character property, but for the plain full stops, and the full-width full stop.
_STRONG = frozenset(c for c in map(chr, range(0x20000)) if regex.match(r"\p{Sentence_Break=STerm}", c)) | {"．"}
#: Ideographic and Indic full stops, which end a sentence whatever follows.
_FINAL = frozenset("。｡．।॥")
_DOTS = frozenset("….‥。")
_HARD = regex.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*|\|{5}| +")
_MARKS = regex.compile("[" + regex.escape("".join(sorted(_STRONG)) + ".…‥\"＂“”„«»‹›「」『』｢｣《》〈〉()[]{}（）［］【】", special_only=False) + "]")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}”’」）)\]»])\s+(?=[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}\p{Arabic}\p{Devanagari}\p{Cyrillic}])")
_VISIBLE = regex.compile(r"[\p{L}\p{Nd}\p{No}\p{Nl}]")
_IN_TOKEN = frozenset(".-‐‑&")
_IGNORED = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_CLAUSE = frozenset(",;:–—-،、，；：؛)")
#: The rest of a date such as 16. 5. 1992 behind its day, and its head up to the month.
_DATE_REST = regex.compile(r"\p{Nd}{1,2}\.\s?\p{Nd}{2,4}")
_DATE_HEAD = regex.compile(r"(?<!\p{Nd})\p{Nd}{1,2}\.\s?\p{Nd}{1,2}\Z")
_NUMBER = regex.compile(r"\p{Nd}+\Z")


def _pairs(text: str, marks: list[tuple[int, str]]) -> dict[int, int]:
    """Matched outermost and inner pairs of one block: place of the opener -> place of the closer."""
    stack: list[tuple[str, int]] = []
    found: dict[int, int] = {}

    def close(kind: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == kind:
                found[stack[k][1]] = at
                del stack[k:]
                return True
        return False

    for at, ch in marks:
        if ch in _STRAIGHT:
            if not close('"', at):
                stack.append(('"', at))
        elif ch == "“":
            if not close("„", at):
                stack.append(("“", at))
        elif ch in _OPEN:
            stack.append((ch, at))
        elif ch == "”":
            close("“", at) or close("„", at)
        elif ch in _CLOSE:
            close(_CLOSE[ch], at)
    return found


def _mixed_case(word: str) -> bool:
    """A small first letter and a capital behind it, as in a product or family name."""
    return len(word) > 1 and word[0].islower() and any(c.isupper() for c in word[1:4])


def _next_word(text: str, at: int) -> str:
    end = at
    while end < len(text) and (text[end].isalnum() or unicodedata.combining(text[end])):
        end += 1
    return text[at:end]


def _skip(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _language(text: str) -> str | None:
    """Language of the closed-class words of a text in Latin letters; None if they don't tell clearly."""
    votes: dict[str, float] = {}
    counts = Counter(_WORD.findall(unicodedata.normalize("NFC", skeleton(text)).lower()))
    for word in counts.keys() & _VOTES.keys():
        langs = _VOTES[word]
        for lang in langs:
            votes[lang] = votes.get(lang, 0) + counts[word] / len(langs)
    ranked = sorted(votes.items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < 1 or len(ranked) > 1 and ranked[0][1] < 1.5 * ranked[1][1]:
        return None
    return ranked[0][0]


def _back(text: str, at: int, begin: int) -> int:
    """Where the token that ends at ``at`` begins."""
    while at > begin and (text[at - 1].isalnum() or text[at - 1] in _IN_TOKEN or unicodedata.category(text[at - 1])[0] in "MN"):
        at -= 1
    return at


def _word_before(text: str, at: int, begin: int) -> str:
    """The word before the one that begins at ``at``."""
    stop = at
    while stop > begin and text[stop - 1].isspace():
        stop -= 1
    start = stop
    while start > begin and not text[start - 1].isspace():
        start -= 1
    return text[start:stop]


class _Block:
    """One stretch of text without hard breaks."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self._lang: str | None = None
        self._asked = False

    def lang(self) -> str | None:
        """Language of the block, else of the whole text; asked for where abbreviations differ."""
        if not self._asked:
            self._asked = True
            self._lang = _language(self.text[self.start : self.end]) or _language(self.text)
        return self._lang

    def never(self, whole: str, last: str, behind_number: bool) -> bool:
        """Whether the token is an abbreviation that something always follows, in the text's own language."""
        folded = _fold(last)
        langs = NEVER.get(_fold(whole)) or NEVER.get(folded)
        if langs is None or behind_number and folded in MEASURES:
            return False
        if not last.isascii() and not (langs & FUNCTION_WORDS.keys()):
            return True  # the script says it all
        lang = self.lang()
        if lang == "en" and folded in TITLES and last[:1].islower():
            return False
        return lang is None or lang in langs

    def new_sentence(self, at: int) -> bool:
        """Whether what stands at ``at`` can open a sentence (a small plain letter cannot)."""
        text = self.text
        if at >= self.end:
            return True
        ch = text[at]
        if ch in _CLAUSE:
            if ch in "—–-":
                follow = _skip(text, at + 1, self.end)
                return follow < self.end and not text[follow].islower() and text[follow] not in _CLAUSE
            return False
        if ch.islower():
            return _mixed_case(_next_word(text, at))
        return ch not in "&/%=+*"

    def opens(self, at: int) -> bool:
        """Whether a capitalised word of the closed classes stands at ``at``."""
        word = _next_word(self.text, at)
        return len(word) > 1 and word[0].isupper() and _fold(word) in _OPENERS

    def after_quote(self, at: int, opener: int, begin: int, close: str) -> bool:
        """Whether the sentence ends at a quotation that closed before ``at``."""
        text = self.text
        nxt = _skip(text, at, self.end)
        if nxt >= self.end:
            return True
        ch = text[nxt]
        if ch in _STRONG or ch in ".…":
            return False
        if not self.new_sentence(nxt):
            return False
        if text.startswith(_SAY_JA, nxt):
            return False
        if opener == begin:  # nothing before the quotation: its speaker may follow
            if _SAY_ZH.match(text, nxt, self.end) and "一" <= ch <= "鿿":
                return False
            if "ऀ" <= ch <= "ॿ" and _SAY_HI.match(text, nxt, self.end):
                return False
            if "؀" <= ch <= "ۿ" and _fold(_next_word(text, nxt)) in _SAY_AR:
                return False
        return True

    def stop(self, at: int, begin: int) -> bool:
        """Whether the single full stop at ``at`` ends the sentence that began at ``begin``."""
        text, end = self.text, self.end
        nxt = _skip(text, at + 1, end)
        if nxt >= end:
            return True
        token_at = _back(text, at, begin)
        token = text[token_at:at]
        last = token.replace("-", ".").rpartition(".")[2]
        follow = text[nxt]
        if nxt == at + 1:  # no space behind
            if not (follow.isalnum() or follow in _OPEN or follow in _STRAIGHT or follow in "¿¡—"):
                return False
            if not last or follow in ")]":
                return False
            if last[-1].isdigit():
                if follow.isdigit():
                    return False
            elif len(last) < 2 and not _wide(last):
                return False
            if follow.islower() and not _mixed_case(_next_word(text, nxt)):
                return False
            folded = _fold(last)
            return not (self.never(token, last, False) or folded in NUMBERED or folded in MAYBE or _fold(token) in MAYBE)
        if not token:
            return self.new_sentence(nxt)
        if _NUMBER.match(token):
            if len(token) <= 3 and _skip(text, begin, at) == at - len(token):
                return False  # a list number
            if len(token) <= 2 and (
                _fold(_next_word(text, nxt)) in _MONTHS
                or _DATE_REST.match(text, nxt)
                or follow.isdigit() and _DATE_HEAD.search(text, max(begin, at - 8), at)
            ):
                return False
            return self.new_sentence(nxt)
        if not self.new_sentence(nxt):
            return False
        whole, folded = _fold(token), _fold(last)
        if folded in _RU_YEAR:
            return self.previous(token_at, at, token, last, begin)[-1:].isdigit()
        if whole in MAYBE or folded in MAYBE and len(last) > 1:
            if whole in _CLOCK:
                return _fold(_next_word(text, nxt)) not in _DAYS
            return self.opens(nxt) if whole in _STATES else True
        if folded in NEVER or whole in NEVER:
            if self.never(token, last, self.previous(token_at, at, token, last, begin)[-1:].isdigit()):
                return False
        if follow.isdigit() and (folded.endswith("str") or whole in NUMBERED or folded in NUMBERED):
            return False
        if len(last) < 4 and len(_IGNORED.sub("", unicodedata.normalize("NFC", last))) == 1 and not last.isdigit() and not _wide(last):
            # an initial, unless a word of the closed classes goes on that no name begins with
            before = self.before(token_at, at, token, last, begin)
            previous = _fold(before.split()[-1]).rstrip(".") if before else ""
            return previous == _T and folded in _DP or before[:1].islower() and self.opens(nxt) or previous[-1:].isdigit() and folded in MEASURES
        return True

    def before(self, token_at: int, at: int, token: str, last: str, begin: int) -> str:
        """What stands before the last part of the token that ends at ``at``."""
        return _word_before(self.text, token_at, begin) if len(token) == len(last) else self.text[token_at : at - len(last)]

    def previous(self, token_at: int, at: int, token: str, last: str, begin: int) -> str:
        found = self.before(token_at, at, token, last, begin)
        return _fold(found.split()[-1]).rstrip(".") if found else ""

    def ends(self) -> list[int]:
        text, start, end = self.text, self.start, self.end
        marks = [(m.start(), m.group()) for m in _MARKS.finditer(text, start, end)]
        pairs = _pairs(text, marks)
        closers = set(pairs.values())
        out: list[int] = []
        begin = _skip(text, start, end)
        skip_to = start
        thai = [m.start() for m in _THAI_GAP.finditer(text, start, end)] if _has_thai(text, start, end) else []
        if thai:
            marks = sorted(marks + [(a, " ") for a in thai])
        for at, ch in marks:
            if at < skip_to:
                continue
            cut = -1
            if ch == " ":
                if text[at - 1] != "ๆ":
                    cut = at
            elif at in pairs:
                close = pairs[at]
                skip_to = close + 1
                inner = close - 1
                while inner > at and (text[inner].isspace() or text[inner] in _CLOSE or text[inner] in "”“\"'’"):
                    inner -= 1
                if text[inner] in _STRONG or text[inner] in "….‥":
                    if ch not in _BRACKETS and self.after_quote(close + 1, at, begin, text[close]):
                        cut = close + 1
                    elif ch in _BRACKETS and at == begin and self.new_sentence(_skip(text, close + 1, end)):
                        cut = close + 1
            elif ch in _STRONG or ch in ".…‥":
                stop = at + 1
                while stop < end and (text[stop] in _STRONG or text[stop] in ".…‥"):
                    stop += 1
                run = text[at:stop]
                skip_to = stop
                nxt = _skip(text, stop, end)
                if run == ".":
                    if self.stop(at, begin):
                        cut = stop
                elif all(c in _DOTS for c in run) and run != "。":
                    if nxt >= end or self.new_sentence(nxt):
                        cut = stop
                elif nxt >= end or run[-1] in _FINAL or self.new_sentence(nxt):
                    cut = stop
                if cut >= 0:
                    while cut < end and text[cut] in "”’»›」』）)]" and cut not in closers:
                        cut += 1
            if cut >= 0:
                out.append(cut)
                begin = _skip(text, cut, end)
                skip_to = max(skip_to, cut)
        out.append(end)
        return out


def _has_thai(text: str, start: int, end: int) -> bool:
    return not text.isascii() and _THAI.search(text, start, end) is not None


_THAI = regex.compile(r"\p{Thai}")


def _wide(ch: str) -> bool:
    """A letter of a script that writes words or syllables without spaces or case."""
    return ch >= "ऀ" and unicodedata.category(ch[-1]) in ("Lo", "Mn", "Mc", "Lm")


def ends(text: str | None) -> list[int]:
    """Offsets behind the last visible character of every sentence of ``text``, in order."""
    if not text:
        return []
    place: list[int] | None = None
    clean = text
    if not text.isascii() and _IGNORED.search(text):
        holes = [m.start() - k for k, m in enumerate(_IGNORED.finditer(text))]
        clean = _IGNORED.sub("", text)
        place = holes
    cuts: list[int] = []
    begin = 0
    for m in _HARD.finditer(clean):
        _block(clean, begin, m.start(), cuts)
        begin = m.end()
    _block(clean, begin, len(clean), cuts)
    if place is None:
        return cuts
    # the character before a cut at c is c - 1; every hole at or before it shifts it
    return [c + bisect_right(place, c - 1) for c in cuts]


def _block(text: str, start: int, end: int, cuts: list[int]) -> None:
    if _VISIBLE.search(text, start, end) is None:
        return
    begin = start
    for cut in _Block(text, start, end).ends():
        last = cut
        while last > begin and text[last - 1].isspace():
            last -= 1
        if _VISIBLE.search(text, begin, last):
            cuts.append(last)
        begin = cut


def spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every sentence of ``text``; starts skip white space and separators."""
    out, begin = [], 0
    for stop in ends(text):
        while begin < stop and (text[begin].isspace() or text[begin] == "|"):
            begin += 1
        out.append((begin, stop))
        begin = stop
    return out


def sentence_ends(df: DataFrame, id_column: str = "row_id", text_column: str = "article") -> DataFrame:
    """One row per sentence of every text: the id and ``end_char``.

    Narrow: one pass over the text column, no shuffle.  Rows with a null text have no row.
    """

    def make(columns):
        ids, stops = [], []
        for key, text in zip(columns["key"].to_pylist(), columns["text"].to_pylist()):
            found = ends(text)
            ids += [key] * len(found)
            stops += found
        return {id_column: ids, "end_char": stops}

    chosen = df.selectExpr(f"`{id_column}` AS key", f"`{text_column}` AS text").where("text IS NOT NULL")
    return map_columns(chosen, f"`{id_column}` bigint, end_char int", make)


def sentence_lists(df: DataFrame, id_column: str = "row_id", text_column: str = "article") -> DataFrame:
    """One row per text with its list of sentences (an empty list for a null or wordless text)."""

    def make(columns):
        lists = [[t[a:b] for a, b in spans(t)] for t in columns["text"].to_pylist()]
        return {id_column: columns["key"], "sentences": lists}

    chosen = df.selectExpr(f"`{id_column}` AS key", f"`{text_column}` AS text")
    return map_columns(chosen, f"`{id_column}` bigint, sentences array<string>", make)
