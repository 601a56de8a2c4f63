"""Sentence boundaries, consistent forms and languages."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom.llm import forms, language, lookalike, sentences


def cut(text):
    return [text[a:b] for a, b in sentences.spans(text)]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("The U.S. envoy left at 10.30 a.m. sharp. iVora of X sold it.", 2),
        ('"Who pays for it?" asked A. Doe. X said: "No. All of it." Gov. Y left.', 3),
        ("(The office declined.) Nobody knew why ... the clerks least of all. It went out... The end.", 4),
        ("It ended at 5 p.m. Monday in Town. The buyer was A & B Corp. The rest.It cost 5 crowns.133,029 came.", 5),
        ("Am 4. Juni kam Dr. Xaver. Am 16. 5. 1992 endete es. „Wer zahlt das?“, fragte Yannick. Ab 1958. Die Akte Nr. 4 fehlt.", 5),
        ("« Qui va payer ? » a demandé Guy. J.-P. Roux vit av. Foch.", 2),
        ("—¿Quién avisó? —preguntó Páxpil. ¡Qué noche para Rosa!", 2),
        ("«Кто за это заплатит?» — спросил Иван. В 2001 г. в г. Бандпол дом. Есть и т. д. Д-р Лей там.", 4),
        ("“我们没想到。没有人想到。”富风川说。牧南山表示：“由于成本。”十年来第三次。", 3),
        ("ムミさんは「違いだ。」と述べた。「誰が？」とダさん。", 2),
        ("คุณวีลถามว่า “ใครจะจ่าย 82 บาท” เด็กๆ ในเมืองนี้ ราคาขึ้น 27 บาท", 3),
        ("Kopf ohne Punkt\n\nEin Satz.\n1. Erster Punkt. 2. Zweiter Punkt. ||||| Letzter", 5),
        ("यह पहला है। डॉ. राम आए। “ठीक है,” सीता ने कहा।", 3),
        ("The gap is 5 mm. Then it closed.", 2), ("Длина 5 см. Затем он ушёл.", 2), ("The pole is 6 ft. It fell over.", 2), ("He met the don. They talked.", 2),
        ("We saw the rep. He was late.", 2), ("He got vitamin C. Everyone was glad.", 2), ("She lives in Washington D.C. Nobody came.", 2), ("It left the U.S. Several people came.", 2),
        ("They passed the old arch. Then it rained on the town.", 2), ("Il vit M. Dupont et Mme. Roux. Il partit.", 2), ("Rep. Lee met Gen. Day at Ft. Hill. He saw Col. May.", 2),
        ("W. H. Oden met J. R. Tall. The U.S. Senate met.", 2),
    ],
)
def test_sentence_counts(text, wanted):
    assert len(cut(text)) == wanted, cut(text)


def test_every_terminator_ends_a_sentence():
    import regex

    marks = [c for c in map(chr, range(0x20000)) if regex.match(r"\p{Sentence_Break=STerm}", c)]
    assert len(marks) > 130
    for mark in marks:
        assert len(cut(f"אבג דהו{mark} זחט יכל{mark}")) == 2, hex(ord(mark))


def test_ends_count_code_points_of_the_raw_text():
    raw = "Mem​ber⁠s left.  The énd 𝒜 came.\n"
    stops = sentences.ends(raw)
    assert [raw[:s].rstrip() == raw[:s] for s in stops] == [True, True]
    assert raw[: stops[0]].endswith("left.") and stops[-1] == len(raw) - 1


def test_texts_without_words_have_no_sentence():
    assert [sentences.ends(x) for x in (None, "", "  \n ", "— — —", "...", "|||||")] == [[]] * 6


def test_very_long_and_unmatched_texts():
    assert len(sentences.ends('He said "no. ' + "It went on. " * 5000)) >= 5000
    assert len(sentences.ends("(" * 500 + " word. " + ")" * 500)) >= 1


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "One. Two is here.", 7), (2, None, 7), (3, "", 7)], "row_id bigint, article string, end_char int")
    rows = sentences.sentence_ends(df).orderBy("end_char").collect()
    assert [(r.row_id, r.end_char) for r in rows] == [(1, 4), (1, 17)]
    assert sentences.sentence_ends(df.limit(0)).count() == 0


def test_skeleton_joins_what_reads_the_same():
    same = [
        ("Ａｂｃ　１２", "Abc 12"), ("café", "café"), ("Moscow", "Mоѕсоw"), ("ofﬁce", "office"), ("a​ b­", "a b"),
        ("ﾊﾞｽ", "バス"), ("バス", "バス"), ("⼈⼯", "人工"), ("年", "年"), ("a \n\n b", "a b"), ("أ", "أ"), ("क़", "क़"),
    ]
    for a, b in same:
        assert forms.skeleton(a) == forms.skeleton(b), (a, b)


def test_skeleton_keeps_what_is_seen():
    for a, b in [("10³", "103"), ("a", "A"), ("o", "ø"), ("plán", "plan"), ("l", "1"), ("0", "O"), ("½", "1/2"), ("①", "1"), ("“a”", '"a"'), ("a b", "ab")]:
        assert forms.skeleton(a) != forms.skeleton(b), (a, b)
    for x in ("", "abc", "Ｈéllo​ wörld", "ﾊﾞ"):
        assert forms.skeleton(forms.skeleton(x)) == forms.skeleton(x)


def test_letters_of_other_alphabets():
    for a, b in zip("ⲞᴏᴄᴠᴢոցᎡᏀⵔ\U00010404αορ", "OocvzngRGOOaop"):
        assert forms.skeleton(a) == b, a
    # other letters: a digit's or a stroke's look, ideographs and syllables, letters of one script
    for a, b in [x.split() for x in ("г r", "σ o", "ס o", "ⵏ l", "ニ 二", "ロ 口", "エ 工", "ک ك", "ی ى", "ɑ a", "− -", "ɪ i", "Ꮞ 4")]:
        assert forms.skeleton(a) != forms.skeleton(b), (a, b)
    for cp in range(0x80, 0x20000):
        if not 0xD800 <= cp < 0xE000:
            once = forms.skeleton(f"x{chr(cp)}x")
            assert forms.skeleton(once) == once, hex(cp)


def test_batch_form_equals_single_form():
    rng = random.Random(3)
    letters = "abcéÄßｆﬁо́​ 、。ハﾊﾞ年人ก้ أ\n1²"
    texts = [None, ""] + ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(200)]
    c, sizes = forms.bare_batch(texts)
    at = 0
    for t, n in zip(texts, sizes):
        assert c[at : at + n].tolist() == (forms.bare(t).tolist() if t else [])
        at += n


def test_same_reading_pairs_against_brute_force(spark):
    base = "The quick brown fox jumps over the lazy dog again and again"
    rows = [(1, base, None), (2, base.replace("o", "о"), base), (3, base.replace(" ", " "), None), (4, base, base), (5, base.upper(), base + "²"), (6, "short", "short"), (7, None, ""), (8, base + "²", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id bigint, article string, highlights string, field_name string")
    found = {tuple(r) for r in lookalike.same_reading(df).collect()}
    want = set()
    for k, field in ((1, "article"), (2, "highlights")):
        ok = [(r[0], r[k]) for r in rows if r[k] and lookalike.enough(forms.skeleton(r[k]))]
        want |= {(field, a, b) for a, x in ok for b, y in ok if a < b and x != y and forms.skeleton(x) == forms.skeleton(y)}
    assert found == want and want
    assert lookalike.same_reading(df.limit(0)).count() == 0


def test_labels_that_name_a_language():
    named = {"en": "en", " DE ": "de", "en-GB": "en", "fr_CA": "fr", "deu": "de", "Russian": "ru", "zho": "zh"}
    assert {k: language.named_language(k) for k in named} == named
    assert all(language.named_language(x) is None for x in (None, "", "und", "n/a", "xx", "--", "unknown"))


SAMPLES = {
    "en": "The harbour council reviewed {} before the winter storms. Members of the choir welcomed {} with a narrow majority.",
    "de": "Der Hafenrat überprüfte {} vor Beginn der Saison. Die Feuerwehr begrüßte {} trotz der Warnungen von Fachleuten.",
    "es": "El consejo del puerto revisó {} antes de la temporada. La asociación de vecinos celebró {} por una mayoría ajustada.",
    "ru": "Совет порта проверил {} перед летним сезоном. Союз рыбаков приветствовал {} после долгих переговоров.",
    "zh": "港口委员会审查了{}并且发布了公共图书馆的预算。渔民支持了{}以及三家诊所的合并。",
}


def sample(lang, k):
    rng = random.Random(f"{lang}{k}")
    name = "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(4)).title()
    return SAMPLES[lang].format(name, name)


@pytest.fixture(scope="module")
def model():
    texts, labels = zip(*[(sample(lang, k), lang) for k in range(120) for lang in SAMPLES])
    labels = [random.Random(k).choice(list(SAMPLES)) if k % 17 == 0 else x for k, x in enumerate(labels)]
    return language.fit(list(texts), labels)


def test_held_out_accuracy(model):
    cases = [(lang, sample(lang, k)) for k in range(200, 240) for lang in SAMPLES]
    found = language.stretches(model, [t for _, t in cases])
    right = sum(len(f) == 1 and f[0][0] == lang for (lang, _), f in zip(cases, found))
    assert right / len(cases) >= 0.97


def test_stretches_in_order(model):
    text = sample("en", 300) + " " + sample("ru", 301) + "\n\n" + sample("de", 302)
    (found,) = language.stretches(model, [text])
    assert [f[0] for f in found] == ["en", "ru", "de"] and all(0 <= f[3] <= 1 for f in found)
    assert language.stretches(model, [None, "", "  ", "12 — 13.5", "***"]) == [[]] * 5


def test_language_table(spark, model):
    df = spark.createDataFrame([(1, sample("en", 400), "en"), (2, sample("de", 401), "fr"), (3, None, None), (4, sample("es", 402) + " " + sample("zh", 403), None)], "doc_id bigint, text string, lang string").withColumn("seg_no", F.lit(9))
    rows = {(r.doc_id, r.seg_no): (r.lang, r.is_case) for r in language.languages(df, model).collect()}
    assert rows == {(1, 0): ("en", False), (2, 0): ("de", True), (4, 0): ("es", True), (4, 1): ("zh", True)}


def test_unicode_data_is_current():
    assert unicodedata.unidata_version >= "15"


def test_calibration_sees_wrong_labels():
    import numpy as np

    rng = np.random.default_rng(2)
    truth = rng.integers(0, 5, 60000)
    z = rng.normal(0, 1, (60000, 5))
    z[np.arange(60000), truth] += 2.5
    # logits of a calibrated model: the class means are 2.5 apart with unit noise
    z *= 2.5
    label = np.where(rng.random(60000) < 0.2, rng.integers(0, 5, 60000), truth)
    t, noise, reject = language.calibrated(z * 3, label)
    assert 2 < t < 3.5 and abs(noise - 0.2) < 0.06 and 0.5 <= reject <= 0.9, (t, noise, reject)


def test_names_come_from_the_language_table():
    named = language.names_of([("en", "English"), ("xx", "Newish")])
    assert language.named_language("eng", named) == "en" and language.named_language("Newish", named) == "xx" and language.named_language("de", named) is None


def test_lines_are_valued_in_blocks(model, monkeypatch):
    """What a block gathers is bounded, and how lines fall into blocks decides nothing."""
    texts = [f"The council of the town met on day {k} and nobody knew what the clerks had written. " * 40 for k in range(30)]
    seen = []
    plain = language.folded
    monkeypatch.setattr(language, "folded", lambda lines: (seen.append(sum(map(len, lines))), plain(lines))[1])
    found = language.stretches(model, texts)
    assert len(seen) > 1 and max(seen) <= language.BLOCK + 100
    monkeypatch.setattr(language, "BLOCK", 10**9)
    for a, b in zip(found, language.stretches(model, texts)):
        assert [x[:3] for x in a] == [x[:3] for x in b]
