import pytest

from quire.llm import sentences as S
from quire.llm.sentences import sentences, split_sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


CASES = {
    "plain": (["One is here.", "Two is there!", "Three?"], "One is here. Two is there!  Three?"),
    "abbreviations": (["Ask Dr. Smith, e.g. the one of vol. 3, cf. Jones.", "He came etc.", "Then left."], "Ask Dr. Smith, e.g. the one of vol. 3, cf. Jones. He came etc. Then left."),
    "initials": (["It was J. R. Miller of the U.S. army."], "It was J. R. Miller of the U.S. army."),
    "decimals and hosts": (["It is 3.14 at a.example.org in v1.2 now."], "It is 3.14 at a.example.org in v1.2 now."),
    "quotations": (['He asked, "is it?" and left.', "She wrote, “it is.”", "Good."], 'He asked, "is it?" and left. She wrote, “it is.” Good.'),
    "note marks": (["It ends.[12]", "Next!(3)", "Last."], "It ends.[12] Next!(3)  Last."),
    "item numbers": (["3. The first.", "11) The other."], "3. The first.\n\n11) The other."),
    "headings": (["A heading", "Text goes\non here."], "A heading\n \nText goes\non here."),
    "ellipsis": (["It went... and then on… and on."], "It went... and then on… and on."),
    "no blank": (["It is the end.", "The next one."], "It is the end.The next one."),
    "german": (["Er kam z. B. im 8. Jahrhundert und die Frage ist u. a. Meier bekannt.", "Er fragte: »ist das so?« und die Stadt.", "Nein."], "Er kam z. B. im 8. Jahrhundert und die Frage ist u. a. Meier bekannt. Er fragte: »ist das so?« und die Stadt. Nein."),
    "german marks": (["Sie schrieb: „das ist es.“", "Und nun."], "Sie schrieb: „das ist es.“ Und nun."),
    "french": (["Il demanda : « est-ce lui ? » puis M. Dupont, p. ex. au fol. 3, av. J.-C. le soir !", "Elle écrivit : « oui. »", "Fin."], "Il demanda : « est-ce lui ? » puis M. Dupont, p. ex. au fol. 3, av. J.-C. le soir ! Elle écrivit : « oui. » Fin."),
    "arabic": (["قال د. زيد في ص. ٣ من ج. ٢ ا. هـ. ثم سنة ٨٥ ق.م. هذا؟", "مات سنة ٥٠٣ هـ.", "ثم جاء!"], "قال د. زيد في ص. ٣ من ج. ٢ ا. هـ. ثم سنة ٨٥ ق.م. هذا؟ مات سنة ٥٠٣ هـ. ثم جاء!"),
    "persian": (["ر.ک. دکتر س. بلند این و.", "گفت: «آیه با آن!» سپس تا."], "ر.ک. دکتر س. بلند این و. گفت: «آیه با آن!» سپس تا."),
    "urdu": (["یہ ع۔ علم ص۔ 3 ہے۔", "وہ کیا؟"], "یہ ع۔ علم ص۔ 3 ہے۔ وہ کیا؟"),
    "hindi": (["यह डॉ. वर्मा पृ. 3 पर है।", "वह गया॥", "कौन?"], "यह डॉ. वर्मा पृ. 3 पर है। वह गया॥ कौन?"),
    "chinese": (["古A. Miller在no. 5与3.5人。", "他问：「本者？」然后去。(7)", "又来！"], "古A. Miller在no. 5与3.5人。他问：「本者？」然后去。(7)又来！"),
    "thai": (["คัดในเหตุ", "ครูตอบ 2.13 ถาม", "สมุด พ.ศ. 2497 ห้อง"], "คัดในเหตุ ครูตอบ 2.13 ถาม สมุด พ.ศ. 2497 ห้อง"),
}


@pytest.mark.parametrize("name", CASES)
def test_languages(name):
    want, text = CASES[name]
    assert cut(text) == want


def test_defined_results():
    assert sentences(None) == sentences("") == sentences(" \n \n ") == []
    assert sentences("  a b ") == [(2, 5)]
    assert cut('"unclosed. Next one. End') == ['"unclosed.', "Next one.", "End"]
    assert cut("...") == ["..."] and cut("?!") == ["?!"]


def test_long_text():
    one = "The line is short. "
    assert len(sentences(one * 20_000)) == 20_000
    assert len(sentences("Dr. " * 3000 + "Who came.")) == 1


@pytest.mark.parametrize("between", [" ", "\n\n"])
def test_german_after_another_language(between):
    foreign = ["It was in the year 1990.", "The next one came here later."] * 60 + ["No one knows the number of the others."] * 5
    german = ["Er kam am 3. Mai und die Frage ist im 8. Jahrhundert bekannt.", "Nein."]
    assert cut(" ".join(foreign) + between + " ".join(german)) == foreign + german
    arabic = ["مات سنة ٥٠٣.", "ثم جاء."] * 200
    assert cut(" ".join(arabic) + between + " ".join(german)) == arabic + german


def test_thai_after_another_script():
    latin = "a word " * 100 + "(note)"
    assert cut(latin + " ครูตอบ ถาม สมุด (ห้อง)") == [latin, "ครูตอบ", "ถาม", "สมุด", "(ห้อง)"]
    assert cut("(ครู.) ครู ถาม") == ["(ครู.)", "ครู", "ถาม"]


@pytest.mark.parametrize("n", [10, 64, 200, 20_000])
def test_long_bracket(n):
    text = "He left (" + "So it is. " * n + "well) and came back."
    assert cut(text + " Next one.") == [text, "Next one."]


def test_cover_everything_but_blanks():
    for want, text in CASES.values():
        assert "".join("".join(want).split()) == "".join(text.split())


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 7), (2, None, 7), (3, "", 7), (1, "A b. C d.", 7)], "doc_id bigint, text string, start_pos int")
    got = sorted(map(tuple, split_sentences(df, "doc_id", "text").collect()))
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_any_length_before_and_after_a_mark():
    assert cut("ครู " + "ก" * 40 + "." + "ข" * 3 + " ถาม") == ["ครู " + "ก" * 40 + "." + "ข" * 3, "ถาม"]
    assert cut("So it is." + "A" * 60 + " b. C") == ["So it is.", "A" * 60 + " b.", "C"]
    assert cut("The " + "9" * 60 + ". der und 5. Mai") == cut("The " + "9" * 60 + ". der und 5. Mai")


@pytest.mark.parametrize(
    ("part", "value", "text"),
    [
        ("TORN", 0.0, "He left (So it is. Well) and came back."),
        ("TORN", 0.0, "She wrote, “A thing. Another thing.” Good."),
        ("BARE_NUMBER", 0.0, "3. The first."),
        ("LENGTH_WEIGHT", 0.0, "A p. X."),
    ],
)
def test_spans_overrule_marks(monkeypatch, part, value, text):
    """The marks alone would cut here; each part of a span's score changes rows."""
    joint = cut(text)
    assert len(joint) < len(S.marks_alone(text, 0, len(text)))
    monkeypatch.setattr(S, part, value)
    assert len(cut(text)) > len(joint)


def test_length_weighs_against_the_words():
    """The same closing and opening words: a boundary between long spans, none between short ones."""
    assert cut("A p. X.") == ["A p. X."]
    long = "He wrote on the same long p. Xylo came only in the following year to the city"
    assert cut(long) == ["He wrote on the same long p.", "Xylo came only in the following year to the city"]


def test_marks_without_partner_are_ordinary():
    assert cut('He said " so. Then "it is." Good. (One. Two') == ['He said " so.', 'Then "it is."', "Good.", "(One.", "Two"]


def test_solver_against_all_sequences():
    """The kept starts lose nothing: the result's score is the best of all sequences of spans."""
    import itertools
    import random

    def score(text, x, spans):
        pairs, total = S._Pairs(text, 0, len(text)), 0.0
        by = {c.end: c for c in x} | {len(text): S.Boundary(len(text), len(text), 0.0)}
        for s, e in spans:
            total += by[e].evidence + S.TORN * (pairs.at(e) + pairs.at(by[e].start)) + S._length(e - s) + (S.BARE_NUMBER if by[e].number == s else 0.0)
        return total

    rnd = random.Random(3)
    for _ in range(150):
        text = " ".join(rnd.choice(["a", "B.", "3.", "p.", "(c.", "d)", "“E.", "f.”", "No!", "Dr.", "x.", "g. H"]) for _ in range(9)) + " end"
        x = S._boundaries(text, 0, len(text), S._Pairs(text, 0, len(text)), S._German(text))
        best = max(
            score(text, x, list(zip([0, *[c.start for c in some]], [*[c.end for c in some], len(text)])))
            for n in range(len(x) + 1) for some in itertools.combinations(x, n)
        )
        assert score(text, x, S._block(text, 0, len(text), S._German(text))) == pytest.approx(best)
