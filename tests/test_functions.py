"""Normalisers, sentences, alignment, lexicons and caps on small cases."""

import itertools

import pandas as pd
import pytest

from glyphmill.functions import normalize, sentences
from glyphmill.operators import align, lexicon, mixing

T = normalize.transliteration


@pytest.mark.parametrize("v", "ABC")
def test_all_variants(v):
    assert "<gap>" in T("a <gap> b <big_gap> c", v) and "<big_gap>" in T("a <gap> b <big_gap> c", v)
    assert "foo" not in T("a (foo) b", v) and "." not in T("a . b", v)
    assert "KÙ.BABBAR" in T("KÙ.BABBAR", v) and "URUK LUGAL" in T("URUK LUGAL", v)
    assert T("sza s,i S,I t,u s'e a2 e3", v) == "ša ṣi ṢI ṭu śe á è"
    assert T(None, v) == T("", v) == ""


@pytest.mark.parametrize("v", "BC")
def test_gaps(v):
    both = T("a [x] b [X] c [x?] d [...] e … f xxx g xxxx h", v)
    assert "<gap>" in both and "<big_gap>" in both
    for text, gone in (("a x x x b x x x x c", "x x x"), ("a ... b .... c", "..."), ("a x-x-x b x- x -x c x-x-x-x d", "x-x-x")):
        assert "<big_gap>" in T(text, v) and gone not in T(text, v)
    for text in ("a {large break} b {broken area} c", "a (broken lines) b (illegible) c"):
        assert T(text, v).count("<big_gap>") == 2
    assert T("a <sup>1</sup> b", v) == "a 1 b"


def test_single_variants():
    assert [T("(d)EN", v) for v in "ABC"] == ["(d)EN", "{d}EN", "{d}EN"]
    assert [T("(TÚG)ku-ta-nu", v) for v in "ABC"] == ["(TÚG)ku-ta-nu", "{TÚG}ku-ta-nu", "{TÚG}ku ta nu"]
    assert T("A-šur a-šur", "C") == "A-šur a šur"
    assert T("a <sup>d</sup>UTU b", "B") == "a {d}UTU b"
    assert T("mu-un-<<an>>-pa3-da", "B") == "mu-un-pà-da"
    assert T("KI/DI-bi", "B") == "KI DI-bi"
    assert T("a {(1(u))} b", "B") == "a b" and T("1' a 2'' b", "B") == "a b"


def test_translation():
    assert normalize.translation("note <add> [missing] text") == "note add missing text"
    assert normalize.translation("a / b 1 / 4 3/5") == "a b 1 / 4 3/5"
    assert normalize.output("2½ shekels, 1/3 and 3minas") == "2.5 shekels, 0.3333 and 3 minas"


@pytest.mark.parametrize(("text", "wanted"), [
    ("We met Dr. Smith. He said e.g. examples.", ["We met Dr. Smith.", "He said e.g. examples."]),
    ("The value is 1.5 kg. Done.", ["The value is 1.5 kg.", "Done."]),
    ("The U.S. Army arrived. It stayed.", ["The U.S. Army arrived.", "It stayed."]),
    ('Annina will pay him the silver in Kanesh."', ["Annina will pay him the silver in Kanesh."]),
    ('Buy a .""', ["Buy a ."]), ('He said: "Hello."', ['He said: "Hello."']), (None, []),
])
def test_split(text, wanted):
    assert sentences.split(text, 1) == wanted


def test_single_sentence():
    assert sentences.single("One. Two! Three.") == "One; Two; Three."
    assert sentences.single("One 3.5. Two.", "truncate") == "One 3.5."
    assert sentences.count("A cost of 3.5... Dr. Who? Yes!!") == 3


def test_segments_by_brute_force():
    for total, lengths in ((7, [3, 4]), (9, [2, 5, 3]), (12, [1, 1, 8, 2])):
        share = align.desired(total, lengths)
        fits = lambda i, s: i == len(lengths) - 1 or min(max(1, int(share[i] * 0.25)), s) <= s <= max(max(1, int(share[i] * 0.25)), int(share[i] * 4) + 1)
        cost = lambda sizes: sum((s - d) ** 2 + 5 * max(0, 3 - s) for s, d in zip(sizes, share))
        cuts = [s for s in itertools.product(range(1, total), repeat=len(lengths)) if sum(s) == total and all(fits(i, x) for i, x in enumerate(s))]
        assert cost(align.segment_sizes(total, lengths)) == pytest.approx(min(map(cost, cuts)))


def test_lexicon():
    forms = lexicon.compiled({"GN": ["Kanesh", "great Kanesh"], "PN": ["Annina", "Kanesh"]})
    text, marks = lexicon.placeholders("Annina of great Kanesh saw Kanesh and Annina", forms)
    assert text == "<PN_1> of <GN_1> saw <PN_2> and <PN_1>"
    assert lexicon.restored(text, marks) == "Annina of great Kanesh saw Kanesh and Annina"
    assert lexicon.number_slots("10 minas, 5 minas 10.") == ("<NUM_1> <UNIT_1>, <NUM_2> <UNIT_1> <NUM_1>.", [("<NUM_1>", "10"), ("<UNIT_1>", "minas"), ("<NUM_2>", "5")])


def test_greedy_caps():
    rows = pd.DataFrame({"s": list("aaabbc"), "l": list("xyxxyy"), "k": range(6)})
    assert mixing.greedy(rows, {"s": 1, "l": 2}, 4)["k"].tolist() == [0, 3, 5, 1]
