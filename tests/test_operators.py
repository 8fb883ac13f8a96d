"""Operators over pairs, pages, slots, pools, files and streams on small cases, against plain definitions."""

import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import normalize, ocr, scores, sentences, udfs
from glyphmill.functions import text as X
from glyphmill.functions.profile import counted
from glyphmill.operators import align, candidates, gates, mixing, pages, slots
from glyphmill.operators.ordering import numbered
from glyphmill.shared import drop_shared, shared_dir, ship, write_shared
from glyphmill.sources import config, tables
from glyphmill.streaming import parts


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# ---- functions ----


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("See figs. 3 and 4 for the plan. They are clear enough to read.", ["See figs. 3 and 4 for the plan.", "They are clear enough to read."]),
        ("As Smith et al. 2004 have shown it is so. That is settled now for all.", ["As Smith et al. 2004 have shown it is so.", "That is settled now for all."]),
        ("It weighs 3 kg approx. 4 of them are lost here.", ["It weighs 3 kg approx.", "4 of them are lost here."]),
        ("One; two; three and more of it", ["One;", "two;", "three and more of it"]),
    ],
)
def test_split_abbreviations(text, wanted):
    assert sentences.split(text, 1) == wanted


def test_single_sentence_places_are_those_before():
    assert sentences.single("One... Two. Three.") == "One; Two.; hree."


def test_normalised_punctuation_and_numbers():
    assert normalize.translation("ʾalpha ‘b’ “c” x–y") == "'alpha 'b' \"c\" x-y"
    assert normalize.output("1/2. And 2 1/3 or ¾ of 5weeks, 7 ½ litres") == "0.5. And 2.3333 or 3 / 4 of 5 weeks, 7.5 litres"
    assert normalize.transliteration("a $|5 b~c@d e", "A") == "a b e"


def test_profile_by_plain_python():
    rng = random.Random(2)
    texts = [None, "", " a  b ", "The And für ÄÖ 12² x\x01", *("".join(rng.choice("aZ é9\t\n.漢 the") for _ in range(rng.randint(0, 40))) for _ in range(200))]
    got = counted(texts)
    for i, t in enumerate(t or "" for t in texts):
        assert [got[k][i] for k in ("len", "tokens", "n_alpha", "n_digit", "n_upper", "n_space")] == [len(t), len(t.split()), sum(map(str.isalpha, t)), sum(map(str.isdigit, t)), sum(map(str.isupper, t)), sum(map(str.isspace, t))]
    assert got["hits_en"][3] == 2 and got["n_control"][3] == 1


def test_text_expressions(spark):
    rows = spark.createDataFrame([("a\\nb\r\nc- \n\n\n\nwo-\nrd so­ft",)], "t string")
    r = rows.select(X.newlines(F.col("t")).alias("n"), X.ocr_text(F.col("t")).alias("o"), X.cleaner_text(F.lit("x – y’s wo- \nrd")).alias("c"), X.without_hints(F.lit("a <LEX> b=c </LEX> d")).alias("h"), X.anchor_token(F.lit("(Šùm.)")).alias("k"), X.truncated(F.lit("abcdef"), 5).alias("s"), X.pipe_list(F.lit(" a || b ")).alias("p")).first()
    assert r.n == "a\nb\nc- \n\n\n\nwo-\nrd soft" and r.o == "a\nb\nc-\n\nword soft" and r.c == "x - y's wo-\nrd"
    assert (r.h, r.k, r.s, r.p) == ("a d", "SUM", "ab...", ["a", "b"])


def test_functions_from_sql(spark):
    udfs.register(spark)
    row = spark.sql("select normalize_translation('<b>x</b>') a, split_sentences('We met Dr. Smith today. He left the old town then.') b, sentence_endings('A. B!') c, block_hash('x  y') d, single_sentence('A. B.') e, lookup_form('Ša-2 & b') f, lemma('amārum') g, gloss('1. \"to see\"; more') h, slot_text('5 minas') i, first_sentence(null) j").first()
    assert row.a == "x" and row.b == ["We met Dr. Smith today.", "He left the old town then."] and row.c == 2 and row.d == ocr.block_hash("x y") and row.e == "A; B." and row.f == "SA 2 AND B"
    assert (row.g, row.h, row.i, row.j) == ("amāru", "to see", "<NUM_1> <UNIT_1>", "")
    assert spark.sql("select transliteration_page('12 a\n{d}EN'), translation_page('FIG. 3\ntext'), pack_sentences('A b. C d.'), normalize_output('3minas'), nfkc('ﬁ'), without_line_numbers('1. a\n2 b')").first()[1] == "text"


def test_page_cleaning():
    text, stats = ocr.translation_page("FIG. 3 a plate\n12\n\n\nHe said [4] it cf. here*\n\nNo. 5 goes\n")
    assert text == "He said it . here" and stats["translation_line_noise_dropped"] == 2 and stats["translation_page_number_dropped"] == 1 and stats["translation_inline_noise_removed"] == 3
    units = ocr.unit_tokens("# head\nprose line\ngoods\tGÍN; MA.NA\tTÚG (x)\n")
    assert units == {"GÍN", "MA.NA", "TÚG"}
    text, stats = ocr.transliteration_page("1 a-na\n5' um-ma\n10 GÍN-ma KÙ\n1.5 x\nplain\n7", units)
    assert text.split("\n") == ["a-na", "um-ma", "10 GÍN-ma KÙ", "1.5 x", "plain"]
    assert (stats["line_start_total"], stats["line_start_prime"], stats["line_start_quantity_keep"], stats["line_start_ambiguous"], stats["line_start_decimal_keep"]) == (4, 1, 1, 2, 1)
    assert ocr.transliteration_page("1 a-na\nDUMU x", units, drop_ambiguous=True, strict=True)[0] == "DUMU x"
    rules = ocr.Noise.parse("# c\nDROP_LINE\t^x\tnote\nremove_inline\ty+\nother\tz\n\n")
    assert rules == ocr.Noise(("^x",), ("y+",))
    assert ocr.without_line_numbers("1 a\n2' b\n\n3. c") == "a b c" and ocr.line_reference("12''a") == (12, 2, "a") and ocr.line_reference("x")[0] == 10**9


def test_identifiers():
    assert [ocr.is_identifier(t) for t in ("BM 113", "113", "AKT 6a, 200", "BM113", "six words", "a b c d e f 7", "Kt 94 k")] == [False, False, True, True, False, False, True]
    assert ocr.lookup_tokens("Cuneiform Tablet Šú & 5b") == ["SU", "AND", "5B"] and ocr.metadata_parts("a|b; c+d\ne") == list("abcde")
    assert ocr.headword("amārum I") == ("amāru", "I") and ocr.headword("amārum") is None and ocr.gloss("1. a thing; and") == "a thing" and ocr.gloss("x" * 50, 10) == "xxxxxxx..."
    assert ocr.page_number("3.0") == 3 and ocr.page_number("x") is None and ocr.truth("Yes") and not ocr.truth(None)


# ---- alignment ----


def test_segments_by_scanning_starts():
    """Against the same recurrence with all starts tried one by one."""
    rng = random.Random(1)
    for _ in range(60):
        total, lengths = rng.randint(1, 40), [rng.randint(1, 20) for _ in range(rng.randint(2, 6))]
        share = align.desired(total, lengths)
        best, back = {0: 0.0}, []
        for i, d in enumerate(share[:-1]):
            floor = max(1, int(d * 0.25))
            top, new, how = max(floor, int(d * 4.0) + 1), {}, {}
            for k in sorted(best):
                most = min(top, total - k - (len(lengths) - 1 - i))
                for size in range(min(floor, most), most + 1) if most >= 1 else ():
                    cost = best[k] + (size - d) ** 2 + 5.0 * max(3 - size, 0)
                    if cost < new.get(k + size, float("inf")):
                        new[k + size], how[k + size] = cost, size
            best = new
            back.append(how)
        sizes = align.segment_sizes(total, lengths)
        ends = {k: c + (total - k - share[-1]) ** 2 + 5.0 * max(3 - total + k, 0) for k, c in best.items() if total - k >= 1}
        if ends:
            at = min(ends, key=lambda k: (ends[k], k))
            wanted = [total - at]
            for how in reversed(back):
                wanted.append(how[at])
                at -= wanted[-1]
            assert sizes == wanted[::-1]


def test_anchors():
    tokens = "a-na x b-na y z a-na w b-na v".split()
    hints = [align.Hint("one", "a-na", None, 1), align.Hint("two", None, "b-na", 8), align.Hint("three", "v", None, 9)]
    assert align.positions(tokens, ["a-na"]) == [0, 5] and align.positions(tokens, ["a-na", "w"], 1) == [5] and align.positions(tokens, []) == []
    found, used = align.anchors(tokens, hints, "A")
    assert found == [(0, 0), (1, 7), (2, 8), (3, 9)] and used == 2
    segments, status, used = align.anchored(tokens, ["one", "two", "three"], hints, "A")
    assert status == "anchored" and segments == [tokens[:7], tokens[7:8], tokens[8:]]
    assert align.anchored([], ["x"], hints, "A")[1] == "empty_src_tokens" and align.anchored(tokens, ["x"], hints, "A")[1] == "len_mismatch"
    assert align.anchored(tokens, ["x", "y"], [align.Hint("x"), align.Hint("y", "nowhere")], "A")[1:] == ("no_anchor", 0)


def test_documents_choose_their_better_way(spark):
    h = [{"translation": "He paid the silver to them.", "spelling": "a-na", "transcription": None, "number": 1}, {"translation": "They left the town then.", "spelling": "zu-ku", "transcription": None, "number": 5}]
    rows = [("d1", "a-na ku-bu x zu-ku ta-ni ru-ba", "He paid the silver to them. They left the town then.", h), ("d2", "a b c", "No hints are here.", None), ("d3", "q r s t u v", "Some words stand here. And others over there now.", h)]
    docs = spark.createDataFrame(rows, "oare_id string, transliteration string, translation string, hints array<struct<translation:string,spelling:string,transcription:string,number:int>>")
    out = align.chosen_rows(align.aligned_documents(docs, "A"), gates.AlignedGate(min_src_tokens=1)).orderBy("oare_id", "place").collect()
    got = {k: [(r.src_sent, r.method, r.align_meta) for r in g] for k, g in itertools.groupby(out, lambda r: r.oare_id)}
    assert [x[0] for x in got["d1"]] == ["a-na ku-bu x", "zu-ku ta-ni ru-ba"] and got["d1"][0][1] == "oare" and got["d1"][0][2].endswith("oare_selected")
    assert got["d2"][0][1:] == ("dp", "") and got["d3"][0][1] == "dp" and got["d3"][0][2] == "oare_available;oare_fallback_no_anchor"
    reasons = spark.createDataFrame([(got["d3"][0][2],), ("",)], "m string").select(align.fallback_reason(F.col("m")).alias("r")).collect()
    assert [r.r for r in reasons] == ["no_anchor", None]
    assert align.block_pairs("a b c d", "One is here now, my friend. Two is over there by it.", "A") and align.block_pairs("a", "One is here now, my friend. Two is over there by it.", "A") == []


# ---- pages ----


def test_greedy_pairs_by_scan():
    rng = random.Random(7)
    for _ in range(200):
        targets = sorted(rng.sample(range(20), 6))
        sources = [(s, [round(rng.random(), 1) for _ in targets]) for s in sorted(rng.sample(range(20), 5))]
        used, wanted = set(), []
        for s, score in sources:
            options = [(score[j], -j) for j, t in enumerate(targets) if t not in used and 0 < t - s <= 4]
            if options and max(options)[0] >= 0.3:
                t = targets[-max(options)[1]]
                used.add(t)
                wanted.append((s, t))
        assert [p[:2] for p in pages.greedy_pairs(sources, targets, 4, "src_then_tgt", 0.3)] == wanted


def test_translated_blocks(spark):
    b = spark.createDataFrame([("own  text", "h1", "en", "translation"), ("fremd", "h2", "de", "translation"), ("autre", "h3", "fr", "translation"), ("x", "h4", "en", "translit")], "block string, block_hash string, lang string, role string")
    t = tables.block_translations(spark.createDataFrame([("h2", "foreign"), ("h3", " ")], "hash string, english_text string"))
    assert sorted((r.block, r.text, r.is_translated) for r in pages.translated_blocks(b, t).collect()) == [("fremd", "foreign", True), ("own  text", "own text", False)]
    by_text = tables.block_translations(spark.createDataFrame([("ein  Block", "a block")], "raw_text string, translation_en string")).first()
    assert by_text.block_hash == ocr.block_hash("ein Block") and by_text.translation_en == "a block"


# ---- slots and hints ----


def test_placeholders_modes_and_targets():
    lexicon = {("a-šur", "ma-lik"): "PN", ("a-šur",): "PN", ("ka-ni-iš",): "GN", ("bob",): "PN"}
    text, mapping = slots.placeholders("a-šur ma-lik to ka-ni-iš saw a-šur bob", lexicon)
    assert text == "<PN_1> to <GN_1> saw <PN_2> <PN_3>" and slots.restored(text, mapping) == "a-šur ma-lik to ka-ni-iš saw a-šur bob"
    assert slots.placeholders("a-šur ma-lik bob ka-ni-iš", lexicon, "strict")[0] == "<PN_1> bob <GN_1>"
    assert slots.placeholders("a-šur bob", lexicon, "pattern")[0] == "<PN_1> bob"
    assert slots.mapped_target("then a-šur ma-lik and bob a-šur", mapping) == "then <PN_1> and <PN_3> <PN_2>"
    assert slots.loaded(slots.dumped(mapping)) == mapping and slots.loaded("{bad") == [] and slots.loaded(None) == []


def test_slots_round_trip():
    s = slots.Slots(names={("Aššur", "Malik"): 1, ("Kaneš",): 1})
    text, mapping = slots.slotted("“Aššur Malik”, 5 minas for Kaneš; 5 shekels 2₂ <gap> <LEX> a=b </LEX>", s)
    assert text == '"<PN_1>", <NUM_1> <UNIT_1> for <PN_2>; <NUM_1> <UNIT_2> <NUM_2> <gap>'
    assert slots.filled(text, mapping) == '"Aššur Malik", 5 minas for Kaneš; 5 shekels 22 <gap>'
    assert slots.slotted_target("To (Aššur Malik) 5 minas.", mapping, s) == "To (<PN_1>) <NUM_1> <UNIT_1>."
    assert slots.filled("<PN_1> <PN_9>", {"<PN_1>": "x"}, {"<PN_9>": "y"}) == "x y" and slots.slot_counts(text) == {"pn": 2, "num": 3, "unit": 2}


def test_hints():
    lexicon = slots.gloss_lexicon([{"type": "word", "lexeme": "amārum", "I_IV": "I", "form": "a-mur", "norm": "āmur"}, {"type": "word", "lexeme": "kaspum", "I_IV": "", "form": "kas-pu", "norm": ""}, {"type": "PN", "lexeme": "x", "form": "y"}])
    known = slots.dictionary([{"word": "amāru I", "definition": '"to see, find" (G)'}, {"word": "kaspu II", "definition": "2. silver; money"}, {"word": "amāru I", "definition": "second"}, {"word": "none", "definition": "x"}])
    g = slots.Gloss(lexicon, known)
    assert slots.hinted("a-mur  kas-pu x a-mur", g) == "a-mur kas-pu x a-mur <LEX> amāru=to see, find | kaspu=silver </LEX>"
    assert slots.hinted("x y", g) == "x y" and slots.hinted("kas-pu", slots.Gloss(lexicon, known, {"kaspu": 9}, 3)) == "kas-pu"
    assert slots.setting({"a": None}, None, {"a": 2}, name="a") == 2 and slots.setting({}, name="b", default=1) == 1


def test_lexicon_forms(spark):
    rows = spark.createDataFrame([("PN", " b  c "), ("pn", "a"), ("GN", "z"), ("x", "q"), ("PN", None)], "type string, form string")
    assert slots.forms(rows, ["PN", "GN"]) == {"PN": ["a", "b c"], "GN": ["z"]}


# ---- pools and scores ----


def test_sentence_scores():
    assert scores.bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(100) and scores.chrf("abc", "abc") == pytest.approx(100)
    assert scores.bleu("a b", "a b") == 0 and scores.bleu("x y z w v", "a b c d e") == 0 and scores.chrf("", "x") == 0
    # one of four orders without a match: 5/6, 3/5, 1/4, then 1/(2*3)
    assert scores.bleu("the cat sat on a mat", "the cat sat in a mat") == pytest.approx(100 * (5 / 6 * 3 / 5 * 1 / 4 * 1 / 6) ** 0.25)
    assert scores.words('"Hi, you".') == ['"', "Hi", ",", 'you"', "."] or scores.words("Hi, you.") == ["Hi", ",", "you", "."]
    assert scores.tokens_13a("1,000 is 3.5, no?") == ["1,000", "is", "3.5", ",", "no", "?"]


def test_corpus_scores_are_those_of_summed_statistics(spark):
    from glyphmill.operators import metrics

    rows = [("the cat sat on the mat", "the cat sat on a mat, so"), ("he went away then", "he went far away then"), ("(yes, 3.5)", "yes 3.5")]
    got = metrics.corpus_scores(spark.createDataFrame(rows, "h string, r string"), "h", "r").first()
    sums = [[sum(x) for x in zip(*s)] for s in zip(*(scores.chrf_statistics(h, r) for h, r in rows))]
    parts_ = [scores.bleu_statistics(h, r) for h, r in rows]
    bleu = scores.bleu_of([[sum(x) for x in zip(*s)] for s in zip(*(p[0] for p in parts_))], sum(p[1] for p in parts_), sum(p[2] for p in parts_))
    assert got.chrf == pytest.approx(scores.chrf_of(sums)) and got.bleu == pytest.approx(bleu) and got.gm == pytest.approx((got.bleu * got.chrf) ** 0.5)
    assert metrics.corpus_scores(spark.createDataFrame([("a", " ")], "h string, r string"), "h", "r").first().gm is None


def test_statistics_are_summed_before_the_shuffle(spark):
    from glyphmill.operators import metrics

    rows = [("a b\tc 😀", "a  b c"), ("", None), (None, "xyzxyz"), ("xyzxyzxyz", "xyz")] * 5
    df = spark.createDataFrame(rows, "h string, r string")
    s = metrics.summed_statistics(df, metrics.chrf_kinds("h", "r") | metrics.bleu_kinds("h", "r"))
    got = {(r.kind, r.n): (r.matches, r.n_hyp, r.n_ref) for r in s.collect()}
    flat = lambda each: [tuple(map(sum, zip(*x))) for x in zip(*each)]
    want = dict(zip([*[("char", n) for n in range(1, 7)], ("word", 1), ("word", 2)], flat([scores.chrf_statistics(h, r) for h, r in rows])))
    want |= dict(zip([("bleu", n) for n in range(1, 5)], flat([scores.bleu_statistics(h, r)[0] for h, r in rows])))
    assert got == {k: v for k, v in want.items() if v[1] or v[2]}
    # no row for each n-gram is made
    assert "Generate" not in s._jdf.queryExecution().toString()


def test_mbr_by_brute_force(spark):
    rng = random.Random(4)
    words = "he paid the silver to them in town and left".split()
    pool = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(2, 6)))) for i in range(6) for _ in range(8)] + [(9, "alone"), (8, "x y z"), (8, "x y z")]
    got = {r.id: (r.translation, r.utility) for r in candidates.mbr_choice(spark.createDataFrame(pool, "id long, translation string")).collect()}
    for i in {p[0] for p in pool}:
        own = [t for k, t in pool if k == i]
        mean = {t: round(sum(scores.chrf(t, r) for r in own) / len(own), 9) for t in set(own)}
        wanted = min(mean, key=lambda t: (-mean[t], -own.count(t), len(t), t))
        assert got[i][0] == wanted and got[i][1] == pytest.approx(mean[wanted] if len(mean) > 1 else 0.0)
    many = spark.createDataFrame([(1, f"w{k} x y") for k in range(90)] + [(1, "w1 x y")] * 30, "id long, translation string")
    assert candidates.mbr_choice(many).first().translation.endswith("x y")


def test_pools(spark):
    pool = spark.createDataFrame([("a", "x", "t", 2, 0, 1.0), ("a", "y", "t", 1, 1, None), ("a", "x", "u", 3, 2, 5.0), ("b", "z", "u", 4, 3, float("nan"))], "id string, translation string, tag string, rank int, row int, fwd double").withColumn("rev", F.lit(0.5))
    assert candidates.distinct_candidates(pool).count() == 3 and sorted((r.id, r.translation, r.mass) for r in candidates.pooled(pool).collect()) == [("a", "x", 2), ("a", "y", 1), ("b", "z", 1)]
    assert sorted((r.tag, r.id, r.translation) for r in candidates.tag_first(pool).collect()) == [("t", "a", "y"), ("u", "a", "x"), ("u", "b", "z")]
    best = {(r.weight, r.id): (r.translation, r.total) for r in candidates.noisy_channel(pool, [0.0, 1.0]).collect()}
    assert best[0.0, "a"] == ("x", 0.5) and best[1.0, "a"] == ("x", 5.5) and best[1.0, "b"] == ("z", float("-inf"))
    gold = spark.createDataFrame([("a", "y"), ("c", "q")], "id string, translation string")
    assert {(r.id, r.translation) for r in candidates.oracle_choice(pool, gold).collect()} == {("a", "x"), ("c", "")} or {(r.id, r.translation) for r in candidates.oracle_choice(pool, gold).collect()} == {("a", "y"), ("c", "")}
    assert candidates.postprocessed("A  b. C d.") == "A b; C d." and candidates.postprocessed("A. B.", "truncate") == "A."
    both = candidates.restored_side_by_side(spark.createDataFrame([("<PN_1> x", "<PN_1>", json.dumps([{"placeholder": "<PN_1>", "text": "Bob"}]))], "h string, r string, m string"), "h", "r", "m").first()
    assert (both.h_restored, both.r_restored) == ("Bob x", "Bob")
    assert [r.translation for r in candidates.baseline(spark.createDataFrame([("1", "A b. C.")], "id string, transliteration string")).collect()] == ["A b."]


def test_memory_candidates(spark):
    memory = spark.createDataFrame([(1, "a-na 5 minas ku-bu", "pay 5 minas now"), (2, "zz yy xx", "other"), (3, "a-na 7 minas ku-bu", "same slots")], "row long, src string, tgt string")
    queries = spark.createDataFrame([("q", "a-na 9 shekels ku-bu ru")], "id string, src string")
    rows = candidates.memory_candidates(queries, memory, 2).orderBy("rank").collect()
    assert [(r["rank"], r.translation, r.slot_match_num, r.slot_match_unit) for r in rows] == [(1, "pay 9 shekels now", 1, 1), (2, "same slots", 1, 1)]
    assert candidates.pseudo_labels(queries, memory, 0.1).first().translation in ("pay 5 minas now", "same slots")


def test_greedy_mix_under_two_caps(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.choice("xyz"), rng.choice("pqr")) for k in range(60)]
    got = {t: {r.k for r in g} for t, g in itertools.groupby(mixing.select_greedy(spark.createDataFrame(rows, "k long, t string, s string, l string"), "t", ["k"], {"s": 3, "l": 4}, 0.4).orderBy("t").collect(), lambda r: r.t)}
    for t in "ab":
        own = [r for r in rows if r[1] == t]
        want, s, l, kept, rest = round(len(own) * 0.4), {}, {}, [], []
        for r in own:
            if len(kept) < want and s.get(r[2], 0) < 3 and l.get(r[3], 0) < 4:
                s[r[2]], l[r[3]] = s.get(r[2], 0) + 1, l.get(r[3], 0) + 1
                kept.append(r[0])
            else:
                rest.append(r[0])
        assert got[t] == set(kept + rest[: want - len(kept)])


# ---- files ----


def test_configurations(tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.toml").write_text("x = 2\n")
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "f.csv").write_text("x\n")
    assert config.load_config(tmp_path / "a.json") == {"x": 1} and config.load_config(tmp_path / "b.toml") == {"x": 2} and config.load_config(None) == {}
    for bad, error in (("none.json", FileNotFoundError), ("data/f.csv", ValueError)):
        with pytest.raises(error):
            config.load_config(tmp_path / bad)
    assert config.flat_yaml("# c\na: 1\nb: 'x y'\nc: ~\nd: true\ne: 1.5\nf: text\nnothing\n") == {"a": 1, "b": "x y", "c": None, "d": True, "e": 1.5, "f": "text"}
    assert config.optional_number("3.0", int) == 3 and config.optional_number(" ") is None and config.number("3.0", 7, int) == 7 and config.first_number([None, "x", "4.2"], 0) == 4
    assert config.frequency_limit("0.9") == 0.9 and config.frequency_limit("2") == 2 and config.gram_range("3,5") == (3, 5) and config.ratio_map("T1=.08,T2=x,T3= 1") == {"T1": 0.08, "T3": 1.0}
    assert config.pick(["b", "c"], ("a", "c", "b")) == "c" and config.comma_list(" a, ,b") == ["a", "b"] and config.root(tmp_path / "data") == tmp_path and config.folder("data", {}, start=tmp_path) == tmp_path / "data"
    assert config.resolved("f.csv", tmp_path / "data") == tmp_path / "data" / "f.csv"


def test_csv_round_trip_keeps_ends_and_nulls(spark, tmp_path):
    from glyphmill.plans import files

    texts = ["  two \t", "\n", "\x01a\x1f", "", None, '"', ' "a", b\r\n', "\0,\n\0", "a\0"]
    df = spark.createDataFrame([(k, t, t and t[:2], None if k % 2 else "") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    want = df.selectExpr("doc_id", "lang", "source", "md5(regexp_replace(text, '\\r\\n?', '\n')) as text_md5")
    mine = files.csv_round_trip(spark, f"file://{tmp_path}")
    assert want.count() == mine.count() and want.exceptAll(mine).count() == 0


def test_hits_of_many_entries_of_one_form(spark, monkeypatch):
    n = 400
    texts = spark.createDataFrame([(k, f"a red bolt of size {k % 3} and {'more ' * 50}") for k in range(n)] + [(n, None)], "page long, text string")
    titles = spark.createDataFrame([(k, f"red bolt {k % 2}") for k in range(n)], "page long, title string")
    entries = spark.createDataFrame([(k, f"Red bolt {k % 3}", f"B{k % 2}") for k in range(n)], "entry long, name string, brand string")
    keys = pages.catalogue_keys(entries, "entry", {"name": F.col("name"), "brand": F.col("brand")}).cache()
    args = (texts, titles, keys, "page", "text", "title", ("brand",))
    whole = pages.hits(*args)
    part = pages.hits(*args, top=5)
    # of 400 entries with 5 forms, each page meets those of its own and its title's alone; 5 of each form are enough for its first five
    assert part.count() < 12 * n < whole.count()
    got = pages.hit_summary(part).orderBy("page").collect()
    assert got == pages.hit_summary(whole).orderBy("page").collect() and len(got) == n
    assert got[0].entries == "0|3|6|9|12" and (got[0].top_score, got[0].n_page, got[0].n_title) == (1.9, 5, 5)
    monkeypatch.setattr(pages, "FORMS", 2)
    assert pages.hits(*args, top=5).exceptAll(part).count() == 0
    tree = pages.forms_tree([(7, ["A", "B"]), (8, ["B"]), (9, ["A", "C"])])
    assert sorted(pages.forms_within({"A", "B", "X"}, tree)) == [7, 8] and pages.forms_within(set(), tree) == []


def test_segments_of_long_documents():
    rng = random.Random(6)
    lengths = [rng.randint(1, 400) for _ in range(400)]
    sizes = align.segment_sizes(200_000, lengths)
    # near the shares, in time and memory that don't grow with the square of the tokens
    share = align.desired(200_000, lengths)
    assert sum(sizes) == 200_000 and max(abs(s - d) for s, d in zip(sizes, share)) < 5


def test_normalisers_of_long_texts():
    text = "He went (d.) away, see fig. " * 40_000
    once = sentences.single(text)
    assert once.count("fig. He") == 39_999 and once.count("(d; )") == 39_999
    assert sentences.word_before("see (e.g)', ", 11) == "(e.g" and sentences.word_before("longer", 6) == "onger" and sentences.word_before(") ", 2) == ""
    rng = random.Random(8)
    for _ in range(2000):
        t = "".join(rng.choice("xX (){}[]<>.-d mul’–²₂š1/KI\n") for _ in range(rng.randint(0, 40)))
        assert normalize.transliterations(t) == tuple(normalize.transliteration(t, v) for v in "ABC")
    assert normalize.transliterations(None) == ("", "", "") and normalize.punctuation("a–b ‘c’ “d„") == "a-b 'c' \"d\""


def test_scorecards_of_all_modes_in_one_pass(spark):
    ship(spark)
    rng = random.Random(9)
    words = ["Ali", "a-b-c-long", "x", "old", "a", "b", "{d}x", "ab-cde"]
    texts = [None, ""] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    known = {("Ali",): "PN", ("a", "b"): "GN", ("a",): "PN", ("a-b-c-long",): "PN", ("ab-cde",): "PN", ("{d}x", "old"): "GN"}
    s = slots.scorecards(spark.createDataFrame([(t,) for t in texts], "text string"), "text", known, ("all", "strict", "pattern"), frozenset({"a", "Ali"}))
    assert s._jdf.queryExecution().toString().count("MapInArrow") <= 4
    for r in s.collect():
        names = [[m["text"].split() for m in slots.placeholders(t, known, r["mode"])[1]] for t in texts]
        n = sum(map(len, names))
        assert r["rows"] == len(texts) and r.coverage == pytest.approx(sum(map(bool, names)) / len(texts)) and r.per_row == pytest.approx(n / len(texts))
        assert r.common_rate == pytest.approx(sum(all(w in ("a", "Ali") for w in x) for row in names for x in row) / n)
        assert r.short_rate == pytest.approx(sum(len(x) == 1 and len(x[0]) <= 3 for row in names for x in row) / n)


def test_page_scores_read_blocks_once(spark):
    rows = [(1, "translation", "en", 0.5), (1, "translation", "de", 0.9), (1, "translation", "de", 0.7), (1, "translit", "fr", 0.0), (2, None, "fr", 0.3), (3, "translation", "fr", 0.2)]
    b = spark.createDataFrame(rows, "page long, role string, lang string, translation_score double").selectExpr("*", "lang = 'en' as english", "0.1D as english_score", "0.4D as translit_score")
    s = pages.page_scores(b, "page")
    assert "Join" not in s._jdf.queryExecution().toString()
    got = {r.page: r for r in s.collect()}
    assert (got[1].n_blocks, got[1].n_english, got[1].n_translation, got[1].n_foreign, got[1].n_translit) == (4, 1, 3, 2, 1)
    assert (got[1].lang_counts, got[1].lang_top, got[1].translation_best, got[1].foreign_best, got[1].translit_best, got[1].english_best) == ("de:2|en:1", "de", 0.9, 0.9, 0.4, 0.1)
    assert (got[2].lang_counts, got[2].lang_top, got[2].translation_best, got[2].n_blocks) == ("", "unknown", 0.0, 1) and got[3].lang_top == "fr"


def test_files(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    df = spark.createDataFrame([(1, 'a "b"\nc, d', None), (2, "", "x")], "n long, t string, u string")
    tables.write_table(df, at("x.csv"))
    back = tables.read_table(spark, at("x.csv"), types=False)
    assert [tuple(r) for r in back.orderBy("n").collect()] == [("1", 'a "b"\nc, d', ""), ("2", "", "x")] and tables.columns_of(spark, at("x.csv")) == ["n", "t", "u"]
    with pytest.raises(FileNotFoundError, match="gold"):
        tables.read_table(spark, at("absent.csv"), "gold")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("__MACOSX/a.csv", "no")
        z.writestr("b.csv", 'p,q\n1,"x\ny"\n')
    assert [tuple(r) for r in tables.read_table(spark, at("z.zip")).collect()] == [("1", "x\ny")]
    (tmp_path / "s.txt").write_text("a\nb\n")
    (tmp_path / "t.txt").write_text("c\nd\n")
    assert [tuple(r) for r in tables.parallel_lines(spark, at("s.txt"), at("t.txt")).orderBy("line").collect()] == [(0, "a", "c"), (1, "b", "d")]
    (tmp_path / "u.txt").write_text("c\n")
    with pytest.raises(ValueError, match="lines"):
        tables.parallel_lines(spark, at("s.txt"), at("u.txt"))
    for k in (3, 4):
        df.where(F.col("n") == k - 2).select("n").toPandas().to_parquet(tmp_path / f"run-part-{k:04d}.parquet")
    assert sorted((r.n, r.part) for r in tables.read_parts(spark, at("run.parquet")).collect()) == [(1, 3), (2, 4)]
    assert tables.write_part(df, at("parts"), 1) and not tables.write_part(df, at("parts"), 1) and tables.write_part(df, at("parts"), 1, overwrite=True)
    tables.append_csv(df, at("log"))
    tables.append_csv(df, at("log"))
    assert spark.read.options(**tables.CSV).csv(at("log")).count() == 4
    for fold in (0, 1):
        (tmp_path / "m" / "variant=A" / f"fold={fold}").mkdir(parents=True)
        (tmp_path / "m" / "variant=A" / f"fold={fold}" / "metrics.json").write_text(json.dumps({"bleu": fold + 0.5, "fold": "7"} if fold else {"bleu": 0.5}))
    assert sorted((r.variant, r.fold, r.bleu) for r in tables.read_metrics(spark, at("m")).collect()) == [("A", "0", 0.5), ("A", "7", 1.5)]
    tables.write_json(spark, at("side.json"), {"b": 1, "a": df.where("n = 1").select("n").first()})
    assert json.loads((tmp_path / "side.json").read_text()) == {"a": [1], "b": 1}


def test_predictions_and_index(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "p.csv").write_text("first one\nsecond\n")
    ids = spark.createDataFrame([("i1",), ("i2",)], "id string").coalesce(1)
    assert sorted(map(tuple, tables.read_predictions(spark, at("p.csv"), ids).collect())) == [("i1", "first one"), ("i2", "second")]
    with pytest.raises(ValueError, match="3 ids"):
        tables.read_predictions(spark, at("p.csv"), spark.range(3).selectExpr("cast(id as string) as id"))
    sent = tables.write_submission(spark.createDataFrame([("i1", "A b. C d.")], "id string, translation string"), at("sub"))
    assert [tuple(r) for r in sent.collect()] == [("i1", "A b; C d.")] and {tuple(r) for r in tables.realigned(sent, ids).collect()} == {("i1", "A b; C d."), ("i2", "")}
    from glyphmill.operators import retrieval

    m = spark.createDataFrame([(1, "abc abd", "x"), (2, "zzz", "y")], "row long, src_sent string, tgt_sent string")
    w, idf = retrieval.tfidf(m, "row", "src_sent")
    tables.write_index(at("index"), w, idf, m, {"low": 3})
    w2, idf2, meta, settings = tables.read_index(spark, at("index"))
    assert settings == {"low": 3} and meta.columns == ["row", "src", "tgt"] and w2.count() == w.count() and idf2.count() == idf.count()
    c = tables.normalised_candidates(spark.createDataFrame([(1, "t", 0.5)], "ID int, pred string, score double"), "oid", "file")
    assert [tuple(r) for r in c.collect()] == [("1", "t", "file", 0.5)]
    assert tables.with_ids(spark.createDataFrame([("x",), ("y",)], "t string").coalesce(1)).orderBy("id").collect()[1] == ("y", "1") and tables.ordered(c, ["score", "nope"]).columns[0] == "score"


def test_stream_goes_on_where_it_was(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = lambda pairs: spark.createDataFrame(pairs, "src string, tgt string").write.mode("append").parquet(folder)
    rows([("a", "b"), ("a", "b"), ("c", "d")])
    assert parts.distinct_pairs(spark, folder, "src string, tgt string", "src", "tgt", out).count() == 2
    rows([("a", "b"), ("e", "f")])
    found = parts.distinct_pairs(spark, folder, "src string, tgt string", "src", "tgt", out)
    assert sorted((r.src, r.tgt) for r in found.collect()) == [("a", "b"), ("c", "d"), ("e", "f")]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.k, r.n) for r in parts.counted_by_window(events, "t", "k").collect()) == [("a", 2), ("b", 1)]


def test_shared_tables(spark, monkeypatch):
    t = write_shared(spark.range(5), "t")
    assert t.count() == 5
    drop_shared(t)
    with pytest.raises(Exception, match="(?i)not exist|not_exist|file"):
        t.count()

    class Fake:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Fake())


def test_numbering_spreads_rows_that_are_alike(spark):
    df = spark.range(100_000).selectExpr("1 as k", "id")
    rows, n = numbered(df, ["k"])
    assert n == 100_000 and rows.agg(F.count_distinct("row_number")).first()[0] == n


# ---- reports ----


def test_reports(spark):
    from glyphmill.operators import reports

    t = spark.createDataFrame([(1, "a b"), (2, "a  B"), (3, ""), (4, None), (5, "x x x x\x01")], "id long, t string")
    p = reports.text_profile(t, "t").first()
    assert (p.rows, p.empty_rate, p.control_rate, p.low_unique_rate, p.tokens_p50) == (5, 0.4, 0.2, 0.0, 2.0) or p.low_unique_rate == 0.2
    assert {(r.id, r.template_count, r.template_rank) for r in reports.templates(t.where("id < 3"), "t").collect()} == {(1, 2, 1), (2, 2, 1)}
    assert reports.examples(t, "id", 2).count() == 2 and reports.marked(t.selectExpr("id", "if(id = 1, 'Yes', 'no') as has_akkadian")).count() == 1
    assert [r.doc_pos for r in reports.position(t.selectExpr("1 as d", "id"), "d", "id").orderBy("id").collect()] == [0, 1, 2, 3, 4]
    f = spark.createDataFrame([("a", "x"), ("b", " "), ("c", None)], "k string, flags string")
    assert reports.flagged_only(f).count() == 1 and reports.flagged_only(f, False).count() == 2
    w = reports.normalisation_warnings(spark.createDataFrame([("[x x] KÙ.BABBAR 1' a", "gap a 1'")], "r string, n string"), "r", "n", "B")
    assert {r.warning for r in w.collect()} == {"gaps are not marked", "gaps without brackets", "line numbers are left", "dotted tokens are lost", "capitals are lost"}
    o = reports.outliers(spark.createDataFrame([("d", 9.0), ("d", 1.0), ("e", 1.0), ("f", 0.0)], "doc string, len_ratio double"), gates.AlignedGate(), "doc", 5)
    assert [(r.doc, r.outlier) for r in o.collect()] == [("f", 1e9), ("d", 1.8)]
    assert {r.counter: r.n for r in reports.page_counters(spark.createDataFrame([("12\nFIG. 3\nx",)], "t string"), "t").collect()}["translation_lines_total"] == 3


def test_translation_jobs(spark):
    from glyphmill.operators import reports

    text = "Der Mann und die Frau sind mit dem Hund in das alte Haus am Rand der Stadt gegangen"
    rows = [("p1", 1, 0, text, "blocks_only", 0.0), ("p1", 2, 0, text + " ", "metadata_and_blocks", 1.0), ("p0", 9, 3, "The man and the woman were in the old house with the dog at the edge of the town", "x", 0.0)]
    blocks = pages.classified(spark.createDataFrame(rows, "pdf_name string, page long, nth int, block string, candidate_reason string, metadata_top_score double"))
    jobs = reports.translation_jobs(blocks)
    (j,) = jobs.collect()
    assert (j.lang, j.lang_name, j.occurrences, j.page, j.candidate_reasons, j.metadata_top_score_max) == ("de", "German", 2, 1, "blocks_only|metadata_and_blocks", 1.0) and text in j.translation_prompt and j.block_hash == ocr.block_hash(text)
    assert reports.open_jobs(jobs, ["de"], each=1).count() == 1 and reports.open_jobs(jobs, ["fr"]).count() == 0
    done = jobs.withColumn("r", reports.job_result(F.lit("English:  The  man"), F.lit(None).cast("string"), "m")).drop("translation_en").select("*", "r.*")
    assert (done.first().translation_en, done.first().translation_model, done.first().translation_error) == ("The man", "m", "")
    assert [tuple(r) for r in reports.job_report(done).collect()] == [("de", 1, 0, ["The man"])]
    assert jobs.select(reports.job_result(F.lit(" "), F.lit(None).cast("string"), "m").alias("r")).first().r.translation_error == "empty output"
