"""Markup, leaked passages, mixtures and languages."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlattice.llm import language, leakage, mixing
from rowlattice.llm.text import plain, without_templates, words

# -- text -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("markup", "wanted"),
    [
        ("a {{b|{{c}}}} d", "a d"),
        ("a }} b {{ c {{d}} e", "a b c e"),
        ("x<!-- y -->z <ref name=q>no</ref> <ref a/>w <b>bold</b>", "x z w bold"),
        ("[[A (b1)|one]] [[two]] [[Category:C]] [[fr:D]] [http://x.y label]", "one two label"),
        ("''it'' '''is''' a&nbsp;&amp; b", "it is a b"),
        ("{| class=\"w\"\n|-\n| one two\n|-\n| align=right|three || four\n|}", "one two three four"),
        ("café pl­ace Ａ", "café place a"),
        ("== Head ==\ntext __NOTOC__", "text"),
        ("", ""),
    ],
)
def test_words_of_markup(markup, wanted):
    assert words(markup) == wanted.split()


def test_templates_in_linear_time():
    deep = "{{a" * 50_000 + "x" + "}}" * 50_000
    assert without_templates(f"start {deep} end") == "start  end"
    assert len(without_templates("{{" * 100_000)) == 200_000


def test_tables_can_be_left_out():
    assert plain("a\n{|\n| cell\n|}\nb", tables=False).split() == ["a", "b"]


# -- leakage -----------------------------------------------------------------------------

SHARED = "read the passage below and then answer the question now please"


def sentence(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    items = [(i, SHARED.split() + sentence(rng, 90)) for i in range(40)]
    docs, wanted = [], set()
    for d in range(400):
        text = sentence(rng, 120)
        what = rng.random()
        i = rng.randrange(40)
        own = items[i][1]
        if what < 0.1:  # all of it
            text[50:50] = own
            wanted.add((d, i))
        elif what < 0.2:  # a part, with small edits
            part = own[15:85]
            for at in range(8, 70, 14):
                part[at] = rng.choice(["changed", ""])
            text[30:30] = [w for w in part if w]
            wanted.add((d, i))
        elif what < 0.3:  # in two long passages
            text[20:20] = own[5:50]
            text[90:90] = own[52:98]
            wanted.add((d, i))
        elif what < 0.4:  # only the instruction, or a short piece
            text[10:10] = rng.choice([own[:25], own[40:60]])
        docs.append((d, " ".join(text)))
    return docs, [(i, " ".join(t).upper()) for i, t in items], wanted


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "a", 1.0) for x in docs], "doc_id long, text string, item_id string, share double")
    i = spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, doc_id string")
    return leakage.leaked_items(d, i, **more)


def share_of(item, document):
    """The contained share by comparing the whole texts."""
    return leakage.contained_share(item, leakage.equal_runs(item, document, leakage.RUN))


def all_pairs(docs, items):
    """Verification of every pair, without any filter."""
    block = leakage.Block(items)
    got = set()
    for d, text in docs:
        ids = np.array([block.vocabulary.get(w, -1) for w in words(text)], np.int32)
        got |= {(d, block.items[i]) for i, w in enumerate(block.words) if share_of(w, ids) >= 0.45}
    return got


@pytest.mark.parametrize("block_bytes", [leakage.BLOCK_BYTES, 4_000])
def test_leaks_are_found(spark, corpus, block_bytes):
    docs, items, wanted = corpus
    found = leaks(spark, docs, items, block_bytes=block_bytes).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted
    assert len(found) == len(wanted)


def test_verification_agrees_with_all_pairs(corpus):
    docs, items, wanted = corpus
    assert all_pairs(docs, items) == wanted


@pytest.mark.parametrize("every", [0, 7, 8, 9, 10, 13, 20])
def test_leaks_with_edits_against_all_pairs(spark, every):
    """Passages of 40 to 60 % of an item with one edit in ``every`` words: 0 to 14 %."""
    rng = random.Random(every)
    items = [(i, sentence(rng, rng.choice([12, 25, 60, 100, 240]))) for i in range(60)]
    docs = []
    for d in range(240):
        own = items[rng.randrange(60)][1]
        n = len(own) if len(own) < 30 else int(len(own) * rng.uniform(0.4, 0.6))
        start = rng.randrange(len(own) - n + 1)
        part = own[start : start + n]
        for at in range(every - 1, len(part), every) if every else ():
            part[at] = rng.choice([f"x{d}", "", part[at] + " new"])
        docs.append((d, " ".join([*sentence(rng, 30), *(w for w in part if w), *sentence(rng, 200)])))
    items = [(i, " ".join(t)) for i, t in items]
    wanted = all_pairs(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in leaks(spark, docs, items).collect()} == wanted
    assert len(wanted) > 100 or every == 7


def test_leaks_in_real_markup_against_all_pairs(spark, sf_dir):
    from rowlattice.llm.queries import p6_found

    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("eval_items", "item_id")))
    wanted = all_pairs([(d, t or "") for d, t in docs], items)
    assert {tuple(r) for r in p6_found(spark, sf_dir).collect()} == wanted and wanted


def test_many_items_are_looked_for_in_one_pass(spark, monkeypatch):
    passes = []
    read = leakage.materialize
    monkeypatch.setattr(leakage, "materialize", lambda frame: passes.append(1) or read(frame))
    rng = random.Random(3)
    items = [(i, " ".join(sentence(rng, 100))) for i in range(20_000)]
    found = leaks(spark, [(1, items[7][1]), (2, "nothing of it")], items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 7)] and passes == [1]


def test_the_filter_loses_no_pair_that_passes(spark):
    item = [f"w{i}" for i in range(100)]
    edited = [w if i % 8 or not i else f"x{i}" for i, w in enumerate(item[:48])][1:]
    refrain = ["la"] * 60 + [f"v{i}" for i in range(60)]
    texts = {"edits": edited, "refrain": refrain[:60] + ["other"] * 20}
    frames = [spark.createDataFrame([(k, " ".join(v)) for k, v in d.items()], f"{n} string, text string") for n, d in (("doc_id", texts), ("item_id", {"edits": item, "refrain": refrain}))]
    found = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(*frames).collect()}
    assert found == {("edits", "edits"), ("refrain", "refrain")}


def test_a_verified_pair_has_the_shingles_needed():
    rng = np.random.default_rng(5)
    passed = 0
    for _ in range(3000):
        item = rng.integers(0, rng.choice([4, 30, 1000]), int(rng.integers(1, 130))).astype(np.int32)
        start = int(rng.integers(0, max(1, len(item) // 2)))
        document = list(item[start : start + int(rng.integers(len(item) // 3 + 1, len(item) + 1))])
        for at in range(len(document) - 1, -1, -int(rng.integers(3, 12))):
            kind = rng.integers(3)
            document[at : at + int(kind > 0)] = [2000 + at] * int(kind < 2)
        document = np.array(document, np.int32)
        if share_of(item, document) >= 0.45:
            passed += 1
            size = leakage.shingle_size(len(item))
            own, times = np.unique(leakage.codes(item, size), return_counts=True)
            assert np.isin(own, leakage.codes(document, size)).sum() >= leakage.need_of(times, len(item), 0.45)
            assert len(document) >= math.floor(leakage.DENSE * max(0.45 * len(item), min(leakage.LONG, len(item))))
    assert passed > 500


def test_leaks_in_odd_texts(spark):
    long = " ".join(f"x{i % 977}y{i}" for i in range(60_000))
    item = " ".join(f"q{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, "{{only markup}}"), (4, long + " " + item), (5, item), (5, item), (6, "a b")]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "a b")]
    got = Counter((r["doc_id"], r["item_id"]) for r in leaks(spark, docs, items).collect())
    assert got == {(4, 1): 2, (5, 1): 4, (6, 4): 1}
    named = leakage.leaked_items(spark.createDataFrame([("d", item)], "doc_id string, text string"), spark.createDataFrame([(7, item), (None, item + " more")], "item_id int, text string"))
    assert sorted(tuple(r)[:2] for r in named.collect() if r["item_id"]) == [("d", 7)] and named.count() == 2
    assert leaks(spark, [], items).collect() == []
    assert leaks(spark, docs, []).collect() == []


# -- mixtures -------------------------------------------------------------------------------


def test_pieces_do_not_change_the_tokens():
    rng = random.Random(1)
    encode = mixing.encoder(mixing.VOCABULARY, mixing.PATTERN).encode_ordinary
    text = "".join(rng.choice(["word ", "12 ", "  \n", "é", ", ", " 'll "]) for _ in range(100_000))
    parts = list(mixing.pieces(text))
    assert "".join(parts) == text and max(map(len, parts)) <= mixing.PIECE + 10
    assert sum(len(encode(p)) for p in parts) == len(encode(text))


@pytest.mark.parametrize("stretch", ["a" * 30_000, "=" * 30_000, "文字" * 9_000 + "。" + "字" * 9_000, " " * 30_000, "x1" * 10_000, "don't'll" * 4_000, "a\u0301'" * 5_000])
def test_tokens_of_stretches_without_blanks_are_exact(monkeypatch, stretch):
    encode = mixing.encoder(mixing.VOCABULARY, mixing.PATTERN).encode_ordinary
    monkeypatch.setattr(mixing, "PIECE", 1_000)
    text = "before " + stretch + " and after " * 300
    parts = list(mixing.pieces(text))
    assert "".join(parts) == text and len(parts) > 1
    assert [t for p in parts for t in encode(p)] == encode(text)


@pytest.mark.parametrize(("rate", "cap"), [(0.3, 1), (1.0, 1), (0.5, 4), (2.5, 3), (3.999, 4), (4.0, 4), (9.0, 4), (0.0, 3), (1.0, 0), (5.0, 500)])
def test_mean_copies_are_the_rate(rate, cap):
    whole, below = mixing.whole_and_thresholds(rate, cap)
    assert whole + len(below) <= cap
    assert list(below) == sorted(below)
    assert whole + sum(1 - c for c in below) == pytest.approx(min(rate, cap) if cap else 0, rel=1e-5)


@pytest.mark.parametrize("rate, cap", [(0.7, 50), (3.2, 60), (900.0, 2_000), (50_000.0, 10**6)])
def test_copies_are_poisson_counts(rate, cap):
    """Mean and variance are those of a Poisson count where the cap is far."""
    rng = np.random.default_rng(8)
    whole, below = mixing.whole_and_thresholds(rate, cap)
    counts = whole + np.searchsorted(below, rng.random(200_000), "right")
    assert counts.mean() == pytest.approx(rate, rel=0.01) and counts.var() == pytest.approx(rate, rel=0.03)
    exact = rng.poisson(rate, 200_000)
    assert np.abs(np.quantile(counts, [0.01, 0.5, 0.99]) - np.quantile(exact, [0.01, 0.5, 0.99])).max() <= max(1, 0.02 * math.sqrt(rate) * 5)


def mixed(spark, docs, targets, **more):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, source string, text string, cdf string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mixture(d, t, **more)


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["Big", " big ", "big", "small"] if i % 10 else ["small"]), "some words " * rng.randrange(1, 20)) for i in range(4000)]
    docs += [(5000, None, "x"), (5001, "other", "x"), (5002, "big", None), (5003, "big", "")]
    made = mixed(spark, docs, [("big", 0.3, 1), ("SMALL", 0.6, 3), ("none", 0.1, 2), ("zero", 0.0, 1), (None, 1.0, 1)])
    report = {r["source"]: r for r in made.report.collect()}
    assert set(report) == {"big", "small", "none", "zero", "other", None}
    assert report["big"]["reached_share"] == pytest.approx(1 / 3, abs=0.03)
    assert report["small"]["reached_share"] == pytest.approx(2 / 3, abs=0.03)
    assert report["none"]["n_copies"] == report["other"]["n_copies"] == 0
    rows = made.documents.select("doc_id", "source", "copy_no").collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert sum(copies.values()) == report["big"]["n_copies"] + report["small"]["n_copies"]
    by_source = defaultdict(int)
    for r in rows:
        by_source[r["source"]] = max(by_source[r["source"]], r["copy_no"])
    assert by_source["big"] <= 1 and by_source["small"] <= 3
    assert not copies.keys() & {5000, 5001, 5002, 5003}
    again = mixed(spark, docs[::-1], [("big", 0.3, 1), ("SMALL", 0.6, 3)]).documents
    assert Counter(r["doc_id"] for r in again.select("doc_id").collect()) == copies


@pytest.mark.parametrize("rate, cap", [(2.5, 10**6), (499.5, 20_000), (12_000.25, 50_000), (19_999.5, 20_000), (30_000, 20_000), (10**6 + 0.5, 2 * 10**6)])
def test_high_caps_are_not_cut(rate, cap):
    whole, thresholds = mixing.whole_and_thresholds(rate, cap)
    assert whole + sum(1 - t for t in thresholds) == pytest.approx(min(rate, cap), rel=1e-5)
    assert len(thresholds) <= 24 * math.sqrt(rate + 1) + 90 and whole + len(thresholds) <= cap


def test_a_source_with_a_high_cap_reaches_its_share(spark):
    documents = spark.createDataFrame([(1, "small", "one"), (2, "big", "word " * 15_000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("small", 0.5, 20_000), ("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    made = mixing.mixture(documents, targets)
    report = {r["source"]: r for r in made.report.collect()}
    assert report["small"]["rate"] > 10_000 and report["small"]["n_copies"] == made.documents.where("source = 'small'").count()
    assert report["small"]["reached_share"] == pytest.approx(0.5, abs=0.01)


def test_many_sources_without_a_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, rng.choice("aaab"), "word " * rng.randrange(1, 9)) for i in range(600)]
    targets = [("a", 0.5, 2), ("b", 0.5, 3)]
    wanted = Counter(map(tuple, mixed(spark, docs, targets).documents.select("doc_id", "copy_no").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_THRESHOLDS", 0)
    assert Counter(map(tuple, mixed(spark, docs, targets).documents.select("doc_id", "copy_no").collect())) == wanted


def test_the_standard_error_is_that_of_the_draws(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice("aab"), "word " * rng.randrange(1, 9)) for i in range(500)]
    far = []
    for seed in range(12):
        for r in mixed(spark, docs, [("a", 0.5, 4), ("b", 0.5, 4)], total_tokens=1500.0, seed=seed).report.collect():
            far.append((r["reached_share"] - r["scaled_share"]) / r["standard_error"])
    assert 0.4 < math.sqrt(sum(x * x for x in far) / len(far)) < 1.7


def test_mixture_of_nothing(spark):
    made = mixed(spark, [], [("a", 1.0, 1)])
    assert made.documents.count() == 0
    assert [r["reached_share"] for r in made.report.collect()] == [0.0]
    assert mixed(spark, [(1, "a", "x")], []).documents.count() == 0


# -- languages ----------------------------------------------------------------------------------


def test_long_words_keep_all_their_features():
    word = "donaudampfschifffahrtsgesellschaft"
    grams = {f"g {w[i : i + n]}" for w in [f"^{word}$"] for n in (2, 3) for i in range(len(w) - n + 1)}
    assert {language._bucket(g) for g in grams} <= set(language.features(word))
    known = ["a", word, "12", "haus"]
    flat, offsets = language.feature_table(known)
    assert [list(flat[a:b]) for a, b in zip(offsets, offsets[1:])] == [language.features(w) for w in known]
    weights = np.arange(language.BUCKETS * 2, dtype=float).reshape(-1, 2)
    some, begins = language.rows_of(flat, offsets, np.array([1, 3]))
    assert (language.feature_sums(weights, some, begins) == [weights[language.features(w)].sum(0) for w in (word, "haus")]).all()


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    lengths, k = np.array([4, 2, 1]), 3
    emissions, moves = rng.random((4, 3, k)) + 0.1, rng.random((k, k)) + 0.1
    gamma, expected = language.forward_backward(emissions, lengths, moves, True)
    total = np.zeros((k, k))
    for b, n in enumerate(lengths):
        weights = {}
        for path in np.ndindex(*[k] * n):
            weights[path] = math.prod(emissions[t, b, y] for t, y in enumerate(path)) * math.prod(moves[x, y] for x, y in zip(path, path[1:]))
        z = sum(weights.values())
        for t in range(n):
            for y in range(k):
                assert gamma[t, b, y] == pytest.approx(sum(w for p, w in weights.items() if p[t] == y) / z)
        for p, w in weights.items():
            for x, y in zip(p, p[1:]):
                total[x, y] += w / z
    assert expected == pytest.approx(total)


TEXTS = {
    "en": ["The old bridge was closed in March.", "Nobody knows who bought the lamps of the mill.", "Every year the town shows its boats.", "There were many horses near the river."],
    "fr": ["Le vieux pont fut fermé en mars.", "Personne ne sait qui a acheté les lampes du moulin.", "Chaque année la ville montre ses bateaux.", "Il y avait beaucoup de chevaux près de la rivière."],
    "ru": ["Старый мост был закрыт в марте.", "Никто не знает, кто купил лампы с мельницы.", "Каждый год город показывает свои лодки.", "Около реки было много лошадей."],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    samples = []
    for _ in range(150):
        code = rng.choice(list(TEXTS))
        label = rng.choice(list(TEXTS)) if rng.random() < 0.15 else code
        samples.append((" ".join(rng.choices(TEXTS[code], k=6)), label))
    return language.fit(samples)


def test_wrong_labels_do_not_spoil_the_model(model):
    rng = random.Random(5)
    for code in TEXTS:
        found, confidence, segments = language.read([" ".join(rng.choices(TEXTS[code], k=3))], model)[0]
        assert found == code and confidence > 0.9 and [s[2:4] for s in segments] == [(code, 3)]


def test_segments_of_mixed_text(model):
    text = " ".join(TEXTS["en"] + TEXTS["fr"][:2]) + "\n\n" + " ".join(TEXTS["en"][:2])
    found, _, segments = language.read([text], model)[0]
    assert found == "en" and [(s[2], s[3]) for s in segments] == [("en", 4), ("fr", 2), ("en", 2)]
    for begin, end, code, *_ in segments:
        assert any(x in plain(text, tables=False)[begin:end] for x in TEXTS[code])


def test_a_very_long_text_is_read_whole(model):
    text = " ".join(TEXTS["en"] * 400 + TEXTS["fr"] * 2)
    _, _, segments = language.read([text], model)[0]
    assert [(s[2], s[3]) for s in segments] == [("en", 1600), ("fr", 8)]
    assert max(s[4] for s in segments) > 10_000


@pytest.mark.parametrize("text", [None, "", "#REDIRECT [[X]]", "zzzz zzzz zzzz", "{{Infobox}}", "asdfkjh;akjdf;", "== Title ==", "????"])
def test_texts_without_language(model, text):
    assert language.read([text], model)[0] == (None, 0.0, [])


@pytest.mark.parametrize("code", ["en", "fr"])
def test_a_text_without_sentence_marks_has_a_language(model, code):
    line = " ".join(TEXTS[code]).replace(".", "").replace("!", "").replace("?", "")
    found, confidence, segments = language.read([line], model)[0]
    assert found == code and confidence > 0.5 and [s[2:4] for s in segments] == [(code, 0)]
    long = " ".join(["word"] * 3)
    assert language.read([long], model)[0] == (None, 0.0, [])


def test_languages_are_those_of_the_labels(spark):
    polish = ["Stary most nad rzeką został zamknięty wczesną wiosną z powodu powodzi.", "Mieszkańcy miasta wybrali nowego burmistrza po długiej dyskusji.", "Muzeum pokazuje obrazy i rzeźby z całego kraju."]
    rng = random.Random(2)
    docs = [(i, code, " ".join(rng.choices(texts, k=4))) for i, (code, texts) in enumerate([("en", TEXTS["en"]), ("pl", polish), ("fr", TEXTS["fr"])] * 30)]
    docs += [(1000, None, " ".join(polish)), (1001, "pl-PL", " ".join(TEXTS["en"])), (1002, "xx", " ".join(polish))]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {r["doc_id"]: (r["given_lang"], r["found_lang"]) for r in language.label_languages(frame).collect()}
    assert got[1000] == (None, "pl") and got[1001] == ("pl", "en") and got[1002] == (None, "pl") and got[1] == ("pl", "pl")
    few = language.label_languages(frame, least_documents=1000)
    assert {r["given_lang"] for r in few.collect()} == {"en", "fr", None}


def test_a_saved_model_reads_the_same(spark, model, tmp_path):
    language.save_model(spark, model, str(tmp_path / "model"))
    again = language.load_model(spark, str(tmp_path / "model"))
    texts = [" ".join(x) for x in TEXTS.values()]
    assert language.read(texts, again) == language.read(texts, model)


def test_labels_in_any_spelling(spark):
    given = {"en-GB": "en", " EN ": "en", "English": "en", "rus": "ru", "es_419": "es", "und": None, "": None, "xx": None, None: None, "nl-BE": "nl"}
    rows = spark.createDataFrame([(x,) for x in given], "x string").select("x", language.label_code(F.col("x")).alias("c")).collect()
    assert {r["x"]: r["c"] for r in rows} == given


def test_corrections(spark, model):
    docs = [
        (1, "en", " ".join(TEXTS["en"])),
        (2, "fr", " ".join(TEXTS["en"])),
        (3, None, " ".join(TEXTS["ru"])),
        (4, "en", " ".join(TEXTS["en"] + TEXTS["fr"])),
        (5, None, TEXTS["en"][0]),
        (6, None, None),
        (7, "English", " ".join(TEXTS["en"] + TEXTS["ru"][:1])),
        (8, "de", "#REDIRECT [[Y]]"),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, lang string, text string, found_lang string")
    labelled = language.label_languages(frame, model=model)
    assert {tuple(r) for r in language.corrections(labelled).collect()} == {(2, "en"), (3, "ru"), (4, "en"), (4, "fr")}
    assert labelled.count() == 8


def test_no_model_from_too_few_labels(spark):
    frame = spark.createDataFrame([(1, "en", "The old bridge was closed in March.")], "doc_id long, lang string, text string")
    assert [tuple(r) for r in language.label_languages(frame).collect()] == [(1, "en", None, 0.0, [])]
    assert language.label_languages(frame.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = language.label_languages(docs).where("given_lang IS NOT NULL AND found_lang IS NOT NULL")
    n, right = labelled.agg(F.count(F.lit(1)), F.count(F.when(F.expr("given_lang = found_lang"), 1))).first()
    assert n > 700 and right > 0.9 * n  # some labels are wrong on purpose
