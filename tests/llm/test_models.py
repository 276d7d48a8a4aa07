"""Language, toxicity and quality: exact parts against brute force, models on held-out rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalog.llm import langid, quality, registry, toxicity
from causalog.llm.features import SpanHash, code_points, letters, runs
from causalog.llm.linear import Rows, ftrl, softmax, temperature
from llm.docs import docs, labelled


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_spans_runs_and_code_points():
    data, at = buffer(["ab ab", "", "ab", "é€😀x", "b"])
    starts, ends, doc = runs(data != 32, at)
    assert [(bytes(data[a:b]).decode(), d) for a, b, d in zip(starts, ends, doc)] == [("ab", 0), ("ab", 0), ("ab", 2), ("é€😀x", 3), ("b", 4)]
    h = SpanHash(data)(starts, ends)
    assert h[0] == h[1] == h[2] != h[4]
    points, places = code_points(data, at)
    assert "".join(map(chr, points)) == "ab ababé€😀xb" and places.tolist() == [0, 5, 5, 7, 11, 12]
    assert letters(np.array([ord(c) for c in "aÉ1 ñΩ€"], np.uint32)).tolist() == [ord(c) if c != "0" else 0 for c in "aé00ñω0"]


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 3, 600)
    features = [np.array([y, 3 + rng.integers(0, 50)]) for y in label]
    rows = Rows(np.arange(601) * 2, np.concatenate(features), np.ones(1200))
    weights, bias = ftrl(rows, np.eye(3)[label], 60, 2.0, 0.1)
    assert (rows.logits(weights, bias).argmax(1) == label).all()
    assert (weights[3:] != 0).mean() < 0.5 and (weights[:3].argmax(1) == [0, 1, 2]).all()


def test_temperature_of_overconfident_logits():
    rng = np.random.default_rng(0)
    true = rng.normal(size=(4000, 2))
    label = (rng.random(4000) < softmax(true)[:, 1]).astype(int)
    assert temperature(true * 5, np.eye(2)[label]) == pytest.approx(5, rel=0.3)
    assert temperature(np.zeros((0, 2)), np.zeros((0, 2))) == 1.0


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op7_language(spark, sf)
    joined = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = joined.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got.count() == 1000 and right > 0.97


def test_language_edge_cases(spark):
    rows = [(i, "der und die das nicht", "de") for i in range(8)] + [(20 + i, "the and of that is", "en") for i in range(8)]
    rows += [(40, None, "en"), (41, "the of", None), (42, "", "en")]
    learning = docs(spark, rows)
    model = langid.train(learning)
    assert model.languages == ["de", "en"]
    tried = docs(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "that is the of " * 20_000), (5, "die und"), (5, "die und"), (None, "the")])
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict(tried.withColumn("score_", F.lit(1)), model, ["doc_id"]).collect()))
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    nothing = langid.train(docs(spark, []))
    assert {r.lang_pred for r in langid.predict(tried, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model, ["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def characters(spark):
    return toxicity.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_character_model_is_counted_over_all_texts(spark):
    model = toxicity.character_model(docs(spark, [(1, "aab"), (2, None), (3, "b!!"), (4, "")]))
    assert np.allclose(np.exp(model).sum(-1), 1)
    a, b = 1, 2
    assert model[0, a, a] == model[0, a].max() and model[a, a, b] == model[a, a].max()


def all_readings(decode, places, start):
    """The best total over every combination of readings, one by one."""
    best = -np.inf
    for pick in itertools.product(*places):
        x = y = 0
        total = start + sum(p[2] for p in pick)
        for s in [s for p in pick for s in p[0]] + [0]:
            if s or y:
                total += decode.model[x][y][s]
                x, y = y, s
        best = max(best, total)
    return best


@pytest.mark.parametrize("span", ["1d10t", "stuuupid", "$1ll!", "a-b", "x0||o", "1", "é1é", "aaa"])
def test_decoding_is_the_best_of_all_readings(characters, span):
    decode = toxicity.Decoder(characters)
    places = decode._lattice(span)
    assert decode._best(places, 0.0)[0] == pytest.approx(all_readings(decode, places, 0.0))


def test_restored_words(spark, characters):
    rows = [(1, "You 1D10T and st.upid C10WN"), (2, "plain text, no. 12 at 10:30"), (3, None), (4, ""), (5, "such a l o s e r!"), (6, "mooooron w0rthl3ss"), (7, "x" * 70_000)]
    got = {r.doc_id: r.restored for r in toxicity.restored_texts(docs(spark, rows), characters).collect()}
    assert "idiot" in got[1] and "clown" in got[1]
    assert got[2] == rows[1][1] and got[3] is None and got[4] == ""
    assert "loser" in got[5] and got[6] == "moron worthless"


@pytest.mark.parametrize("text, wanted", [
    ("st.upid", "stupid"), ("such id-iot", "such idiot"), ("s t u p id", "stupid"), ("i  d\ti\no  t", "idiot"), ("i/d/i/o/t", "idiot"),
    ("i|d|i|o|t", "idiot"), ("y o u  i d i o t", "you  idiot"), ("y o u  a r e  s t u p i d", "you  are  stupid"), ("y o u i d i o t", "you idiot"),
    ("a well-known end.Next", "a well-known end.next"), ("no. 12 at 10:30, 3.5", "no. 12 at 10:30, 3.5"),
])
def test_separators_may_be_there_or_not(characters, text, wanted):
    data, at = buffer(["plain", text, ""])
    got, ends = toxicity.restore(data, at, toxicity.Decoder(characters))
    assert bytes(got).decode() == "plain" + wanted and ends.tolist() == [0, 5, 5 + len(wanted), 5 + len(wanted)]


def read(characters, text):
    return bytes(toxicity.restore(*buffer([text]), toxicity.Decoder(characters))[0]).decode()


def test_word_counts_are_those_of_all_texts(spark):
    rows = [(1, "Good gOOd god"), (2, None), (3, "good,god1god"), (4, ""), (5, "é é É " + "x" * 65 + " " + "y" * 64), (6, " y" + "y" * 63), (7, "y" * 64), (8, "é")]
    model = toxicity.language_model(docs(spark, rows))
    assert model.words == {"good": 3, "god": 3, "é": 3, "y" * 64: 3} and model.total == 3 + 3 + 5 + 1 + 1 + 1
    nothing = toxicity.language_model(docs(spark, []))
    assert nothing.words == {} and read(nothing, "good b00k") and read(nothing, "") == ""


def test_attested_words_are_a_share_of_all(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 4)
    model = toxicity.language_model(docs(spark, [(i, "often rare" if i < 3 else "often often") for i in range(10)]))
    assert model.words == {"often": 17}


@pytest.mark.parametrize("text", [
    "good see too class school password little book look need free tree three week soon food room door call tell small well",
    "kill full pull hello yellow happy apple letter better summer dinner address access success process less miss pass boss",
    "glass committee coffee balloon meeting million dollar different difficult offer affair matter accept account middle",
])
def test_doubled_letters_of_clean_words_stay(characters, text):
    assert read(characters, text) == text


def test_no_attested_word_changes(characters):
    decode = toxicity.Decoder(characters)
    often = [w for w, n in characters.words.items() if n >= 10]
    assert len(often) > 1000 and [w for w in often if decode(w) != w] == []


def test_clean_documents_stay(spark, characters):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0 and quality = 1")
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(good, "doc_id").where("text is not null").collect()]
    pairs = [(a, b) for t in texts for a, b in zip(t.split(), read(characters, t).split())]
    changed = [p for p in pairs if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in p[0]) != p[1]]
    assert len(texts) > 250 and len(changed) <= len(pairs) / 10_000


def test_every_token_with_two_readings_is_decoded(characters):
    text = "idio7 hat3 a55 @$$ stuupiidd id1111ot 1d!0t hello worthless idiot! pay $100, $5, 2024 or 10+ now!! $$$"
    data, at = buffer([text])
    got, _ = toxicity.restore(data, at, toxicity.Decoder(characters))
    assert bytes(got).decode() == "idiot hate ass ass stupid idiot idiot hello worthless idiot! pay $100, $5, 2024 or 10+ now!! $$$"


@pytest.mark.parametrize("span", ["a55", "@$$", "f111", "oo77", "!!a"])
def test_decoding_of_repeated_signs_is_the_best_of_all_readings(characters, span):
    decode = toxicity.Decoder(characters)
    places = decode._lattice(span)
    assert decode._best(places, 0.0)[0] == pytest.approx(all_readings(decode, places, 0.0))


@pytest.mark.parametrize("span", ["st.upid", "i d i-ot", "y o  u i", "a|b|c"])
@pytest.mark.parametrize("spread", [False, True])
def test_decoding_of_separators_is_the_best_of_all_readings(characters, span, spread):
    decode = toxicity.Decoder(characters)
    places = decode._lattice(span, spread)
    if spread:
        assert any(not symbols for place in places for symbols, _, _ in place)
    assert decode._best(places, 0.0)[0] == pytest.approx(all_readings(decode, places, 0.0))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op1_toxicity(spark, sf)
    held = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert got.count() == 1000 and sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.02


def test_disguised_insults_are_scored_like_plain_ones(spark, characters):
    rows = labelled(spark, "sf0.01")
    weights, bias = toxicity.train(rows, characters)
    text = "The and attion to thanedble the anea. {} thea of"
    tried = [(i, text.format(w)) for i, w in enumerate(["idiot", "1d10t", "i d i o t", "idiooooot", "stupid", "stup1d", "thion"])] + [(20, None), (21, "")]
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, tried), characters, weights, bias, ["doc_id"]).collect()}
    assert min(got[i] for i in range(6)) > 0.7 > 0.3 > got[6]
    assert got[20] == got[21] and 0 <= got[20] <= 1
    assert toxicity.score(docs(spark, []), characters, weights, bias, ["doc_id"]).count() == 0
    empty = toxicity.train(rows.limit(0), characters)
    assert {r.score for r in toxicity.score(docs(spark, tried), characters, *empty, ["doc_id"]).collect()} == {0.5}


def test_expectation_maximisation_finds_the_labellers():
    rng = np.random.default_rng(0)
    n, names = 40_000, list(quality.LABELLERS)
    kind = np.where(rng.random(n) < 0.85, 0, rng.integers(1, 4, n))
    codes = np.zeros(n, int)
    for j in range(len(names)):
        no = np.where(kind == 0, rng.random(n) < 0.003, (kind == j + 1) & (rng.random(n) < 0.9))
        codes = codes * 3 + np.where(rng.random(n) < 0.1, 0, np.where(no, 1, 2))
    good, table, shares = quality.expectation_maximisation(np.bincount(codes, minlength=3 ** len(names)))
    said = good[codes] > 0.5
    assert said[kind == 0].mean() > 0.97 and (~said[kind > 0]).mean() > 0.75
    assert 0.8 < shares[0] < 0.92
    assert all(right_bad > 0.5 for n, (right_bad, _) in list(quality.accuracies(table, shares).items())[:3])
    assert quality.expectation_maximisation(np.zeros(3 ** len(names)))[0].shape == (3 ** len(names),)


def test_measures():
    data, at = buffer(["a a a b", "", "One TWO\nOne TWO\nx", "### | éé!!"])
    m = quality.Measured(data, at).measures()
    assert m["repeated"].tolist() == [0.5, 0, 0, 0] and m["same_lines"].round(2).tolist() == [0, 0, 0.33, 0]
    assert m["signs"].round(2).tolist() == [0, 0, 0, 0.67] and m["bare"].round(2).tolist() == [0, 0, 0, 0.67]
    assert m["few_words"].round(2).tolist() == [0.5, 0, 0.4, 0]


def test_few_words_in_texts_of_any_length():
    rng = np.random.default_rng(3)
    texts = [" ".join(itertools.islice(itertools.cycle(["buy", "now", "cheap"]), n)) for n in (300, 301, 5000)]
    texts += ["", "one", *(" ".join(map(str, rng.integers(0, kinds, n))) for kinds, n in ((40, 299), (90, 301), (500, 937), (7, 600)))]
    m = quality.Measured(*buffer(texts))

    def slowly(words):
        size = min(quality.RUN, len(words))
        runs_ = [words[i:i + size] for i in range(len(words) - size + 1)]
        return np.mean([1 - len(set(r)) / size for r in runs_]) if words else 0

    assert m.measures()["few_words"] == pytest.approx([slowly(t.split()) for t in texts])
    place = list(quality.LABELLERS).index("few_words")
    assert quality.pattern_votes()[m.patterns()[:3], place].tolist() == [1, 1, 1]


def test_quality_agrees_with_the_labels_it_never_saw(spark):
    got = registry.op8_quality(spark, "/root/testdata/sf0.01")
    seen = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r.predicted for r in seen if r.quality == 1], [r.predicted for r in seen if r.quality == 0]
    assert got.count() == 1000 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_quality_edge_cases(spark):
    model = quality.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "short"), (4, "word " * 50_000), (5, "short"), (None, "short")]
    got = quality.with_quality(docs(spark, rows), model).collect()
    assert len(got) == 6 and all(0 <= r.quality_score <= 1 for r in got) and len({r.quality_score for r in got if r.text in (None, "")}) == 1
    assert quality.with_quality(docs(spark, []), model).count() == 0
    assert {r.quality_score for r in quality.with_quality(docs(spark, rows), quality.train(docs(spark, []))).collect()} == {0.5}
