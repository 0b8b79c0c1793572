import itertools

import numpy as np

from tessel.llm import lang_id as L

SCHEMA = "doc_id long, text string, lang string, spans string, score int"
EN, FR, RU = "the cat and the dog sat with this thing near that house", "le chat et la maison sont près du chien que nous voyons", "кот и собака сидят дома"


def test_mixed_text_and_edges(spark):
    train = [(i, t, g, "x", 1) for i, (t, g) in enumerate([(EN, "en"), (FR, "fr"), (RU, "ru")] * 5)] + [(90, "zz", None, "", 0), (91, None, "en", "", 0)]
    model = L.fit(spark.createDataFrame(train, SCHEMA))
    assert model.langs == ["en", "fr", "ru"]
    mixed = f"{EN}. {FR}! {RU}?"
    rows = [(1, mixed), (2, EN), (3, None), (4, ""), (5, "123 --- 456"), (6, RU), (7, "漢字"), (8, (EN + " ") * 20_000), (2, EN), (None, FR)]
    df = spark.createDataFrame([(i, t, "de", "c", 2) for i, t in rows], SCHEMA)
    got = L.main_language(L.language_spans(df, model)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    spans = [(s.lang, mixed[s.start:s.end]) for s in by[1].spans]
    assert spans == [("en", EN), ("fr", FR), ("ru", RU)]
    assert [by[i].lang_pred for i in (2, 3, 4, 5, 6, 8, None)] == ["en", "und", "und", "und", "ru", "en", "fr"]
    assert all(0 <= r.score <= 1 for r in got) and by[3].score == 0 and len(by[8].spans) == 1
    none = L.fit(spark.createDataFrame([], SCHEMA))
    assert {r.lang_pred for r in L.main_language(L.language_spans(df, none)).collect()} == {"und"}
    assert L.language_spans(df.limit(0), model).count() == 0


def test_viterbi_against_every_path():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 6, 1, 5])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 2
    label = L.viterbi(scores, starts, lengths, 1.5)
    for s, n in zip(starts, lengths):
        if n:
            def worth(p):
                return sum(scores[s + i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
            best = max(worth(p) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(worth(label[s:s + n]) - best) < 1e-4


def test_script_narrows_candidates(spark):
    rows = [(i, t, g, "", 0) for i, (t, g) in enumerate([(EN, "en"), (RU, "ru")])]
    m = L.fit(spark.createDataFrame(rows, SCHEMA))
    s = m.word_scores(["house", "дом", "漢"])
    assert s[0, 1] <= -L.OUT_OF_SCRIPT + L.BOUND and s[1, 0] <= -L.OUT_OF_SCRIPT + L.BOUND and not s[2].any()


def test_words_are_letters_with_their_marks(spark):
    assert L.WORD.findall("हिन्दी ½ ² ③ Ⅷ x² don't e\u0301te _a1b") == ["हिन्दी", "x", "don", "t", "e\u0301te", "a", "b"]
    model = L.fit(spark.createDataFrame([(1, EN, "en", "", 0)], SCHEMA))
    df = spark.createDataFrame([(i, t, None, "", 0) for i, t in enumerate(["½ ² ③", "Ⅷ", "\u0301", "²x"])], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.main_language(L.language_spans(df, model)).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"
