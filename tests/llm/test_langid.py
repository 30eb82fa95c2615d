import itertools

import numpy as np
from helpers import doc, frame

from lintlake.llm import langid

EN, DE = "the cat and the dog went with this house", "der hund und die katze ist nicht ein haus"
EL, RU = "ο σκύλος και η γάτα", "собака и кошка это"


def corpus(spark):
    data = [doc(i, " ".join([t] * 3), lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (EL, "el"), (RU, "ru")] * 5)]
    return frame(spark, data)


def test_scripts_and_languages(spark):
    model = langid.learn(corpus(spark))
    assert model.langs == ["de", "el", "en", "ru"]
    new = frame(spark, [doc(100, "the house and the dog"), doc(101, "die katze und der hund"), doc(102, "και η γάτα"), doc(103, "кошка и собака"), doc(104, None), doc(105, ""),
                        doc(106, "12 34 !!"), doc(107, "漢字 漢字"), doc(None, "the dog"), doc(100, "the house and the dog")])
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(new.select("doc_id", "text"), model).collect()]
    said = {(i, p) for i, p, _ in got}
    assert {(100, "en"), (101, "de"), (102, "el"), (103, "ru"), (104, "und"), (105, "und"), (106, "und"), (None, "en")} <= said
    assert len(got) == 10 and all(0 <= s <= 1 for _, _, s in got)
    by = {i: (p, s) for i, p, s in got}
    assert by[104][1] == by[106][1] == 0.0
    assert by[107] == (model.langs[model.prior], 0.0)  # a script that no language uses


def test_spans_of_mixed_text(spark):
    model = langid.learn(corpus(spark))
    mixed = " ".join([EN] * 4 + [DE] * 4)
    r = langid.predict(frame(spark, [doc(1, mixed)]).select("doc_id", "text"), model, penalty=4.0).first()
    assert [s["lang"] for s in r["spans"]] == ["en", "de"]
    assert r["spans"][0]["start"] == 0 and r["spans"][1]["stop"] == len(mixed)
    assert abs(r["spans"][1]["start"] - len(" ".join([EN] * 4)) - 1) < 12


def test_very_long_text_and_empty_tables(spark):
    model = langid.learn(corpus(spark))
    r = langid.predict(frame(spark, [doc(1, (EN + " ") * 20000)]).select("doc_id", "text"), model).first()
    assert r["lang_pred"] == "en" and len(r["spans"]) == 1
    empty = frame(spark, [])
    assert langid.predict(empty.select("doc_id", "text"), model).count() == 0
    untrained = langid.learn(empty)
    assert untrained.langs == [] and langid.predict(corpus(spark).select("doc_id", "text"), untrained).select("lang_pred").distinct().first()[0] == "und"


def test_held_out_accuracy(spark):
    from lintlake.llm.queries import op1_language_id

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op1_language_id(spark, sf).join(truth, "doc_id").filter("held_out").selectExpr("avg(cast(lang = lang_pred as double)) a").first()["a"]
    assert got > 0.97


def test_words_are_parted_where_the_script_changes():
    texts = ["кошкаthe-cat", "", "naïve 漢字かなab12в34", "the cat", "ab́γ", "кошкаthe-cat x"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    code, row, uniq, start, end, at = langid._distinct_words(data, off)
    parts = [bytes(data[a:z]).decode() for a, z in zip(start, end, strict=True)]
    assert parts == ["кошка", "the-cat", "naïve", "漢字かな", "ab12", "в34", "the", "cat", "ab́", "γ", "кошка", "the-cat", "x"]
    assert row.tolist() == [0, 0, 2, 2, 2, 2, 3, 3, 4, 4, 5, 5, 5]
    assert [parts[i] for i in at] == list(dict.fromkeys(parts)) and [parts[at[c]] for c in code] == parts and len(uniq) == len(set(parts))


def test_spans_of_mixed_text_without_spaces(spark):
    model = langid.learn(corpus(spark))
    left, right = RU.replace(" ", "") * 3, EN.replace(" ", "") * 3
    r = langid.predict(frame(spark, [doc(1, left + right)]).select("doc_id", "text"), model).first()
    size = len(left.encode())
    assert [(s["start"], s["stop"]) for s in r["spans"]] == [(0, size), (size, size + len(right))]
    assert r["spans"][0]["lang"] == "ru" and r["spans"][1]["lang"] in ("en", "de")


def test_viterbi_equals_all_paths():
    """Every labelling of short rows is scored; rows with the same best score may differ in labels only (none here)."""
    rng = np.random.default_rng(3)
    row = np.repeat(np.arange(7), [3, 0, 5, 1, 4, 0, 6])
    for k, penalty in ((1, 1.0), (2, 0.0), (3, 0.7), (4, 2.5)):
        scores = rng.normal(size=(len(row), k))
        got = langid.viterbi(scores, row, 7, penalty)
        for r in range(7):
            s = scores[row == r]
            paths = itertools.product(range(k), repeat=len(s))
            best = max(paths, key=lambda p: sum(s[i, c] for i, c in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False)))
            assert got[row == r].tolist() == list(best)


def test_a_text_in_two_equal_halves_goes_to_the_first_language(spark):
    model = langid.learn(corpus(spark))
    out = langid.predict(frame(spark, [doc(1, "кошка γάταα"), doc(1, "кошка γάταα")]).select("doc_id", "text"), model, penalty=0.0).collect()
    assert [(r["lang_pred"], [s["lang"] for s in r["spans"]]) for r in out] == [("el", ["ru", "el"])] * 2
