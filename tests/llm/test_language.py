import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from treegrammar.llm import language
from treegrammar.llm.common import held

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"
EN = "the quick brown fox jumps over the lazy dog and runs through the forest with other animals".split()
DE = "der schnelle braune Fuchs springt über den faulen Hund und läuft durch den Wald mit anderen Tieren".split()
RU = "быстрая коричневая лиса прыгает через ленивую собаку и бежит через лес".split()


def corpus():
    rows = []
    for i in range(60):
        for lang, words in (("en", EN), ("de", DE), ("ru", RU)):
            k = (i * 7) % len(words)
            rows.append((len(rows), " ".join(words[k:] + words[:k]), lang, "x", 0.5))
    return rows


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(1)
    scores = rnd.normal(size=(6, 3)).astype(np.float32) * 3
    lengths = np.array([0, 1, 4, 6, 2])
    ids = rnd.integers(0, 6, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    got = language.viterbi(scores, ids, starts, lengths, 2.0)

    def value(path, words):
        return sum(scores[w, s] for w, s in zip(words, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    for s, n in zip(starts, lengths):
        words = ids[s : s + n]
        best = max(value(p, words) for p in itertools.product(range(3), repeat=int(n)))
        assert value(got[s : s + n].tolist(), words) == pytest.approx(best, abs=1e-4)


def test_long_documents_are_walked_in_runs(monkeypatch):
    rnd = np.random.default_rng(2)
    scores = rnd.normal(size=(40, 4)).astype(np.float32) * 3
    lengths = np.array([3, 90, 0, 700, 41, 40])
    ids = rnd.integers(0, 40, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    want = language.viterbi(scores, ids, starts, lengths, 4.0)
    monkeypatch.setattr(language, "LONG", 40)
    for run in (1, 7, 40, 699):
        monkeypatch.setattr(language, "RUN", run)
        got = language.viterbi(scores, ids, starts, lengths, 4.0)
        assert (got == want).mean() > 0.999  # floats are added in another order
        for s, n in zip(starts, lengths):
            value = lambda p: scores[ids[s : s + n], p].sum() - 4.0 * (np.diff(p) != 0).sum()
            assert value(got[s : s + n].astype(int)) == pytest.approx(value(want[s : s + n].astype(int)), abs=1e-2)


def test_only_texts_without_a_letter_have_no_language(spark):
    model = language.learn(spark.createDataFrame(corpus(), SCHEMA).where("lang <> 'ru'"), F.lit(True))
    texts = ["привет мир", "ελληνικά γλώσσα", "全ての人間", "zzqx", "ª", "12 ½ -- !", "", None, " \n", "1x"]
    odd = spark.createDataFrame([(i, t, None, "a", 1.0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].lang_pred in ("de", "en") for i in range(10)] == [True] * 5 + [False] * 4 + [True]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6, 7, 8)) and all(0 <= r.score <= 1 for r in got.values()) and all(got[i].score == 0 for i in (0, 1, 2))


def test_many_languages_and_a_long_text(monkeypatch):
    """Back pointers of few runs are held at a time; the path is that of one walk."""
    rnd = np.random.default_rng(4)
    scores, ids = rnd.normal(size=(50, 60)).astype(np.float32), rnd.integers(0, 50, 6000)
    monkeypatch.setattr(language, "RUN", 100)
    monkeypatch.setattr(language, "LANES", 100 * 60 * 60 * 2)
    got = language.long_viterbi(scores, ids, 2.0).astype(int)
    monkeypatch.setattr(language, "LONG", 10_000)
    want = language.viterbi(scores, ids, np.array([0]), np.array([6000]), 2.0).astype(int)
    value = lambda p: scores[ids, p].astype(float).sum() - 2.0 * (np.diff(p) != 0).sum()
    assert value(got) == pytest.approx(value(want), abs=1e-2)


def test_spans_scripts_and_odd_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = language.learn(docs, F.lit(True))
    assert model.langs == ["de", "en", "ru"]
    assert not np.array(model.uses["Cyrillic"])[[0, 1]].any() and model.uses["Cyrillic"][2]
    mixed = " ".join(EN * 2 + DE * 2 + RU)
    rows = [(1, mixed, None, "a", 1.0), (2, None, "de", "a", 1.0), (3, "", "de", "a", 1.0), (4, "12 -- |", "de", "a", 1.0), (5, "собака 中文", None, "a", 1.0), (6, "the fox " * 30_000, None, "a", 1.0), (7, "ελληνικά", None, "a", 1.0), (None, "der Hund", None, "a", 1.0), (1, mixed, None, "a", 1.0)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [s.lang for s in by[1].spans] == ["en", "de", "ru"]
    assert abs(by[1].spans[0].after - 2 * len(EN)) <= 1 and abs(by[1].spans[1].after - 2 * (len(EN) + len(DE))) <= 1
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and by[2].score == 0
    assert by[5].lang_pred == "ru" and by[6].lang_pred == "en" and by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)
    none = language.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs.limit(3), none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs, ~held(F.col("doc_id"), 3, 1))
    out = language.identify(docs.where(held(F.col("doc_id"), 3, 1)), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.98 * len(out)


STRANGE = ["όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι", "全ての人間は 生まれながらにして 自由であり", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"]


def test_texts_in_no_learned_language_score_low_and_are_rejected(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = language.learn(docs, F.lit(True))
    rows = [(i, t, None, "a", 1.0) for i, t in enumerate([*STRANGE, " ".join(EN), " ".join(DE), " ".join(RU), " ".join(EN) + " " + STRANGE[0]])]
    odd = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].score for i in (0, 1)] == [0.0] * 2 and got[2].score < 0.3
    assert all(got[i].lang_pred in model.langs for i in (0, 1, 2))
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["en", "de", "ru"] and all(got[i].score > 0.9 for i in (3, 4, 5))
    assert got[6].lang_pred == "en" and 0.5 < got[6].score < 0.8
    assert {r.doc_id for r in language.keep_languages(odd, model, 0.3).collect()} == {3, 4, 5, 6}
