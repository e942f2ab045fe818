import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, language_id, quality_classifier, sentencepiece_codec
from graphloom.llm.bpe import PairRanks, merge_words
from graphloom.llm.sentencepiece_codec import PieceModel, default_model

from . import brute
from .brute import sha
from .conftest import ODD, prose

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ung ein ver keit ich ö ü ge".split(), "fr": "eau ou ê é è tion ai qu".split()}


def text_of(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def labelled(n=40):
    return [(i, text_of(lang, i), lang) for i, lang in enumerate(lang for _ in range(n) for lang in SYLLABLES)]


def test_languages_of_held_out_texts(docs_of):
    docs = docs_of(labelled(), extra=True)
    held = language_id.held_out()
    out = language_id.identify(docs, language_id.learn(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert len(out) > 20 and sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and not r.rejected for r in out)


def test_languages_of_odd_texts(docs_of):
    docs = docs_of(labelled() + [(1000 + k, *r[1:]) for k, r in enumerate(ODD)])
    models = language_id.learn(docs.where("doc_id < 1000"), F.lit(True))
    out = {r.doc_id: r for r in language_id.identify(docs, models).where("doc_id >= 1000").collect()}
    assert len(out) == len(ODD)
    assert all(out[k].lang_pred == "und" and out[k].rejected and out[k].score == 0 for k in (1000, 1001, 1002))
    assert all(r.lang_pred in (*SYLLABLES, "und") and 0 <= r.score <= 1 for r in out.values())
    digits = docs_of([(1, "12 34 !?"), (2, "qxzj vwkq jjxq zzqk xqvw " * 20)])
    assert [(r.lang_pred == "und", r.rejected) for r in language_id.identify(digits, models).orderBy("doc_id").collect()] == [(True, True), (False, True)]
    kept = language_id.keep_identified(docs.where("doc_id < 1000"), models)
    assert kept.count() == 120 and kept.columns == docs.columns
    assert language_id.identify(docs_of([]), models).count() == 0


def test_scores_against_kneser_ney_by_the_definition():
    r = random.Random(6)
    for seed in range(3):
        counts = {lang: {w: 1 + k % 4 for k, w in enumerate(sorted(set(text_of(lang, seed, 40).split())))} for lang in SYLLABLES}
        m = language_id.fit([(lang, w, n) for lang, ws in counts.items() for w, n in ws.items()])
        probe = ["", "a", "zzz", *r.sample([w for ws in counts.values() for w in ws], 20), *("".join(r.choice("therinüéßq") for _ in range(r.randrange(1, 9))) for _ in range(40))][1:]
        chars = len({c for ws in counts.values() for w in ws for c in w} | {" "})
        got = m.words(probe)
        for j, lang in enumerate(m.langs):
            plain = brute.kneser_ney(counts[lang], language_id.ORDER, chars)
            assert np.allclose(got[:, j], [plain(w) for w in probe], atol=1e-3)


def test_probabilities_after_a_context_add_up():
    """Over all characters that any word has and the word's end; characters never seen have the little that is left."""
    words = [("en", w, n) for n, w in enumerate(sorted({w for k in range(5) for w in text_of("en", k).split()}), 1)]
    m = language_id.fit(words)
    letters = sorted({c for _, w, _ in words for c in w})
    for context in ("", "t", "th", "ther", "herz"):
        # A word's probability is that of its prefix times that of its last character, up to the end.
        starts = m.words([context + c for c in letters])[:, 0]
        ends = np.array([_end(m, context + c) for c in letters])
        whole = np.exp(starts - ends).sum() + np.exp(m.words([context])[0, 0] if context else -np.inf)
        prefix = m.words([context])[0, 0] - _end(m, context) if context else 0.0
        assert 0.95 < whole / np.exp(prefix) <= 1.0001


def _end(m, word):
    """Log probability of the end after a word."""
    owner, place, _, grams = language_id._grams([word])
    at, score = len(place) - 1, 0.0
    for k in range(language_id.ORDER, 0, -1):
        if place[at] < k - 1:
            continue
        i = language_id._find(m.grams[k - 1], grams[k - 1][at : at + 1])[0]
        if i >= 0:
            return score + m.logp[k - 1][i, 0]
        j = language_id._find(m.contexts[k - 2], grams[k - 2][at - 1 : at])[0] if k > 1 else -1
        score += m.backoff[k - 2][j, 0] if j >= 0 else 0.0
    return score + m.unseen[0]


def test_learning_languages_from_nothing_is_an_error(docs_of):
    with pytest.raises(ValueError):
        language_id.learn(docs_of([(1, "a", None)]), F.lit(True))


def test_all_words_of_the_sample_count_whatever_their_language(docs_of):
    """A language of few texts without spaces, one whose documents have no letters, and many frequent words of others."""
    r = random.Random(4)
    zh = ["".join(chr(0x4E00 + r.randrange(400)) for _ in range(60)) for _ in range(12)]
    docs = docs_of(labelled() + [(1000 + k, t, "zh") for k, t in enumerate(zh)] + [(2000 + k, "12 34", "xx") for k in range(20)])
    models = language_id.learn(docs, F.lit(True))
    assert models.langs == ["de", "en", "fr", "zh"]
    a, b = models.gram_ends[1][3:5]
    assert b - a == len({(" " + t + " ")[k : k + 2] for t in zh for k in range(61)})
    out = language_id.identify(docs.where("lang = 'zh'"), models).collect()
    assert len(out) == 12 and all(x.lang_pred == "zh" for x in out)


def test_texts_of_an_unlearned_language_are_rejected(docs_of):
    """Also with a language of so few texts that it has no spread of its own, and unlike texts are nearest to it."""
    make = lambda parts, seed, n=60: " ".join("".join(random.Random(f"{seed} {k} {parts}").choices(parts.split(), k=1 + k % 3)) for k in range(n))
    few, other = "wa ji lo ku ze", "zy kwo pla mok dru vys ajn"
    known = docs_of(labelled() + [(1000 + k, make(few, k, 12), "few") for k in range(3)])
    models = language_id.learn(known, F.lit(True))
    assert np.isfinite(models.mean).all() and len(models.langs) == 4
    mixed = [f"{text_of('en', 500 + k, 30)} {text_of('de', 600 + k, 30)}" for k in range(20)]
    rows = [(k, make(other, 50 + k)) for k in range(20)] + [(100 + k, text_of(lang, 700 + k)) for k, lang in enumerate(["en", "de", "fr"] * 10)] + [(200 + k, t) for k, t in enumerate(mixed)]
    out = {r.doc_id: r.rejected for r in language_id.identify(docs_of(rows), models).collect()}
    assert all(out[k] for k in range(20))
    assert not any(r for k, r in out.items() if k >= 100)


def test_counts_of_parts_make_the_model_of_the_whole(docs_of):
    from collections import Counter

    rows = labelled(6)
    words = Counter((lang, w) for _, t, lang in rows for w in t.split())
    whole = language_id.fit([(lang, w, n) for (lang, w), n in words.items()])
    counts = language_id._gram_counts(docs_of(rows).select("text", "lang"))
    spark_made = language_id.fit_counts(counts)
    probe = ["ther", "schung", "eau", "qxz", "漢"]
    assert np.allclose(whole.words(probe), spark_made.words(probe))


def test_query_without_anything_to_learn(spark, docs_of, tmp_path):
    import corpus_pipeline

    docs_of([(1, "some words", None), (2, "12 34", "en"), (3, None, "en")]).write.parquet(str(tmp_path / "documents.parquet"))
    out = language_id.query(spark, str(tmp_path)).collect()
    assert len(out) == 3 and all(r.lang_pred == "und" and r.score == 0 for r in out)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in corpus_pipeline.identify_languages(spark, docs, "").collect()] == [1]


def test_quality_of_held_out_texts(spark, docs_of):
    rows = [(k, prose(k, 80) if k % 2 else " ".join(w.upper() + "!!" for w in prose(k, 80).split())) for k in range(200)]
    docs = docs_of(rows + [(1000 + k, t) for k, (_, t) in enumerate(ODD)], extra=True)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (5000, 0)], "doc_id long, quality int")
    held = language_id.held_out(parts=5, which=0)
    out = quality_classifier.score(docs, quality_classifier.learn(docs, labels, ~held)).where("doc_id < 200").where(held).collect()
    assert len(out) > 20 and all(r.predicted == r.doc_id % 2 == (r.score >= 0.3) for r in out)
    odd = quality_classifier.score(docs, quality_classifier.train([])).where("doc_id >= 1000").collect()
    assert len(odd) == len(ODD) and all(r.score == 0.5 for r in odd if r.doc_id == 1000)
    assert quality_classifier.score(docs_of([]), quality_classifier.train([])).count() == 0


def test_repeated_words_count_as_a_feature():
    m = quality_classifier.train([])
    total = m.words(["a", "b"])
    assert total.shape == (2, quality_classifier.WIDTH + 1) and (total[:, -1] == 2).all()  # the word and one n-gram


def slow_merge(symbols, table):
    s = list(symbols)
    while True:
        found = [(table[a, b][0], i) for i, (a, b) in enumerate(zip(s, s[1:])) if (a, b) in table]
        if not found:
            return s
        _, i = min(found)
        s[i : i + 2] = [table[s[i], s[i + 1]][1]]


@pytest.mark.parametrize("long", [512, 6])
def test_merge_rounds_against_one_by_one(monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG", long)
    r = random.Random(5)
    for _ in range(200):
        table, n = {}, 4
        for rank in range(r.randrange(1, 12)):
            pair = r.randrange(n), r.randrange(n)
            if pair not in table:
                table[pair] = r.randrange(6), n  # ranks repeat and may fall for longer symbols
                n += 1
        pairs = PairRanks([a for a, _ in table], [b for _, b in table], [v[0] for v in table.values()], [v[1] for v in table.values()])
        words = [[r.randrange(4) for _ in range(r.randrange(1, 30))] for _ in range(20)] + [[r.randrange(4)] * r.randrange(1, 60) for _ in range(5)] + [[r.randrange(4), r.randrange(4)] * 20]
        got, lengths = merge_words(np.array(sum(words, [])), np.array([len(w) for w in words]), pairs)
        want = [slow_merge(w, table) for w in words]
        assert lengths.tolist() == [len(w) for w in want] and got.tolist() == sum(want, [])


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_pieces_are_the_librarys():
    r, sp, m = random.Random(1), library(), PieceModel(default_model())
    signs = "aabbee  \n\n\té▁漢😀<s>0tthhe'.,\r\x00 ñ"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["a" * 40, "    ", "hehehehe", "<s></s><unk><0x41>", "\n\n\n", " \n ", "▁▁▁", "ﬁ é ½"]
    for t in texts:
        assert m.encode(t) == sp.encode(t), repr(t)
        assert m.decode([*m.encode(t), m.end_id]) == sp.decode([*sp.encode(t), 2]), repr(t)


def test_pieces_of_long_runs_are_the_librarys():
    import time

    r, sp, m = random.Random(3), library(), PieceModel(default_model())
    texts = [unit * n for unit in (" ", "-", "=", "a", "ab", "ha", "\n", "漢", "é", "  x", "=-", "the", "...", "😀") for n in (513, 1000, 2049, 5003)]
    texts += ["".join(r.choice("abcdefgh") for _ in range(4000)), "".join(r.choice("=-_ ") for _ in range(6000)), " " * 3000 + "word" + "-" * 3000 + "x" * 2500]
    texts += ["".join(unit * r.randrange(1, 700) for unit in r.choices([" ", "-", "=", "a", "he", "x"], k=12)) for _ in range(10)]
    for t in texts:
        assert m.encode(t) == sp.encode(t), (t[:20], len(t))
    began = time.monotonic()
    for unit in (" ", "-", "a", "="):
        assert m.encode(unit * 1_000_000) == sp.encode(unit * 1_000_000)
    assert time.monotonic() - began < 30


def test_piece_digests(docs_of):
    sp = library()
    out = sentencepiece_codec.round_trip_digests(docs_of(ODD, extra=True), default_model()).collect()
    want = []
    for i, t in ODD:
        ids = [*sp.encode(t or ""), 2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert sentencepiece_codec.round_trip_digests(docs_of([]), default_model()).count() == 0
