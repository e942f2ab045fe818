import random
from collections import Counter

import corpus_pipeline
from graphloom.llm import language_id, packing
from graphloom.llm.word_bpe import WordBpe

from . import brute
from .conftest import prose
from .test_text import text_of


def test_pipeline_against_brute_force(spark, docs_of, tmp_path):
    r = random.Random(9)
    passage = text_of("en", 77, 60)
    rows = [(k, text_of(lang, k, 70), lang, "s") for k, lang in enumerate(["en", "de", "fr"] * 15)]
    rows += [(100 + k, rows[k][1].replace(" ", "  ", 3), "en", "s") for k in range(10)]  # exact copies
    for k in range(10):  # near copies
        w = rows[k + 10][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((200 + k, " ".join(w), "en", "t"))
    rows += [(300 + k, f"{text_of('en', 400 + k, 50)} {passage} {text_of('en', 500 + k, 40)}", "en", "t") for k in range(6)]  # a passage
    rows += [(900, None, None, None), (901, "", "en", None), (902, "12 34", "en", "s"), (903, prose(1, 50), None, None)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    from pyspark.sql import functions as F

    judged = {x.doc_id: x.rejected for x in language_id.identify(docs, language_id.learn(docs, F.lit(True))).collect()}
    left = [(i, t) for i, t, *_ in rows if not judged[i]]
    assert {900, 901, 902}.isdisjoint(i for i, _ in left) and sum(i < 400 for i, _ in left) == 71
    left = [(i, t) for i, t in left if brute.exact(left)[i][0] == i]
    found = brute.components(left, 5, 80)
    left = [(i, t) for i, t in left if found[i][1] == i]
    cut = {i: " ".join(kept) if len(kept) < len(w) else dict(left)[i] for i, (w, kept) in brute.without_repeats(left).items()}
    library = WordBpe(packing.default_tokenizer()).library
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in cut.items()}
    assert Counter({i: n for i, n in want.items()}) == Counter({x.doc_id: 0 for x in out}) + Counter(_lengths(out))
    assert sum(len(t.split()) < len(dict(left)[i].split()) for i, t in cut.items()) >= 5
    assert sorted(2048 - n for n in _bins(out).values()) == brute.best_fit(list(want.values()), 2048)


def _lengths(out):
    n = Counter()
    for x in out:
        n[x.doc_id] += x.length
    return n


def _bins(out):
    n = Counter()
    for x in out:
        n[x.sequence_id] += x.length
    return n


def test_stages_of_an_empty_table(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_the_columns_of_documents(spark, docs_of):
    docs = docs_of([(k, text_of("en", k), "en", "s") for k in range(12)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 12
