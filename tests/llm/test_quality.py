import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.llm import labelled, nb_svm, quality_rules
from tidings.llm.catalog import QUERIES
from tidings.llm.words import spans, word_hashes

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def brute_rules(text):
    spaces = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in spaces:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(spaces):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
    }


def test_rules_equal_brute_force():
    draw = random.Random(3)
    texts = [t or "" for _, t in ODD if len(t or "") < 1000]
    texts += ["".join(draw.choice("ab é#\n\x0b *") for _ in range(draw.randint(0, 80))) for _ in range(2000)]
    for text in texts:
        assert quality_rules.Text(text.encode()).rules() == brute_rules(text), text


def test_word_hashes_tell_words_apart():
    words = [f"w{i}" for i in range(5000)]
    assert len(set(word_hashes(" ".join(words).encode()).tolist())) == 5000
    starts, ends = spans(np.frombuffer(b" a\tbc ", np.uint8))
    assert (starts.tolist(), ends.tolist()) == ([1, 3], [2, 5])


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_fold_equals_crc32(llm):
    frame = llm.range(50).select("id", labelled.held_out(F.col("id")).alias("h"))
    assert all(r.h == held(r.id) for r in frame.collect())


@pytest.mark.parametrize("name", ["op1_nb_svm_quality", "op3_ngram_quality_rules"])
def test_held_out_accuracy(llm, name):
    labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    out = QUERIES[name](llm, SF).collect()
    assert len(out) == llm.read.parquet(f"{SF}/documents.parquet").count()
    judged = [(r.predicted if "predicted" in r else int(r.kept), labels[r.doc_id]) for r in out
              if r.doc_id in labels and held(r.doc_id)]
    assert np.mean([p == y for p, y in judged]) > 0.95
    # Few good documents may be lost.
    assert np.mean([p for p, y in judged if y == 1]) > 0.97


def test_labels_of_the_held_out_fold_are_not_used(docs, llm):
    rows = [(i, f"text number {i}") for i in range(200)]
    labels = llm.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    x, y = labelled.sample(docs(rows), labels, nb_svm.indicators)
    assert len(x) == len(y) == sum(not held(i) for i in range(200))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - quality, quality) AS quality")
    x2, y2 = labelled.sample(docs(rows), flipped, nb_svm.indicators)
    assert y.tolist() == y2.tolist() and all((a == b).all() for a, b in zip(x, x2))


def test_the_sample_is_bounded(docs, llm):
    labels = llm.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    x, _ = labelled.sample(docs([(i, "a b c") for i in range(200)]), labels, nb_svm.indicators, rows=30)
    assert len(x) == 30


def test_an_id_that_many_rows_share_is_sampled_once(docs, llm):
    labels = llm.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    x, y = labelled.sample(docs([(1, f"text {i}") for i in range(300)] + [(2, None)]), labels, nb_svm.indicators)
    assert y.tolist() == [1, 0][: len(y)] and len(x) == sum(not held(i) for i in (1, 2))
    assert len(y) == 0 or (x[0] == nb_svm.indicators(b"text 0")).all() or held(1)


def test_character_ngrams_are_of_characters():
    assert len(quality_rules.Text("é漢字😀".encode()).blocks()[1]) == 3  # two of three characters, one of four


def test_dual_coordinate_descent_separates():
    x = [np.array([i % 2, 2 + i % 7]) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    ratios = nb_svm.log_count_ratios(x, y)
    assert ratios[0] < 0 < ratios[1]
    w, bias = nb_svm.descend(x, y, ratios)
    assert all(((w * ratios)[xi].sum() + bias > 0) == yi for xi, yi in zip(x, y))


def test_odd_rows(odd, empty, llm):
    none = llm.createDataFrame([], "doc_id long, quality int")
    model = nb_svm.fitted(odd, none)
    scores = nb_svm.scored(odd, model).collect()
    assert len(scores) == len(ODD) and all(r.score == 0.5 for r in scores)
    rules = quality_rules.judged(odd, quality_rules.fitted(odd, none)).collect()
    by_id = {r.doc_id: r for r in rules}
    assert by_id[1].base_failed and not by_id[1].kept and by_id[1].n_words == 0
    assert by_id[None].kept and by_id[7].n_words == 60_000
    assert nb_svm.scored(empty, model).count() == quality_rules.judged(empty, quality_rules.Logistic()).count() == 0


def test_labels_of_absent_documents_take_no_place_in_the_sample(docs, llm):
    """100 documents and a far wider table of labels: every usable label is used."""
    pairs = [(i, f"text number {i}") for i in range(100)]
    labels = llm.createDataFrame([(i, i % 2) for i in range(40_000)], "doc_id long, quality int")
    x, y = labelled.sample(docs(pairs), labels, nb_svm.indicators, 200)
    usable = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert len(x) == len(y) == len(usable) and int(y.sum()) == sum(i % 2 for i in usable)
