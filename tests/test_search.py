"""Manifest states, index segments, ranking and phrases."""

import math
import re
from collections import Counter

import pytest

from tidings.operators.search import B, K1, Fields, SearchIndex
from tidings.sources.manifest import Conflict, Manifest

SCHEMA = "id long, title string, body string, hashtags array<string>"
NOTES = [
    (1, "Exam dates", "the exam is on monday and the exam hall opens early", ["exam"]),
    (2, "Holiday", "no exam on monday", None),
    (3, None, "monday exam", ["a", "exam hall"]),
    (4, "Café menu", "", []),
    (5, "", "on and on and on and off", None),
]


def test_manifest_takes_each_number_once(spark, tmp_path):
    first, second = (Manifest(spark, str(tmp_path / "m")) for _ in range(2))
    assert first.state() == (0, {})
    assert first.update(lambda s, _: s | {"a": 1}) == 1

    def slow(state, _):
        if "b" not in state:
            assert second.update(lambda s, _: s | {"b": 2}) >= 2  # comes in between
        return state | {"c": len(state)}

    first.update(slow)
    assert second.state()[1] == {"a": 1, "b": 2, "c": 2}
    assert first.state(before=2) == (1, {"a": 1})
    (tmp_path / "m" / "000000000099.json").touch()  # of a writer that was lost
    assert first.state()[1] == {"a": 1, "b": 2, "c": 2}
    assert first.update(lambda s, n: {}) == 100

    def refuse(state, _):
        raise Conflict("changed")

    with pytest.raises(Conflict):
        first.update(refuse)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def ranked(notes, query, weights=(3.0, 1.0, 2.0)):
    fields = {i: [words(t), words(b), words(" ".join(h or []))] for i, t, b, h in notes}
    mean = [sum(len(f[k]) for f in fields.values()) / len(fields) for k in range(3)]
    score = Counter()
    for term in set(words(query)):
        holding = {i: f for i, f in fields.items() if any(term in x for x in f)}
        rarity = math.log(1 + (len(fields) - len(holding) + 0.5) / (len(holding) + 0.5))
        for i, f in holding.items():
            repeats = sum(
                w * x.count(term) / (1 - B + B * (len(x) / m if m else 0)) for w, x, m in zip(weights, f, mean)
            )
            score[i] += rarity * repeats / (K1 + repeats)
    return sorted(((i, round(s, 6)) for i, s in score.items()), key=lambda p: (-p[1], p[0]))


def holding(notes, phrase):
    want, out = words(phrase), {}
    for i, *fields in notes:
        n = 0
        for text in (fields[0], fields[1], " ".join(fields[2] or [])):
            found = words(text)
            n += sum(found[k : k + len(want)] == want for k in range(len(found) - len(want) + 1))
        if n and want:
            out[i] = n
    return out


QUERIES = ["exam monday", "café", "hall", "on and on", "nothing here", "", "exam hall", "monday exam on"]


def check(spark, index, notes):
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    top = index.topk(queries, 3).orderBy("query_id", "rank").collect()
    hits = index.phrases(queries).collect()
    for q, text in enumerate(QUERIES):
        assert [(r.id, r.score) for r in top if r.query_id == q] == ranked(notes, text)[:3], text
        assert {r.id: r.n_hits for r in hits if r.query_id == q} == holding(notes, text), text


def test_segments_updates_and_merge(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert index.topk(spark.createDataFrame([(1, "x")], "query_id int, text string")).count() == 0
    index.add(frame(NOTES[:3]))
    check(spark, index, NOTES[:3])
    newer = [(2, "Holiday", "the exam hall is closed", ["exam"]), *NOTES[3:]]
    index.add(frame(newer), spark.createDataFrame([(1,)], "id long"))
    now = [newer[0], NOTES[2], *newer[1:]]
    check(spark, index, now)
    assert len(index.segments()) == 2
    index.merge()
    assert len(index.segments()) == 1
    check(spark, index, now)
    index.add(frame([NOTES[0]]))  # removed once, now there again
    check(spark, index, [*now, NOTES[0]])


def test_segments_of_two_runs_at_once(spark, tmp_path):
    one, two = (SearchIndex(spark, str(tmp_path / "index"), Fields()) for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    update, once = one.manifest.update, []

    def between(change):
        if not once:
            once.append(two.add(frame(NOTES[2:])))
        return update(change)

    one.manifest.update = between
    one.add(frame(NOTES[:2]))
    check(spark, one, NOTES)


def test_a_query_reads_the_files_of_its_terms(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"))
    rows = [(k, f"title{k}", " ".join(f"word{k * 7 + j}" for j in range(20)), None) for k in range(60)]
    index.add(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([("word3",)], "term string")
    found = index.matching(asked)
    assert [r.id for r in found.collect()] == [0]
    everything = spark.read.parquet(f"{index.path}/postings/{index.segments()[0]}").inputFiles()
    assert 0 < len({f.rsplit("bucket=")[1].split("/")[0] for f in everything}) > 20
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "body" not in plan


def test_postings_of_a_notice_are_made_without_a_shuffle(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"))
    rows = [(1, "B a b", "a a", ["b"]), (2, None, "", None)]
    postings = index.postings_of(spark.createDataFrame(rows, SCHEMA))
    assert "Exchange" not in postings._jdf.queryExecution().toString()
    step = 1 << 40
    got = {(r.term, r.id): (r.positions, r.lengths) for r in postings.collect()}
    assert got == {("a", 1): ([1, step, step + 1], [3, 2, 1]), ("b", 1): ([0, 2, 2 * step], [3, 2, 1])}


def test_merging_shuffles_no_postings(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, str(tmp_path / "index"))
    for rows in (NOTES[:3], NOTES[1:]):
        index.add(spark.createDataFrame(rows, SCHEMA))
    plans, store = [], index._store
    monkeypatch.setattr(
        index, "_store", lambda p, s: (plans.append(p._jdf.queryExecution().executedPlan().toString()), store(p, s))
    )
    index.merge()
    assert "Scan parquet" in plans[0] and "Exchange hash" not in plans[0] and "Exchange range" not in plans[0]
    check(spark, index, NOTES)
