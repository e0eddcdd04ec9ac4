import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidings.llm import personal_data as pd
from tidings.llm import sharding

from .conftest import ODD

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in pd.CARD.finditer(text) if pd.is_card(m[0])]
    out += [
        ("phone", *m.span())
        for m in pd.PHONE.finditer(text)
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15
    ]
    return out


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choice("a@.b1 2.@3+4-()5é٣") for _ in range(draw.randint(0, 45)))
        assert pd.detect(text) == brute(text), text


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("to alice AT mail DOT example DOT org.", "email", "alice AT mail DOT example DOT org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("é john＠example．com", "email", "john＠example．com"),
        ("call plus one five five five zero one two three four five six", "phone",
         "plus one five five five zero one two three four five six"),
        ("at one nine two dot one six eight dot zero dot one", "ip",
         "one nine two dot one six eight dot zero dot one"),
        ("4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ],
)
def test_disguises(text, kind, found):
    hidden = pd.hidden(text, pd.detect(text))
    assert [(k, text[s:e]) for k, s, e in hidden] == [(kind, found)]
    assert found not in pd.clean(text) and f"[{kind.upper()}]" in pd.clean(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("to jоhn@example.com now", "email", "jоhn@example.com"),
        ("to john@mail.exаmple.com now", "email", "john@mail.exаmple.com"),
        ("call +1 555 012 34５６ now", "phone", "+1 555 012 34５６"),
    ],
)
def test_disguise_of_a_part(text, kind, found):
    base = pd.detect(text)
    assert base
    assert (kind, text.index(found), text.index(found) + len(found)) in pd.hidden(text, base)
    assert pd.clean(text) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("so anna at firma dot pl wrote", "email", "anna at firma dot pl"),
        ("so anna at firma dot xyz wrote", "email", "anna at firma dot xyz"),
        ("to jane at example.com now", "email", "jane at example.com"),
        ("to jane at mail.example dot com now", "email", "jane at mail.example dot com"),
        ("to jane at mail dot example.com. Then", "email", "jane at mail dot example.com"),
        ("write at john dot doe at example dot com", "email", "john dot doe at example dot com"),
        ("host 192.168.zero.one up", "ip", "192.168.zero.one"),
        ("host 192[.]168[.]zero[.]1 up", "ip", "192[.]168[.]zero[.]1"),
        ("card 4111 1111 1111 111 one ok", "card", "4111 1111 1111 111 one"),
        ("in 1999, 4111 1111 1111 111 one ok", "card", "4111 1111 1111 111 one"),
        ("call +1 555 012 34 five six", "phone", "+1 555 012 34 five six"),
        ("one, " * 60 + "plus one, five, five, five, zero, one, two, three, four, five", "phone",
         "plus one, five, five, five, zero, one, two, three, four, five"),
    ],
)
def test_disguises_without_narrow_gates(text, kind, found):
    spans = {(k, text[s:e]) for k, s, e in pd.hidden(text, pd.detect(text))}
    assert (kind, found) in spans
    assert found not in pd.clean(text) and f"[{kind.upper()}]" in pd.clean(text)


@pytest.mark.parametrize("form", [
    "john@example[ . ]com", "john@example<.>com", "john (  at  ) example.com", "john [  @  ] example.com",
    "john_at_example.com", "john_at_example_dot_com", "john&#64;example&#46;com", "john&commat;example.com",
    "john{at}example{dot}com", "john <at> example <dot> com", "john [at] example (dot) com",
])
def test_brackets_and_entities(form):
    text = f"write {form} now"
    (span,) = pd.hidden(text, pd.detect(text))
    assert (span[0], text[span[1] : span[2]]) == ("email", form)
    assert pd.clean(text) == "write [EMAIL] now"


def test_the_gate_passes_what_the_rewriting_takes():
    """Whatever form a sign is written in, a text that the gate holds back hides nothing."""
    draw, taken = random.Random(8), 0
    pad = lambda: " " * draw.choice((0, 0, 1, 2, 3))
    for _ in range(4000):
        sign = lambda names: draw.choice("[({<") + pad() + draw.choice(names) + pad() + draw.choice("])}>")
        at = draw.choice([sign(("at", "@", "AT")), "_at_", "&#64;", " at ", "  at ", "@"])
        dot = draw.choice([sign(("dot", ".", "Dot")), "_dot_", "&#46;", " dot ", "."])
        text = f"so john{pad()}{at}{pad()}example{pad()}{dot}{pad()}com then"
        if pd.disguised(text):
            taken += 1
            continue
        base = pd.detect(text)
        spans = [s for seen in pd.rewritings(text) for s in pd.detect(seen.text)]
        assert len(spans) <= len(base), text
    assert taken > 2000


def test_a_long_run_of_spelled_digits_is_one():
    text = "plus " + "one " * 15 + "x " + "four " + "one " * 14 + "one " * 41 + "end"
    assert len(pd.digit_edits("one, " * 60)) == 120 - 1
    assert all(e[2] in "+14" for e in pd.digit_edits(text))


@pytest.mark.parametrize("text", ["write at john.doe@example.com", "be at 5.30 or at home.Then go", "one 2 three"])
def test_no_false_finds(text):
    assert pd.hidden(text, pd.detect(text)) == []


@pytest.mark.parametrize("text", ["we met at the dot on the map", "one two three four", "Élan à été", "at 10.5 dot"])
def test_clean_text_stays(text):
    assert pd.hidden(text, pd.detect(text)) == [] and pd.clean(text) == text


@pytest.mark.parametrize("unit", ["1", "a", "@", "a@", "1 ", "+1", " ", " dot ", "one ", "1.", "(at)"])
def test_detection_is_linear(unit):
    text = unit * (200_000 // len(unit))
    start = time.process_time()
    pd.hidden(text, pd.detect(text))
    assert time.process_time() - start < 5


def test_found_odd_rows(odd, empty):
    out = pd.found(odd).collect()
    assert len(out) == len(ODD) and all(r.spans == "" for r in out)
    assert pd.found(empty).count() == 0


def test_shards_hold_every_row_once(odd, empty):
    assert sharding.sharded(empty, F.lit(1)).count() == 0
    out = sharding.sharded(odd, F.lit(8), shards=3).select("record.*", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(ODD)
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_are_shuffled_and_repeatable(docs):
    rows = docs([(i, f"t{i}") for i in range(2000)])
    first = sharding.sharded(rows, F.lit(8)).select("record.doc_id", "shard", "slot").collect()
    places = {r.doc_id: 8 * r.slot + r.shard for r in first}
    assert sorted(places.values()) == list(range(2000))
    moved = sum(abs(places[i] - i) for i in range(2000)) / 2000
    assert 500 < moved < 800  # two thirds of a thousand, for a random order
    other = sharding.sharded(rows, F.lit(8), seed=1).select("record.doc_id", "shard", "slot").collect()
    assert {r.doc_id: 8 * r.slot + r.shard for r in other} != places


def test_op10_moves_whole_rows(docs, llm, tmp_path, monkeypatch):
    given = {i: None if i == 3 else f"é{i} " * (40_000 if i % 20 == 0 else 5) for i in range(100)}
    docs(list(given.items())).write.parquet(str(tmp_path / "documents.parquet"))
    seen, whole = [], sharding.sharded

    def spy(records, weight, *rest):
        seen.append((records.columns, records.agg(F.sum(weight)).first()[0]))
        return whole(records, weight, *rest)

    monkeypatch.setattr(sharding, "sharded", spy)
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 18)
    out = sharding.op10_two_pass_shuffle(llm, str(tmp_path)).collect()
    raw = {i: (t or "").encode() for i, t in given.items()}
    assert "text" in seen[0][0] and seen[0][1] == sum(len(t) + 1 for t in raw.values())
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == {
        i: (len(t) + 1, zlib.crc32(t)) for i, t in raw.items()
    }
    assert sorted(8 * r.slot + r.shard for r in out) == list(range(100))


def test_sharding_runs_without_python(docs):
    plan = sharding.sharded(docs([(1, "a")]), F.lit(8))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_written_shards(docs, llm, tmp_path):
    sharding.write_shards(docs([(i, f"t{i}") for i in range(40)]), F.lit(8), str(tmp_path / "s"), 4)
    back = llm.read.parquet(str(tmp_path / "s"))
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == dict.fromkeys(range(4), 10)


def labelled(llm, tmp_path, rows):
    llm.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    return str(tmp_path)


def test_pipeline_stages(docs, llm, tmp_path):
    draw = random.Random(9)

    def prose(n=120):
        return " ".join(f"{draw.choice('abcdefgh')}{draw.randint(0, 5000)}" for _ in range(n))

    good = {i: prose() for i in range(60)}
    junk = {100 + i: " ".join(f"{w}$$$" for w in prose().split()) for i in range(40)}
    passage = prose(80)
    given = good | junk | {
        200: good[3] + " end", 201: f"{prose(60)} {passage} {prose(60)}",
        202: f"{prose(60)} {passage} {prose(60)}", 203: f"{prose(60)} write to a.b@example.com now",
    }
    sf_dir = labelled(llm, tmp_path, [(i, int(i < 100), 0) for i in good | junk])
    frame = docs(list(given.items()))
    kept = corpus_pipeline.keep_quality(llm, frame, sf_dir)
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= set(good) | {200, 201, 202, 203} and not ids & set(junk)
    assert kept.schema.names == frame.schema.names
    one = corpus_pipeline.one_of_near_duplicates(llm, kept, sf_dir)
    assert {r.doc_id for r in one.collect()} == ids - {200}
    left = corpus_pipeline.without_repeated_passages(llm, one, sf_dir)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[201] == given[201] and len(texts[202]) < len(given[202]) - 200
    assert all(texts[i] == good[i] for i in good)
    clean = corpus_pipeline.without_personal_data(llm, left, sf_dir)
    assert "[EMAIL]" in {r.doc_id: r.text for r in clean.collect()}[203]
    assert clean.schema.names == frame.schema.names
    assert {r.doc_id for r in corpus_pipeline.packed_sequences(llm, clean, sf_dir).collect()} == ids - {200}


def test_pipeline_odd_rows(odd, empty, llm, tmp_path):
    sf_dir = labelled(llm, tmp_path, [])
    for frame, most in ((odd, len(ODD)), (empty, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(llm, frame, sf_dir)
            assert frame.count() <= most
        corpus_pipeline.STAGES[-1][1](llm, frame, sf_dir).count()


def test_stage_columns_may_bear_any_name(docs, llm, tmp_path):
    draw = random.Random(12)
    words = [f"w{draw.randint(0, 9999)}" for _ in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(words[:50] + words[:50]))]
    names = ("of", "_of", "gone", "elsewhere", "left", "clean", "rep", "key", "digest", "_text")
    frame = docs(rows)
    for name in names:
        frame = frame.drop(name).withColumn(name, F.lit(name))
    sf_dir = labelled(llm, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(llm, frame, sf_dir)
        assert after.columns == frame.columns
        assert all(r[n] == n for r in after.select(*names).collect() for n in names)
        frame = after
    assert corpus_pipeline.STAGES[-1][1](llm, frame, sf_dir).count()
