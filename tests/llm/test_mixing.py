import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidings.llm import mixing

from .conftest import ODD

SCHEMA = "doc_id long, text string, source string, record int, `key` string, size int, copies int"


def filled(sizes, weights=mixing.WEIGHTS, share=1.5, most=2.0):
    """Targets by handing out what is over, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    left = share * sum(sizes.values())
    while left > 1e-9 and len(full) < len(names):
        total = sum(weight[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] += left * weight[s] / total
        left = 0.0
        for s in names:
            if s not in full and target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


def copies_of(doc_id, text, source, number, rate):
    parts = (str(mixing.SEED), "" if doc_id is None else str(doc_id))
    parts += (hashlib.md5((text or "").encode()).hexdigest(), "" if source is None else "s" + source)
    key = hashlib.md5(":".join(parts).encode()).hexdigest()
    drawn = int(hashlib.md5(f"{key}:{number}".encode()).hexdigest()[:13], 16) / 16**13
    return math.floor(rate) + (drawn < rate - math.floor(rate))


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, source), n in zip(rows, size):
        sizes[source] += n
    target, seen, out = filled(sizes), Counter(), Counter()
    for row, n in zip(rows, size):
        source = row[2]
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        out[row[0], n, sizes[source], round(target[source], 6), copies_of(*row, seen[row], rate)] += 1
        seen[row] += 1
    return out


def frame(spark, rows, partitions=3):
    wide = [(i, t, s, 1, "k", 2, 3) for i, t, s in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(partitions)


def planned(docs):
    plan = mixing.planned(docs, mixing.n_words(F.col("text")))
    rows = plan.select("record.doc_id", "size", "source_size", "target", "copies").collect()
    return Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows)


ROWS = [(i, t, ("b", None, "a", "")[k % 4]) for k, (i, t) in enumerate(ODD)]
ROWS += [(k, "w " * (k % 50), f"s{k % 7}") for k in range(600)]
ROWS += [(9, "one text of many rows", "hot")] * 900 + [(None, "no id", None)] * 40


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_equals_brute_force_however_split(llm, partitions):
    assert planned(frame(llm, ROWS, partitions)) == brute(ROWS)


def test_empty_tables_and_texts(llm):
    assert planned(frame(llm, [])) == Counter()
    none = [(1, None, "a"), (2, " \n", None), (3, "", "a")]
    assert planned(frame(llm, none)) == brute(none)
    assert all(row[4] == 0 for row in brute(none))


def test_targets_are_filled_by_weight(llm):
    sizes = {"a": 10, "b": 1000, "c": 40, "d": 5000, None: 1, "": 0, "e": 700}
    totals = llm.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(totals).collect()}
    assert got == pytest.approx(filled(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_rows_of_one_key_near_their_target(llm):
    plan = mixing.planned(frame(llm, ROWS), mixing.n_words(F.col("text")))
    hot = plan.filter("record.source = 'hot'").agg(
        F.first("target"), F.sum(F.col("size") * F.col("copies")), F.max("copies")
    )
    target, taken, most = hot.first()
    assert abs(taken - target) < 0.1 * target and most <= 2


def test_the_mix_holds_every_copy_with_its_columns(llm):
    docs = frame(llm, ROWS)
    out = mixing.mixed(docs, mixing.n_words(F.col("text")))
    assert out.columns == docs.columns
    want = Counter()
    for (doc_id, _, _, _, copies), n in planned(docs).items():
        want[doc_id] += n * copies
    assert Counter(r.doc_id for r in out.collect()) == +want
