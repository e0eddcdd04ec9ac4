import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidings.llm import spelling
from tidings.llm.vector_trie import GROUPS, LEVELS, Words, near_pairs, shifts

from .conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    counts = counted(rows)
    near = {w: [v for v in counts if edit_one(v, w)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best and counts[best] >= 2 * counts[word] else None
    out = set()
    for word in counts:
        root = word
        while form[root]:
            root = form[root]
        own = form[word]
        out.add((word, own, root, counts[word], len(near[word]), counts.get(own)))
    return out


def got(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(n, seed, letters="abehtñÉ"):
    draw = random.Random(seed)
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(3, 9))) for _ in range(40)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(draw.randint(0, 60)):
            word = list(draw.choice(stems[: draw.choice((4, 40))]))
            if draw.random() < 0.3:
                at = draw.randrange(len(word))
                word[at : at + draw.randint(0, 1)] = draw.choice(letters) * draw.randint(0, 1)
            words.append("".join(word))
        rows.append((k % 150 if k % 9 else None, draw.choice((" ", ", ", "\n", "1")).join(words)))
    return rows


@pytest.mark.parametrize("block_words", [1, 10, spelling.BLOCK_WORDS])
def test_equals_brute_force(docs, block_words):
    chain = [(None, "kettle " * 60 + "kettlx " * 20 + "ketylx " * 7 + "hetylx " * 3)]
    rows = made_up(200, 1) + made_up(100, 2, "ab") + ODD + chain
    found = got(spelling.variants(docs(rows), block_words))
    assert found == brute(rows)
    assert max(r[4] for r in found) > 3 and any(r[2] != (r[1] or r[0]) for r in found)


def test_small_and_empty_tables(docs, odd, empty):
    assert got(spelling.variants(empty)) == set()
    assert got(spelling.variants(odd)) == brute(ODD)
    assert got(spelling.variants(docs([(1, None), (2, "few few few short")]))) == set()


def test_very_long_words_and_frequent_ones(docs):
    long = "y" * 50_000
    rows = [(k, f"{long} {long[:-1]} frequent " * 2) for k in range(4)] + [(9, "frequemt " * 4)]
    rows += [(None, "frequent ") for _ in range(500)] * 2
    assert got(spelling.variants(docs(rows))) == brute(rows)


def test_counting_in_small_parts_changes_nothing(docs, monkeypatch):
    rows = made_up(80, 3)
    monkeypatch.setattr(spelling, "KEPT_WORDS", 5)
    assert {(r.word, r.n) for r in spelling.word_counts(docs(rows)).collect()} == set(counted(rows).items())


@pytest.mark.parametrize("level", [0, 3, LEVELS])
def test_trie_pairs(level):
    words = sorted({w.encode("latin-1") for w in counted(made_up(300, 4))})
    vectors = Words(words).vectors
    own = [w for w, v in zip(words, vectors) if (v[:level] == vectors[0, :level]).all()]
    rest = [w for w in words if w not in own]
    both = own + rest
    found = [p for a, b in near_pairs(Words(both), len(own), level) for p in zip(a.tolist(), b.tolist())]
    want = {
        (x, y)
        for y in range(len(own))
        for x in [*range(y), *range(len(own), len(both))]
        if edit_one(both[x], both[y])
    }
    assert len(found) == len(set(found)) and set(found) == want


def test_groups_and_shifts():
    assert len(set("".join(GROUPS))) == 26
    moves = {tuple(r) for r in shifts(4).tolist()}
    assert len(moves) == 10 and all(min(m) >= -1 and sum(map(abs, m)) <= 2 for m in moves)
    assert all(tuple(-np.array(m)) not in moves for m in moves)
