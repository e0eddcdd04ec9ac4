import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tidings.llm import chunk_dedup, grid_join, jaccard_join
from tidings.llm.components import components
from tidings.llm.words import shingles

from .conftest import ODD


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def words(draw, n):
    return [f"{draw.choice('abcdefgh')}{draw.randint(0, 3000)}" for _ in range(n)]


def test_components(llm):
    draw = random.Random(1)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(300)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    out = components(llm.createDataFrame(links, "a long, b long")).collect()
    want = brute_components({n for e in links for n in e}, links)
    assert {r.node: r.component for r in out} == {n: want[n] for a, b in links if a != b for n in (a, b)}
    assert len(out) == len({r.node for r in out})
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(pairs, threshold=0.8):
    """Links by the sets themselves."""
    sets = {}
    for i, t in pairs:
        w = (t or "").split()
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets[i] = (t or "", grams)
    links = []
    for a, b in combinations(sorted(sets), 2):
        (ta, x), (tb, y) = sets[a], sets[b]
        if ta == tb or (x | y and len(x & y) / len(x | y) >= threshold):
            links.append((a, b))
    return links, brute_components(sets, links)


def family(draw, first, n, size, changes):
    base = words(draw, size)
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(draw.randint(0, changes)):
            own[draw.randrange(size)] = f"new{draw.randint(0, 10**6)}"
        out.append((first + k, " ".join(own)))
    return out


def test_jaccard_join_equals_brute_force(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)  # so that groups take several blocks
    draw = random.Random(2)
    pairs = [(i, " ".join(words(draw, draw.randint(1, 120)))) for i in range(60)]
    pairs += family(draw, 100, 40, 150, 6) + family(draw, 200, 25, 60, 4) + family(draw, 300, 12, 7, 1)
    pairs += [(400 + i, "equal text of five words") for i in range(30)] + [(500, None), (501, ""), (502, " ")]
    links, want = brute_classes(pairs)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for row in jaccard_join.classes(docs(pairs)).collect():
        assert row.class_id == want[row.doc_id]
        assert row.n_links == count[row.doc_id], row
        assert row.kept == (row.doc_id == row.class_id)


def test_jaccard_join_odd_rows(odd, empty):
    out = jaccard_join.classes(odd).collect()
    assert len(out) == len(ODD)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].class_id == by_id[2].class_id == 1 and by_id[3].class_id == 3
    assert by_id[5].class_id == 4 and not by_id[5].kept and by_id[4].n_links == 1
    assert by_id[None].class_id is None and by_id[None].kept
    assert jaccard_join.classes(empty).count() == 0


def test_texts_that_share_an_id_or_have_none_are_compared(docs, llm):
    draw = random.Random(21)
    near = [family(draw, 0, 2, 400, 2) for _ in range(12)]
    other = [" ".join(words(draw, 100)) for _ in range(8)]
    pairs = [(7, t) for t in other] + [(None, other[0]), (3, other[1]), (7, other[2])]
    for k, ((_, a), (_, b)) in enumerate(near):
        pairs += [(7, a), (20 + k if k % 3 else None, b)]
    pairs += [(None, "no id twice over " * 9), (None, "no id twice over " * 9)]
    rows = jaccard_join.classes(docs(pairs)).collect()
    assert len(rows) == len(pairs)
    assert sum(r.n_links > 0 for r in rows) == 2 * len(near) + 4
    assert sum(r.class_id == 3 for r in rows) == 2 and sum(r.class_id is None for r in rows) == 2
    left = corpus_pipeline.one_of_near_duplicates(llm, docs(pairs), "")
    got = sorted((r.text, r.doc_id) for r in left.collect())
    first = {t: 7 for t in other} | {other[1]: 3} | {a: 7 for (_, a), _ in near}
    # A class keeps one row; of near texts under one id, or none, that of least digest.
    assert len(got) == len(other) + len(near) + 1
    assert all(first.get(t, i) == i for t, i in got) and {t for t, _ in got} >= set(other)


def test_posterior_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches(0.8, 1e-7)
    draw = np.random.default_rng(1)
    same = draw.random((20_000, 96)) < 0.8
    for look, need in enumerate(least, 1):
        assert (same[:, : 16 * look].sum(axis=1) >= need).all()
    assert (np.random.default_rng(2).random((1000, 96)) < 0.3).sum(axis=1).max() < least[-1]


def test_intersections_agree():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 300, 100).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    many = jaccard_join.intersections(sets, a, b)
    few = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert many.tolist() == few
    assert jaccard_join.intersections(sets, a[:5], b[:5]).tolist() == few[:5]


def test_shingles_of_short_texts():
    assert len(shingles(b"")) == 0 and len(shingles(b"a b")) == 1
    assert shingles(b"a b").tolist() != shingles(b"a b c").tolist()


def test_planted_passages_go(docs):
    draw = random.Random(4)
    passages = [words(draw, draw.randint(51, 90)) for _ in range(60)]
    pairs, holders = [], defaultdict(list)
    for i in range(180):
        own = words(draw, 200)
        at = draw.randrange(200)
        pairs.append((i, " ".join(own[:at] + passages[i % 60] + own[at:])))
        holders[i % 60].append(i)
    clean = [(1000 + i, "\n".join(" ".join(words(draw, 30)) for _ in range(5))) for i in range(60)]
    out = {r.doc_id: r for r in chunk_dedup.deduplicated(docs(pairs + clean)).collect()}
    given = dict(pairs + clean)
    missed = 0
    for p, own in holders.items():
        assert out[own[0]].text == given[own[0]]  # the first keeps it
        missed += sum(" ".join(passages[p]) in out[i].text for i in own[1:])
        # What goes is of the passage only.
        assert all(out[i].n_removed_words <= len(passages[p]) for i in own)
    assert missed <= 2
    assert all(out[i].text == t and out[i].removed == "" for i, t in clean)


def test_removed_spans_and_text_agree(docs):
    draw = random.Random(6)
    long = " ".join(f"é{w}" for w in words(draw, 80))
    out = chunk_dedup.deduplicated(docs([(1, long), (2, f"x {long}\n{long} y z"), (3, long)])).collect()
    given = {1: long, 2: f"x {long}\n{long} y z", 3: long}
    for row in out:
        text, last, kept = given[row.doc_id], 0, ""
        for span in filter(None, row.removed.split(",")):
            a, b = map(int, span.split(":"))
            kept, last = kept + text[last:a], b
        assert kept + text[last:] == row.text
    assert {r.doc_id: r.n_removed_words for r in out}[3] == 80
    assert {r.doc_id: r.n_removed_words for r in out}[1] == 0


def test_chunks_resist_insertions():
    draw = random.Random(8)
    own = words(draw, 400)
    a = set(chunk_dedup.Chunks(" ".join(own).encode()).new().tolist())
    b = set(chunk_dedup.Chunks(" ".join(own[:200] + ["inserted"] + own[200:]).encode()).new().tolist())
    assert len(a & b) > 0.85 * len(a)


def test_chunk_dedup_odd_rows(odd, empty):
    out = chunk_dedup.deduplicated(odd).collect()
    assert len(out) == len(ODD)
    assert {r.doc_id: r.text for r in out}[1] == ""
    assert chunk_dedup.deduplicated(empty).count() == 0


def vectors_like(llm, rows):
    return llm.createDataFrame(rows, "label int, vec_id long, embedding array<float>, block string")


def test_grid_join_equals_brute_force(llm, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 64)
    monkeypatch.setattr(grid_join, "LEAF", 16)
    monkeypatch.setattr(grid_join, "FAN", 3)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(30, 12))
    x = np.repeat(centres, 20, axis=0) + draw.normal(size=(600, 12)) * 0.12
    x[50:60] = x[50]
    x = x.astype(np.float32)
    rows = [(0, i * 3, v.tolist(), "b") for i, v in enumerate(x)]
    out = grid_join.near_duplicates(vectors_like(llm, rows)).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    links = [(int(i) * 3, int(j) * 3) for i, j in zip(a, b)]
    want = brute_components([r[1] for r in rows], links)
    count = defaultdict(int)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    assert len(links) > 500 and len(out) == 600
    for r in out:
        assert (r.component_id, r.n_links) == (want[r.vec_id], count[r.vec_id])
        assert r.kept == (r.component_id == r.vec_id)


def test_grid_join_odd_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0], None), (0, 2, [2.0, 0.0], None), (0, 3, None, None), (0, 4, [0.0, 0.0], None),
        (0, 5, [nan, 1.0], None), (0, 6, [inf, 1.0], None), (0, 7, [None, 1.0], None), (0, 8, [], None),
        (0, 9, [1.0, 0.0, 0.0], None), (0, None, [1.0, 0.0], None), (0, 2, [2.0, 0.0], None),
        (0, 10, [1e30, 0.0], None),
    ]
    out = grid_join.near_duplicates(vectors_like(llm, rows)).collect()
    assert len(out) == len(rows)
    by_id = {r.vec_id: r for r in out}
    assert by_id[2].component_id == by_id[10].component_id == 1 and by_id[2].n_links == 2
    assert all(by_id[k].n_links == 0 and by_id[k].kept for k in (3, 4, 5, 6, 7, 8, 9, None))
    assert grid_join.near_duplicates(vectors_like(llm, [])).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_join_of_lengths_and_shared_ids(llm, kind, monkeypatch):
    """Every length is joined, and every vector under an id; against all pairs."""
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    draw = np.random.default_rng(9)
    rows = []
    for length, n in ((2, 40), (3, 150), (7, 90), (40, 60)):
        centres = draw.normal(size=(6, length))
        x = np.repeat(centres, n // 6 + 1, axis=0)[:n] + draw.normal(size=(n, length)) * 0.15
        rows += [(int(draw.integers(0, 200)), v.astype(np.float32).tolist()) for v in x]
    rows += [(7, [1.0, 0.0]), (7, [0.0, 1.0, 0.0]), (9, [0.0, 3.0, 0.0]), (900, [5.0, 0.0]), (7, [1.0, 0.0])]
    frame = llm.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    out = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in grid_join.near_duplicates(frame).collect())

    nodes = sorted({(i, tuple(v)) for i, v in rows})
    unit = [np.array(v) / np.linalg.norm(v) for _, v in nodes]
    links = [
        (a, b)
        for a in range(len(nodes))
        for b in range(a)
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ]
    root = brute_components(range(len(nodes)), links)
    least = {}
    for k, (vec_id, _) in enumerate(nodes):
        least[root[k]] = min(vec_id, least.get(root[k], vec_id))
    count = Counter(k for pair in links for k in pair)
    place = {node: k for k, node in enumerate(nodes)}
    want = Counter()
    for vec_id, v in rows:
        k = place[vec_id, tuple(v)]
        want[vec_id, count[k], least[root[k]], vec_id == least[root[k]]] += 1
    assert len(links) > 1000 and out == want


def test_chunks_of_shared_and_missing_ids_are_compared(docs):
    """One passage in texts under one id and without any: one text keeps it."""
    draw = random.Random(31)
    passage = " ".join(words(draw, 90))
    texts = [f"{' '.join(words(draw, 30))} {passage} {' '.join(words(draw, 30))}" for _ in range(6)]
    pairs = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[4]), (None, texts[5])]
    out = chunk_dedup.deduplicated(docs(pairs)).collect()
    gone = sorted((r.doc_id is None, r.n_removed_words > 60) for r in out)
    assert len(out) == 6 and [r.n_words for r in out] == [150] * 6
    assert [g for _, g in gone].count(True) == 5
    assert sum(r.doc_id == 5 and r.n_removed_words == 0 for r in out) == 1
    only = chunk_dedup.deduplicated(docs([(None, texts[0]), (None, texts[1]), (None, texts[1])])).collect()
    assert sorted(r.n_removed_words > 60 for r in only) in ([False, False, True], [False, True, True])


def test_chunk_dedup_equals_brute_force(docs):
    """Every document's runs against keepers found by plain dictionaries."""
    draw = random.Random(32)
    passages = [words(draw, n) for n in (20, 40, 60, 90, 200)]
    pairs = []
    for k in range(60):
        text = words(draw, draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(text))
            text[at:at] = draw.choice(passages)
        pairs.append((k, " ".join(text)))
    keeper = {}
    chunks = {k: chunk_dedup.Chunks(t.encode()) for k, t in pairs}
    for k, c in chunks.items():
        for d in c.digests.tolist():
            keeper.setdefault(d, k)
    got = {r.doc_id: (r.n_removed_words, r.text) for r in chunk_dedup.deduplicated(docs(pairs)).collect()}
    removed = 0
    for k, text in pairs:
        c, all_words = chunks[k], text.split(" ") if text else []
        hit, seen = [False] * len(all_words), set()
        for d, a, b in zip(c.digests.tolist(), c.first.tolist(), c.last.tolist()):
            if keeper[d] != k or d in seen:
                hit[a:b] = [True] * (b - a)
            seen.add(d)
        left, at = [], 0
        while at < len(hit):
            end = at
            while end < len(hit) and hit[end] == hit[at]:
                end += 1
            if not hit[at] or end - at < chunk_dedup.RUN_WORDS:
                left += all_words[at:end]
            at = end
        removed += len(all_words) - len(left)
        assert got[k] == (len(all_words) - len(left), got[k][1]) and got[k][1].split() == left, k
    assert removed > 1000
