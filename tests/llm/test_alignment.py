import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidings.llm import alignment
from tidings.llm.fragments import (
    EMPTY,
    Aligner,
    Fragment,
    byte_of_letter,
    compose,
    finished,
    fragment,
    slice_fragment,
    slices,
)

from .conftest import ODD

A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = "aaabeé́ß漢か​\x85\xa0  \n\n\t\r'sdmtre12٣Ⅷ😀<|>.,!▁ﬁשK "
WORDS = ["<|endoftext|>", "<s>", "</s>", "<0x41>", "it's", "end.\nThen", "x  y", " a", "b ", "漢字かな", "naïve"]


@pytest.fixture(scope="module")
def found():
    return Aligner(A, B)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(libraries, text):
    """Tokens of the two libraries for the whole text; groups and links by walking along the bytes."""
    a, b = libraries
    if not text:
        return None
    letters = byte_of_letter()
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    raw_x = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
    raw_y = []
    for i in y:
        piece = b.id_to_piece(i)
        raw_y.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if b"".join(raw_x) != (" " + text).encode() or b"".join(raw_y) != (" " + text).encode():
        return None
    groups, links, i, j, at_x, at_y = [], [], 0, 0, 0, 0
    first_x = first_y = 0
    while i < len(x) or j < len(y):
        if at_x <= at_y:
            at_x, i = at_x + len(raw_x[i]), i + 1
        else:
            at_y, j = at_y + len(raw_y[j]), j + 1
        if at_x == at_y:
            groups.append((x[first_x:i], y[first_y:j]))
            links.append((x[i - 1], y[j - 1]))
            first_x, first_y = i, j
    rendered = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return len(x), len(y), links, rendered


def brute(libraries, rows):
    alone = [(i, plain(libraries, t)) for i, t in rows]
    counts = Counter(p for _, f in alone if f for p in f[2])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = Counter()
    for doc_id, f in alone:
        if f is None:
            out[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        n_a, n_b, links, groups = f
        top = sum(counts[p] == best[p[1]] for p in links)
        sha = hashlib.sha256(groups.encode()).hexdigest()
        out[doc_id, n_a, n_b, len(links), len(links), top, sum(counts[p] for p in links), sha] += 1
    return out


def got(frame):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return Counter(tuple(r) for r in frame.select(*names).collect())


def scrambled(n, seed, most=60):
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        parts = [
            draw.choice(WORDS) if draw.random() < 0.1 else draw.choice(ALPHABET)
            for _ in range(draw.randint(0, most))
        ]
        texts.append("".join(parts))
    prose = "the quick brown Fox jumped, over naïve lazy dogs.\nRéunion des élèves".split(" ")
    texts += [" ".join(draw.choice(prose) for _ in range(draw.randint(1, most))) for _ in range(n)]
    return texts


def test_chunks_equal_whole_texts(found, libraries):
    texts = scrambled(3000, 1)
    kept = 0
    for text, (n_a, n_b, links, groups) in zip(texts, found.aligned(texts), strict=True):
        want = plain(libraries, text)
        if want is None:
            assert (n_a, n_b, len(links), groups) == (0, 0, 0, b"")
            continue
        kept += 1
        assert (n_a, n_b, groups.decode()) == (want[0], want[1], want[3])
        assert [(p >> 32, p & 0xFFFFFFFF) for p in links.tolist()] == want[2]
    assert kept > 3000


def test_forgetting_chunks_changes_nothing(found, monkeypatch):
    texts = scrambled(200, 2)
    monkeypatch.setattr("tidings.llm.fragments.KEPT_CHUNKS", 3)
    short = Aligner(A, B)
    for text, want in zip(texts, found.aligned(texts)):
        (own,) = short.aligned([text])
        assert own[:2] == want[:2] and own[3] == want[3] and own[2].tolist() == want[2].tolist()


def random_fragment(draw):
    ends = np.cumsum([draw.randint(1, 4) for _ in range(draw.randint(0, 6))])
    others = np.cumsum([draw.randint(1, 4) for _ in range(draw.randint(0, 6))])
    ids = [np.array([draw.randint(0, 99) for _ in e], dtype=np.int64) for e in (ends, others)]
    return fragment(*ids, np.array(ends, dtype=np.int64), np.array(others, dtype=np.int64))[0]


def test_fragments_are_a_monoid():
    draw = random.Random(3)
    for _ in range(2000):
        f, g, h = (random_fragment(draw) for _ in range(3))
        assert compose(compose(f, g), h) == compose(f, compose(g, h))
        assert compose(EMPTY, f) == f == compose(f, EMPTY)


@pytest.mark.parametrize("size", [7, 40, 200])
def test_slices_compose_to_the_whole(found, libraries, size):
    opened = 0
    for text in scrambled(60, 4, 300) + ["no" * 300 + " cut for long " + "漢字" * 200]:
        want = plain(libraries, text)
        if want is None:
            continue
        parts = [slice_fragment(found, *s) for s in slices(text, size, 30)]
        assert None not in parts
        whole = EMPTY
        for part in parts:
            opened += part[3].tail != ((), ())
            whole = compose(whole, part[3])
        assert finished(whole).decode() == want[3]
        assert (sum(p[0] for p in parts), sum(p[1] for p in parts)) == want[:2]
        assert sum(len(p[2]) for p in parts) == len(want[2])
    assert opened > 10


def test_a_fragment_without_common_end_is_all_tail():
    f, links = fragment(np.array([5]), np.array([6]), np.array([2]), np.array([3]))
    assert f == Fragment(False, ((), ()), b"", ((5,), (6,))) and not len(links)


@pytest.mark.parametrize("size", [50, 1 << 16])
def test_query_equals_brute_force(docs, libraries, size, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 500)
    monkeypatch.setattr(alignment, "FANOUT", 3)
    texts = scrambled(120, 5, 200)
    rows = [(k % 90, t) for k, t in enumerate(texts)] + ODD + [(3, "equal rows here")] * 20
    assert got(alignment.aligned(docs(rows), A, B, size)) == brute(libraries, rows)


def test_odd_and_empty_tables(docs, odd, empty, libraries):
    assert got(alignment.aligned(empty, A, B)) == Counter()
    assert got(alignment.aligned(odd, A, B)) == brute(libraries, ODD)
    none = [(1, None), (2, "a▁b"), (3, "")]
    assert got(alignment.aligned(docs(none), A, B)) == brute(libraries, none)


def test_no_row_holds_a_block(docs, libraries):
    rows = [(k, t) for k, t in enumerate(scrambled(100, 6, 200))]
    blocks = alignment.short_blocks(docs(rows, 1).select("doc_id", "text"), A, B)
    assert not [f.name for f in blocks.schema if f.dataType.typeName() == "array"]
    found = blocks.collect()
    assert len({r.block for r in found}) == 1
    of_docs = [r for r in found if r.pair is None]
    assert len(of_docs) == len(rows) and all(len(r["at"]) == 4 * r.n_links for r in of_docs)
    links = Counter(p for _, t in rows for p in (plain(libraries, t) or ((), (), ()))[2])
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.times for r in found if r.pair is not None} == links


def test_kept_chunks_are_bounded_in_bytes(found, monkeypatch):
    texts = scrambled(200, 7)
    monkeypatch.setattr("tidings.llm.fragments.KEPT_BYTES", 2000)
    short = Aligner(A, B)
    for text, want in zip(texts, found.aligned(texts)):
        (own,) = short.aligned([text])
        assert own[:2] == want[:2] and own[3] == want[3] and own[2].tolist() == want[2].tolist()
        assert sum(map(len, short.numbers)) <= 2000 + len(text) + 1
