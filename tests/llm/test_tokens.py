import base64
import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidings.llm import merge_replay, packing, token_files
from tidings.llm.word_ids import WordEncoder

from .conftest import ODD

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "aaabeé́ß ÀÈ漢か​\x1c\x85\xa0 \n\t  \r'sdmtre12٣Ⅷ😀<|>.,!ΣİﬁשׁK"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def ranked():
    lines = (line.split() for line in open(RANKS, "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def scrambled(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 50))) for _ in range(n)]


def test_word_ids_equal_the_library(library):
    texts = [t or "" for _, t in ODD] + scrambled(4000, 1) + ["<|endoftext|> it's we'll 12'd,"]
    texts += ["say <|endoftext|> now", "a<|StartOfText|>b <| <|endoftext", "x <|ENDOFTEXT|>", "<|endoftext|>" * 3]
    got = WordEncoder(VOCABULARY).encode(texts, 2)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [2], text


def test_special_strings_as_text(library):
    """As an option they are ordinary text."""
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    text = "say <|endoftext|> now"
    (got,) = WordEncoder(VOCABULARY, special_as_text=True).encode([text])
    assert got.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert got.tolist() != library.encode(text, add_special_tokens=False).ids


def test_every_id_comes_back_from_files(docs, tmp_path):
    ids = [-(1 << 63), (1 << 63) - 1, 0, None, None, -1]
    manifest = token_files.write_tokens(docs([(i, "word") for i in ids]), str(tmp_path / "c"), VOCABULARY)
    rows = token_files.read_tokens(manifest, str(tmp_path / "c")).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, None, -(1 << 63), -1, 0, (1 << 63) - 1]


def test_forgetting_words_changes_no_id(monkeypatch):
    texts = scrambled(300, 2)
    want = [i.tolist() for i in WordEncoder(VOCABULARY).encode(texts)]
    monkeypatch.setattr("tidings.llm.word_ids.KEPT_WORDS", 5)
    short = WordEncoder(VOCABULARY)
    assert [short.encode([t])[0].tolist() for t in texts] == want


def test_merge_replay_equals_the_library(ranked):
    encoder = merge_replay.encoder(RANKS)
    texts = [t or "" for _, t in ODD] + scrambled(4000, 3) + ["a" * 999, "ab" * 700, "  a  b\n\n c "]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert array("I", ids).tolist() == ranked.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_merge_replay_query(odd, empty, ranked):
    out = merge_replay.digests(odd, RANKS).collect()
    assert len(out) == len(ODD)
    by_id = {r.doc_id: r for r in out}
    for doc_id, text in ODD:
        ids = array("I", ranked.encode_ordinary(text or ""))
        row = by_id[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert merge_replay.encode(empty, RANKS).count() == 0
    assert merge_replay.encode(odd, RANKS).filter("doc_id = 4").first().decoded == b"word"


def test_token_files_round_trip(odd, empty, library, tmp_path):
    manifest = token_files.write_tokens(odd, str(tmp_path / "corpus"), VOCABULARY)
    got = token_files.read_tokens(manifest, str(tmp_path / "corpus")).collect()
    at = 0
    order = sorted(ODD, key=lambda r: -1 if r[0] is None else r[0])
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), order, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(ids))
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == ids
        at += len(ids)
    sums = token_files.read_checksums(manifest, str(tmp_path / "corpus"), batch_tokens=3).collect()
    assert sorted(r.ids_crc32 for r in sums) == sorted(zlib.crc32(bytes(r.ids)) for r in got)
    none = token_files.write_tokens(empty, str(tmp_path / "none"), VOCABULARY)
    assert token_files.read_tokens(none, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 1], [5000, 3000, 3000, 17], [1] * 300])
def test_assign_fills_every_sequence(lengths):
    check_pieces(lengths, packing.assign(lengths))


def test_assign_random():
    draw = random.Random(5)
    for _ in range(50):
        lengths = [int(draw.paretovariate(0.7) * 40) % 20_000 + 1 for _ in range(200)]
        check_pieces(lengths, packing.assign(lengths))


def check_pieces(lengths, pieces):
    """Every token once, no gap, and no sequence that would need padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for d, start, n, sequence, offset in pieces:
        documents[d].append((start, n))
        sequences[sequence].append((offset, n))
    assert {d: gapless(p) for d, p in documents.items()} == {d: n for d, n in enumerate(lengths) if n}
    for own in sequences.values():
        total = gapless(own)
        assert total == 4096 or total < 4096 and total & (total - 1) == 0


def gapless(parts):
    at = 0
    for start, n in sorted(parts):
        assert start == at and n > 0
        at += n
    return at


def test_assign_balances_cost():
    pieces = packing.assign([2048, 2048, 1024, 1024, 1024, 1024])
    quadratic = defaultdict(int)
    for _, _, n, sequence, _ in pieces:
        quadratic[sequence] += n * n
    assert len(set(quadratic.values())) == 1


def test_pack(odd, empty, library):
    pieces = packing.packed(odd).collect()
    documents, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        documents[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for doc_id, text in ODD:
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        parts = {p.start: p for p in documents[doc_id]}
        ids = b"".join(bytes(parts[s].ids) for s in sorted(parts))
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert all(p.doc_tokens == len(want) for p in parts.values())
    assert all(gapless(s) <= 4096 for s in sequences.values())
    assert packing.digest(packing.packed(empty)).count() == 0
