"""Byte-level BPE by replaying merges over a whole set of words at once.

The words of many texts are laid end to end as one chain of symbols. An inverted index leads from
the rank of a merge to the positions where its pair of neighbours stands, in whatever word. Ranks
are taken in order; a merge touches only the two neighbours of each position, whose new pairs go
into the index. Each different word is merged once per task, however often it occurs.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from tidings.llm.catalog import in_arrow, narrow, query, table, texts

#: Chunks and pieces kept by a task; beyond it the memory is emptied, which changes no id.
KEPT = 500_000
#: Positions replayed together.
CORPUS_BYTES = 4 << 20
#: White space of the splitting pattern: the Unicode property, which the module's own class exceeds.
WHITE = r"\p{White_Space}"
#: Two white-space characters in a row, or one at an edge: there a text can't be cut at spaces.
RUN = regex.compile(rf"[{WHITE}\x1c-\x1f]{{2}}|\A[{WHITE}\x1c-\x1f]|[{WHITE}\x1c-\x1f]\Z")

ROWS = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of byte strings, and the table of mergeable pairs that follows from them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            lines = (line.split() for line in file)
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        classes = pattern.replace(r"^\s", f"^{WHITE}").replace(r"\S", f"[^{WHITE}]")
        self.pieces = regex.compile(classes.replace(r"\s", f"[{WHITE}]"))

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (unsigned 32-bit, little-endian)."""
        merged = dict.fromkeys(range(len(words)))
        chain: list[int] = []  # symbols end to end; -1 between words
        for word in words:
            chain.append(-1)
            chain.extend([self.single[b] for b in word])
        chain.append(-1)
        self._merge(chain)
        out, own = [], array("I")
        for symbol in chain[1:]:
            if symbol >= 0:
                own.append(symbol)
            elif symbol == -1:
                out.append(own.tobytes())
                own = array("I")
        assert len(out) == len(merged)
        return out

    def _merge(self, chain: list[int]) -> None:
        """Apply every merge in rank order, leftmost first; merged-away positions become -2."""
        pairs = self.pairs.get
        after = list(range(1, len(chain) + 1))
        before = list(range(-1, len(chain) - 1))
        index: dict[int, list[int]] = {}
        for at, rank in enumerate(map(pairs, zip(chain, chain[1:]))):
            if rank is not None:
                index.setdefault(rank, []).append(at)
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            waiting = index.pop(rank, None)
            if waiting is None:
                continue
            waiting.sort()
            for k, at in enumerate(waiting):
                # A position is out of date once either symbol of its pair has changed.
                if chain[at] < 0 or pairs((chain[at], chain[after[at]])) != rank:
                    continue
                gone = after[at]
                chain[at], chain[gone] = rank, -2
                after[at] = after[gone]
                before[after[at]] = at
                lower = False
                for left in (before[at], at):
                    new = pairs((chain[left], chain[after[left]]))
                    if new is not None:
                        if new not in index:
                            index[new] = []
                            heappush(heap, new)
                        index[new].append(left)
                        lower |= new <= rank
                if lower and k + 1 < len(waiting):
                    # A merge of lower rank has come up: it goes first, the rest wait in the index.
                    if rank not in index:
                        index[rank] = []
                        heappush(heap, rank)
                    index[rank].extend(waiting[k + 1 :])
                    break


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path, pattern)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that its splitting pattern never crosses, most often a word each."""
        if RUN.search(text):
            return self.vocabulary.pieces.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + r for r in rest)] if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT:
            self.known.clear()
            self.pieces.clear()
        parts = [self.chunks(t) for t in texts]
        new = set().union(*parts).difference(self.known)
        split = {c: self.vocabulary.pieces.findall(c) for c in new}
        self._learn(set().union(*split.values()).difference(self.pieces))
        look = self.pieces.__getitem__
        for chunk, own in split.items():
            self.known[chunk] = b"".join(map(look, own))
        look = self.known.__getitem__
        return [b"".join(map(look, p)) for p in parts]

    def _learn(self, pieces: set[str]) -> None:
        """Replay the merges over all new pieces, some megabytes of them at a time."""
        ranks, corpus, held = self.vocabulary.ranks, {}, 0
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if raw in ranks:  # a piece that is a token of its own is never split
                self.pieces[piece] = array("I", [ranks[raw]]).tobytes()
                continue
            corpus[piece] = raw
            held += len(raw)
            if held >= CORPUS_BYTES:
                self.pieces.update(zip(corpus, self.vocabulary.replay(list(corpus.values()))))
                corpus, held = {}, 0
        self.pieces.update(zip(corpus, self.vocabulary.replay(list(corpus.values()))))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, array("I", ids)))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """The encoder of this worker process, with the words it has met in earlier tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Ids and their decoded bytes for every document.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text has no ids; a
    null doc_id stays null; repeated rows give repeated rows; an empty table gives no rows.
    """

    def work(batch):
        encode_all = encoder(path, pattern)
        ids = encode_all.encode(texts(batch))
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(i) // 4 for i in ids],
            "ids": ids,
            "decoded": list(map(encode_all.decode, ids)),
        }

    return in_arrow(narrow(docs, "doc_id", "text"), work, ROWS)


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encode`` with SHA-256 digests for ids and bytes, taken where they are made."""

    def work(batch):
        encode_all = encoder(path, pattern)
        ids = encode_all.encode(texts(batch))
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(encode_all.decode(i)).hexdigest() for i in ids],
        }

    return in_arrow(narrow(docs, "doc_id", "text"), work, DIGESTS)


@query("op4_merge_replay_bpe")
def op4_merge_replay_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), path)
