"""Groups of tokens that two tokenizers agree on, as fragments that compose.

Tokens of two tokenizers over the same bytes end together at some offsets; the tokens between two such
offsets make a group. A range of bytes holds the tokens that end in it. Its fragment has an open
head, up to the first common end; closed groups; and an open tail, after the last. Fragments of
adjacent ranges compose, in any grouping: tail and head between them close a group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Unicode white space, what Python takes for it besides, and the character that stands for a space.
WHITE = r"\s▁"
#: A single space or line end between others: neither tokenizer joins what is on its two sides.
CUT = re.compile(rf"(?<=[^{WHITE}])(?=[ \n][^{WHITE}])")
#: Where white space stands double or at an edge.
RUN = re.compile(rf"[{WHITE}]{{2}}|\A[{WHITE}]|[{WHITE}]\Z")
#: A chunk that may stand between others in one string.
JOINABLE = re.compile(rf"[ \n][^{WHITE}](?:.*[^{WHITE}])?", re.DOTALL)
#: Chunks kept by a worker; beyond it the memory is emptied, which changes no result.
KEPT_CHUNKS = 400_000
#: Likewise the characters of kept chunks and the bytes of their groups.
KEPT_BYTES = 1 << 26
#: Characters of new chunks tokenized as one string.
JOINED = 1 << 16


@dataclass(frozen=True)
class Fragment:
    """``closed``: whether the range has a common end; without one all its tokens are tail."""

    closed: bool
    head: tuple[tuple, tuple]
    body: bytes
    tail: tuple[tuple, tuple]


EMPTY = Fragment(False, ((), ()), b"", ((), ()))


def _both(x, y):
    return (x[0] + y[0], x[1] + y[1])


def rendered(group) -> bytes:
    return b"|".join(b",".join(b"%d" % i for i in side) for side in group)


def compose(f: Fragment, g: Fragment) -> Fragment:
    if not g.closed:
        return Fragment(f.closed, f.head, f.body, _both(f.tail, g.tail))
    met = _both(f.tail, g.head)
    if not f.closed:
        return Fragment(True, met, g.body, g.tail)
    body = b";".join(p for p in (f.body, rendered(met), g.body) if p)
    return Fragment(True, f.head, body, g.tail)


def finished(f: Fragment) -> bytes:
    """The groups of a whole document, whose end is common to both."""
    return b";".join(p for p in (rendered(f.head), f.body) if p) if f.closed else b""


def fragment(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[Fragment, np.ndarray]:
    """Of tokens with their ends: the fragment, and its links as a * 2**32 + b."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    x, y = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
    links = a[x].astype(np.int64) << 32 | b[y].astype(np.int64)
    a, b = a.tolist(), b.tolist()
    if not len(common):
        return Fragment(False, ((), ()), b"", (tuple(a), tuple(b))), links
    x, y = (x + 1).tolist(), (y + 1).tolist()
    body = b";".join(
        rendered((a[i:j], b[k:m])) for i, j, k, m in zip(x, x[1:], y, y[1:])
    )
    head, tail = (tuple(a[: x[0]]), tuple(b[: y[0]])), (tuple(a[x[-1] :]), tuple(b[y[-1] :]))
    return Fragment(True, head, body, tail), links


def byte_of_letter() -> dict[str, int]:
    """Bytes by the letters of byte-level vocabularies: printable ones are their own letter, the
    others take the letters from 256 on in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Tokens and groups of texts, each different chunk of a text taken once by a worker."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        entries = map(self.a.id_to_token, range(self.a.get_vocab_size(with_added_tokens=True)))
        self.a_bytes = [
            bytes(map(letters.__getitem__, e)) if letters.keys() >= set(e) else e.encode() for e in entries
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_size = np.array(list(map(len, self.a_bytes)))
        self.b_size = np.array(list(map(len, self.b_bytes)))
        self.most = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [b"%d%b" % (i, after) for after in (b",", b"|", b";", b"") for i in range(self.most)]
        # Texts may be cut at CUT if no piece joins a space to what is before it, or a line end to anything.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.held = 0
        self.counts = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, links, and whether it fails
        self.flat = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)

    def tokens(self, part: str):
        """Ids of a part of space+text that starts with a space or line end; None if bytes differ."""
        a = self.a.encode(part, add_special_tokens=False).ids
        # The library puts a space before what it is given.
        b = self.b.encode(part[1:] if part[0] == " " else part, num_threads=1)
        if part[0] != " ":
            b = b[1:]
        raw = part.encode()
        look_a, look_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        if b"".join(map(look_a, a)) != raw or b"".join(map(look_b, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def ended(self, part: str):
        """``tokens`` with the byte offsets where they end."""
        found = self.tokens(part)
        if found is None:
            return None
        a, b = found
        return a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])

    def chunks(self, text: str) -> list[str]:
        """Parts of space+text that both tokenizers take by themselves."""
        if not self.cuts:
            return [" " + text]
        if RUN.search(text):
            return CUT.split(" " + text)
        return [p if p[0] == "\n" else " " + p for p in text.replace("\n", " \n").split(" ")]

    def aligned(self, texts: list[str]) -> list[tuple[int, int, np.ndarray, bytes]]:
        """n_a, n_b, links and rendered groups of every text."""
        if len(self.numbers) > KEPT_CHUNKS or self.held > KEPT_BYTES:
            self._forget()
        parts = [self.chunks(t) if t else [] for t in texts]
        fresh = list(set().union(*parts).difference(self.numbers))
        known = len(self.groups)
        self._learn(fresh)
        self.held += sum(map(len, fresh)) + sum(map(len, self.groups[known:]))
        look, group = self.numbers.__getitem__, self.groups.__getitem__
        out = []
        for own in parts:
            which = np.fromiter(map(look, own), dtype=np.int64, count=len(own))
            n_a, n_b, _, failed = self.counts[which].sum(axis=0).tolist()
            if failed or not own:
                out.append((0, 0, np.zeros(0, dtype=np.int64), b""))
                continue
            starts = self.starts[which]
            sizes = self.starts[which + 1] - starts
            places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out.append((n_a, n_b, self.flat[places], b";".join(map(group, which.tolist()))))
        return out

    def _learn(self, fresh: list[str]) -> None:
        counts, links = [], []
        waiting, held = [], 0
        for chunk in fresh:
            if not (self.cuts and JOINABLE.fullmatch(chunk)):
                self._learn_alone(chunk, counts, links)
                continue
            waiting.append(chunk)
            held += len(chunk)
            if held >= JOINED:
                self._learn_joined(waiting, counts, links)
                waiting, held = [], 0
        if waiting:
            self._learn_joined(waiting, counts, links)
        if counts:
            new = np.concatenate(counts)
            self.counts = np.concatenate([self.counts, new])
            self.flat = np.concatenate([self.flat, *links])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(new[:, 2])])

    def _learn_alone(self, chunk: str, counts: list, links: list) -> None:
        self.numbers[chunk] = len(self.groups)
        found = self.ended(chunk)
        if found is None:
            self.groups.append(b"")
            counts.append(np.array([[0, 0, 0, 1]]))
            return
        whole, own = fragment(*found)
        self.groups.append(finished(whole))
        counts.append(np.array([[len(found[0]), len(found[1]), len(own), 0]]))
        links.append(own)

    def _learn_joined(self, chunks: list[str], counts: list, links: list) -> None:
        """Many chunks as one string; where they end shows in the offsets."""
        found = self.ended("".join(chunks))
        if found is None:
            for chunk in chunks:
                self._learn_alone(chunk, counts, links)
            return
        a, b, a_ends, b_ends = found
        ends = np.cumsum([len(c.encode()) for c in chunks])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # Of each group the first tokens, and one more at the end.
        x = np.concatenate([[0], np.searchsorted(a_ends, common) + 1])
        y = np.concatenate([[0], np.searchsorted(b_ends, common) + 1])
        last = np.searchsorted(common, ends)
        assert (common[last] == ends).all()
        # Tokens in the order in which they are written, each with what follows it.
        group_a = np.repeat(np.arange(len(common)), np.diff(x))
        group_b = np.repeat(np.arange(len(common)), np.diff(y))
        names = np.empty(len(a) + len(b), dtype=np.int64)
        after_a, after_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        after_a[x[1:] - 1], after_b[y[1:] - 1] = 1, 2
        after_b[y[last + 1] - 1] = 3
        names[np.arange(len(a)) + y[group_a]] = after_a * self.most + a
        names[np.arange(len(b)) + x[group_b + 1]] = after_b * self.most + b
        written = list(map(self.names.__getitem__, names.tolist()))
        cuts = [0, *(x[last + 1] + y[last + 1]).tolist()]
        self.numbers.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks))))
        self.groups.extend(b"".join(written[i:j]) for i, j in zip(cuts, cuts[1:]))
        bounds = np.concatenate([[0], last + 1])
        sizes = [np.diff(x[bounds]), np.diff(y[bounds]), np.diff(bounds), np.zeros_like(last)]
        counts.append(np.stack(sizes, axis=1))
        links.append(a[x[1:] - 1] << 32 | b[y[1:] - 1])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process, with the chunks it has met in earlier tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


#: Characters of a slice, and how far from its ends the text may be cut at most.
SLICE, MARGIN = 1 << 16, 1 << 12


def slices(text: str, size: int = SLICE, margin: int = MARGIN):
    """Slices of space+text: (part, bytes of it before the slice, bytes of the slice).

    A slice is cut off anywhere and comes with the text around it up to the next CUT on either side;
    where there is none within the margin the slice goes on.
    """
    whole = " " + text
    cuts = []
    for at in range(size, len(whole), size):
        before = [m.start() for m in CUT.finditer(whole, max(0, at - margin), at + 1)]
        after = CUT.search(whole, at, min(len(whole), at + margin))
        if before and after:
            cuts.append((at, before[-1], after.start()))
    bounds = [(0, 0, 0), *cuts, (len(whole),) * 3]
    for (low, start, _), (high, _, end) in zip(bounds, bounds[1:]):
        part = whole[start:end]
        skip = len(whole[start:low].encode())
        yield part, skip, len(whole[low:high].encode())


def slice_fragment(found: Aligner, part: str, skip: int, size: int):
    """n_a, n_b, links and fragment of the tokens that end within a slice; None if bytes differ."""
    ended = found.ended(part)
    if ended is None:
        return None
    a, b, a_ends, b_ends = ended
    in_a, in_b = ((skip < e) & (e <= skip + size) for e in (a_ends, b_ends))
    whole, links = fragment(a[in_a], b[in_b], a_ends[in_a], b_ends[in_b])
    return int(in_a.sum()), int(in_b.sum()), links, whole
