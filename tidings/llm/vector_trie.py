"""Pairs of words one code point apart, by a trie over their letter counts.

A word's vector counts its letters by group. One edit raises at most one count by one and lowers at
most one by one, so a search down the trie of vectors, a level for each group, goes on while it has
spent no more than one surplus and one deficit. The words at the leaves it reaches are verified.
Words are Latin-1 here, a byte for each code point.
"""

from __future__ import annotations

import numpy as np

#: Letters of each group; what none of them has (accented letters) makes the last group.
GROUPS = ("e", "t", "a", "o", "i", "n", "s", "r", "hl", "dcu", "mfpgwybvkxjqz")
LEVELS = len(GROUPS) + 1
#: A node with so few pairs of a word and a searching word is not taken apart further.
FEW = 256
#: Bytes of the words compared at once, and pairs held before they are verified.
COMPARED = 1 << 22
HELD = 1 << 18

_GROUP = np.full(256, LEVELS - 1, dtype=np.int64)
for _number, _letters in enumerate(GROUPS):
    _GROUP[list(_letters.encode())] = _number


class Words:
    """Words end to end, with their letter counts."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        owner = np.repeat(np.arange(len(words)), self.lengths)
        cells = np.bincount(owner * LEVELS + _GROUP[self.letters], minlength=len(words) * LEVELS)
        self.vectors = cells.reshape(len(words), LEVELS)

    def spelled(self, which: np.ndarray, length: int) -> np.ndarray:
        """The letters of words of one length, a row each."""
        return self.letters[self.starts[which][:, None] + np.arange(length)]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether word a[k] turns into b[k] by exactly one insertion, deletion or replacement."""
        longer = self.lengths[a] < self.lengths[b]
        a, b = np.where(longer, b, a), np.where(longer, a, b)
        more = self.lengths[a] - self.lengths[b]
        found = np.zeros(len(a), dtype=bool)
        order = np.lexsort((more, self.lengths[b]))
        order = order[more[order] <= 1]
        kinds = self.lengths[b[order]] * 2 + more[order]
        for kind in np.split(order, np.flatnonzero(np.diff(kinds)) + 1) if len(order) else ():
            length, one = int(self.lengths[b[kind[0]]]), int(more[kind[0]])
            step = max(1, COMPARED // (length + 1))
            for k in range(0, len(kind), step):
                some = kind[k : k + step]
                left, right = self.spelled(a[some], length + one), self.spelled(b[some], length)
                differ = left[:, :length] != right
                if not one:
                    found[some] = differ.sum(axis=1) == 1
                    continue
                # From the first difference on, the longer word goes on one letter later.
                first = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
                late = (left[:, 1:] != right) & (np.arange(length) >= first[:, None])
                found[some] = ~late.any(axis=1)
        return found


def near_pairs(words: Words, n_stored: int, level: int = 0):
    """Near pairs with a stored word, each once: the first ``n_stored`` words are stored in the trie.

    All words search. They come with their vectors equal, or a search's budget apart, above ``level``.
    Yields arrays of searching and of stored words.
    """
    stored = np.lexsort(words.vectors[:n_stored, ::-1].T)
    vectors = words.vectors[stored]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def verified():
        a, b = (np.concatenate(side) for side in zip(*waiting))
        waiting.clear()
        near = words.near(a, b)
        return a[near], b[near]

    # The budget that a search has spent above ``level``, against any stored word.
    everyone = np.arange(len(words.lengths))
    if n_stored:
        spent = vectors[:1, :level] - words.vectors[:, :level]
        surplus, deficit = spent.clip(min=0).sum(axis=1), (-spent).clip(min=0).sum(axis=1)
        inside = (surplus <= 1) & (deficit <= 1)
        nodes = [(level, 0, n_stored, everyone[inside], surplus[inside], deficit[inside])]
    else:
        nodes = []
    while nodes:
        at, low, high, who, surplus, deficit = nodes.pop()
        if at == LEVELS or (high - low) * len(who) <= FEW:
            a, b = np.repeat(who, high - low), np.tile(stored[low:high], len(who))
            # A pair of stored words is met from both sides and taken from one.
            once = (a >= n_stored) | (a < b)
            waiting.append((a[once], b[once]))
            held += int(once.sum())
            if held >= HELD:
                yield verified()
                held = 0
            continue
        column = vectors[low:high, at]
        cuts = np.flatnonzero(np.diff(column)) + 1
        own = words.vectors[who, at]
        for first, last in zip((0, *cuts.tolist()), (*cuts.tolist(), high - low)):
            step = column[first] - own
            up, down = surplus + (step == 1), deficit + (step == -1)
            on = (np.abs(step) <= 1) & (up <= 1) & (down <= 1)
            if on.any():
                nodes.append((at + 1, low + first, low + last, who[on], up[on], down[on]))
    if waiting:
        yield verified()


def shifts(levels: int) -> np.ndarray:
    """What one edit can do to the first counts of a vector, of which the first change is a rise."""
    out = []
    for up in (None, *range(levels)):
        for down in (None, *range(levels)):
            if up is None or up == down or (down is not None and down < up):
                continue
            row = [0] * levels
            row[up] = 1
            if down is not None:
                row[down] = -1
            out.append(row)
    return np.array(out, dtype=np.int64).reshape(-1, levels)
