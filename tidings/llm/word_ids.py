"""Token ids of whole texts by a vocabulary of the ``tokenizers`` library.

No token of such a vocabulary crosses white space, so a text's ids are those of its words between
spaces and line ends in turn. Each task encodes every different word once, by the library, and
keeps the result: invented or rare words cost the merges once, not at every place. A text that may hold
the string of a special token, which the library takes for that token wherever it stands, goes to the
library whole.
"""

from __future__ import annotations

import os
from array import array
from unicodedata import normalize

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words kept by a task; beyond it the memory is emptied, which costs time but changes no id.
KEPT_WORDS = 350_000
#: Words handed to the library as one string.
JOINED = 200
#: Characters that the vocabulary's own splitting always parts from letters before them.
MARKS = ".,;:!?&%$#*|)"


def letters(word: str) -> bool:
    """Whether the library sees nothing but letters in a word, once it is normalised."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


class Numbers(dict):
    """Numbers words in the order of their first lookup; ``fresh`` are those not yet learned."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class WordEncoder:
    """``special_as_text`` makes special tokens' strings ordinary text, which the library's call does not."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.special = [] if special_as_text else added
        ends = [t.endswith("</w>") for t in map(self.library.id_to_token, range(self.size()))]
        self.closes = np.array(ends)
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.stems: dict[str, bytes] = {}
        self.flat = np.zeros(0, dtype="<u4")  # ids of all words, end to end
        self.starts = np.zeros(1, dtype=np.int64)  # of word k in ``flat``; one more at the end

    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers, ``end`` appended."""
        if len(self.numbers) > KEPT_WORDS:
            self._forget()
        look = self.numbers.__getitem__
        whole = [t for t in texts if self.special and self._may_hold_special(t)]
        whole = dict(zip(whole, self._alone(whole))) if whole else {}
        parts = [
            None if t in whole else np.fromiter(map(look, t.replace("\n", " ").split(" ")), dtype=np.int64)
            for t in texts
        ]
        self._learn()
        tail = np.array([] if end is None else [end], dtype="<u4")
        return [
            np.concatenate([np.frombuffer(whole[t], dtype="<u4") if p is None else self._gather(p), tail])
            for t, p in zip(texts, parts)
        ]

    def _may_hold_special(self, text: str) -> bool:
        """By the tokens' first signs, then, where those are met, by the tokens in lower case."""
        if not any(s[:1] in text or s[:1].upper() in text for s in self.special):
            return False
        low = text.lower()
        return any(s in low for s in self.special)

    def _gather(self, words: np.ndarray) -> np.ndarray:
        starts = self.starts[words]
        lengths = self.starts[words + 1] - starts
        shift = starts - (np.cumsum(lengths) - lengths)
        places = np.repeat(shift, lengths)
        places += np.arange(len(places))
        return self.flat[places]

    def _learn(self) -> None:
        """Ids of new words: of letters, and of the marks after them, each met once."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        stems = [w.rstrip(MARKS) for w in fresh]
        self._learn_stems([s for s in set(stems).difference(self.stems) if letters(s)])
        others = {w if s not in self.stems else w[len(s) :] for w, s in zip(fresh, stems)}
        alone = dict(zip(others, self._alone(list(others))))
        known = [
            self.stems[s] + alone[w[len(s) :]] if s in self.stems else alone[w]
            for w, s in zip(fresh, stems)
        ]
        lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(known), dtype="<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def _learn_stems(self, stems: list[str]) -> None:
        """Many words in one call: in the ids, the closing token of each shows where it ends."""
        groups = [stems[i : i + JOINED] for i in range(0, len(stems), JOINED)]
        joined = [" ".join(g) for g in groups]
        for group, found in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) != len(group) or ends[-1] != len(ids):
                self.stems.update(zip(group, self._alone(group)))
                continue
            raw, last = ids.tobytes(), 0
            for word, end in zip(group, ends):
                self.stems[word] = raw[4 * last : 4 * end]
                last = end

    def _alone(self, words: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", f.ids).tobytes() for f in found]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, with the words it has met in earlier tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
