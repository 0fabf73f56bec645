"""Token ids by the tokenizers library, remembered by word.

The word-level BPE of the vocabulary never joins across white space, so a text's ids are those of
its space-separated strings in order. Lower-case strings of ASCII and Latin letters (nearly all) are remembered,
and only pieces not seen before reach the library's model; a text with any other string, or one that
could hold a special token, goes to the library whole. The ids are the library's in either case.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Characters on which normalisation and splitting act alone, so that strings of them can be remembered.
_SAFE = re.compile("[!-~¡-¬®-ɏ]*")
#: The vocabulary's pieces, for strings of these characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Python splits at these, the library does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Strings remembered and entries held; then the memory is begun anew.
MOST, MOST_ENTRIES = 500_000, 2_000_000
OTHER = -1


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met = bytearray(1 << 21)  # a bit for the hash of a string met once
        self.flat, self.start = array("I"), array("q", [0])

    def _entry(self, text: str) -> int:
        """Closes an entry of ids; its string is remembered when it is met again."""
        self.start.append(len(self.flat))
        number = len(self.start) - 2
        h = hash(text) & 0xFFFFFF
        if self.met[h >> 3] >> (h & 7) & 1:
            self.known[text] = number
        else:
            self.met[h >> 3] |= 1 << (h & 7)
        return number

    def _piece(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            self.flat.extend([t.id for t in self.model.tokenize(spelled)])
            got = self._entry(piece)
        return got

    def _learn(self, word: str) -> int:
        if not _SAFE.fullmatch(word):
            self.known[word] = OTHER
            return OTHER
        if word.isalpha():
            return self._piece(word)
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            pieces = [word[:-1], word[-1]]
        else:
            pieces = _PIECE.findall(word)
        if all(p.isascii() or p.isalpha() for p in pieces):
            if len(pieces) == 1:
                return self._piece(pieces[0])
            for n in [self._piece(p) for p in pieces]:
                self.flat.extend(self.flat[self.start[n]: self.start[n + 1]])
        else:
            self.flat.extend(self.library.encode(word, add_special_tokens=False).ids)
        return self._entry(word)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, without special tokens, as unsigned 32-bit integers."""
        if "<|" in text or any(s in text for s in _SEPARATORS):
            return self._whole(text)
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint32)
        if len(self.known) > MOST or len(self.start) > MOST_ENTRIES:
            self._forget()
        known = self.known
        numbers = list(map(known.get, words))
        if None in numbers:
            for i, n in enumerate(numbers):
                if n is None:
                    n = known.get(words[i])
                    numbers[i] = self._learn(words[i]) if n is None else n
        at = np.array(numbers)
        if at.min() == OTHER:
            return self._whole(text)
        start = np.frombuffer(self.start, np.int64)
        begin = start[at]
        lengths = start[at + 1] - begin
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(begin - (ends - lengths), lengths)
        return np.frombuffer(self.flat, np.uint32)[index]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept between tasks."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
