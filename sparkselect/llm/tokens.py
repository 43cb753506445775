"""Token ids of whole texts with the ``tokenizers`` library, a distinct unit at a time.

A unit is a word with the space before it. The vocabularies used here split a text so that
no token and no merge crosses from a non-space into a following space, so the ids of a text
are the ids of its units end to end, and a unit that a task meets again is looked up. Texts
are cut into units and the units are numbered a batch at a time by Arrow; Python sees each
distinct unit of a batch once. A unit of Latin letters is a single pre-token, so the library's
BPE model takes it directly; any other unit goes through the library's whole encoder. In a
vocabulary that keeps white space, a text in which a space stands beside other white space is
cut into words with all the white space before them, and one with white space outside ASCII
(there a run may cross the units) goes through the library whole, as does a text that holds the
string of a special token, so that ids are those of the library's plain call.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Units kept per Python worker (about 160 bytes each); the memory is cleared and refilled beyond that.
CACHED_UNITS = 1_500_000

#: A text that matches goes to the library whole: white space and format characters outside ASCII's six.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_SPACE = re.compile(r"\s")
_UNIT = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
#: The texts that single spaces don't cut into units.
_HARD = _ODD.pattern.replace("\x1c-\x1f", r"\x1c-\x1f") + r"|^ | $|[ \t\n\x0b\x0c\r] | [\t\n\x0b\x0c\r]"
#: Letters up to here are letters in every version of Unicode.
_LATIN_END = "\u0250"


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies show printable Latin-1 bytes as themselves and number the others from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_chars()


class Units(dict):
    """Unit -> code; an unknown unit gets the next code and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self)
        self.new.append(unit)
        return code


class Encoder:
    """Ids of texts under one vocabulary.

    ``lower``: the vocabulary drops white space and folds case (NFC, then each letter's lower case).
    """

    def __init__(self, path: str, lower: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = lower
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: texts that go another way than word by word: those with a special token's string go to the library whole
        self.special = re.compile("|".join(special) or r"[^\s\S]")
        self.hard = "|".join(special + ([] if lower else [_HARD]))
        self._clear()

    def _clear(self) -> None:
        self.codes = Units()
        self.ends: dict[str, list[int]] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str) -> str | None:
        """The pre-token of a unit of Latin letters (after at most one space), or None."""
        bare = word[1:] if word[:1] == " " else word
        if not bare.isalpha():
            return None
        if bare.isascii():
            return word.lower() if self.lower else word.replace(" ", "\u0120")
        if max(bare) >= _LATIN_END:
            return None
        if self.lower:  # below _LATIN_END a word's lower case is that of its letters
            word = unicodedata.normalize("NFC", word).lower()
            if not word.isalpha() or max(word) >= _LATIN_END:
                return None
        return word.encode().decode("latin-1").translate(_BYTES)

    def _unit_ids(self, unit: str) -> list[int]:
        if "\n" in unit and not self.lower:
            lines = unit.split("\n")
            if all(x and not x.isspace() for x in lines) and not _SPACE.search(unit[1:].replace("\n", "")):
                # one line end between two words is a pre-token of its own
                ids = self._unit_ids(lines[0])
                for line in lines[1:]:
                    ids = [*ids, *self._end_ids("\n"), *self._unit_ids(line)]
                return ids
        word = unit.rstrip(".,!")
        token = self._letters(word) if word else None
        if token is None:
            return self._whole(unit)
        ids = [t.id for t in self.model.tokenize(token)]
        if len(word) < len(unit):  # a run of punctuation after a letter is a pre-token of its own
            ids += self._end_ids(unit[len(word):])
        return ids

    def _end_ids(self, end: str) -> list[int]:
        ids = self.ends.get(end)
        if ids is None:
            ids = self.ends[end] = self._whole(end)
        return ids

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        ids, size = array("I"), np.empty(len(new), np.int64)
        for i, unit in enumerate(new):
            own = self._unit_ids(unit)
            ids.extend(own)
            size[i] = len(own)
        first = len(self.codes) - len(new)
        while len(self.codes) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        ends = self.starts[first] + np.cumsum(size)
        self.starts[first + 1:first + 1 + len(new)] = ends
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.starts[first]:ends[-1]] = np.frombuffer(ids, np.uint32)

    def _of(self, units: list[str]) -> np.ndarray:
        """The codes of units; unknown ones are learnt."""
        at = np.fromiter(map(self.codes.__getitem__, units), np.int64, len(units))
        self._learn()
        return at

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units end to end, and where each unit's end."""
        first = self.starts[at]
        size = self.starts[at + 1] - first
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(first - (ends - size), size) + np.arange(total)], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): the ids of text i are ids[starts[i]:starts[i + 1]]; null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if len(self.codes) > CACHED_UNITS:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = np.empty(0, np.int64)
        if self.hard:
            is_hard = pc.match_substring_regex(texts, self.hard)
            hard = np.flatnonzero(is_hard.to_numpy(zero_copy_only=False))
            if len(hard):
                slow = [self._slow(texts[int(i)].as_py()) for i in hard]
                texts = pc.if_else(is_hard, pa.scalar("", pa.large_string()), texts)
        split = pc.ascii_split_whitespace(texts) if self.lower else pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        encoded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        codes, words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()
        if self.lower:
            at = self._of(words)[codes]
        else:  # a word is one unit after a space and another at the start of a text
            key = 2 * codes + 1
            key[offsets[:-1][np.diff(offsets) > 0]] -= 1
            there = np.zeros(2 * len(words), bool)
            there[key] = True
            used = np.flatnonzero(there)
            number = np.empty(2 * len(words), np.int64)
            number[used] = self._of([" " + words[k >> 1] if k & 1 else words[k >> 1] for k in used.tolist()])
            at = number[key]
        ids, ends = self._gather(at)
        starts = np.append(0, ends)[offsets] if len(ends) else np.zeros(len(texts) + 1, np.int64)
        if len(hard):
            parts = [ids[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]
            for i, own in zip(hard, slow, strict=True):
                parts[i] = own
            ids, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, starts

    def _slow(self, text: str) -> np.ndarray:
        if self.lower or _ODD.search(text) or self.special.search(text):
            return np.array(self._whole(text), np.uint32)
        return self._gather(self._of(_UNIT.findall(text)))[0]


@lru_cache(maxsize=4)
def encoder(path: str, lower: bool) -> Encoder:
    """The encoder of this Python worker, kept over its tasks."""
    return Encoder(path, lower)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, also on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)
