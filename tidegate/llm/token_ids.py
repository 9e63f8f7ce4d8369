"""Token ids of whole texts, fast: words are encoded once and kept.

Both tokenizers used here split a text into words before anything else, so what stands
between two places where a word surely ends can be encoded alone.  Arrow cuts a batch of
texts at spaces and numbers its distinct words; each distinct word is encoded once, and
Arrow lays their ids out in the order of the texts.  A word of Latin letters is one step
for either tokenizer: the library's model encodes it without its normalizer and splitter.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import cache

#: A space between two characters that are no white space: a word ends before it for either tokenizer.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Only beside more white space may a space be no such place (in RE2's terms, which takes \s for ASCII alone).
_UNEVEN = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Latin letters: composed already, and lower-cased one by one.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_LETTERS = re.compile(f"[{_LATIN}]+").fullmatch
#: Further places inside a word: before punctuation after a letter, and round a single line break.
_INSIDE = re.compile(rf"(?<=[{_LATIN}])(?=[,.;:!?\n])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: Words in each of two generations of the store, and other pieces kept.  These bound memory, not results.
KEPT_WORDS, KEPT_PIECES = 300_000, 100_000
_TRIED = (" Ab", " ouanque", "Zz", " Été", "èlle", " Wombat", "the", " The", " řŽ")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_SHOWN = _byte_letters()


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)


class _Words:
    """Ids of words after ``lead`` (a space or nothing).

    When the young generation is full it becomes the old one, and what is still used moves
    back: words seen once go, frequent ones stay.
    """

    def __init__(self, encode, lead: str):
        self._encode, self._lead, self._young, self._old = encode, lead, {}, {}

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words."""
        if len(self._young) > KEPT_WORDS:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        found = list(map(young.get, words))
        new = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if (ids := old.get(words[i])) is None:
                new.append(i)
            else:
                found[i] = young[words[i]] = ids
        told = [words[i] for i in new]
        for i, w, ids in zip(new, told, self._encode(told, self._lead, young), strict=True):
            found[i] = young[w] = ids
        return found


class WordEncoder:
    """Ids of texts as bytes (little-endian, unsigned, 32 bits an id)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._model = self._tokenizer.model
        # How the model is handed a word of letters: with a letter for its space, or lower-cased without one; else by the tokenizer.
        ways = (lambda w, lead: _SHOWN[32] + _spelled(w) if lead else _spelled(w)), (lambda w, lead: _spelled(w.lower()))
        told = lambda way, w: self._bytes([t.id for t in self._model.tokenize(way(w.lstrip(" "), w.startswith(" ")))])
        self._spell = next((way for way in ways if all(told(way, w) == self._encoded([w])[0] for w in _TRIED)), None)
        self._pieces: dict[str, bytes] = {}
        self._first, self._later = _Words(self._words, ""), _Words(self._words, " ")

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        found = array("I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for at in range(0, len(texts), 20_000) for e in self._tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]

    def _words(self, words: list[str], lead: str, known: dict[str, bytes]) -> list[bytes]:
        """The ids of each word, its letters by the model and what else is in it by the tokenizer; ``known`` has words encoded before."""
        if (spell := self._spell) is None:
            return self._encoded([lead + w for w in words])
        tokenize, pack = self._model.tokenize, self._bytes
        if len(self._pieces) > KEPT_PIECES:
            self._pieces = {}
        pieces, odd, out = self._pieces, {}, []
        for w in words:
            if w.isascii() and w.isalpha() or _LETTERS(w):
                out.append(pack([t.id for t in tokenize(spell(w, lead))]))
                continue
            parts: list = _INSIDE.split(w)
            for k, p in enumerate(parts):
                before = "" if k else lead
                if _LETTERS(p):
                    ids = None if k else known.get(p)
                    parts[k] = pack([t.id for t in tokenize(spell(p, before))]) if ids is None else ids
                else:
                    parts[k] = p = before + p
                    if p not in pieces:
                        odd[p] = None
            out.append(parts)
        pieces.update(zip(odd, self._encoded(list(odd)), strict=True))
        return [x if isinstance(x, bytes) else b"".join([p if isinstance(p, bytes) else pieces[p] for p in x]) for x in out]

    def encode(self, texts, end_id: int):
        """(ids, ends) of an Arrow array of strings without nulls: text k's ids, ``end_id`` last, are ids[ends[k]:ends[k + 1]]."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.split_pattern(texts, " ")
        uneven = np.flatnonzero(pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False))
        if len(uneven):
            order = np.arange(len(texts))
            order[uneven] = len(texts) + np.arange(len(uneven))
            by_hand = pa.array([_BETWEEN.split(t) for t in texts.take(pa.array(uneven)).to_pylist()], cut.type)
            cut = pa.concat_arrays([cut, by_hand]).take(pa.array(order))
        sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = cut.flatten()
        later, first = flat.dictionary_encode(), flat.take(pa.array(starts)).dictionary_encode()
        n = len(later.dictionary)
        codes = later.indices.to_numpy().astype(np.int64)
        codes[starts] = n + first.indices.to_numpy()
        codes = np.insert(codes, starts + sizes, n + len(first.dictionary))
        told = lambda d: d.dictionary.to_numpy(zero_copy_only=False).tolist()
        words = self._later.ids(told(later)) + self._first.ids(told(first)) + [self._bytes([end_id])]
        laid = pa.array(words, pa.large_binary()).take(pa.array(codes))
        at = np.frombuffer(laid.buffers()[1], np.int64, len(codes) + 1, 8 * laid.offset) // 4
        ids = np.frombuffer(laid.buffers()[2], "<u4") if at[-1] else np.empty(0, "<u4")
        pa.default_memory_pool().release_unused()  # a worker keeps little between batches
        return ids[: at[-1]], at[np.concatenate(([0], np.cumsum(sizes + 1)))]


@cache
def encoder(path: str) -> WordEncoder:
    """One a Python worker, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)

