"""Token ids of whole texts by the tokenizers library, word by word.

The tokenizer splits a text into words before it merges, so the ids of a text are those of its words in a row. For
texts of plain Latin characters the words are found here and each distinct word is encoded once by the library; every
other text (and any with strings of special tokens) goes to the library whole. The ids are the library's own either way.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: A worker remembers the ids of distinct words in about so many bytes of memory, then forgets them all.
REMEMBERED = 72 << 20
#: Bytes of a remembered word besides its letters and ids (dictionary entry and two objects).
ENTRY = 190
LONGEST = 64

_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u017f]")
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
#: Their lower case holds a combining mark, which the pattern above doesn't know.
_ODD = "İ"


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.vocab_size = self.whole.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _plain(self, text: str) -> bool:
        return not (_OTHER.search(text) or _ODD in text or any(s in text for s in self.special))

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Words joined by spaces are encoded together; the library says which ids belong to which word. Lower-casing
        them once more changes nothing."""
        out = {}
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            got = self.whole.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            at = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1))
            raw = ids.tobytes()
            out |= {w: raw[4 * a : 4 * b] for w, a, b in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True)}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        words = {i: _WORD.findall(t.lower()) for i, t in enumerate(texts) if t and self._plain(t)}
        rest = [i for i, t in enumerate(texts) if t and i not in words]
        for i, got in zip(rest, self.whole.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, "<u4").tobytes()
        known, every = self.known, set().union(*words.values())
        fresh = self._learn(list(every.difference(known)))
        more = sum(ENTRY + len(w) + len(x) for w, x in fresh.items() if len(w) <= LONGEST)
        if self.held + more > REMEMBERED:
            known.clear()
            self.held = 0
            fresh |= self._learn(list(every.difference(fresh)))
        if more <= REMEMBERED:
            known.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
            self.held += more
        for i, ws in words.items():
            try:
                out[i] = b"".join(map(known.__getitem__, ws))
            except KeyError:
                out[i] = b"".join(x if (x := known.get(w)) is not None else fresh[w] for w in ws)
        return out


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker's own copy, read once from the tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]
