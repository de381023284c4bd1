"""Token ids of whole texts, by the tokenizers library, with each distinct word encoded once per worker.

Both vocabularies used here split a text by a fixed pattern into words that are then encoded independently, so a
word's ids can be kept and joined. Only texts made of plain Latin-1 characters take that way; a text with any other
character is handed to the library as a whole. Either way the ids are those of the library for the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np

#: The patterns by which the two public vocabularies split a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Letters and digits among the plain characters; the other plain ones are punctuation.
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_OTHER = re.compile("[^\t\n\r -~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]")
#: The same patterns over plain characters only, for the faster matcher of the standard library.
_PLAIN = {
    BYTE_LEVEL: re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+"),
    WORD_LEVEL: re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[0-9]|[^\s{_L}0-9]+"),
}
_LONG = 1 << 20
_kept: dict[str, "Encoder"] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level models write each byte as one visible letter: printable Latin-1 as itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    About `words` words are kept, in two halves: when the newer half is full, the older one goes, and a word of it that is
    met again moves to the newer. So frequent words stay, while rare ones, which most are, take no memory for long.
    """

    def __init__(self, path: str, words: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        steps = head["pre_tokenizer"].get("pretokenizers", [head["pre_tokenizer"]])
        split = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        pattern = split[0] if split else BYTE_LEVEL
        self.lower = bool(head["normalizer"])
        self.pattern = _PLAIN.get(pattern)
        self.model, self.letters = self.library.model, _byte_letters()
        self.words, self.older, self.limit = {}, {}, words

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.words]
        if len(self.words) + len(missing) > self.limit // 2:
            self.older, self.words, missing = self.words, {}, words
        tokenize, letters, kept, older = self.model.tokenize, self.letters, self.words, self.older
        for w in missing:
            kept[w] = older.get(w) or array("I", [t.id for t in tokenize(w.translate(letters))]).tobytes()

    def _joined(self, words: list[str]) -> bytes:
        self._learn(set(words))
        return b"".join([self.words[w] for w in words])

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            self._learn(set().union(*(w for _, w in split)))
            kept = self.words
            for i, words in split:
                out[i] = b"".join([kept[w] for w in words])
            split.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.pattern is None or _OTHER.search(text):
                out[i] = self._whole([text])[0]
                continue
            if self.lower:
                text = text.lower()
            if len(text) > _LONG:
                found, parts = self.pattern.finditer(text), []
                while words := [m[0] for m in islice(found, 200_000)]:
                    parts.append(self._joined(words))
                out[i] = b"".join(parts)
                continue
            split.append((i, self.pattern.findall(text)))
            size += len(text)
            if size > _LONG:
                flush()
        if split:
            flush()
        return out


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]
