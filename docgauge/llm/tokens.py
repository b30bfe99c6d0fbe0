"""Token ids of a public tokenizer, with caches of the pieces between white space and of words."""

from __future__ import annotations

import os
import unicodedata
from struct import pack

import numpy as np

from .memory import CACHES

#: Entries of each cache of a Python worker; it starts anew beyond them (about 150 MB in all).
CACHE_ENTRIES = 500_000
#: Longer pieces aren't kept.
CACHE_CHARS = 48
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: The word tokenizer's own pattern (a fixed value of its vocabulary file).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this character, Latin, Greek and Cyrillic, our folding and pattern are the tokenizer's for sure.
_SURE = "԰"


class Encoder:
    """ids(texts) equals Tokenizer.encode(text, add_special_tokens=False).ids for each text.

    The word tokenizer folds white space and never joins across it, so a text's ids are
    those of its pieces in order; a piece is folded, split by the tokenizer's pattern and
    its words go to the BPE model alone, which saves most of the tokenizer's time on new
    words. Whatever might differ is left to the tokenizer: texts with its special tokens or
    with separators that only str.split() takes for spaces, and pieces in other scripts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(_PIECES).findall
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, w: str) -> bytes:
        """A folded word by the BPE model alone."""
        ids = self.words.get(w)
        if ids is None:
            raw = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.alphabet)
            ids = pack(f"<{len(found)}I", *found) if (found := [t.id for t in self.model.tokenize(raw)]) else b""
            if len(w) <= CACHE_CHARS:
                self.words[w] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            w = piece.lower()
        elif max(piece) >= _SURE or "Σ" in piece or "İ" in piece:
            return self._whole(piece)
        else:
            w = unicodedata.normalize("NFC", piece).lower()
        if w.isalpha():
            return self._word(w)
        if w[-1] in ".,;:!?" and w[:-1].isalpha():  # most of the others; no pattern spans this cut
            return self._word(w[:-1]) + self._word(w[-1])
        return b"".join(map(self._word, self.split(w)))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        whole = [any(x in t for x in _ODD) for t in texts]
        pieces = [[] if w else t.split() for t, w in zip(texts, whole)]
        cache, long = self.cache, {}
        for x in set().union(*pieces).difference(cache):
            (cache if len(x) <= CACHE_CHARS else long)[x] = self._piece(x)
        out = []
        for t, w, p in zip(texts, whole, pieces):
            found = self._whole(t) if w else b"".join(map(cache.__getitem__, p) if not long else (cache[x] if x in cache else long[x] for x in p))
            out.append(np.frombuffer(found, "<u4"))
        for c in (cache, self.words):
            if len(c) > CACHE_ENTRIES:
                c.clear()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        CACHES.extend([_encoders[path].cache, _encoders[path].words])
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
