"""Token ids of a public vocabulary file, fast enough to run over a corpus.

WordTokenizer gives the ids that the `tokenizers` library gives for a word-level BPE file with an
end-of-word suffix (special tokens not added), for every text. Texts are cut at white space,
which no word spans, and the chunks looked up in a bounded cache; a new chunk is split in words
by the file's pattern and merged by `tiktoken` over the same merges.
Texts and chunks with characters on which the two may differ go to `tokenizers` itself.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import tiktoken

#: ASCII signs but the apostrophe, with which words may start.
_SIGNS = string.punctuation.replace("'", "")
#: Ends a word; texts that hold it are not split here.
_END = "\x01"
#: Texts with these go to the library whole: special tokens' opening, signs whose lower case depends on their place, spaces in one library only.
_WHOLE = ("<|", "\u03a3", "\u0130", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: Chunks with these go to the library: control characters, signs outside the basic plane, code points that only one of the two counts as letters.
_UNSURE = re.compile("[\x00-\x08\x0e-\x1b\x7f-\x9f\u180e\ufeff\ufffe\uffff\U00010000-\U0010ffff\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u1c89\u208f\u209d-\u209f\ua7cb-\ua7f1\uab6c\uab6d]")


def _unicode_to_byte() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """ids(texts): each text's ids as bytes, little-endian unsigned 32-bit.

    cached_chars bounds the characters in the cache, which takes some 25 bytes for each.
    """

    def __init__(self, path: str, cached_chars: int = 6_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        suffix = model["model"]["end_of_word_suffix"]
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(pattern).findall
        self._whole = Tokenizer.from_file(path)
        as_byte, end = _unicode_to_byte(), _END.encode()

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix)
            return bytes(as_byte[c] for c in body) + (end if len(body) < len(token) else b"")

        vocab = model["model"]["vocab"]
        ranks, ids = {}, {}
        # Ranks in order of merging: single bytes, byte and end, then the file's merges.
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + end for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        for token in [*order, *(raw(a) + raw(b) for a, b in merges)]:
            ranks.setdefault(token, len(ranks))
        for token, i in vocab.items():
            if (key := self._key(token, raw)) is not None:
                ids[ranks[key]] = i
        self._ids = np.zeros(len(ranks), "<u4")
        self._ids[list(ids)] = list(ids.values())
        self._ends = np.array([x.endswith(end) and x != end for x in ranks])
        self._bpe = tiktoken.Encoding("words", pat_str=rf"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self._cache: dict[str, bytes] = {}
        self._chars, self._most = 0, cached_chars

    @staticmethod
    def _key(token: str, raw) -> bytes | None:
        try:
            return raw(token)
        except KeyError:  # a special token
            return None

    def _learn(self, chunks: set[str]) -> None:
        """Puts chunks in the cache, all merged in one call; a word ends with each id of _ends."""
        odd = {c for c in chunks if not (c.isascii() and c.isprintable()) and _UNSURE.search(c)}
        new = list(chunks - odd)
        words = list(map(self._words, new))
        ranks = np.array(self._bpe.encode_ordinary(_END.join([*chain.from_iterable(words), ""])), np.int64)
        ids, stops = self._ids[ranks].tobytes(), 4 * np.r_[0, np.flatnonzero(self._ends[ranks]) + 1]
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        to = stops[last].tolist()
        self._cache.update(zip(new, (ids[a:b] for a, b in zip([0, *to], to))))
        self._cache.update((c, self._other(c)) for c in odd)
        self._chars += sum(map(len, chunks))

    def _words(self, chunk: str) -> list[str]:
        """The file's pattern, without it for letters alone or letters before signs, which are most chunks."""
        if chunk.isalpha():
            return [chunk]
        letters = chunk.rstrip(_SIGNS)
        if letters.isalpha():
            return [letters, chunk[len(letters) :]]
        return self._split(chunk)

    def _chunks(self, text: str | None) -> list[str] | bytes:
        """The text's chunks, or its ids where it goes to the other library."""
        if not text:
            return b""
        if any(x in text for x in _WHOLE):
            return self._other(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.lower().split()

    def _other(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: Iterable[str | None], at_once: int = 1_000_000) -> Iterator[bytes]:
        """The ids of each text in turn; about at_once characters are split at a time."""
        texts = iter(texts)
        while True:
            group, chars = [], 0
            for text in texts:
                group.append(self._chunks(text))
                chars += len(text or "")
                if chars >= at_once:
                    break
            if not group:
                return
            if self._chars > self._most:
                self._cache.clear()
                self._chars = 0
            get = self._cache.get
            found = [list(map(get, x)) if isinstance(x, list) else x for x in group]
            new = {c for x, got in zip(group, found) if isinstance(got, list) and None in got for c, ids in zip(x, got) if ids is None}
            if new:
                self._learn(new)
            for x, got in zip(group, found):
                if isinstance(got, list):
                    cache = self._cache
                    got = b"".join([cache[c] if ids is None else ids for c, ids in zip(x, got)])
                yield got


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each process and file."""
    return WordTokenizer(path)


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where the named public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
