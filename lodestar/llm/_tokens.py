"""Token ids of texts by a byte-level BPE vocabulary file, with a bounded cache of words."""

from __future__ import annotations

import re
import struct
from functools import cache

#: Entries that a worker's word cache holds at most; a full cache is emptied.
CACHE_WORDS = 200_000
#: A space next to other white space: such texts are encoded whole, as words there depend on their neighbours.
_UNEVEN = re.compile(r" \s|\s ")
#: The pattern by which this kind of vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = ("It's 12 o'clock,  twice\n\n now\tand über £5 — 日本語 🙂  ", "aaa bbb  c\n d", "")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable ones are themselves, others follow from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(text) gives the same ids as the vocabulary file's tokenizer without added special tokens.

    Words between single spaces are independent in this kind of vocabulary, so their ids are kept in a bounded
    cache. New words go through the vocabulary's merge ranks, if those agree with the tokenizer on probe texts;
    texts that may hold a special token's string always go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.ranked = self._ranked()
        self.cache: dict[str, bytes] = {}

    def _ranked(self):
        """An encoder from the vocabulary's merge ranks; None where it would give other ids."""
        import tiktoken

        to_byte = _byte_of_char()
        try:
            ranks = {bytes(to_byte[c] for c in t): i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t not in self.special}
            ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        except (KeyError, ValueError):
            return None
        if any(ranked(p) != self.whole.encode(p, add_special_tokens=False).ids for p in _PROBES):
            return None
        return ranked

    def _ids(self, text: str) -> bytes:
        ids = self.ranked(text) if self.ranked and not any(s in text for s in self.special) else self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.ranked is None or any(s in text for s in self.special) or _UNEVEN.search(text):
            return self._ids(text)
        first, *parts = text.split(" ")
        get = self.cache.get
        ids = [get(p) for p in parts]
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = get(parts[i]) or self._word(parts[i])
        return (self._ids(first) if first else b"") + b"".join(ids)

    def _word(self, part: str) -> bytes:
        got = self.ranked(" " + part)
        ids = struct.pack(f"<{len(got)}I", *got)
        if len(part) <= 48:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[part] = ids
        return ids


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
