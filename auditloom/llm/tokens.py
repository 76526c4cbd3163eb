"""Token ids by a public tokenizer file, memoised per pre-token.

A BPE tokenizer merges inside each pre-token only, so the ids of a text are the ids of its pre-tokens
one after the other. Corpora repeat their words, so a worker keeps what the library returned for each
pre-token and only asks it about new ones. It holds two generations of up to ``memo`` pre-tokens of at most 64 characters
(some 120 MB): when the younger is full it becomes the older, and what is met again comes over, so frequent ones stay. Texts with characters outside a plain range, where this
module's split might differ from the library's, go to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Only for texts made of these characters is the split below known to be the library's.
PLAIN = re.compile(rf"[\x20-\x7e\n\t{LETTER}]*")
# The split patterns of the two known tokenizers, for the plain range; letters, of which most pieces are, are tried first.
BYTE_LEVEL = rf" ?[{LETTER}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ \n\t{LETTER}0-9]+|[ \n\t]+(?![^ \n\t])|[ \n\t]+"
WORD_LEVEL = rf"[{LETTER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \n\t{LETTER}0-9]+"
#: The pattern in the file of the word-level tokenizer, by which it is recognised.
WORD_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        conf.pop("model")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # a text is never control: special strings are ordinary text
        self.limit, self.older = memo, {}
        pre = conf.get("pre_tokenizer") or {}
        kinds = [x.get("type") for x in (conf.get("normalizer") or {}).get("normalizers", [])]
        self.lower, self.split = False, None
        if conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.split = re.compile(BYTE_LEVEL).findall
        elif kinds == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("pattern", {}).get("Regex") == WORD_FILE_PATTERN:
            self.lower, self.split = True, re.compile(WORD_LEVEL).findall

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece) or self.whole(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def whole(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text (null: none), as bytes."""
        if not text:
            return b""
        if self.split is None or "<|" in text or PLAIN.fullmatch(text) is None:
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.split(text.lower() if self.lower else text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
