"""Exact, memoising front of the tokenizers library.

Both vocabularies split a text into pre-tokens that are merged on their own. Texts of Latin letters are split here, by
the vocabulary's own pattern with its character classes written out; each different pre-token goes through the
library's merges once in a worker, and ids are joined. All other texts are given to the library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
from array import array

import public_tokenizers

#: Bytes of pieces and their ids that a worker keeps before the memory is emptied, with what Python needs for an entry.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def tokenizer_path(name_or_path: str) -> str:
    return name_or_path if os.path.sep in name_or_path else public_tokenizers.path(name_or_path)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def shared_encoder(name_or_path: str) -> LibraryEncoder:
    """One encoder for all tasks of a worker: what it has learned is kept from task to task."""
    return LibraryEncoder(name_or_path)


class _Pieces(dict):
    """piece -> ids as little-endian 32-bit bytes."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.held = encode, limit, 0

    def __missing__(self, piece):
        got = self.encode(piece)
        size = ENTRY_BYTES + 4 * len(piece) + len(got)
        if self.held + size > self.limit:
            self.clear()
            self.held = 0
        if size <= self.limit:
            self[piece] = got
            self.held += size
        return got


# Characters below U+0250 that are letters, numbers and white space (fixed values of Unicode).
_L = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_N = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_W = "\t-\r \u0085\u00a0"
#: The vocabularies' split patterns (fixed values) for texts of such characters.
#: Letters are tried first, as most pieces are words; only marks can stand where a short form begins.
WORD_SPLIT = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_W}{_L}{_N}]+")
BYTE_SPLIT = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
# Beyond these characters, or with a letter whose lower case lies beyond them, a text isn't split here.
_LAST = 0x24F
_BEYOND = re.compile(f"[^\0-{chr(_LAST)}" + "]|[" + "".join(chr(c) for c in range(_LAST + 1) if any(ord(x) > _LAST for x in chr(c).lower())) + "]")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def is_latin(text: str) -> bool:
    return text.isascii() or _BEYOND.search(text) is None


def byte_letters() -> list[str]:
    """The visible letter of each byte: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, name_or_path: str, cache_bytes: int = CACHE_BYTES):
        path = tokenizer_path(name_or_path)
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in normal.get("normalizers", [])]
        # Lower-case words without white space, or the byte level: the two kinds that are split here.
        self.words = kinds == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed"
        self.bytes = not normal and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = _Pieces(self._piece, cache_bytes)
        self.others = _Pieces(self._library, cache_bytes // 4)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """One pre-token through the library's merges; ASCII letters are their own byte letters."""
        letters = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else array("I", ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if (self.words or self.bytes) and is_latin(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, WORD_SPLIT.findall(text.lower()) if self.words else BYTE_SPLIT.findall(text)))
        if self.words:  # no pre-token holds a space
            return b"".join(map(self.others.__getitem__, text.replace("\n", " ").split(" ")))
        return self._library(text)

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4
