"""Token ids of whole texts from a public tokenizer file, by the tokenizers library.

The library cuts a text into pieces before it merges, so a text may be handed to it in parts where a cut is certain, and a part
that came before need not be encoded again. Two known layouts have such places: one drops white space (any ASCII white space
parts it), the other keeps one space before a word (a single space or line feed between two other characters does; the line
feed is a piece by itself). Of a part of plain letters, digits and signs the pieces are known, so the library's model merges
them without its rules, and a word that came with other signs is not merged again; other parts go through the whole library.
Texts that hold a special token, and files of another layout, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

#: Where a text may be parted if the pieces keep their space, and what makes that not every space of it.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \n]\S)")
_OTHER_SPACE = ["  ", " \n", "\n ", "\n\n", "\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
#: Characters that are letters, digits or signs, and have one lower case and composed form, in every version of Unicode; no
#: apostrophe, as contractions have rules of their own. The pieces are what either layout makes of them.
_SIMPLE = re.compile(" ?[!-&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
_WORD = re.compile(f" ?[{_LETTERS}]+").fullmatch
#: Signs that may follow a word; the two are pieces of their own in either layout.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Parts that an encoder remembers, of at most so many bytes each; then it keeps those that the texts at hand have.
REMEMBERED, LONGEST = 400_000, 48


def default_file(name: str) -> str:
    """Path of a public tokenizer file; callers may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    found = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [found[b] for b in range(256)]


class _Known(dict):
    """Ids by part; those of a new part are made when asked for, and kept unless it is long."""

    def __init__(self, make: Callable[[bytes], bytes], held: dict[bytes, bytes] | tuple = ()):
        super().__init__(held)
        self.make = make

    def __missing__(self, raw: bytes) -> bytes:
        ids = self.make(raw)
        if len(raw) <= LONGEST:
            self[raw] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids (``bytes``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self.ids)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer") or {}
        steps = pre.get("pretokenizers") or [{}]
        bare = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s\p{L}\p{N}]+" in (steps[0].get("pattern") or {}).get("Regex", "")
        spaced = not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = {"NFC", "Lowercase", "Replace"} >= {n.get("type") for n in norm.get("normalizers") or [norm] if n}
        self.parts = spaced or (bare and plain and not made.get("post_processor"))
        specials = [t["content"] for t in made.get("added_tokens") or []]
        self.special, self.hint = re.compile("|".join(map(re.escape, specials)), re.I) if specials else None, os.path.commonprefix(specials)[:2]
        self.hint = "" if self.hint.lower() != self.hint.upper() else self.hint
        self.kind = "spaced" if spaced else "bare" if self.parts else "whole"
        self.spaced = spaced
        space, numbers = (" ?", "[0-9]+") if spaced else ("", "[0-9]")
        self.pieces = re.compile(f"{space}[{_LETTERS}]+|{space}{numbers}|{space}[^ 0-9{_LETTERS}]+").findall
        self.symbols = byte_symbols()
        self.packed = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size())]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _piece(self, raw: bytes) -> bytes:
        """Ids of a piece, which needs no rules, so the library's model merges it at once."""
        symbols, packed = self.symbols, self.packed
        shown = raw.decode().replace(" ", symbols[32]).replace("\n", symbols[10]) if raw.isascii() else "".join([symbols[b] for b in raw])
        return b"".join([packed[t.id] for t in self.model.tokenize(shown)])

    def ids(self, raw: bytes) -> bytes:
        """Ids of a part. A piece is looked up as the part that it would be by itself, so that it is merged once."""
        word = raw.rstrip(_SIGNS)
        bare = word[1:] if self.spaced and word[:1] == b" " else word
        if bare.isalpha() or (not word.isascii() and _WORD(word.decode())):
            if len(word) < len(raw):
                return self.known[word] + self.known[raw[len(word) :]]
            low = word if self.spaced else word.decode().lower().encode()
            return self._piece(word) if low == word else self.known[low]
        if self.spaced and raw[:1] == b"\n" and raw[1:2] > b" " and _SIMPLE.fullmatch(after := raw[1:].decode()):
            return self._piece(b"\n") + self.known[after.encode()]
        part = raw.decode()
        if _SIMPLE.fullmatch(part):
            return b"".join([self._piece(p.encode()) for p in self.pieces(part if self.spaced else part.lower())])
        return self._library([part])[0]

    def _parts(self, text: str) -> list[bytes] | None:
        """The parts of a text, None if it goes to the library whole."""
        if not self.parts or (self.special is not None and self.hint in text and self.special.search(text)):
            return None
        if not self.spaced:
            return text.encode().split()  # at ASCII white space, as bytes
        if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(s in text for s in _OTHER_SPACE):
            return [p.encode() for p in _BEFORE_SPACE.split(text)]
        return text.replace(" ", "\0 ").replace("\n", "\0\n").encode().split(b"\0")  # single ones alone, all between other characters

    def encode(self, texts: list[str]) -> list[bytes]:
        parted = [self._parts(t) for t in texts]
        if len(self.known) > REMEMBERED:
            had = self.known.keys() & set().union(*filter(None, parted))
            self.known = _Known(self.ids, {p: self.known[p] for p in had})
        whole = iter(self._library([t for t, parts in zip(texts, parted, strict=True) if parts is None]))
        get = self.known.__getitem__
        return [next(whole) if parts is None else b"".join(map(get, parts)) for parts in parted]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
