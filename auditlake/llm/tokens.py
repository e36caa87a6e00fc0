"""Token ids by a public tokenizer file, remembered per chunk between white space."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
from pyspark import SparkContext


#: Pieces remembered by one memo, in two generations of half as many; at about 150 bytes each.
MEMO_ENTRIES = 700_000
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
_INNER = re.compile(r"(?<=\S) (?=\S)")
#: Texts of these characters alone (no apostrophe, which can begin a contraction) are cut by the patterns below just as
#: the pre-tokenizers cut them: byte-level, and word ends without white space.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^{_L}0-9 \\n\\t!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{{|}}~-]")
_PIECES = re.compile(f" ?[{_L}]+| ?[0-9]+| ?[^\\s{_L}0-9]+|\\s+(?!\\S)|\\s+").findall
_WORDS = re.compile(f"[{_L}]+|[0-9]|[^\\s{_L}0-9]+").findall
_encoders: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as one character: printable Latin-1 as itself, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = str.maketrans(_byte_letters())


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.make(chunk)
        if len(self) >= MEMO_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found


class Encoder:
    """Encodes whole texts piece by piece, each remembered as its ids' bytes: little-endian unsigned 32-bit integers.

    Texts of common characters are cut into the pre-tokenizer's own pieces. For others, both kinds of pre-tokenizer
    cut at these places whatever stands around them, so that the chunks' ids are the text's ids: before a lone blank,
    and around a lone line feed (byte-level); at blanks and line feeds (those that drop white space). Such texts with
    other runs of white space are cut at the lone blanks only. Texts that hold an added token, which the library finds
    before anything else, go to it whole.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.size = self.tokenizer.get_vocab_size()
        model = self.tokenizer.model
        one = lambda s: _stored(self.tokenizer.encode(s, add_special_tokens=False).ids)
        as_bytes = lambda s: s.encode().decode("latin-1").translate(_BYTES)
        bare = lambda s: _stored([t.id for t in model.tokenize(s)])
        self.drops_space = not one(" ") and not one("\n")
        self.line_feed = one("\n")
        self.lowers = one("ABC XYZ") == one("abc xyz")
        direct = lambda s: bare(s if s.isascii() and s.isprintable() and " " not in s else as_bytes(s))
        # Pieces go to the tokenizer's model itself, if it gives the ids of the whole tokenizer on a probe.
        self.pieces = _Memo(direct)
        probe = "Éclairs überaus, xyzzy A straße. THEM niño (12) #x** ||\n\nnew line ~ qwrtpsdfghjkl!!"
        self.direct = b"".join(map(self.pieces.__getitem__, self.cut(probe))) == one(probe)
        self.bare, self.spaced = _Memo(one), _Memo(lambda s: one(f" {s}"))

    def cut(self, text: str) -> list[str]:
        if not self.drops_space:
            return _PIECES(text)
        return _WORDS(text.lower() if self.lowers else text)

    def parts(self, text: str) -> Iterable[bytes]:
        if self.added and self.added.search(text):
            return [_stored(self.tokenizer.encode(text, add_special_tokens=False).ids)]
        if self.direct and not _OTHER.search(text):
            return map(self.pieces.__getitem__, self.cut(text))
        if self.drops_space:
            return map(self.bare.__getitem__, text.replace("\n", " ").split(" "))
        if _UNEVEN.search(text):
            first, *rest = _INNER.split(text)
            return chain([self.bare[first]], map(self.spaced.__getitem__, rest))
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line_feed)
            first, *rest = line.split(" ")
            out.append(self.bare[first])
            out.extend(map(self.spaced.__getitem__, rest))
        return out

    def stored(self, text: str | None, end_id: int | None = None) -> bytes:
        end = b"" if end_id is None else _stored([end_id])
        return b"".join(self.parts(text)) + end if text else end

    def ids(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        return np.frombuffer(self.stored(text, end_id), "<u4")


def _stored(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder != "little":
        found.byteswap()
    return found.tobytes()


def shipped(context: SparkContext, path: str):
    """The tokenizer file's text as a broadcast: a vocabulary file of a few MB, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return context.broadcast(f.read())


def forget() -> None:
    """Frees what this Python worker remembers: it lives on, idle, beside stages that need the executor's memory."""
    _encoders.clear()


def encoder(spec: str) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    found = _encoders.get(spec)
    if found is None:
        _encoders.clear()
        found = _encoders[spec] = Encoder(spec)
    return found


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
