"""Exact encoding with the tokenizers library, each distinct piece of text encoded once per worker.

The library spends most of its time on normalising and splitting, and a corpus repeats most of its pieces.
A text is cut only where the tokenizer itself always cuts, so the pieces' ids, in order, are the text's ids:

* byte-level BPE (its pattern attaches one space to the following run): before a single space between two
  characters that are not white space;
* word BPE that drops white space: at ASCII white space.

The memo is bounded: pieces wait among at most ``NEW`` recent ones and are kept, up to ``MEMO``, when they come again,
so that the many pieces that come once do not push out the frequent ones.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

from .common import LOWER

MEMO, NEW = 400_000, 150_000
#: Characters that some regular expression libraries count as white space and others do not; no cut beside them.
_SPACE = "\\s\u180e\u200b\ufeff"
_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_LONGEST = 200  # characters of a piece that is worth remembering


def _stem(p: str) -> tuple[str, str] | None:
    """A word and the single full stop or comma after it, which both tokenizers always part."""
    return (p[:-1], p[-1]) if p[-1:] in (".", ",") and p[-2:-1].isascii() and p[-2:-1].isalpha() else None


def _stem_bytes(p: bytes) -> tuple[bytes, bytes] | None:
    return (p[:-1], p[-1:]) if p[-1:] in (b".", b",") and p[-2:-1].isalpha() else None


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo:
    """A bounded map from pieces to what ``encode`` makes of them; ``encode`` gets lists of pieces that are new.

    ``stem`` may cut a new piece in two whose results, added, are the piece's.
    """

    def __init__(self, encode: Callable[[list], list], stem: Callable):
        self.encode, self.stem, self.kept, self.recent = encode, stem, {}, {}

    def __call__(self, pieces: list) -> list:
        out = list(map(self.kept.get, pieces))
        if None in out:
            at = [i for i, x in enumerate(out) if x is None]
            new = self.learn({pieces[i] for i in at})
            for i in at:
                out[i] = new[pieces[i]]
        return out

    def learn(self, pieces: set) -> dict:
        kept, recent, found, cut, rest = self.kept, self.recent, {}, {}, set()

        def seek(p) -> bool:
            x = recent.pop(p, None)
            if x is not None:
                kept[p] = found[p] = x
            return x is not None

        for p in pieces:
            if not seek(p):
                parts = self.stem(p)
                if parts:
                    cut[p] = parts
                else:
                    rest.add(p)
        for p in {p for parts in cut.values() for p in parts if p not in found and p not in rest}:
            x = kept.get(p)
            if x is not None:
                found[p] = x
            elif not seek(p):
                rest.add(p)
        missing, made = list(rest), {}
        for i in range(0, len(missing), 256):
            part = missing[i : i + 256]
            made.update(zip(part, self.encode(part), strict=True))
        found.update(made)
        whole = {p: found[a] + found[b] for p, (a, b) in cut.items()}
        found.update(whole)
        for new in (made, whole):
            recent.update((p, x) for p, x in new.items() if len(p) <= _LONGEST)
        if len(recent) > NEW:
            self.recent = {}
        if len(kept) > MEMO:
            self.kept = {}
        return found


def _in_order(pieces: list[str], plain: Callable, together: Callable, apart: Callable) -> list:
    """Pieces of letters are one word to the tokenizer and are encoded in one text, whose ids show where words part."""
    words = [p for p in pieces if plain(p)]
    got = together(words) if words else []
    if len(got) != len(words):
        words, got = [], []
    out = dict(zip(words, got, strict=True))
    rest = [p for p in pieces if p not in out]
    out.update(zip(rest, apart(rest) if rest else [], strict=True))
    return [out[p] for p in pieces]


@cache
def byte_level_counter(path: str) -> Callable[[str], int]:
    """Counts of a byte-level BPE whose pattern is `` ?letters| ?digits| ?others|spaces``."""
    t = tokenizer(path)

    first = np.zeros(t.get_vocab_size(), bool)  # tokens that begin with a space
    first[[i for w, i in t.get_vocab().items() if w.startswith("\u0120")]] = True

    def encode(pieces: list[str]) -> list[int]:
        def together(words: list[str]) -> list[int]:
            ids = np.array(t.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids)
            return np.diff(np.r_[np.flatnonzero(first[ids]), len(ids)]).tolist()

        return _in_order(pieces, lambda p: p[0] == " " and p[1:].isalpha(), together, lambda x: [len(e.ids) for e in t.encode_batch_fast(x, add_special_tokens=False)])

    memo = Memo(encode, _stem)

    def count(text: str) -> int:
        if not text:
            return 0
        pieces = _CUT.split(text)
        return sum(memo([pieces[0], *[" " + p for p in pieces[1:]]]))

    return count


@cache
def word_encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a BPE that drops white space, as little-endian unsigned 32-bit integers."""
    t = tokenizer(path)

    last = np.zeros(t.get_vocab_size(), bool)  # tokens that end a word
    last[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(pieces: list[bytes]) -> list[bytes]:
        def together(words: list[str]) -> list[bytes]:
            ids = np.array(t.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

        return _in_order([p.decode() for p in pieces], str.isalpha, together, lambda x: [array("I", e.ids).tobytes() for e in t.encode_batch_fast(x, add_special_tokens=False)])

    memo = Memo(encode, _stem_bytes)

    def ids(text: str) -> bytes:
        b = text.encode()
        if b"<|" not in b:  # special tokens are found before letters are lowered
            b = b.translate(LOWER)
        return b"".join(memo(b.split()))

    return ids
