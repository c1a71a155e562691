"""Token ids of whole texts, by the ``tokenizers`` library, for use inside Spark tasks.

A byte-level BPE cuts a text into pieces before it merges, and no piece goes on
past a blank that follows a visible character.  So a text may be cut in front of
every such blank, each unit encoded on its own and the ids put together: the
result is what the library gives for the whole text.  Words come back again and
again, so ids are kept in a bounded cache of units and pieces; a piece that is
not there goes through the library's own merge model.  Units with characters
beyond Latin, whose classes differ between Unicode versions, are cut by the
library too.  Texts with special strings, and vocabularies of any other kind, go
through the library as they are.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

_AFTER_WHITE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")

# Fixed value: the pattern that cuts a text into pieces in this family of vocabularies.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


def cut_units(text: str) -> list[str]:
    """The text cut in front of every blank that follows a visible character; no piece goes on past such a cut."""
    if _AFTER_WHITE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    units = [" " + x for x in rest]
    if first:
        units.insert(0, first)
    return units


class Vocabulary:
    """The library's tokenizer, and the bytes of its tokens if it is a plain byte-level BPE."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.find_pieces = regex.compile(PIECE_PATTERN).findall
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.ranks = self._plain_ranks(told)

    @staticmethod
    def _plain_ranks(told: dict) -> dict[bytes, int] | None:
        """Token bytes to ids, if ids rise in the order of the merges and nothing else changes a text."""
        model, cut = told["model"], told.get("pre_tokenizer") or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (model["type"] != "BPE" or any(model.get(k) for k in odd) or told.get("normalizer")
                or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)):
            return None
        of = {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"] for t in told.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in k): v for k, v in model["vocab"].items() if k not in added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        singles = sorted(ranks[bytes([b])] for b in range(256) if bytes([b]) in ranks)
        if len(singles) < 256 or ids != sorted(set(ids)) or ids[0] <= singles[-1] or len(ids) + 256 != len(ranks):
            return None
        return ranks

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def cut_pieces(self, unit: str) -> list[str]:
        """The pieces of a unit of a plain vocabulary, as texts."""
        if _BEYOND_LATIN.search(unit):
            return [unit[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(unit)]
        return self.find_pieces(unit)


class Encoder(Vocabulary):
    """Ids of texts as arrays of unsigned 32-bit numbers, with a cache of at most ``entries`` units and pieces."""

    def __init__(self, path: str, entries: int = 500_000, longest: int = 64) -> None:
        super().__init__(path)
        self.entries, self.longest = entries, longest
        self.cache: dict[str, bytes] = {}
        self.octets = [i.to_bytes(4, "little") for i in range(1 + max(self.library.get_vocab().values(), default=0))]
        self.letters = dict(enumerate(byte_letters()))

    def _remember(self, text: str, ids: bytes) -> bytes:
        if len(text) <= self.longest:
            if len(self.cache) >= self.entries:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit from those of its pieces; a piece that is new goes through the library's merges."""
        cache, octets, found = self.cache, self.octets, []
        for piece in self.cut_pieces(unit):
            ids = cache.get(piece)
            if ids is None:
                lettered = piece.encode().decode("latin-1").translate(self.letters)
                ids = self._remember(piece, b"".join([octets[t.id] for t in self.library.model.tokenize(lettered)]))
            found.append(ids)
        return self._remember(unit, b"".join(found)) if len(found) > 1 else found[0]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.by_library(text), dtype="<u4")
        units = cut_units(text)
        found = list(map(self.cache.get, units))
        if None in found:
            found = [self.cache.get(u) or self._unit(u) if x is None else x for u, x in zip(units, found)]
        return np.frombuffer(b"".join(found), dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, which lives as long as the worker."""
    return Encoder(path)
