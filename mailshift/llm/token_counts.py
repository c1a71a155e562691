"""Exact token counts of texts and of all their prefixes (operator 3).

Method: prefix dynamic programming.  In a byte-pair encoding exactly one token
can end the encoding of each prefix: the token whose bytes end it and which may
stand behind the last token of the shorter prefix before it.  So one pass over
the bytes of a piece gives the last token and the token count of every prefix,
and no merge is ever replayed.  Two tokens may stand side by side if no merge
across their border comes before the merges that build them.  Counts of pieces
add up; prefixes that end in white space or in a cut contraction are counted as
the library would count them if the text ended there.

Truncation and budgets are then look-ups in the stored counts.

Defined results: a null text counts as empty (0 bytes, 0 tokens); equal rows are
counted each for itself; an empty table gives no rows; other columns are ignored
or, in ``with_*``, carried along.  The vocabulary must be a plain byte-level BPE.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe

_NEVER = 1 << 40
#: Entries that a cache of a worker holds at most; it is emptied beyond.
CACHED = 500_000


class PrefixCounter(bpe.Vocabulary):
    """Token counts of every prefix of a text, by dynamic programming over its bytes."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if self.ranks is None:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        import regex

        self.is_white = regex.compile(r"\s+").fullmatch
        self.contraction = regex.compile(r"'(?:s|t|re|ve|m|ll|d)").fullmatch
        self.edges: dict[int, list[int]] = {}
        self.beside: dict[int, bool] = {}
        self.totals: dict[str, int] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """The pair that each token is made of, and which tokens an encoding can hold at all."""
        letters = {c: b for b, c in enumerate(bpe.byte_letters())}
        merges = json.loads(self.library.to_str())["model"]["merges"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for m in merges:
            a, b = (bytes(letters[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = self.ranks[a], self.ranks[b]
            self.joined[pair] = token = self.ranks[a + b]
            self.parts.setdefault(token, pair)
        self.token_of = {x: t for x, t in self.ranks.items() if t not in self.parts}
        whole = set(self.token_of.values())
        for token in sorted(self.parts):
            if whole.issuperset(self.parts[token]) and not self._crossed(*self.parts[token], below=token):
                whole.add(token)
        self.token_of = {x: t for x, t in self.ranks.items() if t in whole}
        self.ends = {x[k:] for x in self.token_of for k in range(len(x))}

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at this side of a token while it is built, first to last."""
        found = self.edges.get(token << 1 | side)
        if found is None:
            pair = self.parts.get(token)
            found = self.edges[token << 1 | side] = [*self._edge(pair[side], side), token] if pair else [token]
        return found

    def _crossed(self, left: int, right: int, below: int = _NEVER) -> bool:
        """Whether a merge of rank under ``below`` crosses the border of two tokens before both are built."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else _NEVER
            next_b = b[j + 1] if j + 1 < len(b) else _NEVER
            across = self.joined.get((a[i], b[j]), _NEVER)
            # At equal rank the merge further left comes first.
            if across < below and across < next_a and across <= next_b:
                return True
            if next_a == next_b == _NEVER:
                return False
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def may_follow(self, left: int, right: int) -> bool:
        if len(self.beside) >= CACHED:
            self.beside.clear()
        known = self.beside[left << 20 | right] = not self._crossed(left, right)
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """Token counts of every prefix of one piece."""
        last, counts, of, ends, beside = [0], [0], self.token_of, self.ends, self.beside
        for end in range(1, len(data) + 1):
            start = end - 1
            while start and data[start - 1:end] in ends:
                start -= 1
            while True:
                token = of.get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    fits = beside.get(last[start] << 20 | token)
                    if fits or fits is None and self.may_follow(last[start], token):
                        break
                start += 1
            last.append(token)
            counts.append(counts[start] + 1)
        return counts

    def char_counts(self, piece: str) -> list[int]:
        """Token counts behind each character of a piece, if the text ended there."""
        counts = self.byte_counts(piece.encode())
        if len(counts) != len(piece) + 1:
            ends = np.cumsum([len(c.encode()) for c in piece]).tolist()
            counts = [0, *(counts[e] for e in ends)]
        if len(piece) == 3 and self.contraction(piece):
            counts[2] = 2
        return counts[1:]

    def _segment(self, text: str, base: int) -> list[int]:
        """Counts behind each character of a text without special strings, plus base."""
        out: list[int] = []
        white, white_base = "", base
        for piece in self.cut_pieces(text):
            counts = self.char_counts(piece)
            if self.is_white(piece):
                if not white:
                    white_base = base
                white += piece
                out += [white_base + c for c in self.char_counts(white)[-len(piece):]]
            else:
                if white and piece[0] == " ":
                    out.append(white_base + self.char_counts(white + " ")[-1])
                    out += [base + c for c in counts[1:]]
                else:
                    out += [base + c for c in counts]
                white = ""
            base += counts[-1]
        return out

    def _unit_total(self, unit: str) -> int:
        total, pieces = 0, self.cut_pieces(unit)
        for piece in pieces:
            n = self.totals.get(piece)
            if n is None:
                n = self.byte_counts(piece.encode())[-1]
                self._remember(piece, n)
            total += n
        if len(pieces) > 1:
            self._remember(unit, total)
        return total

    def _remember(self, text: str, total: int) -> None:
        if len(text) <= 64:
            if len(self.totals) >= CACHED:
                self.totals.clear()
            self.totals[text] = total

    def _plain_total(self, text: str) -> int:
        units = bpe.cut_units(text)
        found = list(map(self.totals.get, units))
        if None in found:
            found = [(self.totals.get(u) or self._unit_total(u)) if x is None else x for u, x in zip(units, found)]
        return sum(found)

    def _split_special(self, text: str) -> list[str]:
        """Ordinary segments at even places, special strings at odd ones."""
        if not any(s in text for s in self.special):
            return [text]
        names = sorted(self.special, key=len, reverse=True)
        return re.split("(" + "|".join(map(re.escape, names)) + ")", text)

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        parts = self._split_special(text)
        return sum(self._plain_total(p) for p in parts[::2] if p) + len(parts) // 2

    def prefix_counts(self, text: str) -> np.ndarray:
        """For k from 0 to the number of characters, the tokens of the first k characters."""
        out = [0]
        base = 0
        parts = self._split_special(text)
        for k in range(0, len(parts), 2):
            segment = parts[k]
            if segment:
                out += self._segment(segment, base)
                whole = base + self._plain_total(segment)
            else:
                whole = base
            if k + 1 < len(parts):
                # A prefix that ends inside a special string is ordinary text there.
                tail = bpe.cut_units(segment)[-1] if segment else ""
                before = whole - (self._plain_total(tail) if tail else 0)
                cut = [self._segment(tail + parts[k + 1][:n], before)[-1] for n in range(1, len(parts[k + 1]))]
                out += [*cut, whole + 1]
                base = whole + 1
        return np.array(out, dtype="int32")


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _by_text(text: Column, kind: str, one: Callable[[PrefixCounter, str], object], vocabulary: str | None) -> Column:
    path = vocabulary or bpe.default_path()

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([one(c, t or "") for t in texts], dtype=object if kind.startswith("array") else "int64")

    return apply(text)


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of the whole text."""
    return _by_text(text, "bigint", lambda c, t: c.total(t), vocabulary)


def prefix_token_counts(text: Column, vocabulary: str | None = None) -> Column:
    """The stored counts: element k + 1 is the exact number of tokens of the first k characters."""
    return _by_text(text, "array<int>", lambda c, t: c.prefix_counts(t), vocabulary)


def chars_within(counts: Column, budget: int) -> Column:
    """From stored counts, the length of the longest prefix of at most ``budget`` tokens."""
    return F.array_max(F.transform(counts, lambda c, k: F.when(c <= budget, k)))


def tokens_between(counts: Column, start: Column, end: Column) -> Column:
    """From stored counts, by how many tokens the first ``end`` characters exceed the first ``start``."""
    return F.element_at(counts, end + 1) - F.element_at(counts, start + 1)


def with_counts(docs: DataFrame, *, text_col: str = "text", limit: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit."""
    return (docs.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"))
            .withColumn("n_tokens", token_count(F.col(text_col), vocabulary))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def truncated(docs: DataFrame, budget: int, *, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Each text cut to its longest prefix of at most ``budget`` tokens, decided on the stored counts."""
    counts = prefix_token_counts(F.col(text_col), vocabulary)
    return (docs.withColumn("prefix_counts", counts)
            .withColumn(text_col, F.expr(f"substring({text_col}, 1, {{}})".format("array_max(transform(prefix_counts, (c, k) -> if(c <= %d, k, 0)))" % budget)))
            .drop("prefix_counts"))
