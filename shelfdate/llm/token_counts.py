"""Operator 9: token counts by prefix dynamic programming over byte-level BPE.

The count for every prefix of a pre-token comes from one left-to-right pass: the encoding of a prefix is the encoding of
a shorter prefix plus one last token, and exactly one last token fits, namely the one that stays apart when it is encoded
together with the token before it. A text keeps the running counts at its pre-token starts, so that the count of any
prefix, and the longest prefix within a budget, are looked up and never encoded again.

Cases: null text is the empty text (0 bytes, 0 tokens); rows are independent, so repeated rows and null ids give a row
each; empty tables give no rows; other columns are ignored. A text holding the special token's string gets that one
token there, as the library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_right
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows, pick

#: Fixed value: the byte-level pre-token pattern (\s stated as the Unicode white space property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts within Latin-1, its letters, numbers and white space spelt out for the faster engine.
LATIN = "".join(chr(c) for c in range(256) if chr(c).isalpha()), "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{0}]+| ?[{1}]+| ?[^{0}{1}{2}]+|[{2}]+(?![^{2}])|[{2}]+".format(*LATIN)
#: Pre-tokens remembered by one task; beyond it those not met lately go.
MEMORY = 300_000
NEVER = 1 << 60
#: Bytes up to which the program's state for a prefix is kept for other pre-tokens that begin alike.
SHARED = 7
#: Bytes of a token's end by which the longest tokens with that end are looked up.
ENDING = 4
#: Characters from which a pre-token is long.
LONG = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix of a pre-token, by dynamic programming over its last token."""

    def __init__(self, model: str | bytes):
        spec = json.loads(model)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        # of each token, and of none at a start, whether tokens stay apart behind it, as far as known
        self.after: dict[bytes, dict[bytes, bool]] = {t: {} for t in (b"", *tokens)}
        self.names = {id(known): t for t, known in self.after.items()}
        self.pairs = 0
        # the most bytes of a token with such an end; other tokens are shorter than the end
        self.reach: dict[bytes, int] = {}
        for t in tokens:
            if len(t) >= ENDING:
                self.reach[t[-ENDING:]] = max(self.reach.get(t[-ENDING:], 0), len(t))
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find_any, self.find_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.begun: dict[bytes, tuple[list[dict[bytes, bool]], list[int]]] = {}
        self.counts = _Counts(self)

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain BPE: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
        if len(piece) <= 64:
            rank, parts = self.rank, [piece[i : i + 1] for i in range(len(piece))]
            pairs = [rank.get((a, b), NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            while pairs and (best := min(pairs)) != NEVER:
                i = pairs.index(best)
                parts[i : i + 2] = [t := parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = rank.get((parts[i - 1], t), NEVER)
                if i < len(pairs):
                    pairs[i] = rank.get((t, parts[i + 1]), NEVER)
            return parts
        return self._encode_long(piece)

    def _encode_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap, for pieces that would take too long by scanning."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not a or j >= len(parts) or parts[j] is not b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := self.rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := self.rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p is not None]

    def _stays(self, a: bytes, b: bytes) -> bool:
        """Whether b stays apart when it is encoded together with the token a before it, or alone where a is empty; kept beside a."""
        if self.pairs > 4 * MEMORY:
            self.pairs = 0
            for known in self.after.values():
                known.clear()
        self.pairs += 1
        known = self.after[a][b] = self.encode(a + b) == ([a, b] if a else [b])
        return known

    def prefixes(self, piece: bytes) -> list[int]:
        """prefixes(p)[i] is the number of tokens of p[:i]."""
        known, after, reach = self.begun, self.after, self.reach
        at = min(len(piece), SHARED)
        while at and (state := known.get(piece[:at])) is None:
            at -= 1
        last, count = (state[0][:], state[1][:]) if at else ([after[b""]], [0])
        for i in range(at + 1, len(piece) + 1):
            n = reach.get(piece[i - ENDING : i], ENDING - 1) if i >= ENDING else i
            for k in range(i - n if i > n else 0, i):
                t = piece[k:i]
                if (own := after.get(t)) is not None:
                    if (stays := last[k].get(t)) is None:
                        stays = self._stays(self.names[id(last[k])], t)
                    if stays:
                        last.append(own)
                        count.append(count[k] + 1)
                        break
            else:
                raise AssertionError("no last token fits")
            if i <= SHARED:
                if len(known) > MEMORY:
                    known.clear()
                known[piece[:i]] = last[:], count[:]
        return count

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens, in order; joined they are the text."""
        if self.split is None or not any(s in text for s in self.special):
            return self.find(text)
        return [x for k, part in enumerate(self.split.split(text)) for x in ([part] if k % 2 else self.find(part))]

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.pieces(text)))

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class _Counts(dict):
    """Tokens of a pre-token; filled by the dynamic program when first asked for."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.old = counter, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMORY // 2:  # what was met since the last time stays, what was met before that goes
            self.old = dict(self)
            self.clear()
        if (n := self.old.get(piece)) is None:
            n = 1 if piece in self.counter.special else self.counter.prefixes(piece.encode())[-1]
        self[piece] = n
        return n


class PrefixTable:
    """Answers count and budget questions about one text from its stored prefix counts."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.pieces = counter.pieces(text)
        self.totals = [0, *accumulate(map(counter.counts.__getitem__, self.pieces))]

    @cached_property
    def starts(self) -> list[int]:
        return [0, *accumulate(map(len, self.pieces))]

    @property
    def total(self) -> int:
        return self.totals[-1]

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]. Only what the cut changes, the pre-tokens of the last white space run and word, is split again."""
        chars = max(0, min(chars, len(self.text)))
        if chars == len(self.text):
            return self.total
        j = bisect_right(self.starts, chars) - 1
        if self.starts[j] == chars and j:
            j -= 1
        while j and (self.pieces[j - 1].isspace() or self.pieces[j - 1][0] in "'<" or self.pieces[j].isspace()):
            j -= 1
        return self.totals[j] + self.counter.count(self.text[self.starts[j] : chars])

    def within(self, budget: int) -> int:
        """The most characters whose prefix has no more than budget tokens."""
        if self.total <= budget:
            return len(self.text)
        j = max(0, bisect_right(self.totals, budget) - 1)
        if j < len(self.pieces) and len(self.pieces[j]) > LONG:
            # any two or more characters of a long pre-token are one pre-token, so that its table of prefixes has them all
            counts, place, fits = self.counter.prefixes(self.pieces[j].encode()), 0, 0
            for k, c in enumerate(self.pieces[j], 1):
                place += len(c.encode())
                if k > 1 and self.totals[j] + counts[place] <= budget:
                    fits = k
            return self.starts[j] + fits if fits else max(c for c in (self.starts[j], self.starts[j] + 1) if self.count(c) <= budget or c == self.starts[j])
        best = max(0, self.starts[max(0, j - 1)])
        for chars in range(min(len(self.text), self.starts[min(j + 1, len(self.pieces))]), best - 1, -1):
            if self.count(chars) <= budget:
                return chars
        return best


def count_tokens(df: DataFrame, model_path: str, budget: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chars_within: the longest prefix within the budget, in code points."""
    with open(model_path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counter = PrefixCounter(held.value)

        def each(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, within = [], []
            for t in texts:
                stored = counter.table(t)
                n.append(stored.total)
                within.append(stored.within(budget))
            n_tokens = np.array(n, dtype=np.int64)
            return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n_tokens, "over_limit": n_tokens > budget, "n_chars_within": within}

        return each

    return map_rows(pick(df, doc_id="long", text="string"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_within long")
