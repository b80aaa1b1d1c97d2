"""Operator 6: SentencePiece BPE encoding that keeps offsets, and decoding.

Normalisation walks the text by longest prefix through the model's compiled character map (a double-array trie) and notes
for each normalised character the source byte where it came from. Encoding merges on the normalised text, so that every
piece is projected through that alignment to a span of source bytes. Pieces never cross from a letter into a following
space mark, nor touch a character that no piece holds; the text is cut there and each cut's merge result is remembered. Cuts
that aren't known yet are merged side by side, each step the best pair of every cut.

Cases: null text is the empty text, which has the end id alone; rows are independent, so repeated rows and null ids give a
row each; empty tables give no rows; other columns are ignored. Characters that no piece holds become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, pick

SPACE = "▁"
NEVER = float("-inf")
#: Cuts remembered by one task; when it is full the rarer half goes.
MEMORY = 100_000
#: Characters of the longest cuts that are merged side by side, and of texts whose cuts are merged at once, about.
WIDE, AT_ONCE = 64, 1 << 20


class CharacterMap:
    """The compiled character map of a model: a double-array trie from byte strings to normalised strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that source holds at this byte."""
        units = self.units
        node = units[0]
        pos = (node >> 10) << ((node & 0x200) >> 6)
        found = None
        for i in range(at, len(source)):
            pos ^= source[i]
            if pos >= len(units) or (units[pos] & 0x800000FF) != source[i]:
                break
            node = units[pos]
            pos ^= (node >> 10) << ((node & 0x200) >> 6)
            if node & 0x100:
                start = units[pos] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found


class Pieces:
    """Encoder and decoder of one model; model is the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type != 2 or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with space marks in front are handled")
        n = m.normalizer_spec
        self.map = CharacterMap(n.precompiled_charsmap)
        self.dummy, self.strip, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.own = sorted((p.piece for p in m.pieces if p.type == 4), key=len, reverse=True)  # user-defined: never merged or split
        self.whole = frozenset(self.own)
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.end = next((i for i, p in enumerate(m.pieces) if p.piece == (m.trainer_spec.eos_piece or "</s>") and p.type == 3), None)
        self.surface = [b"" if p.type in (2, 3) else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.encode() for p in m.pieces]
        self.surface[self.unknown] = (m.trainer_spec.unk_surface or " ⁇ ").encode()
        self.is_byte = [p.type == 6 for p in m.pieces]
        inside = {c for p in self.score if len(p) > 1 for c in p}
        pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        marks = {c for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"}
        while late := {x[1] for x in pairs if x[1] in marks and x[0] not in marks and x[0] != SPACE}:
            marks -= late  # what a piece has behind a letter is no place to cut
        line, mark = "" if "\n" in inside else "\n", re.escape("".join(sorted(marks)))
        cut = rf"{SPACE}*[{mark}]*[^{SPACE}{line}{mark}]+|{SPACE}*[{mark}]+|{SPACE}+" if marks else rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+"
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.cut = (lambda s: [s] if s else []) if crosses else re.compile(cut + ("|\n" if line else "")).findall
        self.keep = re.compile("(" + "|".join(map(re.escape, self.own)) + ")") if self.own else None
        self.pairs = _Pairs(self.score, self.id, len(m.pieces))
        self.memory = _Cuts(self)
        self.decimal = [str(i) for i in range(len(m.pieces))]

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its bytes and its end, the source byte it came from; None: byte i+shift for all, as nothing is rewritten but spaces."""
        if not self.map.units and not self.strip and self.escape:
            if not text:
                return "", None
            return (SPACE if self.dummy else "") + text.replace(" ", SPACE), None
        source, out, align, i = text.encode(), bytearray(), [], 0
        parts: list[tuple[bytes, int]] = []
        while i < len(source):
            own = next((u for u in (x.encode() for x in self.own) if source.startswith(u, i)), None)
            found = (len(own), own) if own else self.map.longest(source, i) if self.map.units else None
            if found is None:
                size = 1 if source[i] < 0x80 else 2 if source[i] < 0xE0 else 3 if source[i] < 0xF0 else 4
                found = size, source[i : i + size]
            parts.append((found[1], i))
            i += found[0]
        if self.strip:
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
        mark = SPACE.encode() if self.escape else b" "
        if self.dummy and parts:
            out += mark
            align += [parts[0][1]] * len(mark)
        spaced = self.strip
        for piece, at in parts:
            if spaced:
                piece = piece.lstrip(b" ")
            for b in piece:
                unit = mark if b == 0x20 else bytes([b])
                out += unit
                align += [at] * len(unit)
            if piece:
                spaced = self.strip and piece.endswith(b" ")
        last = len(source)
        if self.strip:
            while out.endswith(mark):
                last = align[-len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        return out.decode(), np.array([*align, last], dtype=np.int64)

    def merge(self, cut: str) -> list[str]:
        """The best-scored adjacent pair that is a piece merges first, the leftmost of equals."""
        if len(cut) > WIDE:
            return self._merge_long(cut)
        score, parts = self.score, list(cut)
        pairs = [score.get(a + b, NEVER) for a, b in zip(cut, cut[1:], strict=False)]
        while pairs and (best := max(pairs)) != NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [p := parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score.get(parts[i - 1] + p, NEVER)
            if i < len(pairs):
                pairs[i] = score.get(p + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, cut: str) -> list[str]:
        """The same with a heap, for cuts that would take too long by scanning."""
        parts: list[str | None] = list(cut)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score = self.score
        heap = [(-score[p], i, len(p)) for i in range(len(parts) - 1) if (p := cut[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or len(parts[i]) + len(parts[j]) != size:
                continue
            p = parts[i] + parts[j]
            parts[i], parts[j] = p, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (q := p + parts[k]) in score:
                    heapq.heappush(heap, (-score[q], i, len(q)))
            if (h := before[i]) >= 0 and (q := parts[h] + p) in score:
                heapq.heappush(heap, (-score[q], h, len(q)))
        return [p for p in parts if p is not None]

    def ids_of(self, cut: str) -> tuple[list[int], list[int]]:
        """Ids of a cut and the normalised bytes of each."""
        ids, sizes = [], []
        for p in self.merge(cut):
            raw = p.encode()
            if (i := self.id.get(p)) is not None:
                ids.append(i)
                sizes.append(len(raw))
            elif self.byte:
                ids += [self.byte[b] for b in raw]
                sizes += [1] * len(raw)
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return ids, sizes

    def cuts(self, normalised: str) -> list[str]:
        if self.keep is None:
            return self.cut(normalised)
        return [x for k, part in enumerate(self.keep.split(normalised)) for x in ([part] if k % 2 else self.cut(part))]

    def encode_all(self, texts: list[str], end: bool = True):
        """encode of each text; the cuts of some texts at once are merged side by side."""
        for part in _portions(texts):
            ready = [(n, a, self.cuts(n)) for n, a in map(self.normalise, part)]
            known = self.memory.known(set(chain.from_iterable(cuts for _, _, cuts in ready)))
            for text, (normalised, align, cuts) in zip(part, ready, strict=True):
                yield self._project(text, normalised, align, list(map(known.__getitem__, cuts)), end)

    def encode(self, text: str, end: bool = True) -> tuple[list[int], np.ndarray]:
        """Ids, and for each the first and last source byte (end exclusive) it stands for. The end id has an empty span at the end."""
        return next(self.encode_all([text], end))

    def _project(self, text: str, normalised: str, align: np.ndarray | None, cuts: list[bytes], end: bool) -> tuple[list[int], np.ndarray]:
        known = np.frombuffer(b"".join(cuts), dtype=np.int32).reshape(-1, 2)
        ids, ends = known[:, 0].tolist(), np.cumsum(known[:, 1], dtype=np.int64)
        source = text.encode()
        total = len(source)
        if align is None:
            raw = normalised.encode()
            width = np.frombuffer(raw, dtype=np.uint8)
            mark = SPACE.encode()
            hits = np.flatnonzero(width[:-2] == mark[0])
            hits = hits[(width[hits + 1] == mark[1]) & (width[hits + 2] == mark[2])]
            step = np.ones(len(raw) + 1, dtype=np.int64)
            step[0] = 0
            if self.dummy and len(hits):
                step[1:4] = 0
                hits = hits[1:]
            real = hits
            if SPACE in text:  # the text's own marks keep their three bytes
                spaces = np.array([c == " " for c in text if c in (" ", SPACE)], dtype=bool)
                real = hits[spaces]
            step[real + 2] = 0
            step[real + 3] = 0
            align = np.cumsum(step)
            assert align[-1] == total
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        spans = np.stack([align[starts], align[ends]], axis=1) if len(ends) else np.empty((0, 2), np.int64)
        if end and self.end is not None:
            ids.append(self.end)
            spans = np.concatenate([spans, [[total, total]]])
        return ids, spans

    def decode(self, ids: list[int]) -> str:
        """The text of ids: space marks become spaces, the first piece loses the mark that encoding put in front, byte pieces join as UTF-8."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and not self.is_byte[first] and (self.dummy or self.strip) and raw.startswith(SPACE.encode()):
            raw = raw[3:]
        return raw.decode("utf-8", "replace").replace(SPACE, " ")

    def digest(self, ids: list[int], spans: np.ndarray) -> tuple[int, str, str, str]:
        """Of an encoded text: all ids counted, and hashes of: the ids as decimals joined by a space; the text decoded from them; the spans' first and last bytes, id by id, as little-endian 64-bit numbers."""
        joined = " ".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest(), hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest()


def _portions(texts: list[str]):
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE or i + 1 == len(texts):
            yield texts[begin : i + 1]
            begin, size = i + 1, 0


class _Pairs:
    """Merging of many cuts side by side. A pair of pieces that is one when joined has the rank of its score, the best highest."""

    def __init__(self, score: dict[str, float], ids: dict[str, int], n: int):
        self.n = n
        rank = {x: r for r, x in enumerate(sorted(set(score.values())), 1)}  # equal scores have equal ranks
        found = sorted((ids[p[:i]] * (n + 1) + ids[p[i:]], rank[x], ids[p]) for p, x in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score)
        keys, ranks, joined = zip(*found, (np.iinfo(np.int64).max, 0, n), strict=True)
        self.keys, self.ranks, self.joined = np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32), np.array(joined, dtype=np.int64)
        self.character = np.full(0x110000, n, dtype=np.int64)
        for p in score:
            if len(p) == 1:
                self.character[ord(p)] = ids[p]
        self.bytes = np.zeros(n + 1, dtype=np.int64)
        for p in score:
            self.bytes[ids[p]] = len(p.encode())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of ids; 0 if they join to no piece, as with n, which stands for none."""
        key = a * (self.n + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], 0)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of pairs that join to one."""
        return self.joined[np.searchsorted(self.keys, a * (self.n + 1) + b)]

    def merged(self, cuts: list[str]):
        """Each cut with what _Cuts keeps of it, but for cuts that are too long or have a character that is no piece."""
        size = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        symbols = self.character[np.frombuffer("".join(cuts).encode("utf-32-le"), dtype=np.uint32)]
        first = np.cumsum(size) - size
        plain = np.flatnonzero((np.maximum.reduceat(symbols, first) < self.n) & (size <= WIDE)) if len(cuts) else first
        low = 0
        for width in (6, 8, 10, 12, 16, 24, 40, WIDE):
            rows = plain[(size[plain] > low) & (size[plain] <= width)]
            low = width
            within = np.arange(width) < size[rows][:, None]
            ids = np.full(within.shape, self.n)
            ids[within] = symbols[(first[rows][:, None] + np.arange(width))[within]]
            ranks = self.rank(ids[:, :-1], ids[:, 1:])
            while len(rows):
                best = ranks.argmax(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)  # of equals the leftmost
                top = ranks[np.arange(len(rows)), best] if ranks.shape[1] else best
                done = top == 0
                yield from self._named(cuts, rows[done], ids[done])
                go = np.flatnonzero(~done)
                rows, best, ids, ranks, each = rows[go], best[go], ids[go], ranks[go], np.arange(len(go))
                ids[each, best] = self.join(ids[each, best], ids[each, best + 1])
                ids = np.where(np.arange(ids.shape[1] - 1) > best[:, None], ids[:, 1:], ids[:, :-1])
                ranks = np.where(np.arange(ranks.shape[1] - 1) >= best[:, None], ranks[:, 1:], ranks[:, :-1])
                for near in (best - 1, best):  # the pairs that the new piece is in
                    has = np.flatnonzero((near >= 0) & (near < ranks.shape[1]))
                    at = near[has]
                    ranks[has, at] = self.rank(ids[has, at], ids[has, at + 1])

    def _named(self, cuts: list[str], rows: np.ndarray, ids: np.ndarray):
        real = ids < self.n
        flat = ids[real]
        packed = np.stack([flat, self.bytes[flat]], axis=1).astype(np.int32).tobytes()
        edge = (8 * np.cumsum(real.sum(axis=1))).tolist()
        a = 0
        for row, z in zip(rows.tolist(), edge, strict=True):
            yield cuts[row], packed[a:z]
            a = z


class _Cuts:
    """Of a cut: its ids and the normalised bytes of each, as pairs of 32-bit numbers in one string of bytes, which is less to keep and to join than lists."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.recent: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, cuts: set[str]) -> dict[str, bytes]:
        """Of these cuts; those not remembered are merged side by side, or one by one where that leaves them out."""
        recent, old = self.recent.get, self.old.get
        found = {c: recent(c) or old(c) for c in cuts}
        new = [c for c, have in found.items() if have is None]
        if new:
            found.update(self.pieces.pairs.merged([c for c in new if c not in self.pieces.whole]))
            for c in new:
                if found[c] is None:
                    found[c] = self.one(c)
        if len(self.recent) + len(found) > MEMORY:
            self.old, self.recent = self.recent, {}
        self.recent.update(found)
        return found

    def one(self, cut: str) -> bytes:
        ids, sizes = ([self.pieces.id[cut]], [len(cut.encode())]) if cut in self.pieces.whole else self.pieces.ids_of(cut)
        return np.array([ids, sizes], dtype=np.int32).T.tobytes()


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_pieces(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, and starts and ends: the source bytes of each id."""
    held = _model(df, model_path)

    def make():
        pieces = Pieces(held.value)

        def each(batch: pa.RecordBatch) -> dict:
            done = list(pieces.encode_all([t or "" for t in batch.column(1).to_pylist()]))
            return {"doc_id": batch.column(0), "ids": [d[0] for d in done], "starts": [d[1][:, 0] for d in done], "ends": [d[1][:, 1] for d in done]}

        return each

    return map_rows(pick(df, doc_id="long", text="string"), make, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode_pieces(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of doc_id, ids; null ids give an empty text."""
    held = _model(df, model_path)

    def make():
        pieces = Pieces(held.value)
        return lambda batch: {"doc_id": batch.column(0), "text": [pieces.decode(i or []) for i in batch.column(1).to_pylist()]}

    return map_rows(pick(df, doc_id="long", ids="array<int>"), make, "doc_id long, text string")


def piece_digests(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids, of the text decoded from them and of the ids' source spans, without sending these through Spark."""
    held = _model(df, model_path)

    def make():
        pieces = Pieces(held.value)

        def each(batch: pa.RecordBatch) -> dict:
            done = [pieces.digest(*d) for d in pieces.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            return {"doc_id": batch.column(0), "n_tokens": [d[0] for d in done], "ids_sha256": [d[1] for d in done], "decoded_sha256": [d[2] for d in done], "spans_sha256": [d[3] for d in done]}

        return each

    return map_rows(pick(df, doc_id="long", text="string"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
