"""Operator 4: quality rules. Fixed base rules, and a logistic regression on hashed word and character n-grams.

A text's features are the shares of its words and of its byte trigrams in hashed buckets. The regression is trained on
labelled rows, calibrated on rows that it was not trained on, and scored in Arrow batches: each word's and trigram's
weight is looked up and averaged. A text is kept if the base rules pass it and its calibrated probability of good quality
is at least KEEP.

Cases: null text has no word and fails the base rules. Labels are taken once for each id (the lowest of several); rows
with null labels, ids or texts are not learned from. Without both labels to learn from, the base rules alone decide. Rows
are independent, so repeated rows and null ids give a row each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, slices

#: Labelled rows that the regression is fitted on at most: those whose ids hash lowest.
SAMPLE = 3000
BUCKETS, KEEP = 4096, 0.5
#: Bytes of text laid out at once.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_P = 0x5851F42D4C957F2D
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int, base: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    if len(have := known.get(base, ())) < n:
        have = known[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * CHUNK), base, dtype=np.uint64), dtype=np.uint64)])
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Laid:
    """Texts laid out in one buffer: hashes of their words, and buckets of words and trigrams, with the text of each."""

    n: int
    buffer: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    word_doc: np.ndarray
    word_chars: np.ndarray

    @staticmethod
    def of(raws: list[bytes]) -> Laid:
        buffer = np.frombuffer(b"  ".join([*raws, b""]), dtype=np.uint8)
        sizes = np.array([len(r) + 2 for r in raws], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        doc = np.repeat(np.arange(len(raws)), sizes)
        space = _SPACE[buffer]
        before = np.concatenate([[True], space[:-1]])
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(space & ~before)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _powers(len(buffer), _P), dtype=np.uint64)])
        words = _mix((total[end] - total[start]) * _powers(len(buffer), pow(_P, -1, 1 << 64))[start]) if len(start) else np.zeros(0, np.uint64)
        chars = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
        return Laid(len(raws), buffer, first, doc, words, doc[start], chars[end] - chars[start])

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)

    def repeat_words(self) -> np.ndarray:
        """Words of each text that are in 5-word windows found twice or more in it."""
        w, d = self.words, self.word_doc
        if len(w) < 5:
            return np.zeros(self.n, np.int64)
        n = len(w) - 4
        key = np.zeros(n, np.uint64)
        for k in range(5):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
        at = np.flatnonzero(d[:n] == d[4:])
        key = _mix(key[at] + d[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 5, -1)
        return np.bincount(d[np.cumsum(cover)[:-1] > 0], minlength=self.n)

    def word_buckets(self) -> np.ndarray:
        return (self.words >> np.uint64(52)).astype(np.int64)

    def trigram_buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the byte trigrams and the text of each; the last of a text ends in the two spaces behind it."""
        b = self.buffer.astype(np.uint32)
        key = (b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(0x9E3779B1)
        inside = self.doc[:-2] == self.doc[2:]
        return (key >> np.uint32(20)).astype(np.int64)[inside], self.doc[:-2][inside]


def laid(texts: list[str | None]):
    """(first text, raw texts, layout) of runs of texts of about CHUNK bytes."""
    raws = [(t or "").encode() for t in texts]
    begin, size = 0, 0
    for i, r in enumerate(raws):
        size += len(r)
        if size >= CHUNK or i + 1 == len(raws):
            part = raws[begin : i + 1]
            yield begin, part, Laid.of(part)
            begin, size = i + 1, 0


def dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


@dataclass
class Model:
    """Weights of word and trigram buckets, and the calibrated line."""

    words: np.ndarray
    trigrams: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def probability(self, x: Laid) -> np.ndarray:
        n = np.maximum(1, np.bincount(x.word_doc, minlength=x.n))
        word = np.bincount(x.word_doc, weights=self.words[x.word_buckets()], minlength=x.n) / n
        tri, doc = x.trigram_buckets()
        m = np.maximum(1, np.bincount(doc, minlength=x.n))
        z = word + np.bincount(doc, weights=self.trigrams[tri], minlength=x.n) / m + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def sample(documents: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE) -> DataFrame:
    """doc_id, text and y of the labelled rows whose ids hash lowest, size of them at most."""
    own = pick(labels, doc_id="long", **{label: "int"}).where(f"doc_id is not null and {label} is not null")
    chosen = own.groupBy("doc_id").agg(F.min(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    ids = [(r.doc_id, r.y) for r in chosen.collect()]  # bounded by size
    few = documents.sparkSession.createDataFrame(ids, "doc_id long, y int")
    return pick(documents, doc_id="long", text="string").where("text is not null").join(F.broadcast(few), "doc_id")


@dataclass
class Shares:
    """Bucket shares of texts, those over 0 alone: row, bucket and share of each, and the rows' labels."""

    row: np.ndarray
    at: np.ndarray
    share: np.ndarray
    y: np.ndarray

    def rows(self, chosen: np.ndarray) -> Shares:
        own = chosen[self.row]
        return Shares((np.cumsum(chosen) - 1)[self.row[own]], self.at[own], self.share[own], self.y[chosen])

    def times(self, w: np.ndarray) -> np.ndarray:
        """A number for each row: its shares by the buckets' weights."""
        return np.bincount(self.row, weights=self.share * w[self.at], minlength=len(self.y))

    def back(self, d: np.ndarray) -> np.ndarray:
        """A number for each bucket: its shares by the rows' weights."""
        return np.bincount(self.at, weights=self.share * d[self.row], minlength=2 * BUCKETS)


def features(df: DataFrame) -> Shares:
    """The bucket shares of the sample's texts and their labels, in order of id."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            at, share = [], []
            for _, raws, x in laid(batch.column(1).to_pylist()):
                (tri, doc), word = x.trigram_buckets(), x.word_buckets()
                edges = [np.searchsorted(of, np.arange(len(raws) + 1)) for of in (x.word_doc, doc)]
                for i in range(len(raws)):
                    own = [of[e[i] : e[i + 1]] for of, e in zip((word, tri), edges, strict=True)]
                    counts = np.concatenate([np.bincount(o, minlength=BUCKETS) / max(1, len(o)) for o in own])
                    at.append(np.flatnonzero(counts).astype(np.int32))
                    share.append(counts[at[-1]].astype(np.float32))
            return {"doc_id": batch.column(0), "y": batch.column(2), "at": at, "share": share}

        return each

    rows = map_rows(df.select("doc_id", "text", "y"), make, "doc_id long, y int, at array<int>, share array<float>").toArrow().sort_by("doc_id")
    at, share = rows.column("at").combine_chunks(), rows.column("share").combine_chunks()
    sizes = np.diff(at.offsets.to_numpy())
    return Shares(np.repeat(np.arange(len(sizes)), sizes), at.flatten().to_numpy(), share.flatten().to_numpy(), rows.column("y").to_numpy().astype(float))


def fit(x: Shares, rounds: int = 150, ridge: float = 1e-4) -> Model | None:
    """Accelerated gradient descent on the logistic loss over scaled columns; every fourth row is left for calibration."""
    y = x.y
    if len(set(y)) < 2:
        return None
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    own = x.rows(~aside)
    yt = own.y
    spread = np.sqrt(np.bincount(own.at, weights=own.share**2, minlength=2 * BUCKETS) / len(yt)) + 1e-4
    scaled = Shares(own.row, own.at, own.share / spread[own.at], yt)
    weight = np.where(yt == 1, 0.5 / max(1, yt.sum()), 0.5 / max(1, (1 - yt).sum()))
    step = 4 / float(np.bincount(scaled.row, weights=scaled.share**2, minlength=len(yt)).max() + 1)
    w, old, b, old_b = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS), 0.0, 0.0
    for k in range(rounds):
        look, look_b = w + k / (k + 3) * (w - old), b + k / (k + 3) * (b - old_b)
        d = weight * (1 / (1 + np.exp(-np.clip(scaled.times(look) + look_b, -30, 30))) - yt)
        old, old_b = w, b
        w, b = look - 30 * step * (scaled.back(d) + ridge * look), look_b - 30 * step * d.sum()
    flat = w / spread
    model = Model(flat[:BUCKETS], flat[BUCKETS:], float(b))
    held = x.rows(aside) if aside.any() else x
    z, yc, s, t = held.times(flat) + b, held.y, 1.0, 0.0
    for _ in range(500):  # Platt scaling by Newton's steps
        p = 1 / (1 + np.exp(-np.clip(s * z + t, -30, 30)))
        g = np.array([((p - yc) * z).mean() + 1e-3 * s, (p - yc).mean()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * z * z).mean() + 1e-3, (v * z).mean()], [(v * z).mean(), v.mean()]])
        s, t = np.array([s, t]) - 0.5 * np.linalg.solve(h, g)
    model.scale, model.shift = float(s), float(t)
    return model


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    return fit(features(sample(documents, labels, label)))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def judge(df: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The counts, the base rules' and the regression's verdict on every text."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: {"doc_id": batch.column(0), **verdicts(batch.column(1).to_pylist(), held.value, keep)}

    return map_rows(pick(df, doc_id="long", text="string"), make, SCHEMA)


def verdicts(texts: list[str | None], model: Model | None, keep: float = KEEP) -> dict[str, np.ndarray]:
    parts = []
    for _, raws, x in laid(texts):
        n = np.bincount(x.word_doc, minlength=x.n)
        repeat = x.repeat_words()
        failed = (n < 10) | (100 * repeat > 20 * n)
        p = model.probability(x) if model else np.ones(x.n)
        parts.append({"n_words": n, "word_chars": np.bincount(x.word_doc, weights=x.word_chars, minlength=x.n).astype(np.int64), "n_symbols": x.per_doc(_SYMBOL[x.buffer].astype(np.int64)), "n_dup_lines": np.array([dup_lines(r) for r in raws], dtype=np.int64), "n_repeat_words": repeat, "base_failed": failed, "probability": p, "kept": ~failed & (p >= keep)})
    return {k: np.concatenate([q[k] for q in parts]) for k in parts[0]}


def keep_good(df: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of df, with all their columns, whose text is kept."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array(verdicts(texts, held.value, keep)["kept"]))

    held = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(run, df.schema)
