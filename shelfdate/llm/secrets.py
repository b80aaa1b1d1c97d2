"""Operator 1: secret scan. Base rules, and a character convolutional network over every candidate and its context.

The base rules give spans of three kinds (assign, access, hex). Candidates of the network are those spans and, of every run
of token characters, what they leave of it in pieces of 16 or more with a digit. Its input is the candidate's first and last
characters and the characters on either side; a longer candidate is also read in views that slide over it, and its score is
the highest. It is trained in numpy on labelled findings made by rule from public credential formats and
from things that look alike (cards, addresses, versions, paths, identifiers). Scores are calibrated on findings that it
was not trained on; the threshold is the highest that keeps the wanted recall there. Other candidates over it become
spans of kind model; base spans always stay.

Cases: null text is the empty text, which has no span; rows are independent, so repeated rows and null ids give a row
each; empty tables give no rows; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, pick

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")

RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
DIGIT = re.compile(r"[0-9]")
MIN_CANDIDATE = 16
#: Characters of the candidate's head and of its tail, and of the context on each side.
HALF, SIDE = 24, 16
WIDTH = 2 * HALF + 2 * SIDE
#: Findings made for training, and again as many for calibration.
FINDINGS, RECALL = 1200, 0.98
#: Views scored at once, about: bounds a worker's memory, however long a candidate is.
VIEWS = 4096

_WORDS = tuple(w.encode() for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
_NO_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_HEX_MARK = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * 24


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules, sorted."""
    raw = text.encode() if raw is None else raw
    low, found = raw.lower(), []
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in raw.translate(_HEX_MARK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def other_candidates(text: str, spans: list[tuple[int, int, int]], raw: bytes | None = None) -> list[tuple[int, int]]:
    """What base spans leave of long token runs, in pieces that are long enough and hold a digit."""
    raw = text.encode() if raw is None else raw
    if not raw.translate(None, _NO_DIGIT):
        return []
    out, bounds, k = [], sorted((s, e) for s, _, e in spans), 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(bounds) and bounds[k][1] <= at:
            k += 1
        j = k
        while j < len(bounds) and bounds[j][0] < end:  # base spans may overlap one another
            out.append((at, bounds[j][0]))
            at = max(at, bounds[j][1])
            j += 1
        out.append((at, end))
    return [(s, e) for s, e in out if e - s >= MIN_CANDIDATE and DIGIT.search(text, s, e)]


def views(start: int, end: int) -> list[tuple[int, int]]:
    """The candidate, and if it is longer than a window shows, pieces of that length that overlap by half and cover it."""
    if end - start <= 2 * HALF:
        return [(start, end)]
    return [(start, end), *((s, s + 2 * HALF) for s in range(start, end - 2 * HALF, HALF)), (end - 2 * HALF, end)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character codes 0..97 (0: nothing there, 1: not ASCII, 2: control): left context, head, tail, right context."""
    body = text[start:end]
    head, tail = body[:HALF], body[HALF:][-HALF:]
    parts = text[max(0, start - SIDE) : start].rjust(SIDE, "\0") + head.ljust(HALF, "\0") + tail.rjust(HALF, "\0") + text[end : end + SIDE].ljust(SIDE, "\0")
    codes = np.frombuffer(parts.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where(codes == 0, 0, np.where(codes > 126, 1, np.where(codes < 32, 2, codes - 29)))


class CharNet:
    """One convolution over characters, maximum over positions, one dense layer; trained by Adam on the logistic loss."""

    CHARS, FILTERS, SPAN = 98, 24, 5

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {"conv": r.normal(0, 0.15, (self.SPAN, self.CHARS, self.FILTERS)), "bias": np.zeros(self.FILTERS), "dense": r.normal(0, 0.3, self.FILTERS), "out": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        n = x.shape[1] - self.SPAN + 1
        z = sum(self.w["conv"][k][x[:, k : k + n]] for k in range(self.SPAN)) + self.w["bias"]
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :]
        hidden = np.maximum(top, 0)
        return hidden @ self.w["dense"] + self.w["out"][0], hidden, at

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def scores(self, candidates: list[tuple[str, int, int]]) -> np.ndarray:
        """Of each candidate (text, start, end) the highest probability of its views."""
        best, inputs, of = np.zeros(len(candidates)), [], []
        for i, (text, start, end) in enumerate(candidates):
            for s, e in views(start, end):
                inputs.append(window(text, s, e))
                of.append(i)
                if len(inputs) >= VIEWS:
                    np.maximum.at(best, of, self.probability(np.stack(inputs)))
                    inputs, of = [], []
        if inputs:
            np.maximum.at(best, of, self.probability(np.stack(inputs)))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 7) -> CharNet:
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                logit, hidden, at = self._forward(xb)
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - yb) / len(yb)
                dh = d[:, None] * self.w["dense"] * (hidden > 0)
                g = {"dense": hidden.T @ d, "out": np.array([d.sum()]), "bias": dh.sum(axis=0), "conv": np.zeros_like(self.w["conv"])}
                f = np.broadcast_to(np.arange(self.FILTERS), at.shape)
                for k in range(self.SPAN):
                    np.add.at(g["conv"][k], (np.take_along_axis(xb, at + k, axis=1), f), dh)
                step += 1
                for k in self.w:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def calibrate(self, rows: list[tuple[str, int, int]], y: np.ndarray, recall: float) -> CharNet:
        """Platt scaling on held-out findings, then the highest threshold of at least this recall there."""
        z, a, b = self.logits(np.stack([window(*r) for r in rows])), 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.05 * (((p - y) * z).mean() + 1e-3 * a), b - 0.05 * (p - y).mean()
        self.scale, self.shift = float(a), float(b)
        own = np.sort(self.scores(rows)[y == 1])
        self.threshold = float(own[int((1 - recall) * len(own))]) if len(own) else 0.5
        return self


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(text, start, end) of findings and whether each is a secret: half from public credential formats, half from what looks alike."""
    r = np.random.default_rng(seed)
    alnum, hexa, upper, digit, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    some = lambda s, k: "".join(r.choice(list(s), k))
    word = lambda: some("etaoinshrdlu", int(r.integers(2, 9)))
    secret = [
        lambda: "ghp_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 24), lambda: "xoxb-" + some(digit, 11) + "-" + some(alnum, 24), lambda: "AIza" + some(alnum + "_-", 35), lambda: "AKIA" + some(upper, 16),
        lambda: "eyJ" + some(alnum, 20) + "." + some(alnum, 40) + "." + some(alnum + "-_", 43), lambda: some(alnum + "+/", int(r.integers(32, 64))), lambda: some(hexa, int(r.choice([32, 40, 64]))), lambda: some(alnum, int(r.integers(24, 44))), lambda: "glpat-" + some(alnum, 20),
    ]
    plain = [
        lambda: some("3456", 1) + some(digit, 15), lambda: f"{word()}.{some(digit, 2)}@mail{some(digit, 1)}.example.com"[:40].split("@")[0] + "." + word() + word(), lambda: ".".join(some(digit, 3) for _ in range(5)), lambda: "/".join(word() + some(digit, 1) for _ in range(5)), lambda: f"20{some('012', 1)}{some(digit, 1)}-{some('01', 1)}{some(digit, 1)}-{some(digit, 2)}-{word()}{word()}",
        lambda: "-".join(word() for _ in range(4)) + "-" + some(digit, 3), lambda: "".join(word() for _ in range(4)) + some(digit, 2), lambda: "_".join(word() for _ in range(3)) + "_v" + some(digit, 1) + ".tar.gz", lambda: "=" * int(r.integers(12, 30)) + some(digit, 2) + "=" * 6, lambda: some(digit, int(r.integers(16, 30))),
        lambda: "v" + ".".join(some(digit, 2) for _ in range(4)) + "-" + word() + word(), lambda: some(upper[:26], 2) + some(digit, 18), lambda: "mail" + some(digit, 1) + ".example." + word() + ".com",
    ]
    before = ["key ", 'token = "', "secret: ", "Authorization: Bearer ", "export KEY=", "", "id ", "the ", "see ", "\n"]
    out, y = [], np.arange(n) % 2
    for label in y:
        make = secret if label else plain
        body = make[int(r.integers(len(make)))]()
        left = " ".join(word() for _ in range(4)) + " " + before[int(r.integers(len(before)))]
        out.append((left + body + ["", '"', " ", ".", "\n"][int(r.integers(5))] + " " + word() + " " + word(), len(left), len(left) + len(body)))
    return out, y.astype(float)


def trained_net(findings: int = FINDINGS, recall: float = RECALL, seed: int = 11) -> CharNet:
    """The network, trained on labelled findings and calibrated on as many others."""
    rows, y = labelled_findings(2 * findings, seed)
    x = np.stack([window(*r) for r in rows[:findings]])
    return CharNet().fit(x, y[:findings]).calibrate(rows[findings:], y[findings:], recall)


def scan_secrets(df: DataFrame, net: CharNet | None = None) -> DataFrame:
    """doc_id and spans: an array of kind, start, end and the network's score, by start and kind."""
    held = df.sparkSession.sparkContext.broadcast(net or trained_net())

    def make():
        model = held.value

        def each(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found: list[list] = [[] for _ in texts]
            where = []
            for i, t in enumerate(texts):
                raw = t.encode()
                base = base_spans(t, raw)
                where += [(i, s, k, e) for s, k, e in (*base, *((s, 3, e) for s, e in other_candidates(t, base, raw)))]
            for (i, s, k, e), p in zip(where, model.scores([(texts[i], s, e) for i, s, _, e in where]), strict=True):
                if k < 3 or p >= model.threshold:
                    found[i].append((s, k, e, float(p)))
            return {"doc_id": batch.column(0), "spans": [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(f)] for f in found]}

        return each

    return map_rows(pick(df, doc_id="long", text="string"), make, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
