"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Counts of every learning row are summed per task, then over tasks; the matrix of log probabilities (languages times
buckets, a size fixed by its parameters) is broadcast, and batches are scored sparsely in numpy: of each n-gram the row of
the matrix, summed per text.

Cases: null text, or one without a letter, is und with score 0; with nothing to learn from, everything is und. Rows are
independent, so repeated rows give a row each; a row with a null id is never held out and never learned from; rows with
null lang or text are not learned from; empty tables give no rows; other columns are ignored. Equal scores go to the
language that sorts first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick

BUCKETS, ORDERS, SMOOTH = 1 << 15, (1, 2, 3, 4), 0.1
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, one after another, and where each text's begin. Case is folded; ASCII that is no letter counts as a space."""
    lowered = [f" {t.lower()} \n\n\n" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in lowered])[:-1]]).astype(np.int64)
    low = codes < 128
    codes[low] = _FOLD[codes[low].astype(np.int64)]
    out, key = [], np.zeros(max(0, len(codes) - 3), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 : n - 1 + len(key)] + np.uint64(n)
        if n in ORDERS:
            out.append(((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    found = np.stack(out, axis=1)
    ends = starts[1:]
    for back in (1, 2, 3):  # windows that would run into the next text
        found[ends - back] = 0
    return found.reshape(-1), starts * len(ORDERS)


def chunks(texts: list[str], size: int = 1 << 19):
    """Runs of texts of about that many characters."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, texts[first : i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def learn(df: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their log probabilities by bucket, with the log prior in a last column. df: text and lang of the learning rows."""
    rows = pick(df, lang="string", text="string").where("lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                docs[lang] = docs.get(lang, 0) + len(own)
                for _, part in chunks(own):
                    into += np.bincount(grams(part)[0], minlength=BUCKETS)
        for lang, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(at) + 1)), "bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(into[at], docs[lang]), pa.int64())})

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    matrix = np.zeros((len(langs), BUCKETS + 1))
    if langs:
        row = np.searchsorted(np.array(langs, dtype=object), np.array(sums.column("lang").to_pylist(), dtype=object))
        matrix[row, sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()  # bucket -1, the texts, is the last column
        body = matrix[:, :-1] + SMOOTH
        matrix[:, :-1] = np.log(body / body.sum(axis=1, keepdims=True))
        matrix[:, -1] = np.log((matrix[:, -1] + 1) / (matrix[:, -1] + 1).sum())
    return langs, matrix


def identify(df: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score, the posterior probability, from the text alone."""
    held = df.sparkSession.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1][:, :-1].T.astype(np.float32)), model[1][:, -1]))

    def make():
        langs, matrix, prior = held.value

        def each(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            for first, part in chunks(texts) if langs else ():
                buckets, starts = grams(part)
                sums = np.stack([np.add.reduceat(matrix[:, k][buckets], starts, dtype=np.float64) for k in range(len(langs))], axis=1) + prior
                top = sums.argmax(axis=1)
                p = np.exp(sums - sums.max(axis=1, keepdims=True))
                p = p[np.arange(len(part)), top] / p.sum(axis=1)
                for i, t in enumerate(part):
                    if _LETTER.search(t):
                        best[first + i], score[first + i] = langs[top[i]], p[i]
            return {"doc_id": batch.column(0), "lang_pred": best, "score": score}

        return each

    return map_rows(pick(df, doc_id="long", text="string"), make, "doc_id long, lang_pred string, score double")


def fold(doc_id):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out_languages(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learned from the rows outside the held-out fold, predicted for all."""
    own = pick(df, doc_id="long", lang="string", text="string")
    model = learn(own.where(fold(F.col("doc_id")) != 1))
    return identify(own, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
