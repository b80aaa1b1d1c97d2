"""The corpus pipeline on a small fixture: each stage's decisions take effect, and clean documents stay."""

import hashlib
import random

import corpus_pipeline
from shelfdate.llm import pieces
from shelfdate.llm.queries import tokenizer_path


def test_pipeline(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    item = text(25)
    block = "\n".join(text(6) for _ in range(12))
    rows = [(i, "\n".join(text(60) for _ in range(3))) for i in range(40)]
    clean = [d for d, _ in rows]
    rows += [(100, rows[0][1]), (101, "\n".join(word() + x[x.index(" ") :] for x in rows[1][1].split("\n"))), (102, text() + " " + item + " " + text()), (103, "short text"), (104, ("say it now " * 40).strip()), (105, text() + "\n" + block), (106, text() + "\n" + block), (107, None), (108, "")]
    labels = [(d, 1) for d in clean] + [(200 + k, 0) for k in range(20)]
    rows += [(200 + k, " ".join(word() + "%%%" for _ in range(60))) for k in range(20)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = now
        if name != "sentencepiece":
            assert now.columns == docs.columns, name
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(clean) | {100, 105, 106} == set(out) and out[100].n_tokens == 1  # line dedup has emptied the copy
    ids = lambda name: {x.doc_id for x in seen[name].select("doc_id").collect()}
    assert ids("quality_rules") == set(clean) | {100, 101, 102, 105, 106}
    after = {x.doc_id: x for x in seen["line_dedup"].collect()}
    assert after[105].text == rows[45][1] and len(after[106].text) < len(rows[46][1]) and after[106].n_chars == len(after[106].text)
    assert ids("near_dedup") == ids("quality_rules") - {101} and ids("decontamination") == ids("near_dedup") - {102}
    own = pieces.Pieces(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    assert out[106].n_tokens == len(own.encode(after[106].text)[0]) and out[106].decoded_sha256 == hashlib.sha256(after[106].text.encode()).hexdigest()
