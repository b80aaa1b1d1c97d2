"""Operator 3: near duplicates by ProbMinHash over weighted word shingles, banding and verification.

Shingles are five words (runs of anything but ASCII white space; of a text with fewer, all its words), weighted by
1 + ln(count). ProbMinHash draws for each shingle a Poisson process of arrivals at registers, at the rate of its weight;
each register keeps its earliest shingle, and a shingle stops once its arrivals are later than every register's. Two texts
agree in a register with their probability Jaccard similarity; with all weights 1 that is the Jaccard similarity of their
shingle sets. Candidates are verified exactly: two texts are linked if the probability Jaccard similarity of the weighted
shingles, or the Jaccard similarity of the shingle sets, is 0.8 or more. So a text in which a shingle occurs twice has a
second signature of even weights; for others both are the same. BANDS bands of ROWS registers of each signature give a
text's buckets: at a similarity of 0.8, of either kind, a pair shares no bucket with a probability under 1e-5.

Equal texts are one node. Within a bucket every node is first held against one leader; then, in buckets that still hold
nodes of several components, nodes of unlike components against one another. Three tests, made as the bucket is joined,
leave few of those to verify. Two are exact bounds: shingles that no other of these nodes has can't be in common; and a
sketch of parities (each shingle flips one of PARITY bits) can't differ in more bits than the sets do in shingles. The third
is the registers' own estimate, as far below the wanted similarity as links are with a probability under 1e-5. What is left
are pairs within a hair of the wanted similarity. Pairs inside a component are never made, as they add nothing to the
classes: so a bucket of copies costs as many pairs as it has nodes, and no link is lost but with the probabilities named.

Cases: null and empty texts, and texts without words, are like nothing, and each row is its own class; the class of others
is the least doc_id in it (null if all are null); repeated rows are in one class; empty tables give no rows; other columns,
whatever their names, pass through keep_one and are ignored by classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, dropped, map_rows, slices, written
from .quality import _MIX, Laid, _mix, laid

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Registers of a signature: the bands use the first of them, estimates all.
REGISTERS = 400
#: Bits of each register that are kept for estimates. At a similarity of 0.8, or at the wanted one, fewer registers than the mean less NEVER standard deviations agree with a probability under 1e-5.
PLANES, NEVER = 4, 4.4
#: Bits of a parity sketch.
PARITY = 2048
#: Arrivals drawn at once, about.
DRAW = 1 << 15
#: Rows, and bytes of text, of the documents for each task of the steps between: many tiny files cost more than they hold.
PART_ROWS, PART_BYTES = 5000, 1 << 24


def shingles(x: Laid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles, by text and hash."""
    n = np.bincount(x.word_doc, minlength=x.n)
    key, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(x.words) >= SHINGLE:
        m = len(x.words) - SHINGLE + 1
        full = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            full = _mix(full * np.uint64(0x9E3779B97F4A7C15) + x.words[k : k + m])
        at = np.flatnonzero(x.word_doc[:m] == x.word_doc[SHINGLE - 1 :])
        key, doc = full[at], x.word_doc[at]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        first = np.searchsorted(x.word_doc, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            more = n[few] > k
            short[more] = _mix(short[more] * np.uint64(0x9E3779B97F4A7C15) + x.words[first[more] + k] + np.uint64(1))
        key, doc = np.concatenate([key, short]), np.concatenate([doc, few])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n by registers: the shingle that arrived first at each register of each text; 0 for texts without shingles."""
    early = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    x, step = np.zeros(len(key)), np.uint64(1)
    while len(key):
        m = int(np.clip(DRAW // len(key), 1, 64))
        j = step + np.arange(m, dtype=np.uint64)
        draw = _mix(_mix(key[:, None] + j * np.uint64(0x9E3779B97F4A7C15)) + j)
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        when = x[:, None] + np.cumsum(-np.log(u), axis=1) / weight[:, None]
        at = (doc[:, None] * registers + ((draw * _MIX) >> np.uint64(33)).astype(np.int64) % registers).ravel()
        flat = when.ravel()
        better = flat < early[at]
        at, flat, who = at[better], flat[better], np.repeat(key, m)[better]
        np.minimum.at(early, at, flat)
        won = flat == early[at]
        owner[at[won]] = who[won]
        step += np.uint64(m)
        x = when[:, -1]
        live, place = np.unique(doc, return_inverse=True)
        last = early.reshape(n, registers)[live].max(axis=1)[place]
        go = x < last
        doc, key, weight, x = doc[go], key[go], weight[go], x[go]
    return owner.reshape(n, registers)


def buckets(sig: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number for each band of each text, by the band and the registers in it."""
    out = np.zeros((len(sig), count), np.uint64) + np.arange(count, dtype=np.uint64)
    for k in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows][:, :count])
    return out.view(np.int64)


def planes(sig: np.ndarray, bits: int = PLANES) -> np.ndarray:
    """The lowest bits of every register, bit by bit packed into words: registers agree where all their bits do."""
    words = -(-sig.shape[1] // 64)
    out = np.zeros((len(sig), bits, words), np.uint64)
    mixed = _mix(sig)
    for k in range(bits):
        bit = (mixed >> np.uint64(k)) & np.uint64(1)
        for w in range(words):
            part = bit[:, 64 * w : 64 * w + 64]
            out[:, k, w] = (part << np.arange(part.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out.reshape(len(sig), bits * words).view(np.int64)


def _agreeing(a: str, b: str, bits: int = PLANES, registers: int = REGISTERS) -> str:
    """How many registers of two columns of planes agree."""
    words = -(-registers // 64)
    return f"({registers} - aggregate(sequence(0, {words - 1}), 0, (s, i) -> s + bit_count({' | '.join(f'({a}[i + {k * words}] ^ {b}[i + {k * words}])' for k in range(bits))})))"


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> float:
    """The larger of set Jaccard and probability Jaccard of two (sorted hashes, counts); the second is only worked out where the first is under least."""
    (ka, ca), (kb, cb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    plain = len(common) / (len(ka) + len(kb) - len(common))
    if plain >= least or not len(common):
        return plain
    if ca.max() == 1 and cb.max() == 1:
        return plain  # with even weights both are the same
    return max(plain, probability_jaccard(weights(ca), weights(cb), ia, ib))


def probability_jaccard(wa: np.ndarray, wb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> float:
    """Sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i); ia, ib: places of the common ones."""
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    x, y = wa[ia], wb[ib]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    above = only_a + x.sum() - np.concatenate([[0.0], np.cumsum(x)])[np.searchsorted(ratio, ratio, "left")]
    below = only_b + np.concatenate([[0.0], np.cumsum(y)])[np.searchsorted(ratio, ratio, "left")]
    return float((1 / (above / x + below / y)).sum())


def parities(doc: np.ndarray, key: np.ndarray, n: int, bits: int = PARITY) -> np.ndarray:
    """n by bits / 64: each shingle of a text flips one bit of its sketch."""
    at = (_mix(key) >> np.uint64(40)).astype(np.int64) % bits
    odd = (np.bincount(doc * bits + at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view("<i8")


def marks(x: Laid) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray | None]]:
    """Of each text: whether it has words, its buckets, its planes, and the planes of even weights where they aren't the same."""
    doc, key, count = shingles(x)
    sig = signatures(doc, key, weights(count), x.n)
    found, bits = list(buckets(sig)), list(planes(sig))
    even: list[np.ndarray | None] = [None] * x.n
    if len(multi := np.unique(doc[count > 1])):
        own = np.isin(doc, multi)
        sig = signatures(np.searchsorted(multi, doc[own]), key[own], np.ones(own.sum()), len(multi))
        for i, b, p in zip(multi, buckets(sig), planes(sig), strict=True):
            found[i], even[i] = np.unique(np.concatenate([found[i], b])), p
    return np.bincount(x.word_doc, minlength=x.n) > 0, found, bits, even


def _nodes(df: DataFrame) -> DataFrame:
    """doc_id, node (md5 of the text; null for texts without words), bytes of the text, its buckets, planes and, if they are others, planes of even weights."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"node": [], "size": [], "buckets": [], "planes": [], "even": []}
            for _, raws, x in laid(batch.column(1).to_pylist()):
                has, *rest = marks(x)
                out["size"] += [len(r) for r in raws]
                out["node"] += [hashlib.md5(r).digest() if h else None for r, h in zip(raws, has, strict=True)]
                for name, found in zip(("buckets", "planes", "even"), rest, strict=True):
                    out[name] += [f if h else None for f, h in zip(found, has, strict=True)]
            return {"doc_id": batch.column(0), **out}

        return each

    return map_rows(df, make, "doc_id long, node binary, size long, buckets array<long>, planes array<long>, even array<long>")


def _parts(nodes: DataFrame) -> int:
    """How many tasks the steps between are dealt to at most: as many as the documents' rows and bytes ask for, all cores at least."""
    rows, size = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(nodes.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS), -(-size // PART_BYTES))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs a, b of nodes that are similar. texts: node and text, one row a node."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text = dict(zip(a, batch.column(2).to_pylist(), strict=True)) | dict(zip(b, batch.column(3).to_pylist(), strict=True))
            known, names = {}, list(text)
            for first, raws, x in laid(list(text.values())):
                doc, key, count = shingles(x)
                edge = np.searchsorted(doc, np.arange(len(raws) + 1))
                for i in range(len(raws)):
                    known[names[first + i]] = key[edge[i] : edge[i + 1]], count[edge[i] : edge[i + 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array([similar(known[p], known[q], least) >= least for p, q in zip(a, b, strict=True)]))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """node and label, the least node of its component, of every node in links (a, b). Labels spread over links and jump to their labels' labels until none changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), parts)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), parts)
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("label").alias("over"))
        new = written(near.join(jump, "l", "left").select("node", F.least("l", F.coalesce("over", "l")).alias("label"), (F.least("l", F.coalesce("over", "l")) < F.col("label")).alias("moved")), parts)
        dropped(labels)
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            dropped(both)
            return labels


def _joined(labels: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """The labels after these further links: components of the labels that they hold together, not of all nodes again."""
    name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    merged = components(between, parts).select(F.col("node").alias("label"), F.col("label").alias("to"))
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return labels.union(alone).join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _profiles(nodes: DataFrame, texts: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """A frame, and the table that it reads: node, and of its shingles: n, their weights' sum w, whether one occurs twice (multi), their parities (odd), and u and v: how many, and of what weight, no other of these nodes has."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            keys, shares, multi, odd = [], [], [], []
            for _, raws, x in laid(batch.column(1).to_pylist()):
                doc, key, count = shingles(x)
                odd += list(parities(doc, key, x.n))
                edge = np.searchsorted(doc, np.arange(len(raws) + 1))
                for a, z in zip(edge, edge[1:], strict=False):
                    keys.append(key[a:z].view(np.int64))
                    shares.append(weights(count[a:z]))
                    multi.append(bool((count[a:z] > 1).any()))
            return {"node": batch.column(0), "keys": keys, "shares": shares, "multi": multi, "odd": odd}

        return each

    have = written(map_rows(texts.join(nodes, "node").select("node", "text"), make, "node binary, keys array<long>, shares array<double>, multi boolean, odd array<long>"), parts)
    each = have.select("node", F.explode(F.arrays_zip("keys", "shares")).alias("x")).select("node", F.col("x.keys").alias("key"), F.col("x.shares").alias("w"))
    own = each.groupBy("key").agg(F.count("*").alias("c"), F.first("node").alias("node"), F.first("w").alias("w")).where("c = 1").groupBy("node").agg(F.count("*").alias("u"), F.sum("w").alias("v"))
    sums = have.select("node", F.size("keys").cast("long").alias("n"), F.aggregate("shares", F.lit(0.0), lambda a, x: a + x).alias("w"), "multi", "odd")
    return sums.join(own, "node", "left").select("node", "n", "w", "multi", "odd", F.coalesce("u", F.lit(0)).cast("long").alias("u"), F.coalesce("v", F.lit(0.0)).alias("v")), have


def _possible(least: float) -> str:
    """Whether two profiles (n, u, w, v, multi of a and b) leave a similarity of least possible. A node's own shingles are in no other. With c the most that two sets can have in common, their Jaccard similarity is c / (na + nb - c) at most; a probability Jaccard similarity is no more than the share of common weight on either side, and is that of the sets where no shingle occurs twice."""
    c = "least(na - ua, nb - ub)"
    return f"({c} >= {least - 1e-9}D * (na + nb - {c}) or ((ma or mb) and least((wa - va) / wa, (wb - vb) / wb) >= {least - 1e-9}D))"


def _likely(least: float) -> str:
    """Whether the sketches of a and b leave it possible, the registers' estimate but for a probability under 1e-5. Sets differ in as many shingles as their parities in bits, at least: sets of na and nb that differ in d have a Jaccard similarity of (na + nb - d) / (na + nb + d). Of weighted shingles one side has d / 2 that the other has not, each of weight 1 or more."""
    agree = least + (1 - least) / (1 << PLANES)
    enough = REGISTERS * (agree - NEVER * (agree * (1 - agree) / REGISTERS) ** 0.5)
    differ = "aggregate(zip_with(oa, ob, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    sets, shares = f"(na + nb) * {(1 - least) / (1 + least) + 1e-9}D", f"2 * greatest(wa, wb) * {1 - least + 1e-9}D"
    agreeing = lambda a, b: f"{_agreeing(a, b)} >= {enough:.3f}D"
    # each costly term stands here once: Spark works repeated ones out ahead of the cheap tests
    return f"({differ} <= case when ma or mb then greatest({sets}, {shares}) else {sets} end and ({agreeing('ea', 'eb')} or ((ma or mb) and {agreeing('pa', 'pb')})))"


def links(df: DataFrame, nodes: DataFrame, parts: int, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links a, b between unlike texts that hold all classes together, and the labels of their nodes. nodes: doc_id, node, buckets, planes and even of df's rows; parts: how many tasks a step is dealt to at most."""
    spark = df.sparkSession
    worded = nodes.where("node is not null")
    places = worded.groupBy("node").agg(F.first("buckets").alias("buckets")).select("node", F.explode("buckets").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(places.join(sizes, "bucket"), parts)
    cleaned(spark)
    # a bucket's leader is the node with the most company in all its buckets: of copies, the one that most are like
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    met = shared.join(company, "node").select("bucket", "node", F.struct("company", "node").alias("rank"))
    leaders = met.groupBy("bucket").agg(F.max("rank").alias("m")).select("bucket", F.col("m.node").alias("leader"))
    members = written(shared.select("bucket", "node").join(leaders, "bucket"), parts)
    dropped(shared)
    # the texts of nodes with company, once each; the rest isn't moved again
    wanted = df.where("text is not null").select(F.expr("unhex(md5(cast(text as binary)))").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi")
    copies = written(wanted, parts)
    cleaned(spark)
    texts = written(copies.groupBy("node").agg(F.first("text").alias("text")), parts)
    dropped(copies)
    cleaned(spark)
    stars = written(members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), parts)
    first = written(_verified(stars, texts, least), parts)
    cleaned(spark)
    labels = components(first, parts)
    named = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    open_ = written(named.join(mixed, "bucket"), parts)
    if not open_.limit(1).count():
        return first, labels
    pairs = across(open_, worded, texts, parts, least)
    second = written(_verified(pairs.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), texts, least), parts)
    for x in (open_, pairs, stars, members, texts):
        dropped(x)
    cleaned(spark)
    if not second.limit(1).count():
        return first, labels
    return first.union(second), _joined(labels, second, parts)


def across(open_: DataFrame, nodes: DataFrame, texts: DataFrame, parts: int, least: float) -> DataFrame:
    """Pairs a < b of nodes of unlike labels in a bucket that may be linked. open_: bucket, node and label; nodes: node, buckets, planes and even."""
    profiles, held = _profiles(open_.select("node").distinct(), texts, parts)
    able = profiles.where(f"n - u >= {least - 1e-9}D * n or (multi and w - v >= {least - 1e-9}D * w)")
    signed = nodes.join(open_.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("buckets").alias("buckets"), F.first("planes").alias("planes"), F.first("even").alias("even"))
    known = written(open_.join(able.join(signed, "node"), "node").withColumn("even", F.coalesce("even", "planes")), parts)
    dropped(held)
    side = lambda x: known.select("bucket", F.col("node").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in ("label", "n", "u", "w", "v", "multi", "odd", "planes", "even")], F.col("buckets").alias(f"b{x}"))
    # of the buckets that a pair shares, the least makes it; work goes by pairs here, so that more tasks have it
    pairs = written(side("a").join(side("b"), "bucket").where(f"la <> lb and a < b and {_possible(least)} and {_likely(least)} and bucket = array_min(array_intersect(ba, bb))").select("a", "b"), 4 * parts)
    dropped(known)
    return pairs


def classes(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and node of every row."""
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    nodes = written(_nodes(df))
    parts = _parts(nodes)
    _, labels = links(df, nodes, parts, least)
    rows = nodes.select("doc_id", "node")
    least_id = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("m"))
    labelled = least_id.join(labels, "node", "left").select("node", "m", F.coalesce("label", "node").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("m").alias("class_id"))
    # written, so that the join below deals both of its sides itself and can split the node of a text that very many rows have
    member = written(labelled.join(ids, "label").select("node", "class_id"), parts)
    alone = rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), "node")
    return rows.where("node is not null").join(member, "node").select("doc_id", "class_id", "node").union(alone).coalesce(parts)


def keep_one(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of every class the row with the least doc_id, with all its columns; of rows with that id and alike texts, one. Of equal texts without words the row with the least doc_id stays, a null id after all others; rows whose text is null all stay."""
    kept = classes(documents, least).where("node is not null and doc_id <=> class_id").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")).groupBy("kept_id").agg(F.min("kept_node").alias("kept_node"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, F.col("doc_id").cast("long").alias("id"), F.expr("unhex(md5(cast(text as binary)))").alias("node"), F.col("text").rlike(r"[^ \t-\r]").alias("worded"))
    one = rows.where("worded").join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node")), "left_semi").dropDuplicates(["id", "node"])
    wordless = rows.where("not worded").groupBy("node").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row"))
    return one.select("row.*").union(wordless.select("row.*")).union(rows.where("worded is null").select("row.*"))
