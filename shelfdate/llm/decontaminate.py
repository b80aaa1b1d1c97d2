"""Operator 7: benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

Words are runs of anything but ASCII white space, in lower case; shingles are five words (of an item with fewer, all of
them). A window has as many words as the items that it is held against, or all of a shorter text; items of one size share
its windows. Each window and each item gets a 64-bit SimHash over its weighted shingles. A multi-index over the fingerprints
of all items finds them: fingerprints are cut into BLOCKS blocks, and of two within the radius one block at least differs in
no more than radius / BLOCKS bits; so every item stands in the index under all such neighbours of each of its blocks, and a
window that looks its own blocks up meets every item of its size within the radius. What the index finds is verified by the
exact weighted Jaccard similarity of the shingles, sum of the smaller counts over sum of the larger.

Not every window is laid, only those that can hold enough. A window needs, for the wanted similarity to an item of s
shingles, a number of shingles that any item of its size has; a text with fewer of them anywhere within such a window is
left out. A window that begins with another shingle loses nothing by beginning later, up to one of these or the text's last
window. So windows begin at each of these shingles that enough others follow, in whatever order, and at the last place, and
none that isn't laid is more similar to any item than the best of those that are.

Cases: null and empty texts hold nothing; items without a word are ignored; rows with the same id and text are one text
and share its result, as do repeated items; empty tables give no rows; other columns, whatever their names, pass through
drop_leaks and are ignored by find_leaks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Blocks of the fingerprint, of 64 / BLOCKS bits each.
BLOCKS = 8
#: Rows up to which shingles of items, or names of texts, are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _small(df: DataFrame) -> DataFrame:
    """df, sent to every executor if its rows allow that. df must be cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hashes(text: str) -> str:
    return rf"transform(array_remove(split(lower({text}), '[ \\t-\\r]+'), ''), x -> xxhash64(x))"


def _shingles(words: str, k: int) -> str:
    """Hashes of all runs of k entries of an array of word hashes."""
    return f"case when size({words}) >= {k} then transform(sequence(0, size({words}) - {k}), i -> xxhash64({', '.join(f'get({words}, i + {j})' for j in range(k))})) else cast(array() as array<bigint>) end"


def _any_shingles():
    return F.coalesce(*[F.when(F.col("k") == k, F.expr(_shingles("w", k))) for k in range(1, SHINGLE + 1)])


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, it (the text's hash), n (words), k (words of a shingle), s (shingles) and sh: their hashes in order."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).dropDuplicates().where("text is not null").withColumn("w", F.expr(_hashes("text")))
    sized = words.where("size(w) > 0").withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    return sized.select("item_id", F.xxhash64("text").alias("it"), "n", "k", (F.col("n") - F.col("k") + 1).alias("s"), _any_shingles().alias("sh"))


def _bits() -> list:
    """One vote for each bit of the fingerprint: weight if the bit is set, else its negative."""
    return [F.sum(F.expr(f"case when (shiftrightunsigned(h, {b}) & 1) = 1 then c else -c end")).alias(f"v{b}") for b in range(64)]


def _fingerprint():
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(F.col(f"v{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out


def _block(f: str, b: str) -> str:
    width = 64 // BLOCKS
    return f"shiftrightunsigned({f}, {width} * {b}) & {(1 << width) - 1}"


def _flips(radius: int) -> list[int]:
    """Patterns of the bits in which a block may differ."""
    return [sum(1 << i for i in some) for n in range(radius // BLOCKS + 1) for some in combinations(range(64 // BLOCKS), n)]


def _meeting(radius: int) -> str:
    """The first block in which fingerprints f and fi differ in few enough bits."""
    return "case " + " ".join(f"when bit_count({_block('(f ^ fi)', str(b))}) <= {radius // BLOCKS} then {b}" for b in range(BLOCKS)) + " end"


#: Places p from which a window of sw shingles holds need of them, and the text's last window if it does.
_DENSE = "transform(array(array_sort(places)), p -> concat(transform(filter(sequence(0, size(p) - 1), i -> get(p, i + need - 1) < get(p, i) + sw), i -> get(p, i)), case when get(p, size(p) - need) >= words - n then array(greatest(words - n, 0)) else cast(array() as array<int>) end))[0]"


def windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """doc_id, _t, n, k and start of the windows laid. docs: doc_id, _t and text."""
    kinds = sorted(r.k for r in items.select("k").distinct().collect())  # SHINGLE at most
    own = _small(items.select("n", "k", "s", F.explode("sh").alias("h")).distinct())
    all_ = ", ".join(f"transform({_shingles('w', k)}, (h, i) -> named_struct('k', {k}, 'pos', i, 'h', h))" for k in kinds or [SHINGLE])
    places = docs.withColumn("w", F.expr(_hashes("text"))).select("doc_id", "_t", F.size("w").alias("words"), F.explode(F.expr(f"concat({all_})")).alias("x")).select("doc_id", "_t", "words", "x.*")
    # of an item with s shingles and a window with sw, fewer where the text is shorter than the item, a similarity x needs x (s + sw) / (1 + x) in common
    need = F.ceil((F.col("s") + F.col("sw")) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    dense = places.join(own, ["k", "h"]).groupBy("doc_id", "_t", "words", "n", "k", "s").agg(F.collect_set("pos").alias("places")).withColumn("sw", F.least("s", F.col("words") - F.col("k") + 1)).withColumn("need", need).where("size(places) >= need")
    # a window that would run past the end moves back to it
    starts = dense.select("doc_id", "_t", "words", "n", "k", F.expr(_DENSE).alias("starts"))
    return starts.select("doc_id", "_t", "n", "k", F.explode(F.expr("array_distinct(transform(starts, x -> greatest(0, least(x, words - n))))")).alias("start"))


_WINDOW = ["doc_id", "_t", "n", "k", "start"]


def _weights(laid: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """The columns of laid (windows), and h and c: its shingles and their counts. texts: doc_id, _t and w."""
    name = texts.select(F.col("doc_id").alias("d"), F.col("_t").alias("t"), F.col("w").alias("all"))
    cut = laid.join(name, laid["doc_id"].eqNullSafe(name["d"]) & (laid["_t"] == name["t"])).withColumn("w", F.expr("slice(all, start + 1, n)"))
    return cut.select(*_WINDOW, *more, F.explode(_any_shingles()).alias("h")).groupBy(*_WINDOW, *more, "h").agg(F.count("*").alias("c"))


def find_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (word of the best window), distance (of fingerprints) and similarity of every text and item that match; _t tells texts of one id apart."""
    items = _items(benchmark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text is not null").withColumn("_t", F.xxhash64("text"))
    laid = written(windows(docs, items, similarity))
    names = written(laid.select(F.col("doc_id").alias("d"), F.col("_t").alias("t")).distinct())
    few = _small(names)
    # only texts with a window move
    texts = written(docs.join(few, docs["doc_id"].eqNullSafe(few["d"]) & (docs["_t"] == few["t"]), "left_semi").groupBy("doc_id", "_t").agg(F.first("text").alias("text")).select("doc_id", "_t", F.expr(_hashes("text")).alias("w")))
    dropped(names)
    prints = _weights(laid, texts).groupBy(*_WINDOW).agg(*_bits(), F.sum("c").alias("size")).select(*_WINDOW, "size", _fingerprint().alias("f"))
    item_weights = items.select("item_id", "it", "n", "s", F.explode("sh").alias("h")).groupBy("item_id", "it", "n", "s", "h").agg(F.count("*").alias("c"))
    stamped = item_weights.groupBy("item_id", "it", "n", "s").agg(*_bits()).select("item_id", "it", "n", "s", _fingerprint().alias("fi"))
    blocks = F.expr(f"sequence(0, {BLOCKS - 1})")
    flips = F.array(*[F.lit(m) for m in _flips(radius)])
    index = stamped.withColumn("b", F.explode(blocks)).withColumn("flip", F.explode(flips)).select("item_id", "it", "n", "s", "fi", "b", F.expr(f"({_block('fi', 'b')}) ^ flip").alias("v"))
    probes = prints.withColumn("b", F.explode(blocks)).withColumn("v", F.expr(_block("f", "b")))
    near = written(probes.join(index, ["n", "b", "v"]).where(f"bit_count(f ^ fi) <= {radius} and b = {_meeting(radius)}").select(*_WINDOW, "size", "item_id", "it", "s", F.expr("bit_count(f ^ fi)").alias("distance")))
    grams = _weights(near, texts, "size", "item_id", "it", "s", "distance")
    both = grams.join(item_weights.select("item_id", "it", "h", F.col("c").alias("ci")), ["item_id", "it", "h"])
    alike = both.groupBy(*_WINDOW, "size", "item_id", "it", "s", "distance").agg(F.sum(F.least("c", "ci")).alias("common")).withColumn("similarity", F.col("common") / (F.col("s") + F.col("size") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", -F.col("start"), -F.col("distance")))
    found = written(alike.groupBy("doc_id", "_t", "item_id").agg(best.alias("m")).select("doc_id", "_t", "item_id", (-F.col("m.col2")).cast("long").alias("start"), (-F.col("m.col3")).cast("long").alias("distance"), F.col("m.similarity").alias("similarity")))
    for x in (laid, texts, near):
        dropped(x)
    return found


def drop_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of documents, with all their columns, whose text holds no item."""
    bad = find_leaks(documents, benchmark, similarity, radius).select(F.col("doc_id").alias("bad_id"), F.col("_t").alias("bad_text")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("t") == F.col("bad_text")), "left_anti").select("row.*")
