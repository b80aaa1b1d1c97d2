"""Operator 8: removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

Every byte covered by a SPAN-byte string that also starts earlier (smaller doc_id, or same document and earlier) goes.

1. Anchors. Each window of SPAN bytes has an anchor, the leftmost of its KEY-byte strings with the least hash; equal windows
   have equal anchors at equal places in them. Consecutive windows mostly share theirs, so a text is dealt into runs of
   windows, one run an anchor. Anchors that occur once in the corpus hold no repeated window and go no further.
2. Snippets, the bytes of such runs, are collected by content: equal ones become one, at its first place; all windows of
   the others start later and go.
3. Unlike snippets of one anchor may still share windows. Anchors are dealt to buckets of bounded size. A bucket's snippets
   are split into shards; each shard's rotations are sorted by their first SPAN bytes and give its transform. The merge
   never sorts rotations again: an interleave of the shards' places is refined, each step one stable counting sort by the
   transform's preceding symbols, until the blocks that it separates are the intervals of rotations with SPAN bytes in
   common (the common prefixes). Only places that lead up to windows and still share their block are refined. In each
   interval the first place stays.
4. An anchor with more than LIMIT unlike snippets (a line that everybody has, among unlike neighbours) is dealt again by a
   longer key: half of what its windows still have left or right of it. Keys grow to whole windows, so this ends.

Cases: null text is the empty text; texts under SPAN bytes lose nothing; a null id comes after all others; rows with the
same id and text are one document and each gets its result, of one id with unlike texts the order is by a hash of the
text; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, dropped, map_rows, pick, written
from .quality import _mix, _powers

SPAN, KEY = 100, 32
#: Unlike snippets of one key that a bucket takes, and snippets of a bucket, about.
LIMIT, BUCKET = 200, 2000
#: Bytes of snippets in a shard, and of text that is laid out at once.
SHARD, CHUNK = 1 << 16, 1 << 19
#: Bits of a place among texts laid out together. Anchors go by the other bits of hashes, as many whatever is laid out, so that ties break alike everywhere.
PLACE = 32
_BASE = 0x5851F42D4C957F2D | 1


def runs(raws: list[bytes], span: int = SPAN, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Of texts laid out one after another: text, first window, windows, place of the anchor in the first window, and hash of the anchor, of each run."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    buffer = np.frombuffer(b"".join(raws), dtype=np.uint8)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(buffer) < span:
        return none
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _powers(len(buffer), _BASE), dtype=np.uint64)])
    n = len(buffer) - key + 1
    grams = _mix((total[key:] - total[:n]) * _powers(len(buffer), pow(_BASE, -1, 1 << 64))[:n])
    bits = np.uint64(PLACE)
    least = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)  # of equal hashes the leftmost
    width, have = span - key + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window that starts at each place
    doc = np.repeat(np.arange(len(raws)), sizes)
    inside = doc[: len(anchor)] == doc[span - 1 :]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    if not len(start):
        return none
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    own = doc[start]
    return own, start - first[own], stops - start + 1, anchor[start] - start, grams[anchor[start]]


def _chunks(texts: list[bytes]):
    begin, size = 0, 0
    for i, r in enumerate(texts):
        size += len(r)
        if size >= CHUNK or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def sort_shard(codes: np.ndarray, follow: np.ndarray, depth: int) -> np.ndarray:
    """Order of a shard's rotations by their first depth symbols (bytes) or more, by rank doubling. follow: the place after each in its snippet, around its end."""
    rank, ahead, have = codes.astype(np.uint16) << np.uint16(8) | codes[follow], follow[follow], 2
    order = np.argsort(rank, kind="stable")
    while have < depth:
        second = rank[ahead]
        order = np.argsort(second, kind="stable")
        order = order[np.argsort(rank[order], kind="stable")]  # counting sorts, as long as ranks fit 16 bits
        a, b = rank[order], second[order]
        edge = np.zeros(len(order), bool)
        edge[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        dense = np.cumsum(edge, dtype=np.int32)
        distinct = int(dense[-1]) + 1 if len(dense) else 0
        rank = np.empty(len(order), np.uint16 if distinct <= 1 << 16 else np.int32)
        rank[order] = dense
        ahead = ahead[ahead]
        have *= 2
        if distinct == len(rank):
            break
    return order


def merge_shards(bwts: list[np.ndarray], rounds: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rotations at the asked places (in the shards' orders, one after another): place and block, in the merged order, of those in blocks of two or more after refinement by that many symbols. bwts: the symbol before each rotation, in the shard's order."""
    before, at = np.concatenate(bwts), np.cumsum([0, *map(len, bwts)])
    # where the rotation behind the symbol before each stands in its shard's order, and the way back
    behind = np.concatenate([a + np.argsort(b, kind="stable") for a, b in zip(at, bwts, strict=False)]).astype(np.int32)
    ahead = np.empty_like(behind)
    ahead[behind] = np.arange(len(behind), dtype=np.int32)
    place = asked
    for _ in range(rounds):
        place = behind[place]
    # the interleave of those that lead up to the asked ones; one that is alone in its block stays so, and needs no more refinement
    place = np.sort(place)
    block = np.zeros(len(place), np.int32)
    for _ in range(rounds):
        symbols = before[place]
        moved = np.argsort(symbols, kind="stable")
        s, b = symbols[moved], block[moved]
        edge = np.ones(len(moved) + 1, bool)
        edge[1:-1] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        many = np.flatnonzero(~(edge[:-1] & edge[1:]))
        place, block = ahead[place[moved[many]]], np.cumsum(edge[:-1], dtype=np.int32)[many]
    return place, block


def repeated(snippets: list[bytes], windows: np.ndarray, span: int = SPAN, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Snippet, window and interval of the windows that lie in intervals of two or more: windows[i] windows of span bytes start at the first bytes of snippet i."""
    sizes = np.array([len(s) + 1 for s in snippets], dtype=np.int64)
    codes = np.frombuffer(b"".join(s + b"\xff" for s in snippets), dtype=np.uint8)  # no UTF-8 text has this byte
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    who = np.repeat(np.arange(len(snippets)), sizes)
    last = first + sizes - 1
    around = np.arange(len(codes)) - first[who]
    after = np.arange(1, len(codes) + 1)
    after[last] = first
    ago = np.arange(-1, len(codes) - 1)  # the place before each in its snippet, around its start
    ago[first] = last
    step, symbol = 1, codes.astype(np.uint16)
    if span % 2 == 0:  # several bytes at a time, as long as their codes fit a counting sort
        step, symbol = 2, symbol[ago] << np.uint16(8) | symbol
        if span % 4 == 0 and len(codes) < 1 << 16:
            four = symbol.astype(np.uint32)[ago[ago]] << np.uint32(16) | symbol
            step, symbol = 4, np.unique(four, return_inverse=True)[1].astype(np.uint16)
    # symbol[i] codes the step bytes that end at i; the symbol before a rotation ends just in front of it
    before = symbol[ago]
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], first // shard]))) if len(first) else np.zeros(0, np.int64)
    edges = np.append(first[cuts], len(codes))
    orders = [a + sort_shard(codes[a:z], after[a:z] - a, span) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    order = np.concatenate(orders)
    place, block = merge_shards([before[o] for o in orders], span // step, np.flatnonzero(around[order] < windows[who[order]]))
    return who[order[place]], around[order[place]], block


_ROW = "doc_id long, t long, start long, windows int, at int, width int, key long, snippet binary"


def _raws(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [(t or "").encode() for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _anchors(df: DataFrame, span: int, key: int) -> DataFrame:
    """doc_id, node, and keys (hashes) and starts of the text's runs."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            parts = [(len(part), *runs(part, span, key)) for _, part in _chunks(_raws(batch))]
            count = np.concatenate([np.bincount(p[1], minlength=p[0]) for p in parts])
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            return {"doc_id": batch.column(0), "node": batch.column(1), "keys": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[5] for p in parts]).view(np.int64))), "starts": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[2] for p in parts]).astype(np.int32)))}

        return each

    return map_rows(df.select("doc_id", "node", "text"), make, "doc_id long, node binary, keys array<long>, starts array<int>")


def _snippets(df: DataFrame, span: int, key: int) -> DataFrame:
    """The runs of df's texts whose starts are listed in starts."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("row", "start", "windows", "at", "key", "snippet")}
            raws, listed = _raws(batch), batch.column(3).to_pylist()
            for begin, part in _chunks(raws):
                doc, start, windows, at, keys = runs(part, span, key)
                edge = np.searchsorted(doc, np.arange(len(part) + 1))
                for i, raw in enumerate(part):
                    a, z = edge[i], edge[i + 1]
                    mine = a + np.flatnonzero(np.isin(start[a:z], listed[begin + i]))
                    out["row"].append(np.full(len(mine), begin + i))
                    for name, of in (("start", start), ("windows", windows), ("at", at), ("key", keys.view(np.int64))):
                        out[name].append(of[mine])
                    out["snippet"] += [raw[s : s + w + span - 1] for s, w in zip(start[mine].tolist(), windows[mine].tolist(), strict=True)]
            joined = {k: np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("row", "start", "windows", "at", "key")}
            row = pa.array(joined.pop("row"))
            return {"doc_id": batch.column(0).take(row), "t": batch.column(1).take(row), **joined, "width": np.full(len(row), key), "snippet": out["snippet"]}

        return each

    return map_rows(df.select("doc_id", "t", "text", "starts"), make, _ROW)


def _longer(df: DataFrame, span: int) -> DataFrame:
    """Runs dealt again by keys that take in half of what is left of a window, to the left or to the right."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("row", "start", "windows", "at", "width", "key", "snippet")}
            rows = zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5, 7)], strict=True)
            for r, (start, windows, at, width, snippet) in enumerate(rows):
                more = (span - width + 1) // 2
                cut = at - more  # the last window with enough on the left
                for a, z, place in ((0, min(cut, windows - 1), at - more), (max(0, cut + 1), windows - 1, at)):
                    if a <= z:
                        for name, value in (("row", r), ("start", start + a), ("windows", z - a + 1), ("at", place - a), ("width", width + more), ("snippet", snippet[a : z + span])):
                            out[name].append(value)
                        out["key"].append(int.from_bytes(hashlib.md5(snippet[place : place + width + more]).digest()[:8], "little", signed=True) ^ (place == at))
            row = pa.array(out.pop("row"), pa.int64())
            return {"doc_id": batch.column(0).take(row), "t": batch.column(1).take(row), **out}

        return each

    return map_rows(df, make, _ROW)


def _within(df: DataFrame, span: int) -> DataFrame:
    """Byte ranges (doc_id, t, a, z) that go, of the snippets of each bucket: windows whose interval holds an earlier one."""

    def run(group: pa.Table) -> pa.Table:
        ids, ts, starts, windows = (group.column(k).to_pylist() for k in ("doc_id", "t", "start", "windows"))
        who, at, block = repeated(group.column("snippet").to_pylist(), np.array(windows), span)
        keys = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], ts[i]) if ids[i] is not None else (True, 0, ts[i]))
        rank, last = np.zeros(len(ids), np.int64), None
        n = -1
        for i in keys:
            if (ids[i], ts[i]) != last:
                n, last = n + 1, (ids[i], ts[i])
            rank[i] = n
        where = np.array(starts)[who] + at
        order = np.lexsort((where, rank[who], block))
        who, where, block = who[order], where[order], block[order]
        late = np.ones(len(block), bool)
        late[:1] = False
        late[1:] = block[1:] == block[:-1]
        if len(late) > 1:  # the same window of one document, listed twice, is one
            head = np.flatnonzero(~late)
            origin = head[np.searchsorted(head, np.arange(len(late)), "right") - 1] if len(head) else np.zeros(len(late), np.int64)
            late &= (rank[who] != rank[who[origin]]) | (where != where[origin])
        who, where = who[late], where[late]
        order = np.lexsort((where, rank[who]))
        who, where = who[order], where[order]
        new = np.ones(len(who), bool)
        new[1:] = (rank[who[1:]] != rank[who[:-1]]) | (where[1:] > where[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(who)) - 1 if len(head) else head
        return pa.table({"doc_id": pa.array([ids[i] for i in who[head]], pa.int64()), "t": pa.array([ts[i] for i in who[head]], pa.int64()), "a": pa.array(where[head], pa.int64()), "z": pa.array(where[tail] + span if len(head) else where[tail], pa.int64())})

    return df.groupBy("bucket").applyInArrow(run, "doc_id long, t long, a long, z long")


def ranges(df: DataFrame, span: int = SPAN, key: int = KEY) -> DataFrame:
    """doc_id, t, a, z: byte ranges that go; they may overlap. df: doc_id, t (hash of the text) and text."""
    spark = df.sparkSession
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    own = df.withColumn("node", F.expr("unhex(md5(cast(text as binary)))"))
    # equal texts are one, at the least doc_id; the others go whole
    texts = written(_anchors(own, span, key).groupBy("node").agg(F.min(place).alias("rep"), F.first("keys").alias("keys"), F.first("starts").alias("starts")).select("node", "rep", "keys", "starts"))
    cleaned(spark)
    first = texts.select("node", "rep")
    copies = own.select("doc_id", "t", "node", F.octet_length("text").cast("long").alias("z")).where(F.col("z") >= span).join(first, "node").where(place != F.col("rep")).select("doc_id", "t", F.lit(0).cast("long").alias("a"), "z")
    found = written(copies)
    anchors = texts.select(F.col("rep.doc_id").alias("doc_id"), F.explode(F.arrays_zip("keys", "starts")).alias("x")).select("doc_id", F.col("x.starts").alias("start"), F.col("x.keys").alias("key"))
    # written, so that the join deals both of its sides itself and can split an anchor that very many texts have
    twice = written(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    cleaned(spark)
    listed = written(anchors.join(twice, "key").groupBy("doc_id").agg(F.collect_set("start").alias("starts")))
    dropped(texts)
    cleaned(spark)
    mine = listed.select(F.col("doc_id").alias("d"), "starts")
    rows = _snippets(df.join(mine, df["doc_id"].eqNullSafe(mine["d"])), span, key)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "start")
    while True:
        named = written(rows.withColumn("name", F.xxhash64("snippet", "at")))
        cleaned(spark)
        light = named.select("doc_id", "t", "start", "windows", "key", "name")
        alike = written(light.groupBy("key", "name").agg(F.min(place).alias("p"), F.count("*").alias("n")))
        sized = written(alike.groupBy("key").agg(F.count("*").alias("unlike")))
        kept = written(alike.join(sized, "key").where("n > 1 or unlike > 1"))
        dropped(alike)
        cleaned(spark)
        late = light.join(kept.where("n > 1").select("key", "name", "p"), ["key", "name"]).where(place != F.col("p")).select("doc_id", "t", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (span - 1)).alias("z"))
        gone = written(late)
        several = kept.where("unlike > 1").select(F.col("p.doc_id").alias("d"), F.col("p.t").alias("u"), F.col("p.start").alias("s"), "unlike")
        many = several.count()
        if not many:
            return found.unionByName(gone)
        one = written(named.join(several, named["doc_id"].eqNullSafe(several["d"]) & (named["t"] == several["u"]) & (named["start"] == several["s"])).drop("d", "u", "s", "name"))
        dropped(named)
        cleaned(spark)
        buckets = max(64, -(-many // BUCKET))
        dealt = one.where(F.col("unlike") <= LIMIT).select("doc_id", "t", "start", "windows", "snippet", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        found = found.unionByName(gone).unionByName(written(_within(dealt, span)))
        cleaned(spark)
        hot = one.where(F.col("unlike") > LIMIT)
        if not hot.limit(1).count():
            return found
        rows = _longer(hot.select(*[c.split()[0] for c in _ROW.split(", ")]), span)


def dedup_strings(df: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, spans (first and last byte, end exclusive, of the maximal runs that go) and kept (the remaining bytes) of every row."""
    own = pick(df, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("t", F.xxhash64("text"))
    gone = ranges(own, span).groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_list(F.struct("a", "z")).alias("cuts"))
    both = own.join(gone, own["doc_id"].eqNullSafe(gone["d"]) & (own["t"] == gone["u"]), "left").select("doc_id", "text", "cuts")

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            spans, kept, sizes = [], [], []
            for raw, cuts in zip(_raws(batch), batch.column(2).to_pylist(), strict=True):
                own, rest, at = [], [], 0
                for a, z in sorted((c["a"], c["z"]) for c in cuts or ()):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], z)
                    else:
                        own.append([a, z])
                for a, z in own:
                    rest.append(raw[at:a])
                    at = z
                rest.append(raw[at:])
                sizes.append(len(raw))
                spans.append([{"a": a, "z": z} for a, z in own])
                kept.append(b"".join(rest))
            return {"doc_id": batch.column(0), "n_bytes": sizes, "spans": spans, "kept": kept}

        return each

    return map_rows(both, make, "doc_id long, n_bytes long, spans array<struct<a:long,z:long>>, kept binary")
