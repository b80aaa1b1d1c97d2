"""Operator 10: line dedup by content-defined chunks of lines. DataFrame functions only.

Each line is hashed; a rolling (cyclic polynomial) hash runs over the line hashes, and a chunk ends after a line whose
rolling hash is a strict local minimum. A boundary depends on the lines around it alone, so that inserted lines shift
nothing but their own chunk, and no chunk but a text's last has fewer than two lines. Chunks of two or more lines with a
word in them that occur more than once, in any texts, keep their first occurrence (smallest doc_id, then place); the others
go. Two hashes of a chunk find those that may be alike; each is then compared byte by byte with the first place that has
its hashes, and stays if its bytes differ.

A chunk's ends depend on lines beside a passage, so that chunks alone miss short passages and the ends of long ones.
dedup_passages and passage_digests, which the query and the pipeline use, therefore also look at every pair: a line with a
word in it up to the next such line, blank lines between them included. What a chunk or a pair has of an earlier place goes.
So every passage of two or more worded lines loses its later occurrences whole, whatever stands beside it. Each line that
goes has an equal line that stays: the first of all equal lines is in no chunk or pair that is found earlier.

Cases: null and empty texts have nothing to remove and stay as they are; a null id comes after all others; rows with the
same id and text are one text, and each gets that text's result; empty tables give no rows; other columns, whatever
their names, pass through dedup_lines and dedup_passages and are ignored by the digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, written

WINDOW = 2


def _rolled(window: int) -> str:
    """Cyclic polynomial hash of this line's hash and those before it."""
    turn = lambda k: f"(shiftleft(coalesce(get(_h, i - {k}), 0), {k}) | shiftrightunsigned(coalesce(get(_h, i - {k}), 0), {64 - k}))"
    return " ^ ".join(["x", *(turn(k) for k in range(1, window))])


def with_chunks(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """df and _chunks: array of (first line, lines, text)."""
    return (
        df.withColumn("_l", F.expr(r"split(text, '\n', -1)"))
        .withColumn("_h", F.expr("transform(_l, x -> xxhash64(x))"))
        .withColumn("_r", F.expr(f"transform(_h, (x, i) -> {_rolled(window)})"))
        .withColumn("_e", F.expr("filter(sequence(0, size(_l) - 1), i -> i = size(_l) - 1 or (i > 0 and get(_r, i) < get(_r, i - 1) and get(_r, i) < get(_r, i + 1)))"))
        .withColumn("_chunks", F.expr("transform(_e, (e, k) -> named_struct('at', coalesce(get(_e, k - 1) + 1, 0), 'n', e - coalesce(get(_e, k - 1), -1), 'text', array_join(slice(_l, coalesce(get(_e, k - 1) + 2, 1), e - coalesce(get(_e, k - 1), -1)), '\n')))"))
        .drop("_l", "_h", "_r", "_e")
    )


_KEY = ("_id", "_t")


def _keyed(df: DataFrame) -> DataFrame:
    """A text is known by its id and a hash of its bytes."""
    return df.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_t", F.xxhash64("text"))


#: Lines of a text, known as l in what follows: bound by a lambda, as Catalyst would put the split into every use of a column.
_LINES = r"transform(array(split(text, '\n', -1)), l -> {})[0]"


def _pairs() -> str:
    """Array of (first line, lines, text) of each line with a word in it up to the next such line."""
    worded = r"filter(sequence(0, size(l) - 1), i -> get(l, i) rlike '[^ \\t-\\r]')"
    pair = r"named_struct('at', a, 'n', get(w, k + 1) - a + 1, 'text', array_join(slice(l, a + 1, get(w, k + 1) - a + 1), '\n'))"
    return _LINES.format(f"transform(array({worded}), w -> transform(slice(w, 1, greatest(size(w) - 1, 0)), (a, k) -> {pair}))[0]")


def repeats(df: DataFrame, window: int = WINDOW, pairs: bool = True) -> DataFrame:
    """_id, _t and _gone: (first line, lines, text of the first place) of the chunks, and if asked for the pairs, of that text whose hashes an earlier place has. Only hashes are dealt by chunk; the texts that come along are those of first places of what repeats."""
    own = _keyed(df.select(F.col("doc_id"), F.col("text"))).where("text is not null")
    chunks = r"filter(_chunks, c -> c.n > 1 and c.text rlike '[^ \\t-\\r]')"
    marks = (
        with_chunks(own, window)
        .select(*_KEY, F.explode(F.expr(f"concat({chunks}, {_pairs()})" if pairs else chunks)).alias("c"))
        .select(*_KEY, F.col("c.at").alias("_at"), F.col("c.n").alias("_n"), F.xxhash64("c.text").alias("_a"), F.xxhash64(F.lit("second"), "c.text").alias("_b"))
    )
    place = F.struct(F.col("_id").isNull(), "_id", "_t", "_at", "_n")
    often = marks.groupBy("_a", "_b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    # the text of every first place, taken from its document
    asked = often.groupBy(F.col("first._id").alias("_fid"), F.col("first._t").alias("_ft")).agg(F.collect_list(F.struct("_a", "_b", "first")).alias("_asked"))
    told = own.join(asked, own["_id"].eqNullSafe(asked["_fid"]) & (own["_t"] == asked["_ft"]))
    texts = told.select(F.explode(F.expr(_LINES.format(r"transform(_asked, q -> named_struct('_a', q._a, '_b', q._b, 'first', q.first, '_text', array_join(slice(l, q.first._at + 1, q.first._n), '\n')))"))).alias("q")).select("q.*")
    # written, so that the join below deals both of its sides itself and can split a piece that very many texts have
    known = written(texts.dropDuplicates(["_a", "_b"]))
    cleaned(df.sparkSession, 2)  # its shuffles would lie beside those of the query that is made here
    return marks.join(known, ["_a", "_b"]).where(place != F.col("first")).groupBy(*_KEY).agg(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_n").alias("n"), F.col("_text").alias("text"))).alias("_gone"))


def _rid(df: DataFrame, window: int, pairs: bool) -> DataFrame:
    """row (df's columns), _kept, the text that stays, _lines and _gone_lines."""
    gone = repeats(df, window, pairs).withColumnRenamed("_id", "_gid").withColumnRenamed("_t", "_gt")
    rows = _keyed(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id"), F.col("text"))).drop("doc_id", "text")
    # the text goes through the join once, within row
    joined = rows.join(gone, rows["_id"].eqNullSafe(gone["_gid"]) & (rows["_t"] == gone["_gt"]), "left").select("row", F.col("row.text").alias("text"), "_gone")
    return (
        joined.withColumn("_stay", F.expr(_LINES.format(r"array_except(sequence(0, size(l) - 1), flatten(transform(filter(_gone, g -> array_join(slice(l, g.at + 1, g.n), '\n') = g.text), g -> sequence(g.at, g.at + g.n - 1))))")))
        .withColumn("_kept", F.expr("case when _gone is null then text else " + _LINES.format(r"array_join(transform(_stay, i -> get(l, i)), '\n')") + " end"))
        .withColumn("_lines", F.expr(r"case when text is null then 0L else cast(size(split(text, '\n', -1)) as long) end"))
        .withColumn("_gone_lines", F.expr("case when _gone is null then 0L else _lines - size(_stay) end"))
        .drop("_stay", "_gone", "text")
    )


def _with_text(df: DataFrame, window: int, pairs: bool) -> DataFrame:
    """df with what stays as its text; n_chars, if there, follows."""
    own = {c: F.col("row").getField(c) for c in df.columns} | {"text": F.col("_kept")}
    if "n_chars" in df.columns:
        own["n_chars"] = F.when(F.col("_gone_lines") > 0, F.length("_kept")).otherwise(own["n_chars"]).cast(df.schema["n_chars"].dataType)
    return _rid(df, window, pairs).select(*[own[c].alias(c) for c in df.columns])


def _digests(df: DataFrame, window: int, pairs: bool) -> DataFrame:
    kept = F.coalesce("_kept", F.lit(""))
    rid = _rid(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), window, pairs)
    return rid.select("row.doc_id", F.col("_lines").alias("n_lines"), F.col("_gone_lines").alias("n_removed"), F.length(kept).cast("long").alias("n_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def dedup_lines(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """df, its repeated chunks of lines removed from text; n_chars, if there, follows."""
    return _with_text(df, window, False)


def line_digests(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and kept_sha256 of what stays of each text."""
    return _digests(df, window, False)


def dedup_passages(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """As dedup_lines, with repeated pairs of lines removed too."""
    return _with_text(df, window, True)


def passage_digests(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """As line_digests, with repeated pairs of lines removed too."""
    return _digests(df, window, True)
