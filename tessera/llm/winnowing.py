"""Document fingerprints by winnowing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: GRAM words a gram; of each SPAN - GRAM + 1 consecutive grams the least is kept, so texts that share SPAN words in a
#: row share a fingerprint.
GRAM, SPAN = 5, 20
#: Texts too short for that are compared by all their grams of so many characters, or of half the text if that is less.
FINE = 4
_PLACE = (1 << 24) - 1
_SPACE = r"[\x20\x09-\x0D]+"


def _paired(x: Column, step: int, join) -> Column:
    """join of each value and the one `step` places on; the last ones are joined with null."""
    return F.zip_with(x, F.slice(x, step + 1, F.size(x)), join)


def _over_runs(x: Column, k: int, join, body) -> Column:
    """body of the array with join over each k consecutive values of x, from those of 1, 2, 4, ... values: a step is one
    pass over the array, whatever k is."""

    def go(run: Column, size: int, out: Column | None, done: int) -> Column:
        if k & size:
            out, done = (run, size) if out is None else (F.zip_with(out, F.slice(run, done + 1, F.size(run)), join), done + size)
        if done == k:
            return body(F.slice(out, 1, F.greatest(F.size(x) - k + 1, F.lit(0))))
        return C.let(_paired(run, size, join), lambda r: go(r, 2 * size, out, done))

    return go(x, 1, None, 0)


def _minima(p: Column, w: int) -> Column:
    """The least of each w consecutive values: two runs of a power of two cover them."""

    def go(run: Column, size: int) -> Column:
        if 2 * size <= w:
            return C.let(_paired(run, size, lambda a, b: F.least(a, b)), lambda r: go(r, 2 * size))
        return F.slice(run if size == w else _paired(run, w - size, lambda a, b: F.least(a, b)), 1, F.size(p) - w + 1)

    return go(p, 1)


def selected(text: Column, gram: int = GRAM, span: int = SPAN) -> Column:
    """The kept grams of a text as longs, in order: 40 bits of the gram's hash, then 2^24 - 1 - its position.

    The least long of a window is so the least hash, and of equal hashes the rightmost. A text of fewer words than a
    gram is one gram; one of fewer grams than a window is one window; a text without words has none."""
    w = span - gram + 1
    place = lambda h, i: F.shiftleft(F.shiftright(h, 24), 24).bitwiseOR(F.lit(_PLACE) - F.pmod(i, F.lit(_PLACE + 1)).cast("long"))
    one = lambda x: F.array(place(F.xxhash64(F.concat_ws(" ", x)), F.lit(0)))
    least = lambda p: F.when(F.size(p) > w, F.array_distinct(_minima(p, w))).otherwise(F.array(F.array_min(p)))
    hashed = lambda x: C.let(F.transform(x, lambda v: F.xxhash64(v)), lambda h: _over_runs(h, gram, lambda a, b: F.xxhash64(a, b), lambda g: C.let(F.transform(g, place), least)))
    words = F.array_remove(F.split(text, _SPACE), "")
    none = F.array().cast("array<bigint>")
    return C.let(words, lambda x: F.when(F.size(x) == 0, none).when(F.size(x) < gram, one(x)).otherwise(hashed(x)))


def printed(kept: Column) -> Column:
    """hash:position of each kept gram, by a space."""
    one = lambda x: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 24))), 10, "0"), F.lit(":"), (F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE))).cast("string"))
    return F.concat_ws(" ", F.transform(kept, one))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the kept hashes, wherever they are; 1 for two empty fingerprints."""
    hashes = lambda x: F.transform(x, lambda v: F.shiftright(v, 24))
    return jaccard(hashes(a), hashes(b))


def jaccard(a: Column, b: Column) -> Column:
    both = C.let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("i"), F.size(F.array_union(s["a"], s["b"])).alias("u")))
    return C.let(both, lambda s: F.when(s["u"] == 0, F.lit(1.0)).otherwise(s["i"].cast("double") / F.greatest(s["u"], F.lit(1))))


def half_of(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def is_short(text: Column, n: Column, span: int = SPAN) -> Column:
    """Whether the half of a text that an edit keeps may hold fewer than `span` whole words, so that no fingerprint is
    sure to be kept: short texts, and those without white space."""
    return F.size(F.array_remove(F.split(F.substring(text, F.lit(1), n - half_of(n)), _SPACE, span + 2), "")) <= span


def fine_grams(text: Column, size: Column) -> Column:
    """The hashes of all runs of `size` (FINE at most) characters; a shorter text is one run, an empty one has none."""
    run = lambda x, i: F.xxhash64(*(F.when(F.lit(j) < size, F.get(x, i + j)) for j in range(FINE)))
    grams = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - size, F.lit(0))), lambda i: run(x, i))
    return C.let(F.array_remove(F.split(text, ""), ""), lambda x: F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(grams(x))))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids (_id long, n int, short) to one row an _id: _id, need (half of its largest n), any_short and next: the least larger _id, or
    after the last the first. The ids alone are sorted, by range; a table of one row a range links its borders."""
    parts = C.n_parts(ids.sparkSession)
    ids = ids.groupBy("_id").agg(F.max("n").alias("n"), F.max("short").alias("any_short")).repartitionByRange(parts, "_id")
    ids = C.cut(ids.select("_id", "n", "any_short", F.spark_partition_id().alias("part")))
    heads = ids.groupBy("part").agg(F.min("_id").alias("head"))
    border = heads.select(F.col("part").alias("_part"), F.lead("head").over(Window.orderBy("part")).alias("after"), F.min("head").over(Window.partitionBy()).alias("first"))
    inner = ids.withColumn("then", F.lead("_id").over(Window.partitionBy("part").orderBy("_id")))
    # one row a partition of the sort: bounded by the session's shuffle partitions
    return inner.join(F.broadcast(border), F.col("part") == F.col("_part")).select("_id", half_of(F.col("n")).alias("need"), "any_short", F.coalesce("then", "after", "first").alias("next"))


def fingerprint_edits(docs: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, next_doc_id, next_chars.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many of the next document's
    (all, if it has fewer), by ascending doc_id, and after the last the first. Null texts count as empty. A null doc_id
    counts as the lowest. Rows that repeat a doc_id each keep their row; the next document of all of them is the next
    doc_id's, of whose repeated rows the one with the least text counts. A single document is its own next.

    near_edited and near_next compare fingerprints; for a text whose kept half may have fewer than `span` whole words,
    all its character grams, so that near_edited is above 0 for every text."""
    parts = C.n_parts(docs.sparkSession)
    docs = docs.select("doc_id", C.id_or_lowest().alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("_id", F.length("text").alias("n"), is_short(F.col("text"), F.length("text"), span).alias("short"))
    links = next_ids(ids)
    # both uses below read the same columns of this exchange, so that texts move and are fingerprinted once
    full = docs.select("doc_id", "_id", "text", F.length("text").alias("n"), selected(F.col("text"), gram, span).alias("kept")).repartition(parts, "_id")
    repeated = docs.select("_id").groupBy("_id").count().where("count > 1").limit(1).count() > 0
    heads = full.groupBy("_id").agg(F.min(F.struct("text", "doc_id", "n", "kept")).alias("s")).select("_id", "s.*") if repeated else full
    heads = heads.select(*(F.col(c).alias(f"h_{c.strip('_')}") for c in ("doc_id", "_id", "text", "n", "kept")))
    after = heads.join(links.select(F.col("_id").alias("of"), F.col("need"), F.col("any_short"), F.col("next")), F.col("h_id") == F.col("next"))
    after = after.select("of", F.substring("h_text", F.lit(1), F.least("need", "h_n")).alias("head"), F.col("h_doc_id").alias("next_doc_id"), F.col("h_n").cast("long").alias("next_chars"), F.col("h_kept").alias("next_kept"), F.when(F.col("any_short"), F.col("h_text")).alias("next_text"))
    # in as many parts as the texts: what follows costs more time than its bytes tell
    both = full.join(after.repartition(parts, "of"), F.col("_id") == F.col("of"))
    half = half_of(F.col("n"))
    # of repeated rows the shorter need less than the longest
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("head", F.lit(1), half))
    both = both.select("doc_id", "n", "kept", "next_doc_id", "next_chars", "next_kept", edited.alias("edited"), F.when(F.col("next_text").isNotNull() & is_short(F.col("text"), F.col("n"), span), F.col("text")).alias("short"), "next_text")
    both = both.withColumn("edited_kept", selected(F.col("edited"), gram, span))
    # grams of at most the half that is kept: the edited text shares one, however short it is
    size = F.least(F.lit(FINE), F.greatest(F.lit(1), F.col("n") - half))
    near = lambda other, kept: F.when(F.col("short").isNotNull(), jaccard(fine_grams(F.col("short"), size), fine_grams(F.col(other), size))).otherwise(likeness(F.col("kept"), F.col(kept)))
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("kept")).alias("fingerprint"),
        printed(F.col("edited_kept")).alias("edited_fingerprint"),
        near("edited", "edited_kept").alias("near_edited"),
        near("next_text", "next_kept").alias("near_next"),
        "next_doc_id",
        "next_chars",
    )


def op3_winnowing(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(C.table(spark, sf_dir, "documents"))
