"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted-shingle similarity. DataFrame operations alone.

First the documents' shingles are met with the items' anchors (below), in one scan for all widths
of shingles; only the stretches around such places are read again. An item's window in a document
has as many words as the item (the whole document, where that has
fewer). Windows whose five-word shingles have nothing in common with an item cannot reach the
similarity, and more holds: of an item's m shingles any m - ceil(0.8 m) + 1 must meet the window.
Only windows over such an anchor get a fingerprint; this loses no match. A fingerprint is cut into
8 blocks of 8 bits: of at most 15 differing bits, one block has at most one, so that the index of
each item's blocks, with each of their bits flipped, finds every fingerprint within the radius.
Similarity of what the index finds is computed from the shingles themselves: the sum of the lesser
counts over the sum of the greater ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, in_few_files, small, written

WORDS = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 8
#: Words of a stretch, whose windows are made one row each.
STRETCH = 256


def words_of(text: str) -> Column:
    """Lower-cased runs of letters, marks and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _shingle_hashes(words: Column, k: int) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, each).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, k: int) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) >= k, each).otherwise(F.array().cast("array<string>"))


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes; repeats count.

    Bits are counted several at a time, in lanes of a long as wide as the array is short.
    """
    n = F.size(hashes)
    return F.when(n < 1 << 7, _majority(hashes, 8)).when(n < 1 << 15, _majority(hashes, 16)).otherwise(_majority(hashes, 64))


def _majority(hashes: Column, width: int) -> Column:
    """Bits that over half of the hashes have; counts fit into lanes of ``width`` - 1 bits.

    The places are an array, too: written out one by one they would be an expression of a hundred
    aggregates, of which every task writes and compiles the code anew.
    """
    lanes = [i * width for i in range(64 // width)]
    ones, top = sum(1 << x for x in lanes), lanes[-1]
    below = (1 << top) - 1
    half = F.floor(F.size(hashes) / 2).cast("long")

    def voted(sums: Column, j: Column) -> Column:
        # the greatest lane alone could reach the sign; in the others a carry to the highest bit tells
        highest = F.when(_shift_right(sums, F.lit(top)) > half, _call("shiftleft", F.lit(1).cast("long"), j + top)).otherwise(F.lit(0).cast("long"))
        if not top:
            return highest
        low = sums.bitwiseAND(F.lit(below)) + (F.lit((1 << width - 1) - 1) - half) * F.lit(ones & below)
        carries = _shift_right(low, F.lit(width - 1)).bitwiseAND(F.lit(ones & below))
        return highest.bitwiseOR(_call("shiftleft", carries, j))

    counted = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(hashes, F.lit(0).cast("long"), _adding(j, ones)))
    return F.aggregate(F.transform(counted, voted), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _adding(shift: Column, ones: int):
    return lambda acc, h: acc + _shift_right(h, shift).bitwiseAND(F.lit(ones))


def _call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def _shift_right(x: Column, by: Column) -> Column:
    return _call("shiftrightunsigned", x, by)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, k, m, hashes, shingles, counts, fp) of the items that have words, each once.

    ``item`` tells apart different words under one item_id, or under none.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0).distinct()
    rows = rows.withColumn("item", F.xxhash64("item_id", "words"))
    made = []
    for k in range(1, WORDS + 1):
        of = rows.where(F.size("words") == k if k < WORDS else F.size("words") >= k)
        every = _shingles(F.col("words"), k)
        made.append(
            of.select("item", "item_id", F.size("words").alias("n"), F.lit(k).alias("k"), _shingle_hashes(F.col("words"), k).alias("hashes"), every.alias("every"))
            .select("*", F.size("hashes").alias("m"), F.array_distinct("every").alias("shingles"), simhash(F.col("hashes")).alias("fp"))
            .withColumn("counts", F.transform("shingles", lambda s: F.size(F.filter("every", lambda x: x == s))))
            .drop("every")
        )
    return written(reduce(DataFrame.unionAll, made))


def _anchors(items: DataFrame) -> DataFrame:
    """(k, anchor, n): hashes one of which each matching window of n words must hold; those that
    the fewest items share are taken."""
    each = items.select("item", "n", "k", "m", F.explode("hashes").alias("hash"))
    rare = each.join(each.select("item", "hash").distinct().groupBy("hash").agg(F.count("*").alias("shared")), "hash")
    ranked = rare.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("shared", "hash")))
    return ranked.where(F.col("rank") <= F.col("m") - F.ceil(F.col("m") * SIMILARITY - 1e-9) + 1).select("k", F.col("hash").alias("anchor"), "n").distinct()


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: the optimizer doesn't copy what a
    generator makes into the filters and lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _hits(texts: DataFrame, widths: list[int], anchors: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, k, n, at): where an anchor for windows of n words stands."""
    rows = _once(texts, "words", words_of("text")).drop("text")
    each = F.array(*[F.struct(F.lit(k).alias("k"), _shingle_hashes(F.col("words"), k).alias("hashes")) for k in widths])
    rows = rows.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.inline(each))
    rows = rows.select("doc_id", "text_hash", "n_words", "k", F.posexplode("hashes").alias("at", "hash"))
    of = small(anchors.withColumnRenamed("k", "of_k"))
    return rows.join(of, F.col("hash") == F.col("anchor")).where("k = of_k").select("doc_id", "text_hash", "n_words", "k", "n", "at")


def _stretches(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, text_hash, k, first, words, windows array<struct<n, start>>): the windows over the
    hits of some words of a text, with the words from number ``first`` on that they need."""
    start = F.sequence(F.greatest(F.lit(0), F.col("at") + F.col("k") - F.col("n")), F.least("at", F.greatest(F.lit(0), F.col("n_words") - F.col("n"))))
    starts = hits.select("doc_id", "text_hash", "k", "n", F.explode(start).alias("start"))
    windows = starts.groupBy("doc_id", "text_hash", "k", F.floor(F.col("start") / STRETCH).alias("stretch")).agg(F.collect_set(F.struct("n", "start")).alias("windows"))
    windows = windows.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    found = _once(texts.join(small(written(in_few_files(windows))), same), "words", words_of("text"))
    longest = F.array_max(F.transform("windows", lambda w: w["n"]))
    first = (F.col("stretch") * STRETCH).cast("int")
    return found.select("doc_id", "text_hash", "k", first.alias("first"), F.slice("words", first + 1, STRETCH + longest).alias("words"), "windows").distinct()


def _windows(stretches: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n, start, words, hashes), a row for each window."""
    each = stretches.where(F.col("k") == k).select("doc_id", "text_hash", "first", "words", F.inline("windows"))
    own = F.slice("words", F.col("start") - F.col("first") + 1, F.col("n"))
    each = _once(each.select("doc_id", "text_hash", "n", "start", own.alias("words")), "hashes", _shingle_hashes(F.col("words"), k))
    return each.where(F.size("hashes") > 0)


def _block(fp: Column, at: Column) -> Column:
    return _shift_right(fp, at * 8).bitwiseAND(F.lit(255).cast("long"))


def _index(items: DataFrame) -> DataFrame:
    """(n, block, value, item, item_fp): each block as it is and with each bit flipped."""
    flips = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << b for b in range(8))]])
    blocks = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    return blocks.select("n", "block", F.explode(F.transform(flips, lambda x: _block(F.col("fp"), F.col("block")).bitwiseXOR(x))).alias("value"), "item", F.col("fp").alias("item_fp"))


def _matches(windows: DataFrame, items: DataFrame, k: int) -> DataFrame:
    index = small(written(_index(items)))
    printed = _once(windows, "fp", simhash(F.col("hashes")))
    probes = printed.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).withColumn("value", _block(F.col("fp"), F.col("block")))
    pairs = probes.join(index, ["n", "block", "value"]).withColumn("differ", F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda j: F.bit_count(_block(F.col("differ"), j)) <= 1)
    pairs = pairs.where((F.array_position(near, True) == F.col("block") + 1) & (F.bit_count("differ") <= RADIUS))
    pairs = pairs.join(small(items.select("item", "item_id", "m", "shingles", "counts")), "item")
    common = F.aggregate(
        F.arrays_zip("shingles", "counts"),
        F.lit(0),
        lambda acc, x: acc + F.least(x["counts"], F.size(F.filter("of_window", lambda y: y == x["shingles"]))),
    )
    scored = _once(_once(pairs, "of_window", _shingles(F.col("words"), k)), "common", common)
    similarity = F.col("common") / (F.col("m") + F.size("of_window") - F.col("common"))
    return scored.select("doc_id", "text_hash", "item_id", "start", F.size("words").alias("n_words"), similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, similarity): for each document (doc_id, text)
    and item (item_id, text) the most similar window, the first of equals, where its similarity is
    at least 0.8. ``start`` counts the words before the window.

    Null and empty texts match nothing, nor do items without words. Items of fewer than five words
    are one shingle. Rows with a null id are told apart by the text's hash; rows equal in both are
    one. Every text of an item_id is searched for, null included; the best of them counts. Empty
    tables give an empty result; other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    items = _items(benchmark)
    widths = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]  # at most WORDS
    if not widths:
        return documents.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, n_words int, similarity double")
    with Scratch() as scratch:
        anchors = scratch.written(in_few_files(_anchors(items)))
        stretches = scratch.written(_stretches(texts, scratch.written(in_few_files(_hits(texts, widths, anchors).distinct()))))
        found = [_matches(_windows(stretches, k), items.where(F.col("k") == k), k) for k in widths]
        best = reduce(DataFrame.unionAll, found).groupBy("doc_id", "text_hash", "item_id")
        best = best.agg(F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start"))).alias("x"))
        return written(in_few_files(best.select("doc_id", "text_hash", "item_id", "x.*")))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no item is found; all columns stay as they are."""
    hits = written(contaminated(documents, benchmark).select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_text")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_text"))
    return documents.join(small(hits), same, "left_anti")
