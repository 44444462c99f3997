"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Built from DataFrame functions only. A document matches an item if a window of as many words as the item has
(cut off at the document's ends) reaches ``threshold`` in weighted similarity of word shingles: the sum over
shingles of the smaller count over the sum of the larger.

1. Windows. One that similar holds at least ``threshold`` of the item's shingles, so any choice of more than the
   rest of them must meet it. Each item's anchors are its shingles whose longest word is longest, just as many as
   that takes. All item-sized windows over a place with an anchor are taken, wherever the item has it; windows
   without an anchor cannot match, so nothing is lost. Places are kept in pieces of ``PIECE`` words with the words
   around them.
2. Fingerprints. Every such window gets a 64-bit SimHash of its shingles. From one window to the next the counts of
   set bits change by the shingles that come and go; four counts share a long, so that a step is 16 sums.
3. Candidates. A fingerprint is cut into 8 blocks. Two within ``RADIUS`` = 23 bits agree up to 2 bits in some block;
   items are listed under all 37 values that near to each of their blocks, so that a window's 8 look-ups give every
   item of its size within the radius, and no other place knows which item a window might match.
4. Verification computes the weighted similarity of the shingles themselves.

Two shingle sets at 0.8 differ in 9 bits on average, with a standard deviation of about 3.

The benchmark is a small given set: its anchors go to every task if they number ``literal_bound`` at most. Beyond
that the hashes of all shingles are looked up by a shuffled join, and the words around those found are cut out of
the texts afterwards.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut, unused

SHINGLE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Words of a document whose anchors are looked at together.
PIECE = 64
#: All differences of up to 2 bits in a block of 8.
_FLIPS = [sum(1 << k for k in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(64 // BLOCKS), n)]
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Four bits are spread to lanes of 15 bits by a product and a mask; a lane counts up to 2^14 shingles.
_SPREAD, _LANES = sum(1 << 14 * k for k in range(4)), sum(1 << 15 * k for k in range(4))
MOST_WORDS = (1 << 14) - 1


def words_of(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATORS), "")


def _shingles(words: str) -> Column:
    """Shingles of an array of words; fewer words are one shingle, none give none."""
    return F.expr(
        f"CASE WHEN size({words}) = 0 THEN array() ELSE transform(sequence(0, greatest(0, size({words}) - {SHINGLE})),"
        f" i -> array_join(slice({words}, i + 1, {SHINGLE}), ' ')) END"
    )


def _simhash(hashes: str) -> Column:
    """Bit k is set if it is in over half of the shingles' hashes."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, k) -> acc | shiftleft(CAST(size(filter({hashes}, h -> (shiftright(h, k) & 1L) = 1L)) * 2"
        f" > size({hashes}) AS BIGINT), k))"
    )


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    """``rows`` with fp. Shingles and hashes are written first, or each of the 64 bits would compute them again."""
    return cut(rows.withColumn("shingles", _shingles("words")).withColumn("hashes", F.expr("transform(shingles, s -> xxhash64(s))"))).withColumn("fp", _simhash("hashes"))


def _similarity(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger counts of the elements of two arrays."""
    repeats = f"size(array_distinct({a})) < size({a}) AND size(array_distinct({b})) < size({b})"
    counted = f"aggregate(array_distinct({a}), 0, (acc, x) -> acc + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    shared = f"(CASE WHEN {repeats} THEN {counted} ELSE size(array_intersect({a}, {b})) END)"
    return F.expr(f"transform(array({shared}), n -> n / double(size({a}) + size({b}) - n))[0]")


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    return _with_fingerprint(rows.withColumn("size", F.size("words")))


def _anchors(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, size, at, width, gate, anchor): the shingles at which windows are laid."""
    width = F.least(F.lit(SHINGLE), F.col("size"))
    each = items.select("item_id", "size", width.alias("width"), "words", F.posexplode("shingles").alias("at", "shingle"))
    own = F.expr("slice(words, at + 1, width)")
    gate = F.expr("array_max(transform(own, w -> struct(length(w) AS n, w AS w))).w")
    each = each.withColumn("own", own).withColumn("gate", gate).withColumn("rank", F.struct(-F.length("gate"), F.col("shingle")))
    all_of = items.select("item_id", F.size("shingles").alias("n"))
    # Rank of a shingle counts all its repeats, so that a multiple counts as often as it is there.
    ranked = each.join(each.select("item_id", F.col("rank").alias("r")), "item_id").groupBy("item_id", "size", "width", "at", "shingle", "gate", "rank").agg(F.count_if(F.expr("r < rank")).alias("before"))
    chosen = ranked.join(all_of, "item_id").filter(F.col("before") < F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    return chosen.select("item_id", "size", "at", "width", "gate", F.xxhash64("shingle").alias("anchor"))


def _places(docs: DataFrame, anchors: DataFrame, widths: list[int], literal_bound: int) -> DataFrame:
    """(doc_id, words, hits): documents that hold an anchor, with all places (at, width, anchor)."""
    rows = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("digest"))
    hash_at = "xxhash64(array_join(slice(words, s + 1, {w}), ' '))"
    small = anchors.select("gate", "width", "anchor").distinct().limit(literal_bound + 1).collect()
    if len(small) > literal_bound:
        every = reduce(DataFrame.union, [rows.select("digest", F.explode(F.expr(f"transform(CASE WHEN size(words) < {w} THEN array() ELSE sequence(0, size(words) - {w}) END, s -> struct(s AS at, {w} AS width, {hash_at.format(w=w)} AS anchor))")).alias("hit")) for w in widths])
        known = anchors.select("anchor", "width").distinct()
        found = every.select("digest", "hit.*").join(known, ["anchor", "width"]).groupBy("digest").agg(F.collect_set(F.struct("at", "width", "anchor")).alias("hits"))
        return rows.join(found, "digest").select("doc_id", "words", "hits")
    # The gate words, the longest of each anchor, are looked up in the row itself, and hashes only beside them.
    gates = sorted({r["gate"] for r in small})
    rows = rows.withColumn("gates", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(gates), i)))).filter(F.size("gates") > 0)

    def within(hits: Column, known: list[int]) -> Column:
        return F.filter(hits, lambda x: x["anchor"].isin(known))

    parts = []
    for w in widths:
        known = sorted({r["anchor"] for r in small if r["width"] == w})
        starts = F.expr(f"array_distinct(flatten(transform(gates, g -> transform(sequence(0, {w - 1}), o -> g - o))))")
        hit = F.expr(f"transform(filter(starts{w}, s -> s >= 0 AND s <= size(words) - {w}), s -> struct(s AS at, {w} AS width, {hash_at.format(w=w)} AS anchor))")
        rows = rows.withColumn(f"starts{w}", starts).withColumn(f"hits{w}", within(hit, known))
        parts.append(f"hits{w}")
    return rows.select("doc_id", "words", F.concat(*parts).alias("hits"))


def _pieces(places: DataFrame, longest: int) -> DataFrame:
    """(piece, doc_id, first, n, words, hits): the words around the hits of each ``PIECE`` words; n are the document's words."""
    own = f"filter(hits, h -> h.at div {PIECE} = p)"
    first = f"greatest(0, CAST(p AS INT) * {PIECE} - {longest})"
    piece = f"struct({first} AS first, size(words) AS n, slice(words, {first} + 1, {PIECE + SHINGLE + 2 * longest}) AS words, {own} AS hits)"
    # An outer generator, as for an inner one the optimizer would look below it for empty arrays, computing all of this twice.
    out = places.select("doc_id", F.explode_outer(F.expr(f"transform(array_distinct(transform(hits, h -> h.at div {PIECE})), p -> {piece})")).alias("x")).filter("x is not null")
    return cut(out.select("doc_id", "x.*").withColumn("piece", F.monotonically_increasing_id()))


def _windows(pieces: DataFrame, anchors: DataFrame) -> DataFrame:
    """(piece, size, width, s, fp): all windows over an anchor of an item of that size, with their SimHash."""
    sizes = anchors.select("anchor", "width", "size").distinct()
    of_size = pieces.select("piece", F.explode("hits").alias("h")).select("piece", "h.*").join(sizes, ["anchor", "width"])
    of_size = of_size.groupBy("piece", "size", "width").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    rows = of_size.join(pieces.select("piece", "first", "n", "words"), "piece")
    # A window belongs to the first anchor in it, so that none is there twice.
    low = "greatest(a - size + width, CASE WHEN i = 0 THEN a - size + width ELSE ats[i - 1] + 1 END)"
    rows = rows.withColumn("starts", F.expr(f"flatten(transform(ats, (a, i) -> sequence({low}, a)))"))
    hashes = "transform(sequence(0, size(words) - width), p -> xxhash64(array_join(slice(words, p + 1, width), ' ')))"
    lanes = f"transform({hashes}, h -> transform(sequence(0, 15), k -> ((shiftright(h, 4 * k) & 15L) * {_SPREAD}L) & {_LANES}L))"
    begin, end = "(greatest(0, s) - first)", "(least(n, s + size) - first - width + 1)"
    added = f"aggregate(slice(lanes, acc.t + 1, {end} - acc.t), acc.c, (c, x) -> zip_with(c, x, (p, q) -> p + q))"
    moved = f"aggregate(slice(lanes, acc.f + 1, {begin} - acc.f), {added}, (c, x) -> zip_with(c, x, (p, q) -> p - q))"
    # Bit 14 of a lane tells whether its count is over half of the window's shingles.
    tested = f"shiftright(c[k] + (16383L - ({end} - {begin}) div 2) * {_LANES}L, 14) & {_LANES}L"
    four = f"transform(array({tested}), b -> (b | shiftright(b, 14) | shiftright(b, 28) | shiftright(b, 42)) & 15L)[0]"
    fp = f"aggregate(sequence(0, 15), 0L, (acc2, k) -> acc2 | shiftleft({four}, 4 * k))"
    begun = "struct(greatest(0, starts[0]) - first AS f, greatest(0, starts[0]) - first AS t, array_repeat(0L, 16) AS c, CAST(array() AS array<struct<s: int, fp: bigint>>) AS out)"
    step = f"transform(array({moved}), c -> struct({begin} AS f, {end} AS t, c AS c, array_append(acc.out, struct(s AS s, {fp} AS fp)) AS out))[0]"
    # One-element arrays bind what is used more than once, so that it is computed once.
    found = F.expr(f"transform(array({lanes}), lanes -> aggregate(starts, {begun}, (acc, s) -> {step}, acc -> acc.out))[0]")
    return cut(rows.select("piece", "size", "width", F.explode_outer(found).alias("x")).filter("x is not null").select("piece", "size", "width", "x.s", "x.fp"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, literal_bound: int = 50_000) -> DataFrame:
    """(doc_id, item_id, start, similarity): for each pair that matches its most similar window, the first of equals.

    * Null, empty and wordless texts and items match nothing. Rows with one doc_id, or with a null one, are one document.
    * Items with the same text all match. Items of under 5 words have one shingle, the whole; those of over
      ``MOST_WORDS`` words are refused.
    * Very long texts are scanned whole, and go on in pieces around their anchors.
    * Other columns are not looked at. Empty tables give an empty result.
    """
    items = cut(_items(benchmark))
    anchors = cut(_anchors(items, threshold))
    shape = items.agg(F.max("size").alias("longest"), F.collect_set(F.least(F.lit(SHINGLE), F.col("size"))).alias("widths")).first()
    if not shape["widths"]:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).limit(0)
    if shape["longest"] > MOST_WORDS:
        raise ValueError(f"an item has {shape['longest']} words; windows have {MOST_WORDS} at most")
    pieces = _pieces(_places(docs, anchors, sorted(shape["widths"]), literal_bound), shape["longest"])
    windows = _windows(pieces, anchors)

    block = F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b AS block, CAST(shiftright(fp, b * {64 // BLOCKS}) & 255L AS INT) AS value))")
    flips = F.array(*[F.lit(x) for x in _FLIPS])
    listed = items.select("item_id", "size", "fp", F.explode(block).alias("b")).withColumn("flip", F.explode(flips))
    listed = listed.select("item_id", "size", F.col("fp").alias("item_fp"), "b.block", F.col("b.value").bitwiseXOR(F.col("flip")).alias("value"))
    probes = windows.select("size", "fp").distinct().select("size", "fp", F.explode(block).alias("b")).select("size", "fp", "b.*")
    near = probes.join(listed, ["size", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = cut(near.select("size", "fp", "item_id").distinct())

    said = F.expr("slice(words, greatest(0, s) - first + 1, least(n, s + size) - greatest(0, s))")
    candidates = windows.join(near, ["size", "fp"]).join(pieces.select("piece", "doc_id", "first", "n", "words"), "piece")
    candidates = candidates.select("doc_id", "item_id", F.greatest(F.lit(0), "s").alias("start"), said.alias("words"))
    # The windows of equal texts are compared once.
    pairs = cut(candidates.select("item_id", "words").distinct().withColumn("shingles", _shingles("words")))
    pairs = pairs.join(items.select("item_id", F.col("shingles").alias("item_shingles")), "item_id").withColumn("similarity", _similarity("shingles", "item_shingles"))
    same = cut(pairs.filter(F.col("similarity") >= threshold).select("item_id", "words", "similarity"))
    best = candidates.join(same, ["item_id", "words"]).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.col2")).alias("start"), "x.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, literal_bound: int = 50_000) -> DataFrame:
    """One row per document that matches an item: doc_id, n_items, item_ids (ascending), start of the first match, similarity of the best."""
    pairs = matches(docs, benchmark, threshold, literal_bound)
    out = pairs.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.min("start").cast("long").alias("first_word"), F.max("similarity").alias("similarity"))
    return out.select("doc_id", "n_items", "item_ids", "first_word", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows of documents that match an item; all columns stay as they are, whatever they are called."""
    own = unused("bad", docs.columns)
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(own))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_anti")
