"""SimHash near-dedup: a byte-position inverted index with count filtering.

Two 64-bit fingerprints within ``RADIUS`` = 3 bits differ in at most 3 of their 8 bytes, so they share at
least 5 bytes in place. Postings are kept for groups of byte positions: of 5 shared bytes, one half of the
word holds 3, so every such pair meets in one of the 8 lists (3 positions of a half, their values). In a list
the shared positional bytes of a pair are tallied, pairs with fewer than 5 go, and the rest are verified bit
by bit. A list longer than ``split_at`` is split by two more of the five other positions (10 lists, still at
least one for each pair). There every pair has its 5 shared bytes, so that the tally keeps them all and only the
verification is left; 24 bits are free, so a long one is verified by looking up what up to 3 flipped bits make of
each member, in time that grows with its length. Lists give the links of a spanning forest, never all pairs. Only distinct fingerprints take part, so exact copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.graph import components
from tidemark.llm.common import cut, forest, map_rows, unused

RADIUS, MIN_SHARED = 3, 5
#: Members from which on a list whose pairs all have the minimum of shared bytes is verified by look-ups.
DENSE = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
# The constants of SplitMix64.
_GAMMA, _MIX, _MASK = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)), (1 << 64) - 1
_KEYS = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]


def _hashes(text: str | None, words_per_shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, as rows of 8 bytes; no row if there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty((0, 8), np.uint8)
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_digest
    spans = zip((ends - sizes)[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[i:j], seed) for i, j in spans]), np.uint8).reshape(n, 8)


def _majority(raw: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number; 0 of none."""
    n = len(raw)
    if n < 64:
        votes = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    else:
        seen = np.stack([np.bincount(raw[:, k], minlength=256) for k in range(8)]).astype(np.float64)
        votes = (seen @ _BITS).astype(np.int64).ravel()
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 if there is no word."""
    return _majority(_hashes(text, words_per_shingle, seed))


def family(text: str | None, count: int, words_per_shingle: int = 3, seed: int = 42) -> list[int]:
    """``count`` fingerprints of a text: the k-th is over the shingles' hashes scrambled by the k-th step of SplitMix64.

    The first is ``fingerprint``. Texts are hashed once, whatever the count.
    """
    raw = _hashes(text, words_per_shingle, seed)
    h, out = raw.view(">u8").astype(np.uint64).ravel(), [_majority(raw)]
    for k in range(1, count):
        z = h + np.uint64(k * _GAMMA & _MASK)
        z = (z ^ (z >> np.uint64(30))) * _MIX[0]
        z = (z ^ (z >> np.uint64(27))) * _MIX[1]
        z ^= z >> np.uint64(31)
        out.append(_majority(z.astype(">u8").view(np.uint8).reshape(-1, 8)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42, count: int = 1) -> DataFrame:
    """(doc_id, fps) for each row; fps are the ``count`` fingerprints as signed longs."""

    def run(columns: list) -> Iterator[tuple]:
        known: dict[str | None, list[int]] = {}
        for doc_id, text in zip(*columns, strict=True):
            if text not in known:
                if len(known) > 1000:
                    known.clear()
                known[text] = [_signed(x) for x in family(text, count, words_per_shingle, seed)]
            yield doc_id, known[text]

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long,fps array<long>")


def _byte(c: str, k: int) -> Column:
    return F.shiftrightunsigned(F.col(c), 56 - 8 * k).bitwiseAND(F.lit(255).cast("long"))


def _list_key(c: str, positions: tuple[int, ...], number: Column) -> Column:
    key = number.cast("long")
    for k in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(c, k))
    return key


def _near(a: int, b: int) -> bool:
    """Tally the shared positional bytes, then verify the bits."""
    x = (a ^ b) & 0xFFFFFFFFFFFFFFFF
    return x.to_bytes(8, "big").count(0) >= MIN_SHARED and x.bit_count() <= RADIUS


def _near_pairs(members: np.ndarray) -> Iterator[tuple[int, int]]:
    """Linked pairs of a list: shared positional bytes are tallied in blocks, and the pairs with enough are verified."""
    fps = np.unique(members)
    if len(fps) <= 8:
        yield from ((a, b) for a, b in combinations(fps.tolist(), 2) if _near(a, b))
        return
    bits = fps.view(np.uint64)
    if len(fps) > DENSE and (positions := _all_share(bits)) is not None:
        yield from _verified_by_flips(bits, positions)
        return
    for at in range(0, len(fps), 256):
        x = bits[at : at + 256, None] ^ bits[None, at:]
        shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
        i, j = np.nonzero((shared >= MIN_SHARED) & (np.bitwise_count(x) <= RADIUS))
        keep = j > i
        yield from zip(fps[at + i[keep]].tolist(), fps[at + j[keep]].tolist(), strict=True)


def _all_share(bits: np.ndarray) -> list[int] | None:
    """The bits in which a list's members differ, if the tally of every pair reaches the minimum: all share ``MIN_SHARED`` bytes."""
    differ = np.bitwise_or.reduce(bits ^ bits[0])
    same = int((np.array([differ], np.uint64).view(np.uint8) == 0).sum())
    return [k for k in range(64) if int(differ) >> k & 1] if same >= MIN_SHARED else None


def _verified_by_flips(bits: np.ndarray, positions: list[int]) -> Iterator[tuple[int, int]]:
    """Verification of a list in which no pair can be ruled out by its tally: members with up to ``RADIUS`` bits flipped are looked up.

    The positions are 24 at most, so that the work grows with the list and not with its square.
    """
    order = np.sort(bits)
    for n in range(1, RADIUS + 1):
        for flips in combinations(positions, n):
            other = bits ^ np.uint64(sum(1 << k for k in flips))
            found = order[np.minimum(np.searchsorted(order, other), len(order) - 1)] == other
            yield from zip(bits[found].view(np.int64).tolist(), other[found].view(np.int64).tolist(), strict=True)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of equal keys; rows come sorted by key. Links of several runs are merged."""
    held_key, held, found = None, np.empty(0, np.int64), []

    def send() -> pa.RecordBatch:
        merged = forest(found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in merged], pa.int64()), pa.array([b for _, b in merged], pa.int64())], names=["u", "v"])

    for batch in batches:
        keys, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        parts, firsts = np.split(fps, cuts), keys[np.concatenate([[0], cuts])]
        if held_key is not None and firsts[0] == held_key:
            parts[0] = np.concatenate([held, parts[0]])
        elif held_key is not None:
            parts.insert(0, held)
        held_key, held = keys[-1], parts.pop()
        for part in parts:
            if len(part) > 1:
                found.extend(forest(_near_pairs(part)))
                if len(found) > 1 << 16:
                    yield send()
    found.extend(forest(_near_pairs(held)))
    yield send()


def links(nodes: DataFrame, split_at: int = 512) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints ``fp`` of ``nodes`` with the same ``k`` at ``RADIUS`` bits or fewer.

    Each k, from 0, has lists of its own: a list's number is k * 8 and that of its positions, above the 24 bits of its bytes.
    """

    def listed(df: DataFrame) -> DataFrame:
        return df.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long")

    keys = F.array(*[_list_key("fp", c, F.col("k") * 8 + n) for n, c in enumerate(_KEYS)])
    postings = nodes.select(F.explode(keys).alias("key"), "fp")
    sizes = cut(postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    found = listed(postings.join(sizes.filter(F.col("n") <= split_at), "key", "left_semi"))
    long_lists = sizes.filter(F.col("n") > split_at)
    if not long_lists.isEmpty():
        more = []
        for number, c in enumerate(_KEYS):
            rest = [k for k in range(8) if k not in c]
            k = F.shiftright("key", 27)
            five = [_list_key("fp", (*c, *two), k * 80 + number * 10 + i) for i, two in enumerate(combinations(rest, 2))]
            of_key = postings.filter(F.shiftright("key", 24) % 8 == number).join(long_lists, "key", "left_semi")
            more.append(of_key.select(F.explode(F.array(*five)).alias("key"), "fp"))
        extra = more[0]
        for x in more[1:]:
            extra = extra.union(x)
        found = found.union(listed(extra))
    return found


def _text_links(own: DataFrame, split_at: int) -> DataFrame:
    """(u, v) between first fingerprints ``id`` whose texts have a k-th fingerprint ``fp`` equal or linked, of rows (id, k, fp).

    Every fingerprint is stood for by the smallest ``id`` that has it, so that the members of a group are never paired.
    """
    of = cut(own.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high")))
    same = own.join(of.filter("low < high"), "fp").filter("id <> low").selectExpr("id u", "low v")
    found = cut(links(own.select("k", "fp").distinct(), split_at))
    near = found.join(of.selectExpr("fp u", "low a"), "u").join(of.selectExpr("fp v", "low b"), "v")
    return same.union(near.selectExpr("a u", "b v"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42, split_at: int = 512, count: int = 1) -> DataFrame:
    """Near-duplicate class of each row of ``docs`` (doc_id, text; other columns are not looked at).

    Returns doc_id, fp (the first fingerprint, a signed long) and component_id, the smallest doc_id that a chain of links
    reaches. With a ``count`` above 1 each text has that many fingerprints, and texts are linked if any of them are: a
    pair whose bits differ with probability p is then found in 1 - (1 - P(B(64, p) <= 3)) ** count of all cases.

    * Null, empty and blank texts have fingerprint 0, which is linked like any other.
    * Very long texts are hashed whole; one must fit in a task's memory a few times, as its shingles' hashes do.
    * Ties do not arise: a bit set in just half of the hashes is 0, and the smallest doc_id of a class is one.
    * Rows with the same doc_id are rows of their own; they get the same class if their texts do.
    * A null doc_id is never the smallest; a class that has no other gets a null component_id.
    * An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, words_per_shingle, seed, count))
    fps = rows.select("doc_id", F.col("fps")[0].alias("fp"))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    if count == 1:
        roots = components(links(nodes.select(F.lit(0).alias("k"), "fp"), split_at))
    else:
        own = rows.select("fps").distinct().select(F.col("fps")[0].alias("id"), F.posexplode("fps").alias("k", "fp"))
        roots = components(_text_links(cut(own), split_at))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = cut(rooted)
    # Written first: both sides of the joins below are then plain exchanges, whose hot partitions Spark splits.
    smallest = cut(classes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    by_fp = cut(classes.join(smallest, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near copies: of each class the rows with the smallest doc_id stay.

    All columns stay as they are, whatever they are called. Rows that share the smallest doc_id all stay.
    """
    classes = near_duplicates(docs, **options)
    own = unused("stays", docs.columns)
    stay = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")
