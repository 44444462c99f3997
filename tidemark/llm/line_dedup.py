"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of white space at both ends with A-Z lower-cased. A key of at least
``min_chars`` code points that is found in at least ``min_docs`` documents is active: all its lines go,
except in the document with the largest doc_id that holds it.

``LineIndex`` holds three things. ``references`` has a row for every key and document, ``counts`` the exact
number of documents and the largest doc_id of each key, ``filters`` a cuckoo filter of the active keys for
each shard of the key space. The filters answer for nearly all lines without a look-up; what they let
through is checked against the exact counts, so that a false positive drops nothing. Inserting documents adds
references and the fingerprints of keys that become active, deleting documents takes both away again, which
leaves what an index built without them has: no decision is ever final. Both write the references, counts and
shards that they change, not the index.

Keys are held as 128-bit digests.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_BYTES, cut, few, unused

SLOTS, KICKS = 4, 500
#: Active keys of a shard when the index is built, and the size up to which filters go to every task.
SHARD_KEYS, BROADCAST_BYTES = 1 << 15, 32 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE_BYTES).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four, two candidate buckets each; full tables get one more beside them."""

    def __init__(self, n_keys: int = 1, tables: list[np.ndarray] | None = None):
        self.tables = tables or [self._table(n_keys)]

    @staticmethod
    def _table(n_keys: int) -> np.ndarray:
        return np.zeros((1 << max(2, (int(n_keys / 0.8) // SLOTS).bit_length()), SLOTS), np.uint16)

    @staticmethod
    def _mix(mark: int) -> int:
        return mark * 0x5BD1E995 >> 7

    def _place(self, key: bytes, table: np.ndarray) -> tuple[int, int, int]:
        a = int.from_bytes(key[:8], "little")
        mark, i = (a & 0xFFFF) or 1, a >> 16 & len(table) - 1
        return mark, i, i ^ self._mix(mark) & len(table) - 1

    def insert(self, key: bytes) -> None:
        table = self.tables[-1]
        mark, i, j = self._place(key, table)
        for b in (i, j):
            if len(free := np.flatnonzero(table[b] == 0)):
                table[b, free[0]] = mark
                return
        undo = []
        for k in range(KICKS):
            slot = k % SLOTS
            undo.append((j, slot, table[j, slot]))
            mark, table[j, slot] = int(table[j, slot]), mark
            j ^= self._mix(mark) & len(table) - 1
            if len(free := np.flatnonzero(table[j] == 0)):
                table[j, free[0]] = mark
                return
        for b, slot, old in reversed(undo):
            table[b, slot] = old
        self.tables.append(np.zeros((2 * len(table), SLOTS), np.uint16))
        self.insert(key)

    def delete(self, key: bytes) -> bool:
        for table in self.tables:
            mark, i, j = self._place(key, table)
            for b in (i, j):
                if len(at := np.flatnonzero(table[b] == mark)):
                    table[b, at[0]] = 0
                    return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For the first 8 bytes of each key, as little-endian uint64."""
        mark = np.maximum(keys & np.uint64(0xFFFF), np.uint64(1))
        found = np.zeros(len(keys), bool)
        for table in self.tables:
            low = np.uint64(len(table) - 1)
            i = keys >> np.uint64(16) & low
            j = i ^ (mark * np.uint64(0x5BD1E995) >> np.uint64(7)) & low
            for b in (i, j):
                found |= (table[b.astype(np.int64)] == mark.astype(np.uint16)[:, None]).any(axis=1)
        return found

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<I", len(t)) + t.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        tables, at = [], 0
        while at < len(raw):
            (n,) = struct.unpack_from("<I", raw, at)
            tables.append(np.frombuffer(raw, np.uint16, n * SLOTS, at + 4).reshape(n, SLOTS).copy())
            at += 4 + 2 * n * SLOTS
        return cls(tables=tables)


def _shard(c: str, shards: int):
    """Shard of a key column: bits that the filter itself does not use."""
    return F.conv(F.hex(F.substring(c, 13, 4)), 16, 10).cast("long") % shards


def _shards_of(raw: np.ndarray, shards: int) -> np.ndarray:
    return raw[:, 12:16].copy().view(">u4").ravel().astype(np.int64) % shards


def line_references(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(key, doc_id): each long key of each row, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            sizes: list[int] = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                own = {k for line in raw.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                keys.extend(own)
                sizes.append(len(own))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)], pa.binary()), ids.slice(at, 1 << 16)], names=["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "key binary, doc_id long")


def _counted(references: DataFrame) -> DataFrame:
    """Documents of each key: rows of one doc_id are one document, those without any are one too."""
    n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    return references.groupBy("key").agg(n.alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _build_filters(active: DataFrame, shards: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(len(pdf))
        for key in pdf["key"]:
            made.insert(key)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [made.to_bytes()]})

    return active.select(_shard("key", shards).alias("shard"), "key").groupBy("shard").applyInPandas(run, "shard long, filter binary")


def _update_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """changes: (key, on); on tells a key that became active from one that no longer is."""

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(len(new))
        for key, on in zip(new["key"], new["on"], strict=True):
            made.insert(key) if on else made.delete(key)
        shard = old["shard"].iloc[0] if len(old) else new["shard"].iloc[0]
        return pd.DataFrame({"shard": [shard], "filter": [made.to_bytes()]})

    sharded = changes.select(_shard("key", shards).alias("shard"), "key", "on")
    return filters.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInPandas(run, "shard long, filter binary")


@dataclass
class LineIndex:
    """The three tables. ``insert`` and ``delete`` write what they change and no more; ``compact`` writes all anew.

    Between compactions ``references`` and ``counts`` are what was written first less or plus the changes, which are
    joined when they are read.
    """

    references: DataFrame
    counts: DataFrame
    active: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 40
    min_docs: int = 5

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: bool = True) -> LineIndex:
        """Index of ``docs`` (doc_id, text). Without ``keep`` only the active keys and their filters are written, for one use."""
        references = line_references(docs, min_chars)
        references = cut(references.distinct()) if keep else references
        counts = cut(_counted(references)) if keep else _counted(references)
        return cls._of(references, counts, cut(counts.filter(F.col("n_docs") >= min_docs)), min_chars, min_docs)

    @classmethod
    def _of(cls, references: DataFrame, counts: DataFrame, active: DataFrame, min_chars: int, min_docs: int) -> LineIndex:
        shards = max(16, 1 << (active.count() // SHARD_KEYS).bit_length())
        return cls(references, counts, active, cut(_build_filters(active, shards)), shards, min_chars, min_docs)

    def compact(self) -> LineIndex:
        """The same index written anew, with as many shards as its active keys need now."""
        return self._of(cut(self.references), cut(self.counts), self.active, self.min_chars, self.min_docs)

    def _changed(self, references: DataFrame, touched: DataFrame, fresh: DataFrame) -> LineIndex:
        """touched: (key) whose counts may differ; fresh: their counts now, without keys that no document has."""
        fresh = cut(fresh)
        counts = self.counts.join(touched, "key", "left_anti").unionByName(fresh)
        now = fresh.filter(F.col("n_docs") >= self.min_docs)
        on = now.join(self.active, "key", "left_anti").select("key", F.lit(True).alias("on"))
        off = self.active.join(touched, "key", "left_semi").join(now, "key", "left_anti").select("key", F.lit(False).alias("on"))
        changes = cut(off.union(on))
        # Only shards with a change are read and written; the others stay the files that they are.
        shards = changes.select(_shard("key", self.shards).alias("shard")).distinct()
        updated = cut(_update_filters(self.filters.join(shards, "shard", "left_semi"), changes, self.shards))
        filters = self.filters.join(shards, "shard", "left_anti").unionByName(updated)
        active = cut(self.active.join(touched, "key", "left_anti").unionByName(now))
        out = LineIndex(references, counts, active, filters, self.shards, self.min_chars, self.min_docs)
        return out.compact() if active.count() > 4 * SHARD_KEYS * self.shards else out

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents too; their doc_ids must be new."""
        new = cut(line_references(docs, self.min_chars).distinct())
        touched = new.select("key").distinct()
        both = self.counts.join(touched, "key", "left_semi").unionByName(_counted(new))
        fresh = both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return self._changed(self.references.unionByName(new), touched, fresh)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of ``doc_ids`` (doc_id); only keys that they held are counted again."""
        gone = cut(doc_ids.select(F.col("doc_id").cast("long").alias("_gone")).distinct())
        same = F.col("doc_id").eqNullSafe(F.col("_gone"))
        touched = cut(self.references.join(gone, same, "left_semi").select("key").distinct())
        left = self.references.join(gone, same, "left_anti")
        return self._changed(left, touched, _counted(left.join(touched, "key", "left_semi")))

    def _passed(self, docs: DataFrame, broadcast_bytes: int) -> DataFrame:
        """(key, doc_id) of the lines that the filters let through."""
        shards = self.shards
        if (self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= broadcast_bytes:
            sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
                for batch in batches:
                    raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 16)
                    of, head = _shards_of(raw, shards), raw[:, :8].copy().view("<u8").ravel()
                    found = np.zeros(len(raw), bool)
                    for shard in np.unique(of):
                        if shard in filters:
                            at = np.flatnonzero(of == shard)
                            found[at] = filters[shard].contains(head[at])
                    yield batch.filter(pa.array(found))

            return line_references(docs, self.min_chars).mapInArrow(probe, "key binary, doc_id long")

        # Filters beyond the bound: lines go to the filter of their shard, each shard dealt over several tasks.
        salts = 16

        def look(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            if not len(old) or not len(new):
                return new[["key", "doc_id"]].iloc[:0]
            head = np.frombuffer(b"".join(k[:8] for k in new["key"]), "<u8")
            return new.loc[CuckooFilter.from_bytes(old["filter"].iloc[0]).contains(head), ["key", "doc_id"]]

        lines = line_references(docs, self.min_chars).withColumn("shard", _shard("key", shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        filters = self.filters.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])))
        return filters.groupBy("shard", "salt").cogroup(lines.groupBy("shard", "salt")).applyInPandas(look, "key binary, doc_id long")

    def apply(self, docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` with ``text`` cut down, and ``n_lines`` and ``n_dropped`` (long), which replace columns so named."""
        drops = self._passed(docs, broadcast_bytes).join(self.active, "key").filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        own, drop = unused("own_id", kept), unused("drop", kept)
        drops = drops.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(drop))
        with_drops = docs.select(*kept).join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").select(*kept, drop)
        schema, min_chars, at = docs.select(*kept).schema, self.min_chars, kept.index("text")

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few(batches):
                texts, lines, dropped = batch.column(at).to_pylist(), [], []
                for i, drop in enumerate(batch.column(len(kept)).to_pylist()):
                    parts = (texts[i] or "").encode().split(b"\n")
                    stay = [x for x in parts if not (len(x) >= min_chars and line_key(x, min_chars) in gone)] if (gone := set(drop or ())) else parts
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(stay))
                    if len(stay) < len(parts):
                        texts[i] = b"\n".join(stay).decode()
                columns = batch.columns[: len(kept)]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

        return with_drops.mapInArrow(rewrite, schema.add("n_lines", "long").add("n_dropped", "long"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the lines that many documents share.

    Returns all columns and rows of ``docs`` with ``text`` cut down, n_lines (before) and n_dropped.

    * A null text counts as one empty line and stays null; an empty text is one empty line. Nothing is dropped.
    * Rows with one doc_id count as one document, those with a null one too; rows that share the largest doc_id of a key
      all keep its lines. A null doc_id ranks below all others: its rows keep a line only if every row that holds it has none.
    * Very long texts are split whole; one must fit in a task's memory a few times. Lines of any length have a key of 16 bytes.
    * Columns named n_lines or n_dropped are replaced, all others stay as they are. An empty table stays empty.
    """
    return LineIndex.build(docs, min_chars, min_docs, keep=False).apply(docs, broadcast_bytes)
