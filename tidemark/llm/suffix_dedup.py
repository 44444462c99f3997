"""Suffix-array dedup by deep-shallow sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller
doc_id. Strings are judged on the input; overlaps count; no string crosses documents.

Suffixes are sorted only where they can repeat. Every window of ``length`` bytes has an anchor: of the 20-byte
grams in it the one with the least hash, the leftmost of equals. Equal windows have equal anchors, and a
document's windows fall into runs with the same anchor, so a text needs about one record for 16 bytes.

1. ``_anchors`` hashes the texts and packs the anchors of a task by bucket. Anchors that a task sees very often
   ("hot") go ahead as candidates at once, with two of them sent to the bucket as witnesses.
2. ``_candidates`` finds, in each bucket, the anchors of two or more documents.
3. ``_contexts`` takes the runs of these anchors out of the texts. Equal runs of a shard count once, with the
   smallest doc_id. Runs go to the bucket of their anchor; those of hot anchors are split into windows, which are
   dealt by their own hash, so that neither a frequent string nor a frequent anchor meets in one task.
4. ``_repeats`` sorts the suffixes of a bucket: a multikey sort over characters of 8 bytes to a shallow depth of
   16 bytes, then the groups with a longer common prefix by comparison with their first members and, for what
   remains, by blind tries. Of each group of equal windows the smallest doc_id is known then.
5. ``_removed`` marks what is covered and cuts it out of the texts.

A doc_id tells only which document is smaller, and which rows are one document; rows themselves are told apart by
doc_id and text. A null doc_id is tracked by a hash of its text, so such rows are dealt like any others.

Exact copies of a text are found by digest first and skip step 3. Everything moves as packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release

LENGTH, GRAM, SHALLOW = 50, 20, 16
#: Bytes of text hashed at once, anchors packed at once, and records of an anchor, of those packed at once or four
#: times as many of a bucket, that make it hot: a small part of what a bucket holds anyway.
CHUNK, FLUSH, HOT = 1 << 17, 1 << 21, 4096
#: Bytes of text for each bucket and shard.
UNIT_BYTES = 4 << 20
NO_ID = (1 << 63) - 1
#: Rows without a doc_id are tracked by numbers from here on; as documents they all count as this one, the largest.
OWN_IDS = (1 << 63) - (1 << 32)
_U = np.uint64
_POWERS = {1: 0x9E3779B97F4A7C15}
for _k in (2, 4, 8):
    _POWERS[_k] = _POWERS[_k // 2] ** 2 % (1 << 64)


def pack(x: np.ndarray) -> bytes:
    """An array as planes of bytes, which compress well if the numbers are small or alike."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    h = {1: b.astype(_U) + _U(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * _U(_POWERS[k]) + h[k][k:]
    out = h[16][:-4] * _U(_POWERS[4]) + h[4][16:]
    out ^= out >> _U(31)
    out *= _U(0xD6E8FEB86659FD93)
    out ^= out >> _U(29)
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def find_anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, place, hash) of all anchors, in order, a chunk at a time; long texts are cut with an overlap."""
    width = length - GRAM + 1
    pieces: list[tuple[int, int, int, int]] = []
    total = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t), CHUNK):
            low, high = max(0, at - width + 1), min(len(t), at + CHUNK + length - 1)
            if high - low >= length:
                pieces.append((i, low, high, at))
                total += high - low
                if total >= CHUNK:
                    yield _chunk_anchors(texts, pieces, length)
                    pieces, total = [], 0
    if pieces:
        yield _chunk_anchors(texts, pieces, length)


def _chunk_anchors(texts: list[bytes], pieces: list[tuple[int, int, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = length - GRAM + 1
    b = np.frombuffer(b"".join(texts[i][low:high] for i, low, high, _ in pieces), np.uint8)
    sizes = np.array([high - low for _, low, high, _ in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = _gram_hashes(b)
    least = _sliding(h, width, np.minimum)
    valid = np.zeros(len(least), bool)
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        valid[s : s + n - length + 1] = True
    # A gram is an anchor if it is the least of a window that holds it; windows across pieces never are.
    padded = np.zeros(len(least) + 2 * (width - 1), _U)
    padded[width - 1 : width - 1 + len(least)] = np.where(valid, least, _U(0))
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    piece = np.searchsorted(starts, at, "right") - 1
    of, low, keep = (np.array([p[k] for p in pieces]) for k in (0, 1, 3))
    place = at - starts[piece] + low[piece]
    own = (place >= keep[piece]) & (place < keep[piece] + CHUNK) & (h[at] > 0)
    return of[piece[own]], place[own], h[at[own]]


def runs(doc: np.ndarray, place: np.ndarray, h: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows of which each anchor is the anchor (last < first: none)."""
    width = length - GRAM + 1
    first, last = np.maximum(0, place - width + 1), np.minimum(place, sizes[doc] - length)
    # Anchors k apart are only near if those k - 1 apart are, so few are left after the first look.
    at, k = np.arange(len(doc)), 1
    while len(at := at[at + k < len(doc)]):
        at = at[(doc[at + k] == doc[at]) & (place[at + k] - place[at] < width)]
        left_wins = h[at] <= h[at + k]
        i, j = at[left_wins] + k, at[~left_wins]
        first[i] = np.maximum(first[i], place[i - k] + 1)
        last[j] = np.minimum(last[j], place[j + k] - width)
        k += 1
    return first, last


class BlindTrie:
    """A Patricia trie that looks at one byte for each branch; a string's place is verified against one leaf."""

    def __init__(self, first: bytes):
        self.strings, self.root = [first], 0

    def insert(self, s: bytes) -> int:
        """Number of the string's leaf, a new one if it is new. Inner nodes are (depth, {byte: child})."""
        node = self.root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.strings[node]
        if s == other:
            return node
        depth = next(k for k in range(len(s)) if s[k] != other[k])
        leaf = len(self.strings)
        self.strings.append(s)
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = leaf
        else:
            made = (depth, {s[depth]: leaf, other[depth]: node})
            if parent is None:
                self.root = made
            else:
                parent[1][s[parent[0]]] = made
        return leaf

    def ordered(self) -> list[int]:
        """Leaves in the order of their strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(child for _, child in sorted(node[1].items(), key=lambda x: -x[0]))
        return out


def sort_packed(*parts: np.ndarray) -> np.ndarray:
    """Order of rows by several columns of whole numbers from 0: one sort of packed numbers if they fit in 64 bits."""
    n = len(parts[0])
    bits = [int(x.max(initial=0)).bit_length() for x in parts]
    width = max(1, n - 1).bit_length()
    if sum(bits) + width > 64:
        return np.lexsort(parts[::-1])
    key = np.zeros(n, _U)
    for x, k in zip(parts, bits, strict=True):
        key = key << _U(k) | x.astype(_U)
    return (np.sort(key << _U(width) | np.arange(n, dtype=_U)) & _U((1 << width) - 1)).astype(np.int64)


def shallow_sort(eight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``SHALLOW`` bytes, and where a place differs from the one before.

    A multikey sort: each level takes as many bytes more as can be packed with the group and the place in 64 bits,
    and goes on with the groups of several suffixes only.
    """
    order, new = np.arange(len(starts)), np.zeros(len(starts), bool)
    new[0] = True
    open_, depth = order.copy(), 0
    while depth < SHALLOW and len(open_):
        group = np.cumsum(new[open_] | np.concatenate([[True], open_[1:] != open_[:-1] + 1])) - 1
        taken = min(SHALLOW - depth, max(1, (63 - int(group[-1]).bit_length() - len(open_).bit_length()) // 8))
        chars = eight[starts[order[open_]] + depth] >> _U(8 * (8 - taken)) if taken < 8 else eight[starts[order[open_]] + depth]
        by = sort_packed(group, chars)
        order[open_] = order[open_][by]
        chars = chars[by]
        differs = np.concatenate([[False], (chars[1:] != chars[:-1]) | (group[1:] != group[:-1])])
        new[open_] |= differs
        depth += taken
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone[open_]]
    return order, new


def deep_shallow_sort(buffer: bytes, starts: np.ndarray, length: int = LENGTH, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): windows of ``length`` bytes in order, and the rank that equal ones share.

    Shallow: a multikey sort by two characters of 8 bytes. Deep: a group with more in common is compared with its
    first member, what differs with the first of those, and so on; after ``rounds`` a blind trie orders the rest.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = np.frombuffer(buffer, np.uint8)
    two = b[:-1].astype(np.uint16) << 8 | b[1:]
    four = two[:-2].astype(np.uint32) << 16 | two[2:]
    eight = four[:-4].astype(_U) << _U(32) | four[4:]
    offsets = [*range(SHALLOW, length - 7, 8), *([length - 8] if length % 8 else [])]
    order, new = shallow_sort(eight, starts)
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    at = starts[order]
    # Class of each window within its group: the number of the member that it equals.
    member = np.arange(len(order)) - first[group]
    cls = np.where(sizes[group] == 1, 0, -1)
    for _ in range(rounds):
        open_ = np.flatnonzero(cls < 0)
        if not len(open_):
            break
        head_at = open_[np.concatenate([[True], group[open_[1:]] != group[open_[:-1]]])]
        head = np.full(len(first), -1)
        head[group[head_at]] = head_at
        mine = head[group[open_]]
        same = np.ones(len(open_), bool)
        for o in offsets:
            same &= eight[at[open_] + o] == eight[at[mine] + o]
        cls[open_[same]] = member[mine[same]]
    for g in np.unique(group[cls < 0]):
        low, high = first[g], first[g] + sizes[g]
        rest = low + np.flatnonzero(cls[low:high] < 0)
        cut_ = [buffer[s + SHALLOW : s + length] for s in at[rest].tolist()]
        trie = BlindTrie(cut_[0])
        leaf = np.array([trie.insert(s) for s in cut_])
        firsts = {int(x): int(member[rest[k]]) for k, x in reversed(list(enumerate(leaf.tolist())))}
        cls[rest] = [firsts[x] for x in leaf.tolist()]
    # Order within a group: the first members of its classes by the rest of their strings, all groups at once.
    heads = np.flatnonzero(member == cls)
    by = np.arange(len(heads))
    if len(heads) > len(first):
        by = np.lexsort((*(eight[at[heads] + o] for o in reversed(offsets)), group[heads]))
    rank_of = np.empty(len(order), np.int64)
    rank_of[heads[by]] = np.arange(len(heads))
    place = rank_of[first[group] + cls]
    if len(heads) > len(first):
        final = np.argsort(place, kind="stable")
        order, place = order[final], place[final]
    return order, np.cumsum(np.concatenate([[True], place[1:] != place[:-1]])) - 1


PACKED = "key long, kind int, shard long, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _TYPES, strict=True)], names=_NAMES)


def _split(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(key, arrays) for each key."""
    order = sort_packed(key)
    ordered = key[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]])
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if high > low:
            yield (int(ordered[low]), *(x[order[low:high]] for x in arrays))


def _anchors(length: int, buckets: int, hot_at: int):
    """Step 1: kind 0 has hashes, doc_ids and places (-1: a witness of a hot anchor); kind 1 has hot candidates."""

    def send(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h)
        h, doc, place = h[order], doc[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(first, len(h)))
        hot = np.repeat(sizes > hot_at, sizes)
        rows = []
        if hot.any():
            for key, d, p in _split(doc[hot] % buckets, doc[hot], place[hot]):
                rows.append((key, 1, None, pack(d), pack((-1 - p).astype(np.int32)), None, None))
            of_hot = np.flatnonzero(sizes > hot_at)
            ends = [pick.reduceat(doc, first)[of_hot] for pick in (np.minimum, np.maximum)]
            h = np.concatenate([h[~hot], h[first[of_hot]], h[first[of_hot]]])
            doc, place = np.concatenate([doc[~hot], *ends]), np.concatenate([place[~hot], np.full(2 * len(of_hot), -1)])
        for key, x, d, p in _split((h % _U(buckets)).astype(np.int64), h, doc, place):
            marks = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 2:]
            rows.append((key, 0, None, marks.T.tobytes(), pack(d), pack(p.astype(np.int32)), None))
        for at in range(0, len(rows), 64):
            yield _batch(rows[at : at + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), [(t.as_py() or "").encode() for t in batch.column(1)]
            for of, place, h in find_anchors(texts, length):
                held.append((h, ids[of], place))
                n += len(h)
                if n >= FLUSH:
                    yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _candidates(shards: int, hot_at: int):
    """Step 2: doc_ids and places of anchors that two documents have, for each shard; hot ones as -1 - place."""

    def run(table: pa.Table) -> pa.Table:
        kinds, rows = table["kind"].to_pylist(), []
        a, b, c = (table[x].to_pylist() for x in "abc")
        doc = [unpack(a[i], np.int64) for i, k in enumerate(kinds) if k == 1]
        place = [unpack(b[i], np.int32) for i, k in enumerate(kinds) if k == 1]
        own = [i for i, k in enumerate(kinds) if k == 0]
        if own:
            marks = np.concatenate([np.frombuffer(a[i], np.uint8).reshape(6, -1).T for i in own])
            h = np.zeros((len(marks), 8), np.uint8)
            h[:, 2:] = marks
            h = h.view(_U).ravel()
            d = np.concatenate([unpack(b[i], np.int64) for i in own])
            p = np.concatenate([unpack(c[i], np.int32) for i in own])
            order = np.argsort(h)
            h, d, p = h[order], d[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(first, len(h)))
            hot = np.logical_or.reduceat(p < 0, first) | (sizes > 4 * hot_at)
            as_doc = np.minimum(d, OWN_IDS)
            several = np.minimum.reduceat(as_doc, first) != np.maximum.reduceat(as_doc, first)
            keep = np.repeat(several, sizes) & (p >= 0)
            doc.append(d[keep])
            place.append(np.where(np.repeat(hot, sizes)[keep], -1 - p[keep], p[keep]))
        if doc:
            doc, place = np.concatenate(doc), np.concatenate(place).astype(np.int32)
            for key, d, p in _split(doc % shards, doc, place):
                rows.append((key, 0, key, pack(d), pack(p), None, None))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return table["id"].to_numpy(), [(t or "").encode() for t in table["text"].to_pylist()]


def _copies(table: pa.Table) -> dict[int, set[bytes]]:
    """Digests of the texts by which rows of a tracking id are copies of smaller documents."""
    found: dict[int, set[bytes]] = {}
    for kind, ids, digests in zip(table["kind"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
        if kind == 2:
            for i, x in enumerate(unpack(ids, np.int64).tolist()):
                found.setdefault(x, set()).add(digests[16 * i : 16 * i + 16])
    return found


def _variants(ids: np.ndarray, texts: list[bytes], copies: dict[int, set[bytes]]) -> list[int]:
    """For each row of a shard the number of its text among those of its id, or -1 if it is a copy.

    The numbers follow the order of digests, so that both steps that see a shard's rows come to the same ones.
    """
    out = [0] * len(texts)
    once, counts = np.unique(ids, return_counts=True)
    again = set(once[counts > 1].tolist())
    digests = {i: md5(texts[i]).digest() for i, x in enumerate(ids.tolist()) if x in copies or x in again}
    of_id: dict[int, set[bytes]] = {}
    for i, digest in digests.items():
        of_id.setdefault(int(ids[i]), set()).add(digest)
    ranks = {x: {digest: k for k, digest in enumerate(sorted(own))} for x, own in of_id.items()}
    for i, digest in digests.items():
        x = int(ids[i])
        out[i] = -1 if digest in copies.get(x, ()) else ranks[x][digest]
    return out


def _contexts(length: int, buckets: int):
    """Step 3: kind 0 has runs (number, smallest doc_id, size, bytes) for a bucket; kind 1 where a shard's runs are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, rows = right["kind"].to_pylist(), []
        shard = (left["shard"] if len(left) else right["shard"])[0].as_py()
        a, b = right["a"].to_pylist(), right["b"].to_pylist()
        own = [i for i, k in enumerate(kinds) if k == 0]
        if own and len(left):
            ids, texts = _texts(left)
            variants = _variants(ids, texts, _copies(right))
            doc = np.concatenate([unpack(a[i], np.int64) for i in own])
            place = np.concatenate([unpack(b[i], np.int32) for i in own]).astype(np.int64)
            with_any = set(np.unique(doc).tolist())
            # Repeated rows count once: what goes from one of them goes from all.
            at = list({(x, v): i for i, (x, v) in enumerate(zip(ids.tolist(), variants, strict=True)) if v >= 0 and x in with_any}.values())
            ids, texts, variants = ids[at], [texts[i] for i in at], [variants[i] for i in at]
            found = list(find_anchors(texts, length))
            if found:
                of, anchor, h = (np.concatenate(x) for x in zip(*found, strict=True))
                first, last = runs(of, anchor, h, np.array([len(t) for t in texts]), length)
                # Which anchors are candidates, and which of them hot.
                _, number_of = np.unique(np.concatenate([ids, doc]), return_inverse=True)
                mine = (number_of[: len(ids)][of] << 32) + anchor
                known = np.sort((number_of[len(ids) :] << 33) + (np.where(place < 0, -1 - place, place) << 1) + (place < 0))
                where = np.minimum(np.searchsorted(known, mine << 1), len(known) - 1)
                keep = (known[where] >> 1 == mine) & (first <= last)
                of, first, last, h, hot = of[keep], first[keep], last[keep], h[keep], (known[where[keep]] & 1).astype(bool)
                numbers: dict[bytes, int] = {}
                bucket, least = [], []
                records, own_ids = [], ids.tolist()
                for i, f, t, x, wide in zip(of.tolist(), first.tolist(), last.tolist(), (h % _U(buckets)).tolist(), hot.tolist(), strict=True):
                    text, d = texts[i], own_ids[i]
                    as_doc, variant = min(d, OWN_IDS), variants[i] << 8
                    for s, n in ((s, 1) for s in range(f, t + 1)) if wide else ((f, t - f + 1),):
                        said = text[s : s + n + length - 1]
                        number = numbers.setdefault(said, len(numbers))
                        if number == len(bucket):
                            bucket.append(crc32(said) % buckets if wide else x)
                            least.append(as_doc)
                        elif as_doc < least[number]:
                            least[number] = as_doc
                        records.append((d, s, number, variant | n))
                strings, least = list(numbers), np.array(least, np.int64)
                for key, which in _split(np.array(bucket, np.int64), np.arange(len(bucket))):
                    picked = [strings[k] for k in which.tolist()]
                    rows.append((key, 0, shard, pack(which.astype(np.int32)), pack(least[which]), pack(np.array([len(s) for s in picked], np.int16)), b"".join(picked)))
                d, s, number, n = (np.array(x) for x in zip(*records, strict=True)) if records else [np.empty(0, np.int64)] * 4
                rows.append((shard % buckets, 1, shard, pack(d), pack(s.astype(np.int32)), pack(number.astype(np.int32)), pack(n.astype(np.int32))))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _repeats(length: int):
    """Step 4: for each shard the stretches (run, first window, windows) that a smaller document has; kind 1 passes."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        own = [i for i, k in enumerate(kinds) if k == 0]
        rows = [tuple(r[x] for x in _NAMES) for r in table.filter(pa.array([k == 1 for k in kinds])).to_pylist()]
        if own:
            a, b, c, d = (table[x].to_pylist() for x in "abcd")
            shards = table["shard"].to_pylist()
            number = np.concatenate([unpack(a[i], np.int32) for i in own])
            least = np.concatenate([unpack(b[i], np.int64) for i in own])
            size = np.concatenate([unpack(c[i], np.int16) for i in own]).astype(np.int64)
            shard = np.repeat([shards[i] for i in own], [len(c[i]) // 2 for i in own])
            # Runs with the same bytes are sorted once, with the smallest doc_id of all.
            kinds_of: dict[bytes, int] = {}
            kind = []
            for i in own:
                raw, at = d[i], 0
                for n in unpack(c[i], np.int16).tolist():
                    kind.append(kinds_of.setdefault(raw[at : at + n], len(kinds_of)))
                    at += n
            kind = np.array(kind)
            first_of = np.full(len(kinds_of), NO_ID)
            np.minimum.at(first_of, kind, least)
            buffer, length_of = b"".join(kinds_of), np.fromiter(map(len, kinds_of), np.int64, len(kinds_of))
            del kinds_of
            windows = length_of - length + 1
            of = np.repeat(np.arange(len(length_of)), windows)
            k = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            order, rank = deep_shallow_sort(buffer, np.repeat(np.cumsum(length_of) - length_of, windows) + k, length)
            first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            smallest = np.minimum.reduceat(first_of[of[order]], first)[rank]
            gone = np.zeros(len(of), bool)
            gone[order] = smallest < first_of[of[order]]
            begins = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (of[1:] != of[:-1])]))
            ends = np.flatnonzero(gone & np.concatenate([~gone[1:] | (of[1:] != of[:-1]), [True]]))
            # A run with a larger doc_id than another of the same bytes goes whole, the first one by its stretches.
            whole = np.flatnonzero(least > first_of[kind])
            firsts = np.flatnonzero(least == first_of[kind])
            low, high = np.searchsorted(of[begins], kind[firsts], "left"), np.searchsorted(of[begins], kind[firsts], "right")
            some = np.repeat(firsts, high - low)
            which = np.arange(len(some)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            runs_, froms = np.concatenate([whole, some]), np.concatenate([np.zeros(len(whole), np.int64), k[begins][which]])
            counts = np.concatenate([size[whole] - length + 1, (ends - begins + 1)[which]])
            for key, w, f, n in _split(shard[runs_], runs_, froms, counts):
                rows.append((key, 0, key, pack(number[w]), pack(f.astype(np.int16)), pack(n.astype(np.int16)), None))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _removed(length: int):
    """Step 5: the texts of a shard without what is covered."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right["kind"].to_pylist()
        a, b, c, d = (right[x].to_pylist() for x in "abcd")
        spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if 1 in kinds:
            at = kinds.index(1)
            doc, start, number, n = unpack(a[at], np.int64), unpack(b[at], np.int32).astype(np.int64), unpack(c[at], np.int32), unpack(d[at], np.int32).astype(np.int64)
            # A row is its id's place among the ids and the number of its text; 8 bits of n are the windows.
            own, row = np.unique(doc, return_inverse=True)
            row, n, doc = row << 24 | n >> 8, n & 255, np.minimum(doc, OWN_IDS)
            least = np.full(int(number.max(initial=-1)) + 1, NO_ID)
            np.minimum.at(least, number, doc)
            whole = doc > least[number]
            docs, low, high = [row[whole]], [start[whole]], [start[whole] + n[whole] - 1 + length]
            parts = [(unpack(a[i], np.int32), unpack(b[i], np.int16), unpack(c[i], np.int16)) for i, k in enumerate(kinds) if k == 0]
            if parts:
                run_, first, m = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
                order = np.argsort(run_, kind="stable")
                run_, first, m = run_[order], first[order], m[order]
                mine = np.flatnonzero(~whole)
                begin, end = np.searchsorted(run_, number[mine], "left"), np.searchsorted(run_, number[mine], "right")
                rec = np.repeat(mine, end - begin)
                which = np.arange(len(rec)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
                docs.append(row[rec])
                low.append(start[rec] + first[which])
                high.append(start[rec] + first[which] + m[which] - 1 + length)
            docs, low, high = np.concatenate(docs), np.concatenate(low), np.concatenate(high)
            for key, x, y in _split(docs, low, high):
                spans[int(own[key >> 24]), key & 0xFFFFFF] = (x, y)
        out = []
        ids, texts = _texts(left) if len(left) else (np.empty(0, np.int64), [])
        for i, variant, text in zip(ids.tolist(), _variants(ids, texts, _copies(right)), texts, strict=True):
            size = len(text)
            if variant < 0:
                out.append((size, size, 1, b""))
            elif (i, variant) in spans:
                x, y = spans[i, variant]
                depth = np.bincount(x, minlength=size + 1)[: size + 1] - np.bincount(y, minlength=size + 1)[: size + 1]
                gone = np.cumsum(depth)[:size] > 0
                begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((size, int(gone.sum()), begins, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            else:
                out.append((size, 0, 0, text))
        values = list(zip(*out, strict=True)) if out else [[]] * 4
        columns = [pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
        doc_id = left["doc_id"].combine_chunks() if len(left) else pa.array([], pa.int64())
        return pa.Table.from_arrays([doc_id, *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, length: int = LENGTH, unit_bytes: int = UNIT_BYTES, hot_at: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    * A null text counts as empty; texts shorter than ``length`` bytes are kept whole and are not shuffled.
    * Rows with the same doc_id are one document: they never remove each other's bytes, whatever their texts are, and
      meet in one task as one document does. Repeated rows get the same result.
    * Null doc_ids (and those of ``OWN_IDS`` or more) count as one document, the largest; their rows are dealt by text.
    * Very long texts are hashed in pieces, but each must fit in a task's memory a few times.
    * What is kept may end within a character, so it is binary. Other columns are not looked at.
    * An empty table gives an empty result.
    """
    if length < GRAM + 4:
        raise ValueError(f"length must be {GRAM + 4} at least")
    doc_id, own = F.col("doc_id").cast("long"), F.lit(OWN_IDS) + F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.when(doc_id < OWN_IDS, doc_id).otherwise(own)).withColumn("size", F.octet_length("text"))
    short, rows = rows.filter(F.col("size") < length), rows.filter(F.col("size") >= length)
    digests = cut(rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "size"))
    total = digests.agg(F.sum("size")).first()[0] or 0
    shards = buckets = _prime(max(37, -(-total // unit_bytes)))

    as_doc = F.least("id", F.lit(OWN_IDS))
    originals = cut(digests.groupBy("digest").agg(F.min(as_doc).alias("original"), F.max(as_doc).alias("last")).filter("last > original"))
    copies = digests.join(originals, "digest").filter(as_doc > F.col("original")).select("id", "digest")

    def pack_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            yield _batch([(key, 2, key, pack(x), b"".join(own[k] for k in at.tolist()), None, None) for key, x, at in _split(ids % shards, ids, np.arange(len(ids)))])

    copied = cut(copies.distinct().mapInArrow(pack_copies, PACKED))
    texts = rows.select("doc_id", "id", "text").withColumn("shard", F.pmod("id", F.lit(shards)))

    found = rows.select("id", "text").mapInArrow(_anchors(length, buckets, hot_at), PACKED)
    found = cut(found.groupBy("key").applyInArrow(_candidates(shards, hot_at), PACKED)).union(copied)
    release(docs.sparkSession)  # the packed anchors are not needed any more
    said = texts.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_contexts(length, buckets), PACKED)
    gone = said.groupBy("key").applyInArrow(_repeats(length), PACKED).union(copied)
    cleaned = texts.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    return cleaned.union(short.select("doc_id", F.col("size").cast("long"), none, none, F.col("text").cast("binary")))
