r"""Repeated byte strings across documents, by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id. Strings are
dealt out by content: the smallest hash of the seeds inside a string is its anchor, so equal strings have equal
anchors. Neighbouring strings with one anchor form a segment.

1. Per chunk of documents, the distinct anchors are sorted and packed; per bucket of anchors those of two or more
   documents are found, and each chunk learns which of its own are.
2. Per chunk, segments with such anchors go to shards by anchor, equal ones once with their smallest id.
3. Per shard, the parts of distinct segments that others may share go through a transform, which is expanded
   breadth-first: the interval of a string gives those of the string with one more character in front, and each
   interval that ends at a new place marks there the length of the common prefix. Prefixes come by increasing length, and at ``LENGTH`` the expansion stops: what is unmarked
   agrees in ``LENGTH`` bytes. Each class of equal strings gets its smallest id, and chunks learn where that is
   smaller than their own.
4. Per chunk, the documents are cut.

A string that very many documents share is one segment per chunk, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.arrow import ragged, text_buffer
from lakecheck.llm.words import BYTE_VALUE, range_hashes

LENGTH = 50
#: Bytes of a seed; a string has ``LENGTH - SEED + 1`` of them.
SEED = 24
#: Bytes of documents in numpy at once.
STEP_BYTES = 1 << 18
CHUNK_BYTES = 2 << 20
#: Input bytes per bucket of anchors and per shard, places within a shard, and bytes of segments in one transform.
BUCKET_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
FINE = 256
TRANSFORM_BYTES = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)
NO_ID = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    kinds = "".join(x.dtype.str.rjust(4) for x in arrays).encode()
    return b"".join([head.tobytes(), kinds, *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    kinds = data[8 + 8 * n : 8 + 12 * n].decode()
    ends = 8 + 12 * n + np.cumsum(sizes)
    return [np.frombuffer(data[e - s : e], kinds[4 * i : 4 * i + 4].strip()) for i, (s, e) in enumerate(zip(sizes, ends))]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 48-bit values by their differences, in 32 bits where these fit."""
    steps = np.diff(values, prepend=np.uint64(0))
    wide = steps >= 2**32
    return pack(np.where(wide, 0, steps).astype(np.uint32), np.flatnonzero(wide), steps[wide])


def unpack_sorted(data: bytes) -> np.ndarray:
    small, at, large = unpack(data)
    steps = small.astype(np.uint64)
    steps[at] = large
    return np.cumsum(steps, dtype=np.uint64)


# ---- anchors and segments -----------------------------------------------------------------------


@dataclass
class Segments:
    """Runs of strings of a byte buffer that share an anchor: first and last string, document, 48-bit anchor, 64-bit key of the bytes."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    key: np.ndarray

    def take(self, keep: np.ndarray) -> Segments:
        return Segments(*(x[keep] for x in (self.first, self.last, self.doc, self.anchor, self.key)))


_NONE = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2


def segments(data: np.ndarray, offsets: np.ndarray) -> Segments:
    """All segments of the documents; worked out for about ``STEP_BYTES`` of documents at a time."""
    found, start = [_NONE], 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + STEP_BYTES, side="right")) - 1
        stop = max(stop, start + 1)
        first, last, doc, anchor, key = _segments(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        found.append((first + offsets[start], last + offsets[start], doc + start, anchor, key))
        start = stop
    return Segments(*map(np.concatenate, zip(*found)))


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    lengths = np.diff(offsets)
    whole = np.flatnonzero(lengths >= LENGTH)
    if not len(whole):
        return _NONE
    data = np.ascontiguousarray(data)
    hashes = seed_hashes(data)
    least, at, width, seeds = hashes, np.arange(len(hashes), dtype=np.int32), 1, LENGTH - SEED + 1
    while width < seeds:
        shift = min(width, seeds - width)
        later = least[shift:] < least[:-shift]
        at = np.where(later, at[shift:], at[:-shift])
        least = np.where(later, least[shift:], least[:-shift])
        width += shift
    place = ragged(offsets[whole], lengths[whole] - LENGTH + 1)
    at = at[place]
    begin = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1))))
    first, last = place[begin], place[np.append(begin[1:], len(place)) - 1]
    doc = np.searchsorted(offsets, first, side="right") - 1
    return first, last, doc, hashes[at[begin]] >> np.uint64(16), range_hashes(BYTE_VALUE[data], first, last + LENGTH)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes from each position on, read as 64-bit words at every offset."""
    n = len(data) - SEED + 1
    out = np.zeros(n, np.uint64)
    for at, factor in zip(range(0, SEED, 8), _FACTORS):
        out += np.ndarray((n,), "<u8", data, at, (1,))
        out *= factor
        out ^= out >> np.uint64(29)
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().fill_null(NO_ID))


def _buffer(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).combine_chunks()
    return text_buffer(column)


def _place(anchors: np.ndarray, n: int) -> np.ndarray:
    """Bucket or shard of sorted or unsorted anchors, by their leading bits."""
    return ((anchors >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _anchors_of_chunk(n: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        ids, (data, offsets) = _ids(docs["doc_id"]), _buffer(docs["text"])
        found = segments(data, offsets)
        order = np.argsort(found.anchor, kind="stable")
        anchors, owners = found.anchor[order], ids[found.doc[order]]
        begin = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1]))) if len(anchors) else np.empty(0, np.int64)
        distinct = anchors[begin]
        several = np.minimum.reduceat(owners, begin) != np.maximum.reduceat(owners, begin) if len(begin) else np.empty(0, bool)
        bucket = _place(distinct, n)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, int)
        return pa.table(
            {
                "bucket": pa.array([int(bucket[a]) for a in cuts[:-1]], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * (len(cuts) - 1), pa.int32()),
                "anchors": pa.array([pack_sorted(distinct[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                "several": pa.array([pack(np.flatnonzero(several[a:b]).astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            }
        )

    return run


def _repeated_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    chunks = np.asarray(rows["chunk"])
    lists = [unpack_sorted(x) for x in rows["anchors"].to_pylist()]
    anchors = np.concatenate(lists)
    several = np.zeros(len(anchors), bool)
    begin = np.cumsum([0, *map(len, lists)])
    for at, marked in zip(begin, rows["several"].to_pylist()):
        several[at + unpack(marked)[0]] = True
    order = np.argsort(anchors, kind="stable")
    ranked = anchors[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.append(start, len(ranked)))
    often = (size > 1) | np.logical_or.reduceat(several[order], start)
    mark = np.empty(len(anchors), bool)
    mark[order] = np.repeat(often, size)
    out = [(int(c), x[mark[a : a + len(x)]]) for c, a, x in zip(chunks, begin, lists)]
    out = [(c, x) for c, x in out if len(x)]
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "anchors": pa.array([pack_sorted(x) for _, x in out], pa.binary())})


SEGMENTS = "chunk int, shard int, segments binary"


def _repeated_segments(shards: int):
    """Per shard the chunk's distinct segments with a repeated anchor: keys, smallest owners, lengths, fine places and bytes."""

    def run(key: tuple, docs: pa.Table, repeated: pa.Table) -> pa.Table:
        chunk, rows = key[0].as_py(), []
        ids, (data, offsets) = _ids(docs["doc_id"]), _buffer(docs["text"])
        lists = [unpack_sorted(x) for x in repeated["anchors"].to_pylist()]
        known = np.sort(np.concatenate(lists)) if lists else np.empty(0, np.uint64)
        found = segments(data, offsets)
        at = np.minimum(np.searchsorted(known, found.anchor), max(len(known) - 1, 0))
        found = found.take(known[at] == found.anchor if len(known) else np.zeros(len(at), bool))
        owners = ids[found.doc]
        order = np.lexsort((owners, found.key))
        ranked = found.key[order]
        pick = order[np.concatenate(([True], ranked[1:] != ranked[:-1]))] if len(order) else order
        fine = _place(found.anchor[pick], shards * FINE)
        by_shard = np.argsort(fine, kind="stable")
        pick, fine = pick[by_shard], fine[by_shard]
        shard = fine // FINE
        lengths = found.last[pick] + LENGTH - found.first[pick]
        body = data[ragged(found.first[pick], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            packed = pack(found.key[pick[a:b]], owners[pick[a:b]], lengths[a:b].astype(np.uint8), (fine[a:b] % FINE).astype(np.uint8), body[ends[a] : ends[b]])
            rows.append({"chunk": chunk, "shard": int(shard[a]), "segments": packed})
        return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("segments", pa.binary())]))

    return run


# ---- transform and expansion --------------------------------------------------------------------


#: Bits of a value in the first sorting key, and values in it; values are bytes moved up by one.
VALUE_BITS, SEVERAL = 9, 4


def sorting_order(key: np.ndarray) -> np.ndarray:
    """Stable order of unsigned keys. Small keys are sorted together with their positions, which is much faster."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 64:
        return np.argsort(key, kind="stable")
    return (np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of parts that end at ``ends`` with a 0, where the comparison stops; other values are from 1 to 256.

    Suffixes that are equal up to the end of their parts stand in order of position. Ranks by the first few values
    are doubled in reach until no part is longer.
    """
    n, depth = len(text), SEVERAL
    padded = np.concatenate((text, np.zeros(depth, text.dtype))).astype(np.uint64)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key |= np.where(left > k, padded[k : n + k], 0).astype(np.uint64) << np.uint64(VALUE_BITS * (SEVERAL - 1 - k))
    rank, longest = np.empty(n, np.int64), int(left.max(initial=0))
    while True:
        order = sorting_order(key)
        ranked = key[order]
        step = ranked[1:] != ranked[:-1]
        rank[order] = np.concatenate(([0], np.cumsum(step)))
        if depth >= longest or step.all():
            return order
        beyond = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > depth)
        beyond[inside] = rank[inside + depth] + 1
        key = (rank * np.int64(n + 2) + beyond).astype(np.uint64)
        depth *= 2


def common_prefix_marks(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place between neighbours of ``order`` (place ``i``: before suffix ``i``) whether they differ within ``least`` values.

    Breadth-first expansion of intervals by backward steps: round ``k`` marks the places where the common prefix has
    length ``k``. Every 0 of ``text`` counts as a value of its own.
    """
    n = len(text)
    before = text[order - 1]  # the part before the first one is the last one
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    zero = before == 0
    back[zero] = row[order[zero] - 1]
    marks = np.zeros(n + 1, bool)
    marks[0] = marks[n] = True
    begin, size = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        rows = ragged(begin, size)
        parent = np.repeat(np.arange(len(begin)), size)
        to = back[rows]
        sort = sorting_order(to.astype(np.uint64))
        to, parent, value = to[sort], parent[sort], before[rows[sort]]
        new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (value[1:] != value[:-1]) | (value[1:] == 0)))
        first = np.flatnonzero(new)
        starts, ends = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~marks[ends]
        marks[ends[fresh]] = True
        begin, size = starts[fresh], (ends - starts)[fresh]
        if not len(begin):
            break
    return marks[:n]


def smallest_owners(bodies: np.ndarray, lengths: np.ndarray, owners: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """For each string of ``least`` bytes of each part, part after part, the smallest owner of a part that has it."""
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.uint16)
    place = ragged(ends - lengths, lengths)
    text[place] = bodies.astype(np.uint16) + 1
    order = suffix_order(text, ends)
    marks = common_prefix_marks(text, order, least)
    part = np.repeat(np.arange(len(lengths)), lengths + 1)
    begin = np.flatnonzero(marks)
    smallest = np.minimum.reduceat(owners[part[order]], begin)
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(smallest, np.diff(np.append(begin, len(text))))
    return out[ragged(ends - lengths, lengths - least + 1)]


def smallest_of_repeated(bodies: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """``smallest_owners`` of distinct segments; strings whose hash occurs once among them stay out of the transform.

    Of a passage that many documents share, the segments at its ends reach into text of their own; only what they
    have in common is left.
    """
    begin, strings = np.cumsum(lengths) - lengths, lengths - LENGTH + 1
    start, values = ragged(begin, strings), BYTE_VALUE[bodies]
    hashes = range_hashes(values, start, start + LENGTH)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    repeated = np.zeros(len(start), bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    out = np.repeat(owners, strings)
    some = np.flatnonzero(repeated)
    if not len(some):
        return out
    part = np.repeat(np.arange(len(lengths)), strings)[some]
    new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (start[some][1:] != start[some][:-1] + 1))))
    end = np.append(new[1:], len(some))
    first, last, owner = start[some[new]], start[some[end - 1]], owners[part[new]]
    keys = range_hashes(values, first, last + LENGTH)
    order = np.lexsort((owner, keys))
    fresh = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    pick = order[fresh]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(fresh) - 1
    size = last[pick] + LENGTH - first[pick]
    smallest = smallest_owners(bodies[ragged(first[pick], size)], size, owner[pick])
    at = np.concatenate(([0], np.cumsum(size - LENGTH + 1)))
    out[some] = smallest[ragged(at[group], end - new)]
    return out


ANSWER = "chunk int, answers binary"


def _answers(key: tuple, rows: pa.Table) -> pa.Table:
    """Per chunk the segments in which some string has an owner smaller than the chunk's own: key, runs of start, length and owner."""
    parts = [unpack(x) for x in rows["segments"].to_pylist()]
    keys, owners, lengths, fine, bodies = (np.concatenate(x) for x in zip(*parts))
    lengths = lengths.astype(np.int64)
    chunk = np.repeat(np.asarray(rows["chunk"]), [len(p[0]) for p in parts])
    order = np.lexsort((owners, keys, fine))
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    pick = order[first]
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    at = np.cumsum(lengths) - lengths
    # equal strings have one anchor and so one fine place: transforms are made for some places at a time
    size, smallest, start = np.cumsum(lengths[pick]), [], 0
    edges = np.flatnonzero(np.concatenate((fine[pick][1:] != fine[pick][:-1], [True]))) + 1
    while start < len(pick):
        done = size[start - 1] if start else 0
        enough = np.searchsorted(size[edges - 1], done + TRANSFORM_BYTES)
        stop = int(edges[min(enough, len(edges) - 1)])
        some = pick[start:stop]
        smallest.append(smallest_of_repeated(bodies[ragged(at[some], lengths[some])], lengths[some], owners[some]))
        start = stop
    smallest = np.concatenate(smallest)
    strings = lengths[pick] - LENGTH + 1
    owner_of = np.repeat(np.arange(len(pick)), strings)
    place = ragged(np.zeros(len(pick), np.int64), strings)
    change = np.flatnonzero(np.concatenate(([True], (smallest[1:] != smallest[:-1]) | (owner_of[1:] != owner_of[:-1]))))
    run_group, run_start, run_owner = owner_of[change], place[change], smallest[change]
    run_length = np.diff(np.append(change, len(smallest)))
    runs_at = np.concatenate(([0], np.cumsum(np.bincount(run_group, minlength=len(pick)))))
    out = []
    for c in np.unique(chunk):
        mine = np.flatnonzero(chunk == c)
        count = np.diff(runs_at)[group[mine]]
        runs = ragged(runs_at[group[mine]], count)
        of = np.repeat(mine, count)
        smaller = run_owner[runs] < owners[of]
        if smaller.any():
            runs, of = runs[smaller], of[smaller]
            out.append((int(c), pack(keys[of], run_start[runs].astype(np.uint8), run_length[runs].astype(np.uint8), run_owner[runs])))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "answers": pa.array([x for _, x in out], pa.binary())})


CUT = "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string"
_CUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string())]
)


def _removed(found: Segments, n_bytes: int, ids: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """Which bytes of the chunk go."""
    hit = np.zeros(n_bytes + 1, np.int32)
    if not len(found.first):
        return hit[:-1] > 0

    def cover(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(hit, first, 1)
        np.add.at(hit, last + LENGTH, -1)

    owners = ids[found.doc]
    # the smallest owner that a segment has in this chunk is not sent back
    order = np.lexsort((owners, found.key))
    ranked = found.key[order]
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    own = np.empty(len(order), np.int64)
    own[order] = np.repeat(owners[order[new]], np.diff(np.append(new, len(order))))
    whole = np.flatnonzero(own < owners)
    cover(found.first[whole], found.last[whole])
    if answers:
        keys, start, length, owner = (np.concatenate(x) for x in zip(*map(unpack, answers)))
        rank = np.argsort(keys, kind="stable")
        keys, start, length, owner = keys[rank], start[rank].astype(np.int64), length[rank].astype(np.int64), owner[rank]
        low, high = np.searchsorted(keys, found.key), np.searchsorted(keys, found.key, side="right")
        runs, of = ragged(low, high - low), np.repeat(np.arange(len(found.key)), high - low)
        smaller = owner[runs] < owners[of]
        runs, of = runs[smaller], of[smaller]
        first = found.first[of] + start[runs]
        cover(first, first + length[runs] - 1)
    return np.cumsum(hit[:-1]) > 0


def _cut(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return _CUT.empty_table()
    ids, (data, offsets) = _ids(docs["doc_id"]), _buffer(docs["text"])
    gone = _removed(segments(data, offsets), len(data), ids, answers["answers"].to_pylist())
    kept, kept_at = data[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))
    rows = []
    for i, a, b in zip(docs["doc_id"].to_pylist(), offsets[:-1], offsets[1:]):
        edge = np.diff(np.concatenate(([False], gone[a:b], [False])).astype(np.int8))
        rows.append(
            {
                "doc_id": i, "n_bytes": int(b - a), "n_removed": int(gone[a:b].sum()), "starts": np.flatnonzero(edge == 1), "ends": np.flatnonzero(edge == -1),
                "kept_sha256": hashlib.sha256(kept[kept_at[a] : kept_at[b]]).hexdigest(),
            }
        )
    return pa.Table.from_pylist(rows, _CUT)


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, starts, ends, kept_sha256``, one row per input row.

    Texts are UTF-8 bytes; NULL is empty. Strings are judged on the input and never cross documents. A NULL id is
    larger than all others and not smaller than another NULL; rows of one id do not remove each other's bytes, nor
    does a document its own. Texts under ``LENGTH`` bytes lose nothing. ``starts`` and ``ends`` bound the removed
    runs in bytes. An empty table gives no rows; other columns are not read. Ids must be whole numbers. Segments are
    told apart by 64-bit hashes.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, buckets, shards = (int(max(1, -(-total // size))) for size in (chunk_bytes, BUCKET_BYTES, SHARD_BYTES))
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    anchors = dealt.groupBy("chunk").applyInArrow(_anchors_of_chunk(buckets), "bucket int, chunk int, anchors binary, several binary")
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated_anchors, "chunk int, anchors binary")
    found = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_repeated_segments(shards), SEGMENTS)
    answers = found.groupBy("shard").applyInArrow(_answers, ANSWER)
    # the chunks are dealt out once: all three passes over the documents read one exchange
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut, CUT)
