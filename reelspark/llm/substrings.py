"""Exact substring deduplication with suffix arrays of shards.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. Three steps, over packs of
documents that a task holds whole:

1. *Anchors.* In every window of ``length`` bytes, the ``GRAM``-byte substring of least hash is its anchor. Equal windows have equal
   anchors, so only windows whose anchor occurs in two documents can repeat. Consecutive windows with one anchor are a segment.
2. *Shards.* The segments whose anchor is shared go to shards by anchor, so that equal windows meet. Equal segments are sent once
   a pack and sorted once a shard. A shard's suffix array comes from induced sorting; neighbouring windows whose permuted common
   prefix reaches ``length`` are one group, and the group's smallest document decides.
3. *Removal.* The verdicts go back to their packs, where overlapping windows join to spans.

An anchor found very often goes window by window instead of segment by segment, spread over all shards by the windows' hashes, so
no anchor's contexts ever gather in one task.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, quoted, text_bytes
from .sais import common_prefixes, suffix_array

LENGTH = 50
GRAM = 20
#: Bytes of text in a pack, of text behind one anchor bucket, and of segments in one suffix array
PACK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
SORTED_BYTES = 1 << 20
#: Places of an anchor, all packs together, from which its windows go one by one
HOT_PLACES = 4_096
#: Windows whose hashes are looked at together
SLIDE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = np.iinfo(np.int64).max


def _powers(count: int, cache={}) -> tuple[np.ndarray, np.ndarray]:
    if cache.get("n", 0) < count:
        size, inverse = max(count, 1 << 16), np.uint64(pow(int(_BASE), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        cache["up"] = np.multiply.accumulate(np.concatenate((one, np.full(size, _BASE))))
        cache["down"] = np.multiply.accumulate(np.concatenate((one, np.full(size, inverse))))
        cache["n"] = size
    return cache["up"], cache["down"]


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(29))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a byte string."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        wide = data.astype(np.uint64)
        wide += np.uint64(1)
        wide *= up[:len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(wide, out=self.sums[1:])

    def of(self, starts, lengths) -> np.ndarray:
        return _mixed((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        value = self.sums[length:] - self.sums[:-length]
        value *= self.down[:len(value)]
        return _mixed(value)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: text, first window, number of windows, and the anchor's hash; with the :class:`Hashes`."""
    hashes = Hashes(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), hashes
    grams = hashes.all(gram)
    span, anchors = length - gram + 1, []
    for at in range(0, len(grams) - span + 1, SLIDE):
        # The hash's high half, then the place: the leftmost of the least
        part = grams[at:at + SLIDE + span - 1] & np.uint64(0xFFFFFFFF00000000)
        part |= np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            part = np.minimum(part[:-width], part[width:])
            width *= 2
        if span > width:
            part = np.minimum(part[:len(part) - (span - width)], part[span - width:])
        anchors.append((part & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
    anchor = np.concatenate(anchors)
    # Windows that reach into the next text do not count
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    window = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    window += np.arange(len(window))
    own = anchor[window]
    del anchor
    fresh = np.ones(len(window), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(window)))
    return text[first], window[first], counts, grams[own[first]], hashes


class Pack:
    """Some whole documents: ids, and texts end to end."""

    def __init__(self, ids: bytes, offsets: bytes, packed: bytes, length: int, gram: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.frombuffer(offsets, np.int64)
        self.length = length
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8) if packed else np.zeros(0, np.uint8)
        self.text, self.first, self.count, self.anchor, self.hashes = segments(self.data, self.offsets, length, gram)

    def places(self):
        """The distinct anchors of the pack, their places, and whether they lie in two documents."""
        order = np.argsort(self.anchor, kind="stable")
        anchor, ids = self.anchor[order], self.ids[self.text[order]]
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        at = np.flatnonzero(fresh)
        if not len(at):
            return anchor, np.zeros(0, np.int64), np.zeros(0, bool)
        low, high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
        return anchor[at], np.diff(np.append(at, len(anchor))), low != high

    def sent(self, shared: np.ndarray, hot: np.ndarray, shards: int):
        """What goes to the shards: distinct pieces, and the piece of every shared segment or window.

        Returns the pieces' shard, route, first byte, bytes and smallest id, and for each occurrence its piece, text and first window.
        """
        distinct, _, local = self.places()
        known = np.union1d(distinct[local], shared)
        chosen = np.flatnonzero(np.isin(self.anchor, known, kind="sort"))
        is_hot = np.isin(self.anchor[chosen], hot, kind="sort")
        whole, cut = chosen[~is_hot], chosen[is_hot]
        counts = self.count[cut]
        windows = np.repeat(self.first[cut] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        first = np.concatenate((self.first[whole], windows))
        size = np.concatenate((self.count[whole], np.ones(len(windows), np.int64))) + self.length - 1
        text = np.concatenate((self.text[whole], np.repeat(self.text[cut], counts)))
        content = self.hashes.of(first, size)
        route = np.concatenate((self.anchor[whole], content[len(whole):]))
        order = np.lexsort((content, route))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (route[order[1:]] != route[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
        piece = np.empty(len(order), np.int64)
        piece[order] = np.cumsum(fresh) - 1
        at = np.flatnonzero(fresh)
        ids = np.minimum.reduceat(self.ids[text[order]], at) if len(at) else np.zeros(0, np.int64)
        lead = order[at]
        shard = ((route[lead] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        return (shard, route[lead], first[lead], size[lead], ids), (piece, text, first, size)


def _contents(joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each piece, a byte of all pieces at a time: pieces are short, and there are many."""
    value = np.zeros(len(starts), np.uint64)
    for at in range(int(sizes.max()) if len(sizes) else 0):
        live = np.flatnonzero(sizes > at)
        value[live] = value[live] * _BASE + joined[starts[live] + at] + np.uint64(1)
    return _mixed(value)


def settle(routes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, joined: np.ndarray, length: int) -> np.ndarray:
    """For each window of the pieces, in order: whether it also starts in a document with a smaller id than its piece's.

    ``joined`` holds the pieces end to end. Pieces are sorted by route and taken about ``SORTED_BYTES`` at a time, a route's together.
    """
    windows = sizes - length + 1
    starts, marks = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    # Within a route, equal pieces lie together: one of them is sorted, with the smallest id
    content = _contents(joined, starts, sizes)
    order = np.lexsort((ids, content, routes))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (routes[order[1:]] != routes[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
    lead = order[np.flatnonzero(fresh)]
    leader = np.empty(len(order), np.int64)
    leader[order] = lead[np.cumsum(fresh) - 1]
    begin = 0
    reach = np.cumsum(sizes[lead])
    while begin < len(lead):
        done = reach[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(reach, done + SORTED_BYTES, "right")))
        while end < len(lead) and routes[lead[end]] == routes[lead[end - 1]]:
            end += 1
        _settle_sorted(lead[begin:end], starts, sizes, windows, marks, ids, joined, length, out)
        begin = end
    # The others of equal pieces: what their leader's windows say, or all if their own document comes later
    others = np.flatnonzero(leader != np.arange(len(leader)))
    counts = windows[others]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    later = np.repeat(ids[others] > ids[leader[others]], counts)
    out[np.repeat(marks[others], counts) + within] = later | out[np.repeat(marks[leader[others]], counts) + within]
    return out


def _settle_sorted(chosen, starts, sizes, windows, marks, ids, joined, length, out):
    counts = sizes[chosen]
    source = np.repeat(starts[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    text = joined[source]
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    piece = np.repeat(chosen, counts)
    valid = within < windows[piece]
    order = suffix_array(text)
    order = order[valid[order]]
    prefix = common_prefixes(text, order, length)
    fresh = prefix[order] < length
    fresh[:1] = True
    group = np.cumsum(fresh) - 1
    owner = ids[piece[order]]
    least = np.minimum.reduceat(owner, np.flatnonzero(fresh))
    out[marks[piece[order]] + within[order]] = least[group] < owner


def _sorted_runs(df: DataFrame, key: str, columns: list[str], schema: str, done):
    """Rows of one key after another, all of a key's rows given to ``done``, which yields record batches."""
    ordered = df.select(key, *columns).repartition(key).sortWithinPartitions(key, *[c for c in columns if c == "kind"])

    def run(batches):
        held, current = [], None
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, name in enumerate(names):
                if name != current:
                    if held:
                        yield from done(current, held)
                    held, current = [], name
                held.append([batch.column(c)[i].as_py() for c in range(1, 1 + len(columns))])
        if held:
            yield from done(current, held)

    return ordered.mapInArrow(run, schema)


def _pack(docs: DataFrame) -> DataFrame:
    """Documents in packs of about ``PACK_BYTES``, each with a number of its own."""

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        pack = zstandard.ZstdCompressor(level=3).compress

        def done():
            lengths = np.array([len(text) for _, text in held], np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([np.array([i for i, _ in held], np.int64).tobytes()], pa.binary()),
                pa.array([np.concatenate(([0], np.cumsum(lengths))).astype(np.int64).tobytes()], pa.binary()),
                pa.array([pack(b"".join(text for _, text in held))], pa.binary())], ["pack", "ids", "offsets", "packed"])

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw, ids = data.tobytes(), batch.column(0).fill_null(_NO_ID).to_pylist()
            for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                held.append((i, raw[a:b]))
                size += b - a + 16
                if size >= PACK_BYTES:
                    yield done()
                    number, held, size = number + 1, [], 0
        if held:
            yield done()

    return docs.mapInArrow(run, "pack bigint, ids binary, offsets binary, packed binary")


def _packs_of(batches, length, gram):
    for batch in batches:
        for i in range(batch.num_rows):
            number, ids, offsets, packed = (batch.column(c)[i].as_py() for c in range(4))
            yield batch, i, number, Pack(ids, offsets, packed, length, gram)


def _anchors(packs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """The distinct anchors of each pack, by bucket of their hash."""

    def run(batches):
        for _, _, number, pack in _packs_of(batches, length, gram):
            anchors, places, _ = pack.places()
            bucket = (anchors % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, anchors[order[s:e]], np.minimum(places[order[s:e]], HOT_PLACES)) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
            press = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([
                pa.array([b for b, _, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()),
                pa.array([a.tobytes() for _, a, _ in rows], pa.binary()),
                pa.array([press(p.astype(np.uint16).tobytes()) for _, _, p in rows], pa.binary())], ["bucket", "pack", "anchors", "places"])

    return packs.mapInArrow(run, "bucket bigint, pack bigint, anchors binary, places binary")


def _shared_anchors(anchors: DataFrame) -> DataFrame:
    """For each pack and bucket, its anchors that other packs have too, and those found very often anywhere."""

    def done(bucket, rows):
        unpack = zstandard.ZstdDecompressor().decompress
        values = [np.frombuffer(row[1], np.uint64) for row in rows]
        places = np.concatenate([np.frombuffer(unpack(row[2]), np.uint16) for row in rows]).astype(np.int64)
        sizes = np.array([len(v) for v in values])
        owner, value = np.repeat(np.arange(len(rows)), sizes), np.concatenate(values)
        order = np.argsort(value, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = value[order[1:]] != value[order[:-1]]
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(order)))
        hot = np.repeat(np.add.reduceat(places[order], at) >= HOT_PLACES, times)
        shared = np.repeat(times > 1, times)
        chosen = order[shared | hot]
        is_hot = hot[shared | hot]
        turn = np.argsort(owner[chosen], kind="stable")
        chosen, is_hot = chosen[turn], is_hot[turn]
        edges = np.searchsorted(owner[chosen], np.arange(len(rows) + 1))
        some = [i for i in range(len(rows)) if edges[i + 1] > edges[i]]
        part = [slice(edges[i], edges[i + 1]) for i in some]
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in some], pa.int64()),
            pa.array([value[chosen[p]].tobytes() for p in part], pa.binary()),
            pa.array([value[chosen[p][is_hot[p]]].tobytes() for p in part], pa.binary())], ["pack", "shared", "hot"])

    return _sorted_runs(anchors, "bucket", ["pack", "anchors", "places"], "pack bigint, shared binary, hot binary", done)


def _with_anchors(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """Packs with their shared and hot anchors as lists of arrays."""
    listed = shared.groupBy(F.col("pack").alias("__pack")).agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot"))
    return packs.join(listed, F.col("pack") == F.col("__pack"), "left").select("pack", "ids", "offsets", "packed", "shared", "hot")


def _sent(batch, i, pack: Pack, shards: int):
    shared, hot = (np.unique(np.frombuffer(b"".join(batch.column(c)[i].as_py() or []), np.uint64)) for c in (4, 5))
    return pack.sent(shared, hot, shards)


def _pieces(packs: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """The distinct pieces of each pack, by shard."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for batch, i, number, pack in _packs_of(batches, length, gram):
            (shard, route, first, size, ids), _ = _sent(batch, i, pack, shards)
            order, out = np.argsort(shard, kind="stable"), []
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[s]:edges[s + 1]]
                # In the order of the text, where neighbours overlap and compress well
                counts = size[own]
                source = np.repeat(first[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                head = np.concatenate((route[own].view(np.int64), counts, ids[own])).tobytes()
                out.append((s, len(own), press(head), press(pack.data[source].tobytes())))
            yield pa.RecordBatch.from_arrays([
                pa.array([row[0] for row in out], pa.int64()), pa.array([number] * len(out), pa.int64()),
                pa.array([row[1] for row in out], pa.int64()), pa.array([row[2] for row in out], pa.binary()),
                pa.array([row[3] for row in out], pa.binary())], ["shard", "pack", "pieces", "head", "body"])

    return packs.mapInArrow(run, "shard bigint, pack bigint, pieces bigint, head binary, body binary")


def _verdicts(pieces: DataFrame, length: int) -> DataFrame:
    """For each pack and shard, one bit per window of its pieces."""

    def done(shard, rows):
        unpack = zstandard.ZstdDecompressor().decompress
        heads = [np.frombuffer(unpack(row[2]), np.int64).reshape(3, -1) for row in rows]
        joined = np.frombuffer(b"".join(unpack(row[3]) for row in rows), np.uint8)
        routes, sizes, ids = (np.concatenate([head[k] for head in heads]) for k in range(3))
        bits = settle(routes, sizes, ids, joined, length)
        per_row = [int((head[1] - length + 1).sum()) for head in heads]
        edges = np.concatenate(([0], np.cumsum(per_row)))
        yield pa.RecordBatch.from_arrays([
            pa.array([row[0] for row in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()),
            pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["pack", "shard", "bits"])

    return _sorted_runs(pieces, "shard", ["pack", "pieces", "head", "body"], "pack bigint, shard bigint, bits binary", done)


def _removed(packs: DataFrame, verdicts: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    listed = verdicts.groupBy(F.col("pack").alias("__pack")).agg(F.collect_list(F.struct("shard", "bits")).alias("bits"))
    judged = packs.join(listed, F.col("pack") == F.col("__pack"), "left").drop("__pack")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, i, _, pack in _packs_of(batches, length, gram):
            (shard, _, _, size, ids), (piece, text, first, _) = _sent(batch, i, pack, shards)
            windows = size - length + 1
            marks = np.cumsum(windows) - windows
            flags = np.zeros(int(windows.sum()), bool)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for row in batch.column(6)[i].as_py() or []:
                own = order[edges[row["shard"]]:edges[row["shard"] + 1]]
                counts = windows[own]
                target = np.repeat(marks[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                flags[target] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:len(target)].astype(bool)
            # Windows of all places of a piece: the piece's verdict, or gone if an earlier document of the pack has the piece too
            counts = windows[piece]
            at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            mark = np.repeat(marks[piece] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            gone = at[flags[mark] | np.repeat(pack.ids[text] > ids[piece], counts)]
            change = np.zeros(len(pack.data) + length + 1, np.int32)
            np.add.at(change, gone, 1)
            np.add.at(change, gone + length, -1)
            covered = np.cumsum(change[:len(pack.data)]) > 0
            yield _documents(pack, covered, span)

    return judged.mapInArrow(run, "id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")


def _documents(pack: Pack, covered: np.ndarray, span) -> pa.RecordBatch:
    kept, spans = [], []
    for a, b in zip(pack.offsets[:-1].tolist(), pack.offsets[1:].tolist()):
        own = covered[a:b]
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            kept.append(pack.data[a:b][~own].tobytes())
        else:
            spans.append([])
            kept.append(pack.data[a:b].tobytes())
    ids = pa.array(pack.ids, mask=pack.ids == _NO_ID)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(pack.offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])


def dedup_substrings(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, length: int = LENGTH, gram: int = GRAM,
) -> DataFrame:
    """``id``, ``n_bytes``, ``removed`` (maximal runs of bytes, end exclusive) and ``kept`` (the remaining bytes) of every row.

    Texts count as UTF-8 bytes, null texts as empty; matches do not cross documents and are judged on the input. The id is an
    integer; a null id comes after all others. Rows that repeat an id are one document to each other: neither is smaller. Texts
    shorter than ``length`` keep everything.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    narrow = docs.select(quoted(id_column).cast("bigint").alias("id"), quoted(text_column).alias("text"))
    packs = scratch.keep(_pack(narrow), "packs")
    total = packs.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    # Compressed bytes, about a third of the text's
    buckets = max(1, round(3 * total / BUCKET_BYTES))
    shared = scratch.keep(_shared_anchors(_anchors(packs, buckets, length, gram)), "anchors")
    known = _with_anchors(packs, shared)
    pieces = _pieces(known, buckets, length, gram)
    verdicts = scratch.keep(_verdicts(pieces, length), "verdicts")
    return _removed(known, verdicts, buckets, length, gram)
