"""Benchmark decontamination by suffix arrays over the documents' words.

The documents are read in shards (what one task holds at a time). A shard's suffix array orders its word positions by the
words that follow; every suffix of the benchmark is looked up in it by binary search, which gives all places of its
window, and neighbouring hits join to the longest verbatim matches with their places in item and document.

Before sorting, words that cannot lie in a match are dropped exactly: a window's every two adjacent words are adjacent
somewhere in the benchmark, so only runs of such pairs as long as the shortest window are kept.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, quoted, slabs, text_bytes, tune

WINDOW = 10
#: Words of the benchmark that one pass over the documents holds; a larger benchmark takes several passes
BLOCK_WORDS = 1_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LETTER = np.zeros(256, bool)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _LETTER[_low:_high] = True


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters; A-Z count as a-z."""
    return _WORD.findall((text or "").encode().lower())


@dataclass
class Needles:
    """One block of the benchmark: words as numbers, items one after another with -1 between them."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    stream: np.ndarray = None
    item_of: np.ndarray = None
    item_start: np.ndarray = None
    #: Start in the stream and length of every window
    at: np.ndarray = None
    length: np.ndarray = None


def needles(rows: list[tuple[str, str | None]], window: int) -> Needles:
    """Every run of ``window`` words of an item, and every shorter item as a whole."""
    block, stream, item_of, starts, at, length = Needles(), [], [], [], [], []
    for item, text in rows:
        found = words_of(text)
        if not found:
            continue
        number = len(block.items)
        block.items.append(item)
        starts.append(len(stream))
        size = min(window, len(found))
        for i in range(len(found) - size + 1):
            at.append(len(stream) + i)
            length.append(size)
        stream += [block.vocabulary.setdefault(word, len(block.vocabulary)) for word in found] + [-1]
        item_of += [number] * (len(found) + 1)
    block.stream, block.item_of, block.item_start = (np.array(x, np.int64) for x in (stream, item_of, starts))
    block.at, block.length = np.array(at, np.int64), np.array(length, np.int64)
    return block


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as far as asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < count:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            size = max(count, 1 << 16)
            cls.up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, _BASE))))
            cls.down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, inverse))))
        return cls.up, cls.down


def _hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word."""
    up, down = Powers.to(len(chars) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:len(chars)])))
    value = (sums[ends] - sums[starts]) * down[starts]
    return value ^ (value >> np.uint64(31))


class Shard:
    """Matches of one block of the benchmark in some texts."""

    def __init__(self, block: Needles):
        self.block = block
        words = sorted(block.vocabulary, key=block.vocabulary.get)
        joined = b"".join(words)
        ends = np.cumsum([len(word) for word in words], dtype=np.int64)
        starts = ends - np.array([len(word) for word in words], np.int64)
        hashes = _hashes(np.frombuffer(joined, np.uint8), starts, ends) if words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int64)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.base = max(1, len(words)) + 1
        stream = block.stream
        inside = np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0)) if len(stream) else np.zeros(0, np.int64)
        self.pairs = np.unique(stream[inside] * self.base + stream[inside + 1])
        self.shortest = int(block.length.min()) if len(block.length) else 0
        self.depth = int(block.length.max()) if len(block.length) else 0

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """Per text the number of words, and the matches: text, word in the text, item, word in the item, words."""
        chars = np.append(np.insert(ascii_lower()[data], offsets[:-1], np.uint8(32)), np.uint8(32))
        places = offsets + np.arange(len(offsets))
        edge = np.diff(_LETTER[chars].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        first = np.searchsorted(starts, places)
        counts = np.diff(first)
        none = [np.zeros(0, np.int64)] * 5
        if not len(starts) or not len(self.block.at):
            return counts, none
        ids = self._numbers(chars, starts, ends)
        text = np.repeat(np.arange(len(counts)), counts)
        kept = self._runs(ids, text)
        if not len(kept):
            return counts, none
        # Exact words: a hash that only looks like a word of the benchmark becomes a word of no item
        raw, vocabulary = chars.tobytes(), self.block.vocabulary
        exact = np.array([vocabulary.get(raw[a:b], -2) for a, b in zip(starts[kept].tolist(), ends[kept].tolist())], np.int64)
        broken = np.flatnonzero((np.diff(kept) > 1) | (np.diff(text[kept]) > 0)) + 1
        haystack, origin = np.insert(exact, broken, -2), np.insert(kept, broken, -1)
        order = suffix_array(haystack, self.depth)
        at, place = self._windows(haystack, order)
        return counts, self._matches(at, origin[place], text, first)

    def _numbers(self, chars, starts, ends):
        """Each word's number in the benchmark, -2 for other words."""
        hashes = _hashes(chars, starts, ends)
        ids = np.full(len(hashes), -2, np.int64)
        maybe = np.flatnonzero(self.coarse[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[slot] == hashes[maybe]
        ids[maybe[same]] = self.numbers[slot[same]]
        return ids

    def _runs(self, ids, text):
        """Words that lie in a run of benchmark words and pairs as long as the shortest window."""
        known = np.flatnonzero(ids >= 0)
        if self.shortest == 1:
            return known
        joined = known[:-1][(np.diff(known) == 1) & (text[known[:-1]] == text[known[1:]])]
        code = ids[joined] * self.base + ids[joined + 1]
        slot = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        joined = joined[self.pairs[slot] == code] if len(self.pairs) else joined[:0]
        if not len(joined):
            return joined
        cut = np.flatnonzero(np.diff(joined) > 1) + 1
        begins, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(joined)]))
        long = stops - begins >= self.shortest - 1
        lengths = stops[long] - begins[long] + 1
        return np.repeat(joined[begins[long]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

    def _windows(self, haystack, order):
        """Every place of every window: the window's number and the place in the haystack."""
        block = self.block
        low = _bound(haystack, order, block.stream, block.at, block.length, False)
        high = _bound(haystack, order, block.stream, block.at, block.length, True)
        found = high - low
        at = np.repeat(np.arange(len(found)), found)
        rank = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
        return at, order[rank]

    def _matches(self, window, word, text, first):
        """Windows side by side in the same item and text, joined to the longest matches."""
        block = self.block
        start, length = block.at[window], block.length[window]
        slant = word - start
        order = np.lexsort((start, slant, block.item_of[start]))
        start, word, length, slant = start[order], word[order], length[order], slant[order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = ((np.diff(start) != 1) | (np.diff(slant) != 0) | (np.diff(block.item_of[start]) != 0)
                     | (np.diff(text[word]) != 0))
        begins = np.flatnonzero(fresh)
        last = np.concatenate((begins[1:], [len(start)])) - 1 if len(begins) else begins
        item = block.item_of[start[begins]]
        return [text[word[begins]], word[begins] - first[text[word[begins]]], item, start[begins] - block.item_start[item],
                start[last] - start[begins] + length[last]]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` words that follow them, by doubling of ranks; the end sorts first."""
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    sorted_to = 1
    while sorted_to < depth:
        after = np.zeros(len(rank), np.int64)
        after[:max(0, len(rank) - sorted_to)] = rank[sorted_to:]
        _, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        sorted_to *= 2
    return np.argsort(rank, kind="stable")


def _bound(haystack, order, stream, at, length, upper: bool) -> np.ndarray:
    """Binary search of all windows at once: the first suffix not below the window, or (``upper``) the first above it."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    padded = np.append(haystack, np.full(int(length.max()), -3, np.int64))
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) // 2
        place, want, size = order[middle], at[live], length[live]
        sign, open_ = np.zeros(len(live), np.int64), np.arange(len(live))
        for j in range(int(size.max())):
            difference = padded[place[open_] + j] - stream[want[open_] + j]
            sign[open_] = np.sign(difference)
            open_ = open_[(difference == 0) & (j + 1 < size[open_])]
            if not len(open_):
                break
        right = (sign <= 0) if upper else (sign < 0)
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]


MATCH = "struct<item:string,item_at:bigint,doc_at:bigint,words:bigint>"
SCHEMA = f"id {{}}, text string, n_words bigint, matches array<{MATCH}>"


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", *, window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``id``, ``n_words`` and ``matches``: the maximal verbatim matches of at least ``window`` words, or of a whole shorter item.

    A match has its item (as a string), the first word's place in item and document, and its length in words. Null or wordless
    texts have no words; null or wordless items, and items without an id, match nothing; an item listed twice is two items of
    one id. Every document row gives one row. The benchmark is held ``block_words`` words at a time, one narrow pass over the
    documents for each block.
    """
    tune(docs.sparkSession)
    narrow = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    result = None
    for block in benchmark_blocks(benchmark, item_column, item_text_column, window, block_words):
        result = _pass(narrow if result is None else result, block, kind, result is None)
    return result.drop("text")


def benchmark_blocks(
    benchmark: DataFrame, item_column: str, text_column: str, window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> Iterator[Needles]:
    """The benchmark, about ``block_words`` words at a time."""
    items = benchmark.select(quoted(item_column).cast("string").alias("item"), quoted(text_column).alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL")
    # A word and the gap after it take two characters or more
    size = items.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    blocks = int(size // block_words) + 1
    part = F.pmod(F.xxhash64("item"), F.lit(blocks))
    for number in range(blocks):
        rows = [tuple(row) for row in items.where(part == number).orderBy("item", "text").collect()]
        yield needles(rows, window)


def _pass(docs: DataFrame, block: Needles, kind: str, first_pass: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(block))
    match = pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())])

    def run(batches):
        shard = Shard(Needles(**shared.value))
        names = pa.array(shard.block.items, pa.string())
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            counts, found = [], []
            for begin, end in slabs(offsets):
                part = offsets[begin:end + 1] - offsets[begin]
                words, matches = shard.search(data[offsets[begin]:offsets[end]], part)
                counts.append(words)
                found.append([matches[0] + begin, *matches[1:]])
            columns = [np.concatenate(parts) for parts in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
            text, doc_at, item, item_at, words = (column[order] for column in columns)
            values = pa.StructArray.from_arrays(
                [names.take(pa.array(item)), pa.array(item_at), pa.array(doc_at), pa.array(words)], fields=list(match))
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), values)
            total = np.concatenate(counts) if counts else np.zeros(batch.num_rows, np.int64)
            kept = [batch.column(0), batch.column(1), pa.array(total.astype(np.int64))]
            if not first_pass:
                # Matches of earlier blocks come along as the last column
                before = batch.column(3)
                lists = pa.array([(a or []) + b for a, b in zip(before.to_pylist(), lists.to_pylist())], pa.list_(match))
            yield pa.RecordBatch.from_arrays([*kept, lists], ["id", "text", "n_words", "matches"])

    return docs.mapInArrow(run, SCHEMA.format(kind))


def hit_words(matches) -> object:
    """How many of a document's words lie in a match, as a Column over ``matches``."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_at"].alias("a"), (m["doc_at"] + m["words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("to"))
    return F.aggregate(
        spans, start,
        lambda acc, span: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), span["b"] - F.greatest(span["a"], acc["to"]))).alias("hit"),
            F.greatest(acc["to"], span["b"]).alias("to")),
        lambda acc: acc["hit"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
    *, window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs``, all columns as they are, without the rows whose text holds a window of the benchmark."""
    tune(docs.sparkSession)
    place = docs.columns.index(text_column)
    for block in benchmark_blocks(benchmark, item_column, item_text_column, window, block_words):
        docs = _without(docs, block, place)
    return docs


def _without(docs: DataFrame, block: Needles, place: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(block))

    def run(batches):
        shard = Shard(Needles(**shared.value))
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            clean = np.ones(batch.num_rows, bool)
            for begin, end in slabs(offsets):
                _, matches = shard.search(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])
                clean[matches[0] + begin] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
