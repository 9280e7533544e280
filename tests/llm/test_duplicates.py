"""Near and exact duplicates against brute force: fingerprints, embeddings, lines, substrings, components."""
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelspark.llm import embeddings, lines, sais, simhash, substrings
from reelspark.llm.common import Scratch
from reelspark.llm.components import connected_components

WORDS = "the of and river stone tree cloud light water fire road house north south east west apple pear plum".split()


def grouped(nodes, links):
    """The smallest node that each node reaches."""
    least = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def corpus(seed, count=60):
    """Texts with exact copies, near copies, shared passages, empties, nulls and a long text."""
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))
    base, passage, line = [make(40) for _ in range(6)], make(14), make(11)
    texts = [None, "", "  \n ", "One", "Näïve ÉTUDE 東京 text"]
    while len(texts) < count:
        pick = rng.random()
        if pick < 0.25:
            texts.append(rng.choice(base))
        elif pick < 0.5:
            words = rng.choice(base).split()
            words[rng.randrange(len(words))] = make(1)
            texts.append(" ".join(words))
        elif pick < 0.75:
            texts.append(make(20) + "\n" + rng.choice([passage, line]) + "\n" + make(12))
        else:
            words = line.split()
            edit = rng.choice(["drop", "add", "swap"])
            at = rng.randrange(len(words))
            words[at:at + (edit != "add")] = [] if edit == "drop" else [make(1)]
            texts.append(make(9) + "\n" + " ".join(words))
    texts.append(make(3000))
    return [(i * 3 % 1000, text, f"s{i % 3}") for i, text in enumerate(texts)]


def frame(spark, rows):
    # Columns whose names clash with those the operators use inside
    return spark.createDataFrame([(*row, 7, "x") for row in rows], "doc_id long, text string, source string, n int, line string")


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("seed,tile,blocks", [(1, 1024, None), (2, 4, 5), (3, 4, 7)])
def test_simhash_groups(spark, monkeypatch, seed, tile, blocks):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = corpus(seed)
    prints = {i: plain_simhash(text) for i, text, _ in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    least = grouped(ids, links)
    got = {(r.id, r.fingerprint & (2**64 - 1), r.component) for r in simhash.simhash_groups(frame(spark, rows), blocks=blocks).collect()}
    assert got == {(i, prints[i], least[i]) for i in ids} and links
    kept = {r.doc_id for r in simhash.keep_first(frame(spark, rows), blocks=blocks).collect()}
    assert kept == set(least.values())


def test_simhash_block_keys_find_every_close_pair():
    rng = random.Random(5)
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_masks(blocks, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any((a ^ b) & mask % 2**64 == 0 for mask in masks)


def test_simhash_edges(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, None), (9, None)]
    got = sorted((r.id is None, r.id or 0, r.component) for r in simhash.simhash_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [(False, 4, 4), (False, 4, 4), (False, 9, 9), (True, 0, 4), (True, 0, 9)]


def test_simhash_keeps_one_row_of_a_group(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words are here"), (None, "other words are here"),
            (3, "x y z u v w"), (3, "x y z u v w"), (5, "x y z u v w"), (None, "x y z u v w"), (3, "a text of its own")]
    kept = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[4], rows[8]], key=str)


def test_components_of_chains_stars_and_nothing(spark):
    scratch = Scratch(spark, "test")
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 4)]
    random.Random(3).shuffle(links)
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", scratch).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", scratch).count() == 0


def vectors(seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, 24))
    rows = [(i, (centers[i % 4] + rng.normal(size=24) * (0.05 if i % 3 else 0.5)).tolist()) for i in range(90)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, None), (203, []), (204, [0.0] * 24), (205, [1.0, None]), (206, [float("nan")] * 24),
             (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [-0.0, 1.0]), (210, [0.0, 1.0]), (211, [float("inf"), 1.0])]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    rows = vectors(4)
    good = {i: np.array(v, float) for i, v in rows
            if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    cosine = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and cosine(good[a], good[b]) >= 0.9]
    least = grouped([i for i, _ in rows], links)
    count = {i: sum(i in link for link in links) for i, _ in rows}
    got = {tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(i, count[i], least[i], least[i] == i) for i, _ in rows}
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_extreme_lengths(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=8)
    rows = [(n, (near + rng.normal(scale=0.01, size=8)).tolist()) for n in range(3)] + [(3, (-near).tolist())]
    long, short = [[(n, (np.array(v) * scale).tolist()) for n, v in rows] for scale in (1e200, 1e-170)]
    for these in (rows, long, short, [rows[0], long[1], short[2], (3, (-near * 1e-300).tolist())]):
        got = {tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(these, "vec_id long, embedding array<double>")).collect()}
        assert got == {(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(200, 40))
    units = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    whole, scale, error = embeddings.quantise(units)
    assert np.abs(whole).max() <= 127
    near = (whole * scale[:, None]) @ (whole * scale[:, None]).T
    reach = np.sqrt((whole.astype(float) ** 2).sum(axis=1)) * scale
    assert (np.abs(units @ units.T - near) <= error[:, None] * reach + error + 1e-9).all()


def within_one(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1:] == y for i in range(len(x)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_lines(spark, seed):
    rows = sorted(corpus(seed))
    first = {}
    for i, text, _ in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = tuple(line.encode().split())
            if words:
                first.setdefault(words, (i, n))
    earliest = dict(first)
    long = [words for words in first if len(words) >= lines.FUZZY_WORDS]
    close = 0
    for x in long:
        for y in long:
            if x != y and within_one(x, y):
                earliest[x] = min(earliest[x], first[y])
                close += 1
    want = {}
    for i, text, _ in rows:
        kept = [line for n, line in enumerate((text or "").split("\n"))
                if not (words := tuple(line.encode().split())) or earliest[words] >= (i, n)]
        want[i] = None if text is None else "\n".join(kept)
    out = lines.dedup_lines(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "n", "line"]
    assert {r.doc_id: r.text for r in out.collect()} == want and close


def test_lines_edges(spark):
    schema = "doc_id long, text string"
    assert lines.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(2, "same\n\nsame"), (None, "same\nown"), (1, None), (5, ""), (2, "same\n\nsame")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, schema)).collect() if r.text is not None)
    assert got == [(False, 2, "same\n"), (False, 2, "same\n"), (False, 5, ""), (True, 0, "own")]


def test_lines_of_rows_that_share_an_id(spark):
    near = "one two three four five six seven eight {}"
    rows = [
        (None, "a\nb\nc\na"), (None, "d\ne\nf\ng"), (None, "h\na\ni\n" + near.format("x")), (None, "j\nk\nl\nm"), (None, "same\nn"), (None, "same\no"),
        (7, "p\nq\np"), (7, "r\ns\nt"), (7, "u\nv\n" + near.format("y"))]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    kept = [(r.doc_id, line) for r in out.collect() for line in r.text.split("\n")]
    # Of each line one is left, at the smallest id; every clean line stays
    assert sorted(line for _, line in kept) == sorted([*"abcdefghijklmnopqrstuv", "same", near.format("y")])
    assert out.count() == len(rows) and (7, near.format("y")) in kept


def test_suffix_arrays_match_sorting():
    rng = np.random.default_rng(1)
    for turn in range(200):
        size, letters = int(rng.integers(0, 160)), int(rng.choice([1, 2, 3, 26, 256]))
        text = rng.integers(0, letters, size).astype(np.uint8)
        text = np.tile(text, 3) if turn % 3 == 0 else text
        raw = text.tobytes()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        order = sais.suffix_array(text)
        assert order.tolist() == want
        shared = sais.common_prefixes(text, order, 20)
        for a, b in zip(want, want[1:]):
            same = next((k for k in range(20) if raw[a + k:a + k + 1] != raw[b + k:b + k + 1] or b + k >= len(raw) or a + k >= len(raw)), 20)
            assert shared[b] == same


def plain_substrings(rows, length=50):
    ordered, seen = sorted(rows, key=lambda row: row[0]), {}
    for i, text, _ in ordered:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            seen.setdefault(raw[k:k + length], i)
    out = set()
    for i, text, _ in ordered:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if seen[raw[k:k + length]] < i:
                gone[k:k + length] = [True] * length
        runs = [(k, next((e for e in range(k, len(raw)) if not gone[e]), len(raw))) for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.add((i, len(raw), tuple(runs), hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed,pack,hot", [(1, 1 << 22, 4096), (2, 900, 4096), (3, 900, 6)])
def test_substrings(spark, monkeypatch, seed, pack, hot):
    monkeypatch.setattr(substrings, "PACK_BYTES", pack)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 8 * pack)
    monkeypatch.setattr(substrings, "SORTED_BYTES", 2000)
    monkeypatch.setattr(substrings, "HOT_PLACES", hot)
    rows = corpus(seed)
    got = {(r.id, r.n_bytes, tuple((s.start, s.end) for s in r.removed), hashlib.sha256(r.kept).hexdigest())
           for r in substrings.dedup_substrings(frame(spark, rows)).collect()}
    assert got == plain_substrings(rows)


def test_substrings_edges(spark):
    schema = "doc_id long, text string"
    assert substrings.dedup_substrings(spark.createDataFrame([], schema)).count() == 0
    text = "x" * 70
    rows = [(3, text), (3, text), (None, text), (8, "x" * 50), (9, "x" * 49)]
    got = sorted((r.id is None, r.id or 0, len(r.kept)) for r in substrings.dedup_substrings(spark.createDataFrame(rows, schema)).collect())
    assert got == [(False, 3, 70), (False, 3, 70), (False, 8, 0), (False, 9, 49), (True, 0, 0)]


def test_a_column_with_dots(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, `text.raw` string").withColumn("u", F.lit(1))
    assert {r.component for r in simhash.simhash_groups(df, text_column="text.raw").collect()} == {1}
