"""The pipeline against plain Python, stage by stage on each stage's own input."""
import re

import numpy as np
import xxhash

import corpus_pipeline
from oracle import DATA
from reelspark.llm import lines, toxicity
from reelspark.llm.queries import fold, table
from test_duplicates import within_one

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), None if name == "mixing" else docs.schema)
        rows[name] = before, {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns + ["mix_copies"] * (name == "mixing") and rows[name][1]
    before, after = rows["toxicity"]
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels").where(fold(5) != 0))
    bad = {r.id for r in toxicity.score(table(spark, SF, "documents"), model).collect() if r.predicted == 1}
    assert set(after) == set(before) - bad
    before, after = rows["line dedup"]
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in after.values())
    first = {}
    for i in sorted(before):
        for n, line in enumerate(before[i].text.split("\n")):
            if words := tuple(line.encode().split()):
                first.setdefault(words, (i, n))
    earliest, by_size = dict(first), {}
    for words in first:
        by_size.setdefault(len(words), []).append(words)
    for size in (size for size in by_size if size >= lines.FUZZY_WORDS):
        for x in by_size[size]:
            for y in by_size[size] + by_size.get(size + 1, []):
                if x != y and within_one(x, y):
                    earliest[x], earliest[y] = min(earliest[x], first[y]), min(earliest[y], first[x])
    for i in before:
        assert after[i].text == "\n".join(
            line for n, line in enumerate(before[i].text.split("\n"))
            if not (words := tuple(line.encode().split())) or earliest[words] >= (i, n))
    before, after = rows["SimHash near-dedup"]
    prints = {}
    for i, row in before.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text.translate({c: c + 32 for c in range(65, 91)}))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {i: i for i in prints}
    ids, bits = np.array(sorted(prints)), None
    bits = np.array([prints[i] for i in ids], np.uint64)
    for _ in range(20):
        for k, i in enumerate(ids):
            near = ids[np.bitwise_count(bits ^ bits[k]) <= 4]
            low = min(least[j] for j in near)
            for j in near:
                least[j] = low
    assert set(after) == {int(v) for v in least.values()}
    before, after = rows["benchmark decontamination"]
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[k:k + 10]) for r in table(spark, SF, "benchmark").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    hit = {i for i, r in before.items() if any(tuple(w[k:k + 10]) in windows for w in [words(r.text)] for k in range(len(w) - 9))}
    assert set(after) == set(before) - hit
    before, after = rows["mixing"]
    assert set(after) <= set(before) and all(1 <= r.mix_copies <= 3 for r in after.values())
    size = {i: len(r.text.split()) for i, r in before.items()}
    taken, total = sum(size[i] * r.mix_copies for i, r in after.items()), sum(size.values())
    assert total - max(size.values()) <= taken <= total


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
