"""Scores, languages, contamination, personal data, chats and mixes."""
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import DATA, compare, connect
from reelspark.llm import chat, decontaminate, langid, mixing, pii, toxicity
from reelspark.llm.queries import ORACLE, QUERIES

EMPTY = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect("0.01"), name, "0.01", QUERIES, ORACLE) is None


def joined(spark, name):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "toxic")
    return QUERIES[name](spark, f"{DATA}/sf0.1").join(docs, "doc_id").join(labels, "doc_id", "left")


def test_toxicity_on_held_out_rows(spark):
    row = joined(spark, "op1_toxicity").where("held_out AND toxic IS NOT NULL").agg(
        F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))),
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert row[0] > 0.95 and row[1] > 0.6 and row[2] < 0.03


def test_training_rows_that_repeat_an_id(spark):
    """A third of all rows on one id: they teach once, and the others as if they were alone."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    first = docs.where("lang IS NOT NULL AND length(text) BETWEEN 100 AND 2000").orderBy("doc_id").limit(1)
    hot = docs.unionByName(first.crossJoin(spark.range(500)).select("doc_id", "text", "lang"))
    plain, repeated = langid.train(docs), langid.train(hot)
    assert plain.languages == repeated.languages and len(plain.centroids) == len(repeated.centroids)
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    labelled = docs.select("doc_id", "text").join(labels, "doc_id")
    more = labelled.unionByName(labelled.orderBy("doc_id").limit(1).crossJoin(spark.range(500)).drop("id"))
    one, other = (toxicity.train(rows.select("doc_id", "text"), labels) for rows in (labelled, more))
    assert np.array_equal(one.weight, other.weight) and np.array_equal(one.pull, other.pull)


def test_language_on_held_out_rows(spark):
    row = joined(spark, "op6_langid").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and 0 <= row[1] <= row[2] <= 1


def test_misspellings_share_ngrams():
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(600):
        body = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            body[rng.randrange(40)] = rng.choice(["horriblo", "horribla", "horrible"])
            body[rng.randrange(40)] = "horrible"
        texts.append(" ".join(body))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(toxicity.features(pa.array(texts)), np.array(labels), 0.25)
    clean = " ".join(words[:40])
    scores = model.score(pa.array([clean, clean + " horriblz horribli", None, ""]))
    assert scores[1] > scores[0] and scores[2] == scores[3]


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 30_000), (2, "x")], EMPTY)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(spark.createDataFrame([], EMPTY), model).count() == 0
    assert toxicity.keep_clean(docs.withColumn("score", F.lit(1)), model).columns == ["doc_id", "text", "score"]
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    model = langid.train(spark.createDataFrame([(1, "the cat", "en"), (2, "die Katze", "de"), (3, "", "fr")], "doc_id long, text string, lang string"))
    got = {r.id: (r.lang_pred, r.rejected) for r in langid.identify(
        spark.createDataFrame([(1, "the cat"), (2, "die Katze"), (3, "12 !"), (4, None)], EMPTY), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == ("und", True) and got[4] == ("und", True)


def plain_contamination(docs, items, window=10):
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[i:i + size]), set()).add(str(item))
    out = set()
    for i, text in docs:
        found, hit, held = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(found) - size + 1):
                if (w := tuple(found[k:k + size])) in windows:
                    hit |= set(range(k, k + size))
                    held |= windows[w]
        out.add((i, len(found), len(hit), tuple(sorted(held))))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_contamination(spark, block_words):
    rng = random.Random(2)
    word = lambda: rng.choice("aa bb cc dd ee ff 11 é".split())
    make = lambda n: " ".join(word() for _ in range(n))
    items = [(i, make(rng.randint(11, 30))) for i in range(8)] + [(8, "Solo"), (9, "zz  yy"), (10, None), (11, "..."), (12, make(10))]
    docs = [(i, make(30) + ", " + rng.choice(items[:8])[1].upper() + "; " + make(rng.randint(0, 300))) for i in range(20)]
    docs += [(30, None), (31, ""), (32, "it is SOLO."), (33, "ZZ-yy"), (34, "yy zz"), (35, items[12][1]), (36, items[0][1][:20])]
    found = decontaminate.longest_matches(
        spark.createDataFrame(docs, EMPTY).withColumn("matches", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"),
        block_words=block_words)
    got = {(r.id, r.n_words, r.hit, tuple(sorted({m.item for m in r.matches}))) for r in found.withColumn(
        "hit", decontaminate.hit_words(F.col("matches"))).collect()}
    want = plain_contamination(docs, items)
    assert got == want and sum(bool(w[3]) for w in want) > 15
    bad = {w[0] for w in want if w[3]}
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, EMPTY), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - bad


def test_longest_matches_tell_places(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 20)) + " z")], EMPTY)
    row = decontaminate.longest_matches(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).first()
    assert [tuple(m) for m in row.matches] == [("a", 5, 2, 15)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.longest_matches(docs, none).first().matches == []
    assert decontaminate.longest_matches(spark.createDataFrame([], EMPTY), none).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def valid(kind, value):
        digits = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(part) <= 255 for part in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern) in enumerate(PATTERNS.items())
             for m in re.finditer(pattern, text or "", re.ASCII) if valid(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(6)
    pieces = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "@", ".", " ", "-", "+", "é😀", "1", "12", "4539 1488 0343 6467", "4539-1488-0343-6467", "255.1.0.300",
              "10.0.0.1", "1.2.3.4.5.6.7.8", "+1 (415) 555-0100", "+4915112345678", "0000000000000000", "word", "\n", "007.010.000.255"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(500)] + [None, "", "9" * 40, "1 " * 30]
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), EMPTY)).collect()
    for row in rows:
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.base)
        assert base == plain_spans(texts[row.id]), texts[row.id]


def test_disclosing_words(spark):
    texts = [f"meeting number {i} with zorblax at bob@corp.org now" for i in range(4)]
    texts += [f"nothing number {i} with anyone at home now" for i in range(60)] + ["zorblaxian tales"]
    rows = {r.id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), EMPTY)).collect()}
    assert [(s.kind, texts[0][s.start:s.end]) for s in rows[0].spans if s.kind == "term"] == [("term", "meeting"), ("term", "zorblax")]
    assert rows[0].sanitised == " number 0 with  at [EMAIL] now"
    assert all(not rows[i].spans and rows[i].sanitised == texts[i] for i in range(4, len(texts)))
    assert pii.find_personal_data(spark.createDataFrame([], EMPTY)).count() == 0
    odd = pii.find_personal_data(spark.createDataFrame([(None, None), (None, "a@b.c"), (1, ""), (1, "a@b.c")], EMPTY)).collect()
    assert sorted((r.id is None, len(r.spans)) for r in odd) == [(False, 0), (False, 1), (True, 0), (True, 1)]


def test_terms_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    # A name at the head of a letter whose address is at its end, named twice; a text with two entities; one that comes twice
    extra = [(9001, "quillon writes. " + "the and of " * 200 + " quillon.x@corp.org quillon"), (9002, "the zarb and +44 20 7946 0958 zarb of 10.0.0.9"),
             (9003, "vex of a@b.cd the"), (9003, "vex of a@b.cd the"), (9004, "vex the of and"), (9005, None), (9006, "")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    found = pii.find_personal_data(docs).collect()
    texts = [(row.id, row.text) for row in docs.withColumnRenamed("doc_id", "id").collect()]
    base = {row.id: row.base for row in found}
    word = re.compile(r"[^\W\d_][^\W_]*")
    uses, everywhere, entities = {}, Counter(), Counter()
    for id, text in texts:
        everywhere.update({w.lower() for w in word.findall(text or "")})
        if base[id]:
            blank = list(text)
            for span in base[id]:
                blank[span.start:span.end] = " " * (span.end - span.start)
            uses[id, len(uses)] = {w.lower() for w in word.findall("".join(blank))}, {span.value for span in base[id]}
    both, here = Counter(), Counter()
    for terms, values in uses.values():
        entities.update(values)
        here.update(terms)
        both.update((term, value) for term in terms for value in values)

    def share(term, value):
        n, p = max(everywhere[term], here[term]), entities[value] / len(texts)
        return 1 - math.log2((both[term, value] + 0.5 * p) / (n + 0.5)) / math.log2(p)

    want = {}
    by_id = dict(texts)
    for (id, _), (terms, values) in uses.items():
        shares = {term: max(share(term, value) for value in values) for term in terms}
        want[id] = sorted(
            (m.start(), m.end(), "remove" if shares[m[0].lower()] >= 0.95 else "generalise") for m in word.finditer(by_id[id])
            if shares.get(m[0].lower(), 0) >= 0.8 and all(m.end() <= s.start or m.start() >= s.end for s in base[id]))
    got = {row.id: [(s.start, s.end, s.value) for s in row.spans if s.kind == "term"] for row in found}
    assert got == {id: want.get(id, []) for id in got}
    assert [by_id[9001][begin:end] for begin, end, _ in got[9001]].count("quillon") == 2
    assert {by_id[9002][begin:end] for begin, end, _ in got[9002]} == {"zarb"} and got[9003]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(30):
        talk = [("user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", None, ""])) for t in range(rng.randint(1, 5))]
        rows += [(c, t, *turn) for t, turn in enumerate(talk)]
        if c % 3 == 0:
            rows += [(100 + c, t, *turn) for t, turn in enumerate(talk[:rng.randint(1, len(talk))])]
    return rows + [(500, 1, None, "a"), (500, 1, "user", "a"), (500, None, "user", "z")]


@pytest.mark.parametrize("seed,split", [(1, None), (2, "3")])
def test_chats_equal_their_sql(spark, seed, split):
    schema = "conv_id long, turn long, role string, text string"
    rows = conversations(seed)
    if split:
        spark.conf.set("spark.reelspark.hotKeyRows", split)
    try:
        got = sorted(map(tuple, chat.render_turns(spark.createDataFrame(rows, schema).withColumn("n_turns", F.lit("x"))).collect()))
    finally:
        spark.conf.unset("spark.reelspark.hotKeyRows")
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(map(tuple, con.sql(ORACLE["op9_chat"]).fetchall()))
    assert len({row[0] for row in got}) < len({row[0] for row in rows})


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.render(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 0, "user", "q"), (3, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "r")]
    got = [tuple(r) for r in chat.render(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(5, 2, "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n")]
    copies = [(None, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "user", "q")]
    assert [r.conversation for r in chat.render(spark.createDataFrame(copies, schema)).collect()] == [3]


def test_mix(spark):
    schema = "doc_id long, text string, source string"
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 10 else None) for i in range(400)] + [(1000, None, "a"), (1001, "one", "tiny"), (7, "w " * 3, "b")]
    out = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, schema).withColumn("size", F.lit("x"))).collect()]
    total = sum(r["size"] for r in out)
    assert len(out) == len(rows) and total == sum(len((t or "").split()) for _, t, _ in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in targets.values())
    assert targets["tiny"] == (3.0, 1)
    for source, (target, _) in targets.items():
        taken = sum(r["taken"] for r in out if r["source"] == source)
        assert abs(taken - target) <= 8
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in out)
    again = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows[::-1], schema)).collect()]
    key = lambda r: (r["id"], r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "", None)], schema)).first().taken == 0


def test_a_taken_row_has_its_own_copies(spark):
    rows = [(None if i % 3 else i % 8, "w " * (i % 7), "abc"[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = sorted((str(r.id), r.source, r.size, r.copies) for r in mixing.mix(docs).collect() if r.copies)
    taken = mixing.take_mix(docs).collect()
    assert sorted((str(r.doc_id), r.source, len(r.text.split()), r.mix_copies) for r in taken) == mixed
    assert sum(len(r.text.split()) * r.mix_copies for r in taken) <= sum(len(text.split()) for _, text, _ in rows)


def test_mix_ranges_do_not_matter(spark, monkeypatch):
    whole = sorted(map(tuple, QUERIES["op10_mixing"](spark, f"{DATA}/sf0.01").collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert sorted(map(tuple, QUERIES["op10_mixing"](spark, f"{DATA}/sf0.01").collect())) == whole




def test_personal_data_in_a_text_of_many_entities(spark):
    text = "".join(f"wörd{i % 50} user{i}@mail{i % 7}.example.com, " for i in range(100_000))
    began = time.perf_counter()
    row, = pii.find_personal_data(spark.createDataFrame([(1, text), (2, "x")], EMPTY)).where("id = 1").collect()
    assert time.perf_counter() - began < 120
    found = [match.span() for match in re.finditer(r"user[0-9]+@[a-z0-9.]+com", text)]
    assert [(span.start, span.end) for span in row.base] == found
    assert row.sanitised == re.sub(r"user[0-9]+@[a-z0-9.]+com", "[EMAIL]", text)
