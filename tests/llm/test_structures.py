"""Manifests, secrets and repaired conversations against plain Python."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reelspark.llm import merkle, repair, secrets

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is not None, value) for value in row))


# Manifests

def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    path = []
    for level in levels[:-1]:
        begin = at // 16 * 16
        path.append(("".join(level[begin:at]), "".join(level[at + 1:begin + 16])))
        at //= 16
    return path


def changed(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0


def lowered(text):
    return text and re.sub("[A-Z]", lambda match: match[0].lower(), text)


def plain_manifest(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row, sha("".join(map(field, row)))))
    names = sorted(sources, key=lambda name: (name is not None, (name or "").encode()))
    for name in names:
        sources[name].sort(key=lambda pair: (pair[0][0] is not None, pair[0][0] or 0, pair[1]))
    trees = {name: tree([leaf for _, leaf in sources[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    found = []
    for at, name in enumerate(names):
        for place, (row, leaf) in enumerate(sources[name]):
            path = siblings(trees[name], place) + siblings(top, at)
            folded = sha("".join(map(field, (*row[:4], lowered(row[4]))))) if changed(row) else leaf
            for left, right in path:
                folded = sha(left + folded + right)
            root = top[-1][0]
            found.append((row[0], leaf, trees[name][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return found


def manifest(spark, rows):
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], DOCS + ", leaf string, row int").repartition(3)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, changes={"text": lower}, changed=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)


def digests(df):
    return [tuple(row) for row in df.select("id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]


def test_manifest_of_a_hot_source_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i if i % 50 else None, "hot" if i % 3 else rng.choice([None, "", "a", "bé"]), rng.choice([None, "en"]), i,
             rng.choice([None, "", "AbC É" * 3])) for i in range(7_000)]
    rows += [(3, "lone", None, 1, "X"), (5, "twins", None, 1, "Y" * 500_000), (5, "twins", None, 1, "Y" * 500_000)]
    got = manifest(spark, rows)
    assert ordered(digests(got)) == ordered(plain_manifest(rows))
    versions = got.where("copies IS NOT NULL").select("root", "folded_root", "copies").collect()
    assert versions and all(row["copies"][-1] == row["folded_root"] and row["copies"][0] != row["root"] for row in versions)


def test_manifest_of_small_and_many_sources(spark):
    assert digests(manifest(spark, [])) == []
    one = [(1, None, None, None, None)]
    assert digests(manifest(spark, one)) == plain_manifest(one)
    many = [(i, f"s{i // 2}", None, None, "T") for i in range(9_000)]
    assert ordered(digests(manifest(spark, many))) == ordered(plain_manifest(many))


# Secrets

def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [{frozenset({"aki", "kia"})}]
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.trigram_query("(ab|token)x?") == secrets.trigram_query("(?:abcd)*") == []
    assert secrets.trigram_query("(?:abcd|xyz)[0-9]+end") == [{frozenset({"abc", "bcd"}), frozenset({"xyz"})}, {frozenset({"end"})}]
    assert secrets.trigram_query("ab?cd") == [{frozenset({"abc", "bcd"}), frozenset({"acd"})}]
    assert secrets.trigram_query("x[a-c]y{2}") == [{frozenset({f"x{c}y", f"{c}yy"}) for c in "abc"}]


def plain_secrets(text):
    text, spans = text or "", []
    for rank, rule in enumerate(secrets.RULES):
        for match in re.finditer(rule.pattern, text, re.ASCII):
            if rule.kind == "assign" and len(match[2]) < 6 or rule.kind == "access" and len(match[0]) < 20:
                continue
            spans.append((match.start(), rank, match.end(), rule.kind, match[0]))
    return sorted(spans)


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(2)
    pieces = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", " = ", ":", '"', "'", "  ", "=", "AKIA", "AKIA" + "Q7" * 8, "abc", "0f" * 12,
              "é", "ÉÀ", "\n", "ghp_" + "a1B2" * 9, "xoxb-1234567890ab", "AIza" + "x" * 35, "sk_live_" + "9" * 16, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".c",
              "http://me:pass@host", "-----BEGIN RSA PRIVATE KEY-----", "hunter2", "toKEN: abcdef", "token=token:abcdefgh"]
    texts = [None, "", "token", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(600))]
    rows = [(None if i % 40 == 0 else i // 2, text) for i, text in enumerate(texts)]
    docs = spark.createDataFrame([(*row, 1, "k") for row in rows], "doc_id long, text string, row long, kinds string").repartition(4)
    got = ordered([(row.id, [tuple(span) for span in row.spans]) for row in secrets.find_secrets(docs).collect()])
    assert got == ordered([(key, plain_secrets(text)) for key, text in rows])
    assert sum(len(spans) for _, spans in got) > 500


def test_secrets_of_empty_and_long_texts(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "é token = abcdefgh0 " * 50_000 + "0" * 1_000_000
    row, = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(span) for span in row.spans] == plain_secrets(text)


def test_secrets_without_indexed_rules(spark):
    docs = spark.createDataFrame([(1, "a" * 30), (2, None)], "doc_id long, text string")
    rows = secrets.find_secrets(docs, rules=secrets.BASE[2:]).orderBy("id").collect()
    assert [len(row.spans) for row in rows] == [1, 0]


# Conversations

def plain_faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        found.append(fault)
    return found


def cheapest(rows, faults):
    """By trying every edit of every row, with up to two inserts before each and at the end."""
    best = None
    choices = []
    for (_, role, _), fault in zip(rows, faults):
        edits = [(4, "D", "")]
        if fault in (None, "truncated"):
            extra = 3 if fault else 0
            edits += [(extra, "K", role[:1] or "?"), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
        choices.append(edits)
    inserts = [(0, "", ""), (3, "I", "u"), (3, "I", "a"), (6, "II", "ua"), (6, "II", "au")]
    for picked in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            roles = "".join(a[2] + p[2] for a, p in zip(added, picked)) + added[-1][2]
            if re.fullmatch("(s?(ua)+)?", roles):
                option = (sum(p[0] for p in picked) + sum(a[0] for a in added), "".join(a[1] + p[1] for a, p in zip(added, picked)) + added[-1][1])
                best = min(best, option) if best else option
    return best


def test_edits_against_every_choice():
    rng = random.Random(3)
    for _ in range(120):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", "c!", "a."])) for i in range(rng.randint(1, 3))]
        faults = plain_faults(rows)
        (edits, _), = repair.tight_edits([(role[:1], fault) for (_, role, _), fault in zip(rows, faults)], repair.END, [0], True)
        audit = re.sub("[ua]", "", "".join(edits))
        cost = sum({"K": 0, "R": 3, "I": 3, "D": 4}[letter] for letter in audit)
        cost += sum(3 for edit, fault in zip(edits, faults) if fault == "truncated" and "D" not in edit)
        assert (cost, audit) == cheapest(rows, faults)


def whole(rows):
    """Edits of one conversation in one stretch, and its repaired lines."""
    faults = plain_faults(rows)
    (edits, _), = repair.tight_edits([(role[:1], fault) for (_, role, _), fault in zip(rows, faults)], repair.END, [0], True)
    lines = []
    for (_, role, text), edit in zip(rows, edits):
        for letter, named in re.findall("([DIKR])([ua]?)", edit):
            role_now = {"u": "user", "a": "assistant"}.get(named, role)
            lines += [] if letter == "D" else [f"{role_now}:{'' if letter == 'I' else text}"]
    return re.sub("[ua]", "", "".join(edits)), sha("\n".join(lines)), faults


@pytest.mark.parametrize("stretch", [7, 4_096])
def test_repair_of_long_conversations(spark, monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rng = random.Random(4)
    said = ["a.", "b", "", " \n", "c!", "what?", "é."] + [f"line {i}." for i in range(40)]
    sizes = {None: 150, 1: 400, 2: 1, 3: 7, 4: 8, 5: 61}
    rows = [(key, None if turn == 0 else turn + turn // 9, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(said))
            for key, size in sizes.items() for turn in range(size)]
    turns = spark.createDataFrame([(*row, 5) for row in rows], TURNS + ", position int").repartition(5)
    got = {row.conversation: row for row in repair.repair_summary(turns).collect()}
    assert set(got) == set(sizes)
    for key in sizes:
        held = sorted(((turn, role, text) for name, turn, role, text in rows if name == key),
                      key=lambda row: (row[0] is not None, row[0] or 0, row[1], hashlib.md5(row[2].encode()).hexdigest()))
        audit, digest, faults = whole(held)
        initials = [role[:1] for _, role, _ in held]
        numbers = [turn for turn, _, _ in held if turn is not None]
        row = got[key]
        assert (row.audit, row.digest) == (audit, digest)
        assert [row.blank, row.duplicate, row.truncated] == [faults.count(name) for name in ("blank", "duplicate", "truncated")]
        assert row.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert row.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert row.cost == sum({"K": 0, "R": 3, "I": 3, "D": 4}[letter] for letter in audit) + 3 * sum(
            fault == "truncated" and letter != "D" for fault, letter in zip(faults, audit.replace("I", "")))


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 1, "user", "b."), (2, 5, None, None), (3, 0, "assistant", "x" * 300_000)]
    turns = spark.createDataFrame(rows, TURNS)
    kept = repair.repaired_turns(repair.repair_rows(turns)).orderBy("conversation", "position", "part").collect()
    roles = {}
    for row in kept:
        roles.setdefault(row.conversation, []).append(row.role)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(role[0] for role in found)) for found in roles.values()) and 2 not in roles
    assert repair.repair_summary(spark.createDataFrame([], TURNS)).count() == 0


def test_stretches_compose():
    rng = random.Random(5)
    rows = [(rng.choice("suat"), rng.choice([None, None, "blank", "truncated"])) for _ in range(60)]
    vector = repair.END
    for begin in range(50, -1, -10):
        vector = repair.apply_table(repair.stretch_table(rows[begin:begin + 10]), vector)
    edits, _ = repair.tight_edits(rows, repair.END, [0], True)[0]
    cost = sum({"K": 0, "R": 3, "I": 3, "D": 4}[letter] for letter in re.sub("[ua]", "", "".join(edits)))
    cost += 3 * sum(fault == "truncated" and "D" not in edit for (_, fault), edit in zip(rows, edits))
    assert vector[0] == cost
