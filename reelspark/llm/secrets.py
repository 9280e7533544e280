"""Secrets in texts by rules of regular expressions, searched through an inverted index of trigrams. DataFrame functions only.

Each rule's expression says which trigrams a text must hold for it to match (after Cox, "Regular expression matching with a
trigram index", 2012): clauses that all hold, each of alternative sets of trigrams. The index has, for each of the trigrams that
some rule asks for and each segment of rows, the rows that hold it. Posting lists of a set are intersected, those of a clause's
sets united and the clauses intersected again; what is left are candidates, and only those are matched with the expression.
Rules without a mandatory trigram are matched with every text.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as codes, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, quoted
from .spans import placed_matches

#: Rows of a segment are those whose numbers share all but these low bits
SEGMENT_BITS = 12
#: Members of a character class, and texts of a stretch, that are still written out when trigrams are derived
CLASS_MEMBERS, STRETCH_TEXTS = 16, 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; ``check`` drops matches by their value, without another try."""

    kind: str
    pattern: str
    check: Callable[[Column], Column] | None = None


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The fixed rules come first
BASE = [
    Rule("assign", _ASSIGN, lambda value: F.length(F.regexp_extract(value, _ASSIGN, 2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda value: F.length(value) >= 20),
    # Shorter runs would be dropped anyway
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Published forms of keys and tokens, and credentials in addresses
RULES = [
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,900}\.eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]+"),
    Rule("credentials", r"[a-z]{2,20}://[A-Za-z0-9._-]{1,100}:[^\x00-\x20/@:]{1,100}@[A-Za-z0-9.-]+"),
]

_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def _joined(parts: list[set[str]]) -> set[str] | None:
    """All texts of one part after another, unless there are too many."""
    count = 1
    for part in parts:
        count *= len(part)
    return {"".join(choice) for choice in product(*parts)} if count <= STRETCH_TEXTS else None


def _texts(token) -> set[str] | None:
    """All lower-cased texts that a part of an expression matches; None if they are many or without end."""
    kind, value = token
    if kind is codes.LITERAL:
        return {chr(value).lower()}
    if kind is codes.IN and value[0][0] is not codes.NEGATE:
        members = set()
        for what, member in value:
            if what is codes.CATEGORY or what is codes.RANGE and member[1] - member[0] >= 2 * CLASS_MEMBERS:
                return None
            members |= {chr(member).lower()} if what is codes.LITERAL else {chr(c).lower() for c in range(member[0], member[1] + 1)}
        return members if len(members) <= CLASS_MEMBERS else None
    if kind in (codes.SUBPATTERN, codes.BRANCH):
        choices = value[1] if kind is codes.BRANCH else [value[-1]]
        found = set()
        for choice in choices:
            parts = [_texts(part) for part in choice]
            whole = None if None in parts else _joined(parts)
            if whole is None:
                return None
            found |= whole
        return found if len(found) <= STRETCH_TEXTS else None
    if kind in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
        least, most, inner = value
        parts = [_texts(part) for part in inner]
        if None in parts or most is codes.MAXREPEAT or most > 8 or (one := _joined(parts)) is None:
            return None
        several = [_joined([one] * times) for times in range(least, most + 1)]
        return None if None in several else set().union(*several)
    return {""} if kind in (codes.AT, codes.ASSERT, codes.ASSERT_NOT) else None


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """Clauses of alternative sets of lower-case trigrams: a text that matches holds all of one set of every clause.

    Stretches of parts with few possible texts are written out; a stretch with a text shorter than three characters says nothing. No
    clause at all means that the rule has no mandatory trigram. Literals are taken to be ASCII.
    """
    stretches, stretch = [], {""}
    for token in parser.parse(pattern):
        texts = _texts(token)
        longer = None if texts is None else _joined([stretch, texts])
        if longer is None:
            stretches.append(stretch)
        stretch = longer or texts or {""}
    stretches.append(stretch)
    clauses = []
    for stretch in stretches:
        sets = {frozenset(text[i:i + 3] for i in range(len(text) - 2)) for text in stretch}
        # A set that holds another one's trigrams and more is met only where that one is
        sets = {one for one in sets if not any(other < one for other in sets)}
        if all(sets) and sets not in clauses:
            clauses.append(sets)
    return clauses


def index_trigrams(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """``segment``, ``trigram`` and ``rows``: which rows of the segment hold the trigram once lower-cased; ``rows`` has ``row`` and ``text``."""
    lowered = rows.select("row", F.lower("text").alias("text"))
    held = F.filter(F.array(*[F.when(F.col("text").contains(trigram), F.lit(trigram)) for trigram in trigrams]), lambda found: found.isNotNull())
    return lowered.select("row", F.explode(held).alias("trigram")).groupBy(
        F.shiftright("row", SEGMENT_BITS).alias("segment"), "trigram").agg(F.collect_list("row").alias("rows"))


def _common(lists: Column) -> Column:
    """Rows that all posting lists have."""
    return F.aggregate(F.slice(lists, F.lit(2), F.size(lists)), lists[0], lambda acc, other: F.array_intersect(acc, other))


def candidates(postings: DataFrame, queries: dict[str, list[set[frozenset[str]]]]) -> DataFrame:
    """``row`` and ``kinds``: the rules whose trigram queries the row meets. Everything happens within a segment."""
    asked = [
        (kind, clause, len(clauses), at, len(trigrams), trigram)
        for kind, clauses in queries.items() for clause, sets in enumerate(clauses)
        for at, trigrams in enumerate(sorted(sets, key=sorted)) for trigram in sorted(trigrams)]
    plan = postings.sparkSession.createDataFrame(asked, "kind string, clause int, clauses int, option int, needed int, trigram string")
    # As many rows as the rules have trigrams, whatever the table
    wanted = postings.join(F.broadcast(plan), "trigram").repartition("segment")
    sets = wanted.groupBy("segment", "kind", "clause", "clauses", "option", "needed").agg(
        F.collect_list("rows").alias("lists")).where(F.size("lists") == F.col("needed"))
    clauses = sets.groupBy("segment", "kind", "clause", "clauses").agg(
        F.array_distinct(F.flatten(F.collect_list(_common(F.col("lists"))))).alias("rows"))
    met = clauses.groupBy("segment", "kind", "clauses").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == F.col("clauses"))
    return met.select("segment", "kind", F.explode(_common(F.col("lists"))).alias("row")).groupBy("segment", "row").agg(
        F.collect_list("kind").alias("kinds")).drop("segment")


def _found(text: Column, rule: Rule, rank: int) -> Column:
    found = placed_matches(text, rule.pattern)
    if rule.check is not None:
        found = F.filter(found, lambda m: rule.check(m["value"]))
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(rule.kind).alias("kind"), m["value"].alias("value")))


def _nothing() -> Column:
    return F.array().cast(_SPANS)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, rules: list[Rule] = RULES) -> DataFrame:
    """``id``, ``spans`` and ``searched`` (the rules whose expressions were tried by way of the index) of every row.

    Spans are structs ``start``, ``rank`` (of the rule), ``end`` (code points, end exclusive), ``kind`` and ``value``, by start and rule; those
    of one rule do not overlap, those of two may. Null and empty texts have none; null and repeated ids keep their rows; a text
    of any length is one row; no other column is read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: clauses for kind, clauses in queries.items() if clauses}
    # Written once, so that a row's number stays the same
    rows = scratch.keep(docs.select(
        quoted(id_column).alias("id"), F.coalesce(quoted(text_column), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")),
        "texts", compression="zstd")
    ranks = {rule.kind: rank for rank, rule in enumerate(rules)}
    scanned = [F.when(F.col("text").rlike(rule.pattern), _found(F.col("text"), rule, ranks[rule.kind])).otherwise(_nothing())
               for rule in rules if rule.kind not in indexed]
    every = rows.select("id", "row", (F.concat(*scanned) if scanned else _nothing()).alias("scanned"))
    if not indexed:
        return every.select("id", F.array_sort("scanned").alias("spans"), F.array().cast("array<string>").alias("searched"))
    trigrams = sorted({trigram for clauses in indexed.values() for sets in clauses for trigrams in sets for trigram in trigrams})
    postings = scratch.keep(index_trigrams(rows, trigrams), "postings")
    hopeful = scratch.keep(candidates(postings, indexed), "candidates").withColumnRenamed("row", "__row")
    tried = [F.when(F.array_contains("kinds", rule.kind), _found(F.col("text"), rule, ranks[rule.kind])).otherwise(_nothing())
             for rule in rules if rule.kind in indexed]
    verified = rows.select("row", "text").join(hopeful, F.col("row") == F.col("__row")).select(
        "__row", F.concat(*tried).alias("verified"), "kinds")
    verified = scratch.keep(verified, "verified")
    joined = every.join(verified, F.col("row") == F.col("__row"), "left")
    return joined.select(
        "id", F.array_sort(F.concat("scanned", F.coalesce("verified", _nothing()))).alias("spans"),
        F.array_sort(F.coalesce("kinds", F.array().cast("array<string>"))).alias("searched"))

