"""Personal data: fixed detectors, and words of the same text that give away what they find. DataFrame functions only.

The detectors find e-mail and IP addresses, card and phone numbers; what they find are the protected entities. Any word of an
entity's text discloses it as far as seeing the word makes the entity more likely than it is at large: the pointwise mutual
information of word and entity over the corpus, as a share of the entity's information, after the information-theoretic sanitisation of
Sanchez, Batet and Viejo (2013). Words above the threshold are generalised, and those that nearly name the entity are removed,
wherever they stand in the text. The estimate is smoothed, so entities and words of one text count too, at a discount.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, quoted
from .spans import bound, listed, placed_matches, running_greatest

#: Order of the kinds of spans
KINDS = ("email", "ip", "card", "phone", "term")
#: Characters of the places in which words and entities meet
PLACE = 128
#: Rows without the entity that a word is thought to have beside those that are counted (the usual half of a Bernoulli estimate)
SMOOTHING = 0.5
#: Shares of an entity's information from which a word is generalised, and removed
GENERALISE, REMOVE = 0.8, 0.95
#: Characters of the blocks that sanitised texts are cut from
BLOCK = 4_096
WORD = r"\p{L}[\p{L}\p{N}]*"

# A run of address characters is tried from its start or where the last match ended, so no run is scanned once per character
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
# Whole chains of digits with single separators, of the lengths that can be cards
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check: every second from the right doubled, less 9 if above 9."""
    def weigh(char, at):
        digit = char.cast("int")
        return F.when(at % 2 == 0, digit).otherwise(F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit))

    chars = F.regexp_extract_all(F.reverse(_digits(value)), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(F.transform(chars, weigh), F.lit(0), lambda total, digit: total + digit) % 10 == 0


def _byte_parts(value: Column) -> Column:
    """Whether all parts of an IP address are at most 255, whatever their leading zeros."""
    return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike(
        "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid(found: Column, check) -> Column:
    return F.filter(found, lambda m: check(m["value"]))


def _shaped(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """What the detectors find: structs ``start``, ``rank``, ``end``, ``kind``, ``value`` in order."""
    text = F.coalesce(text, F.lit(""))
    detectors = [
        (text.contains("@"), _EMAIL, None),
        (text.rlike(r"[0-9]\.[0-9]"), _IP, _byte_parts),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _CARD, _luhn),
        (text.rlike(r"\+[0-9]"), _PHONE, lambda value: F.length(_digits(value)).between(10, 15)),
    ]
    nothing = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")
    parts = []
    for rank, (possible, pattern, valid) in enumerate(detectors):
        found = placed_matches(text, pattern)
        parts.append(F.when(possible, _shaped(found if valid is None else _valid(found, valid), rank)).otherwise(nothing))
    return F.array_sort(F.concat(*parts))


def _blank(text: Column, base: Column) -> Column:
    """The text with a space for each base span, so that no word is a part of an entity."""
    return sanitised(text, base, lambda span: F.lit(" "))


def _distinct_words(text: Column) -> Column:
    return F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))))


def _texts_named() -> list[Column]:
    """A name for a set of texts, the same whatever their order: two 64-bit hashes of each, combined by exclusive or."""
    return [F.bit_xor(F.xxhash64("seen", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]


def _likely(both: Column, word: Column, p: Column) -> Column:
    """Smoothed share of a word's rows that have the entity."""
    return (both + SMOOTHING * p) / (word + SMOOTHING)


def _reaches(both: Column, word: Column, p: Column) -> Column:
    """Whether so many common rows can disclose :data:`GENERALISE` of the entity's information (a little less, for rounding)."""
    return _likely(both, word, p) >= F.pow(p, F.lit(1 - GENERALISE)) * (1 - 1e-9)


def disclosing_terms(narrow: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """``seen``, ``term`` and ``share``: the words of a text that disclose an entity of it, and how much of its information at most.

    ``narrow`` has every row's ``text``; ``held`` one row per distinct text with an entity: its name ``seen``, ``copies``, ``text`` and
    ``base``. Rows with a word, with an entity and with both are counted over the whole corpus and whole texts. Of pairs, only those are
    made whose rows alone let the word reach the threshold; and entities found in the same texts are one class, as are words, so a
    list of addresses found nowhere else makes one pair with a word and not one for each address.
    """
    total = float(max(narrow.count(), 1))
    uses = scratch.keep(held.select("seen", "copies", _distinct_words(_blank(F.col("text"), F.col("base"))).alias("term")), "words", compression="zstd")
    met = held.select("seen", "copies", F.explode(F.array_distinct(F.transform("base", lambda s: s["value"]))).alias("value"))
    entities = met.groupBy("value").agg(F.sum("copies").alias("rows"), *_texts_named()).withColumn("p", F.col("rows") / total)
    classes = scratch.keep(met.join(entities, "value").groupBy("seen", "x1", "x2").agg(
        F.any_value("rows").alias("rows"), F.any_value("p").alias("p"), F.any_value("copies").alias("copies")), "entities")
    spread = narrow.where("text IS NOT NULL").select(_distinct_words(F.col("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("everywhere"))
    words = uses.groupBy("term").agg(F.sum("copies").alias("here"), *[name.alias(f"w{n}") for n, name in enumerate(_texts_named(), 1)])
    words = words.join(spread, "term", "left").select("term", "w1", "w2", F.greatest("here", F.coalesce("everywhere", "here")).alias("word"))
    words = scratch.keep(uses.join(words, "term").select("seen", "term", "w1", "w2", "word"), "counted", compression="zstd")
    named = words.select(F.col("seen").alias("__seen"), "w1", "w2", "word").distinct()
    possible = _reaches(F.least("rows", "word"), F.col("word"), F.col("p"))
    pairs = scratch.keep(classes.join(named, (F.col("seen") == F.col("__seen")) & possible).drop("__seen", "rows"), "pairs", compression="zstd")
    both = pairs.groupBy("x1", "x2", "w1", "w2", "word", "p").agg(F.sum("copies").alias("both")).where(_reaches(F.col("both"), F.col("word"), F.col("p")))
    # Of an entity of every text nothing is left to disclose
    shares = both.where("p < 1").select("x1", "x2", "w1", "w2", "word", (1 - F.log2(_likely(F.col("both"), F.col("word"), F.col("p"))) / F.log2("p")).alias("share"))
    told = pairs.join(shares, ["x1", "x2", "w1", "w2", "word"]).groupBy("seen", "w1", "w2", "word").agg(F.max("share").alias("share"))
    return words.join(told, ["seen", "w1", "w2", "word"]).select("seen", "term", "share")


def _placed_terms(held: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurrence of a text's disclosing words that no base span overlaps: ``seen``, ``start``, ``end``, ``share``.

    Words and spans meet in places of the text's length, so a text with many of both is not gone through once for each.
    """
    words = held.select("seen", F.explode(placed_matches(F.col("text"), WORD)).alias("w")).select(
        "seen", F.lower("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    flagged = words.join(terms, ["seen", "term"]).select("seen", "start", "end", "share", F.explode(_places("start", "end")).alias("place"))
    spans = held.select(F.col("seen").alias("__seen"), F.explode("base").alias("s")).select(
        "__seen", F.col("s.start").alias("from"), F.col("s.end").alias("to"), F.explode(_places("s.start", "s.end")).alias("__place"))
    covered = (F.col("seen") == F.col("__seen")) & (F.col("place") == F.col("__place")) & (F.col("start") < F.col("to")) & (F.col("from") < F.col("end"))
    # A word that lies in several places stays only if it is free in all of them
    free = flagged.join(spans, covered, "left_anti").groupBy("seen", "start", "end").agg(F.max("share").alias("share"), F.count(F.lit(1)).alias("places"))
    return free.where(F.col("places") == F.size(_places("start", "end"))).drop("places")


def _places(start: str, end: str) -> Column:
    return F.sequence(F.floor(F.col(start) / PLACE), F.floor((F.col(end) - 1) / PLACE))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, with_text: bool = True) -> DataFrame:
    """``id``, ``base`` and ``spans`` of every row, and ``sanitised`` text if asked for.

    Spans are structs ``start``, ``rank``, ``end``, ``kind``, ``value`` by start and kind; ``base`` has what the detectors find, ``spans`` also
    the ``term`` spans of disclosing words (with ``value`` generalise or remove), none of which overlaps a base span. Null and empty
    texts have none; null and repeated ids keep their rows, and copies of a text count as often as they occur; no other column is read.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    narrow = docs.select(quoted(id_column).alias("id"), quoted(text_column).alias("text"))
    # The detectors go through each text once; without sanitised texts only those with an entity are kept
    rows = scratch.keep(narrow.select(
        "id", base_spans(F.col("text")).alias("base"), F.md5("text").alias("seen"), F.col("text").alias("whole")).select(
        "id", "base", "seen", F.when(F.lit(with_text) | (F.size("base") > 0), F.col("whole")).alias("text")), "base", compression="zstd")
    entities = rows.where(F.size("base") > 0)
    copies = entities.groupBy("seen").agg(F.count(F.lit(1)).alias("copies"))
    held = scratch.keep(entities.dropDuplicates(["seen"]).select("seen", "base", "text").join(copies, "seen"), "texts", compression="zstd")
    flagged = _placed_terms(held, scratch.keep(disclosing_terms(narrow, held, scratch), "terms"))
    shaped = F.struct(
        F.col("start"), F.lit(len(KINDS) - 1).alias("rank"), F.col("end"), F.lit("term").alias("kind"),
        F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("value"))
    added = scratch.keep(flagged.groupBy(F.col("seen").alias("__seen")).agg(F.collect_list(shaped).alias("terms")), "placed")
    joined = rows.join(added, F.col("seen") == F.col("__seen"), "left")
    nothing = F.expr("CAST(array() AS array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>)")
    found = joined.select("id", "base", F.array_sort(F.concat("base", F.coalesce("terms", nothing))).alias("spans"), "text")
    if not with_text:
        return found.drop("text")
    return found.withColumn("sanitised", sanitised(F.col("text"), F.col("spans"))).drop("text")


def _bracketed(span: Column) -> Column:
    """A span's kind in brackets, or nothing if it is to be removed."""
    return F.when(span["value"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))


def sanitised(text: Column, spans: Column, named: Callable[[Column], Column] = _bracketed) -> Column:
    """The text with each span replaced by what ``named`` makes of it; of spans that overlap, the first.

    What lies between spans is cut from blocks of the text, so no cut starts from the text's beginning.
    """
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))

    def cut(whole, begin, end):
        first = F.floor(begin / BLOCK)
        part = F.array_join(F.slice(whole, (first + 1).cast("int"), F.greatest(F.lit(0), F.floor((end - 1) / BLOCK) - first + 1).cast("int")), "")
        return F.when(end > begin, F.substring(part, (begin - first * BLOCK + 1).cast("int"), (end - begin).cast("int"))).otherwise("")

    # How far earlier spans reach
    reach = F.concat(F.array(F.lit(0).cast("bigint")), running_greatest(F.transform(spans, lambda span: span["end"])))

    def replaced(whole, ends):
        parts = F.transform(spans, lambda span, at: F.when(span["start"] < ends[at], "").otherwise(
            F.concat(cut(whole, ends[at], span["start"]), named(span))))
        return F.concat(F.array_join(parts, ""), cut(whole, F.element_at(ends, -1), F.length(text).cast("bigint")))

    return F.when(text.isNotNull(), bound(blocks, lambda whole: bound(reach, lambda ends: replaced(whole, ends))))
