"""S4. Cues of WebVTT text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_TIME = r"^(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})$"
# Entities in the order they are decoded
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&lrm;", ""), ("&rlm;", ""), ("&amp;", "&")]


def timestamp_micros(text: Column) -> Column:
    """[hours:]minutes:seconds.milliseconds as microseconds, null when malformed."""

    def part(n):
        return F.coalesce(F.nullif(F.regexp_extract(text, _TIME, n), F.lit("")).try_cast("long"), F.lit(0))

    return F.when(text.rlike(_TIME), (((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)) * 1000)


def plain_text(text: Column) -> Column:
    """Text without tags (an unclosed tag runs to the end of its line) and with entities decoded."""
    text = F.regexp_replace(text, r"<[^>\n]*(?:>|(?=\n|$))", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def read_cues(files: DataFrame, file: str, text: str) -> DataFrame:
    """One row per cue: (file, cue_no, start_us, end_us, text), numbered by start within its file.

    A block of lines up to a blank line holds at most one cue, which its first timing line opens; cues with a bad time,
    an end before the start, or no text are left out. A file is read within its row, without a shuffle.
    """
    lines = F.regexp_replace(F.col(text), r"\r\n|\r", "\n")
    blocks = F.split(lines, r"\n(?:[\s&&[^\n]]*\n)+")

    def read(block, position):
        head = F.regexp_extract(block, r"(?:^|\n)((?:(?!-->)[^\n])*)-->", 1)
        after = F.regexp_extract(block, r"-->((?:(?!-->)[^\n])*)", 1)
        body = F.regexp_extract(block, r"(?s)^(?:(?!-->).)*-->[^\n]*\n(.*)$", 1)
        return F.struct(
            timestamp_micros(F.trim(head)).alias("start_us"), position.alias("position"),
            timestamp_micros(F.element_at(F.split(F.trim(after), r"\s+"), 1)).alias("end_us"),
            F.regexp_replace(plain_text(body), r"^\s+|\s+$", "").alias("text"))

    found = F.filter(
        F.transform(F.filter(blocks, lambda block: block.contains("-->")), read),
        lambda item: (item["end_us"] >= item["start_us"]) & (item["text"] != ""))
    rows = files.select(file, F.posexplode(F.array_sort(found)).alias("cue_no", "__cue"))
    return rows.select(file, "cue_no", "__cue.start_us", "__cue.end_us", "__cue.text")
