"""Text rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{Nd}_:-]+"
SENTENCE_BREAK = r"(?<=[。！？.!?])\s*"
UNIT_BREAK = r"(?<=[。！？.!?])\s+"
BULLET = r"^\s*[-*\d.)]+\s*"


def keywords(text: Column) -> Column:
    """Distinct lower-case pieces of at least two characters."""
    return F.filter(F.array_distinct(F.split(F.lower(text), WORD_BREAK)), lambda t: F.length(t) >= 2)


# Names of the flags that mark evidence in conversation records.
EVIDENCE_FLAGS = ("has_answer", "hasAnswer", "is_evidence", "isEvidence")


def has_evidence(record: Column) -> Column:
    """Whether a JSON text sets one of the evidence flags anywhere; a flag inside a string is none."""
    return record.rlike(r'(?<!\\)"(?:' + "|".join(EVIDENCE_FLAGS) + r')"\s*:\s*(?:true|"(?i:true)"|[1-9])')


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank, at least 1 otherwise."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized_tags(tags: Column) -> Column:
    """Trimmed tags without null, blank and repeated ones, in order."""
    trimmed = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t))
    return F.array_distinct(F.filter(trimmed, lambda t: t.isNotNull() & (t != "")))


def matches_all(tags: Column, required: list[str]) -> Column:
    """True if every required tag occurs; true for none required, false without tags."""
    if not required:
        return F.lit(True)
    return F.size(F.array_except(F.array(*map(F.lit, required)), normalized_tags(tags))) == 0


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs of the stripped text."""
    parts = F.transform(F.split(strip(text), r"\n{2,}"), strip)
    return F.filter(parts, lambda p: p != "")


def packed(sentences: Column, limit: int) -> Column:
    """Sentences joined by a space while their words stay within ``limit``; greedy, in order."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(s: Column, x: Column) -> Column:
        n = word_count(x)
        fits = (s["n"] > 0) & (s["n"] + n <= limit)
        new = F.struct(
            F.when(fits | (s["n"] == 0), s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))).alias("out"),
            F.when(fits, F.concat_ws(" ", s["now"], x)).otherwise(x).alias("now"),
            F.when(fits, s["n"] + n).otherwise(n).alias("n"),
        )
        return F.when(n == 0, s).otherwise(new)

    return F.aggregate(sentences, zero, add, lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))


def split_text(text: Column, limit: int = 512) -> Column:
    """Paragraphs up to ``limit`` words; longer ones as packed sentences."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.when(word_count(p) <= limit, F.array(p)).otherwise(packed(F.split(p, SENTENCE_BREAK), limit))))


def units(text: Column, most: int = 12) -> Column:
    """Lines without bullet marks, cut into sentences; the first ``most``."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R+"), lambda x: strip(F.regexp_replace(F.regexp_replace(x, BULLET, ""), r"\s+", " ")))
    return F.slice(F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, UNIT_BREAK))), lambda u: strip(u) != ""), 1, most)


def summary(text: Column, most: int = 12, limit: int = 1200) -> Column:
    """Units joined by line breaks, cut at the last space in the second half of ``limit``."""
    whole = F.concat_ws("\n", units(text, most))
    head = F.substring(whole, 1, limit)
    back = F.instr(F.reverse(head), " ")
    at = F.length(head) - back
    cut = F.when((back > 0) & (at >= limit // 2), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(whole) <= limit, whole).otherwise(strip(cut))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "-")


def scenario(text: Column, allowed: list[str], default: str = "CHAT") -> Column:
    """Lenient enumeration: blank and unknown values become the default."""
    v = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(v.isin(allowed), v).otherwise(F.lit(default))


def label(text: Column, limit: int = 40) -> Column:
    """Text that can stand inside a quoted DOT label."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'\\', r"\\\\"), '"', '\\\\"')
    line = F.regexp_replace(one, r"[\r\n]+", " ")
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(line)


def profile_number(name: Column, letter: str) -> Column:
    """Number after ``-arm`` or ``-p`` in a profile name, null if absent."""
    found = F.regexp_extract(name, rf"-{letter}(\d+)", 1)
    return F.when(found != "", found.cast("int"))
