"""Text functions as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pronouns whose share decides a text's perspective, and its least share.
FIRST_PERSON = ("i", "me", "my", "mine", "myself", "we", "us", "our", "ours")
SECOND_PERSON = ("you", "your", "yours", "yourself", "yourselves")
THIRD_PERSON = ("he", "she", "they", "him", "her", "his", "their", "them", "himself", "herself", "themselves")
DOMINANCE = 0.60
# The patterns of section tags and of footer lines.
TAG = r"\[.*?\]"
FOOTER = r"(?imd)^[\s&&[^\n]]*(\d+\s*embed|see .+ live|get tickets|you might also like)[\s&&[^\n]]*$"
#: What ends a line: everything that text editors and line splitters count as such.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Bytes of one Arrow batch between Spark and Python; a longer text travels alone.
BATCH_BYTES = 4 << 20
CURLY, STRAIGHT = "‘’“”—–", "''\"\"--"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalise_spacing(text: str | Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))


def id_part(text: str | Column) -> Column:
    """Lower case, all but a-z, 0-9 and space as space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(text))), "[^a-z0-9 ]", " "), r"\s+", " "))


def entity_id(artist: str | Column, title: str | Column, year: str | Column) -> Column:
    """The first 16 hexadecimal digits of the MD5 of artist, title and year; null if any is null."""
    key = F.concat(id_part(artist), F.lit("|"), id_part(title), F.lit("|"), _col(year).cast("long").cast("string"))
    return F.substring(F.md5(key), 1, 16)


def is_entity_id(value: str | Column) -> Column:
    """Whether a value is an id; null counts as none."""
    return F.coalesce(_col(value).rlike(r"\A[0-9a-f]{16}\z"), F.lit(False))


def cache_name(value: str) -> str:
    """The file name of an id's cached document."""
    if not isinstance(value, str) or not re.fullmatch("[0-9a-f]{16}", value):
        raise ValueError(f"not an entity id: {value!r}")
    return f"{value}.json"


def strip_header(text: str | Column) -> Column:
    """Drop a page header: through the first 'Lyrics' line end, else a first line that names contributors or lyrics."""
    raw = _col(text)
    at = F.instr(raw, "Lyrics\n")
    line = F.substring_index(raw, "\n", 1)
    headed = line.contains("Contributors") | line.contains("Lyrics")
    after = F.regexp_replace(raw, r"\A[^\n]*\n?", "")
    out = F.when(at > 0, F.substring(raw, at + 7, F.length(raw))).when(headed, after).otherwise(raw)
    return F.regexp_replace(out, r"(?U)\A\s+|\s+\z", "")


def split_lines(text: str | Column) -> Column:
    return F.split(_col(text), LINE_END)


def bound_batches() -> None:
    """Bound what one Arrow batch of the session holds by bytes: 10,000 texts, as many as Spark takes by itself, may be any size."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark has no function for; nulls stay null."""
    return values.str.normalize("NFKC")


def straight_quotes(text: str | Column) -> Column:
    return F.translate(_col(text), CURLY, STRAIGHT)


def without_tags(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(text), F.lit("")), TAG, ""), FOOTER, "")


def tidy_lines(text: str | Column, keep_blank: bool = False) -> Column:
    """Collapse spaces in every line and drop blank lines (or keep one for each run of them)."""
    lines = F.transform(split_lines(text), lambda line: F.trim(F.regexp_replace(line, r"(?U)\s+", " ")))
    if not keep_blank:
        return F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def clean_text(text: str | Column, keep_blank: bool = False) -> Column:
    """Tags and footers off, NFKC, straight quotes, tidy lines; null and blank texts become ''.

    Of texts in ASCII the normaliser sees nulls only, and what they are stays in the JVM. ``keep_blank``
    keeps stanza breaks, for the operators that look for stanzas.
    """
    bound_batches()
    bare = without_tags(text)
    other = nfkc(F.when(bare.rlike(r"[^\x00-\x7F]"), bare))
    return tidy_lines(F.coalesce(straight_quotes(other), bare), keep_blank)


def clean_ascii(text: str | Column) -> Column:
    """``clean_text`` without compatibility normalisation: built-in functions only."""
    return tidy_lines(straight_quotes(without_tags(text)))


def has_tags(text: str | Column) -> Column:
    return F.coalesce(_col(text).rlike(r"\[.+?\]"), F.lit(False))


def tag_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"\[.+?\]")), F.lit(0)).cast("long")


def token_count(text: str | Column) -> Column:
    """Words between white space; '' and null have none."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def perspective(text: str | Column) -> Column:
    """The person whose pronouns have a share of 60 % or more, else 'abstract'.

    One pass of one pattern finds all pronouns; the fold over the few hits counts them by person.
    """
    people = (("first_person", FIRST_PERSON), ("second_person", SECOND_PERSON), ("third_person", THIRD_PERSON))
    every = "|".join(w for _, group in people for w in group)
    hits = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(rf"(?<![a-z])({every})(?![a-z])"), F.lit(1))
    start = F.struct(*(F.lit(0).alias(name) for name, _ in people))

    def step(counts: Column, word: Column) -> Column:
        return F.struct(*((counts[name] + word.isin(*group).cast("int")).alias(name) for name, group in people))

    def label(counts: Column) -> Column:
        total = sum((counts[name] for name, _ in people), F.lit(0))
        out = F.when(total == 0, "abstract")
        for name, _ in people:
            out = out.when(counts[name] / total >= DOMINANCE, name)
        return out.otherwise("abstract")

    return F.aggregate(hits, start, step, label)


def split_tags(text: str | Column) -> Column:
    """Parts between '|', trimmed, empty ones left out; null stays null."""
    return F.filter(F.transform(F.split(_col(text), r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def pretty_label(text: str | Column) -> Column:
    return F.initcap(F.replace(_col(text), F.lit("_"), F.lit(" ")))


def coalesce_nonblank(*texts: str | Column) -> Column:
    """The first text with something in it, else null."""
    return F.coalesce(*(F.when(F.regexp_replace(_col(t), r"(?U)\s+", "") != "", _col(t)) for t in texts))


def model_input(text: str | Column) -> Column:
    """What a model is given: the text, a space for an empty one."""
    return F.when(F.trim(F.coalesce(_col(text), F.lit(""))) == "", " ").otherwise(_col(text))
