"""Sections of tagged texts: verses without choruses, and the chorus itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.functions.text import split_lines, token_count

# Fixed value: the tags that open a chorus.
CHORUS_TAG = r"(?i)\[(chorus|hook|refrain)(\s+\d+)?\]"
ANY_TAG = r"\A\[.+\]\z"
VERSE_TAG = r"(?i)\A\[\s*verse"


def _lines(text: str | Column) -> Column:
    return split_lines(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` and the lambdas in it name it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def extract_sections(text: str | Column, verse_tag: str = VERSE_TAG) -> Column:
    """The text outside of sections that are no verses.

    A tag line that names no verse starts a skipped section and is dropped, as is the tag line
    that ends one; other tag lines are kept. Another non-verse tag goes on with the skipping.
    The lines are cut at tag lines into segments; whether one stays follows from its own tag and the one before.
    """

    def of_lines(lines: Column) -> Column:
        tags = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).rlike(ANY_TAG).alias("tag"), (~F.trim(x).rlike(verse_tag)).alias("other"))), lambda t: t["tag"])
        return bound(tags, lambda t: F.trim(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(t)), lambda j: segment(lines, t, j))), "\n")))

    def segment(lines: Column, tags: Column, j: Column) -> Column:
        own, before = F.get(tags, j - 1), F.get(tags, j - 2)
        start = F.coalesce(own["i"], F.lit(0))
        first = start + F.when(before["other"], 1).otherwise(0)
        end = F.coalesce(F.get(tags, j)["i"], F.size(lines))
        return F.when(own["other"], F.array().cast("array<string>")).otherwise(F.slice(lines, first + 1, F.greatest(end - first, F.lit(0))))

    return bound(_lines(text), of_lines)


def tagged_chorus(text: str | Column, pattern: str = CHORUS_TAG) -> Column:
    """The lines after a chorus tag up to the next tag, once a line was met; another chorus tag starts anew. Null for none."""

    def of_lines(lines: Column) -> Column:
        bare = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).rlike(pattern).alias("opens"), F.trim(x).rlike(ANY_TAG).alias("tag")))
        events = F.filter(bare, lambda x: x["opens"] | x["tag"])
        # Where the chorus opens and ends; an end is a tag after at least one line.
        start = F.struct(F.lit(-1).alias("opened"), F.lit(-1).alias("ended"))

        def step(state: Column, x: Column) -> Column:
            going = state["ended"] < 0
            ends = going & ~x["opens"] & (state["opened"] >= 0) & (x["i"] >= state["opened"] + 2)
            return F.struct(F.when(going & x["opens"], x["i"]).otherwise(state["opened"]).alias("opened"), F.when(ends, x["i"]).otherwise(state["ended"]).alias("ended"))

        def cut(state: Column) -> Column:
            end = F.when(state["ended"] < 0, F.size(lines)).otherwise(state["ended"])
            kept = F.transform(F.slice(lines, state["opened"] + 2, F.greatest(end - state["opened"] - 1, F.lit(0))), lambda x: F.trim(x))
            joined = F.array_join(F.filter(kept, lambda x: x != ""), "\n")
            return F.when((state["opened"] >= 0) & (joined != ""), joined)

        return bound(F.aggregate(events, start, step), cut)

    return bound(_lines(text), of_lines)


def normalised_stanza(text: Column) -> Column:
    """Lower case without punctuation, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def repeated_stanza(text: str | Column, least_times: int = 3, least_tokens: int = 6) -> Column:
    """The stanza that comes back most often, as it stands first; null if none comes ``least_times`` times with ``least_tokens`` words.

    All within a row: the normalised forms are sorted, and one pass counts the runs of equal ones.
    """
    source = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    trimmed = F.transform(F.split(source, "\n{2,}"), lambda s: F.regexp_replace(s, r"(?U)\A\s+|\s+\z", ""))
    start = F.struct(F.lit(None).cast("string").alias("form"), F.lit(0).alias("first"), F.lit(False).alias("able"), F.lit(0).alias("n"), F.lit(0).alias("most"), F.lit(-1).alias("best"))

    def step(run: Column, x: Column) -> Column:
        same = F.coalesce(run["form"] == x["form"], F.lit(False))
        first, able = F.when(same, run["first"]).otherwise(x["i"]), F.when(same, run["able"]).otherwise(x["able"])
        n = F.when(same, run["n"]).otherwise(0) + 1
        better = able & (n >= least_times) & ((n > run["most"]) | ((n == run["most"]) & (first < run["best"])))
        return F.struct(x["form"].alias("form"), first.alias("first"), able.alias("able"), n.alias("n"), F.when(better, n).otherwise(run["most"]).alias("most"), F.when(better, first).otherwise(run["best"]).alias("best"))

    def of_stanzas(stanzas: Column) -> Column:
        formed = F.transform(stanzas, lambda s, i: F.struct(normalised_stanza(s).alias("form"), i.alias("i"), (token_count(s) >= least_tokens).alias("able")))
        best = F.aggregate(F.array_sort(formed), start, step, lambda run: run["best"])
        return bound(best, lambda at: F.when((at >= 0) & (F.size(stanzas) >= 2), F.get(stanzas, at)))

    return bound(F.filter(trimmed, lambda s: s != ""), of_stanzas)


def repeated_stanza_rows(df: DataFrame, key: str, text: str, least_times: int = 3, least_tokens: int = 6) -> DataFrame:
    """As ``repeated_stanza``, by explode and group: for texts with very many stanzas."""
    cut = df.select(key, F.posexplode(F.filter(F.transform(F.split(text, "\n{2,}"), lambda s: F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")), lambda s: s != "")).alias("pos", "stanza"))
    grouped = cut.groupBy(key, F.md5(normalised_stanza(F.col("stanza"))).alias("form")).agg(F.count("*").alias("n"), F.min(F.struct("pos", "stanza")).alias("first"))
    able = grouped.where((F.col("n") >= least_times) & (token_count(F.col("first.stanza")) >= least_tokens))
    return able.groupBy(key).agg(F.max_by(F.col("first.stanza"), F.struct("n", -F.col("first.pos"))).alias("chorus_text"), F.max("n").alias("times"))


def chorus_cascade(text: str, out_prefix: str = "chorus", pattern: str = CHORUS_TAG, least_times: int = 3, least_tokens: int = 6, provided: Column | None = None) -> list[Column]:
    """chorus_detected, chorus_method, chorus_text and chorus_token_count: by tag, by repetition, by a provider's column, else the whole text."""
    by_tag, by_stanza = tagged_chorus(text, pattern), repeated_stanza(text, least_times, least_tokens)
    other = provided if provided is not None else F.lit(None).cast("string")
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    method = F.when(blank, "none").when(by_tag.isNotNull(), "tag").when(by_stanza.isNotNull(), "repetition").when(other.isNotNull(), "llm").otherwise("none")
    chorus = F.when(blank, "").otherwise(F.coalesce(by_tag, by_stanza, other, F.col(text)))
    return [(method != "none").alias(f"{out_prefix}_detected"), method.alias(f"{out_prefix}_method"), chorus.alias(f"{out_prefix}_text"), token_count(chorus).alias(f"{out_prefix}_token_count")]
