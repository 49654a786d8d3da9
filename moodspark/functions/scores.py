"""Scores, bins and label rules as Column expressions. Null inputs give null where the rule says nothing else."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodspark.config import QUALITY_SCORES, WEIGHTS

BINS = (0.2, 0.4, 0.6, 0.8)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: str | Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null, which ``greatest`` and ``least`` alone would hide."""
    v = _col(value)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def rounded(value: str | Column, digits: int) -> Column:
    """Round half to even on the scaled value, as array libraries do."""
    return F.rint(_col(value) * 10**digits) / 10**digits


def numeric_coerce(value: str | Column) -> Column:
    """A double, or null for what is none; never NaN."""
    made = _col(value).cast("string").try_cast("double")
    return F.when(~F.isnan(made), made)


def ensemble_score(first: str | Column, second: str | Column, weights: tuple[float, float] = (0.6, 0.4)) -> Column:
    return F.round(clip(_col(first) * weights[0] + _col(second) * weights[1], -1.0, 1.0), 4)


def bin_levels(score: str | Column, bins: Sequence[float] = BINS) -> Column:
    """1 below the first edge, one more at each edge reached."""
    v = _col(score)
    out = F.when(v.isNull(), F.lit(None).cast("long"))
    for level, edge in enumerate(bins, 1):
        out = out.when(v < edge, F.lit(level).cast("long"))
    return out.otherwise(F.lit(len(bins) + 1).cast("long"))


def quality_tier(tokens: str | Column, least: int = 50, partial: int = 150, documented: bool = False) -> Column:
    """Text quality by length. By default the rules stand in the order in which they have always run, so that
    'partial' needs ``partial`` below ``least``; ``documented`` has them as described: below ``least`` missing,
    below ``partial`` partial, else full."""
    n = F.coalesce(_col(tokens), F.lit(0))
    if documented:
        return F.when(n < least, "missing").when(n < partial, "partial").otherwise("full")
    return F.when(n >= least, "full").when(n >= partial, "partial").otherwise("missing")


def scored_unless_missing(quality: str | Column, score: str | Column) -> Column:
    """Only texts of quality 'missing' are not scored."""
    return F.when(_col(quality) != "missing", _col(score))


def contrast_index(detected: str | Column, chorus: str | Column, whole: str | Column) -> Column:
    return F.when(_col(detected), F.round(_col(chorus) - _col(whole), 4))


def energy_shift(detected: str | Column, chorus: str | Column, level: str | Column, bins: Sequence[float] = BINS) -> Column:
    """Whether the chorus has more or less energy than the whole."""
    own = bin_levels(chorus, bins)
    known = _col(detected) & _col(chorus).isNotNull() & _col(level).isNotNull()
    return F.when(known, F.when(own > _col(level), "increase").when(own < _col(level), "decrease").otherwise("stable"))


def theme_shift(detected: str | Column, themes: str | Column, tone: str | Column, chorus_tone: str | Column) -> Column:
    """A proxy by tones: 'none' where one is unknown or both agree, else 'minor'."""
    same = _col(tone).isNull() | _col(chorus_tone).isNull() | (_col(tone) == _col(chorus_tone))
    return F.when(_col(detected) & _col(themes).isNotNull(), F.when(same, "none").otherwise("minor"))


def jaccard_distance(a: str | Column, b: str | Column) -> Column:
    """1 - shared / all tags, 4 digits; two empty sets are equal."""
    together = F.size(F.array_union(_col(a), _col(b)))
    return F.when(together == 0, F.lit(0.0)).otherwise(F.round(1 - F.size(F.array_intersect(_col(a), _col(b))) / together, 4))


def jaccard_bucket(distance: str | Column) -> Column:
    d = _col(distance)
    return F.when(d.isNull(), F.lit(None).cast("string")).when(d == 0, "none").when(d <= 0.5, "minor").otherwise("major")


def normalised_weights(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Weights that add up to one; the defaults where none or a total of nothing is given."""
    given = {k: float((weights or WEIGHTS).get(k, WEIGHTS[k])) for k in WEIGHTS}
    total = sum(given.values())
    if total <= 0:
        given, total = dict(WEIGHTS), sum(WEIGHTS.values())
    return {k: v / total for k, v in given.items()}


def resonance_score(
    sentiment: str | Column = "sentiment_score",
    energy: str | Column = "energy_level",
    chorus: str | Column = "chorus_detected",
    quality: str | Column = "lyrics_quality",
    development: str | Column = "development_score",
    weights: Mapping[str, float] | None = None,
    renormalise_missing: bool = False,
) -> Column:
    """The weighted sum of five parts in 0..1, 6 digits. Null if sentiment, energy or development is;
    ``renormalise_missing`` weighs the known parts instead."""
    w = normalised_weights(weights)
    quality_part = F.lit(0.0)
    for label, value in QUALITY_SCORES.items():
        quality_part = F.when(_col(quality) == label, value).otherwise(quality_part)
    parts = {
        "sentiment": (clip(_col(sentiment).cast("double"), -1.0, 1.0) + 1) / 2,
        "energy": (clip(_col(energy).cast("double"), 1.0, 5.0) - 1) / 4,
        "chorus": F.coalesce(_col(chorus).cast("boolean"), F.lit(False)).cast("double"),
        "quality": quality_part,
        "jungian": (clip(_col(development).cast("double"), 1.0, 7.0) - 1) / 6,
    }
    if renormalise_missing:
        share = sum((F.when(p.isNotNull(), w[k]).otherwise(0.0) for k, p in parts.items()), F.lit(0.0))
        total = sum((F.coalesce(p, F.lit(0.0)) * w[k] for k, p in parts.items()), F.lit(0.0)) / share
    else:
        total = sum((p * w[k] for k, p in parts.items()), F.lit(0.0))
    return rounded(clip(total, 0.0, 1.0), 6)


def dominant_label(scores: str | Column, labels: Sequence[str]) -> Column:
    """The label with the highest score in a map; the first on ties, 0 for a label that is missing."""
    ranked = F.array(*(F.struct(F.coalesce(F.try_element_at(_col(scores), F.lit(label)), F.lit(0.0)).alias("s"), F.lit(-i).alias("p"), F.lit(label).alias("l")) for i, label in enumerate(labels)))
    return F.when(_col(scores).isNotNull(), F.array_max(ranked)["l"])


def ranked_tags(scores: str | Column, taxonomy: Sequence[str], threshold: float) -> Column:
    """Labels of the taxonomy whose score reaches the threshold, highest first; map order breaks ties."""
    entries = F.transform(F.map_entries(_col(scores)), lambda e, i: F.struct((-e["value"]).alias("s"), i.alias("i"), e["key"].alias("l")))
    kept = F.filter(entries, lambda e: (-e["s"] >= threshold) & e["l"].isin(list(taxonomy)))
    return F.transform(F.array_sort(kept), lambda e: e["l"])


def active_tags(scores: str | Column, taxonomy: Sequence[str], threshold: float = 0.40) -> Column:
    """``ranked_tags`` joined by '|', '' for none."""
    return F.array_join(ranked_tags(scores, taxonomy, threshold), "|")


def widened(scores: str | Column, labels: Sequence[str], prefix: str) -> list[Column]:
    """One column for each label."""
    return [F.try_element_at(_col(scores), F.lit(label)).alias(f"{prefix}_{label}") for label in labels]


def quality_flag(stage: str | Column, score: str | Column) -> Column:
    known = (F.coalesce(_col(stage), F.lit("unclassified")) != "unclassified") & _col(score).isNotNull()
    return F.when(known, "high").otherwise("low")
