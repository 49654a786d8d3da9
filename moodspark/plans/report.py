"""A self-contained HTML report from aggregates that have one row per cohort or label."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.config import DECADES
from moodspark.operators.aggregates import extreme_cohort, label_distribution
from moodspark.operators.windows import canonical_place

#: Cohorts that a report can show; more are an error.
MOST_ROWS = 200


class ReportError(ValueError):
    """There are more cohorts than a report can show."""


def signed(value: float | None) -> str:
    return "n/a" if value is None else f"{value:+.3f}"


def bar_width(value: float | None) -> int:
    return int(abs(value or 0.0) * 100)


def summary(index: DataFrame) -> dict[str, object]:
    """Totals and the most and least positive cohorts; the first in order on ties."""
    totals = index.agg(F.sum("song_count").alias("songs"), F.sum("scored_count").alias("scored")).first()
    placed = index.withColumn("place", canonical_place("decade_label", DECADES))
    pick = lambda largest: extreme_cohort(placed, "decade_label", "CMI_sentiment", "place", largest).first()["decade_label"]
    return {"songs": totals["songs"] or 0, "scored": totals["scored"] or 0, "highest": pick(True), "lowest": pick(False)}


def build(index: DataFrame, layer4: DataFrame, title: str = "Mood report", pictures: dict[str, str] | None = None) -> str:
    """The report's HTML; ``pictures`` are SVG charts by name, which it holds in itself."""
    facts = summary(index)
    rows = index.withColumn("place", canonical_place("decade_label", DECADES)).orderBy("place", "decade_label").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ReportError(f"a report shows {MOST_ROWS} cohorts at most")
    tones = label_distribution(layer4, "emotional_tone").orderBy(F.col("n").desc(), "emotional_tone").collect()
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    lines = [
        "<!doctype html><html><head><meta charset='utf-8'>",
        f"<title>{html.escape(title)}</title><style>table{{border-collapse:collapse}}td,th{{padding:4px 8px}}.bar{{background:#888;height:8px}}</style></head><body>",
        f"<h1>{html.escape(title)}</h1><p>{facts['songs']} songs, {facts['scored']} scored. Most positive: {html.escape(str(facts['highest']))}; least: {html.escape(str(facts['lowest']))}.</p>",
        "<table><tr><th>Cohort</th><th>Songs</th><th>Sentiment</th><th></th><th>Energy</th><th>Tone</th><th>Stage</th><th>Themes</th><th>Top</th></tr>",
    ]
    for r in rows:
        bar = f"<td><div class='bar' style='width:{bar_width(r['CMI_sentiment'])}px'></div></td>"
        energy = None if r["CMI_energy"] is None else f"{r['CMI_energy']:.2f}"
        lines.append("<tr>" + cell(r["decade_label"]) + cell(r["song_count"]) + cell(signed(r["CMI_sentiment"])) + bar + "".join(map(cell, (energy, r["emotional_tone"], r["dominant_jung_stage"], r["top_themes"], r["top_resonance_songs"]))) + "</tr>")
    lines.append("</table><table><tr><th>Tone</th><th>Songs</th><th>%</th></tr>")
    lines += [f"<tr>{cell(str(r['emotional_tone']).capitalize())}{cell(r['n'])}{cell(round(r['pct'], 1))}</tr>" for r in tones]
    lines.append("</table>")
    lines += [f"<figure><figcaption>{html.escape(name.replace('_', ' ').capitalize())}</figcaption>{image}</figure>" for name, image in (pictures or {}).items() if image]
    return "".join([*lines, "</body></html>"])
