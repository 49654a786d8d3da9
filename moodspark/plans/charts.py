"""The five charts: their data as DataFrames, their pictures as SVG and their sidecar facts."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.config import DECADES, EMOTIONS, STAGE_LABELS, THEMES
from moodspark.operators.aggregates import distribution_summary, label_share, tag_penetration_pivot
from moodspark.operators.windows import canonical_place, canonical_sort
from moodspark.plans import drawing
from moodspark.sources.files import write_atomic, write_text

log = logging.getLogger(__name__)
MOST_ROWS = 5_000
STAGES_SHOWN = tuple(s for s in STAGE_LABELS if s != "unclassified")


def sentiment_trend(index: DataFrame) -> DataFrame:
    """Mean sentiment and energy by cohort, in canonical order."""
    return canonical_sort(index.where(F.col("CMI_sentiment").isNotNull()).select("decade_label", "CMI_sentiment", "CMI_energy"), "decade_label", DECADES)


def emotion_mix(layer4: DataFrame) -> DataFrame:
    return label_share(layer4, "decade", "emotional_tone", EMOTIONS)


def stage_mix(layer4: DataFrame, layer5: DataFrame) -> DataFrame:
    """Stages come from layer 5, which is joined here."""
    return label_share(layer4.drop("jung_stage").join(layer5.select("song_id", "jung_stage"), "song_id", "left"), "decade", "jung_stage", STAGES_SHOWN)


def theme_heatmap(layer4: DataFrame) -> DataFrame:
    return tag_penetration_pivot(layer4, "decade", "themes", DECADES).where(F.col("tag").isin(list(THEMES)))


def resonance_spread(layer4: DataFrame, layer6: DataFrame) -> DataFrame:
    scored = layer4.select("song_id", "decade").join(layer6.select("song_id", "cultural_resonance_score"), "song_id", "left")
    return canonical_sort(distribution_summary(scored, "decade", "cultural_resonance_score"), "decade", DECADES)


class ChartError(ValueError):
    """A chart has more rows than a picture can show."""


def rows_of(data: DataFrame) -> list[dict]:
    """The rows of a chart, a few for each cohort; too many are an error, never cut."""
    rows = [r.asDict() for r in data.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ChartError(f"a chart shows {MOST_ROWS} rows at most")
    return rows


def picture(name: str, data: DataFrame) -> str:
    """A chart as SVG."""
    rows = rows_of(data)
    title = name.replace("_", " ").capitalize()
    if name == "sentiment_trend":
        return drawing.lines(rows, "decade_label", ("CMI_sentiment", "CMI_energy"), title)
    if name == "theme_heatmap":
        cohorts = [c for c in data.columns if c != "tag"]
        return drawing.heatmap(sorted(rows, key=lambda r: r["tag"]), "tag", cohorts, title)
    if name == "resonance_spread":
        return drawing.boxes(rows, "decade", title)
    label, parts = ("emotional_tone", EMOTIONS) if name == "emotion_mix" else ("jung_stage", STAGES_SHOWN)
    value = next(c for c in data.columns if c not in ("decade", label, "n"))
    return drawing.stacked(rows, "decade", label, value, title, ordered([str(r["decade"]) for r in rows]), parts)


def write_all(charts: dict[str, Callable[[], DataFrame]], folder: str, digest: str, draw: bool = True) -> dict[str, str]:
    """Write each chart's data, picture and facts; one that fails is logged and left out. The pictures of those written."""
    done = {}
    for name, make in charts.items():
        try:
            data = make()
            spark = data.sparkSession
            write_atomic(data, f"{folder}/{name}")
            written = spark.read.schema(data.schema).parquet(f"{folder}/{name}")
            image = picture(name, in_order(written)) if draw else ""
            if draw:
                write_text(spark, f"{folder}/{name}.svg", image)
            write_text(spark, f"{folder}/{name}.meta.json", json.dumps({"chart": name, "config_hash": digest, "columns": data.columns, "picture": f"{name}.svg" if draw else None}))
            done[name] = image
        except Exception:  # noqa: BLE001 - one chart must not stop the others
            log.exception("chart %s failed", name)
    return done


def in_order(data: DataFrame) -> DataFrame:
    """Cohorts in canonical order, as files keep none."""
    column = next((c for c in ("decade_label", "decade") if c in data.columns), None)
    return canonical_sort(data, column, DECADES) if column else data


def rgba(colour: str, alpha: float) -> str:
    """'#rrggbb' with an opacity as rgba(...)."""
    digits = colour.removeprefix("#")
    if len(digits) != 6 or any(c not in "0123456789abcdefABCDEF" for c in digits):
        raise ValueError(f"not a colour of six hexadecimal digits: {colour!r}")
    if not 0 <= alpha <= 1:
        raise ValueError(f"opacity {alpha} is not between 0 and 1")
    return "rgba({}, {}, {}, {})".format(*(int(digits[i : i + 2], 16) for i in (0, 2, 4)), alpha)


def ordered(labels: Sequence[str]) -> list[str]:
    """Known labels in canonical order, others after them by alphabet."""
    known = [x for x in DECADES if x in labels]
    return known + sorted(set(labels) - set(known))


__all__ = ["canonical_place", "emotion_mix", "picture", "ordered", "resonance_spread", "rgba", "sentiment_trend", "stage_mix", "theme_heatmap", "write_all"]
