"""Table schemas: casting, and all violations in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.config import DECADES, EMOTIONS, STAGE_LABELS, THEMES
from moodspark.functions.text import split_tags


class SchemaError(ValueError):
    """Rows that break a schema; ``cases`` holds a sample of them."""

    def __init__(self, table: str, cases: list) -> None:
        super().__init__(f"{table}: {len(cases)} failure cases, the first: {cases[:3]}")
        self.cases = cases


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple = ()
    pattern: str | None = None
    tags_of: tuple[str, ...] = ()

    def rules(self) -> list[tuple[str, Column]]:
        """(rule, condition under which a cast value breaks it)."""
        c = F.col(self.name)
        out: list[tuple[str, Column]] = [] if self.nullable else [("not_null", c.isNull())]
        if self.low is not None:
            out.append((f">={self.low}", c < self.low))
        if self.high is not None:
            out.append((f"<={self.high}", c > self.high))
        if self.allowed:
            out.append(("allowed", c.isNotNull() & ~c.isin(list(self.allowed))))
        if self.pattern:
            out.append(("pattern", ~c.rlike(self.pattern)))
        if self.tags_of:
            out.append(("tags", F.exists(split_tags(c), lambda t: ~t.isin(list(self.tags_of)))))
        return out


@dataclass(frozen=True)
class TableSchema:
    name: str
    fields: tuple[Field, ...]

    def conform(self, df: DataFrame) -> DataFrame:
        """Cast known columns, null for what can't be cast; other columns pass, missing ones are added as null."""
        known = {f.name for f in self.fields}
        cast = [(F.col(f.name).try_cast(f.kind) if f.name in df.columns else F.lit(None).cast(f.kind)).alias(f.name) for f in self.fields]
        return df.select(*cast, *(c for c in df.columns if c not in known))

    def violations(self, df: DataFrame) -> DataFrame:
        """(column, rule, value) of every broken rule, in a single pass over the rows."""
        raw = [F.col(f.name).cast("string").alias(f"__raw_{f.name}") if f.name in df.columns else F.lit(None).cast("string").alias(f"__raw_{f.name}") for f in self.fields]
        known = {f.name for f in self.fields}
        cast = df.select(*raw, *((F.col(f.name).try_cast(f.kind) if f.name in df.columns else F.lit(None).cast(f.kind)).alias(f.name) for f in self.fields if f.name in known))
        cases = []
        for f in self.fields:
            value = F.col(f"__raw_{f.name}")
            case = lambda rule, value=value, f=f: F.struct(F.lit(f.name).alias("column"), F.lit(rule).alias("rule"), value.alias("value"))
            cases.append(F.when(value.isNotNull() & F.col(f.name).isNull(), case("type")))
            cases += [F.when(F.coalesce(broken, F.lit(False)) & ~(value.isNotNull() & F.col(f.name).isNull()), case(rule)) for rule, broken in f.rules()]
        found = F.filter(F.array(*cases), lambda x: x.isNotNull())
        return cast.select(F.explode(found).alias("f")).select("f.*")

    def check(self, df: DataFrame, sample: int = 100) -> None:
        """Raise with a sample of the failure cases, if there are any."""
        cases = self.violations(df).limit(sample).collect()
        if cases:
            raise SchemaError(self.name, [tuple(c) for c in cases])

    def conforms(self, df: DataFrame) -> bool:
        """Whether the columns and their types are the schema's already, so that casting would change nothing."""
        return [(f.name, f.dataType.simpleString()) for f in self.conform(df).schema.fields] == [(f.name, f.dataType.simpleString()) for f in df.schema.fields]

    def validate(self, df: DataFrame, sample: int = 100) -> DataFrame:
        """The conformed rows; raises with a sample of the failure cases."""
        self.check(df, sample)
        return self.conform(df)


ID = Field("song_id", "string", pattern="^[0-9a-f]{16}$")
TITLES = (Field("song_title", "string"), Field("artist", "string"), Field("year", "long", low=1958, high=2030), Field("decade", "string", allowed=DECADES))
PERSPECTIVES = ("first_person", "second_person", "third_person", "abstract")
QUALITIES = ("full", "partial", "missing")
METHODS = ("tag", "repetition", "llm", "none")
CLEANED = (
    Field("lyrics_clean", "string", True),
    Field("lyrics_verse_only", "string", True),
    Field("lyrics_quality", "string", allowed=QUALITIES),
    Field("narrative_perspective", "string", True, allowed=PERSPECTIVES),
    Field("has_section_tags", "boolean"),
    Field("section_count", "long", low=0),
)
CHORUS = (Field("chorus_detected", "boolean"), Field("chorus_method", "string", allowed=METHODS), Field("chorus_text", "string", True), Field("chorus_token_count", "long", low=0))
SENTIMENT = (Field("sentiment_score", "double", True, -1, 1), Field("energy_level", "long", True, allowed=(1, 2, 3, 4, 5)))
EMOTION = (Field("emotional_tone", "string", True, allowed=EMOTIONS), Field("chorus_sentiment_score", "double", True, -1, 1), Field("chorus_emotional_tone", "string", True, allowed=EMOTIONS))
SHIFTS = (Field("contrast_sentiment_index", "double", True), Field("energy_shift", "string", True, allowed=("increase", "decrease", "stable")), Field("theme_shift", "string", True, allowed=("none", "minor", "major")))
STAGE = (Field("jung_stage", "string", allowed=STAGE_LABELS), Field("psychological_theme", "string", True), Field("development_score", "long", True, 1, 7), Field("jungian_quality_flag", "string", True, allowed=("high", "low")))

SCHEMAS = {
    s.name: s
    for s in (
        TableSchema("metadata", (ID, *TITLES, Field("chart_rank", "long", True, 1, 100), Field("chart_weeks_on", "long", True, 0))),
        TableSchema("cleaned", (ID, *TITLES, *CLEANED)),
        TableSchema("chorus", (ID, *CHORUS)),
        TableSchema("layer2_sentiment", (ID, *SENTIMENT)),
        TableSchema("layer2_emotion", (ID, *EMOTION)),
        TableSchema("layer2_themes", (ID, Field("themes", "string", True, tags_of=THEMES))),
        TableSchema("layer4", (ID, *TITLES, *CLEANED[2:], *CHORUS[:2], CHORUS[3], *SENTIMENT, *EMOTION, Field("themes", "string", True), *SHIFTS)),
        TableSchema("layer5", (ID, *STAGE)),
        TableSchema("layer6", (ID, Field("cultural_resonance_score", "double", True, 0, 1))),
        TableSchema(
            "decade_cmi",
            (
                Field("decade_label", "string", allowed=DECADES),
                Field("song_count", "long", low=0),
                Field("scored_count", "long", low=0),
                Field("CMI_sentiment", "double", True, -1, 1),
                Field("CMI_energy", "double", True, 1, 5),
                Field("emotional_tone", "string", True, allowed=EMOTIONS),
                Field("dominant_jung_stage", "string", True, allowed=STAGE_LABELS),
                Field("top_themes", "string", True),
                Field("top_resonance_songs", "string", True),
            ),
        ),
    )
}
