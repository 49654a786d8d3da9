"""Configuration: frozen dataclasses with validation, read from YAML, and its hash.

The YAML has the sections ``dataset``, ``lyrics``, ``preprocessing``, ``analysis``, ``cultural_metrics``,
``cmi`` and ``output``; ``data`` is another name of the first. Unknown sections and keys are errors.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

# Labels and thresholds of the domain.
THEMES = ("love", "heartbreak", "party_celebration", "identity", "struggle", "rebellion", "wealth_success", "friendship", "nostalgia", "self_reflection", "empowerment", "unity")
EMOTIONS = ("joy", "sadness", "anger", "fear", "disgust", "surprise", "neutral")
STAGE_LABELS = ("shadow", "persona", "anima_animus", "integration", "transcendence", "unclassified")
DECADES = ("1960s*", "1970s", "1980s", "1990s", "2000s", "2010s", "2020s")
BUCKETS = (("1960s*", 1958, 1969), ("1970s", 1970, 1979), ("1980s", 1980, 1989), ("1990s", 1990, 1999), ("2000s", 2000, 2009), ("2010s", 2010, 2019), ("2020s", 2020, 2025))
WEIGHTS = {"sentiment": 0.25, "energy": 0.20, "chorus": 0.15, "quality": 0.20, "jungian": 0.20}
QUALITY_SCORES = {"full": 1.0, "partial": 0.5, "missing": 0.0}
FEATURE_VECTOR = ("sentiment_score", "energy_level", "themes_tfidf")
MODELS = {"chorus": "gpt-4o", "emotion": "j-hartmann/emotion-english-distilroberta-base", "theme": "facebook/bart-large-mnli", "stage": "gpt-4o"}


class ConfigError(ValueError):
    """A configuration that breaks a rule, or that can't be read."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def at_least(section: Any, low: float, *names: str) -> None:
    for name in names:
        value = getattr(section, name)
        require(isinstance(value, (int, float)) and value >= low, f"{name} must be a number from {low} on")


@dataclass(frozen=True)
class Bucket:
    label: str
    start: int
    end: int
    non_standard: bool = False

    def __post_init__(self) -> None:
        require(bool(str(self.label).strip()), "a bucket needs a label")
        require(self.end >= self.start, f"bucket {self.label} ends before it starts")


@dataclass(frozen=True)
class DataSection:
    start_year: int = 1958
    end_year: int = 2025
    decade_filter: str | None = None
    decade_buckets: tuple[Bucket, ...] = tuple(Bucket(*b, b[0] == "1960s*") for b in BUCKETS)
    fetch_coverage: float = 0.80

    def __post_init__(self) -> None:
        require(self.start_year >= 1900, "start_year is before 1900")
        require(self.end_year >= self.start_year, "end_year is before start_year")
        require(bool(self.decade_buckets), "decade_buckets is empty")


@dataclass(frozen=True)
class LyricsSection:
    cache_dir: str = "cache/lyrics"
    min_token_threshold: int = 50
    partial_token_threshold: int = 150
    genius_sleep_time: float = 0.5
    genius_max_retries: int = 3

    def __post_init__(self) -> None:
        at_least(self, 1, "min_token_threshold", "partial_token_threshold")
        at_least(self, 0, "genius_sleep_time", "genius_max_retries")


@dataclass(frozen=True)
class PreprocessingSection:
    chorus_tier1_tag_pattern: str = r"\[(chorus|hook|refrain)(\s+\d+)?\]"
    chorus_tier2_min_repetitions: int = 3
    chorus_tier2_min_tokens: int = 6
    chorus_tier3_model: str = MODELS["chorus"]
    chorus_max_tokens: int = 200

    def __post_init__(self) -> None:
        at_least(self, 1, "chorus_tier2_min_repetitions", "chorus_tier2_min_tokens", "chorus_max_tokens")


@dataclass(frozen=True)
class AnalysisSection:
    bins: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)
    emotion_model: str = MODELS["emotion"]
    emotion_batch_size: int = 16
    theme_model: str = MODELS["theme"]
    theme_threshold: float = 0.40
    theme_batch_size: int = 8
    theme_taxonomy: tuple[str, ...] = THEMES
    coverage_gate_threshold: float = 0.85
    jungian_model: str = MODELS["stage"]
    jungian_batch_size: int = 5
    jungian_inter_batch_sleep: float = 1.0
    jungian_max_retries: int = 3
    jungian_valid_stages: tuple[str, ...] = STAGE_LABELS
    jungian_dev_score_min: int = 1
    jungian_dev_score_max: int = 7

    def __post_init__(self) -> None:
        require(bool(self.bins), "energy bins are empty")
        require(list(self.bins) == sorted(self.bins), "energy bins must ascend")
        require(all(0 < b < 1 for b in self.bins), "energy bins must lie between 0 and 1")
        require(bool(self.theme_taxonomy), "theme_taxonomy is empty")
        require(self.jungian_dev_score_max >= self.jungian_dev_score_min, "score range is empty")
        require(set(self.jungian_valid_stages) <= set(STAGE_LABELS), "jungian_valid_stages has a label that no schema knows")
        at_least(self, 1, "emotion_batch_size", "theme_batch_size", "jungian_batch_size")
        at_least(self, 0, "jungian_inter_batch_sleep", "jungian_max_retries", "theme_threshold", "coverage_gate_threshold")
        require(max(self.theme_threshold, self.coverage_gate_threshold) <= 1, "a threshold is above 1")


@dataclass(frozen=True)
class IndexSection:
    """Weights of the resonance score, scaled to a sum of 1, and the index's gate and list lengths."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    coverage_threshold: float = 0.60
    top_themes: int = 5
    top_titles: int = 3

    def __post_init__(self) -> None:
        require(set(self.weights) == set(WEIGHTS), f"weights must name {', '.join(WEIGHTS)}")
        total = sum(self.weights.values())
        object.__setattr__(self, "weights", {k: v / total for k, v in self.weights.items()} if total > 0 else dict(WEIGHTS))


@dataclass(frozen=True)
class CulturalSection:
    """Settings that the index's formula doesn't read; they count for the hash."""

    normalization: str = "minmax_within_decade"
    feature_vector: tuple[str, ...] = FEATURE_VECTOR
    top_resonance_songs_per_decade: int = 5

    def __post_init__(self) -> None:
        at_least(self, 1, "top_resonance_songs_per_decade")


@dataclass(frozen=True)
class OutputSection:
    output_dir: str = "outputs"
    save_visualizations: bool = True
    visualization_format: str = "svg"
    visualization_scale: float = 2.0
    report_format: str = "html"
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        at_least(self, 0.1, "visualization_scale")
        require(self.report_format == "html", "report_format must be html")


@dataclass(frozen=True)
class Config:
    data: DataSection = DataSection()
    lyrics: LyricsSection = LyricsSection()
    preprocessing: PreprocessingSection = PreprocessingSection()
    analysis: AnalysisSection = AnalysisSection()
    cmi: IndexSection = field(default_factory=IndexSection)
    cultural_metrics: CulturalSection = CulturalSection()
    output: OutputSection = OutputSection()

    def digest(self) -> str:
        """The first 8 hexadecimal digits of the MD5 of the configuration as sorted JSON."""
        return hashlib.md5(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()[:8]


SECTIONS = {"data": DataSection, "lyrics": LyricsSection, "preprocessing": PreprocessingSection, "analysis": AnalysisSection, "cmi": IndexSection, "cultural_metrics": CulturalSection, "output": OutputSection}
#: Other names of sections and keys.
SECTION_NAMES = {"dataset": "data"}
KEY_NAMES = {"data": {"sample_start_year": "start_year", "sample_end_year": "end_year"}, "cmi": {"min_coverage_pct": "coverage_threshold"}}


def _section(name: str, kind: type, values: Any) -> Any:
    """A section from its mapping."""
    require(values is None or isinstance(values, dict), f"{name}: not a mapping")
    known = {f.name for f in dataclasses.fields(kind)}
    made: dict[str, Any] = {}
    for key, value in (values or {}).items():
        key = KEY_NAMES.get(name, {}).get(key, key)
        if name == "analysis" and key == "energy_level":
            require(isinstance(value, dict) and set(value) == {"bins"}, "analysis.energy_level has one key, bins")
            key, value = "bins", value["bins"]
        if name == "cmi" and key.startswith("weight_"):
            made["weights"] = made.get("weights", dict(WEIGHTS)) | {key.removeprefix("weight_"): value}
            continue
        require(key in known, f"{name}.{key} is no setting")
        if value is None and key != "decade_filter":
            continue
        if key == "decade_buckets":
            value = [_section("decade_buckets", Bucket, b) for b in value]
        made[key] = tuple(value) if isinstance(value, list) else value
    try:
        return kind(**made)
    except TypeError as error:
        raise ConfigError(f"{name}: {error}") from error


def from_mapping(values: dict[str, Any]) -> Config:
    named: dict[str, Any] = {}
    for name, section in values.items():
        name = SECTION_NAMES.get(name, name)
        require(name in SECTIONS, f"{name} is no section")
        require(name not in named, f"{name} is there twice")
        named[name] = section
    return Config(**{name: _section(name, kind, named.get(name)) for name, kind in SECTIONS.items()})


def load_config(path: str | Path, start_year: int | None = None, end_year: int | None = None) -> Config:
    """Read YAML; years given here replace those of the file and are validated with the rest."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no configuration at {file}")
    try:
        values = yaml.safe_load(file.read_text()) or {}
    except yaml.YAMLError as error:
        raise ConfigError(f"{file}: {error}") from error
    require(isinstance(values, dict), f"{file}: not a mapping")
    years = {k: v for k, v in (("start_year", start_year), ("end_year", end_year)) if v is not None}
    section = "dataset" if "dataset" in values else "data"
    given = values.get(section) or {}
    require(isinstance(given, dict), f"{section}: not a mapping")
    other = {new: old for old, new in KEY_NAMES["data"].items()}
    kept = {k: v for k, v in given.items() if k not in years and k not in {other[y] for y in years}}
    return from_mapping(values | {section: kept | years})
