"""The stages of a run: a registry, a sequential runner and a command line.

Each stage reads its inputs as Parquet and gives one lazy plan, which is written once, beside its
target. Schema and gate look at the written rows; only what passes takes the target's place. Then the
checkpoint is written. Only the runner knows checkpoints, so forcing forces.
"""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import sys
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.config import EMOTIONS, Config, ConfigError, load_config
from moodspark.functions import replies, scores, text
from moodspark.operators import aggregates, filters, index, joins, keys, labels, opinions, providers, sections, windows
from moodspark.plans import charts, checkpoints, report
from moodspark.plans.schemas import SCHEMAS, SchemaError
from moodspark.sources import cache, feed, replylog
from moodspark.sources.files import MissingInputError, exists, read_csv, require_path, write_atomic, write_text

log = logging.getLogger(__name__)
TEXTS = "song_id string, lyrics string"


@dataclass
class Run:
    """What a stage works with."""

    spark: SparkSession
    config: Config
    root: str
    #: A function from prompt to reply, or None to leave every row unclassified.
    chat: Callable[[str], str] | None = None
    #: The lexicons of the two scorers of the ensemble, as files; None for the built-in word lists.
    valences: str | None = None
    polarities: str | None = None
    #: Saved models of label scores, as folders; None for digests of the text, which mean nothing.
    emotion_model: str | None = None
    theme_model: str | None = None
    #: A function from title and artist to a text or None, or None to take the texts of ``lyrics.csv``.
    lookup: Callable[[str, str], str | None] | None = None

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def kept(self, name: str, frame: DataFrame) -> DataFrame:
        """The frame, written beside the stages' outputs and read back."""
        write_atomic(frame, self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def landed(self) -> DataFrame:
        return feed.read_feed(self.spark, require_path(self.spark, self.path("landing"), "the fetcher"))

    def covered(self, calendar: DataFrame, landed: DataFrame) -> None:
        feed.enforce_feed_coverage(feed.feed_coverage(calendar, landed), self.config.data.fetch_coverage)

    def texts(self) -> DataFrame:
        return read_csv(self.spark, require_path(self.spark, self.path("lyrics.csv"), "the fetcher"), TEXTS)

    def read(self, name: str) -> DataFrame:
        maker = next((s.name for s in STAGES if s.output == name), "ingest")
        return self.spark.read.parquet(require_path(self.spark, self.path(name), maker))


@dataclass(frozen=True)
class Stage:
    name: str
    build: Callable[[Run], DataFrame]
    output: str
    schema: str | None = None
    gate: Callable[[Run, DataFrame], object] | None = None
    #: What it reads: names below the root, and fields of the run that hold a path or None.
    inputs: tuple[str, ...] = ()
    settings: tuple[str, ...] = ()
    #: Columns whose values should be a row's own; the log names those that aren't.
    key: tuple[str, ...] = ("song_id",)

    def sources(self, run: Run) -> dict[str, str | None]:
        """The paths that the output follows from, by name."""
        return {name: run.path(name) for name in self.inputs} | {name: getattr(run, name) for name in self.settings}


def ingest(run: Run) -> DataFrame:
    """Landed weeks to canonical songs with ids and cohorts."""
    data = run.config.data
    landed = feed.explode_weekly_feed(run.landed())
    run.covered(feed.week_calendar(run.spark, data.start_year, data.end_year), landed)
    songs = aggregates.dedupe_canonical(landed, ("chart_date", "position"))
    buckets = [(b.label, b.start, b.end) for b in data.decade_buckets]
    year = F.year("first_chart_date").cast("long")
    songs = songs.select(
        text.normalise_spacing("title").alias("song_title"), text.normalise_spacing("artist").alias("artist"), year.alias("year"), "chart_rank", "chart_weeks_on", "first_chart_date"
    ).withColumn("decade", joins.range_bucket_case("year", buckets))
    songs = songs.where(F.col("decade").isNotNull()).withColumn("song_id", text.entity_id("artist", "song_title", "year"))
    return filters.filter_cohort(songs, "decade", data.decade_filter)


def lyrics(run: Run) -> DataFrame:
    """Texts with their quality; a song without a text is 'missing'.

    With a lookup, what the cache of records lacks is looked up and added to it before anything reads it;
    without one, the texts come from a file that a fetcher has left.
    """
    songs = run.read("metadata")
    rules = run.config.lyrics
    if run.lookup is not None:
        cached = run.path(rules.cache_dir)
        cache.fill(songs, cached, run.lookup, tries=max(1, rules.genius_max_retries), pause=rules.genius_sleep_time)
        raw = cache.read_cache(run.spark, cached).select("song_id", "lyrics")
    else:
        raw = run.texts()
    body = text.strip_header("lyrics")
    joined = joins.left_join_pruned(songs, raw, "song_id", ["lyrics"])
    return joined.withColumn("lyrics_raw", F.coalesce(body, F.lit(""))).drop("lyrics").withColumn("lyrics_quality", scores.quality_tier(text.token_count("lyrics_raw"), rules.min_token_threshold, rules.partial_token_threshold))


def cleaning(run: Run) -> DataFrame:
    """Cleaned texts and their features; tags are looked at before they are stripped."""
    rows = run.read("lyrics")
    verses = sections.extract_sections("lyrics_raw")
    return rows.select(
        "song_id", "song_title", "artist", "year", "decade", "lyrics_raw", "lyrics_quality",
        text.clean_text("lyrics_raw").alias("lyrics_clean"),
        text.tidy_lines(text.straight_quotes(text.without_tags(verses))).alias("lyrics_verse_only"),
        text.has_tags("lyrics_raw").alias("has_section_tags"),
        text.tag_count("lyrics_raw").alias("section_count"),
    ).withColumn("narrative_perspective", text.perspective("lyrics_clean"))


def chorus(run: Run) -> DataFrame:
    rules = run.config.preprocessing
    rows = run.read("cleaned").select("song_id", "lyrics_raw")
    return rows.select("song_id", *sections.chorus_cascade("lyrics_raw", pattern=f"(?i){rules.chorus_tier1_tag_pattern}", least_times=rules.chorus_tier2_min_repetitions, least_tokens=rules.chorus_tier2_min_tokens))


def opinion(run: Run, rows: DataFrame, column: str, out: str) -> DataFrame:
    """The ensemble of two scorers: ``song_id`` and ``out``."""
    return opinions.ensemble(rows, ["song_id"], column, opinions.read_valences(run.spark, run.valences), opinions.read_polarities(run.spark, run.polarities), out=out)


def sentiment(run: Run) -> DataFrame:
    rows = run.read("cleaned").select("song_id", "lyrics_quality", text.coalesce_nonblank("lyrics_clean", "lyrics_verse_only").alias("__text"))
    scored = rows.join(opinion(run, rows, "__text", "__score"), "song_id").select("song_id", scores.scored_unless_missing("lyrics_quality", F.col("__score")).alias("sentiment_score"))
    return scored.withColumn("energy_level", scores.bin_levels("sentiment_score", run.config.analysis.bins))


def label_scores(run: Run, rows: DataFrame, column: str, known: Sequence[str], model: str | None, batch: int, out: str, independent: bool = False) -> DataFrame:
    """``song_id`` and a map of scores by the saved model, or by the stand-in. Labels that a model lacks score 0."""
    if model is None:
        return rows.select("song_id", providers.classify(text.model_input(column), known, providers.hashed_labels(known, independent), batch).alias(out))
    scored = labels.bayes_scores(rows.select("song_id", text.model_input(column).alias("__input")), ["song_id"], "__input", labels.read_model(run.spark, model), out="__found")
    names = F.array(*map(F.lit, known))
    return scored.select("song_id", F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(F.element_at("__found", n), F.lit(0.0)))).alias(out))


def emotion(run: Run) -> DataFrame:
    """Tones of the whole and of the chorus, which is scored by the same scorers."""
    rows = run.read("chorus").join(run.read("cleaned").select("song_id", "lyrics_clean", "lyrics_quality"), "song_id")
    batch, model = run.config.analysis.emotion_batch_size, run.emotion_model
    both = rows.join(label_scores(run, rows, "lyrics_clean", EMOTIONS, model, batch, "__whole"), "song_id").join(label_scores(run, rows, "chorus_text", EMOTIONS, model, batch, "__part"), "song_id")
    both = both.join(opinion(run, rows, "chorus_text", "__opinion"), "song_id")
    known = F.col("lyrics_quality") != "missing"
    return both.select(
        "song_id",
        F.when(known, scores.dominant_label("__whole", EMOTIONS)).alias("emotional_tone"),
        F.when(known & F.col("chorus_detected"), F.col("__opinion")).alias("chorus_sentiment_score"),
        F.when(known & F.col("chorus_detected"), scores.dominant_label("__part", EMOTIONS)).alias("chorus_emotional_tone"),
        *scores.widened("__whole", EMOTIONS, "emotion"),
    )


def themes(run: Run) -> DataFrame:
    """Themes that reach the threshold; none is null, as later stages expect."""
    rules = run.config.analysis
    rows = label_scores(run, run.read("cleaned"), "lyrics_clean", rules.theme_taxonomy, run.theme_model, rules.theme_batch_size, "s", independent=True)
    return rows.select("song_id", F.nullif(scores.active_tags("s", rules.theme_taxonomy, rules.theme_threshold), F.lit("")).alias("themes"), *scores.widened("s", rules.theme_taxonomy, "theme"))


def layers(run: Run) -> DataFrame:
    """All layers on the cleaned songs, the contrast columns and the coverage gate."""
    spine = run.read("cleaned").drop("lyrics_raw")
    joined = joins.left_join_layers(spine, [(run.read("sentiment"), "_sent"), (run.read("emotion"), "_emo"), (run.read("themes"), "_thm"), (run.read("chorus").drop("chorus_text"), "_cho")], "song_id")
    joined = filters.fill_nulls(joined, {"chorus_detected": False, "chorus_method": "none", "chorus_token_count": 0})
    return index.contrast(filters.filter_cohort(joined, "decade", run.config.data.decade_filter), run.config.analysis.bins)


def stage_labels(run: Run) -> DataFrame:
    """Stage labels by a chat provider in batches, or none; a batch that fails is unclassified."""
    rows = run.read("layer4").select("song_id", "song_title", "artist", "decade", "themes", "emotional_tone")
    if run.chat is None:
        out = providers.without_provider(rows.select("song_id"))
    else:
        rules = run.config.analysis
        # Batches are written and keep their numbers; replies are logged round by round, so a run that stops goes on there.
        batched = run.kept("layer5.batches", windows.batch_assign(rows, rules.jungian_batch_size, ["song_id"]))
        prompts = providers.prompt_lines(batched, "batch_id", ["song_id"])
        answers = replylog.ask(prompts, run.path("layer5.replies"), run.chat, tries=max(1, rules.jungian_max_retries), between=rules.jungian_inter_batch_sleep)
        records = replies.parse_replies(answers)
        met = replies.reconcile(batched.select("batch_id", "song_id"), records)
        out = met.select("song_id", F.coalesce("jung_stage", F.lit("unclassified")).alias("jung_stage"), "psychological_theme", "development_score")
    return out.withColumn("jungian_quality_flag", scores.quality_flag("jung_stage", "development_score"))


def resonance(run: Run) -> DataFrame:
    rules = run.config.cmi
    joined = joins.left_join_pruned(run.read("layer4"), run.read("layer5"), "song_id", ["jung_stage", "development_score"])
    return index.with_resonance(joined, weights=rules.weights, renormalise_missing=run.chat is None)


def mood_index(run: Run) -> DataFrame:
    rules = run.config.cmi
    return index.cohort_mood_index(run.read("layer6"), ["song_id"], top_themes=rules.top_themes, top_titles=rules.top_titles)


LEXICONS = ("valences", "polarities")
STAGES = (
    Stage("FEED_FETCH", ingest, "metadata", "metadata", inputs=("landing",)),
    Stage("LYRICS_FETCH", lyrics, "lyrics", inputs=("metadata", "lyrics.csv")),
    Stage("TEXT_CLEANING", cleaning, "cleaned", "cleaned", inputs=("lyrics",)),
    Stage("CHORUS_DETECTION", chorus, "chorus", "chorus", inputs=("cleaned",)),
    Stage("SENTIMENT", sentiment, "sentiment", "layer2_sentiment", inputs=("cleaned",), settings=LEXICONS),
    Stage("EMOTION", emotion, "emotion", "layer2_emotion", inputs=("chorus", "cleaned"), settings=("emotion_model", *LEXICONS)),
    Stage("THEMES", themes, "themes", "layer2_themes", inputs=("cleaned",), settings=("theme_model",)),
    Stage("CONTRAST", layers, "layer4", "layer4", lambda run, rows: index.enforce_coverage(rows, run.config.analysis.coverage_gate_threshold), inputs=("cleaned", "sentiment", "emotion", "themes", "chorus")),
    Stage("JUNGIAN", stage_labels, "layer5", "layer5", inputs=("layer4",)),
    Stage("RESONANCE", resonance, "layer6", "layer6", lambda run, rows: index.enforce_nonnull(rows, threshold=run.config.cmi.coverage_threshold), inputs=("layer4", "layer5")),
    Stage("CULTURAL_METRICS", mood_index, "decade_cmi", "decade_cmi", inputs=("layer6",), key=("decade_label",)),
)


def select(names: Sequence[str] | None) -> list[Stage]:
    """The named stages in registry order, or all."""
    if not names:
        return list(STAGES)
    known = {s.name for s in STAGES}
    if unknown := [n for n in names if n not in known]:
        raise ConfigError(f"no such stages: {', '.join(unknown)}")
    return [s for s in STAGES if s.name in names]


def run_stage(run: Run, stage: Stage, force: bool = False) -> bool:
    """Whether the stage ran; it is skipped while its checkpoint is current: same configuration, same inputs.

    What it is made from is noted before it is built, so an input that changes meanwhile makes the output stale.
    """
    digest, output = run.config.digest(), run.path(stage.output)
    made_from = checkpoints.fingerprint(run.spark, stage.name, digest, stage.sources(run))
    if not force and checkpoints.is_current(run.spark, output, digest, made_from):
        log.info("%s: current, skipped", stage.name)
        return False
    began = time.monotonic()

    def check(rows: DataFrame) -> DataFrame | None:
        """Validate what was written; rows whose types the schema changes are written anew from it."""
        if stage.gate:
            stage.gate(run, rows)
        if stage.schema:
            schema = SCHEMAS[stage.schema]
            schema.check(rows)
            if shared := keys.shared_keys(rows, stage.key):
                log.warning("%s: rows share %s and will multiply in joins, such as %s", stage.name, ", ".join(stage.key), shared[:3])
            return None if schema.conforms(rows) else schema.conform(rows)
        return None

    write_atomic(stage.build(run), output, check=check)
    checkpoints.mark(run.spark, output, stage.name, digest, made_from=made_from)
    log.info("%s: %.1f s", stage.name, time.monotonic() - began)
    return True


def draw(run: Run) -> list[str]:
    """Chart data and the report, from the outputs of the stages."""
    layer4, layer5, layer6, idx = (run.read(n) for n in ("layer4", "layer5", "layer6", "decade_cmi"))
    made = {
        "sentiment_trend": lambda: charts.sentiment_trend(idx),
        "emotion_mix": lambda: charts.emotion_mix(layer4),
        "stage_mix": lambda: charts.stage_mix(layer4, layer5),
        "theme_heatmap": lambda: charts.theme_heatmap(layer4),
        "resonance_spread": lambda: charts.resonance_spread(layer4, layer6),
    }
    done = charts.write_all(made, run.path("charts"), run.config.digest(), run.config.output.save_visualizations)
    write_text(run.spark, run.path("report.html"), report.build(idx, layer4, pictures=done))
    return list(done)


OK, FAILED, BAD_CONFIG, BROKEN = 0, 1, 2, 3


def run_all(run: Run, stages: Sequence[Stage], force: bool = False) -> int:
    """Run in order and stop at the first failure; the exit code."""
    for stage in stages:
        try:
            run_stage(run, stage, force)
        except (MissingInputError, FileNotFoundError, index.CoverageError, SchemaError, feed.FeedError) as error:
            log.error("%s: %s", stage.name, error)
            return FAILED
        except ConfigError as error:
            log.error("%s: %s", stage.name, error)
            return BAD_CONFIG
        except Exception:  # noqa: BLE001 - anything else is a defect, reported with its trace
            log.exception("%s broke", stage.name)
            return BROKEN
    return OK


def dry_run(run: Run, stages: Sequence[Stage]) -> int:
    """Analyse the plans of the stages without running them or asking a provider.

    A stage whose inputs are not there yet is analysed over empty ones of their schemas.
    """
    planned = _Planned(run.spark, run.config, run.root)
    for stage in stages:
        frame = stage.build(planned)
        planned.made[stage.output] = frame.schema
        frame.explain("formatted")
    return OK


@dataclass
class _Planned(Run):
    """A run whose missing inputs are empty; ``made`` has the schemas of the stages planned so far."""

    made: dict[str, T.StructType] = field(default_factory=dict)

    def read(self, name: str) -> DataFrame:
        if exists(self.spark, self.path(name)):
            return super().read(name)
        if name in self.made:
            return self.spark.createDataFrame([], self.made[name])
        maker = next(s for s in STAGES if s.output == name)
        log.info("%s: %s is not there, planned as empty", maker.name, name)
        self.made[name] = maker.build(self).schema
        return self.spark.createDataFrame([], self.made[name])

    def landed(self) -> DataFrame:
        return super().landed() if exists(self.spark, self.path("landing")) else self.spark.createDataFrame([], feed.FEED)

    def texts(self) -> DataFrame:
        return super().texts() if exists(self.spark, self.path("lyrics.csv")) else self.spark.createDataFrame([], TEXTS)

    def covered(self, calendar: DataFrame, landed: DataFrame) -> None:
        """Nothing is counted in a dry run."""


def log_to(path: str | None, level: str) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=5_000_000, backupCount=3))
    logging.basicConfig(level=level, handlers=handlers, format="%(asctime)s %(levelname)s %(name)s %(message)s", force=True)


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="moodspark", description="Run the stages of the mood index.")
    parser.add_argument("--config", default="config.yaml")
    parser.add_argument("--root", help="folder of inputs and outputs (default: the configuration's output_dir)")
    parser.add_argument("--stage")
    parser.add_argument("--stages", nargs="+")
    parser.add_argument("--start-year", type=int)
    parser.add_argument("--end-year", type=int)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--charts", action="store_true")
    parser.add_argument("--log-file")
    parser.add_argument("--valences", help="lexicon of word, tab and valence for the first scorer of the ensemble")
    parser.add_argument("--polarities", help="XML lexicon of polarities for the second")
    parser.add_argument("--emotion-model", help="folder of a saved model of label scores")
    parser.add_argument("--theme-model", help="folder of a saved model of label scores")
    args = parser.parse_args(argv)
    try:
        config = load_config(args.config, args.start_year, args.end_year)
        log_to(args.log_file, config.output.log_level)
        stages = select([args.stage] if args.stage else args.stages)
    except (ConfigError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return BAD_CONFIG
    spark = SparkSession.builder.appName("moodspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = Run(spark, config, args.root or config.output.output_dir, valences=args.valences, polarities=args.polarities, emotion_model=args.emotion_model, theme_model=args.theme_model)
    if args.dry_run:
        return dry_run(run, stages)
    code = run_all(run, stages, args.force)
    if code == OK and args.charts:
        draw(run)
    return code
