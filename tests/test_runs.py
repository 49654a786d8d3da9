"""Configuration, schemas, checkpoints, the stage runner and the stream, end to end on a small feed."""

import dataclasses
import json

import pytest
import yaml
from pyspark.sql import functions as F

from moodspark.config import Config, ConfigError, from_mapping, load_config
from moodspark.functions.text import cache_name
from moodspark.operators import providers
from moodspark.plans import charts, checkpoints, stages
from moodspark.plans.schemas import SCHEMAS, SchemaError
from moodspark.sources import cache, feed, files
from moodspark.streaming import canonical, weekly

SONGS = [("The Beatles", "Hey Jude", 1968), ("Michael Jackson", "Billie Jean", 1983), ("Nirvana", "Smells Like Teen Spirit", 1991), ("Beyonce", "Crazy in Love", 2003), ("Billie Eilish", "Bad Guy", 2019)]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump({"data": {"start_year": 1970, "end_year": 1980}, "analysis": {"energy_level": {"bins": [0.1, 0.5]}}}))
    config = load_config(path, end_year=1975)
    assert (config.data.start_year, config.data.end_year, config.analysis.bins) == (1970, 1975, (0.1, 0.5))
    assert len(config.digest()) == 8 and config.digest() != Config().digest()
    with pytest.raises(ConfigError):
        load_config(path, end_year=1960)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    for bad in ({"data": {"decade_buckets": []}}, {"analysis": {"energy_level": {"bins": [0.5, 0.1]}}}, {"analysis": {"energy_level": {"bins": [0.5, 1.0]}}}, {"analysis": {"theme_taxonomy": []}}):
        with pytest.raises(ConfigError):
            from_mapping(bad)


FULL_CONFIG = """
dataset:
  sample_start_year: 1990
  sample_end_year: 2005
  decade_filter: 1990s
  decade_buckets:
    - {label: 1990s, start: 1990, end: 1999, non_standard: false}
    - {label: 2000s, start: 2000, end: 2009, non_standard: false}
lyrics: {cache_dir: cache/lyrics, min_token_threshold: 40, partial_token_threshold: 150, genius_sleep_time: 0.5, genius_max_retries: 3}
preprocessing: {chorus_tier1_tag_pattern: "x", chorus_tier2_min_repetitions: 3, chorus_tier2_min_tokens: 6, chorus_tier3_model: m, chorus_max_tokens: 200}
analysis:
  energy_level: {bins: [0.2, 0.4]}
  emotion_model: a
  theme_model: b
  jungian_model: c
  jungian_inter_batch_sleep: 0.5
  jungian_valid_stages: [shadow, persona]
cultural_metrics: {normalization: minmax_within_decade, feature_vector: [sentiment_score], top_resonance_songs_per_decade: 7}
cmi: {weight_sentiment: 1.0, min_coverage_pct: 0.5}
output: {output_dir: o, save_visualizations: false, visualization_format: png, visualization_scale: 1.0, report_format: html, log_level: DEBUG}
"""


def test_config_in_all_sections(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(FULL_CONFIG)
    config = load_config(path)
    assert (config.data.start_year, config.data.end_year, config.data.decade_filter, [b.label for b in config.data.decade_buckets]) == (1990, 2005, "1990s", ["1990s", "2000s"])
    assert (config.lyrics.min_token_threshold, config.analysis.bins, config.analysis.jungian_inter_batch_sleep, config.cultural_metrics.top_resonance_songs_per_decade) == (40, (0.2, 0.4), 0.5, 7)
    assert config.cmi.coverage_threshold == 0.5 and sum(config.cmi.weights.values()) == pytest.approx(1) and config.cmi.weights["sentiment"] == pytest.approx(1 / 1.75)
    assert load_config(path, start_year=1995, end_year=1996).data.start_year == 1995
    for bad in ({"dataset": {"first_year": 1}}, {"datasets": {}}, {"dataset": {}, "data": {}}, {"analysis": {"energy_level": {"edges": []}}}, {"cmi": {"weight_other": 1}}, {"analysis": {"emotion_batch_size": 0}}, {"output": 3}, {"analysis": {"theme_threshold": 2}}):
        with pytest.raises(ConfigError):
            from_mapping(bad)


def test_schema_violations(spark):
    rows = [("0123456789abcdef", "1.5", "3"), ("bad id", "0.5", "6"), ("0123456789abcdef", "x", None), (None, None, "2")]
    df = spark.createDataFrame(rows, "song_id string, sentiment_score string, energy_level string")
    got = {(r[0], r[1], r[2]) for r in SCHEMAS["layer2_sentiment"].violations(df).collect()}
    assert got == {("sentiment_score", "<=1", "1.5"), ("song_id", "pattern", "bad id"), ("energy_level", "allowed", "6"), ("sentiment_score", "type", "x"), ("song_id", "not_null", None)}
    with pytest.raises(SchemaError):
        SCHEMAS["layer2_sentiment"].validate(df)
    themes = spark.createDataFrame([("0123456789abcdef", "love|fear"), ("0123456789abcdef", None)], "song_id string, themes string")
    assert [tuple(r) for r in SCHEMAS["layer2_themes"].violations(themes).collect()] == [("themes", "tags", "love|fear")]


def test_checkpoints(spark, tmp_path):
    out = str(tmp_path / "x")
    assert not checkpoints.is_current(spark, out, "h")
    for content in ("", "{", "[]", "{}"):
        (tmp_path / "x.done.json").write_text(content)
        assert not checkpoints.is_current(spark, out, "h")
    checkpoints.mark(spark, out, "S", "h")
    assert checkpoints.is_current(spark, out, "h") and not checkpoints.is_current(spark, out, "other")


def test_atomic_write_keeps_the_old_output(spark, tmp_path):
    out = str(tmp_path / "t")
    files.write_atomic(spark.range(3), out)
    with pytest.raises(Exception):
        files.write_atomic(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), out)
    assert spark.read.parquet(out).count() == 3
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name or ".old" in p.name] == []


def test_csv_trip(spark, tmp_path):
    df = spark.createDataFrame([("0001", 'a "q"\nb')], "song_id string, lyrics string")
    files.write_csv(df, str(tmp_path / "c"), quote_all=True)
    assert files.read_csv(spark, str(tmp_path / "c"), "song_id string, lyrics string").collect() == df.collect()
    assert files.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    inferred = files.read_csv(spark, str(tmp_path / "c"), text=["song_id"])
    assert inferred.collect() == df.collect() and files.read_csv(spark, str(tmp_path / "c")).dtypes[0] == ("song_id", "int")
    with pytest.raises(files.MissingInputError, match="STAGE"):
        files.require_path(spark, str(tmp_path / "none"), "STAGE")


def test_cache(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"song_id": "a", "lyrics": "x", "status": "found"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("")
    table = cache.read_cache(spark, str(tmp_path))
    asked = spark.createDataFrame([("a", "t", "r"), ("b", "t", "r")], "song_id string, song_title string, artist string")

    def lookup(title, artist):
        raise OSError("offline")

    got = {r.song_id: r.lyrics for r in cache.cache_hits(asked, table).collect()}
    assert got == {"a": "x"}
    made = cache.fetch_missing(cache.cache_misses(asked, table), lookup, tries=2, pause=0).collect()
    assert [(r.song_id, r.lyrics, r.status) for r in made] == [("b", None, "missing")]
    with pytest.raises(ValueError):
        cache_name("../x")


def test_fetcher():
    import urllib.error

    calls = []

    def get(url):
        calls.append(url)
        if len(calls) < 2:
            raise OSError("slow")
        return json.dumps({"date": "2000-01-01", "data": [{"song": "s", "artist": "a"}, {"song": " ", "artist": "b"}]})

    assert feed.fetch_week("u", get=get, pause=0)["data"] == [{"song": "s", "artist": "a"}]
    with pytest.raises(feed.FeedError):
        feed.fetch_week("u", get=lambda u: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "no", None, None)), pause=0)
    with pytest.raises(feed.FeedError):
        feed.fetch_week("u", get=lambda u: '{"data": []}', pause=0, tries=1)


def land(folder, weeks):
    folder.mkdir(exist_ok=True)
    for i, (date, entries) in enumerate(weeks):
        data = [{"song": t, "artist": a, "peak_position": r, "weeks_on_chart": w} for a, t, r, w in entries]
        (folder / f"{date}-{i}.json").write_text(json.dumps({"date": date, "data": data}))


@pytest.fixture
def run(spark, tmp_path):
    land(tmp_path / "landing", [(f"{y}-06-0{5 if y != 2019 else 1}", [(a, t, 1, 10)]) for a, t, y in SONGS])
    config = from_mapping({"data": {"fetch_coverage": 0.0}, "analysis": {"coverage_gate_threshold": 0.5}})
    made = stages.Run(spark, config, str(tmp_path))
    stages.run_stage(made, stages.STAGES[0])
    ids = {r.song_title: r.song_id for r in made.read("metadata").collect()}
    verse = "[Verse 1]\n" + "I walk my road and love the light of hope with you tonight\n" * 6
    rows = [(ids[t], f"{t} Lyrics\n{verse}[Chorus]\nwe dance in sunshine and we smile\n[Verse 2]\nmy pain is gone") for _, t, _ in SONGS]
    files.write_csv(spark.createDataFrame(rows, "song_id string, lyrics string"), f"{tmp_path}/lyrics.csv")
    return made


def test_end_to_end(run, tmp_path):
    assert stages.run_all(run, stages.STAGES) == stages.OK
    rows = {r.decade_label: r for r in run.read("decade_cmi").collect()}
    assert sorted(rows) == ["1960s*", "1980s", "1990s", "2000s", "2010s"] and all(r.song_count == r.scored_count == 1 for r in rows.values())
    layer4 = run.read("layer4").collect()
    assert all(r.chorus_method == "tag" and r.has_section_tags and r.narrative_perspective == "first_person" and r.contrast_sentiment_index is not None for r in layer4)
    assert not stages.run_stage(run, stages.STAGES[3]) and stages.run_stage(run, stages.STAGES[3], force=True)
    assert sorted(stages.draw(run)) == ["emotion_mix", "resonance_spread", "sentiment_trend", "stage_mix", "theme_heatmap"]
    page = (tmp_path / "report.html").read_text()
    assert "1960s*" in page and page.count("<svg") == 5
    import xml.dom.minidom

    for name in ("emotion_mix", "resonance_spread", "sentiment_trend", "stage_mix", "theme_heatmap"):
        picture = (tmp_path / "charts" / f"{name}.svg").read_text()
        assert xml.dom.minidom.parseString(picture).documentElement.tagName == "svg" and picture in page
        assert json.loads((tmp_path / "charts" / f"{name}.meta.json").read_text())["picture"] == f"{name}.svg"
    assert "1991" not in picture and "1990s" in picture


def test_lexicons_of_a_run(run, tmp_path):
    (tmp_path / "valences.txt").write_text("love\t3.2\nhope\t1.9\npain\t-2.3\nsmile\t1.5\n")
    run.valences = str(tmp_path / "valences.txt")
    assert stages.run_all(run, stages.STAGES[:6]) == stages.OK
    assert all(0 < r.sentiment_score <= 1 for r in run.read("sentiment").collect())
    assert all(0 < r.chorus_sentiment_score <= 1 for r in run.read("emotion").collect())


def test_models_of_a_run(run, tmp_path):
    from moodspark.config import EMOTIONS
    from moodspark.operators import labels

    themes = run.config.analysis.theme_taxonomy
    for name, known in (("emotions", EMOTIONS), ("themes", themes)):
        texts = [(f"{label} walk my road and love" if i == 1 else f"{label} cold night alone", label) for i, label in enumerate(known)]
        labels.save_model(labels.fit_bayes(run.spark.createDataFrame(texts, "text string, label string"), "text", "label"), f"{tmp_path}/{name}")
    run.emotion_model, run.theme_model = f"{tmp_path}/emotions", f"{tmp_path}/themes"
    assert stages.run_all(run, stages.STAGES[:7]) == stages.OK
    assert {r.emotional_tone for r in run.read("emotion").collect()} == {EMOTIONS[1]}
    assert all(themes[1] in r.themes.split("|") for r in run.read("themes").collect())


def test_failures_stop_the_run(run):
    assert stages.run_all(stages.Run(run.spark, run.config, run.root + "/nowhere"), stages.STAGES) == stages.FAILED
    with pytest.raises(ConfigError):
        stages.select(["NONE"])
    strict = stages.Run(run.spark, from_mapping({"data": {"fetch_coverage": 0.5}}), run.root)
    assert stages.run_all(strict, stages.STAGES[:1]) == stages.FAILED
    assert run.read("metadata").count() == 5


def test_chat_provider(run):
    def chat(prompt):
        import re

        ids = re.findall(r"song_id=(\S+)", prompt)
        return json.dumps([{"song_id": i, "jung_stage": "shadow", "development_score": 3, "psychological_theme": "x"} for i in ids])

    asked = run.spark.sparkContext.accumulator(0)

    def counted(prompt):
        asked.add(1)
        return chat(prompt)

    run.chat = counted
    run.config = dataclasses.replace(run.config, analysis=dataclasses.replace(run.config.analysis, jungian_inter_batch_sleep=0.0, jungian_batch_size=2))
    assert stages.run_all(run, stages.STAGES) == stages.OK
    assert asked.value == 3, "five songs in batches of two are three prompts, each asked once"
    assert {(r.jung_stage, r.development_score, r.jungian_quality_flag) for r in run.read("layer5").collect()} == {("shadow", 3, "high")}


def test_a_stage_is_computed_once_and_checked_as_written(run):
    computed = run.spark.sparkContext.accumulator(0)

    def build(score):
        @F.udf("double")
        def counted(value):
            computed.add(1)
            return score

        return lambda r: r.read("metadata").select("song_id", counted("song_id").alias("sentiment_score"), F.lit("3").alias("energy_level"))

    one = stages.Stage("ONE", build(0.5), "one", "layer2_sentiment")
    assert stages.run_stage(run, one) and computed.value == 5
    rows = run.spark.read.parquet(run.path("one"))
    assert dict(rows.dtypes) == {"song_id": "string", "sentiment_score": "double", "energy_level": "bigint"} and rows.count() == 5
    with pytest.raises(SchemaError):
        stages.run_stage(run, stages.Stage("ONE", build(7.5), "one", "layer2_sentiment"), force=True)
    assert {r.sentiment_score for r in run.spark.read.parquet(run.path("one")).collect()} == {0.5}
    strict = stages.Stage("ONE", build(0.5), "one", None, lambda r, staged: stages.index.enforce_nonnull(staged, "sentiment_score", 1.5))
    with pytest.raises(stages.index.CoverageError):
        stages.run_stage(run, strict, force=True)
    import os

    assert sorted(n for n in os.listdir(run.root) if "staging" in n or ".changed" in n or ".old" in n) == []


def test_lookups_fill_the_cache_once(run, spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def lookup(title, artist):
        asked.add(1)
        if title == "Bad Guy":
            raise OSError("offline")
        return f"{title} Lyrics\nsome words to sing " * 20

    looked = stages.Run(spark, from_mapping({"lyrics": {"cache_dir": "texts", "genius_sleep_time": 0, "genius_max_retries": 2}}), run.root, lookup=lookup)
    got = {r.song_title: (r.lyrics_quality, r.lyrics_raw == "") for r in stages.lyrics(looked).collect()}
    assert asked.value == 6 and got["Bad Guy"] == ("missing", True) and got["Hey Jude"] == ("full", False)
    assert stages.lyrics(looked).count() == 5 and asked.value == 6


def test_dry_run_plans_without_inputs(spark, tmp_path, capfd):
    planned = stages.Run(spark, Config(), str(tmp_path / "none"))
    assert stages.dry_run(planned, stages.STAGES) == stages.OK
    assert not (tmp_path / "none").exists()


def test_chat_failure_is_unclassified(spark):
    prompts = spark.createDataFrame([(0, "1. song_id=a | x")], "batch_id long, prompt string")
    got = providers.complete(prompts, lambda p: "[]", tries=2, pause=0).collect()
    assert [(r.batch_id, r.reply) for r in got] == [(0, None)]


def test_report_and_charts_are_never_cut(run, spark):
    many = spark.range(300).select(F.col("id").cast("string").alias("decade_label"), F.lit(1).alias("song_count"), F.lit(1).alias("scored_count"), F.lit(0.1).alias("CMI_sentiment"), F.lit(2.0).alias("CMI_energy"))
    from moodspark.plans import report

    with pytest.raises(report.ReportError):
        report.build(many, spark.createDataFrame([("joy",)], "emotional_tone string"))
    with pytest.raises(charts.ChartError):
        charts.rows_of(spark.range(charts.MOST_ROWS + 1))


def test_charts_helpers():
    assert charts.rgba("#ff8000", 0.5) == "rgba(255, 128, 0, 0.5)"
    for bad in (("#ff80", 0.5), ("#ff8000", 2), ("#gg8000", 1)):
        with pytest.raises(ValueError):
            charts.rgba(*bad)
    assert charts.ordered(["zz", "1980s", "1960s*"]) == ["1960s*", "1980s", "zz"]


def test_stream_upserts(spark, tmp_path):
    landing, target, mark = tmp_path / "in", str(tmp_path / "songs"), str(tmp_path / "mark")
    land(landing, [("2000-01-08", [("A", "x", 5, 1)]), ("2000-01-15", [("a", "X", 3, 2)])])
    weekly.run_available(spark, str(landing), target, mark)
    land(landing, [("1999-12-25", [("A ", "x ", 9, 1), ("B", "y", 1, 1)])])
    weekly.run_available(spark, str(landing), target, mark)
    got = {r.canonical_key: (r.chart_rank, r.chart_weeks_on, str(r.first_chart_date)) for r in canonical.read_canonical(spark, target).collect()}
    assert got == {"a||x": (3, 2, "1999-12-25"), "b||y": (1, 1, "1999-12-25")}
