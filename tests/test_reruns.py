"""What reruns when inputs change or a stage is forced, and keys that rows share."""

import pytest
from pyspark.sql import functions as F

from moodspark.config import Config
from moodspark.operators import keys
from moodspark.plans import checkpoints, stages


def copy_of(*names):
    def build(run):
        made = run.spark.createDataFrame([], "song_id string, n long")
        for name in names:
            made = made.unionByName(run.spark.read.parquet(run.path(name)))
        return made.groupBy("song_id").agg(F.sum("n").alias("n"))

    return build


CHAIN = (
    stages.Stage("LEFT", copy_of("one"), "left", inputs=("one",)),
    stages.Stage("RIGHT", copy_of("two"), "right", inputs=("two",), settings=("valences",)),
    stages.Stage("NEXT", copy_of("left"), "next", inputs=("left",)),
    stages.Stage("BOTH", copy_of("next", "right"), "both", inputs=("next", "right")),
)


def test_only_what_follows_from_a_change_reruns(spark, tmp_path):
    run = stages.Run(spark, Config(), str(tmp_path))
    put = lambda name, n: spark.createDataFrame([("a", n)], "song_id string, n long").coalesce(1).write.mode("overwrite").parquet(run.path(name))
    ran = lambda: [s.name for s in CHAIN if stages.run_stage(run, s)]
    put("one", 1)
    put("two", 10)
    assert ran() == ["LEFT", "RIGHT", "NEXT", "BOTH"] and ran() == []
    put("two", 20)
    assert ran() == ["RIGHT", "BOTH"] and ran() == []
    assert [r.n for r in spark.read.parquet(run.path("both")).collect()] == [21]
    stages.run_stage(run, CHAIN[0], force=True)
    assert ran() == ["NEXT", "BOTH"] and ran() == []
    lexicon = tmp_path / "valences.txt"
    lexicon.write_text("good\t1")
    run.valences = str(lexicon)
    assert ran() == ["RIGHT", "BOTH"] and ran() == []
    lexicon.write_text("good\t1.5")
    assert ran() == ["RIGHT", "BOTH"] and ran() == []
    run.config = Config(output=run.config.output.__class__(log_level="ERROR"))
    assert ran() == ["LEFT", "RIGHT", "NEXT", "BOTH"]


def test_every_input_of_the_registry_is_made_before_it_is_read():
    made = {"landing", "lyrics.csv"}
    for stage in stages.STAGES:
        assert stage.inputs and set(stage.inputs) <= made, stage.name
        made.add(stage.output)


def test_a_damaged_checkpoint_names_nothing(spark, tmp_path):
    out = str(tmp_path / "x")
    before = checkpoints.state_of(spark, out)
    for content in ("", "{", "[]", "{}"):
        (tmp_path / "x.done.json").write_text(content)
        assert checkpoints.state_of(spark, out) == before
    checkpoints.mark(spark, out, "S", "h", made_from="f")
    first = checkpoints.state_of(spark, out)
    checkpoints.mark(spark, out, "S", "h", made_from="f")
    assert before != first != checkpoints.state_of(spark, out)
    assert checkpoints.is_current(spark, out, "h", "f") and not checkpoints.is_current(spark, out, "h", "g")


def test_key_violations(spark):
    rows = [("a", 1, 0), ("a", 1, 1), ("a", None, 2), ("a", None, 3), (None, None, 4), ("b", 1, 5), ("", 1, 6)]
    df = spark.createDataFrame(rows, "`a.b` string, n int, __hash int")
    got = {tuple(r) for r in keys.key_violations(df, ["a.b", "n"]).collect()}
    assert got == {("a", 1, 2), ("a", None, 2)}
    assert keys.key_violations(df.limit(0), ["n"]).count() == 0
    many = spark.range(20_000).select((F.col("id") % 3).alias("k"), "id")
    assert {r.k: r.row_count for r in keys.key_violations(many, ["k"]).collect()} == {0: 6667, 1: 6667, 2: 6666}
    keys.enforce_unique(many, ["id"], "t")
    with pytest.raises(keys.KeyClashError):
        keys.enforce_unique(many, ["k"], "t")
