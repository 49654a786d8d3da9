import random
import re

from pyspark.sql import functions as F

from moodspark.functions import replies, scores, text
from moodspark.operators import aggregates, index, joins, sections, windows


def test_text_basics(column):
    assert column([None, "", "  a  b\n"], text.normalise_spacing) == ["", "", "a b"]
    assert column(["", None, "  ", "a  b\nc d"], text.token_count) == [0, 0, 0, 4]
    assert column(["A page Lyrics\nbody\nmore", "12 Contributors\nbody", "plain\nbody ", "Lyrics here", None], text.strip_header) == ["body\nmore", "body", "plain\nbody", "", None]
    assert column(["a| b ||c", "", None], text.split_tags) == [["a", "b", "c"], [], None]


def test_clean_text(column):
    raw = "[Verse 1]\n  “Hi”   there — friend\r\n\n23 Embed\nSee Anyone Live\nYou might also like\n[Chorus]ﬁne"
    assert column([raw, None, " \n"], text.clean_text) == ['"Hi" there - friend\nfine', "", ""]
    assert column(["a\n\n\n\nb\n [x]\nc"], lambda c: text.clean_text(c, True)) == ["a\n\nb\n\nc"]


def test_perspective(column):
    assert column(["I'm me", "you and your", "he they them", "I you", "none here", "", None], text.perspective) == ["first_person", "second_person", "third_person", "abstract", "abstract", "abstract", "abstract"]


def test_entity_ids(spark):
    import hashlib

    df = spark.createDataFrame([("The Beatles", "Hey  Jude!", 1968), ("Beyoncé", "Crazy", 2003), (None, "x", 1999)], "a string, t string, y int")
    got = [r[0] for r in df.select(text.entity_id("a", "t", "y")).collect()]
    assert got == [hashlib.md5(b"the beatles|hey jude|1968").hexdigest()[:16], hashlib.md5(b"beyonc|crazy|2003").hexdigest()[:16], None]


def test_energy_bins(column):
    values = [-1.0, 0.19, 0.2, 0.39, 0.4, 0.6, 0.79, 0.8, 1.0, None]
    assert column(values, scores.bin_levels, "double") == [1, 1, 2, 2, 3, 4, 4, 5, 5, None]


def test_quality_tiers(column):
    assert column([0, 49, 50, 149, 150, None], scores.quality_tier, "int") == ["missing", "missing", "full", "full", "full", "missing"]
    assert column([0, 49, 50, 149, 150, None], lambda c: scores.quality_tier(c, documented=True), "int") == ["missing", "missing", "partial", "partial", "full", "missing"]


def test_jaccard(spark):
    rows = [([], [], 0.0, "none"), (["a"], [], 1.0, "major"), (["a", "b"], ["a", "b"], 0.0, "none"), (["a", "b"], ["b"], 0.5, "minor"), (["a", "b"], ["b", "c"], 0.6667, "major")]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, d double, k string")
    for r in df.withColumn("x", scores.jaccard_distance("a", "b")).withColumn("y", scores.jaccard_bucket("x")).collect():
        assert (r.x, r.y) == (r.d, r.k)


def test_resonance_extremes_and_nulls(spark):
    schema = "sentiment_score double, energy_level double, chorus_detected boolean, lyrics_quality string, development_score double"
    rows = [(1.0, 5.0, True, "full", 7.0), (-1.0, 1.0, False, "missing", 1.0), (9.0, 9.0, None, "partial", 9.0), (None, 5.0, True, "full", 7.0), (0.0, 3.0, True, "full", None)]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(scores.resonance_score()).collect()] == [1.0, 0.0, 0.75, None, None]
    assert [r[0] for r in df.select(scores.resonance_score(renormalise_missing=True)).collect()][3] == 1.0
    assert abs(sum(scores.normalised_weights({"sentiment": 5}).values()) - 1) < 1e-12
    assert scores.normalised_weights(dict.fromkeys(scores.WEIGHTS, 0))["sentiment"] == 0.25


def test_labels_and_tags(spark):
    df = spark.createDataFrame([({"joy": 0.4, "fear": 0.4},), ({"fear": 0.9, "love": 0.4, "x": 1.0},), (None,)], "s map<string,double>")
    assert [r[0] for r in df.select(scores.dominant_label("s", ["joy", "fear"])).collect()] == ["joy", "fear", None]
    assert [r[0] for r in df.select(scores.active_tags("s", ["love", "fear"], 0.4)).collect()] == ["fear", "fear|love", None]


def test_imputation_keeps_to_cohorts(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", None), (4, None, 5.0), (5, "a", 3.0)], "i int, g string, v double")
    for by_window in (False, True):
        got = {r.i: r.v for r in windows.impute_cohort_mean(df, "g", ["v"], by_window).collect()}
        assert got == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: 3.0}


def test_ties(spark):
    df = spark.createDataFrame([(1, "g", "b", "x|y"), (2, "g", "a", "y|z"), (3, "g", None, "x"), (4, "g", "a", None), (5, "g", "b", "")], "i int, g string, m string, t string")
    assert df.groupBy("g").agg(aggregates.mode_value("m").alias("m")).first().m == "a"
    assert aggregates.top_tags(df, "g", "t", ["i"], 2).first().top_tags == "x|y"
    scored = df.select("i", "g", "m", F.lit(1.0).alias("s"))
    assert aggregates.top_titles(scored, "g", "m", "s", ["i"], 3).first().top_titles == "b|a|nan"


def test_dedupe_takes_the_first_spelling(spark):
    import datetime

    day = datetime.date(2000, 1, 1)
    rows = [(" Abba", "SOS ", None, 3, day, 2), ("ABBA", "sos", 4, 1, day, 1), ("abba", "Sos", 2, None, datetime.date(1999, 1, 1), 9)]
    df = spark.createDataFrame(rows, "artist string, title string, rank int, weeks int, chart_date date, p int")
    got = aggregates.dedupe_canonical(df, ("chart_date", "p")).collect()
    assert len(got) == 1 and (got[0].title, got[0].artist, got[0].chart_rank, got[0].chart_weeks_on) == ("Sos", "abba", 2, 3)


def test_range_buckets(spark):
    df = spark.createDataFrame([(1,), (5,), (7,), (None,)], "v int")
    buckets = (("a", 1, 5), ("b", 5, 6))
    assert [r[0] for r in df.select(joins.range_bucket_case("v", buckets)).collect()] == ["a", "a", None, None]
    assert sorted((str(r.v), r.bucket) for r in joins.range_bucket_join(df, "v", buckets).collect()) == [("1", "a"), ("5", "a"), ("7", None), ("None", None)]


def test_join_suffix(spark):
    left = spark.createDataFrame([(1, "l"), (2, "m")], "k int, v string")
    right = spark.createDataFrame([(1, "r", 5)], "k int, v string, w int")
    assert [tuple(r) for r in joins.left_join_suffix(left, right, "k", "_r").orderBy("k").collect()] == [(1, "l", "r", 5), (2, "m", None, None)]


def test_sections(column):
    song = "[Verse 1]\na\n[Chorus]\nc1\nc2\n[Verse 2]\nb\n[Bridge]\nx\n[Outro]\ny"
    assert column([song, "plain\ntext", None], sections.extract_sections) == ["[Verse 1]\na\nb", "plain\ntext", ""]
    assert column([song, "[Chorus]\n[Verse]\nq\n[Outro]", "[Hook 2]\none\n[Refrain]\ntwo\n\nthree\n[Verse]", "none"], sections.tagged_chorus) == ["c1\nc2", "[Verse]\nq", "two\nthree", None]


def test_repeated_stanzas(column, spark):
    a, b = "one two three four five six", "Seven eight nine ten eleven twelve"
    texts = ["\n\n".join([b, a + "!", b, a, b.lower() + ".", a]), "\n\n".join([a, a, b]), "x y\n\nx y\n\nx y", None]
    assert column(texts, sections.repeated_stanza) == [b, None, None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    assert [(r.k, r.chorus_text, r.times) for r in sections.repeated_stanza_rows(df, "k", "t").collect()] == [(0, b, 3)]
    got = df.select("k", *sections.chorus_cascade("t")).orderBy("k").collect()
    assert [(r.chorus_detected, r.chorus_method) for r in got] == [(True, "repetition"), (False, "none"), (False, "none"), (False, "none")]
    assert got[1].chorus_text == texts[1] and got[3].chorus_text == "" and got[3].chorus_token_count == 0


def test_reply_parsing(spark):
    good = '{"song_id":"a","jung_stage":"PERSONA ","psychological_theme":"","development_score":4.7}'
    rows = [
        (1, f"[{good}]"),
        (2, f'{{"songs":[{good}]}}'),
        (3, f'{{"songs":[{good}],"more":1}}'),
        (4, "not json"),
        (5, '[{"song_id":"b","jung_stage":"dream","development_score":"4.7"},{"song_id":"c","development_score":"6"},{"song_id":"d","development_score":9},7,{"jung_stage":"shadow"}]'),
        (6, None),
        (7, '"text"'),
    ]
    got = replies.parse_replies(spark.createDataFrame(rows, "batch_id long, reply string")).orderBy("batch_id", "position").collect()
    assert [(r.batch_id, r.song_id, r.jung_stage, r.psychological_theme, r.development_score) for r in got] == [
        (1, "a", "persona", None, 4),
        (2, "a", "persona", None, 4),
        (5, "b", "unclassified", None, None),
        (5, "c", "unclassified", None, 6),
        (5, "d", "unclassified", None, None),
    ]


def test_coverage_gates(spark):
    import pytest

    def frame(scored, total):
        return spark.createDataFrame([("full", 0.5 if i < scored else None) for i in range(total)] + [("missing", None)], "lyrics_quality string, sentiment_score double")

    assert index.enforce_coverage(frame(17, 20), 0.85) == 0.85
    with pytest.raises(index.CoverageError):
        index.enforce_coverage(frame(16, 20), 0.85)
    assert index.enforce_coverage(frame(0, 0), 0.85) == 1.0
    with pytest.raises(index.CoverageError):
        index.enforce_nonnull(frame(1, 4), "sentiment_score", 0.6)


def test_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "i int").repartition(4)
    got = {r.i: r.batch_id for r in windows.batch_assign(df, 5, ["i"]).collect()}
    assert got == {i: i // 5 for i in range(23)}


def test_tagged_queries_read_whole_texts(spark, tmp_path):
    from moodspark.plans.catalogue import QUERIES

    body = "\n".join(f"line {i} of a long text" for i in range(400))
    spark.createDataFrame([(1, f"{body}\n[Hook]\nfar away\n[Verse 9]\nnear", "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("clean_text", "extract_sections", "chorus_cascade")}
    assert [r.cleaned for r in got["clean_text"]] == [f'"{body}\nfar away\nnear"\nsrc1 sings along\nonce more-en fine']
    assert [r.verse_only for r in got["extract_sections"]] == [f"[Verse 1]\n  “{body}\nnear” \n\nonce more—en"]
    assert [(r.chorus_method, r.chorus_text) for r in got["chorus_cascade"]] == [("tag", "far away")]


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    lines = "\n".join("[Chorus]" if i % 1000 == 0 else "[Verse 2]" if i % 1000 == 500 else f"line {i}" for i in range(100_000))
    stanzas = "\n\n".join(f"these are the words of stanza {i % 9000 if i % 7 else 3}" for i in range(20_000))
    df = spark.createDataFrame([(lines, stanzas)], "lines string, stanzas string")
    began = time.monotonic()
    row = df.select(sections.extract_sections("lines").alias("verses"), sections.tagged_chorus("lines").alias("chorus"), sections.repeated_stanza("stanzas").alias("stanza"), *sections.chorus_cascade("stanzas")).first()
    assert time.monotonic() - began < 60
    assert len(row.verses.split("\n")) == 100 * 499 and row.verses.startswith("line 501\n")
    assert row.chorus == "\n".join(f"line {i}" for i in range(1, 500))
    assert row.stanza == row.chorus_text == "these are the words of stanza 3"


def plain_verses(text):
    out, skip = [], False
    for line in text.split("\n"):
        tag = re.fullmatch(r"\[.+\]", line.strip(" "))
        other = bool(tag) and not re.match(r"(?i)\[\s*verse", line.strip(" "))
        if not (other or skip):
            out.append(line)
        skip = True if other else False if tag else skip
    return "\n".join(out).strip(" ")


def plain_chorus(text):
    on, buf = False, []
    for line in text.split("\n"):
        bare = line.strip(" ")
        if re.search(sections.CHORUS_TAG, bare):
            on, buf = True, []
        elif on and re.fullmatch(r"\[.+\]", bare) and buf:
            break
        elif on:
            buf.append(bare)
    return "\n".join(x for x in buf if x) or None


def plain_stanza(text):
    stanzas = [s.strip() for s in re.split("\n{2,}", text) if s.strip()]
    forms = [" ".join(re.sub(r"[^\w\s]", "", s.lower()).split()) for s in stanzas]
    able = [(forms.count(f), -i) for i, f in enumerate(forms) if forms.index(f) == i and forms.count(f) >= 3 and len(stanzas[i].split()) >= 6]
    return stanzas[-max(able)[1]] if able else None


def test_sections_of_many_texts(spark):
    rng = random.Random(8)
    pool = ["[Verse 1]", "[Chorus]", "[Hook 2]", "[Bridge]", "say [chorus] now", " [Outro] ", "a line", "", "[ verse x ]", "another"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(300)]
    songs = ["\n\n".join(rng.choice(["one two three four five six", "One, two three four five six!", "six five four three two one", "short", "a b c d e f g"]) for _ in range(rng.randrange(9))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sections.extract_sections("t").alias("v"), sections.tagged_chorus("t").alias("c")).collect()
    for r in rows:
        assert (r.v, r.c) == (plain_verses(texts[r.i]), plain_chorus(texts[r.i])), texts[r.i]
    for r in spark.createDataFrame(list(enumerate(songs)), "i int, t string").select("i", sections.repeated_stanza("t").alias("s")).collect():
        assert r.s == plain_stanza(songs[r.i]), songs[r.i]
