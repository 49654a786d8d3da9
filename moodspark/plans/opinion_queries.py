"""Queries of the learned lexicon, the sentiment scorers and the learned label scores, over whole texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodspark.operators import labels, opinions
from moodspark.plans.catalogue import query
from moodspark.plans.proxies import table
from moodspark.sources import files

STRONGER, WEAKER, NEGATIONS = ("(" + ", ".join(f"'{w}'" for w in words) + ")" for words in (opinions.STRONGER, opinions.WEAKER, opinions.NEGATIONS))
BARE = f"regexp_replace(t, '{opinions.EDGES}', '', 'g')"
NEGATES = f"(replace(replace(low, '''', ''), '’', '') IN {NEGATIONS} OR contains(low, 'n''t'))"
#: Common tables up to ``lex``, the lexicon learned from labels of quality.
LEXICON_SQL = f"""w AS (SELECT doc_id, text, list_transform(list_filter(string_split_regex(coalesce(text, ''), '{opinions.BLANKS}'), lambda t: t <> ''), lambda t: CASE WHEN length({BARE}) <= 2 THEN t ELSE {BARE} END) AS w FROM documents),
    m AS (SELECT l.quality AS label, list_distinct(list_transform(w, lambda x: lower(x))) AS low FROM w JOIN labels l ON w.doc_id = l.doc_id AND l.quality IN (0, 1)),
    n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM m),
    c AS (SELECT word, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM (SELECT label, unnest(low) AS word FROM m) WHERE regexp_full_match(word, '[a-z]{{3,}}') GROUP BY word HAVING count(*) >= 5),
    lex AS (SELECT * FROM (SELECT word, round(greatest(least(ln((c.p + 1) / (n.p + 2)) - ln((c.n + 1) / (n.n + 2)), 4.0::DOUBLE), -4.0::DOUBLE), 3) AS valence FROM c, n) WHERE abs(valence) >= 0.5)"""


def learned(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return files.kept(opinions.learn_valences(docs, table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "text", "quality"), "lexicon")


@query("learned_valences", f"WITH {LEXICON_SQL} SELECT word, valence FROM lex")
def learned_valences(spark, d):
    return learned(spark, d)


@query(
    "sentiment_rules",
    f"""WITH {LEXICON_SQL},
    t AS (SELECT doc_id, i, w[i] AS raw, lower(w[i]) AS low FROM w, generate_series(1, len(w)) g(i)),
    f AS (SELECT *, upper(raw) = raw AND low <> raw AND length(raw) > 1 AS loud FROM t),
    u AS (SELECT doc_id, bool_or(loud) AND bool_or(NOT loud) AS mixed, min(i) FILTER (low = 'but') AS turn FROM f GROUP BY 1),
    e AS (SELECT f.*, mixed, turn, CASE WHEN low IN {STRONGER} THEN 1.0::DOUBLE WHEN low IN {WEAKER} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS way, {NEGATES} AS negates FROM f JOIN u USING (doc_id)),
    k AS (SELECT *, {", ".join(f"lag(way * CASE WHEN mixed AND loud THEN 0.293::DOUBLE + 0.733::DOUBLE ELSE 0.293::DOUBLE END, {b}, 0.0::DOUBLE) OVER o AS b{b}, lag(CASE WHEN negates THEN low END, {b}) OVER o AS n{b}" for b in (1, 2, 3))},
        lag(low, 1) OVER o AS l1, lag(low, 2) OVER o AS l2, lead(low) OVER o AS nx FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT word FROM lex WHERE word NOT IN {STRONGER} AND word NOT IN {WEAKER}),
    v0 AS (SELECT k.*, sign(valence) AS sg, valence + CASE WHEN mixed AND loud THEN sign(valence) * 0.733::DOUBLE ELSE 0.0::DOUBLE END AS v FROM k JOIN lex ON k.low = lex.word AND k.way = 0),
    {", ".join(f"v{b} AS (SELECT * EXCLUDE (v), CASE WHEN n{b} IS NOT NULL AND n{b} NOT IN (SELECT word FROM s) THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END * (v + sg * b{b} * {share}::DOUBLE) AS v FROM v{b - 1})" for b, share in ((1, 1.0), (2, 0.95), (3, 0.9)))},
    x AS (SELECT doc_id, CASE WHEN low = 'no' AND nx IN (SELECT word FROM lex) THEN 0.0::DOUBLE ELSE v * CASE WHEN l1 = 'least' AND coalesce(l2 NOT IN ('at', 'very'), true) THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END END
        * CASE WHEN turn IS NULL OR i = turn THEN 1.0::DOUBLE WHEN i < turn THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS v FROM v3),
    y AS (SELECT doc_id, sum(round(v, 10)::DECIMAL(24, 10))::DOUBLE AS total FROM x GROUP BY 1),
    z AS (SELECT d.doc_id, text IS NULL AS blank, coalesce(total, 0.0::DOUBLE) AS total, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN q < 2 THEN 0.0::DOUBLE WHEN q <= 3 THEN q * 0.18::DOUBLE ELSE 0.96::DOUBLE END AS marks
        FROM (SELECT *, length(text) - length(replace(text, '?', '')) AS q FROM documents) d LEFT JOIN y ON d.doc_id = y.doc_id)
    SELECT doc_id, CASE WHEN NOT blank THEN round(greatest(least(tt / sqrt(tt * tt + 15), 1.0::DOUBLE), -1.0::DOUBLE), 4) END AS score FROM (SELECT *, total + sign(total) * marks AS tt FROM z)""",
)
def sentiment_rules(spark, d):
    return opinions.rule_scores(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", learned(spark, d))


@query(
    "sentiment_average",
    f"""WITH {LEXICON_SQL},
    words AS (SELECT word, valence / 4 AS polarity, 1.0::DOUBLE AS intensity FROM lex WHERE word NOT IN {STRONGER} AND word NOT IN {WEAKER} UNION ALL SELECT unnest({list(opinions.STRONGER)}), 0.0, 1.3 UNION ALL SELECT unnest({list(opinions.WEAKER)}), 0.0, 0.7),
    t AS (SELECT doc_id, i, f[i] AS low FROM (SELECT doc_id, regexp_extract_all(lower(text), '{opinions.WORDS_AND_MARKS.replace("'", "''")}') AS f FROM documents), generate_series(1, len(f)) g(i)),
    k AS (SELECT t.*, polarity, intensity, CASE WHEN low IN ('.', '!', '?') THEN 'mark' WHEN {NEGATES} OR low = 'no' THEN 'negation' WHEN polarity = 0 AND intensity <> 1 THEN 'intensity' WHEN polarity IS NOT NULL THEN 'value' ELSE 'other' END AS kind FROM t LEFT JOIN words ON t.low = words.word),
    g AS (SELECT *, count(*) FILTER (kind IN ('mark', 'value')) OVER b AS clause, count(*) FILTER (kind IN ('mark', 'value', 'other')) OVER b AS run FROM k WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h AS (SELECT *, coalesce(bool_or(kind = 'negation') OVER (PARTITION BY doc_id, clause ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS turned,
        coalesce(product(CASE WHEN kind = 'intensity' THEN intensity ELSE 1.0 END) OVER (PARTITION BY doc_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS strength FROM g),
    v AS (SELECT doc_id, sum(least(greatest(polarity * strength, -1.0::DOUBLE), 1.0::DOUBLE) * CASE WHEN turned THEN -0.5::DOUBLE ELSE 1.0::DOUBLE END) / count(*) AS score FROM h WHERE kind = 'value' GROUP BY 1)
    SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN round(coalesce(score, 0.0::DOUBLE), 10) END AS score FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id""",
)
def sentiment_average(spark, d):
    scored = opinions.average_scores(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", opinions.polarities_of(learned(spark, d)))
    return scored.withColumn("score", F.round("score", 10))


#: Buckets of the queries' model.
BUCKETS = 1 << 16
MODEL_SQL = f"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{labels.WORDS}') AS w FROM documents),
    g AS (SELECT doc_id, ('0x' || left(md5(unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])))), 8))::BIGINT % {BUCKETS} AS feature FROM w),
    l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT label, feature, count(*) AS n FROM l JOIN g USING (doc_id) GROUP BY 1, 2),
    model AS (SELECT label, -1::BIGINT AS feature, round(ln(count(*) / (SELECT count(*) FROM l)), 10) AS weight FROM l GROUP BY 1
        UNION ALL SELECT label, -2, round(-ln(coalesce(sum(n), 0) + {BUCKETS}), 10) FROM (SELECT DISTINCT label FROM l) LEFT JOIN c USING (label) GROUP BY 1
        UNION ALL SELECT label, feature, round(ln(n + 1), 10) FROM c)"""


def labelled(spark, d):
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", label.alias("label")), "doc_id")


@query("label_model", f"WITH {MODEL_SQL} SELECT label, feature, weight FROM model")
def label_model(spark, d):
    return labels.fit_bayes(labelled(spark, d), "text", "label", BUCKETS)


@query(
    "label_scores",
    f"""WITH {MODEL_SQL},
    names AS (SELECT a.label, a.weight AS prior, b.weight AS each FROM model a JOIN model b ON a.label = b.label AND a.feature = -1 AND b.feature = -2),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    s AS (SELECT doc_id, label, sum(weight::DECIMAL(24, 10))::DOUBLE AS w FROM g JOIN model ON g.feature = model.feature AND model.feature >= 0 GROUP BY 1, 2),
    p AS (SELECT d.doc_id, names.label, coalesce(w, 0.0::DOUBLE) + prior + coalesce(n, 0) * each AS lp FROM documents d JOIN names ON true LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = names.label),
    e AS (SELECT doc_id, label, exp(lp - max(lp) OVER (PARTITION BY doc_id)) AS e FROM p)
    SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS score FROM e""",
)
def label_scores(spark, d):
    model = labels.fit_bayes(labelled(spark, d), "text", "label", BUCKETS)
    labels.save_model(model, path := files.scratch(spark, "labels"))
    scored = labels.bayes_scores(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", labels.read_model(spark, path), BUCKETS)
    return scored.select("doc_id", F.explode("scores").alias("label", "score"))
