"""Tokens, secrets, licenses and toxicity: operators that work on one text at a time."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from moodspark.llm import automata, bpe, licenses, secrets, toxicity


def test_bpe_matches_the_library_and_decodes(documents, hard_texts):
    texts = [*hard_texts, "  a\n\n b's 123 \t\t", "x" * 3000, ("ab " * 40_000) + "  \n tail", "  x ퟿"]
    df = bpe.decode(bpe.encode(documents(texts, extra=["'old' AS token_ids", "1 AS raw_bytes"])))
    assert df.columns.count("token_ids") == 1
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.DEFAULT_RANKS), special_tokens={})
    rows = bpe.unpack(df).select("doc_id", "token_ids", "raw_bytes", "ids").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == whole.encode_ordinary(text) == np.frombuffer(r.token_ids, "<u4").tolist()
        assert bytes(r.raw_bytes) == text.encode()


def test_bpe_query(spark, tmp_path, hard_texts):
    texts = [*hard_texts, "naïve  café\n\n 123's", "word" * 30_000]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.DEFAULT_RANKS), special_tokens={})
    found = bpe.op7_byte_bpe(spark, str(tmp_path)).collect()
    expected = []
    for i, text in rows:
        ids = whole.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(b"".join(n.to_bytes(4, "little") for n in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected))


def test_bpe_round_trip_is_one_map(spark, documents, hard_texts, tmp_path):
    import corpus_pipeline
    from moodspark.llm.common import SCAN_ROWS

    docs = documents(hard_texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for made in (corpus_pipeline.to_tokens(spark, read, str(tmp_path)), bpe.op7_byte_bpe(spark, str(tmp_path))):
        # Each map in a row is one more Python worker for every core of an executor.
        assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == SCAN_ROWS
    key = lambda df: sorted((r.doc_id, bytes(r.token_ids), bytes(r.raw_bytes)) for r in df.collect())
    assert key(bpe.round_trip(docs)) == key(bpe.decode(bpe.encode(docs)))


def test_bpe_decodes_parts_of_characters(spark):
    ranks = bpe.read_ranks(bpe.DEFAULT_RANKS)
    first = ranks[bytes([0xE6])]
    df = spark.createDataFrame([(bytearray(np.array([first], "<u4").tobytes()),), (bytearray(),), (None,)], "token_ids binary")
    assert [None if r.raw_bytes is None else bytes(r.raw_bytes) for r in bpe.decode(df).collect()] == [b"\xe6", b"", None]


def test_empty_tables_give_empty_results(documents):
    empty = documents([])
    for made in (bpe.encode(empty), secrets.scan(empty), licenses.detect(empty), toxicity.score(empty, toxicity.Model((), (0.0, 1.0, 0.0)))):
        assert made.count() == 0


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[1]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_match_plain_patterns():
    scanner, rng = secrets.Scanner(), random.Random(4)
    parts = ["token", "secret", "API_KEY", "apikey", "passwd", "password", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4", "0123abcd", "deadbeef", "é", "x", "ſ", "K", "tok", "KEY"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        assert [s for s in scanner.spans(text) if s[1] < 3] == plain_secrets(text), text


def plain_added(text):
    """The added rules as patterns; spans by rule number."""
    runs = {3: ("gh[pousr]_([A-Za-z0-9]+)", 36), 4: ("xox[abprs]-([A-Za-z0-9-]+)", 10), 5: ("AIza([A-Za-z0-9_-]+)", 35), 6: (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 8)}
    out = [(m.start(), n, m.end()) for n, (pattern, least) in runs.items() for m in re.finditer(pattern, text) if len(m[1]) >= least]
    head = re.compile("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(-+)")
    at = 0
    while m := head.search(text, at):
        at = m.end()
        if len(m[1]) >= 5:
            closing = re.compile(r"[A-Za-z0-9+/=\t\n\r :,-]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----").match(text, at)
            at = closing.end() if closing else re.compile(r"[A-Za-z0-9+/=\r\n]*").match(text, at).end()
            out.append((m.start(), 7, at))
    return sorted(out)


def test_added_rules_match_plain_patterns():
    scanner, rng = secrets.Scanner(), random.Random(14)
    parts = ["ghp_", "gho_", "xoxb-", "AIza", "eyJ", "eyJab.", "eyJ_-.", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "-----END ", "PRIVATE KEY-----", "a1" * 9, "Zz09" * 9, "_", " ", "\n", "é", "end,", "-----BEGIN PRIVATE KEY-----\n"]
    kinds = Counter()
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = [s for s in scanner.spans(text) if s[1] >= 3]
        assert got == plain_added(text), text
        kinds.update(n for _, n, _ in got)
    assert set(kinds) == {3, 4, 5, 6, 7}
    many = "-----BEGIN PRIVATE KEY-----\n" * 20_000
    assert len(scanner.spans(many)) == 20_000


def test_secret_query(spark, tmp_path, hard_texts):
    texts = [*hard_texts, f"é token=abcdefgh1 {'0a' * 20}\n-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nab+/=\n-----END RSA PRIVATE KEY-----!"]
    spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    names = [r.kind for r in secrets.DEFAULT_RULES]
    joined = lambda found: ",".join(f"{names[n]}:{a}:{b}" for a, n, b in found)
    rows = {r.doc_id: r for r in secrets.op8_secret_automaton(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base, added = plain_secrets(text or ""), plain_added(text or "")
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(n == k for _, n, _ in base) for k in range(3))
        assert rows[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and rows[i].spans == joined(sorted(base + added))
    assert "private_key" in rows[len(texts) - 1].spans
    redacted = secrets.redact(spark.read.parquet(f"{tmp_path}/documents.parquet").where(f"doc_id = {len(texts) - 1}")).first().text
    assert redacted == "é [ASSIGN] [HEX]\n[PRIVATE_KEY]!"


def test_added_rules_and_redaction(documents):
    text = f"é ghp_{'a1' * 18} and xoxb-{'1' * 12}; AIza{'b' * 35} -----BEGIN RSA PRIVATE KEY----- eyJabcd.eyJabcd.{'s' * 9}"
    kinds = {secrets.DEFAULT_RULES[n].kind for _, n, _ in secrets.Scanner().spans(text)}
    assert kinds >= {"github", "slack", "google", "jwt", "private_key"}
    given = ["x token=abcd1234 y", None, "", "password: short", f"token={'0a' * 20}!"]
    rows = {r.doc_id: r for r in secrets.redact(documents(given), length="n_chars").collect()}
    assert [rows[i].text for i in range(5)] == ["x [ASSIGN] y", None, "", "password: short", "[ASSIGN]!"]
    assert [rows[i].n_chars for i in range(5)] == [12, None, 0, 15, 9]
    assert secrets.redact(documents(given)).columns == documents(given).columns


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[^a-c]x{2,3}", "(ab?)+c", "x{2}|yz?", "\\x41[b-d]\\."])
def test_automata_match_like_patterns(pattern):
    dfa = automata.compile_union([automata.Parser(pattern).parse()], anywhere=False)
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice("abcdxyzA.") for _ in range(rng.randint(0, 8)))
        ends = [n for n in range(len(text) + 1) if re.fullmatch(pattern, text[:n])]
        assert dfa.longest(text.encode(), 0) == (max(ends) if ends else None)


def test_minimised_union_is_small():
    trees = [automata.Parser(p).parse() for p in ("ab|cb", "(a|c)b")]
    assert len(automata.compile_union(trees, anywhere=False)) == 4


def test_license_words_and_phrases_match_plain_code(hard_texts):
    rng = random.Random(9)
    parts = ["MIT", "License", "apache", "General", "public", " ", "-", "\n", "é", "license", "(c)", "2"]
    texts = [t for t in hard_texts if t] + ["".join(rng.choice(parts) for _ in range(30)) for _ in range(500)]
    matcher = licenses.Matcher()
    for text in texts:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES:
            q = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(q)] == q]
            places += found
            labels |= {label} if found else set()
        got = matcher.scan(text)
        assert (got["n_words"], sorted(got["places"]), set(got["base"])) == (len(words), sorted(places), labels)
    assert matcher.scan(None) == {"n_words": 0, "places": [], "base": [], "found": [], "score": 0.0}


def ends_of(items, words, at):
    """Where marked wording that starts at a word can end, by trying everything."""
    ends = {at}
    for kind, value in items:
        if kind == "word":
            ends = {e + 1 for e in ends if e < len(words) and words[e] == value}
        elif kind == "any":
            ends = {e + n for e in ends for n in range(value + 1) if e + n <= len(words)}
        else:
            ends = (ends if kind == "opt" else set()) | {x for e in ends for branch in value for x in ends_of(branch, words, e)}
    return ends


def sample_of(items, rng):
    """Some wording that the markup allows."""
    out = []
    for kind, value in items:
        if kind == "word":
            out.append(value.decode())
        elif kind == "any":
            out += [f"name{rng.randrange(9)}" for _ in range(rng.randint(0, value))]
        elif kind == "one" or rng.random() < 0.5:
            out += sample_of(rng.choice(value), rng)
    return out


@pytest.mark.parametrize("markup", ["a [[b|c d]] {{2}} e", "a <<b|c [[d]]>> [[{{1}} a]] b", "a {{3}} a b {{2}} a", "a [[a [[b]] c|d {{1}}]] e"])
def test_license_automata_match_plain_search(markup):
    automaton, rng = licenses.compile_template("t", markup), random.Random(5)
    for _ in range(4000):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"x"]) for _ in range(rng.randint(1, 9))]
        assert automaton.match(words, 0) == max(ends_of(licenses.parse(markup), words, 0), default=None), words


def test_whole_licenses_match_and_altered_ones_dont():
    matcher, rng = licenses.Matcher(), random.Random(6)
    for label, markup in licenses.TEMPLATES:
        parsed = licenses.parse(markup)
        for _ in range(6):
            words = sample_of(parsed, rng)
            text = " ".join(["Copyright (c) 2020 Some One,", *words, "and more"]).upper()
            assert label in matcher.scan(text)["found"]
            at = rng.choice([i for i, w in enumerate(words) if not w.startswith("name")])
            altered = [*words[:at], "unlike", *words[at + 1 :]]
            altered = [w.encode() for w in altered]
            expected = any(ends_of(parsed, altered, i) for i in range(len(altered)))
            assert (label in matcher.scan(b" ".join(altered).decode())["found"]) == expected
    grant = " ".join(sample_of(licenses.parse(dict(licenses.TEMPLATES)["mit"]), rng))
    assert "mit" in matcher.scan(grant)["found"]
    assert matcher.scan(grant[: len(grant) // 2] + " provided you pay")["found"] == []
    assert matcher.scan("under the MIT license is not what this is") | {"score": 0} == {"n_words": 9, "places": [2], "base": ["mit"], "found": [], "score": 0}
    two, three = (" ".join(sample_of(licenses.parse(dict(licenses.TEMPLATES)[k]), rng)) for k in ("bsd-2-clause", "bsd-3-clause"))
    assert (matcher.scan(two)["found"], matcher.scan(three)["found"]) == (["bsd-2-clause"], ["bsd-3-clause"])


@pytest.mark.parametrize("markup", ["a [[b", "a ]] b", "a | b", "a << b ]]", "a {x} b"])
def test_license_markup_that_is_refused(markup):
    with pytest.raises(ValueError):
        licenses.parse(markup)


def test_license_notices():
    matcher = licenses.Matcher()
    labels = lambda t: matcher.scan(t)["found"]
    assert labels("Released under the MIT License.") == ["mit-notice"]
    assert labels("licensed under the terms of the GNU General Public License, version 3 or later") == ["gpl-3.0-notice"]
    assert labels("licensed under the GNU Public License, version 3") == []
    assert labels("licensed under the Apache License; version 2.0") == ["apache-2.0-notice"]


def test_license_query(spark, tmp_path, hard_texts):
    texts = [*hard_texts, "Released under the MIT License. mit license", ("calm words " * 300_000) + "Apache License"]
    spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, labels int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in licenses.op10_license_templates(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE_PHRASES}
        every = sorted(k for found in places.values() for k in found)
        base = sorted(label for label, found in places.items() if found)
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(every), min(every, default=None), max(every, default=None))
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",") if r.labels else []) and 0 <= r.score <= 1
    assert rows[len(hard_texts)].labels == "mit,mit-notice" and rows[len(texts) - 1].labels == "apache"


def labelled(spark):
    rng = random.Random(3)
    letters = string.ascii_lowercase
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(600)]
    rows = []
    for i in range(900):
        bad = i % 9 == 0
        body = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        if bad:
            for _ in range(3):
                body[rng.randrange(len(body))] = "zorgle" + rng.choice(["s", "", "ing", "ed"])
        rows.append((i, " ".join(body) + ".", int(bad)))
    return spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxicity_learns_and_generalises(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert any(name.startswith("zor") for name, _ in model.weights)
    scored = toxicity.score(docs.join(labels, "doc_id"), model, out="s").where(toxicity.remainder("doc_id") == 1)
    hits = scored.groupBy("toxic", (F.col("s") >= 0.7).alias("p")).count().collect()
    assert all(r.p == bool(r.toxic) for r in hits if r["count"] > 1)


def test_toxicity_reads_clauses():
    grammar = toxicity.Grammar(toxicity.Model((("idiot$", 6.0),), (-2.0, 1.0, 0.0)))
    weight = lambda t: sum(grammar.clauses(t))
    plain = weight("an idiot there")
    assert weight("you idiot") == weight("idiot, you") == 1.25 * 6 > plain == 0.5 * 6 > weight("not an idiot") > 0
    assert weight("he said idiot") < plain
    assert weight("not now. idiot") == plain
    for harmless in ("we kill time", "i will kill the engine", "kill the noise. you win", "they beat the record", "your engine will burn oil", "burn these leaves", "you will burn oil", "kill the noise as you win", "you i will kill"):
        assert weight(harmless) == 0, harmless
    for threat in ("i will kill you", "i killed you", "i will be killing you", "we kill all of you", "beaten up and burnt them", "ich werde dich töten", "je vais te tuer", "te voy a matar"):
        assert weight(threat) == 4, threat
    assert weight("i will not kill you") == weight("never kill any one of all of you") == 2
    assert grammar.score("i will kill you") > grammar.score("i will kill the engine")
    assert weight('he said "you are a fool. you idiot."') == weight('he said you idiot') == 0.6 * weight("you idiot")
    assert weight('"a quotation" you idiot') == weight('"an open one\nyou idiot') == weight("you idiot")
    assert grammar.score(None) == grammar.score("") == grammar.score("calm words")


def test_no_lone_word_is_a_match():
    grammar = toxicity.Grammar(toxicity.Model((("idiot$", 6.0),), (-2.0, 1.0, 1.0)))
    for text in ("idiot", "that idiot savant", "not an idiot", "Idiot. They left"):
        assert 0 < grammar.score(text) <= toxicity.LONE, text
    for text in ("you idiot", "idiot, you", "idiot. an idiot", "i will kill you"):
        assert grammar.score(text) >= 0.7, text


def plain_clauses(text, weights):
    """The clause rules word for word: what was said, quoted, denied or named around each word."""
    found, linking = [], ("kill", "all", "not")
    for line in text.split("\n"):
        quoted = False
        for clause in re.split("[.!?;]", line):
            words = re.findall(r'"|\w+', clause)
            insults, threats, insulted, reported = 0.0, 0.0, False, False
            denied, near = 0, 0  # words that a negation and an object before still reach; "held" and "waits" for an object
            for word in words:
                factor = (0.5 if denied else 1) * (0.6 if quoted or reported else 1)
                if word == '"':
                    quoted, reported = not quoted, reported and quoted
                elif word == "said" and not quoted:
                    reported = True
                elif word == "idiot":
                    insults += weights["idiot"] * factor * (0.5 if insulted else 1)
                    insulted = True
                elif (word == "kill" and near not in (0, "waits")) or (word in ("you", "dich") and near == "waits"):
                    threats += 4 * factor
                if denied == "held":
                    denied = "held" if word in linking else 0
                elif denied and word == "kill":
                    denied = "held"
                else:
                    denied = 3 if word == "not" else max(0, denied - 1)
                if near == "waits":
                    near = "waits" if word in linking else 0
                elif word == "kill":
                    near = 0 if near else "waits"
                else:
                    near = 4 if word == "dich" else max(0, near - 1)
            total = insults * (1.25 if {"you", "dich", "they"} & set(words) else 0.5) + threats
            if total:
                found.append(total)
    return found


def test_toxicity_matches_plain_clauses():
    weights = {"idiot": 6.0}
    grammar, rng = toxicity.Grammar(toxicity.Model((("idiot$", 6.0),), (-2.0, 1.0, 0.0))), random.Random(12)
    for _ in range(6000):
        text = " ".join(rng.choice(["idiot", "kill", "you", "dich", "they", "all", "not", "said", '"', ".", "\n", "calm", "word", "word"]) for _ in range(rng.randint(1, 14)))
        assert grammar.clauses(text) == pytest.approx(plain_clauses(text, weights)), text


def test_toxicity_query(spark, tmp_path):
    docs, labels = labelled(spark)
    more = spark.createDataFrame([(5000, None), (5001, ""), (5002, ("calm words here. " * 60_000) + "you stupid idiot moron"), (5003, "you stupid idiot moron, you worthless scum"), (None, "x"), (5003, "calm")], "doc_id long, text string")
    more = docs.unionByName(more).withColumns({"toxic": F.lit(1), "score": F.lit("s"), "labels": F.lit(2)})
    more.write.parquet(f"{tmp_path}/documents.parquet")
    twice = labels.unionByName(spark.createDataFrame([(0, 0), (3, None), (None, 1), (7777, 1)], "doc_id long, toxic int"))
    twice.withColumn("text", F.lit("idiot")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op2_toxicity_grammar(spark, str(tmp_path)).collect()
    assert len(rows) == more.count()
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    caught = [r.predicted == (r.doc_id in toxic) for r in rows if r.held_out and r.doc_id < 5000]
    assert sum(caught) >= 0.98 * len(caught)
    scores = {r.doc_id: r.score for r in rows if r.doc_id in (5000, 5001, 5002)}
    assert scores[5000] == scores[5001] < scores[5002]
    assert sorted(r.predicted for r in rows if r.doc_id == 5003) == [0, 1]


def test_toxicity_without_labels(documents, spark):
    docs = documents(["you stupid idiot", None, "fine"])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r.s for r in toxicity.score(docs, model, out="s").collect()}
    assert got[0] > 0.7 > got[1] == got[2]
