"""Toxicity by a weighted finite-state pattern grammar.

Word transducers turn words into symbols: insults (a weighted character trie
learned from labelled texts, with a few seeds), threats with their inflected
forms, people who are addressed or acted on, negations and reported speech. Four
small machines read the symbols of a clause; their composition is one automaton
whose moves carry factors and whose states carry a final factor.

* An insult is bound if its clause names someone, before or after it: the clause's final factor is then above one,
  without anyone it is ``BARE``.
* A threat counts only with its object: a pronoun that follows it, with nothing but ``FILLERS`` between, or a
  pronoun that stands up to four words before it in the languages that put it there. Subjects and owners are no objects.
* A text with no bound clause and one insulting word in all is no match: it scores ``LONE`` at most.

A quotation goes on over sentence ends to its closing
mark or the end of the line. The score is a logistic of the matched clauses' total
weight and of their weight per hundred words; both saturate at ``Model.cap``, as beyond
it more evidence changes nothing.

The learned insults are whole words or word beginnings of ``SHORTEST`` to ``LONGEST``
letters, so that inflected forms count.

Only labelled rows whose ``crc32(id as text) mod folds`` differs from the held-out
remainder are learned from, ``max_rows`` of them at most (a bounded sample in the
order of a hash of the id, so that it can be broadcast). Labels, language,
source and id are no inputs of a score.

Null and empty texts score the prior. Rows are independent: repeated rows give
repeated results; of contradicting labels of one id the highest counts. Without
any labelled row the seeds alone are used and the prior is one in ten. An empty table
of documents gives an empty result. A text of any length is read once from end to end; a
worker holds a batch of texts and the words of one. Other
columns are carried along; one named like a result column is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.llm.common import bound_batches, cached, field, map_column, table

# Seeds of the word transducers.
SEED_INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "imbecile", "dumbass")
THREATS = ("kill", "murder", "strangle", "hurt", "destroy", "beat", "burn")
ENDINGS = ("", "s", "ed", "ing", "in", "en", "t")
OTHER_THREATS = ("töten", "töte", "umbringen", "verprügeln", "verprügle", "tuer", "tuerai", "tuerons", "frapper", "frapperai", "matar", "mataré", "mataremos", "golpear", "golpearé")
OBJECTS = ("you", "u", "yourself", "yourselves", "him", "her", "them", "usted", "ustedes", "toi", "ti")
OBJECTS_BEFORE = ("dich", "euch", "te", "vous", "os")
ADDRESSED = ("your", "yours", "they", "these", "du", "dein", "deine", "ihr", "tu", "vosotros", "eres")
FILLERS = ("all", "any", "one", "each", "every", "both", "of", "and", "the", "lot", "up", "down", "out", "off")
NEGATIONS = ("not", "no", "never", "nobody", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "ni", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "writes", "called", "claimed", "quoted", "reported", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

OTHER, INSULT, THREAT, OBJECT, BEFORE, ADDRESS, FILLER, NEGATION, REPORT, QUOTE, STOP, LINE = SYMBOLS = range(12)
NAMED = (OBJECT, BEFORE, ADDRESS)
ENDS = {".": STOP, "!": STOP, "?": STOP, ";": STOP, "\n": LINE}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”„«»]")
WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 10
WORD_END = "$"
#: What an insult counts for if its clause names nobody, and if it names someone.
BARE, BOUND = 0.5, 1.25
#: The highest score of a text whose only match is one insulting word that is bound to nobody.
LONE = 0.6


def inflected(stem: str) -> set[str]:
    """The forms of a regular English verb and the few irregular ones that its endings also spell."""
    short = stem.removesuffix("e")
    return {stem} | {base + ending for base in (stem, short) for ending in ENDINGS if not (base != stem and ending in ("", "s", "t"))}


@dataclass(frozen=True)
class Machine:
    """A small transducer: (state, symbol) -> state, the factor of a symbol in a state, and a state's final factor for insults."""

    moves: dict
    factors: dict
    final: dict

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), self.moves.get((state, None), state))

    def factor(self, state: int, symbol: int) -> float:
        return self.factors.get((state, symbol), 1.0)


def machines(scope: int = 3, reach: int = 4) -> list[Machine]:
    """Object, address, negation, reported speech and repetition machines, in that order.

    A threat is paid for with its object: state ``reach + 1`` waits for one that follows, states 1 to ``reach`` count down
    the words since one that stood before. A negation holds for ``scope`` words, or from a threat in its reach to that
    threat's object; a verb of report holds for the rest of the clause, a quotation to its end.
    """
    ends = lambda states: {(s, end): 0 for s in states for end in (STOP, LINE)}
    waiting = reach + 1
    objects = {(s, None): s - 1 for s in range(1, waiting)} | {(waiting, None): 0} | ends(range(1, waiting + 1))
    objects |= {(s, BEFORE): reach for s in range(waiting)} | {(s, THREAT): 0 for s in range(1, waiting)}
    objects |= {(0, THREAT): waiting} | {(waiting, kind): waiting for kind in (THREAT, FILLER, NEGATION)}
    unpaid = {(s, THREAT): 0.0 for s in (0, waiting)} | {(s, kind): 0.0 for s in range(waiting) for kind in (OBJECT, BEFORE)}
    held = scope + 1
    denied = {(s, None): s - 1 for s in range(1, held)} | {(s, NEGATION): scope for s in range(held)} | {(held, None): 0}
    denied |= {(s, THREAT): held for s in range(1, held)} | {(held, kind): held for kind in (THREAT, FILLER, NEGATION)}
    report = {(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 2, (2, QUOTE): 0, (1, STOP): 0, (1, LINE): 0, (2, LINE): 0}
    counted = (INSULT, THREAT, OBJECT, BEFORE)
    return [
        Machine(objects, unpaid, {}),
        Machine({(0, kind): 1 for kind in NAMED} | ends((1,)), {}, {0: BARE, 1: BOUND}),
        Machine(denied | ends(range(1, held + 1)), {(s, kind): 0.5 for s in range(1, held + 1) for kind in counted}, {}),
        Machine(report, {(s, kind): 0.6 for s in (1, 2) for kind in counted}, {}),
        Machine({(0, INSULT): 1} | ends((1,)), {(1, INSULT): 0.5}, {}),
    ]


def compose(parts: list[Machine]) -> tuple[list[list[int]], list[list[float]], list[float]]:
    """The product of the machines: next state and factor by state and symbol, final factor by state."""
    start = (0,) * len(parts)
    number, order = {start: 0}, [start]
    moves: list[list[int]] = []
    factors: list[list[float]] = []
    for current in order:  # grows while it is read
        row, weights = [], []
        for symbol in SYMBOLS:
            target = tuple(m.step(s, symbol) for m, s in zip(parts, current, strict=True))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
            weights.append(math.prod(m.factor(s, symbol) for m, s in zip(parts, current, strict=True)))
        moves.append(row)
        factors.append(weights)
    return moves, factors, [math.prod(m.final.get(s, 1.0) for m, s in zip(parts, state, strict=True)) for state in order]


@dataclass(frozen=True)
class Model:
    """Weights of word beginnings (whole words end with ``WORD_END``) and the logistic's
    coefficients: the constant, of the total weight and of the weight per hundred words."""

    weights: tuple[tuple[str, float], ...]
    coefficients: tuple[float, float, float]
    threat_weight: float = 4.0
    cap: float = 20.0


class Grammar:
    """A model with its composed automaton; ``score`` reads one text."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.weights = dict(model.weights)
        self.moves, self.factors, self.final = compose(machines())
        threats = {form for stem in THREATS for form in inflected(stem)} | set(OTHER_THREATS)
        kinds = ((THREAT, threats), (OBJECT, OBJECTS), (BEFORE, OBJECTS_BEFORE), (ADDRESS, ADDRESSED), (FILLER, FILLERS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
        self.symbols = {w: s for s, words in kinds for w in words}
        self.heads = {w[:SHORTEST] for w in self.weights} | {w[:SHORTEST] for w in threats}

    def insult(self, word: str) -> float:
        """The weight of a word: the highest among its beginnings that the trie accepts."""
        weights = self.weights
        ends = [weights[word[:n]] for n in range(SHORTEST, min(len(word), LONGEST) + 1) if word[:n] in weights]
        if (whole := word + WORD_END) in weights:
            ends.append(weights[whole])
        return max(ends, default=0.0)

    def matches(self, text: str) -> list[tuple[float, int, bool]]:
        """The matched clauses of a lower-case text: weight, insulting words, and whether an insult or a threat is bound to someone."""
        moves, factors, final, found = self.moves, self.factors, self.final, []
        state, insults, threats, count = 0, 0.0, 0.0, 0

        def close() -> None:
            if insults or threats:
                bound = bool(threats) or final[state] > 1
                found.append((insults * final[state] + threats, count, bound))

        for token in TOKEN.findall(text):
            if token in ENDS:
                close()
                state, insults, threats, count = moves[state][ENDS[token]], 0.0, 0.0, 0
                continue
            symbol = QUOTE if token in '"“”„«»' else self.symbols.get(token, OTHER)
            if symbol in (THREAT, OBJECT, BEFORE):
                threats += self.model.threat_weight * factors[state][symbol]
            elif symbol == OTHER and token[:SHORTEST] in self.heads and (weight := self.insult(token)):
                symbol, count = INSULT, count + 1
                insults += weight * factors[state][symbol]
            state = moves[state][symbol]
        close()
        return found

    def clauses(self, text: str) -> list[float]:
        """The weights of the matched clauses."""
        return [weight for weight, _, _ in self.matches(text)]

    def evidence(self, text: str | None) -> tuple[float, float, bool]:
        """The total weight of the matched clauses and the weight per hundred words, both capped; and whether they are
        more than one word that is bound to nobody."""
        if not text:
            return 0.0, 0.0, False
        lowered = text.lower()
        words = WORD.findall(lowered)
        if self.heads.isdisjoint([w[:SHORTEST] for w in words]):
            return 0.0, 0.0, False
        found = self.matches(lowered)
        total = sum(weight for weight, _, _ in found)
        matched = any(bound for _, _, bound in found) or sum(count for _, count, _ in found) > 1
        return min(self.model.cap, total), min(self.model.cap, 100 * total / (20 + len(words))), matched

    def score(self, text: str | None) -> float:
        constant, by_total, by_density = self.model.coefficients
        total, density, matched = self.evidence(text)
        likely = 1.0 / (1.0 + math.exp(-(constant + by_total * total + by_density * density)))
        return likely if matched or not total else min(likely, LONE)


def remainder(doc_id: str | Column, folds: int = 3) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)).cast("int")


def beginnings(text: str | None) -> set[str]:
    """The distinct word beginnings and whole words of a text."""
    found: set[str] = set()
    for word in set(WORD.findall(text.lower())) if text else ():
        if len(word) >= SHORTEST:
            found.add(word + WORD_END)
            found.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
    return found


def family(text: str | None, least: int = 4) -> str:
    """A key that near copies of a text mostly share and other texts don't: the ``least`` smallest digests of its long words."""
    words = {w for w in WORD.findall(text.lower()) if len(w) >= 8} if text else ()
    if len(words) < least:
        return f"={text}"
    return "".join(sorted(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest() for w in words)[:least])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    max_rows: int = 20_000,
    max_entries: int = 4_000,
    least_weight: float = 2.0,
) -> Model:
    """Learn the insult trie: beginnings that mark toxic texts beyond chance, at a bounded rate of false discoveries over all that were tried.

    Near copies of a text count as one, else chance words of a text with many copies
    would look certain. A beginning's weight is its smoothed log-odds of toxic against other texts. The
    lexicon that reaches the driver has ``max_entries`` entries at most, the most certain;
    entries below ``least_weight`` are left out. The logistic is fitted to the evidence of
    the same bounded sample.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (remainder(doc_id, folds) != held_out))
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(F.col(label).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    matched = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id").select("__text", "__label")

    def keyed(values: list) -> list[pa.Array]:
        return [pa.array([family(v) for v in values], pa.string())]

    # At most max_rows rows, and a family with many members meets a partial minimum first.
    families = map_column(matched, "__text", keyed, [field("__family", T.StringType())])
    sample = families.groupBy("__family", "__label").agg(F.min("__text").alias("__text")).select("__text", "__label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for value, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kinds[kind > 0].update(beginnings(value))
                rows[kind > 0] += 1
        names = list(kinds[0] | kinds[1])
        for at in range(0, len(names) + 1, 50_000):
            part = names[at : at + 50_000] + ([""] if at + 50_000 > len(names) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.string()),
                    pa.array([kinds[1][n] if n else rows[1] for n in part], pa.int64()),
                    pa.array([kinds[0][n] if n else rows[0] for n in part], pa.int64()),
                ],
                names=["name", "bad", "good"],
            )

    counts = sample.mapInArrow(count, "name string, bad long, good long").groupBy("name").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    seeds = [w + WORD_END for w in SEED_INSULTS]
    # What can pass the test below: at least three toxic texts, and not rare among them.
    likely = counts.where((F.col("name").isin("", *seeds)) | ((F.col("bad") >= 3) & (3 * F.col("bad") > F.col("good"))))
    ranked = likely.orderBy(~F.col("name").isin("", *seeds), (F.col("bad") - F.col("good") / 3).desc(), "name").limit(8 * max_entries).collect()
    tried = max(1, max_rows)
    totals = next(((r["bad"], r["good"]) for r in ranked if r["name"] == ""), (0, 0))
    bad_rows, good_rows = totals
    weights: dict[str, float] = {}
    if bad_rows and good_rows:
        tried = max(tried, 40 * (bad_rows + good_rows))
        tests = []
        for r in ranked:
            if r["name"]:
                a, b = r["bad"], r["good"]
                weight = math.log((a + 0.5) / (bad_rows + 1)) - math.log((b + 0.5) / (good_rows + 1))
                if r["name"] in seeds or weight >= least_weight:
                    tests.append((surprise(a, b, bad_rows, good_rows), r["name"], weight))
        tests.sort(reverse=True)
        # Step-up: of the entries kept, one in twenty at most is expected to be chance among all that were tried.
        passed = max((k for k, (found, _, _) in enumerate(tests, 1) if found >= 2 * math.log(tried / (0.05 * k))), default=0)
        tests = tests[:passed] + [t for t in tests[passed:] if t[1] in seeds]
        weights = {name: max(0.0, weight) for _, name, weight in tests[:max_entries]}
    for seed in seeds:
        weights.setdefault(seed, 3.5)
    prior = math.log((bad_rows + 0.5) / (good_rows + 0.5)) if bad_rows + good_rows else math.log(1 / 9)
    lexicon = tuple(sorted((n, w) for n, w in weights.items() if w > 0))
    draft = Model(lexicon, (prior, 1.0, 0.0))
    if not (bad_rows and good_rows):
        return draft

    def weigh(values: list) -> list[pa.Array]:
        grammar = cached(("toxicity", draft), lambda: Grammar(draft))
        made = [grammar.evidence(v) for v in values]
        return [pa.array([m[i] for m in made], pa.float64()) for i in (0, 1)]

    evidence = map_column(sample, "__text", weigh, [field("total", T.DoubleType()), field("density", T.DoubleType())], ["__label"])
    rows = evidence.groupBy("__label", F.round("total", 2).alias("total"), F.round("density", 2).alias("density")).count().collect()
    table_of = [(float(r["total"]), float(r["density"]), float(r["__label"] > 0), float(r["count"])) for r in rows]
    return Model(lexicon, logistic(table_of, prior))


def logistic(rows: list[tuple[float, float, float, float]], prior: float, ridge: float = 0.5, rounds: int = 40) -> tuple[float, float, float]:
    """Newton's method for (total, density, label, count) rows, with a pull towards (prior, 1/2, 0)."""
    data = np.array(rows)
    x = np.column_stack([np.ones(len(data)), data[:, 0], data[:, 1]])
    centre = np.array([prior, 0.5, 0.0])
    beta = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (data[:, 3] * (data[:, 2] - p)) - ridge * (beta - centre)
        curve = (x * (data[:, 3] * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.clip(np.linalg.solve(curve, slope), -1, 1)
        beta = beta + step
        beta[1:] = np.maximum(beta[1:], 0.0)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(round(float(b), 6) for b in beta)


def surprise(a: int, b: int, bad_rows: int, good_rows: int) -> float:
    """The log-likelihood ratio of the two-by-two table of a word and the label."""
    n, seen = bad_rows + good_rows, a + b
    cells = ((a, seen * bad_rows / n), (b, seen * good_rows / n), (bad_rows - a, (n - seen) * bad_rows / n), (good_rows - b, (n - seen) * good_rows / n))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """Add the toxicity score of ``text``, 0 to 1."""

    def run(values: list) -> list[pa.Array]:
        grammar = cached(("toxicity", model), lambda: Grammar(model))
        return [pa.array([grammar.score(v) for v in values], pa.float64())]

    return map_column(df, text, run, [field(out, T.DoubleType())], keep)


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Score every whole text of ``documents``; labels are learned from two folds of three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model, out="score", keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
