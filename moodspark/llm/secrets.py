"""Secret scans with one deterministic automaton for all rules.

Every rule is a prefix and a run of body bytes. The prefixes, each followed by
as many body bytes as tell that the rule has begun, become one minimal automaton
that reads a text once, byte by byte; where it accepts, a reversed automaton
finds the leftmost start and the body run gives the end. A rule with a closing
marker goes on to it, over bytes of its ``inside`` class only. Matches of one rule
don't overlap; spans count code points, the end is exclusive.

Null and empty texts have no spans. Rows are independent: repeated rows give
repeated results, an empty table an empty one. Other columns are carried along;
one that is named like a result column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.llm.automata import Parser, compile_union, mirrored
from moodspark.llm.common import cached, field, map_column, table


@dataclass(frozen=True)
class Rule:
    """``prefix`` then ``body`` bytes, ``begun`` of them at least to start a match.

    A match that is begun takes its whole body run; it is reported when the body has
    ``least`` bytes. With ``closing``, a reported match goes on to the end of the first closing
    marker that only ``inside`` bytes lead to; without such a marker over the ``rest`` bytes that follow.
    """

    kind: str
    prefix: str
    body: str
    begun: int
    least: int
    ignore_case: bool = False
    closing: str = ""
    inside: str = ""
    rest: str = ""


# Kinds and patterns of the base rules.
BASE_RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 1, 8, True),
    Rule("access", "AKIA", "[A-Z0-9]", 1, 12),
    Rule("hex", "", "[0-9a-f]", 32, 32),
)
#: Rules of the method's own: vendor tokens, signed web tokens and private keys.
ADDED_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 1, 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 1, 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 1, 35),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 1, 8),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY", "[-]", 1, 5, closing="-----END ([A-Z]+ )*PRIVATE KEY-----", inside="[A-Za-z0-9+/=\\x09\\x0A\\x0D\\x20:,-]", rest="[A-Za-z0-9+/=\\x0A\\x0D]"),
)
DEFAULT_RULES = BASE_RULES + ADDED_RULES


class Scanner:
    """The compiled rules; ``spans`` reads one text."""

    def __init__(self, rules: tuple[Rule, ...] = DEFAULT_RULES) -> None:
        self.rules = rules
        begun = []
        for rule in rules:
            prefix = Parser(rule.prefix, rule.ignore_case).parse()
            body = Parser(rule.body, False).parse()
            begun.append(("cat", [prefix, ("rep", body, rule.begun, rule.begun)]))
        self.forward = compile_union(begun, anywhere=True)
        self.backward = [compile_union([mirrored(tree)], anywhere=False) for tree in begun]
        self.body = [self.members(rule.body) for rule in rules]
        self.inside = [self.members(rule.inside) if rule.closing else None for rule in rules]
        self.rest = [self.members(rule.rest) if rule.closing else None for rule in rules]
        self.closing = [compile_union([Parser(rule.closing).parse()], anywhere=True) if rule.closing else None for rule in rules]

    @staticmethod
    def members(pattern: str) -> list[bool]:
        """Which bytes a class of one byte holds."""
        values = Parser(pattern).parse()[1][0][1]
        return [b in values for b in range(256)]

    def closed(self, number: int, data: bytes, at: int, none_before: dict[int, int]) -> int:
        """The end of a match of a rule with a closing marker; its body ends at ``at``.

        ``none_before``: for each rule, up to where a look from an earlier match has found no marker.
        """
        if at >= none_before.get(number, 0):
            inside, automaton = self.inside[number], self.closing[number]
            state, place = automaton.start, at
            while place < len(data) and inside[data[place]]:
                state = automaton.rows[state][data[place]]
                place += 1
                if state >= automaton.first_accepting:
                    return place
            none_before[number] = place
        rest = self.rest[number]
        while at < len(data) and rest[data[at]]:
            at += 1
        return at

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes of all reported matches, by start and rule."""
        rows, first, accepts = self.forward.rows, self.forward.first_accepting, self.forward.accepts
        done = [0] * len(self.rules)
        found = []
        none_before: dict[int, int] = {}
        state = self.forward.start
        at = 0
        for byte in data:
            state = rows[state][byte]
            at += 1
            if state >= first:
                for number in accepts[state]:
                    if at <= done[number]:
                        continue
                    start = self.backward[number].longest(data, at, -1, done[number])
                    if start is None:
                        continue
                    body, end = self.body[number], at
                    while end < len(data) and body[data[end]]:
                        end += 1
                    if end - at + self.rules[number].begun >= self.rules[number].least:
                        if self.closing[number]:
                            end = self.closed(number, data, end, none_before)
                        found.append((start, number, end))
                    done[number] = end
        return sorted(found)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """As ``matches``, in code points."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found = self.matches(data)
        if len(data) == len(text) or not found:
            return found
        place, chars, last = {}, 0, 0
        for edge in sorted({edge for start, _, end in found for edge in (start, end)}):
            chars += len(data[last:edge].decode("utf-8", "surrogatepass"))
            place[edge], last = chars, edge
        return [(place[start], number, place[end]) for start, number, end in found]


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(df: DataFrame, text: str = "text", spans: str = "secret_spans", rules: tuple[Rule, ...] = DEFAULT_RULES, keep: list[str] | None = None) -> DataFrame:
    """Add the spans of all rules in ``text``, ordered by start and then by rule."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(values: list) -> list[pa.Array]:
        scanner = cached(rules, lambda: Scanner(rules))
        kinds = [rule.kind for rule in rules]
        made = [[{"kind": kinds[n], "start": a, "end": b} for a, n, b in scanner.spans(v)] for v in values]
        return [pa.array(made, arrow)]

    return map_column(df, text, run, [field(spans, SPAN_TYPE)], keep)


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES, mask: str = "[{kind}]", length: str | None = None) -> DataFrame:
    """Replace every span by its mask; spans that overlap are masked as one, under the first one's kind.

    Null texts stay null. ``length`` names a column to set to the new text's code points.
    The columns come back in their order.
    """
    order = df.columns

    def cleaned(scanner: Scanner, value: str | None) -> str | None:
        found = scanner.spans(value)
        if not found:
            return value
        parts, at = [], 0
        for start, number, end in found:
            if start >= at:
                parts += [value[at:start], mask.format(kind=rules[number].kind.upper())]
            at = max(at, end)
        return "".join([*parts, value[at:]])

    def run(values: list) -> list[pa.Array]:
        scanner = cached(rules, lambda: Scanner(rules))
        made = [cleaned(scanner, v) for v in values]
        out = [pa.array(made, pa.string())]
        return out if length is None else [*out, pa.array([None if v is None else len(v) for v in made], pa.int64())]

    new = [field(text, T.StringType())] + ([field(length, T.LongType())] if length else [])
    return map_column(df, text, run, new).select(*(f"`{c}`" for c in order))


def op8_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``: base counts, base digest and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, keep=["doc_id"])
    base = [rule.kind for rule in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(joined(F.filter("secret_spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
