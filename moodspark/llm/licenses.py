"""License scans by matching template markup with token automata.

A template is wording with marked regions: ``[[ ... ]]`` may be absent,
``<<a|b>>`` is one of several wordings and ``{{n}}`` stands for up to n words that
may be replaced. Templates are compiled to automata over words; a text is accepted
where the mandatory wording of a template stands word for word. Templates of whole
licenses have the license's name as label and take its whole wording; those of
one-line notices are labelled ``-notice``. Words are runs of letters A-Z in either case,
digits and everything outside ASCII; all else separates.

Null and empty texts have no words, no labels and score 0. Rows are
independent: repeated rows give repeated results, an empty table an empty one.
Other columns are carried along; one named like a result column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodspark.llm.common import cached, field, map_column, table

# Base phrases and their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

_GPL_HEADER = """
<<this program|{name}>> is free software you can redistribute it and or modify it under the terms of the GNU {kind}general public license
as published by the free software foundation [[either]] version {version} [[of the license [[or at your option any later version]]]]
<<this program|{name}>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the GNU {kind}general public license for more details"""

_BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1|a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[2|b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution {third}
this software is provided by {{{{12}}}} as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall {{{{12}}}} be liable for any direct indirect incidental
special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits
or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""

# The wording of licenses and of notices at the head of files, with their optional and replaceable regions.
TEMPLATES = (
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
        following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all
        copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including
        but not limited to the warranties of merchantability fitness for a particular purpose and <<noninfringement|non infringement>> in no event
        shall the {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of
        or in connection with the software or the use or other dealings in the software""",
    ),
    (
        "isc",
        """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and {{8}} disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable
        for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in
        an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    ),
    ("bsd-2-clause", _BSD.format(third="")),
    (
        "bsd-3-clause",
        _BSD.format(
            third="""[[3|c]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from
            this software without specific prior written permission"""
        ),
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the <<author|authors>> be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not
        be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the
        product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not
        be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution""",
    ),
    (
        "apache-2.0",
        """licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may
        obtain a copy of the license at <<http|https>> www apache org licenses license 2 0 unless required by applicable law or agreed to in
        writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
        express or implied see the license for the specific language governing permissions and limitations under the license""",
    ),
    ("gpl-2.0", _GPL_HEADER.format(name="this software", kind="", version=2)),
    ("gpl-3.0", _GPL_HEADER.format(name="this software", kind="", version=3)),
    ("agpl-3.0", _GPL_HEADER.format(name="this software", kind="affero ", version=3)),
    ("lgpl-2.1", _GPL_HEADER.format(name="this library", kind="lesser ", version="2 1")),
    ("lgpl-3.0", _GPL_HEADER.format(name="this library", kind="lesser ", version=3)),
    ("mit-notice", "<<released|licensed|distributed|available|provided>> under the [[terms of the]] MIT license"),
    ("apache-2.0-notice", "licensed under the [[terms of the]] Apache license version 2 0"),
    ("gpl-2.0-notice", "licensed under the [[terms of the]] GNU general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0-notice", "licensed under the [[terms of the]] GNU general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("lgpl-notice", "licensed under the [[terms of the]] GNU lesser general public license [[as published by the free software foundation]] [[version {{2}}]]"),
    ("mpl-2.0-notice", "subject to the terms of the Mozilla public license v 2 0"),
    ("cc-by-4.0-notice", "licensed under [[a creative commons attribution 4 0 international license|the creative commons attribution license]] CC BY 4 0"),
    ("cc-by-sa-4.0-notice", "licensed under CC BY SA 4 0"),
    ("cc-by-nc-4.0-notice", "licensed under CC BY NC 4 0"),
)

_SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def separated(text: str) -> bytes:
    """A text as UTF-8 with A-Z lower-cased and spaces for all that isn't part of a word."""
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATED)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return separated(text).split() if text else []


@dataclass(frozen=True)
class TokenAutomaton:
    """Deterministic over words: ``moves[s]`` maps a word to a state, None any other word.

    The states are sets of positions of the template's word graph.
    """

    label: str
    moves: tuple[dict, ...]
    final: frozenset[int]
    heads: frozenset[bytes]
    mandatory: int

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest match that starts at word ``at``."""
        state, best = 0, None
        for end in range(at, len(words)):
            step = self.moves[state]
            state = step.get(words[end], step.get(None))
            if state is None:
                break
            if state in self.final:
                best = end + 1
        return best


CLOSES = {"[[": "]]", "<<": ">>"}


def parse(markup: str) -> list:
    """Markup as ('word', w), ('any', n), ('opt', alternatives) and ('one', alternatives) items."""
    tokens = re.findall(r"\[\[|\]\]|<<|>>|\||\{\{\d+\}\}|[^\s\[\]{}|<>]+|\S", markup)

    def items(at: int, closing: str | None) -> tuple[list, int]:
        branches: list[list] = [[]]
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token == closing:
                return branches, at
            if token in CLOSES:
                inner, at = items(at, CLOSES[token])
                branches[-1].append(("opt" if token == "[[" else "one", inner))
            elif token == "|" and closing:
                branches.append([])
            elif token.startswith("{{"):
                branches[-1].append(("any", int(token[2:-2])))
            elif token in ("|", "]]", ">>") or not words_of(token):
                raise ValueError(f"{token!r} out of place in the markup: {markup}")
            else:
                branches[-1] += [("word", word) for word in words_of(token)]
        if closing:
            raise ValueError(f"{closing!r} is missing in the markup: {markup}")
        return branches, at

    return items(0, None)[0][0]


def compile_template(label: str, markup: str) -> TokenAutomaton:
    """The template's word graph by subset construction."""
    edges: list[list[tuple[bytes | None, int]]] = [[]]
    empty: list[list[int]] = [[]]
    mandatory = 0

    def state() -> int:
        edges.append([])
        empty.append([])
        return len(edges) - 1

    def attach(items: list, start: int, counted: bool) -> int:
        nonlocal mandatory
        for kind, value in items:
            if kind == "word":
                end = state()
                edges[start].append((value, end))
                mandatory += counted
            elif kind == "any":
                end = state()
                empty[start].append(end)
                for _ in range(value):
                    nxt = state()
                    edges[start].append((None, nxt))
                    empty[nxt].append(end)
                    start = nxt
            else:
                end = state()
                if kind == "opt":
                    empty[start].append(end)
                else:
                    mandatory += counted
                for branch in value:
                    first = state()
                    empty[start].append(first)
                    empty[attach(branch, first, False)].append(end)
            start = end
        return start

    last = attach(parse(markup), 0, True)

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    subsets = [closure([0])]
    number = {subsets[0]: 0}
    moves: list[dict] = []
    for subset in subsets:  # grows while it is read
        step: dict = {}
        for word in {w for s in subset for w, _ in edges[s]}:
            target = closure({end for s in subset for w, end in edges[s] if w is None or w == word})
            if target not in number:
                number[target] = len(subsets)
                subsets.append(target)
            step[word] = number[target]
        moves.append(step)
    return TokenAutomaton(label, tuple(moves), frozenset(number[s] for s in subsets if last in s), frozenset(w for w in moves[0] if w is not None), mandatory)


class Matcher:
    """All compiled templates and phrases, looked up by the words that can begin a match."""

    def __init__(self, templates: tuple = TEMPLATES, phrases: tuple = BASE_PHRASES) -> None:
        self.templates = [compile_template(label, markup) for label, markup in templates]
        self.phrases = [(words_of(phrase), label) for phrase, label in phrases]
        self.heads: dict[bytes, list[int]] = {}
        for n, automaton in enumerate(self.templates):
            if None in automaton.moves[0]:
                raise ValueError(f"template {automaton.label} starts with a replaceable region")
            for word in automaton.heads:
                self.heads.setdefault(word, []).append(n)
        # Every match ends with or holds one of these words, so texts without them are done at once.
        self.anchors = [re.escape(words[-1]) for words, _ in self.phrases]
        self.anchors += [re.escape(self._anchor(markup)) for _, markup in templates]
        self.gate = re.compile(b"|".join(sorted(set(self.anchors))))

    @staticmethod
    def _anchor(markup: str) -> bytes:
        """The longest mandatory word of a template."""
        return max((value for kind, value in parse(markup) if kind == "word"), key=len)

    def scan(self, text: str | None) -> dict:
        """Words, base places and the labels of one text."""
        if not text:
            return {"n_words": 0, "places": [], "base": [], "found": [], "score": 0.0}
        lowered = separated(text)
        words = lowered.split()
        out = {"n_words": len(words), "places": [], "base": [], "found": [], "score": 0.0}
        if not self.gate.search(lowered):
            return out
        seen = {word for word in words}
        for phrase, label in self.phrases:
            if phrase[-1] in seen:
                n = len(phrase)
                places = [i - n + 1 for i in range(n - 1, len(words)) if words[i] == phrase[-1] and words[i - n + 1 : i + 1] == phrase]
                out["places"] += places
                out["base"] += [label] if places else []
        found: dict[str, int] = {}
        heads = self.heads
        for at, word in enumerate(words):
            for n in heads.get(word, ()):
                automaton = self.templates[n]
                if automaton.label not in found and automaton.match(words, at) is not None:
                    found[automaton.label] = automaton.mandatory
        out["found"] = sorted(found)
        # One license name alone may be talk about it; each mandatory word that stands as asked adds certainty.
        evidence = max(found.values(), default=0)
        out["score"] = 1.0 - 0.5 ** (1 + evidence / 2) if evidence else 0.5 if out["places"] else 0.0
        return out


def detect(df: DataFrame, text: str = "text", templates: tuple = TEMPLATES, phrases: tuple = BASE_PHRASES, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``phrase_starts``, ``base_labels``, ``template_labels`` (arrays) and ``license_score``."""

    def run(values: list) -> list[pa.Array]:
        matcher = cached(("licenses", templates, phrases), lambda: Matcher(templates, phrases))
        made = [matcher.scan(v) for v in values]
        return [
            pa.array([m["n_words"] for m in made], pa.int64()),
            pa.array([sorted(m["places"]) for m in made], pa.list_(pa.int64())),
            pa.array([sorted(set(m["base"])) for m in made], pa.list_(pa.string())),
            pa.array([m["found"] for m in made], pa.list_(pa.string())),
            pa.array([m["score"] for m in made], pa.float64()),
        ]

    new = [
        field("n_words", T.LongType()),
        field("phrase_starts", T.ArrayType(T.LongType())),
        field("base_labels", T.ArrayType(T.StringType())),
        field("template_labels", T.ArrayType(T.StringType())),
        field("license_score", T.DoubleType()),
    ]
    return map_column(df, text, run, new, keep)


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every whole text of ``documents``: base phrases and template labels."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrase_starts").cast("long").alias("n_base"),
        F.array_min("phrase_starts").alias("first_word"),
        F.array_max("phrase_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "template_labels")), ",").alias("labels"),
        F.col("license_score").alias("score"),
    )


