"""The two sentiment scorers as plain functions of one text: what the relational ones are held against."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Mapping, Sequence

from moodspark.operators.opinions import BOOST, CAPITALS, DISTANCE, NEGATED, NEGATIONS, STRONGER, WEAKER
from moodspark.operators.providers import ALPHA


def words_and_marks(text: str) -> list[str]:
    """Words without the punctuation around them; short tokens, such as emoticons, stay as they are."""
    out = []
    for token in text.split():
        bare = token.strip(string.punctuation)
        out.append(token if len(bare) <= 2 else bare)
    return out


def is_negation(word: str) -> bool:
    low = word.lower().replace("'", "").replace("’", "")
    return low in NEGATIONS or "n't" in word.lower()


class RuleScorer:
    """The compound score of a text."""

    def __init__(self, valences: Mapping[str, float]) -> None:
        self.valences = dict(valences)
        self.boosts = dict.fromkeys(STRONGER, BOOST) | dict.fromkeys(WEAKER, -BOOST)

    def __call__(self, text: str) -> float:
        words = words_and_marks(text)
        shouting = [w.isupper() and len(w) > 1 for w in words]
        mixed = any(shouting) and not all(shouting)
        found = [self.valence(words, i, shouting, mixed) for i in range(len(words))]
        turn = next((i for i, w in enumerate(words) if w.lower() == "but"), None)
        if turn is not None:
            found = [v * (0.5 if i < turn else 1.5 if i > turn else 1.0) for i, v in enumerate(found)]
        total = math.fsum(found)
        marks = self.emphasis(text)
        total += marks if total > 0 else -marks if total < 0 else 0.0
        return round(max(-1.0, min(1.0, total / math.sqrt(total * total + ALPHA))), 4)

    def valence(self, words: Sequence[str], i: int, shouting: Sequence[bool], mixed: bool) -> float:
        low = words[i].lower()
        if low in self.boosts or low not in self.valences:
            return 0.0
        value = self.valences[low]
        if low == "no" and i + 1 < len(words) and words[i + 1].lower() in self.valences:
            return 0.0
        sign = 1 if value > 0 else -1
        if mixed and shouting[i]:
            value += sign * CAPITALS
        for back in range(1, 4):
            if i < back:
                break
            before = words[i - back].lower()
            if before in self.valences and before not in self.boosts:
                continue
            boost = self.boosts.get(before, 0.0)
            if boost:
                boost += math.copysign(CAPITALS, boost) if mixed and shouting[i - back] else 0.0
                value += sign * boost * DISTANCE[back - 1]
            if is_negation(words[i - back]):
                value *= NEGATED
        if i and words[i - 1].lower() == "least" and (i < 2 or words[i - 2].lower() not in ("at", "very")):
            value *= NEGATED
        return value

    @staticmethod
    def emphasis(text: str) -> float:
        asks = text.count("?")
        return min(text.count("!"), 4) * 0.292 + (0.0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96)


class AverageScorer:
    """The mean polarity of the words of a text that the lexicon has; an intensifier multiplies the next word, a negation turns it by half."""

    def __init__(self, words: Mapping[str, tuple[float, float]]) -> None:
        self.words = dict(words)

    def __call__(self, text: str) -> float:
        found, strength, turned = [], 1.0, False
        for word in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?]", text.lower()):
            if word in ".!?":
                strength, turned = 1.0, False
            elif is_negation(word) or word == "no":
                turned = True
            elif word in self.words:
                polarity, intensity = self.words[word]
                if polarity == 0.0 and intensity != 1.0:
                    strength *= intensity
                    continue
                value = max(-1.0, min(1.0, polarity * strength))
                found.append(value * -0.5 if turned else value)
                strength, turned = 1.0, False
            else:
                strength = 1.0
        return math.fsum(found) / len(found) if found else 0.0
