"""Model stages behind providers: offline scorers here, others plug in with the same shape.

A provider is a function from a list of texts to a list of results; it is made once a worker by a
factory. Arrow batches carry the texts; the batch size is Spark's.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.functions.scores import ensemble_score
from moodspark.functions.text import bound_batches

# Fixed value: the normaliser of the published lexicon method (x / sqrt(x^2 + 15)).
ALPHA = 15
POSITIVE = ("love", "happy", "joy", "good", "great", "sweet", "smile", "bright", "beautiful", "win", "free", "hope", "dance", "sunshine", "heaven")
NEGATIVE = ("hate", "sad", "cry", "bad", "lonely", "pain", "hurt", "dark", "cold", "lose", "tears", "broken", "fear", "dead", "hell")

Provider = Callable[[list[str]], list]


#: The words of both lists, looked for only where one of their first letters stands.
LISTED = rf"(?=[{''.join(sorted({w[0] for w in POSITIVE + NEGATIVE}))}])(?<![a-z])(?:{'|'.join(POSITIVE + NEGATIVE)})(?![a-z])"


def from_hits(text: str | Column, score: Callable[[Column, Column], Column]) -> Column:
    """A score of the numbers of good and bad words, null for null: one pass over a text, however often they are used."""
    among = lambda found, words: F.size(F.filter(found, lambda w: w.isin(*words))).cast("double")
    found = F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(LISTED), F.lit(0))
    return F.get(F.transform(F.array(found), lambda f: F.when(f.isNotNull(), score(among(f, POSITIVE), among(f, NEGATIVE)))), F.lit(0))


def lexicon_balance(good: Column, bad: Column, alpha: float = ALPHA) -> Column:
    x = (good - bad) * 2
    return F.round(x / F.sqrt(x * x + alpha), 4)


def polarity_balance(good: Column, bad: Column) -> Column:
    return F.when(good + bad == 0, 0.0).otherwise((good - bad) / (good + bad))


def lexicon_score(text: str | Column, alpha: float = ALPHA) -> Column:
    """A small lexicon's balance in -1..1, with built-in functions only."""
    return from_hits(text, lambda good, bad: lexicon_balance(good, bad, alpha))


def polarity_score(text: str | Column) -> Column:
    """The second scorer: the balance of hits among all hits, 0 for none."""
    return from_hits(text, polarity_balance)


def listed_score(text: str | Column) -> Column:
    """Both scorers weighted."""
    return from_hits(text, lambda good, bad: ensemble_score(lexicon_balance(good, bad), polarity_balance(good, bad)))


def hashed_labels(labels: Sequence[str], independent: bool = False) -> Callable[[], Provider]:
    """A deterministic stand-in for a classifier: scores from a digest of the text, summing to one unless independent.

    Scores are not rounded: digests that differ give scores that differ, so rounding ties no two labels.
    """

    def factory() -> Provider:
        def score(texts: list[str]) -> list[dict[str, float]]:
            out = []
            for text in texts:
                raw = {label: int(hashlib.md5(f"{label}|{text}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for label in labels}
                total = 1.0 if independent else math.fsum(raw.values())
                out.append({label: v / total for label, v in raw.items()})
            return out

        return score

    return factory


def classify(text: str | Column, labels: Sequence[str], factory: Callable[[], Provider], batch: int = 16) -> Column:
    """A map of all labels to scores; the provider is made once for each worker's iterator."""
    names = list(labels)
    bound_batches()

    @F.pandas_udf("map<string,double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = factory()
        for part in parts:
            texts = [" " if v is None or not str(v).strip() else v for v in part]
            found = [s for at in range(0, len(texts), batch) for s in provider(texts[at : at + batch])]
            yield pd.Series([{n: float(s.get(n, 0.0)) for n in names} for s in found])

    return run(F.col(text) if isinstance(text, str) else text)


FALLBACK = ("unclassified", None, None)


def prompt_lines(df: DataFrame, batch: str, order: Sequence[str]) -> DataFrame:
    """One prompt per batch: numbered lines of id, title, artist, cohort, themes and tone."""
    line = F.format_string('song_id=%s | "%s" by %s (%s) | themes: %s | emotion: %s', *(F.coalesce(F.col(c), F.lit("")) for c in ("song_id", "song_title", "artist", "decade", "themes", "emotional_tone")))
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    numbered = F.transform(listed, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["line"]))
    return df.groupBy(batch).agg(F.array_join(numbered, "\n").alias("prompt"))


def complete(prompts: DataFrame, provider: Callable[[str], str], accept: Callable[[str, str], bool] = None, tries: int = 3, pause: float = 2.0, batch: str = "batch_id", between: float = 0.0) -> DataFrame:
    """Ask a chat provider once per batch, again while the reply is not accepted; null if it never is. Providers must be idempotent.

    ``between``: seconds that a task waits after each batch.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies = []
            for prompt in part["prompt"]:
                reply = None
                for attempt in range(1, tries + 1):
                    try:
                        text = provider(prompt)
                        if (accept or accepts_all)(prompt, text):
                            reply = text
                            break
                    except Exception:  # noqa: BLE001 - any failure of the provider counts as a failed try
                        pass
                    if attempt < tries:
                        time.sleep(pause * attempt)
                replies.append(reply)
                time.sleep(between)
            yield pd.DataFrame({batch: part[batch], "reply": replies})

    return prompts.select(batch, "prompt").mapInPandas(run, f"{batch} long, reply string")


def accepts_all(prompt: str, reply: str) -> bool:
    """Whether a reply is JSON with a list of records that has every id of its prompt."""
    try:
        value = json.loads(reply)
    except (TypeError, ValueError):
        return False
    if isinstance(value, dict):
        value = next(iter(value.values())) if len(value) == 1 else None
    if not isinstance(value, list):
        return False
    found = {str(r.get("song_id", "")).strip() for r in value if isinstance(r, dict)}
    return set(re.findall(r"song_id=(\S+)", prompt)) <= found


def without_provider(df: DataFrame) -> DataFrame:
    """Every row unclassified: what a run without a provider gives, and the fallback of a failed batch."""
    return df.withColumns({"jung_stage": F.lit(FALLBACK[0]), "psychological_theme": F.lit(None).cast("string"), "development_score": F.lit(None).cast("long")})
