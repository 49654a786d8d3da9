"""Clients of services and of local models, in the shapes that providers take.

Each is a small object that pickles, so that it travels to the executors; connections and models are made there.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from moodspark.operators.providers import Provider


class ProviderError(RuntimeError):
    """A service or a model can't be used."""


def fetch(request: urllib.request.Request, timeout: float) -> bytes:
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def at_path(value: object, path: Sequence[str | int]) -> object:
    """The part of a JSON value at a path of keys and places; None where there is none."""
    for step in path:
        try:
            value = value[step]
        except (KeyError, IndexError, TypeError):
            return None
    return value


@dataclass(frozen=True)
class ChatClient:
    """A prompt to a chat completion service, its reply as text.

    The key is read from the environment variable ``key_variable`` where the call is made. Retries are the caller's.
    """

    url: str
    model: str
    instructions: str = "Answer with JSON only."
    key_variable: str | None = None
    temperature: float = 0.0
    timeout: float = 60.0
    reply: tuple[str | int, ...] = ("choices", 0, "message", "content")
    send: Callable[[urllib.request.Request, float], bytes] = fetch

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": self.instructions}, {"role": "user", "content": prompt}]}
        heads = {"Content-Type": "application/json"}
        if self.key_variable:
            key = os.environ.get(self.key_variable)
            if not key:
                raise ProviderError(f"the environment has no {self.key_variable}")
            heads["Authorization"] = f"Bearer {key}"
        answer = json.loads(self.send(urllib.request.Request(self.url, json.dumps(body).encode(), heads), self.timeout))
        found = at_path(answer, self.reply)
        if not isinstance(found, str):
            raise ProviderError(f"{self.url}: the answer has no text")
        return found


@dataclass(frozen=True)
class SearchClient:
    """Title and artist to a text, from a service that is asked by ``GET url?q=...`` and answers with JSON.

    ``hits`` is the path to the list of hits, ``artist`` and ``text`` paths in a hit. The first hit of the artist
    counts; None if there is none.
    """

    url: str
    hits: tuple[str | int, ...]
    artist: tuple[str | int, ...]
    text: tuple[str | int, ...]
    headers: Mapping[str, str] = field(default_factory=dict)
    timeout: float = 30.0
    send: Callable[[urllib.request.Request, float], bytes] = fetch

    def __call__(self, title: str, artist: str) -> str | None:
        asked = urllib.parse.urlencode({"q": f"{title} {artist}"})
        answer = json.loads(self.send(urllib.request.Request(f"{self.url}?{asked}", headers=dict(self.headers)), self.timeout))
        for hit in at_path(answer, self.hits) or []:
            name, found = at_path(hit, self.artist), at_path(hit, self.text)
            if isinstance(found, str) and found.strip() and str(name or "").casefold().strip() == artist.casefold().strip():
                return found
        return None


def local_model(path: str, labels: Sequence[str], zero_shot: bool = False, chars: int = 2_000) -> Callable[[], Provider]:
    """A factory of providers over a text classifier in a local folder; it needs the transformers library.

    ``zero_shot``: the labels are hypotheses that are scored apart from each other. Texts are given up to ``chars``
    characters, as such models read a few hundred tokens.
    """
    return partial(_load, path, tuple(labels), zero_shot, chars)


def _load(path: str, labels: tuple[str, ...], zero_shot: bool, chars: int) -> Provider:
    try:
        from transformers import pipeline
    except ImportError as error:
        raise ProviderError("local models need the transformers library") from error
    if not os.path.isdir(path):
        raise ProviderError(f"no model folder at {path}")
    if zero_shot:
        model = pipeline("zero-shot-classification", model=path)
        answers = lambda texts: [dict(zip(a["labels"], a["scores"], strict=True)) for a in model([t[:chars] for t in texts], list(labels), multi_label=True)]
    else:
        model = pipeline("text-classification", model=path, top_k=None)
        answers = lambda texts: [{a["label"]: a["score"] for a in found} for found in model([t[:chars] for t in texts], truncation=True)]
    return lambda texts: [{label: float(scores.get(label, 0.0)) for label in labels} for scores in answers(texts)]
