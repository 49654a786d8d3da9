"""Checkpoints of stages: a small JSON file beside the output, written when the output is complete.

A checkpoint names what the stage was made from: the configuration, the version of this package, the files of its inputs
and the very outputs of the stages before it. So a changed input or a stage that ran again makes all that follow from it
stale, and nothing else.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import SparkSession

import moodspark
from moodspark.sources.files import listing, read_text, write_text


def path_of(output: str) -> str:
    return f"{output.rstrip('/')}.done.json"


def read(spark: SparkSession, output: str) -> dict:
    """The checkpoint of an output, empty where it is absent or damaged."""
    raw = read_text(spark, path_of(output))
    try:
        found = json.loads(raw) if raw else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) else {}


def state_of(spark: SparkSession, path: str) -> str:
    """What stands at a path: the name of the run that made a stage's output, else a digest of the files' names, sizes and times."""
    if made := read(spark, path).get("made"):
        return str(made)
    found = hashlib.sha256()
    for name, size, time in listing(spark, path):
        found.update(f"{name}\t{size}\t{time}\n".encode())
    return found.hexdigest()


def fingerprint(spark: SparkSession, stage: str, digest: str, inputs: Mapping[str, str | None]) -> str:
    """A digest of all that a stage's output follows from; an input that isn't used is None."""
    facts = [stage, digest, moodspark.__version__, sorted((name, path and state_of(spark, path)) for name, path in inputs.items())]
    return hashlib.sha256(json.dumps(facts).encode()).hexdigest()


def is_current(spark: SparkSession, output: str, digest: str, made_from: str | None = None) -> bool:
    """Whether the stage has run with this configuration and, if a fingerprint is given, from these inputs; absent, damaged
    and stale checkpoints say no."""
    found = read(spark, output)
    return found.get("config_hash") == digest and (made_from is None or found.get("made_from") == made_from)


def mark(spark: SparkSession, output: str, stage: str, digest: str, rows: int | None = None, made_from: str | None = None) -> None:
    facts = {"stage": stage, "config_hash": digest, "completed_at": datetime.now(UTC).isoformat(timespec="seconds"), "rows": rows, "made_from": made_from, "made": uuid.uuid4().hex}
    write_text(spark, path_of(output), json.dumps(facts, sort_keys=True))
