"""Clients against stand-ins of their services."""

import json
import pickle

import pytest

from moodspark.operators import clients, providers


def answer_chat(request, timeout):
    asked = json.loads(request.data)
    return json.dumps({"choices": [{"message": {"content": f"{asked['model']}: {asked['messages'][1]['content']} {request.headers.get('Authorization')}"}}]}).encode()


def answer_nothing(request, timeout):
    return b'{"choices": []}'


def answer_search(request, timeout):
    assert "q=Song+Artist" in request.full_url and request.headers["X-key"] == "k"
    hits = [{"by": {"name": "Other"}, "words": "no"}, {"by": {"name": " artist"}, "words": "yes"}, {"by": None}]
    return json.dumps({"found": hits}).encode()


def test_chat(monkeypatch):
    client = pickle.loads(pickle.dumps(clients.ChatClient("http://x", "m", key_variable="TEST_CHAT_KEY", send=answer_chat)))
    with pytest.raises(clients.ProviderError):
        client("hello")
    monkeypatch.setenv("TEST_CHAT_KEY", "secret")
    assert client("hello") == "m: hello Bearer secret"
    with pytest.raises(clients.ProviderError):
        clients.ChatClient("http://x", "m", send=answer_nothing)("hello")


def test_chat_completes_batches(spark):
    prompts = spark.createDataFrame([(0, "1. song_id=a | x")], "batch_id long, prompt string")
    got = providers.complete(prompts, clients.ChatClient("http://x", "m", send=answer_chat), accept=lambda prompt, reply: "song_id=a" in reply, tries=1).collect()
    assert got[0].reply == "m: 1. song_id=a | x None"


def test_search():
    client = clients.SearchClient("http://x", ("found",), ("by", "name"), ("words",), {"X-Key": "k"}, send=answer_search)
    assert pickle.loads(pickle.dumps(client))("Song", "Artist") == "yes"
    assert clients.SearchClient("http://x", ("none",), ("by",), ("words",), {"X-Key": "k"}, send=answer_search)("Song", "Artist") is None


def test_local_model_needs_its_library_and_folder(tmp_path):
    with pytest.raises(clients.ProviderError):
        clients.local_model(str(tmp_path / "none"), ("joy", "anger"))()
