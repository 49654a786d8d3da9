"""Token files against the library on whole texts."""

import hashlib
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodspark.llm import tokenfiles
from moodspark.llm.common import scratch

from .conftest import words


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(tokenfiles.DEFAULT_TOKENIZER)
    made.encode_special_tokens = True
    return made


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    "Don't STOP's. it's... 'quoted' x'- (a) [b] 12.5% v2.0, A|B _c_ \"d\"",
    "Σίσυφος ΟΔΥΣΣΕΥΣ. ΣΑΣ, İstanbul ǅ ß",
    "é. é,x ́ a ́b ñ!",
    "a\x1cb c d\x0be\x0cf\rg　h",
    "漢字。かな, ½² ª. Ⅷ! ١٢.",
    "<|endoftext|> x<|startoftext|>. <|endoftext|>,",
    "\U0001f600. \U0001f600\U0001f600!! a�.",
    "x" * 300 + ". " + "y" * 70,
    "'s 't're. ''s. 'll, d'",
]


def test_words_are_encoded_as_whole_texts_are(library, monkeypatch):
    made = tokenfiles.Words(tokenfiles.DEFAULT_TOKENIZER)
    assert made.by_words
    rng = np.random.default_rng(5)
    pool = list(" \t\n.,'sStTé́AaZz09ß漢!?-|_\"#%$(ΣσİX")
    texts = [*ODD, *("".join(rng.choice(pool, 60)) for _ in range(400))]
    for text in texts:
        assert np.frombuffer(made.packed(text), "<u2").tolist() == ids_of(library, text)[:-1], text
    monkeypatch.setattr(tokenfiles, "MOST_WORDS", 20)
    made = tokenfiles.Words(tokenfiles.DEFAULT_TOKENIZER)
    for text in texts:
        assert np.frombuffer(made.packed(text), "<u2").tolist() == ids_of(library, text)[:-1]
    assert len(made) <= 20 and len(made.parts) <= 20
    made.by_words = False
    assert np.frombuffer(made.packed(ODD[0]), "<u2").tolist() == ids_of(library, ODD[0])[:-1]


def expected(library, rows):
    start, out = 0, []
    for key, text in rows:
        ids = ids_of(library, text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_come_back_in_order(spark, documents, library, hard_texts):
    texts = [*hard_texts, *ODD, *(" ".join(words(i, 40)) for i in range(80))]
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)]
    folder = scratch(spark, "tokens")
    docs = documents(rows, 5).withColumn("shard", F.lit("own")).withColumn("file", F.lit(1))
    tokenfiles.write_token_files(docs, folder, shard_bytes=20_000)
    index = spark.read.parquet(f"{folder}/index")
    assert index.select("file").distinct().count() > 5
    got = tokenfiles.read_token_files(spark, folder).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected(library, rows)
    assert all(np.frombuffer(r.token_ids, "<u4").tolist() == ids_of(library, t) for r, (_, t) in zip(got, rows, strict=True))
    some = tokenfiles.fetch(spark, folder, spark.createDataFrame([(6,), (13,), (13,), (1000,)], "doc_id long"))
    found = {r.doc_id: r for r in some.collect()}
    assert sorted(found) == [6, 13]
    assert np.frombuffer(found[13].token_ids, "<u4").tolist() == ids_of(library, texts[9])
    # Every frame opens alone, with the dictionary that the header names.
    row = index.where("doc_id = 13").first()
    store, root = tokenfiles.open_store(folder)
    data = store.open_input_file(f"{root}/{row.file}").read()
    digest = data[len(tokenfiles.MAGIC) + 1 : tokenfiles.HEADER_BYTES]
    dictionary = store.open_input_file(tokenfiles.dictionary_path(root, digest.hex())).read()
    assert hashlib.sha256(dictionary).digest() == digest
    frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(data[row.offset : row.offset + row.length])
    assert np.frombuffer(frame, "<u2").tolist() == ids_of(library, texts[9])


def test_repeated_ids_fill_several_shards(spark, documents, library):
    texts = [" ".join(words(i, 60)) for i in range(120)]
    rows = [(None, "no id"), (None, None)] + [(5 if i % 3 else 1000 + i, t) for i, t in enumerate(texts)] + [(5, texts[1])] * 3
    folder = scratch(spark, "tokens")
    tokenfiles.write_token_files(documents(rows, 4), folder, shard_bytes=3000)
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    got = tokenfiles.read_token_files(spark, folder, ids=False).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected(library, order)
    assert spark.read.parquet(f"{folder}/index").where("doc_id = 5").select("file").distinct().count() > 2


def test_no_documents(spark, documents):
    folder = scratch(spark, "tokens")
    tokenfiles.write_token_files(documents([]), folder)
    assert tokenfiles.read_token_files(spark, folder).collect() == []
    assert tokenfiles.fetch(spark, folder, spark.createDataFrame([(1,)], "doc_id long")).collect() == []


def test_other_dictionaries_are_refused(spark, documents):
    folder = scratch(spark, "tokens")
    tokenfiles.write_token_files(documents(["one", "two"]), folder)
    store, root = tokenfiles.open_store(folder)
    [name] = [f.path for f in store.get_file_info(tokenfiles.pa.fs.FileSelector(root)) if "dictionary-" in f.path]
    with store.open_output_stream(name) as out:
        out.write(b"another")
    with pytest.raises(Exception, match="dictionary of"):
        tokenfiles.read_token_files(spark, folder).collect()


def test_dictionary_of_many_samples():
    samples = [np.array([(i * k) % 500 for i in range(80)], "<u2").tobytes() for k in range(1, 400)]
    made = tokenfiles.train_dictionary(samples)
    assert 0 < len(made) <= tokenfiles.DICTIONARY_BYTES
    assert tokenfiles.train_dictionary([]) == b"" and tokenfiles.train_dictionary([b"ab"]) == b"ab"


def test_query_over_all_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.op12_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got == expected(library, sorted(docs.items()))
