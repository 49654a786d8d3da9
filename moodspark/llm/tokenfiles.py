"""Token ids of documents in binary shards: a shared zstandard dictionary, a frame for each document, an offset index.

``write_token_files`` encodes whole texts, ends each with an id, and lays them out in ascending id order. A folder holds

* ``shard-*.ids``: ``MAGIC``, one byte with the width of an id, the SHA-256 of the dictionary, then a zstandard frame
  for each document, compressed on its own;
* ``dictionary-<sha256>``: what all frames are compressed with, trained on the serialized id arrays of short documents;
* ``index``: Parquet, a row for each document with its shard, offset, length and place among the shard's ids.

``read_token_files`` reads whole shards by the index, ``fetch`` only the frames of the wanted documents. Both refuse a
shard whose header names another dictionary than the one at hand. Files of attempts that failed stay unnamed by the
index, which Spark commits, so a lost executor leaves nothing half-written that a reader would see.

Only compressed frames are shuffled: a row's shard follows from quantiles of the ids, and ``repartitionById`` deals
frames to shards. The quantiles decide balance only; an id that fills several shards is dealt over them by a hash of its
text, in whose order its rows stand. Rows that agree in id and text stand together in one shard.

Words are encoded once and remembered, as the tokenizer lets no token cross white space: what stands between ASCII white
space is encoded by the library on its own, and so are ASCII marks that close a word. ``MOST_WORDS`` bounds the memory;
a forgotten word is encoded again.

Null and empty texts have the end id alone. Rows without an id come first, their id stays null. Rows that repeat an id
are documents of their own, in the order of their texts' hashes. Of the given columns only the id and the text are used,
so no extra column can clash. A very long text is encoded and compressed whole: memory follows its length. An empty
table gives an empty index and no shards.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodspark.llm.common import BATCH_BYTES, bound_batches, cached, checked, grown, scratch, table
from moodspark.llm.warc import open_store

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
MAGIC = b"tokids1\n"
HEADER_BYTES = len(MAGIC) + 1 + 32
LEVEL = 6
#: Bytes of text for one shard; frames take about a third.
SHARD_BYTES = 256 << 20
#: Documents the dictionary is trained on at most, and the bytes of text one of them has at most: it serves short documents.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 2000, 8192
DICTIONARY_BYTES = 64 << 10
#: Fewer samples than this train no dictionary; their ids then are the dictionary as they stand.
LEAST_SAMPLES = 50
#: Words that a process remembers, and the code points of the longest of them.
MOST_WORDS, LONGEST_WORD = 500_000, 64
#: ASCII marks without the apostrophe, which may begin a contraction.
CLOSING = '.,;:!?#$%&*()[]|-_"'
#: The make of tokenizer whose tokens never cross white space; fixed values of the file.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Bytes of a shard that a reader asks for at once.
READ_BYTES = 8 << 20
INDEX = "doc_id long, shard int, file string, offset long, length long, first long, n_tokens long"


class Words(dict):
    """Packed little-endian ids of words, made by the library when a word is first met.

    Only a tokenizer of the known make works by words; any other one encodes texts as they stand.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        made = json.loads(self.library.to_str())
        self.by_words = (made["normalizer"], made["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self.parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}").tobytes()

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(CLOSING)
        # Between what is a letter or digit in lower case and such marks the pattern always ends a match.
        if stem and len(stem) < len(word) and ord(stem[-1]) < 0x250 and stem[-1].lower().isalnum():
            made = self.part(stem) + self.part(word[len(stem) :])
        else:
            made = self.part(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = made
        return made

    def part(self, text: str) -> bytes:
        plain = text.isascii()
        if plain:
            text = text.lower()
        made = self.parts.get(text)
        if made is None:
            if plain and text.isalpha():  # one match that normalising leaves as it is
                made = np.array([token.id for token in self.library.model.tokenize(text)], dtype=f"<u{self.width}").tobytes()
            else:
                made = self.encode(text)
            if len(text) <= LONGEST_WORD:
                if len(self.parts) >= MOST_WORDS:
                    self.parts.clear()
                self.parts[text] = made
        return made

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text, without an end id."""
        if not text:
            return b""
        if not self.by_words:
            return self.encode(text)
        for blank in "\t\n\r\x0b\x0c":
            if blank in text:
                text = text.replace(blank, " ")
        return b"".join(map(self.__getitem__, filter(None, text.split(" "))))


def words_of(path: str) -> Words:
    return cached(("words", path), lambda: Words(path))


def widened(packed: bytes, width: int) -> bytes:
    """Packed ids as little-endian unsigned 32-bit integers."""
    return packed if width == 4 else np.frombuffer(packed, dtype=f"<u{width}").astype("<u4").tobytes()


def train_dictionary(packed: list[bytes]) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES`` from serialized id arrays; empty without any."""
    raw = b"".join(packed)[:DICTIONARY_BYTES]
    if len(packed) < LEAST_SAMPLES:
        return raw
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, packed, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little that repeats
        return raw


def sample_texts(docs: DataFrame, text: str, n_short: int) -> list[str]:
    """Up to ``SAMPLE_DOCUMENTS`` distinct short texts by hash, the same ones for the same table.

    The hash lets about three times as many through before copies fold, so the sort at the end is a bounded one.
    """
    share = min(1.0, 3 * SAMPLE_DOCUMENTS / max(1, n_short))
    key = F.xxhash64(text)
    short = docs.where(F.octet_length(text).between(1, SAMPLE_BYTES) & (F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))))
    return [r[0] for r in short.select(F.col(text).alias("t")).distinct().orderBy(F.xxhash64("t"), "t").limit(SAMPLE_DOCUMENTS).collect()]


def dictionary_path(root: str, digest: str) -> str:
    return f"{root}/dictionary-{digest}"


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str = DEFAULT_TOKENIZER, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the token files of ``docs`` to ``folder``, which driver and executors share. Two sums, a sample and one pass over the texts."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = F.octet_length("text")
    total, n_short = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count_if(size.between(1, SAMPLE_BYTES))).first()
    shards = max(1, -(-total // shard_bytes), min(spark.sparkContext.defaultParallelism, total // (1 << 20)))
    fractions = [i / shards for i in range(1, shards)]
    bounds = docs.agg(F.percentile_approx("doc_id", fractions, max(10_000, 20 * shards))).first()[0] if fractions else []
    bounds = np.array(bounds or [], dtype=np.int64)
    words = words_of(path)
    width = words.width
    dictionary = train_dictionary([words.packed(t) for t in sample_texts(docs, "text", n_short)])
    digest = hashlib.sha256(dictionary).hexdigest()
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(dictionary_path(root, digest), compression=None) as out:
        out.write(dictionary)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        end = end_id.to_bytes(width, "little")
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)  # else every frame digests the dictionary anew
        pressed = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=False, write_dict_id=False)
        for batch in batches:
            ids = batch.column(0)
            plain = [words.packed(t) + end for t in batch.column(1).to_pylist()]
            given = ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = batch.column(2).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, given, "left"), np.searchsorted(bounds, given, "right")
            # The hash, shifted to 0..1, deals an id that is a bound over the shards it may stand in, in hash order.
            place = low + np.minimum((order.astype(np.float64) / 2.0**64 + 0.5) * (high - low + 1), high - low).astype(np.int64)
            shard = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, place).astype(np.int32)
            counts = pa.array([len(p) // width for p in plain], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(shard), counts, pa.array([pressed.compress(p) for p in plain], pa.binary())], names=["doc_id", "text_hash", "shard", "n_tokens", "frame"])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        sink, name, offset, first = None, None, HEADER_BYTES, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                name = f"shard-{batch.column(1)[0].as_py():06d}-{uuid.uuid4().hex}.ids"
                sink = store.open_output_stream(f"{root}/{name}", compression=None)
                sink.write(MAGIC + bytes([width]) + bytes.fromhex(digest))
            frames = batch.column(3).to_pylist()
            sink.write(b"".join(frames))
            lengths = np.array([len(f) for f in frames], dtype=np.int64)
            counts = batch.column(2).to_numpy()
            starts = offset + np.cumsum(lengths) - lengths
            firsts = first + np.cumsum(counts) - counts
            offset, first = int(starts[-1] + lengths[-1]), int(firsts[-1] + counts[-1])
            made = [batch.column(0), batch.column(1), pa.array([name] * len(frames)), pa.array(starts), pa.array(lengths), pa.array(firsts), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in INDEX.split(", ")])
        if sink is not None:
            sink.close()

    frames = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(press, "doc_id long, text_hash long, shard int, n_tokens long, frame binary")
    laid = frames.repartitionById(shards, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash")
    laid.select("doc_id", "shard", "n_tokens", "frame").mapInArrow(lay_out, INDEX).write.parquet(f"{folder}/index")


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index: a row a document, ``start`` counting the ids of all documents before it.

    What stands before a shard is summed over a row for each shard.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return index.join(checked(before), "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "file", "offset", "length")


class Shards:
    """Frames of the shards of a folder, with the dictionaries their headers name."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = open_store(folder)
        self.readers: dict[bytes, zstandard.ZstdDecompressor] = {}
        self.name, self.file, self.reader, self.width = None, None, None, 0

    def open(self, name: str) -> None:
        if name == self.name:
            return
        if self.file is not None:
            self.file.close()
        self.file, self.name = self.store.open_input_file(f"{self.root}/{name}"), name
        head = self.file.read_at(HEADER_BYTES, 0)
        if not head.startswith(MAGIC):
            raise ValueError(f"{name} is no token file")
        self.width, digest = head[len(MAGIC)], head[len(MAGIC) + 1 :]
        if digest not in self.readers:
            with self.store.open_input_stream(dictionary_path(self.root, digest.hex()), compression=None) as source:
                dictionary = source.read()
            if hashlib.sha256(dictionary).digest() != digest:
                raise ValueError(f"the dictionary of {name} is not the one that it was written with")
            self.readers[digest] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.reader = self.readers[digest]

    def documents(self, names: list[str], offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, bytes]]:
        """Places in the given lists and unsigned 32-bit ids; neighbouring frames are read at once."""
        order = sorted(range(len(names)), key=lambda i: (names[i], offsets[i]))
        at = 0
        while at < len(order):
            end, start = at + 1, offsets[order[at]]
            stop = start + lengths[order[at]]
            while end < len(order) and names[order[end]] == names[order[at]] and offsets[order[end]] <= stop <= start + READ_BYTES:
                stop = max(stop, offsets[order[end]] + lengths[order[end]])
                end += 1
            self.open(names[order[at]])
            data = memoryview(self.file.read_at(stop - start, start))
            for i in order[at:end]:
                frame = data[offsets[i] - start : offsets[i] - start + lengths[i]]
                yield i, widened(self.reader.decompress(frame), self.width)
            at = end


def read_frames(index: DataFrame, folder: str, ids: bool) -> DataFrame:
    """The documents of index rows: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``token_ids`` (packed, 4 bytes an id)."""
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("token_ids", pa.binary())] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder)
        for batch in batches:
            keys, starts, *places = (c.to_pylist() for c in batch.columns)
            rows, held = [], 0
            for i, packed in shards.documents(*places):
                rows.append((keys[i], starts[i], len(packed) // 4, zlib.crc32(packed), packed)[: len(kinds)])
                held += len(packed) if ids else 40
                if held > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", token_ids binary" if ids else "")
    return index.select("doc_id", "start", "file", "offset", "length").mapInArrow(run, schema)


def read_token_files(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Every document of the token files in ``folder``."""
    return read_frames(index_of(spark, folder), folder, ids)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose ids stand in ``wanted``: only their frames are read."""
    keys = wanted.select(F.col(f"`{key}`").cast("long").alias("doc_id")).distinct()
    return read_frames(index_of(spark, folder).join(grown(keys), "doc_id", "left_semi"), folder, True)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every whole text of ``documents`` in ascending order and read the files back."""
    folder = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, ids=False)
