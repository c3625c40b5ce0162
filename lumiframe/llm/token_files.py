"""Token ids in shard files: one zstandard frame a document, a shared dictionary, an offset index.

A shard file is

    magic 8 bytes | width of an id, 1 byte | SHA-256 of the dictionary, 32 bytes | frames
    index: document ids (int64), absent-id marks (uint8), token counts (uint32), frame ends (uint64)
    place of the index (uint64) | number of documents (uint64)

and the dictionary is the file ``dictionary`` beside the shards; empty means none.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder
from .scratch import Scratch, shuffle_partitions

MAGIC = b"LFTOKEN1"
HEAD = len(MAGIC) + 1 + 32
#: The dictionary is trained on about so many documents, drawn by a hash of their ids and texts.
DICTIONARY_DOCUMENTS = 1000
DICTIONARY_BYTES = 32 * 1024
LEVEL = 3
#: Documents of one result batch.
BATCH = 5000


def _open(uri: str):
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system, path


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained dictionary; the samples themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _with_end(path: str, end_id: int, texts: list[str]) -> list[bytes]:
    end = np.array([end_id], dtype=encoder(path).dtype).tobytes()
    return [ids + end for ids in encoder(path).encode(texts)]


def sample_ids(docs: DataFrame, tokenizer: str, end_id: int, documents: int) -> list[bytes]:
    """Serialised ids of about ``documents`` documents, all of them in a small table."""
    n = docs.count()
    share = 1.0 if n <= documents else documents / n
    drawn = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < max(1, round(share * (1 << 20))))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ids": _with_end(tokenizer, end_id, batch["text"].tolist())})
        encoder(tokenizer).settle()

    # The draw is bounded by its share; 1.5 times as many as asked for are far beyond its spread.
    rows = drawn.select("text").mapInPandas(encoded, "ids binary").limit(documents + documents // 2).collect()
    return sorted(bytes(r["ids"]) for r in rows)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, dictionary: bytes) -> DataFrame:
    """(id, n_tokens, frame) of every document."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=LEVEL)  # once a task, not once a document
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        width = encoder(tokenizer).dtype.itemsize
        for batch in batches:
            ids = _with_end(tokenizer, end_id, batch["text"].tolist())
            counts = [len(x) // width for x in ids]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": counts, "frame": [compressor.compress(x) for x in ids]})
        encoder(tokenizer).settle()

    return docs.mapInPandas(encoded, "id bigint, n_tokens bigint, frame binary")


def write_shards(encoded: DataFrame, folder: str, width: int, dictionary: bytes, shards: int) -> DataFrame:
    """One file for each id range, ids ascending; (file, first, n_docs, n_tokens) of each.

    A file's name holds the task attempt: an attempt that is lost or doubled leaves
    a file that no row names.
    """
    mark = hashlib.sha256(dictionary).digest()

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, path = _open(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        keys, absent, counts, ends, at = [], [], [], [], HEAD
        with system.open_output_stream(path) as out:
            out.write(MAGIC + bytes([width]) + mark)
            for batch in itertools.chain([first], batches):
                keys.append(batch["id"].fillna(0).to_numpy(np.int64))
                absent.append(batch["id"].isna().to_numpy(np.uint8))
                counts.append(batch["n_tokens"].to_numpy(np.uint32))
                ends.append(at + batch["frame"].str.len().to_numpy(np.uint64).cumsum())
                at = int(ends[-1][-1])
                out.write(b"".join(batch["frame"]))
            index = [np.concatenate(x) for x in (keys, absent, counts, ends)]
            for column in index:
                out.write(column.tobytes())
            out.write(np.array([at, len(index[0])], dtype="<u8").tobytes())
        head = None if index[1][0] else int(index[0][0])
        row = {"file": [name], "first": [head], "n_docs": [len(index[0])], "n_tokens": [int(index[2].sum(dtype=np.int64))]}
        yield pd.DataFrame(row).astype({"first": "Int64"})

    placed = encoded.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions("id", "frame")
    return placed.mapInPandas(written, "file string, first bigint, n_docs bigint, n_tokens bigint")


def _read_at(handle, place: int, size: int) -> bytes:
    handle.seek(place)
    return handle.read(size)


class Shard:
    """Reader of one shard file: the index first, then only the frames that are asked for."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.handle = system.open_input_file(path)
        head = _read_at(self.handle, 0, HEAD)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        width, mark = head[8], head[9:]
        with system.open_input_file(path.rpartition("/")[0] + "/dictionary") as file:
            data = file.read()
        if hashlib.sha256(data).digest() != mark:
            raise ValueError(f"{uri} was written with another dictionary")
        self.dtype = np.dtype(f"<u{width}")
        self.unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        size = self.handle.size()
        place, n = np.frombuffer(_read_at(self.handle, size - 16, 16), dtype="<u8").tolist()
        index = _read_at(self.handle, place, size - 16 - place)
        self.keys = np.frombuffer(index, "<i8", n)
        self.absent = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<u4", n, 9 * n)
        self.ends = np.frombuffer(index, "<u8", n, 13 * n)

    def frames(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of documents first..last-1, read in one go."""
        start = int(self.ends[first - 1]) if first else HEAD
        data = _read_at(self.handle, start, int(self.ends[last - 1]) - start)
        cuts = [0, *(self.ends[first:last].astype(np.int64) - start).tolist()]
        return [np.frombuffer(self.unzip.decompress(data[a:b]), self.dtype) for a, b in zip(cuts, cuts[1:])]

    def document(self, key: int) -> np.ndarray | None:
        """Ids of one document by its id, with one short read; None when it is absent."""
        present = int(self.absent.sum())  # documents without an id come first
        at = present + int(np.searchsorted(self.keys[present:], key))
        return self.frames(at, at + 1)[0] if at < len(self.keys) and self.keys[at] == key else None


def read_shards(spark: SparkSession, places: list[tuple[str, int]], key: str) -> DataFrame:
    """Rows of each document from the shard files; ``places`` has (file, ids before it)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, base in zip(batch["file"], batch["base"]):
                shard = Shard(uri)
                for at in range(0, len(shard.keys), BATCH):
                    upto = min(at + BATCH, len(shard.keys))
                    ids = shard.frames(at, upto)
                    counts = np.array([len(x) for x in ids], dtype=np.int64)
                    if (counts != shard.counts[at:upto]).any():
                        raise ValueError(f"{uri} does not hold the ids its index names")
                    yield pd.DataFrame(
                        {
                            key: pd.array(shard.keys[at:upto], dtype="Int64").copy(),
                            "start": base + counts.cumsum() - counts,
                            "n_tokens": counts,
                            "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                        }
                    ).assign(**{key: lambda d, a=at, b=upto: d[key].mask(shard.absent[a:b])})
                    base += int(counts.sum())

    files = spark.createDataFrame(places, "file string, base bigint")
    return files.repartition(max(1, len(places))).mapInPandas(
        rows, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def tokenize_to_files(
    df: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    folder: str | None = None,
    shards: int | None = None,
) -> DataFrame:
    """Write the ids of every document to shard files and return what the files hold.

    Returns (key, start, n_tokens, ids_crc32) per document, read back from the
    files: ``start`` counts the ids of all documents before it in ascending key
    order, the end id is part of every document, ``ids_crc32`` is over the ids as
    little-endian 32-bit integers. A null or empty text is the end id alone; null
    keys come first; repeated keys and rows are all written, next to each other;
    an empty table writes only the dictionary; other columns play no part,
    whatever their names. The key must be an integer.

    ``folder`` is a path that all executors reach, by default one below
    ``spark.checkpoint.dir``. Ids are encoded and compressed before the shuffle,
    a shard is written as a stream, and only one row a shard comes to the driver.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = (folder or scratch.path("files")).rstrip("/")
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = train_dictionary(sample_ids(docs, tokenizer, end_id, DICTIONARY_DOCUMENTS))
    system, path = _open(f"{folder}/dictionary")
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(dictionary)
    encoded = scratch.table(encode_documents(docs, tokenizer, end_id, dictionary), "encoded")
    width = encoder(tokenizer).dtype.itemsize
    shards = shards or shuffle_partitions(spark)
    manifest = scratch.table(write_shards(encoded, folder, width, dictionary, shards), "manifest").collect()
    scratch.drop("encoded")
    places, before = [], 0
    for row in sorted(manifest, key=lambda r: (r["first"] is not None, r["first"] or 0, r["file"])):
        places.append((row["file"], before))
        before += row["n_tokens"]
    return read_shards(spark, places, key)
