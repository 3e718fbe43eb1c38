"""Token ids in seekable binary files: independent zstandard frames, checksums and a trailing seek table.

A file is a run of zstandard frames that any zstandard reader can decompress, followed by two skippable frames: a document
index and the seek table. Each data frame holds whole documents; a reader that wants one looks its frame up in the index,
seeks to it and decompresses only that frame. Integers are little-endian.

  data frame      magic ``TLF1``, id width (2 or 4 bytes) u32, documents u32, then for each document
                  doc_id i64, has_doc_id u8, ids u64, and after all of them the ids
  document index  skippable frame 0x184D2A5D: for each data frame documents u32, ids u64, first and last doc_id i64
  seek table      skippable frame 0x184D2A5E: for each data frame compressed size u32, decompressed size u32,
                  low half of the XXH64 of the decompressed data u32; frames u32, descriptor u8 (0x80), 0x8F92EAB1 u32
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import read, scratch_path, text_of

MAGIC, INDEX_MAGIC, SEEK_MAGIC, SEEK_END = b"TLF1", 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_DOC, _INDEX, _SEEK = struct.Struct("<qBQ"), struct.Struct("<IQqq"), struct.Struct("<III")
WRITTEN = "part int, file string, frame int, frame_start long, offset long, compressed long, decompressed long, checksum long, documents long, ids long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    A tokenizer that drops white space and never looks across it gives a text the ids of its pieces between spaces and
    line ends, one after another. Pieces recur, so their ids are remembered, up to ``remembered`` of them. In a text of
    Latin-1 letters, which has one form under NFC, pieces are lower-cased and full stops and commas that end a word are
    pieces of their own; any other text is cut at white space only. A tokenizer that does not treat ``PROBES`` so is given
    every text whole.
    """

    def __init__(self, path: str, remembered: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core; threads would only contend
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.seen = remembered, {}
        # Only a tokenizer whose normalizer lower-cases takes the first way.
        self.lower = self.tokenizer.encode("ABC", add_special_tokens=False).ids == self.tokenizer.encode("abc", add_special_tokens=False).ids
        self.whole = False
        self.whole = any(x != self.ids(t) for t, x in zip(PROBES, self(list(PROBES)), strict=True))
        self.seen.clear()

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """u32 ids of each text."""
        if self.whole:
            return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        seen = self.seen
        if len(seen) > self.remembered:
            seen.clear()
        pieces = [self.pieces(t) for t in texts]
        missing = set().union(*pieces).difference(seen)
        words = [p for p in missing if p.isalpha()]
        # Letters between spaces are one word each, so many are encoded at once and told apart by their word's number.
        found = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ids, number = np.array(found.ids, dtype="<u4"), np.array(found.word_ids, dtype=np.int64)
        ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(ids)) if len(ids) else np.empty(0, dtype=np.int64)
        if len(ends) == len(words):
            plain, start = ids.tobytes(), 0
            for word, end in zip(words, (ends * 4).tolist(), strict=True):
                seen[word] = plain[start:end]
                start = end
            missing = missing.difference(words)
        rest = list(missing)
        for piece, one in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else (), strict=True):
            seen[piece] = np.array(one.ids, dtype="<u4").tobytes()
        return [b"".join(map(seen.__getitem__, p)) for p in pieces]

    def pieces(self, text: str) -> list[str]:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        if not self.lower or "<|" in text or _MARKS_TOGETHER.search(text):
            return text.split(" ")
        return text.lower().replace(". ", " . ").replace(", ", " , ").split(" ")


#: Texts that tell whether ids of pieces are ids of texts: spaces of all kinds and lengths, marks at the ends of words, capitals,
#: letters beyond ASCII and Latin-1, digits and what looks like a special token.
PROBES = (
    "one two", "one  two", " one two ", "one\ttwo\r\n three\n\n", "One, two. Three", "(one). 'two', three's \"four.\"", "one ,two .three", "1,000.50 , 3.14. 12", "ÉCOLE naïve. Straße, ÜBER",
    "日本語 テキスト。 次", "привет, мир. Δέλτα", "a\xa0b\x85c", "<|endoftext|> <s> </s> [INST]", "e\u0301 \u212b ½", "don't stop. I'll, go.", "", " ", "\n",
)


#: A mark before a full stop or comma that ends a piece: the two can be one token, so the text is not cut there.
_MARKS_TOGETHER = re.compile(r"(?:[^\w ]|_)[.,] ")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks that follow each other share it."""
    return Encoder(path)


class ShardWriter:
    """Writes frames to a new file. The file gets its name only when it is complete, so a task that is repeated after a
    lost executor leaves no half-written file under that name."""

    def __init__(self, folder: str, part: int, attempt: int, width: int, frame_bytes: int, level: int = 3):
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(folder)
        self.folder, self.part, self.width, self.frame_bytes = folder, part, width, frame_bytes
        self.name = f"part-{part:06d}-{attempt}.tlf"
        self.files.create_dir(root, recursive=True)
        self.path, self.temporary = f"{root}/{self.name}", f"{root}/.{self.name}.tmp"
        self.out = self.files.open_output_stream(self.temporary)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.offset = self.ids_before = 0
        self.rows, self.index, self.seek = [], [], []
        self.docs, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, ids))
        self.held += len(ids)
        return self.flush() if self.held >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.docs:
            return []
        counts = [len(ids) // 4 for _, ids in self.docs]
        heads = b"".join(_DOC.pack(d or 0, d is not None, n) for (d, _), n in zip(self.docs, counts, strict=True))
        ids = np.frombuffer(b"".join(ids for _, ids in self.docs), dtype="<u4").astype(f"<u{self.width}").tobytes()
        plain = MAGIC + struct.pack("<II", self.width, len(self.docs)) + heads + ids
        packed = self.zstd.compress(plain)
        check = xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF
        self.out.write(packed)
        named = [d for d, _ in self.docs if d is not None]
        self.index.append(_INDEX.pack(len(self.docs), sum(counts), min(named, default=0), max(named, default=-1)))
        self.seek.append(_SEEK.pack(len(packed), len(plain), check))
        row = (self.part, self.name, len(self.seek) - 1, self.ids_before, self.offset, len(packed), len(plain), check, len(self.docs), sum(counts))
        self.offset += len(packed)
        self.ids_before += sum(counts)
        self.docs, self.held = [], 0
        return [row]

    def close(self) -> list[tuple]:
        rows = self.flush()
        index = b"".join(self.index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        seek = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        self.out.close()
        self.files.move(self.temporary, self.path)
        return rows


def slices(texts: pa.Array, most: int = 2_000_000) -> list[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(texts)] if len(texts) else []
    return list(zip(cuts, cuts[1:], strict=False))


def write_tokens(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, frame_bytes: int = 1 << 20) -> DataFrame:
    """Writes ids of every whole text of ``documents`` (doc_id, text) to ``folder``, in ascending doc_id order.

    Returns the manifest, a row for each frame: part (files in order), file, frame, frame_start (ids before it in its
    file), offset, compressed, decompressed, checksum, documents, ids. It is written beside the files as Parquet and
    read from there, so the texts are encoded once. Null texts are empty: they hold the end id alone. Null doc_ids come
    last and are marked. Repeated rows are written as often as they come, in the order of their texts. A frame holds
    whole documents and closes at ``frame_bytes`` of u32 ids; ids take two bytes if the vocabulary allows. An empty
    table gives an empty manifest. Files of failed or repeated attempts may stay; the manifest names those that count.
    """
    spark = documents.sparkSession
    path = tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, writer, end = TaskContext.get(), None, np.uint32(end_id).tobytes()
        names = [x.split()[0] for x in WRITTEN.split(", ")]

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "file" else pa.int32() if n in ("part", "frame") else pa.int64()) for x, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)

        for batch in batches:
            for first, last in slices(batch["text"]):
                if writer is None:
                    encode = encoder(path)
                    width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                    writer = ShardWriter(folder, context.partitionId(), context.taskAttemptId(), width, frame_bytes)
                some = batch.slice(first, last - first)
                for doc_id, ids in zip(some["doc_id"].to_pylist(), encode(some["text"].to_pylist()), strict=True):
                    yield from out(writer.add(doc_id, ids + end))
        if writer:
            yield from out(writer.close())

    rows = documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("last", F.col("doc_id").isNull())
    # Range partitions follow each other, so the files in the order of their partitions are in doc_id order.
    ordered = rows.repartitionByRange("last", "doc_id", F.xxhash64("text")).sortWithinPartitions("last", "doc_id", F.xxhash64("text"))
    ordered.select("doc_id", "text").mapInArrow(write, WRITTEN).write.parquet(f"{folder}/manifest")
    return spark.read.schema(WRITTEN).parquet(f"{folder}/manifest")


def parse_frame(plain: bytes) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a decompressed data frame."""
    if plain[:4] != MAGIC:
        raise ValueError("not a data frame")
    width, n = struct.unpack_from("<II", plain, 4)
    heads = [_DOC.unpack_from(plain, 12 + k * _DOC.size) for k in range(n)]
    at, out = 12 + n * _DOC.size, []
    for doc_id, known, count in heads:
        out.append((doc_id if known else None, np.frombuffer(plain, dtype=f"<u{width}", count=count, offset=at).astype("<u4")))
        at += count * width
    return out


def open_frame(file, offset: int, compressed: int, checksum: int) -> bytes:
    """Seeks to one frame, decompresses it and verifies its checksum."""
    file.seek(offset)
    plain = zstandard.ZstdDecompressor().decompress(file.read(compressed))
    if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
        raise ValueError(f"checksum of the frame at {offset} is wrong")
    return plain


def seek_table(file) -> list[tuple[int, int, int, int]]:
    """(offset, compressed, decompressed, checksum) of each data frame, from the end of an open file."""
    size = file.seek(0, 2)
    file.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_END:
        raise ValueError("no seek table")
    file.seek(size - 9 - frames * _SEEK.size)
    out, offset = [], 0
    for compressed, decompressed, check in _SEEK.iter_unpack(file.read(frames * _SEEK.size)):
        out.append((offset, compressed, decompressed, check))
        offset += compressed
    return out


def read_document(folder: str, file_name: str, doc_id: int) -> list[np.ndarray]:
    """Ids of each document of that doc_id in one file; only frames that may hold it are decompressed."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{root}/{file_name}") as file:
        table = seek_table(file)
        file.seek(sum(x[1] for x in table))
        _, size = struct.unpack("<II", file.read(8))
        ranges = [(low, high) for _, _, low, high in _INDEX.iter_unpack(file.read(size))]
        frames = [open_frame(file, at, packed, check) for (at, packed, _, check), (low, high) in zip(table, ranges, strict=True) if low <= doc_id <= high]
    return [ids for frame in frames for d, ids in parse_frame(frame) if d == doc_id]


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files that ``manifest`` names.

    start counts the ids of all documents before it in the order of files and frames; the totals of the files, a row
    for each, give their offsets. Frames are read in parallel; each is sought, decompressed and verified alone.
    """
    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # a row for each file
    starts, before = [], 0
    for row in totals:
        starts.append((row["part"], before))
        before += row["ids"]
    offsets = spark.createDataFrame(starts, "of_part int, file_start long")
    frames = manifest.join(offsets, F.col("part") == F.col("of_part")).select("file", "offset", "compressed", "checksum", (F.col("file_start") + F.col("frame_start")).alias("start"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{root}/{row['file']}") as file:
                    docs = parse_frame(open_frame(file, row["offset"], row["compressed"], row["checksum"]))
                counts = np.array([len(ids) for _, ids in docs], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in docs], pa.int64()), pa.array(row["start"] + np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(ids.tobytes()) for _, ids in docs], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = frames.repartition(max(1, min(10_000, manifest.count() // 16)), "file", "offset")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), folder), folder)
