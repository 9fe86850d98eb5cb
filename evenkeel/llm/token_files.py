"""Token ids in binary files of independent zstandard frames with a seek table.

A file is a run of zstandard frames, one per document, each with its own checksum; then a skippable frame
with the document ids; then the seek table of the public seekable format: for each frame its
compressed and plain size and a checksum of the plain bytes, and a footer that says how many there are.
Any zstandard reader can read the file through; a reader of single documents takes the
footer, the table and then only the frames asked for. Ids take two bytes where the vocabulary allows, else four.

Documents are spread over files by ranges of ids, so that files in order hold ascending ids.

Defined results: a null text is an empty document; null ids come first; repeated rows are written each, those of
equal id in the order of a hash of their texts; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.encode import encoder
from evenkeel.llm.files import Whole, place
from evenkeel.llm.frames import id_and_text, map_batches
from evenkeel.llm.words import blocks
from evenkeel.session import scratch_path

#: Fixed values of the public format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
_CHECKED = 0x80
_NO_ID = -(2**63)
_READ = 4_000_000


def _frame(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class TokenFile:
    """A file open for reading; only what is asked for is decompressed."""

    def __init__(self, uri: str):
        files, path = place(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or not flags & _CHECKED:
            raise ValueError(f"{uri} has no checked seek table")
        table = self.file.read_at(12 * n, end - 9 - 12 * n)
        rows = np.frombuffer(table, "<u4").reshape(n, 3)
        self.sizes, self.plain, self.sums = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2]
        # The last two entries are the skippable frame of ids and nothing else follows before the table.
        self.begins = np.cumsum(self.sizes) - self.sizes
        k = n - 1
        head = self.file.read_at(int(self.sizes[k]), int(self.begins[k]))
        if struct.unpack("<I", head[:4])[0] != SKIPPABLE_IDS:
            raise ValueError(f"{uri} has no table of ids")
        self.width = head[8]
        self.ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(head[9:]), "<i8")
        self.unpack = zstandard.ZstdDecompressor()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _tokens(self, k: int, data: bytes) -> np.ndarray:
        plain = self.unpack.decompress(data, max_output_size=int(self.plain[k]))
        if len(plain) != self.plain[k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"document {k} is damaged")
        return np.frombuffer(plain, f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self._tokens(k, self.file.read_at(int(self.sizes[k]), int(self.begins[k])))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, read in large pieces."""
        k, n = 0, len(self.ids)
        while k < n:
            m = max(k + 1, int(np.searchsorted(self.begins[:n], self.begins[k] + _READ)))
            begin = int(self.begins[k])
            data = memoryview(self.file.read_at(int(self.begins[m - 1] + self.sizes[m - 1]) - begin, begin))
            for i in range(k, m):
                at = int(self.begins[i]) - begin
                yield (None if self.ids[i] == _NO_ID else int(self.ids[i])), self._tokens(i, data[at : at + int(self.sizes[i])])
            k = m


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write (doc_id, text) to files below path; (file, documents, tokens) of each, in order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h")
    spread = spread.sortWithinPartitions("doc_id", "h").drop("h")

    def store(batches):
        name, enc = f"{path}/part-{TaskContext.get().partitionId():06d}.zst", encoder(tokenizer)
        width = 2 if enc.size <= 1 << 16 else 4
        packer = zstandard.ZstdCompressor(level=1, write_checksum=True)
        end, ids, table, tokens = struct.pack("<I", end_id), [], bytearray(), 0
        with Whole(name) as out:
            for b in batches:
                own, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for part in blocks(texts):
                    for doc, data in zip(own[part], enc.encode(texts[part])):
                        plain = np.frombuffer(data + end, "<u4").astype(f"<u{width}").tobytes()
                        packed = packer.compress(plain)
                        out.write(packed)
                        table += struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
                        ids.append(_NO_ID if doc is None else doc)
                        tokens += len(plain) // width
            packed = zstandard.ZstdCompressor(level=3).compress(np.array(ids, "<i8").tobytes())
            last = _frame(SKIPPABLE_IDS, bytes([width]) + packed)
            table += struct.pack("<III", len(last), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
            out.write(last)
            out.write(_frame(SKIPPABLE_TABLE, bytes(table) + struct.pack("<IBI", len(table) // 12, _CHECKED, SEEKABLE)))
        yield [[name], [len(ids)], [tokens]]

    rows = map_batches(spread, store, "file string, documents bigint, tokens bigint").collect()
    # One row per file, not per document.
    rows = sorted((r["file"], r["documents"], r["tokens"]) for r in rows if r["documents"])
    return docs.sparkSession.createDataFrame(rows, "file string, documents bigint, tokens bigint")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, frame) of every document of the files, read back from them.

    start counts the ids of all documents before it, over all files in the order of their names.
    """
    rows, start, spark = sorted(files.collect()), 0, files.sparkSession
    begins = []
    for r in rows:
        begins.append((r["file"], start))
        start += r["tokens"]
    listed = spark.createDataFrame(begins, "file string, begin bigint").repartition(max(1, len(begins)), "file")

    def load(batches):
        for b in batches:
            for r in b.to_pylist():
                at, out = r["begin"], ([], [], [], [], [], [])
                with TokenFile(r["file"]) as f:
                    for k, (doc, ids) in enumerate(f.documents()):
                        for column, x in zip(out, (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), r["file"], k)):
                            column.append(x)
                        at += len(ids)
                yield list(out)

    return map_batches(listed, load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string, frame int")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents to files in the shared folder and read them back."""
    return read(write(id_and_text(docs), scratch_path(docs.sparkSession, "tokens"), tokenizer, end_id))
