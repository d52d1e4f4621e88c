"""Token-id files with shuffled bit planes, and the encoder that fills them.

File format (all numbers little-endian):

    header   8 bytes "TOKPLAN1"; u32 ids in a full block; u32 blocks; u32 documents; u64 ids; u64 bytes of the index
    index    zstandard frame of the chunk index: u8 1 for bit planes, 0 for byte planes; for each block u64 place of its first byte after the index,
             u32 ids, u8 planes, and for each plane u32 bytes; then for each document u32 ids
    planes   for each block, for each of its planes, one zstandard frame

A block holds up to BLOCK ids. Its ids are transposed: plane p has bit p (or
byte p) of every id, packed; only planes up to the highest that is in use are
stored. Any block can be read alone through the index.

A file holds whole documents, in order, and is closed once it has FILE_IDS ids,
so that files stay small (a document longer than that closes its file at once).
Files are rows of a table written by Spark, one binary value each, since only
Spark's writers reach every store and commit whole tasks.

Order and starts: documents are range-partitioned and sorted by id, equal ids
by their text's hash and text. A partition's ids before each file are known
where the file is made; the partitions' own starts come from one sum for each
partition.

Encoding: byte-level BPE cuts a text into words, blanks and signs before it
merges, and never merges across such a cut. For texts of Latin-1 characters the
cuts are those of the tokenizer; for others they are made at blanks only, which
is coarser and still never inside a merge. The library encodes each piece
between cuts once, in batches, and the ids are kept in a table of bounded size
that forgets what was not asked for lately. Whether the result equals that of
the whole text is tested against the library. Texts that hold the string of an
added token are given to the library whole.

Defined cases: ids are whole numbers; a null or empty text has the end id only; a
null id sorts first and its row is kept; rows with equal ids follow one another;
an empty table gives no files and no rows; other columns are left out.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, fresh_path, table, tables_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK = 65_536
FILE_IDS = 1 << 20
MAGIC = b"TOKPLAN1"
_HEAD = struct.Struct("<8sIIIQQ")
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space as Unicode has it
_LETTER, _NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANKS = f"[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: Cuts of any text, and the finer ones of Latin-1 text.
_COARSE = re.compile(f" ?[^{_BLANK}]+|{_BLANKS}")
_FINE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|{_BLANKS}")
#: Pieces kept in each of two generations, and the longest that is kept.
KEPT, LONGEST = 450_000, 48


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path(TOKENIZER)


class Encoder:
    """encode_all() of texts: ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, file: str):
        # one thread for each worker process: Spark already runs one on each core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _COARSE.findall(text)
        return _FINE.findall(text)

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: array("I", e.ids).tobytes() for p, e in zip(pieces, found, strict=True)}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        whole = [bool(t) and any(a in t for a in self.added) for t in texts]
        cut = [[] if w or not t else self.pieces(t) for t, w in zip(texts, whole, strict=True)]
        needed = set().union(*cut) - self.known.keys()
        if len(self.known) + len(needed) > KEPT:
            self.older, self.known = self.known, {}
            needed = set().union(*cut)
        again = {p: self.older[p] for p in needed & self.older.keys()}
        fresh = self._encode(sorted(needed - again.keys()))
        long = {p: ids for p, ids in fresh.items() if len(p) > LONGEST}
        self.known |= again | fresh
        out = [self._encode([t])[t] if w else b"".join(map(self.known.__getitem__, c)) for t, w, c in zip(texts, whole, cut, strict=True)]
        for p in long:
            del self.known[p]
        return out


def loaded(file: str) -> Encoder:
    """The encoder of this worker process, with the pieces that earlier tasks have kept."""
    return tables_of("planes", file, lambda: Encoder(file))


def pack_block(ids: np.ndarray, by: str, compressor) -> list[bytes]:
    """The compressed planes of a block, the lowest first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if by == "byte":
        n = (int(ids.max(initial=0)).bit_length() + 7) // 8
        columns = ids.view(np.uint8).reshape(-1, 4)
        return [compressor.compress(np.ascontiguousarray(columns[:, p]).tobytes()) for p in range(n)]
    n = int(ids.max(initial=0)).bit_length()
    return [compressor.compress(np.packbits(((ids >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes()) for p in range(n)]


def unpack_block(planes: list[bytes], n: int, by: str, decompressor) -> np.ndarray:
    if by == "byte":
        columns = np.zeros((n, 4), np.uint8)
        for p, z in enumerate(planes):
            columns[:, p] = np.frombuffer(decompressor.decompress(z), np.uint8)
        return columns.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for p, z in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(decompressor.decompress(z), np.uint8), count=n, bitorder="little")
        ids |= bits.astype("<u4") << np.uint32(p)
    return ids


def write_file(ids: np.ndarray, lengths: list[int], by: str = "byte", block: int = BLOCK, level: int = 3) -> bytes:
    """The bytes of a file with these ids, of documents of these lengths."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    index, body, place = [struct.pack("<B", by == "bit")], [], 0
    blocks = range(0, len(ids), block)
    for at in blocks:
        part = ids[at : at + block]
        planes = pack_block(part, by, z)
        index.append(struct.pack("<QIB", place, len(part), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        body += planes
        place += sum(map(len, planes))
    index.append(np.array(lengths, dtype="<u4").tobytes())
    listed = z.compress(b"".join(index))
    return b"".join([_HEAD.pack(MAGIC, block, len(blocks), len(lengths), len(ids), len(listed)), listed, *body])


def read_index(raw: bytes) -> tuple[str, list[tuple[int, int, list[int]]], np.ndarray, int]:
    """How planes are cut; (place, ids, bytes of planes) of each block; ids of each document; where planes begin."""
    import zstandard

    magic, _, n_blocks, n_docs, _, listed = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token-plane file")
    index = zstandard.ZstdDecompressor().decompress(raw[_HEAD.size : _HEAD.size + listed])
    by, at, blocks = ("bit" if index[0] else "byte"), 1, []
    for _ in range(n_blocks):
        place, n, planes = struct.unpack_from("<QIB", index, at)
        at += 13
        blocks.append((place, n, list(struct.unpack_from(f"<{planes}I", index, at))))
        at += 4 * planes
    return by, blocks, np.frombuffer(index, "<u4", n_docs, at), _HEAD.size + listed


def read_ids(raw: bytes, only: list[int] | None = None) -> np.ndarray:
    """The ids of a file, or of some of its blocks."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    by, blocks, _, start = read_index(raw)
    out = []
    for k in range(len(blocks)) if only is None else only:
        place, n, sizes = blocks[k]
        at, planes = start + place, []
        for size in sizes:
            planes.append(raw[at : at + size])
            at += size
        out.append(unpack_block(planes, n, by, z))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


FILES = "part int, file int, part_start long, n_ids long, doc_ids array<long>, bytes binary"


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, end_id: int | None = END_ID, by: str = "byte", block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """One row for each file: its partition and number there, ids of the partition before it, ids in it, its document ids and its bytes."""
    source = file or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    dealt = rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h", "t").select("i", "t")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = loaded(source), TaskContext.get().partitionId()
        number = before = held_ids = 0
        ids: list[bytes] = []
        names: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal number, before, held_ids
            raw = write_file(np.frombuffer(b"".join(ids), "<u4"), lengths, by, block)
            row = [[part], [number], [before], [held_ids], [list(names)], [raw]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            number, before, held_ids = number + 1, before + held_ids, 0
            for x in (ids, names, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "file", "part_start", "n_ids", "doc_ids", "bytes"])

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                for i, some in zip(batch.column("i").to_pylist(), encoder.encode_all(batch.column("t").to_pylist()), strict=True):
                    ids.append(some + end)
                    names.append(i)
                    lengths.append(len(ids[-1]) // 4)
                    held_ids += lengths[-1]
                    if held_ids >= file_ids:
                        yield close()
        if names:
            yield close()

    return dealt.mapInArrow(run, FILES)


def read_documents(files: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32, all from the files' bytes."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each partition that was written: few, whatever the number of documents
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column("bytes")[k].as_py()
                ids, lengths = read_ids(raw), read_index(raw)[2].astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("part")[k].as_py(), np.int32)), batch.column("doc_ids")[k].values, pa.array(starts + batch.column("part_start")[k].as_py()), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    read = files.select("part", "part_start", "doc_ids", "bytes").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, "part").select("doc_id", (F.col("at") + F.col("part_at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the token files as a table in the shared folder and read the documents back from it."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-planes")
    token_files(docs, **how).write.option("compression", "none").parquet(path)
    return read_documents(spark.read.parquet(path))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))
