"""Token ids of a corpus in binary files, in ascending order of document id.

A file holds a run of documents. Its ids are replaced by their rank of frequency within the file (0 is the most
frequent, ties to the smaller id) and the ranks are written in 1, 2, 3 or 4 bytes. The lengths stand apart, in
control bytes: one bit per value (1 or 2 bytes) where no rank needs more, else two bits. A file is

    magic "TKF1" | u32 bits per length | u64 documents, tokens, distinct ids, data bytes
    | u32 ids by rank | i64 document ids (null: a flag byte each) | u64 tokens of each document | control | data

all little-endian. Readers look the lengths of a control byte up in a table of 256 rows, add them up to offsets and
gather all values at once.

Plan: bounds that split the ids evenly come from a scan of the ids alone; each document is tokenized once and goes, as
packed ids, to the partition of its range; a partition is sorted and written in files of at most about
`file_tokens` tokens (one longer document is a file of its own), so memory is bounded. Repeated ids are ordered
by the hash of their text, also across partitions, so that one id of many rows is spread. Files carry the name of
their attempt and only those listed in the manifest, a committed table, count: a lost executor's files are written anew.
The manifest has a row per file; starts are its running sums.

Null texts and empty texts have the end id only. Null document ids come first. An empty table gives no
file. Repeated rows are encoded each. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnsift.llm.common import arrow_map
from txnsift.session import materialize, scratch_path

MAGIC = b"TKF1"
_HEADER = struct.Struct("<4sI4Q")
#: Words, and pieces, that a worker keeps with their ids in each of two generations.
CACHED = 200_000
#: Values that are coded at once, a multiple of 8.
SLICE = 1 << 18

# -- tokenizing


class _Memory:
    """What was computed last: a generation that fills up, and the one before, from which used entries return."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= CACHED:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordTokenizer:
    """Ids of whole texts by a tokenizer of the tokenizers library, with a memory for words.

    The tokenizer must drop white space and split at it, so that a text's ids are those of its words. Words of
    Latin-1 characters are also cut where the tokenizer cuts them, and each piece is asked of its model once.
    """

    #: The classes of the tokenizer's own pattern, within Latin-1.
    _PIECES = re.compile(
        "'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿªµº]+|[0-9²³¹¼-¾]"
        "|[^\\s\u0085 a-zß-öø-ÿªµº0-9²³¹¼-¾]+"
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = _Memory(), _Memory()
        mapped = [t[0] for t in (self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in ("!", "é"))]
        self.by_piece = mapped == [("!", (0, 1)), ("Ã©", (0, 1))]
        shown = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in map(chr, range(33, 256))}
        self.shown = {c: v[0][0] for c, v in shown.items() if len(v) == 1}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            text = piece if piece.isascii() else "".join([self.shown[c] for c in piece])
            found = array("H", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
            self.pieces.put(piece, found)
        return found

    def _word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is not None:
            return found
        text = word.decode("utf-8", "surrogatepass")
        if self.by_piece and "<|" not in text and text.isprintable() and (text.isascii() or _latin1(text)):
            lowered = text.lower()
            if lowered.isalpha():
                found = self._piece(lowered)
            else:
                found = b"".join([self._piece(p) for p in self._PIECES.findall(lowered)])
        else:
            found = array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self.words.put(word, found)
        return found

    def encode(self, text: str) -> bytes:
        """Packed 16-bit ids."""
        words = text.encode("utf-8", "surrogatepass").split()
        ask = self._word
        parts = []
        for at in range(0, len(words), 65536):  # the generation may change between slices
            known = self.words.new.get
            parts += [known(w) or ask(w) for w in words[at : at + 65536]]
        return b"".join(parts)

    def forget(self) -> None:
        """Give the memory of words back, before the worker waits or does other work."""
        self.words, self.pieces = _Memory(), _Memory()


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# -- the file format


def _length_table(bits: int) -> np.ndarray:
    """Lengths that each control byte stands for."""
    codes = np.arange(256)[:, None] >> np.arange(0, 8, bits)
    return ((codes & ((1 << bits) - 1)) + 1).astype(np.uint8)


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: `lengths` tokens for each document, `ids` of all of them."""
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    by_rank = distinct[np.argsort(-counts[distinct], kind="stable")]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(distinct), dtype=np.uint32)
    bits = 1 if len(distinct) <= 1 << 16 else 2
    packed = [_pack(rank_of[ids[at : at + SLICE]], bits) for at in range(0, len(ids), SLICE)]
    control, data = b"".join(p[0] for p in packed), b"".join(p[1] for p in packed)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = _HEADER.pack(MAGIC, bits, len(doc_ids), len(ids), len(distinct), len(data))
    return b"".join(
        [head, by_rank.astype("<u4").tobytes(), known.tobytes(), nulls.tobytes(),
         np.asarray(lengths, "<u8").tobytes(), control, data]
    )


def _pack(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control and data bytes of up to `SLICE` values."""
    sizes = np.ones(len(ranks), np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        sizes += ranks >= limit
    per = 8 // bits
    padded = np.zeros(-(-len(ranks) // per) * per, np.uint8)
    padded[: len(sizes)] = sizes - 1
    control = np.zeros(len(padded) // per, np.uint8)
    for i in range(per):
        control |= padded[i::per] << (bits * i)
    ends = np.cumsum(sizes, dtype=np.int64)
    data = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - sizes
    for i in range(int(sizes.max())):
        have = sizes > i
        data[starts[have] + i] = (ranks[have] >> (8 * i)) & 0xFF
    return control.tobytes(), data.tobytes()


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of tokens, and all ids of one file."""
    magic, bits, n_docs, n_tokens, n_ids, n_data = _HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(raw, kind, n, at)
        at += part.nbytes
        return part

    by_rank, known, nulls, lengths = take("<u4", n_ids), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    control = take("u1", -(-n_tokens // (8 // bits)))
    data = take("u1", n_data)
    table, ids, at = _length_table(bits), np.empty(n_tokens, "<u4"), 0
    for first in range(0, n_tokens, SLICE):
        n = min(SLICE, n_tokens - first)
        sizes = table[control[first * bits // 8 : -(-(first + n) * bits // 8)]].reshape(-1)[:n]
        starts = at + np.cumsum(sizes, dtype=np.int64) - sizes
        ranks = data[starts].astype(np.uint32)
        for i in range(1, int(sizes.max())):
            have = np.flatnonzero(sizes > i)
            ranks[have] |= data[starts[have] + i].astype(np.uint32) << np.uint32(8 * i)
        ids[first : first + n] = by_rank[ranks]
        at += int(sizes.sum())
    return [None if x else int(d) for d, x in zip(known, nulls, strict=True)], lengths, ids


# -- files of a corpus


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    folder: str | None = None,
    partition_chars: int = 32 << 20,
    file_tokens: int = 1 << 22,
) -> DataFrame:
    """Writes the files and returns the manifest: file, documents, tokens, start (ids in all files before it).

    `folder` is shared storage that pyarrow can open (default: below spark.checkpoint.dir). `tokenizer_path` is read
    on the workers, and must be there; its ids must be below 65,536.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    n_chars = slim.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0.0
    parts = max(1, int(-(-n_chars // partition_chars)), min(spark.sparkContext.defaultParallelism, int(n_chars // (1 << 16))))
    bounds = slim.stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.array(bounds, dtype=np.float64).astype(np.int64)
    folder = folder or scratch_path(spark, "tokens")

    def tokenize(batches):
        encode = _tokenizer(tokenizer_path).encode
        end = np.uint16(end_id).tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            packed, mix, slot = [], [], []
            for d, t in zip(ids.to_pylist(), texts, strict=True):
                value = t.as_py()
                mix.append(zlib.crc32(value.encode("utf-8", "surrogatepass")))
                packed.append(encode(value) + end)
                if d is None:
                    slot.append(0)
                else:  # an id that fills several ranges is spread over them by its text
                    low, high = np.searchsorted(bounds, d, "left"), np.searchsorted(bounds, d, "right")
                    slot.append(int(low) + mix[-1] * int(high - low + 1) // (1 << 32))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(mix, pa.int64()), pa.array(slot, pa.int32()), pa.array(packed, pa.binary())], ["id", "mix", "slot", "ids"]
            )
        _tokenizer(tokenizer_path).forget()

    def write(batches):
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        held: list[tuple] = []
        n_held, slot, n_file = 0, None, 0

        def flush():
            nonlocal held, n_held, n_file
            ids = np.frombuffer(b"".join([h[1] for h in held]), np.uint16)
            lengths = np.array([len(h[1]) // 2 for h in held], np.int64)
            name = f"part-{slot:07d}-{n_file:05d}-{uuid.uuid4().hex}.tkf"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(encode_file([h[0] for h in held], lengths, ids))
            row = (slot, n_file, name, len(held), len(ids))
            held, n_held, n_file = [], 0, n_file + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["slot", "part", "file", "documents", "tokens"])

        for batch in batches:
            for d, s, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                packed = ids.as_py()
                if held and (s != slot or n_held + len(packed) // 2 > file_tokens):
                    yield flush()
                if s != slot:
                    slot, n_file = s, 0
                held.append((d, packed))
                n_held += len(packed) // 2
        if held:
            yield flush()

    packed = arrow_map(slim, tokenize, "id bigint, mix bigint, slot int, ids binary")
    placed = packed.repartitionById(parts, F.col("slot")).sortWithinPartitions("slot", F.asc_nulls_first("id"), "mix", "ids")
    written = arrow_map(placed, write, "slot bigint, part bigint, file string, documents bigint, tokens bigint")
    manifest = materialize(written, "token-files")
    before = Window.orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.select(
        F.concat(F.lit(folder + "/"), "file").alias("file"),
        "documents",
        "tokens",
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"),
    )


def read_tokens(manifest: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents of the files: `doc_id`, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers)."""

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _filesystem(file)
                with system.open_input_file(path) as source:
                    doc_ids, lengths, ids = decode_file(source.read())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths.astype(np.int64)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    [doc_id, "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("file", "start")
    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "file")
    return arrow_map(spread, read, f"`{doc_id}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
