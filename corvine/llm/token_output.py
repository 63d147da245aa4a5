"""Token ids of whole texts as checksummed binary blocks, in ascending document order.

Texts are dealt by ranges of doc_id, sorted inside a range, tokenised and packed into blocks of whole documents (see
:mod:`corvine.llm.token_codec`), each of at least ``BLOCK_IDS`` ids unless it ends a range. A block is a row of a Parquet
table: ``part`` and ``block`` are its place, ``doc_ids`` and ``sizes`` its documents, ``n_tokens`` its ids and
``payload`` its bytes. Spark's writer commits the files, so a lost executor costs its blocks only. A reader decodes
blocks independently; where a document's ids start among all ids comes from sums over the ranges, then over the blocks
of a range.

Neither the vocabulary's normaliser nor its splitting looks across a space or a line break, so the distinct pieces between
those are tokenised once for many texts, and words of Latin letters are remembered by a worker, up to ``REMEMBERED``.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows that share a doc_id are
ordered by a hash of their texts, and those that are equal in both are alike, so their order does not matter; each row is a
document of its own in the output; an empty table gives no rows; extra columns are ignored. One row's ids have to fit
a block in memory, so a text of any length that fits a row is coded whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.token_codec import BlockError, decode_block, encode_block
from corvine.runtime import broadcast_if_small, slices

BLOCK_IDS = 1 << 21
END_ID = 1
#: Words that a worker remembers; beyond them it forgets the older half.
REMEMBERED = 800_000
#: Bytes of text that are tokenised at a time.
TURN_BYTES = 16 << 20
#: A word of Latin letters, and a run of ASCII marks after it. The vocabulary's normaliser only lower-cases it, and its pattern
#: always cuts between letters and marks and nowhere else, so the ids of both are those of the piece.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@[-`{-~]*)")
#: Runs of marks that a worker remembers.
MARKS = 10_000
#: Little-endian 32-bit words of few ids.
_FEW = [struct.Struct(f"<{n}I").pack for n in range(9)]
#: The model's spelling of bytes: those that print stand for themselves, the others for characters from 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELT = {b: b for b in _PRINT} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(_PRINT))}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceTokenizer:
    """Ids of whole texts by way of their distinct pieces between blanks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.marks = {"": b""}

    def _whole(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return _FEW[len(ids)](*ids) if len(ids) < len(_FEW) else np.array(ids, "<u4").tobytes()

    def _marks(self, run: str) -> bytes:
        if len(self.marks) > MARKS:
            self.marks = {"": b""}
        found = self.marks[run] = self._whole(run)
        return found

    def _word(self, word: str) -> bytes:
        """Of a lower-case word of Latin letters: the model alone, in its spelling of bytes."""
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELT)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return _FEW[len(ids)](*ids) if len(ids) < len(_FEW) else np.array(ids, "<u4").tobytes()

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        if len(self.known) > REMEMBERED:
            self.known = dict(list(self.known.items())[len(self.known) // 2 :])
        out, known, plain_of = [], self.known, _PLAIN.fullmatch
        for p in pieces:
            plain = plain_of(p)
            if plain is None:
                found = known.get(p)
                if found is None:
                    found = known[p] = self._whole(p)
            else:
                word, run = plain.groups()
                word = word.lower()
                found = known.get(word)
                if found is None:
                    found = known[word] = self._word(word)
                if run:
                    marks = self.marks.get(run)
                    found += self._marks(run) if marks is None else marks
            out.append(found)
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; nulls count as empty."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        raw = self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, raw), np.int32, len(raw)) // 4, out=starts[1:])
        pieces = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(raw), "<u4")))
        found = pieces.take(words.indices)
        ends = found.offsets.to_numpy()
        cuts = ends.take(split.offsets.to_numpy() - split.offsets[0].as_py())
        return found.values.to_numpy()[ends[0] : ends[-1]], np.diff(cuts)


_tokenizers: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    """One for each vocabulary and worker, so that tasks share what is known."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts, of ``TURN_BYTES`` or one text more at a time."""
    ids: list = []
    texts: list[pa.Array] = []
    held = 0
    for batch in slices(batches):
        column = batch.column(1)
        size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            to = min(int(np.searchsorted(size, before + TURN_BYTES - held)) + 1, batch.num_rows)
            ids += batch.column(0).slice(at, to - at).to_pylist()
            texts.append(column.slice(at, to - at))
            held, at = held + int(size[to - 1]) - before, to
            if held >= TURN_BYTES:
                yield ids, pa.concat_arrays(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def _pack(path: str, block_ids: int, end_id: int, kind: pa.DataType):
    end = np.array([end_id], "<u4")
    names = ["part", "block", "doc_ids", "sizes", "n_tokens", "payload"]

    def block(part: int, number: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        sizes = [len(p) + 1 for p in parts[::2]]
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())),
            pa.array([len(ids)], pa.int64()), pa.array([encode_block(ids)], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, number = _tokenizer(path), TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []  # ids and the end id of each document
        held = 0
        for keys, texts in _turns(batches):
            ids, counts = tokens(texts)
            at = 0
            for key, n in zip(keys, counts.tolist(), strict=True):
                docs.append(key)
                parts += (ids[at : at + n], end)
                at, held = at + n, held + n + 1
                if held >= block_ids:
                    yield block(part, number, docs, parts)
                    docs, parts, held, number = [], [], 0, number + 1
        if docs:
            yield block(part, number, docs, parts)

    return run


def write_token_blocks(documents: DataFrame, path: str, vocabulary: str | None = None, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> None:
    """Tokenise ``documents`` (doc_id, text) and write their blocks to ``path``, a folder that must not exist yet."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema["doc_id"].dataType
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    # equal rows are alike, so a number may part them: no key is so hot that it cannot be split
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "h", "n").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "n")
    schema = f"part int, block int, doc_ids array<{kind.simpleString()}>, sizes array<bigint>, n_tokens bigint, payload binary"
    packed = rows.select("doc_id", "text").mapInArrow(_pack(vocabulary or default_vocabulary(), block_ids, end_id, to_arrow_type(kind)), schema)
    packed.write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The blocks without their bytes, with ``start``: the ids of all blocks before."""
    rows = spark.read.parquet(path).select("part", "block", "n_tokens")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    # one row for each range of documents, however long it is
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(before, "part").select("part", "block", "n_tokens", (F.col("before") + F.col("within")).alias("start"))


def _unpack(kind: pa.DataType, digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                ids, sizes = decode_block(row["payload"]), np.array(row["sizes"], np.int64)
                if len(ids) != row["n_tokens"] or sizes.sum() != len(ids):
                    raise BlockError("a block and its index differ")
                ends = np.cumsum(sizes)
                spans: Iterable[tuple[int, int]] = zip((ends - sizes).tolist(), ends.tolist(), strict=True)
                raw = ids.astype("<u4").tobytes()
                content = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in spans] if digest_only else [ids[a:b] for a, b in spans]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], kind), pa.array(row["start"] + ends - sizes), pa.array(sizes),
                    pa.array(content, pa.int64() if digest_only else pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"])

    return run


def read_token_blocks(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with ``digest_only``, ids_crc32) of every document, decoded from the files."""
    from pyspark.sql.pandas.types import to_arrow_type

    blocks, index = spark.read.parquet(path), read_index(spark, path).select("part", "block", "start")
    kind = blocks.schema["doc_ids"].dataType.elementType
    rows = blocks.join(broadcast_if_small(index, blocks.count(), 24), ["part", "block"])
    schema = f"doc_id {kind.simpleString()}, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest_only else "ids array<bigint>")
    return rows.mapInArrow(_unpack(to_arrow_type(kind), digest_only), schema)
