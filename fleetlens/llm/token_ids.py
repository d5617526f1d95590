"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Ids of a public tokenizer are renumbered by falling frequency over all documents. A rank takes 1 to 4 bytes; two bits of a
control byte tell how many, four ranks to a control byte. Control bytes and data bytes are separate, so numpy decodes a
whole file with a few table lookups. A file is one Parquet row of the archive: first doc_id order and position, per-document
counts, control bytes, data bytes. Files follow each other in ascending doc_id order.

Text is split at white space, which the tokenizer's own rules never cross; distinct pieces of a batch are encoded once.
Pieces of plain letters with trailing marks take the tokenizer's BPE model directly on the lower-cased letters; all other
pieces go through the whole tokenizer.

Defined results: null and empty texts have the end id only; repeated rows and equal doc_ids are written each, in the order
of their ids' checksum; a null doc_id comes first; an empty table writes no file and gives no rows; other columns are not
written.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ragged, slices, write_shared

END_ID = 1
#: Ids in one file, about; a longer document has a file of its own.
FILE_IDS = 1 << 20
#: Ids of one task that writes files, about.
PART_IDS = 1 << 23
#: Bytes of text that a task encodes at once, and words whose ids a worker keeps.
TEXT_BYTES = 16 << 20
KEPT_WORDS = 500_000
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,!?;:|#$%&*]*)$"

_loaded: dict[str, object] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE uses for each byte: printable Latin-1 stands for itself, others follow from 256."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, the same as Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.seen: dict[str, bytes] = {}
        self.size = self.whole.get_vocab_size(with_added_tokens=True)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters in lower case, as little-endian 32-bit numbers; words seen lately are looked up."""
        out = []
        for word in words:
            ids = self.seen.get(word)
            if ids is None:
                letters = word.translate(self.letters) if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
                ids = struct.pack(f"<{len(t := self.whole.model.tokenize(letters))}I", *(x.id for x in t))
                if len(self.seen) >= KEPT_WORDS:
                    self.seen.clear()
                self.seen[word] = ids
            out.append(ids)
        return out

    def whole_ids(self, pieces: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces one after the other, and how many each has."""
        parts = pc.extract_regex(pieces, PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(plain))
        word, marks = (pc.utf8_lower(parts.field(f).take(at)).dictionary_encode() for f in ("word", "marks"))
        word_ids, mark_ids = self.word_ids(word.dictionary.to_pylist()), self.whole_ids(marks.dictionary.to_pylist())
        other = np.flatnonzero(~plain)
        ids = [word_ids[w] + mark_ids[m] for w, m in zip(word.indices.to_pylist(), marks.indices.to_pylist())] + self.whole_ids(pieces.take(pa.array(other)).to_pylist())
        order = np.empty(len(pieces), np.int64)
        order[np.concatenate([np.flatnonzero(plain), other])] = np.arange(len(pieces))
        ids = [ids[k] for k in order.tolist()]
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def texts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, END_ID after each, and how many each text has with it."""
        split = pc.ascii_split_whitespace(text.fill_null("").cast(pa.string()))
        words = split.flatten()
        keep = pc.greater(pc.binary_length(words), 0)
        per_text = np.diff(split.offsets.to_numpy())
        row = np.repeat(np.arange(len(text)), per_text)[keep.to_numpy(zero_copy_only=False)]
        coded = words.filter(keep).dictionary_encode()
        ids, counts = self.pieces(coded.dictionary)
        piece = coded.indices.to_numpy().astype(np.int64)
        lengths = counts[piece] if len(piece) else np.zeros(0, np.int64)
        per_row = np.bincount(row, weights=lengths, minlength=len(text)).astype(np.int64) + 1
        ends = np.cumsum(per_row)
        out = np.full(int(ends[-1]) if len(ends) else 0, END_ID, np.uint32)
        begin = np.cumsum(counts) - counts
        inside = np.cumsum(lengths) - lengths
        source = np.repeat(begin[piece] - inside, lengths) + np.arange(int(lengths.sum()))
        is_end = np.zeros(len(out), bool)
        is_end[ends - 1] = True
        out[~is_end] = ids[source]
        return out, per_row


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


#: Of each control byte: the four sizes.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of encode()."""
    size = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned little-endian; 2 bytes each where the vocabulary allows it) and crc32 of the ids."""
    wide = "<u2" if Encoder.of(tokenizer).size <= 1 << 16 else "<u4"

    def each(batches):
        coder = Encoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                ids, counts = coder.texts(part.column("text"))
                ends = np.cumsum(counts)
                four, short = ids.astype("<u4", copy=False), ids.astype(wide)
                spans = list(zip((ends - counts).tolist(), ends.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array([short[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([zlib.crc32(four[a:b].tobytes()) for a, b in spans], pa.int64())],
                    names=["doc_id", "n_tokens", "ids", "crc"],
                )

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, n_tokens long, ids binary, crc long")


def id_counts(coded: DataFrame, vocab: int, wide: str) -> DataFrame:
    """id, n: how often each id occurs; a row for each id of the vocabulary at most."""

    def count(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            ids = batch.column("ids")
            data = np.frombuffer(ids.buffers()[2], np.uint8) if len(ids) else np.zeros(0, np.uint8)
            first = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(2, np.int32)
            total += np.bincount(data[first[0] : first[-1]].view(wide), minlength=vocab)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["id", "n"])

    return coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


FILES = "part int, seq int, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write path/files (the coded ids, in ascending doc_id order), path/index (where each file starts), path/ranks (each rank's id)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    vocab = Encoder.of(tokenizer).size
    wide = "<u2" if vocab <= 1 << 16 else "<u4"
    coded = write_shared(tokenize(docs, tokenizer), "token-ids")
    order = id_counts(coded, vocab, wide).orderBy(F.desc("n"), "id").toPandas()  # at most the vocabulary
    ranks = order.assign(rank=np.arange(len(order)))[["rank", "id", "n"]].astype("int64")
    spark.createDataFrame(ranks, "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(vocab, np.uint32)
    rank_of[ranks["id"].to_numpy()] = ranks["rank"].to_numpy()
    shared = spark.sparkContext.broadcast(rank_of)

    def files(batches):
        part, seq, held, n_ids = TaskContext.get().partitionId(), 0, [], 0

        def row():
            control, data = encode(shared.value[np.frombuffer(b"".join(x for _, _, x in held), wide)])
            columns = [[part], [seq], [n_ids], [[d for d, _, _ in held]], [[c for _, c, _ in held]], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "seq", "n_ids", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids")):
                held.append((doc, n, ids.as_buffer()))
                n_ids += n
                if n_ids >= FILE_IDS:
                    yield row()
                    seq, held, n_ids = seq + 1, [], 0
        if held:
            yield row()

    total = coded.agg(F.sum("n_tokens")).first()[0] or 0
    ordered = coded.repartitionByRange(max(1, -(-total // PART_IDS)), "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(files, FILES).write.option("compression", "none").parquet(f"{path}/files")
    sizes = spark.read.schema(FILES).parquet(f"{path}/files").select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    index.select("part", "seq", (F.col("before") + F.col("ahead")).alias("file_start")).write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<int>) of each document in the archive at path."""
    ids_of = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")["id"].to_numpy(np.uint32)  # at most the vocabulary
    shared = spark.sparkContext.broadcast(ids_of)
    schema = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def each(batches):
        for batch in batches:
            for part, seq, docs, counts, control, data in zip(*(batch.column(c) for c in ("part", "seq", "doc_ids", "counts", "control", "data"))):
                counts = counts.values.to_numpy()
                ends = np.cumsum(counts)
                ids = shared.value[decode(control.as_buffer(), data.as_buffer(), int(ends[-1]))].astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(counts)
                columns = [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), docs.values, pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, ragged(ids.astype(np.int32), counts, pa.int32())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = spark.read.schema(FILES).parquet(f"{path}/files").drop("n_ids").mapInArrow(each, schema)
    rows = rows.join(spark.read.schema("part int, seq int, file_start long").parquet(f"{path}/index"), ["part", "seq"])
    return rows.select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
