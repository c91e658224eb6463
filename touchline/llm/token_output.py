"""Token ids as a binary file format: shards of separately compressed documents.

A shard is one binary value (written as a row of a Parquet table, so any store Spark writes to will do and a
lost executor's shards are written again by Spark's committer):

    magic ``TLID1``, width of an id in bytes (1 byte), SHA-256 of the dictionary (32 bytes), number of documents n
    (uint32), then for each document its id (int64), whether it has one (uint8), its number of tokens (uint32) and, n + 1
    times, the offset of its bytes (uint64); then the bytes: each document's ids, little-endian, compressed alone by
    zstandard with the shared dictionary.

The dictionary is trained on the serialised ids of a bounded sample of documents (``SAMPLE_DOCS``, by a
hash of their id) and stored beside the shards with its hash; a reader refuses a shard whose hash differs. One
document is read by its index entry alone, without its neighbours.

Defined cases: null text is an empty document, which has the end id only; documents with one id stay together, in the
order of their text's hash; a null id sorts first and comes back as null; an empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import NULL_ID, as_ids, blocks, bounded_sample, mapped, out, partitions, table, texts
from touchline.session import fresh_path

END_ID = 2
SAMPLE_DOCS = 300
DICTIONARY_BYTES = 64 * 1024
SHARD_BYTES = 2_000_000
LEVEL = 1
MAGIC = b"TLID1"
KNOWN_PIECES = 1_000_000  # of a worker's memory of pieces, emptied when full

SHARDS = "part int, start_in_part long, n_docs long, n_tokens long, first_id long, last_id long, shard binary"
_SHARDS = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                     ("first_id", pa.int64()), ("last_id", pa.int64()), ("shard", pa.binary())])


#: Of ISO 8859-1: white space, ASCII characters and accented letters. The vocabulary's normaliser only lowers these.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_LOWER = bytes(x + 32 if 65 <= x <= 90 or 0xC0 <= x <= 0xDE and x != 0xD7 else x for x in range(256))
#: The pre-tokenizer's pattern, as it acts on plain characters in lower case.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\s0-9a-z\xdf-\xf6\xf8-\xff]+")
_GROUP = 64


class WordEncoder:
    """The ids of whole texts from the ids of their pieces.

    A text's ids are those of its pre-tokenizer's pieces one after the other, so a worker has the library encode each piece
    that it meets once. That holds for texts of plain characters; any other text, and any with the opening of a
    special token, is given to the library whole."""

    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _learn(self, new: list[bytes], width: str) -> None:
        groups = [new[k : k + _GROUP] for k in range(0, len(new), _GROUP)]
        for group, e in zip(groups, self.tokenizer.encode_batch([b" ".join(g).decode("latin-1") for g in groups], add_special_tokens=False)):
            cuts = [0, *(np.flatnonzero(np.diff(e.word_ids)) + 1).tolist(), len(e.ids)]
            if len(cuts) != len(group) + 1:
                raise ValueError("the vocabulary's pre-tokenizer does not cut texts as expected")
            raw, size = np.array(e.ids, width).tobytes(), np.dtype(width).itemsize
            for piece, s, t in zip(group, cuts, cuts[1:]):
                self.known[piece] = raw[s * size : t * size]

    def serialised(self, data: list[bytes], width: str) -> list[bytes]:
        """For each text its ids, end id included, as little-endian numbers of type ``width``."""
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        end = np.array([END_ID], width).tobytes()
        found: list = []
        for x in data:
            text = x.decode()
            try:
                plain = text.encode("latin-1")
            except UnicodeEncodeError:
                plain = None
            if plain is None or b"<|" in x or plain.translate(None, _PLAIN):
                found.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, width).tobytes())
            else:
                found.append(_PIECE.findall(plain.translate(_LOWER)))
        new = set().union(*(x for x in found if isinstance(x, list))) - self.known.keys()
        self._learn(list(new), width)
        known = self.known.__getitem__
        return [(b"".join(map(known, x)) if isinstance(x, list) else x) + end for x in found]


def train_dictionary(docs: DataFrame, path: str, width: str, sample: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary from the ids of about ``sample`` documents; empty if they are too few to train on."""
    rows = bounded_sample(docs, sample).select("doc_id", "text").collect()
    samples = WordEncoder.of(path).serialised([r[1].encode() for r in sorted(rows, key=str)], width)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def _codec(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def encode_shard(ids: np.ndarray, tokens: list[int], bodies: list[bytes], digest: bytes, width: int) -> bytes:
    offsets = np.zeros(len(bodies) + 1, "<u8")
    np.cumsum([len(b) for b in bodies], out=offsets[1:])
    return b"".join([MAGIC, struct.pack("<B", width), digest, struct.pack("<I", len(bodies)), ids.astype("<i8").tobytes(),
                     (ids != NULL_ID).astype("u1").tobytes(), np.array(tokens, "<u4").tobytes(), offsets.tobytes(), *bodies])


class Shard:
    """One shard: its index, and its documents one at a time."""

    def __init__(self, blob: bytes, dictionary: bytes):
        if blob[:5] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.width, n = blob[5], struct.unpack_from("<I", blob, 38)[0]
        if blob[6:38] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = 42
        self.ids = np.frombuffer(blob, "<i8", n, at)
        self.has_id = np.frombuffer(blob, "u1", n, at + 8 * n).astype(bool)
        self.tokens = np.frombuffer(blob, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 13 * n)
        self.body, self.blob = at + 13 * n + 8 * (n + 1), blob
        self.reader = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own bytes only."""
        s, e = (self.body + int(x) for x in self.offsets[k : k + 2])
        raw = self.reader.decompress(self.blob[s:e], max_output_size=int(self.tokens[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def _writer(path: str, dictionary: bytes, width: int):
    kind, digest = f"<u{width}", hashlib.sha256(dictionary).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = WordEncoder.of(path), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary))
        ids, tokens, bodies, size = [], [], [], 0

        def shard():
            nonlocal done
            blob, total = encode_shard(np.array(ids, np.int64), tokens, bodies, digest, width), sum(tokens)
            row = out(_SHARDS, [part], [done], [len(ids)], [total], [ids[0]], [ids[-1]], [blob])
            done += total
            return row

        for batch in blocks(batches):
            raws = encoder.serialised(batch.column(1).cast(pa.binary()).to_pylist(), kind)
            for doc_id, raw in zip(as_ids(batch).tolist(), raws):
                body = press.compress(raw)
                ids.append(doc_id), tokens.append(len(raw) // width), bodies.append(body)
                size += len(body)
                if size >= SHARD_BYTES:
                    yield shard()
                    ids, tokens, bodies, size = [], [], [], 0
        if ids:
            yield shard()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the shards, in ascending order of doc_id, and their dictionary under ``path``."""
    from tokenizers import Tokenizer

    df = texts(docs, id_col, text_col)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 2**16 else 4
    dictionary = train_dictionary(df, tokenizer, f"<u{width}")
    spark = df.sparkSession
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    # Texts move to their range once; they are encoded behind that shuffle. The hash spreads a repeated id.
    ranged = df.repartitionByRange(partitions(df), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    mapped(ordered, _writer(tokenizer, dictionary, width), SHARDS).write.parquet(f"{path}/shards")
    return path


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row["dictionary"])).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary in {path} does not have its hash")
    return bytes(row["dictionary"])


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with that id: only shards whose range holds it are read, only its bytes decompressed."""
    dictionary = read_dictionary(spark, path)
    rows = spark.read.parquet(f"{path}/shards").where(f"first_id <= {int(doc_id)} AND last_id >= {int(doc_id)}").select("shard").toLocalIterator()
    shards = (Shard(bytes(r[0]), dictionary) for r in rows)
    return [s.document(k) for s in shards for k in np.flatnonzero((s.ids == doc_id) & s.has_id)]


_READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(dictionary: bytes):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard = Shard(blob, dictionary)
                n = len(shard.ids)
                crc = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(n)]
                tokens = shard.tokens.astype(np.int64)
                starts = start + np.concatenate([[0], np.cumsum(tokens)[:-1]])
                yield out(_READ, np.full(n, part, np.int32), pa.array(shard.ids, mask=~shard.has_id), starts, tokens, np.array(crc, np.int64))

    return read


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    shards = spark.read.parquet(f"{path}/shards")
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each partition of the writer
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("part", before.alias("base"))
    rows = mapped(shards.select("part", "start_in_part", "shard"), _reader(read_dictionary(spark, path)),
                  "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` under a new path of the shared folder and read the files back."""
    import public_tokenizers

    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, fresh_path(spark, "token-ids"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
