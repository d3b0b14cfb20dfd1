"""Token counts of whole texts, exactly as a tokenizer library gives them.

A byte-level BPE never merges across the start of a white-space run, so a text
falls into pre-tokens, each a run of white space with the run of other
characters behind it, whose counts add up.

1. Profiles.  Texts are read once, in blocks of about ``BLOCK_CHARS`` characters
   of one split.  A block has a dictionary (pre-token, code) and for each of its
   documents the frequencies by code.  So a pre-token travels once a block,
   however many documents repeat it, and a word that a third of all documents
   hold is one entry a block.  The dictionary is dealt to parts by a hash of the
   pre-token, and each block's entries of a part are one deflated row.
2. Counts.  All rows of a part meet, and the library counts the pieces of each
   distinct pre-token once, for all blocks that have it.  A task holds the
   different pre-tokens of one part; there are four parts a shuffle partition.
3. Join.  Counts go back to their blocks, where they are joined to the documents'
   frequencies and summed; the ids of a document never exist.

Special strings are split off first, as the library does by default, and count
one each.  Other vocabularies than byte-level BPE don't fall into such
pre-tokens and are counted text by text.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a null id stays
null; a text without white space is one pre-token, whatever its length; repeated
rows give repeated rows; further columns of the input are ignored; an empty
table gives an empty result.  A task holds one block, and at least one text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import scratch

#: Characters of a block, and the pre-tokens that the library gets at once.
BLOCK_CHARS, BATCH = 24 << 20, 10_000
#: The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Rows of a block: part -1 holds its documents, the others what the dictionary has of a part.
PROFILE = "block long, part int, packed binary"


class ByteLevel:
    """One vocabulary file; one of these lives in each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.additive, self.special = additive(path)

    def count(self, pieces: list[str]) -> list[int]:
        """The number of tokens of each string."""
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [len(e) for at in range(0, len(pieces), BATCH) for e in encode(pieces[at : at + BATCH], add_special_tokens=False)]


def additive(path: str) -> tuple[bool, re.Pattern | None]:
    """Whether counts of pre-tokens add up, and the pattern of the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    fits = spec.get("normalizer") is None and parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
    fits = fits and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    # the longest string first, as the library matches
    words = sorted((t["content"] for t in added), key=len, reverse=True)
    return fits, re.compile("|".join(map(re.escape, words))) if words else None


def pre_tokens(text: str, special: re.Pattern | None) -> tuple[list[str], int]:
    """The pre-tokens of a text in order, and the number of special strings."""
    if special is None or not (found := len(special.findall(text))):
        return PRE_TOKEN.findall(text), 0
    return [p for part in special.split(text) for p in PRE_TOKEN.findall(part)], found


class Block:
    """Documents read so far, their dictionary and frequencies."""

    def __init__(self, special: re.Pattern | None):
        self.special = special
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.columns: tuple[list, ...] = ([], [], [], [])  # id or 0, id is null, bytes, special strings
        self.profiles: list[tuple[np.ndarray, np.ndarray]] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        pieces, found = pre_tokens(text, self.special)
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int32, len(pieces))
        self.profiles.append(np.unique(codes, return_counts=True))
        for column, value in zip(self.columns, (doc_id or 0, doc_id is None, len(text.encode()), found), strict=True):
            column.append(value)
        self.chars += len(text) + 64

    def packed(self) -> bytes:
        """Size of the dictionary, documents, lengths of their profiles, code steps and frequencies."""
        steps = [np.diff(c, prepend=0).astype(np.int32) for c, _ in self.profiles]
        parts = [np.array([len(self.codes), len(steps)], np.int64), *(np.array(c, np.int64) for c in self.columns), np.array([len(s) for s in steps], np.int64)]
        parts += [np.concatenate(steps), np.concatenate([n for _, n in self.profiles]).astype(np.int32)]
        return pack(*parts)

    def rows(self, number: int, parts: int) -> Iterator[pa.RecordBatch]:
        raw = [p.encode() for p in self.codes]
        part = np.fromiter((zlib.crc32(p) % parts for p in raw), np.int32, len(raw))
        order = np.argsort(part, kind="stable")
        names, starts = np.unique(part[order], return_index=True)
        for name, codes in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
            own = [raw[k] for k in codes.tolist()]
            lengths = np.fromiter(map(len, own), np.int32, len(own))
            yield _batch(number, name, pack(np.array([len(own)], np.int64), codes.astype(np.int32), lengths, b"".join(own)))
        yield _batch(number, -1, self.packed())


def pack(*parts: np.ndarray | bytes) -> bytes:
    return zlib.compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts), 1)


def _batch(block: int, part: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["block", "part", "packed"])


def entries(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Codes and pre-tokens of a dictionary row."""
    data = zlib.decompress(packed)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    codes, lengths = np.frombuffer(data, np.int32, 2 * n, 8).reshape(2, n)
    ends = (np.cumsum(lengths, dtype=np.int64) + 8 + 8 * n).tolist()
    return codes, [data[a:b] for a, b in zip([8 + 8 * n, *ends], ends, strict=False)]


def totals(packed: bytes, counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """id, id is null, bytes, tokens of a block's documents; counts: codes and their tokens."""
    data = zlib.decompress(packed)
    size, n = np.frombuffer(data, np.int64, 2).tolist()
    known = np.zeros(size, np.int64)
    for codes, tokens in counts:
        known[codes] = tokens
    doc_id, missing, n_bytes, found, lengths = np.frombuffer(data, np.int64, 5 * n, 16).reshape(5, n)
    steps, times = np.frombuffer(data, np.int32, -1, 16 + 40 * n).reshape(2, -1)
    sums, ends = np.cumsum(steps, dtype=np.int64), np.cumsum(lengths)
    starts = ends - lengths
    codes = sums - np.repeat(np.where(starts > 0, sums[starts - 1], 0), lengths) if len(sums) else sums
    tokens = np.concatenate(([0], np.cumsum(known[codes] * times.astype(np.int64))))
    return doc_id, missing.astype(bool), n_bytes, found + tokens[ends] - tokens[starts]


def profiles(docs: DataFrame, special: re.Pattern | None, parts: int) -> DataFrame:
    """Dictionary and documents of each block, as PROFILE says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, block, made = TaskContext.get().partitionId() << 32, Block(special), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                block.add(doc_id.as_py(), text.as_py() or "")
                if block.chars > BLOCK_CHARS:
                    yield from block.rows(first + made, parts)
                    block, made = Block(special), made + 1
        if block.profiles:
            yield from block.rows(first + made, parts)

    return docs.mapInArrow(run, PROFILE)


def counted(dictionary: DataFrame, vocabulary: str) -> DataFrame:
    """The dictionary rows with codes and their tokens; each distinct pre-token is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            for block, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, known = part, {}
                codes, pieces = entries(packed)
                fresh = [p for p in pieces if p not in known]
                known.update(zip(fresh, counter(vocabulary).count([p.decode() for p in fresh]), strict=True))
                tokens = np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))
                yield _batch(block, part, pack(np.stack((codes, tokens))))

    return dictionary.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, PROFILE)


def summed(rows: DataFrame, limit: int) -> DataFrame:
    """The documents of each block with their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part >= 0:
                    counts.append(tuple(np.frombuffer(zlib.decompress(packed), np.int32).reshape(2, -1)))
                    continue
                doc_id, missing, n_bytes, tokens = totals(packed, counts)  # a block's documents come behind its counts
                counts = []
                columns = [pa.array(doc_id, mask=missing), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.repartition("block").sortWithinPartitions("block", F.col("part").desc()).mapInArrow(run, OUT)


def whole_texts(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """Text by text, for vocabularies whose counts don't add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = library.count(texts)
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, OUT)


class SentencePieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]


_COUNTERS: dict[str, ByteLevel | SentencePieceModel] = {}


def counter(path: str) -> ByteLevel | SentencePieceModel:
    """The worker's counter for a vocabulary: .json or .model."""
    if path not in _COUNTERS:
        _COUNTERS[path] = SentencePieceModel(path) if path.endswith(".model") else ByteLevel(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    vocabulary: the path of the vocabulary file, the same on every machine.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fits, special = (False, None) if vocabulary.endswith(".model") else additive(vocabulary)
    if not fits:
        return whole_texts(rows, vocabulary, limit)
    spark = docs.sparkSession
    root = scratch(spark, "token-profiles")
    profiles(rows, special, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(root)
    told = spark.read.parquet(root)
    return summed(counted(told.filter("part >= 0"), vocabulary).union(told.filter("part < 0")), limit)
