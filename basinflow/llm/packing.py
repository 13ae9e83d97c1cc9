"""Packing by power-of-two decomposition.

A document becomes token ids plus one end id. It is cut into pieces of
``max_len`` (a power of two) and the binary expansion of what is left, largest
first: 1,300 ids with ``max_len`` 1,024 give 1,024 + 256 + 16 + 4. Every piece is
a sequence of its own, so no sequence crosses documents and none is padded;
sequences of one length form a bucket, and batches are drawn from buckets.

Everything about a document happens in its own row, so nothing is grouped and a
hot source costs nothing. The finished rows are dealt in order of length to tasks, none
of which gets much over twice its share of rows or of tokens: this brings the buckets
together and splits a bucket of any size.

Defined results: a null or empty text has only its end id (one piece of one
token); repeated rows are packed one by one; rows with a null doc_id keep it; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import materialize, parallelism, read_table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc_row long"
#: A text on which a fast encoder must agree with the tokenizer file before it is used.
PROBE = "It's 12 o'clock;  don't\n\n\tgo!  Été naïve 你好 क्ष \U0001f600 x  \r\n < | > end "


@lru_cache(maxsize=2)
def encoder(path: str | None):
    """texts -> lists of ids for a ``tokenizers`` file (default: the public byte-level BPE).

    A byte-level BPE whose ids are its merge ranks is run by ``tiktoken`` over the
    vocabulary read from that same file, four times as fast; texts that hold an
    added token, any other file, or one on which the two disagree, are run by
    ``tokenizers`` itself.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)

    def slow(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in exact.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    step = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or spec.get("normalizer"):
        return slow
    import tiktoken

    added = [t["content"] for t in spec["added_tokens"]]
    back = _byte_alphabet()
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if [fast.encode_ordinary(PROBE)] != slow([PROBE]):
        return slow

    def encode(texts: list[str]) -> list[list[int]]:
        # ``tiktoken`` knows no added tokens: texts that hold one are left to ``tokenizers``.
        held = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        own = dict(zip(held, slow([texts[i] for i in held]))) if held else {}
        return [own[i] if i in own else fast.encode_ordinary(t) for i, t in enumerate(texts)]

    return encode


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_lengths(n: int, max_len: int) -> list[int]:
    """``max_len`` as often as it fits, then the binary expansion of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], max_len: int, path: str | None, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    row = number
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo in range(0, len(texts), 256):  # few token lists are alive at a time
            out: list[tuple] = []
            bodies = []
            for doc, ids in zip(docs[lo : lo + 256], encode([t or "" for t in texts[lo : lo + 256]])):
                raw = np.append(np.array(ids, "<u4"), np.uint32(end_id)).astype("<u4")
                start = 0
                for length in piece_lengths(len(raw), max_len):
                    piece = raw[start : start + length]
                    out.append((doc, start, length, zlib.crc32(piece.tobytes()), len(raw), number, 0, row))
                    if with_ids:
                        bodies.append(piece.astype("<i4"))
                    start += length
                    number += 1
                row += 1
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_row"]
            if with_ids:
                cols.append(pa.array(bodies, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(cols, names=names)
            del cols, bodies
            pa.default_memory_pool().release_unused()  # workers live on; what this stage needed is given back


def _by_bucket(pieces: DataFrame, n: int) -> DataFrame:
    """``pieces`` in ``n`` partitions, buckets in order of length, each spread by a hash.

    A bucket's share of the partitions is the mean of its shares of rows and of tokens, so a partition has about two n-ths of either at most.
    """
    sizes = sorted(tuple(r) for r in pieces.groupBy("length").agg(F.count("*"), F.sum("length")).collect())  # a row per power of two
    if not sizes:
        return pieces
    rows, tokens = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
    begin, spans = 0.0, []
    for length, r, t in sizes:
        share = (r / rows + t / tokens) / 2
        spans += [F.lit(length), F.struct(F.lit(begin).alias("begin"), F.lit(share).alias("share"))]
        begin += share
    span = F.create_map(*spans)[F.col("length")]
    steps = 1 << 30
    place = span["begin"] + span["share"] * F.pmod(F.xxhash64("sequence_id"), F.lit(steps)) / steps
    return pieces.repartitionById(n, F.least(F.floor(place * n), F.lit(n - 1)).cast("int"))


def pack_documents(
    docs: DataFrame, max_len: int = 1024, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True
) -> DataFrame:
    """A row per piece with its token ids (``ids array<int>``); without ``with_ids`` only their digest.

    ``sequence_id`` is the map task's number in the upper bits and a counter below,
    so it is unique without a shuffle and the same when a lost task runs again.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = texts.mapInArrow(lambda it: _pack(it, max_len, tokenizer, end_id, with_ids), schema)
    # Bucket sizes are found by a first pass over the pieces: written down, texts are encoded once.
    return _by_bucket(materialize(pieces, "pieces"), parallelism(docs.sparkSession)).sortWithinPartitions("length", "sequence_id")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), max_len=1024)  # with ids, of which the query shows the digest
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
