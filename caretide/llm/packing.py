"""Best-fit packing of tokenised documents with large-item matching.

Documents are tokenised once, each followed by an end token; one longer than the capacity is cut into full pieces, its
first piece taking the rest. What the packing needs is the histogram of piece lengths (at most ``capacity`` rows), and
the packing is planned on it: full pieces stand alone; pieces above a third of the capacity are matched greedily, the
largest with the largest that still fits, so at most two share a bin; all smaller pieces, in falling length, go to the
tightest gap. The plan says for each length which ranks go to which bins at which offset. Ranks within a length are
taken by salted windows, so a length that most documents share is spread over many tasks.
"""

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from caretide.llm.common import stored

CAPACITY = 2048
END_TOKEN = 0
#: Parts that the pieces of one length are ranked in.
SALTS = 64
#: Vocabulary file within the tokenizer folder; its added tokens stand in the JSON file of the same name.
VOCABULARY = "byte_bpe_50k.tiktoken"

_ENCODERS: dict[str, object] = {}


def public_tokenizers_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the vocabulary that a file of ranks belongs to; none if there is no JSON file beside it."""
    described = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as text:
        added = json.load(text)["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that match by what stands around them: {odd}")
    return {t["content"]: t["id"] for t in added}


def encoder(path: str | None = None):
    """Byte-level BPE from a file of ranks. Strings of added tokens become these tokens, as in ``tokenizers``. One per
    process and file."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers_path(VOCABULARY)
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))
    return _ENCODERS[path]


#: Runs of white space from this length on go to ``tokenizers``: the pattern of ranks backtracks over a run.
LONG_SPACE = re.compile(r"\s{50000}")


def encode(text: str, path: str | None = None) -> np.ndarray:
    """Ids of a text. ``tokenizers`` gives the same ones more slowly, and stands any run of white space."""
    ranks = path or public_tokenizers_path(VOCABULARY)
    if not LONG_SPACE.search(text):
        return encoder(ranks).encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
    described = os.path.splitext(ranks)[0] + ".json"
    if described not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[described] = Tokenizer.from_file(described)
    return np.array(_ENCODERS[described].encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece of n tokens."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(a, a + capacity) for a in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers)."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_TOKEN], np.uint32)
        for batch in batches:
            owner, rows = [], []
            for i, t in enumerate(batch.column("text")):
                ids = np.concatenate([encode(t.as_py() or "", path), end])
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for k, (a, b) in enumerate(cuts(len(ids), capacity)):
                    owner.append(i)
                    rows.append((k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return narrow.mapInArrow(pieces, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, number of ranks, first bin, offset) and the number of bins.

    Bins that hold the same lengths are handled as one group, so the work depends on the number of lengths, not of
    pieces.
    """
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    done: list[tuple[int, tuple]] = []  # number of bins, what they hold as nested (rest, length, times)
    gaps: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]

    def close(n: int, held: tuple | None, used: int) -> None:
        gaps[capacity - used].append((n, held))

    if left[capacity]:
        close(left[capacity], (None, capacity, 1), capacity)
    third = capacity // 3
    partner = capacity - 1
    for length in range(capacity - 1, third, -1):
        while left[length]:
            partner = min(length, capacity - length)
            while partner > third and not (left[partner] - (partner == length) > 0):
                partner -= 1
            if partner <= third:
                close(left[length], (None, length, 1), length)
                left[length] = 0
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                left[length] -= n
                left[partner] -= n
                close(n, ((None, length, 1), partner, 1), length + partner)
    for length in range(third, 0, -1):
        gap = length
        while left[length]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                times = capacity // length
                n, held, room = max(1, left[length] // times), None, capacity
            else:
                n, held = gaps[gap].pop()
                times, room = gap // length, gap
            full = min(n, left[length] // times)
            if full:
                gaps[room - times * length].append((full, (held, length, times)))
                left[length] -= full * times
            elif left[length]:  # the last few of this length share one bin
                gaps[room - left[length] * length].append((1, (held, length, left[length])))
                left[length], full = 0, 1
            if gap <= capacity and n > full:
                gaps[gap].append((n - full, held))
    for group in gaps:
        done += group
    slots, ranks, bins = [], [0] * (capacity + 1), 0
    for n, held in done:
        offset, parts = 0, []
        while held:
            held, length, times = held
            parts.append((length, times))
        for length, times in reversed(parts):
            for _ in range(times):
                slots.append((length, ranks[length], n, bins, offset))
                ranks[length] += n
                offset += length
        bins += n
    return slots, bins


def ranked(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds rank, from 0 and without gaps within each length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null and empty text: one piece, the end token alone. Ties in length go by document and piece. Repeated rows are
    packed each. Empty table: no rows. Other columns of ``docs`` are not read.
    """
    pieces = stored(tokenized_pieces(docs, doc_id, text, capacity, path), "pieces")
    lengths = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    slots, _ = plan({r["length"]: r["count"] for r in lengths}, capacity)
    table = np.array(sorted(slots) or [(0, 0, 0, 0, 0)], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(table)  # as many rows as kinds of bins have slots

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, bin_from, offset = sent.value.T
        keys = (length << 44) + first
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, "right") - 1
            own = [batch.column(c) for c in names]
            yield pa.record_batch([*own, pa.array(bin_from[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked(pieces).select(*names, "rank").mapInArrow(placed, out)
