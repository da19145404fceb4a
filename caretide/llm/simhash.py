"""SimHash near duplicates: fingerprints of word shingles, linked where few bits differ, compared bit-sliced.

Equal fingerprints are one class from the start, so copies never meet each other. Fingerprints are cut into ``pieces`` of
bits; two that differ in at most ``RADIUS`` bits agree in the rest of the pieces, so every choice of that many pieces is a
table of its own, and candidates share a bucket of one of them. The number of pieces follows the number of distinct
fingerprints, which sets the size of the buckets and never the result.

A bucket is dealt into blocks of about ``BLOCK`` fingerprints, and every two blocks of a bucket meet in one row. There, one
side is stored as vertical bit planes of 64 lanes a word: for a fingerprint of the other side each plane adds the
differing bit to all lanes at once, in carry-save counters that overflow just beyond the radius. Words whose lanes have all
overflowed are abandoned. What leaves a row is at most one link for a fingerprint.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from caretide.llm.common import stored
from caretide.llm.components import components

#: Words in a shingle, and the differing bits up to which fingerprints are linked.
WORDS, RADIUS = 4, 4
#: Fixed by the result contract.
SEED = 42
#: Fingerprints of a block, and those that a bucket should have on average when the number of pieces is chosen.
BLOCK, BUCKET = 2048, 256
#: Bytes of text whose words are held at a time, and shingles counted at a time.
CHUNK, SHINGLES = 1 << 20, 1 << 16
#: Bit planes added between two looks at which words are still open.
PLANES = 8
#: Queries times words compared at a time.
CELLS = 1 << 17

U64 = np.uint64
ALL = U64(0xFFFFFFFFFFFFFFFF)
_SPACES = b" \t\n\x0b\x0c\r"


def _chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about CHUNK bytes of it at a time; a word is never cut."""
    at = 0
    while at < len(data):
        to = at + CHUNK
        if to < len(data):
            while to < len(data) and data[to] not in _SPACES:
                to += 1
        yield data[at:to].lower().split()
        at = to


def _hashed(words: list[bytes], size: int) -> np.ndarray:
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    at = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in at), np.uint64, len(words) - size + 1)


def shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles in order; fewer words than a shingle has are one shingle; none without words."""
    last: list[bytes] = []
    seen = 0
    for words in _chunks(data):
        words = last + words
        seen += len(words) - len(last)
        if len(words) >= size:
            yield _hashed(words, size)
            words = words[len(words) - size + 1 :] if size > 1 else []
        last = words
    if 0 < seen < size:
        yield _hashed(last, len(last))


def fingerprint(data: bytes, size: int = WORDS) -> int:
    """A bit is set if over half the shingles have it; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, size):
        for at in range(0, len(hashes), SHINGLES):
            part = hashes[at : at + SHINGLES].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch.column("text"))
            prints = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return narrow.mapInArrow(sign, f"doc_id {id_type}, fp long")


def pieces_for(n: int, radius: int = RADIUS) -> int:
    """Pieces into which fingerprints are cut: the fewest with which n random ones leave BUCKET in a bucket."""
    pieces = radius + 1
    while pieces < 16 and n > BUCKET << (64 * (pieces - radius) // pieces):
        pieces += 1
    return pieces


def tables(fp: Column, pieces: int, radius: int = RADIUS) -> Column:
    """(table, key) of every choice of pieces - radius pieces: the bits outside of it are cleared."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(bits, pieces - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 x words: bit i of lane j of a word is bit i of a fingerprint; the lanes past the end repeat the last one."""
    padded = np.concatenate([prints, np.repeat(prints[-1:], -len(prints) % 64)]).astype("<u8")
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def close(queries: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (query, word, lanes) with lanes within the radius; lanes is a bit mask, never zero.

    The counter of every lane starts so far below its end that the bit after ``radius`` ones carries out of it.
    """
    width = radius.bit_length()
    start = (1 << width) - (radius + 1)
    words = planes.shape[1]
    query, word = np.repeat(np.arange(len(queries)), words), np.tile(np.arange(words), len(queries))
    counters = [np.full(len(query), ALL if start >> i & 1 else U64(0)) for i in range(width)]
    over = np.zeros(len(query), np.uint64)
    # planes that are equal on both sides add nothing
    both = np.bitwise_or.reduce(queries) | np.bitwise_or.reduce(lanes_of(planes))
    alike = np.bitwise_and.reduce(queries) & np.bitwise_and.reduce(lanes_of(planes))
    differing = [i for i in range(64) if int(both & ~alike) >> i & 1]
    for at, plane in enumerate(differing):
        bit = (queries >> U64(plane)) & U64(1)
        carry = planes[plane][word] ^ (U64(0) - bit)[query]
        for c in counters:
            carried = c & carry
            c ^= carry
            carry = carried
        over |= carry
        if at % PLANES == PLANES - 1:
            kept = over != ALL
            if not kept.all():
                query, word, over = query[kept], word[kept], over[kept]
                counters = [c[kept] for c in counters]
            if not len(query):
                break
    kept = over != ALL
    return query[kept], word[kept], ~over[kept]


def lanes_of(planes: np.ndarray) -> np.ndarray:
    """The fingerprints that ``bit_planes`` has turned."""
    bits = np.unpackbits(planes.astype("<u8").view(np.uint8).reshape(64, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").reshape(-1).astype(np.uint64)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, root) that connect what the links (u, v) between 0 .. n - 1 connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, root[u], low)
        np.minimum.at(after, root[v], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def block_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between close fingerprints of a, or of a and b if b is given: a forest over what they connect."""
    other = a if b is None else b
    planes = bit_planes(other)
    step = max(1, CELLS // planes.shape[1])
    us, vs = [], []
    for at in range(0, len(a), step):
        query, word, lanes = close(a[at : at + step], planes, radius)
        cell, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        u, v = query[cell] + at, word[cell] * 64 + lane
        real = v < len(other)
        if b is None:
            real &= u != v
        us.append(u[real])
        vs.append(v[real] + (0 if b is None else len(a)))
    both = a if b is None else np.concatenate([a, b])
    linked, root = forest(len(both), np.concatenate(us), np.concatenate(vs))
    return both[linked], both[root]


def close_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all fingerprints (fp, distinct) differing in at most ``radius`` bits."""
    rows = prints.select("fp", F.inline(tables(F.col("fp"), pieces_for(prints.count(), radius), radius)))
    rows = stored(rows, "simhash-tables")
    bucket = ["table", "key"]
    large = rows.groupBy(*bucket).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    large = large.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy(*bucket, "blocks", "block").agg(F.collect_list("fp").alias("a"))
    blocks = stored(blocks.filter("blocks > 1 or size(a) > 1"), "simhash-blocks")
    several = blocks.filter("blocks > 1")
    other = several.select(*bucket, F.col("block").alias("later"), F.col("a").alias("b"))
    met = several.join(other, bucket).filter("block < later").select("a", "b")
    alone = blocks.select("a", F.lit(None).cast("array<long>").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                first = a.values.to_numpy().view(np.uint64)
                second = b.values.to_numpy().view(np.uint64) if b.is_valid else None
                found = block_links(first, second, radius)
                u.append(found[0])
                v.append(found[1])
            yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return alone.unionByName(met).mapInArrow(compare, "u long, v long").distinct()


def hexadecimal(fp: Column) -> Column:
    """Sixteen lowercase digits of a signed long, read as unsigned."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hexadecimal) and component_id, the least doc_id that links reach.

    Null text and text without words: fingerprint zero, linked like any other. Repeated rows: a row each, linked by their
    equal fingerprints. Rows that share an id but not the text: a fingerprint and component each. Null id: judged like
    any row, but never the least one; a component of null ids alone has a null component_id. Empty table: no rows. Other
    columns are not read.
    """
    signed = stored(fingerprints(docs, doc_id, text, words), "simhash")
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = components(stored(close_links(classes.select("fp"), radius), "simhash-links"))
    labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    labelled = stored(labelled, "simhash-labels")
    least = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    # a component that is one fingerprint needs no second look
    component = labelled.join(least, "c").select("fp", "component_id")
    out = signed.join(component, "fp")
    return out.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
