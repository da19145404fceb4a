"""Phrase collocations by Toivonen's sampling: a sample proposes frequent phrases, one pass over all texts counts them and
their negative border exactly, and where a border phrase turns out frequent, further passes count what it opens.

A phrase is counted if both its start and its end, each one word shorter, are proposed; every single word is. So what is
counted is the proposed phrases and those just beyond them. What this pass finds frequent without having been proposed has
failed the border: the expansion pass counts the phrases that it opens, those that these open, and so on. A phrase that is
frequent has frequent parts alone, so after that none can be missing, and nothing is counted twice.

Proposals reach the tasks as a bit filter of bounded size: a filter never forgets a proposal, and what it lets through
besides is counted exactly like the rest. Counts are added up per chunk of text, per task and by shuffle, on the phrases
themselves.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from caretide.llm.common import stored
from caretide.llm.textbytes import BASE, BYTE_VALUE, INVERSE, LOWERED, cached_powers, mixed

#: Fixed by the result contract: words of a phrase, least frequency, reports per language, percentage of a phrase's
#: occurrences that a longer one must hold to replace it.
LONGEST, FREQUENT, REPORTED, ABSORBED = 5, 100, 2000, 100
#: One document in so many is sampled; a phrase is proposed if the sample holds this part of the frequency asked for.
SAMPLE, LOWERED_TO = 8, 0.4
#: Bits of the filter: so many per proposal, in powers of two between the bounds (at most 64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 29
#: Bits set for a proposal.
PROBES = 3
#: Bytes of text counted at a time; a task holds about sixty times that in arrays.
CHUNK = 3 << 18
#: Filter bits gathered in one row.
SLAB = 1 << 20

U64 = np.uint64
#: Byte classes: 0 inside a word, 1 between words, 2 between pieces of text.
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, 0x09]] = 1
CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Separates texts in a chunk; a class 2 byte.
END = b"\n"


def chunks(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bytes, language number of every text, offsets of texts are implied by END) in chunks of about CHUNK bytes. A longer
    text is cut between pieces."""
    held, owners, size = [], [], 0
    for text, lang in zip(texts, langs, strict=True):
        data = text.as_py() or b""
        at = 0
        while at < len(data):
            to = len(data)
            if to - at > CHUNK:
                found = np.flatnonzero(CLASS[np.frombuffer(data, np.uint8, len(data) - at - CHUNK, at + CHUNK)] == 2)
                to = at + CHUNK + int(found[0]) if len(found) else len(data)
            held.append(data[at:to])
            owners.append(lang.as_py())
            size += to - at
            at = to
            if size >= CHUNK:
                yield held, owners
                held, owners, size = [], [], 0
    if held:
        yield held, owners


class Words:
    """The words of a chunk of texts: their hashes, their pieces, and their bytes with one space behind each."""

    def __init__(self, texts: list[bytes], codes: np.ndarray) -> None:
        data = LOWERED[np.frombuffer(END.join(texts) + END, np.uint8)]
        kind = CLASS[data]
        inside = kind == 0
        edges = np.diff(inside.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.size = ends - starts
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, starts)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.code = codes[np.searchsorted(text_ends, starts, "right")]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * cached_powers(INVERSE, len(data)), out=sums[1:])
        self.hash = mixed((sums[ends] - sums[starts]) * cached_powers(BASE, len(data))[starts] + self.size.astype(np.uint64))
        # every word is followed by a separator: its first byte becomes the space
        kept = inside.copy()
        kept[ends] = True
        data = np.where(inside, data, 0x20).astype(np.uint8)
        self.data = data[kept]
        self.start = np.append(0, np.cumsum(self.size + 1))

    def __len__(self) -> int:
        return len(self.size)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each length, the hashes of the phrases that start at every word, language included; the last words have
        none. Whether a phrase stays within a piece is not asked."""
        rolled = mixed(self.hash + self.code)
        for k in range(1, longest + 1):
            yield k, rolled
            rolled = mixed(rolled[:-1] * U64(31)) + self.hash[k:]

    def within(self, k: int) -> np.ndarray:
        """Words at which a phrase of k words of one piece starts."""
        n = len(self) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, bool)

    def spelled(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that start at the given words."""
        a, b = self.start[at], self.start[at + k] - 1
        offsets = np.append(0, np.cumsum(b - a))
        source = np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[source])])


def _lang_code(lang: str) -> int:
    """A 64-bit number of a language, the same in every task."""
    data = np.frombuffer(lang.encode(), np.uint8)
    return int(mixed((BYTE_VALUE[data] * cached_powers(BASE, len(data))).sum(keepdims=True, dtype=np.uint64) + U64(len(data)))[0])


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        hashes = mixed(hashes + U64(i + 1))
        yield hashes >> U64(64 - bits)


class Filter:
    """A set of phrase hashes that may hold more than was put in, never less."""

    def __init__(self, packed: bytes) -> None:
        self.packed = np.frombuffer(packed, np.uint8)
        self.bits = (len(packed) * 8).bit_length() - 1

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in _probes(hashes, self.bits):
            out &= (self.packed[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _opened(words: Words, k: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Words at which a phrase of k words starts whose start and end, each one word shorter, are known."""
    n = max(0, len(words) - k + 1)
    return known[k - 1][:n] & known[k - 1][1 : n + 1] if k > 1 else np.ones(n, bool)


def counted(docs: DataFrame, shortest: int, longest: int, now: Broadcast | None, before: Broadcast | None, onwards: bool = False) -> DataFrame:
    """lang, k, phrase and f: exact counts of the phrases of ``shortest`` to ``longest`` words that ``now`` opens and
    ``before`` does not. Without ``now`` all phrases are counted. ``onwards``: what is opened opens further phrases. With
    single words comes k = 0, the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if b is None else Filter(b.value) for b in (now, before)]
        for batch in batches:
            for texts, langs in chunks(batch.column("text"), batch.column("lang")):
                names = sorted(set(langs))
                codes = np.array([_lang_code(x) for x in names], np.uint64)
                number = {x: i for i, x in enumerate(names)}
                owner = np.array([number[x] for x in langs])
                words = Words(texts, codes[owner])
                lang_of = np.searchsorted(np.sort(codes), words.code)
                by_code = np.argsort(codes)
                if not len(words):
                    continue
                known: list[dict[int, np.ndarray]] = [{}, {}]
                for k, hashes in words.phrases(longest):
                    wanted = words.within(k)
                    if filters[0] is not None:
                        wanted = wanted & _opened(words, k, known[0])
                    if filters[1] is not None:
                        wanted = wanted & ~_opened(words, k, known[1])
                    for f, held in zip(filters, known, strict=True):
                        if f is not None and k < longest:
                            # a phrase can only be known where its own start and end are
                            held[k] = np.zeros(len(hashes), bool)
                            open_at = np.flatnonzero(_opened(words, k, held))
                            held[k][open_at] = f.holds(hashes[open_at])
                    if onwards and k < longest and k >= shortest:
                        known[0][k] |= wanted
                    if k < shortest:
                        continue
                    at = np.flatnonzero(wanted)
                    _, first, times = np.unique(hashes[at], return_index=True, return_counts=True)
                    first = at[first]
                    if k == 1 and before is None:
                        per_lang = np.bincount(lang_of, minlength=len(names))
                        yield _rows(pa.array([names[by_code[i]] for i in range(len(names))]), 0, pa.array([b""] * len(names), pa.large_binary()), per_lang)
                    if len(first):
                        langs_of = pa.DictionaryArray.from_arrays(pa.array(by_code[lang_of[first]].astype(np.int32)), pa.array(names))
                        yield _rows(langs_of.cast(pa.string()), k, words.spelled(first, k), times)

    rows = docs.mapInArrow(count, "lang string, k int, phrase string, f long")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def _rows(lang: pa.Array, k: int, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    # bytes of valid UTF-8 cut at ASCII separators stay valid
    text = pc.cast(phrase, pa.large_string(), safe=False).cast(pa.string())
    return pa.record_batch([lang, pa.array(np.full(len(lang), k, np.int32)), text, pa.array(f.astype(np.int64))], names=["lang", "k", "phrase", "f"])


def proposed_filter(phrases: DataFrame) -> Broadcast:
    """The bit filter of (lang, phrase), made in slabs by Spark and put together on the driver: bounded by MOST_BITS."""
    n = max(1, phrases.count())
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            rows = [(lang, phrase.encode()) for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            if rows:
                words = Words([p for _, p in rows], np.array([_lang_code(lang) for lang, _ in rows], np.uint64))
                firsts = np.append(0, np.cumsum(np.array(batch.column("k").to_pylist())))[:-1]
                sizes = np.array(batch.column("k").to_pylist())
                for k, hashes in words.phrases(int(sizes.max())):
                    at += list(_probes(hashes[firsts[sizes == k]], bits))
            found = np.unique(np.concatenate(at)) if at else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array((found // U64(SLAB)).astype(np.int32)), pa.array((found % U64(SLAB)).astype(np.int32))], names=["slab", "place"])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        slab = np.zeros(SLAB, np.uint8)
        slab[rows.column("place").to_numpy()] = 1
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([np.packbits(slab, bitorder="little").tobytes()], pa.binary())})

    slabs = phrases.select("lang", "k", "phrase").mapInArrow(places, "slab int, place int").distinct()
    packed = bytearray((1 << bits) // 8)
    for row in slabs.groupBy("slab").applyInArrow(pack, "slab int, packed binary").collect():
        packed[row["slab"] * SLAB // 8 : (row["slab"] + 1) * SLAB // 8] = row["packed"]
    return phrases.sparkSession.sparkContext.broadcast(bytes(packed))


def _part(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def frequencies(docs: DataFrame, longest: int, frequent: int, sample: int, lowered: float, lang: str, text: str) -> DataFrame:
    """lang, k, phrase, f of every phrase of up to ``longest`` words with f >= frequent, and the words as k = 0."""
    narrow = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"), *_salt(docs))
    least = max(1, int(frequent / sample * lowered))
    part = narrow.filter(F.pmod("salt", F.lit(sample)) == 0).drop("salt")
    narrow = narrow.drop("salt")
    proposed = stored(_at_least(counted(part, 1, 2, None, None), least), "proposed")
    # longer phrases of the sample: only those whose parts are frequent there
    longer = counted(part, 3, longest - 1, proposed_filter(proposed), None, onwards=True)
    proposed = proposed.unionByName(stored(_at_least(longer, least), "proposed")).select("lang", "k", "phrase")
    now = proposed_filter(proposed)
    found = stored(counted(narrow, 1, longest, now, None).filter((F.col("k") == 0) | (F.col("f") >= frequent)), "frequent")
    failed = found.filter(F.col("k").between(1, longest - 1)).join(proposed, ["lang", "k", "phrase"], "left_anti")
    failed = stored(failed.select("lang", "k", "phrase"), "border-failures")
    if failed.isEmpty():
        return found
    more = counted(narrow, 2, longest, proposed_filter(proposed.unionByName(failed)), now, onwards=True)
    return found.unionByName(stored(_at_least(more, frequent), "frequent"))


def _at_least(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter((F.col("k") > 0) & (F.col("f") >= least))


def _salt(docs: DataFrame) -> list[Column]:
    """Deals rows to the sample by all of their simple columns, so that copies of a text are dealt each by itself."""
    simple = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.simpleString() in ("bigint", "int", "string", "double", "boolean")]
    return [F.xxhash64(*simple).alias("salt")]


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    frequent: int = FREQUENT,
    reported: int = REPORTED,
    absorbed: int = ABSORBED,
    sample: int = SAMPLE,
    lowered: float = LOWERED_TO,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``reported`` phrases of each language that stand together most.

    Null language: ``und``, together with texts of that language. Null, empty and wordless texts hold no phrase. Repeated
    rows count each. Ties of score go by frequency, then by the phrase's bytes. A language without frequent phrases has no
    rows, nor has an empty table. Equality of phrases within a chunk of text rests on 64-bit hashes, everywhere else on
    the phrases. Other columns only deal rows to the sample.
    """
    f = frequencies(docs, longest, frequent, sample, lowered, lang, text)
    n = f.filter("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = f.filter("k > 0")
    candidates = known.filter("k > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    k = F.col("k")
    # the longer phrase that matters is one word longer: what holds all of a phrase's occurrences has parts that do, too
    inside = candidates.filter("k > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(_part(F.lit(1), k - 1), _part(F.lit(2), k))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(absorbed) * F.col("a")))
    cut = kept.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, k).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(n, "lang")
    wide = "decimal(19,0)"
    score = F.expr(f"cast(1000 * cast(a as {wide}) * cast(n as {wide}) as decimal(38,0)) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    scored = scored.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reported)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
