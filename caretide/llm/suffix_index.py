"""Removal of long repeated byte strings with a logarithmic family of sorted indexes.

Documents come in batches of rising id. A batch gets its own sorted array of anchored strings, which is merge-scanned
against the levels of the index for long matches; what is new in it becomes a level, and levels of equal size are
merged, so there are never more levels than the logarithm of the number of batches.

A full suffix array would hold an entry per byte. As matches below WIDTH bytes do not count, the arrays here are sparse:
an entry is a run of windows with one content-chosen anchor (see ``anchors``), sorted by the hashes of the anchor and of
the run's bytes instead of by the bytes themselves, which is enough to meet equals. Equal runs settle all their windows
at once, the first document keeping them. Where one anchor stands in different runs (the ends of a shared passage, an
edited copy), the windows themselves are hashed (128 bits), sorted and scanned in the same way. Results are those of
comparing every window with every other.

Each task first settles what repeats within its own batch of rows and sends one entry for it; scans hold one row of
state, however often a string occurs.
"""

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from caretide.llm.anchors import rolling, runs
from caretide.llm.common import ROW, drop_stored, ids_are_unique, stored, unique_rows, with_ids, without_ids
from caretide.llm.textbytes import flat, mixed, slices

#: Bytes of a string that counts, and of the anchor inside it.
WIDTH, GRAM = 100, 32
#: Batches that a whole table is added in, whatever its size: the first two levels merge into one, and the last batch is
#: scanned against a level of two batches and one of a single batch. Every batch is scanned against all that came before, so
#: n batches cost about (n + 1) / 2 passes over all entries.
BATCHES = 4
#: Parts, by anchor, that the windows of edges are shuffled in, one after the other, so that only a part of the shuffle is
#: on disk at once. Equal windows have equal anchors, so no match crosses parts.
PARTS = 6
#: Bytes of text whose repeats are settled within a task.
CHUNK = 8 << 20

OTHER_BASE = 0xD6E8FEB86659FD93
DUPLICATE, NEW, EDGE = 0, 1, 2
ENTRY = "a long, r long, doc_id long, start long, count long"


def _first_of(keys: tuple[np.ndarray, ...], order: np.ndarray) -> np.ndarray:
    """Whether each row, in this order, differs from the one before it in some key."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return new


def entries(docs: DataFrame) -> DataFrame:
    """Runs of every document: new false for those that an earlier run of the same task equals (already settled)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, offsets = flat(part.column("text"))
                found = runs(data, offsets, WIDTH, GRAM)
                ids = part.column("doc_id").to_numpy()[found["text"]]
                order = np.lexsort((found["start"], ids, found["region"], found["anchor"]))
                new = _first_of((found["anchor"], found["region"]), order)
                yield pa.record_batch(
                    [
                        pa.array(found["anchor"][order].view(np.int64)),
                        pa.array(found["region"][order].view(np.int64)),
                        pa.array(ids[order]),
                        pa.array(found["start"][order]),
                        pa.array(found["count"][order]),
                        pa.array(new),
                    ],
                    names=["a", "r", "doc_id", "start", "count", "new"],
                )

    return docs.select("doc_id", "text").mapInArrow(find, ENTRY + ", new boolean")


def merge_scan(batch: DataFrame, levels: list[DataFrame], keep_new: bool) -> DataFrame:
    """One sorted pass over a batch and all levels: (kind, entry) rows.

    DUPLICATE: a run of the batch that occurs earlier. NEW (if wanted): a run that no level has. EDGE: the first
    occurrence of a run whose anchor also stands in another run.
    """
    own = batch.withColumn("fresh", F.lit(True))
    for level in levels:
        own = own.unionByName(level.withColumn("fresh", F.lit(False)))
    names = ["a", "r", "doc_id", "start", "count"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the anchor and run met last, and the first entry of the anchor's first run until another run turns up
        last, waiting = None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            a, r = rows.column("a").to_numpy(), rows.column("r").to_numpy()
            fresh = rows.column("fresh").to_numpy(zero_copy_only=False)
            new_a = np.append(last is None or last[0] != a[0], a[1:] != a[:-1])
            first = new_a.copy()
            first[0] |= last is None or last[1] != r[0]
            first[1:] |= r[1:] != r[:-1]
            # further runs of an anchor are edges at once, its first run when the second comes
            group = np.cumsum(new_a)  # 0: the anchor met last goes on
            further = first & ~new_a
            with_more = np.zeros(group[-1] + 1, bool)
            with_more[group[further]] = True
            edge = further | (new_a & with_more[group])
            kinds = [(np.flatnonzero(~first & fresh), DUPLICATE), (np.flatnonzero(edge), EDGE)]
            if keep_new:
                kinds.append((np.flatnonzero(first & fresh), NEW))
            at = np.concatenate([k for k, _ in kinds])
            kind = np.repeat([v for _, v in kinds], [len(k) for k, _ in kinds]).astype(np.int32)
            out = rows.select(names).take(pa.array(at))
            yield pa.record_batch([pa.array(kind), *out.columns], names=["kind", *names])
            if with_more[0] and waiting is not None:
                yield pa.record_batch([pa.array([EDGE], pa.int32()), *waiting.columns], names=["kind", *names])
            if new_a.any():
                begin = int(np.flatnonzero(new_a)[-1])
                waiting = None if with_more[group[-1]] else pa.RecordBatch.from_pylist(rows.select(names).slice(begin, 1).to_pylist(), rows.select(names).schema)
            elif with_more[0]:
                waiting = None
            last = (a[-1], r[-1])

    dealt = own.repartition(_partitions(own.sparkSession), "a").sortWithinPartitions("a", "r", "doc_id", "start")
    return dealt.select(*names, "fresh").mapInArrow(scan, "kind int, " + ENTRY)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


class SuffixIndex:
    """Levels of known runs, the spans found so far and the edges to look at window by window."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def add(self, docs: DataFrame, more: bool = True) -> None:
        """Adds a batch whose ids are above all earlier ones. ``more``: whether further batches will come."""
        own = entries(docs)
        sent = stored(own, "runs")
        scanned = stored(merge_scan(sent.filter("new").drop("new"), [level for _, level in self.levels], more), "scanned")
        settled = stored(sent.filter("not new").select("doc_id", "start", "count"), "settled")
        drop_stored(sent)
        release(docs.sparkSession)
        self.found += [stored(scanned.filter(F.col("kind") == DUPLICATE).select("doc_id", "start", "count"), "found"), settled]
        self.edges.append(stored(scanned.filter(F.col("kind") == EDGE).drop("kind", "r"), "edges"))
        if more:
            self.levels.append((1, stored(scanned.filter(F.col("kind") == NEW).drop("kind"), "level")))
        drop_stored(scanned)
        if more:
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (n, upper), (_, lower) = self.levels.pop(), self.levels.pop()
                both = lower.unionByName(upper).repartition(_partitions(docs.sparkSession), "a").sortWithinPartitions("a", "r")
                self.levels.append((2 * n, stored(both, "level")))
                drop_stored(upper, lower)
        release(docs.sparkSession)

    def spans(self, docs: DataFrame) -> DataFrame:
        """doc_id, start, count: runs of windows that occur earlier. ``docs`` holds all batches; the index ends here."""
        drop_stored(*(level for _, level in self.levels))
        self.levels.clear()
        edges = self.edges[0]
        for e in self.edges[1:]:
            edges = edges.unionByName(e)
        found = self.found[0]
        for f in self.found[1:]:
            found = found.unionByName(f)
        # an old run may have become an edge in several batches
        edges = edges.select("doc_id", "start", "count", F.pmod(F.xxhash64("a"), F.lit(PARTS)).alias("part")).distinct()
        per_doc = stored(edges.groupBy("doc_id").agg(F.collect_list(F.struct("part", "start", "count")).alias("edges")), "edges")
        texts = with_ids(docs.select("doc_id", "text"), per_doc.select("doc_id")).join(per_doc, "doc_id")
        hashed = stored(window_hashes(texts), "windows")
        for part in range(PARTS):
            found = found.unionByName(window_scan(hashed.filter(F.col("part") == part)))
        drop_stored(hashed, per_doc)
        return found


def window_hashes(texts: DataFrame) -> DataFrame:
    """Hashes of the windows of all edges, with their part: new false for those that an earlier window of the same task
    equals. ``texts``: doc_id, text and edges (part, start and count)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK // 16):
                data, offsets = flat(part.column("text"))
                lists = part.column("edges")
                inner = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                start, count = inner.field("start").to_numpy(), inner.field("count").to_numpy()
                own_part = np.repeat(inner.field("part").to_numpy(), count)
                owner = np.repeat(owner, count)
                within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(start, count) + within
                place = offsets[owner] + at
                w1, w2 = (mixed(rolling(data, WIDTH, *base)[place]) for base in ((), (OTHER_BASE,)))
                ids = part.column("doc_id").to_numpy()[owner]
                order = np.lexsort((at, ids, w2, w1))
                new = _first_of((w1, w2), order)
                yield pa.record_batch(
                    [*(pa.array(x[order]) for x in (own_part, w1.view(np.int64), w2.view(np.int64), ids, at)), pa.array(new)],
                    names=["part", "w1", "w2", "doc_id", "start", "new"],
                )

    return texts.mapInArrow(windows, "part long, w1 long, w2 long, doc_id long, start long, new boolean")


def window_scan(hashed: DataFrame) -> DataFrame:
    """Windows that an earlier window equals: doc_id, start, count (1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for rows in batches:
            if not rows.num_rows:
                continue
            w1, w2 = rows.column("w1").to_numpy(), rows.column("w2").to_numpy()
            again = np.append(last == (w1[0], w2[0]), (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]))
            last = (w1[-1], w2[-1])
            yield rows.select(["doc_id", "start"]).filter(pa.array(again))

    first = hashed.filter("new").select("w1", "w2", "doc_id", "start")
    dealt = first.repartition(_partitions(hashed.sparkSession), "w1").sortWithinPartitions("w1", "w2", "doc_id", "start")
    later = dealt.mapInArrow(scan, "doc_id long, start long").unionByName(hashed.filter("not new").select("doc_id", "start"))
    later = stored(later.withColumn("count", F.lit(1).cast("long")), "window-spans")
    release(hashed.sparkSession)
    return later


def covered(length: int, spans: np.ndarray) -> tuple[np.ndarray, int]:
    """Mask of the bytes inside windows of the spans (start, count), and the number of maximal runs of them."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1] + WIDTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone, int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, contents: bool = False) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256, with ``contents`` also kept_text (what is left,
    without the halves of characters that were cut).

    Removes every byte that a string of 100 bytes covers which also starts earlier: in a document of smaller id, or
    earlier in the same one. Null text: empty. Rows that share an id, repeated ones too, are documents of their own in the
    order of their texts. A null id: left as it is and compared with nothing. Empty table: no rows. Ids of any type that
    can be ordered. Other columns of ``docs`` are not read.
    """
    every = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = every.filter("doc_id is not null")
    if not isinstance(every.schema["doc_id"].dataType, IntegralType) or not ids_are_unique(known):
        rows = unique_rows(known)
        judged = remove_repeats(rows, ROW, "text", batches, contents).withColumnRenamed("doc_id", ROW)
        out = judged.join(rows.select(ROW, "doc_id"), ROW)
        return out.select("doc_id", *judged.columns[1:]).unionByName(_untouched(every.filter("doc_id is null"), contents))
    every = every.withColumn("doc_id", F.col("doc_id").cast("long"))
    narrow = every.filter("doc_id is not null")
    limits = narrow.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    limits = sorted(set(map(int, limits)))
    index = SuffixIndex()
    long_texts = narrow.filter(F.octet_length("text") >= WIDTH)
    for i in range(len(limits) + 1):
        batch = long_texts.filter(F.col("doc_id") < limits[i]) if i < len(limits) else long_texts
        batch = batch.filter(F.col("doc_id") >= limits[i - 1]) if i else batch
        index.add(batch, more=i < len(limits))
    spans = index.spans(long_texts)
    per_doc = stored(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("spans")), "spans")
    ids = per_doc.select("doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, t, s in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                data = np.frombuffer(t.as_py().encode(), np.uint8)
                pairs = np.stack([s.values.field("start").to_numpy(), s.values.field("count").to_numpy()], axis=1)
                gone, n = covered(len(data), pairs)
                left = data[~gone].tobytes()
                row = (own, len(data), int(gone.sum()), n, hashlib.sha256(left).hexdigest())
                out.append((*row, left.decode("utf-8", "ignore")) if contents else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * contents
            types = [pa.int64()] * 4 + [pa.string()] * (1 + contents)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * contents
    changed = with_ids(narrow, ids).join(per_doc, "doc_id").mapInArrow(cut, schema)
    same = without_ids(narrow, ids).unionByName(every.filter("doc_id is null"))
    return _untouched(same, contents).unionByName(changed)


def _untouched(rows: DataFrame, contents: bool) -> DataFrame:
    """Result rows of texts that keep all their bytes."""
    whole = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        F.octet_length(whole).cast("long").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2(whole.cast("binary"), 256).alias("kept_sha256"),
        *([whole.alias("kept_text")] if contents else []),
    )
