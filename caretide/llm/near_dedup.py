"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, connected components.

SuperMinHash (Ertl, 2017) gives each shingle a random permutation of the registers; rank j of it may set a register to
a value in [j, j + 1). A document stops as soon as all its registers lie below the next rank, so a long one needs a
step or two per shingle. Registers of one document differ in their ranks and so vary less than independent ones.

Documents with equal sets are one class from the start (pre-aggregated by fingerprint). Classes that share a band are
candidates. A band's members are compared with its least member first, then, while a band holds several components, each
class with one drawn member of another component in a few rounds; every comparison is a row, so rows grow with the classes
alone. Bands that still hold different components are settled exactly, block by block within tasks that return a link
only where it joins components. With 32 bands of 4 registers a pair of similarity 0.8 shares no band once in 10^7.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caretide.llm.common import stored, with_ids
from caretide.llm.components import components
from caretide.llm.textbytes import flat, mixed, slices, word_hashes

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Similarity as a percentage: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Words in a shingle.
WORDS = 2
#: Bytes of text worked on at a time.
CHUNK = 2 << 20
#: Rounds in which classes of open bands are compared with a drawn member before bands are settled exactly.
ROUNDS = 3
#: Shingles of a block of classes in a band (a longer set is a block alone), sets compared at a time within a task, and
#: shingles multiplied at a time.
BLOCK, TILE, COLUMNS = 1 << 18, 256, 4096

U64 = np.uint64
_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def shingle_sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; of fewer words, the whole sequence is one shingle."""
    data, offsets = flat(batch.column("text"))
    hashes, sizes = word_hashes(data, offsets)
    rolled = hashes.copy()
    for i in range(1, words):
        rolled[: len(hashes) - i] = mixed(rolled[: len(hashes) - i] * U64(31)) + hashes[i:]
    out, at = [], 0
    for n in sizes:
        own = hashes[at : at + n]
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            short = own[:1].copy()
            for i in range(1, n):
                short = mixed(short * U64(31)) + own[i : i + 1]
            out.append(mixed(short + U64(n)))
        else:
            out.append(own)
        at += n
    return out


def super_minhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers (sets x m): rank in the upper, random fraction in the lower 32 bits. All ones for an empty set."""
    registers = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return registers.reshape(0, m)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    drawn: list[np.ndarray] = []
    for j in range(m):
        u = mixed(element + U64(_STEP * (j + 1) & _ALL))
        k = (U64(j) + (u & U64(0xFFFFFFFF)) % U64(m - j)).astype(np.int16)
        place = k.copy()  # what earlier swaps of the shuffle have put at k
        for i in range(j - 1, -1, -1):
            np.putmask(place, drawn[i] == place, np.int16(i))
        np.minimum.at(registers, owner * m + place, (U64(j) << U64(32)) | (u >> U64(32)))
        drawn.append(k)
        open_set = registers.reshape(-1, m).max(axis=1) >= (U64(j + 1) << U64(32))
        still = open_set[owner]
        if not still.all():
            element, owner, drawn = element[still], owner[still], [d[still] for d in drawn]
        if not len(element):
            break
    return registers.reshape(-1, m)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = registers.reshape(len(registers), bands, registers.shape[1] // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U64(_STEP), rows.shape[:2])
    for i in range(rows.shape[2]):
        key = mixed(key + rows[:, :, i])
    return key


def fingerprints(sets: list[np.ndarray], seed: int) -> np.ndarray:
    return np.array([mixed(s ^ U64(seed)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (fingerprint of the set) and bands (their keys; none for an empty set)."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                sets = shingle_sets(part, words)
                full = np.array([len(s) > 0 for s in sets])
                keys = band_keys(super_minhash([s for s in sets if len(s)])).view(np.int64)
                ends = np.append(0, np.cumsum(full * BANDS)).astype(np.int32)
                prints = [fingerprints(sets, seed) for seed in (0, 0x5851F42D4C957F2D)]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *map(pa.array, prints),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return narrow.mapInArrow(sign, f"doc_id {id_type}, n long, f1 long, f2 long, bands array<long>")


def full_sets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, f1 and shingles: the whole set of each document."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                sets = shingle_sets(part, words)
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.record_batch([part.column("doc_id"), pa.array(fingerprints(sets, 0)), lists], names=["doc_id", "f1", "shingles"])

    return narrow.mapInArrow(sets_of, f"doc_id {id_type}, f1 long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""
    own = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
    both = own.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
    # the shorter set can at best be all of the intersection
    sized = 100 * F.least(F.size("a"), F.size("b")) >= similar * F.greatest(F.size("a"), F.size("b"))
    shared = F.size(F.array_intersect("a", "b"))
    near = F.when(sized, 100 * shared >= similar * (F.size("a") + F.size("b") - shared)).otherwise(F.lit(False))
    return both.filter(near).select("u", "v").distinct()


def drawn_pairs(rows: DataFrame, seed: int, similar: int) -> DataFrame:
    """Pairs (u, v): each class with one member, drawn in one of its bands, that is of another component and not too long
    or short. At most one pair for a class."""
    drawn = F.struct(F.xxhash64("rep", "key", F.lit(seed)).alias("h"), "rep", "c", "n")
    pivots = rows.groupBy("key").agg(F.max(drawn).alias("p")).select("key", F.col("p.rep").alias("v"), F.col("p.c").alias("d"), F.col("p.n").alias("m"))
    sized = 100 * F.least("n", "m") >= similar * F.greatest("n", "m")
    met = rows.join(pivots, "key").filter((F.col("c") != F.col("d")) & sized)
    one = met.groupBy("rep").agg(F.max(F.struct(F.xxhash64("key", F.lit(seed)).alias("h"), "v")).alias("one"))
    return one.select(F.col("rep").alias("u"), F.col("one.v").alias("v"))


def open_bands(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """key, rep, n and c (its component) in bands that hold several components."""
    rows = bands.select("key", "rep", "n").join(labels, "rep")
    several = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    return stored(rows.join(several.select("key"), "key"), "open-bands")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rep, c) after further links (u, v) between classes: only the components that links join are looked at."""
    ends = links.join(labels.withColumnRenamed("rep", "u").withColumnRenamed("c", "cu"), "u")
    ends = ends.join(labels.withColumnRenamed("rep", "v").withColumnRenamed("c", "cv"), "v")
    found = components(ends, "cu", "cv").select(F.col("node").alias("c"), "component")
    return stored(labels.join(found, "c", "left").select("rep", F.coalesce("component", "c").alias("c")), "labels")


def tile_shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: sums of small matrix products over shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1  # what only one set has adds to no intersection
    dense = (np.cumsum(times > 1) - 1)[column[several]]
    owner = owner[several]
    order = np.argsort(dense, kind="stable")
    dense, owner = dense[order], owner[order]
    # a product of 0 and 1 over COLUMNS shingles is exact in 32 bits, their sum needs more
    shared = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(dense[-1]) + 1 if len(dense) else 0, COLUMNS):
        a, b = np.searchsorted(dense, [at, at + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[a:b], dense[a:b] - at] = 1
        shared += (block @ block.T).astype(np.int64)
    return shared


def block_links(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, cross: bool, similar: int) -> list[tuple[int, int]]:
    """Pairs of similar sets of different components, as many as join what similar sets of different components join.

    ``cross``: only sets of different sides are held against each other. Sets go by size in tiles; two tiles are skipped
    if their sizes are too far apart or if all of them are one component by now.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    root = np.arange(int(component.max()) + 1)
    links = []
    tiles = [order[at : at + TILE] for at in range(0, len(order), TILE)]
    for i, one in enumerate(tiles):
        for other in tiles[: i + 1]:
            if 100 * sizes[other].max() < similar * sizes[one].min():
                continue
            both = one if other is one else np.concatenate([other, one])
            c = root[component[both]]
            if (c == c[0]).all() or (cross and (side[both] == side[both[0]]).all()):
                continue
            shared = tile_shared([sets[k] for k in both])
            near = 100 * shared >= similar * (sizes[both][:, None] + sizes[both][None, :] - shared)
            near &= c[:, None] < c[None, :]
            if cross:
                near &= side[both][:, None] != side[both][None, :]
            for u, v in np.argwhere(near).tolist():
                p, q = root[component[both[u]]], root[component[both[v]]]
                if p != q:
                    root[root == max(p, q)] = min(p, q)
                    links.append((int(both[u]), int(both[v])))
    return links


def linked_inside(rows: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links (u, v) that join the components of each open band as far as similar sets do.

    The classes of a band are dealt into blocks of about BLOCK shingles, and every two blocks meet in one task: a band whose
    sets fit into one block copies each of them once. What leaves a task is fewer links than it has components.
    """
    sized = rows.groupBy("key").agg(F.sum("n").alias("total"))
    dealt = rows.join(sized.select("key", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    full = dealt.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    copied = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = copied.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "c", "shingles")
    id_type = rows.schema["rep"].dataType.simpleString()

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        found = []
        for chunk in group.column("shingles").chunks:
            bounds, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
            found += [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        component = np.unique(np.array(group.column("c").to_pylist()), return_inverse=True)[1]
        pairs = block_links(found, component, group.column("own").to_numpy(), key[1].as_py() != key[2].as_py(), similar)
        ids = group.column("rep")
        u, v = (ids.take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1))
        return pa.table({"u": u, "v": v})

    return met.groupBy("key", "lo", "hi").applyInArrow(compare, f"u {id_type}, v {id_type}").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id it is linked to, directly or not) and kept.

    Null or blank text: empty set, linked with nothing, kept. Rows repeated with id and text count as one document;
    rows that share an id but not the text are linked through it. A null id: compared with nothing, component null, kept.
    Empty table: no rows. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(docs, "doc_id", "text", words).dropDuplicates(["doc_id", "n", "f1", "f2"]), "signatures")
    prints = ["n", "f1", "f2"]
    comparable = F.expr("n > 0 and doc_id is not null")
    classes = signed.filter(comparable).groupBy(*prints).agg(F.min("doc_id").alias("rep"))
    member = stored(signed.filter(comparable).select("doc_id", *prints, "bands").join(classes, prints), "classes")

    entries = member.filter(F.col("doc_id") == F.col("rep")).select("rep", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    bands = stored(entries.join(shared.select("key", "least"), "key").distinct(), "bands")
    candidates = stored(bands.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    sets = full_sets(with_ids(docs, candidates), "doc_id", "text", words)
    # an id may come with several texts; those that stand for a class are compared
    standing = member.filter(F.col("doc_id") == F.col("rep")).select("doc_id", "f1")
    sets = stored(sets.join(standing, ["doc_id", "f1"], "left_semi").dropDuplicates(["doc_id", "f1"]), "sets")

    star = bands.filter("rep > least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct()
    alone = candidates.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("c"))
    labels = relabelled(alone, stored(verified(star, sets, similar), "links"))
    for seed in range(ROUNDS):
        rows = open_bands(bands, labels)
        links = stored(verified(drawn_pairs(rows, seed, similar), sets, similar), "links")
        if links.isEmpty():
            break
        labels = relabelled(labels, links)
    rows = open_bands(bands, labels)
    labels = relabelled(labels, stored(linked_inside(rows, sets, similar), "links"))
    links = labels.filter("rep != c").select(F.col("rep").alias("u"), F.col("c").alias("v"))
    same = member.filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(links.unionByName(same.join(_several(member), F.col("u") == F.col("several"), "left_semi")))

    by_rep = found.withColumnRenamed("node", "rep")
    labelled = member.select("doc_id", *prints, "rep").join(by_rep, "rep", "left").select("doc_id", *prints, F.coalesce("component", "rep").alias("component_id"))
    out = signed.filter(~comparable).select("doc_id", *prints, F.col("doc_id").alias("component_id")).unionByName(labelled)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _several(member: DataFrame) -> DataFrame:
    """Ids that stand for more than one text, so that their classes are one component."""
    return member.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("doc_id").alias("several"))
