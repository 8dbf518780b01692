"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct shingles of `words` words (fewer words: the whole sequence as one; none: empty, linked
with nothing). Documents are linked if 100 * intersection >= percent * union.

1. Signatures (`SLOTS` values) by SuperMinHash: each shingle walks a permutation of the slots and offers the value
   step + fraction; all shingles of a batch take a step together, and a document stops once every slot holds a value below
   the next step. Equal sets collapse to one class by a 128-bit sum of shingle hashes.
2. Bands of `ROWS` slots. Buckets with the same lowest id become one family. A family of up to `LIMIT` classes with up to
   `ELEMENTS` shingles in all is settled in one task (a bounded group: intersections of whole sets as a matrix product, then union-find), which hands on a spanning
   forest. Larger families are never gathered or paired off: a family has a consensus C, the shingles of more than half of
   its members. With D(x) the difference of x and C, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles and are
   linked if that is at most share * (|x| + |y|). Let f(x) = |D(x)| - share * |x|. Every pair with f(x) + f(y) <= 0 is
   linked, and then both are linked with the member b of lowest f; so links from b to every x with f(b) + f(x) <= 0 (the
   core) stand for all of those. Any other link that counts has an end outside the core and needs at least
   (f(x) + f(y)) / 2 shared differences; by the prefix principle, both ends then hold one common element among the first few
   of their differences. Classes that share such an element are the next round's groups, with D in place of sets. An element
   is a difference for at most half of a family, so groups halve each round. No link between components is lost.
3. Links are confirmed on whole sets of 64-bit shingle hashes.
4. Components by alternating large-star and small-star rounds (union-find as joins) until nothing changes.

Links are between classes (rows of equal sets), whatever their doc_ids; rows that share a doc_id are one document for reachability,
so their classes are linked. component_id is the lowest doc_id of the component. Null or empty texts: 0 shingles, a component of
their own. A row with a null doc_id is a document: its component_id is the lowest doc_id it reaches, else null, and `keep_first`
drops it in the first case only. Repeated rows are answered each; `keep_first` keeps all rows of the lowest doc_id whose text is in
that component. Ties cannot arise: classes of one id are one component. An empty table gives an empty table. Very long texts need
memory for their own set. Extra columns pass; columns named lg_drop raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, binary_texts, bound_batches, check_free, extended, mix64, released, sieve, sieved, table

SLOTS, ROWS = 96, 4
BANDS = SLOTS // ROWS
SALTS = 32
#: Members of a group that one task settles, and their shingles.
LIMIT, ELEMENTS = 512, 8_000_000
#: Fixed: A-Z become a-z; words are split at the bytes 0x09-0x0D and 0x20.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within each, and the counts."""
    tokens = [t.translate(LOWER).split() for t in texts]
    known: dict[bytes, int] = {}
    for ts in tokens:
        for t in ts:
            if t not in known:
                known[t] = len(known)
    word_hash = np.fromiter((hash_bytes(w) for w in known), np.uint64, len(known))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    get = known.__getitem__
    ids = np.fromiter((get(t) for ts in tokens for t in ts), np.int64, int(lengths.sum()))
    h = word_hash[ids] if len(ids) else np.zeros(0, np.uint64)
    out, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    for i, n in enumerate(lengths.tolist()):
        if n:
            size = min(words, n)
            m = n - size + 1
            s = np.full(m, np.uint64(size), np.uint64)
            for k in range(size):
                s = mix64(s ^ h[at + k : at + k + m])
            s = np.unique(s)
            out.append(s)
            counts[i] = len(s)
            at += n
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def hash_bytes(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


#: Shingles whose walks over the slots are held at once (each takes 2 * SLOTS bytes).
WALKS = 40_000


def super_minhash(hashes: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures, a row for each document (rows of empty sets are meaningless)."""
    ends = np.cumsum(counts)
    out, at = [], 0
    while at < len(counts):
        start = ends[at] - counts[at]
        stop = max(at + 1, int(np.searchsorted(ends, start + WALKS, side="right")))
        out.append(signatures_of(hashes[start : ends[stop - 1]], counts[at:stop], slots))
        at = stop
    return np.concatenate(out) if out else np.zeros((0, slots))


def signatures_of(hashes: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    docs = len(counts)
    values = np.full(docs * slots, np.inf)
    owner = np.repeat(np.arange(docs), counts)
    state, own = hashes, owner
    perm = None
    for step in range(slots):
        if not len(own):
            break
        state = mix64(state)
        fraction = (state >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        pick = step + (mix64(state ^ np.uint64(step + 1)) % np.uint64(slots - step)).astype(np.int64)
        if step == 0:
            slot = pick
        elif perm is None:
            perm = np.broadcast_to(np.arange(slots, dtype=np.int16), (len(own), slots)).copy()
            first = picked_before
            rows = np.arange(len(own))
            perm[rows, first], perm[rows, 0] = perm[rows, 0].copy(), perm[rows, first].copy()
        if step:
            rows = np.arange(len(own))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, step]
            perm[rows, step] = slot
        np.minimum.at(values, own * slots + slot, step + fraction)
        worst = values.reshape(docs, slots).max(1)
        live = worst[own] >= step + 1
        if step == 0:
            picked_before = pick[live]
        state, own = state[live], own[live]
        if perm is not None:
            perm = perm[live]
    return values.reshape(docs, slots)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, bands): the class of equal sets, and a hash for each band (null for empty sets)."""

    def run(batches):
        for batch in batches:
            texts = binary_texts(batch.column(1))
            hashes, counts = shingle_hashes(texts, words)
            sums = class_sums(hashes, counts)
            sig = super_minhash(hashes, counts).view(np.uint64).reshape(len(texts), BANDS, ROWS)
            band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(texts), BANDS))
            for r in range(ROWS):
                band = mix64(band ^ sig[:, :, r])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), bands], ["doc_id", "n_shingles", "c1", "c2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, n_shingles long, c1 long, c2 long, bands array<long>")


def class_sums(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each set's hashes: equal sets have equal ones."""
    sums = np.zeros((2, len(counts)), np.uint64)
    if len(hashes):
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]
        for k in range(2):
            sums[k, some] = np.add.reduceat(mix64(hashes + np.uint64(k)), starts)
    return sums


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, c1, c2, n, s): sorted shingle hashes, with their number and their class."""

    def run(batches):
        for batch in batches:
            hashes, counts = shingle_hashes(binary_texts(batch.column(1)), words)
            sums = class_sums(hashes, counts).view(np.int64)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), pa.array(counts), sets], ["id", "c1", "c2", "n", "s"])

    return docs.select("id", "text").mapInArrow(released(run), "id long, c1 long, c2 long, n long, s array<long>")


def settle(ids: np.ndarray, sizes: np.ndarray, differences: list, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the members of one bounded group."""
    k = len(ids)
    lengths = np.fromiter(map(len, differences), np.int64, k)
    flat = np.concatenate(differences) if k else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(k), lengths)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((k, k), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for at in range(0, width, 8192):
        part = (column >= at) & (column < at + 8192)
        m = np.zeros((k, min(8192, width - at)), np.float32)
        m[owner[part], column[part] - at] = 1
        both += m @ m.T
    apart = lengths[:, None] + lengths[None, :] - 2 * both.astype(np.int64)
    linked = apart * (100 + percent) <= (sizes[:, None] + sizes[None, :]) * (100 - percent)
    root = list(range(k))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1))):
        rx, ry = find(int(x)), find(int(y))
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            edges.append((int(ids[x]), int(ids[y])))
    return edges


def settle_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of groups (g, id, n, d) of at most LIMIT members."""

    def run(group: pa.Table) -> pa.Table:
        d = group.column("d").combine_chunks()
        offsets, values = d.offsets.to_numpy(), d.values.to_numpy()
        edges = settle(group.column("id").to_numpy(), group.column("n").to_numpy(), [values[i:j] for i, j in zip(offsets, offsets[1:])], percent)
        return pa.table({"a": pa.array([min(e) for e in edges], pa.int64()), "b": pa.array([max(e) for e in edges], pa.int64())})

    return rows.select("g", "id", "n", "d").groupBy("g").applyInArrow(run, "a long, b long")


def salt():
    return F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")


def spread(small: DataFrame) -> DataFrame:
    """One row for each salt: a family's row reaches its members in as many tasks."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def judge_families(members: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame]:
    """Large groups (g, id, n, d): core links (a, b), and the next groups (g, id, n, d, core)."""
    up, down = 100 + percent, 100 - percent
    size = members.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    held = members.select("g", F.explode("d").alias("e")).groupBy("g", "e").agg(F.count(F.lit(1)).alias("c")).join(size, "g").where("2 * c > k")
    # at most twice the mean set size
    consensus = size.join(held.groupBy("g").agg(F.collect_list("e").alias("common")), "g", "left").select("g", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))
    more, less = F.array_sort(F.array_except("d", "common")), F.array_sort(F.array_except("common", "d"))
    mark = F.lit(0x5BD1E9959D1B54A3).cast("long")
    differences = F.concat(more, F.transform(less, lambda e: e.bitwiseXOR(mark)))
    apart = members.withColumn("salt", salt()).join(spread(consensus), ["g", "salt"]).select("g", "id", "n", differences.alias("d"))
    apart = scratch.save(apart.withColumn("f", (F.lit(up) * F.size("d") - F.lit(down) * F.col("n")).cast("long")))
    best = apart.groupBy("g").agg(F.min(F.struct("f", "id")).alias("b")).select("g", F.col("b.f").alias("bf"), F.col("b.id").alias("b"))
    judged = apart.withColumn("salt", salt()).join(spread(best), ["g", "salt"]).withColumn("core", F.col("f") + F.col("bf") <= 0)
    rest = judged.where("not core").groupBy("g").agg(F.min("f").alias("rf"))
    core_links = scratch.save(judged.where("core and id != b").select(F.least("b", "id").alias("a"), F.greatest("b", "id").alias("b")).distinct())
    needed = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("f") + F.when(F.col("core"), F.col("rf")).otherwise(F.col("bf"))) / (2.0 * up)))
    prefix = F.size("d") - needed.cast("int") + 1
    keys = judged.join(spread(rest), ["g", "salt"]).where(prefix > 0).select("g", "id", "core", F.explode(F.slice("d", F.lit(1), prefix)).alias("e"))
    open_ = keys.groupBy("g", "e").agg(F.count(F.lit(1)).alias("k"), F.min("core").alias("closed")).where("k > 1 and not closed").select("g", "e")
    rows = keys.join(open_, ["g", "e"]).join(apart.select("g", "id", "n", "d"), ["g", "id"])
    return core_links, rows.select(F.xxhash64("g", "e").alias("g"), "id", "n", "d", "core")


def links(families: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, limit: int = LIMIT) -> DataFrame:
    """Confirmed links (a, b) that connect what is linked among ids that share a family (g, id)."""
    rows = scratch.save(families.join(sets, "id").select("g", "id", F.size("s").cast("long").alias("n"), F.col("s").alias("d"), F.lit(False).alias("core")))
    found: list[DataFrame] = []
    while True:
        size = scratch.save(rows.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("core").alias("closed"), F.sum(F.size("d")).alias("e")).where("k > 1 and not closed"))
        small = (F.col("k") <= limit) & (F.col("e") <= ELEMENTS)
        found.append(scratch.save(settle_groups(rows.join(size.where(small), "g", "left_semi"), percent)))
        large = scratch.save(rows.join(size.where(~small), "g", "left_semi").select("g", "id", "n", "d"))
        if not large.take(1):
            return union(found).distinct()
        core, following = judge_families(large, scratch, percent)
        found.append(core)
        before, rows = rows, scratch.save(following)
        scratch.drop(before)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): the lowest id reachable, for every id with an edge. Large-star and small-star rounds.

    Each round's joins move labels, not neighbour lists. The lowest neighbour is a sum, whatever the number of edges; the join of a
    hub's edges with its one label is left to adaptive execution to split.
    """
    now = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = scratch.save(small)
        same = after.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first() == now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        scratch.drop(now)
        now = after
        if same:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


CLASS = ("c1", "c2", "n_shingles")


def group(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, component_id) for each row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = scratch.save(signatures(docs, words))
    classes = rows.where("n_shingles > 0").groupBy(*CLASS).agg(F.min(F.col("doc_id").cast("long")).alias("doc"), F.any_value("bands").alias("bands"))
    # a class's number here: 64 bits of its 128 and its size
    classes = scratch.save(classes.withColumn("id", F.xxhash64(*CLASS)))
    groups = classes.select("id", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("g"), "id")
    buckets = groups.groupBy("g").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1").select("g", "low")
    families = scratch.save(groups.join(buckets, "g").select(F.col("low").alias("g"), "id").distinct())
    wanted = scratch.save(classes.join(families.select("id").distinct(), "id", "left_semi").select("id", "doc", *CLASS))
    # texts are read again where they are; only those that may be a wanted class's first go on, as sets
    texts = sieved(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), scratch.save(sieve(wanted, "doc")), "id").where("lg_may").drop("lg_may")
    sets = shingle_sets(texts, words).withColumn("id", F.xxhash64("c1", "c2", "n")).join(wanted.select("id"), "id", "left_semi")
    sets = scratch.save(sets.groupBy("id").agg(F.any_value("s").alias("s")))
    edges = links(families, sets, scratch, percent, limit)
    # classes of one doc_id are one document
    pairs = rows.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(*CLASS).alias("id"))
    several = scratch.save(pairs.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("doc", "a"))
    pairs = sieved(pairs, scratch.save(sieve(several, "doc")), "doc").where("lg_may").drop("lg_may").distinct()
    edges = edges.unionByName(pairs.join(several, "doc").where("a != id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")))
    roots = components(edges, scratch)
    roots = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    lowest = classes.join(roots, "id").groupBy("root").agg(F.min("doc").alias("component_id"))
    labelled = classes.join(roots.join(lowest, "root"), "id", "left").select(*CLASS, F.coalesce("component_id", "doc").alias("component_id"))
    # a class that holds many copies is one row here; the copies' side is split by a salt
    salts = 16
    left = rows.select("doc_id", *CLASS, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    right = labelled.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    out = left.join(right, [*CLASS, "salt"], "left")
    return out.select("doc_id", "n_shingles", "c1", "c2", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long")).alias("component_id"))


def keep_first(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the lowest doc_id of their component, with their own columns."""
    check_free(docs, "lg_drop", "lg_may")
    found = scratch.save(group(docs, scratch, words, percent))
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias("lg_drop")).distinct()
    # a text without doc_id goes if it reaches a document that has one
    texts = found.where("doc_id is null and component_id is not null").select("n_shingles", "c1", "c2").distinct()
    named = docs.where("doc_id is not null").join(gone, F.col("doc_id") == F.col("lg_drop"), "left_anti")
    nameless = docs.where("doc_id is null")
    if texts.take(1):
        nameless = drop_classes(nameless, texts, words)
    return named.unionByName(nameless)


def drop_classes(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """docs without those whose sets are in classes (n_shingles, c1, c2)."""
    at, kinds = docs.columns.index("text"), ("lg_n", "lg_c1", "lg_c2")

    def run(batches):
        for batch in batches:
            hashes, counts = shingle_hashes(binary_texts(batch.column(at)), words)
            sums = class_sums(hashes, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts), pa.array(sums[0]), pa.array(sums[1])], [*batch.schema.names, *kinds])

    rows = docs.mapInArrow(run, extended(docs, **dict.fromkeys(kinds, "long")))
    return rows.join(classes.toDF(*kinds), list(kinds), "left_anti").select(docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 3) - 1], ' ')) AS s FROM w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
