"""Line dedup by a log-template tree of fixed depth, grown as DataFrame aggregations.

A line's tokens are its runs without white space; a token with a digit is a variable field. The tree goes by token count, then
by the `LEAD` leading tokens, then by which of `PARTS` equal parts of the other tokens a branch fixes: all of them, or all but
two (all but one in a line too short for that). A leaf is the cluster of lines that agree in all that its branch fixes, and its
template has a wildcard wherever its members differ (`templates`). So lines that differ in digits anywhere, or in words of any
two parts, share a leaf. A branch fixes at least `MIN_FIXED` tokens; a shorter line has its exact leaf alone.
(MIN_FIXED: with fewer, ordinary sentences of common words meet by chance; README has the figures.) A leaf recurs if `MIN_DOCS`
texts have it, or `LONG_DOCS` in the case of lines of `LONG_TOKENS` tokens or more, which two authors don't write alike by chance.
The first document (lowest doc_id) of a recurring leaf keeps its line, the others drop theirs.

Passages are then cut: runs of `LONG_TOKENS` tokens or more, within lines that stay, that an earlier document has word for word
in such a line, wherever they stand. Of the `SEED`-token grams of a line, the one of least hash is marked in each run of
`LONG_TOKENS` tokens, so equal runs have equal marks; around marks of two texts or more, all windows of `LONG_TOKENS` tokens are
hashed and compared.

Documents of equal text are one text here, whose id is the lowest of theirs: copies of a whole document are no recurring lines,
and get the same result. Texts that share a doc_id are judged by themselves. `drop_lines`, the pipeline's stage, also spares what
a near-duplicate shares with its source (the text that is first for most of what recurs in it), if both are near-duplicates
(`WORDS`-word shingles, `PERCENT`) once what recurs from elsewhere is gone, since near-duplicate detection is to drop it as
a whole. Only texts of which `CANDIDATE` or more recurs can be such copies, and are looked at.

Plans: leaves and marks are hashed once, in Arrow batches, and written; they are counted with partial sums before the shuffle, and
sieved by the recurring hashes (common.sieve), so that only what may recur meets them, in a join salted by text. Keys, classes of
equal texts and windows are 64-bit hashes.

Null texts stay null, empty ones empty. A null doc_id sorts first. Repeated rows are answered each, alike. Of texts that tie as
lowest doc_id of a leaf, each keeps its line. Very long texts are handled line by line. An empty table gives an empty table.
Extra columns pass; columns named like an output or beginning with lg_ raise an error.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, binary_texts, bound_batches, check_free, mix64, released, sieve, sieved, table
from .neardup import shingle_sets

LEAD, PARTS, MIN_FIXED = 1, 4, 5
LONG_TOKENS, MIN_DOCS, LONG_DOCS = 50, 3, 2
SEED = 25
CANDIDATE = 0.5
#: What the pipeline's near-dedup links.
WORDS, PERCENT = 5, 80
SALTS, COPIES = 32, 64
FIRST = -(2**63)
#: The parts that a branch leaves variable: none, each, each two.
BRANCHES = [(), *combinations(range(PARTS), 1), *combinations(range(PARTS), 2)]


def branch_kinds(n: np.ndarray) -> np.ndarray:
    """How many parts branches of lines of n tokens may leave variable at most."""
    part = -(-(n - LEAD) // PARTS)
    return np.where(n - 2 * part >= MIN_FIXED, 2, np.where(n - part >= MIN_FIXED, 1, 0))


#: Bytes of text that are tokenised at once, in arrays of some 80 bytes for each; a longer line is taken whole.
CHUNK = 250_000
BASE = 0x9E3779B97F4A7C15
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))
WILDCARD = mix64(np.array([BASE], np.uint64))[0]


@functools.lru_cache(1)
def table_of_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x))])) for x in (BASE, pow(BASE, -1, 2**64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64, up to n."""
    some = table_of_powers(2 * CHUNK) if n <= 2 * CHUNK else table_of_powers.__wrapped__(n)
    return some[0][: n + 1], some[1][: n + 1]


class Lines:
    """The tokens of the lines of some texts: hashes, and hashes of runs of them by prefix sums."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        """parts: (text, place of the first line, lines)."""
        data = np.frombuffer(b"\n".join([p[2] for p in parts]), np.uint8)
        inside = np.concatenate([[False], ~SPACES[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        breaks = np.cumsum(data == 10)
        line = np.where(self.starts > 0, breaks[self.starts - 1], 0) if len(data) else np.zeros(0, np.int64)
        sizes = np.array([len(p[2]) for p in parts], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        part = np.searchsorted(first, self.starts, side="right") - 1
        before = np.where(first > 0, breaks[np.maximum(first - 1, 0)], 0) if len(data) else np.zeros(len(parts), np.int64)
        power, inverse = powers(len(data))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[data] * power[:-1])])
            self.hash = mix64((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
            digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
            fields = np.where(digits[self.ends] > digits[self.starts], WILDCARD, self.hash)
            token_power, self.inverse = powers(len(self.hash))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hash * token_power[:-1])])
            self.field_sums = np.concatenate([[np.uint64(0)], np.cumsum(fields * token_power[:-1])])
        # lines that have tokens: their first token, tokens, text and place
        self.at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        self.n = np.diff(np.concatenate([self.at, [len(line)]]))
        self.text = np.array([p[0] for p in parts], np.int64)[part[self.at]]
        self.place = line[self.at] - before[part[self.at]] + np.array([p[1] for p in parts], np.int64)[part[self.at]]

    def runs(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def leaves(self) -> tuple[np.ndarray, ...]:
        """(line, branch, leaf) of each leaf that each line belongs to."""
        p = -(-(self.n - LEAD) // PARTS)
        edges = [np.minimum(LEAD + j * p, self.n) for j in range(PARTS + 1)]
        hashed = [self.runs(self.field_sums, self.at + edges[j], self.at + edges[j + 1]) for j in range(PARTS)]
        with np.errstate(over="ignore"):
            node = mix64(self.n.astype(np.uint64)) + self.runs(self.field_sums, self.at, self.at + np.minimum(LEAD, self.n))
            hashed = [mix64(h + np.uint64(j + 1) * np.uint64(BASE)) for j, h in enumerate(hashed)]
            kinds = branch_kinds(self.n)
            rows, branch, leaf = [], [], []
            for b, free in enumerate(BRANCHES):
                some = np.flatnonzero((kinds == len(free)) | (len(free) == 0))
                total = node[some]
                for j in range(PARTS):
                    if j not in free:
                        total = total + hashed[j][some]
                rows.append(some)
                branch.append(np.full(len(some), b))
                leaf.append(mix64(total ^ np.uint64(b + 1)))
        return np.concatenate(rows), np.concatenate(branch), np.concatenate(leaf)

    def windows(self, size: int, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of all runs of size tokens of some lines."""
        count = np.maximum(self.n[lines] - size + 1, 0)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.at[lines], count)
        return start, self.runs(self.sums, start, start + size)

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, first token, hash) of marked grams: the least of each run of LONG_TOKENS tokens."""
        lines = np.flatnonzero(self.n >= LONG_TOKENS)
        if not len(lines):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start, h = self.windows(SEED, lines)
        width = LONG_TOKENS - SEED + 1
        count = self.n[lines] - LONG_TOKENS + 1  # runs of each line
        base = np.cumsum(self.n[lines] - SEED + 1) - (self.n[lines] - SEED + 1)
        run = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(base, count)
        found = np.unique(np.lib.stride_tricks.sliding_window_view(h, width)[run].argmin(1) + run)
        return lines[np.searchsorted(base, found, side="right") - 1], start[found], h[found]


def pieces_of(texts: list[bytes]):
    """Lines of texts, in parts of about CHUNK bytes."""
    parts, held = [], 0
    for i, text in enumerate(texts):
        at = place = 0
        while at < len(text):
            stop = len(text) if len(text) - at <= CHUNK else text.find(b"\n", at + CHUNK)
            stop = len(text) if stop < 0 else stop
            parts.append((i, place, text[at:stop]))
            held += stop - at
            if stop < len(text):
                place += text.count(b"\n", at, stop) + 1
            at = stop + 1
            if held >= CHUNK:
                yield Lines(parts)
                parts, held = [], 0
    if parts:
        yield Lines(parts)


def class_of(text="text"):
    return F.xxhash64(text)


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, id, text): each text once, with the lowest doc_id it has. Only texts that may have copies are shuffled."""
    rows = docs.where("text is not null").select(class_of().alias("cls"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"), "text")
    copied = scratch.save(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("cls"))
    rows = sieved(rows, scratch.save(sieve(copied, "cls")), "cls")
    several = rows.where("lg_may").groupBy("cls").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
    return rows.where("not lg_may").select("cls", "id", "text").unionByName(several)


def keys_of(texts: DataFrame, passages: bool) -> DataFrame:
    """(cls, id, place, h, fresh, least, n, total): leaves of lines, and marks of passages (place -1), with whether it is the hash's
    first place in the text, the number of texts that make it recur, and the tokens of the line and of the text."""

    def run(batches):
        for batch in batches:
            data = binary_texts(batch.column(2))
            total, out = np.zeros(len(data), np.int64), []
            for lines in pieces_of(data):
                total += np.bincount(lines.text, lines.n, len(data)).astype(np.int64)
                row, _, h = lines.leaves()
                n = lines.n[row]
                out.append((lines.text[row], lines.place[row], h, np.where(n >= LONG_TOKENS, LONG_DOCS, MIN_DOCS), n))
                if passages:
                    row, _, h = lines.marks()
                    out.append((lines.text[row], np.full(len(h), -1), h, np.full(len(h), 2), np.zeros(len(h), np.int64)))
            owner, place, h, least, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
            order = np.lexsort((h, owner))
            fresh = np.zeros(len(h), bool)
            if len(h):
                fresh[order] = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
            keep = fresh | (place >= 0)
            owner, place, h, fresh, least, n = owner[keep], place[keep], h[keep], fresh[keep], least[keep], n[keep]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(fresh), pa.array(least.astype(np.int8)), pa.array(n.astype(np.int32)), pa.array(total[owner])],
                ["cls", "id", "place", "h", "fresh", "least", "n", "total"],
            )

    return texts.mapInArrow(released(run), "cls long, id long, place int, h long, fresh boolean, least tinyint, n int, total long")


def shared(rows: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with the first text's id of their hash, of those hashes whose counts say that they recur."""
    found = counts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("id").alias("first"), F.max("least").alias("least")).where("texts >= least").select("h", "first")
    found = scratch.save(found)
    rows = sieved(rows, scratch.save(sieve(found, "h")), "h").where("lg_may").drop("lg_may")
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")
    return rows.withColumn("lg_salt", salt).hint("merge").join(salted(found), ["h", "lg_salt"]).drop("lg_salt")


def salted(df: DataFrame) -> DataFrame:
    """Each row for every salt, never broadcast: by the size of its file a table may seem small, but not so often over."""
    return df.withColumn("lg_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def confirmed(some: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """cls of texts (cls, source, text) that are near-duplicates of a text of their source (source, text)."""
    sets = shingle_sets(sources.select(F.col("source").alias("id"), "text"), WORDS).select(F.col("id").alias("source"), F.col("s").alias("t"))
    own = shingle_sets(some.select(F.col("cls").alias("id"), "text"), WORDS).select(F.col("id").alias("cls"), "s")
    # a source's set is repeated for every COPIES texts that it is compared with, not for each salt: sets are large
    shares = scratch.save(some.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("shares")))
    own = own.join(some.select("cls", "source").join(shares, "source").withColumn("salt", F.expr("cast(pmod(xxhash64(cls), shares) as int)")).drop("shares"), "cls")
    sets = sets.join(shares, "source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    both = F.size(F.array_intersect("s", "t"))
    like = (both > 0) & (100 * both >= PERCENT * (F.size("s") + F.size("t") - both))
    near = scratch.save(own.hint("merge").join(sets.hint("merge"), ["source", "salt"]).where(like).select("cls").distinct())
    # a text that others have as their source is never spared itself
    ids = some.join(near, "cls", "left_semi").select(F.col("source").alias("id")).distinct()
    return near.join(sources.select("cls", F.col("source").alias("id")).join(ids, "id", "left_semi").select("cls").distinct(), "cls", "left_anti")


def spare(texts: DataFrame, marks: DataFrame, without, scratch: Scratch) -> DataFrame:
    """(cls, gone): of marks (cls, gone, foreign, source, total, share), what really goes: of a confirmed near-duplicate, what is first elsewhere.

    without(texts, column of gone things) gives texts without those. Texts with too little that recurs are not
    compared with their source.
    """
    likely = scratch.save(marks.where(F.col("share") >= CANDIDATE).select("cls", "source", "foreign"))
    some = scratch.save(without(texts.select("cls", "text").join(likely.select("cls", "source", "foreign").hint("merge"), "cls"), "foreign"))
    of = texts.join(likely.select(F.col("source").alias("id")).distinct().hint("merge"), "id", "left_semi").join(marks.select("cls", "gone").hint("merge"), "cls", "left")
    sources = scratch.save(without(of, "gone").select("cls", F.col("id").alias("source"), "text"))
    near = confirmed(some, sources, scratch).withColumn("lg_near", F.lit(True))
    return marks.join(near, "cls", "left").select("cls", F.when(F.col("lg_near"), F.col("foreign")).otherwise(F.col("gone")).alias("gone"))


def marked(hits: DataFrame, what: str) -> DataFrame:
    """(cls, gone, foreign, source, total, share): what recurs of each text, what of it is first elsewhere than in its source, the source's id, its tokens, and the share that recurs."""
    hits = hits.where("id != first")
    marks = hits.groupBy("cls").agg(F.collect_set(F.struct(F.col(what).alias("x"), "first", "n")).alias("hits"), F.mode("first", True).alias("source"), F.max("total").alias("total"))
    some = "array_distinct(transform({}, h -> h.x))"
    share = "aggregate(array_distinct(transform(hits, h -> named_struct('x', h.x, 'n', h.n))), 0L, (s, h) -> s + h.n) / total"
    return marks.select("cls", "source", "total", F.expr(share).alias("share"), F.expr(some.format("hits")).alias("gone"), F.expr(some.format("filter(hits, h -> h.first != source)")).alias("foreign"))


LINES = "split(text, '\\n')"


def without_places(texts: DataFrame, gone: str) -> DataFrame:
    """texts without the lines at places of the column gone (null: none), which goes."""
    kept = f"if(coalesce(size({gone}), 0) <= 0, text, array_join(filter({LINES}, (x, i) -> not array_contains({gone}, i)), '\\n'))"
    return texts.withColumn("text", F.expr(kept)).drop(gone)


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the tokens of windows whose hash is in gone; a line of nothing else goes too."""
    out: list[bytes | None] = []
    at = 0
    while at <= len(text):
        stop = len(text) if len(text) - at <= CHUNK else text.find(b"\n", at + CHUNK)
        stop = len(text) if stop < 0 else stop
        part = text[at:stop]
        lines, found = part.split(b"\n"), Lines([(0, 0, part)])
        long = np.flatnonzero(found.n >= LONG_TOKENS)
        start, h = found.windows(LONG_TOKENS, long)
        hit = start[np.isin(h, gone)]
        if len(hit):
            lost = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(lost, hit, 1)
            np.add.at(lost, hit + LONG_TOKENS, -1)
            lost = np.cumsum(lost)[:-1] > 0
            for k in long:
                own = slice(found.at[k], found.at[k] + found.n[k])
                if lost[own].any():
                    line = lines[found.place[k]]
                    places = found.starts[own] - found.starts[found.at[k]] + len(line) - len(line.lstrip())
                    places = [*places.tolist(), len(line)]
                    kept = b"".join([line[places[i] : places[i + 1]] for i in np.flatnonzero(~lost[own])]).rstrip()
                    lines[found.place[k]] = line[: places[0]] + kept if kept else None
        out += lines
        at = stop + 1
    return b"\n".join(x for x in out if x is not None)


def without_windows(docs: DataFrame, gone: str) -> DataFrame:
    """docs without the windows whose hashes are in the column gone (null: none), which goes."""
    text, hashes = docs.columns.index("text"), docs.columns.index(gone)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, g in enumerate(batch.column(hashes)):
                if g.is_valid and len(g) and texts[i]:
                    texts[i] = cut(texts[i].encode(), g.values.to_numpy(zero_copy_only=False).view(np.uint64)).decode()
            batch = batch.set_column(text, "text", pa.array(texts, pa.string()))
            yield batch.drop_columns([gone])

    return docs.mapInArrow(released(run), docs.drop(gone).schema)


def windows_of(texts: DataFrame) -> DataFrame:
    """(cls, id, h, n, total): windows of LONG_TOKENS tokens around marked grams of the column marks, of lines not in the column gone.

    Windows overlap, so n, the tokens of one, is that of the text: how much of it recurs is not known from them.
    """

    def run(batches):
        for batch in batches:
            data = binary_texts(batch.column(2))
            gone = {(i, p) for i, places in enumerate(batch.column(3).to_pylist()) for p in places or ()}
            marks = batch.column(4)
            pairs = np.concatenate([mix64(x.values.to_numpy(zero_copy_only=False).view(np.uint64) + mix64(np.array([i], np.uint64))) for i, x in enumerate(marks)] or [np.zeros(0, np.uint64)])
            pairs.sort()
            total, owner, hashes = np.zeros(len(data), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for lines in pieces_of(data):
                total += np.bincount(lines.text, lines.n, len(data)).astype(np.int64)
                row, at, h = lines.marks()
                with np.errstate(over="ignore"):
                    keep = np.isin(mix64(h + mix64(lines.text[row].astype(np.uint64))), pairs)
                if gone:
                    keep &= np.array([(t, p) not in gone for t, p in zip(lines.text[row].tolist(), lines.place[row].tolist())], bool)
                row, at = row[keep], at[keep]
                near = at[:, None] - np.arange(LONG_TOKENS - SEED + 1)
                fits = (near >= lines.at[row][:, None]) & (near + LONG_TOKENS <= (lines.at[row] + lines.n[row])[:, None])
                start, which = np.unique(near[fits], return_index=True)
                owner.append(np.repeat(lines.text[row], fits.sum(1))[which])
                hashes.append(lines.runs(lines.sums, start, start + LONG_TOKENS))
            owner, h = np.concatenate(owner), np.concatenate(hashes)
            order = np.lexsort((h, owner))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])[: len(h)]
            owner, h = owner[order][new], h[order][new]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h.view(np.int64)), pa.array(total[owner].astype(np.int32)), pa.array(total[owner])], ["cls", "id", "h", "n", "total"])

    return texts.select("cls", "id", "text", "gone", "marks").mapInArrow(released(run), "cls long, id long, h long, n int, total long")


def recurring(docs: DataFrame, scratch: Scratch, passages: bool = True, copies: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(cls, gone): places of lines that go from texts, and hashes of windows that go from what is left (None without passages).

    With copies, near-duplicates of a source are spared.
    """
    texts = distinct_texts(docs.select("doc_id", "text"), scratch)
    keys = scratch.save(keys_of(texts, passages))
    hits = scratch.save(shared(keys, keys.where("fresh"), scratch))
    scratch.drop(keys)
    places = scratch.save(marked(hits.where("place >= 0"), "place"))
    lines = scratch.save(spare(texts, places, without_places, scratch) if copies else places.select("cls", "gone"))
    if not passages:
        return lines, None
    marks = hits.where("place < 0").groupBy("cls").agg(F.collect_set("h").alias("marks"))
    near = texts.join(marks.hint("merge"), "cls").join(lines.hint("merge"), "cls", "left")
    windows = scratch.save(windows_of(near))
    counts = windows.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("id").alias("first"))
    found = scratch.save(counts.where("texts > 1").select("h", "first"))
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")
    again = windows.withColumn("lg_salt", salt).hint("merge").join(salted(found), ["h", "lg_salt"]).drop("lg_salt")
    cuts = scratch.save(marked(again, "h"))
    if not copies:
        return lines, cuts.select("cls", "gone")
    both = lambda t, gone: without_windows(without_places(t.join(lines.withColumnRenamed("gone", "lg_lines"), "cls", "left"), "lg_lines"), gone)
    return lines, scratch.save(spare(texts, cuts, both, scratch))


def apply(docs: DataFrame, lines: DataFrame, windows: DataFrame | None, scratch: Scratch, count: str) -> DataFrame:
    """docs with their text without what goes, and the number of dropped lines. Texts that lose nothing are not shuffled."""
    gone = lines.select("cls", F.col("gone").alias("lg_places"))
    if windows is not None:
        gone = gone.join(windows.select("cls", F.col("gone").alias("lg_windows")), "cls", "full")
    else:
        gone = gone.withColumn("lg_windows", F.lit(None).cast("array<bigint>"))
    gone = scratch.save(gone.where("size(lg_places) > 0 or size(lg_windows) > 0"))
    rows = sieved(docs.withColumn("lg_cls", class_of()), scratch.save(sieve(gone, "cls")), "lg_cls")
    salt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")  # equal texts may be very many
    some = rows.where("lg_may").withColumn("lg_salt", salt)
    some = some.hint("merge").join(salted(gone.withColumnRenamed("cls", "lg_cls")), ["lg_cls", "lg_salt"], "left").withColumn(count, F.greatest(F.coalesce(F.size("lg_places"), F.lit(0)), F.lit(0)).cast("long"))
    some = without_places(some, "lg_places").select(*docs.columns, count, "lg_windows")
    some = some.drop("lg_windows") if windows is None else without_windows(some, "lg_windows")
    rest = rows.where("not lg_may").select(*docs.columns, F.lit(0).cast("long").alias(count))
    return rest.unionByName(some)


def clean(docs: DataFrame, scratch: Scratch, text: str = "clean_text", count: str = "n_dropped", passages: bool = True) -> DataFrame:
    """Adds the text without what recurs, and the number of dropped lines, to the columns of docs."""
    check_free(docs, text, count, *LG)
    bound_batches(docs.sparkSession)
    lines, windows = recurring(docs, scratch, passages)
    out = apply(docs.withColumn("lg_text", F.col("text")), lines, windows, scratch, count)
    return out.withColumnRenamed("text", text).withColumnRenamed("lg_text", "text").select(*docs.columns, text, count)


LG = ("lg_text", "lg_cls", "lg_may", "lg_salt", "lg_places", "lg_windows", "lg_dropped", "lg_lines", "lg_near")


def drop_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with its own columns, text without dropped lines and passages; n_chars, if there, is counted anew where some went."""
    check_free(docs, *LG)
    bound_batches(docs.sparkSession)
    lines, windows = recurring(docs, scratch, copies=True)
    out = apply(docs.withColumn("lg_text", F.xxhash64("text")), lines, windows, scratch, "lg_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.xxhash64("text") != F.col("lg_text"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def templates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, n_tokens, n_texts, first, template): recurring leaves, with a wildcard wherever members differ (or hold a digit).

    Members meet as a pair of least and greatest token at each place, so a leaf of any size is a sum.
    """
    bound_batches(docs.sparkSession)
    texts = distinct_texts(docs.select("doc_id", "text"), scratch)
    keys = scratch.save(keys_of(texts, False))
    hits = shared(keys, keys.where("fresh"), scratch).select("cls", "id", "place", "h", "first")
    lines = hits.join(texts.select("cls", F.expr(LINES).alias("lines")), "cls").select("cls", "h", "first", F.expr("lines[place]").alias("line"))
    tokens = lines.withColumn("t", F.expr(r"filter(split(regexp_replace(line, r'[^\x09-\x0D\x20]*[0-9][^\x09-\x0D\x20]*', '<*>'), r'[\x09-\x0D\x20]+'), x -> x != '')"))
    at = tokens.select("cls", "h", "first", F.posexplode("t").alias("at", "token"))
    places = at.groupBy("h", "at").agg(F.min("token").alias("least"), F.max("token").alias("most"), F.min("first").alias("first"), F.count_distinct("cls").alias("texts"))
    rows = places.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("<*>").alias("token")))).alias("t"), F.max("texts").alias("n_texts"), F.min("first").alias("first"))
    return rows.select(F.col("h").alias("leaf"), F.size("t").alias("n_tokens"), "n_texts", "first", F.expr("array_join(transform(t, x -> x.token), ' ')").alias("template"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op4"))
    return out.select("doc_id", "n_dropped", F.length(F.coalesce("clean_text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"), "clean_text")


OP4_SQL = r"""
WITH txt AS (SELECT text, min(doc_id) AS id, row_number() OVER (ORDER BY text) AS c FROM documents WHERE text IS NOT NULL GROUP BY text),
lines AS (SELECT c, id, i - 1 AS place, s[i] AS line FROM (SELECT c, id, string_split(text, chr(10)) AS s FROM txt), unnest(range(1, len(s) + 1)) AS u(i)),
tok AS (SELECT c, id, place, line, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x09-\x0D\x20]*[0-9][^\x09-\x0D\x20]*', '<*>', 'g'), '[\x09-\x0D\x20]+'), lambda x: x != '') AS t FROM lines),
big AS (SELECT c, id, place, t, len(t) AS n, CAST(ceil((len(t) - 1) / 4.0) AS INTEGER) AS p FROM tok WHERE len(t) > 0),
kind AS (SELECT *, CASE WHEN n - 2 * p >= 5 THEN 2 WHEN n - p >= 5 THEN 1 ELSE 0 END AS kind FROM big),
leaf AS (SELECT c, id, place, n, -1 AS a, -1 AS b, array_to_string(t, ' ') AS k FROM kind
  UNION ALL SELECT c, id, place, n, a, a, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i > 1 AND (i - 2) // p = a THEN '' ELSE t[i] END), ' ') FROM kind, range(4) AS r(a) WHERE kind = 1
  UNION ALL SELECT c, id, place, n, a, b, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN i > 1 AND (i - 2) // p IN (a, b) THEN '' ELSE t[i] END), ' ') FROM kind, range(4) AS r(a), range(4) AS q(b) WHERE kind = 2 AND a < b),
rec AS (SELECT n, a, b, k, min(id) AS f FROM leaf GROUP BY n, a, b, k HAVING count(DISTINCT c) >= 3 OR (n >= 50 AND count(DISTINCT c) >= 2)),
gone AS (SELECT DISTINCT c, place FROM leaf JOIN rec USING (n, a, b, k) WHERE id != f),
kept AS (SELECT l.c, l.id, l.place, l.line, regexp_extract_all(l.line, '[^\x09-\x0D\x20]+[\x09-\x0D\x20]*') AS u, regexp_extract_all(l.line, '[^\x09-\x0D\x20]+') AS t FROM lines l LEFT JOIN gone g ON g.c = l.c AND g.place = l.place WHERE g.c IS NULL),
win AS (SELECT c, id, place, i, hash(array_to_string(t[i:i + 49], ' ')) AS h FROM kept, unnest(range(1, len(t) - 48)) AS r(i) WHERE len(t) >= 50),
rw AS (SELECT h, min(id) AS f FROM win GROUP BY h HAVING count(DISTINCT c) > 1),
cov AS (SELECT c, place, list(i) AS s FROM win JOIN rw USING (h) WHERE id != f GROUP BY c, place),
fin AS (SELECT k.c, k.place, CASE WHEN v.s IS NULL THEN k.line ELSE
  (SELECT regexp_extract(k.line, '^[\x09-\x0D\x20]*') || coalesce(string_agg(k.u[j], '' ORDER BY j), '') FROM range(1, len(k.u) + 1) AS r(j) WHERE len(list_filter(v.s, lambda x: x <= j AND j < x + 50)) = 0) END AS line, v.s IS NOT NULL AS cut
  FROM kept k LEFT JOIN cov v ON v.c = k.c AND v.place = k.place),
part AS (SELECT c, string_agg(CASE WHEN cut THEN regexp_replace(line, '[\x09-\x0D\x20]+$', '') ELSE line END, chr(10) ORDER BY place) AS x FROM fin WHERE NOT cut OR regexp_replace(line, '[\x09-\x0D\x20]', '', 'g') != '' GROUP BY c),
res AS (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(part.x, '') END AS clean_text, (SELECT count(*) FROM gone WHERE gone.c = txt.c) AS n FROM documents d LEFT JOIN txt ON txt.text = d.text LEFT JOIN part ON part.c = txt.c)
SELECT doc_id, CAST(n AS BIGINT) AS n_dropped, CAST(length(coalesce(clean_text, '')) AS BIGINT) AS n_chars, sha256(coalesce(clean_text, '')) AS clean_sha256, clean_text FROM res
"""
