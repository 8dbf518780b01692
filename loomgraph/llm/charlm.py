"""Interpolated modified Kneser-Ney character models over words, built and applied with DataFrame joins.

A word is a run of word characters (`spaces`: all but white space; `letters`: letters and marks, lower case) between a start
and an end mark; contexts do not cross words. Of `spaces` words, one equal to the word before it is one repeat mark. Each
character after the start mark is predicted from the `order` - 1 characters before it in its word, so a text of any length and a
word of any length have the same grams, whole. U+0000 to U+0008 separate words.

Training: tasks hand on counts of distinct grams; the counts are summed and joined as DataFrames: count-of-counts give the
discounts, context sums the back-off weights, and each order joins the order below.

Scoring by joins (`joined_sums`): documents are taken in blocks, which are runs of about `BLOCK_CHARS` characters of rows of
one file, the same in every attempt (frames that are not read from files are written first). Each block's distinct grams are
collected by its tasks; the distinct grams of all blocks are joined to the model's tables by shuffle, sharded by gram, which gives
each its log probability with all back-offs; the values go back to the blocks, and meet their documents (compressed) in one
task a block. Nothing of the model reaches the driver or all executors, and there is one way at every size.

Scoring by arrays (`Model`): hash arrays sorted by gram for each model, for callers that check their size first. Grams are
looked up by 64-bit hashes; values are the same.
"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.ipc  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .common import extended, mix64, release, released

START, END, REPEAT = "\x02", "\x03", "\x04"
#: Characters whose grams are handled at once, of a block of documents, and entries of counts that a task holds.
CHUNK, BLOCK_CHARS, HELD = 250_000, 32_000_000, 500_000
#: Entries of counts that go to the JVM at once.
SENT = 100_000
#: Of zstd, for texts on their way to the values of their grams: those are most of what is on disk.
LEVEL = 6
_FACTORS = mix64(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


@functools.cache
def word_characters(kind: str) -> np.ndarray:
    """Which code points belong to words."""
    if kind == "spaces":
        out = np.ones(0x110000, bool)
        out[[c for c in range(0x110000) if chr(c).isspace()]] = False
    else:
        out = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    out[:9] = False  # among them the marks of this module
    return out


@functools.cache
def mixed_codes() -> np.ndarray:
    return mix64(np.arange(0x110000, dtype=np.uint64))


class Index:
    """Places of distinct 64-bit keys: one slot each by the high bits, another by mixed bits for what has lost its slot, and binary
    search for the few that lose both."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift, self.slots = self.table(keys, np.arange(len(keys), dtype=np.int32))
        lost = np.flatnonzero(keys[self.slots[keys >> self.shift]] != keys) if len(keys) else np.zeros(0, np.int64)
        mixed = mix64(keys[lost])
        self.shift2, self.slots2 = self.table(mixed, lost.astype(np.int32))
        lost = lost[self.slots2[mixed >> self.shift2] != lost]
        self.order = lost[np.argsort(keys[lost])]
        self.sorted = keys[self.order]

    @staticmethod
    def table(keys: np.ndarray, places: np.ndarray) -> tuple[np.uint64, np.ndarray]:
        shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        slots = np.zeros(1 << (64 - int(shift)), np.int32)
        slots[keys >> shift] = places
        return shift, slots

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each, all of which are keys."""
        out = self.slots[h >> self.shift]
        other = np.flatnonzero(self.keys[out] != h)
        if len(other):
            rest = h[other]
            at = self.slots2[mix64(rest) >> self.shift2]
            left = np.flatnonzero(self.keys[at] != rest)
            at[left] = self.order[np.searchsorted(self.sorted, rest[left])]
            out[other] = at
        return out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and their counts. The places are sorted as the values' low bits, which is several
    times faster than sorting places by value; where two values agree in all other bits, it is done by value."""
    bits = np.uint64((1 << max(1, len(h).bit_length())) - 1)
    packed = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    at = (packed & bits).view(np.int64)
    s = h[at]
    new = s[1:] != s[:-1]
    high = packed & ~bits
    if (new & (high[1:] == high[:-1])).any():
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        return u, at, n
    edges = np.flatnonzero(np.concatenate([[True], new])) if len(s) else np.zeros(0, np.int64)
    return s[edges], at[edges], np.diff(np.concatenate([edges, [len(s)]]))


@dataclass
class Grams:
    """The longest gram that ends at each scored character of some texts."""

    hashes: np.ndarray
    owner: np.ndarray  # the text of each
    codes: np.ndarray
    at: np.ndarray  # the place of its last character in codes
    size: np.ndarray  # its length

    def strings(self, which: np.ndarray, order: int) -> np.ndarray:
        rows = self.at[which][:, None] - self.size[which][:, None] + 1 + np.arange(order)
        out = np.where(np.arange(order) < self.size[which][:, None], self.codes[np.minimum(rows, len(self.codes) - 1)], 0)
        return np.ascontiguousarray(out.astype(np.uint32)).view(f"<U{order}").ravel()


def hash_codes(codes: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the grams that end at each place of codes: as many characters as order and place allow."""
    m = mixed_codes()[codes]
    with np.errstate(over="ignore"):
        h = m * _FACTORS[0]
        near = np.minimum(place, order).astype(np.int8)
        for j in range(1, order):
            step = m[:-j] * _FACTORS[j]
            step &= (-(near[j:] >= j).view(np.int8)).astype(np.int64).view(np.uint64)  # all bits, or none
            h[j:] += step
    return h


def hash_strings(grams: np.ndarray) -> np.ndarray:
    """The same hashes of whole strings of a fixed-width array."""
    width = grams.dtype.itemsize // 4
    codes = np.ascontiguousarray(grams).view(np.uint32).reshape(len(grams), width).astype(np.uint64)
    size = (codes != 0).sum(1)
    m = mix64(codes)
    out = np.zeros(len(grams), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            back = size - 1 - j
            rows = np.flatnonzero(back >= 0)
            out[rows] += m[rows, back[rows]] * _FACTORS[j]
    return out


SEPARATORS = [chr(c) for c in range(9)]
SEPARATOR = re.compile("[\x00-\x08]")


def spaced_grams(texts: list[str], order: int) -> Grams:
    """grams_of for the kind `spaces`, whose words are those of str.split."""
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if any(c in text for c in SEPARATORS):
            text = SEPARATOR.sub(" ", text)
        words += text.split()
        ends[i + 1] = len(words)
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    again = np.zeros(len(words), bool)
    if words:
        again[1:] = np.fromiter(map(operator.eq, words[1:], words), bool, len(words) - 1) & (text[1:] == text[:-1])
        for i in np.flatnonzero(again).tolist():
            words[i] = REPEAT
    full = np.fromiter(map(len, words), np.int64, len(words)) + 2
    joined = START + (END + START).join(words) + END if words else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(full) - full, full)
    at = np.flatnonzero(place)
    return Grams(hash_codes(codes, place, order)[at], np.repeat(text, full - 1), codes, at, np.minimum(place[at] + 1, order))


def grams_of(texts: list[str], kind: str, order: int) -> Grams:
    if kind == "spaces":
        return spaced_grams(texts, order)
    joined = " ".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if kind == "letters":
        lowered = [t.lower() for t in texts]
        joined, lengths = " ".join(lowered), np.fromiter(map(len, lowered), np.int64, len(texts))
    source = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], word_characters(kind)[source], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    first = np.cumsum(lengths + 1) - lengths - 1  # of each text in joined
    text = np.searchsorted(first, starts, side="right") - 1
    full = size + 2
    offset = np.cumsum(full) - full
    place = np.arange(int(full.sum())) - np.repeat(offset, full)
    codes = source[np.clip(np.repeat(starts - 1, full) + place, 0, max(len(source) - 1, 0))] if len(source) else np.zeros(0, np.uint32)
    codes[offset], codes[offset + full - 1] = ord(START), ord(END)
    at = np.flatnonzero(place > 0)
    return Grams(hash_codes(codes, place, order)[at], np.repeat(text, full - 1), codes, at, np.minimum(place[at] + 1, order))


def chunks(texts: list[str | None], kind: str):
    """(numbers of texts, parts of them) of about CHUNK characters. Only texts beyond that are cut, between two different words."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            stop = len(text) if len(text) - at <= CHUNK else cut_after(text, at, at + CHUNK, kind)
            rows.append(i)
            parts.append(text[at:stop])
            held += stop - at
            at = stop
            if held >= CHUNK:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


SPACED = re.compile(r"[^\s\x00-\x08]+")


def cut_after(text: str, at: int, stop: int, kind: str) -> int:
    inside = word_characters(kind)
    while stop < len(text) and inside[ord(text[stop])]:
        stop += 1
    if kind == "spaces":  # a repeated word needs the word before it
        last = SPACED.findall(text[at:stop].rsplit(None, 1)[-1])[-1:]
        while (m := SPACED.search(text, stop)) and [m[0]] == last:
            stop = m.end()
    return stop


class Tally:
    """Distinct grams with counts, in arrays that are merged now and then."""

    def __init__(self, order: int):
        self.order, self.parts, self.size, self.merged = order, [], 0, 0

    def add(self, grams: Grams) -> None:
        h, first, n = distinct(grams.hashes)
        self.parts.append((h, grams.strings(first, self.order), n))
        self.size += len(h)
        if self.size > max(HELD, 2 * self.merged):
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            h, first, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[2] for p in self.parts])).astype(np.int64)
            self.parts = [(h, np.concatenate([p[1] for p in self.parts])[first], n)]
            self.size = self.merged = len(h)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams and counts; the tally is empty then."""
        self.merge()
        out = self.parts[0][1:] if self.parts else (np.zeros(0, "<U1"), np.zeros(0, np.int64))
        self.parts, self.size, self.merged = [], 0, 0
        return out


def slices(name, grams: np.ndarray, n: np.ndarray):
    """Parts of what a tally holds, which are lists and Arrow batches for a while, on both sides of the pipe."""
    for i in range(0, len(n), SENT):
        yield name, grams[i : i + SENT], n[i : i + SENT]


def tallies(batches, order: int, kind: str):
    """(name, grams, counts) of batches whose columns begin with a name and a text; a name may come more than once."""
    held: dict = {}
    for batch in batches:
        by: dict = {}
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name is not None and text:
                by.setdefault(name, []).append(text)
        for name, texts in by.items():
            tally = held.setdefault(name, Tally(order))
            for _, parts in chunks(texts, kind):
                tally.add(grams_of(parts, kind, order))
        while sum(t.size for t in held.values()) > 2 * HELD:
            name = max(held, key=lambda k: held[k].size)
            yield from slices(name, *held.pop(name).take())
    for name, tally in held.items():
        yield from slices(name, *tally.take())


def count_grams(df: DataFrame, order: int, kind: str, text: str = "text", model: str = "model") -> DataFrame:
    """(model, gram, n) summed over all rows; rows whose model is null do not count."""

    def run(batches):
        for name, grams, n in tallies(batches, order, kind):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(n, pa.int64())], ["model", "gram", "n"])

    parts = df.select(F.col(model).cast("string").alias("model"), F.col(text).alias("text")).mapInArrow(released(run), "model string, gram string, n long")
    return parts.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame, order: int, scratch) -> tuple[DataFrame, DataFrame]:
    """Probabilities (model, k, gram, p) and back-off weights (model, k, ctx, gamma) of all orders.

    Each order is written before the next is built, so plans stay small.
    """
    level = {order: grams.select("model", "gram", "n")}
    top = grams.where((F.length("gram") == order))
    anchored = grams.where(F.col("gram").startswith(START))
    for k in range(order - 1, 0, -1):
        above = level[k + 1].where(F.length("gram") == k + 1) if k + 1 == order else level[k + 1]
        follows = above.select("model", F.expr("substring(gram, 2)").alias("gram")).groupBy("model", "gram").agg(F.count(F.lit(1)).alias("n"))
        starts = anchored.where(F.length("gram") == k) if k > 1 else anchored.limit(0)
        level[k] = scratch.save(follows.unionByName(starts.select("model", "gram", "n")))
    level[order] = top.select("model", "gram", "n")
    below = None
    probs, backs = [], []
    for k in range(1, order + 1):
        g = level[k].withColumns({"ctx": F.expr("substring(gram, 1, length(gram) - 1)")})
        nk = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        c = g.groupBy("model").agg(*nk)
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

        def discount(i: int):
            d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))
            return F.least(F.greatest(d, F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}")

        d = F.broadcast(scratch.save(c.select("model", discount(1), discount(2), discount(3))))  # a row for each model
        g = g.join(d, "model").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        ctx = scratch.save(g.groupBy("model", "ctx").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("cut")).withColumn("gamma", F.col("cut") / F.col("total")))
        g = g.join(ctx.select("model", "ctx", "total", "gamma"), ["model", "ctx"]).withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
        if below is None:
            size = F.broadcast(scratch.save(g.groupBy("model").agg((F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("flat"))))  # a row for each model
            p = g.join(size, "model").select("model", "gram", (F.col("own") + F.col("gamma") * F.col("flat")).alias("p"))
            backs.append(g.join(size, "model").groupBy("model").agg(F.first(F.col("gamma") * F.col("flat")).alias("gamma")).select("model", F.lit(0).alias("k"), F.lit("").alias("ctx"), "gamma"))
        else:
            low = below.select("model", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            p = g.withColumn("suffix", F.expr("substring(gram, 2)")).join(low, ["model", "suffix"], "left").select("model", "gram", (F.col("own") + F.col("gamma") * F.coalesce("low", F.lit(0.0))).alias("p"))
            backs.append(ctx.select("model", F.lit(k).alias("k"), "ctx", "gamma"))
        below = scratch.save(p)
        probs.append(below.withColumn("k", F.lit(k)))
    union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
    return union(probs).select("model", "k", "gram", "p"), union(backs)


@dataclass
class Model:
    """For each model: arrays of gram hashes in order with log probabilities, and of context hashes with log back-off weights."""

    names: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: list[float]

    def of(self, grams: Grams) -> list[np.ndarray]:
        """For each model, the log probability of each character."""
        u, first, _ = distinct(grams.hashes)
        at = Index(u).find(grams.hashes)
        return [v[at] for v in self.values(grams.strings(first, self.order)).T]

    def values(self, grams: np.ndarray) -> np.ndarray:
        """Log probabilities of the last character of distinct grams, a column for each model."""
        width = grams.dtype.itemsize // 4
        codes = np.ascontiguousarray(grams).view(np.uint32).reshape(len(grams), width)
        size = (codes != 0).sum(1)
        out = np.zeros((len(grams), len(self.names)))
        done = np.zeros(out.shape, bool)
        for k in range(self.order, 0, -1):
            rows = np.flatnonzero(size >= k)
            tail = codes[rows[:, None], (size[rows] - k)[:, None] + np.arange(k)]
            h = hash_strings(np.ascontiguousarray(tail).view(f"<U{k}").ravel())
            c = hash_strings(np.ascontiguousarray(tail[:, :-1]).view(f"<U{k - 1}").ravel()) if k > 1 else None
            for m in range(len(self.names)):
                found, value = self.look(self.grams[m], h)
                found &= ~done[rows, m]
                out[rows[found], m] += value[found]
                done[rows[found], m] = True
                left = ~done[rows, m]
                if k > 1:
                    found, value = self.look(self.contexts[m], c)
                    found &= left
                    out[rows[found], m] += value[found]
                else:
                    out[rows[left], m] += self.floor[m]
        return out

    @staticmethod
    def look(entry: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(entry[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(entry[0], keys), len(entry[0]) - 1)
        return entry[0][at] == keys, entry[1][at].astype(np.float64)


def sums(texts: list[str | None], kind: str, order: int, width: int, values) -> np.ndarray:
    """For each text: the log probability under each model, then the number of characters scored. values(grams) gives a row for each."""
    out = np.zeros((len(texts), width + 1))
    for rows, parts in chunks(texts, kind):
        g = grams_of(parts, kind, order)
        if len(g.hashes):
            v = values(g)
            owner = np.array(rows)[g.owner]
            for m in range(width):
                out[:, m] += np.bincount(owner, v[m], len(texts))
            out[:, width] += np.bincount(owner, minlength=len(texts))
    return out


@dataclass
class Tables:
    """A model in tables: probabilities (model, k, gram, p) and back-off weights (model, k, ctx, gamma)."""

    names: list[str]
    order: int
    kind: str
    probs: DataFrame
    backs: DataFrame
    scratch: object

    def entries(self) -> int:
        return self.probs.count() + self.backs.count()

    def collect(self) -> Model:
        """The model as arrays on the driver, 12 bytes an entry; callers check entries() first."""
        number = {n: i for i, n in enumerate(self.names)}

        def run(batches):
            for batch in batches:
                which = pa.array([number[x] for x in batch.column(0).to_pylist()], pa.int32())
                texts = np.array(batch.column(1).to_pylist() or [""])
                h = hash_strings(texts)[: batch.num_rows]
                yield pa.RecordBatch.from_arrays([which, pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], ["m", "h", "v"])

        def arrays(df: DataFrame, text: str, value: str):
            log = F.log(F.greatest(value, F.lit(1e-300))).alias("v")
            got = df.select("model", text, log).mapInArrow(run, "m int, h long, v float").toArrow()
            m, h, v = (got.column(c).to_numpy() for c in ("m", "h", "v"))
            out = []
            for i in range(len(self.names)):
                own = np.flatnonzero(m == i)
                own = own[np.argsort(h[own].view(np.uint64))]
                out.append((h[own].view(np.uint64).copy(), v[own].copy()))
            return out

        floor = [float(np.log(1e-6))] * len(self.names)
        for r in self.backs.where("k = 0").collect():  # a row for each model
            floor[number[r["model"]]] = float(np.log(max(r["gamma"], 1e-12)))
        return Model(self.names, self.order, arrays(self.probs, "gram", "p"), arrays(self.backs.where("k > 1"), "ctx", "gamma"), floor)

    def gram_scores(self, grams: DataFrame) -> DataFrame:
        """(gram, v) of distinct grams and of their ends: the natural log probability of the last character under each model, in order
        of names. Values of short grams come first; a longer one that a model has not seen takes its end's, with the back-off weight."""
        number = F.array_position(F.array(*map(F.lit, self.names)), F.col("model")) - 1
        log = lambda c: F.log(F.greatest(c, F.lit(1e-300)))
        by = lambda df, key, value: df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(number.cast("int"), log(value)))).alias(value))  # noqa: E731  # at most an entry for each model
        floors = {r["model"]: float(np.log(max(r["gamma"], 1e-12))) for r in self.backs.where("k = 0").collect()}  # a row for each model
        low = F.array(*[F.lit(floors.get(n, float(np.log(1e-6)))) for n in self.names])
        below, out = None, []
        for k in range(1, self.order + 1):
            g = grams.where(F.length("gram") >= k).select(F.expr(f"right(gram, {k})").alias("gram")).distinct()
            g = g.join(by(self.probs.where(F.col("k") == k), "gram", "p"), "gram", "left")
            if k == 1:
                g = g.withColumn("low", low).withColumn("gamma", F.lit(None).cast("map<int,double>"))
            else:
                g = g.withColumns({"ctx": F.expr(f"left(gram, {k - 1})"), "suffix": F.expr(f"right(gram, {k - 1})")})
                g = g.join(by(self.backs.where(F.col("k") == k), "ctx", "gamma"), "ctx", "left").join(below, "suffix")
            v = F.expr("transform(low, (x, i) -> coalesce(element_at(p, i), coalesce(element_at(gamma, i), 0D) + x))")
            g = self.scratch.save(g.select("gram", v.alias("v")))
            below = g.select(F.col("gram").alias("suffix"), F.col("v").alias("low"))
            out.append(g)
        union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
        return union(out[1:])

    def joined_sums(self, docs: DataFrame, extra: DataFrame | None = None, find=None, name: str = "lg_found") -> DataFrame:
        """docs with lg_sums (the log probability of its text under each model), lg_size (characters scored), and `name`: whether
        find (text to words) gives a word of extra (word). Columns of docs pass."""
        order, kind, width, spark = self.order, self.kind, len(self.names), docs.sparkSession
        few = extra is not None and extra.count() <= FEW_WORDS
        listed = spark.sparkContext.broadcast({r["word"] for r in extra.collect()}) if few else None  # FEW_WORDS at most
        extra = None if few else extra
        bits = spark.sparkContext.broadcast(sieve_array(extra, self.scratch)) if extra is not None else None  # 8 MB
        blocks, columns = in_blocks(docs, self.scratch), docs.columns
        at = columns.index("text")

        def needed(batches):
            words: dict = {}

            passed: list = []

            def watch(batches):
                for batch in batches:
                    if bits is not None:
                        for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                            if text:
                                words.setdefault(block, set()).update(find(text))
                        for block in [b for b, w in words.items() if len(w) > 100_000]:
                            passed.append((block, passing(words.pop(block), bits.value)))
                    yield batch

            for block, grams, _ in tallies(watch(batches), order, kind):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), pa.array(grams.tolist(), pa.string())], ["lg_block", "gram"])
            for block, found in [*passed, *((b, passing(w, bits.value)) for b, w in words.items())]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array([WORD + w for w in found], pa.string())], ["lg_block", "gram"])

        need = self.scratch.save(blocks.select("lg_block", "text").mapInArrow(released(needed), "lg_block long, gram string").distinct())
        values = self.gram_scores(self.scratch.save(need.where(~F.col("gram").startswith(WORD)).select("gram").distinct()))
        if extra is not None:
            values = values.unionByName(extra.select(F.concat(F.lit(WORD), "word").alias("gram"), F.lit(None).cast("array<double>").alias("v")).distinct())
        hits = need.hint("merge").join(values.hint("merge"), "gram")

        def packed(batches):
            for batch in batches:
                sink = pa.BufferOutputStream()
                block = batch.column(0)
                rest = batch.select(range(1, batch.num_columns))
                for value in pa.compute.unique(block).to_pylist():
                    sink = pa.BufferOutputStream()
                    some = rest.filter(pa.compute.equal(block, value))
                    with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                        out.write_batch(some)
                    yield pa.RecordBatch.from_arrays([pa.array([value], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["lg_block", "data"])

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            out = scored(left, right)
            release()
            return out

        def scored(left: pa.Table, right: pa.Table) -> pa.Table:
            grams = right.column("gram").to_pylist()
            own = [i for i, g in enumerate(grams) if not g.startswith(WORD)]
            bad = listed.value if listed else {g[len(WORD) :] for g in grams if g.startswith(WORD)}
            h = hash_strings(np.array([grams[i] for i in own], f"<U{order}")) if own else np.zeros(0, np.uint64)
            v = right.column("v").take(pa.array(own, pa.int64())).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), width).T.copy()
            index = Index(h)
            out = []
            for data in left.column("data"):
                for batch in pa.ipc.open_stream(data.as_py()):
                    texts = batch.column(at).to_pylist()
                    got = sums(texts, kind, order, width, lambda g: v[:, index.find(g.hashes)])
                    found = [bool(bad and t and not bad.isdisjoint(find(t))) for t in texts]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array(got[:, :width].ravel()))
                    out.append(pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(got[:, width]), pa.array(found, pa.bool_())], [*columns, "lg_sums", "lg_size", name]))
            return pa.Table.from_batches(out, out[0].schema if out else schema_of(left))

        data = blocks.select("lg_block", *columns).mapInArrow(packed, "lg_block long, data binary")
        schema = extended(docs, **{"lg_sums": "array<double>", "lg_size": "double", name: "boolean"})
        from pyspark.sql.pandas.types import to_arrow_schema

        empty = to_arrow_schema(schema)
        schema_of = lambda _: empty
        return data.groupBy("lg_block").cogroup(hits.groupBy("lg_block")).applyInArrow(score, schema)


#: Words of extra that are sent to executors; more of them go by way of sieves and joins.
FEW_WORDS = 50_000
#: Begins words among grams; no gram begins so.
WORD = "\x05\x05"


def sieve_array(words: DataFrame, scratch) -> np.ndarray:
    from .common import SIEVE, WORDS, sieve

    out = np.zeros(((1 << (SIEVE - 6)) // WORDS, WORDS), np.uint64)
    got = sieve(words, "word").toArrow()  # at most 2^16 rows
    out[got.column("lg_word").to_numpy()] = got.column("lg_bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
    return out.ravel()


def passing(words: set, bits: np.ndarray) -> list[str]:
    import xxhash

    words = list(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words), np.uint64, len(words))
    hit = bits[((h & np.uint64((len(bits) << 6) - 1)) >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)
    return [words[i] for i in np.flatnonzero(hit)]


def in_blocks(docs: DataFrame, scratch) -> DataFrame:
    """docs with lg_block: rows of a file by their number, the same in every attempt and however the file is split."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("lg_file"), F.col("_metadata.row_index").alias("lg_row"))
    except AnalysisException:  # not read from files
        docs = scratch.save(docs)
        rows = docs.select("*", F.col("_metadata.file_path").alias("lg_file"), F.col("_metadata.row_index").alias("lg_row"))
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-(got["chars"] or 0) // BLOCK_CHARS))
    per = max(1, -(-got["n"] // blocks))
    # small files share blocks
    block = F.xxhash64(F.pmod(F.xxhash64("lg_file"), F.lit(4 * blocks)), F.floor(F.col("lg_row") / per))
    return rows.withColumn("lg_block", block).drop("lg_file", "lg_row")


def train(df: DataFrame, scratch, order: int, kind: str, text: str = "text", model: str = "model") -> Tables | None:
    """A model for each value of `model`; None if no row has one."""
    probs, backs = kneser_ney(scratch.save(count_grams(df, order, kind, text, model)), order, scratch)
    names = sorted(r[0] for r in probs.select("model").distinct().collect())  # a row for each model
    return Tables(names, order, kind, probs, backs, scratch) if names else None
