"""SentencePiece encoding and decoding by streaming Viterbi.

The pieces come from a model file (a parameter; read by the driver, sent to the executors; its size is that of the
vocabulary). A text is a dummy space and its characters, spaces written as U+2581; the search keeps one best path to each
boundary between characters. Where the model has log probabilities, a path's score is their sum. Where it has merge ranks
(all scores are whole numbers), sums of ranks are no likelihood; a step then scores 0 if the model's own merges leave the
piece and the one before it side by side, and is impossible if they would not. Exactly one path to each boundary is
possible then, and its pieces are those that the merges give: the ids are the model's.

Characters that no piece covers are written as the byte pieces of their UTF-8 form (`BYTE_COST` below the lowest score); a
literal U+2581 is always written as bytes, so that decoding is exact (the model's own encoder takes it for a space).

`Codec.stream` is the only search. It looks at `longest` characters ahead of a boundary, keeps scores and back pointers
since the last commit, and every 4 * `longest` boundaries walks back from all surviving ends: where their paths meet, the
ids before are committed and their window is freed. Paths always meet where no piece can cross a boundary (before a space that
follows another character, and between any two characters that no piece has side by side); so `Codec.run` hands such stretches
to the search one by one, and remembers the ids of up to twice `CACHE` short ones. Tests hold the result with and without that
memory, and over the whole text in one search, to be equal.

Null or empty texts have no ids and decode to the empty text. Ties between segmentations go to the longer last piece. Very long
texts need memory for one window and the ids. Repeated rows are answered each; an empty table gives an empty table; columns
named as an output raise an error.
"""

from __future__ import annotations

import array
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, check_free, extended, released, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BYTE_COST = 10.0
NEVER = float("-inf")
#: A private-use character that stands for a literal U+2581 during the search.
LITERAL = "\ue000"
CACHE, CACHED_CHARS = 250_000, 64
#: Remembered answers about pairs of pieces, and beginnings of `HEAD` characters; up to twice as many are kept.
PAIRS, HEADS, HEAD = 200_000, 50_000, 5
CUTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def load(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 ordinary, 1 byte, 2 unused or control) in order of id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)]
    return [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds


class Apart(dict):
    """Whether the model's merges leave two pieces side by side; keys are before * width + piece, with width for no piece before."""

    def __init__(self, pieces: list[str], rank: dict[str, float]):
        self.pieces, self.rank, self.width, self.old = pieces, rank, len(pieces), {}

    def merged(self, chars: str) -> list[str]:
        """The pieces that merging neighbours, best rank and then leftmost first, gives."""
        parts, rank = list(chars), self.rank.get
        while len(parts) > 1:
            ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = max(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def __missing__(self, key: int) -> bool:
        out = self.old.get(key)
        if out is None:
            before, piece = divmod(key, self.width)
            wanted = [self.pieces[piece]] if before == self.width else [self.pieces[before], self.pieces[piece]]
            out = self.merged("".join(wanted)) == wanted
        if len(self) >= PAIRS:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Heads(dict):
    """Of `HEAD` characters or a shorter end: (length, id) of each piece that they begin with, and whether longer pieces begin with them."""

    def __init__(self, walk: dict[str, int]):
        self.walk, self.old = walk, {}

    def __missing__(self, head: str) -> tuple[tuple, bool]:
        out = self.old.get(head)
        if out is None:
            hits = [(k, self.walk.get(head[:k], -1)) for k in range(1, len(head) + 1)]
            out = tuple(x for x in hits if x[1] >= 0), len(head) == HEAD and head in self.walk
        if len(self) >= HEADS:
            self.old = dict(self)
            self.clear()
        self[head] = out
        return out


class Cuts(dict):
    """Remembered ids of cuts, as bytes; when full, the older half goes and what is met again is kept."""

    def __init__(self, solve):
        self.solve, self.old = solve, {}

    def __missing__(self, cut: str) -> bytes:
        ids = self.old.get(cut)
        if ids is None:
            ids = self.solve(cut)
        if len(cut) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[cut] = ids
        return ids


class Codec:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        self.text = [p.replace(SPACE, " ") for p in pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 0}
        self.scores, self.width = scores, len(pieces)
        ranked = all(scores[i] == int(scores[i]) for i in self.ids.values())
        self.apart = Apart(pieces, {p: scores[i] for p, i in self.ids.items()}) if ranked else None
        self.bytes = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.value = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.cost = min(scores[i] for i in self.ids.values()) - BYTE_COST
        #: Every piece, and -1 for every other beginning of one, so that a walk from a boundary ends where no piece goes on.
        self.walk: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.heads = Heads(self.walk)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Neighbouring characters within some piece; paths always meet between others.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cache = Cuts(self.solve)
        forms = [bytes([self.value[i]]) if i in self.value else t.encode("utf-8", "surrogatepass") for i, t in enumerate(self.text)]
        self.sizes = np.array([len(f) for f in forms], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.forms = np.frombuffer(b"".join(forms), np.uint8)

    def raw(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character."""
        return tuple(self.bytes[b] for b in (SPACE if char == LITERAL else char).encode("utf-8", "surrogatepass"))

    def advance(self, chars: str, at: int, stop: int, base: int, back: list, piece: list, score: list) -> None:
        """Takes the steps from boundaries at to stop of a model with scores."""
        n, get, known = len(chars), self.walk.get, self.ids
        for start in range(at, stop):
            k = start - base
            here = score[k]
            for end in range(start + 1, n + 1):
                hit = get(chars[start:end])
                if hit is None:
                    break
                k += 1
                if hit >= 0 and here + self.scores[hit] > score[k]:
                    score[k], back[k], piece[k] = here + self.scores[hit], start, hit
            if chars[start] not in known:
                cost, k = self.cost * len(self.raw(chars[start])), start - base + 1
                if here + cost > score[k]:
                    score[k], back[k], piece[k] = here + cost, start, self.width

    def advance_merges(self, chars: str, at: int, stop: int, base: int, back: list, piece: list, score: list) -> None:
        """Takes the steps of a model with merge ranks: every possible path scores 0, and the first to a boundary is the only one."""
        n, get, heads, apart, width, ids = len(chars), self.walk.get, self.heads, self.apart, self.width, self.ids
        for start in range(at, stop):
            k = start - base
            pair = width * piece[k]
            hits, longer = heads[chars[start : start + HEAD]]
            for size, hit in hits:
                if piece[k + size] < 0 and apart[pair + hit]:
                    back[k + size], piece[k + size] = start, hit
            if longer:
                for end in range(start + HEAD + 1, n + 1):
                    hit = get(chars[start:end])
                    if hit is None:
                        break
                    if hit >= 0 and piece[end - base] < 0 and apart[pair + hit]:
                        back[end - base], piece[end - base] = start, hit
            if piece[k + 1] < 0 and chars[start] not in ids:
                back[k + 1], piece[k + 1] = start, width

    def path(self, chars: str, base: int, meet: int, back: list, piece: list) -> list[int]:
        """The ids from boundary base to boundary meet."""
        out: list[int] = []
        k = meet
        while k > base:
            p = piece[k - base]
            if p < self.width:
                out.append(p)
            else:
                out.extend(reversed(self.raw(chars[k - 1])))
            k = back[k - base]
        out.reverse()
        return out

    def stream(self, chars: str):
        """Yields lists of committed ids of the best segmentation of chars, in which LITERAL stands for a literal U+2581.

        back, piece (-1: not reached; the number of pieces: raw bytes, or the start) and score hold the boundaries since the last commit.
        """
        n, step, advance = len(chars), 4 * self.longest, self.advance if self.apart is None else self.advance_merges
        base, at = 0, 0
        back, piece, score = [0], [self.width], [0.0]
        while at < n:
            stop = min(n, at + step)
            more = min(n, stop + self.longest) - base + 1 - len(back)
            back += [0] * more
            piece += [-1] * more
            score += [NEVER] * more
            advance(chars, at, stop, base, back, piece, score)
            at = meet = stop
            if at < n:
                ends = {k + base for k in range(at - base, len(back)) if piece[k] >= 0}
                while len(ends) > 1:  # the largest end steps back until all paths have met
                    last = max(ends)
                    ends.remove(last)
                    ends.add(back[last - base] if last > base else base)
                meet = ends.pop()
            if meet > base:
                yield self.path(chars, base, meet, back, piece)
                del back[: meet - base], piece[: meet - base], score[: meet - base]
                base = meet

    def solve(self, cut: str) -> bytes:
        """The ids of a cut: its parts between characters that no piece joins are segmented by themselves."""
        joined, body = self.joined, cut[1:]
        # plain letters go together in nearly all pairs, so looking for a gap among them is not worth it
        ends = [0] if body.isascii() and body.isalpha() else [0, *[k for k in range(1, len(cut)) if cut[k - 1 : k + 1] not in joined]]
        if len(ends) > 1:
            ends.append(len(cut))
            return b"".join([self.cache[cut[i:j]] for i, j in zip(ends, ends[1:])])
        if self.apart is None or len(cut) > 4 * self.longest:
            return b"".join([array.array("i", ids).tobytes() for ids in self.stream(cut)])
        n = len(cut)  # within one window of the search
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        piece[0] = self.width
        self.advance_merges(cut, 0, n, 0, back, piece, [])
        return array.array("i", self.path(cut, 0, n, back, piece)).tobytes()

    def whole(self, text: str) -> list[int]:
        """The ids of a text by one search over all of it, without the memory of stretches."""
        return [i for ids in self.stream((" " + text).replace(SPACE, LITERAL).replace(" ", SPACE)) for i in ids] if text else []

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        if not text:
            return b""
        if LITERAL in text:  # a private mark of this codec: its own bytes, by way of pieces of text without it
            own = array.array("i", [self.bytes[b] for b in LITERAL.encode()]).tobytes()
            return own.join([self.run(part, dummy=k == 0) for k, part in enumerate(text.split(LITERAL))])
        return self.run(text, dummy=True)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def run(self, text: str, dummy: bool) -> bytes:
        chars = (" " * dummy + text).replace(SPACE, LITERAL).replace(" ", SPACE)
        return b"".join(map(self.cache.__getitem__, [chars] if self.crossing else CUTS.findall(chars)))

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids that end at the given places."""
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = self.forms[np.repeat(self.starts[ids] - total[:-1], sizes) + np.arange(total[-1])]
        at = total[np.concatenate([[0], ends])]
        texts = [data[i:j].tobytes() for i, j in zip(at, at[1:])]
        return pa.array([(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()


_codecs: dict[str, Codec] = {}


def codec_for(path: str, model: tuple) -> Codec:
    """The codec of a worker, which lives on from task to task with what it knows of pairs; remembered cuts go."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(*model)
    codec = _codecs[path]
    codec.cache = Cuts(codec.solve)
    return codec


def encode(docs: DataFrame, path: str = MODEL, name: str = "ids") -> DataFrame:
    """Adds the ids of text."""
    check_free(docs, name)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # the vocabulary
    at = docs.columns.index("text")

    def run(batches):
        codec = codec_for(path, shared.value)
        for batch in batches:
            parts = [codec.encode_bytes(text or "") for text in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])
        codec.cache = Cuts(codec.solve)

    return docs.mapInArrow(released(run), extended(docs, **{name: "array<int>"}))


def decode(rows: DataFrame, path: str = MODEL, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of ids (null ids: empty)."""
    check_free(rows, name)
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(load(path))  # the vocabulary
    at = rows.columns.index(ids)

    def run(batches):
        codec = codec_for(path, shared.value)
        for batch in batches:
            column = batch.column(at)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = codec.decode_many(column.flatten().to_numpy(zero_copy_only=False), ends.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    return rows.mapInArrow(released(run), extended(rows, **{name: "string"}))


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids and whether decoding gives the text back. One worker does both, so that there are not two for each task."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # the vocabulary

    def run(batches):
        codec = codec_for(path, shared.value)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            parts = [codec.encode_bytes(text) for text in texts]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            ids = np.frombuffer(b"".join(parts), np.int32)
            back = codec.decode_many(ids, ends[1:]).to_pylist()
            exact = [a == b for a, b in zip(texts, back)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(exact, pa.bool_())], ["doc_id", "n_ids", "ids", "exact"])
        codec.cache = Cuts(codec.solve)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, n_ids long, ids array<int>, exact boolean")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
