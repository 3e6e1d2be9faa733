"""SentencePiece encoding and decoding by a batched numpy Viterbi (operator 9).

The vocabulary's pieces never hold a space mark after another character, so a text falls apart into words, each with the
space marks before it, and equal words have equal pieces. Words of all lengths advance together, a character at a
time: substrings are hashed and grown while they begin a piece, as a table of the hashes tells, and the maximum over the
pieces found that end there gives each word's backpointer. A word is first cut between any two characters that no piece holds side
by side, since no piece can reach over such a place; what is left of a long word is short, and advances like any other.

For a vocabulary of merges the best segmentation is not the one with the largest sum of scores, but the one that
merging would leave. Merging leaves exactly one piece at the end of each prefix: the one that, with the last piece before it,
makes a pair that merging keeps apart. So the maximum is taken over whether a piece makes such a pair, and ids equal those
of merging. Characters without a piece are written as bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import parts

SPACE = "▁"
#: Bytes, about, of the words that a Python worker keeps with their pieces, and characters of text that it encodes at a time.
KEPT, GROUP = 24 << 20, 1 << 18
#: Bytes that a kept word takes besides its characters, and ends of a word's substrings that are looked up at a time.
ENTRY, ENDS = 150, 256
#: Characters of words that advance together, about, and bits of the table of hashes.
TOGETHER, SLOTS = 1 << 17, 20
_P = np.uint64(0x9E3779B97F4A7C15)


def load(path: str) -> dict:
    """Pieces and scores of a SentencePiece model file of merges with byte fallback; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    plain = [not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)) for i in range(n)]
    pieces = [model.id_to_piece(i) for i in range(n)]
    if any(SPACE in p.lstrip(SPACE) for p, ok in zip(pieces, plain) if ok):
        raise ValueError("a piece holds a space mark after another character")
    return {"pieces": pieces, "plain": plain, "scores": [model.get_score(i) for i in range(n)], "bytes": [i for i in range(n) if model.is_byte(i)]}


class Codec:
    """Encodes and decodes with a loaded vocabulary; made once in each Python worker."""

    def __init__(self, vocabulary: dict) -> None:
        self.pieces = vocabulary["pieces"]
        n = len(self.pieces)
        self.byte = np.array(vocabulary["bytes"], np.int32)
        # what a piece decodes to: its characters, with spaces for marks, or the byte that it stands for
        out = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(self.pieces, vocabulary["plain"])]
        for b, i in enumerate(self.byte):
            out[i] = bytes([b])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        ids = {p: i for i, (p, ok) in enumerate(zip(self.pieces, vocabulary["plain"])) if ok}
        # order of merging: rank 0 first; a single character is never merged, so it comes last
        by_rank = sorted(ids.values(), key=lambda i: (len(self.pieces[i]) == 1, -vocabulary["scores"][i], i))
        self.rank = np.full(n + 1, 1 << 30, np.int64)
        self.rank[by_rank] = np.arange(len(by_rank))
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.merged: dict[tuple[int, int], int] = {}
        for i in by_rank:
            p = self.pieces[i]
            for cut in range(len(p) - 1, 0, -1):
                a, b = ids.get(p[:cut], -1), ids.get(p[cut:], -1)
                if a >= 0 and b >= 0 and all(len(self.pieces[x]) == 1 or self.rank[x] < self.rank[i] for x in (a, b)) and self.apart(a, b):
                    self.left[i], self.right[i], self.merged[a, b] = a, b, i
                    break
        # a piece that no merges make is never used
        self.whole = self.left >= 0
        self.whole[[i for i in by_rank if len(self.pieces[i]) == 1]] = True
        kept = [i for i in by_rank if self.whole[i]]
        self.longest = max(len(self.pieces[i]) for i in kept)
        self.chars = np.unique([ord(self.pieces[i]) for i in kept if len(self.pieces[i]) == 1]).astype(np.uint64)
        self.inside = np.unique(np.array([ord(a) << 32 | ord(b) for i in kept for a, b in zip(self.pieces[i], self.pieces[i][1:])], np.uint64))
        pairs = np.array([(a * (n + 1) + b, i) for (a, b), i in self.merged.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_key, self.pair_id, self.width = pairs[:, 0], pairs[:, 1], n + 1
        # every beginning of a piece, by its hash, with the piece that it is or none; the upper bits of a hash say where to look first
        known = {self.pieces[i]: i for i in kept}
        begins = sorted((self._hash(x), known.get(x, -1)) for x in {p[:l] for p in known for l in range(1, len(p) + 1)})
        self.key, self.key_id = np.array([h for h, _ in begins] + [(1 << 64) - 1], np.uint64), np.array([i for _, i in begins] + [-1], np.int32)
        slots = (self.key[:-1] >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << SLOTS)).astype(np.int32)
        self.crowd = int(np.bincount(slots).max())
        self.seen_key, self.seen = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.words: dict[str, int] = {}
        self._clear()

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h + ord(c) + 1) * int(_P)) & ((1 << 64) - 1)
            h ^= h >> 29
        return h

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: undoing their merges, latest first, never meets a pair that merges sooner."""
        limit = 1 << 40
        while True:
            both = self.merged.get((a, b))
            if both is not None and self.rank[both] < limit:
                return False
            # of equal ranks the left pair is merged first
            ra, rb = (self.rank[a] if self.left[a] >= 0 else -1), (self.rank[b] if self.left[b] >= 0 else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb or rb < 0:
                limit, a = ra, int(self.right[a])
            else:
                limit, b = rb + 1, int(self.left[b])

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """apart for many pairs, with those met before kept in a table."""
        pair = a * self.width + b
        slot = ((pair * -7046029254386353131) >> 44) & ((1 << 20) - 1)
        new = np.flatnonzero(self.seen_key[slot] != pair)
        out = self.seen[slot]
        if not len(new):
            return out
        fresh, back = np.unique(pair[new], return_inverse=True)
        x, y = fresh // self.width, fresh % self.width
        ok, limit, live = np.ones(len(fresh), bool), np.full(len(fresh), 1 << 40, np.int64), np.arange(len(fresh))
        while len(live):
            u, v = x[live], y[live]
            key = u * self.width + v
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            sooner = (self.pair_key[at] == key) & (self.rank[self.pair_id[at]] < limit[live])
            ok[live[sooner]] = False
            ru, rv = np.where(self.left[u] >= 0, self.rank[u], -1), np.where(self.left[v] >= 0, self.rank[v], -1)
            first = (ru > rv) | (rv < 0)
            limit[live] = np.where(first, ru, rv + 1)
            x[live], y[live] = np.where(first, self.right[u], u), np.where(first, v, self.left[v])
            live = live[~sooner & ((ru >= 0) | (rv >= 0))]
        out[new] = ok[back]
        self.seen_key[slot[new]], self.seen[slot[new]] = pair[new], ok[back]
        return out

    def _clear(self) -> None:
        self.words.clear()
        self.held = 0
        self.flat: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _found(self, chars: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that begin at these places and end before their stops: their first and last places and ids, shorter ones first."""
        firsts, lasts, ids = [], [], []
        hashes = np.zeros(len(at), np.uint64)
        for l in range(self.longest):
            hashes = (hashes + chars[at + l]) * _P
            hashes ^= hashes >> np.uint64(29)
            to = self.first[hashes >> np.uint64(64 - SLOTS)]
            for _ in range(self.crowd):
                to = to + (self.key[to] < hashes)
            live = np.flatnonzero(self.key[to] == hashes)
            at, stop, hashes, piece = at[live], stop[live], hashes[live], self.key_id[to[live]]
            hit = np.flatnonzero(piece >= 0)
            firsts.append(at[hit])
            lasts.append(at[hit] + l)
            ids.append(piece[hit])
            more = np.flatnonzero(at + l + 1 < stop)
            at, stop, hashes = at[more], stop[more], hashes[more]
            if not len(at):
                break
        return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(ids)

    def _together(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words that hold known characters only, longest word first, one after another in chars: all ids, word by word, and how many each has."""
        chars = chars + np.uint64(1)
        begins = np.cumsum(sizes) - sizes
        nth, n = (np.arange(len(chars)) - np.repeat(begins, sizes)).astype(np.int32), int(sizes[0])
        # the piece that ends at each place, and its length
        last, length = np.full(len(chars), -1, np.int32), np.ones(len(chars), np.int32)
        for done in range(0, n, ENDS):
            live = int(np.searchsorted(-sizes, -done))  # words of more characters
            low = max(0, done + 1 - self.longest)
            stop = begins[:live] + np.minimum(sizes[:live], done + ENDS)
            many = stop - begins[:live] - low
            starts = np.repeat(begins[:live] + low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            first, end, ids = self._found(chars, starts, np.repeat(stop, many))
            step = nth[end] - done  # below 0: done before
            order = np.argsort(np.where(step < 0, ENDS, step).astype(np.int16), kind="stable")
            first, end, ids = first[order], end[order], ids[order]
            inner = nth[first] > 0
            edges = np.cumsum([0, *np.bincount(step[step >= 0], minlength=min(ENDS, n - done))]).tolist()
            for a, b in zip(edges, edges[1:]):
                prev, piece, to, begun = last[first[a:b] - 1], ids[a:b], end[a:b], inner[a:b]
                fits = ~begun
                test = np.flatnonzero(begun & (prev >= 0))
                fits[test] = self._apart(prev[test].astype(np.int64), piece[test].astype(np.int64))
                at = to[fits]
                last[at] = piece[fits]  # the longest, which comes last
                length[at] = at - first[a:b][fits] + 1
        at, begun = begins + sizes - 1, begins
        if (last[at] < 0).any():
            raise ValueError("a word has no segmentation")
        used = np.zeros(len(chars), bool)  # where a piece of a word's segmentation ends
        while len(at):
            used[at] = True
            at = at - length[at]
            more = np.flatnonzero(at >= begun)
            at, begun = at[more], begun[more]
        return last[used], np.add.reduceat(used.astype(np.int64), begins)

    def _learn(self, words: list[str]) -> None:
        """Adds words to those kept, cut where no piece can reach over. A character without a piece is such a part of its own, and stands as bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        pair = chars[:-1] << np.uint64(32) | chars[1:]
        at = np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)
        cut = np.concatenate([[True], self.inside[at] != pair])
        cut[np.cumsum(sizes)[:-1]] = True
        begin = np.flatnonzero(cut)
        long = np.diff(np.append(begin, len(chars)))
        owner = np.searchsorted(np.cumsum(sizes), begin, side="right")
        first = np.minimum(np.searchsorted(self.chars, chars[begin]), len(self.chars) - 1)
        raw = np.flatnonzero(self.chars[first] != chars[begin])
        long[raw] = 0
        order, counts, flat = [raw], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        if len(raw):
            each = [chr(c).encode() for c in chars[begin[raw]].tolist()]
            counts.append(np.fromiter(map(len, each), np.int64, len(each)))
            flat.append(self.byte[np.frombuffer(b"".join(each), np.uint8)])
        by_length = np.argsort(-long, kind="stable")[: len(long) - len(raw)]
        ends, low = np.cumsum(long[by_length]), 0
        while low < len(by_length):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + TOGETHER)))
            some = by_length[low:high]
            n = long[some]
            ids, count = self._together(chars[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)
            order.append(some)
            counts.append(count)
            flat.append(ids)
            low = high
        at, size = np.concatenate(order), np.concatenate(counts)
        by_part = np.zeros(len(begin), np.int64)
        by_part[at] = size
        begins = np.cumsum(by_part) - by_part
        ids = np.empty(int(by_part.sum()), np.int32)
        ids[np.repeat(begins[at] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = np.concatenate(flat)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.held += len(words) * ENTRY + 4 * len(chars) + 4 * len(ids)
        self.flat.append(ids)
        self.sizes.append(np.bincount(owner, by_part, len(words)).astype(np.int64))

    def _of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.held > KEPT:
            self._clear()
        if fresh := list(set(words).difference(self.words)):
            self._learn(fresh)
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        begin = np.cumsum(self.sizes[0]) - self.sizes[0]
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[0][at]
        where = np.repeat(begin[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.flat[0][where], sizes

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text, each with the space marks before it; joined, they are the text with its first mark."""
        if not text:
            return []
        parts, out, marks = text.replace(SPACE, " ").split(" "), [], ""
        if "" not in parts:
            return [SPACE + p for p in parts]
        for p in parts:
            marks += SPACE
            if p:
                out.append(marks + p)
                marks = ""
        if marks:
            out.append(marks)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and how many each text has."""
        flats, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            if words:
                ids, sizes = self._of(words)
                flats.append(ids)
                np.add.at(counts, np.repeat([i for i, _ in owner], [n for _, n in owner]), sizes)
                words.clear()
                owner.clear()

        chars = 0
        for i, text in enumerate(texts):
            own = self.split(text or "")
            for a in range(0, len(own), GROUP // 8):
                words.extend(part := own[a : a + GROUP // 8])
                owner.append((i, len(part)))
                if (chars := chars + sum(map(len, part))) > GROUP:
                    flush()
                    chars = 0
        flush()
        return np.concatenate(flats), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids: pieces joined, marks as spaces, without the first; bytes that make no character become U+FFFD."""
        size = np.diff(self.out_at)[ids]
        ends = np.cumsum(size)
        text_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        out = []
        for k in range(0, len(counts), 256):
            lo, hi = int(np.cumsum(counts)[k - 1]) if k else 0, int(np.cumsum(counts)[min(k + 256, len(counts)) - 1])
            some, n = ids[lo:hi], size[lo:hi]
            where = np.repeat(self.out_at[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            raw, base = self.out[where].tobytes(), int(text_ends[k - 1]) if k else 0
            at = base
            for e in text_ends[k : k + 256]:
                text = raw[at - base : int(e) - base].decode(errors="replace")
                out.append(text[1:] if text[:1] == " " else text)
                at = int(e)
        return out


def encoded(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """docs with ids, n_ids and decoded_crc32: the pieces of each text, their number, and the crc32 of the text that they decode to.

    Ids equal those of merging; decoding gives the text back, except that U+2581, the space mark, comes back as a space.
    Defined results: a null or empty text has no ids and decodes to an empty text; a text without spaces, however
    long, is one word; equal texts have equal ids; a column of docs with a new one's name is replaced; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    new = ("ids", "n_ids", "decoded_crc32")
    kept = [c for c in docs.columns if c.lower() not in new]
    text = [c.lower() for c in kept].index("text")
    schema = T.StructType([*docs.select(*kept).schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("decoded_crc32", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in parts(batches, text, GROUP):
            ids, counts = codec.encode(batch.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            crcs = pa.array([zlib.crc32(t.encode()) for t in codec.decode(ids, counts)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counts), crcs], names=[*kept, *new])

    return docs.select(*kept).mapInArrow(apply, schema)


_CODECS: list[Codec] = []


def _codec(shared: Broadcast) -> Codec:
    """The codec of this Python worker, made anew only for another vocabulary."""
    if not _CODECS or _CODECS[0].pieces != shared.value["pieces"]:
        _CODECS[:] = [Codec(shared.value)]
    return _CODECS[0]
