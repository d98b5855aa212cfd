"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts that were not met before (a segment is the spaces before a word and the word; no piece
of a vocabulary that is split this way runs on past a word) are joined to one text. Its suffix array, to
the depth of the longest piece, is made from packed characters and ranks; every piece's range of occurrences is found by
binary search, all pieces at once; the occurrences are edges (position, piece), which are sorted by position.
Edges are then relaxed: for BPE models the best adjacent pair that makes a piece is joined until none is
left, for unigram models by the best path. Characters that no piece covers become byte pieces, or the
unknown piece if the model has none.

Null text: null ids; empty text: no ids. A null id: its row stays; repeated rows are rows of their own; extra columns are not read.
Vocabularies with pieces over 52 characters or over 2^20 pieces are refused (an edge is packed in 64 bits). Decoding gives back the text, but for U+2581, which the
vocabulary itself takes for a space, and lone surrogates. Models with a normaliser other than `identity`
need normalised text; user-defined symbols are refused.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_pieces, lean

SPACE = "▁"
LONG = 64  # longer segments are joined one by one, with a heap
WIDTHS = (8, 12, 16, 24, 40, LONG)  # shorter ones with those of about their length
CACHE, LEARN, BATCH = 400_000, 200_000, 3_000_000
NEVER = np.int32(2**31 - 1)
_SEGMENT = re.compile(r" *[^ ]+| +\Z")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[at] & 127) << shift
        shift += 7
        at += 1
        if b[at - 1] < 128:
            return out, at


def _fields(b: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at:at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if kind == 5 else "<d", b[at:at + n])[0], at + n
        yield key >> 3, value


class Model:
    """Pieces, scores and flags of a model file (the published ModelProto format)."""

    def __init__(self, proto: bytes):
        self.pieces, scores, kinds = [], [], []
        self.unigram, self.prefix, normaliser = True, True, b""
        for number, value in _fields(proto):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                scores.append(got.get(2, 0.0))
                kinds.append(got.get(3, 1))
            elif number == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                got = dict(_fields(value))
                self.prefix, normaliser = bool(got.get(3, 1)), got.get(2, b"")
                self.squeeze = bool(got.get(4, 1))
        if normaliser or self.squeeze:
            raise ValueError("only the identity normaliser without removal of spaces is supported")
        self.scores, kinds = np.array(scores, np.float64), np.array(kinds)
        if (kinds == 4).any():
            raise ValueError("user-defined symbols are not supported")
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.bytes = {int(self.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(kinds == 6)}
        self.normal = [int(i) for i in np.flatnonzero((kinds == 1) | (kinds == 5))]
        self.depth = max(len(self.pieces[i]) for i in self.normal)
        if self.depth > 52 or len(self.pieces) > 1 << 20:
            raise ValueError("pieces of over 52 characters, or over 2^20 pieces, are not supported")
        #: words can be taken one by one if no piece has a space after another character
        self.by_word = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in self.normal)
        chars = np.zeros((len(self.normal), self.depth), np.uint32)
        for k, i in enumerate(self.normal):
            p = self.pieces[i]
            chars[k, :len(p)] = [ord(c) for c in p]
        self.lengths = np.array([len(self.pieces[i]) for i in self.normal])
        self.ids = np.array(self.normal, np.int32)
        letters = np.unique(chars[chars > 0])
        #: letters are the characters of pieces, from 1; 0 is any other
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.spelled = self.letter[chars]
        self.single = np.full(len(letters) + 1, -1, np.int32)  # the piece that is a letter alone
        self.single[self.spelled[self.lengths == 1, 0]] = self.ids[self.lengths == 1]
        self.met, self.ready = np.zeros(len(letters) + 1, bool), None
        #: order in which BPE joins pairs: equal scores are equal; the last entry is for no piece
        self.priority = np.concatenate([np.unique(-self.scores, return_inverse=True)[1].astype(np.int32), [NEVER]]).astype(np.int32)
        #: the same before the column of a pair in a segment of at most LONG characters
        self.rank = np.where(self.priority == NEVER, NEVER, self.priority * LONG).astype(np.int32)
        # bytes that each id stands for
        raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        for i in np.flatnonzero((kinds == 3)):
            raw[i] = b""
        raw[self.unknown] = " ⁇ ".encode()
        self.raw_len = np.array([len(r) for r in raw])
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def packed(self, letters: np.ndarray) -> Packed:
        """Pieces that can occur in texts of the letters met so far, these included; made anew only when a letter is new."""
        here = np.zeros(len(self.met), bool)
        here[letters] = True
        here[0] = False
        if self.ready is None or (here & ~self.met).any():
            self.met |= here
            number = np.cumsum(self.met) * self.met
            bits = max(1, int(number.max()).bit_length())
            wide = 64 // bits
            piece = number[self.spelled]
            live = np.flatnonzero(((piece > 0) == (self.spelled > 0)).all(1))
            piece = np.concatenate([piece[live], np.zeros((len(live), -self.depth % wide), piece.dtype)], 1)
            low = _packed(piece[:, :wide], bits, False)
            order = np.argsort(low, kind="stable")
            live, piece = live[order], piece[order]
            self.ready = Packed(number.astype(np.uint64), bits, wide, piece, self.lengths[live], self.ids[live], low[order], _packed(piece[:, :wide], bits, True))
        return self.ready


class Packed(NamedTuple):
    """Numbers of letters (0: not met, or of no piece), their bits, how many 64 bits hold, and the pieces of letters met in the order of their
    first characters: numbers, lengths, ids, and the least and greatest key of what begins as they do."""

    number: np.ndarray
    bits: int
    wide: int
    piece: np.ndarray
    length: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray


@functools.lru_cache(maxsize=2)
def parsed(proto: bytes) -> Model:
    """The model, read once by a worker process that runs several tasks."""
    return Model(proto)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


class Edges:
    """Occurrences of pieces, sorted by position, then length: for each position a bit set of lengths and
    where its pieces begin. Pieces of one character are kept by position alone."""

    def __init__(self, keys: np.ndarray, one: np.ndarray):
        self.one, n, keys = one, len(one), np.sort(keys)
        count = np.bincount((keys >> np.uint64(26)).view(np.int64), minlength=n)
        self.ids = (keys & np.uint64((1 << 20) - 1)).astype(np.int32)
        self.first = np.cumsum(count) - count
        self.mask, some = np.zeros(n, np.uint64), np.flatnonzero(count)
        if len(some):
            self.mask[some] = np.bitwise_or.reduceat(np.uint64(1) << ((keys >> np.uint64(20)) & np.uint64(63)), self.first[some])

    def find(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Piece ids of (position, length of two or more), -1 where there is none."""
        if not len(self.ids):
            return np.full(np.shape(at), -1, np.int32)
        bit = np.uint64(1) << np.minimum(length, 63).astype(np.uint64)
        mask = self.mask[at]
        k = self.first[at] + np.bitwise_count(mask & (bit - np.uint64(1)))
        return np.where((mask & bit) != 0, self.ids[np.minimum(k, len(self.ids) - 1)], -1)

    def rows(self, start: int, end: int, depth: int) -> np.ndarray:
        """Ids by position (from start) and length, for a long segment."""
        at = np.repeat(np.arange(start, end), depth + 1)
        out = self.find(at, np.tile(np.arange(depth + 1), end - start)).reshape(-1, depth + 1)
        out[:, 1] = self.one[start:end]
        return out


def _packed(cols: np.ndarray, bits: int, fill: bool) -> np.ndarray:
    """Rows of character numbers as one uint64 each; with fill, those after the end (0) as all ones."""
    key, over = np.zeros(len(cols), np.uint64), np.zeros(len(cols), bool)
    for k in range(cols.shape[1]):
        over |= cols[:, k] == 0
        key = (key << np.uint64(bits)) | np.where(over & fill, np.uint64((1 << bits) - 1), cols[:, k].astype(np.uint64))
    return key


def occurrences(codes: np.ndarray, model: Model) -> Edges:
    """Suffix array of the codes, then every piece's range in it.

    As many characters as 64 bits hold are sorted at once; pieces longer than that are looked up in further
    levels, each of which sorts (rank so far, rank of the next characters) of the suffixes that such a piece can
    still match.
    """
    n = len(codes)
    letters = model.letter[codes]
    number, bits, wide, piece, length, ids, low, high = model.packed(letters)
    text = np.concatenate([number[letters], np.zeros(wide, np.uint64)])
    key = np.zeros(n, np.uint64)
    for d in range(wide):
        key <<= np.uint64(bits)
        key |= text[d:n + d]
    order = np.argsort(key)
    in_order = key[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    unique = in_order[new]
    rank0 = np.empty(n, np.int64)
    rank0[order] = np.cumsum(new)  # from 1; 0 is beyond the end
    found = []

    def gather(which, order, lo, hi):
        count = np.maximum(hi - lo, 0)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count)
        found.append((order[at].astype(np.uint64) << np.uint64(26)) | np.repeat((length[which].astype(np.uint64) << np.uint64(20)) | ids[which].astype(np.uint64), count))

    which = np.flatnonzero((length > 1) & (length <= wide))
    gather(which, order, np.searchsorted(in_order, low[which]), np.searchsorted(in_order, high[which], "right"))
    which = np.flatnonzero(length > wide)
    rank, base = rank0, len(unique) + 1
    prefix = np.searchsorted(unique, low[which])
    good = (prefix < len(unique)) & (unique[np.minimum(prefix, len(unique) - 1)] == low[which])
    which, prefix, suffixes = which[good], prefix[good] + 1, np.arange(n)
    level = 1
    while len(which):
        wanted = np.zeros(int(rank.max()) + 2, bool)
        wanted[prefix] = True
        on = wanted[rank]
        suffixes, rank = suffixes[on], rank[on]
        nxt = suffixes + level * wide
        pair = rank * base + np.where(nxt < n, rank0[np.minimum(nxt, n - 1)], 0)
        order = np.argsort(pair)
        in_order = pair[order]
        part = piece[which, level * wide:(level + 1) * wide]
        lo = np.searchsorted(in_order, prefix * base + np.searchsorted(unique, _packed(part, bits, False)) + 1)
        hi = np.searchsorted(in_order, prefix * base + np.searchsorted(unique, _packed(part, bits, True), "right") + 1)
        ends = length[which] <= (level + 1) * wide
        gather(which[ends], suffixes[order], lo[ends], hi[ends])
        new = np.concatenate([[True], in_order[1:] != in_order[:-1]])[:len(in_order)]
        ranks = np.cumsum(new)
        rank = np.empty(len(order), np.int64)
        rank[order] = ranks
        go = ~ends & (hi > lo)
        which, prefix = which[go], ranks[np.minimum(lo[go], len(ranks) - 1)] if len(ranks) else prefix[go]
        level += 1
    return Edges(np.concatenate(found), model.single[letters])


def _join_long(start: int, end: int, edge: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
    """The same joining of pairs for one long segment, with a heap."""
    stop = list(range(start + 1, end + 1))
    left, alive = list(range(-1, end - start - 1)), [True] * (end - start)
    heap: list[tuple[float, int, int]] = []

    def offer(i):
        j = stop[i] - start
        if j < end - start and stop[j] - (start + i) < edge.shape[1] and (p := edge[i, stop[j] - start - i]) >= 0:
            heapq.heappush(heap, (-scores[p], i, stop[j]))

    for i in range(end - start - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = stop[i] - start
        if not alive[i] or j >= end - start or not alive[j] or stop[j] != e:
            continue
        alive[j] = False
        stop[i] = e
        if e < end:
            left[e - start] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [(start + i, stop[i]) for i in range(end - start) if alive[i]]


def _best_path(start: int, end: int, edge: np.ndarray, scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Unigram: the path of best total score; a character of no piece costs 10 more than the least score."""
    n = end - start
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for i in range(n):
        for k in range(1, min(edge.shape[1] - 1, n - i) + 1):
            p = edge[i, k]
            s = best[i] + (scores[p] if p >= 0 else least - 10 if k == 1 else -np.inf)
            if s > best[i + k]:
                best[i + k], back[i + k] = s, i
    out, at = [], n
    while at:
        out.append((start + back[at], start + at))
        at = back[at]
    return out[::-1]


def encode_segments(segments: list[str], model: Model):
    """(ids, offsets) of segments, each given as its characters with spaces as U+2581."""
    text = "\0".join(segments) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
    edges = occurrences(codes, model)
    stop = np.zeros(len(codes), np.int64)  # where the symbol ends that begins here
    for k in np.flatnonzero(lens > (0 if model.unigram else LONG)):
        a, b = int(begin[k]), int(begin[k] + lens[k])
        edge = edges.rows(a, b, model.depth)
        got = _best_path(a, b, edge, model.scores, float(model.scores[model.ids].min())) if model.unigram else _join_long(a, b, edge, model.scores)
        stop[[x for x, _ in got]] = [x for _, x in got]
    for least, most in itertools.pairwise([0, *WIDTHS]):
        some = np.flatnonzero((lens > least) & (lens <= most) & (not model.unigram))
        if len(some):
            _join_short(begin[some], lens[some], most, edges, model, stop)
    at = np.flatnonzero(stop)
    ids = np.where(stop[at] == at + 1, edges.one[at], edges.find(at, stop[at] - at))
    offsets = np.concatenate([[0], np.cumsum(stop > 0)[begin + lens]])
    if (ids < 0).any():  # one character each
        none = np.flatnonzero(ids < 0)
        chars, which = np.unique(codes[at[none]], return_inverse=True)
        parts = [[model.bytes[b] for b in chr(c).encode("utf-8", "replace")] if model.bytes else [model.unknown] for c in chars.tolist()]
        size = np.ones(len(ids), np.int64)
        size[none] = np.array([len(p) for p in parts])[which]
        ends = np.cumsum(size)
        out = np.repeat(ids, size)
        out[out < 0] = np.concatenate([parts[k] for k in which.tolist()])
        ids, offsets = out, np.concatenate([[0], ends])[offsets]
    return ids, offsets


def _join_short(begin: np.ndarray, lens: np.ndarray, width: int, edges: Edges, model: Model, stop: np.ndarray) -> None:
    """Joins pairs in all segments at once, each of at most width characters, and sets where their symbols stop. A column of the matrices is a segment; in
    a row are the symbols that begin at its character, and the price of joining each with the next: its rank, then the row, so that the least is the
    first of equals."""
    n = len(begin)
    row = np.arange(width, dtype=np.int32)[:, None]
    price = model.rank[edges.find(np.minimum(begin + row, len(stop) - 1), np.array(2))] | row
    price[row + 1 >= lens] = NEVER
    end, left = np.repeat(row + 1, n, 1).ravel(), np.repeat(row - 1, n, 1).ravel()
    alive, flat = row < lens, price.ravel()
    gone = alive.ravel()
    while True:
        best = price.min(0)
        on = np.flatnonzero(best != NEVER)
        if not len(on):
            break
        i = best[on] & (LONG - 1)
        here = i * n + on
        second = end[here] * n + on
        e = end[second]
        end[here], flat[second], flat[here], gone[second] = e, NEVER, NEVER, False
        more = np.flatnonzero(e < lens[on])
        after = e[more] * n + on[more]
        left[after] = i[more]
        before = left[here]
        less = np.flatnonzero(before >= 0)
        # the new symbol with the next one, and the one before with the new symbol
        first, last, seg = np.concatenate([i[more], before[less]]), np.concatenate([end[after], e[less]]), np.concatenate([on[more], on[less]])
        flat[first * n + seg] = model.rank[edges.find(begin[seg] + first, last - first)] | first
    r, c = np.nonzero(alive)
    stop[begin[c] + r] = begin[c] + end[r * n + c]


class _Numbers(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Codec:
    """Encodes and decodes batches; segments met before are kept. Of more than CACHE those stay that were met most often, a quarter of
    CACHE at most."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self):
        self.known, self.met = _Numbers(), np.zeros(0, np.int64)
        self.at, self.size, self.vals, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32), 0

    def _thin(self):
        """Drops segments that were met once, and the rarer ones beyond a quarter of CACHE; counts begin anew."""
        often = np.flatnonzero(self.met > 1)
        often = np.sort(often[np.argsort(-self.met[often], kind="stable")[:CACHE // 4]])
        keys = list(self.known)
        known = [keys[k] for k in often.tolist()]
        at, size, vals = self.at[often], self.size[often], self.vals
        self._clear()
        if not known:
            return
        self.known.update(zip(known, range(len(known))))
        self.met, ends = np.zeros(len(known), np.int64), np.cumsum(size)
        self.used = int(ends[-1])
        self.vals = vals[np.repeat(at - (ends - size), size) + np.arange(self.used)]
        self.at, self.size = ends - size, size

    def _learn(self, keys: list[str]):
        """Encodes segments that known has just numbered, LEARN of their characters at a time or one segment: more would take more memory."""
        ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)) + 2)
        cuts = [0, *np.searchsorted(ends, np.arange(LEARN, int(ends[-1]), LEARN), "right").tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if a < b:
                self._learn_some(keys[a:b], len(self.known) - len(keys) + a)

    def _learn_some(self, keys: list[str], n: int):
        ids, offsets = encode_segments([(SPACE + k.replace(" ", SPACE)) if self.model.by_word else k for k in keys], self.model)
        m = n + len(keys)
        if m > len(self.at):
            more = np.zeros(max(m, 2 * len(self.at)) - len(self.at), np.int64)
            self.at, self.size = np.concatenate([self.at, more]), np.concatenate([self.size, more])
        if self.used + len(ids) > len(self.vals):
            self.vals = np.concatenate([self.vals, np.zeros(max(self.used + len(ids), 2 * len(self.vals)) - len(self.vals), np.int32)])
        self.at[n:m], self.size[n:m] = self.used + offsets[:-1], np.diff(offsets)
        self.vals[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _keys(self, text: str) -> list[str]:
        """Segments without their first space, which every segment has."""
        if not text:
            return []
        if not self.model.by_word:
            return [(SPACE if self.model.prefix else "") + text.replace(" ", SPACE)]
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        return [m[0][1:] for m in _SEGMENT.finditer(" " + text)]

    def encode(self, texts: list[str]):
        """(ids, offsets) of texts, one after another."""
        if self.model.by_word and not self.model.prefix:
            raise ValueError("models without a prefix space are not supported")
        if len(self.known) > CACHE:
            self._thin()
        words = [self._keys(t) for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        count = np.bincount(codes, minlength=len(self.known))
        count[:len(self.met)] += self.met
        self.met = count
        size = self.size[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.vals[np.repeat(self.at[codes] - (ends - size), size) + np.arange(total)]
        per = np.cumsum([len(w) for w in words]) if words else np.zeros(0, int)
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[per]]).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; the prefix space of the first piece is left out."""
        m = self.model
        size = m.raw_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = m.raw[np.repeat(m.raw_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[offsets]
        return [out[a:b][m.prefix and out[a:a + 1] == b" ":] for a, b in itertools.pairwise(cut.tolist())]


SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, SHA-256 of the ids as little-endian int32, whether decoding gives back the
    text) for each row; a narrow map, with the vocabulary read by each worker from model_path."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: under 1 MB

    @lean
    def run(batches):
        codec = Codec(parsed(shared.value))
        for keys, texts in in_pieces(batches, ["doc_id", "text"], BATCH // 2):
            ids, offsets = codec.encode([t or "" for t in texts])
            back = codec.decode(ids, offsets)
            here = [t is not None for t in texts]
            mask = pa.array([not h for h in here], pa.bool_())
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()),
                pa.array(np.diff(offsets), pa.int64(), mask=np.array([not h for h in here])),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=mask),
                pa.array([hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() if h else None for (a, b), h in zip(itertools.pairwise(offsets.tolist()), here, strict=True)], pa.string()),
                pa.array([b == t.encode("utf-8", "replace") if h else None for b, t, h in zip(back, texts, here, strict=True)], pa.bool_()),
            ], ["doc_id", "n_tokens", "ids", "ids_sha256", "round_trip"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def packer(spark: SparkSession, model_path: str, id_bytes: int = 2):
    """A function of Arrow batches that gives lists of their first column and of the ids of their last, a text, as little-endian integers of
    id_bytes: encode without the hash and the check of the way back."""
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: under 1 MB
    if len(Model(shared.value).pieces) > 1 << 8 * id_bytes:
        raise ValueError(f"the vocabulary does not fit in {id_bytes} bytes")

    def run(batches):
        codec = Codec(parsed(shared.value))
        for keys, texts in in_pieces(batches, ["doc_id", "body"], BATCH):
            ids, offsets = codec.encode([t or "" for t in texts])
            raw = ids.astype(f"<u{id_bytes}")
            yield keys, [None if t is None else raw[a:b].tobytes() for t, (a, b) in zip(texts, itertools.pairwise(offsets.tolist()), strict=True)]

    return run


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids: null text. Bytes that are no UTF-8 are replaced."""
    with open(model_path, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec(parsed(shared.value))
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1).to_pylist()
            flat = np.array(list(itertools.chain.from_iterable(x or [] for x in lists)), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x or []) for x in lists])]).astype(np.int64)
            texts = codec.decode(flat, offsets)
            yield pa.RecordBatch.from_arrays([keys, pa.array([None if x is None else t.decode("utf-8", "replace") for x, t in zip(lists, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return tokens.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, text string")
