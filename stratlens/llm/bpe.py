"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every distinct pre-token of a chunk gets a tree whose leaves hold ``rank << 32 | position`` of its
adjacent pairs.  The root is the leftmost lowest-rank merge; a merge changes three leaves, each a
point update of logarithmic cost; the tree is done when its root is infinite.  Trees of one width
advance together as rows of one array; a very long pre-token has a tree of its own (``SegmentTree``).

Defined results: null and empty texts have no ids and decode to the empty text; text of a special
token becomes its id, as the library does by default; invalid bytes decode to U+FFFD; extra columns
pass through.  A column named like a result (``ids``, ``decoded``) is replaced by it.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_column, chunks, flat_utf8, frugal, ranges, small_batches, word_codes

NONE = np.int64(1) << 62
CHUNK = 1 << 20
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(1)
def char_classes() -> np.ndarray:
    """White space, letter, number or other, for every code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = _LETTER
        elif kind == "N":
            table[cp] = _DIGIT
    for cp in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[cp] = _SPACE
    return table


def pretokens(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens over code points; ``firsts`` are the starts of non-empty texts.

    Contractions, an optional single blank before letters, numbers or other characters, and white
    space that leaves its last character to what follows.
    """
    n = len(points)
    kind = char_classes()[points]
    start = np.zeros(n + 1, bool)
    text_start = np.zeros(n + 1, bool)
    text_start[firsts] = True
    text_start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= text_start
    run = np.flatnonzero(start)  # with n at the end
    begin, end = run[:-1], run[1:]
    what = kind[begin]
    # a run of white space before more of the same text: its last character is split off, and a blank joins what follows
    s = (what == _SPACE) & ~text_start[end]
    last = end[s] - 1
    start[last] = True
    glued = points[last] == 0x20
    start[last[glued] + 1] = False
    # contractions: a lone apostrophe that begins a token, then letters
    lone = (what == _OTHER) & (end - begin == 1)
    lone[lone] &= points[begin[lone]] == 0x27
    at = begin[lone]
    at = at[start[at] & (at + 1 < n)]
    at = at[(kind[at + 1] == _LETTER) & ~text_start[at + 1]]
    if len(at):
        one = points[at + 1]
        has2 = (at + 2 < n) & ~text_start[np.minimum(at + 2, n)]
        two = np.where(has2, points[np.minimum(at + 2, n - 1)], 0)
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for hit, width in ((short, 2), (long, 3)):
            start[at[hit] + 1] = False
            start[at[hit] + width] = True
    return np.flatnonzero(start[:n])


class SegmentTree:
    """The tree of one sequence of symbols; ``merge_all`` returns the symbols left."""

    def __init__(self, symbols, lookup):
        self.sym, self.lookup, n = list(symbols), lookup, len(symbols)
        self.next, self.prev = list(range(1, n + 1)), list(range(-1, n - 1))
        self.size = 1
        while self.size < max(1, n - 1):
            self.size *= 2
        none = int(NONE)
        self.tree = [none] * (2 * self.size)
        self.new = [0] * n
        for i in range(n - 1):
            self.tree[self.size + i] = self._leaf(i)
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def _leaf(self, i: int) -> int:
        j = self.next[i]
        if j >= len(self.sym):
            return int(NONE)
        found = self.lookup.get((self.sym[i] << 32) | self.sym[j])
        if found is None:
            return int(NONE)
        self.new[i] = found[1]
        return found[0] << 32 | i

    def _set(self, i: int, value: int) -> None:
        tree, i = self.tree, self.size + i
        tree[i] = value
        while i > 1:
            i //= 2
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def merge_all(self) -> list[int]:
        n = len(self.sym)
        while n > 1 and self.tree[1] < NONE:
            i = self.tree[1] & 0xFFFFFFFF
            j = self.next[i]
            self.sym[i] = self.new[i]
            self.next[i] = k = self.next[j]
            if k < n:
                self.prev[k] = i
            if j < n - 1:
                self._set(j, int(NONE))
            if i < n - 1:
                self._set(i, self._leaf(i))
            if self.prev[i] >= 0:
                self._set(self.prev[i], self._leaf(self.prev[i]))
        out, i = [], 0
        while i < n:
            out.append(self.sym[i])
            i = self.next[i]
        return out


class Codec:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without a normaliser or a prefix blank is supported")
        vocab, symbol = model["vocab"], _byte_symbols()
        byte_of = {c: b for b, c in symbol.items()}
        self.byte_id = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookup = {}
        for rank, (a, b) in enumerate(pairs):
            self.lookup.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self._table()
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        pieces = [b""] * size
        for text, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in text)
        self.special = {}
        for t in spec.get("added_tokens", []):
            pieces[t["id"]] = t["content"].encode()
            self.special[t["content"].encode()] = t["id"]
        self.special_len = {i: len(text) for text, i in self.special.items()}
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_data = np.frombuffer(b"".join(pieces), np.uint8)
        self.cache_hash, self.cache_off, self.cache_ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _table(self) -> None:
        """An open hash table of the pairs, for lookups of whole arrays."""
        keys = np.fromiter(self.lookup, np.int64, len(self.lookup))
        value = np.array([self.lookup[int(k)] for k in keys], np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(2, 4 * len(keys))))))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_val = np.full((1 << self.bits, 2), NONE, np.int64)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + probe) & ((1 << self.bits) - 1)
            free = self.slot_key[at] < 0
            at, one = np.unique(at[free], return_index=True)
            put = left[free][one]
            self.slot_key[at], self.slot_val[at] = keys[put], value[put]
            left, probe = np.setdiff1d(left, put), probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they don't merge) and merged id of pairs."""
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        rank = np.full(len(key), NONE)
        new = np.zeros(len(key), np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            seen = self.slot_key[slot[todo]]
            hit = seen == key[todo]
            where = todo[hit]
            rank[where], new[where] = self.slot_val[slot[where]].T
            todo = todo[~hit & (seen >= 0)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return rank, new

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[start : start + length], concatenated, and how many each has."""
        count = length.copy()
        ids = self.byte_id[data[ranges(start, length)]]  # in place: a merged symbol stays at its first byte
        base = np.cumsum(length) - length
        alive = np.ones(len(ids), bool)
        width = np.where(length > 1, 2 ** np.ceil(np.log2(np.maximum(length - 1, 1))).astype(np.int64), 0)
        for size in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == size)
            if size > 64:
                for r in rows:
                    lo, hi = base[r], base[r] + length[r]
                    left = SegmentTree(ids[lo:hi].tolist(), self.lookup).merge_all()
                    ids[lo : lo + len(left)] = left
                    alive[lo + len(left) : hi] = False
                    count[r] = len(left)
                continue
            step = max(1, (1 << 21) // int(size))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                count[part] = self._grow(ids, alive, base[part], length[part], int(size))
        return ids[alive].astype(np.int32), count

    def _grow(self, ids: np.ndarray, alive: np.ndarray, base: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
        """Trees of one width, all merging at once: one merge per tree and round."""
        w, cols = len(base), size + 3
        pos = np.arange(size + 1)
        inside = pos[None, :] < length[:, None]
        sym = np.full((w, cols), -1, np.int64)
        sym[:, : size + 1][inside] = ids[ranges(base, length)]
        tree = np.full((w, 2 * size), NONE)
        new = np.zeros((w, size), np.int64)
        nxt = np.broadcast_to(np.arange(1, cols + 1, dtype=np.int16), (w, cols)).copy()
        prv = np.broadcast_to(np.arange(-1, cols - 1, dtype=np.int16), (w, cols)).copy()
        pair = pos[None, :size] + 1 < length[:, None]
        rank, made = self.rank(sym[:, :size][pair], sym[:, 1 : size + 1][pair])
        leaf = np.full((w, size), NONE)
        leaf[pair] = rank
        leaf = np.where(leaf < NONE, (leaf << 32) | pos[:size], NONE)
        new[pair] = made
        tree[:, size:] = leaf
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree1, sym1, new1, nxt1, prv1 = tree.ravel(), sym.ravel(), new.ravel(), nxt.ravel(), prv.ravel()
        left = length.copy()
        act = np.flatnonzero(tree[:, 1] < NONE)
        while len(act):
            i = tree1[act * 2 * size + 1] & 0xFFFFFFFF
            row = act * cols
            j = nxt1[row + i].astype(np.int64)
            k = nxt1[row + j].astype(np.int64)
            sym1[row + i] = new1[act * size + i]
            nxt1[row + i] = k
            prv1[row + k] = i
            sym1[row + j] = -1
            left[act] -= 1
            h = prv1[row + i].astype(np.int64)
            # three leaves change: j vanishes, i and its predecessor h have new pairs
            val, mid = self.rank(sym1[row + i], sym1[row + k])
            new1[act * size + np.minimum(i, size - 1)] = np.where(i < size, mid, new1[act * size + np.minimum(i, size - 1)])
            self._update(tree1, act, size, j, np.full(len(act), NONE))
            self._update(tree1, act, size, i, np.where((val < NONE) & (k < length[act]), (val << 32) | i, NONE))
            has = h >= 0
            a2, h2 = act[has], h[has]
            val, mid = self.rank(sym1[row[has] + h2], sym1[row[has] + i[has]])
            new1[a2 * size + h2] = mid
            self._update(tree1, a2, size, h2, np.where(val < NONE, (val << 32) | h2, NONE))
            act = act[tree1[act * 2 * size + 1] < NONE]
        ok = sym[:, : size + 1] >= 0
        where = ranges(base, length)
        keep = ok[inside]
        ids[where] = np.where(keep, sym[:, : size + 1][inside], 0)
        alive[where] = keep
        return left

    @staticmethod
    def _update(tree: np.ndarray, row: np.ndarray, size: int, leaf: np.ndarray, value: np.ndarray) -> None:
        real = leaf < size
        if not real.all():
            row, leaf, value = row[real], leaf[real], value[real]
        at, node = row * (2 * size), leaf + size
        tree[at + node] = value
        while size > 1:
            node >>= 1
            tree[at + node] = np.minimum(tree[at + 2 * node], tree[at + 2 * node + 1])
            size >>= 1

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[off[i]:off[i+1]], concatenated, and their offsets."""
        lo, hi = int(off[0]), int(off[-1])
        data, off = data[lo:hi], off - lo
        raw = data.tobytes()
        cuts, forced = [], []
        for text, i in self.special.items():
            at = raw.find(text)
            while at >= 0:
                doc = int(np.searchsorted(off, at, side="right")) - 1
                if at + len(text) <= off[doc + 1]:
                    cuts += [at, at + len(text)]
                    forced.append((at, i))
                at = raw.find(text, at + len(text))
        firsts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], [c for c in cuts if c < len(data)]]).astype(np.int64))
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = (data & 0xC0) != 0x80
        byte_at = np.flatnonzero(lead)
        point_at = firsts if len(byte_at) == len(data) else np.searchsorted(byte_at, firsts)
        starts = byte_at[pretokens(points, point_at)] if len(points) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))
        if forced:  # a special token is one pre-token of its own, whatever it is made of
            begin, ids = np.array(sorted(forced)).T
            size = np.array([self.special_len[i] for i in ids.tolist()])
            at = np.searchsorted(begin, starts, side="right") - 1
            inside = (at >= 0) & (starts < begin[at] + size[at])
            heads = inside & (starts == begin[at])
            ends[heads] = (begin + size)[at[heads]]
            starts, ends = starts[~inside | heads], ends[~inside | heads]
        token_ids, per = self._unique(data, starts, ends, dict(forced))
        before = np.concatenate([[0], np.cumsum(per)])
        return token_ids, before[np.searchsorted(starts, off)] if len(starts) else np.zeros(len(off), np.int64)

    def _unique(self, data, starts, ends, forced) -> tuple[np.ndarray, np.ndarray]:
        """Merge each distinct pre-token once; hashes only group them, bytes confirm the groups."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        length = ends - starts
        code = word_codes(data, starts, ends)
        if forced:
            code[np.searchsorted(starts, np.fromiter(forced, np.int64))] = np.fromiter(forced.values(), np.uint64)
        seen, first, back = np.unique(code, return_index=True, return_inverse=True)
        same = data[ranges(starts, length)] == data[ranges(starts[first][back], length)] if (length == length[first][back]).all() else np.zeros(1, bool)
        if not same.all():  # two pre-tokens with one hash: group by bytes instead
            raw, table = data.tobytes(), {}
            back = np.array([table.setdefault((raw[s:e], forced.get(int(s))), len(table)) for s, e in zip(starts, ends)])
            first = np.unique(back, return_index=True)[1]
            seen = None
        ids, count = self._cached(data, starts[first], length[first], seen, forced)
        at = np.cumsum(count) - count
        return ids[ranges(at[back], count[back])], count[back]

    def _cached(self, data, start, length, code, forced):
        known = np.full(len(start), -1, np.int64)
        if code is not None and len(self.cache_hash):
            at = np.minimum(np.searchsorted(self.cache_hash, code), len(self.cache_hash) - 1)
            hit = self.cache_hash[at] == code
            known[hit] = at[hit]
        fresh = np.flatnonzero(known < 0)
        ids, count = self.merge(data, start[fresh], length[fresh])
        if forced:  # replace the merged symbols of a special token by its id
            own = np.array([forced.get(at, -1) for at in start[fresh].tolist()])
            if (own >= 0).any():
                off = np.cumsum(count) - count
                keep = np.repeat(own < 0, count)
                keep[off[own >= 0]] = True
                ids[off[own >= 0]] = own[own >= 0]
                ids, count = ids[keep], np.where(own >= 0, 1, count)
        off = np.cumsum(count) - count
        full_count = np.zeros(len(start), np.int64)
        full_at = np.zeros(len(start), np.int64)
        full_count[fresh] = count
        full_at[fresh] = off + len(self.cache_ids)
        old = np.flatnonzero(known >= 0)
        full_at[old] = self.cache_off[known[old]]
        full_count[old] = self.cache_off[known[old] + 1] - self.cache_off[known[old]]
        pool = np.concatenate([self.cache_ids, ids])
        out = pool[ranges(full_at, full_count)]
        if code is not None and not forced and len(self.cache_hash) < 150_000:  # short pre-tokens recur; the bound keeps a worker small
            short = length <= 12
            short[old] = True
            keep = np.flatnonzero(short)[:300_000]
            merged = np.concatenate([self.cache_hash, code[keep]])
            self_len = np.concatenate([np.diff(self.cache_off), full_count[keep]])
            self_at = np.concatenate([self.cache_off[:-1], full_at[keep]])
            self.cache_hash, one = np.unique(merged, return_index=True)
            self.cache_ids = pool[ranges(self_at[one], self_len[one])]
            self.cache_off = np.concatenate([[0], np.cumsum(self_len[one])])
        return out, full_count

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes the ids stand for, concatenated, and the offsets of the texts."""
        size = self.piece_len[ids]
        data = self.piece_data[ranges(self.piece_at[ids], size)]
        return data, np.concatenate([[0], np.cumsum(size)])[off]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _valid_text(data: np.ndarray, off: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    try:
        raw.decode("utf-8")  # the cuts may still fall inside characters
        if not len(data) or not ((data[off[:-1][np.diff(off) > 0]] & 0xC0) == 0x80).any():
            return binary_column(raw, off, pa.string())
    except UnicodeDecodeError:
        pass
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])], pa.string())


def _plan(df: DataFrame, drop: list[str], add: list[tuple[str, T.DataType]]) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in {n for n, _ in add}]
    return [f.name for f in kept], T.StructType([*kept, *(T.StructField(n, t) for n, t in add)])


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False, keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit integers as binary) and, if asked, their ``decoded`` text."""
    add = [("ids", T.BinaryType())] + [("decoded", T.StringType())] * decoded
    names, schema = _plan(df, [] if keep_text else [text], add)

    def run(batches):
        c = codec(path)
        for batch in batches:
            data, off = flat_utf8(batch.column(batch.schema.get_field_index(text)))
            for lo, hi in chunks(off, CHUNK):
                ids, at = c.encode(data, off[lo : hi + 1])
                part = batch.slice(lo, hi - lo)
                cols = [part.column(part.schema.get_field_index(n)) for n in names]
                cols.append(binary_column(ids.astype("<u4"), at * 4))
                if decoded:
                    cols.append(_valid_text(*c.decode(ids, at)))
                yield pa.RecordBatch.from_arrays(cols, [*names, *(n for n, _ in add)])

    return small_batches(df).mapInArrow(frugal(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ``ids`` column."""
    names, schema = _plan(df, [], [("decoded", T.StringType())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            data, off = flat_utf8(batch.column(batch.schema.get_field_index(ids)))
            for lo, hi in chunks(off, CHUNK):
                values = np.frombuffer(data[off[lo] : off[hi]].tobytes(), "<u4").astype(np.int64)
                part = batch.slice(lo, hi - lo)
                cols = [part.column(part.schema.get_field_index(n)) for n in names]
                cols.append(_valid_text(*c.decode(values, (off[lo : hi + 1] - off[lo]) // 4)))
                yield pa.RecordBatch.from_arrays(cols, [*names, "decoded"])

    return small_batches(df).mapInArrow(frugal(run), schema)


def digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a table of documents."""
    out = encode(df.select("doc_id", "text"), path, decoded=True, keep_text=False)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
