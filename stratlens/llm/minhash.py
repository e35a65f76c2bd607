"""Near-duplicate documents by b-bit MinHash.

Every text gets ``hashes`` minima over its distinct word shingles.  Bands of whole minima propose
candidates; of each minimum only the lowest ``bits`` bits are kept, packed into a signature, and the
similarity of candidates is estimated from the matching signature bits, corrected for chance
collisions.  Pairs whose estimate is not far below the threshold are confirmed on full shingle sets.

Documents with equal sets are one class and are compared once; a class is named by a 128-bit hash of
its set, so neither null nor repeated ids matter.  The sets of candidates are made once, from whole
texts.  A group of candidates of any size is compared in tiles of bounded size, and a tile emits a
spanning forest, never all of its pairs.

Defined results: there is one row for each row of the table.  A null text, or one without words, has an
empty set and is linked with nothing; a text with fewer words than a shingle has its whole word
sequence as its only shingle.  Rows that share a doc_id are judged each by its own text.  A null doc_id
is never a component_id unless its whole component has none; then component_id is null and the rows are
kept.  Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U64, ascii_lower, binary_column, chunks, components, flat_utf8, frugal, mix64, ranges, small_batches, tiled, union_find, word_codes

CHUNK = 1 << 19
TILE, TILE_SHINGLES = 512, 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, and their offsets."""
    lo = int(off[0])
    data, off = ascii_lower(data[lo : int(off[-1])]), off - lo
    n = len(off) - 1
    word = ~_BLANK[data]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    start = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    end = np.flatnonzero(stop) + 1
    code = word_codes(data, start, end)
    first = np.searchsorted(start, off)
    words = np.diff(first)
    have = np.maximum(words - size + 1, 0)
    have[(words > 0) & (have == 0)] = 1
    at = ranges(first[:-1], have)
    doc = np.repeat(np.arange(n), have)
    width = np.minimum(words, size)[doc]
    out = np.full(len(at), U64(0x5851F42D4C957F2D))
    for k in range(size):
        use = width > k
        out[use] = mix64(out[use] * U64(0xD6E8FEB86659FD93) + code[at[use] + k])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(n + 1))


def coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def minima(sets: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """(documents, hashes) 32-bit minima; documents without shingles must not be asked for."""
    mul, add = coefficients(hashes)
    out = np.empty((len(at) - 1, hashes), np.uint32)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat((sets * mul[k] + add[k]) >> U64(32), at[:-1]).astype(np.uint32)
    return out


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each minimum, as rows of 64-bit words."""
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.reshape(len(low), -1).astype(np.uint8), axis=1).view("<u8")


def estimate(a: np.ndarray, b: np.ndarray, hashes: int, bits: int) -> np.ndarray:
    """Similarity of all pairs of signatures, corrected for the 2**-bits chance that low bits agree by luck."""
    if bits not in (1, 2, 4):
        raise ValueError("bits must be 1, 2 or 4")
    diff = np.zeros((len(a), len(b)), np.int32)
    lowest = {1: 0xFFFFFFFFFFFFFFFF, 2: 0x5555555555555555, 4: 0x1111111111111111}[bits]
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        if bits > 1:
            x = x | (x >> U64(1))
        if bits > 2:
            x = x | (x >> U64(2))
        diff += np.bitwise_count(x & U64(lowest)).astype(np.int32)
    chance = 2.0**-bits
    return (1 - diff / hashes - chance) / (1 - chance)


class Settings:
    """Production parameters.  A pair at the threshold shares a band with probability 1 - (1 - t**rows)**bands
    (at 0.8 with 32 bands all but 5e-8, at 0.85 with 16 all but 7e-6), and its estimate is below ``floor`` with
    probability 1e-5 at most."""

    def __init__(self, size: int = 5, percent: int = 80, hashes: int = 128, bands: int = 32, rows: int = 4, bits: int = 2, slack: float = 0.2):
        if not bands * rows <= hashes:
            raise ValueError("bands * rows must not exceed hashes")
        self.size, self.percent, self.hashes, self.bands, self.rows, self.bits = size, percent, hashes, bands, rows, bits
        self.floor = percent / 100 - slack


def _classes(sets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each set, as two words; ``own`` are the starts of sets that are not empty."""
    return np.column_stack([np.add.reduceat(mix64(sets + U64(11)), own), np.bitwise_xor.reduceat(mix64(sets + U64(29)), own)])


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, row (by which a text is found again) and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def signatures(docs: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """doc_id, row, n_shingles, cls (hash of the whole set), bands (64-bit keys) and sig (packed low bits)."""

    def run(batches):
        for batch in batches:
            data, off = flat_utf8(batch.column(2))
            for lo, hi in chunks(off, CHUNK):
                sets, at = shingles(data, off[lo : hi + 1], s.size)
                count = np.diff(at)
                full = np.flatnonzero(count)
                n = hi - lo
                cls, sig_n, band_n = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                keys, sig = np.zeros((0, s.bands), np.int64), np.zeros((0, 1), np.uint64)
                if len(full):
                    own = at[:-1][full]
                    cls[full] = _classes(sets, own)
                    low = minima(sets, np.append(own, len(sets)), s.hashes)
                    sig, sig_n[full] = pack(low, s.bits), s.hashes * s.bits // 8
                    band = low[:, : s.bands * s.rows].reshape(len(full), s.bands, s.rows).astype(np.uint64)
                    key = np.broadcast_to(np.arange(s.bands, dtype=np.uint64) * U64(0x9E3779B97F4A7C15), (len(full), s.bands)).copy()
                    for k in range(s.rows):
                        key = mix64(key * U64(0xD6E8FEB86659FD93) + band[:, :, k])
                    keys, band_n[full] = key.view(np.int64), s.bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(band_n)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(count), binary_column(cls.view(np.uint8).ravel(), np.arange(n + 1) * 16), lists,
                        binary_column(sig.view(np.uint8).ravel(), np.concatenate([[0], np.cumsum(sig_n)])),
                    ],
                    ["doc_id", "row", "n_shingles", "cls", "bands", "sig"],
                )

    return small_batches(_rows(docs, text)).mapInArrow(frugal(run), "doc_id long, row long, n_shingles long, cls binary, bands array<long>, sig binary")


def _sets(s: Settings):
    """cls, component, n, sig and the shingles (binary) of the texts whose class is the one asked for."""

    def run(batches):
        for batch in batches:
            data, off = flat_utf8(batch.column(2))
            want, at0 = flat_utf8(batch.column(0))
            want = np.frombuffer(want[at0[0] : at0[-1]].tobytes(), np.uint64).reshape(-1, 2)
            for lo, hi in chunks(off, CHUNK):
                sets, at = shingles(data, off[lo : hi + 1], s.size)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                own = at[:-1][full]
                mine = (_classes(sets, own) == want[lo:hi][full]).all(axis=1)
                sig = pack(minima(sets, np.append(own, len(sets)), s.hashes), s.bits)[mine]
                full = full[mine]
                size = np.diff(at)[full]
                pick = pa.array(lo + full)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pick), batch.column(1).take(pick), pa.array(size), binary_column(sig.view(np.uint8).ravel(), np.arange(len(full) + 1) * sig.shape[1] * 8),
                        binary_column(sets[ranges(at[:-1][full], size)].view(np.uint8), np.concatenate([[0], np.cumsum(size * 8)])),
                    ],
                    ["cls", "component", "n", "sig", "shingles"],
                )

    return run


def _forest(ids: pa.Array, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
    """(node, node reached) for the nodes that are not the first of their own."""
    root = union_find(len(ids), left.tolist(), right.tolist())
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(root[moved]))], ["u", "v"]) if len(moved) else None


def _words(column, rows: int) -> np.ndarray:
    """A binary column of equal lengths as rows of 64-bit words."""
    data, off = flat_utf8(column)
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), "<u8").reshape(rows, -1)


def _groups(batches, key_columns: int):
    """Consecutive rows with equal leading columns, as tables; rows arrive sorted by them."""
    held: list[pa.RecordBatch] = []

    def merged():
        return pa.Table.from_batches(held).combine_chunks()

    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            mine = tuple(c[lo] for c in cols)
            if held and mine != key:
                yield key, merged()
                held = []
            key = mine
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, merged()


def _candidate_links(s: Settings):
    def run(batches):
        for (_, i, j), rows in _groups(batches, 3):
            sig, tile = _words(rows.column("sig"), rows.num_rows), rows.column("_t").to_numpy()
            near = estimate(sig, sig, s.hashes, s.bits) >= s.floor
            if i != j:  # pairs inside one tile belong to that tile's own task
                near &= tile[:, None] != tile[None, :]
            out = _forest(rows.column("cls").combine_chunks(), *np.nonzero(np.triu(near, 1)))
            if out:
                yield out

    return run


def _confirmed_links(s: Settings):
    def run(batches):
        for (_, i, j), rows in _groups(batches, 3):
            sig, tile, size = _words(rows.column("sig"), rows.num_rows), rows.column("_t").to_numpy(), rows.column("n").to_numpy()
            data, off = flat_utf8(rows.column("shingles"))
            near = np.triu(estimate(sig, sig, s.hashes, s.bits), 1)
            ok = near >= s.floor
            if i != j:
                ok &= tile[:, None] != tile[None, :]
            small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
            ok &= 100 * small >= s.percent * large  # a smaller set can't fill the share asked for
            a, b = np.nonzero(ok)
            best = np.argsort(-near[a, b], kind="stable")
            parent = list(range(rows.num_rows))

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            def of(x):
                return np.frombuffer(data[off[x] : off[x + 1]].tobytes(), "<u8")

            for x, y in zip(a[best].tolist(), b[best].tolist()):
                rx, ry = root(x), root(y)
                if rx == ry:
                    continue
                both = np.concatenate([of(x), of(y)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= s.percent * (len(both) - common):
                    parent[max(rx, ry)] = min(rx, ry)
            top = np.array([root(x) for x in range(rows.num_rows)])
            moved = np.flatnonzero(top != np.arange(rows.num_rows))
            if len(moved):
                ids = rows.column("cls").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(top[moved]))], ["u", "v"])

    return run


def _by_tile(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).repartition(*columns[:3]).sortWithinPartitions(*columns[:3])


def near_duplicates(docs: DataFrame, settings: Settings | None = None, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept."""
    s = settings or Settings()
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    base = scratch.keep(signatures(docs, s, text), "signatures")
    # one row for every distinct set; copies are never compared
    reps = base.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = scratch.keep(reps, "classes")
    keyed = reps.select(F.explode("bands").alias("key"), "cls", "sig")
    links = _by_tile(tiled(keyed, "key", "cls", 1024), ["key", "_i", "_j", "_t", "cls", "sig"]).mapInArrow(frugal(_candidate_links(s)), "u binary, v binary")
    groups = scratch.keep(components(scratch.keep(links, "links"), scratch, "candidates"), "groups")
    # full sets, made from whole texts, confirm links inside each candidate group
    wanted = groups.join(reps.select("cls", "row"), F.col("node") == F.col("cls")).select("cls", "component", "row")
    found = wanted.join(_rows(docs, text).drop("doc_id"), "row").select("cls", "component", "text").mapInArrow(frugal(_sets(s)), "cls binary, component binary, n long, sig binary, shingles binary")
    members = scratch.keep(found.dropDuplicates(["cls"]), "sets")
    work = tiled(members, "component", "cls", TILE, "n", TILE_SHINGLES)
    sure = _by_tile(work, ["component", "_i", "_j", "_t", "cls", "n", "sig", "shingles"]).mapInArrow(frugal(_confirmed_links(s)), "u binary, v binary")
    linked = scratch.keep(components(scratch.keep(sure, "sure"), scratch, "linked"), "components")
    least = linked.join(reps.select("cls", "low"), F.col("node") == F.col("cls")).groupBy("component").agg(F.min("low").alias("top"))
    tops = linked.join(least, "component").select(F.col("node").alias("cls"), "top", F.lit(True).alias("many"))
    top = reps.select("cls", "low").join(tops, "cls", "left").select("cls", F.when(F.col("many"), F.col("top")).otherwise(F.col("low")).alias("top"))
    out = base.select("doc_id", "n_shingles", "cls").join(top, "cls", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("top")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))
