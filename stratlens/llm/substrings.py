"""Exact substring deduplication with suffix arrays by induced sorting.

A byte goes if some ``length``-byte string covering it also starts earlier (smaller doc_id, or the
same document and an earlier start).  Strings are judged on the input, not on what is left.

1. Every window of ``length`` bytes has one anchor: its leftmost smallest hash of ``GRAM`` bytes.
   Equal windows have equal anchors at equal places, so windows that may be equal meet under the
   anchor's hash.  Windows in a row with the same anchor form a run; its bytes are the run's context.
2. Runs with equal anchor and context are equal windows throughout: all but the first go.
3. What is left are anchors with several contexts.  Most share little more than the anchor: hashes of
   the bytes to its left and right, a third and two thirds of the way, bound which windows another
   context can have.  Those windows of one context of each are sent to the anchor's shard, where a
   suffix array (induced sorting) and permuted common prefixes find the equal ones.
   An anchor with more than ``BLOCK`` contexts is split into blocks; windows that stay first in
   their block meet once more by their hash.
4. The ranges found are merged per document and cut from its bytes.

Nothing is capped: a hot anchor costs blocks, not memory.  Hash equality is over 128 bits.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` stay whole; rows
with a null doc_id stay whole and are compared with nothing; rows that share a doc_id count as one
document and get the same ranges.  Extra columns pass through; one named like a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, Scratch, U64, binary_column, chunks, flat_utf8, fresh, frugal, mix64, ranges, small_batches
from .suffixes import permuted_lcp, suffix_array

GRAM = 24
PIECE = 1 << 19
BLOCK = 1000
SHARD_RUNS = 1 << 20
RUN = np.dtype([("fp", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u2"), ("lead", "<u2"), ("left", "<u2", 2), ("right", "<u2", 2)])
SHARD_BYTES = 3 << 18


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _reach(length: int) -> tuple[int, int]:
    """How many bytes beside an anchor's are hashed, on either side."""
    return (length - GRAM) // 3, 2 * (length - GRAM) // 3


def _runs_of(data: np.ndarray, base: np.ndarray, stop: np.ndarray, length: int):
    """Runs of windows in pieces [base, stop) of one buffer: first window, windows, anchor hash, context hash, bytes
    before the anchor, and hashes of the anchor with those to its left and right (0 where the context has fewer)."""
    roll = RollingHash(data)
    gram = roll.windows(GRAM)
    key = (gram & ~U64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)  # a piece is shorter than 2**24
    low = _sliding_min(key, length - GRAM + 1)
    anchor = (low & U64(0xFFFFFF)).astype(np.int64)
    count = np.maximum(stop - base - length + 1, 0)
    at = ranges(base, count)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) + (np.zeros((0, 2), np.uint16),) * 2
    a = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    begin = at[first]
    a = a[first]
    fp, lead, end = gram[a], a - begin, begin + windows + length - 1
    ctx = mix64(roll.of(begin, end) + lead.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    left, right = np.zeros((len(a), 2), np.uint16), np.zeros((len(a), 2), np.uint16)
    for k, more in enumerate(_reach(length)):
        there = lead >= more
        left[there, k] = np.maximum(roll.of(a[there] - more, a[there] + GRAM) >> U64(48), U64(1))
        there = end - a >= GRAM + more
        right[there, k] = np.maximum(roll.of(a[there], a[there] + GRAM + more) >> U64(48), U64(1))
    return begin, windows, fp, ctx, lead, left, right


def _collapse(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first run of each (anchor, context), and the others.  One row repeated is no copy of itself."""
    runs = runs[np.lexsort((runs["start"], runs["doc"], runs["ctx"], runs["fp"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["fp"][1:] != runs["fp"][:-1]) | (runs["ctx"][1:] != runs["ctx"][:-1])
    lead = runs[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(runs) else runs
    again = (lead["doc"] == runs["doc"]) & (lead["start"] == runs["start"])
    return runs[new], runs[~new & ~again]


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Ranges of each document, joined where they overlap or touch."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    lift = np.cumsum(np.append(True, doc[1:] != doc[:-1])).astype(np.int64) << 40
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(doc), bool)
    new[1:] = (begin + lift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], begin[first], reach[last] - lift[last]


_FOUND = "doc_id long, begin long, stop long, fp long, block int"


def _found(doc, begin, end, fp=None, block=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc.astype(np.int64)), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)),
            pa.nulls(n, pa.int64()) if fp is None else pa.array(fp.view(np.int64)), pa.nulls(n, pa.int32()) if block is None else pa.array(block.astype(np.int32)),
        ],
        ["doc_id", "begin", "stop", "fp", "block"],
    )


def _scan(length: int, shards: int):
    def send(parts):
        runs, again = _collapse(np.concatenate(parts))
        d, b, e = _merged(again["doc"], again["start"], again["start"].astype(np.int64) + again["n"] + length - 1)
        shard = (mix64(runs["fp"] + U64(5)) % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        runs, shard = runs[order], shard[order]
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(runs) else np.zeros(0, int)
        off = np.append(cut, len(runs)) * RUN.itemsize
        kinds, blobs = [shard[cut]], [binary_column(runs.tobytes(), off)]
        if len(d):
            known = np.column_stack([d, b, e]).astype("<i8")
            kinds.append(np.array([-1 - int(d[0]) % shards]))
            blobs.append(binary_column(known.tobytes(), np.array([0, known.nbytes])))
        kinds = np.concatenate(kinds)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.concat_arrays(blobs)], ["shard", "runs"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = flat_utf8(batch.column(1))
            for lo, hi in chunks(off, PIECE):
                buf, first = data[off[lo] : off[hi]], int(off[lo])
                base, stop = off[lo:hi] - first, off[lo + 1 : hi + 1] - first
                doc = np.arange(lo, hi)
                jobs = [(buf, base, stop, doc, np.zeros(len(doc), np.int64))]
                if len(buf) > PIECE:  # one very long text: pieces that overlap by a window less a byte
                    cuts = np.arange(0, max(1, len(buf) - length + 1), PIECE)
                    jobs = [(buf[c : c + PIECE + length - 1], np.zeros(1, np.int64), np.array([min(len(buf) - c, PIECE + length - 1)]), doc, np.array([c])) for c in cuts]
                for part, b, s, d, shift in jobs:
                    begin, windows, fp, ctx, lead, left, right = _runs_of(part, b, s, length)
                    which = np.searchsorted(b, begin, side="right") - 1
                    # empty texts share a base with their successor; the last of equal bases is the one that has bytes
                    out = np.empty(len(begin), RUN)
                    out["fp"], out["ctx"], out["doc"] = fp, ctx, ids[d[which]]
                    out["start"], out["n"] = begin - b[which] + shift[which], windows
                    out["lead"], out["left"], out["right"] = lead, left, right
                    held.append(out)
                    size += len(out)
                    if size >= SHARD_RUNS // 2:
                        yield send(held)
                        held, size = [], 0
        if size:
            yield send(held)

    return run


def _sharing(group: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether another row of the group has the same mark, which is not 0."""
    order = np.lexsort((mark, group))
    same = (mark[order][1:] == mark[order][:-1]) & (group[order][1:] == group[order][:-1])
    out = np.zeros(len(mark), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return out & (mark > 0)


def _common(runs: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each context, from its start, that another context of its group may have, and how many from there.

    A window that starts ``o`` bytes before the anchor has those and length - GRAM - o after it.  Where nobody shares
    ``more`` bytes on a side, equal windows have less than that there.
    """
    most, (near, far) = length - GRAM, _reach(length)
    side = []
    for marks in (runs["left"], runs["right"]):
        low_mark, high_mark = marks.T.astype(np.uint32)
        some, much = _sharing(group, low_mark), _sharing(group, np.where(high_mark > 0, high_mark << 16 | low_mark, 0))
        side.append(np.where(much, most, np.where(some, far - 1, near - 1)))
    lead = runs["lead"].astype(np.int64)
    low = np.maximum(lead - side[0], 0)
    high = np.minimum(lead - most + side[1], runs["n"].astype(np.int64) - 1)
    return low, np.maximum(high - low + 1, 0)


def _resolve(length: int):
    """Copies of a context go at once; an anchor with several contexts asks for the bytes they may have in common."""

    def settle(held, hot, last):
        runs, again = _collapse(np.concatenate(held))
        out = [_found(*_merged(again["doc"], again["start"], again["start"].astype(np.int64) + again["n"] + length - 1))]
        new = np.ones(len(runs), bool)
        new[1:] = runs["fp"][1:] != runs["fp"][:-1]
        group = np.cumsum(new) - 1
        seen = np.isin(runs["fp"], np.fromiter(hot, np.uint64, len(hot))) if hot else np.zeros(len(runs), bool)
        low, count = np.zeros(len(runs), np.int64), runs["n"].astype(np.int64)
        if last:  # contexts of an anchor that left early are not all here
            several = np.flatnonzero(~seen & (np.bincount(group, minlength=1)[group] > 1))
            low[several], count[several] = _common(runs[several], group[several], length)
            stay = count > 0
            runs, group, seen, low, count = runs[stay], group[stay], seen[stay], low[stay], count[stay]
        first = np.append(True, group[1:] != group[:-1])[: len(runs)]
        many = np.bincount(group)[group] if len(runs) else np.zeros(0, int)
        nth = np.arange(len(runs)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(runs) else many
        blazing = seen | (many > BLOCK)
        if not last:
            for f in np.unique(runs["fp"][blazing]).tolist():
                hot[f] = hot.get(f, 0)
        for f in np.unique(runs["fp"][blazing]).tolist():
            hot.setdefault(f, 0)
        start = np.zeros(len(runs), np.int64)
        if blazing.any():
            f, inverse = np.unique(runs["fp"][blazing], return_inverse=True)
            start[blazing] = np.array([hot[x] for x in f.tolist()])[inverse]
            used = np.zeros(len(f), np.int64)
            np.maximum.at(used, inverse, nth[blazing] // BLOCK + 1)
            for x, u in zip(f.tolist(), used.tolist()):
                hot[x] += u
        ask = blazing | ((many > 1) if last else np.zeros(len(runs), bool))
        block = np.where(blazing, 1 + start + nth // BLOCK, 0)
        chosen = runs[ask]
        begin = chosen["start"] + low[ask]
        out.append(_found(chosen["doc"], begin, begin + count[ask] + length - 1, chosen["fp"].copy(), block[ask]))
        return out, [] if last else [runs[~ask]]

    def run(batches):
        key, held, size, hot, limit = None, [], 0, {}, 4 * SHARD_RUNS
        for batch in batches:
            shard = batch.column(0).to_pylist()
            data, off = flat_utf8(batch.column(1))
            for i, b in enumerate(shard):
                raw = data[off[i] : off[i + 1]].tobytes()
                if b < 0:
                    known = np.frombuffer(raw, "<i8").reshape(-1, 3)
                    yield _found(known[:, 0], known[:, 1], known[:, 2])
                    continue
                if b != key:
                    if held:
                        yield from settle(held, hot, True)[0]
                    key, held, size, hot, limit = b, [], 0, {}, 4 * SHARD_RUNS
                held.append(np.frombuffer(raw, RUN))
                size += len(held[-1])
                if size > limit:  # hot anchors leave early, in blocks; the others stay until the shard ends
                    done, held = settle(held, hot, False)
                    yield from done
                    size = len(held[0])
                    limit = max(limit, 2 * size)
        if held:
            yield from settle(held, hot, True)[0]

    return run


def _contexts(batches):
    """The bytes asked for: (fp, block, doc_id, begin, ctx)."""
    for batch in batches:
        data, off = flat_utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        per = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        begin, stop = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        doc = np.repeat(np.arange(len(ids)), per)
        step = 20_000
        for k in range(0, len(doc), step):
            at, size = off[:-1][doc[k : k + step]] + begin[k : k + step], (stop - begin)[k : k + step]
            body = binary_column(data[ranges(at, size)], np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays(
                [flat.field(2).slice(k, step), flat.field(3).slice(k, step), pa.array(ids[doc[k : k + step]]), pa.array(begin[k : k + step]), body],
                ["fp", "block", "doc_id", "begin", "ctx"],
            )


def equal_windows(data: np.ndarray, off: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of contexts data[off[i]:off[i+1]] that occur twice within a group: places and class numbers."""
    # contexts of different groups can't share windows of use: the same window has one anchor
    size = np.diff(off)
    spaced = np.zeros(len(data) + len(size), np.int64)
    shift = np.repeat(np.arange(len(size)), size)
    spaced[np.arange(len(data)) + shift] = data.astype(np.int64) + 1
    begin = off[:-1] + np.arange(len(size))
    sa = suffix_array(spaced, 257)
    stop = np.repeat(begin + size, size + 1)
    text = spaced.astype(np.uint16)
    plcp = permuted_lcp(text, sa, stop)
    equal = plcp[sa] >= length
    cls = np.cumsum(~equal)
    whole = stop[sa] - sa >= length
    twice = equal.copy()
    twice[:-1] |= equal[1:]
    use = twice & whole
    return sa[use], cls[use]


def _sort_shards(length: int):
    schema = ["doc_id", "begin", "stop", "h1", "h2"]

    def solve(held):
        table = pa.Table.from_batches(held).combine_chunks()
        data, off = flat_utf8(table.column("ctx"))
        data, off = data[off[0] : off[-1]], off - off[0]
        doc, begin = table.column("doc_id").to_numpy(), table.column("begin").to_numpy()
        block, fp = table.column("block").to_numpy(), table.column("fp").to_numpy()
        size = np.diff(off)
        spaced_begin = off[:-1] + np.arange(len(size))
        place, cls = equal_windows(data, off, fp, length)
        row = np.searchsorted(spaced_begin, place, side="right") - 1
        start = begin[row] + place - spaced_begin[row]
        order = np.lexsort((start, doc[row], cls))
        row, start, cls = row[order], start[order], cls[order]
        first = np.append(True, cls[1:] != cls[:-1]) if len(cls) else np.zeros(0, bool)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(cls) else np.zeros(0, int)
        again = (doc[row] != doc[row[lead]]) | (start != start[lead])
        d, b, e = _merged(doc[row[again]], start[again], start[again] + length)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(b), pa.array(e), pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.int64())], schema)
        if (block > 0).any():  # blocks of a hot anchor: windows still first meet again by hash
            roll = RollingHash(data)
            mine = np.flatnonzero(block > 0)
            count = np.maximum(size[mine] - length + 1, 0)
            at = ranges(off[:-1][mine], count)
            who = np.repeat(mine, count)
            first_of = begin[who] + at - off[:-1][who]
            gone = np.zeros(len(data), bool)
            gone[off[:-1][row[again]] + start[again] - begin[row[again]]] = True
            keep = ~gone[at]
            at, who, first_of = at[keep], who[keep], first_of[keep]
            h1 = roll.of(at, at + length)
            h2 = mix64((RollingHash(data ^ np.uint8(0xA5)).of(at, at + length) + U64(0x5851F42D4C957F2D)) ^ fp[who].view(np.uint64))
            for k in range(0, len(at), 100_000):
                p = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[who[p]]), pa.array(first_of[p]), pa.array(first_of[p] + length), pa.array(h1[p].view(np.int64)), pa.array(h2[p].view(np.int64))], schema
                )

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            off = flat_utf8(batch.column(4))[1]
            new = np.append(key != (fp[0], block[0]), (fp[1:] != fp[:-1]) | (block[1:] != block[:-1]))
            key, lo = (fp[-1], block[-1]), 0
            for at in np.flatnonzero(new).tolist():  # groups stay whole
                if size + off[at] - off[lo] > SHARD_BYTES:
                    yield from solve([*held, batch.slice(lo, at - lo)])
                    held, size, lo = [], 0, at
            held.append(batch.slice(lo))
            size += off[-1] - off[lo]
        if held:
            yield from solve(held)

    return run


def repeated_ranges(docs: DataFrame, length: int = 100, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, spans array<struct<begin, stop>>) of the bytes that earlier strings cover; not yet merged."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    plain = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    volume = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about 2 runs for each (length - GRAM) bytes
    shards = max(8, int(volume * 2 / (length - GRAM + 2) / SHARD_RUNS * 4))
    runs = plain.mapInArrow(frugal(_scan(length, shards)), "shard long, runs binary")
    found = scratch.keep(runs.repartition("shard").sortWithinPartitions("shard").mapInArrow(frugal(_resolve(length)), _FOUND), "found")
    asked = found.where("fp is not null").groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop", "fp", "block")).alias("asks"))
    bytes_of = plain.join(asked, "doc_id").mapInArrow(frugal(_contexts), "fp long, block int, doc_id long, begin long, ctx binary")
    blocks = bytes_of.repartition("fp", "block").sortWithinPartitions("fp", "block")
    sorted_ = scratch.keep(blocks.mapInArrow(frugal(_sort_shards(length)), "doc_id long, begin long, stop long, h1 long, h2 long"), "sorted")
    left = sorted_.where("h1 is not null")
    twice = left.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "begin")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = left.join(twice, ["h1", "h2"]).where("doc_id <> lead.doc_id or begin <> lead.begin").select("doc_id", "begin", "stop")
    every = found.where("fp is null").select("doc_id", "begin", "stop").unionByName(sorted_.where("h1 is null").select("doc_id", "begin", "stop")).unionByName(late)
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop")).alias("_spans"))


def deduplicate(docs: DataFrame, length: int = 100, text: str = "text", characters: bool = False, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, spans (maximal removed runs) and ``kept``, the bytes left.

    ``characters`` keeps any character of which a byte stays; ``kept`` is then valid UTF-8.  The text
    column itself is passed on only ``with_text``.
    """
    spans = repeated_ranges(docs, length, text, scratch)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "spans", "kept") and (with_text or c != text)]
    kept = [f for f in docs.schema.fields if f.name in names]
    span_type = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span_type), T.StructField("kept", T.BinaryType())])
    body, of, found = (fresh(x, names) for x in ("text", "of", "spans"))
    spans = spans.select(F.col("doc_id").alias(of), F.col("_spans").alias(found))
    source = docs.select(*names, F.col(text).cast("string").alias(body), F.col("doc_id").cast("long").alias(fresh("id", [*names, body, of, found])))
    source = small_batches(source.join(spans, source[source.columns[-1]] == F.col(of), "left").select(*names, body, found))

    def run(batches):
        for batch in batches:
            data, off = flat_utf8(batch.column(len(names)))
            lists = batch.column(len(names) + 1).fill_null([])
            for lo, hi in chunks(off, 2 << 20):
                part = lists.slice(lo, hi - lo)
                at = part.offsets.to_numpy().astype(np.int64)
                flat = part.flatten()
                size = np.diff(off[lo : hi + 1])
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                begin = np.minimum(flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), size[doc])
                stop = np.minimum(flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64), size[doc])
                doc, begin, stop = _merged(doc, begin, stop)
                body, first = data[off[lo] : off[hi]], off[lo:hi] - off[lo]
                if characters and len(doc):
                    tail = (np.append(body, 0) & 0xC0) == 0x80
                    begin, stop = begin + first[doc], stop + first[doc]
                    for _ in range(3):
                        begin = np.where(tail[begin] & (begin < stop), begin + 1, begin)
                        stop = np.where(tail[np.minimum(stop, len(body))] & (stop > begin) & (stop < first[doc] + size[doc]), stop - 1, stop)
                    full = stop > begin
                    doc, begin, stop = doc[full], begin[full] - first[doc[full]], stop[full] - first[doc[full]]
                real = stop > begin
                doc, begin, stop = doc[real], begin[real], stop[real]
                stay = np.ones(len(body), bool)
                stay[ranges(first[doc] + begin, stop - begin)] = False
                removed = np.bincount(doc, weights=stop - begin, minlength=hi - lo).astype(np.int64)
                rows = batch.slice(lo, hi - lo)
                spans_out = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(begin.astype(np.int64)), pa.array(stop.astype(np.int64))], ["begin", "stop"])
                )
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in range(len(names))), pa.array(size), pa.array(removed), spans_out, binary_column(body[stay], np.concatenate([[0], np.cumsum(size - removed)]))],
                    [*names, "n_bytes", "n_removed", "spans", "kept"],
                )

    return source.mapInArrow(frugal(run), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
