"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text.  Toxic documents
are mostly ordinary prose, so the toxic dictionary is trained on the windows of toxic documents that
need explaining: at first those that the ordinary dictionary compresses worst, then, for a few rounds,
those that the toxic dictionary of the round before shortens most.  Windows of ordinary text that it
shortens too are added to what the ordinary dictionary is trained on.

Every window of a text is compressed with the ordinary dictionary and with both; a window that gets
shorter with the toxic one resembles toxic text.  How many windows gain how much is calibrated, on
labelled rows the dictionaries have not seen, to a probability; 0.5 is the threshold.

Fitting uses at most ``per_class`` labelled rows of either class, chosen by a hash, and reads at most
``max_bytes`` of each.  Scoring uses whole texts, in overlapping windows.

Defined results: null and empty texts score as texts of which no window gains; if a class has no
labelled rows every text scores the share of label 1 (0 without labels); equal texts score equally.
Rows are kept one to one, with null or repeated ids.  Extra columns pass through; one named ``score``
or ``predicted`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, flat_utf8, fresh, frugal, small_batches
from .language import fold

WINDOW, STRIDE, LEVEL = 64, 32, 6
CALIBRATE = 500
SAMPLE = 32  # bytes of a window that the toxic dictionary is trained on
STEPS = (1, 2, 3, 4, 5, 6, 8)


_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case, and one digit for all: numbers tell nothing here."""
    return _DIGITS[ascii_lower(data)]


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """Content of a dictionary trained on the samples; plain text where there are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    joined = b"".join(samples)
    if not samples:
        return b" "
    if len(joined) <= 4 * size or len(samples) < 20:
        samples = samples * max(1, 20 // len(samples), 8 * size // max(1, len(joined)))
    try:
        return zstd.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstd.ZstdError:
        return joined[-size:]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Gains:
    """Window gains of texts: bytes saved by the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = [_compressor(ordinary), _compressor(ordinary + toxic)]

    def of(self, text: bytes) -> np.ndarray:
        plain, both = self.pair[0].compress, self.pair[1].compress
        last = max(1, len(text) - WINDOW + STRIDE)
        return np.array([len(plain(w)) - len(both(w)) for w in (text[i : i + WINDOW] for i in range(0, last, STRIDE))])

    def features(self, text: bytes) -> np.ndarray:
        g = np.sort(self.of(text))[::-1] if text else np.zeros(1)
        top = np.zeros(6)
        top[: min(6, len(g))] = g[:6]
        size = np.log(len(g) + 1.0)
        counts = np.array([np.log1p((g >= s).sum()) for s in STEPS])
        shares = np.array([(g >= s).mean() for s in STEPS])
        return np.concatenate([top, counts, shares * 10, [size, g.mean(), size * top[0] / 10]])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _windows(text: bytes, size: int, step: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(1, len(text) - size + step), step)]


def dictionaries(toxic: list[bytes], plain: list[bytes], size: int = 98304, special: int = 3072, rounds: int = 5, top: int = 3, hard: int = 4000, share: float = 0.005) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary, of at most ``size`` and ``special`` bytes.

    In each round every toxic text gives its ``top`` windows of largest gain, if they gain more than all but a
    ``share`` of ordinary windows do; the ``hard`` ordinary windows of largest gain become ordinary samples.
    """
    rng = np.random.default_rng(3)

    def mixed(windows: list[bytes], most: int) -> list[bytes]:
        return [windows[i] for i in rng.permutation(len(windows))[:most]]

    base, extra = mixed([w for t in plain for w in _windows(t, WINDOW, WINDOW)], size // 2), []
    probe = mixed([t[i : i + SAMPLE] for t in plain for i in range(0, len(t), 2 * SAMPLE)], 40_000)
    parts = [_windows(t, SAMPLE, SAMPLE // 2) for t in toxic]
    ordinary = _trained(base, size, 32)
    alone = _compressor(ordinary).compress
    length = [[len(alone(w)) for w in p] for p in parts]
    picked = [p[i] for p, n in zip(parts, length) for i in np.argsort(-np.array(n), kind="stable")[: 2 * top]]
    for k in range(rounds):
        found = _trained(picked, special, 16)
        if k == rounds - 1 or not probe:
            break
        both = _compressor(ordinary + found).compress
        gain = np.array([len(alone(w)) - len(both(w)) for w in probe])
        order = np.argsort(-gain, kind="stable")
        least = gain[order[int(len(order) * share)]]
        extra += [probe[i] for i in order[:hard] if gain[i] >= 2]
        ordinary = _trained(base + 4 * extra, size, 32)
        alone, both = _compressor(ordinary).compress, _compressor(ordinary + found).compress
        next_ = []
        for p in parts:
            g = np.array([len(alone(w)) - len(both(w)) for w in p])
            next_ += [p[i] for i in np.argsort(-g, kind="stable")[:top] if g[i] >= least]
        picked = next_ or picked
    return ordinary, found


def train(texts: list[bytes], label: np.ndarray, penalty: float = 1e-3, toxic_share: float | None = None) -> Model:
    """Dictionaries from some rows, calibration on the others: of each class a fourth, or ``CALIBRATE`` rows if that is more,
    but no more than half.  ``toxic_share`` is that of the rows sampled from (None: as given)."""
    texts = [_folded(np.frombuffer(t, np.uint8)).tobytes() for t in texts]
    build = np.ones(len(texts), bool)
    for own in (np.flatnonzero(label), np.flatnonzero(~label)):
        some = max(len(own) // 4, min(len(own) // 2, CALIBRATE))
        build[own[np.arange(some) * len(own) // max(1, some)]] = False
    ordinary, special = dictionaries([t for t, y, k in zip(texts, label, build) if y and k], [t for t, y, k in zip(texts, label, build) if not y and k])
    gains = Gains(ordinary, special)
    x = np.array([gains.features(t) for t, k in zip(texts, build) if not k])
    y = label[~build].astype(float)
    weight = np.full(len(y), 1 / len(y))
    if toxic_share is not None:
        weight = np.where(y > 0, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum()))
    mean = weight @ x
    scale = np.maximum(np.sqrt(weight @ (x - mean) ** 2), 1e-6)
    z = (x - mean) / scale
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(40):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -40, 40)))
        one = np.column_stack([z, np.ones(len(z))])
        slope = one.T @ (weight * (p - y)) + penalty * np.append(w, 0)
        bend = (one * (weight * p * (1 - p))[:, None]).T @ one + penalty * np.eye(len(w) + 1)
        step = np.linalg.solve(bend, slope)
        w, b = w - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(ordinary, special, mean, scale, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_bytes: int = 1 << 15) -> Model | float:
    """Fit on (doc_id, text) and (doc_id, toxic) rows; a number (the share of label 1) where there is nothing to tell apart."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {bool(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return 1.0 if True in sizes else 0.0
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = None
    for cls in (False, True):
        part = known.where((F.col("toxic") == cls) & (chance < min(1.0, 1.2 * per_class / sizes[cls]))).orderBy(F.xxhash64("doc_id")).limit(per_class)
        few = part if few is None else few.unionByName(part)
    # at most 2 * per_class rows are broadcast, by their limit
    rows = docs.where(F.octet_length("text") > 0).select("doc_id", F.substring("text", 1, max_bytes).alias("text")).join(F.broadcast(few), "doc_id")
    picked = rows.select(F.col("doc_id").alias("key"), "text", "toxic").orderBy("key", F.xxhash64("text")).limit(2 * per_class)
    got = picked.select("key", "text", "toxic").toArrow()
    keys = [str(k) for k in got.column("key").to_pylist()]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    texts = [got.column("text")[int(i)].as_py().encode() for i in order]
    label = np.array(got.column("toxic").to_pylist(), bool)[order] if order else np.zeros(0, bool)
    if min(label.sum(), (~label).sum()) < 8 if len(label) else True:
        return sizes[True] / (sizes[True] + sizes[False])
    return train(texts, label, toxic_share=sizes[True] / (sizes[True] + sizes[False]))


def score(df: DataFrame, model: Model | float, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds score (0 to 1) and predicted."""
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    source = small_batches(df).select(*names, F.col(text).cast("string").alias(fresh("text", names)))

    def run(batches):
        gains = Gains(model.ordinary, model.toxic) if isinstance(model, Model) else None
        for batch in batches:
            data, off = flat_utf8(batch.column(len(names)))
            if gains is None:
                s = np.full(batch.num_rows, float(model))
            else:
                s = np.zeros(batch.num_rows)
                for lo in range(0, batch.num_rows, 512):
                    hi = min(lo + 512, batch.num_rows)
                    low = _folded(data[off[lo] : off[hi]]).tobytes()
                    s[lo:hi] = model.score(np.array([gains.features(low[off[i] - off[lo] : off[i + 1] - off[lo]]) for i in range(lo, hi)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return source.mapInArrow(frugal(run), schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, learned from labelled rows that are not held out."""
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = score(docs.select("doc_id", "text"), model, keep_text=False)
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted")
