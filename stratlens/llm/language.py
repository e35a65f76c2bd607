"""Language identification with error-correcting output codes.

Every language has a codeword; each bit is predicted by a binary logistic classifier over hashed
byte n-grams of the whole text, and the codeword with the smallest summed logistic loss wins
(loss-weighted decoding).  If the runner-up's loss is within ``margin`` the text is ambiguous.

The classifiers are fitted on at most ``per_language`` labelled rows of each language, chosen by a
hash of their id, and ``max_rows`` in all; nothing else is bounded.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled
rows every text is ``und``; with one language it is predicted everywhere with score 1.  Languages of
equal loss are decided by their names' order, and flagged.  Rows keep their null ids and repetitions,
and equal texts get equal results.  Extra columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, flat_utf8, fresh, frugal, small_batches

DIMS = 4096
CHUNK = 1 << 19
# letters and bytes of other scripts stay (ASCII in lower case), everything else is a blank
_FOLD = np.full(256, 32, np.uint32)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, DIMS) square roots of hashed byte 2- and 3-gram counts, each row of length 1."""
    lo, n = int(off[0]), len(off) - 1
    x = _FOLD[data[lo : int(off[-1])]]
    out = np.zeros((n, DIMS), np.float32)
    if not len(x):
        return out
    at = off - lo
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(at))
    for k, mul in ((2, np.uint32(0x9E3779B1)), (3, np.uint32(0x85EBCA6B))):
        if len(x) < k:
            continue
        code = x[: len(x) - k + 1].copy()
        for i in range(1, k):
            code = (code << np.uint32(8)) | x[i : len(x) - k + 1 + i]
        slot = ((code * mul) >> np.uint32(20)).astype(np.int64)
        inside = np.ones(len(slot), bool)  # a gram must not reach into the next text
        for i in range(1, k):
            cut = at[1:-1] - i
            inside[cut[(cut >= 0) & (cut < len(slot))]] = False
        out += np.bincount((doc[: len(slot)] + slot)[inside], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codebook(classes: int, seed: int = 3) -> np.ndarray:
    """Codewords of +1 and -1, one row a class.  Exhaustive up to 7 classes, else the best of random
    codes of 10 log2(classes) bits by smallest distance between rows."""
    if classes == 1:
        return np.ones((1, 1), np.int8)
    if classes <= 7:
        bits = (1 << (classes - 1)) - 1
        rows = [np.ones(bits, np.int8)]
        for i in range(1, classes):
            block = 1 << (classes - 1 - i)
            rows.append(np.where((np.arange(bits) // block) % 2 == 0, -1, 1).astype(np.int8))
        return np.array(rows)
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes))), None, (-1, 0)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        if (np.abs(code.sum(axis=0)) == classes).any():
            continue
        near = (bits - code.astype(int) @ code.T.astype(int)) // 2
        rows = near[~np.eye(classes, dtype=bool)].min()
        if (rows, 0) > most:
            best, most = code, (rows, 0)
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    margin: float

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, its share of the likelihood and ambiguity, from the rows' features."""
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None, :, :]).sum(axis=2)
        best = loss.argmin(axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        gap = np.partition(loss, 1, axis=1) if loss.shape[1] > 1 else None
        unsure = gap[:, 1] - gap[:, 0] < self.margin if gap is not None else np.zeros(len(best), bool)
        return best, share[np.arange(len(best)), best].astype(float), unsure


def _train(x: np.ndarray, y: np.ndarray, rounds: int, penalty: float, scale: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all bits at once, by accelerated gradient steps on the whole sample; ``x`` is scaled in place."""
    x *= np.float32(scale)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    vw, vb, step = w.copy(), b.copy(), np.float32(4.0 / (scale * scale + 1))
    for k in range(rounds):
        pull = -y / (1 + np.exp(y * (x @ vw + vb))) / len(x)
        nw = vw - step * (x.T @ pull + penalty * vw)
        nb = vb - step * pull.sum(axis=0)
        beta = np.float32(k / (k + 3))
        vw, vb, w, b = nw + beta * (nw - w), nb + beta * (nb - b), nw, nb
    return w * np.float32(scale), b


def fit(labelled: DataFrame, per_language: int = 300, max_rows: int = 1500, rounds: int = 80, penalty: float = 1e-4, margin: float = 1.0) -> Model | None:
    """Fit on (key, text, lang) rows; those with a null text or lang are left out."""
    labelled = labelled.where("lang is not null and text is not null").select("key", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    quota = max(1, min(per_language, max_rows // len(sizes)))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * quota / n))).otherwise(share)
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(chance < share).withColumn("_h", F.xxhash64("key", "text")).orderBy("_h").limit(max_rows)

    def run(batches):
        for batch in batches:
            data, off = flat_utf8(batch.column(0))
            langs, keys = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for i, (lang, key) in enumerate(zip(langs, keys)):
                rng = np.random.default_rng(abs(int(key)))
                body = data[off[i] : off[i + 1]]
                parts = [body]
                for size in (24, 80, 240):  # short texts need examples too
                    if len(body) > size:
                        at = int(rng.integers(0, len(body) - size))
                        parts.append(body[at : at + size])
                x = features(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
                at = [np.flatnonzero(r).astype(np.uint16) for r in x]
                spots, values = (pa.array([v.tobytes() for v in c], pa.binary()) for c in (at, [r[k].astype(np.float16) for r, k in zip(x, at)]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), spots, values], ["lang", "at", "x"])

    rows = small_batches(sample).select("text", "lang", "_h").mapInArrow(frugal(run), "lang string, at binary, x binary").toArrow()
    names = sorted(sizes)
    label = np.array([names.index(v) for v in rows.column("lang").to_pylist()])
    (at, off), (value, _) = (flat_utf8(rows.column(c)) for c in ("at", "x"))
    x = np.zeros((len(off) - 1, DIMS), np.float32)
    x[np.repeat(np.arange(len(x)), np.diff(off) // 2), np.frombuffer(at[off[0] : off[-1]].tobytes(), np.uint16)] = np.frombuffer(value[off[0] : off[-1]].tobytes(), np.float16)
    del rows, at, value
    code = codebook(len(names))
    if len(names) == 1:
        return Model(names, code, np.zeros((DIMS, 1), np.float32), np.full(1, 40, np.float32), margin)
    w, b = _train(x, code[label].astype(np.float32), rounds, penalty)
    return Model(names, code, w, b, margin)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous."""
    add = ["lang_pred", "score", "ambiguous"]
    kept = [f for f in df.schema.fields if f.name not in add and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    body = fresh("text", names)
    letters = fresh("letters", [*names, body])
    source = small_batches(df).select(*names, F.col(text).cast("string").alias(body), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias(letters))
    labels = np.array([*(model.languages if model else []), "und"], object)

    def run(batches):
        for batch in batches:
            data, off = flat_utf8(batch.column(len(names)))
            letters = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in chunks(off, CHUNK):
                for a in range(lo, hi, 512):
                    b = min(hi, a + 512)
                    best, score, unsure = np.full(b - a, len(labels) - 1), np.zeros(b - a), np.zeros(b - a, bool)
                    real = letters[a:b]
                    if model and real.any():
                        found = model.decode(features(data, off[a : b + 1]))
                        best, score, unsure = np.where(real, found[0], best), np.where(real, found[1], 0.0), real & found[2]
                    rows = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(names))), pa.array(labels[best], pa.string()), pa.array(score), pa.array(unsure)], [*names, *add])

    return source.mapInArrow(frugal(run), schema)


def fold(column: str, mod: int):
    """crc32 of the column as text, modulo ``mod``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous, learned outside the held-out rows."""
    model = fit(docs.where(fold("doc_id", 4) != 2).select(F.col("doc_id").alias("key"), "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model, keep_text=False)
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
