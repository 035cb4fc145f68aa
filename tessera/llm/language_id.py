"""Language identification by error-correcting output codes.

Every learned language gets a codeword.  For every bit one binary classifier over byte 3-grams (naive Bayes: the log
ratio of a gram's frequency among the languages with that bit set and among the others) predicts the bit; a text is given
to the codeword of least weighted logistic loss.  Bits that erred more in training weigh less.  A text whose best
codeword is not clearly nearer than the next one is flagged as ambiguous.

Only fitting uses a sample: at most about ``rows_per_language`` labelled rows of each language, drawn by a hash of the
id.  Prediction reads every text whole, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buffers, column, slices

#: Buckets that grams are hashed to; a model has GRAMS weights for each bit.
GRAMS = 1 << 16
#: Pseudo-count of every gram, and the score under which a prediction is flagged.
SMOOTH, CLEAR = 0.5, 0.5
#: Languages a model may have; with the bits of their codewords this bounds what is sent to the executors.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte 3-gram of the texts (lower case, other ASCII as spaces, a space at both ends), and where the
    grams of each text begin. An empty text has none."""
    raw, at = buffers(col)
    n = len(at) - 1
    flat = np.full(len(raw) + 2 * n, 32, np.uint32)
    flat[np.arange(len(raw)) + 1 + 2 * np.repeat(np.arange(n), np.diff(at))] = _FOLD[raw]
    if len(flat) < 3:
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    code = (flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.arange(len(raw)) + 2 * np.repeat(np.arange(n), np.diff(at))
    return bucket[inside].astype(np.int64), at


def codewords(n: int) -> np.ndarray:
    """A row of bits for each of n languages: all ways to part them in two while they are few, else 10 log2(n) bits of a
    fixed sequence without constant columns."""
    if n <= 6:
        cols = [[(c >> i) & 1 for i in range(n)] for c in range(1, 1 << max(n - 1, 1)) if n > 1]
        return np.array(cols, np.int8).T if cols else np.ones((n, 1), np.int8)
    rng = np.random.default_rng(7)
    bits = 10 * math.ceil(math.log2(n))
    while True:
        m = rng.integers(0, 2, (n, bits), np.int8)
        if len({r.tobytes() for r in m}) == n and ((m.sum(0) > 0) & (m.sum(0) < n)).all():
            return m


@dataclass
class Model:
    languages: list[str]
    #: languages x bits of 0 and 1, GRAMS x bits, and by bit the scale of a margin and the weight of its loss
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, col: pa.Array) -> np.ndarray:
        """Mean weight of each text's grams, for each bit."""
        bucket, at = grams(col)
        size = np.maximum(np.diff(at), 1)
        out = np.empty((len(at) - 1, self.weights.shape[1]))
        for b in range(out.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket, b], dtype=np.float64)])
            out[:, b] = (sums[at[1:]] - sums[at[:-1]]) / size
        return out

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """Share of every language, from the weighted losses of its codeword."""
        sign = 2.0 * self.code - 1
        z = margins / self.scale
        loss = np.stack([(np.logaddexp(0, -s * z) * self.trust).sum(1) for s in sign], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def fit(labelled: DataFrame, rows_per_language: int = 5000) -> Model | None:
    """A model of the rows (id, text, lang) given; None without any."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counted:
        return None
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, rows_per_language / n)) for k, n in sorted(counted.items())])
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share).select("text", "lang")
    languages = sorted(counted)

    def count(batches):
        total = np.zeros((len(languages), GRAMS), np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for b in slices(batches):
            t = pa.Table.from_batches([b])
            bucket, at = grams(column(t, "text"))
            which = np.repeat([index[x] for x in t.column("lang").to_pylist()], np.diff(at))
            total += np.bincount(which * GRAMS + bucket, minlength=total.size).reshape(total.shape)
        k, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(total[k, g])], ["k", "g", "n"])

    counts = np.zeros((len(languages), GRAMS))
    summed = sample.mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()  # at most languages x GRAMS
    counts[summed["k"], summed["g"]] = summed["n"]
    share_of = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((GRAMS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one = code[:, b] == 1
        if one.any() and not one.all():
            weights[:, b] = np.log(share_of[one].mean(0)) - np.log(share_of[~one].mean(0))
    first = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    sent = sample.sparkSession.sparkContext.broadcast(first)

    def judge(batches):
        m = sent.value
        index = {x: i for i, x in enumerate(m.languages)}
        n, wrong, size = 0, np.zeros(m.code.shape[1]), np.zeros(m.code.shape[1])
        for b in slices(batches):
            t = pa.Table.from_batches([b])
            margins = m.margins(column(t, "text"))
            bits = m.code[[index[x] for x in t.column("lang").to_pylist()]]
            n, wrong, size = n + len(bits), wrong + ((margins > 0) != bits).sum(0), size + np.abs(margins).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(wrong), pa.int64()), pa.array(range(len(wrong)), pa.int32()), pa.array(wrong), pa.array(size)], ["n", "bit", "wrong", "size"])

    judged = sample.mapInArrow(judge, "n long, bit int, wrong double, size double").groupBy("bit").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.sum("size").alias("size"))
    for r in judged.collect():  # a row for each bit
        error = (r["wrong"] + 1) / (r["n"] + 2)
        first.scale[r["bit"]] = max(r["size"] / max(r["n"], 1), 1e-6) / 4
        first.trust[r["bit"]] = max(0.05, min(1.0, 1 - 2 * error))
    sent.destroy()
    return first


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` in front.

    A null text, one without letters, and any text where there is no model gets ``und`` with score 0 and is not ambiguous.
    Repeated rows stay; an empty table gives an empty result; of columns that have one of the new names, the new one
    stays."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    new = ["lang_pred", "score", "ambiguous"]
    rest = [c for c in docs.columns if c not in new]
    others = [c for c in rest if c != text_col or dict(docs.dtypes)[c] != "string"]  # a text that is a string is sent to the workers once
    if not others:
        others = rest
    src = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), lettered.alias("lettered"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    kind = src.schema["row"].dataType.simpleString()

    def predict(batches):
        m = sent.value
        for b in slices(batches):
            t = pa.Table.from_batches([b])
            text = column(t, "text")
            known = column(t, "lettered").to_numpy(zero_copy_only=False) if m else np.zeros(len(text), bool)
            best, score, unclear = np.zeros(len(text), int), np.zeros(len(text)), np.zeros(len(text), bool)
            if known.any():
                share = m.shares(m.margins(text.take(pa.array(np.arange(len(text)), mask=~known))))
                best, score = share.argmax(1), np.where(known, share.max(1), 0.0)
                unclear = known & (score < CLEAR)
            names = [m.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            cols = [pa.array(names, pa.string()), pa.array(score), pa.array(unclear), column(t, "row")]
            yield pa.RecordBatch.from_arrays([*cols, text] if len(others) < len(rest) else cols, [*new, "row", "text"][: 5 if len(others) < len(rest) else 4])

    out = src.mapInArrow(predict, f"lang_pred string, score double, ambiguous boolean, row {kind}" + ", text string" * (len(others) < len(rest)))
    return out.select(*new, *[(F.col(f"row.`{c}`") if c in others else F.col("text")).alias(c) for c in rest])


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 5000) -> DataFrame:
    """``identify`` with a model fitted on the rows of ``docs`` that have a language and are not held out (a null id
    is held out: its row is not learned from); adds ``held_out`` (false for a null id)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    model = fit(src.where(~held_out(F.col("id"))), rows_per_language)
    return identify(docs, model, text_col).withColumn("held_out", F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)))
