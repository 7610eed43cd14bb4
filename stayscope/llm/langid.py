"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit sees
hashed byte n-grams of the whole text; the loss of each codeword under the bits'
margins, weighted by how well each bit was learned, is summed and the nearest
codeword wins. A text is flagged ambiguous if the runner-up is close.

Fitting uses at most ``max_rows`` labelled rows, equally from all languages and
drawn by a hash of the id; this bound is a parameter. Prediction sees only the
text.

Defined cases: a null text or one without any letter is ``und`` with score 0;
without labelled rows every text is; with one language it is the answer for all
texts that have a letter; ties go to the language first in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from stayscope.llm.textarrays import map_slices, packed, unpacked, with_fields

UNKNOWN = "und"
_DIM = 4096
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Codes:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit
    ambiguous_below: float


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of square roots of hashed counts of two and three bytes, whole texts, case folded."""
    out = np.zeros((len(texts), _DIM), np.float32)
    for a in range(0, len(texts), 256):
        part = [x.lower().encode() + b" " for x in texts[a : a + 256]]
        data = _LETTERS[np.frombuffer(b" " + b"".join(part), np.uint8)].astype(np.uint32)
        of = np.repeat(np.arange(len(part), dtype=np.int64) * _DIM, [len(x) for x in part])
        two = data[:-1] * np.uint32(257) + data[1:]
        three = two[:-1] * np.uint32(263) + data[2:]
        counts = np.bincount(of + ((two * np.uint32(2654435761)) >> np.uint32(20)), minlength=len(part) * _DIM)
        counts += np.bincount(of[1:] + ((three * np.uint32(2246822519)) >> np.uint32(20)), minlength=len(part) * _DIM)
        x = np.sqrt(counts.reshape(len(part), _DIM).astype(np.float32))
        out[a : a + len(part)] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def codewords(n: int, bits: int, seed: int = 5) -> np.ndarray:
    """The best of many random code matrices: far rows, no constant column."""
    if n < 2:
        return np.ones((n, bits))
    rng, best, far = np.random.Generator(np.random.PCG64(seed)), None, -1
    for _ in range(400):
        code = rng.choice([-1.0, 1.0], (n, bits))
        constant = np.flatnonzero(np.abs(code.sum(axis=0)) == n)
        code[rng.integers(0, n, len(constant)), constant] *= -1
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


def fit_features(x: np.ndarray, labels: list[str], bits: int = 15, steps: int = 300, ambiguous_below: float = 0.6) -> Codes:
    """Logistic classifiers of all bits at once by gradient descent with momentum."""
    languages = sorted(set(labels))
    code = codewords(len(languages), bits)
    want = code[[languages.index(y) for y in labels]] if labels else np.zeros((0, bits))
    weight, bias, speed = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32), 0
    for _ in range(steps if len(languages) > 1 else 0):
        margin = want * (x @ weight + bias)
        pull = (want / (1 + np.exp(np.clip(margin, -30, 30)))).astype(np.float32)
        grad = np.vstack([x.T @ pull, pull.sum(axis=0, keepdims=True)]) / len(x)
        speed = 0.9 * speed + grad
        weight, bias = weight * 0.9999 + 8 * speed[:-1], bias + 8 * speed[-1]
    right = ((x @ weight + bias) * want > 0).mean(axis=0) if len(languages) > 1 else np.ones(bits)
    trust = np.maximum(2 * right - 1, 1e-3)
    return Codes(languages, code, weight, bias, trust / trust.mean(), ambiguous_below)


def fit(labelled: DataFrame, max_rows: int = 1600, bits: int = 15) -> Codes:
    """Fit on (doc_id, text, lang), at most ``max_rows`` of them (or one per language), features made by Spark.

    Rows are drawn by a hash of id and text; repeated rows come after the first of each, so copies outweigh nothing.
    """
    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit_features(np.zeros((0, _DIM), np.float32), [], bits)
    each, whole = max(1, max_rows // len(counts)), 1 << 30
    share = known.sparkSession.createDataFrame([(k, int(min(1.0, each / n) * whole)) for k, n in counts.items()], "lang string, share long")
    # one row per language
    drawn = known.withColumn("_h", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang").filter(F.pmod("_h", F.lit(whole)) < F.col("share"))
    # filters on row numbers cut before the shuffle, so a hot row or language sends `each` rows a task at most
    again = drawn.withColumn("_again", F.row_number().over(W.partitionBy("lang", "_h").orderBy("doc_id"))).filter(F.col("_again") <= each)
    chosen = again.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_again", "_h"))).filter(F.col("_n") <= each)

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        x = features(part.column("text").to_pylist())
        return pa.record_batch([part.column("lang"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in map_slices(chosen.select("text", "lang"), rows, "lang string, x binary").collect())
    x = np.array([np.frombuffer(v, np.float16) for _, v in got], np.float32).reshape(len(got), _DIM)
    return fit_features(x, [y for y, _ in got], bits)


def decode(codes: Codes, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword, and its share of the weight of all: 1 is certain."""
    margin = x @ codes.weight + codes.bias
    loss = np.stack([(np.logaddexp(0, -margin * row) * codes.trust).sum(axis=1) for row in codes.code], axis=1)
    near = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return loss.argmin(axis=1), near.max(axis=1) / near.sum(axis=1)


def predict(docs: DataFrame, codes: Codes) -> DataFrame:
    """``docs`` (with a column text) and ``lang_pred``, ``score``, ``ambiguous``."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        some = [i for i, x in enumerate(texts) if codes.languages and x and any(map(str.isalpha, x))]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if some:
            best, sure = decode(codes, features([texts[i] for i in some]))
            score[some] = sure
            for i, k in zip(some, best):
                lang[i] = codes.languages[k]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(score < codes.ambiguous_below)], [*part.schema.names, "lang_pred", "score", "ambiguous"])

    return map_slices(docs, rows, with_fields(docs.schema, lang_pred=StringType(), score=DoubleType(), ambiguous=BooleanType()))


def held_out(doc_id, parts: int, part: int):
    """Whether the checksum of the id as text leaves ``part`` modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame, parts: int = 3, part: int = 1, max_rows: int = 1600) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row, learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), parts, part)
    codes = fit(docs.filter(~out), max_rows)
    return predict(docs.select("doc_id", "text", out.alias("held_out")), codes).drop("text")


def is_rejected():
    """No letter, or no language that holds at least half of the weight."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("score") < 0.5)


def known_language(docs: DataFrame, max_rows: int = 1600) -> DataFrame:
    """``docs`` (with lang) without the rejected rows; learned from all labelled rows. Without labels nothing can be rejected but texts without a letter."""
    codes = fit(docs, max_rows)
    found = predict(packed(docs), codes)
    if not codes.languages:
        return unpacked(found.filter(F.col("text").rlike(r"\p{L}")), docs.columns)
    return unpacked(found.filter(~is_rejected()), docs.columns)
