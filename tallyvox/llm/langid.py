"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits. For each bit a binary classifier of hashed
byte trigrams is learned: the log-odds of a trigram in the languages with that bit
against those without it, from counts over all training documents (whole texts; each
language weighs the same, however many documents it has). A text's margin for a
bit is the mean log-odds of its trigrams. Decoding takes the codeword with the smallest
loss-weighted distance, where a bit's weight is the divergence of its two sides. A text is
flagged as ambiguous if the runner-up is near, if too many bits disagree, or if it is mixed: of its
segments of SEGMENT trigrams, each decoded by itself, too many are nearest to another codeword.
Segments in no learned language have no say, and texts of less than two segments aren't asked for them.

What reaches the driver are the summed counts: at most CELLS numbers for each of at most LANGUAGES
languages, those with the most labelled documents (ties: the one that sorts first); others aren't learned. A text is
read in blocks, so it takes a few times its own size in memory, whatever the number of languages.

A text is in no learned language if even the language that fits best makes its trigrams less likely
than if all cells were equally so. Such a text, a null one and one without a letter are
`und` with score 0, as every text is if no language was learned. Ties go to the language that
sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.shipping import Sent

CELLS = 1 << 15
SMOOTHING = 0.5
FLOOR = 0.01  # of a language's trigrams, spread over all cells, where the fit of a text is measured
#: How many times a text's mean log-odds counts, as if so many trigrams were independent evidence.
EVIDENCE = 20.0
AMBIGUOUS_SCORE = 0.6
SEGMENT, BLOCK = 128, 1 << 15  # trigrams that are decoded by themselves, and that are looked up at once
MIXED = 0.2  # share of the segments in other languages from which a text is flagged
LANGUAGES = 256
UNDETERMINED = "und"

# ASCII letters lower-cased, other ASCII to a space, bytes of other characters as they are.
FOLDED = bytes((b | 0x20) if chr(b).isalpha() and b < 128 else b if b >= 128 else 0x20 for b in range(256))


def trigrams(data: bytes) -> np.ndarray:
    """The cells of the byte trigrams of data."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(17)


def cells(data: bytes) -> Iterator[np.ndarray]:
    """The cells of the byte trigrams of a folded text, block by block; a space is put at both ends."""
    data = b" " + data + b" "
    for at in range(0, len(data) - 2, BLOCK):
        yield trigrams(data[at : at + BLOCK + 2])


def folded(text: str) -> bytes:
    return (text if text.isascii() else text.lower()).encode("utf-8", "replace").translate(FOLDED)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits for up to five languages, else the widest apart of many drawn."""
    if n <= 5:
        return np.array([[1 if i == 0 or not column >> (i - 1) & 1 else -1 for column in range(1, 1 << (n - 1))] for i in range(n)], dtype=np.int8).reshape(n, -1)
    draw, best, bits = np.random.default_rng(7), None, 15 + int(4 * np.ceil(np.log2(n)))
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0, dtype=int)) < n]
        alike = code.astype(int) @ code.T.astype(int)
        near = ((code.shape[1] - alike[np.triu_indices(n, 1)]) // 2).min()
        if best is None or near > best[0]:
            best = near, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # cells x bits
    weight: np.ndarray  # bits
    fit: np.ndarray  # cells x languages: the log of how much likelier a cell is than if all were equally so

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The loss-weighted distance of each row of margins to each codeword."""
        return np.logaddexp(0, -EVIDENCE * self.code[None] * margins[:, None, :]) @ self.weight

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log-odds by bit and mean fit by language of a folded text, and how many of its segments each language has."""
        odds, fit, votes, n = np.zeros(self.code.shape[1]), np.zeros(len(self.languages)), np.zeros(len(self.languages), dtype=int), 0
        data = b" " + data + b" "
        for at in range(0, len(data) - 2, BLOCK):
            of = trigrams(data[at : at + BLOCK + 2])
            odds_of, fit_of = self.odds[of], self.fit[of]
            whole = len(of) // SEGMENT * SEGMENT
            if whole:
                by = odds_of[:whole].reshape(whole // SEGMENT, SEGMENT, len(odds)).mean(axis=1, dtype=np.float64)
                there = fit_of[:whole].reshape(whole // SEGMENT, SEGMENT, len(fit)).mean(axis=1, dtype=np.float64).max(axis=1) >= 0
                votes += np.bincount(self.losses(by[there]).argmin(axis=1), minlength=len(votes))
            odds += odds_of.sum(axis=0, dtype=np.float64)
            fit += fit_of.sum(axis=0, dtype=np.float64)
            n += len(of)
        return odds / n, fit / n, votes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, flags = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for i, text in enumerate(texts):
            if not self.languages or not has_letter(text):
                continue
            margins, fit, votes = self.read(folded(text))
            if fit.max() < 0:
                continue
            loss = self.losses(margins[None])[0]
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            best = int(loss.argmin())
            wrong = (np.sign(margins) != self.code[best]).sum() * 4 > self.code.shape[1]
            mixed = votes.sum() > 1 and votes.sum() - votes[best] >= MIXED * votes.sum()
            langs[i], scores[i], flags[i] = self.languages[best], float(p[best]), bool(p[best] < AMBIGUOUS_SCORE or wrong or mixed)
        return langs, scores, flags


def counted(labelled: DataFrame) -> DataFrame:
    """lang, cell, n over all rows of labelled (lang, text), summed in each task before the shuffle."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    if lang not in sums:
                        sums[lang] = np.zeros(CELLS, dtype=np.int64)
                    for of in cells(folded(text)):
                        waiting.setdefault(lang, []).append(of)
                        held[lang] = held.get(lang, 0) + len(of)
                        if held[lang] > 65_536:
                            sums[lang] += np.bincount(np.concatenate(waiting.pop(lang)), minlength=CELLS)
                            held[lang] = 0
        for lang, some in waiting.items():
            sums[lang] += np.bincount(np.concatenate(some), minlength=CELLS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

    return labelled.select("lang", "text").mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def learned(labelled: DataFrame, languages: int = LANGUAGES) -> Model:
    """A model of the `languages` most frequent languages in labelled (lang, text); rows without a language or a letter teach nothing."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = counted(labelled.join(F.broadcast(most.select("lang")), "lang", "left_semi")).toPandas()
    languages = sorted(counts["lang"].unique())
    p = np.zeros((max(len(languages), 1), CELLS))
    for i, lang in enumerate(languages):
        of = counts[counts["lang"] == lang]
        p[i, of["cell"].to_numpy()] += of["n"].to_numpy()
    total = np.maximum(p.sum(axis=1, keepdims=True), 1)
    fit = np.log((p * CELLS / total + FLOOR) / (1 + FLOOR)).T.astype(np.float32)
    p += SMOOTHING
    p /= p.sum(axis=1, keepdims=True)
    code = codewords(len(languages)) if languages else np.zeros((0, 0), dtype=np.int8)
    odds, weight = np.zeros((CELLS, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        one, two = p[code[:, b] > 0].mean(axis=0), p[code[:, b] < 0].mean(axis=0)
        odds[:, b] = np.log(one) - np.log(two)
        weight[b] = ((one - two) * odds[:, b]).sum()
    if weight.sum() > 0:
        weight *= len(weight) / weight.sum()
    return Model(list(languages), code, odds, weight, fit)


def predictor(spark, model: Model):
    """A column function: text to struct<lang_pred, score, ambiguous>. The model is broadcast; its size is set by CELLS and the languages."""
    sent = Sent(spark, model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores, flags = sent.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores, "ambiguous": flags})

    return predict


def fold(docs: DataFrame, k: int):
    """crc32 of the identifier as text, modulo k; null for a null identifier."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def trained_on(docs: DataFrame) -> Model:
    """Learned from text and lang of the documents that aren't held out."""
    return learned(docs.filter(fold(docs, 4) != 2).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))


def identified(docs: DataFrame, model: Model | None = None, to: str = "_language") -> DataFrame:
    """docs with a struct column: lang_pred, score, ambiguous."""
    predict = predictor(docs.sparkSession, model or trained_on(docs))
    return docs.withColumn(to, predict(F.col("text").cast("string")))
