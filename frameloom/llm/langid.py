"""Language ID by string kernels: presence of character n-grams, Nyström landmarks, ridge regression.

The kernel of two texts is the number of n-grams of 1 to ORDER characters that both contain,
over the root of the product of their own numbers (a blended-spectrum presence kernel). A few
labelled landmark texts stand for the whole kernel matrix: with K_nm the kernels of the training
texts and landmarks, one-versus-rest ridge regression solves (K_nm' K_nm + r n K_mm) A = K_nm' Y.
A batch of texts is scored by two matrix products, presence x landmarks and kernels x A.

The model is fitted on a bounded sample: per label the PER_LABEL rows with the smallest hash of
id and text among the labelled rows with a text of at most TRAIN_CHARS characters; with many labels so few a label
that SAMPLE_ROWS are left, but one at least. No label is left out. Landmarks are taken from all labels in turn, as many as
LANDMARK_CELLS of the matrix of their n-grams allow. Prediction reads
whole texts only. Null texts and texts without a letter get ``und`` and score 0, as does every
text if no row is labelled. With one label only, every other text gets that label. Among equal scores
the first label by name wins. Rows that repeat id, label and text count once in the sample and are
predicted alike. Columns named like the two new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import SMALL_ROWS, crc_mod, per_text, small_batches, table

ORDER = 3
#: Bits of an n-gram's hash; the table of columns has 2**BITS entries.
BITS = 19
#: Bounds of the fitting sample: rows of a label, rows of all, their characters, landmarks of a label, and cells of their matrix (4 bytes each).
PER_LABEL, SAMPLE_ROWS, TRAIN_CHARS, LANDMARKS, LANDMARK_CELLS = 400, 8000, 20_000, 32, 1 << 24
RIDGE = 1e-4
UNKNOWN = "und"
#: Texts go through the matrix products in blocks of so many.
BLOCK = 128


def grams(text: str) -> np.ndarray:
    """Hashes (below 2**BITS) of the text's n-grams with repeats; runs of other than letters are one space."""
    lower = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) if not text.isascii() else " ".join(text.lower().translate(_ASCII).split())
    a = np.frombuffer(f" {lower} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(a), np.uint64)
    for n in range(1, ORDER + 1):
        if len(a) < n:
            break
        h = (h[: len(a) - n + 1] * np.uint64(0x100000001B3) + a[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(h >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


_ASCII = {c: c if chr(c).isalpha() else 32 for c in range(128)}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """columns: n-gram hash to column or -1; landmarks: presence / root of size, by column; weights: by landmark and label."""

    labels: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernels(self, texts: list[str]) -> np.ndarray:
        seen = np.zeros((len(texts), self.landmarks.shape[0]), np.float32)
        sizes = np.ones(len(texts), np.float32)
        last = np.zeros(1 << BITS, np.int64)
        for i, text in enumerate(texts):
            g = grams(text)
            order = np.arange(len(g))
            last[g] = order  # of equal n-grams the last stays, so each is counted once
            distinct = g[last[g] == order]
            sizes[i] = max(1, len(distinct))
            at = self.columns[distinct]
            seen[i, at[at >= 0]] = 1
        return (seen @ self.landmarks) / np.sqrt(sizes)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A label and a score from 0 to 1 for each text."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, x in enumerate(texts) if self.labels and x and has_letter(x)]
        for start in range(0, len(known), BLOCK):
            block = known[start : start + BLOCK]
            margins = (self.kernels([texts[i] for i in block]) @ self.weights).astype(np.float64)
            odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
            for i, k, p in zip(block, margins.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1), strict=True):
                labels[i], scores[i] = self.labels[k], float(p)
        return labels, scores


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from labelled texts; of each label the first ones are landmarks."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.full(1 << BITS, -1, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    turns, counts = [], dict.fromkeys(names, 0)
    for i, label in enumerate(labels):
        counts[label] += 1
        if counts[label] <= landmarks:
            turns.append((counts[label], label, i))
    chosen, found, seen = [], [], np.zeros(1 << BITS, bool)
    for _, _, i in sorted(turns):  # the first text of each label, then the second, ..
        own = np.unique(grams(texts[i]), return_counts=True)[0]
        seen[own] = True
        if chosen and int(seen.sum()) * (len(chosen) + 1) > LANDMARK_CELLS:
            break
        chosen.append(i)
        found.append(own)
    used = np.unique(np.concatenate(found), return_counts=True)[0]
    columns = np.full(1 << BITS, -1, np.int32)
    columns[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(chosen)), np.float32)
    for j, g in enumerate(found):
        marks[columns[g], j] = 1 / np.sqrt(len(g))
    model = Model(names, columns, marks, np.zeros((len(chosen), len(names)), np.float32))
    k_nm = np.concatenate([model.kernels(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]).astype(np.float64)
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    balance = np.array([1 / labels.count(x) for x in labels])[:, None] * len(labels) / len(names)
    normal = k_nm.T @ (balance * k_nm) + ridge * len(texts) * k_nm[chosen] + 1e-8 * np.eye(len(chosen))
    model.weights = np.linalg.solve(normal, k_nm.T @ (balance * y)).astype(np.float32)
    return model


def fit_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """fit() on the bounded sample of docs that the module describes."""
    cut = F.substring(text_col, 1, TRAIN_CHARS)
    rows = docs.select(cut.alias("text"), (F.length(text_col) > TRAIN_CHARS).alias("long"), F.col(label_col).cast("string").alias("label"), F.xxhash64(id_col, text_col).alias("h"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A row's level is the number of leading zero bits of its hash; each level has about half the rows of the one below. The counts by label
    # and level tell from which level on a label has enough rows, so only about twice as many as are wanted are ranked.
    # Longer texts are cut, and come last: only a label that has too few others needs them.
    level = F.when(F.col("long"), -1).otherwise(63 - F.floor(F.log2(F.greatest(F.lit(1.0), F.shiftrightunsigned("h", 1).cast("double") * 2))).cast("int"))
    counts = rows.groupBy("label", level.alias("level")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("label").orderBy(F.desc("level")))  # at most 64 rows a label
    start = counts.withColumn("above", above).groupBy("label").agg(F.coalesce(F.max(F.when(F.col("above") >= PER_LABEL, F.col("level"))), F.lit(-1)).alias("from"))
    starts = start.collect()  # a row a label
    most = max(1, min(PER_LABEL, SAMPLE_ROWS // max(1, len(starts))))
    bounds = docs.sparkSession.createDataFrame([(r["label"], r["from"]) for r in starts], "label string, `from` int")
    bounds = F.broadcast(bounds) if len(starts) <= SMALL_ROWS else bounds
    picked = rows.withColumn("level", level).join(bounds, "label").where(F.col("level") >= F.col("from")).dropDuplicates(["label", "h"])
    place = F.row_number().over(Window.partitionBy("label").orderBy("long", F.shiftrightunsigned("h", 1), "h"))
    sample = picked.withColumn("place", place).where(F.col("place") <= most).select("label", "h", "text").collect()
    sample.sort(key=lambda r: (r["h"], r["label"], r["text"]))
    return fit([r["text"] for r in sample], [r["label"] for r in sample])


def predict(docs: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted label and its score; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: landmarks x their n-grams
    return per_text(docs, f"{label_col} string, {score_col} double", lambda texts: list(shared.value.predict(texts)), text_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those outside the held-out quarter."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = fit_sample(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
