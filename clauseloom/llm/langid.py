"""Language identification with a string kernel.

A text is the set of its character n-grams of one to four code points (lower-cased,
digits as one character, runs of white space as one space), hashed into a fixed number of
columns. The kernel of two texts is the size of what their sets share over the root of the
product of their sizes. Nyström landmarks stand for the training texts; one ridge
regression per language against the rest is fitted on the landmark features. A kernel
value is a product of two presence rows, so landmarks, whitening and regression fold into
one matrix (columns x languages), and a batch of whole texts is scored by one product.

The fit is on a bounded sample: ``ROWS_PER_LANG`` labelled rows a language, chosen by hash
of their key, and ``LANDMARKS`` of them. Every row is scored.

Defined cases: a text that is null or has no letter gets ``und`` and 0; so does every text
when there was nothing to learn from; rows without a language, key or text are not
learned from; equal scores go to the first language in order; repeated rows are scored
alike; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import mixed

COLUMNS = 1 << 16
LONGEST = 4
ROWS_PER_LANG = 800
LANDMARKS = 256
RIDGE = 1e-3
#: More distinct labels than this are not languages.
MOST_LANGS = 1000
BATCH = 64
LETTER = re.compile(r"[^\W\d_]")
_SPACE, _DIGIT = re.compile(r"\s+"), re.compile(r"\d")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # COLUMNS x languages


def columns_of(text: str) -> np.ndarray:
    """Columns of the n-grams of a text, with repeats."""
    chars = np.frombuffer(_SPACE.sub(" ", _DIGIT.sub("0", text.lower())).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    base, out, gram = mixed(chars), [], None
    for n in range(1, LONGEST + 1):
        if len(base) < n:
            break
        gram = base if gram is None else mixed(gram[:-1] * np.uint64(3) + base[n - 1:])
        out.append((gram >> np.uint64(20)) % np.uint64(COLUMNS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def presence(texts: list[str], out: np.ndarray | None = None) -> np.ndarray:
    """One row per text, with unit length: 1 / sqrt(set size) in the columns of its n-grams."""
    rows = np.zeros((len(texts), COLUMNS), np.float32) if out is None else out[:len(texts)]
    rows[:] = 0
    for row, text in zip(rows, texts):
        row[columns_of(text)] = 1
    sizes = rows.sum(axis=1, keepdims=True)
    return rows / np.sqrt(np.maximum(sizes, 1)) if out is None else np.divide(rows, np.sqrt(np.maximum(sizes, 1)), out=rows)


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of each language, by hash of the key; all rows of a rarer one."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND key IS NOT NULL")
    counts = usable.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} distinct labels")
    if not counts:
        return usable.limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, rows / n)])
    return usable.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)


def fitted(labelled: DataFrame, rows: int = ROWS_PER_LANG, landmarks: int = LANDMARKS) -> Model:
    """Fits on rows with columns key, text, lang; at most about ``rows`` of each language reach the fit."""
    sample = sampled(labelled, rows)
    # landmarks: the first texts of each language by hash, taking turns; LANDMARKS texts at most
    keys = sample.select("lang", F.xxhash64("key").alias("h"), "key").collect()  # rows x languages at most, no texts
    turns: dict[str, list] = {}
    for lang, h, key in sorted(keys, key=lambda r: (r[1], str(r[2]))):
        turns.setdefault(lang, []).append(key)
    langs = sorted(turns)
    if not langs:
        return Model([], np.zeros((COLUMNS, 0), np.float32))
    chosen = [turns[lang][k] for k in range(max(map(len, turns.values()))) for lang in langs if k < len(turns[lang])][:landmarks]
    texts = [t for _, t in sorted((str(k), t) for k, t in sample.where(F.col("key").isin(chosen)).select("key", "text").collect())]
    marks = presence(texts)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.zeros((BATCH, COLUMNS), np.float32)
        for batch in batches:
            values = batch.column(0).to_pylist()
            kernel = [presence(values[i:i + BATCH], room) @ marks.T for i in range(0, len(values), BATCH)]
            if kernel:
                kernel = np.concatenate(kernel)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(kernel), pa.list_(pa.float32())), batch.column(1)], ["kernel", "lang"])

    got = sample.select("text", "lang").mapInArrow(features, "kernel array<float>, lang string").collect()
    kernel, names = np.array([r[0] for r in got], np.float64), [r[1] for r in got]
    among = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values[-1]
    white = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ white
    order = np.lexsort((*phi.T[:2], names))  # rows come back in any order; sums should not depend on it
    phi, names = phi[order], [names[i] for i in order]
    wanted = np.array([[name == lang for lang in langs] for name in names], float)
    balance = 1 / np.maximum(wanted.sum(axis=0), 1)
    row_weight = wanted @ balance
    solved = np.linalg.solve(phi.T @ (phi * row_weight[:, None]) + RIDGE * np.eye(phi.shape[1]), phi.T @ (wanted * row_weight[:, None]))
    return Model(langs, (marks.T @ (white @ solved)).astype(np.float32))


def predicted(text: Column, model: Model) -> Column:
    """struct<lang, score>"""
    langs, weights = model.langs, model.weights

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        room = np.zeros((BATCH, COLUMNS), np.float32)
        for column in batches:
            names, scores = [], []
            for i in range(0, len(column), BATCH):
                values = column.slice(i, BATCH).to_pylist()
                known = [bool(x and LETTER.search(x)) for x in values]
                if langs:
                    out = presence([x if k else "" for x, k in zip(values, known)], room) @ weights
                    best = out.argmax(axis=1)
                for j, k in enumerate(known):
                    names.append(langs[best[j]] if k and langs else "und")
                    scores.append(float(min(1.0, max(0.0, out[j, best[j]]))) if k and langs else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict(text)
