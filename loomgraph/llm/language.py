"""Operator 6, language identification with string kernels.

The kernel of two texts counts the byte n-grams of orders 1 to 3 (blended spectrum) that
both hold, presence only, over A-Z lower-cased bytes with digits, punctuation and white
space taken as one blank: ``k(x, y) = |x & y| / sqrt(|x| |y|)``.

Landmarks (a few labelled texts per language) span the Nystroem feature space
``phi(x) = k(x, L) K_LL^(-1/2)``; in it one ridge regression per language tells its texts
(+1) from all others (-1). As all of this is linear in the presence vector, a batch is
scored by one product of its presence matrix with ``n-grams x languages`` weights.

Only the classifier is fitted on a sample: at most ``landmarks`` and ``examples`` texts
per language, drawn by hash of the id from the training rows (``crc32(id) mod modulus !=
held``, language and text not null). Every language is learned, however rare or many they
are: beyond 16 languages the shares of each shrink (``LANDMARKS`` and ``EXAMPLES`` texts in
all, one and four of a language at least). Sampled texts are read whole, and their n-grams
alone reach the driver. Kernel products run over slices of n-grams, so that no dense
matrix of texts by n-grams is made. Every text is scored whole.

A text's familiarity is the share of its distinct n-grams that the landmarks know. The
examples that are no landmarks give its usual range: a text below half of what 99 in 100
of them reach is in none of the learned languages (``familiar`` is false); the rule does
not depend on the number of languages, as scores of one-versus-rest regressions do.

Nulls: a null text, or one without any letter, is ``und`` with score 0, and not familiar.
Rows with a null language or text are not learned from. Repeated rows are predicted each.
An empty table, or one without rows to learn from, gives ``und`` for all; ties go to the
first language by code point. Texts of any length are read whole; a single very long one
makes a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import distinct, remainder, texts
from .words import batches_of, buffer_of

_CLASS = np.zeros(256, np.int32)
for _b in range(256):
    _low = _b + 32 if 65 <= _b <= 90 else _b
    _CLASS[_b] = _low - 96 if 97 <= _low <= 122 else _b - 128 + 27 if _b >= 128 else 0
_BASE = 155
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: Texts that the classifier is fitted on at most, over all languages.
LANDMARKS, EXAMPLES = 640, 2560
#: N-grams per slice of a kernel product, and cells of a presence matrix.
SLICE, CELLS = 8192, 40_000_000
#: Number of n-gram codes: orders 1, 2 and 3 one after the other.
CODES = _BASE + _BASE**2 + _BASE**3


def ngram_codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: codes at all positions, and whether the n-gram stays within its text."""
    c = _CLASS[data]
    yield c, np.ones(len(c), bool)
    if len(c) > 1:
        inside = np.ones(len(c), bool)
        last = offsets[1:][np.diff(offsets) > 0] - 1
        inside[last] = False
        yield _BASE + c[:-1] * _BASE + c[1:], inside[:-1]
        if len(c) > 2:
            inside[np.maximum(last - 1, 0)] = False
            yield _BASE + _BASE**2 + (c[:-2] * _BASE + c[1:-1]) * _BASE + c[2:], inside[:-2]


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    known = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = known[offsets[1:]] > known[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


class Model:
    """Weights of n-grams by language, and the least familiarity of a text in a learned language."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, shift: np.ndarray | float = 0.0, usual: float = 0.0):
        self.languages, self.codes, self.weights, self.shift, self.usual = languages, codes, weights, shift, usual
        self._slot = None

    @property
    def rows(self) -> int:
        """Texts whose presence matrix is of bounded size."""
        return max(1, min(2000, CELLS // max(1, len(self.codes))))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decision values (text by language), and each text's familiarity."""
        if self._slot is None:
            self._slot = np.full(CODES, -1, np.int32)
            self._slot[self.codes] = np.arange(len(self.codes))
        n = len(offsets) - 1
        present = np.zeros((n, len(self.codes)), bool)
        flat = present.reshape(-1)
        base = np.repeat(np.arange(n) * len(self.codes), np.diff(offsets))
        text = np.repeat(np.arange(n), np.diff(offsets))
        strange = []
        for codes, inside in ngram_codes(data, offsets):
            slot = self._slot[codes]
            use = inside & (slot >= 0)
            flat[base[: len(codes)][use] + slot[use]] = True
            use = inside & (slot < 0)
            strange.append(text[: len(codes)][use] * CODES + codes[use])
        others = np.bincount(distinct(np.concatenate(strange)) // CODES, minlength=n) if strange else np.zeros(n)
        out, known = np.zeros((n, len(self.languages))), np.zeros(n)
        for i in range(0, n, 512):
            part = present[i : i + 512]
            known[i : i + 512] = part.sum(1)
            out[i : i + 512] = part.astype(np.float32) @ self.weights / np.sqrt(np.maximum(known[i : i + 512], 1))[:, None]
        return out + self.shift, known / np.maximum(1, known + others)

    def __getstate__(self):
        return {**self.__dict__, "_slot": None}


def fit_kernel(languages: list[str], landmarks: list[np.ndarray], examples: list[np.ndarray], truth: np.ndarray, ridge: float = 0.1) -> Model:
    """Kernel ridge regression in the landmarks' Nystroem space; texts are given as sorted n-gram codes. There is a landmark at least."""
    codes = distinct(np.concatenate(landmarks))

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts and columns of known n-grams, by column, and each text's number of them."""
        text, column = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(codes, column), max(0, len(codes) - 1))
        good = codes[at] == column if len(codes) else np.zeros(len(column), bool)
        text, at = text[good], at[good]
        order = np.argsort(at, kind="stable")
        return text[order], at[order], np.bincount(text, minlength=len(sets))

    def slices(parts):
        """Dense slices of presence, scaled to length one per text."""
        for low in range(0, len(codes), SLICE):
            out = []
            for text, column, count in parts:
                i, j = np.searchsorted(column, [low, low + SLICE])
                dense = np.zeros((len(count), min(SLICE, len(codes) - low)), np.float32)
                dense[text[i:j], column[i:j] - low] = 1 / np.sqrt(count[text[i:j]])
                out.append(dense)
            yield out

    marks, rows = cells(landmarks), cells(examples)
    among, across = np.zeros((len(landmarks), len(landmarks))), np.zeros((len(examples), len(landmarks)))
    for m, r in slices((marks, rows)):
        among += m @ m.T
        across += r @ m.T
    values, vectors = np.linalg.eigh(among)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([across @ root, np.ones((len(examples), 1))], 1)
    goal = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.maximum(1, np.bincount(truth, minlength=len(languages)))[truth]
    gram = (phi * weight[:, None]).T @ phi
    gram[np.arange(len(gram) - 1), np.arange(len(gram) - 1)] += ridge * weight.sum() / len(examples)
    beta = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), (phi * weight[:, None]).T @ goal)
    dual = root @ beta[:-1]
    weights = [m.T @ dual for (m,) in slices((marks,))]
    return Model(languages, codes, np.concatenate(weights).astype(np.float32) if weights else np.zeros((0, len(languages)), np.float32), beta[-1])


def train(rows: DataFrame, landmarks: int = 40, examples: int = 160) -> Model | None:
    """Fit on ``rows(id, text, lang)``: of every language a bounded sample by hash of the id. None where there is nothing to learn from."""
    rows = rows.where("text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return None
    languages = sorted(sizes, key=lambda x: x.encode())
    landmarks, examples = max(1, min(landmarks, LANDMARKS // len(sizes))), max(4, min(examples, EXAMPLES // len(sizes)))
    luck = F.pmod(F.xxhash64(F.lit(6), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 3 * (landmarks + examples) / n)))]), F.col("lang"))
    drawn = rows.withColumn("luck", luck).where(F.col("luck") < share)
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("luck", "id"))).where(F.col("nth") <= landmarks + examples)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for i in range(batch.num_rows):
                data, offsets = buffer_of(batch.column(0).slice(i, 1))
                sets.append(distinct(np.concatenate([c[use] for c, use in ngram_codes(data, offsets)])).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sets, pa.binary())], names=["lang", "nth", "codes"])

    found = drawn.select("text", "lang", "nth").mapInArrow(grams, "lang string, nth int, codes binary").orderBy("lang", "nth").collect()
    sets = [np.frombuffer(r.codes, "<i4").astype(np.int64) for r in found]
    place = {k: i for i, k in enumerate(languages)}
    truth = np.array([place[r.lang] for r in found])
    model = fit_kernel(languages, [s for s, r in zip(sets, found, strict=True) if r.nth <= landmarks], sets, truth)
    rest = [np.isin(s, model.codes).mean() for s, r in zip(sets, found, strict=True) if r.nth > landmarks and len(s)]
    model.usual = float(np.quantile(rest, 0.01)) if rest else 0.0
    return model


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 5, held: int = 0, piece: int = 4_000_000, **options) -> DataFrame:
    """All rows: columns c0, c1, ... in the order of ``docs``, then held_out, lang_pred, score (0 to 1) and familiar."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, at = docs.sparkSession, docs.columns.index(text)
    labelled = texts(docs, doc_id, text, lang).toDF("id", "text", "lang").where("lang is not null").where(remainder("id", modulus) != held)
    model = spark.sparkContext.broadcast(train(labelled, **options))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in plain.schema], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("familiar", T.BooleanType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for table in batches_of(batches, piece, fitted.rows if fitted else 2000):
            data, offsets = buffer_of(table.column(at))
            n = table.num_rows
            names, score, familiar = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if fitted is not None:
                value, known = fitted.scores(data, offsets)
                best = value.argmax(1)
                seen = has_letter(table.column(at), data, offsets)
                names[seen] = np.array(fitted.languages, object)[best[seen]]
                score[seen] = np.clip((value.max(1)[seen] + 1) / 2, 0, 1)
                familiar = seen & (known >= fitted.usual / 2)
            columns = [*table.columns, pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(familiar)]
            columns = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    held_out = remainder(f"c{docs.columns.index(doc_id)}", modulus) == held
    return plain.mapInArrow(run, out).withColumn("held_out", held_out)


def with_language(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in a learned language: those with letters that are familiar. Columns stay as they are."""
    rows = identify(docs, **options).where("familiar")
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select(F.col("c0").alias("doc_id"), "held_out", "lang_pred", "score")
