"""Language identification by the nearest of several centroids per language, with rejection by distance.

A text is lower-cased, everything but letters becomes blank, and its character n-grams are counted in hashed features.
Vectors are (1 + log count) times inverse document frequency, at unit length. Each language is clustered into a few
unit centroids (spherical k-means); the centroid with the largest cosine names the language. A text whose cosine lies
below the centroid's floor for texts of its size is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from specloom.llm.names import unused
from specloom.session import ship_package, stage

FEATURES = 1 << 13
GRAM_SIZES = (2, 3)
CENTROIDS = 4
#: About so many texts of each language are drawn, by a hash of their id, to fit its centroids.
SAMPLE_PER_LANGUAGE = 400
ITERATIONS = 12
#: Sums of document frequencies meet in so many rows before they reach the driver.
PARTIAL_SUMS = 64
#: A text is rejected below this part of the smallest cosine of the sample's texts that hold as many features or fewer.
FLOOR_PART = 0.25
SIZE_STEPS = 24
#: With fewer features than this the floor sinks in proportion: a few grams say little about distance.
SURE_FEATURES = 32
UNKNOWN = "und"
SLAB_CHARS = 1 << 18
SLAB_TEXTS = 64


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    floors: np.ndarray


def letters_only(text: Column) -> Column:
    """Lower-cased, with one blank for all that stands between letters; blank if there are none, or for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " "))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def gram_counts(texts: list[str]):
    """Yield (from, to, counts): a row of feature counts for each text, some texts at a time, whole texts always."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < SLAB_TEXTS and (end == at or size + len(texts[end]) <= SLAB_CHARS):
            size += len(texts[end])
            end += 1
        n, counts = end - at, np.zeros((end - at) * FEATURES, np.float32)
        # A text beyond a slab is counted in parts that overlap by what a gram needs.
        part = SLAB_CHARS if n == 1 else size + 1
        for lo in range(0, max(1, len(texts[at]) if n == 1 else 1), part):
            padded = [f" {t} " for t in texts[at:end]] if n > 1 else [f" {texts[at]} "[lo : lo + part + max(GRAM_SIZES) + 1]]
            points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = np.array([len(p) for p in padded])
            last = n == 1 and lo + part < len(texts[at])
            row = np.repeat(np.arange(n, dtype=np.int64), sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
            with np.errstate(over="ignore"):
                mixed = points.copy()
                for gram in range(2, max(GRAM_SIZES) + 1):
                    mixed = mixed[:-1] * np.uint32(0x01000193) + points[gram - 1 :] + np.uint32(gram)
                    if gram not in GRAM_SIZES:
                        continue
                    ok = left[: len(mixed)] >= gram
                    if last:
                        # Grams from here on start in the next part.
                        ok[part:] = False
                    slot = (mixed * np.uint32(0x9E3779B1) >> np.uint32(32 - 13)).astype(np.int64)
                    counts += np.bincount((row[: len(mixed)] * FEATURES + slot)[ok], minlength=len(counts)).astype(np.float32)
        yield at, end, counts.reshape(n, FEATURES)
        at = end


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = np.zeros_like(counts)
    np.log(counts, out=weight, where=counts > 0)
    weight += counts > 0
    weight *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", weight, weight))
    weight /= np.where(norm > 0, norm, 1)[:, None]
    return weight


def _k_means(vectors: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids; starts from the vectors farthest from those taken before."""
    centres = [vectors.mean(0)]
    while len(centres) < min(k, len(vectors)):
        near = np.max(vectors @ np.array(centres).T, axis=1)
        centres.append(vectors[int(np.argmin(near))])
    centres = np.array(centres)
    for _ in range(ITERATIONS):
        home = np.argmax(vectors @ centres.T, axis=1)
        sums = [vectors[home == j].sum(0) if (home == j).any() else centres[j] for j in range(len(centres))]
        centres = np.array([s / max(np.linalg.norm(s), 1e-12) for s in sums])
    return centres.astype(np.float32)


def _size_step(counts: np.ndarray) -> np.ndarray:
    """Half powers of two of the number of features a text has."""
    return np.minimum(SIZE_STEPS - 1, (2 * np.log2(np.maximum(1, (counts > 0).sum(1)))).astype(np.int64))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """Fit centroids to the rows of ``docs`` with a label and at least one letter.

    Document frequencies come from all of them; centroids from a sample of about SAMPLE_PER_LANGUAGE texts a language.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(label_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        empty = np.empty((0, FEATURES), np.float32)
        return Model([], empty, np.empty(0, np.int64), np.zeros(FEATURES, np.float32), np.empty((0, SIZE_STEPS)))
    share = F.create_map(*[c for k, n in sizes.items() for c in (F.lit(k), F.lit(min(1.0, SAMPLE_PER_LANGUAGE / n)))])
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = rows.select(letters_only(F.col("text")), "lang", (draw < share[F.col("lang")]).alias("drawn"))
    schema = T.StructType(
        [
            T.StructField("lang", T.StringType()), T.StructField("part", T.IntegerType()),
            T.StructField("slot", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType())),
        ]
    )

    def count(batches):
        frequency = np.zeros(FEATURES, np.int64)
        for batch in batches:
            texts, langs, drawn = (batch.column(i).to_pylist() for i in range(3))
            for a, b, counts in gram_counts(texts):
                frequency += (counts > 0).sum(0)
                for i in range(a, b):
                    if drawn[i]:
                        slot = np.flatnonzero(counts[i - a])
                        value = counts[i - a][slot].astype(np.int64)
                        yield pa.RecordBatch.from_pylist([{"lang": langs[i], "part": None, "slot": slot, "n": value}], arrow)
        part = TaskContext.get().partitionId() % PARTIAL_SUMS
        yield pa.RecordBatch.from_pylist([{"lang": None, "part": part, "slot": None, "n": frequency}], arrow)

    arrow = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("slot", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    counted = stage(rows.mapInArrow(count, schema), "grams")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [np.sum(np.stack(group["n"].to_list()), axis=0)]})

    sums = counted.where("part IS NOT NULL").groupBy("part").applyInPandas(add, "n array<bigint>").collect()
    frequency = np.sum([r["n"] for r in sums], axis=0)
    idf = np.log((1 + sum(sizes.values())) / (1 + frequency)).astype(np.float32)
    languages, centroids, owner, floors = sorted(sizes), [], [], []

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        sample = group.sort_values("place", kind="stable")
        counts = np.zeros((len(sample), FEATURES), np.float32)
        for i, (slot, n) in enumerate(zip(sample["slot"], sample["n"])):
            counts[i, slot] = n
        vectors = unit_vectors(counts, idf)
        centres = _k_means(vectors, CENTROIDS)
        near, step = np.max(vectors @ centres.T, axis=1), _size_step(counts)
        # Larger texts lie nearer, so a floor holds for texts of its size and up to that of the next step.
        floor = np.array([near[step >= s].min() if (step >= s).any() else 1.0 for s in range(SIZE_STEPS)])
        lowest = np.array([near[step == s].min() if (step == s).any() else np.nan for s in range(SIZE_STEPS)])
        floor = np.fmin(floor, np.where(np.isnan(lowest), floor, lowest))
        sure = np.minimum(1, 2 ** (np.arange(SIZE_STEPS) / 2) / SURE_FEATURES)
        floor = FLOOR_PART * sure * np.minimum.accumulate(floor[::-1])[::-1]
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centres": [centres.ravel()], "floor": [floor]})

    # A group is a sample of one language; what comes back is a few centroids of each.
    sampled = counted.where("lang IS NOT NULL").select("lang", "slot", "n", F.xxhash64("slot", "n").alias("place"))
    fitted = {r.lang: r for r in sampled.groupBy("lang").applyInPandas(fit, "lang string, centres array<float>, floor array<double>").collect()}
    for number, lang in enumerate(languages):
        if lang in fitted:
            centres = np.array(fitted[lang].centres, np.float32).reshape(-1, FEATURES)
            centroids.append(centres)
            owner += [number] * len(centres)
            floors += [np.array(fitted[lang].floor)] * len(centres)
    if not centroids:
        return Model([], np.empty((0, FEATURES), np.float32), np.empty(0, np.int64), idf, np.empty((0, SIZE_STEPS)))
    return Model(languages, np.concatenate(centroids), np.array(owner), idf, np.array(floors))


def _judge(known: Model, texts: list[str], letters: list[bool]) -> tuple[list[str], list[float], list[bool]]:
    lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    for a, b, counts in gram_counts(texts) if len(known.owner) else ():
        cosine = unit_vectors(counts, known.idf) @ known.centroids.T
        best, step = np.argmax(cosine, axis=1), _size_step(counts)
        for i in range(a, b):
            if letters[i]:
                j = int(best[i - a])
                value = float(cosine[i - a, j])
                lang[i], score[i] = known.languages[known.owner[j]], min(1.0, max(0.0, value))
                rejected[i] = bool(value < known.floors[j, step[i - a]])
    return lang, score, rejected


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each row: the language of the nearest centroid and its cosine, 0 to 1.

    A null text, or one without letters, is ``und`` with score 0 and rejected, as is everything if the model knows no
    language. Of equally near centroids the first language by name wins. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
        ]
    )

    def judge(batches):
        for batch in batches:
            lang, score, rejected = _judge(shared.value, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                schema.fieldNames(),
            )

    text = F.col(text_column)
    return docs.select(F.col(id_column), letters_only(text), has_letter(text)).mapInArrow(judge, schema)


def keep_known(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`predict` does not reject, with all their columns."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    width = len(docs.columns)

    def keep(batches):
        for batch in batches:
            _, _, rejected = _judge(shared.value, batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())
            kept = pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width])
            yield kept.filter(pa.array([not r for r in rejected], pa.bool_()))

    text, letters, any_ = F.col(text_column), unused("_letters", docs.columns), unused("_any", docs.columns)
    return docs.select("*", letters_only(text).alias(letters), has_letter(text).alias(any_)).mapInArrow(keep, docs.schema)
