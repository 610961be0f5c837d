"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader under an elastic net, then calibrated by temperature."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.llm import blobs
from domloom.llm.text import uniform
from domloom.session import checkpointed

UNDETERMINED = "und"

#: n-grams of one to so many characters are hashed to 2**BITS features.
ORDERS = 3
BITS = 16

#: Labelled rows used for fitting, per language at most on average. The bound of the sample.
ROWS_PER_LANGUAGE = 2_000

#: Share of the sample kept from fitting, for the temperature.
CALIBRATION = 0.2

#: Relative frequencies are small numbers; features are scaled to lengths of about 1.
SCALE = 10.0

EPOCHS = 4
#: Parts of the sample that are fitted side by side and averaged after each epoch.
PARTS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.005, 0.001

TEMPERATURES = tuple(float(t) for t in np.geomspace(0.02, 5.0, 80))

#: Characters hashed at a time, the unit of memory.
BLOCK = 1 << 19

#: Values of a state, for all languages, that are one row when states are averaged.
STATE_VALUES = 1 << 16

_WORD = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """Languages, ``idf * weight`` per feature and language, bias, temperature."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float


def ngram_codes(chars: np.ndarray, count: int) -> np.ndarray:
    """Hashes of the n-grams that begin at the first ``count`` of ``chars``, a row per order.
    ``chars`` must go on for ``ORDERS - 1`` places."""
    codes = np.empty((ORDERS, count), dtype=np.uint32)
    mixed = np.zeros(count, dtype=np.uint32)
    for n in range(ORDERS):
        mixed = mixed * np.uint32(0x01000193) + chars[n : n + count] + np.uint32(n + 1)
        codes[n] = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return codes


def blocks_of(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """n-gram codes of whole texts, about ``BLOCK`` characters at a time: ``(codes, rows,
    starts)`` with the texts in the block and where each begins. A long text spans several."""
    chars: list[np.ndarray] = []
    rows: list[int] = []
    starts: list[int] = []
    size = 0
    pad = np.zeros(ORDERS - 1, dtype=np.uint32)

    def flush():
        joined = np.concatenate([*chars, pad])
        return ngram_codes(joined, size), np.array(rows), np.array(starts)

    for row, text in enumerate(texts):
        if not text:
            continue
        own = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(own) >= BLOCK:
            padded = np.concatenate([own, pad])
            for at in range(0, len(own), BLOCK):
                part = padded[at : at + BLOCK + ORDERS - 1]
                yield ngram_codes(part, len(part) - ORDERS + 1), np.array([row]), np.array([0])
            continue
        if size + len(own) > BLOCK:
            yield flush()
            chars, rows, starts, size = [], [], [], 0
        rows.append(row)
        starts.append(size)
        chars += [own, pad]
        size += len(own) + ORDERS - 1
    if rows:
        yield flush()


def fit_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel | None:
    """Fit on the rows of ``docs`` that have a language; None if there is none.

    Document frequencies cover all labelled rows. Weights are fitted on a sample bounded by
    ``ROWS_PER_LANGUAGE``, drawn by a hash of the id. Each epoch streams the written sample in
    ``PARTS`` parts, each continuing from the common state. States are averaged in slices of features
    and stay in tables; the driver gets the final weights only, ``2**BITS`` features times languages
    in single precision.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = tuple(sorted(counts))
    frequencies = blobs.summed(labelled.select("text").mapInArrow(_document_frequencies, blobs.SCHEMA), 1 << BITS)
    idf = (np.log((1 + sum(counts.values())) / (1 + frequencies)) + 1).astype(np.float32)

    share = F.create_map(*[F.lit(x) for c in languages for x in (c, min(1.0, ROWS_PER_LANGUAGE / counts[c]))])
    number = F.create_map(*[F.lit(x) for i, c in enumerate(languages) for x in (c, i)])
    sample = labelled.where(uniform(F.col("doc_id"), "sample") < share[F.col("lang")]).select(
        number[F.col("lang")].alias("label"), "text",
        (uniform(F.col("doc_id"), "calibrate") < CALIBRATION).alias("calibrate"),
        F.xxhash64("doc_id", "text").alias("shuffled"),
    )
    vectors = checkpointed(sample.mapInArrow(_vectors(idf), _VECTOR_SCHEMA))
    # Neighbours in a part come in random order, the same on every run.
    spark = docs.sparkSession
    fitting = vectors.where("NOT calibrate").select(
        F.pmod(F.col("shuffled"), F.lit(PARTS)).cast("int").alias("part"), F.lit(1).alias("kind"), "shuffled", "label", "features", "amounts")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    state = spark.createDataFrame([], _STATE)
    for _ in range(EPOCHS):
        # The common state comes first in each part.
        known = state.select(every_part, F.lit(0).alias("kind"), F.col("slice").alias("shuffled"), F.lit(0).alias("label"),
                             F.col("z").alias("features"), F.col("n").alias("amounts"))
        rows = known.unionByName(fitting).repartition("part").sortWithinPartitions("part", "kind", "shuffled")
        state = checkpointed(rows.mapInArrow(_epoch(len(languages)), _STATE).repartition("slice").mapInArrow(_averaged, _STATE))
    weights = np.zeros(((1 << BITS) + 1, len(languages)), dtype=np.float32)
    for row in state.mapInArrow(_final_weights, "slice bigint, weights binary").toLocalIterator():
        part = np.frombuffer(row["weights"], dtype=np.float32).reshape(-1, len(languages))
        begin = row["slice"] * _slice_features(len(languages))
        weights[begin : begin + len(part)] = part
    shipped = spark.sparkContext.broadcast(weights)
    loss = vectors.where("calibrate").mapInArrow(_losses(shipped), "losses array<double>").agg(
        *[F.sum(F.get("losses", F.lit(i))).alias(f"l{i}") for i in range(len(TEMPERATURES))]
    ).first()
    shipped.destroy()
    temperature = min(zip(loss, TEMPERATURES))[1] if loss and loss[0] is not None else 1.0
    weights[:-1] *= idf[:, None] * np.float32(SCALE)
    return LanguageModel(languages, weights[:-1], weights[-1].astype(np.float64), temperature)


def predict_language(
    docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the columns ``keep``, ``lang_pred`` and ``score``, the
    calibrated probability. Whole texts are read, whatever their length, in blocks.

    Null, empty and letterless texts are ``und`` with score 0, and so is everything without a
    model. Ties go to the first language by name. Rows that repeat are predicted alike. Columns
    not named are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep])
    kept = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    if model is None:
        return rows.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if text_col in keep:
        place = kept.index(text_col)
    else:
        place = len(kept)
        rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shipped.value)
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            best, score = _predictions(model, batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    return rows.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows kept from learning: CRC-32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _predictions(model: LanguageModel, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((len(texts), len(model.languages)))
    grams = np.zeros(len(texts))
    columns = [np.ascontiguousarray(model.table[:, k]) for k in range(len(model.languages))]
    for codes, rows, starts in blocks_of(texts):
        for order in codes:
            for k, column in enumerate(columns):
                total[rows, k] += np.add.reduceat(column[order], starts)
        lengths = np.diff([*starts, codes.shape[1]])
        grams[rows] += ORDERS * lengths
    logits = (total / np.maximum(grams, 1)[:, None] + model.bias) / model.temperature
    shares = np.exp(logits - logits.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    best = shares.argmax(axis=1)
    score = shares[np.arange(len(texts)), best]
    # Superscripts, fractions and the like are word characters, but no letters.
    lettered = np.array([bool(t) and any(m[0].isalpha() for m in _WORD.finditer(t)) for t in texts], dtype=bool)
    return np.where(lettered, best, len(model.languages)), np.where(lettered, score, 0.0)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS, dtype=np.int64)
    seen = np.zeros(1 << BITS, dtype=bool)
    last = -1
    for number, batch in enumerate(batches):
        last = -1
        for codes, rows, starts in blocks_of(batch.column(0).to_pylist()):
            for row, begin, end in zip(rows, starts, [*starts[1:], codes.shape[1]]):
                if row != last:
                    counts += seen
                    seen[:] = False
                    last = row
                seen[codes[:, begin:end].ravel()] = True
        counts += seen
        seen[:] = False
    yield from blobs.sliced(counts, TaskContext.get().partitionId())


_VECTOR_SCHEMA = "label int, calibrate boolean, shuffled bigint, features binary, amounts binary"
_VECTOR_ARROW = pa.schema([
    ("label", pa.int32()), ("calibrate", pa.bool_()), ("shuffled", pa.int64()), ("features", pa.binary()), ("amounts", pa.binary())
])


def _vectors(idf: np.ndarray):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text, calibrate, shuffled in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.zeros(1 << BITS, dtype=np.int64)
                for codes, _, _ in blocks_of([text]):
                    counts += np.bincount(codes.ravel(), minlength=1 << BITS)
                features = np.flatnonzero(counts).astype(np.int32)
                amounts = (counts[features] / max(1, counts.sum()) * idf[features] * SCALE).astype(np.float32)
                yield pa.RecordBatch.from_pylist([{
                    "label": label, "calibrate": calibrate, "shuffled": shuffled,
                    "features": features.tobytes(), "amounts": amounts.tobytes(),
                }], _VECTOR_ARROW)

    return vectors


def _example(row: dict) -> tuple[int, np.ndarray, np.ndarray]:
    """Label, features and amounts of a row, with the constant feature at the end."""
    features = np.frombuffer(row["features"], dtype=np.int32)
    amounts = np.frombuffer(row["amounts"], dtype=np.float32)
    return row["label"], np.append(features, 1 << BITS), np.append(amounts, 1.0).astype(np.float64)


_STATE = "slice bigint, z binary, n binary"
_STATE_ARROW = pa.schema([("slice", pa.int64()), ("z", pa.binary()), ("n", pa.binary())])


def _slice_features(languages: int) -> int:
    return max(1, STATE_VALUES // languages)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the leader's state stands for: zero below the L1 threshold."""
    active = np.abs(z) > L1
    return np.where(active, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def _epoch(languages: int):
    """The state each part of the sample comes to, in slices, however parts are dealt to tasks."""

    def slices(state: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = _slice_features(languages)
        for number, begin in enumerate(range(0, state.shape[1], step)):
            z, n = state[:, begin : begin + step]
            yield pa.RecordBatch.from_pylist([{"slice": number, "z": z.tobytes(), "n": n.tobytes()}], _STATE_ARROW)

    def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = at = None
        examples = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != at:
                    if examples:
                        yield from slices(state)
                    state, at, examples = np.zeros((2, (1 << BITS) + 1, languages), dtype=np.float32), row["part"], 0
                if not row["kind"]:
                    begin = row["shuffled"] * _slice_features(languages)
                    for own, field in zip(state, ("features", "amounts")):
                        part = np.frombuffer(row[field], dtype=np.float32).reshape(-1, languages)
                        own[begin : begin + len(part)] = part
                    continue
                examples += 1
                label, features, amounts = _example(row)
                z, n = state
                near_z, near_n = z[features].astype(np.float64), n[features].astype(np.float64)
                weights = _weights(near_z, near_n)
                logits = amounts @ weights
                shares = np.exp(logits - logits.max())
                shares /= shares.sum()
                shares[label] -= 1.0
                gradient = amounts[:, None] * shares[None, :]
                squares = gradient * gradient
                z[features] = near_z + gradient - (np.sqrt(near_n + squares) - np.sqrt(near_n)) / ALPHA * weights
                n[features] = near_n + squares
        if examples:
            yield from slices(state)

    return epoch


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of all parts' states, by slice."""
    sums: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = np.array([np.frombuffer(row[field], dtype=np.float32) for field in ("z", "n")], dtype=np.float64)
            total = sums.setdefault(row["slice"], [0, 0.0])
            total[0], total[1] = total[0] + 1, total[1] + own
    for number, (count, total) in sums.items():
        z, n = (total / count).astype(np.float32)
        yield pa.RecordBatch.from_pylist([{"slice": number, "z": z.tobytes(), "n": n.tobytes()}], _STATE_ARROW)


def _final_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            z, n = (np.frombuffer(row[field], dtype=np.float32).astype(np.float64) for field in ("z", "n"))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([row["slice"]], pa.int64()), "weights": pa.array([_weights(z, n).astype(np.float32).tobytes()], pa.binary())})


def _losses(shipped):
    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for row in (row for batch in batches for row in batch.to_pylist()):
            label, features, amounts = _example(row)
            logits = (amounts @ shipped.value[features])[None, :] / np.array(TEMPERATURES)[:, None]
            top = logits.max(axis=1)
            total += np.log(np.exp(logits - top[:, None]).sum(axis=1)) + top - logits[:, label]
        yield pa.RecordBatch.from_pydict({"losses": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return losses
