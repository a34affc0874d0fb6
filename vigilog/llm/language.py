"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that
followed. A byte that followed the longest known context costs its share there; otherwise an escape
is paid and the next shorter context is asked, down to all 256 bytes alike. Escapes weigh as many as
the distinct bytes of the context. The counts are frozen after training, so a byte's cost depends on
the bytes before it and nothing else, and the code length of a text is a plain sum.

For speed the trees of all languages are laid over each other: a table gives, for each context that
any tree holds and each byte, the exact code length under every language. A context that no tree
holds has the code lengths of the longest one below it, since shorter contexts are asked without an
escape where the longer is unknown.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import lean

#: Bytes of the longest context.
ORDER = 3
#: Training documents per language, chosen by hash; the only sample, it bounds the model.
TRAIN_DOCUMENTS = 1000
#: A text's first byte follows so many of these.
START = 0
UNDETERMINED = "und"


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``lang, text``: about ``per_language`` documents of each language, chosen by the hash of
    ``doc_id`` (of the text where there is none); all of a language that has fewer. Rows without text or
    language are left out."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).withColumnRenamed("lang", "l")
    draw = F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")), F.lit(1 << 30)) / F.lit(1 << 30)
    return (
        known.join(F.broadcast(sizes), F.col("lang") == F.col("l"))  # a row per language, each of which gets a model
        .filter(draw * F.col("rows") < per_language)
        .select("lang", "text")
    )


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(b"\0" * ORDER + text.encode(), np.uint8)


def _windows(symbols: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` bytes before it, as one number, oldest byte highest."""
    windows = np.zeros(len(symbols) - ORDER, np.uint32)
    for back in range(ORDER, -1, -1):
        windows = (windows << 8) | symbols[ORDER - back : len(symbols) - back]
    return windows


def context_counts(rows: DataFrame) -> DataFrame:
    """``lang, window, n``: how often each byte followed each ``ORDER`` bytes, by language."""

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            windows: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, batch.column(1), strict=True):
                windows.setdefault(lang, []).append(_windows(_symbols(text.as_py())))
            for lang, parts in windows.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))],
                    ["lang", "window", "n"],
                )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, window bigint, n bigint")
    return counted.groupBy("lang", "window").agg(F.sum("n").alias("n"))


class ContextModel:
    """Frozen statistics as tables: ``state`` of the last ``ORDER`` bytes, and ``cost[state, byte]``."""

    def __init__(self, counts: pa.Table | list[tuple[str, int, int]]):
        """``counts`` are ``lang, window, n``, as a table or as rows."""
        if isinstance(counts, list):
            counts = pa.table(dict(zip(("lang", "window", "n"), map(list, zip(*counts, strict=True)), strict=True)))
        names = counts["lang"].combine_chunks().dictionary_encode()
        self.languages = sorted(names.dictionary.to_pylist())
        number = {lang: i for i, lang in enumerate(self.languages)}
        lang = np.array([number[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        window = counts["window"].to_numpy()
        n = counts["n"].to_numpy().astype(np.float64)
        # Bytes that training never saw are one class: nothing tells them apart.
        seen = np.unique(np.concatenate([[START], *((window >> (8 * k)) & 255 for k in range(ORDER + 1))]))
        self.symbol = np.full(256, len(seen), np.uint8)
        self.symbol[seen] = np.arange(len(seen))
        self.width = width = len(seen) + 1
        unseen = 256 - len(seen)
        size = len(self.languages)
        mapped = sum(self.symbol[(window >> (8 * k)) & 255].astype(np.int64) * width**k for k in range(ORDER + 1))
        # Probabilities under the context of no bytes, then of one, two, ...: each from the one before.
        share = np.full(width, 1 / 256)
        probability = np.tile(share, (1, size, 1))  # context x language x byte
        state = np.zeros(1, np.int64)
        for order in range(ORDER + 1):
            contexts, at = np.unique(mapped % width ** (order + 1) // width, return_inverse=True)
            by_context = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[by_context], np.arange(len(contexts) + 1))
            # Of the longest contexts, by far the most, only costs are kept: half the bytes, and no second copy.
            last = order == ORDER
            found = np.empty((0 if last else len(contexts), size, width))
            if last:
                self.cost = np.empty(((len(probability) + len(contexts)) * width, size), np.float32)
                self._price(0, probability)
            for start in range(0, len(contexts), 1024):  # a piece at a time, to hold little
                stop = min(start + 1024, len(contexts))
                own = by_context[ends[start] : ends[stop]]
                cell = ((at[own] - start) * size + lang[own]) * width + mapped[own] % width
                count = np.bincount(cell, n[own], (stop - start) * size * width).reshape(-1, size, width)
                # The context with its oldest byte taken away.
                shorter = probability[state[contexts[start:stop] % width ** max(order - 1, 0)]]
                piece = self._follow(count, shorter, unseen)
                if last:
                    self._price(len(probability) + start, piece)
                else:
                    found[start:stop] = piece
            if order == 0:
                probability = found
                continue
            state = state[np.arange(width**order) % width ** (order - 1)]
            state[contexts] = len(probability) + np.arange(len(contexts))
            if not last:
                probability = np.concatenate([probability, found])
        self.state = state.astype(np.int32)

    def _price(self, first: int, probability: np.ndarray) -> None:
        """Set the costs of contexts from number ``first`` on."""
        rows = slice(first * self.width, (first + len(probability)) * self.width)
        for i in range(probability.shape[1]):
            self.cost[rows, i] = -np.log2(np.maximum(probability[:, i, :].reshape(-1), 1e-12))

    @staticmethod
    def _follow(count: np.ndarray, shorter: np.ndarray, unseen: int) -> np.ndarray:
        """Probability of each byte: its share of what followed, else an escape and the share among
        the bytes that didn't follow under the shorter context."""
        total = count.sum(axis=2, keepdims=True)
        followed = count > 0
        distinct = followed.sum(axis=2, keepdims=True)
        alike = np.ones(count.shape[2])
        alike[-1] = unseen
        left = np.where(followed, 0.0, shorter * alike).sum(axis=2, keepdims=True)
        escape = distinct / np.maximum(total + distinct, 1) / np.where(left > 0, left, 1)
        here = np.where(followed, count / np.maximum(total + distinct, 1), escape * shorter)
        return np.where(total > 0, here, shorter)

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the text under each language; it is looked at piece by piece."""
        raw = self.symbol[_symbols(text)]
        total = np.zeros(len(self.languages))
        for start in range(0, len(raw) - ORDER, 1 << 20):
            piece = raw[start : start + (1 << 20) + ORDER].astype(np.int32)
            context = np.zeros(len(piece) - ORDER, np.int32)
            for back in range(ORDER, 0, -1):
                context = context * self.width + piece[ORDER - back : len(piece) - back]
            total += self.cost[self.state[context] * self.width + piece[ORDER:]].sum(axis=0, dtype=np.float64)
        return total


def train(docs: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> ContextModel | None:
    """The model of the training rows, None if there are none.

    The counts that the driver reads are bounded by the sample: one row per language and distinct
    run of ``ORDER + 1`` bytes of ``per_language`` documents.
    """
    lean()  # what making the model takes goes back to the system, on the driver too
    rows = context_counts(training_rows(docs, per_language)).toArrow()
    return ContextModel(rows) if rows.num_rows else None


def identify(docs: DataFrame, model: ContextModel | None, text: str = "text") -> Column:
    """``struct<lang_pred: string, score: double, bits: double>`` of a text.

    The language is the one under which the text is shortest (ties: the first by code point);
    ``score`` is its probability against the others, all being equally likely before; ``bits`` the
    code length per byte. Null text, text without a letter, and every text without a model is
    ``und`` with score 0 and no ``bits``.
    """
    none = F.struct(
        F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits")
    )
    if model is None:
        return none
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded with the training sample

    @F.arrow_udf("lang_pred string, score double, bits double")
    def best(texts: pa.Array) -> pa.Array:
        lean()
        frozen = shared.value
        names, scores, bits = [], [], []
        for value in texts:
            lengths = frozen.code_lengths(value.as_py() or "")
            at = int(np.argmin(lengths))
            names.append(frozen.languages[at])
            scores.append(float(1 / np.exp2(np.maximum(lengths[at] - lengths, -1000)).sum()))
            bits.append(float(lengths[at]) / max(1, value.as_buffer().size if value.is_valid else 1))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores), pa.array(bits)], ["lang_pred", "score", "bits"]
        )

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return F.when(lettered, best(text)).otherwise(none)
