"""Rule statistics of whole texts, shared by the quality operators.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  A null text counts as empty: all
statistics are zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import text_batches

WINDOW_WORDS = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct", "n_letters", "n_upper", "n_digits", "n_bang", "n_stops")

_OTHER = 256  # all code points above Latin-1


def _mask(chars) -> np.ndarray:
    m = np.zeros(_OTHER + 1, dtype=np.int64)
    m[[ord(c) for c in chars]] = 1
    return m


_LATIN1 = [chr(c) for c in range(256)]
_SPACE = _mask(" \t\n\v\f\r")
_SYMBOL = _mask("#*$%&|<>")
_LETTER = _mask(c for c in _LATIN1 if c.isalpha())
_LETTER[_OTHER] = 1
_UPPER = _mask(c for c in _LATIN1 if c.isupper())
_DIGIT = _mask("0123456789")
_BANG = _mask("!")
_STOP = _mask(".,;:?")
_CLASSES = np.stack([_SPACE, _SYMBOL, _LETTER, _UPPER, _DIGIT, _BANG, _STOP])


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words inside ``width``-word windows that occur twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    grams = [tuple(words[i:i + width]) for i in starts]  # equal hashes are only candidates
    seen = Counter(grams)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, g in zip(starts, grams, strict=True):
        if seen[g] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The :data:`COUNTS` of one text."""
    if not text:
        return (0,) * len(COUNTS)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hist = np.bincount(np.minimum(code, _OTHER), minlength=_OTHER + 1)
    space, symbols, letters, upper, digits, bang, stops = (_CLASSES @ hist).tolist()
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), len(text) - space, symbols, dup, repeated_words(words), lines,
            len(set(words)), letters, upper, digits, bang, stops)


FEATURES = ("symbol_rate", "upper_rate", "digit_rate", "bang_rate", "stop_rate", "word_length",
            "dup_line_rate", "repeat_rate", "distinct_rate", "log_words", "line_words")
_RATIOS = (("n_symbols", "word_chars"), ("n_upper", "n_letters"), ("n_digits", "word_chars"), ("n_bang", "word_chars"),
           ("n_stops", "word_chars"), ("word_chars", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
           ("n_distinct", "n_words"), None, ("n_words", "n_lines"))


def text_features(counts: np.ndarray) -> np.ndarray:
    """The :data:`FEATURES`, length-free ratios but for ``log_words``; zero where undefined."""
    by = dict(zip(COUNTS, counts.T.astype(np.float64), strict=True))
    out = np.zeros((len(counts), len(FEATURES)))
    for j, pair in enumerate(_RATIOS):
        if pair is None:
            out[:, j] = np.log1p(by["n_words"])
        else:
            np.divide(by[pair[0]], by[pair[1]], out=out[:, j], where=by[pair[1]] > 0)
    return out


def stats_of(text: Column) -> Column:
    """The :data:`COUNTS` and :data:`FEATURES` of a text column as one struct, computed once per row."""

    @F.pandas_udf(", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES]))
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            counts = np.array([text_counts(x) for x in t], dtype=np.int64).reshape(len(t), len(COUNTS))
            yield pd.concat([pd.DataFrame(counts, columns=list(COUNTS)),
                             pd.DataFrame(text_features(counts), columns=list(FEATURES))], axis=1)

    return stats.asNondeterministic()(text.cast("string"))


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the :data:`COUNTS` and the :data:`FEATURES` of every whole text; no shuffle.

    Null ids stay null; repeated rows give repeated results; other columns of
    ``docs`` are ignored, whatever their names.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stats_of(F.col(text_col)).alias("stats"))
    return rows.select("doc_id", "stats.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, wanted: int, only: Column | None = None,
                    id_col: str = "doc_id") -> DataFrame:
    """Documents of about ``wanted`` labelled ids (a documented bound), with column ``y``.

    The same hash decides on both sides, so only the sampled texts are joined.
    Null ids, null labels and ids with contradicting labels are left out.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    lab = lab.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if only is not None:
        lab = lab.where(only)
    share = sample_share_of(lab, wanted)
    picked = lab.where(share(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y_max"))
    picked = picked.where("y = y_max").drop("y_max")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.where(share(F.col("doc_id"))).join(picked, "doc_id")


def sample_share_of(rows: DataFrame, wanted: int):
    """A predicate on ids that keeps about ``wanted`` of ``rows``."""
    from tideline.llm.common import hash_share, sample_share

    rate = sample_share(rows.count(), wanted)
    return lambda doc_id: hash_share(doc_id, rate)
