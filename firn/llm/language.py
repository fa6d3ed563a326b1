"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from firn.llm.lines import query, remainder, table

LONGEST = 3
PROFILE = 400
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_BITS = 21
_CHUNK = 1 << 20
_HELD_KEYS = 1 << 22


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(word: str, longest: int = LONGEST) -> list[str]:
    """All runs of 1 to ``longest`` characters of a word that is padded by one blank at either end."""
    padded = f" {word} "
    return list(word) + [padded[i : i + n] for n in range(2, longest + 1) for i in range(len(padded) - n + 1)]


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, runs of other characters as one blank, a blank at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    line = np.where(letter, points, 32)[kept].astype(np.uint64)
    return np.concatenate(([32], line, [] if line[-1] == 32 else [32])).astype(np.uint64)


def _gram_keys(text: str, longest: int) -> Iterator[np.ndarray]:
    """All n-grams of a text's words as numbers (21 bits a character), by chunks of a million characters.

    Words are parted by one blank, so only n-grams with a blank inside reach over two words; they are left out.
    """
    codes, shift = _codes(text), np.uint64(_BITS)
    for start in range(0, len(codes), _CHUNK):
        here = codes[start : start + _CHUNK + longest - 1]
        own = min(_CHUNK, len(codes) - start)
        key, single = here[:own], here[:own] != 32
        found = [key[single]]
        for n in range(2, longest + 1):
            size = min(own, len(here) - n + 1)
            if size <= 0:
                break
            key = (key[:size] << shift) | here[n - 1 : n - 1 + size]
            if n > 2:
                inside = np.logical_and.reduce([here[i : i + size] != 32 for i in range(1, n - 1)])
                found.append(key[inside])
            else:
                found.append(key)
        yield np.concatenate(found)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_counts(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of a text, ascending, and how often each occurs."""
    parts = [np.unique(keys, return_counts=True) for keys in _gram_keys(text, longest)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else _merged(parts)


def _name(key: int) -> str:
    out = ""
    while key:
        out = chr(key & ((1 << _BITS) - 1)) + out
        key >>= _BITS
    return out


def _key(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << _BITS | ord(c)
    return out


def profiles(samples: DataFrame, size: int = PROFILE, longest: int = LONGEST) -> DataFrame:
    """The ``size`` most frequent n-grams of each language: ``lang``, ``gram``, ``rank`` (from 0).

    ``samples`` has ``text`` and ``lang``; rows where either is null are left out. Every text
    counts whole. Each task adds up n-grams per language, and hands on its counts when they are many,
    so nothing is shuffled but partial counts. Equal counts rank by n-gram.
    """
    _check(longest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        raw: dict[str, list[np.ndarray]] = {}

        def settle() -> None:
            for lang, keys in raw.items():
                counts.setdefault(lang, []).append(np.unique(np.concatenate(keys), return_counts=True))
                counts[lang] = [_merged(counts[lang])]
            raw.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, ((keys, n),) in counts.items():
                names = pa.array([_name(k) for k in keys.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), names, pa.array(n)], ["lang", "gram", "n"])
            counts.clear()

        held = 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                for keys in _gram_keys(text.as_py(), longest):
                    raw.setdefault(lang.as_py(), []).append(keys)
                    held += len(keys)
                if held > _HELD_KEYS:
                    settle()
                    held = 0
                    if sum(len(c[0][0]) for c in counts.values()) > _HELD_KEYS:
                        yield from flush()
        settle()
        yield from flush()

    known = samples.select("text", F.col("lang").cast("string").alias("lang")).dropna()
    counts = known.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def _check(longest: int) -> None:
    if not 1 <= longest <= 3:
        raise ValueError("n-grams have 1 to 3 characters")


class _Judge:
    """Out-of-place distances of texts to all profiles. Counts alone decide, so ties need no order:
    an n-gram's rank is the number of n-grams with a higher count, and all of rank < size take part."""

    def __init__(self, rows: list[tuple[str, str, int]], size: int, longest: int) -> None:
        self.size, self.longest = size, longest
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({_key(r[1]) for r in rows}), np.uint64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[at[lang], np.searchsorted(self.keys, np.uint64(_key(gram)))] = rank

    def distances(self, text: str | None) -> np.ndarray | None:
        """Mean out-of-place distance to each language, from 0 to 1; None without a letter."""
        keys, counts = gram_counts(text or "", self.longest)
        if not len(keys):
            return None
        falling = np.sort(-counts)
        rank = np.searchsorted(falling, -counts)
        top = rank < self.size
        keys, rank = keys[top], rank[top]
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        there = self.ranks[:, np.where(known, at, len(self.keys))]
        gap = np.where(there < 0, self.size, np.minimum(np.abs(there - rank), self.size))
        return gap.mean(axis=1) / self.size


def identify(docs: DataFrame, learned: DataFrame, size: int = PROFILE, longest: int = LONGEST) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``distance`` added (columns of these names are replaced).

    The language is that of the nearest profile; equal distances go to the smaller name. The
    score is d2 / (d1 + d2) for the two nearest distances, 0.5 when both fit alike and 1 for a
    perfect fit; with one language learned it is 1 - d1. A text that is null or has no letter
    (an empty one too), or any text when nothing was learned, is ``und`` with score 0 and null
    distance. Other columns pass through; repeated rows are judged each.

    The profiles go to the driver and to all tasks: at most 1000 languages of ``size`` rows.
    """
    rows = [tuple(r) for r in learned.select("lang", "gram", "rank").limit(MAX_LANGUAGES * size + 1).collect()]
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "distance")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("distance", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _Judge(rows, size, longest)
        for batch in batches:
            lang, score, distance = [], [], []
            for text in batch.column("text"):
                gaps = by.distances(text.as_py()) if by.langs else None
                if gaps is None:
                    lang.append(UNKNOWN), score.append(0.0), distance.append(None)
                    continue
                best = int(np.argmin(gaps))
                second = float(np.partition(gaps, 1)[1]) if len(gaps) > 1 else None
                first = float(gaps[best])
                lang.append(by.langs[best])
                distance.append(first)
                score.append(1 - first if second is None else second / (first + second) if second else 0.5)
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=None, names=[*kept, "lang_pred", "score", "distance"])

    return docs.select(*kept).mapInArrow(judge, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Three quarters of the rows teach: those whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.filter(remainder("doc_id", 4) != 2)


@query("op1_language_id")
def op1_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    judged = identify(docs.select("doc_id", "text"), profiles(training_rows(docs)))
    return judged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "distance")
