"""Periodic runs of words in whole texts, found by recompression.

A run is a stretch of words with smallest period q (words q apart are identical) of at least two periods that no
neighbouring word extends. Every run of period p covers a grid point i, a multiple of p, together with i + p, so
the candidates of all periods are the pairs (i, i + p) of the harmonic grid, n/1 + n/2 + ... in number. How far the
words from i on equal those from i + p on, and the words before them, is asked of a grammar.

The grammar is built by recompression: blocks of one symbol become one symbol with a count, then the symbols are
divided in two classes by a hash and every neighbouring (left, right) pair becomes one symbol; both steps alternate until each
text is a few symbols. Equal stretches are cut alike but near their ends, so an extension is answered by
climbing the levels while symbols agree, putting at most one symbol (or the rest of a block) on each level aside, and climbing
down again where they differ. Both ways run over all candidates of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from firn.llm.lines import WORD, query, table
from firn.llm.words import mix

LEAST_LENGTH = 12
SLICE_WORDS = 1 << 17
CANDIDATES = 1 << 20
TOP_SYMBOLS = 6
_U = np.uint64


class Level:
    """One row of the grammar, read in one direction.

    ``symbols`` of the row; ``opens``: whether a symbol is the first of its parent; ``parent`` of each symbol;
    ``start`` of each parent in this row, and the end; ``blocks``: whether the parents are blocks or pairs.
    """

    def __init__(self, symbols: np.ndarray, opens: np.ndarray, blocks: bool) -> None:
        self.symbols, self.opens, self.blocks = symbols, opens, blocks
        self.parent = (np.cumsum(opens) - 1).astype(np.int32)
        self.start = np.append(np.flatnonzero(opens), len(symbols)).astype(np.int32)

    def mirrored(self) -> Level:
        closes = np.append(self.opens[1:], True)
        return Level(self.symbols[::-1], closes[::-1], self.blocks)


class Grammar:
    """Run-length grammar of a row of word numbers. Numbers below ``marks`` stand once each, between texts, and are never joined."""

    def __init__(self, symbols: np.ndarray, marks: int) -> None:
        self.levels: list[Level] = []
        unused, step = int(symbols.max(initial=0)) + 1, 0
        symbols = symbols.astype(np.int64)
        while True:
            symbols, unused = self._blocks(symbols, unused)
            symbols, unused = self._pairs(symbols, unused, marks, step)
            step += 1
            edges = np.flatnonzero(symbols < marks)
            longest = np.diff(edges).max(initial=1) if len(edges) > 1 else len(symbols)
            if longest <= TOP_SYMBOLS:
                break
        self.top = symbols

    def _blocks(self, symbols: np.ndarray, unused: int) -> tuple[np.ndarray, int]:
        opens = np.append(True, symbols[1:] != symbols[:-1]) if len(symbols) else np.zeros(0, bool)
        level = Level(symbols, opens, True)
        self.levels.append(level)
        length = np.diff(level.start)
        parents = symbols[level.start[:-1]].copy()
        return self._named(parents, np.flatnonzero(length > 1), parents, length.astype(np.int64), unused)

    def _pairs(self, symbols: np.ndarray, unused: int, marks: int, step: int) -> tuple[np.ndarray, int]:
        side = (mix((symbols.astype(np.uint64) + _U(1)) * _U(2 * step + 1)) >> _U(40)) & _U(1)
        side = np.where(symbols < marks, -1, side.astype(np.int64))
        here, there = side[:-1], side[1:]
        if np.count_nonzero((here == 0) & (there == 1)) < np.count_nonzero((here == 1) & (there == 0)):
            here, there = there, here
            joined = (side[:-1] == 1) & (side[1:] == 0)
        else:
            joined = (here == 0) & (there == 1)
        opens = np.append(True, ~joined) if len(symbols) else np.zeros(0, bool)
        level = Level(symbols, opens, False)
        self.levels.append(level)
        first = level.start[:-1]
        at = np.flatnonzero(np.diff(level.start) > 1)
        second = symbols[np.minimum(first + 1, max(len(symbols) - 1, 0))]
        return self._named(symbols[first].copy(), at, symbols[first], second, unused)

    @staticmethod
    def _named(parents: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, unused: int) -> tuple[np.ndarray, int]:
        """Give the parents at ``at`` one new number for each different (left, right)."""
        if len(at):
            kinds, which = np.unique(left[at] * np.int64(unused + len(left) + 1) + right[at], return_inverse=True)
            parents[at] = unused + which
            unused += len(kinds)
        return parents, unused


class Reader:
    """Longest common extensions to the right of many pairs of positions of a row, or of its mirror image."""

    def __init__(self, levels: list[Level], top: np.ndarray) -> None:
        self.levels, self.top = levels, top

    @classmethod
    def both(cls, grammar: Grammar) -> tuple[Reader, Reader]:
        return cls(grammar.levels, grammar.top), cls([level.mirrored() for level in grammar.levels], grammar.top[::-1])

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different positions, how many symbols from them on agree. The row must end in a mark."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        reached = np.full(len(a), len(self.levels), np.int32)
        going = np.arange(len(a))
        for height, level in enumerate(self.levels):
            x, y = a[going], b[going]
            same = level.symbols[x] == level.symbols[y]
            reached[going[~same]] = height
            going, x, y = going[same], x[same], y[same]
            inside = np.flatnonzero(~(level.opens[x] & level.opens[y]))
            if len(inside):
                u, v = x[inside], y[inside]
                if level.blocks:
                    left = level.start[level.parent[u] + 1] - u
                    right = level.start[level.parent[v] + 1] - v
                    taken = np.minimum(left, right)
                    apart = left != right
                    x[inside] += taken
                    y[inside] += taken
                    uneven = np.zeros(len(going), bool)
                    uneven[inside[apart]] = True
                    out = going[uneven]
                    a[out], b[out] = x[uneven], y[uneven]
                    reached[out] = height
                    going, x, y = going[~uneven], x[~uneven], y[~uneven]
                else:
                    x[inside] += 1
                    y[inside] += 1
            # A sync step may have come to the end mark of a text, which has a parent of its own.
            a[going], b[going] = level.parent[x], level.parent[y]
        while len(going):
            same = self.top[a[going]] == self.top[b[going]]
            going = going[same]
            a[going] += 1
            b[going] += 1
        for height in range(len(self.levels) - 1, -1, -1):
            level, at = self.levels[height], np.flatnonzero(reached > height)
            p, q = a[at], b[at]
            x, y = level.start[p].astype(np.int64), level.start[q].astype(np.int64)
            same = level.symbols[x] == level.symbols[y]
            if level.blocks:
                taken = np.minimum(level.start[p + 1] - x, level.start[q + 1] - y)
                a[at], b[at] = x + same * taken, y + same * taken
            else:
                a[at], b[at] = x + same, y + same
        return a - i


def _grid(lengths: np.ndarray, bases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (i, period) of texts of these lengths from these positions on, about ``CANDIDATES`` at a time."""
    halves = lengths // 2
    owner = np.repeat(np.arange(len(lengths)), halves)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    count = (lengths[owner] - 1) // period
    ends = np.cumsum(count)
    first = 0
    while first < len(owner):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
        c = count[first:last]
        p = np.repeat(period[first:last], c)
        step = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(bases[owner[first:last]], c) + step * p, p
        first = last


def runs_of(texts: list[np.ndarray], least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs of at least ``least`` words of texts of word numbers, by text, start and period.

    ``least`` must be at least 4.
    """
    marks = len(texts) + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    bases = np.cumsum(np.append(0, lengths[:-1] + 1)) + 1
    row = np.concatenate([np.append(m, t + marks) for m, t in enumerate(texts)] + [[marks - 1]]).astype(np.int64)
    found = []
    readers = None
    for i, p in _grid(lengths, bases):
        # A run around i and i + p spans at least 4 words beyond one period or is longer, so a neighbour agrees too.
        j = i + p
        hit = row[i] == row[j]
        i, j, p = i[hit], j[hit], p[hit]
        hit = (row[i + 1] == row[j + 1]) | (row[i - 1] == row[j - 1])
        i, j, p = i[hit], j[hit], p[hit]
        if not len(i):
            continue
        if readers is None:
            readers = Reader.both(Grammar(row, marks))
        on = readers[0].extend(i, j)
        back = readers[1].extend(len(row) - i, len(row) - j)
        long = p + on + back >= np.maximum(least, 2 * p)
        found.append(np.stack((i - back, j + on, p))[:, long])
    if not found:
        return (np.empty(0, np.int64),) * 4
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # Multiples of a period extend to the same ends; the smallest period names the run.
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    start, end, period = start[new], end[new], period[new]
    owner = np.searchsorted(bases, start, "right") - 1
    order = np.lexsort((period, start))
    owner, start, end, period = owner[order], start[order], end[order], period[order]
    return owner, start - bases[owner], end - bases[owner], period


def _judge(texts: list[list[bytes]], least: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Runs (start, length, period) and kept words of each text of a slice."""
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(texts)), np.int64)
    cuts = np.cumsum([len(t) for t in texts])[:-1]
    owner, start, end, period = runs_of(np.split(flat, cuts), least)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    for t, words in enumerate(texts):
        here = slice(at[t], at[t + 1])
        if here.start == here.stop:
            yield [], words
            continue
        s, e, q = start[here], end[here], period[here]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, s + q, 1)
        np.add.at(change, e, -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        yield list(zip(s.tolist(), (e - s).tolist(), q.tolist())), [words[k] for k in kept.tolist()]


def _slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, in slices of about ``SLICE_WORDS`` words (or one longer text)."""
    part: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = text.split() if text else []
        if part and size + len(words) > SLICE_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


_RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` of every row.

    ``runs`` holds start (word number), length and smallest period of every run of at least ``least`` words and two
    periods, by start, then period. ``collapsed`` is the text without the words that any run
    contains after its first period, joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and null ids are rows of their own; an empty
    table gives an empty result. Columns other than ``doc_id`` and ``text`` are not read. No shuffle: one
    pass over the texts, in slices of about ``SLICE_WORDS`` words or one longer text; a text of n words takes n log n work.
    """
    if least < LEAST_LENGTH // 3:
        raise ValueError("runs shorter than 4 words are not searched")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            done = 0
            for part in _slices(texts):
                runs, collapsed = [], []
                for found, kept in _judge(part, least):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    collapsed.append(b" ".join(kept))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(done, len(part)), pa.array([len(w) for w in part], pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                done += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(search, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text of one id in ten, made periodic from a seeded word on; other texts (and those of null ids) as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def turned(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.element_at(words, (a + (i - a) % p + 1).cast("int")))), " ")

    # A one-element array binds the word list once.
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    chosen = (h % 10 == 0) & text.rlike(WORD)
    return F.when(chosen, F.element_at(F.transform(words, turned), 1)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """One line per document: number of runs, the longest run, and digests of all runs and of the collapsed text."""
    longest = F.element_at(
        F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), 1
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.select("*", F.when(F.size("runs") > 0, longest).alias("_best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_periodic_runs")
def op13_periodic_runs(spark, folder):
    """Runs of every document; one id in ten has its text looped first. No row stays out."""
    docs = table(spark, folder, "documents")
    return digest(periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))))
