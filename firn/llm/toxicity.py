"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine over whole texts.

Examples are a bounded sample of labelled rows. The index holds every word of the distinct example
vectors; inverse document frequencies are counted over all documents. Words whose presence tells about the
label weigh more, no word is left out. The index skips blocks of examples whose largest weights cannot reach the
k-th cosine; examples that can be among the k nearest are scored again in double precision, so the k nearest are exact.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firn.llm.lines import query, remainder, table
from firn.session import discard, materialize

MAX_EXAMPLES = 40_000
LEAST_PHI2 = 0.004
TELLING = 8.0
NEIGHBOURS = 15
BLOCK = 32
BINS = 64
STEM = 5
_WORD = re.compile(r"[^\W_]+")
_CHUNK = 512
_LANES = 16
_ROWS = 65_536
_CACHE = 20_000
_QUERIES = 64
_SLACK = 1e-5
_GROUPS = 8
_OFTEN = 16
_GATHER = 4
_LOOKS = 8
_SHORT = 256


def examples(labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """(``doc_id``, ``toxic``) of at most ``most`` labelled rows, by smallest hash of the id.

    A doc_id that is labelled more than once counts as toxic if at least half of its labels say so. Rows
    with a null id or label teach nothing.
    """
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("t")).dropna().groupBy("doc_id").agg(F.avg("t").alias("t"))
    return known.select("doc_id", (F.col("t") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _words(text: str | None) -> list[str]:
    """Terms of a text: its words, and for longer words their first letters, which inflected forms share."""
    words = _WORD.findall((text or "").lower())
    return words + [w[:STEM] + "*" for w in words if len(w) > STEM]


def _packed(numbers: np.ndarray) -> bytes:
    """Counts as bytes where all are below 256, else as 32-bit numbers."""
    return numbers.astype(np.uint8 if not len(numbers) or numbers.max() < 256 else np.int32).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == size else np.int32)


def _steps(at: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, first all low bytes, last all high ones, which compresses well."""
    return np.diff(at, prepend=np.int32(0)).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _ascending(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).ravel(), dtype=np.int32)


def example_vectors(texts: DataFrame) -> tuple[list[str], np.ndarray, list[tuple]]:
    """Words, their factors and the distinct vectors of the (``doc_id``, ``text``, ``toxic``) rows.

    Words are sorted by how many rows hold them. A word's factor is 1, and up to 1 + TELLING for words whose presence depends on
    the label (phi squared of at least LEAST_PHI2 over different vectors, so that copies don't make their
    rare words telling). Vectors are (word numbers, counts, toxic votes, votes, smallest doc_id). What reaches the
    driver is the words of at most MAX_EXAMPLES texts, each once for every _CHUNK texts; no text is shuffled."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(first, _CHUNK)
                place: dict[str, int] = {}
                at, times = [], []
                for text in batch.column("text"):
                    held = Counter(_words(text.as_py()))
                    own = np.fromiter((place.setdefault(w, len(place)) for w in held), np.int32, len(held))
                    sort = np.argsort(own)
                    at.append(zlib.compress(_steps(own[sort]), 1))
                    times.append(zlib.compress(_packed(np.fromiter(held.values(), np.int64, len(held))[sort]), 1))
                words = pa.array([zlib.compress("\n".join(place).encode(), 1), *[None] * (batch.num_rows - 1)], pa.binary())
                kept = [batch.column("doc_id"), batch.column("toxic").cast(pa.int32())]
                yield pa.RecordBatch.from_arrays([*kept, words, pa.array(at, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "toxic", "words", "at", "times"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    told = texts.select("doc_id", "text", "toxic").mapInArrow(code, f"doc_id {kind}, toxic int, words binary, at binary, times binary").toArrow()
    number: dict[str, int] = {}
    known = np.empty(0, np.int32)
    read = []
    for batch in told.to_batches():
        # The rows of a chunk follow its words, in the order in which the task made them.
        for doc, toxic, words, at, times in zip(*(batch.column(c) for c in ("doc_id", "toxic", "words", "at", "times")), strict=True):
            if words.is_valid:
                known = np.fromiter((number.setdefault(w, len(number)) for w in zlib.decompress(words.as_py()).decode().split("\n") if w), np.int32)
            own = known[_ascending(zlib.decompress(at.as_py()))]
            read.append((doc.as_py(), toxic.as_py(), own, _unpacked(zlib.decompress(times.as_py()), len(own))))
    del told
    words = sorted(number)
    by_name = np.fromiter((number[w] for w in words), np.int64, len(words))
    del number
    rows = np.zeros(len(words), np.int64)
    for _, _, at, _ in read:
        rows[at] += 1
    order = np.argsort(-rows[by_name], kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[by_name[order]] = np.arange(len(words), dtype=np.int32)
    merged: dict[bytes, list] = {}
    while read:
        doc, toxic, at, times = read.pop()
        at = rank[at]
        sort = np.argsort(at)
        at, times = at[sort], times[sort]
        found = merged.setdefault(_digest(at.tobytes(), times.tobytes()), [at, times, 0, 0, doc])
        found[2] += toxic
        found[3] += 1
        found[4] = min(found[4], doc)
    sizes = np.zeros(2)
    held = np.zeros((2, len(words)))
    for at, _, bad, n, _ in merged.values():
        for toxic in [0] * (bad < n) + [1] * (bad > 0):
            sizes[toxic] += 1
            held[toxic, at] += 1
    (good, bad), (b, a) = sizes, held
    rest = (bad + good - a - b) * bad * good
    phi2 = np.divide((a * good - b * bad) ** 2, (a + b) * rest, out=np.zeros(len(words)), where=(a + b) * rest > 0)
    extra = 1.0 + TELLING * np.where(phi2 >= LEAST_PHI2, np.sqrt(phi2), 0.0)
    return [words[i] for i in order.tolist()], extra, [tuple(v) for v in merged.values()]


def words_of(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Words and factors of ``example_vectors``."""
    return example_vectors(texts)[:2]


def _digest(*parts: bytes) -> bytes:
    whole = hashlib.blake2b(digest_size=16)
    for part in parts:
        whole.update(len(part).to_bytes(8, "little"))
        whole.update(part)
    return whole.digest()


def counted(docs: DataFrame, words: list[str]) -> DataFrame:
    """``docs`` with ``_at`` and ``_times``, which of ``words`` the whole text holds and how often (in the forms of ``_steps``
    and ``_packed``, by word), and ``_other``, the sum of (1 + ln times) squared over its words outside ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    names = [c for c in docs.columns if c != "text"]
    place: dict[str, int] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not place:
            place.update(zip(shared.value, range(len(shared.value)), strict=True))
        for batch in batches:
            at, times, other = [], [], []
            for text in batch.column("text"):
                held = Counter(_words(text.as_py()))
                keys = np.fromiter((place.get(w, -1) for w in held), np.int32, len(held))
                often = np.fromiter(held.values(), np.int32, len(held))
                order = np.argsort(keys)[np.count_nonzero(keys < 0) :]
                at.append(_steps(keys[order]))
                times.append(_packed(often[order]))
                other.append(float(((1.0 + np.log(often[keys < 0])) ** 2).sum()))
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(at, pa.binary()), pa.array(times, pa.binary()), pa.array(other, pa.float64())], [*names, "_at", "_times", "_other"]
            )

    types = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.mapInArrow(count, f"{types}, _at binary, _times binary, _other double")


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many rows hold each of the ``size`` words; tasks send _LANES counts a row."""
    lanes = [f"n{i}" for i in range(_LANES)]
    blocks = -(-size // _LANES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(blocks * _LANES, np.int64)
        for batch in batches:
            for at in batch.column("_at"):
                held[_ascending(at.as_py())] += 1
        held = held.reshape(-1, _LANES)
        found = np.flatnonzero(held.any(axis=1))
        for first in range(0, len(found), _ROWS):
            part = found[first : first + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(np.ascontiguousarray(held[part, i])) for i in range(_LANES))], ["b", *lanes])

    counts = vectors.select("_at").mapInArrow(count, "b long, " + ", ".join(f"{n} long" for n in lanes)).groupBy("b").agg(*[F.sum(n).alias(n) for n in lanes]).toArrow()
    out = np.zeros((blocks, _LANES))
    for i, lane in enumerate(lanes):
        out[np.asarray(counts.column("b")), i] = np.asarray(counts.column(lane))
    return out.ravel()[:size]


class BlockMaxIndex:
    """Distinct example vectors under a block-max inverted index, and one by one for exact cosines.

    ``vectors`` are (word numbers, occurrence counts, toxic votes, votes, smallest doc_id); ``idf`` has the weight of
    each word and ``unseen`` that of a word outside. Vectors are dealt to a few groups and stand there in blocks of
    ``block``. Words that at least one in _OFTEN of a group holds are frequent there: an entry of each block keeps the largest weight
    of each frequent word, which bounds what they add to any cosine in the block. All other words have posting
    lists, which are added up first. A block is then skipped where lists and bound together cannot reach the k-th
    cosine known so far; in the others a vector is scored where its own frequent part is long enough for that.
    ``met`` and ``skipped`` count the blocks of all searches. Everything is made where it is first used.
    """

    def __init__(self, vectors: list[tuple], idf: np.ndarray, block: int = BLOCK, unseen: float = 0.0) -> None:
        vectors = sorted(vectors, key=lambda v: (v[4] is None, v[4]))
        self.idf, self.block, self.unseen = idf, block, unseen
        self.size = len(vectors)
        self.bad = np.array([v[2] for v in vectors], float)
        self.votes = np.array([v[3] for v in vectors], float)
        self.docs = [v[4] for v in vectors]
        self.bounds = np.concatenate(([0], np.cumsum([len(v[0]) for v in vectors]))).astype(np.int64)
        self.word = np.concatenate([np.asarray(v[0], np.int32) for v in vectors]) if vectors else np.empty(0, np.int32)
        times = np.concatenate([np.asarray(v[1]) for v in vectors]) if vectors else np.empty(0, np.uint8)
        self.times = times.astype(np.uint8 if times.max(initial=0) < 256 else np.int32)
        self.made, self.met, self.skipped = False, 0, 0

    def __getstate__(self) -> dict:
        names = ("idf", "block", "unseen", "size", "bad", "votes", "docs", "bounds", "word", "times")
        return {n: self.__dict__[n] for n in names} | {"made": False, "met": 0, "skipped": 0}

    def _make(self) -> None:
        self.scale = 1.0 + np.log(np.maximum(1, np.arange(int(self.times.max()) + 1)))
        self.lengths = np.empty(self.size)
        weight = np.empty(len(self.word), np.float32)
        for x in range(self.size):
            s, e = self.bounds[x], self.bounds[x + 1]
            raw = self.scale[self.times[s:e]] * self.idf[self.word[s:e]]
            self.lengths[x] = math.sqrt(float(raw @ raw))
            weight[s:e] = raw / self.lengths[x]
        owner = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.bounds))
        group = self._grouped(owner, weight)
        thick = np.zeros(len(self.word), bool)
        words = []
        for g in range(_GROUPS):
            here = np.flatnonzero((group == g)[owner])
            often = np.bincount(self.word[here], minlength=len(self.idf)) * _OFTEN >= max(1, np.count_nonzero(group == g))
            thick[here] = often[self.word[here]]
            words.append(np.flatnonzero(often) if len(here) else np.empty(0, np.int64))
        norm = np.sqrt(np.bincount(owner[thick], weight[thick].astype(float) ** 2, self.size))
        #: vectors by group, those with long frequent parts first, so that a block's members are alike in it
        self.order = np.lexsort((-norm, group))
        place = np.empty(self.size, np.int32)
        place[self.order] = np.arange(self.size, dtype=np.int32)
        self.norm = norm[self.order].astype(np.float32) * (1 + 1e-6)
        edges = np.searchsorted(group[self.order], np.arange(_GROUPS + 1))
        self.groups, starts = [], []
        for g, (first, last) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if first == last:
                continue
            mine = np.flatnonzero(thick & (group == g)[owner])
            dense = np.zeros((last - first, len(words[g])), np.float32)
            dense[place[owner[mine]] - first, np.searchsorted(words[g], self.word[mine])] = weight[mine]
            cuts = np.arange(0, last - first, self.block)
            self.groups.append((first, last, len(starts), words[g], dense, np.maximum.reduceat(dense, cuts, axis=0), cuts))
            starts.extend((cuts + first).tolist())
        self.blocks = np.array(starts)
        rest = self.word[~thick]
        order = np.argsort(rest, kind="stable")
        self.posting, self.weight = place[owner[~thick][order]], weight[~thick][order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(rest, minlength=len(self.idf)))))
        self.made = True

    def _grouped(self, owner: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A group for each vector by its most frequent words, so that a group's frequent words stand in dense columns. Only
        the speed depends on it."""
        common = np.argsort(-np.bincount(self.word, minlength=len(self.idf)), kind="stable")[:256]
        column = np.full(len(self.idf), -1)
        column[common] = np.arange(len(common))
        known = column[self.word] >= 0
        place = np.zeros((self.size, len(common)), np.float32)
        place[owner[known], column[self.word[known]]] = weight[known]
        place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)
        centres = [place[0]]
        while len(centres) < _GROUPS:
            centres.append(place[np.argmin((place @ np.array(centres).T).max(axis=1))])
        for _ in range(5):
            group = (place @ np.array(centres).T).argmax(axis=1)
            centres = [c if not (group == g).any() else (m := place[group == g].mean(axis=0)) / max(1e-9, float(np.linalg.norm(m))) for g, c in enumerate(centres)]
        return group

    def weigh(self, at, times, other: float = 0.0) -> np.ndarray:
        raw = (1.0 + np.log(np.asarray(times, float))) * self.idf[np.asarray(at, np.int64)]
        return raw / math.sqrt(float(raw @ raw) + other * self.unseen**2) if len(raw) else raw

    def nearest(self, at, times, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        return self.nearest_of([(at, times, 0.0)], k)[0]

    def nearest_of(self, queries: list[tuple], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """The k nearest (cosine, vector) of each (word numbers, occurrence counts, other), best first; equal cosines by
        vector number. Vectors without a common word are not near."""
        if not self.size:
            return [[] for _ in queries]
        if not self.made:
            self._make()
        asked = [(np.asarray(at, np.int64), self.weigh(at, times, other)) for at, times, other in queries]
        rare = np.zeros((len(asked), self.size), np.float32)
        for (at, weight), score in zip(asked, rare, strict=True):
            self._add_lists(at, weight, score)
        # What a vector, and what any vector of a block, can reach at most.
        most, bound, left = rare.copy(), np.empty((len(asked), len(self.blocks)), np.float32), []
        for first, last, block, words, _, top, cuts in self.groups:
            own = np.zeros((len(asked), len(words)), np.float32)
            if len(words):
                for i, (at, weight) in enumerate(asked):
                    seat = np.minimum(np.searchsorted(words, at), len(words) - 1)
                    here = words[seat] == at
                    own[i, seat[here]] = weight[here]
            left.append(own)
            most[:, first:last] += np.linalg.norm(own, axis=1)[:, None] * self.norm[first:last]
            bound[:, block : block + len(cuts)] = own @ top.T + np.maximum.reduceat(rare[:, first:last], cuts, axis=1)
        np.minimum(bound, np.maximum.reduceat(most, self.blocks, axis=1), out=bound)
        score = np.full((len(asked), self.size), -1.0, np.float32)
        least = self._first_looks(rare, bound, left, score, k)
        for (first, last, block, _, dense, _, cuts), own in zip(self.groups, left, strict=True):
            reach = bound[:, block : block + len(cuts)] >= least[:, None]
            self.met += reach.size
            self.skipped += int(reach.size - np.count_nonzero(reach))
            rows = np.flatnonzero(reach.any(axis=1))
            sizes = np.diff(cuts, append=last - first)
            need = (most[rows, first:last] >= least[rows, None]) & np.repeat(reach[rows], sizes, axis=1)
            many = np.count_nonzero(need, axis=1) * _GATHER >= last - first
            if many.any():
                score[rows[many], first:last] = rare[rows[many], first:last] + own[rows[many]] @ dense.T
            for i, needed in zip(rows[~many].tolist(), need[~many], strict=True):
                at = np.flatnonzero(needed)
                score[i, first + at] = rare[i, first + at] + dense[at] @ own[i]
        full = np.zeros(len(self.idf))
        out = []
        for (at, weight), own, floor in zip(asked, score, least.tolist(), strict=True):
            near = np.flatnonzero((own >= floor) & (own > 0))
            if len(near) > k:
                near = near[own[near] >= np.partition(own[near], len(near) - k)[len(near) - k] - _SLACK]
            found = []
            if len(near):
                near = self.order[near]
                s, n = self.bounds[near], self.bounds[near + 1] - self.bounds[near]
                ends = np.cumsum(n)
                each = np.repeat(s - ends + n, n) + np.arange(ends[-1])
                full[at] = weight
                common = full[self.word[each]] > 0
                each, seat = each[common], np.repeat(np.arange(len(near)), n)[common]
                word = self.word[each]
                cosines = np.bincount(seat, self.scale[self.times[each]] * self.idf[word] * full[word], len(near)) / self.lengths[near]
                full[at] = 0.0
                found = [(round(c, 12), x) for c, x in zip(cosines.tolist(), near.tolist(), strict=True)]
            out.append(sorted(found, key=lambda p: (-p[0], p[1]))[:k])
        return out

    def _add_lists(self, at: np.ndarray, weight: np.ndarray, score: np.ndarray) -> None:
        """Adds the posting lists of the query's words that are rare in a group."""
        starts = self.starts[at]
        many = self.starts[at + 1] - starts
        for s, n, q in zip(starts[many >= _SHORT].tolist(), many[many >= _SHORT].tolist(), weight[many >= _SHORT].astype(np.float32), strict=True):
            score[self.posting[s : s + n]] += self.weight[s : s + n] * q
        few = np.flatnonzero((many > 0) & (many < _SHORT))
        if len(few):
            n = many[few]
            each = np.repeat(starts[few] - np.cumsum(n) + n, n) + np.arange(n.sum())
            score += np.bincount(self.posting[each], self.weight[each] * np.repeat(weight[few], n), self.size)

    def _first_looks(self, rare: np.ndarray, bound: np.ndarray, left: list, score: np.ndarray, k: int) -> np.ndarray:
        """Scores the blocks with the highest bounds of each query; the k-th cosine there, less the slack."""
        looks = min(len(self.blocks), max(_LOOKS, -(-2 * k // self.block)))
        best = np.argpartition(-bound, looks - 1, axis=1)[:, :looks]
        group = np.searchsorted([g[2] for g in self.groups], np.arange(len(self.blocks)), side="right") - 1
        least = np.zeros(len(score), np.float32)
        for i, blocks in enumerate(best.tolist()):
            seen = []
            for b in blocks:
                first, last, _, _, dense, _, _ = self.groups[group[b]]
                s = int(self.blocks[b])
                e = min(s + self.block, last)
                score[i, s:e] = rare[i, s:e] + dense[s - first : e - first] @ left[group[b]][i]
                seen.append(score[i, s:e])
            seen = np.concatenate(seen)
            if len(seen) > k:
                least[i] = max(0.0, float(np.partition(seen, len(seen) - k)[len(seen) - k]) - _SLACK)
        return least

    def vote(self, found: list[tuple[float, int]], prior: float, but: tuple[int, int] | None = None) -> float:
        """Toxic share of the neighbours' votes, each weighted by 1 / (distance + 0.05), with one vote of
        weight 1 for the prior. ``but`` (vector, toxic) takes one vote back: an example does not vote on itself."""
        total, bad = 1.0, prior
        for cosine, x in found:
            weight = 1.0 / (1.0 - cosine + 0.05)
            mine = but is not None and but[0] == x
            total += weight * math.log1p(max(0.0, self.votes[x] - mine))
            share = (self.bad[x] - (but[1] if mine else 0)) / max(1.0, self.votes[x] - mine)
            bad += weight * math.log1p(max(0.0, self.votes[x] - mine)) * share
        return bad / total


def _calibration(bins: list[tuple[int, int, int]], prior: float) -> np.ndarray:
    """Chance of label 1 per bin of raw votes: pooled adjacent violators over (bin, labels, toxic), each
    pool with two examples of the prior added; empty bins take the bin below."""
    pools: list[list[float]] = []
    for b, n, bad in sorted(bins):
        pools.append([b, n, bad])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            _, n2, bad2 = pools.pop()
            pools[-1][1] += n2
            pools[-1][2] += bad2
    out = np.full(BINS, prior)
    for b, n, bad in pools:
        out[int(b) :] = (bad + 2 * prior) / (n + 2)
    return out


def score_toxicity(docs: DataFrame, labelled: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with ``score``, ``predicted`` and ``evidence`` of every row.

    ``labelled`` is the bounded sample of ``examples`` (``doc_id``, ``toxic``); its ids, its words and its index are
    broadcast (at most MAX_EXAMPLES whole texts). The raw vote of the k nearest examples is calibrated on the
    examples themselves, each scored without its own vote. Evidence lists the nearest examples (doc_id,
    cosine, share of toxic labels among the examples of that vector). Every text with words is searched; its words
    that no example holds count in its length, each as a word of one document. A text without words, as a null
    or empty one, gets the share of toxic labels among examples like it and no evidence. With no examples every
    score is 0. Repeated rows are scored each; other columns are not read.
    """
    sample = materialize(labelled.select("doc_id", "toxic"), "labelled")
    read = docs.select("doc_id", "text")
    # The sample has at most MAX_EXAMPLES rows by contract.
    words, extra, rows = example_vectors(read.join(F.broadcast(sample), "doc_id"))
    vectors = materialize(counted(read.join(F.broadcast(sample), "doc_id", "left"), words), "vectors")
    total = vectors.count()
    idf = (np.log((1 + total) / (1 + document_counts(vectors, len(words)))) + 1e-3) * extra
    all_bad, all_n = (sum(r[c] for r in rows) for c in (2, 3))
    prior = all_bad / all_n if all_n else 0.0
    bare = [(bad, n) for at, _, bad, n, _ in rows if not len(at)]
    plain = (bare[0][0] + prior) / (bare[0][1] + 1) if bare else prior
    index = BlockMaxIndex([r for r in rows if len(r[0])], idf, unseen=math.log((1 + total) / 2) + 1e-3 if total else 0.0)
    del words, rows
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache: dict[bytes, tuple] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, _QUERIES):
                batch = whole.slice(first, _QUERIES)
                coded = list(zip(*(batch.column(c).to_pylist() for c in ("_at", "_times", "_other")), strict=True))
                keys = [_digest(at, times, struct.pack("d", other)) for at, times, other in coded]
                if len(cache) > _CACHE:
                    cache.clear()
                new = {key: c for key, c in zip(keys, coded, strict=True) if key not in cache}
                asked = [(at := _ascending(a), _unpacked(times, len(at)), other) for a, times, other in new.values()]
                for key, found in zip(new, own.nearest_of(asked, k), strict=True):
                    told = [{"doc_id": own.docs[x], "cosine": min(c, 1.0), "toxic_share": own.bad[x] / own.votes[x]} for c, x in found[:5]]
                    mine = next((x for c, x in found if c > 1 - 1e-9), None)
                    votes = [own.vote(found, prior, but) for but in (None, *(((mine, t) if mine is not None else None) for t in (0, 1)))]
                    cache[key] = [min(BINS - 1, int(BINS * v)) for v in votes], told
                toxic = batch.column("toxic").to_pylist()
                bins = [cache[key][0][0] if at or other else None for key, (at, _, other) in zip(keys, coded, strict=True)]
                without = [cache[key][0][1 + t] if t is not None and at else None for key, (at, _, _), t in zip(keys, coded, toxic, strict=True)]
                arrow = pa.list_(pa.struct([("doc_id", batch.column("doc_id").type), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(toxic, pa.int32()), pa.array(bins, pa.int32()), pa.array(without, pa.int32()), pa.array([cache[key][1] for key in keys], arrow)],
                    ["doc_id", "toxic", "bin", "without", "evidence"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    evidence = f"evidence array<struct<doc_id:{kind},cosine:double,toxic_share:double>>"
    searched = materialize(vectors.mapInArrow(search, f"doc_id {kind}, toxic int, bin int, without int, {evidence}"), "searched")
    bins = searched.filter("without is not null").groupBy("without").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    discard(vectors)
    table_of = _calibration([tuple(r) for r in bins.collect()], prior)
    chance = F.element_at(F.array(*[F.lit(float(v)) for v in table_of]), F.col("bin") + 1)
    judged = searched.select("doc_id", F.coalesce(chance, F.lit(plain)).alias("score"), "evidence")
    return judged.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op6_toxicity")
def op6_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    taught = examples(labels.filter(remainder("doc_id", 5) != 0))
    judged = score_toxicity(docs, taught)
    return judged.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")
