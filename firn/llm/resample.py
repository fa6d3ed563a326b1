"""Importance resampling of documents towards a target text by hashed word n-grams.

A feature is a run of 1 to ``max_n`` consecutive words, joined by one space; its bucket is the CRC-32 of its
UTF-8 bytes modulo the number of buckets. Words come in a head and a tail. The head, words and pairs of
words with at least 1 / ``HEAD`` of all occurrences, is broadcast: the CRC state of each frequent word
(from which a longer feature goes on) and that of each frequent pair. A tail feature takes its CRC
from its bytes. Head and tail give the same values, so bucket totals are exact whatever the head holds.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firn.llm.lines import query, table
from firn.operators.ordered import place
from firn.session import materialize

HEAD = 16_384
HEAD_BYTES = 64
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text to bytes of its words: letters lowered, every other ASCII byte a space.
_TO_WORDS = bytes(b if b >= 0x80 else (bytes([b]).lower()[0] if bytes([b]).lower() in _KEPT else 0x20) for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none of a null text."""
    return text.translate(_TO_WORDS).split() if text else []


class Words(dict):
    """CRC-32 of words: looked up for head words, computed (and not kept) for others."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Pairs(dict):
    """CRC-32 of pairs of words: looked up for head pairs, else carried on from the first word's state."""

    def __init__(self, words: Words, known: Iterable = ()) -> None:
        super().__init__(known)
        self.words = words

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(b" " + pair[1], self.words[pair[0]])


class Vocabulary:
    """CRC states of the head; ``states`` gives the CRC-32 of every feature of a text."""

    def __init__(self, words: Iterable[bytes] = (), pairs: Iterable[bytes] = ()) -> None:
        self.words = Words((w, crc32(w)) for w in words)
        self.pairs = Pairs(self.words, ((tuple(p.split(b" ")), crc32(p)) for p in pairs))

    def states(self, words: list[bytes], max_n: int) -> np.ndarray:
        found = [np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))]
        if max_n > 1 and len(words) > 1:
            state = list(map(self.pairs.__getitem__, zip(words, words[1:])))
            found.append(np.array(state, np.uint32))
            for n in range(3, min(max_n, len(words)) + 1):
                state = [crc32(b" " + w, s) for s, w in zip(state, words[n - 1 :])]
                found.append(np.array(state, np.uint32))
        return np.concatenate(found)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def head(docs: DataFrame, max_n: int, most: int = HEAD) -> Vocabulary:
    """Words and pairs with at least 1 / ``most`` of all occurrences, at most ``most`` of each.

    Such a feature has this share in at least one Arrow batch, so each batch sends on only its own
    frequent features (at most ``most``), whose sums are filtered by the share of all. Features of more than
    ``HEAD_BYTES`` bytes stay in the tail. The head decides speed only, no result.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[Counter] = [Counter() for _ in range(min(max_n, 2))]
            for text in _texts(batch):
                words = words_of(text)
                counts[0].update(words)
                if max_n > 1:
                    counts[1].update(map(b" ".join, zip(words, words[1:])))
            for n, count in enumerate(counts, 1):
                total = count.total()
                kept = [(f, c) for f, c in count.items() if c * most >= total and len(f) <= HEAD_BYTES]
                kept.append((None, total))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(kept), pa.int32()), pa.array([f for f, _ in kept], pa.binary()), pa.array([c for _, c in kept], pa.int64())],
                    ["n", "feature", "times"],
                )

    sums = docs.select("text").mapInArrow(frequent, "n int, feature binary, times long").groupBy("n", "feature").agg(F.sum("times").alias("times"))
    sums = materialize(sums, "head")
    totals = {r["n"]: r["times"] for r in sums.filter(F.col("feature").isNull()).collect()}
    known: dict[int, list[bytes]] = {1: [], 2: []}
    for n, total in totals.items():
        rows = sums.filter((F.col("n") == n) & F.col("feature").isNotNull() & (F.col("times") * F.lit(most) >= F.lit(total)))
        known[n] = [bytes(r["feature"]) for r in rows.select("feature").collect()]
    return Vocabulary(known[1], known[2])


def bucket_totals(texts: DataFrame, vocabulary: Vocabulary, max_n: int, buckets: int) -> np.ndarray:
    """Occurrences of features in each bucket over all rows: one partial count per task, ``buckets`` rows in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                words = words_of(text)
                if words:
                    np.add.at(totals, vocabulary.states(words, max_n) % np.uint32(buckets), 1)
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(totals[seen])], ["bucket", "times"])

    rows = texts.select("text").mapInArrow(count, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).collect()
    totals = np.zeros(buckets, np.int64)
    for bucket, times in rows:
        totals[bucket] = times
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket, in double precision."""
    size = float(len(source))
    all_source, all_target = float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_source + size) / ((source + 1.0) * (all_target + size))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, vocabulary: Vocabulary, gain: np.ndarray, max_n: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (sum of gains of all features) of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.uint32(len(gain))
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in _texts(batch):
                words = words_of(text)
                states = vocabulary.states(words, max_n)
                n_words.append(len(words))
                n_features.append(len(states))
                weight.append(int(gain[states % size].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    ``score`` is the weight plus seeded Gumbel noise of the doc_id, so the highest scores are a draw without replacement with
    chances by importance. Of the rows with at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) are drawn: ``rank`` counts them from 1 by score, ties by smaller doc_id; it is null for all others.

    A null or empty text has no features and weight 0. A null doc_id takes the noise of the empty id and stands after
    other ids at equal scores. Repeated rows are rows of their own. An empty table gives an empty result;
    an empty target is smoothed like any other. Only columns ``doc_id`` and ``text`` are read.

    Three scans of the text; only counts are shuffled, then one narrow row per document by ranges of the score.
    """
    vocabulary = head(docs, max_n)
    gain = gains(bucket_totals(docs, vocabulary, max_n, buckets), bucket_totals(target, vocabulary, max_n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = weights(docs, vocabulary, gain, max_n).withColumn("score", (F.col("weight") + noise).cast("long"))
    rows = materialize(rows, "weights")
    fit = F.col("n_words") >= least_words
    drawn = rows.filter(fit).count() * percent // 100
    # Rows equal in every column may change places; the row number keeps them from one task.
    ranked = place(
        rows.select("*", F.monotonically_increasing_id().alias("_row")),
        [~fit, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "_row"],
    )
    rank = F.when(fit & (F.col("_g") < drawn), F.col("_g") + 1).cast("long")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


# CRC-32 (reflected polynomial 0xEDB88320) of each distinct word, byte by byte from a table built by its rule.
_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), doc_counts AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM doc_words) GROUP BY r, w),
target_counts AS (SELECT w, count(*) AS c FROM target_words GROUP BY w),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM doc_counts UNION ALL SELECT w FROM target_counts)),
bytes AS (SELECT w, hex(encode(w)) AS x FROM vocabulary),
digest AS (
  SELECT w, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INTEGER + 1, 2))::BIGINT)),
    lambda a, b: xor(a // 256, t[1 + (xor(a, b) & 255)]))) % 10000 AS bucket
  FROM bytes, crc
), s AS (SELECT bucket, sum(c) AS s FROM doc_counts JOIN digest USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM target_counts JOIN digest USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), sums
), weighed AS (
  SELECT r, sum(c * g) AS weight FROM doc_counts JOIN digest USING (w) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM doc_words LEFT JOIN weighed USING (r)
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k,
    sum(CASE WHEN n_features >= 20 THEN 1 ELSE 0 END) OVER () * 10 // 100 AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= n THEN k END AS rank FROM drawn
"""


@query("op11_resampling", _SQL)
def op11_resampling(spark, folder):
    """Documents drawn towards the benchmark texts by hashed words; every document stays, ``rank`` marks the drawn."""
    drawn = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
