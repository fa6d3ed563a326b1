"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from firn.llm.lines import query, table
from firn.llm.words import hashed_words, mix, shingles
from firn.session import materialize, shuffle_width

BITS = 128
SHINGLE = 5
RADIUS = 3
BLOCKS = 5
_SIGNS = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) == 1, 1.0, -1.0)


def fingerprint_words(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """High and low 64 bits of each text's fingerprint; 0 for a text without words.

    Terms are word shingles. A term that occurs n times votes with weight 1 + ln n on each of 128
    signed bits of its hash; a bit is set where the votes are above zero. Votes are summed from
    weighted histograms of the 16 hash bytes, so no text-by-bit matrix is built.
    """
    high, low = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for first, hashes, bounds in hashed_words(texts):
        values, at = shingles(hashes, bounds, shingle)
        for i in range(len(at) - 1):
            terms = values[at[i] : at[i + 1]]
            if not len(terms):
                continue
            terms, times = np.unique(terms, return_counts=True)
            weight = 1.0 + np.log(times)
            both = np.stack([mix(terms), mix(terms ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
            digits = both.astype(">u8").view(np.uint8).reshape(len(terms), 16).astype(np.int64)
            cells = (digits + np.arange(16) * 256).ravel()
            held = np.bincount(cells, np.repeat(weight, 16), minlength=4096).reshape(16, 256)
            bits = np.packbits((held @ _SIGNS).ravel() > 1e-9)
            high[first + i], low[first + i] = bits.view(">i8")
    return high, low


def with_fingerprint(df: DataFrame, text: str, high: str, low: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of the string column ``text`` as two long columns."""
    names = [*df.columns, high, low]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = fingerprint_words(batch.column(text), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, pair)], names)

    return df.mapInArrow(add, StructType([*df.schema.fields, StructField(high, LongType()), StructField(low, LongType())]))


def as_hex(high: str | Column, low: str | Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a_high, a_low, b_high, b_low) -> Column:
    """Hamming distance of two fingerprints."""
    apart = [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in ((a_high, b_high), (a_low, b_low))]
    return apart[0] + apart[1]


def likeness(bits_apart: Column) -> Column:
    """Cosine estimated from the share of differing bits, not below 0: 1 for equal fingerprints, 0 from half apart on."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(math.pi / BITS) * bits_apart))


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of distinct fingerprints (``high``, ``low``) at most ``radius`` bits apart:
    ``a_high, a_low, b_high, b_low, apart``, each once.

    The bits are cut into ``blocks`` blocks. Two such fingerprints agree in at least
    blocks - radius of them, so for every choice of that many blocks there is one table keyed by
    their bits, and a pair is found in the first table whose blocks it shares. With the defaults a key
    has about 51 bits, so only near fingerprints meet. Copies must have been combined before.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below the number of blocks")
    distinct = prints.select("high", "low").distinct()
    edges = [BITS * b // blocks for b in range(blocks + 1)]

    def part(h: Column, lo: Column, b: int) -> list[Column]:
        out = []
        for word, base in ((h, 64), (lo, 0)):
            start, stop = max(edges[b], base) - base, min(edges[b + 1], base + 64) - base
            if start < stop:
                mask = ((1 << (stop - start)) - 1) << start
                out.append(word.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))
        return out

    chosen = list(combinations(range(blocks), blocks - radius))
    rows = [
        F.struct(F.lit(t).alias("_table"), F.xxhash64(F.lit(t), *[c for b in tables for c in part(F.col("high"), F.col("low"), b)]).alias("_key"))
        for t, tables in enumerate(chosen)
    ]
    keyed = distinct.select("high", "low", F.inline(F.array(*rows)))
    a = keyed.select("_table", "_key", F.col("high").alias("a_high"), F.col("low").alias("a_low"))
    b = keyed.select("_table", "_key", F.col("high").alias("b_high"), F.col("low").alias("b_low"))
    apart = distance("a_high", "a_low", "b_high", "b_low")
    above = (F.col("a_high") < F.col("b_high")) | ((F.col("a_high") == F.col("b_high")) & (F.col("a_low") < F.col("b_low")))
    met = a.join(b, (a["_key"] == b["_key"]) & (a["_table"] == b["_table"]) & above & (apart <= radius))
    return met.select("a_high", "a_low", "b_high", "b_low", apart.alias("apart")).distinct()


def with_next(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows in doc_id order beside their successor: ``doc_id``, ``text`` (null: empty), ``high``, ``low``,
    ``next_text``, ``next_high``, ``next_low``; the last row's successor is the first.

    Rows are cut into ranges of doc_id at quantiles, so texts are shuffled once, and each range also gets
    the first row of the range after it. Ids are expected to be distinct: rows that repeat one stay
    in one range, ordered by text; null ids come first.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    wanted = 4 * shuffle_width(spark)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 100 * wanted)).head()[0] or []
    splits = np.unique(np.array(cuts, np.int64))
    block = F.lit(0) if not len(splits) else F.array_size(F.filter(F.expr(f"array({', '.join(f'{s}L' for s in splits)})"), lambda s: s <= F.col("doc_id")))
    least = F.min(F.coalesce("doc_id", F.lit(-(1 << 63))))
    firsts = sorted((r[0], r[1]) for r in ids.groupBy(F.coalesce(block, F.lit(0)).alias("b")).agg(least.alias("m")).collect())
    before = {m: firsts[i - 1][0] for i, (_, m) in enumerate(firsts)}
    names = ["doc_id", "text"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = fingerprint_words(batch.column("text"), shingle)
            plain = batch.column("doc_id").cast(pa.int64()).fill_null(-(1 << 63))
            number = np.asarray(plain)
            home = np.searchsorted(splits, number, "right").astype(np.int32)
            whole = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(high), pa.array(low), pa.array(home), pa.array(np.zeros(len(home), bool))], [*names, "high", "low", "_block", "_guard"]
            )
            yield whole
            guards = [i for i, n in enumerate(number.tolist()) if n in before]
            if guards:
                copy = whole.take(pa.array(guards))
                target = pa.array([before[int(number[i])] for i in guards], pa.int32())
                yield pa.RecordBatch.from_arrays([*copy.columns[:4], target, pa.array([True] * len(guards))], whole.schema.names)

    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = read.mapInArrow(spread, f"doc_id {kind}, text string, high long, low long, _block int, _guard boolean")
    line = Window.partitionBy("_block").orderBy("_guard", "doc_id", "high", "low", "text")
    lead = {f"next_{c}": F.lead(c).over(line) for c in ("text", "high", "low")}
    return dealt.withColumns(lead).filter("not _guard").drop("_guard", "_block")


def edited(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likeness to those and to the next row.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` and the fingerprint words ``high``, ``low``. The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next text. A null or
    empty text is empty, with fingerprint 0. Other columns are not read; an empty table gives an empty result.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    ahead = with_next(docs, shingle).withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    text = F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    changed = ahead.select("doc_id", "n_chars", "high", "low", "next_high", "next_low", text.alias("edited"))
    done = with_fingerprint(changed, "edited", "edited_high", "edited_low", shingle)
    return done.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex("high", "low").alias("fingerprint"),
        as_hex("edited_high", "edited_low").alias("edited_fingerprint"),
        likeness(distance("high", "low", "edited_high", "edited_low")).alias("near_edited"),
        likeness(distance("high", "low", "next_high", "next_low")).alias("near_next"),
        "high", "low",
    )


@query("op4_simhash")
def op4_simhash(spark, folder):
    """Besides the digest, ``n_near``: other fingerprints of the table within the radius."""
    found = materialize(edited(table(spark, folder, "documents")), "fingerprints")
    pairs = near_pairs(found)
    ends = pairs.select(F.col("a_high").alias("high"), F.col("a_low").alias("low")).union(pairs.select("b_high", "b_low"))
    links = ends.groupBy("high", "low").agg(F.count("*").alias("n_near"))
    joined = found.join(links, ["high", "low"], "left")
    return joined.select(*[c for c in found.columns if c not in ("high", "low")], F.coalesce("n_near", F.lit(0)).alias("n_near"))
