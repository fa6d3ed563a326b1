"""Set-similarity join of documents on word shingles by PartEnum signatures.

Sets are put into size bands so that two sets of Jaccard similarity >= gamma lie in one band or in
neighbouring ones. For a band, similar sets differ in at most k elements. The feature domain
(shingle hashes) is cut into n1 parts, so one part holds at most k2 = k // n1 differences; each
part is cut into n2 > k2 pieces and every choice of n2 - k2 pieces gives one signature, the hash of
the set's elements in those pieces. Similar sets therefore share a signature, always.

What shares a signature is only a candidate. Pairs of sets that share one, of signatures of few sets, are checked by sketches: a sketch holds
for each bucket of the hashes whether the set has an odd number of elements there, so two sets differ in at least as many elements as
their sketches in bits. Pairs that surely differ too much are dropped; signatures of many sets join theirs by a hub, never all pairs. What is left is
joined into clusters. Similar sets also share one of their rarest shingles, so clusters
are parted again by those, and each part is searched exactly: from every set not yet reached,
the sets that share a rare shingle with it are counted against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from firn.llm.lines import query, table
from firn.llm.words import mix, shingle_sets
from firn.operators.spatial import components
from firn.session import discard, materialize, shuffle_width

BLOOM_BITS = 24
RARITY_BITS = 16
CLUSTER_ELEMENTS = 2_000_000
CLUSTER_SETS = 50_000
#: Signatures are shuffled in so many shares, one after the other: less disk, more hashing, the same result.
PASSES = 2
#: Chunks of sets outside a part's largest group that meet all its chunks in one round: less disk, the same pairs.
ROUND_CHUNKS = 2
HELD_KEYS = 1 << 20
#: Sets of one signature up to which all their pairs are checked.
PAIRED_SETS = 64
LEAST_SKETCH = 64
SMALL_K = 6
_LEVELS = 6
_SEEN_SETS = 1 << 20
_U = np.uint64


class Bands:
    """Size bands and the parts of each for similarity of at least ``num`` / ``den``."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.upper = num, den, [0]

    def of(self, size: int) -> int:
        """Number of the band (from 1) that holds sets of this size."""
        while self.upper[-1] < size:
            self.upper.append((self.upper[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.upper, size))

    @cache
    def parts(self, band: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, spare) for two sets of this band or one of it and one of the next.

        ``spare`` parts are added, so that more than ``spare`` parts hold at most k2 differences. Few
        sets leave a projection empty in more parts than that, and such sets are cut once more.
        """
        largest = self.upper[band]
        together = largest + largest * self.den // self.num
        k = together * (self.den - self.num) // (self.den + self.num)
        n2, k2 = (3, 1) if 0 < k <= SMALL_K else (1, 0)
        n1, spare = k // (k2 + 1) + 1, 0
        smallest = max(1, largest * self.num // self.den)
        for _ in range(3 if k2 == 0 else 0):
            empty = n1 * n2 * (1 - (n2 - k2) / (n1 * n2)) ** smallest
            spare = 0 if empty < 0.001 else int(np.ceil(empty + 3 * np.sqrt(empty)))
            n1 = k // (k2 + 1) + 1 + spare
        return n1, n2, k2, spare

    @cache
    def labels(self, band: int, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hash seed of a cut, and for each choice of pieces the labels of the first-level parts."""
        n1, n2, k2, _ = self.parts(band)
        seed = mix(np.array([band * 1_000_003 + level * 7919 + 1], _U))
        number = np.arange(n1, dtype=_U)
        choices = len(list(combinations(range(n2), n2 - k2)))
        return seed, [mix(seed + number * _U(64) + _U(c)) for c in range(choices)]


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of one non-empty set of distinct hashes: those of its band and of the band below,
    in which it can be the larger partner."""
    own = bands.of(len(elements))
    out = []
    for band in (own, own - 1):
        if band >= 1:
            out += _in_band(elements, band, bands)
    return np.concatenate(out)


def _in_band(elements: np.ndarray, band: int, bands: Bands) -> list[np.ndarray]:
    """Projections that hold no element are left out: sets without it would all meet there. Two similar
    sets agree in more than ``spare`` parts, so they still share a signature unless both leave more
    than ``spare`` parts with an empty projection; both are then cut anew by another hash."""
    n1, n2, k2, spare = bands.parts(band)
    n, out = n1 * n2, []
    for level in range(_LEVELS):
        seed, labels = bands.labels(band, level)
        scattered = mix(elements ^ seed)
        piece = ((scattered >> _U(32)) % _U(n)).astype(np.int64)
        held, sums = np.bincount(piece, minlength=n), np.zeros(n, _U)
        np.add.at(sums, piece, scattered * (scattered | _U(1)))
        if n2 == 1:
            filled = held > 0
            out.append(mix(sums ^ labels[0])[filled])
            bare = n - np.count_nonzero(filled)
        else:
            sums, held = sums.reshape(n1, n2), held.reshape(n1, n2)
            some = [held[:, c].any(axis=1) for c in combinations(range(n2), n2 - k2)]
            for c, label, there in zip(combinations(range(n2), n2 - k2), labels, some, strict=True):
                out.append(mix(sums[:, c].sum(axis=1, dtype=_U) ^ label)[there])
            bare = n1 - np.count_nonzero(np.logical_and.reduce(some))
        if bare <= spare:
            return out
    return [*out, mix(np.array([band], _U))]


def _set_hash(elements: np.ndarray) -> int:
    return int(mix(np.array([mix(elements).sum(dtype=_U) + _U(len(elements))], _U))[0].view(np.int64))


def _sketch(elements: np.ndarray) -> bytes:
    """One bit for each of the next power of two of buckets: whether the set has an odd number of elements there."""
    buckets = max(LEAST_SKETCH, 1 << (len(elements) - 1).bit_length())
    held = np.bincount((mix(elements) & _U(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((held & 1).astype(bool)).tobytes()


def _sketch_bits(a: pa.Array, b: pa.Array) -> np.ndarray:
    """In how many bits the sketches of each row differ; the longer one is folded to the length of the shorter."""
    sides = []
    for column in (a, b):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        sides.append((ends[:-1], np.diff(ends), np.frombuffer(column.buffers()[2] or b"", np.uint8)))
    sizes = np.stack((sides[0][1], sides[1][1]), axis=1)
    out = np.zeros(len(sizes), np.int64)
    for pair in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == pair).all(axis=1))
        short = int(pair.min())
        # Some megabytes at a time, however long the sketches are.
        step = max(1, (1 << 24) // int(pair.max()))
        for at in (rows[i : i + step] for i in range(0, len(rows), step)):
            bits = np.zeros((len(at), short), np.uint8)
            for (starts, _, values), size in zip(sides, pair):
                whole = values[starts[at][:, None] + np.arange(size)]
                bits ^= np.bitwise_xor.reduce(whole.reshape(len(at), -1, short), axis=1)
            out[at] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return out


def set_rows(docs: DataFrame, shingle: int, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``also``, ``n_shingles``, ``_set``, the 64-bit hash of the shingle set, and its ``_sketch`` (both null if empty)."""
    names = ["doc_id", *also]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, sketches = [], [], []
            for elements in shingle_sets(batch.column("text"), shingle):
                sizes.append(len(elements))
                hashes.append(_set_hash(elements) if len(elements) else None)
                sketches.append(_sketch(elements) if len(elements) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *made], [*names, "n_shingles", "_set", "_sketch"])

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, "text").mapInArrow(rows, f"{kinds}, n_shingles long, _set long, _sketch binary")


class _Hubs:
    """Keys of sets in one task. A flush gives a key of at most ``paired`` sets with each of them; any other key once, with one of its sets
    (the hub), and ties the other sets that hold the key to the hub, so a key of very many sets leaves a task as one row."""

    def __init__(self, paired: int = 1) -> None:
        self.paired = paired
        self.keys: list[np.ndarray] = []
        self.names: list[int] = []
        self.held = 0

    def add(self, name: int, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.names.append(name)
        self.held += len(keys)

    def flush(self) -> pa.RecordBatch:
        keys = np.concatenate([np.empty(0, _U), *self.keys])
        sets = np.repeat(np.array(self.names, np.int64), [len(k) for k in self.keys])
        order = np.argsort(keys, kind="stable")
        keys, sets = keys[order], sets[order]
        opens = np.ones(len(keys), bool)
        opens[1:] = keys[1:] != keys[:-1]
        number = np.cumsum(opens) - 1
        hubs = sets[opens][number]
        opens |= (np.bincount(number) <= self.paired)[number] if len(number) else opens
        tied = np.unique(np.stack((hubs, sets), axis=1)[(hubs != sets) & ~opens], axis=0)
        self.keys, self.names, self.held = [], [], 0
        out_keys = np.concatenate((keys[opens].view(np.int64), tied[:, 1]))
        out_sets = np.concatenate((sets[opens], tied[:, 1]))
        out_hubs = pa.array(np.concatenate((np.zeros(opens.sum(), np.int64), tied[:, 0])), mask=np.arange(len(out_keys)) < opens.sum())
        return pa.RecordBatch.from_arrays([pa.array(out_keys), pa.array(out_sets), out_hubs], ["_key", "_set", "_hub"])


def _distinct_sets(texts: Iterator[pa.Array], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set hash, elements) of the non-empty sets of a task's texts; sets just handed on are left out (a million are remembered)."""
    seen: set[int] = set()
    for column in texts:
        for elements in shingle_sets(column, shingle):
            if not len(elements) or (name := _set_hash(elements)) in seen:
                continue
            if len(seen) >= _SEEN_SETS:
                seen.clear()
            seen.add(name)
            yield name, elements


def signature_rows(docs: DataFrame, shingle: int, num: int, den: int, passes: int = 1, share: int = 0) -> DataFrame:
    """(``_key``, ``_set``, ``_hub``) of the signatures of all texts whose remainder by ``passes`` is ``share``, combined in each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, hubs = Bands(num, den), _Hubs(PAIRED_SETS)
        for name, elements in _distinct_sets((b.column("text") for b in batches), shingle):
            found = signatures(elements, bands)
            hubs.add(name, found[(found >> _U(32)) % _U(passes) == share] if passes > 1 else found)
            if hubs.held >= HELD_KEYS:
                yield hubs.flush()
        yield hubs.flush()

    return docs.select("text").mapInArrow(rows, "_key long, _set long, _hub long")


def _hub_edges(keyed: DataFrame) -> DataFrame:
    """Edges (``src``, ``dst``) that join the sets of each key; a key has at most one row for each flush of a task."""
    of_key = Window.partitionBy("_key").orderBy("_set").rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.withColumn("_src", F.coalesce("_hub", F.first("_set").over(of_key)))
    return joined.filter("_src != _set").select(F.col("_src").alias("src"), F.col("_set").alias("dst")).distinct()


def _met(keyed: DataFrame, paired: int) -> DataFrame:
    """Pairs (``src`` < ``dst``, not ``tied``) of all sets of each key of at most ``paired`` sets; edges (``tied``) that join those of any other key."""

    def pairs(keys: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        opens = np.ones(len(keys), bool)
        opens[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(opens)
        count = np.diff(np.append(first, len(keys)))
        # A row meets all rows before it in its key, or the first alone.
        before = np.arange(len(keys)) - np.repeat(first, count)
        many = np.repeat(count > paired, count)
        met = np.where(many, np.minimum(before, 1), before)
        a = _ranges(np.repeat(first, count), met)
        b = np.repeat(np.arange(len(keys)), met)
        ends = np.stack((sets[a], sets[b], many[b].astype(np.int64)), axis=1)
        return _edge_rows(np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, held = [], [], 0
        for batch in batches:
            hubs = batch.column("_hub")
            tied = np.asarray(hubs.is_valid())
            key, name = (np.asarray(batch.column(c)) for c in ("_key", "_set"))
            if tied.any():
                hub = np.asarray(hubs.fill_null(0))[tied]
                ends = np.sort(np.stack((hub, name[tied]), axis=1), axis=1)
                yield _edge_rows(np.column_stack((ends, np.ones(len(ends), np.int64))))
            keys.append(key[~tied])
            sets.append(name[~tied])
            held += len(keys[-1])
            if held >= HELD_KEYS:
                key, name = np.concatenate(keys), np.concatenate(sets)
                # The last key may go on in the next batch.
                done = int(np.searchsorted(key, key[-1]))
                yield pairs(key[:done], name[:done])
                keys, sets, held = [key[done:]], [name[done:]], 0
        if held or keys:
            yield pairs(np.concatenate(keys), np.concatenate(sets))

    sorted_ = keyed.repartition(shuffle_width(keyed.sparkSession), "_key").sortWithinPartitions("_key", "_set")
    met = sorted_.mapInArrow(rows, "src long, dst long, tied long")
    return met.groupBy("src", "dst").agg(F.max("tied").alias("tied"))


def _edge_rows(ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in ends.reshape(-1, 3).T], ["src", "dst", "tied"])


def _checked(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``src``, ``dst``) that may be similar by their sizes and sketches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.asarray(batch.column(c)) for c in ("_a_size", "_b_size")]
            least = _sketch_bits(batch.column("_a"), batch.column("_b"))
            kept = pa.array((den + num) * least <= (den - num) * (sizes[0] + sizes[1]))
            yield batch.select(["src", "dst"]).filter(kept)

    one, other = (sketches.select(F.col("_set").alias(end), F.col("_size").alias(f"{s}_size"), F.col("_sketch").alias(s)) for end, s in (("src", "_a"), ("dst", "_b")))
    both = pairs.join(one, "src").join(other, "dst")
    near = both.filter((den * F.col("_a_size") >= num * F.col("_b_size")) & (den * F.col("_b_size") >= num * F.col("_a_size")))
    return near.select("src", "dst", "_a_size", "_b_size", "_a", "_b").mapInArrow(rows, "src long, dst long")


def _bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size (2**bits bits) over hashed ids; the driver reads at most 2**(bits-6) words."""
    marks = ids.select(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63L as int))")
    words = marks.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("b"))
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices of the ranges that start at ``starts`` and have ``counts`` members, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _prefix(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of a set's elements, rarest first, hold at least one that each similar set has among its own so many."""
    return sizes - (num * sizes + den - 1) // den + 1


def _reach(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Label of each set: the first set of its component of links with similarity >= num / den.

    Breadth-first. A set meets only unreached ones that share an element of both prefixes; the posting lists
    are made anew when half of their sets are reached, so reached sets cost nothing later.
    """
    sizes = np.array([len(s) for s in sets])
    values, codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(values))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = rank[codes]
    codes = codes[np.lexsort((codes, owner))]
    reach = _prefix(sizes, num, den)
    at = _ranges(bounds[:-1], reach)
    prefix_code, prefix_owner = codes[at], owner[at]
    order = np.argsort(prefix_code, kind="stable")
    prefix_code, prefix_owner = prefix_code[order], prefix_owner[order]
    label = np.full(len(sets), -1)
    mark = np.zeros(len(values), bool)
    indexed = left = len(sets)
    for start in range(len(sets)):
        if label[start] >= 0:
            continue
        label[start] = start
        left -= 1
        todo = [start]
        while todo and left:
            if 2 * left < indexed:
                open_ = label[prefix_owner] < 0
                prefix_code, prefix_owner, indexed = prefix_code[open_], prefix_owner[open_], left
            one = todo.pop()
            own = codes[bounds[one] : bounds[one + 1]]
            asked = own[: reach[one]]
            first = np.searchsorted(prefix_code, asked)
            met = prefix_owner[_ranges(first, np.searchsorted(prefix_code, asked, "right") - first)]
            met = met[(label[met] < 0) & (den * sizes[met] >= num * sizes[one]) & (den * sizes[one] >= num * sizes[met])]
            if not len(met):
                continue
            met = np.unique(met)
            mark[own] = True
            shared = mark[codes[_ranges(bounds[met], sizes[met])]]
            common = np.add.reduceat(shared, np.cumsum(sizes[met]) - sizes[met], dtype=np.int64)
            mark[own] = False
            found = met[den * common >= num * (sizes[one] + sizes[met] - common)]
            label[found] = start
            left -= len(found)
            todo += found.tolist()
    return label


def similar_components(
    docs: DataFrame,
    shingle: int = 5,
    num: int = 8,
    den: int = 10,
    cluster_elements: int = CLUSTER_ELEMENTS,
    also: tuple[str, ...] = (),
    passes: int = PASSES,
    cluster_sets: int = CLUSTER_SETS,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and the columns ``also`` of every row of ``docs`` (``doc_id``, ``text``).

    Rows are linked when den * |A and B| >= num * |A or B| for their sets of distinct word shingles
    (words lower-cased in A-Z); a text with fewer words than a shingle has its whole sequence as
    one. ``component_id`` is the smallest doc_id that can be reached by links. Null or empty texts
    have size 0 and no link: their own doc_id. Null doc_ids take part but never name a component
    (unless all its ids are null). Repeated rows are linked to each other. Other columns are not read; an empty
    table gives an empty result.

    Copies count as one set. A cluster is cut into chunks of about ``cluster_elements`` shingles and ``cluster_sets`` sets,
    each searched together with one set of the whole cluster. Sets that this does not join to the cluster's largest group
    then meet all chunks, so one task holds about two chunks or two longer sets. Every link is found; the
    bitmap of document ids only spares reading texts that have no partner. Signatures are shuffled in ``passes`` shares.
    """
    rows = materialize(set_rows(docs, shingle, also), "sets")
    shares = [materialize(_met(signature_rows(docs, shingle, num, den, passes, i), PAIRED_SETS), "met") for i in range(passes)]
    met = reduce(DataFrame.unionByName, shares)
    sketches = rows.filter("_set is not null").groupBy("_set").agg(F.max("n_shingles").alias("_size"), F.first("_sketch").alias("_sketch"))
    pairs = met.filter("tied = 0").select("src", "dst").distinct()
    edges = materialize(_checked(pairs, sketches, num, den).union(met.filter("tied = 1").select("src", "dst")), "edges")
    for done in shares:
        discard(done)
    names = rows.filter("_set is not null").groupBy("_set").agg(F.min("doc_id").alias("_first"), F.max("n_shingles").alias("_size"))
    labels = _labels(docs, names, edges, shingle, num, den, cluster_elements, cluster_sets)
    rooted = names.join(labels, "_set", "left").withColumn("_root", F.coalesce("_root", "_set"))
    named = rooted.join(rooted.groupBy("_root").agg(F.min("_first").alias("component_id")), "_root").select("_set", "component_id")
    found = rows.join(named, "_set", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), *also)


def _labels(docs, names, edges, shingle, num, den, cluster_elements, cluster_sets) -> DataFrame:
    """(``_set``, ``_root``): exact components among the sets that share signatures."""
    clusters = materialize(components(edges).select(F.col("id").alias("_set"), F.col("label").alias("_cluster")), "clusters")
    candidates = _Asked(docs, clusters.join(names, "_set"), shingle)
    rare = materialize(_hub_edges(_rare_rows(candidates, num, den)), "rare")
    parts = components(rare).select(F.col("id").alias("_set"), F.col("label").alias("_part"))
    members = materialize(clusters.join(parts, "_set").join(names, "_set"), "parts")
    group = ["_cluster", "_part"]
    needed = F.greatest(F.ceil(F.sum("_size") / cluster_elements), F.ceil(F.count("*") / cluster_sets)).cast("int")
    whole = members.groupBy(*group).agg(needed.alias("_chunks"), F.min("_set").alias("_pivot"), F.count("*").alias("_sets"))
    members = materialize(members.join(whole.filter("_sets > 1").drop("_sets"), group), "members")
    chunk = F.pmod(F.xxhash64("_set"), F.col("_chunks")).cast("int")
    held = _Asked(docs, members, shingle).lists().join(members.select("_set", *group, "_chunks", "_pivot"), "_set")
    lists = materialize(held.withColumn("_chunk", chunk), "lists")

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = np.asarray(group.column("_set"))
        ids, keep = np.unique(ids, return_index=True)
        elements = group.column("_elements").chunk(0) if group.num_rows else []
        label = _reach([np.asarray(elements[int(i)].values) for i in keep], num, den)
        linked = label != np.arange(len(ids))
        return pa.table({"src": pa.array(ids[label[linked]]), "dst": pa.array(ids[linked])})

    every = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    pivots = lists.filter("_chunks > 1 and _set = _pivot").select(*group, every.alias("_chunk"), "_set", "_elements")
    near = lists.select(*group, "_chunk", "_set", "_elements").unionByName(pivots)
    links = materialize(near.groupBy(*group, "_chunk").applyInArrow(search, "src long, dst long"), "links")
    cut = members.filter("_chunks > 1")
    if not cut.isEmpty():
        for across in _across(cut, lists, links, group, cluster_elements, cluster_sets):
            found = across.groupBy(*group, "_chunk", "_other").applyInArrow(search, "src long, dst long")
            links = links.unionByName(materialize(found, "links"))
    labels = materialize(components(links).select(F.col("id").alias("_set"), F.col("label").alias("_root")), "labels")
    for done in (clusters, rare, members, lists):
        discard(done)
    return labels


def _across(cut: DataFrame, lists: DataFrame, links: DataFrame, group: list[str], cluster_elements: int, cluster_sets: int) -> Iterator[DataFrame]:
    """Rows of the pairs of chunks still to be searched: each chunk of a part against the sets outside the part's largest
    group of linked sets, which are dealt to chunks (``_other``) of their own. Sets of the largest group need not meet again.

    All pairs come, in rounds of ROUND_CHUNKS of these chunks of each part: a round holds each set so many times, and each of its guests once a chunk."""
    joined = components(links).select(F.col("id").alias("_set"), F.col("label").alias("_group"))
    grouped = cut.join(joined, "_set", "left").withColumn("_group", F.coalesce("_group", "_set"))
    sizes = grouped.groupBy(*group, "_group").count()
    largest = sizes.groupBy(*group).agg(F.max_by("_group", F.struct("count", "_group")).alias("_most"))
    outside = grouped.join(largest, group).filter("_group != _most").select(*group, "_set", "_size")
    needed = F.greatest(F.ceil(F.sum("_size") / cluster_elements), F.ceil(F.count("*") / cluster_sets)).cast("int")
    outside = materialize(outside, "outside")
    others = materialize(outside.groupBy(*group).agg(needed.alias("_others")), "others")
    most = others.agg(F.max("_others")).first()[0] or 0
    spread = lists.join(others, group)
    columns = [*group, "_chunk", "_other", "_set", "_elements"]
    at_home = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_others") - 1))).select(*columns)
    dealt = spread.join(outside.select("_set"), "_set", "left_semi").withColumn("_other", F.pmod(F.xxhash64("_set", F.lit(1)), F.col("_others")).cast("int"))
    guests = dealt.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).select(*columns)
    every = at_home.unionByName(guests)
    for first in range(0, most, ROUND_CHUNKS):
        yield every.filter(F.col("_other").between(first, first + ROUND_CHUNKS - 1))


class _Asked:
    """The shingle sets of the first document of each of ``members`` (and of a few more that the bitmap lets through)."""

    def __init__(self, docs: DataFrame, members: DataFrame, shingle: int) -> None:
        bits = docs.sparkSession.sparkContext.broadcast(_bloom(members.select(F.col("_first").alias("doc_id")), BLOOM_BITS))
        self.docs = docs.select("text", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BLOOM_BITS).alias("_at"))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            at = ((b, np.asarray(b.column("_at"))) for b in batches)
            return _distinct_sets((b.column("text").filter(pa.array((bits.value[i >> 6] >> (i & 63)) & 1 == 1)) for b, i in at), shingle)

        self.sets = sets

    def map(self, rows, schema: str) -> DataFrame:
        return self.docs.mapInArrow(rows, schema)

    def lists(self) -> DataFrame:
        """(``_set``, ``_elements``)."""
        sets = self.sets

        def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, values = [], []
            for name, found in sets(batches):
                names.append(name)
                values.append(found.view(np.int64))
                if len(names) >= 256:
                    yield _lists(names, values)
                    names, values = [], []
            if names:
                yield _lists(names, values)

        return self.map(elements, "_set long, _elements array<long>")


def _bucket(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) >> _U(64 - RARITY_BITS)).astype(np.int64)


def _rare_rows(asked: _Asked, num: int, den: int) -> DataFrame:
    """(``_key``, ``_set``, ``_hub``) of the prefixes of the asked sets. Shingles are ordered by the count of their bucket (2**RARITY_BITS of
    them, over all asked sets), then by hash: one order for all sets, so buckets that several shingles share cost only time."""
    sets = asked.sets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << RARITY_BITS, np.int64)
        for _, elements in sets(batches):
            held += np.bincount(_bucket(elements), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["b", "n"])

    counted = asked.map(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << RARITY_BITS, np.int64)
    often[np.asarray(counted.column("b"))] = np.asarray(counted.column("n"))
    shared = asked.docs.sparkSession.sparkContext.broadcast(often)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs = _Hubs()
        for name, elements in sets(batches):
            order = np.lexsort((elements, shared.value[_bucket(elements)]))
            hubs.add(name, elements[order[: _prefix(np.array([len(elements)]), num, den)[0]]])
            if hubs.held >= HELD_KEYS:
                yield hubs.flush()
        yield hubs.flush()

    return asked.map(rows, "_key long, _set long, _hub long")


def _lists(names: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    bounds = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(values)))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists], ["_set", "_elements"])


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` that name their component (the smallest doc_id), with all their columns.

    Rows without words or without doc_id stay. Rows that repeat that doc_id in the same component stay with it; where
    a doc_id stands on texts of several components, each row goes or stays by its own text. A bitmap of fixed size
    lets most rows that stay pass without a shuffle; the others are settled by an exact join.
    """
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    found = similar_components(keyed, shingle, num, den, also=("_text_key",))
    gone = materialize(found.filter("doc_id != component_id").select("doc_id", "_text_key").distinct(), "gone")
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(gone, BLOOM_BITS))
    placed = keyed.withColumn("_at", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BLOOM_BITS))

    def marked(hit: bool) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.asarray(batch.column("_at"))
                yield batch.filter(pa.array(((bits.value[at >> 6] >> (at & 63)) & 1 == 1) == hit))

        return placed.mapInArrow(rows, placed.schema)

    return marked(False).select(*docs.columns).union(marked(True).join(gone, ["doc_id", "_text_key"], "left_anti").select(*docs.columns))


@query(
    "op10_ngram_jaccard",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
        FROM documents
    ), d AS MATERIALIZED (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
        FROM w
    ), s AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM d),
    links AS MATERIALIZED (
        SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
    ), r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT y, root FROM r JOIN links ON x = r.doc_id)
    SELECT d.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(root) AS component_id
    FROM d JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, len(g)
    """,
)
def op10_ngram_jaccard(spark, folder):
    return similar_components(table(spark, folder, "documents"), shingle=3, num=90, den=100)
