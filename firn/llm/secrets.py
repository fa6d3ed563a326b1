"""Secret scan: fixed patterns, and character Markov models told apart by log-likelihood ratio
(DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from firn.llm.lines import query, table
from firn.session import materialize

# Fixed patterns and least lengths of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z]+(?:[_-][A-Za-z]+)*"
LEAST_IDENTIFIER = 8
ODDS = 10_000.0
BACKOFF = 20.0
KINDS = ("assign", "access", "hex", "markov")


def _characters(token: Column) -> Column:
    return F.split(token, "")


def _steps(token: Column) -> Column:
    """All pairs of neighbouring characters of a token as numbers first * n + second (alphabet of n)."""
    n = len(ALPHABET)
    number = F.transform(_characters(token), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    count = F.greatest(F.size(number) - 1, F.lit(0))
    return F.zip_with(F.slice(number, F.lit(1), count), F.slice(number, F.lit(2), count), lambda a, b: a * n + b)


def markov_ratio(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character step, random over ordinary, learned from labelled samples.

    ``samples`` has ``token`` (over ALPHABET), ``secret`` and ``n``, how often the token stands. Both models
    are first-order chains; a step's chance is its share after the first character, together with BACKOFF
    imagined steps at the share of the second character in all steps (half a step added to each). What
    reaches the driver is at most one row for each class and pair of characters.
    """
    steps = samples.select("secret", "n", F.explode(_steps(F.col("token"))).alias("step"))
    size = len(ALPHABET)
    counts = {True: [0.0] * size**2, False: [0.0] * size**2}
    for r in steps.groupBy("secret", "step").agg(F.sum("n").alias("n")).collect():
        counts[r["secret"]][r["step"]] += r["n"]
    logs = {}
    for c, seen in counts.items():
        second = [sum(seen[b::size]) + 0.5 for b in range(size)]
        share = [x / sum(second) for x in second]
        rows = [seen[a * size : (a + 1) * size] for a in range(size)]
        logs[c] = [math.log((x + BACKOFF * share[b]) / (sum(row) + BACKOFF)) for row in rows for b, x in enumerate(row)]
    return [x - y for x, y in zip(logs[True], logs[False], strict=True)]


def log_ratio(token: Column, ratio: list[float]) -> Column:
    """Sum of the step ratios of a token over ALPHABET."""
    values = F.expr("array(" + ", ".join(f"{v:.4f}D" for v in ratio) + ")")
    return F.aggregate(_steps(token), F.lit(0.0), lambda total, step: total + F.element_at(values, step + 1))


def own_samples(docs: DataFrame) -> DataFrame:
    """Labelled samples from the texts themselves: what the base patterns find is random; runs of letters
    (with single ``_`` or ``-`` between) of at least 8 characters are ordinary. All texts count."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= LEAST["assign"]),
        F.filter(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda v: F.char_length(v) >= LEAST["access"]),
        F.filter(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), lambda v: F.char_length(v) >= LEAST["hex"]),
    )
    plain = F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda v: F.char_length(v) >= LEAST_IDENTIFIER)
    held = docs.select(F.transform(found, lambda v: F.replace(v, F.lit("."), F.lit(""))).alias("r"), plain.alias("o"))
    random = held.select(F.explode("r").alias("token"), F.lit(True).alias("secret"))
    ordinary = held.select(F.explode("o").alias("token"), F.lit(False).alias("secret"))
    return random.union(ordinary).groupBy("token", "secret").agg(F.count("*").alias("n"))


def _matches(text: Column, kind: int, pattern: str, keep) -> Column:
    """Matches in order as (kind, gap before, length, kept): texts between matches give the gaps, so that
    positions are running sums and no text is searched twice."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = keep(hits)
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(hits, F.char_length).alias("len"), kept.alias("ok"))
    empty = F.expr("cast(array() as array<struct<kind:int,gap:int,len:int,ok:boolean>>)")
    named = F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), p["gap"].alias("gap"), p["len"].alias("len"), p["ok"].alias("ok")))
    return F.when(text.rlike(pattern), named).otherwise(empty)


def find_secrets(docs: DataFrame, ratio: list[float], odds: float = ODDS) -> DataFrame:
    """Spans of every row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``spans``, an array of (start, kind,
    end) in order of start then kind, in code points, end exclusive.

    Base kinds are leftmost non-overlapping matches of their patterns, without those that are too short.
    A ``markov`` span is a run of 16 or more characters of ALPHABET with a letter and a digit whose
    log-likelihood ratio exceeds ln ``odds``, the assumed odds of ordinary to random, and which overlaps
    no base span. A null text is empty; a text without spans has an empty array. Rows that repeat are rows
    of their own; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def at_least(n: int):
        return lambda hits: F.transform(hits, lambda h: F.char_length(h) >= n)

    def assigned(_hits: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= LEAST["assign"])

    def unlikely(hits: Column) -> Column:
        return F.transform(hits, lambda h: h.rlike("[A-Za-z]") & h.rlike("[0-9]") & (log_ratio(h, ratio) > math.log(odds)))

    found = F.concat(
        _matches(text, 0, ASSIGN, assigned),
        _matches(text, 1, ACCESS, at_least(LEAST["access"])),
        # Runs are maximal, so asking for 16 characters finds the same spans as dropping shorter runs.
        _matches(text, 2, HEX[:-1] + "{%d,}" % LEAST["hex"], at_least(LEAST["hex"])),
        _matches(text, 3, TOKEN, unlikely),
    )
    rows = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), found.alias("_found")), "matches")
    each = rows.select("_row", F.posexplode("_found").alias("_n", "_m")).select("_row", "_n", "_m.*").repartition("_row")
    before = Window.partitionBy("_row", "kind").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).filter("ok")
    span = F.struct((F.col("end") - F.col("len")).cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"))
    spans = placed.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("_all"))
    base = F.filter("_all", lambda s: s["kind"] < 3)
    clear = F.filter(
        "_all", lambda s: (s["kind"] < 3) | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return rows.select("doc_id", "_row").join(spans.select("_row", clear.alias("_spans")), "_row", "left").select(
        "doc_id", F.coalesce("_spans", none).alias("spans")
    )


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


@query("op7_secrets")
def op7_secrets(spark, folder):
    docs = table(spark, folder, "documents")
    found = find_secrets(docs, markov_ratio(own_samples(docs)))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_markov"),
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )
