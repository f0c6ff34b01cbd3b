"""Secret scans in DataFrame functions only.

Base spans: credential assignments, access keys and long hex runs, by pattern.  Entropy spans: candidate strings
that hold a letter and a digit are walked by a window of ``WINDOW`` characters.  The window's sum of n * log2(n) over
character counts n is kept up to date by the character that enters and the one that leaves; a window whose entropy
reaches the bound of the candidate's character class (hex, alphanumeric, any) is secret.  The span runs from the first
such window to the last.  Candidates that match the allow list, and spans that overlap a base span, add nothing.

Matches are found with their strings by one regular expression call, and the texts between them by a split at the
same expression; positions are running sums of both lengths.  Positions count code points.

The sums are integers (millionths), so that results do not depend on rounding.

Defined cases: a null text equals the empty one, without spans.  Rows are kept apart even where ids repeat.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in the order in which kinds sort.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, CANDIDATE]))

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = [(r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.6), (r"", 3.8)]  # class, least bits per character
ALLOW = [
    r"(?i)example|sample|placeholder|dummy|changeme",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij",
]
MILLION = 1_000_000
#: n * log2(n) in millionths, for counts 0 to WINDOW.
WEIGHTS = [0, *(round(n * math.log2(n) * MILLION) for n in range(1, WINDOW + 1))]
REDACTED = "[SECRET]"


def most_weight(bits: float) -> int:
    """The greatest sum of n * log2(n) a window may have to reach so many bits per character."""
    return round((WINDOW * math.log2(WINDOW) - WINDOW * bits) * MILLION)


def is_candidate(hit: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | hit.rlike(pattern)
    return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~allowed


def bound_of(hit: Column) -> Column:
    bound = F.lit(most_weight(CLASSES[-1][1]))
    for pattern, bits in reversed(CLASSES[:-1]):
        bound = F.when(hit.rlike(pattern), F.lit(most_weight(bits))).otherwise(bound)
    return bound.cast("long")


def secret_windows(hit: Column) -> Column:
    """struct(first, last): ends of the first and the last window that reach the class's bound; 0 if none does.

    The fold goes over the candidate's characters and keeps the count of each character in the window.  A step takes
    the leaving character out and puts the entering one in, and changes the sum by these two alone.
    """
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    slots = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    place = F.struct(slots.alias("slots"), bound_of(hit).alias("bound"))
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last")
    )

    def weight(n: Column) -> Column:
        return F.element_at(weights, n + 1)

    def walk(at: Column) -> Column:
        def leave(acc: Column) -> Column:
            old = F.element_at(at["slots"], acc["i"] + 1 - WINDOW)
            n = F.element_at(acc["counts"], old)
            return F.when(
                acc["i"] >= WINDOW,
                F.struct(F.transform(acc["counts"], lambda x, k: x - (k + 1 == old).cast("int")).alias("counts"), (acc["sum"] - weight(n) + weight(n - 1)).alias("sum")),
            ).otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))

        def enter(acc: Column, c: Column) -> Column:
            return _let(leave(acc), lambda w: F.struct(F.transform(w["counts"], lambda x, k: x + (k + 1 == c).cast("int")).alias("counts"), (w["sum"] + weight(F.element_at(w["counts"], c) + 1) - weight(F.element_at(w["counts"], c))).alias("sum")))

        def note(acc: Column, c: Column) -> Column:
            def ends(w: Column) -> Column:
                i = acc["i"] + 1
                hit_here = (i >= WINDOW) & (w["sum"] <= at["bound"])
                return F.struct(
                    w["counts"].alias("counts"),
                    w["sum"].alias("sum"),
                    i.alias("i"),
                    F.when(hit_here & (acc["first"] == 0), i).otherwise(acc["first"]).alias("first"),
                    F.when(hit_here, i).otherwise(acc["last"]).alias("last"),
                )

            return _let(enter(acc, c), ends)

        return F.aggregate(at["slots"], start, note, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _let(place, walk)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hits(s: Column, kind: str) -> Column:
    """array<struct<gap, hit, size>>: length of the text before each match, the match, the length that is held to account.

    A text without a match is only tested; the last struct holds the rest of the text and no match.
    """
    pattern = PATTERNS[kind]
    strings = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(s, F.lit(pattern), F.lit(2)) if kind == "assign" else strings
    rows = F.arrays_zip(F.split(s, pattern, -1).alias("piece"), strings.alias("hit"), values.alias("value"))
    shaped = F.transform(
        rows, lambda r, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.char_length(r["piece"]).alias("gap"), r["hit"].alias("hit"), F.char_length(r["value"]).alias("size"))
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string,size:int>>")
    return F.when(s.rlike(pattern), shaped).otherwise(none)


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<start, kind, stop>> by start and kind; kind counts along KINDS."""
    s = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(F.concat(*[_hits(s, k) for k in KINDS]), lambda h: h["hit"].isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), found.alias("found")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.explode_outer("found").alias("h")).select("row", "doc_id", "h.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i")
    size = F.char_length("hit")
    rows = rows.withColumn("start", (F.sum(F.col("gap") + size).over(before) - size).cast("long"))
    is_entropy = F.col("kind") == KINDS.index("entropy")
    rows = rows.withColumn("w", F.when(is_entropy & is_candidate(F.col("hit")), secret_windows(F.col("hit"))))
    holds = F.when(is_entropy, F.coalesce(F.col("w.first") > 0, F.lit(False))).when(F.col("kind") == 0, F.col("size") >= LEAST_VALUE).otherwise(F.col("kind").isNotNull())
    start = F.when(is_entropy, F.col("start") + F.col("w.first") - WINDOW).otherwise(F.col("start"))
    stop = F.when(is_entropy, F.col("start") + F.col("w.last")).otherwise(F.col("start") + size)
    spans = rows.select("row", "doc_id", F.when(holds, F.struct(start.alias("start"), F.col("kind").alias("kind"), stop.alias("stop"))).alias("span"))

    # A base span overlaps if one that starts no later reaches past the start, or one that starts later does so before the stop.
    by_start = Window.partitionBy("row").orderBy("span.start")
    base = F.col("span.kind") < KINDS.index("entropy")
    earlier = F.max(F.when(base, F.col("span.stop"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(base, F.col("span.start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    spans = spans.withColumn("earlier", earlier).withColumn("later", later)
    free = base | ~(F.coalesce(F.col("earlier") > F.col("span.start"), F.lit(False)) | F.coalesce(F.col("later") < F.col("span.stop"), F.lit(False)))
    return spans.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(free, F.col("span")))).alias("spans")).drop("row")


def report(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans and all spans as text, of ``find_spans`` rows."""
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] < KINDS.index("entropy"))
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def redact(text: Column) -> Column:
    """The text with every secret replaced, kind after kind, each row for itself.  Null stays null."""

    def swap(s: Column, kind: str) -> Column:
        pattern = PATTERNS[kind]
        strings = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
        if kind == "assign":
            values = F.regexp_extract_all(s, F.lit(pattern), F.lit(2))
            fresh = F.zip_with(strings, values, lambda h, v: F.when(F.char_length(v) >= LEAST_VALUE, F.concat(F.substring(h, F.lit(1), F.char_length(h) - F.char_length(v)), F.lit(REDACTED))).otherwise(h))
        elif kind == "entropy":
            fresh = F.transform(strings, lambda h: F.when(is_candidate(h) & (secret_windows(h)["first"] > 0), F.lit(REDACTED)).otherwise(h))
        else:
            fresh = F.transform(strings, lambda h: F.lit(REDACTED))
        pieces = F.zip_with(F.split(s, pattern, -1), fresh, lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
        return F.when(s.rlike(pattern), F.array_join(pieces, "")).otherwise(s)

    for kind in KINDS:
        text = swap(text, kind)
    return text
