"""Scalar column functions: parsing, text, dates, numbers, JSON.  All JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlink.schemas import MONEY

# Date layouts accepted on upload, first fit wins.
DATE_LAYOUTS = ["d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "d MMM yyyy", "d-MMM-yyyy"]

# Words ignored when a counterparty name is tokenised, one list per rule.
STOP_WINDOW = ["PRIVATE", "LIMITED", "PVT", "LTD", "SERVICES", "SOLUTIONS"]
STOP_RULES = [
    "PRIVATE", "LIMITED", "PVT", "LTD", "SERVICES", "SOLUTIONS",
    "ENTERPRISES", "TRADING", "GROUP", "ASSOCIATES", "SUPPLIERS",
]
STOP_GROUPS = [
    "PRIVATE", "LIMITED", "PVT", "LTD", "SERVICES", "SOLUTIONS", "CORP", "CORPORATION", "ENTERPRISES", "TRADING",
    "TRADERS", "GROUP", "ASSOCIATES", "SUPPLIERS", "LOGISTICS", "AND", "THE", "FOR", "FROM", "WITH", "PAYMENT",
    "INDIA", "INDUSTRIES", "TECHNOLOGIES", "PLC", "CO", "COMPANY",
]

# Part-payment words that switch duplicate detection off (matched as substrings).
SPLIT_WORDS = [
    "PART", "SECOND", "2ND", "1ST", "FIRST", "THIRD", "3RD", "INSTALLMENT", "INSTALMENT", "TRANCHE", "ADVANCE",
    "BALANCE", "SPLIT", "FINAL", "REMAINING", "PARTIAL",
]

# Channel prefixes removed before fuzzy comparison.
CHANNEL_PREFIXES = ["UPI/", "NEFT-", "IMPS/", "RTGS/", "CHQ DEP "]

MIN_TOKEN = 4
PREFIX_MIN = 6


def parse_amount(c: Column) -> Column:
    """STR-1: rupee sign, digit grouping and all whitespace removed; null when not a number.

    Only plain decimal notation is read.  More than two decimals round half-up to paise.
    """
    clean = F.regexp_replace(c, r"[₹,\s]", "")
    return F.when(clean != "", clean.try_cast(MONEY))


def parse_date(c: Column) -> Column:
    """DTM-1: the first layout that fits; impossible dates are null."""
    t = F.trim(c)
    return F.coalesce(*[F.try_to_date(t, f) for f in DATE_LAYOUTS])


def blank_to_null(c: Column) -> Column:
    """STR-2."""
    return F.nullif(F.trim(c), F.lit(""))


def paise(c: Column) -> Column:
    """MTH-3: exact integer hundredths, half-even."""
    return F.bround(c * 100, 0).cast("bigint")


def comma_list(c: Column) -> Column:
    """ARR-1: comma list to array of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def tokens(c: Column, stop: list[str]) -> Column:
    """STR-6: whitespace tokens of at least four characters that are not stopwords."""
    return F.filter(
        F.split(F.trim(c), r"\s+"), lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(stop)
    )


def token_heads(c: Column, stop: list[str]) -> Column:
    """First four letters of each significant token; a token in a text implies its head is there too."""
    return F.transform(tokens(c, stop), lambda t: F.substring(t, 1, MIN_TOKEN))


def name_marks(c: Column) -> Column:
    """Significant tokens of a counterparty name with outer punctuation removed (group relevance, STR-8)."""
    bare = F.transform(F.split(F.trim(c), r"\s+"), lambda t: F.regexp_replace(t, r"""^[,.\-/'"]+|[,.\-/'"]+$""", ""))
    return F.filter(bare, lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(STOP_GROUPS))


def invoice_tokens(narration_upper: Column) -> Column:
    """STR-7: all word-bounded INV-digits tokens."""
    return F.regexp_extract_all(narration_upper, F.lit(r"\bINV-\d+\b"), F.lit(0))


def strip_channel(narration_upper: Column) -> Column:
    """STR-5: remove one leading channel prefix."""
    return F.regexp_replace(narration_upper, "^(" + "|".join(CHANNEL_PREFIXES) + ")", "")


def has_split_word(narration_upper: Column) -> Column:
    """STR-10."""
    return narration_upper.rlike("|".join(SPLIT_WORDS))


def ref_points(a: Column, b: Column) -> Column:
    """STR-3 / SCO-1: 40 for equal references, 20 when one is a prefix of the other, 0 otherwise.

    Inputs are trimmed and upper-cased; null when absent.
    """
    long_enough = (F.length(a) >= PREFIX_MIN) & (F.length(b) >= PREFIX_MIN)
    return (
        F.when(a == b, 40.0).when(long_enough & (a.startswith(b) | b.startswith(a)), 20.0).otherwise(0.0)
    )


def leading_digit(c: Column) -> Column:
    """STR-11: first non-zero digit of the decimal text; null when there is none."""
    return F.nullif(F.regexp_extract(c.cast("string"), "[1-9]", 0), F.lit("")).cast("int")


def day_gap(a: Column, b: Column) -> Column:
    """DTM-2."""
    return F.abs(F.datediff(a, b))


def gaussian(x: Column, sigma: float) -> Column:
    """MTH-1."""
    z = x / F.lit(float(sigma))
    return F.exp(F.lit(-0.5) * z * z)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null; greatest and least alone would skip it and return a bound."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def logistic_score(llr: Column, k: float) -> Column:
    """MTH-2: log-likelihood ratio to 0..100, neutral at 50."""
    return F.round(100.0 / (1.0 + F.exp(-clip(llr * k, -20, 20))), 2)


def chi_square_sf8(x: Column) -> Column:
    """MTH-4: upper tail of the chi-square distribution with 8 degrees of freedom (closed form)."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """MTH-5: cosine similarity, 0 when either norm is 0.  Pass precomputed norms where rows repeat."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def sorted_set(c: Column) -> Column:
    """Canonical form of a set of ids, so that set equality is array equality (SET-1)."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))


REPLY_SCHEMA = "assessment string, confidence_delta double, explanation string, key_factors array<string>"


def parse_reply(text: Column) -> Column:
    """JSN-1: first JSON object in free text, fenced or bare; null when it does not parse or lacks a verdict."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.when(F.instr(text, "{") > 0, F.substr(text, F.instr(text, "{")))
    got = F.from_json(F.coalesce(fenced, bare), REPLY_SCHEMA)
    ok = got["assessment"].isin("match", "no_match", "insufficient_evidence") & got["confidence_delta"].isNotNull()
    return F.when(ok, got)
