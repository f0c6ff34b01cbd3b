"""URL filter by two character language models, in DataFrame functions only.

Rules (host suffix with path prefix) judge first.  All other URLs are judged by the ratio of two variable-order
Markov models, one of accepted and one of rejected URLs.  Both are learned from the URLs that the rules decide.

* Characters are folded to 32 symbols (letters, one digit, five signs, the edge), so that a context of three symbols
  and the next one make at most 32^4 = 1,048,576 grams.  That bounds the model and therefore its broadcast.
* The chance of a symbol after a context of three mixes the counts there with the chance after the context of two, and
  so on down to the uniform chance; each level weighs ``SMOOTH`` imagined counts.  Contexts never seen thereby fall back to
  the longest one that was.
* A URL's score is the sum of log(accepted / rejected) over its symbols, divided by their number.  The cut is
  calibrated on labelled URLs that were kept from training: the one with the least mean of both classes' error shares.

Counts are gathered over all URLs.  Log ratios are rounded to millionths once per gram, so that sums do not
depend on the order of rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule fits it, and the method judges
the text as it is (null: empty).  Repeated rows repeat.  Without labelled URLs every score is 0 and the URL is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import LOWER, UPPER
from ledgerlink.session import Workspace

# The rules and what they decide.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

EDGE, OTHER = "^", "~"
ORDER = 3
SYMBOLS = 32
SMOOTH = 2.0
CALIBRATE = "33"  # URLs whose SHA-256 in hex sorts before this, a fifth, calibrate and do not train
MILLION = 1_000_000
STEP = 10_000  # calibration bins, in millionths


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """The longest fitting rule, null if none fits."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(RULES, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def folded(url: Column) -> Column:
    """The URL in the 32 symbols, with edges."""
    s = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    s = F.regexp_replace(F.regexp_replace(s, r"[0-9]", "0"), r"[^a-z0/.\-]", OTHER)
    return F.concat(F.lit(EDGE * ORDER), s, F.lit(EDGE))


def grams(urls: DataFrame) -> DataFrame:
    """The rows with one gram each, in a column ``gram``; ``folded`` is dropped."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("folded") - ORDER))
    return urls.withColumn("at", at).withColumn("gram", F.substring("folded", F.col("at"), F.lit(ORDER + 1))).drop("folded", "at")


def model(ws: Workspace, urls: DataFrame) -> DataFrame:
    """gram, ratio (millionths) for every gram of the rows ``urls`` (folded, accepted; null if not to learn from)."""
    one = lambda c: F.sum(c.cast("long"))
    counts = ws.save(grams(urls).groupBy("gram").agg(F.coalesce(one(F.col("accepted")), F.lit(0)).alias("a"), F.coalesce(one(~F.col("accepted")), F.lit(0)).alias("r")), "grams")
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")).first()
    table = counts.select("gram")
    chance = {"a": F.lit(1.0 / SYMBOLS), "r": F.lit(1.0 / SYMBOLS)}
    for n in range(ORDER + 1):  # contexts of n symbols
        tail = F.substring("gram", ORDER + 1 - n, n + 1)
        seen = counts.groupBy(tail.alias("tail")).agg(F.sum("a").alias(f"a{n}"), F.sum("r").alias(f"r{n}"))
        table = table.withColumn("tail", tail).join(seen, "tail").drop("tail")
        if n:
            head = F.substring("gram", ORDER + 1 - n, n)
            after = counts.groupBy(head.alias("head")).agg(F.sum("a").alias(f"all_a{n}"), F.sum("r").alias(f"all_r{n}"))
            table = table.withColumn("head", head).join(after, "head").drop("head")
        for k in "ar":
            chance[k] = (F.col(f"{k}{n}") + F.lit(SMOOTH) * chance[k]) / ((F.col(f"all_{k}{n}") if n else F.lit(total[k])) + F.lit(SMOOTH))
    return ws.save(table.select("gram", F.round(F.log(chance["a"] / chance["r"]) * MILLION).cast("long").alias("ratio")), "model")


def scores(ws: Workspace, urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """key, total (millionths), n for distinct rows (key, folded)."""
    return ws.save(
        grams(urls).join(F.broadcast(ratios), "gram", "left").groupBy("key").agg(F.coalesce(F.sum("ratio"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")), "scores"
    )


def calibrated(labelled: DataFrame) -> int:
    """The cut in millionths, from rows (mean, accepted): the bin edge with the least mean error share; ties nearest to 0."""
    bins = labelled.groupBy(F.floor(F.col("mean") / STEP).alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    rows = sorted(map(tuple, bins.collect()))  # at most the range of a log ratio over STEP, a few thousand
    all_a, all_r = sum(a for _, a, _ in rows), sum(r for _, _, r in rows)
    if not all_a or not all_r:
        return 0
    best, lost, caught = None, 0, 0
    for edge in [b for b, _, _ in rows] + [rows[-1][0] + 1]:
        error = lost * all_r + (all_r - caught) * all_a
        best = min(best or (error, abs(edge), edge), (error, abs(edge), edge))
        for b, a, r in rows:
            if b == edge:
                lost, caught = lost + a, caught + r
    return best[2] * STEP


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (millionths per symbol), cut for each row."""
    ws = Workspace(pages.sparkSession)
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = parts(text)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), folded(text).alias("folded")).withColumn("rule", rule_of(F.col("host"), F.col("path")))
    verdict = F.create_map(*[F.lit(x) for pair in RULES for x in pair])[F.col("rule")]
    rows = rows.withColumn("verdict", verdict).withColumn("key", F.sha2(F.col("folded").cast("binary"), 256))
    fold = F.col("key") < CALIBRATE
    ratios = model(ws, rows.select("folded", F.when(~fold, F.col("verdict") == "allow").alias("accepted")))
    found = scores(ws, rows.select("key", "folded").distinct(), ratios)
    rows = rows.drop("folded").join(found, "key").withColumn("score", F.floor(F.col("total") / F.col("n")))
    cut = calibrated(rows.filter("rule is not null").filter(fold).select(F.col("score").alias("mean"), (F.col("verdict") == "allow").alias("accepted")))
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score", F.lit(cut).cast("long").alias("cut")
    )
