"""The best pair of each transaction by pass 1, found without making all candidate pairs (FLT-6, JN-1, SCO-1..6, WIN-1).

Apart from the date, a pair's points come from three signals that rows can name beforehand: the amounts they agree on, the
name or the head of a name that the narration holds, and the reference.  Each row lists its terms of each signal, the empty
term included; every combination of terms is a key.  Of the invoices under a key a transaction needs only the nearest day's
first one: it has at least the points of the key, and no other under that key is nearer.  The best pair is the nearest of
the key of its own signals, so the best over a transaction's keys is the best of all its pairs.

A reference that few invoices of a merchant have makes no key: its pairs are made and scored at once.  The points they give are a
bound, and keys that stay below it with the nearest day's points, too, are not looked up.

Both sides of these joins grow with the input, so they are sorted and merged, not broadcast.

Pairs whose narration names the invoice, and rows with an amount of zero or less, for which the amount window may exclude
pairs, are few; they are compared as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlink.functions import scalars as fx
from ledgerlink.operators import scoring
from ledgerlink.operators.candidates import CELL, amount_window, candidate_pairs, in_window, pairs_near_reference, plain_invoice, plain_txn
from ledgerlink.params import DEFAULT, Params
from ledgerlink.session import Workspace

TERM = "array<struct<term:string,points:double>>"
AMOUNTS = ["net_p", "total_p", "tds_p", "gateway_p"]
KEY = ["_k1", "_k2"]
RARE = 4  # invoices of one reference that are compared as pairs
MOST_DATE_POINTS = 20.0


def _term(kind: str, value: Column, points: float) -> Column:
    return F.struct(F.concat(F.lit(kind), value).alias("term"), F.lit(float(points)).alias("points"))


def _no_term() -> Column:
    return F.array(_term("", F.lit(""), 0.0))


def _options(hits: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, and an array of the terms (term, points) of each value; as many as its text is long."""
    return hits.groupBy(*by).agg(F.collect_list(F.struct("term", "points")).alias(name))


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """CELL, narr, kind, val: which names (CELL, kind, val) each text (CELL, narr) holds.

    A place of the text that begins like some name is read in the lengths of the names that begin so.
    """
    head = fx.MIN_TOKEN
    starts = names.where(F.length("val") >= head).select(*CELL, F.substring("val", 1, head).alias("gram"), "kind", F.length("val").alias("len")).distinct()
    places = texts.where(F.length("narr") >= head).select(*CELL, "narr", F.explode(F.sequence(F.lit(1), F.length("narr") - head + 1)).alias("at"))
    read = (
        places.withColumn("gram", F.substr("narr", F.col("at"), F.lit(head))).join(starts, [*CELL, "gram"])
        .select(*CELL, "narr", "kind", F.substr("narr", F.col("at"), F.col("len")).alias("val"))
    )
    long_ = read.distinct().join(names.hint("merge"), [*CELL, "kind", "val"], "left_semi")
    short = texts.join(names.where(F.length("val") < head), CELL).where(F.col("narr").contains(F.col("val")))
    return long_.unionByName(short.select(*long_.columns))


def reference_pairs(t: DataFrame, i: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """SCO-1: the candidate pairs with s_ref above 0, met by their references or by the invoice that the narration names."""
    due = i.where("status = 'open' and inv_u != ''")
    names = due.select(*CELL, F.lit("n").alias("kind"), F.col("inv_u").alias("val")).distinct()
    held = contained(t.select(*CELL, "narr").distinct(), names).select(*CELL, "narr", F.col("val").alias("_key"))
    naming = t.join(held.hint("merge"), [*CELL, "narr"])
    by_ref = pairs_near_reference(t, i, params)
    by_name = candidate_pairs(naming, due.withColumn("_key", F.col("inv_u")), params, also=["_key"]).drop("_key")
    ref = F.coalesce(fx.ref_points(F.col("t_ref"), F.col("i_ref")), F.lit(0.0))
    points = lambda pairs: pairs.withColumn("_ref", ref)
    both = points(by_ref).where("_ref > 0").withColumn("s_ref", F.col("_ref")).unionByName(points(by_name).where("_ref = 0").withColumn("s_ref", F.lit(35.0)))
    return both.drop("_ref")


def rare_references(i: DataFrame) -> DataFrame:
    """CELL, i_ref that at most ``RARE`` invoices have."""
    return i.where("i_ref is not null").groupBy(*CELL, "i_ref").agg(F.count("*").alias("_n")).where(F.col("_n") <= RARE).drop("_n")


def shared_references(t: DataFrame, i: DataFrame, rare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of references that meet, for (CELL, t_ref) and (CELL, i_ref): equal ones that are not rare, and one a proper prefix of the other."""

    def known(df: DataFrame, ref: str) -> DataFrame:
        return df.where(F.col(ref).isNotNull()).select(*CELL, ref).distinct()

    def lengths(refs: DataFrame, ref: str) -> DataFrame:
        return refs.select(*CELL, F.length(ref).alias("len")).where(F.col("len") >= fx.PREFIX_MIN).groupBy(*CELL).agg(F.collect_set("len").alias("lens"))

    def terms(refs: DataFrame, ref: str, own: str, cut: str, other: DataFrame) -> DataFrame:
        whole = F.array(_term(own, F.col(ref), 20.0))
        whole = F.when(F.col("_rare"), whole).otherwise(F.array_append(whole, _term("e", F.col(ref), 40.0)))
        cuts = F.transform(F.filter(F.coalesce("lens", F.array()), lambda n: n < F.length(ref)), lambda n: _term(cut, F.substr(ref, F.lit(1), n), 20.0))
        return refs.join(other, CELL, "left").select(*CELL, ref, F.inline(F.concat(whole, cuts)))

    tr, ir = known(t, "t_ref").withColumn("_rare", F.lit(False)), known(i, "i_ref")
    ir = ir.join(rare.withColumn("_rare", F.lit(True)).hint("merge"), [*CELL, "i_ref"], "left").withColumn("_rare", F.coalesce("_rare", F.lit(False)))
    # "a": the transaction's reference begins the invoice's; "b": the other way round.
    tt, it = terms(tr, "t_ref", "a", "b", lengths(ir, "i_ref")), terms(ir, "i_ref", "b", "a", lengths(tr, "t_ref"))
    meets = lambda df, other: df.join(other.select(*CELL, "term").distinct().hint("merge"), [*CELL, "term"], "left_semi")
    return meets(tt, it), meets(it, tt)


def shared_amounts(t: DataFrame, i: DataFrame, params: Params) -> DataFrame:
    """CELL, amount_p, channel and the amounts of invoices that give points with them."""
    width = max(params.tolerance_paise, params.formula_tolerance_paise) + 1
    place = lambda c: F.floor(c / width)
    paid = t.select(*CELL, "amount_p", F.when(F.col("channel") == "UPI", "UPI").otherwise("").alias("channel")).distinct()
    owed = i.select(*CELL, *AMOUNTS).distinct()
    left = paid.withColumn("_at", F.explode(F.sequence(place(F.col("amount_p") - width), place(F.col("amount_p") + width))))
    values = F.array_distinct(F.transform(F.array("net_p", "total_p", F.col("total_p") - F.col("tds_p"), "gateway_p"), place))
    right = owed.withColumn("_at", F.explode(values))
    met = left.join(right.hint("merge"), [*CELL, "_at"]).drop("_at").distinct()
    return scoring.with_amount_points(met, params).withColumn("points", F.col("s_amount") + F.col("s_formula")).where("points > 0").select(*paid.columns, *AMOUNTS, "points")


def _amount_term() -> Column:
    return F.concat_ws("|", *AMOUNTS)


def _keyed(df: DataFrame) -> DataFrame:
    """The key of a combination of terms: 128 bits."""
    parts = [*CELL, "_a", "_n", "_r"]
    return df.withColumn("_k1", F.xxhash64(*parts)).withColumn("_k2", F.xxhash64(F.lit(7), *reversed(parts)))


def nearest(days: DataFrame, offers: DataFrame, params: Params) -> DataFrame:
    """KEY, day, and the nearest offer (_first) in the window of each day; ``offers`` has KEY, day, _first, one row a day."""
    none = F.lit(None).cast(offers.schema["_first"].dataType)
    both = days.withColumn("_first", none).withColumn("_asks", F.lit(True)).unionByName(offers.withColumn("_asks", F.lit(False)))
    seen = F.when(~F.col("_asks"), F.struct("day", "_first"))
    by = Window.partitionBy(*KEY)
    until = by.orderBy("day", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    since = by.orderBy(F.desc("day"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.last(seen, True).over(until)).withColumn("_after", F.last(seen, True).over(since)).where("_asks")

    def side(c: str, most: int) -> Column:
        gap = fx.day_gap(F.col("day"), F.col(f"{c}.day"))
        return F.when(gap <= most, F.struct(gap.alias("gap"), F.col(f"{c}._first.row_idx").alias("row_idx"), F.col(f"{c}._first.invoice_id").alias("invoice_id")))

    found = F.array_min(F.array_compact(F.array(side("_before", params.window_back_days), side("_after", params.window_forward_days))))
    return both.select(*KEY, "day", found.alias("_hit")).where(F.col("_hit").isNotNull())


def best_by_rules(txns: DataFrame, invoices: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The rows of ``top_by_rules(rule_points(candidate_pairs(txns, invoices)))``."""
    ws = Workspace(txns.sparkSession)
    txns = ws.save(txns, "search-txns")
    due = ws.save(invoices.where("status = 'open'"), "search-invoices")
    t, i = txns.where(plain_txn()), due.where(plain_invoice())
    t_key, i_key = scoring.TXN, [*CELL, "invoice_id"]

    names = i.select(*CELL, F.explode(F.concat(
        F.array(F.struct(F.lit("c").alias("kind"), F.col("cp").alias("val")), F.struct(F.lit("n").alias("kind"), F.col("inv_u").alias("val"))),
        F.transform("heads", lambda h: F.struct(F.lit("h").alias("kind"), h.alias("val"))),
    )).alias("_x")).select(*CELL, "_x.*").where("val != ''").distinct()
    held = ws.save(contained(t.select(*CELL, "narr").distinct(), ws.save(names, "names")), "held")
    n_terms = held.where("kind != 'n'").select(*CELL, "narr", F.concat("kind", "val").alias("term"), F.when(F.col("kind") == "c", 35.0).otherwise(15.0).alias("points"))
    rare = ws.save(rare_references(i), "rare")
    t_refs, i_refs = shared_references(t, i, rare)
    gap = fx.day_gap(F.col("txn_date"), F.col("invoice_date"))
    by_ref = i.join(rare.hint("merge"), [*CELL, "i_ref"]).withColumn("t_ref", F.col("i_ref"))
    direct = t.join(by_ref.hint("merge"), [*CELL, "t_ref"]).where(in_window(params) & amount_window()).withColumn("gap", gap)
    direct = ws.save(scoring.rule_points(direct, params).select(*t_key, "invoice_id", "p1"), "direct")
    least = direct.groupBy(*t_key).agg(F.max("p1").alias("_least"))
    sums = ws.save(shared_amounts(t, i, params), "amounts")

    # Invoices under their keys: the first one of each day.
    wanted = sums.select(*CELL, *AMOUNTS).distinct().withColumn("_hit", F.lit(True))
    rows = i.select(*CELL, "invoice_id", "row_idx", "invoice_date", "cp", "heads", "i_ref", *AMOUNTS)
    rows = rows.join(wanted.hint("merge"), [*CELL, *AMOUNTS], "left").join(_options(i_refs, [*CELL, "i_ref"], "_rs").hint("merge"), [*CELL, "i_ref"], "left")
    own = F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.col("cp") != "", F.array(F.concat(F.lit("c"), "cp"))).otherwise(F.array().cast("array<string>")), F.transform("heads", lambda h: F.concat(F.lit("h"), h))))
    rows = rows.withColumn("_a", F.explode(F.when(F.col("_hit"), F.array(F.lit(""), _amount_term())).otherwise(F.array(F.lit("")))))
    rows = rows.withColumn("_n", F.explode(own)).withColumn("_r", F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.col("_rs.term"), F.array().cast("array<string>")))))
    offers = _keyed(rows).groupBy(*KEY, F.col("invoice_date").alias("day")).agg(F.min(F.struct("row_idx", "invoice_id")).alias("_first")).where("day is not null")

    # Transactions under theirs, with the points that each key gives.
    asks = t.select(*t_key, F.col("txn_date").alias("day"), "narr", "t_ref", "amount_p", F.when(F.col("channel") == "UPI", "UPI").otherwise("").alias("channel"))
    none = F.array().cast(TERM)
    asks = asks.join(_options(n_terms, [*CELL, "narr"], "_ns").hint("merge"), [*CELL, "narr"], "left").join(_options(t_refs, [*CELL, "t_ref"], "_rs").hint("merge"), [*CELL, "t_ref"], "left")
    s = sums.select(*CELL, "amount_p", "channel", _amount_term().alias("term"), "points")
    asks = asks.join(least.hint("merge"), t_key, "left").select(*t_key, "day", "_ns", "_rs", "amount_p", "channel", "_least")
    asks = asks.withColumn("_a", F.lit("")).withColumn("_pa", F.lit(0.0)).unionByName(
        asks.join(s.hint("merge"), [*CELL, "amount_p", "channel"]).withColumnsRenamed({"term": "_a", "points": "_pa"})
    )
    asks = asks.withColumn("_x", F.explode(F.concat(_no_term(), F.coalesce("_ns", none)))).withColumn("_y", F.explode(F.concat(_no_term(), F.coalesce("_rs", none))))
    asks = asks.withColumn("_n", F.col("_x.term")).withColumn("_r", F.col("_y.term")).withColumn("_points", F.col("_pa") + F.col("_x.points") + F.col("_y.points"))
    asks = asks.where(F.col("_least").isNull() | (F.least(F.lit(100.0), F.col("_points") + MOST_DATE_POINTS) >= F.col("_least")))
    asks = ws.save(_keyed(asks).select(*t_key, *KEY, "day", "_points"), "asks")

    met = asks.join(nearest(asks.select(*KEY, "day").distinct(), offers, params).hint("merge"), [*KEY, "day"])
    low = F.least(F.lit(100.0), F.col("_points") + scoring.date_points(F.col("_hit.gap")))
    best = met.groupBy(*t_key).agg(F.min(F.struct((-low).alias("neg"), "_hit")).alias("_best")).select(*t_key, F.col("_best._hit.invoice_id").alias("invoice_id"))

    named = held.where("kind = 'n'").join(t.select(*t_key, "narr").hint("merge"), [*CELL, "narr"]).join(i.select(*i_key, F.col("inv_u").alias("val")).hint("merge"), [*CELL, "val"]).select(*t_key, "invoice_id")
    few = best.unionByName(named).unionByName(direct.drop("p1")).distinct()
    pairs = few.join(t.hint("merge"), t_key).join(i.hint("merge"), i_key).where(in_window(params) & amount_window()).withColumn("gap", gap)
    odd_t, odd_i = txns.where(~plain_txn()), due.where(~plain_invoice())
    if not odd_t.isEmpty():
        pairs = pairs.unionByName(candidate_pairs(odd_t, due, params))
    if not odd_i.isEmpty():
        pairs = pairs.unionByName(candidate_pairs(t, odd_i, params))
    return scoring.top_by_rules(scoring.rule_points(pairs, params), params)
