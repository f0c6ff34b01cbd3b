"""Checks a finished run, transaction by transaction, taking the engine's own group claims as given.

A claim is a split or batch match: its leader is the transaction that carries the row, its members are out of reach
for every later transaction (larger amounts come first, then earlier days, then smaller ids).  Given the claims of
earlier leaders, each row can be judged alone: its pair must be the best of all pairs in reach, its group the best of
all groups in reach, and no better one may have been possible.  Groups are found by trying every subset, so inputs
are small.  Rows are dicts; money is Decimal.
"""

from __future__ import annotations

import math
import re
from collections import namedtuple
from decimal import ROUND_HALF_EVEN, Decimal
from functools import cached_property
from itertools import chain, combinations

from ledgerlink.functions.scalars import CHANNEL_PREFIXES, SPLIT_WORDS, STOP_GROUPS, STOP_RULES
from ledgerlink.operators.linkage import PRIORS
from plain_text import partial, ratio, set_ratio, sort_ratio

TOLERANCE = 2  # rupees
GROUP_KINDS = ("split_many_to_one", "batch_one_to_many")
Outcome = namedtuple("Outcome", "kind band category score txns invoices")
Group = namedtuple("Group", "kind txns invoices bonus human")
Choice = namedtuple("Choice", "members preferred")


def upper(x):
    return (x or "").strip().upper()


def close(a, b):
    return abs(a - b) <= TOLERANCE


def consistent(text, name):
    """STR-8: the text names the counterparty in full, by a telling word, or fuzzily."""
    text, name = upper(text), upper(name)
    telling = [w for w in (x.strip(",.-/'\"") for x in name.split()) if len(w) >= 4 and w not in STOP_GROUPS]
    return bool(text and name) and (name in text or any(w in text for w in telling) or set_ratio(name, text) >= 70)


class Pair:
    """What a transaction and an invoice have to do with each other."""

    def __init__(self, txn, invoice):
        self.txn, self.invoice = txn, invoice
        self.text, self.name = txn["narration"].upper(), invoice["counterparty_name"].upper()
        self.refs = upper(txn["reference_number"]), upper(invoice["reference_number"])
        self.amount, self.net, self.gross = txn["amount"], invoice["expected_net_amount"], invoice["total_amount"]
        self.tds = invoice["tds_amount"] or Decimal(0)
        self.gap = abs((txn["txn_date"] - invoice["invoice_date"]).days)

    @cached_property
    def rule_points(self):
        """Points per signal: the first line that applies."""
        a, b = self.refs
        name = self.name.strip()
        heads = [w[:4] for w in name.split() if len(w) >= 4 and w not in STOP_RULES]
        after_fee = (self.net * Decimal("0.9764")).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
        table = {
            "reference": [(40, a and a == b), (20, min(len(a), len(b)) >= 6 and (a[: len(b)] == b or b[: len(a)] == a)), (35, upper(self.invoice["invoice_id"]) in self.text)],
            "amount": [(45, close(self.amount, self.net)), (35, close(self.amount, self.gross))],
            "formula": [(25, self.tds > 0 and close(self.amount, self.gross - self.tds)), (22, self.txn["channel"] == "UPI" and close(self.amount, after_fee))],
            "date": [(p, self.gap <= d) for p, d in ((20, 3), (15, 7), (10, 30), (5, 60))],
            "name": [(35, name and name in self.text), (15, any(h in self.text for h in heads))],
        }
        return {k: next((float(p) for p, applies in lines if applies), 0.0) for k, lines in table.items()}

    @property
    def by_rules(self):
        return min(100.0, sum(self.rule_points.values()))

    @property
    def money_agrees(self):
        return self.rule_points["amount"] + self.rule_points["formula"] > 0

    @cached_property
    def fuzzy_points(self):
        """(name, amount or None, date)."""
        prefix = next((x for x in CHANNEL_PREFIXES if self.text.startswith(x)), "")
        text = self.text[len(prefix) :]
        r = max(sort_ratio(self.name, text), partial(self.name, text))
        off = float(abs(self.amount - self.net) / self.net)
        bell = lambda x, width: math.exp(-((x / width) ** 2) / 2)
        return (
            round(18.0 * (r - 40) / 60, 2) if r >= 40 else 0.0,
            round(12 * bell(off, 0.1), 2) if off <= 0.30 else None,
            round(10 * bell(self.gap, 15.0), 2) if self.gap <= 60 else 0.0,
        )

    @property
    def with_fuzzy(self):
        return min(100.0, self.by_rules + sum(x or 0.0 for x in self.fuzzy_points))

    @property
    def evidence(self):
        """Linkage score from the eight fields' agreement; a field that cannot be compared has no say."""
        a, b = self.txn["reference_number"], self.invoice["reference_number"]
        exact = close(self.amount, self.net)
        gst = sum(self.invoice[x] or Decimal(0) for x in ("cgst_amount", "sgst_amount", "igst_amount"))
        likeness = max(partial(self.name, self.text), set_ratio(self.name, self.text))
        agrees = {
            "reference_number": upper(a) == upper(b) if a and b else None,
            "amount_exact": exact,
            "amount_tds": exact if self.tds > 0 else None,
            "amount_gst": close(self.amount, self.gross) if gst > 0 else None,
            "name_strong": likeness >= 85,
            "name_weak": likeness >= 60,
            "date_close": self.gap <= 7,
            "date_window": self.gap <= 60,
        }
        weight = sum(math.log(m / u) if agrees[f] else math.log((1 - m) / (1 - u)) for f, m, u in PRIORS if agrees[f] is not None)
        return round(100 / (1 + math.exp(-max(-20.0, min(20.0, weight / 2)))), 2)


def best_subset(amounts, target, gaps, names_ok):
    """The preferred subset of two or more that meets the target: named members only if there is one, then few, then near in time."""
    n = range(len(amounts))
    meets = [c for c in chain.from_iterable(combinations(n, k) for k in n[2:] or []) if abs(sum(amounts[x] for x in c) - target) <= TOLERANCE]
    if len(amounts) >= 2 and abs(sum(amounts) - target) <= TOLERANCE:
        meets.append(tuple(n))
    named = [c for c in meets if all(names_ok[x] for x in c)]
    pool = named or meets
    return Choice(min(pool, key=lambda c: (len(c), max(gaps[x] for x in c), c)), len(pool)) if pool else None


class Checker:
    def __init__(self, txns, invoices, claims, pool_max=16):
        """claims: leader id -> (member txn ids, invoice ids)."""
        self.txns, self.invoices, self.pool_max = txns, invoices, pool_max
        self.order = sorted(txns, key=lambda t: (-t["amount"], t["txn_date"], t["txn_id"]))
        self.place = {t["txn_id"]: k for k, t in enumerate(self.order)}
        self.claims = claims

    def gone(self, txn):
        """(transactions, invoices) that leaders before this transaction have claimed."""
        before = [c for leader, c in self.claims.items() if self.place[leader] < self.place[txn["txn_id"]]]
        return {t for ts, _ in before for t in ts}, {i for _, inv in before for i in inv}

    def has_row(self, txn):
        return txn["txn_id"] not in self.gone(txn)[0]

    def pairs(self, txn):
        """Pairs in reach, nearest first."""
        taken = self.gone(txn)[1]
        near = [i for i in self.invoices if i["status"] == "open" and i["invoice_id"] not in taken and -7 <= (txn["txn_date"] - i["invoice_date"]).days <= 60]
        return sorted((Pair(txn, i) for i in near), key=lambda p: p.gap)

    def copy_of_earlier(self, txn):
        said = txn["narration"].upper()
        mentions_part = lambda s: any(w in s for w in SPLIT_WORDS)
        when = lambda x: (x["txn_date"], x["txn_id"])
        return not mentions_part(said) and any(
            when(o) < when(txn)
            and (o["direction"], o["amount"]) == (txn["direction"], txn["amount"])
            and (txn["txn_date"] - o["txn_date"]).days <= 3
            and not mentions_part(o["narration"].upper())
            and max(ratio(said, o["narration"].upper()), set_ratio(said, o["narration"].upper())) >= 85
            for o in self.txns
        )

    def exclusion(self, txn):
        tests = {
            "debit_transaction": lambda: txn["direction"] == "debit",
            "noise_below_floor": lambda: txn["amount"] <= 10 or ("INTEREST" in txn["narration"].upper() and txn["amount"] < 100),
            "duplicate_detected": lambda: self.copy_of_earlier(txn),
            "no_candidate_found": lambda: not self.pairs(txn),
        }
        return next((name for name, test in tests.items() if test()), None)

    def ranking(self, txn):
        """([(score, pair)] best first, whether the best is the rules' leader and they alone settle it)."""
        first = sorted(self.pairs(txn), key=lambda p: -p.by_rules)
        settled = first[0].by_rules >= 55 and first[0].money_agrees
        scored = [(p.by_rules if settled and p is first[0] else p.with_fuzzy, p) for p in first]
        ranked = sorted(scored, key=lambda x: -x[0])
        return ranked, settled and ranked[0][1] is first[0]

    def batch(self, txn, pairs):
        """(best batch or None, whether the pool was too large to search)."""
        named = re.findall(r"\bINV-\d+\b", txn["narration"].upper())
        wanted = [p for p in pairs if (upper(p.invoice["invoice_id"]) in named if named else consistent(p.text, p.name))] or pairs
        if len(wanted) > self.pool_max:
            return None, True
        got = best_subset([p.net for p in wanted], txn["amount"], [p.gap for p in wanted], [consistent(p.text, p.name) for p in wanted])
        return got and Group("batch_one_to_many", [txn["txn_id"]], [wanted[k].invoice["invoice_id"] for k in got.members], 45 if got.preferred == 1 else 25, False), False

    def split_pool(self, txn, invoice):
        taken = self.gone(txn)[0]
        credits = [u for u in self.order if u["direction"] == "credit" and u["txn_id"] not in taken]
        number = upper(invoice["invoice_id"])

        def about(u):
            named = re.findall(r"\bINV-\d+\b", u["narration"].upper())
            return number in named if named else consistent(u["narration"], invoice["counterparty_name"])

        return [u for u in credits if about(u)] or credits

    def splits(self, txn, pairs):
        """For each pair: a split, a partial payment, ``large`` (pool not searched), or None."""
        me = txn["txn_id"]
        for p in pairs:
            pool = self.split_pool(txn, p.invoice)
            if len(pool) > self.pool_max:
                yield "large"
                continue
            ok = [consistent(u["narration"], p.name) for u in pool]
            got = best_subset([u["amount"] for u in pool], p.net, [Pair(u, p.invoice).gap for u in pool], ok)
            number = [p.invoice["invoice_id"]]
            if got:
                members = [pool[k]["txn_id"] for k in got.members]
                yield Group("split_many_to_one", members, number, 45 if got.preferred == 1 else 25, len(members) > 2) if me in members else None
            else:
                below = [u for u, k in zip(pool, ok) if k and u["amount"] < p.net]
                largest = max(below, key=lambda u: u["amount"], default=None)
                yield Group("partial", [me], number, 25, False) if largest and largest["txn_id"] == me else None

    def group(self, txn, pairs):
        """(group or None, whether a pool too large to search leaves the row to a human)."""
        batch, large = self.batch(txn, pairs)
        if batch:
            return batch, False
        seen = list(self.splits(txn, pairs))
        split = next((g for g in seen if isinstance(g, Group) and g.kind == "split_many_to_one"), None)
        second = next((g for g in seen if g == "large" or isinstance(g, Group) and g.kind == "partial"), None)
        found = split or (second if isinstance(second, Group) else None)
        return found, found is None and (large or second == "large")

    def expected(self, txn):
        """The row this transaction must have, and its pairs' scores."""
        out = self.exclusion(txn)
        if out:
            return Outcome("exception", "reject", out, 0.0, {txn["txn_id"]}, set()), {}
        ranked, settled = self.ranking(txn)
        (score, top), runner_up = ranked[0], ranked[1][0] if len(ranked) > 1 else None
        group, unsure = (None, False) if settled else self.group(txn, self.pairs(txn))
        if group:
            if top.invoice["invoice_id"] not in group.invoices:
                top = Pair(txn, next(i for i in self.invoices if i["invoice_id"] == group.invoices[0]))
            score = min(100.0, score + group.bonus)
        contested = runner_up is not None and score - runner_up < 15
        final = max(0.0, min(100.0, 0.6 * score + 0.4 * top.evidence))
        human = unsure or contested or bool(group and group.human)
        band = "reject" if final < 50 else "review" if final < 85 or human else "auto_accept"
        whole = group is not None and group.kind in GROUP_KINDS
        return (
            Outcome(
                group.kind if group else "one_to_one",
                band,
                "low_confidence_match" if band == "reject" else None,
                round(final, 2),
                set(group.txns) if whole else {txn["txn_id"]},
                set(group.invoices) if whole else {top.invoice["invoice_id"]},
            ),
            {p.invoice["invoice_id"]: s for s, p in ranked},
        )


def best_assignment_weight(edges, txns, invoices, floor=30.0):
    """Largest total weight of a one-to-one choice, over sets of used invoices."""
    best = {frozenset(): 0}
    for t in sorted(txns):
        offers = [(i, round(edges[t, i] * 100)) for i in invoices if edges.get((t, i), 0) >= floor]
        new = dict(best)
        for used, w in best.items():
            for i, more in offers:
                if i not in used and new.get(used | {i}, -1) < w + more:
                    new[used | {i}] = w + more
        best = new
    return max(best.values())
