"""URL rules, scores and the cut against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

from ledgerlink.llm import url_filter as uf


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain(urls):
    rows = []
    for u in urls:
        u = u or ""
        rest = u.partition("://")[2]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
        fits = [r for r, _ in uf.RULES for n, p in [(r.split("/")[0], "/" + r.partition("/")[2])] if (host == n or host.endswith("." + n)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        fold = "^^^" + re.sub(r"[^a-z0/.\-]", "~", re.sub("[0-9]", "0", lower(u))) + "^"
        rows.append((host, path, rule, dict(uf.RULES).get(rule), fold, hashlib.sha256(fold.encode()).hexdigest()))
    counts = {"allow": Counter(), "block": Counter()}
    for *_, said, fold, key in rows:
        if said and not key < uf.CALIBRATE:
            for i in range(3, len(fold)):
                for n in range(4):
                    counts[said][n, fold[i - n : i + 1]] += 1
                    counts[said]["after", n, fold[i - n : i]] += 1

    def chance(said, gram):
        p = 1 / 32
        for n in range(4):
            p = (counts[said][n, gram[3 - n :]] + uf.SMOOTH * p) / (counts[said]["after", n, gram[3 - n : 3]] + uf.SMOOTH)
        return p

    out = []
    for host, path, rule, said, fold, key in rows:
        grams = [fold[i : i + 4] for i in range(len(fold) - 3)]
        total = sum(round(math.log(chance("allow", g) / chance("block", g)) * 1e6) for g in grams)
        out.append([host, path, rule, said, math.floor(total / len(grams)), key])
    held = [(s // uf.STEP, said) for _, _, rule, said, s, key in out if rule and key < uf.CALIBRATE]
    good, bad = [b for b, x in held if x == "allow"], [b for b, x in held if x == "block"]
    edges = [b for b, _ in held] + [max((b for b, _ in held), default=0) + 1]
    cut = min(((sum(b < e for b in good) * len(bad) + sum(b >= e for b in bad) * len(good)), abs(e), e) for e in edges)[2] * uf.STEP if good and bad else 0
    return [(h, p, r, said or ("allow" if s >= cut else "block"), s, cut) for h, p, r, said, s, _ in out]


def urls():
    rng = random.Random(9)
    out = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.net?x", "ftp://x.Example.NET/en/1://y", "http://example.com/de", "http://example.com/de/x#y", "http://notexample.com/de/", "http://ÉX.org/fr/a", "http://a.b\nc.org/fr/\nz"]
    for _ in range(300):
        out.append(f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'm.', '', 'spam-'])}{rng.choice(['alpha', 'beta', 'cheap'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(999)}{rng.choice(['', '?q=1', '#t', '.html'])}")
    return out + out[:40] + ["http://x.org/" + "ab-" * 5000]


def test_whole_operator_equals_plain_python(spark):
    rows = [(i if i else None, u, "h", 1) for i, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score int")
    got = sorted(map(tuple, uf.judge(pages).collect()), key=repr)
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]))), key=repr)
    assert {g[4] for g in got if g[3] is None} == {"allow", "block"}


def test_without_labels_everything_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert {(r.verdict, r.score, r.cut) for r in uf.judge(pages).collect()} == {("allow", 0, 0)}
    assert uf.judge(pages.limit(0)).count() == 0
