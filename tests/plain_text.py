"""Text ratios by definition, for tests: longest common subsequence by rows."""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    n = len(a) + len(b)
    return 100.0 if n == 0 else (1.0 - (n - 2.0 * lcs(a, b)) / n) * 100.0


def sort_ratio(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    roles = {(a, b), (b, a)} if len(a) == len(b) else {tuple(sorted((a, b), key=len))}
    return max(ratio(s, t[max(0, k) : k + len(s)]) for s, t in roles for k in range(1 - len(s), len(t)))


def set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and both in (x, y):
        return 100.0
    rest = [" ".join(sorted(w - both)) for w in (x, y)]
    core = " ".join(sorted(both))
    full = [f"{core} {r}" if core else r for r in rest]
    found = [100.0 - 100.0 * (len(rest[0]) + len(rest[1]) - 2 * lcs(*rest)) / (len(full[0]) + len(full[1]))]
    if core:
        found += [100.0 - 100.0 * (len(f) - len(core)) / (len(f) + len(core)) for f in full]
    return max(found)
