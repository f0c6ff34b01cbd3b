"""Fuzzy text ratios in SQL, for checking: longest common subsequences by bit masks.

A text of m characters is a number of m bits.  Reading the other text, each character's positions in the first one
(a mask) update that number by one addition and two logical operations; the zero bits left at the end count the
longest common subsequence.  Everything is a list expression, so a query needs no recursion.
"""

from __future__ import annotations


def _masks(p: str, t: str) -> str:
    """For each character of t, the bits of its positions in p."""
    place = f"CASE WHEN substr({p}, i, 1) = c THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END"
    return f"list_transform(string_split({t}, ''), lambda c: list_sum(list_transform(range(1, length({p}) + 1), lambda i: {place}))::HUGEINT)"


def _full(p: str) -> str:
    return f"((1::HUGEINT << length({p})::INTEGER) - 1)"


def _lcs(m: str, full: str, masks: str) -> str:
    return f"({m} - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, x: ((v + (v & x)) | (v - (v & x))) & {full})))"


def _indel(t: str, a: str, b: str, lcs: str) -> str:
    total = f"CAST(length({t}.{a}) + length({t}.{b}) AS DOUBLE)"
    return f"CASE WHEN {total} = 0 THEN 100.0::DOUBLE ELSE (1.0::DOUBLE - ({total} - 2.0::DOUBLE * {lcs}) / {total}) * 100.0::DOUBLE END"


def ratios(source: str, out: str = "fz") -> str:
    """Common table expressions that end in ``out`` (a, b, plain, sorted, part, sets) for the pairs ``source`` (a, b)."""
    x = f"{out}_"
    words = lambda c: f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
    line = lambda c: f"array_to_string(list_sort({c}), ' ')"
    every = lambda c: f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"
    lcs = lambda a, b: f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE {_lcs(f'length({a})', _full(a), _masks(a, b))} END"
    return f"""
{x}0 AS MATERIALIZED (SELECT DISTINCT a, b, {line(every('a'))} AS sa, {line(every('b'))} AS sb, {words('a')} AS wa, {words('b')} AS wb FROM {source}),
{x}1 AS MATERIALIZED (SELECT *, list_sort(list_filter(wa, lambda w: list_contains(wb, w))) AS shared,
    {line("list_filter(wa, lambda w: NOT list_contains(wb, w))")} AS ja, {line("list_filter(wb, lambda w: NOT list_contains(wa, w))")} AS jb FROM {x}0),
{x}2 AS MATERIALIZED (SELECT *, length(array_to_string(shared, ' ')) AS sect, CASE WHEN len(shared) > 0 THEN 1 ELSE 0 END AS glue,
    {lcs('a', 'b')} AS l_plain, {lcs('sa', 'sb')} AS l_sort, {lcs('ja', 'jb')} AS l_rest FROM {x}1),
{x}roles AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS p, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM {x}0
    UNION ALL SELECT a, b, b, a FROM {x}0 WHERE length(a) = length(b)),
{x}open AS MATERIALIZED (SELECT a, b, length(p) AS m, length(t) AS n, {_full('p')} AS f, {_masks('p', 't')} AS mk FROM {x}roles WHERE p <> '' AND NOT contains(t, p)),
{x}win AS (SELECT a, b, m, f, unnest(list_transform(range(1 - m, n), lambda k: mk[greatest(k, 0) + 1:least(k + m, n)])) AS w FROM {x}open),
{x}part AS MATERIALIZED (SELECT a, b, max(2.0::DOUBLE * {_lcs('m', 'f', 'w')} / (m + len(w))) AS r FROM {x}win GROUP BY a, b),
{out} AS MATERIALIZED (SELECT a, b, {_indel('z', 'a', 'b', 'l_plain')} AS plain, {_indel('z', 'sa', 'sb', 'l_sort')} AS sorted,
    CASE WHEN a = b THEN 100.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * p.r END AS part,
    CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE WHEN len(shared) > 0 AND (ja = '' OR jb = '') THEN 100.0::DOUBLE
      ELSE greatest(CASE WHEN sect > 0 THEN greatest(100.0::DOUBLE - 100.0::DOUBLE * (glue + length(ja)) / (sect + sect + glue + length(ja)), 100.0::DOUBLE - 100.0::DOUBLE * (glue + length(jb)) / (sect + sect + glue + length(jb))) ELSE 0.0::DOUBLE END,
        100.0::DOUBLE - 100.0::DOUBLE * (length(ja) + length(jb) - 2.0::DOUBLE * l_rest) / (2 * (sect + glue) + length(ja) + length(jb))) END AS sets
  FROM {x}2 z LEFT JOIN {x}part p USING (a, b))"""
