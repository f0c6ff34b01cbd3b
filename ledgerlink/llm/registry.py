"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm import language_id, phrase_automata, secret_scan, term_pipeline, toxicity, url_filter
from ledgerlink.llm.base import LOWER, UPPER, table
from ledgerlink.llm.digests import encoding_digests, piece_digests
from ledgerlink.llm.exact_dedup import exact_groups
from ledgerlink.llm.packing import pack
from ledgerlink.llm.periodic_runs import periodic_runs
from ledgerlink.llm.simhash_dedup import near_groups
from ledgerlink.llm.suffix_dedup import dedup
from ledgerlink.llm.topk_search import search
from ledgerlink.llm.url_filter import judge
from ledgerlink.llm.word_bpe import compile_lexicon, encode


def op1_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op2_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack(table(spark, sf_dir, "documents")))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op5_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encoding_digests(encode(docs, lexicon=compile_lexicon(docs)))


def op8_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.find_spans(table(spark, sf_dir, "documents")))


def op10_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def rotated(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Every tenth document repeats a part of itself to its end, by the crc32 of its id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=rotated)
    best = F.reduce("runs", F.element_at("runs", 1), lambda top, r: F.when(r["length"] > top["length"], r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return phrase_automata.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", length.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_markov": op1_url_markov,
    "op2_suffix_radix": op2_suffix_radix,
    "op3_binary_packing": op3_binary_packing,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_simhash_bk": op5_simhash_bk,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe_lexicon": op7_bpe_lexicon,
    "op8_toxicity_pu": op8_toxicity_pu,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_ecoc": op10_language_ecoc,
    "op11_recompression": op11_recompression,
    "op12_phrase_automata": op12_phrase_automata,
    "op13_term_pipeline": op13_term_pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _op1_sql() -> str:
    """The URL filter in SQL: rules, gram counts, mixed chances, calibration and verdicts."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    fits = []
    for rule, verdict in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        name, slash, start = rule.partition("/")
        fits.append((rule, verdict, f"(host = {q(name)} OR ends_with(host, {q('.' + name)})) AND starts_with(path, {q(slash + start)})"))
    rule = "CASE " + " ".join(f"WHEN {c} THEN {q(r)}" for r, _, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = {q(r)} THEN {q(v)}" for r, v, _ in fits) + " END"
    order, smooth = url_filter.ORDER, url_filter.SMOOTH
    joins, chance = [], {k: f"1.0::DOUBLE / {url_filter.SYMBOLS}" for k in "ar"}
    for n in range(order + 1):
        joins.append(f"JOIN (SELECT substring(gram, {order + 1 - n}, {n + 1}) AS x, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1) t{n} ON substring(c.gram, {order + 1 - n}, {n + 1}) = t{n}.x")
        joins.append(f"JOIN (SELECT substring(gram, {order + 1 - n}, {n}) AS x, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1) h{n} ON substring(c.gram, {order + 1 - n}, {n}) = h{n}.x")
        chance = {k: f"((t{n}.{k}::DOUBLE + {smooth} * ({chance[k]})) / (h{n}.{k}::DOUBLE + {smooth}))" for k in "ar"}
    return f"""
        WITH raw AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
        cut1 AS (SELECT *, CASE WHEN strpos(u, '://') > 0 THEN substring(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM raw),
        hosts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                         '^^^' || regexp_replace(regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '[^a-z0/.\\-]', '~', 'g') || '^' AS folded FROM cut1),
        ruled AS (SELECT *, {rule} AS rule FROM hosts),
        rows AS (SELECT *, {verdict} AS said, sha256(folded) AS key FROM ruled),
        folds AS (SELECT DISTINCT key, folded FROM rows),
        held AS (SELECT key, folded, key < '{url_filter.CALIBRATE}' AS held FROM folds),
        grams AS (SELECT key, substring(folded, i::BIGINT, 4) AS gram FROM (SELECT key, folded, unnest(range(1, length(folded) - 2)) AS i FROM folds)),
        counts AS (SELECT gram, count(*) FILTER (said = 'allow' AND NOT held) AS a, count(*) FILTER (said = 'block' AND NOT held) AS r
                   FROM rows JOIN held USING (key) JOIN grams USING (key) GROUP BY gram),
        model AS (SELECT c.gram, round(ln({chance["a"]} / {chance["r"]}) * 1000000)::BIGINT AS ratio FROM counts c {" ".join(joins)}),
        scores AS (SELECT key, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM grams JOIN model USING (gram) GROUP BY key),
        bins AS (SELECT floor(score::DOUBLE / 10000)::BIGINT AS bin, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r
                 FROM rows JOIN held USING (key) JOIN scores USING (key) WHERE held AND rule IS NOT NULL GROUP BY 1),
        edges AS (SELECT bin AS edge FROM bins UNION SELECT max(bin) + 1 FROM bins HAVING count(*) > 0),
        errors AS (SELECT edge, sum(CASE WHEN bin < edge THEN a ELSE 0 END) * sum(r) + sum(CASE WHEN bin >= edge THEN r ELSE 0 END) * sum(a) AS error, sum(a) * sum(r) AS classes
                   FROM edges CROSS JOIN bins GROUP BY edge),
        cut AS (SELECT coalesce((SELECT edge FROM errors WHERE classes > 0 ORDER BY error, abs(edge), edge LIMIT 1), 0) * 10000 AS cut)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, score, cut::BIGINT AS cut
        FROM rows JOIN scores USING (key) CROSS JOIN cut"""


def _op9_sql() -> str:
    """The secret scan in SQL; every window's characters are counted anew."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT row, {n} AS kind, regexp_extract_all(s, {q(p)}) AS hits, regexp_extract_all(s, {q(p)}, {2 if n == 0 else 0}) AS vals, string_split_regex(s, {q(p)}) AS gaps FROM d"
        for n, p in enumerate(secret_scan.PATTERNS.values())
    )
    bound = "CASE " + " ".join(f"WHEN regexp_matches(hit, {q(p)}) THEN {secret_scan.most_weight(b)}" for p, b in secret_scan.CLASSES) + " END"
    allowed = " OR ".join(f"regexp_matches(hit, {q(p)})" for p in secret_scan.ALLOW)
    size = secret_scan.WINDOW
    names = "[" + ", ".join(q(k) for k in secret_scan.KINDS) + "]"
    line = f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER ({{}}), '')"
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS s FROM documents),
        found AS ({found}),
        hits AS (SELECT row, kind, i, hits[i] AS hit, vals[i] AS val, gaps[i] AS gap FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
        placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) - length(hit) AS start FROM hits),
        base AS (SELECT row, kind, start::BIGINT AS start, (start + length(hit))::BIGINT AS stop FROM placed WHERE kind IN (1, 2) OR kind = 0 AND length(val) >= {secret_scan.LEAST_VALUE}),
        cand AS (SELECT row, start, hit, {bound} AS bound FROM placed WHERE kind = 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({allowed})),
        win AS (SELECT *, unnest(range(0, length(hit) - {size - 1})) AS at0 FROM cand),
        heavy AS (SELECT *, list_sum(list_transform(map_values(list_aggregate(string_split(substring(hit, (at0 + 1)::BIGINT, {size}), ''), 'histogram')), lambda n: {secret_scan.WEIGHTS}[n::BIGINT + 1])) AS w FROM win),
        more AS (SELECT row, 3 AS kind, (start + min(at0))::BIGINT AS start, (start + max(at0) + {size})::BIGINT AS stop FROM heavy WHERE w <= bound GROUP BY row, start, hit),
        spans AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = m.row AND b.start < m.stop AND m.start < b.stop))
        SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256({line.format("kind < 3")}) AS base_sha256, {line.format("kind IS NOT NULL")} AS spans
        FROM d LEFT JOIN spans USING (row) GROUP BY row"""


_TERMS = f"list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: translate(x, '{UPPER}', '{LOWER}'))"

ORACLE = {
    "op12_phrase_automata": """
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS rank, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        w AS (SELECT row, rank, i, list_slice(ws, i, i + 12) AS x FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
        hit AS (SELECT row, i FROM (SELECT *, min(rank) OVER (PARTITION BY x) AS low FROM w) WHERE low < rank),
        gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS i FROM hit),
        words AS (SELECT row, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
        kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)""",
    "op13_term_pipeline": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents),
        s AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
        p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
        i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p SEMI JOIN i USING (term) GROUP BY term),
        r AS (SELECT item_id, row, any_value(doc_id) AS doc_id,
                     sum(times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
              FROM i JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY item_id, row),
        t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM t WHERE rank <= 20""",
    "op2_suffix_radix": """
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS b FROM documents),
        n AS (SELECT *, octet_length(b) AS n FROM d),
        w AS (SELECT row, p, md5(b[p:p + 399]) AS h FROM (SELECT row, b, unnest(range(1, n - 398)) AS p FROM n WHERE n >= 400)),
        again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT row, p, lag(p) OVER (PARTITION BY row ORDER BY p) AS q FROM w SEMI JOIN again USING (h)),
        part AS (SELECT row, p, sum(CASE WHEN q IS NULL OR p - q > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY p) AS k FROM hit),
        gone AS (SELECT row, k, min(p) AS a, max(p) + 399 AS z FROM part GROUP BY row, k),
        cut AS (SELECT row, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM gone GROUP BY row),
        ends AS (SELECT doc_id, n, b, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_prepend(1, list_transform(coalesce(stops, []), lambda z: z + 1)) AS lo,
                        list_append(list_transform(coalesce(starts, []), lambda a: a - 1), n) AS hi FROM n LEFT JOIN cut USING (row))
        SELECT doc_id, n AS n_bytes, n_removed, n_spans,
               sha256(unhex(array_to_string(list_transform(range(1, len(lo) + 1), lambda i: CASE WHEN hi[i] >= lo[i] THEN hex(b[lo[i]:hi[i]]) ELSE '' END), ''))) AS kept_sha256
        FROM ends""",
    "op9_secret_scan": _op9_sql(),
    "op1_url_markov": _op1_sql(),
    "op4_pivot_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body)""",
}
