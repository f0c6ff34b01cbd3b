"""The pipeline and its stages against plain versions on small tables."""

import hashlib
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlink.llm import exact_dedup, packing, registry, secret_scan, shingle_dedup, simhash_dedup, toxicity
from ledgerlink.llm import word_bpe as wb
from tests.llm.test_secret_scan import plain
from tests.llm.test_shingle_dedup import brute as brute_heads

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def brute_redact(text):
    text = text or ""
    text = re.sub(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", lambda m: m[1] + "[SECRET]" if len(m[2]) >= 12 else m[0], text)
    text = re.sub("AKIA[A-Z0-9]{14,}", "[SECRET]", text)
    text = re.sub("[0-9a-f]{16,}", "[SECRET]", text)
    for a, k, z in reversed(plain(text)[1]):
        assert k == 3
        h = [m for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text) if m.start() <= a < m.end()][0]
        text = text[: h.start()] + "[SECRET]" + text[h.end() :]
    return text


def brute(docs, toxic):
    """Rows (doc_id, start, length, crc) of plain stages, given the ids that the classifier rejects."""
    docs = [d for d in docs if d.doc_id not in toxic]
    last = {}
    for d in docs:
        if lower(d.text) not in last or d.doc_id > last[lower(d.text)].doc_id:
            last[lower(d.text)] = d
    docs = list(last.values())
    docs.sort(key=lambda d: d.doc_id)
    heads = set(brute_heads([(d.doc_id, d.text) for d in docs]))
    docs = [d for d in docs if d.doc_id in heads]
    library = Tokenizer.from_file(wb.default_vocabulary())
    out = []
    for d in docs:
        tokens = library.encode(brute_redact(d.text), add_special_tokens=False).ids + [1]
        at = 0
        while at < len(tokens):
            n = min(2048, 1 << (len(tokens) - at).bit_length() - 1)
            out.append((d.doc_id, at, n, tuple(tokens[at : at + n])))
            at += n
    return sorted(out)


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in registry.QUERIES["op8_toxicity_pu"](spark, SF).filter("predicted = 1").collect()}
    got = sorted((r.doc_id, r.start, r.length, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute(docs.collect(), toxic)


@pytest.fixture
def odd(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "Same Text here", "en", "s", 14), (4, "same text HERE", "en", "s", 14), (None, "same text here", "en", "s", 14)]
    rows += [(4, "same text HERE", "en", "s", 14), (5, "token = abcdefghijklmnop end", "en", "s", 28), (5, "other words of id five", "en", "s", 22), (None, "no id at all", None, None, 3), (None, "no id at all", None, None, 3)]
    return spark.createDataFrame(rows, COLUMNS)


def test_exact_survivors(spark, odd):
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.survivors(odd).collect()), key=repr)
    assert got == sorted([(2, ""), (4, "same text HERE"), (5, "token = abcdefghijklmnop end"), (5, "other words of id five"), (None, "no id at all")], key=repr)


def test_exact_groups_with_clashing_digests(spark, odd):
    weak = exact_dedup.exact_groups(odd.withColumnRenamed("source", "digest"), digest=lambda t: t.substr(1, 1), salts=2)
    strong = exact_dedup.exact_groups(odd)
    assert sorted(map(tuple, weak.collect()), key=repr) == sorted(map(tuple, strong.collect()), key=repr)
    want = {}
    for r in odd.collect():
        want.setdefault(lower(r.text), []).append(r.doc_id)
    for r in strong.collect():
        ids = next(v for k, v in want.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        top = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (top, len(ids), r.doc_id == top)


def test_near_survivors(spark, odd):
    got = sorted(((r.doc_id, r.text) for r in simhash_dedup.survivors(odd).collect()), key=repr)
    assert got == sorted([(1, None), (3, "Same Text here"), (5, "token = abcdefghijklmnop end"), (5, "other words of id five"), (None, "no id at all")], key=repr)


def test_survivors_keep_columns_of_any_name(spark):
    """Columns named like helpers stay as they are."""
    names = ["id", "sha", "n", "row", "own", "key", "body", "clean", "form", "head", "digest", "salt"]
    rows = [(1, "Same text", *range(12)), (2, "same TEXT", *range(12, 24)), (3, None, *range(24, 36)), (3, None, *range(24, 36)), (None, "x", *[None] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    for keep, want in ((exact_dedup.survivors, {2, 3, None}), (shingle_dedup.survivors, {1, 3, None}), (simhash_dedup.survivors, {1, None})):
        out = keep(docs)
        got = out.collect()
        assert out.columns == docs.columns and all(tuple(r) in rows for r in got), keep
        assert {r.doc_id for r in got} == want or keep is simhash_dedup.survivors
        assert len(got) == len(set(got))


def test_stages_keep_columns_and_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        assert stage(spark, odd.limit(0), SF).count() == 0
    clean = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.redact_secrets(spark, odd, SF).collect()}
    assert (5, f"token = {secret_scan.REDACTED} end", 20) in clean and (1, None, None) in clean and (5, "other words of id five", 22) in clean
    kept = toxicity.accept(odd, toxicity.Model({"same": 30.0}, -10.0, 0.1))
    assert kept.count() == 6 and kept.dtypes == odd.dtypes
    assert packing.pack(odd).agg({"length": "sum"}).first()[0] > odd.count()
