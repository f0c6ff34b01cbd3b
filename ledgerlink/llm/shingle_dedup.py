"""Near copies by exact shingle similarity, for the corpus pipeline.

Rule: two texts are linked where the sets of their ``WIDTH``-word shingles (words as in ``simhash_dedup``) have a Jaccard
similarity of ``SIMILAR`` or more; of each component of links one document stays.

1. Equal sets are one form.  A form's min-hashes, ``BANDS`` bands of ``ROWS``, put it into as many buckets; two forms of similarity s
   share one with probability 1 - (1 - s^ROWS)^BANDS, at 0.8 that is 0.9996.  Each form is compared with the smallest form of each of its buckets.
2. A bucket whose members these links already join is done.  In the others, members go down a prefix tree of up to
   ``DEEPER`` further min-hashes: in a node of more than ``SMALL`` members each is compared with the node's smallest,
   in the first node of at most ``SMALL`` all members of different components are compared.  Nodes that one component
   fills, most of them single members, are counted but not joined with their members.
3. The SimHash fingerprints of all sets go into the BK-trees of ``simhash_dedup``.  Any two forms whose fingerprints lie within
   ``RADIUS`` bits are compared, unless the links so far join them.  By the angle between two sets the radius holds most pairs
   of 0.95, about half at 0.9 and few at 0.8.

So every comparison is decided by whole sets.  No pair within the radius is left out.  In buckets a member has at most
DEEPER + SMALL comparisons, however many texts share it: their number grows with the number of texts, not with the square of a
family.  The price is recall inside large families of texts that share buckets without being near copies and lie beyond the
radius; it is measured in the tests.  The trees' comparisons grow with the pairs that are within the radius and still apart.

Defined cases: null, empty and blank texts have the same empty set.  Fewer words than ``WIDTH`` form one shingle.
Rows that share an id are told apart by their texts; a null id never wins against an id.  Copies share a form.  Very long texts
are read in segments; their sets are as large as their distinct shingles.  Other columns may have any name and are
kept.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import keep_listed, small_batches, text_sha, utf8
from ledgerlink.llm import simhash_dedup
from ledgerlink.llm.simhash_dedup import component_heads, majority_bits, shingle_hashes
from ledgerlink.session import Workspace

WIDTH, SIMILAR = 5, (4, 5)  # the least similarity, as a fraction
RADIUS, BLOCKS = 6, 8  # of the BK-trees
BANDS, ROWS = 20, 5
DEEPER, SMALL = 11, 8
PIECE = 1 << 14


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = [np.unique(h) for h in shingle_hashes(text, WIDTH)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def form_of(members: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(members.tobytes()), np.uint64).view(np.int64))


def least_hashes(members: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` min-hashes of a set that is not empty."""
    times, plus = np.random.default_rng(seed).integers(0, 1 << 63, (2, n, 1), np.uint64)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), PIECE):
        low = np.minimum(low, (members[None, at : at + PIECE] * (times | np.uint64(1)) + plus).min(axis=1))
    return low


def named(data: bytes, seed: int) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(data, seed=seed), np.uint64).view(np.int64))


def buckets(members: np.ndarray) -> list[int]:
    """One signed 64-bit bucket a band; none for the empty set."""
    if not len(members):
        return []
    return [named(r.tobytes(), i) for i, r in enumerate(least_hashes(members, BANDS * ROWS, 11).reshape(BANDS, ROWS))]


def paths(members: np.ndarray, wanted: set[int]) -> list[tuple[int, list[int]]]:
    """(bucket, nodes below it from the top down) for the wanted buckets of a set."""
    further = least_hashes(members, BANDS * DEEPER, 12).reshape(BANDS, DEEPER)
    out = []
    for bucket, hashes in zip(buckets(members), further.tolist()):
        if bucket in wanted:
            nodes, node = [], bucket
            for depth, h in enumerate(hashes):
                node = named(b"%d %d" % (node, h), depth)
                nodes.append(node)
            out.append((bucket, nodes))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if SIMILAR[1] * len(a) < SIMILAR[0] * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, form, fp, buckets for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in utf8(b.column(1))]
            named = [pa.array([name(s) for s in sets], pa.int64()) for name in (form_of, lambda s: majority_bits([s]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *named, pa.array([buckets(s) for s in sets], pa.list_(pa.int64()))], ["key", "form", "fp", "buckets"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"key {kind}, form long, fp long, buckets array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """form, members (sorted 64-bit hashes as bytes) of the one column of ``texts``."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([form_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["form", "members"])

    return texts.mapInArrow(run, "form long, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose whole sets are similar."""
    side = lambda c: sets.withColumnsRenamed({"form": c, "members": f"set_{c}"})

    def run(batches):
        for b in batches:
            a, z = ([np.frombuffer(x, np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
            hit = pa.array([similar(x, y) for x, y in zip(a, z)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], ["u", "v"])

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def tree_pairs(ws: Workspace, forms: DataFrame) -> DataFrame:
    """All pairs of forms (form, fp, head) u > v of different heads whose fingerprints lie within the radius."""
    prints = ws.save(forms.groupBy("fp").agg(F.min("head").alias("low"), F.max("head").alias("high")), "prints")
    found = simhash_dedup.links(ws, prints, RADIUS, BLOCKS, apart=True)
    mixed = prints.filter("low < high").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    # Spark does not know how many forms a fingerprint has: both sides are sorted and merged.
    side = lambda c: forms.select(F.col("fp").alias(c), F.col("form").alias(f"form_{c}"), F.col("head").alias(f"head_{c}")).hint("merge")
    met = found.union(mixed).join(side("u"), "u").join(side("v"), "v").filter("head_u <> head_v and (u <> v or form_u > form_v)")
    return ws.save(met.select(F.greatest("form_u", "form_v").alias("u"), F.least("form_u", "form_v").alias("v")), "tree-pairs")


def links(ws: Workspace, forms: DataFrame, sets_of) -> DataFrame:
    """Links u > v among the forms (form, fp, buckets), enough for the components; ``sets_of(forms)`` gives form, members."""
    rows = forms.select("form", F.explode("buckets").alias("bucket"))
    sizes = ws.save(rows.groupBy("bucket").agg(F.min("form").alias("leader"), F.max("form").alias("last")).filter("leader < last").drop("last"), "buckets")
    members = ws.save(rows.join(sizes.hint("merge"), "bucket"), "members")  # the buckets of a form are more than Spark reckons
    leads = ws.save(members.filter("form > leader").select(F.col("form").alias("u"), F.col("leader").alias("v")).distinct(), "leads")
    sets = ws.save(sets_of(members.select("form").distinct()), "sets")
    first = ws.save(confirmed(leads, sets), "links")

    heads = component_heads(ws, first).select(F.col("u").alias("form"), F.col("v").alias("head"))
    known = ws.save(members.join(heads, "form", "left").withColumn("head", F.coalesce("head", "form")), "named")
    sizes = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("a"), F.max("head").alias("z"))
    open_ = ws.save(sizes.filter("a < z").select("bucket", "n"), "open")
    live = ws.save(known.join(open_, "bucket").select("bucket", "n", "form", "head"), "live")

    below = ws.save(tree_nodes(live.filter(F.col("n") > SMALL).select("bucket", "form", "head"), sets), "nodes")
    # A node whose members one component holds asks for no comparison, and neither does any node below it.
    nodes = below.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("form", "head")).alias("first"), F.min("head").alias("a"), F.max("head").alias("z"))
    nodes = ws.save(nodes.filter("a < z").drop("a", "z"), "node-sizes")
    placed = ws.save(below.join(nodes, "node"), "placed")
    leads = placed.filter((F.col("n") > SMALL) & (F.col("head") != F.col("first.head"))).select(F.col("form").alias("u"), F.col("first.form").alias("v"))
    # A path leaves the large nodes once; the node it enters then has all its members from the same parent.
    entered = placed.groupBy("bucket", "form", "head").agg(F.min(F.when(F.col("n") <= SMALL, F.struct("depth", "node"))).alias("leaf")).filter("leaf is not null")
    leaves = ws.save(live.filter(F.col("n") <= SMALL).select("bucket", "form", "head").union(entered.select("leaf.node", "form", "head")), "leaves")
    other = leaves.select("bucket", F.col("form").alias("v"), F.col("head").alias("other"))
    within = leaves.join(other, "bucket").filter((F.col("form") > F.col("v")) & (F.col("head") != F.col("other"))).select(F.col("form").alias("u"), "v")
    more = ws.save(leads.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(within).distinct(), "apart")
    linked = ws.save(first.union(confirmed(more, sets)), "bucket-links")

    heads = component_heads(ws, linked).select(F.col("u").alias("form"), F.col("v").alias("head"))
    classed = ws.save(forms.select("form", "fp").join(heads, "form", "left").withColumn("head", F.coalesce("head", "form")), "classed")
    trees = tree_pairs(ws, classed)
    if trees.isEmpty():
        return linked
    sets = ws.save(sets_of(trees.select(F.explode(F.array("u", "v")).alias("form")).distinct()), "tree-sets")
    return ws.save(linked.union(confirmed(trees, sets)), "all-links")


def tree_nodes(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, form, head, depth, node: the prefix-tree nodes below the buckets that the forms are open in."""
    per = open_.groupBy("form", "head").agg(F.collect_list("bucket").alias("buckets"))  # at most one a band

    def run(batches):
        for b in batches:
            out = []
            for form, head, wanted, members in zip(*(b.column(c).to_pylist() for c in range(4))):
                for bucket, nodes in paths(np.frombuffer(members, np.uint64), set(wanted)):
                    out += [(bucket, form, head, depth, node) for depth, node in enumerate(nodes)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(columns)], ["bucket", "form", "head", "depth", "node"])

    return per.join(sets.hint("merge"), "form").select("form", "head", "buckets", "members").mapInArrow(run, "bucket long, form long, head long, depth int, node long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, component (its smallest key) for each row."""
    ws = Workspace(docs.sparkSession)
    tagged = docs.select(F.struct(F.col(key).alias("key"), text_sha(F.col(text)).alias("sha")).alias("own"), F.col(text).alias("text"))
    rows = ws.save(sketches(tagged, "own", "text").select("key.*", "form", "fp", "buckets"), "sketches")
    forms = ws.save(rows.groupBy("form").agg(F.min("key").alias("least"), F.min("sha").alias("sha"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "forms")

    def sets_of(wanted: DataFrame) -> DataFrame:
        shas = ws.save(forms.join(wanted, "form", "left_semi").select("sha"), "wanted")
        texts = tagged.select(F.col("own.sha").alias("sha"), "text").join(shas, "sha", "left_semi").dropDuplicates(["sha"])
        return shingle_sets(texts.select(F.col("text").cast("string")))

    heads = component_heads(ws, links(ws, forms, sets_of)).select(F.col("u").alias("form"), F.col("v").alias("head"))
    named = forms.select("form", "least").join(heads, "form", "left").withColumn("head", F.coalesce("head", "form"))
    ids = named.groupBy("head").agg(F.min("least").alias("component"))
    names = ws.save(named.join(ids.hint("merge"), "head").select("form", "component"), "names")
    return rows.select("key", "form").join(names.hint("merge"), "form").select("key", "component")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, all columns: the one with the smallest id."""
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), text_sha(F.col(text)).alias("sha"))
    groups = near_groups(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text")
    keep = groups.filter(F.col("key") == F.col("component")).groupBy("key.id", "key.sha").agg(F.count(F.lit(1)).alias("n"))
    return keep_listed(docs, Workspace(docs.sparkSession).save(keep, "keep"), doc_id, F.col(text))
