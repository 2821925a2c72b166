"""MinHash-like near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles (words lower-cased A-Z).  Each element sends
points to random registers at exponentially spaced times (a Poisson process from its hash);
a register keeps the earliest time, truncated to the integer ``floor(1 - log_b(time))``.  The minimum
makes sketches mergeable, and equal registers become likelier with the Jaccard similarity.

1. Documents with equal sets form a class; one document speaks for it.
2. Bands of ``ROWS`` registers are hashed; classes that share a band value are candidates.
   Each is tied to the least class of its bucket, if their sketches say so: the share of equal
   registers estimates the similarity, whose complement is a metric, so two linked classes
   are almost equally similar to the least one.  Sorted by that, a bucket is cut at the first gap that
   is wider than a link and both errors allow; what is below it has met by chance and looks
   for a least class of its own, ``ROUNDS`` times, after which it is tied without looking.
   Connected components of the ties are clusters: every link lies inside a cluster.
3. Inside clusters, pairs are estimated jointly from the two sketches and the set sizes by
   maximum likelihood; pairs near or over the threshold are confirmed on the full sets.
   Clusters of up to ``SMALL`` classes are one cell.  Larger ones are cut into chunks, each
   compared within itself and with common pivots; whatever is then outside the cluster's
   largest component is compared with every chunk.  Pairs that are already connected need no
   further check, so cells put out a spanning forest instead of all pairs.
4. Connected components of the confirmed links give the result.

At similarity 0.8 a link has no common band with a chance of 2.5e-7 (50 bands of 6), and is
lost by the estimate, 5 standard deviations below the threshold, with one of 3e-7.

Defined cases: a document without words or with null text has an empty set, is linked with
nothing and is kept; a document with fewer words than a shingle is one shingle; a null id has
component null and is kept; rows that repeat an id are one document (linked by any of its
texts); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.components import components
from regspark.llm.tables import documents, sieved, text_key, written
from regspark.llm.words import _ship_by_value, binary_list, mix, shingle_hashes

BANDS, ROWS = 50, 6
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
MARGIN = 5.0            # standard deviations that the estimate may lie below the threshold
SMALL, CHUNK, PIVOTS, REST = 128, 96, 32, 64
ROUNDS = 4

SKETCHES = "did long, dkey long, n long, f1 long, f2 long, sketch binary"


def registers(hashes, owner, counts):
    """(documents, REGISTERS) uint16 sketches of the elements ``hashes`` of documents ``owner``."""
    import numpy as np
    m = REGISTERS
    times = np.full((len(counts), m), np.inf)
    todo, slack = np.arange(len(counts)), 4.0
    todo = todo[counts > 0]
    while len(todo):
        limit = np.zeros(len(counts))
        limit[todo] = (np.log(m) + slack) / (RATE * counts[todo])
        use = limit[owner] > 0
        h, who = hashes[use], owner[use]
        t, j = np.zeros(len(h)), 0
        flat = times.reshape(-1)
        while len(h):
            j += 1
            r = mix(h + np.uint64((j * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
            u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
            t = t - np.log(u) / (RATE * m)
            on = t <= limit[who]
            h, who, t, r = h[on], who[on], t[on], r[on]
            slot = (mix(r ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(flat, who * m + slot, t)
        todo = todo[np.isinf(times[todo]).any(axis=1)]
        times[todo] = np.inf
        slack *= 2
    with np.errstate(invalid="ignore"):
        k = np.floor(1.0 - np.log(times) / np.log(BASE))
    k[np.isinf(times)] = 0
    return np.clip(k, 0, 65535).astype(np.uint16)


def _sketcher(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        names = [f.split()[0] for f in SKETCHES.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = [shingle_hashes(d.lower().split(), shingle) for d in binary_list(batch["text"])]
                counts = np.array([len(s) for s in sets], np.int64)
                h = np.concatenate(sets)
                k = registers(h, np.repeat(np.arange(len(sets)), counts), counts)
                # order-free fingerprints of the sets
                ends = np.concatenate([[0], np.cumsum(counts)])
                f1, f2 = ((c := np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(s)))]))[ends[1:]] - c[ends[:-1]]
                          for s in (0x1234567, 0x89ABCDEF01))
                yield pa.RecordBatch.from_arrays([
                    batch["did"], batch["dkey"], pa.array(counts), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    pa.array([x.tobytes() for x in k], pa.binary())], names)
    return run


def likelihood_estimate(more, less, equal, n1, n2):
    """Maximum-likelihood Jaccard similarity of pairs, from how many registers of the first
    are larger, smaller, equal, and the two set sizes."""
    import numpy as np
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-300))
    lo, hi = np.zeros_like(top), top * (1 - 1e-9)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):                                     # golden section: one maximum
        x, y = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = log_likelihood(x) > log_likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def forest(rows: list, shingle: int, similarity: float) -> list:
    """Links (rep, rep) that connect all linked classes of one cell.

    ``rows``: (rep, n, sketch, text, label, rest): equal labels are connected already; if some
    row is marked ``rest``, only pairs with such a row are looked at."""
    import numpy as np
    if len(rows) < 2:
        return []
    k = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), -1)
    n = np.array([r[1] for r in rows], np.float64)
    rest = np.array([r[5] for r in rows])
    m = k.shape[1]
    sd = np.sqrt(similarity * (1 - similarity) / m)
    pairs = []
    for i in range(len(rows)):
        js = np.arange(i + 1, len(rows))
        if rest.any() and not rest[i]:
            js = js[rest[js]]
        js = js[np.minimum(n[i], n[js]) >= similarity * np.maximum(n[i], n[js]) - 1e-9]
        if not len(js):
            continue
        equal = (k[js] == k[i]).sum(axis=1)
        on = equal >= m * (similarity - (MARGIN + 1) * sd)
        js, equal = js[on], equal[on]
        if len(js):
            more = (k[i] > k[js]).sum(axis=1)
            est = likelihood_estimate(more, m - equal - more, equal, n[i], n[js])
            pairs += [(-e, i, j) for e, j in zip(est.tolist(), js.tolist()) if e >= similarity - MARGIN * sd]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    sets: dict = {}
    links = []
    for _, i, j in sorted(pairs):
        a, b = root(rows[i][4]), root(rows[j][4])
        if a == b:
            continue
        for x in (i, j):
            if x not in sets:
                sets[x] = shingle_hashes(rows[x][3].lower().split(), shingle)
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= round(100 * similarity) * (len(sets[i]) + len(sets[j]) - both):
            parent[a] = b
            links.append((rows[i][0], rows[j][0]))
    return links


def equal_share(a, b):
    """Hundredths of equal registers of pairs of sketches (Arrow binary columns)."""
    import numpy as np
    import pyarrow as pa
    if not len(a):
        return pa.array([], pa.int32())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), -1) for c in (a, b))
    return pa.array(((x == y).mean(axis=1) * 100).astype(np.int32))


def first_gap(shares, gap: int):
    """Of the hundredths in an array: the least before the first gap from 100 down that is wider
    than ``gap``."""
    return F.aggregate(F.sort_array(shares, asc=False), F.struct(F.lit(100).alias("last"), F.lit(False).alias("cut")),
                       lambda acc, x: F.when(acc["cut"] | (acc["last"] - x > gap), F.struct(acc["last"].alias("last"), F.lit(True).alias("cut")))
                       .otherwise(F.struct(x.alias("last"), F.lit(False).alias("cut"))), lambda acc: acc["last"])


def _stars(pairs: DataFrame) -> DataFrame:
    """(a, b): as connected as ``pairs`` (f1, least) with ``least < f1``, which hold a class once a band.

    Each class keeps the smallest of its at most ``BANDS`` least ones, which the others of them are tied to
    instead: in a large group these are the same few pairs for all its classes."""
    each = pairs.groupBy("f1").agg(F.collect_set("least").alias("all")).withColumn("first", F.array_min("all"))
    return each.select(F.explode(F.array_union("all", F.array("f1"))).alias("a"), F.col("first").alias("b")).where("a <> b").distinct()


def ties_of(classes: DataFrame, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): ties that connect the classes (``f1``) with the least of their buckets, without those that met by chance."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                        lambda i: F.xxhash64(F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i))
    left = classes.select("f1", F.explode(bands).alias("band"))
    near = None                                             # classes that share a band with another
    # a link's two similarities to a third class differ by 1 - similarity at most; both are estimates
    gap = round(100 * (1 - similarity + 2 * MARGIN * (0.25 / REGISTERS) ** 0.5)) + 1
    ties = None
    for i in range(rounds + 1):
        left = left.where("f1 is not null and band is not null").repartition("band")   # dealt once, for both uses
        least = left.groupBy("band").agg(F.min("f1").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
        pairs = written(left.join(least, "band").where("f1 <> least"), "pairs")
        if i < rounds:
            if near is None:
                met = written(pairs.select(F.explode(F.array("f1", "least")).alias("f1")).distinct(), "met")
                near = written(sieved(classes.select("f1", "sketch"), met, ["f1"]).join(met, "f1"), "near")
            sketch = lambda name, as_name: near.select(F.col("f1").alias(name), F.col("sketch").alias(as_name))
            both = (pairs.select("f1", "least").distinct().join(sketch("f1", "sa"), "f1").join(sketch("least", "sb"), "least"))
            share = written(both.select("f1", "least", F.arrow_udf(equal_share, "int")("sa", "sb").alias("share")), "shares")
            pairs = pairs.join(share, ["f1", "least"])
            cuts = pairs.groupBy("band").agg(first_gap(F.collect_set("share"), gap).alias("cut"))
            pairs = written(pairs.join(cuts, "band").select("band", "f1", "least", (F.col("share") >= F.col("cut")).alias("near")), "pairs")
            left = pairs.where("not near").select("f1", "band")
            pairs = pairs.where("near")
        own = _stars(pairs)
        ties = own if ties is None else ties.unionByName(own)
        if left.isEmpty():
            break
    return ties


def _cells(shingle: int, similarity: float):
    def run(batches):
        import pyarrow as pa
        cell, rows, out = None, [], []

        def batch_of(links):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("cell", "did", "n", "sketch")]
            cols += [binary_list(batch["text"]), batch["label"].to_pylist(), batch["rest"].to_pylist()]
            for c, *row in zip(*cols):
                if c != cell:
                    out += forest(rows, shingle, similarity)
                    cell, rows = c, []
                rows.append(row)
            if out:
                yield batch_of(out)
                out = []
        out += forest(rows, shingle, similarity)
        if out:
            yield batch_of(out)
    return run


def _verified(cells: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Confirmed links of the rows dealt to cells (cell, did, n, sketch, text, label, rest)."""
    dealt = cells.select("cell", "did", "n", "sketch", "text", "label", "rest").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_cells(shingle, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 2, similarity: float = 0.8) -> DataFrame:
    """(doc_id, doc_key, n_shingles, component_id, kept) for every row of ``docs``;
    ``doc_key`` is a hash of the text."""
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("did"), text_key(text).alias("dkey"), text.alias("text"))
    sketches = written(base.mapInArrow(_sketcher(shingle), SKETCHES), "sketches")
    full = sketches.where("did is not null and n > 0")
    classes = (full.groupBy("f1", "f2", "n").agg(F.min(F.struct("did", "dkey", "sketch")).alias("rep"))
               .select("f1", "f2", "n", F.col("rep.did").alias("did"), F.col("rep.dkey").alias("dkey"),
                       F.col("rep.sketch").alias("sketch")))
    classes = written(classes, "classes")
    clusters = components(ties_of(classes, similarity)).select(F.col("node").alias("f1"), F.col("label").alias("cluster"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    # sketches and texts are dealt only of classes in clusters
    clustered = sieved(classes, clusters, ["f1"]).join(clusters.join(size, "cluster"), "f1").dropDuplicates(["f1", "did"])
    clustered = written(clustered, "clustered")
    keys = clustered.select("did", "dkey").distinct()
    texts = sieved(base, keys, ["did", "dkey"]).join(keys, ["did", "dkey"]).dropDuplicates(["did", "dkey"])
    members = clustered.join(texts, ["did", "dkey"]).select("f1", "did", "dkey", "n", "sketch", "text", "cluster", "size")
    members = written(members, "members")
    none = [F.col("did").alias("label"), F.lit(False).alias("rest")]
    small = members.where(F.col("size") <= SMALL).select("*", F.xxhash64("cluster").alias("cell"), *none)
    # large clusters: chunks with common pivots
    large = members.where(F.col("size") > SMALL)
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("f1", F.lit(1)), chunks).cast("int")
    pivot = (F.pmod(F.xxhash64("f1", F.lit(2)), F.ceil(F.col("size") / PIVOTS)) == 0) | (F.col("f1") == F.col("cluster"))
    everywhere = F.sequence(F.lit(0), chunks - 1)
    dealt = large.select("*", F.explode(F.when(pivot, everywhere).otherwise(F.array(chunk))).alias("chunk"))
    first = dealt.select("*", F.xxhash64("cluster", "chunk").alias("cell"), *none)
    links = written(_verified(small.drop("size").unionByName(first.drop("size", "chunk")), shingle, similarity), "links")
    # what is outside the largest component of a large cluster meets every chunk
    big = written(large.select("did", "f1", "cluster", "size"), "large")
    if not big.isEmpty():
        inside = links.join(big.select(F.col("did").alias("a")), "a", "left_semi")
        labels = components(inside)
        labelled = big.join(labels, F.col("did") == F.col("node"), "left").withColumn("label", F.coalesce("label", "did")).drop("node")
        largest = (labelled.groupBy("cluster", "label").agg(F.count("*").alias("c"))
                   .groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main")))
        labelled = labelled.join(largest, "cluster").withColumn("rest", F.col("label") != F.col("main"))
        n_rest = labelled.where("rest").groupBy("cluster").agg(F.count("*").alias("n_rest"))
        labelled = written(labelled.join(n_rest, "cluster").select("did", "label", "rest", "n_rest"), "labelled")
        left = large.join(labelled, "did").withColumn("chunk", chunk).withColumn("chunks", chunks)
        parts = F.ceil(F.col("n_rest") / REST).cast("int")
        part = F.pmod(F.xxhash64("f1", F.lit(3)), parts).cast("int")
        as_rest = (left.where("rest").withColumn("part", part)
                   .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")))
        as_member = left.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("chunk").alias("other"))
        cells = as_rest.unionByName(as_member.withColumn("rest", F.lit(False)))
        cells = cells.withColumn("cell", F.xxhash64("cluster", "other", "part"))
        links = written(links.unionByName(_verified(cells, shingle, similarity)), "links")
    # rows that repeat an id with other texts connect their classes
    of_row = full.select("did", "f1", "f2", "n").join(classes.select("f1", "f2", "n", F.col("did").alias("rep")), ["f1", "f2", "n"])
    twice = (of_row.groupBy("did").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b"))
    own = of_row.join(twice.select("did"), "did", "left_semi").select(F.col("did").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(own)).select(F.col("node").alias("did"), F.col("label").alias("component_id"))
    named = (classes.join(found, "did", "left")
             .select("f1", "f2", "n", F.coalesce("component_id", "did").alias("component_id")))
    empty = sketches.where("did is null or n = 0").select("did", "dkey", "n", F.col("did").alias("component_id"))
    result = (full.select("did", "dkey", "n", "f1", "f2").join(named, ["f1", "f2", "n"]).select("did", "dkey", "n", "component_id")
              .unionByName(empty))
    return result.select(F.col("did").alias("doc_id"), F.col("dkey").alias("doc_key"), F.col("n").alias("n_shingles"),
                         "component_id", F.col("did").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, over 2-word shingles."""
    return near_duplicates(documents(spark, sf_dir), 2).drop("doc_key")


_ship_by_value(__name__)
