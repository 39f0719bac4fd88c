"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of sub-signatures, A and B, each of `tables` entries of
`width` minhashes, stand in for tables * tables banding tables: table (i, j) has
the key (A[i], B[j]). Only 2 * tables * width minhashes are computed, about the
square root of what separate tables would need, and a pair of similarity s meets
in some table with probability (1 - (1 - s**width)**tables)**2 (0.9994 at 0.8
for the defaults, more above).

Candidates of sizes that allow the similarity are verified on the full shingle sets,
which are written once for the documents that share a key with another. No
bucket emits all its pairs. Rows of equal shingle sets are one node. In each
bucket every member is checked against the bucket's most central member (the one
that meets most others over all buckets, so an original rather than one of its
copies); components follow. Where buckets still hold several components and the pairs left
over are few, in proportion to the nodes, they are checked one by one. Where they
are many, members whose sizes and lone shingles rule out all others go, and the rest
of a bucket are counted against each other in blocks of sets; where even that is too
much, members outside the largest component first take turns as centres, in each round
four times as many, so that rounds grow with the logarithm of a bucket. So each
pair that shares a key is checked, cannot be similar, or is already in one
component: no link is lost.

Defined results: null, empty or blank texts have an empty set, no links and
their own id as component; a row with null id takes no part and has a null
component; repeated rows of one id get the same component, also where their texts
differ; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Hasher, column, connected_components, mix, ngrams, scratch_scope, stage_table, text_chunks

#: So many unchecked pairs for each node, at most, are checked one by one.
PAIRS_PER_NODE = 8
#: For each of them, so many may be counted in blocks.
LOOKS_PER_PAIR = 50
#: Members of a bucket that are centres in the first round; in each later one, four times as many.
TURNS = 4
#: Sets of one side of a matrix of intersections.
BLOCK = 256


def shingle_sets(hasher: Hasher, held: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence as one shingle if it is shorter."""
    h, _, _, first, _ = hasher.batch([x.lower() for x in held])  # bytes.lower() lowers A-Z alone
    g = ngrams(h, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(g[a : b - width + 1]))
        else:  # short sequences are told apart from full shingles by their length
            out.append(ngrams(h[a:b], b - a) ^ np.uint64(width - b + a) if b > a else h[:0])
    return out


def _signatures(width: int, tables: int, sub: int):
    mult = mix(np.arange(1, 2 * tables * sub + 1, dtype=np.uint64)) | np.uint64(1)
    add = mix(mult)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            for ids, held in text_chunks(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                sets = shingle_sets(hasher, [x or b"" for x in held], width)
                n = np.array([len(x) for x in sets])
                flat, full = np.concatenate(sets), np.flatnonzero(n)
                begin = np.concatenate(([0], np.cumsum(n[full])[:-1])).astype(np.int64)
                keys = np.zeros((len(full), 2 * tables), np.uint64)
                low = high = np.zeros(0, np.uint64)
                if len(full):
                    for k in range(2 * tables * sub):
                        least = np.minimum.reduceat((flat ^ add[k]) * mult[k], begin)
                        keys[:, k // sub] = mix(keys[:, k // sub] * mult[0] + least)
                    low, high = np.add.reduceat(flat, begin), np.add.reduceat(mix(flat), begin)
                rows: list = [None] * len(ids)
                a, b = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                a[full], b[full] = low.view(np.int64), high.view(np.int64)
                for at, key in zip(full, keys.view(np.int64), strict=True):
                    rows[at] = key
                yield pd.DataFrame({"id": ids, "n": n, "set1": a, "set2": b, "subs": rows})

    return run


def _sets(width: int):
    """Rows (id, text) to (id, set): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            for ids, held in text_chunks(pdf["id"], pdf["text"]):
                yield pd.DataFrame({"id": ids, "set": [x.tobytes() for x in shingle_sets(hasher, held, width)]})

    return run


def _verify(num: int, den: int):
    """Rows (a, b, set_a, set_b) to (a, b, ok) by the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, q in zip(pdf["set_a"], pdf["set_b"], strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(den * both >= num * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "ok": out})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100, tables: int = 8, width: int = 2) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept (id = component_id).
    Documents are linked when den * intersection >= num * union."""
    docs = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    with scratch_scope(docs.sparkSession, "nd") as keep:
        return keep(_classes(docs, shingle_words, num, den, tables, width).withColumnRenamed("id", id_col), "near-duplicates")


def _classes(docs: DataFrame, shingle_words: int, num: int, den: int, tables: int, width: int) -> DataFrame:
    signed = docs.withColumn("id", F.col("id").cast("string")).mapInPandas(_signatures(shingle_words, tables, width), "id string, n long, set1 long, set2 long, subs array<long>")
    sigs = stage_table(signed.withColumn("id", F.col("id").cast("long")), "nd-sigs")
    full = sigs.filter("n > 0 AND id IS NOT NULL")
    # Equal sets are one node, named by its smallest id.
    nodes = stage_table(full.groupBy("n", "set1", "set2").agg(F.min("id").alias("node"), F.first("subs").alias("subs")), "nd-nodes")
    links = _links(docs, nodes, shingle_words, num, den, tables)
    comps = nodes.select("n", "set1", "set2", "node").join(links, "node", "left").select("n", "set1", "set2", F.coalesce("component", "node").alias("component"))
    out = sigs.select("id", "n", "set1", "set2").join(comps, ["n", "set1", "set2"], "left")
    comp = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    comp = F.when(F.col("id").isNotNull(), comp)
    return out.select("id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _buckets(nodes: DataFrame, tables: int) -> DataFrame:
    """(key, node, c, weight, lo, hi) of the tables' keys that more than one node has; lo and hi bound
    the size of its set (an id of several texts has several)."""
    subs = nodes.select("node", F.posexplode("subs").alias("slot", "sub"))
    # Nodes that meet in table (i, j) meet in A[i] and in B[j]: sub-keys met by nobody go before keys are formed.
    met = subs.groupBy("slot", "sub").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    left = subs.join(met, ["slot", "sub"]).groupBy("node").agg(F.collect_list(F.struct("slot", "sub")).alias("s"))
    a, b = f"filter(s, x -> x.slot < {tables})", f"filter(s, x -> x.slot >= {tables})"
    keys = left.select("node", F.explode(F.expr(f"flatten(transform({a}, x -> transform({b}, y -> xxhash64(x.slot, x.sub, y.slot, y.sub))))")).alias("key"))
    keys = stage_table(keys, "nd-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("c > 1")
    # Tables that hold the same nodes together need one of them; each still counts as a meeting.
    sizes = stage_table(sizes.groupBy("c", "who").agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "c", "times"), "nd-sizes")
    kept = stage_table(keys.join(sizes, "key"), "nd-kept")
    weights = kept.groupBy("node").agg(F.sum(F.col("c") * F.col("times")).alias("weight"))
    bounds = nodes.groupBy("node").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return stage_table(kept.select("key", "node", "c").join(weights.join(bounds, "node"), "node"), "nd-buckets")


def _cross(own: DataFrame) -> int:
    """How many pairs of unlike components meet in the sub-keys."""
    parts = own.groupBy("slot", "sub", "component").agg(F.count("*").alias("c"))
    groups = parts.groupBy("slot", "sub").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    return int(groups.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0)


def _possible(own: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """own with u, the number of a node's shingles that no other of these nodes has, without the
    rows whose node is too unlike all: two sets of x and y shingles of which u and v are theirs
    alone share at most x - u and have at least y + u in all."""
    nodes = own.select(F.col("node").alias("id")).distinct()
    held = sets.join(nodes.hint("merge"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(np.int64), [len(x) // 8 for x in pdf["set"]]), "s": np.frombuffer(b"".join(map(bytes, pdf["set"])), np.int64)})

    rows = held.select("id", "set").mapInPandas(run, "id long, s long")
    alone = rows.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    once = held.groupBy("id").agg(F.count("*").alias("sets")).filter("sets = 1").select("id")  # an id of several texts is left in
    own = own.drop("u").join(alone.join(once, "id").withColumnRenamed("id", "node"), "node", "left").withColumn("u", F.coalesce("alone", F.lit(0))).drop("alone")
    least = own.groupBy("slot", "sub").agg(F.min("n").alias("least"))
    return own.join(least, ["slot", "sub"]).filter(F.expr(f"{den} * (n - u) >= {num} * (least + u)")).select("node", "component", "weight", "n", "u", "subs", "slot", "sub")


def _unlike(own: DataFrame, tables: int, num: int, den: int) -> DataFrame:
    """(a, b): pairs of nodes of unlike components that share a table key and can be similar enough."""
    x, y = (own.select("slot", "sub", *(F.col(c).alias(f"{c}_{v}") for c in ("node", "component", "n", "u", "subs"))) for v in "xy")
    x = x.withColumnsRenamed({"slot": "slot_x", "sub": "sub_x"})
    first = f"array_position(zip_with(slice(subs_x, 1, {tables}), slice(subs_y, 1, {tables}), (p, q) -> p = q), true) = slot + 1"
    second = f"exists(zip_with(slice(subs_x, {tables + 1}, {tables}), slice(subs_y, {tables + 1}, {tables}), (p, q) -> p = q), t -> t)"
    both = "least(n_x - u_x, n_y - u_y)"
    able = f"{den} * {both} >= {num} * (n_x + n_y - {both})"
    on = f"slot_x = slot AND sub_x = sub AND node_x < node_y AND component_x <> component_y AND {able} AND {first} AND {second}"
    return x.join(y, F.expr(on)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _by_blocks(own: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join unlike components, all pairs of a bucket counted block by block:
    two blocks of about BLOCK sets make one matrix of intersections, and of its links only those that
    join something new are passed on."""
    by = ["slot", "sub"]
    last = own.groupBy(*by).agg(F.floor((F.count("*") - 1) / BLOCK).alias("last"))
    rows = own.select(*by, "node", "component").join(last, by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("last") + 1))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select(*by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    rows = rows.join(sets.select(F.col("id").alias("node"), "set"), "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        ids, comp, block = pdf["node"].tolist(), pdf["component"].tolist(), pdf["block"].to_numpy()
        x, y = np.flatnonzero(block == pdf["i"].iloc[0]), np.flatnonzero(block == pdf["j"].iloc[0])
        size = np.array([len(s) for s in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        word, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        both = np.zeros((len(x), len(y)), np.float32)
        shared = np.cumsum(count > 1) - 1
        keep = count[col] > 1
        col, of = shared[col[keep]], of[keep]
        for at in range(0, int((count > 1).sum()), 8192):
            m = np.zeros((len(sets), 8192), np.float32)
            part = (col >= at) & (col < at + 8192)
            m[of[part], col[part] - at] = 1
            both += m[x] @ m[y].T
        linked = den * both >= num * (size[x][:, None] + size[y][None, :] - both)
        root, out = {c: c for c in comp}, []

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        for p, q in zip(*np.nonzero(linked), strict=True):
            p, q = int(x[p]), int(y[q])
            c, d = find(comp[p]), find(comp[q])
            if c != d:
                root[max(c, d)] = min(c, d)
                out.append((ids[p], ids[q]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy(*by, "i", "j").applyInPandas(run, "a long, b long")


def _links(docs: DataFrame, nodes: DataFrame, shingle_words: int, num: int, den: int, tables: int) -> DataFrame:
    """(node, component) of the linked nodes."""
    buckets = _buckets(nodes, tables)
    involved = buckets.select(F.col("node").alias("id")).distinct()
    # The hints keep the plan the same at every size.
    texts = docs.filter("text IS NOT NULL").join(involved.hint("merge"), "id").distinct()
    sets = stage_table(texts.mapInPandas(_sets(shingle_words), "id long, set binary"), "nd-sets")

    def checked(pairs: DataFrame) -> DataFrame:
        own = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")).hint("merge")
        both = pairs.join(own("a"), "a").join(own("b"), "b")
        return stage_table(both.select("a", "b", "set_a", "set_b").mapInPandas(_verify(num, den), "a long, b long, ok boolean"), "nd-checked")

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    few = PAIRS_PER_NODE * nodes.count()
    centre = F.max_by(F.struct(F.col("node").alias("centre"), F.col("lo").alias("least"), F.col("hi").alias("most")), F.struct("weight", -F.col("node"))).alias("c")
    pairs = buckets.drop("c").join(buckets.groupBy("key").agg(centre).select("key", "c.*"), "key")
    # Sets of too unlike sizes cannot be similar.
    pairs = pairs.filter(f"node <> centre AND {den} * hi >= {num} * least AND {den} * most >= {num} * lo").select(*ordered("node", "centre")).distinct()
    known = checked(pairs)
    comps = connected_components(known.filter("ok"))
    joined = buckets.filter("c > 2").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    still = joined.join(open_, "key", "left_semi").groupBy("node", "component").agg(F.first("weight").alias("weight"))
    # From here on buckets are those of A alone: fewer, and no pair of a table is lost.
    rows = still.join(nodes.select("node", "n", "subs"), "node").select("node", "component", "weight", "n", F.lit(0).alias("u"), "subs", F.posexplode(F.slice("subs", 1, tables)).alias("slot", "sub"))
    own, pruned, turns = stage_table(rows, "nd-own"), False, TURNS
    by = ["slot", "sub"]
    while cross := _cross(own):
        if cross <= few:
            pairs = _unlike(own, tables, num, den).join(known, ["a", "b"], "left_anti")
            return connected_components(known.union(checked(pairs)).filter("ok"))
        if not pruned:
            own, pruned = stage_table(_possible(own, sets, num, den), "nd-possible"), True
            continue
        if cross <= LOOKS_PER_PAIR * few:
            links = stage_table(_by_blocks(own, sets, num, den), "nd-blocks")
            return connected_components(known.filter("ok").select("a", "b").union(links))
        # The most central members outside a bucket's largest component take their turns as centres.
        largest = own.groupBy(*by, "component").agg(F.count("*").alias("c")).groupBy(*by).agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
        turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "node"))
        centres = own.join(largest, by).filter("component <> largest").withColumn("turn", turn).filter(F.col("turn") <= turns)
        centres = stage_table(centres.select(*by, F.col("node").alias("centre"), F.col("component").alias("of")), "nd-centres")
        pairs = own.join(centres, by).filter("component <> of").select(*ordered("node", "centre")).distinct().join(known, ["a", "b"], "left_anti")
        known = stage_table(known.union(checked(pairs)), "nd-known")
        comps = connected_components(known.filter("ok"))
        own = own.join(centres.withColumnRenamed("centre", "node"), [*by, "node"], "left_anti").drop("component")
        own = own.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = own.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(*by)
        turns *= 4
        own = stage_table(own.join(mixed, by, "left_semi").select("node", "component", "weight", "n", "u", "subs", *by), "nd-own")
    return comps
