"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts with the same set of shingles are one class, and only classes are compared. A class's signature is cut into
TREES labels of DEPTH values, each label a path in a prefix trie, whose nodes are the prefixes that classes share. A
class begins with its whole labels, and its matched prefixes are shortened, a value at a time, the step that brings the
fewest new neighbours for its gain first, until a text at the threshold is found with probability RECALL at least. No
prefix need be shorter than the one with which all trees alike would reach that (four values for 0.8 and 20 trees). A
node that one of its classes needs is taken whole, by all classes under it, so two classes meet in it or neither does.

Two classes are candidates if they share such a node in any tree. Candidates whose signatures agree in too few places
(SLACK deviations below the threshold, which loses 3 in 10 million at most and is part of the miss that RECALL admits),
or whose sizes already rule out the threshold, are left out; every other pair is verified on its whole shingle sets.

A node that many classes share is dealt into chunks and a block for each two of them, so a task holds two chunks at
most. Within a block pairs stay in memory, as counts and partner lists; a pair found in several trees counts in the
first. Blocks return each class's number of links and a star over linked classes, a row for each class, and the stars
are joined into components. So rows grow with the classes and not with the square of a group, and no link is dropped.

Defined cases: words are runs of a-z, 0-9 and all that is not ASCII, after lowering ASCII. A text of fewer words than a
shingle is one shingle; texts without words, null among them, are one class without links. Repeated rows are copies of
each other. Rows without a doc_id, or with a repeated one, take part by their text; those without never name a class
unless it has no other. Of a class, ties go to the least doc_id. Texts of any length are taken whole, an empty table
gives no rows. Extra columns, whatever their names, are ignored (``keep_first`` hands them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import BROADCAST_ROWS, discard, identity, keep, lookup, materialize, released
from maskwright.llm.components import components
from maskwright.llm.decontaminate import words

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 20, 6, 0.9999
#: Classes, and shingles, of a chunk.
CHUNK, WEIGHT = 256, 1_500_000
#: How many standard deviations below the threshold a signature's agreement may lie.
SLACK = 5.0
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def depth_for(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, ``depth`` at most, by which a pair at the threshold is found with that probability if it counts
    in every tree; the shortest that any tree needs."""
    return next((d for d in range(depth, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def shingles(text: bytes | None, size: int = SHINGLE):
    """The set of 64-bit hashes of a text's runs of ``size`` words, sorted."""
    import numpy as np
    import xxhash

    found = words(text)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), dtype=np.uint64)
    size = min(size, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(MIX[0]) + np.uint64(size)
    out ^= out >> np.uint64(31)
    out *= np.uint64(MIX[1])
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(sets, a):
    """The minimum of each of the hash functions x -> a x, its upper 32 bits."""
    import numpy as np

    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(sets), 512):
        np.minimum(out, (sets[i : i + 512, None] * a[None, :]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def _sets(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """row, identity, a digest of the shingle set, its size and its signature."""

    @released
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(20240229)
        a = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            digests, n, sigs = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_buffer().to_pybytes() if text.is_valid else None, size)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                n.append(len(s))
                sigs.append(signature(s, a).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())],
                names=["row", "identity", "digest", "n", "sig"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), identity().alias("identity"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, identity struct<none:boolean,id:long,h1:long,h2:long>, digest binary, n long, sig binary")


def runs(batches: Iterator, key: int, names: list[str]) -> Iterator[dict]:
    """Columns of the rows of each run of one block; rows come sorted by their first ``key`` columns."""
    import numpy as np

    held: list[dict] = []  # pieces of the run that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: _numpy(batch.column(i)) for i, c in enumerate(names)}
        first = [columns[c] for c in names[:key]]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in first], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = {c: v[a:b] for c, v in columns.items()}
            if held and (a or any(held[-1][c][-1] != part[c][0] for c in names[:key])):
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[dict]) -> dict:
    import numpy as np

    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _numpy(column):
    import numpy as np
    import pyarrow as pa

    if pa.types.is_binary(column.type) or pa.types.is_list(column.type):
        out = np.empty(len(column), dtype=object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def shorten(nodes: list[tuple[int, list[int]]], floor: int, depth: int, trees: int, threshold: float, recall: float) -> dict[int, int]:
    """How long the prefix must be in each of a class's trees.

    ``nodes`` has, for each tree in which the class shares its prefix of ``floor`` values, how many classes are in its
    nodes of ``floor`` to ``depth`` values; in the other trees it has no neighbour at that length. Whole labels are
    shortened, the step with the fewest new neighbours for its gain first (then the first tree), until a text at the
    threshold is missed with probability 1 - ``recall`` at most.
    """
    miss = {d: math.log1p(-(threshold**d)) for d in range(floor, depth + 1)}
    length = {tree: depth for tree, _ in nodes}
    sizes = dict(nodes)
    now = (trees - len(nodes)) * miss[floor] + len(nodes) * miss[depth]
    while now > math.log1p(-recall) + 1e-12:
        steps = [((sizes[t][d - 1 - floor] - sizes[t][d - floor]) / (miss[d] - miss[d - 1]), t) for t, d in length.items() if d > floor]
        if not steps:
            break
        _, tree = min(steps)
        now += miss[length[tree] - 1] - miss[length[tree]]
        length[tree] -= 1
    return length


def _prefix(d: int, column: str = "label"):
    """The node of ``d`` values that a label is under: the tree, the length and the values."""
    return F.concat(F.expr(f"unhex(lpad(hex(tree * 256 + {d}), 8, '0'))"), F.expr(f"substring({column}, 1, {4 * d})"))


def _cuts(classes: DataFrame, trees: int, depth: int, floor: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """rep, tree, key, m and weight (classes and shingles there) of each class's node in each tree in which it has
    neighbours; and, by rep, cuts: the length of its prefix in each tree."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    entries = classes.where("n > 0").select("rep", "n", "sig", tree).select("rep", "n", "tree", F.expr(f"substring(sig, tree * {4 * depth} + 1, {4 * depth})").alias("label"))
    count = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight")]

    def nodes(rows: DataFrame, d: int, how: str) -> DataFrame:
        """``rows`` with key, and in sizes how many classes and shingles are in their node of ``d`` values."""
        rows = rows.withColumn("key", _prefix(d))
        held = materialize(rows.groupBy("key").agg(*count).where("m > 1"), "forest-nodes")
        rows = lookup(rows, held, "key", "m", F.struct("rep", "tree"), how=how)
        size = F.struct(F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("weight", "n").alias("weight"))
        before = F.col("sizes") if "sizes" in rows.columns else F.array().cast("array<struct<m:bigint,weight:bigint>>")
        return rows.withColumn("sizes", F.concat(before, F.array(size))).drop("key", "m", "weight")

    # Only entries that share their shortest prefix go on: few, unless texts are near copies of each other.
    members = nodes(entries, floor, "inner")
    for d in range(floor + 1, depth + 1):
        members = nodes(materialize(members, "forest-members"), d, "left")
    members = materialize(members, "forest-members")

    @released
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            reps, at, wish = [], [], []
            for rep, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t, d in shorten([(h["tree"], h["m"]) for h in held], floor, depth, trees, threshold, recall).items():
                    reps.append(rep)
                    at.append(t)
                    wish.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(at, pa.int32()), pa.array(wish, pa.int32())], names=["rep", "tree", "wish"])

    own = members.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("tree", F.col("sizes.m").alias("m")))).alias("held"))  # ``trees`` at most
    wishes = own.mapInArrow(run, "rep long, tree int, wish int")
    members = materialize(members.join(wishes, ["rep", "tree"]), "forest-wishes")
    cut = F.lit(depth)
    for d in range(depth - 1, floor - 1, -1):
        needed = members.withColumn("key", _prefix(d)).groupBy("key").agg(F.min("wish").alias("least"), F.count(F.lit(1)).alias("of")).where(f"least <= {d}")
        needed = materialize(needed.select("key", "of", F.lit(True).alias(f"needed{d}")), "forest-needed")
        members = lookup(members.withColumn("key", _prefix(d)), needed, "key", "of", F.struct("rep", "tree")).drop("key", "of")
        cut = F.when(F.col(f"needed{d}"), d).otherwise(cut)
    key = F.lit(None).cast("binary")
    for d in range(floor, depth + 1):
        key = F.when(F.col("cut") == d, _prefix(d)).otherwise(key)
    members = members.withColumn("cut", cut).withColumn("size", F.element_at("sizes", F.col("cut") - floor + 1))
    members = materialize(members.select("rep", "tree", "cut", key.alias("key"), "size.m", "size.weight"), "forest-cuts")
    cuts = members.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "cut"))).alias("cuts"))
    return members, cuts.select("rep", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.element_at("cuts", t), F.lit(floor))).alias("cuts"))


def _blocks(members: DataFrame) -> DataFrame:
    """The members of each block: tree, key, lo, hi (its chunks), chunk and rep; blocks of one class are left out."""
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    members = members.where("m > 1").withColumn("chunks", chunks).withColumn("chunk", F.expr("cast(pmod(xxhash64(rep), chunks) as int)"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return members.select("tree", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "rep")


def _candidates(blocks: DataFrame, classes: DataFrame, trees: int, depth: int, threshold: float) -> DataFrame:
    """Blocks again, of the classes that have a pair to verify there, with the partners of one side."""
    least = threshold - SLACK * (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    names = ["tree", "key", "lo", "hi", "chunk", "rep", "n", "sig", "cuts"]

    @released
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        out: list[tuple] = []
        for g in runs(batches, 4, names):
            one = g["lo"][0] == g["hi"][0]
            left = np.arange(len(g["rep"])) if one else np.flatnonzero(g["chunk"] == g["lo"])
            right = left if one else np.flatnonzero(g["chunk"] == g["hi"])
            if len(left) * len(right) < 1 + one:
                continue
            sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(-1, trees, depth)
            # Values beyond a class's prefix don't matter for where it meets another.
            beyond = np.arange(depth) >= np.array(g["cuts"].tolist())[:, :, None]
            n = g["n"].astype(float)
            partners: dict[int, list[int]] = {}
            for i in left:
                js = right[right > i] if one else right
                equal = sig[js] == sig[i]
                ok = equal.mean(axis=(1, 2)) >= least
                ok &= (equal | beyond[i]).all(axis=2).argmax(axis=1) == g["tree"][0]
                ok &= np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i])
                if ok.any():
                    partners[int(i)] = js[ok].tolist()
            for i in sorted({*partners, *(j for js in partners.values() for j in js)}):
                out.append((g["key"][0], g["lo"][0], g["hi"][0], g["rep"][i], g["rep"][partners.get(i, [])].tolist()))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows):
        import pyarrow as pa

        types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "lo", "hi", "rep", "partners"])

    rows = blocks.join(classes.select("rep", "n", "sig", "cuts"), "rep").select(*names)
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("tree", "key", "lo", "hi", "rep")
    return rows.mapInArrow(run, "key binary, lo int, hi int, rep long, partners array<long>")


def _verified(candidates: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """rep, its number of links in a block, and the least class that links lead to within the block."""
    names = ["key", "lo", "hi", "rep", "partners", "digest", "text"]

    @released
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for g in runs(batches, 3, names):
            sets, partners = {}, {}
            for rep, text, digest, mates in zip(g["rep"].tolist(), g["text"], g["digest"], g["partners"], strict=True):
                s = shingles(text, size)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != digest:
                    raise ValueError("two texts have one hash of 128 bits")
                sets[rep], partners[rep] = s, mates
            at = {rep: i for i, rep in enumerate(sorted(sets))}
            order = sorted(sets)
            n = np.array([len(sets[r]) for r in order])
            start = np.concatenate([[0], np.cumsum(n)])
            values, ids = np.unique(np.concatenate([sets[r] for r in order]) if order else np.zeros(0, np.uint64), return_inverse=True)
            links, root = np.zeros(len(order), dtype=np.int64), list(range(len(order)))

            def find(i: int, root=root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            mark = np.zeros(len(values), dtype=bool)
            for rep in order:
                js = np.array(sorted(at[j] for j in partners[rep] if j in at), dtype=np.int64)
                if not len(js):
                    continue
                i = at[rep]
                own = ids[start[i] : start[i + 1]]
                mark[own] = True
                common = np.array([np.count_nonzero(mark[ids[start[j] : start[j + 1]]]) for j in js])
                mark[own] = False
                linked = js[common >= threshold * (n[i] + n[js] - common) - 1e-9]
                links[i] += len(linked)
                links[linked] += 1
                for j in linked.tolist():
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
            some = [i for i in range(len(order)) if links[i]]
            if some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([order[i] for i in some], pa.int64()), pa.array(links[some], pa.int64()), pa.array([order[find(i)] for i in some], pa.int64())],
                    names=["rep", "links", "root"],
                )

    rows = candidates.join(texts, "rep").select(*names)
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")
    return rows.mapInArrow(run, "rep long, links long, root long")


def _texts(docs: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, digest and text of each candidate: a text of its hash, whichever row has it, written once."""
    wanted = classes.join(candidates.select("rep").distinct(), "rep", "left_semi")
    wanted = materialize(wanted.select(F.struct("identity.h1", "identity.h2").alias("hash"), "rep", "digest", "n_copies"), "wanted-texts")
    rows = docs.select(F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).alias("hash"), F.col("text").cast("binary").alias("text"))
    if wanted.count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(wanted), "hash")
    else:
        found = lookup(rows, wanted, "hash", "n_copies", F.monotonically_increasing_id(), how="inner")
    return materialize(found.groupBy("rep", "digest").agg(F.first("text").alias("text")), "class-texts")


def _report(docs: DataFrame, threshold: float, size: int, trees: int, depth: int, recall: float) -> DataFrame:
    """A row per document: identity, and what ``jaccard_join`` says."""
    floor = depth_for(threshold, trees, depth, recall)
    sets = materialize(_sets(docs, size, trees, depth), "shingle-sets")
    first = F.min(F.struct("identity.none", "identity.id", "row")).alias("first")
    groups = sets.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n_copies")).select("digest", F.col("first.row").alias("rep"), "n_copies")
    plain = materialize(groups.join(sets.select(F.col("row").alias("rep"), "identity", "n", "sig"), "rep"), "classes")
    members, cuts = _cuts(plain, trees, depth, floor, threshold, recall)
    candidates = materialize(_candidates(_blocks(members), plain.select("rep", "n", "sig").join(cuts, "rep"), trees, depth, threshold), "candidates")
    classes = plain.select("rep", "digest", "identity", "n_copies")
    texts = _texts(docs, candidates, classes)
    verified = materialize(_verified(candidates, texts, size, threshold), "verified")
    discard(candidates, texts, members)
    links = verified.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(verified.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = classes.join(links, "rep", "left")
    named = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = materialize(named, "class-roots")
    groups = named.groupBy("root").agg(F.min(F.struct("identity.none", "identity.id", "rep")).alias("f"), F.count(F.lit(1)).alias("m"))
    groups = materialize(groups.select("root", F.when(~F.col("f.none"), F.col("f.id")).alias("class_id"), F.col("f.rep").alias("top"), "m"), "class-names")
    named = lookup(named, groups, "root", "m", "rep")
    named = materialize(named.select("digest", "class_id", "top", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "class-report")
    discard(plain, groups, verified)
    out = lookup(sets.select("row", "identity", "digest"), named, "digest", "n_copies", "row")
    doc_id = F.when(~F.col("identity.none"), F.col("identity.id")).alias("doc_id")
    return out.select("identity", doc_id, "class_id", "n_links", "n_copies", (F.col("row") == F.col("top")).alias("first"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """A row per document.

    doc_id; class_id, the least doc_id of all texts that links lead to; n_links, the number of other texts (classes of
    equal shingle sets) at or above the threshold; n_copies, the number of documents with the same shingles; first,
    true for one row of each class_id.
    """
    return _report(docs, threshold, size, trees, depth, recall).drop("identity")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, with all columns, one of each class: that with the least doc_id."""
    return keep(docs, _report(docs, threshold, size, trees, depth, recall).select("identity", F.col("first").alias("kept")))
