"""N-gram Jaccard join by count-vector R-trees.

Two texts link when ``100 * |A & B| >= 75 * |A | B|`` over their sets of distinct five-word shingles.

1. Every text's set is hashed; equal sets form one class, named by 64 bits of the set's hash.  64 further bits are compared,
   and should two classes ever share a name, all is named anew with another seed.  A sketch of fixed size counts shingles
   over all texts; how far a bucket is above what rare shingles make it, in steps of a power of two, is its level.
2. The index's directory: a set is filed under its first ``n // 4 + 1`` shingles, by level.  Sets that link share one of
   these (no link is lost, whatever the order), and a passage in very many texts files next to none of them.  The level of
   what is in many texts does not depend on the size of the input, so tiles do not grow with it.
3. The sets filed under one shingle form a tile; equal tiles are kept once.  A tile's first set seeds its search: the points
   of the sets that meet this leader most often make an R-tree, which is searched with the leader's point, and what it
   finds is verified.  So a group of near copies is joined by one comparison a member.
4. In every tile that still has different components, an R-tree over the group counts finds the pairs whose summed
   coordinate minima admit a link (nodes of a single component are skipped), and those pairs are verified: first the
   likeliest pair of any two components, then, in the tiles where such a pair did not link, every pair.

All pairs that are verified come from an R-tree.  Only links between different components are ever looked for, so a group
of k near copies costs about k comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import rtree
from quillmark.llm.graph import components
from quillmark.llm.rolling import _mix
from quillmark.llm.shingles import raw_texts, shingle_sets
from quillmark.sources.scratch import materialise, release, tidy

#: Counters of the sketch, in blocks; counts up to ``SPREAD`` standard deviations above the mean have level 0, and from there
#: ``STEPS`` levels double ``1 + count / UNIT``.
WIDTH, STRIPE, SPREAD, UNIT, STEPS = 1 << 22, 1 << 12, 4, 8, 2
#: Sets of one tile, or of one leader, that a task holds at once: larger tiles are joined block by block.
HELD = 20_000


def _signature(tokens: np.ndarray, seed: int = 0) -> int:
    """64 bits of the set's hash (signed), the same for equal sets."""
    if not len(tokens):
        return 0
    own = _mix(tokens + np.uint64(seed)) if seed else tokens
    both = _mix(own.sum(dtype=np.uint64, keepdims=True) + _mix(np.bitwise_xor.reduce(own, keepdims=True) + np.uint64(len(own))))
    return int(both.view(np.int64)[0])


def _profile(docs: DataFrame, seed: int) -> DataFrame:
    """A row a text: ``doc_id, key, n, sig, proof``; and per task the sketch's stripes: ``stripe, counts``."""

    def run(batches):
        sketch, buckets, held = np.zeros(WIDTH, np.uint32), [], 0
        for batch in batches:
            sets = list(shingle_sets(raw_texts(batch.column(2))))
            for s in sets:
                buckets.append((s & np.uint64(WIDTH - 1)).astype(np.uint32))
                held += len(s)
            if held > WIDTH:
                sketch += np.bincount(np.concatenate(buckets), minlength=WIDTH).astype(np.uint32)
                buckets, held = [], 0
            numbers = ([len(s) for s in sets], [_signature(s, seed) for s in sets], [_signature(s, ~seed & 0xFFFFFFFF) for s in sets])
            yield _batch(batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in numbers), None, None)
        if buckets:
            sketch += np.bincount(np.concatenate(buckets), minlength=WIDTH).astype(np.uint32)
        stripes = [(k, row.tobytes()) for k, row in enumerate(sketch.reshape(-1, STRIPE)) if row.any()]
        for at in range(0, len(stripes), 128):
            some = stripes[at : at + 128]
            yield _batch(None, None, None, None, None, pa.array([s[0] for s in some], pa.int32()), pa.array([s[1] for s in some], pa.binary()))

    def _batch(*columns):
        n = max(len(c) for c in columns if c is not None)
        kinds = (*[pa.int64()] * 5, pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([c if c is not None else pa.nulls(n, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "key", "n", "sig", "proof", "stripe", "counts"])

    return docs.mapInArrow(run, "doc_id long, key long, n long, sig long, proof long, stripe int, counts binary")


def _levels(profile: DataFrame) -> bytes:
    """The level of each of the sketch's WIDTH buckets, a compressed byte each (the size does not grow with the input)."""
    mean = (profile.agg(F.sum("n")).first()[0] or 0) / WIDTH
    usual = mean + SPREAD * mean**0.5

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.frombuffer(data, "<u4").astype(np.int64)
                sums[k] = sums[k] + row if k in sums else row
        for k, row in sums.items():
            level = np.ceil(STEPS * np.log2(1 + np.maximum(0, row - usual) / UNIT)).astype(np.uint8)
            if level.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["stripe", "level"])

    found = profile.where("stripe is not null").select("stripe", "counts").repartition("stripe").mapInArrow(run, "stripe int, level binary").toArrow()
    levels = np.zeros((WIDTH // STRIPE, STRIPE), np.uint8)
    for k, data in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        levels[k] = np.frombuffer(data, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(levels.tobytes())


def _filed(docs: DataFrame, packed: bytes, seed: int) -> DataFrame:
    """``h, sig``: every set under its first ``n // 4 + 1`` shingles by level, each level in order of the hash.  A task files
    equal sets once."""

    def run(batches):
        levels, known = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), set()
        for batch in batches:
            hs, sigs = [], []
            for s in shingle_sets(raw_texts(batch.column(0))):
                sig = _signature(s, seed)
                if len(s) and sig not in known:
                    known.add(sig)
                    level = levels[(s & np.uint64(WIDTH - 1)).astype(np.int64)]
                    first = len(s) // 4 + 1
                    hs.append(s[np.argsort(level, kind="stable")[:first]])
                    sigs.append(np.full(first, sig))
                if len(hs) >= 500:
                    yield _rows(hs, sigs)
                    hs, sigs = [], []
            if hs:
                yield _rows(hs, sigs)

    def _rows(hs, sigs):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(sigs), pa.int64())], ["h", "sig"])

    return docs.select("text").mapInArrow(run, "h long, sig long")


def _tiles(filed: DataFrame) -> DataFrame:
    """``kind, x, y, votes``: kind 0, the distinct tiles (x tile, y sig); kind 1, a set, its tile leader and how often."""

    def run(batches):
        h, sig = [], []
        for batch in batches:
            h.append(batch.column(0).to_numpy())
            sig.append(batch.column(1).to_numpy())
        if not h:
            return
        h, sig = np.concatenate(h), np.concatenate(sig)
        order = np.lexsort((sig, h))
        h, sig = h[order], sig[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
        h, sig = h[new], sig[new]
        start = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        size = np.diff(start, append=len(h))
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return
        rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        members = sig[rows]
        first = np.cumsum(size) - size
        names = _mix(np.add.reduceat(_mix(members.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)
        leader = np.repeat(members[first], size)
        follows = leader != members
        pairs = np.stack([members[follows], leader[follows]], 1)
        pairs, votes = np.unique(pairs, axis=0, return_counts=True)
        _, once = np.unique(names, return_index=True)
        keep = np.zeros(len(names), bool)
        keep[once] = True
        keep = np.repeat(keep, size)
        x = np.concatenate([np.repeat(names, size)[keep], pairs[:, 0]])
        y = np.concatenate([members[keep], pairs[:, 1]])
        kind = np.concatenate([np.zeros(keep.sum(), np.int32), np.ones(len(pairs), np.int32)])
        votes = np.concatenate([np.zeros(keep.sum(), np.int64), votes])
        for at in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in (kind, x, y, votes)], ["kind", "x", "y", "votes"])

    return filed.repartition("h").mapInArrow(run, "kind int, x long, y long, votes long")


def _texts(docs: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """``sig, n, cv, text`` of the row of every class that ``classes(sig, key)`` names."""

    def own(batches):
        for batch in batches:
            keep, sizes, points = [], [], []
            for k, s in enumerate(shingle_sets(raw_texts(batch.column(1)))):
                if _signature(s, seed) == batch.column(0)[k].as_py():  # else another text with the same key
                    keep.append(k)
                    sizes.append(len(s))
                    points.append(rtree.point(s))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), kept.column(1)], ["sig", "n", "cv", "text"])

    # the second hash keeps apart texts that share a key; rows that repeat a document are one
    joined = docs.select("key", F.xxhash64(F.lit(1), "text").alias("k2"), "text").join(classes.select("key", "sig"), "key")
    return joined.dropDuplicates(["key", "k2"]).select("sig", "text").mapInArrow(own, "sig long, n long, cv binary, text string")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, verified on the whole shingle sets."""

    def run(batches):
        last, kept = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right, out = raw_texts(batch.column(2)), raw_texts(batch.column(3)), []
            for k, x in enumerate(shingle_sets(left)):
                if b[k] != last:
                    last, kept = b[k], next(iter(shingle_sets([right[k]])))
                if 75 * max(len(x), len(kept)) <= 100 * min(len(x), len(kept)):
                    both = len(np.intersect1d(x, kept, assume_unique=True))
                    if 100 * both >= 75 * (len(x) + len(kept) - both):
                        out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in out], pa.int64()), pa.array([b[k] for k in out], pa.int64())], ["a", "b"])

    left = texts.select(F.col("sig").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("sig").alias("b"), F.col("text").alias("right_text"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_text", "right_text").mapInArrow(run, "a long, b long")


def _led(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that an R-tree over the points of a leader's followers ``a`` gives for its own point ``b``.  At most
    ``HELD`` followers make a tree; more make several."""

    def run(batches):
        last, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] != last or len(rows) >= HELD:
                    yield from _found(rows)
                    last, rows = row[1], []
                rows.append(row)
        yield from _found(rows)

    def _found(rows):
        if rows:
            at = rtree.search([rtree.counts_of(r[2]) for r in rows], np.array([r[4] for r in rows]), rtree.counts_of(rows[0][3]), rows[0][5])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in at], pa.int64()), pa.array([rows[k][1] for k in at], pa.int64())], ["a", "b"])

    left = texts.select(F.col("sig").alias("a"), F.col("cv").alias("x"), F.col("n").alias("n_a"))
    right = texts.select(F.col("sig").alias("b"), F.col("cv").alias("y"), F.col("n").alias("n_b"))
    near = pairs.join(left, "a").join(right, "b").where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    return near.select("a", "b", "x", "y", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _fitting(tiles: DataFrame) -> DataFrame:
    """The rows of ``tile, low, high, sig, label, n`` whose next smaller or larger set in the tile is of a size that can link; if
    those are not, no set of the tile is.  Points are fetched for these rows only."""
    by_size = Window.partitionBy("tile", "low", "high").orderBy("n", "sig")
    near = tiles.withColumn("smaller", F.lag("n").over(by_size)).withColumn("larger", F.lead("n").over(by_size))
    return near.where("100 * smaller >= 75 * n or 100 * n >= 75 * larger").select("tile", "low", "high", "sig", "label", "n")


def _blocks(labelled: DataFrame) -> DataFrame:
    """``tile, low, high, sig, label``: the tiles with different labels; one of over ``HELD`` sets is parted by the sets' names
    into blocks, and every two of its blocks make a tile of their own, so that all its pairs meet and no task holds it whole."""
    mixed = labelled.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / F.lit(HELD)).cast("int").alias("blocks")).where("lo <> hi").select("tile", "blocks")
    rows = labelled.join(mixed, "tile").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("tile", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "sig", "label")


def _candidates(tiles: DataFrame, best: bool) -> DataFrame:
    """``tile, a, b``: by R-tree in each tile of ``tile, low, high, sig, label, n, cv``, pairs of different labels that may link
    (``best``: of any two labels the likeliest one)."""

    def run(batches):
        tile, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != tile:
                    yield from _joined(tile, rows)
                    tile, rows = row[:3], []
                rows.append(row[3:])
        yield from _joined(tile, rows)

    def _joined(tile, rows):
        if len(rows) < 2:
            return
        _, labels = np.unique([r[1] for r in rows], return_inverse=True)
        sig = np.array([r[0] for r in rows])
        i, j = rtree.join([rtree.counts_of(r[3]) for r in rows], np.array([r[2] for r in rows]), labels, best)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tile[0])), pa.array(np.maximum(sig[i], sig[j])), pa.array(np.minimum(sig[i], sig[j]))], ["tile", "a", "b"])

    place = ("tile", "low", "high")
    return tiles.select(*place, "sig", "label", "n", "cv").repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "tile long, a long, b long")


def _apart(tried: DataFrame, groups: DataFrame) -> DataFrame:
    """``tile`` of the rows ``tile, a, b`` of ``tried`` whose ends are in different components."""
    name = groups.select(F.col("node").alias("s"), "root")
    for end in ("a", "b"):
        tried = tried.join(name, tried[end] == name["s"], "left").withColumn(end, F.coalesce("root", end)).drop("s", "root")
    return tried.where("a <> b").select("tile").distinct()


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after further links ``a, b``: only the roots are joined anew."""
    name = groups.select(F.col("node").alias("s"), "root")
    ends = links
    for end in ("a", "b"):
        ends = ends.join(name, ends[end] == name["s"], "left").select(F.coalesce("root", end).alias(end), *[c for c in ("a", "b") if c != end])
    top = materialise(components(ends, "jaccard-roots"), "jaccard-top").select(F.col("node").alias("old"), F.col("root").alias("new"))
    # nodes that no link had met before are their own roots
    known = groups.unionByName(top.select(F.col("old").alias("node"), F.col("old").alias("root")).join(groups.select("node"), "node", "left_anti"))
    return known.join(top, known["root"] == top["old"], "left").select("node", F.coalesce("new", "root").alias("root"))


def _resolved(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, n, sig`` of every row of ``docs(doc_id, key, text)``, and ``sig, first`` for the sets that several rows have
    or that link with others: the row of the component (a struct that sorts) with the smallest doc_id, null last, then key."""
    profile = materialise(_profile(docs, seed), "jaccard-profile")
    levels = _levels(profile)
    rows = materialise(profile.where("stripe is null").select("doc_id", "key", "n", "sig", "proof"), "jaccard-rows")
    release(profile)
    counted = rows.where("n > 0").groupBy("sig").agg(F.min(_place()).alias("least"), F.min("key").alias("key"), F.count(F.lit(1)).alias("times"), (F.min("proof") != F.max("proof")).alias("torn"))
    classes = materialise(counted, "jaccard-classes")
    if classes.where("torn").limit(1).count():  # two different sets share a name
        release(rows, classes)
        return _resolved(docs, seed + 1)

    found = materialise(_tiles(_filed(docs, levels, seed)), "jaccard-tiles")
    tidy(docs.sparkSession)
    tiles = found.where("kind = 0").select(F.col("x").alias("tile"), F.col("y").alias("sig")).distinct()
    filed = found.where("kind = 0").select(F.col("y").alias("sig")).distinct()
    texts = materialise(_texts(docs, classes.join(filed, "sig", "left_semi"), seed), "jaccard-texts")
    tidy(docs.sparkSession)

    votes = found.where("kind = 1").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("votes").alias("votes"))
    best = Window.partitionBy("a").orderBy(F.col("votes").desc(), "b")
    leaders = votes.withColumn("k", F.row_number().over(best)).where("k = 1").select("a", "b")
    near = materialise(_led(leaders, texts), "jaccard-near")
    tidy(docs.sparkSession)
    links = materialise(_linked(near, texts), "jaccard-links")
    groups = materialise(components(links, "jaccard-leaders"), "jaccard-groups")
    release(near, links)
    tidy(docs.sparkSession)
    # Twice: first the likeliest pair of any two components in a tile, then every pair of components that are still apart.  Two
    # components of which a tile has no likeliest pair have none at all in it, and components only grow, so the second search
    # goes to the tiles with a first pair that is still apart.
    for likeliest in (True, False):
        labelled = tiles.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("tile", "sig", F.coalesce("root", "sig").alias("label"))
        labelled = materialise(labelled, "jaccard-labelled")
        sized = _blocks(labelled).join(texts.select("sig", "n"), "sig")
        searched = _fitting(sized).join(texts.select("sig", "cv"), "sig")
        pairs = materialise(_candidates(searched, likeliest), "jaccard-pairs")
        tidy(docs.sparkSession)
        late = materialise(_linked(pairs.select("a", "b").distinct(), texts), "jaccard-late")
        before, groups = groups, materialise(_merged(groups, late), "jaccard-groups")
        if likeliest:
            left = materialise(_apart(pairs, groups), "jaccard-left")
            tiles = tiles.join(left, "tile", "left_semi")
        release(before, labelled, pairs, late)
        tidy(docs.sparkSession)
    release(found, texts, left)

    # The smallest doc_id of a component comes to its classes first, so no join has a component's rows under one key.
    named = classes.join(groups.withColumnRenamed("node", "sig"), "sig", "left").where("times > 1 or root is not null").select("sig", F.coalesce("root", "sig").alias("root"), "least")
    named = materialise(named, "jaccard-named")
    roots = materialise(named.groupBy("root").agg(F.min("least").alias("first")), "jaccard-roots")
    names = materialise(named.join(roots, "root").select("sig", "first"), "jaccard-names")
    release(classes, groups, named, roots)
    return rows.select("doc_id", "key", "n", "sig"), names


def _place():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` with a hash of doc_id and text as ``q_key``."""
    return docs.select(*columns, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("q_key"))


def _slim(docs: DataFrame) -> DataFrame:
    return _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.col("q_key").alias("key"), "text")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row.

    ``component_id`` is the smallest doc_id that is reachable by links, the row's own included.  A null, empty or blank
    text has 0 shingles and links with nothing (its component is its own doc_id).  Rows that repeat a doc_id count as texts
    of their own; a null doc_id takes part, but names no component; other columns are ignored; empty in, empty out.
    """
    rows, names = _resolved(_slim(docs))
    found = rows.join(names, "sig", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("first.doc_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id (null last; equal ids by a hash of the text).

    Rows are told apart by doc_id and text, so a row with a null or repeated doc_id goes only for what its own text links
    with.  Of rows alike in doc_id and text the smallest by all columns stays.  Texts without words link with nothing and
    all stay, repeated or not; all columns pass; empty in, empty out.
    """
    rows, names = _resolved(_slim(docs))
    marked = rows.where("n > 0").join(names, "sig").groupBy("key", "doc_id").agg(F.max(F.col("key") != F.col("first.key")).alias("goes"), F.count(F.lit(1)).alias("times")).where("goes or times > 1")
    marked = materialise(marked.select(F.col("key").alias("q_mark"), F.col("doc_id").alias("q_id"), "goes"), "jaccard-marked")
    own = _keyed(docs, *(F.col(f"`{c}`") for c in docs.columns))
    same = (F.col("q_key") == F.col("q_mark")) & F.col("doc_id").cast("long").eqNullSafe(F.col("q_id"))
    once = own.join(marked.where("not goes"), same, "left_semi").groupBy("q_key", "doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("q_row"))
    return own.join(marked, same, "left_anti").drop("q_key").unionByName(once.select("q_row.*"))
