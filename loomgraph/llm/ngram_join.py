"""N-gram Jaccard join: MinHash banding, then verification on full sets of word 5-grams.

A text's set holds every five consecutive words; a text of one to four words is one gram. Equal
sets are one class and are compared once. Signatures of the classes are cut into bands, whose
number and rows follow from the target recall at the threshold, and are shuffled on band hashes.
A bucket of a band is a group of candidates. Buckets that overlap are put together where that saves
work: star edges tie classes into clusters (connected components), and a cluster of up to
``WHOLE_CHUNKS`` chunks is verified as one, each text sent to its cluster's blocks once. A larger
cluster, a chain of texts that have little in common or a very large group of copies, is verified
bucket by bucket, and a pair counts in the first band that it shares; so the pairs looked at stay
those of buckets. Blocks verify pairs on full sets. They keep a set as its difference from the
block's common core, so that near copies cost what they differ in, and return sums of links and star
edges, never pairs.

Every pair that meets in a band is in one block, so verification misses none of them; the chance
that a pair at exactly the threshold meets in no band is at most MISS. Grams and sets are compared
by 64 and 128 bits.

Defined results: a text that is null or has no word, and a row with a null doc_id, link with
nothing and are classes of their own. Rows that repeat an id are documents of their own and count
as links. No rows give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.blocks import grouped, into_blocks, star_roots
from loomgraph.llm.text import U, gram_hashes, hash_words, mix, passes, signed, words_of
from loomgraph.operators.components import connected_components
from loomgraph.plans.scratch import Scratch

N = 5
#: The threshold as a fraction, so that the check is in whole numbers.
JACCARD = (4, 5)
#: Chance that a pair exactly at the threshold shares no band, and the most hashes for it.
MISS = 1e-5
MOST_HASHES = 128
SEED = 6
#: Bounds of a chunk: texts and bytes.
CHUNK_ROWS = 1024
CHUNK_BYTES = 6 << 20
#: Chunks of a cluster that is verified as a whole: each of its texts is sent so many times at most.
WHOLE_CHUNKS = 22
#: Grams shared by more texts of a block than this are multiplied densely.
DENSE_FROM = 24


@dataclass(frozen=True)
class Bands:
    bands: int
    rows: int

    @staticmethod
    def choose(threshold: float = JACCARD[0] / JACCARD[1], miss: float = MISS, most: int = MOST_HASHES) -> Bands:
        """The most rows a band, hence the fewest false candidates, that reach the recall within ``most`` hashes."""
        for rows in range(most, 0, -1):
            bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
            if bands * rows <= most:
                return Bands(bands, rows)
        raise ValueError("the recall needs more hashes")


def gram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each text, sorted, one text after the other, and their offsets."""
    flat, offsets = words_of(texts)
    h = hash_words(flat)
    whole = gram_hashes(h, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mix(gram_hashes(h[a:b], b - a), b - a))
        else:
            out.append(np.zeros(0, U))
    sizes = [len(x) for x in out]
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def set_fingerprints(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: two sums of its grams' hashes."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(grams, k), dtype=U)]) for k in (1, 2)]
        one, two = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    return mix(one, 3), mix(two, 4)


def _signatures(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(SEED)
    count = bands.bands * bands.rows
    scale = rng.integers(0, 1 << 63, count, dtype=np.uint64) * U(2) + U(1)
    shift = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    for part in itertools.chain.from_iterable(map(passes, batches)):
        grams, offsets = gram_sets(part.column("text"))
        one, two = set_fingerprints(grams, offsets)
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes)
        keys = np.zeros((part.num_rows, bands.bands), U)
        if len(some):
            starts = offsets[:-1][some]
            with np.errstate(over="ignore"):
                for b in range(bands.bands):
                    key = np.full(len(some), b, U)
                    for i in range(b * bands.rows, (b + 1) * bands.rows):
                        key = mix(key, np.minimum.reduceat(grams * scale[i] + shift[i], starts))
                    keys[some, b] = key
        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands.bands), pa.array(signed(keys).ravel()))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("mark"), pa.array(signed(one)), pa.array(signed(two)), pa.array(sizes), lists],
            names=["doc_id", "mark", "s1", "s2", "n_grams", "bands"],
        )


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections of sorted sets.

    With the grams that more than half of the sets hold as the core, the intersection of two sets
    is the core without the core grams that either lacks, plus what both differ in alike.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    core = np.flatnonzero(2 * held > n)
    out = np.full((n, n), len(core), np.int64)
    is_core = np.zeros(len(held), bool)
    is_core[core] = True
    # what differs: grams outside the core that a set has, and core grams that it lacks
    own_rows, own_columns = owner[~is_core[column]], column[~is_core[column]]
    place = np.full(len(held), -1)
    place[core] = np.arange(len(core))
    lacks = np.ones((n, len(core)), bool)
    inside = is_core[column]
    lacks[owner[inside], place[column[inside]]] = False
    lack_rows, lack_columns = np.nonzero(lacks)
    lacking = lacks.sum(axis=1)
    out -= lacking[:, None] + lacking[None, :]
    rows = np.concatenate([own_rows, lack_rows])
    columns = np.concatenate([own_columns, core[lack_columns] if len(core) else lack_columns])
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(columns) != 0])) if len(columns) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(cuts, len(columns)))
    for size in np.unique(lengths[(lengths > 1) & (lengths <= DENSE_FROM)]).tolist():
        members = rows[cuts[lengths == size][:, None] + np.arange(size)]
        for a in range(size):
            for b in range(size):
                if a != b:
                    np.add.at(out, (members[:, a], members[:, b]), 1)
    wide = np.flatnonzero(lengths > DENSE_FROM)
    for a in range(0, len(wide), 4096):
        some = wide[a : a + 4096]
        flags = np.zeros((n, len(some)), np.float32)
        for j, k in enumerate(some.tolist()):
            flags[rows[cuts[k] : cuts[k] + lengths[k]], j] = 1
        out += np.rint(flags @ flags.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = sizes
    return out


BLOCK = ["band", "key", "low", "high"]


def _verify(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    up, down = threshold
    for block in grouped(batches, BLOCK):
        if block.num_rows < 2:
            continue
        block = block.combine_chunks()
        grams, offsets = gram_sets(block.column("text").combine_chunks())
        one, two = (signed(x) for x in set_fingerprints(grams, offsets))
        want1, want2, chunk, ids, copies = (block.column(c).to_numpy() for c in ("s1", "s2", "chunk", "rep", "n"))
        # rows that repeat an id with another text, and rows that repeat a row, don't stand for the class
        right = np.flatnonzero((one == want1) & (two == want2))
        _, first = np.unique(ids[right], return_index=True)
        rows = right[np.sort(first)]
        if len(rows) < 2:
            continue
        chunk, ids, copies = chunk[rows], ids[rows], copies[rows]
        met = np.eye(len(rows), dtype=bool)
        if (band := block.column("band")[0].as_py()) > 0:  # pairs that share an earlier band were told there
            keys = block.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)[rows]
            for k in range(band):
                met |= keys[:, k][:, None] == keys[:, k][None, :]
        if block.column("low")[0].as_py() != block.column("high")[0].as_py():
            met |= chunk[:, None] == chunk[None, :]
        if not (new := np.flatnonzero(~met.all(axis=1))).size:
            continue
        rows, ids, copies, met = rows[new], ids[new], copies[new], met[np.ix_(new, new)]
        sets = [grams[offsets[i] : offsets[i + 1]] for i in rows]
        sizes = np.array([len(s) for s in sets])
        both = shared_counts(sets)
        # both / (a + b - both) >= up / down in whole numbers
        near = np.triu((up + down) * both >= up * (sizes[:, None] + sizes[None, :]), 1) & ~met
        p, q = np.nonzero(near)
        if not len(p):
            continue
        root = star_roots(len(rows), p, q)
        links = np.bincount(p, weights=copies[q], minlength=len(rows)) + np.bincount(q, weights=copies[p], minlength=len(rows))
        told = np.flatnonzero((links > 0) | (root != np.arange(len(rows))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(links[told].astype(np.int64)), pa.array(ids[root[told]])], names=["rep", "links", "root"])


def _work(members: DataFrame, sized: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, band, key, chunks): the groups in which each class is verified; band -1 is a whole cluster."""
    room = F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("bytes") / CHUNK_BYTES)).alias("chunks")
    clusters = scratch.save(sized.groupBy("cluster").agg(room), "clusters")
    whole = members.select("cid", "cluster").join(clusters.where(F.col("chunks") <= WHOLE_CHUNKS), "cluster")
    whole = whole.select("cid", F.lit(-1).alias("band"), F.col("cluster").alias("key"), "chunks")
    large = members.select("cid", "cluster").join(clusters.where(F.col("chunks") > WHOLE_CHUNKS).select("cluster"), "cluster")
    keyed = large.join(sized.groupBy("cid").agg(F.max("bytes").alias("bytes")), "cid").join(classes.select("cid", "bands"), "cid")
    keyed = scratch.save(keyed.select("cid", "bytes", F.posexplode("bands").alias("band", "key")), "large")
    buckets = scratch.save(keyed.groupBy("band", "key").agg(room, F.count("*").alias("rows")).where("rows > 1").drop("rows"), "buckets")
    return whole.unionByName(keyed.join(buckets, ["band", "key"]).select("cid", "band", "key", "chunks"))


def _related(docs: DataFrame, scratch: Scratch, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, mark, n_grams, class_id, n_links and part for every row of ``docs`` (doc_id long, text, mark).

    ``part`` numbers groups; it is null for a row that is a class of its own as it has no word or no id.
    """
    bands = Bands.choose(threshold[0] / threshold[1])
    fields = "doc_id long, mark long, s1 long, s2 long, n_grams long, bands array<long>"
    signed_ = scratch.save(docs.mapInArrow(lambda it: _signatures(it, bands), fields), "signatures")
    usable = signed_.where("doc_id is not null and n_grams > 0")
    classes = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    # two classes may share their smallest id only where rows repeat an id; they are told apart by number
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    least = keyed.groupBy("band", "key").agg(F.min("cid").alias("v"), F.count("*").alias("rows")).where("rows > 1")
    edges = scratch.save(keyed.join(least, ["band", "key"]).where("cid <> v").select(F.col("cid").alias("u"), "v").distinct(), "edges")
    clusters = connected_components(edges, scratch).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    members = scratch.save(clusters.join(classes.drop("bands"), "cid"), "members")
    # joins that carry texts are planned alike at every size
    sized = docs.select("doc_id", "text").join(members.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id").withColumn("bytes", F.octet_length("text"))
    sized = scratch.save(sized, "texts")
    blocks = into_blocks(_work(members, sized, classes, scratch), F.col("cid"), F.col("chunks")).drop("chunks")
    blocks = blocks.join(sized.select("cid", "n", "s1", "s2", "text").hint("merge"), "cid").join(classes.select("cid", "bands"), "cid")
    blocks = blocks.withColumn("bands", F.when(F.col("band") > 0, F.col("bands"))).withColumnRenamed("cid", "rep")
    blocks = blocks.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = scratch.save(blocks.mapInArrow(lambda it: _verify(it, threshold), "rep long, links long, root long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "cid")
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    told = classes.select("cid", "s1", "s2", "rep", "n").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    smallest = told.groupBy("part").agg(F.min("rep").alias("least_id"))
    told = told.join(smallest, "part").join(links, "cid", "left")
    told = told.select("s1", "s2", "part", F.col("least_id").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = ["doc_id", "mark", "n_grams", "class_id", "n_links", "part"]
    done = usable.select("doc_id", "mark", "n_grams", "s1", "s2").join(told, ["s1", "s2"]).select(*out)
    rest = signed_.where("doc_id is null or n_grams = 0")
    zero, none = F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("part")
    return done.unionByName(rest.select("doc_id", "mark", "n_grams", F.col("doc_id").alias("class_id"), zero, none))


def near_documents(docs: DataFrame, scratch: Scratch, threshold: tuple[int, int] = JACCARD) -> DataFrame:
    """doc_id, n_grams, class_id and n_links for every row of ``docs`` (doc_id long, text).

    ``class_id`` is the smallest id that the document reaches over links (its own without any);
    ``n_links`` is the number of other documents of Jaccard similarity at the threshold or above.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("mark"))
    return _related(slim, scratch, threshold).select("doc_id", "n_grams", "class_id", "n_links")


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of ``docs`` of each group of near copies, that with the smallest id.

    Of a group's rows that share the smallest id, the one whose text has the least hash stays, and of
    rows that repeat that id and text the one whose other columns have the least hash, so reruns
    agree; rows that are equal in all columns are any of them. Rows with a null id and rows without
    a word are in no group and stay. Columns travel in one struct, so no name clashes. No rows give
    no rows.
    """
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    found = scratch.save(_related(named, scratch, JACCARD), "near")
    lone = found.where("part is null and doc_id is not null").select("doc_id", "mark").distinct().withColumn("n", F.lit(1).cast("long"))
    first = found.where("part is not null and doc_id = class_id").groupBy("part", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = first.groupBy("part").agg(F.min(F.struct("doc_id", "mark", "n")).alias("head")).select("head.*")
    heads = scratch.save(first.unionByName(lone), "heads")
    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), row).join(heads.hint("merge"), ["doc_id", "mark"])
    single = kept.where("n = 1").select("_row")
    # repeated rows are summed up one by one, so a row that is repeated very often isn't ordered
    several = kept.where("n > 1").withColumn("tie", F.xxhash64("_row")).groupBy("doc_id", "mark").agg(F.min_by("_row", "tie").alias("_row")).select("_row")
    rows = single.unionByName(several).unionByName(docs.where("doc_id is null").select(row))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


#: Every pair of documents in DuckDB, on the same sets.
JOIN_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {N} THEN list_distinct(list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM w),
sets AS (SELECT doc_id, count(*) AS n, list(gram ORDER BY gram) AS grams FROM g GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS cid, any_value(n) AS n, count(*) AS docs, grams FROM sets GROUP BY grams),
member AS (SELECT s.doc_id, c.cid, c.docs FROM sets s JOIN classes c USING (grams)),
cg AS (SELECT cid, n, docs, unnest(grams) AS gram FROM classes),
pairs AS (SELECT a.cid AS a, b.cid AS b, any_value(b.docs) AS docs, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM cg a JOIN cg b ON a.gram = b.gram AND a.cid <> b.cid GROUP BY a.cid, b.cid),
near AS (SELECT a, b, docs FROM pairs WHERE {sum(JACCARD)} * k >= {JACCARD[0]} * (na + nb)),
reach AS (SELECT cid AS a, cid AS b FROM classes UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
parts AS (SELECT a AS cid, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS cid, sum(docs) AS n FROM near GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_grams, coalesce(p.class_id, d.doc_id)::BIGINT AS class_id, coalesce(m.docs - 1 + coalesce(l.n, 0), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN member m USING (doc_id) LEFT JOIN parts p USING (cid) LEFT JOIN links l USING (cid)
"""
