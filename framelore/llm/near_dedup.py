"""MinHash near-duplicates by an inverted join over signature coordinates.

Two documents are linked when the Jaccard similarity of their distinct five-word shingles is 0.75 or more. The steps:

1. Each text becomes its full shingle set, a digest of that set and a MinHash signature. Documents with equal sets form
   one class; only classes take part below, so exact copies never pair up.
2. Each class is posted under every (coordinate, value) of its signature. Postings of one class fall away. What is left is
   ordered from rare to frequent, and a class keeps only its prefix: two signatures that agree in MATCHES of COORDINATES
   places share a value in both prefixes.
3. In each posting list every class is first compared with the list's hub alone (a star, never all pairs). Links give
   components, and a list that lies within one component is skipped. Texts that have too few shingles in common with all
   the others together are left out.
4. The other lists are compared across components, in blocks, inside a task: one pass counts agreeing coordinates and keeps
   the members that have a partner at all, the next takes these members' full sets along, confirms each pair of enough
   agreeing coordinates on them, and joins components as it goes. A task returns the links that join two components, fewer
   than it has members, so no step's output grows with the square of a group of near copies.
5. Components of the links give each class the smallest doc_id.

A pair of similarity 0.75 agrees in fewer than MATCHES coordinates with a probability of 1.0e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, table, wrapped
from .components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
COORDINATES = 64
MATCHES = 29
STAR_MEETINGS = 4
BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.default_rng(7).integers(1, 2**63, size=(2, COORDINATES), dtype=np.uint64)
_MUL, _ADD = _seeds[0] | np.uint64(1), _seeds[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z in lower case, words between ASCII white space.

    With fewer words than ``words`` the whole sequence is the only shingle; without words the set is empty.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    span = min(words, len(found))
    n = len(found) - span + 1
    out = np.full(n, span, np.uint64)
    for j in range(span):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def digest(hashes: np.ndarray) -> bytes | None:
    """A name of a shingle set; None for the empty one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima of multiply-shift hashes, as int32."""
    low = np.full(COORDINATES, 2**31 - 1, np.int64)
    for i in range(0, len(hashes), 1024):
        part = (hashes[i : i + 1024, None] * _MUL + _ADD) >> np.uint64(33)
        low = np.minimum(low, part.min(axis=0).astype(np.int64))
    return low.astype(np.int32)


def enough(both, a, b):
    """Whether sets of ``a`` and ``b`` shingles with ``both`` in common are similar: 4 |a and b| >= 3 |a or b|."""
    return DENOMINATOR * both >= NUMERATOR * (a + b - both)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The same of two sorted distinct arrays; empty ones are similar to nothing."""
    return bool(len(a) and len(b) and enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))


def _sizes_allow(a: str, b: str) -> str:
    return f"{DENOMINATOR} * least({a}, {b}) >= {NUMERATOR} * greatest({a}, {b})"


def _described(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text_key, text in rows:
        found = shingles(text)
        yield doc_id, text_key, len(found), digest(found), signature(found) if len(found) else None


def _sets(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The shingle sets of the texts that have their class's set; another text of the same doc_id may have another set."""
    for node, set_key, n, sig, text in rows:
        found = shingles(text)
        if digest(found) == set_key:
            yield node, n, sig, found.tobytes()


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column of 64-bit numbers, one after another, and each row's first place, the end last."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
    return values.view(np.uint64), (offsets - offsets[0]) // 8


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that agree in MATCHES coordinates and are similar on their full sets."""
    for batch in batches:
        a, b, sig_a, sig_b, set_a, set_b = batch.columns
        agree = (_matrix(sig_a) == _matrix(sig_b)).sum(axis=1) >= MATCHES
        (x, at), (y, bt) = _ragged(set_a), _ragged(set_b)
        keep = np.zeros(batch.num_rows, bool)
        for i in np.flatnonzero(agree):
            keep[i] = similar(x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]])
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))


class Block:
    """Members of a posting list: node, comp, n, mask of their prefix's coordinates, alone, sig, and in the second pass set."""

    def __init__(self, members: pa.StructArray) -> None:
        field = lambda name: members.field(name)
        self.node, self.comp, self.n, self.mask, self.alone = (field(c).to_numpy(zero_copy_only=False).copy() for c in ("node", "comp", "n", "mask", "alone"))
        self.sig = _matrix(field("sig"))
        if members.type.get_field_index("set") >= 0:
            self.shingles, self.start = _ragged(field("set"))

    def common(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the sorted shingles ``found`` each of the members ``at`` has."""
        sizes = self.start[at + 1] - self.start[at]
        first = np.cumsum(sizes) - sizes
        x = self.shingles[np.repeat(self.start[at] - first, sizes) + np.arange(sizes.sum())]
        place = np.searchsorted(found, x)
        place[place == len(found)] = 0
        return np.add.reduceat(found[place] == x, first)


_BITS = np.int64(1) << np.arange(COORDINATES, dtype=np.int64)


def _partners(a: Block, i: int, b: Block, after: int, token: int) -> np.ndarray:
    """The members of ``b`` from ``after`` on that may be similar to a's i-th and have another component.

    A pair belongs to one list only, that of the first coordinate in which both prefixes agree.
    """
    n, alone = a.n[i], a.alone[i]
    ok = (b.comp[after:] != a.comp[i]) & (DENOMINATOR * np.minimum(b.n[after:], n) >= NUMERATOR * np.maximum(b.n[after:], n))
    # Shingles that only one of the two can have bound their similarity from above.
    both = np.minimum(b.n[after:] - b.alone[after:], n - alone)
    ok &= (DENOMINATOR - NUMERATOR) * both >= NUMERATOR * (b.alone[after:] + alone)
    at = np.flatnonzero(ok) + after
    if not len(at):
        return at
    equal = b.sig[at] == a.sig[i]
    agree = equal.sum(axis=1) >= MATCHES
    at = at[agree]
    met = (equal[agree] * _BITS).sum(axis=1) & b.mask[at] & a.mask[i]
    return at[met & np.int64((1 << (token >> 32)) - 1) == 0]


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, Block, bool]]:
    for batch in batches:
        tokens, left, right, same = batch.columns
        for k in range(batch.num_rows):
            is_same = same[k].as_py()
            b = Block(right[k].values)
            yield tokens[k].as_py(), b if is_same else Block(left[k].values), b, is_same


HOPEFUL = ["token", "node", "comp", "mask", "alone"]


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, the members that have a partner."""
    for token, a, b, same in _block_pairs(batches):
        in_a, in_b = np.zeros(len(a.node), bool), np.zeros(len(b.node), bool)
        for i in range(len(a.node)):
            at = _partners(a, i, b, i + 1 if same else 0, token)
            in_b[at] = True
            in_a[i] |= len(at) > 0
        for block, found in ((a, in_a | in_b), (a, in_a[:0])) if same else ((a, in_a), (b, in_b)):
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.sum(), token))] + [pa.array(x[found]) for x in (block.node, block.comp, block.mask, block.alone)], names=HOPEFUL)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, links between similar members that join two components; links within one are left out."""
    for token, a, b, same in _block_pairs(batches):
        links: list[tuple[int, int]] = []
        for i in range(len(a.node)):
            at = _partners(a, i, b, i + 1 if same else 0, token)
            if not len(at):
                continue
            own = a.shingles[a.start[i] : a.start[i + 1]]
            at = at[enough(b.common(own, at), len(own), b.n[at])]
            for old in np.unique(b.comp[at]):
                links.append((a.node[i], b.node[at[b.comp[at] == old][0]]))
                b.comp[b.comp == old] = a.comp[i]
                a.comp[a.comp == old] = a.comp[i]
        if links:
            x, y = (np.array(side, np.int64) for side in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _paired_blocks(members: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of blocks of each posting list that has several components: token, members, others, same.

    ``members``: token, comp, bytes and ``columns``. Members of a list's largest component lie in blocks of their own, and
    those are never paired with each other, so a list that is nearly one component gives few pairs however long it is.
    """
    each = members.groupBy("token", "comp").agg(F.count("*").alias("c"), F.sum("bytes").alias("w"))
    most = F.max(F.struct("c", "w", "comp"))
    per = each.groupBy("token").agg(most.alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    blocks_of = lambda c, w: F.ceil(F.greatest(c / BLOCK_ROWS, w / BLOCK_BYTES))
    per = per.select("token", F.col("main.comp").alias("main"), blocks_of(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).cast("int").alias("q"), blocks_of(F.col("main.c"), F.col("main.w")).cast("int").alias("p"))
    mixed = members.join(per, "token")
    place = F.xxhash64("node")
    dealt = mixed.withColumn("block", F.when(F.col("comp") == F.col("main"), F.col("q") + F.pmod(place, "p")).otherwise(F.pmod(place, "q")).cast("int"))
    blocks = dealt.groupBy("token", "block").agg(F.first("q").alias("q"), F.first("p").alias("p"), F.collect_list(F.struct(*columns)).alias("members"))
    left = blocks.where("block < q").select("token", F.col("block").alias("i"), "members", F.explode(F.sequence("block", F.col("q") + F.col("p") - 1)).alias("j"))
    right = blocks.select("token", F.col("block").alias("j"), F.col("members").alias("others"))
    return left.join(right, ["token", "j"]).select("token", "members", "others", F.expr("i = j").alias("same"))


def _alone(sets: DataFrame) -> DataFrame:
    """node, n, sig, alone of the nodes that can have a link among ``sets`` (node, n, sig, set); alone: shingles no other has.

    A text of which less than 3/4 of the shingles occur in another cannot have one. Texts that share a frequent passage, and
    little else, fall away here before they are compared with each other.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, start = _ragged(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(start))), pa.array(values.view(np.int64))], names=["node", "shingle"])

    each = sets.select("node", "set").mapInArrow(spread, "node long, shingle long")
    lonely = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").alias("alone"))
    known = sets.select("node", "n", "sig").join(lonely, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("long")))
    return known.where(f"{DENOMINATOR} * (n - alone) >= {NUMERATOR} * n")


def _prefixes(classes: DataFrame) -> DataFrame:
    """node, token, found, mask: the rarest shared postings of each class, as many as a link needs; found: shared ones in all."""
    tokens = classes.select("node", F.posexplode("sig").alias("i", "value")).select("node", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("value")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = W.partitionBy("node")
    ranked = tokens.join(shared, "token").withColumns({"at": F.row_number().over(own.orderBy("df", "token")), "found": F.count("*").over(own)})
    kept = ranked.where(f"at + ({COORDINATES} - found) <= {COORDINATES - MATCHES + 1}")
    return kept.select("node", "token", "found", F.expr("bit_or(shiftleft(1L, cast(shiftright(token, 32) as int)))").over(own).alias("mask"))


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n, set_key, sig), classes of equal sets (set_key, node, first doc_id) and components of linked
    classes (node, component)."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = materialise(map_rows(keyed, ["doc_id", "text_key", "text"], "doc_id long, text_key long, n long, set_key binary, sig array<int>", _described))
    grouped = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()))
    prefix = materialise(_prefixes(classes))

    posted = prefix.select("node").distinct()
    wanted = classes.join(posted, "node", "left_semi").select("node", F.col("first").alias("doc_id"), "set_key", "n", "sig")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    found = map_rows(texts, ["node", "set_key", "n", "sig", "text"], "node long, n long, sig array<int>, set binary", _sets)
    sets = materialise(found.dropDuplicates(["node"]))

    # A list's hub is the class of most copies, then the one that has most in common with others: in a group of edited
    # copies that is the original, or the least edited, which links with more of them than any other.
    central = prefix.join(classes.select("node", "copies"), "node").withColumn("rank", F.struct("copies", "found", (-F.col("node")).alias("first")))
    hubs = central.groupBy("token").agg((-F.max("rank")["first"]).alias("hub"))
    stars = prefix.join(hubs, "token").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # Classes that meet a hub in few lists alone are left to the step below, which misses none.
    stars = stars.groupBy("a", "b").count().where(F.col("count") >= STAR_MEETINGS).select("a", "b")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("set").alias(f"set_{x}"))
    arms = stars.join(side("b"), "b").join(side("a"), "a").where(_sizes_allow("n_a", "n_b"))
    first = arms.select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInArrow(_starred, "a long, b long")
    labels = materialise(components(first))

    named = prefix.join(labels, "node", "left").select("token", "node", "mask", F.coalesce("component", "node").alias("comp"))
    mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    between = materialise(named.join(mixed, "token"))
    linkable = materialise(_alone(sets.join(between.select("node").distinct(), "node", "left_semi")))
    members = between.join(linkable, "node").withColumn("bytes", F.lit(8 * COORDINATES))
    hopeful = materialise(_paired_blocks(members, ["node", "comp", "n", "mask", "alone", "sig"]).mapInArrow(_hopeful, ", ".join(f"{c} long" for c in HOPEFUL)).distinct())
    whole = hopeful.join(sets, "node").withColumn("bytes", 8 * F.col("n"))
    second = materialise(_paired_blocks(whole, ["node", "comp", "n", "mask", "alone", "sig", "set"]).mapInArrow(_joining, "a long, b long"))
    if not second.isEmpty():
        joined = materialise(components(second.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))))
        discard(labels)
        labels = joined
    discard(prefix, sets, between, linkable, hopeful, second)
    return rows, classes, labels


def _rooted(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, root (the component, null without words), component_id of every row."""
    rows, classes, labels = link_classes(docs)
    least = labels.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    linked = labels.join(least, "component").select("node", "component", "component_id")
    named = classes.join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(named, "set_key", "left").select("doc_id", "text_key", "n", "root", own.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles, link with nothing and are kept. Rows that share a doc_id are linked by their own
    texts: with equal sets they are one class, with different ones two, which share a component only if linked. A null doc_id
    takes part in nothing, has no component and is not kept. Very long texts are read whole, an empty table gives no rows, and
    columns other than doc_id and text are ignored.
    """
    return _rooted(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("doc_id").isNotNull()).toDF("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id (ties: of the smallest text hash), with all its columns.

    Rows without words are components of their own by doc_id. Of repeated rows one stays. Rows of one doc_id whose texts are
    not linked all stay. Rows with a null doc_id stay, as nothing names them.
    """
    kept = _rooted(docs).where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key")
    keyed = wrapped(docs, doc_id=F.col("doc_id"), text_key=F.xxhash64("text"))
    # The join leaves rows sorted by the keys, so numbering them takes no further sort.
    keys = ["doc_id", "text_key"]
    numbered = keyed.join(kept, keys).withColumn("copy", F.row_number().over(W.partitionBy(*keys).orderBy(*keys)))
    return numbered.where("copy = 1").select("row.*").union(docs.where("doc_id is null"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 4, least(len(w), 1)) + 1 AS BIGINT))) AS i FROM words) AS x),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT s FROM sets GROUP BY s HAVING count(*) > 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets AS a JOIN shared ON a.s = shared.s JOIN sets AS b ON b.s = a.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS root, doc_id FROM documents
  UNION
  SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.doc_id),
roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d JOIN roots ON roots.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
