"""Near duplicates: a multi-index Hamming join over MinHash signatures, confirmed on whole shingle sets.

A document's signature has parts x size MinHash values cut to 16 bits. Two signatures that differ in fewer
than parts x (ERRORS + 1) values have, by the pigeonhole principle, a part that differs in at most ERRORS of its
values. So each part is indexed under every way to leave out ERRORS of its values, and all pairs within that
distance meet under some key. At a similarity of 0.85 and 16 x 6 values the number of differing values is
binomial(96, 0.15), at 0.8 and 20 x 5 values binomial(100, 0.2): the chance to miss a pair is of the order 1e-5.

Pairs are never listed, only links that span the same components:

1.  Of the documents under a key, each is paired with the smallest. Pairs within the distance are confirmed on whole
    shingle sets. So a group of copies of any size takes a comparison a document and key, not one a pair.
2.  Keys whose documents are still in several components are taken again, in blocks of bounded size: there, documents
    of different components are connected if their signatures are within the distance.
3.  In these clusters, again in blocks, documents of different components are compared by their whole shingle sets. The
    largest component of a cluster is not compared with itself.

Documents with one and the same shingle set are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import discard, likely, sent_if_small, ship, shuffled, table, written
from .graph import components

ERRORS = 1
#: Bounds of a block whose shingle sets are compared, and of one whose signatures are.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_SIGNATURES = 400, 1 << 18, 4096
_U = np.uint64
_A, _B, _C, _D = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MULTIPLIERS = (np.random.default_rng(20).integers(1, 1 << 62, 128, dtype=np.uint64) << _U(1)) | _U(1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: these six white-space characters, and A-Z alone
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _C
    h = (h ^ (h >> _U(27))) * _D
    return h ^ (h >> _U(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the text's distinct ``n``-word shingles; the whole sequence is one if it is shorter; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * _A + w[i : len(w) - k + 1 + i] * _B)
    return np.unique(h)


def layout(percent: int) -> tuple[int, int]:
    """Parts of a signature and values in each."""
    return (16, 6) if percent >= 85 else (20, 5)


def signature(shingles: np.ndarray, values: int) -> np.ndarray:
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[k : k + 2048, None] * _MULTIPLIERS[:values]).min(axis=0), out=least)
    return (mixed(least) >> _U(48)).astype("<u2")


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h & ((1 << 64) - 1)) - (1 << 63), (h >> 64) - (1 << 63)


def left_out(parts: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """(number, from, bytes, from, bytes): what stays of a signature's part, for each part and value that is left out.

    ERRORS is 1, so what stays is what stands before that value and what stands behind it.
    """
    places = [(part, k) for part in range(parts) for k in range(size)]
    return [(part * 1000 + k, 2 * size * part + 1, 2 * k, 2 * (size * part + k + 1) + 1, 2 * (size - k - 1)) for part, k in places]


def keyed(reps: DataFrame, parts: int, size: int) -> DataFrame:
    """(key, rep): the keys of each (rep, sig). One short expression over exploded places, so that it is compiled."""
    names = ("part", "a", "an", "b", "bn")
    places = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, p, strict=True)]) for p in left_out(parts, size)])
    rows = reps.select("rep", "sig", F.explode(places).alias("p")).select("rep", "sig", "p.*")
    return rows.select(F.xxhash64("part", F.substring("sig", F.col("a"), F.col("an")), F.substring("sig", F.col("b"), F.col("bn"))).alias("key"), "rep")


def distance(a: Column, b: Column, values: int) -> Column:
    """Hamming distance of two signatures in values."""
    at = F.sequence(F.lit(1), F.lit(2 * values - 1), F.lit(2))
    return F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(2)) != F.substring(b, i, F.lit(2))))


def _signed(docs: DataFrame, shingle: int, values: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), shingle)
                a, c = set_hash(s)
                n.append(len(s))
                h1.append(a)
                h2.append(c)
                sig.append(signature(s, values).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def close_edges(ids: np.ndarray, comps: np.ndarray, sigs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (a, b) within the distance ``most`` that, with components as they are, connect all that such pairs connect."""
    waiting, links = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not waiting[root]:
            continue
        waiting[root], stack = False, [root]
        while stack:
            x = stack.pop()
            rest = np.flatnonzero(waiting)
            if not len(rest):
                break
            own = comps[rest] == comps[x]
            near = own.copy()
            near[~own] = (sigs[rest[~own]] != sigs[x]).sum(axis=1) <= most
            links += [(int(ids[x]), int(ids[y])) for y in rest[near & ~own]]
            waiting[rest[near]] = False
            stack += rest[near].tolist()
    return links


def spanning_links(ids: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that, with components as they are, connect what all pairs with 100 * intersection >= percent * union connect."""
    n = len(ids)
    label = np.unique(comps, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    ordered, owner = values[order], owner[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    length = np.diff(np.r_[start, len(ordered)])
    group = np.empty(len(values), np.int64)
    group[order] = np.repeat(np.arange(len(start)), length)
    links, ends = [], np.cumsum(sizes)
    for i in range(n):
        if (label == label[i]).all():
            continue
        g = group[ends[i] - sizes[i] : ends[i]]
        g = g[length[g] > 1]
        if not len(g):
            continue
        lens = length[g]
        where = np.repeat(start[g] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
        shared = np.bincount(owner[where], minlength=n)
        near = np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes - shared))
        while len(near := near[label[near] != label[i]]):
            links.append((ids[i], ids[int(near[0])]))
            label[label == label[near[0]]] = label[i]
    return links


_GROUP = ["grp", "low", "high"]


def _in_blocks(rows: DataFrame, docs: int, shingles: int | None = None) -> DataFrame:
    """(grp, low, high, rep, comp) from (grp, rep, comp, n): groups of bounded size in which all pairs of different components meet.

    A group beyond the bounds is cut into blocks, by hash, and each block meets each other one; but the blocks of its
    largest component meet only those of the rest.
    """
    each = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("docs", "shingles", "comp")).alias("most")
    size = each.groupBy("grp").agg(most, F.count(F.lit(1)).alias("comps"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).filter("comps > 1")
    blocks = lambda d, s: F.greatest(F.ceil(d / docs), F.ceil(s / shingles) if shingles else F.lit(0)).cast("int")
    size = size.select("grp", F.col("most.comp").alias("largest"), blocks(F.col("docs"), F.col("shingles")).alias("whole"), blocks(F.col("most.docs"), F.col("most.shingles")).alias("large"), blocks(F.col("docs") - F.col("most.docs"), F.col("shingles") - F.col("most.shingles")).alias("small"))
    placed = rows.join(shuffled(size), "grp")
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), n)).cast("int")
    large = (F.col("whole") > 1) & (F.col("comp") == F.col("largest"))
    block = F.when(F.col("whole") <= 1, 0).when(large, F.col("small") + spread(F.col("large"))).otherwise(spread(F.col("small")))
    last = F.when(F.col("whole") <= 1, 0).when(large, F.col("small") - 1).otherwise(F.col("small") + F.col("large") - 1)
    placed = placed.select("grp", "rep", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return placed.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "comp")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """The rows of each group, as tuples of ``columns``; rows come sorted."""
    now, held = None, []
    for b in batches:
        for *key, row in zip(*[b.column(c).to_pylist() for c in _GROUP], zip(*[b.column(c).to_pylist() for c in columns], strict=True), strict=True):
            if key != now:
                if held:
                    yield held
                now, held = key, []
            held.append(row)
    if held:
        yield held


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=_LINKS)


def _connected(met: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """(a, b) from (grp, rep, comp): links within the distance that connect the groups' components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "rep", "comp", "sig"):
            ids, comps, sigs = zip(*rows, strict=True)
            yield _links_of(close_edges(np.array(ids), np.array(comps), np.frombuffer(b"".join(sigs), "<u2").reshape(len(ids), -1), most))

    blocks = _in_blocks(met.withColumn("n", F.lit(0)), BLOCK_SIGNATURES)
    return _grouped(blocks.join(shuffled(reps.select("rep", "sig")), "rep").select(*_GROUP, "rep", "comp", "sig")).mapInArrow(run, "a long, b long").distinct()


def _confirmed(met: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) from (grp, low, high, rep, comp): links that whole shingle sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "rep", "comp", "text"):
            found = [(r, c, s) for r, c, t in rows if len(s := shingle_set(t, shingle))]
            yield _links_of(spanning_links(*map(list, zip(*found, strict=True)), percent) if len(found) > 1 else [])

    met = written(met, "met", small=True)
    if met.limit(common.SENT_ROWS + 1).count() <= common.SENT_ROWS:
        met = F.broadcast(met)
    else:
        texts, met = likely(texts, "doc_id", met.select("rep")), shuffled(met)
    return _grouped(texts.join(met, F.col("doc_id") == F.col("rep")).select(*_GROUP, "rep", "comp", "text")).mapInArrow(run, "a long, b long")


def _stars(met: DataFrame, reps: DataFrame, values: int, most: int) -> DataFrame:
    """(grp, low, high, rep, comp) from (key, rep, hub): hubs with those within the distance, in blocks of bounded size."""
    pairs = met.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    own = lambda name: reps.select(F.col("rep").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n").alias(f"n_{name}"))
    pairs = pairs.join(shuffled(own("a")), "a").join(shuffled(own("b")), "b").filter(distance(F.col("sig_a"), F.col("sig_b"), values) <= most)
    pairs = written(pairs.select("a", "b", "n_b"), "stars", small=True)
    size = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n_b") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = pairs.join(shuffled(size), "a").select(F.col("a").alias("grp"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("low"), F.lit(0).alias("high"), F.col("b").alias("rep"))
    hubs = size.select(F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("low"), F.lit(0).alias("high"), F.col("a").alias("rep"))
    return placed.unionByName(hubs).withColumn("comp", F.col("rep"))


def near_components(docs: DataFrame, *, shingle: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 times the intersection of their shingle sets is at least ``percent`` times the
    union; component_id is the smallest id reachable. Null, empty and wordless texts have no shingles and are
    alone. Repeated rows are given each; rows that repeat an id with another text share its component. Rows
    with a null id get the component of their text, never ``kept``. Other columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    if percent < 80:
        raise ValueError("the index is laid out for similarities of 0.8 and more")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    parts, part_size = layout(percent)
    values, most = parts * part_size, parts * (ERRORS + 1) - 1
    signed = written(_signed(texts, shingle, values), "signatures")
    reps = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).filter("rep is not null")
    reps = written(reps, "classes")
    keys = keyed(reps, parts, part_size)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("rep").alias("hub")).filter("docs > 1").drop("docs")
    met = written(keys.join(shuffled(shared), "key"), "keys", small=True)
    first = components(_confirmed(_stars(met, reps, values, most), texts, shingle, percent))
    comp = F.coalesce("component", "rep").alias("comp")
    rows = met.join(shuffled(first), F.col("rep") == F.col("node"), "left").select(F.col("key").alias("grp"), "rep", comp)
    apart = rows.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("grp")
    rows = written(rows.join(apart, "grp"), "apart", small=True)
    joined = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    clusters = components(_connected(rows, reps, most).unionByName(joined))
    left = rows.select("rep", "comp").distinct().join(shuffled(clusters), F.col("rep") == F.col("node")).join(shuffled(reps.select("rep", "n")), "rep")
    blocks = _in_blocks(left.select(F.col("component").alias("grp"), "rep", "comp", "n"), BLOCK_DOCS, BLOCK_SHINGLES)
    found = components(joined.unionByName(_confirmed(blocks, texts, shingle, percent)))
    discard(met, rows)
    classes = reps.select("h1", "h2", "rep").join(shuffled(found), F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_near_copies(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are not their component's smallest id; rows with a null id stay."""
    judged = near_components(docs, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col)
    gone = judged.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(sent_if_small(gone, "gone"), id_col, "left_anti").select(*docs.columns)


def op9_neardup(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
