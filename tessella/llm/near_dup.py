"""Near-duplicate documents by circulant MinHash.

All signature coordinates come from two permutations of the shingle universe: the first scatters the shingles, the
second, circularly shifted by one more step for each coordinate, ranks them (C-MinHash). The coordinates are banded;
documents that share a band's bucket are candidates, and links are confirmed by the Jaccard similarity of the
full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import components, entering, keeps, map_arrow, owning, space_words, written

SHINGLE = 5
#: Coordinates of a signature: so many bands of so many rows. At a similarity of 0.75 a pair meets in no band with
#: a chance of (1 - 0.75 ** 4) ** 30, about 1e-5.
BANDS, ROWS = 30, 4
#: Coordinates of a sketch, four bits each, and standard deviations beyond the expected number of differences at
#: the threshold from which a pair isn't compared in full (a chance of about 3e-6).
SKETCH, SPREAD = 1024, 4.5
#: Documents of a block: the open documents of a bucket are compared block by block.
BLOCK = 512
#: A bucket of more than PARTS blocks is split first, by so many bands of so many further coordinates (the sketch's):
#: a pair at a similarity of 0.75 meets in none with a chance of (1 - 0.75 ** 8) ** 128, about 1e-6.
PARTS, PART_ROWS = 128, 8
_CHUNK = 40_000


def _mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rank32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
keeps(__name__, _hashes.clear)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter; of no words: none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
    return np.unique(h)


def signatures(sets: list[np.ndarray], width: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash signatures of non-empty shingle sets, so many coordinates each."""
    out = np.empty((len(sets), width), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        # The first permutation scatters shingles over the universe of 32-bit integers.
        placed = (_mix64(np.concatenate(sets[at:end])) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(out.shape[1]):
            # The second one, shifted circularly by k: the rank of the place k steps before.
            out[at:end, k] = np.minimum.reduceat(_rank32(placed - np.uint32(k)), starts)
        at = end
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    rows = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    for k in range(rows.shape[2]):
        keys = _mix64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return keys.view(np.int64)


def _parts(texts: DataFrame) -> DataFrame:
    """doc and parts: the bands that split very large buckets."""

    def run(batch: pa.RecordBatch) -> dict:
        found = signatures([shingle_hashes(space_words(b)) for b in batch.column(1).to_pylist()], PARTS * PART_ROWS)
        return {"doc": batch.column(0), "parts": list(band_keys(found, PARTS))}

    return map_arrow(texts.select("doc", F.col("text").cast("binary")), run, "doc bigint, parts array<bigint>")


def _sketched(texts: DataFrame) -> DataFrame:
    """doc and sketch: the lowest four bits of each of SKETCH coordinates, sixteen in a long."""

    def run(batch: pa.RecordBatch) -> dict:
        found = signatures([shingle_hashes(space_words(b)) for b in batch.column(1).to_pylist()], SKETCH)
        nibbles = (found & np.uint32(15)).astype(np.uint64).reshape(len(found), SKETCH // 16, 16)
        packed = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)
        return {"doc": batch.column(0), "sketch": list(packed)}

    return map_arrow(texts.select("doc", F.col("text").cast("binary")), run, "doc bigint, sketch array<bigint>")


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket, of different components and like size, whose sketches leave a link possible.

    ``rows``: bucket, part, doc, n, component, sketch, buckets (all open buckets of the document, sorted). The members of
    a part of a bucket are dealt into blocks, and every pair of blocks is a small dense comparison of its own, so no task
    holds a large bucket. A pair that shares several buckets is given by the lowest of them only; one that shares several
    parts of it is given by each."""
    chance = (1 - percent / 100) * 15 / 16
    most = int(SKETCH * chance + SPREAD * (SKETCH * chance * (1 - chance)) ** 0.5) + 1
    sizes = rows.groupBy("bucket", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, ["bucket", "part"]).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(
        "bucket", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc", "n", "component", "sketch", "buckets"
    )
    dealt = dealt.repartition("bucket", "part", "low", "high").sortWithinPartitions("bucket", "part", "low", "high")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        _, _, low, high = group[0][:4]
        left = [r for r in group if r[4] == low]
        right = left if low == high else [r for r in group if r[4] == high]
        if not left or not right or len(group) < 2:
            return []
        side = lambda part: (np.array([r[5] for r in part]), np.array([r[6] for r in part]), np.array([r[7] for r in part]), np.array([r[8] for r in part], np.int64).view(np.uint64))
        (da, na, ca, sa), (db, nb, cb, sb) = side(left), side(right)
        out = []
        for k in range(len(left)):
            able = (cb != ca[k]) & (100 * np.minimum(nb, na[k]) >= percent * np.maximum(nb, na[k]))
            able &= (db > da[k]) if low == high else (db != da[k])
            at = np.flatnonzero(able)
            if len(at):
                x = sb[at] ^ sa[k]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1)
                for j in at[differ <= most].tolist():
                    shared = set(left[k][9]).intersection(right[j][9])
                    if min(shared) == group[0][0]:
                        out.append((int(min(da[k], db[j])), int(max(da[k], db[j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering(__name__)
        held: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:4] != held[0][:4]:
                    found += compare(held)
                    held = []
                held.append(row)
            yield _pairs(found)
        if held:
            yield _pairs(compare(held))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _signed(docs: DataFrame) -> DataFrame:
    """doc, n_shingles, content (128-bit hash of the word sequence; null without words), bands."""

    def run(batch: pa.RecordBatch) -> dict:
        words = [space_words(b) for b in batch.column(1).to_pylist()]
        sets = [shingle_hashes(w) for w in words]
        full = [k for k, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        if full:
            for k, row in zip(full, band_keys(signatures([sets[k] for k in full]))):
                bands[k] = row
        return {
            "doc": batch.column(0),
            "n_shingles": [len(s) for s in sets],
            "content": [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words],
            "bands": bands,
        }

    return map_arrow(
        docs.select("doc", F.col("text").cast("binary")), run, "doc bigint, n_shingles bigint, content binary, bands array<bigint>"
    )


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total) with sizes of intersection and union of the full sets of 5-word shingles.

    Both joins bring texts to pairs; a text that stands in very many pairs is split by adaptive execution. Joins with
    texts are sort-merge joins at every size: what they move grows with the input, without a step where a table of
    ids outgrows a broadcast."""
    left, right = (texts.select(F.col("doc").alias(c), F.col("text").cast("binary").alias(f"text_{c}")) for c in "ab")
    rows = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def sets(data: bytes) -> set:
        w = space_words(data)
        return set(zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else {tuple(w)}

    def run(batch: pa.RecordBatch) -> dict:
        shared, total, last, own = [], [], None, set()
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if a != last:
                last, own = a, sets(x)
            other = sets(y)
            both = len(own & other)
            shared.append(both)
            total.append(len(own) + len(other) - both)
        return {"a": batch.column(0), "b": batch.column(1), "shared": shared, "total": total}

    return map_arrow(rows, run, "a bigint, b bigint, shared bigint, total bigint")


def link_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text): one row for each doc_id, from whole texts.

    doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept. Two documents are
    linked if 100 * intersection >= percent * union of their sets of 5-word shingles. Documents without words have no
    shingles and no links; rows of one doc_id: the one with the smallest text counts; a null doc_id is left out;
    other columns are ignored.

    Copies (one word sequence) count once, by their smallest id. Among the rest, candidates are those that share a
    bucket; a bucket is resolved when all its members are in one component or all pairs of members from different
    components were compared. It is first compared with one member, the one that shares most buckets with
    others, which resolves groups of copies in one round of linear size. What stays apart is compared pair by pair:
    first by longer sketches (circulant MinHash again, over the open documents only), then, where these leave a link
    possible, by full sets.
    """
    return _linked(docs, percent, _repeats(docs))


def _linked(docs: DataFrame, percent: int, repeats: bool) -> DataFrame:
    one = docs.where("doc_id is not null")
    one = one.groupBy("doc_id").agg(F.min("text").alias("text")) if repeats else one
    texts = one.select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    signed = written(_signed(texts), "signatures")
    reps = signed.where("content is not null").groupBy("content").agg(F.min("doc").alias("rep"))
    reps = written(reps, "copies")
    with owning():  # all but signatures, copies and components goes
        spread = signed.join(reps.select(F.col("rep").alias("doc")), "doc").select(
            "doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")
        )
        shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        # Written first: a join of two scans, whose hot buckets adaptive execution can split.
        shared = written(shared, "shared")
        buckets = written(spread.join(shared.hint("merge"), "bucket").select("bucket", "doc", "n", "size"), "buckets")
        rank = buckets.groupBy("doc").agg(F.sum("size").alias("rank"))
        members = written(buckets.join(rank, "doc").select("bucket", "doc", "n", F.struct("rank", -F.col("doc")).alias("rank")), "members")
        wanted = members.select("doc").distinct()
        candidate_texts = written(texts.join(wanted.hint("merge"), "doc"), "texts")

        near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  a link needs sets of like size
        def confirmed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
            done = written(_confirmed(pairs.distinct(), candidate_texts), "confirmed")
            return done.select("a", "b"), done.where(100 * F.col("shared") >= percent * F.col("total")).select("a", "b")

        def labelled(links: DataFrame) -> DataFrame:
            return written(components(links), "components", outlive=True).withColumnRenamed("node", "doc")

        # One document of each bucket with all others of it.
        pivots = members.groupBy("bucket").agg(F.max(F.struct("rank", "doc", "n")).alias("p"))
        pivots = written(pivots.select("bucket", F.col("p.doc").alias("a"), F.col("p.n").alias("a_n")), "pivots")
        stars = members.join(pivots.hint("merge"), "bucket").where((F.col("doc") != F.col("a")) & near(F.col("n"), F.col("a_n")))
        checked, links = confirmed(stars.select("a", F.col("doc").alias("b")))
        labels = labelled(links)
        # What is in different components of a bucket still.
        now = members.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        ends = now.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        mixed = written(ends.where("least <> most").select("bucket"), "mixed")
        rows = written(now.join(mixed, "bucket"), "open")
        if not rows.isEmpty():
            own = rows.groupBy("doc").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
            sketches = written(_sketched(candidate_texts.join(own.select("doc").hint("merge"), "doc")), "sketches")
            sizes = written(rows.groupBy("bucket").agg((F.count("*") > BLOCK * PARTS).alias("huge")), "sizes")
            whole = rows.withColumn("part", F.lit(0).cast("bigint"))
            if not sizes.where("huge").isEmpty():
                rows = written(rows.join(sizes.hint("merge"), "bucket"), "sized")
                huge = rows.where("huge")
                wanted = candidate_texts.join(huge.select("doc").distinct().hint("merge"), "doc")
                split = huge.join(written(_parts(wanted), "parts").hint("merge"), "doc").withColumn("part", F.explode("parts"))
                whole = rows.where("not huge").withColumn("part", F.lit(0).cast("bigint")).unionByName(split.drop("parts"))
            rows = whole.join(own, "doc").join(sketches, "doc")
            pairs = _open_pairs(rows.select("bucket", "part", "doc", "n", "component", "sketch", "buckets"), percent)
            seen = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            _, more = confirmed(pairs.join(seen, ["a", "b"], "left_anti"))
            labels = labelled(links.unionByName(more))
    of_rep = reps.join(labels.withColumnRenamed("doc", "rep"), "rep", "left")
    of_rep = of_rep.select("content", F.coalesce("component", "rep").alias("component"))
    result = signed.select("doc", "n_shingles", "content").join(of_rep, "content", "left")
    component = F.coalesce("component", "doc")
    return result.select(
        F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("doc") == component).alias("kept")
    )


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id stands in several rows."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def keep_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (of repeated rows one with the smallest
    text). Rows with a null doc_id stay. All columns stay, under any name."""
    repeats = _repeats(docs)
    kept = _linked(docs, percent, repeats).where("kept").select(F.col("doc_id").alias("kept_id"))
    names = [f"`{c}`" for c in docs.columns]
    if repeats:
        order = F.struct("text", *(F.col(n).cast("string") for n in names))
        first = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*names), order).alias("w"))
        docs = first.select("w.*").unionByName(docs.where("doc_id is null"))
    own = docs.select(F.col("doc_id").alias("id"), F.struct(*names).alias("whole"))  # apart from names that the table has
    joined = own.join(kept, F.col("id") == F.col("kept_id"), "left").where("id is null or kept_id is not null")
    return joined.select(*(F.col(f"whole.{n}") for n in names))
