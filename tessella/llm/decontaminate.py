"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a bounded number of documents, and its index holds all their words, each document ending a sequence. The test
phrases (windows of benchmark items) are searched backwards through the ranks of a wavelet matrix, occurrences are
located by sampled suffix positions, and the occurrences merge into removal spans. An index knows nothing of the phrases:
a benchmark of any size is searched, block by block, on the same indexes.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import alnum_words, entering, leaving, map_arrow, owning, row_key, small_batches, written
from tessella.llm.fm_index import FMIndex

WINDOW = 13
#: Words of a shard and documents of a shard, at most (one document more may start below the bound).
SHARD_WORDS, SHARD_DOCS = 1_500_000, 4000
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Phrases:
    """The windows of a block of benchmark items, as rows of places in a word list by length, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
        number: dict[str, int] = {}  # rows of one id are one item
        for item, data in items:
            k = number.setdefault(item, len(number))
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in alnum_words(data)]
            size = min(WINDOW, len(ids))
            for a in range(len(ids) - size + 1 if ids else 0):
                windows.setdefault(size, {}).setdefault(tuple(ids[a : a + size]), set()).add(k)
        self.words, self.items = list(vocabulary), list(number)
        self.by_length = []
        for size, found in sorted(windows.items()):
            owners = [sorted(x) for x in found.values()]
            bounds = np.cumsum([0, *map(len, owners)])
            self.by_length.append((size, np.array(list(found), np.int64).reshape(-1, size), bounds, np.array(sum(owners, []), np.int64)))


class _Numbers(dict):
    """Words by their first occurrence, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Shard:
    """The FM-index of a shard of documents (each as words), searched for any phrases."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        ids = np.zeros(len(words) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.parts.append(ids)
        self.size += len(words)

    def build(self) -> Shard:
        self.starts = np.cumsum([0, *map(len, self.parts)])
        self.index = FMIndex(np.concatenate(self.parts), len(self.numbers)) if self.parts else None
        self.parts = []
        return self

    def pack(self) -> bytes:
        return pickle.dumps((list(self.numbers), self.starts, self.index), 5)

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        out = cls()
        words, out.starts, out.index = pickle.loads(data)
        out.numbers.update(zip(words, range(1, len(words) + 1)))
        return out

    def search(self, phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """Per document: merged spans of the words that phrases hit, and the items of these."""
        count = len(self.starts) - 1
        mark = np.zeros(int(self.starts[-1]) + 1, np.int32)
        hits: set[tuple[int, int]] = set()
        symbols = np.array([self.numbers.get(w, 0) for w in phrases.words], np.int64)
        for size, patterns, bounds, owners in phrases.by_length if count else ():
            rows = symbols[patterns]
            able = np.flatnonzero((rows > 0).all(1))  # a word that the shard lacks: no occurrence
            a, b = self.index.search(rows[able])
            met = np.flatnonzero(b > a)
            if not len(met):
                continue
            times = (b - a)[met]
            rows = np.repeat(a[met] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            at = self.index.locate(rows)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + size, -1)
            docs = np.searchsorted(self.starts, at, side="right") - 1
            pairs = np.unique(docs * len(bounds) + np.repeat(able[met], times))
            for d, w in zip((pairs // len(bounds)).tolist(), (pairs % len(bounds)).tolist()):
                hits.update((d, k) for k in owners[bounds[w] : bounds[w + 1]].tolist())
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark) > 0).astype(np.int8), [0]])))
        spans: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        of = np.searchsorted(self.starts, edge[::2], side="right") - 1
        for d, a, b in zip(of.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
            spans[d].append((a - int(self.starts[d]), b - int(self.starts[d])))
        items: list[list[str]] = [[] for _ in range(count)]
        for d, k in sorted(hits):
            items[d].append(phrases.items[k])
        return list(zip(spans, items))


class Blocks:
    """The benchmark's phrases in blocks of about ``BLOCK_BYTES`` of text, one broadcast at a time."""

    def __init__(self, benchmark: DataFrame) -> None:
        self.items = benchmark.where("item_id is not null and text is not null").select(
            F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("data")
        )
        total = self.items.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0
        self.count = -(-int(total) // BLOCK_BYTES) or 1

    def broadcast(self, k: int) -> Broadcast:
        rows = self.items.where(F.pmod(F.xxhash64("item", "data"), F.lit(self.count)) == k).collect()
        return self.items.sparkSession.sparkContext.broadcast(Phrases([(r[0], bytes(r[1])) for r in rows]))


Found = tuple[int, list[tuple[int, int]], list[str]]


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], Shard, list[int]]]:
    """Batches of a shard, its index and the number of words of each row. A batch is cut where a shard is full."""
    entering(__name__)
    held: list[pa.RecordBatch] = []
    shard, sizes = Shard(), []
    for batch in batches:
        begin = 0
        for k, data in enumerate(batch.column(text)):
            words = alnum_words(data.as_py())
            sizes.append(len(words))
            shard.add(words)
            if shard.size >= SHARD_WORDS or len(sizes) >= SHARD_DOCS:
                yield [*held, batch.slice(begin, k + 1 - begin)], shard.build(), sizes
                held, shard, sizes, begin = [], Shard(), [], k + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield held, shard.build(), sizes
    del held, shard
    leaving()


def _searched(batches: Iterator[pa.RecordBatch], text: int, phrases: Phrases) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
    """Batches with what was found in each of their rows."""
    for held, shard, sizes in _shards(batches, text):
        found = [(n, s, i) for n, (s, i) in zip(sizes, shard.search(phrases))]
        at = 0
        for batch in held:
            yield batch, found[at : at + batch.num_rows]
            at += batch.num_rows


SPAN = "struct<start:bigint,end:bigint>"
HIT = f"copy bigint, n_words bigint, spans array<{SPAN}>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(first: list[pa.Array], found: list[Found]) -> pa.RecordBatch:
    spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in found], _SPANS)
    columns = [*first, pa.array([r[0] for r in found], pa.int64()), spans, pa.array([r[2] for r in found], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "n_words", "spans", "items"][-len(columns) :])


def shard_indexes(source: DataFrame) -> DataFrame:
    """A row for each shard of ``source`` (doc_id, text as binary, copy): docs (array of doc_id, copy, n_words) and index."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard, sizes in _shards(batches, 1):
            ids, copies = (pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in (0, 2))
            rows = pa.StructArray.from_arrays([ids, copies, pa.array(sizes, pa.int64())], ["doc_id", "copy", "n_words"])
            docs = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([docs, pa.array([shard.pack()], pa.binary())], ["docs", "index"])

    return source.mapInArrow(run, f"docs array<struct<doc_id:{kind},copy:bigint,n_words:bigint>>, index binary")


def _in_blocks(source: DataFrame, blocks: Blocks) -> DataFrame:
    """What ``find_hits`` merges, for a benchmark of several blocks: the indexes are written once, and each block in its
    turn is broadcast and searched on them."""
    indexes = written(shard_indexes(source), "indexes")
    with owning():
        parts = []
        for k in range(blocks.count):
            phrases = blocks.broadcast(k)

            def run(batches: Iterator[pa.RecordBatch], phrases: Broadcast = phrases) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for docs, index in zip(batch.column(0).to_pylist(), batch.column(1)):
                        found = Shard.unpack(index.as_py()).search(phrases.value)
                        met = [(d, (d["n_words"], *f)) for d, f in zip(docs, found) if f[0]]
                        yield _rows([pa.array([d["copy"] for d, _ in met], pa.int64())], [f for _, f in met])

            parts.append(written(indexes.mapInArrow(run, HIT), "hits"))
            phrases.destroy()
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        merged = every.groupBy("copy").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        merged = written(merged, "merged", outlive=True)
    rows = indexes.select(F.explode("docs").alias("d")).select("d.*").join(merged, "copy", "left")
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows.select("doc_id", "copy", "n_words", "spans", "items"), _merge, f"doc_id {kind}, {HIT}")


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans (merged, of words hit, end exclusive), items (distinct
    ids as strings), n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; null item ids and texts are no items; repeated rows give repeated results;
    other columns are ignored. Nothing is shuffled while the benchmark fits one block; beyond it the indexes are written
    to the shared folder, and the blocks' spans merge by document.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("binary"), row_key("doc_id", "text").alias("copy"))
    blocks = Blocks(benchmark)
    if blocks.count > 1:
        found = _in_blocks(source, blocks)
    else:
        phrases = blocks.broadcast(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, rows in _searched(batches, 1, phrases.value):
                yield _rows([batch.column(0), batch.column(2)], rows)

        found = source.mapInArrow(run, f"doc_id {kind}, {HIT}")
    sizes = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        sizes.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((sizes > 0) & (20 * sizes >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
        "copy",
    )


def _merge(batch: pa.RecordBatch) -> dict:
    out = []
    for spans in batch.column(3).to_pylist():
        merged: list[dict] = []
        for s in spans or ():
            if merged and s["start"] <= merged[-1]["end"]:
                merged[-1]["end"] = max(merged[-1]["end"], s["end"])
            else:
                merged.append(dict(s))
        out.append(merged)
    return {n: batch.column(k) for k, n in enumerate(("doc_id", "copy", "n_words"))} | {"spans": out, "items": [x or [] for x in batch.column(4).to_pylist()]}


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [(m.start(), m.end()) for m in WORD.finditer(data)]
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, data[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows (hits in a twentieth of the words or more) and, in all others, without the
    words hit. All columns stay, under any name; a null text stays null."""
    blocks = Blocks(benchmark)
    if blocks.count > 1:
        hits = find_hits(docs, benchmark).where("n_hit > 0").groupBy("copy").agg(
            F.first("spans").alias("spans"), F.first("contaminated").alias("contaminated")
        )
        names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
        key = row_key("doc_id", "text").alias("copy")
        rows = docs.select(key, *(F.col(f"`{c}`").alias(n) for c, n in names.items())).join(hits, "copy", "left")
        rows = rows.where(~F.coalesce("contaminated", F.lit(False))).drop("contaminated", "copy")
        remove: Callable = lambda b, r: cut(b, [(s["start"], s["end"]) for s in r])

        def apply(batch: pa.RecordBatch) -> dict:
            texts = batch.column(names["text"]).to_pylist()
            spans = batch.column("spans").to_pylist()
            new = [remove(t.encode(), s).decode("utf-8", "replace") if s else t for t, s in zip(texts, spans)]
            return {n: batch.column(n) for n in names.values()} | {names["text"]: new}

        kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in names.items())
        return map_arrow(rows, apply, kinds).toDF(*docs.columns)
    small_batches(docs.sparkSession)
    text, phrases = docs.columns.index("text"), blocks.broadcast(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _searched(_encoded(batches, text), text, phrases.value):
            keep, texts = [], []
            for k, (n_words, spans, _) in enumerate(rows):
                hit = sum(b - a for a, b in spans)
                if hit and 20 * hit >= n_words:
                    continue
                keep.append(k)
                data = batch.column(text)[k].as_py()
                texts.append(None if data is None else (cut(data, spans) if spans else data).decode("utf-8", "replace"))
            out = batch.take(pa.array(keep, pa.int64()))
            yield out.set_column(text, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _encoded(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(text, "text", b.column(text).cast(pa.binary()))
