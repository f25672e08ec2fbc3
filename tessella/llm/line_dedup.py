"""Line deduplication by deletion neighbourhoods.

Two lines are the same text if their words differ by at most one edit (one word inserted, deleted or replaced). A
line emits all variants with up to one word deleted as hashed keys; lines with an equal variant join, the edit
distance is verified on their words, and the earliest line stays.

Variants are emitted only by lines that can have a partner: within one edit, either the first or the last half of the
words agrees, so lines first emit their halves as keys, and those whose halves no other line has are done.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow, owning, row_key, small_batches, written

#: Shorter lines are left alone, or compared exactly (``short``).
LEAST_WORDS = 5


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def key(tag: str, words: list[bytes]) -> int:
    """Of some words of a line: the tag and the number of words keep unlike keys apart."""
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words), xxhash.xxh32_intdigest(tag) << 32 | len(words)))


def normal(line: bytes) -> list[bytes]:
    """Words of a line, split at white space, with A-Z in lower case."""
    return line.lower().split()


def halves(words: list[bytes]) -> list[int]:
    """Keys of the first and the last half, and of those that a line of one word less would have."""
    n, out = len(words), []
    for size in (n, n - 1):
        head = size // 2
        for tag, part in (("head", words[:head]), ("tail", words[n - (size - head) :])):
            out.append(key(f"{tag} of {size}", part))
    return out


def variants(words: list[bytes]) -> list[tuple[str, int]]:
    """Kind and key of each deletion variant: ``same`` lines of one length that lack the word at the same place,
    ``less`` a line without one word, ``full`` the line itself; ``less`` meets ``full``."""
    out = {("full", key("full", words))}
    for i in range(len(words)):
        rest = words[:i] + words[i + 1 :]
        out.add(("less", key("full", rest)))
        out.add(("same", key(f"without {i}", rest)))
    return sorted(out)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1 :] == b[at + (len(a) == len(b)) :]


def _lines(docs: DataFrame, least: int, short: bool = False) -> DataFrame:
    """doc_id, row, lines: array of line number, hash of its words (128 bits as text-free binary), and half keys.
    With ``short``, also lines of 1 to ``least`` - 1 words, without half keys, so that they have exact partners only."""

    def run(batch: pa.RecordBatch) -> dict:
        out, total = [], []
        for data in batch.column(1).to_pylist():
            rows, n = [], 0
            for k, line in enumerate(data.split(b"\n") if data else ()):
                words = normal(line)
                n += bool(words)
                if len(words) >= least or short and words:
                    keys = halves(words) if len(words) >= least else []
                    rows.append({"line": k, "full": _signed(xxhash.xxh3_64_intdigest(b" ".join(words))), "halves": keys})
            out.append(rows)
            total.append(n)
        return {"doc_id": batch.column(0), "row": batch.column(2), "n_lines": total, "lines": out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", F.col("text").cast("binary"), row_key("doc_id", "text").alias("row")),
        run,
        f"doc_id {kind}, row bigint, n_lines bigint, lines array<struct<line:int,full:bigint,halves:array<bigint>>>",
    )


def _place() -> Column:
    """Order of lines: by doc_id (null first), then row key, then line number."""
    return F.struct("doc_id", "row", "line")


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, removed): doc_id, row, n_lines of each row, and for rows that lose lines: row, removed (line numbers).

    A line goes if an earlier line, itself kept or not, is within one edit. See ``dedup_lines``."""
    scanned = written(_lines(docs, least_words, short), "lines")
    each = scanned.select("doc_id", "row", F.explode("lines").alias("l")).select("doc_id", "row", "l.*")
    firsts = written(
        each.groupBy("full").agg(F.min(F.struct("doc_id", "row", "line", "halves")).alias("p"), F.count("*").alias("n")).select(
            "full", F.struct("p.doc_id", "p.row", "p.line").alias("place"), F.col("p.halves").alias("halves"), "n"
        ),
        "firsts",
    )
    # Lines that share a half with another line.
    keyed = firsts.select("full", F.explode(F.array_distinct("halves")).alias("half"))
    common = keyed.groupBy("half").agg(F.min("full").alias("low"), F.max("full").alias("high")).where("low <> high").select("half")
    wanted = keyed.join(common, "half").select("full").distinct()
    candidates = firsts.select("full", "place").join(wanted, "full")
    by_row = candidates.groupBy("place.row").agg(F.collect_list(F.struct("place.line", "full", "place")).alias("want"))
    source = docs.select(F.col("text").cast("binary").alias("text"), row_key("doc_id", "text").alias("row"))
    with owning():
        texts = source.join(by_row, "row").select("text", "want")

        def pick(batch: pa.RecordBatch) -> dict:
            full, place, words = [], [], []
            for data, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = data.split(b"\n")
                for w in want:
                    full.append(w["full"])
                    place.append(w["place"])
                    words.append(b" ".join(normal(lines[w["line"]])))
            return {"full": full, "place": place, "words": words}

        place_kind = firsts.schema["place"].dataType.simpleString()
        chosen = written(map_arrow(texts, pick, f"full bigint, place {place_kind}, words binary").dropDuplicates(["full"]), "candidates")

        def emit(batch: pa.RecordBatch) -> dict:
            full, kinds, keys, at = [], [], [], []
            for k, (f, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                for kind, value in variants(words.split()):
                    full.append(f)
                    kinds.append(kind)
                    keys.append(value)
                    at.append(k)
            return {"full": full, "place": batch.column(1).take(pa.array(at, pa.int32())), "kind": kinds, "key": keys}

        emitted = map_arrow(chosen.select("full", "place", "words"), emit, f"full bigint, place {place_kind}, kind string, key bigint")
        emitted = written(emitted, "variants")
        # Of each group only its earliest member matters: the others are compared with that one.
        me = F.struct("place", "full")
        group = F.when(F.col("kind") == "same", "same").otherwise("size")
        heads = emitted.groupBy(group.alias("group"), "key").agg(
            F.min(F.when(F.col("kind") == "same", me)).alias("same"),
            F.min(F.when(F.col("kind") == "full", me)).alias("full_head"),
            F.min(F.when(F.col("kind") == "less", me)).alias("less_head"),
            F.count("*").alias("n"),
        ).where("n > 1 and (same is not null or (full_head is not null and less_head is not null))")
        met = emitted.withColumn("group", group).join(heads.drop("n"), ["group", "key"])
        head = F.when(F.col("kind") == "same", F.col("same")).when(F.col("kind") == "less", F.col("full_head")).otherwise(F.col("less_head"))
        pairs = met.withColumn("head", head).where("head.place < place").select("full", F.col("head.full").alias("earlier")).distinct()
        words = chosen.select("full", "words")
        pairs = pairs.join(words, "full").join(words.toDF("earlier", "earlier_words"), "earlier")

        def verify(batch: pa.RecordBatch) -> dict:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            good = [f for f, x, y in zip(batch.column(0).to_pylist(), a, b) if within_one_edit(x.split(), y.split())]
            return {"full": good}

        near = map_arrow(pairs.select("full", "words", "earlier_words"), verify, "full bigint").distinct()
        near = written(near, "near", outlive=True)
    # Every occurrence of a line with an earlier neighbour goes, and of all other lines every occurrence but the first.
    again = each.select("row", "line", "full", _place().alias("place")).join(
        firsts.where("n > 1").select("full", F.col("place").alias("first")), "full"
    ).where("not (place <=> first)").select("row", "line")
    once = each.select("row", "line", "full").join(near, "full").select("row", "line")
    removed = again.unionByName(once).groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    return scanned.select("doc_id", "row", "n_lines"), removed


def without(data: bytes, removed: list[int]) -> bytes:
    gone = set(removed)
    return b"\n".join([x for k, x in enumerate(data.split(b"\n")) if k not in gone])


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, short: bool = False) -> DataFrame:
    """``docs`` without repeated lines, and without the rows that have no words left by that.

    Lines are split at line feeds and compared as words (white space splits, A-Z in lower case). A line of
    ``least_words`` or more goes if an earlier line of any document is within one word edit of it; earlier is by
    doc_id (null first), then by a hash of id and text, then by line. Shorter lines stay, or with ``short`` go if an
    earlier line has the same words, so that no copy survives as its short lines. Rows that had no words before stay
    as they are, null texts null. Repeated rows (same id and text) are one document: what one loses, all lose. All
    columns stay, under any name.
    """
    small_batches(docs.sparkSession)
    _, removed = repeated_lines(docs, least_words, short)
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(row_key("doc_id", "text").alias("row"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = rows.join(removed, "row", "left")
    text = names["text"]

    def run(batch: pa.RecordBatch) -> dict:
        keep, texts = [], []
        column = batch.column(text).to_pylist()
        for k, (t, gone) in enumerate(zip(column, batch.column("removed").to_pylist())):
            if gone:
                t = without(t.encode(), gone).decode("utf-8", "replace")
                if not t.strip(" \t\n\r\x0b\x0c"):
                    continue
            keep.append(k)
            texts.append(t)
        kept = batch.take(pa.array(keep, pa.int64()))
        return {n: kept.column(n) for n in names.values()} | {text: texts}

    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in names.items())
    return map_arrow(rows, run, kinds).toDF(*docs.columns)


def line_report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines (lines with words), n_removed, removed (line numbers from 0),
    kept (some line with words stays, or there was none). The decisions are those of ``dedup_lines`` without ``short``."""
    rows, removed = repeated_lines(docs, least_words)
    joined = rows.join(removed, "row", "left")
    gone = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    n = F.size(gone).cast("bigint")
    return joined.select("doc_id", "n_lines", n.alias("n_removed"), gone.alias("removed"), ((n < F.col("n_lines")) | (F.col("n_lines") == 0)).alias("kept"))
