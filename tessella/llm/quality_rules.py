"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host and line the distinct documents are counted; lines above the limits
are removed, and documents that lose most of their words are rejected.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow, row_key, written

SYMBOLS, SPACES, DIGITS = b"#*$%&|<>", b" \t\n\r\x0b\x0c", bytes(range(0x30, 0x3A))
ZERO_DIGITS = bytes.maketrans(DIGITS, b"0" * 10)


def line_hash(words: list[bytes]) -> int:
    """Of a line in lower case, with single spaces, and every digit as 0; as a signed 64-bit integer."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words).lower().translate(ZERO_DIGITS))
    return h - (1 << 64) if h >> 63 else h


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count, covered, end = Counter(windows), 0, 0
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered += k + 3 - max(k, end)
            end = k + 3
    return covered


def measure(data: bytes | None) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and (hash, words in all its copies) of each line."""
    if not data:
        return 0, 0, 0, 0, 0, []
    words: list[bytes] = []
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            words += own
            h = line_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(data.decode("utf-8", "replace")) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), chars, symbols, dup, repeat_words(words), list(lines.items())


def line_frequency_rules(
    docs: DataFrame,
    host: str = "source",
    max_documents: int = 20,
    max_share: float = 0.01,
    least_kept: float = 0.5,
    texts: bool = False,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text and the ``host`` column), from its whole text.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 50 words, or over half of
    the words in repeated 3-word windows), n_removed_words (words in removed lines), kept, and with ``texts`` the text
    without the removed lines. A line is removed if it stands in more than ``max_documents`` distinct documents of its
    host and in more than ``max_share`` of the host's documents; a document is rejected if less than ``least_kept`` of
    its words remain. A null or empty text has no words and fails; rows of one doc_id count as one document of a
    host; a null host is a host of its own; repeated rows give repeated results; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = [measure(b) for b in batch.column(1).to_pylist()]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {n: [r[k] for r in rows] for k, n in enumerate(names)} | {
            "doc_id": batch.column(0),
            "host": batch.column(2),
            "row": batch.column(3),
            "lines": [[{"line": h, "words": n} for h, n in r[5]] for r in rows],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    stats = written(
        map_arrow(
            docs.select(
                "doc_id", F.col("text").cast("binary"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), row_key("doc_id", "text").alias("row")
            ),
            run,
            f"doc_id {kind}, host string, row bigint, {numbers}, lines array<struct<line:bigint,words:bigint>>",
        ),
        "lines",
    )
    doc = F.struct("doc_id")  # counts a null id too
    each = stats.select("host", "doc_id", "row", F.explode("lines").alias("l")).select("host", "doc_id", "row", "l.*")
    hosts = stats.groupBy("host").agg(F.countDistinct(doc).alias("documents"))
    often = each.groupBy("host", "line").agg(F.countDistinct(doc).alias("n")).where(F.col("n") > max_documents)
    often = often.join(hosts, "host").where(F.col("n") > F.lit(max_share) * F.col("documents")).select("host", "line")
    # Written first, so that the hot lines of `each` meet a table of known size: no shuffle of `each` where it is small
    # (at most one line in max_share of a host's documents for each line of a document), a split of hot keys else.
    often = written(often, "often")
    gone = each.join(often, ["host", "line"]).select("host", "row", "line", "words").distinct()
    gone = gone.groupBy("host", "row").agg(F.sum("words").alias("n_removed_words"), *([F.collect_set("line").alias("removed")] if texts else []))
    rated = (
        stats.drop("lines").join(gone, ["host", "row"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= F.lit(least_kept) * F.col("n_words")))
    )
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]
    if not texts:
        return rated.select(*columns)

    def clean(batch: pa.RecordBatch) -> dict:
        out = []
        for data, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            bad = set(removed or ())
            if data and bad:
                kept = [x for x in data.split(b"\n") if not (own := x.split()) or line_hash(own) not in bad]
                data = b"\n".join(kept)
            out.append(None if data is None else data.decode("utf-8", "replace"))
        return {n: batch.column(n) for n in columns} | {"text": out}

    whole = docs.select(F.col("text").cast("binary").alias("text"), row_key("doc_id", "text").alias("row"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"))
    both = rated.select("host", "row", "removed", *columns).distinct().join(whole, ["host", "row"])
    kinds = ", ".join(f"{n} {both.schema[n].dataType.simpleString()}" for n in columns)
    return map_arrow(both.select(*columns, "removed", "text"), clean, f"{kinds}, text string")
