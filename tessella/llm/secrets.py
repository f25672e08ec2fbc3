"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed (SHA-256 of its text). Only pairs of a blob and a rule version
that the ledger has not seen are scanned; findings join back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_text, entering, owning, row_key, small_batches, written

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is a maximal run
#: Formats that issuers publish, each with a string that every match has.
OTHERS = (
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"), "-----BEGIN"),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}"), "gh"),
    ("gitlab", re.compile(r"glpat-[A-Za-z0-9_-]{20,}"), "glpat-"),
    ("slack", re.compile(r"xox[abeprs]-[A-Za-z0-9-]{10,}"), "xox"),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), "eyJ"),
    ("google", re.compile(r"AIza[A-Za-z0-9_-]{35}"), "AIza"),
    ("stripe", re.compile(r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"), "k_"),
    ("npm", re.compile(r"npm_[A-Za-z0-9]{36}"), "npm_"),
    ("pypi", re.compile(r"pypi-[A-Za-z0-9_-]{50,}"), "pypi-"),
    ("bearer", re.compile(r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*"), "earer "),
    ("url", re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,64}@"), "://"),
)
KINDS = ("assign", "access", "hex", *(k for k, *_ in OTHERS))
RULE_VERSION = hashlib.sha256(
    repr([x.pattern for x in (ASSIGN, ACCESS, HEX)] + [(k, p.pattern) for k, p, _ in OTHERS]).encode()
).hexdigest()[:16]


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (_, pattern, hint) in enumerate(OTHERS, 3):
        if hint in text:
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


LEDGER = (
    "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
)


#: Bits that say which rows' texts are wanted: 2,048 bitmaps of 4 KB, 8 MB at every size of the input.
BITS = 1 << 26


def _wanted(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """``versions`` whose ``row`` stands in ``rows``, sorted by row within partitions.

    The bits of the wanted rows, a table of fixed size, are broadcast and drop nearly all others before anything moves;
    a merge join settles the few whose bit is shared."""
    bit = lambda c: F.pmod(F.col(c), F.lit(BITS)) + 1
    bits = rows.groupBy(F.bitmap_bucket_number(bit("row")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit("row"))).alias("bits"))
    at = F.bitmap_bit_position(bit("row")).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = versions.withColumn("bucket", F.bitmap_bucket_number(bit("row"))).join(F.broadcast(bits), "bucket").where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1)
    # An inner join (each row stands in ``rows`` once): a semi-join would be pushed below the bits.
    return near.drop("bucket", "bits").join(rows.distinct().hint("merge"), "row").sortWithinPartitions("row")


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the blobs of ``versions`` (columns ``row``, ``blob`` and ``text``) that ``ledger`` lacks.

    With a ledger, blob names alone meet it first, and each unseen blob is fetched from one row, whose text moves once;
    texts of seen blobs, and other copies of unseen ones, stay where they are. Without one, a copy of each blob moves,
    which is kept on the map side already, so that a blob which is a third of all rows moves once for each map task."""
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        one = versions.groupBy("blob").agg(F.min("row").alias("row"))
        unseen = written(one.join(seen.hint("merge"), "blob", "left_anti").select("row"), "unseen")
        blobs = _wanted(versions, unseen)
    else:
        blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))

    names = ("blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering(__name__)
        last = None
        for batch in batches:
            rows = []
            for blob, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blob == last:  # rows that repeat an id and text stand side by side
                    continue
                last, spans = blob, find_secrets(as_text(data))
                base = [s for s in spans if s[1] < 3]
                counts = (sum(s[1] == k for s in base) for k in range(3))
                rows.append((blob, RULE_VERSION, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    small_batches(versions.sparkSession)
    return blobs.select("blob", F.col("text").cast("binary")).mapInArrow(run, LEDGER)


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every path of ``docs`` (doc_id is the path; several rows of an id are its versions), and the
    ledger rows that are new: append them to the ledger, and the next call scans only what it hasn't seen.

    The first frame has one row for each row of ``docs``: doc_id, blob, n_assign, n_access, n_hex, base_sha256,
    spans (``kind:start:end`` by start, comma-joined; code points, end exclusive). A null text is the empty blob;
    repeated rows share a blob and give repeated rows; rows that the ledger repeats count once; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    paths = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"), row_key("doc_id", "text").alias("row"))
    with owning():
        fresh = written(scan_unseen(paths.select("row", "blob", "text"), ledger), "blobs", outlive=True)
    every = fresh
    if ledger is not None:
        every = fresh.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select(*fresh.columns).dropDuplicates(["blob"]))
    found = paths.select("doc_id", "blob").join(every.drop("rule_version").hint("merge"), "blob")
    return found.select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"), fresh
