"""Personal data by bootstrapped contextual extraction.

Seed entities (regular expressions for e-mail addresses, IP addresses, card and phone numbers) induce lexical
patterns: the words around them, in three widths. Patterns and the identifier-like tokens that they stand around form a
graph, which Spark scores in rounds: a pattern is as good as the instances it extracts, and an instance as good as its
accepted patterns together. Instances that are good enough join the seeds, so that patterns which no original seed
has can be accepted in the next round. Where an accepted pattern stands, an identifier-like token counts as personal data.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_text, map_arrow, owning, row_key, written

KINDS = ("email", "ip", "card", "phone", "id")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, DIGITS = re.compile("[0-9]"), re.compile("[0-9]+")
SPACE = re.compile(r"\s")
BEFORE = re.compile(r"[^\W\d_]+")
EDGES = ".,;:!?()[]{}\"'<>|*#$%&="
ANY_DIGIT = bytes(range(0x30, 0x3A))
#: Characters before and after a mention in which its context is sought.
REACH = 60


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a run of local characters, @ and a dotted domain, in linear time: from each @ on."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str, digits: bool) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not digits:
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        number = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(number) <= 19 and luhn(number):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a mention, in lower case, ``_`` for the mention: the two words before it, the one before, and the one
    before with the one after. ``^`` and ``$`` stand for the text's start and end where words are lacking; a context
    of these alone is no pattern."""
    before = BEFORE.findall(text[max(0, start - REACH) : start].lower())[-2:]
    after = BEFORE.search(text[end : end + REACH])
    if not before and not after:
        return []
    if len(before) < 2 and start <= REACH:
        before = ["^", *before]
    left = before[-1] if before else ""
    right = after[0].lower() if after else "$" if end + REACH >= len(text) else ""
    out = [f"{left} _ {right}"] if left and right else []
    if left not in ("", "^"):
        out.append(f"{left} _")
        if len(before) > 1:
            out.append(f"{before[0]} {left} _")
    return out


def mentions(text: str, spans: list[tuple[int, int, int]], digits: bool) -> list[tuple[int, int, list[str], str, bool]]:
    """(start, end, patterns, instance, seed) of the seeds, and of the tokens outside them that have a digit."""
    out = [(a, b, text[a:b], True) for _, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    last = 0  # the furthest end of the spans before k
    done, k = 0, 0
    for m in DIGITS.finditer(text) if digits else ():
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not SPACE.match(text[start - 1]):
            start -= 1
        stop = SPACE.search(text, m.end())
        done = stop.start() if stop else len(text)
        token = text[start:done]
        start += len(token) - len(token.lstrip(EDGES))
        token = token.strip(EDGES)
        while k < len(taken) and taken[k][0] < start + len(token):
            last = max(last, taken[k][1])
            k += 1
        if last <= start:
            out.append((start, start + len(token), token, False))
    return [(a, b, p, x, seed) for a, b, x, seed in out if (p := contexts(text, a, b))]


def bootstrap(
    edges: DataFrame, rounds: int = 3, least_confidence: float = 0.5, least_seeds: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) from distinct (pattern, instance, seed) rows: pattern, confidence, support and round of the
    accepted patterns, and instance, trust and round of the instances that were found.

    In each round a pattern's confidence is the mean trust of its instances and its support the number of trusted ones;
    it is accepted with ``least_confidence`` and ``least_seeds`` or more. An instance that is no seed has the chance that
    not all its accepted patterns err, 1 - prod(1 - confidence), and is trusted if that is ``least_confidence`` or more.
    A round is two aggregations with map-side combine and two joins with tables of a row for each instance or
    pattern, which adaptive execution can split; it ends early if nothing was found."""
    trusted = edges.where("seed").select("instance").distinct().withColumns({"trust": F.lit(1.0), "round": F.lit(0)})
    before = -1
    for k in range(1, rounds + 1):
        rated = edges.join(trusted.select("instance", "trust"), "instance", "left").groupBy("pattern").agg(
            F.avg(F.coalesce("trust", F.lit(0.0))).alias("confidence"), F.count("trust").alias("support")
        )
        accepted = written(rated.where((F.col("confidence") >= least_confidence) & (F.col("support") >= least_seeds)), "patterns", outlive=True)
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))
        found = edges.where("not seed").join(accepted, "pattern").groupBy("instance").agg((1 - doubt).alias("trust"))
        found = found.where(F.col("trust") >= least_confidence)
        seeds = trusted.where("round = 0")
        known = trusted.where("round > 0").select("instance", F.col("round").alias("first"))
        found = found.join(seeds.select("instance"), "instance", "left_anti").join(known, "instance", "left")
        found = found.select("instance", "trust", F.coalesce("first", F.lit(k)).alias("round"))
        trusted = written(seeds.unionByName(found), "instances", outlive=True)
        now = trusted.count()
        if now == before:
            break
        before = now
    return accepted, trusted.where("round > 0")


def find_pii(docs: DataFrame, rounds: int = 3, least_confidence: float = 0.5, least_seeds: int = 3) -> DataFrame:
    """One row for each row of ``docs``, from its whole text.

    doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all spans as ``kind:start:end`` by kind, then start,
    comma-joined), n_id (spans that the patterns add), n_spans (all), entities (array of kind, start, end). Code points,
    end exclusive. A null or empty text has no spans; repeated rows give repeated results and count once in the graph;
    other columns are ignored. Identifier-like is a token between white space, less the marks around it, that has a digit
    and no span in it; what ``bootstrap`` accepts decides which of them are added.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for data in batch.column(1).to_pylist():
            digits = bool(data) and len(data.translate(None, ANY_DIGIT)) < len(data)
            if not data or not digits and b"@" not in data:
                rows.append(([], []))
                continue
            text = as_text(data)
            spans = base_spans(text, digits)
            rows.append((spans, mentions(text, spans, digits)))
        return {
            "doc_id": batch.column(0),
            "row": batch.column(2),
            "base": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s, _ in rows],
            "base_sha256": [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in s).encode()).hexdigest() for s, _ in rows],
            "mentions": [
                [{"start": a, "end": b, "patterns": p, "instance": x, "seed": seed} for a, b, p, x, seed in m] for _, m in rows
            ],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "struct<kind:int,start:bigint,end:bigint>"
    scanned = written(
        map_arrow(
            docs.select("doc_id", F.col("text").cast("binary"), row_key("doc_id", "text").alias("row")),
            run,
            f"doc_id {kind}, row bigint, base array<{span}>, base_sha256 string, mentions array<struct<start:bigint,end:bigint,patterns:array<string>,instance:string,seed:boolean>>",
        ),
        "mentions",
    )
    each = scanned.select("row", F.explode("mentions").alias("m")).select(
        "row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"), "m.instance", "m.seed"
    )
    with owning():
        pairs = each.select("pattern", F.xxhash64("instance").alias("instance"), "seed")
        edges = written(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
        good, _ = bootstrap(edges, rounds, least_confidence, least_seeds)
    extra = each.where("not seed").join(good.select("pattern"), "pattern").groupBy("row").agg(
        F.collect_set(F.struct(F.lit(KINDS.index("id")).alias("kind"), "start", "end")).alias("extra")
    )
    empty = F.array().cast(f"array<{span}>")
    joined = scanned.drop("mentions").join(extra, "row", "left").withColumn(
        "entities", F.array_sort(F.concat("base", F.coalesce("extra", empty)))
    )
    names = F.array(*map(F.lit, KINDS))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return joined.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        "base_sha256",
        F.array_join(
            F.transform("entities", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
        ).alias("spans"),
        F.coalesce(F.size("extra"), F.lit(0)).cast("bigint").alias("n_id"),
        F.size("entities").cast("bigint").alias("n_spans"),
        F.transform(
            "entities", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        ).alias("entities"),
    )
