"""Findings of the review of round 1, each by a case that used to come out wrong."""

import hashlib
import random

from tessella.llm import decontaminate, quality_classifier
from tests.llm.test_operators import documents, words


def test_pipeline_drops_copies_with_short_lines(spark):
    import corpus_pipeline

    rng = random.Random(3)
    body = "\n".join(words(rng, 12) for _ in range(3))
    text = f"Haanth.\n{body}\nThe end of it"
    texts = [text, text, text.upper(), f"{words(rng, 9)}\nthe END  of it\nThe end of all", "Haan\n\nlone words"]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, documents(spark, texts), "").collect()}
    assert kept == {0: text, 3: texts[3].replace("the END  of it\n", ""), 4: texts[4]}


def test_toxic_documents_of_good_quality_are_rejected(spark):
    rng = random.Random(13)
    texts = [words(rng, 80, 300) + "." for _ in range(240)]
    for i in range(240):  # no toxic word stands in many documents; their beginning does
        starts = ["grim" if i % 3 == 0 else "".join(rng.choices("abcdefghij", k=4)) for _ in range(3)]
        texts[i] = " ".join([texts[i], *(f"{s}{rng.randrange(10**5, 10**6)}" for s in starts)])
    docs = documents(spark, texts)
    truth = [(i, 1, int(i % 3 == 0)) for i in range(240)]
    labels = spark.createDataFrame(truth[:160], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_classifier.classify(docs, labels).where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality_classifier.keep_good(docs, labels).collect()}
    assert sum((i in kept) == (not t) for i, _, t in truth[160:]) >= 0.9 * 80


def test_rows_of_one_benchmark_item_count_once(spark, monkeypatch):
    rng = random.Random(17)
    items = [words(rng, 20) for _ in range(3)]
    benchmark = spark.createDataFrame(list(zip((7, 7, 8), items)), "item_id long, text string")
    docs = documents(spark, [" ".join(items)])
    for size in (8 << 20, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        row = decontaminate.find_hits(docs, benchmark).first()
        assert (row["n_items"], sorted(row["items"]), row["items_sha256"]) == (2, ["7", "8"], hashlib.sha256(b"7,8").hexdigest())
