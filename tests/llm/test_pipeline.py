"""The pipeline's stages against brute-force versions, and its scratch tables."""

import random

import pytest
from tokenizers import Tokenizer

from tessella.llm import near_dup
from tessella.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_components, documents, edit, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.01"


def brute_lines(texts):
    """Texts by id after line dedup: long lines within one word edit of an earlier one, short ones that repeat, go."""
    seen, out = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            w = line.lower().split()
            same = any(w == v or min(len(w), len(v)) >= 5 and edit(w, v) <= 1 for v in seen) if w else False
            seen += [w] if w else []
            kept += [] if same else [line]
        text = "\n".join(kept)
        if text.strip() or not (t or "").split():
            out[i] = t if t is None else text
    return out


def brute_cut(text, items):
    """The text without hit words, or None if a twentieth is hit; texts of single spaces."""
    w, hit = (text or "").lower().split(), set()
    for item in items:
        own = item.split()
        size = min(13, len(own))
        hit |= {k for i in range(len(w) - size + 1) for a in range(len(own) - size + 1) if w[i : i + size] == own[a : a + size] for k in range(i, i + size)}
    return None if hit and 20 * len(hit) >= len(w) else [x for k, x in enumerate((text or "").split()) if k not in hit]


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(31)
    pool = [words(rng, rng.randrange(3, 20), 60) for _ in range(40)]
    items = [words(rng, 20, 60) for _ in range(3)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(50)]
    texts += [words(rng, 400, 60) + " " + items[k % 3] + " " + words(rng, 300 * (k % 2), 60) for k in range(6)] + [None, "", " "]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, texts)
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    assert text(corpus_pipeline.lines(spark, docs, str(tmp_path))) == brute_lines(texts)
    component, _ = brute_components(texts)
    assert text(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))) == {i: t for i, t in enumerate(texts) if component[i] == i}
    cut = {i: brute_cut(t, items) for i, t in enumerate(texts)}
    got = text(corpus_pipeline.contamination(spark, docs, str(tmp_path)))
    assert {i: (t or "").split() for i, t in got.items()} == {i: w for i, w in cut.items() if w is not None}
    library = Tokenizer.from_file(tokenizer_path())
    for r in corpus_pipeline.encoding(spark, docs, str(tmp_path)).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)


def test_whole_pipeline_and_its_scratch_tables(spark):
    """Another run takes away nothing that a frame still reads."""
    first = corpus_pipeline.run(spark, DATA)
    near = near_dup.link_components(spark.read.parquet(f"{DATA}/documents.parquet"))
    second = corpus_pipeline.run(spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert near.count() == n and 0.3 * n < first.count() < n and second.count() == first.count()
    assert sorted(map(str, first.select("doc_id", "n_tokens").collect())) == sorted(map(str, second.select("doc_id", "n_tokens").collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null labels, and columns with names that operators use themselves."""
    docs = documents(spark, [None, "", "one two three four five six", "one two three four five six", "x" * 3000])
    for c in ("row", "c0", "m0", "removed", "kept_id", "copy"):
        docs = docs.selectExpr("*", f"1 as {c}")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (docs, docs.where("false")):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "bpe encoding":
                assert now.columns == docs.columns
        assert now.count() <= df.count()
