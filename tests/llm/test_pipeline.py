"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import zlib

import pytest
import test_decontamination
import test_packing
import test_simhash
import test_suffix_dedup
import test_toxicity

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.workspace import new_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage, each stage run on all that its predecessor kept."""
    pick = random.Random(21)
    labelled = test_toxicity.made(400)
    rows = [(i, t) for i, t, _ in labelled]
    items = [(i, " ".join("q%d" % pick.randint(0, 80) for _ in range(pick.randint(12, 30)))) for i in range(6)]
    clean = [t for _, t, y in labelled if not y and len(t) > 300]
    passage = " ".join("p%d" % pick.randint(0, 500) for _ in range(40))
    rows += [(1000 + i, clean[i]) for i in range(20)]  # exact copies
    rows += [(1100 + i, clean[i] + " word7") for i in range(20)]  # near copies
    rows += [(1200 + i, f"{clean[20 + i]} word{i} {items[i % 6][1]} word{i + 1}") for i in range(12)]  # leaks
    rows += [(1300 + i, f"word{i} {passage} word{2 * i} word{3 * i}") for i in range(12)]  # a shared passage
    rows += [(1400, None), (1401, ""), (None, "word1 word2 of no id"), (1402, "word5 " * 5000)]
    root = new_dir(spark, "pipeline-test")
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    seen, frames = [], [spark.read.parquet(f"{root}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], root)
        path = f"{root}/out-{name}"
        out.write.parquet(path)
        frames.append(spark.read.parquet(path))
        seen.append(name)
    return seen, frames, items, root


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_names_and_columns(stages):
    seen, frames, _, _ = stages
    assert seen == ["toxicity", "simhash", "suffix_dedup", "decontamination", "packing"]
    assert all(f.columns == COLUMNS for f in frames[:-1])


def test_toxicity_keeps_what_scores_low(spark, stages):
    _, frames, _, root = stages
    scored = toxicity.toxicity(frames[0], spark.read.parquet(f"{root}/labels.parquet")).collect()
    low = sorted(str(r.doc_id) for r in scored if r.score < 0.5)
    assert sorted(str(i) for i, _ in pairs(frames[1])) == low and len(low) < frames[0].count()


def test_simhash_keeps_one_of_each_group(stages):
    _, frames, _, _ = stages
    rows = pairs(frames[1])
    want = [i for i, _, least in test_simhash.slow_components(rows) if i is None or i == least]
    assert sorted(map(str, want)) == sorted(str(i) for i, _ in pairs(frames[2])) and len(want) < len(rows)


def test_suffixes_cut_what_a_smaller_document_has(stages):
    _, frames, _, _ = stages
    want = [(i, kept.decode("utf-8", "ignore")) for i, _, _, _, kept in test_suffix_dedup.slow(pairs(frames[2]))]
    rows = frames[3].collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert sum(len(t) for _, t in want) < sum(len(t or "") for _, t in pairs(frames[2]))


def test_contaminated_documents_go(stages):
    _, frames, items, _ = stages
    rows = pairs(frames[3])
    bad = {i for i, t in rows for _, item in items
           if test_decontamination.slow_cover(test_decontamination.words(t)[:400], test_decontamination.words(item))[0] >= 0.8}
    assert sorted(str(i) for i, _ in pairs(frames[4])) == sorted(str(i) for i, _ in rows if i not in bad) and bad


def test_packed_whole(stages):
    _, frames, _, _ = stages
    rows = frames[5].collect()
    test_packing.check(rows, pairs(frames[4]), 2048)
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_run_is_the_stages(spark, stages):
    _, frames, _, root = stages
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = sorted((tuple(r) for r in corpus_pipeline.run(spark, root).select(key).collect()), key=str)
    assert whole == sorted((tuple(r) for r in frames[5].select(key).collect()), key=str)
