from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as driver
from tests.llm import cases
from tests.llm.test_minhash import brute_force
from tests.llm.test_packing import check_pieces
from tidecast.llm import decontaminate, quality, toxicity


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in driver.queries() if q.startswith("op") and q[2].isdigit()}
    assert driver.queries()["pipeline"] is corpus_pipeline.run


def test_every_stage_does_its_work(spark, folder):
    docs, labels, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    names = docs.columns
    one, two, three, four, _ = [f for _, f in corpus_pipeline.STAGES]
    rejected = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).where("rejected").collect()}
    after_one = one(spark, docs, folder).cache()
    assert after_one.columns == names
    assert {r["doc_id"] for r in after_one.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    after_two = two(spark, after_one, folder).cache()
    scores, limits, _ = quality.judged(after_one, labels)
    assert after_two.columns == names
    good = {r["doc_id"] for r in quality.decide(scores, limits).where("keep").collect()}
    assert {r["doc_id"] for r in after_two.collect()} == good
    after_three = three(spark, after_two, folder).cache()
    kept = set(brute_force(sorted((r["doc_id"], r["text"]) for r in after_two.collect())))
    assert after_three.columns == names and {r["doc_id"] for r in after_three.collect()} == kept
    after_four = four(spark, after_three, folder).cache()
    dirty = {r["doc_id"] for r in decontaminate.contaminated(after_three, items).collect()}
    assert after_four.columns == names and {r["doc_id"] for r in after_four.collect()} == kept - dirty
    pieces = corpus_pipeline.run(spark, folder).collect()
    check_pieces(pieces, after_four.select("doc_id", "text").collect(), 1024)


def test_stages_stand_tricky_and_empty_tables(spark, folder):
    for docs in (cases.tricky(spark), cases.empty(cases.tricky(spark))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
