"""Each stage of the pipeline on its own input, against what brute force says."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_text_operators import leaks, near_want, word_list

from fieldloom.llm import toxicity


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "mixing", "token_shards"]
    stage = dict(corpus_pipeline.STAGES)
    every = {r.doc_id: r.text for r in docs.collect()}

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = stage["toxicity"](spark, docs, folder).cache()
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.toxic_score for r in toxicity.toxicity(docs, model).collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, s in scores.items() if s < toxicity.CUT}

    unique = stage["ngram_join"](spark, clean, folder).cache()
    want = {c for _, c, _, _ in near_want([(r.doc_id, r.text) for r in clean.collect()])}
    assert {r.doc_id for r in unique.collect()} == want and unique.count() == len(want)

    safe = stage["decontamination"](spark, unique, folder).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in leaks([(r.doc_id, r.text) for r in unique.collect()], items) if n}
    assert hit and {r.doc_id for r in safe.collect()} == {r.doc_id for r in unique.collect()} - hit

    mixed = stage["mixing"](spark, safe, folder).cache()
    sizes = {r.doc_id: len((r.text or "").split()) for r in safe.collect()}
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.split())
        assert r.text == every[r.doc_id]
    half = sum(sorted(sizes.values())[-len({r.source for r in safe.collect()}):]) / 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= half and all(taken[d] in (sizes[d], 2 * sizes[d]) for d in taken)

    index = stage["token_shards"](spark, mixed, folder)
    begun = index.selectExpr("explode(arrays_zip(doc_ids, starts)) AS d").where("d.starts >= 0").select("d.doc_ids")
    assert Counter(r[0] for r in begun.collect()) == Counter(r.doc_id for r in mixed.collect())


def test_stages_take_awkward_tables(spark, folder, edge, nothing):
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        begun = rows.selectExpr("explode(starts) AS s").where("s >= 0")
        assert begun.count() == docs.count()
    assert word_list("É a-B") == ["É", "a", "b"]
