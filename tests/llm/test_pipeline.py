"""Each stage of the pipeline on its own input, against a plain version."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from grainflow.llm.common import read, workspace, written
from grainflow.llm.decontaminate import decontaminate
from grainflow.llm.quality import Classifier
from tests.llm.helpers import SF
from tests.llm.test_simhash import similar_groups


def test_stages(spark):
    docs, folder = read(spark, SF, "documents"), workspace(spark, "test_pipeline")
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, SF), f"{folder}/{name}")
        seen[name] = (before, after)
        if name != "tokens":
            assert after.columns == docs.columns
        before = after
    given, kept = seen["quality"]
    scores = {r.doc_id: r.score for r in Classifier(given, read(spark, SF, "labels")).scores().collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s >= 0.3}

    given, kept = seen["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in given.collect())
    groups = similar_groups([t for _, t in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[min(g)][0] for g in groups) and len(groups) < len(rows)

    given, kept = seen["decontamination"]
    leaks = {r.doc_id for r in decontaminate(given, read(spark, SF, "benchmark")).collect()}
    assert leaks and {r.doc_id for r in kept.collect()} == {r.doc_id for r in given.collect()} - leaks

    given, mixed = seen["mixing"]
    words = {r.doc_id: len((r.text or "").split()) for r in given.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 3 * words[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(words.values())) < 0.02 * sum(words.values()) + 500

    given, out = seen["tokens"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = sorted((r.doc_id, zlib.crc32(np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in given.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in out.collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == len(want)
