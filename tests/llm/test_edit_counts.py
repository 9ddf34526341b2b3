"""Edit-aware counts against encoding the whole edited text."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainflow.llm.edit_counts import CountTree, edited_counts, standard_edits, with_trees
from grainflow.llm.encoding import encoder
from grainflow.llm.queries import QUERIES, TOKENIZER
from tests.llm.helpers import SF, docs_frame


def _whole():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _apply(text, edits):
    for at, removed, inserted in edits:
        at = min(max(0, at), len(text))
        text = text[:at] + inserted + text[at + max(0, removed) :]
    return text


def test_random_edits():
    whole, count, rng = _whole(), encoder(TOKENIZER).count, random.Random(5)
    words = ["the", " ", "  ", "été", "it's", "\n", "don't", "12", "a" * 30, "😀", "!!", "\t", "x"]
    for size in (0, 1, 7, 300, 3000):
        text = "".join(rng.choice(words) for _ in range(size))
        tree = CountTree(text, count, 16)
        for _ in range(60):
            edit = (rng.randint(-2, len(text) + 5), rng.choice([0, 0, 1, 3, 40, 500]), rng.choice(["", " ", "new", " two words ", "'", "y" * 90]))
            text = _apply(text, [edit])
            tree.edit(*edit)
            assert tree.text == text and tree.chars[1] == len(text)
            assert tree.total == whole(text)


def test_only_touched_regions_are_encoded():
    text = "some words here " * 20_000
    tree = CountTree(text, encoder(TOKENIZER).count)
    tree.encoded = 0
    tree.edit(150_000, 4, "changed")
    assert 0 < tree.encoded < 5000 and tree.total == _whole()(tree.text)


def test_query_against_brute_force(spark):
    whole = _whole()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_edit_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        n = len(text)
        edited = _apply(text, [(n // 3, 0, " corrected "), (n * 2 // 3, 40, ""), (n + 11, 0, "suffix")])
        assert (r.n_tokens_before, r.n_tokens, r.n_chars) == (whole(text), whole(edited), len(edited))


def test_odd_rows_and_kept_trees(spark):
    docs = docs_frame(spark, [(1, None), (1, None), (None, ""), (3, "a b"), (4, "word " * 5000)]).withColumn("tree", F.lit("clash")).withColumn("edits", standard_edits())
    trees = with_trees(docs, TOKENIZER)
    assert trees.count() == 5
    once = edited_counts(trees, TOKENIZER)
    again = edited_counts(once.withColumn("edits", F.expr("array(named_struct('at', 0L, 'removed', 2L, 'inserted', 'zz'), null)")), TOKENIZER)
    whole = _whole()
    for r in again.collect():
        assert r.n_tokens == whole(r.text) and r.n_chars == len(r.text)
    null_edits = edited_counts(once.withColumn("edits", F.expr("cast(null as array<struct<at:long,removed:long,inserted:string>>)")), TOKENIZER)
    assert all(r.n_tokens == r.n_tokens_before and r.reencoded_chars == 0 for r in null_edits.collect())
    no_tree = edited_counts(docs.withColumn("tree", F.expr("cast(null as struct<chars:array<long>,tokens:array<long>>)")), TOKENIZER)
    assert sorted(r.n_tokens for r in no_tree.collect()) == sorted(r.n_tokens for r in once.collect())
    assert edited_counts(trees.limit(0), TOKENIZER).count() == 0
