"""Spelling variants against SQL and against all pairs of words."""

import random
import zlib

import pytest

from grainflow.llm.oracles import SPELLING
from grainflow.llm.queries import op11_spelling_variants
from grainflow.llm.spelling import near_pairs, one_edit, spelling_variants, words_with_gaps
from tests.llm.helpers import SF, docs_frame, spark_rows, sql_rows


def test_against_sql(spark):
    assert spark_rows(op11_spelling_variants(spark, SF)) == sql_rows(SPELLING)


def test_one_edit():
    yes = [("abcdefg", "abcdefx"), ("abcdefg", "xbcdefg"), ("abcdefg", "abcdefgh"), ("abcdefg", "aabcdefg"), ("abcdefg", "abcxdefg"), ("aaaaaaa", "aaaaaaaa")]
    no = [("abcdefg", "abcdefg"), ("abcdefg", "bacdefg"), ("abcdefg", "abxdefy"), ("abcdefg", "abcdxefgh"[:9])]
    assert all(one_edit(a, b) for a, b in yes) and not any(one_edit(a, b) for a, b in no)


def plain_pairs(words):
    from itertools import combinations

    near = lambda a, b: abs(len(a) - len(b)) < 2 and one_edit(*sorted((a, b), key=len))
    return sorted((a, b) for a, b in combinations(sorted(words), 2) if near(a, b))


@pytest.mark.parametrize("q,most,letters", [(3, 20_000, "abcdeé"), (3, 5, "ab"), (2, 20, "ab"), (2, 20_000, "abc")])
def test_pairs_against_all_pairs(spark, q, most, letters):
    """Few letters make crowded shards and repeated q-grams; small ``most`` deals them out."""
    rng = random.Random(7)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(220)}
    for w in sorted(words)[:60]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    found = near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), q, most).collect()
    assert sorted((r.a, r.b) for r in found) == plain_pairs(words)


def test_gaps():
    """The code point at h modulo the length goes where 31 divides h; only A-Z are lower-cased."""
    hits = lambda k, run: zlib.crc32(f"{k}:{run}".encode()) % 31 == 0
    hit = next(k for k in range(10_000) if hits(k, "überfülle") and not hits(k, "überfÜlle"))
    at = zlib.crc32(f"{hit}:überfülle".encode()) % 9
    assert words_with_gaps(hit, "überFÜLLE überfülle ÜBERFÜLLE") == {"überfÜlle": 1, "überfülle"[:at] + "überfülle"[at + 1 :]: 1, "ÜberfÜlle": 1}
    assert words_with_gaps(1, None) == {} and words_with_gaps(1, "1 2 _-") == {}


def test_forms_and_roots(spark):
    """Chains of forms lead to one root; of equally frequent ones the first by code point is the form."""
    words = ["standard"] * 400 + ["standarx"] * 30 + ["standaxx"] * 2 + ["elephants"] * 20 + ["elephantz"] * 20 + ["elephantx"] * 2 + ["lonesome"] * 3 + ["onlyonce"] + ["short"] * 9
    rows = {r.word: r for r in spelling_variants(docs_frame(spark, [(1, " ".join(words))]), every=0).collect()}
    assert set(rows) == {"standard", "standarx", "standaxx", "elephants", "elephantz", "elephantx", "lonesome"}
    assert [(rows[w].form, rows[w].root, rows[w].form_n) for w in ("standaxx", "standarx", "standard")] == [("standarx", "standard", 30), ("standard", "standard", 400), (None, "standard", None)]
    assert (rows["elephantx"].form, rows["elephantx"].n_near) == ("elephants", 2)
    assert (rows["lonesome"].form, rows["lonesome"].root, rows["lonesome"].n_near) == (None, "lonesome", 0)


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, null ids, other columns and empty tables."""
    rows = [(1, None), (2, ""), (None, "wordwork"), (3, "wordwork " * 50_000), (3, "wordwork " * 50_000), (4, "x" * 5000 + " " + "x" * 5001), (4, "x" * 5000 + " " + "x" * 5001)]
    docs = docs_frame(spark, rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    found = {r.word: (r.n, r.n_near) for r in spelling_variants(docs, every=0).collect()}
    assert found == {"wordwork": (100_001, 0), "x" * 5000: (2, 1), "x" * 5001: (2, 1)}
    assert spelling_variants(docs_frame(spark, [])).collect() == []
