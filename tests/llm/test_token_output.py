import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainflow.llm import queries
from grainflow.llm.common import workspace
from grainflow.llm.encoding import Encoder, slices
from grainflow.llm.token_output import from_planes, read_tokens, to_planes, write_tokens
from tests.llm.helpers import SF, docs_frame

NAME = "word_bpe_49k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
OURS = Encoder(NAME, most=5000)


def brute(rows, end=2):
    start, out = 0, []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzAZ019 \t\n\x0b\x1c\x85\xa0'.,!$-_<|>éÉßÿªµ²ÀüİΣςσ̱́ 　中Hh'st")) | st.characters(codec="utf-8"), max_size=40))
def test_pieces_give_the_library_s_ids(text):
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_known_texts():
    for text in ("don't they'll 's ''s", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "H̱ ẖ ẖ", "x" * 5000, "1234567 ²½", ""):
        assert np.frombuffer(OURS.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_slices():
    text = "ab cd\nef " * 50 + "g" * 99
    assert "".join(slices(text, 20)) == text and len(list(slices(text, 20))) > 10


def test_planes():
    ids = np.random.default_rng(0).integers(0, 2**32, 1001, dtype=np.uint32)
    for kind in ("byte", "bit"):
        assert (from_planes(to_planes(ids, kind), len(ids), kind) == ids).all()


def test_round_trip(spark):
    rows = [(None, "no id"), (1, "Hello, World"), (2, None), (3, ""), (4, "don't " * 3000), (5, "same"), (5, "same"), (9, "ÉCOLE naïve 42")]
    for kind in ("byte", "bit"):
        folder = workspace(spark, "test")
        write_tokens(docs_frame(spark, rows).sample(1.0), folder, NAME, 2, kind, chunk_ids=64, shards=3)
        got = read_tokens(spark, folder, with_ids=True).orderBy("start").collect()
        assert [tuple(r)[:4] for r in got] == brute(rows)
        assert got[1].ids == LIBRARY.encode("Hello, World", add_special_tokens=False).ids + [2]


def test_empty(spark):
    folder = workspace(spark, "test")
    assert write_tokens(docs_frame(spark, []), folder, NAME, 2).count() == 0
    assert read_tokens(spark, folder).count() == 0


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()
    got = queries.op1_token_planes(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute([(d["doc_id"], d["text"]) for d in docs])
