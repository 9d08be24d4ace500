import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import bpe_tree
from kindred.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small_leaves():
    return bpe_tree.TreeBpe(PATH, PATTERN, leaf_bytes=3)


SMALL = bpe_tree.TreeBpe(PATH, PATTERN, leaf_bytes=2)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeEst 'ñ日🙂\n\t\x1c\x85\u3000!1", max_size=120) | st.text(max_size=60) | st.text("aA", max_size=300))
def test_halves_give_what_the_library_gives(library, text):
    ids = SMALL.encode(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert SMALL.bytes_of(ids) == text.encode()


def rows_of(df):
    return sorted(((r.doc_id, list(r.ids)) for r in df.collect()), key=str)


def test_documents(awkward_docs, docs, no_docs, library):
    for df in (awkward_docs, docs):
        got = rows_of(bpe_tree.encode(df, PATH, PATTERN))
        assert got == sorted(((r.doc_id, library.encode_ordinary(r.text or "")) for r in df.collect()), key=str)
        back = bpe_tree.decode(bpe_tree.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
        assert sorted(bytes(r.decoded) for r in back) == sorted((r.text or "").encode() for r in df.collect())
    assert bpe_tree.decode(bpe_tree.encode(no_docs, PATH, PATTERN), PATH, PATTERN).count() == 0


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe_tree.decode(df, PATH, PATTERN).first().decoded) == b""


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_bpe_codec"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_ordinary_words_are_joined(docs):
    """With the leaf in use, words of ordinary text are halved and joined, and give the library's ids."""
    from kindred.llm.bpe_tree import LEAF_BYTES, TreeBpe

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tree, whole = TreeBpe(path, pattern), TreeBpe(path, pattern, leaf_bytes=1 << 20)
    joins, join = [], tree.join
    tree.join = lambda left, right: (joins.append(1), join(left, right))[1]
    texts = [r.text for r in docs.limit(100).collect() if r.text]
    assert all((tree.encode(t) == whole.encode(t)).all() for t in texts)
    assert LEAF_BYTES == 8 and len(joins) > 500
