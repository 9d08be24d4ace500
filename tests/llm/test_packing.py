import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kindred.llm.queries import QUERIES
from kindred.llm.vector_packing import Limits, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(pieces, want, limits):
    """``want``: every document's ids. Pieces cover them once; sequences hold their limits, gapless."""
    by_sequence, spans = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        spans[p.doc_id, p.doc_tokens].append((p.start, ids))
    lengths = []
    for inside in by_sequence.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(inside) <= limits.segments
        assert sum(p.loss_tokens for p in inside) <= limits.loss
        lengths.append(at)
    return spans, lengths


def padding(lengths, full):
    return sum(full - n for n in lengths if n & (n - 1))


def test_awkward(awkward_docs, no_docs, library):
    docs = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in awkward_docs.collect()]
    spans, lengths = check(pack(awkward_docs, PATH).collect(), docs, Limits())
    got = [x for key in spans for x in spans[key]]
    assert sorted(sum((ids for _, ids in got), [])) == sorted(sum((ids for _, ids in docs), []))
    for doc_id, ids in docs:
        if doc_id not in (3, None):
            assert sum((part for _, part in sorted(spans[doc_id, len(ids)])), []) == ids
    assert padding(lengths, 2048) == 0
    assert pack(no_docs, PATH).count() == 0


def test_all_limits_hold(spark, library):
    rows = [(i, "q " * (i % 37), "answer word " * (1 + i * 7 % 90)) for i in range(300)] + [(300, None, "z " * 5000), (301, "p " * 900, None)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    limits = Limits(tokens=256, segments=3, loss=160)
    pieces = pack(df, PATH, limits, prompt="prompt").collect()
    want = {i: sum((library.encode(t or "", add_special_tokens=False).ids for t in (p, x)), []) + [1] for i, p, x in rows}
    spans, lengths = check(pieces, want, limits)
    for (doc_id, total), parts in spans.items():
        assert total == len(want[doc_id]) and sum((ids for _, ids in sorted(parts)), []) == want[doc_id]
    assert len({d for d, _ in spans}) == len(want)


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_packing"](spark, sf).collect()
    ids = {d: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    covered = defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id].append((r.start, r.length))
    for d, spans in covered.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert covered.keys() == ids.keys()


def test_plain_words_are_merged_as_the_library_does(library):
    from random import Random

    from kindred.llm.vector_packing import WordTokens

    rng = Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzAEIOUßàÄéÉñøÿþÐ"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", ".", " ", "'s", "́", "1"]) for _ in range(3000)]
    tokens = WordTokens(PATH)
    assert [np.frombuffer(t, "<u4").tolist() for t in tokens.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
