"""The pipeline's stages against brute force, and on odd tables."""

import os
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from skerry.llm import bpe, quality, secrets, simhash
from tests.llm.test_operators import _texts, _words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, mix_ref int, sh_fingerprint int, mix_copies string, sh_root bigint"


def _joined(nodes, links):
    """Smallest member of each node's group."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _steps(spark, docs, folder):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, single, clean, mixed, tokens = _steps(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert Counter(r.doc_id for r in good.collect()) == Counter(kept) and all(d.columns == docs.columns for d in (good, single, clean, mixed))
    texts = {r.doc_id: r.text for r in good.collect()}
    single_ids = Counter(r.doc_id for r in single.collect())
    assert max(single_ids.values()) == 1
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in texts.items()}
    prints = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    alike = [(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    close = [(i, j) for i in texts for j in texts if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    root = _joined(texts, alike + close)
    assert {root[i] for i in single_ids} == set(root.values())  # of every group one stays
    assert all(i in single_ids for i in texts if root[i] == i and list(root.values()).count(i) == 1)  # what is like no other stays
    tight = _joined(texts, close)
    assert all(sum(tight[i] == r for i in single_ids) <= 1 for r in set(tight.values()))
    assert sum(i in single_ids and j in single_ids for i, j in alike) <= 0.1 * len(alike)
    assert {r.doc_id: r.text for r in clean.collect()} == {i: secrets.redact(texts[i]) for i in single_ids}
    rows = clean.collect()
    taken, copies = Counter(), Counter(r.doc_id for r in mixed.collect())
    size, source = {r.doc_id: len(_words(r.text)) for r in rows}, {r.doc_id: r.source for r in rows}
    for i, n in copies.items():
        assert i in size and n <= 3
        taken[source[i]] += n * size[i]
    assert abs(sum(taken.values()) - sum(size.values())) <= sum(max(size[i] for i in size if source[i] == s) for s in set(source.values()))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, tuple(other.encode_ordinary(r.text or ""))) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(copies)


def test_stages_on_odd_tables(spark, tmp_path):
    odd = [(i, t, ("en", None)[i % 2], ("s", None, "r")[i % 3], None, 1, 2, "x", 3) for i, t in enumerate(_texts())] + [(None, "null id text " * 30, None, None, 1, 1, 1, None, None)] * 2
    docs = spark.createDataFrame([*odd, odd[0], odd[0]], SCHEMA)
    *kept, last = _steps(spark, docs, f"{tmp_path}/odd")
    assert all(d.columns == docs.columns for d in kept) and last.count() == kept[-1].count()
    assert max(Counter(r.doc_id for r in kept[1].collect()).values()) == 1
    assert _steps(spark, docs.limit(0), f"{tmp_path}/empty")[-1].count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_odd_tables(spark, k):
    odd = [(i, t, None, None, None, 1, 2, "x", 3) for i, t in enumerate(_texts())] + [(None, None, None, None, None, None, None, None, None)] * 3
    docs = spark.createDataFrame(odd, SCHEMA)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.collect() is not None
    if k == 1:
        assert sum(r.doc_id is None for r in out.collect()) == 0  # empty texts with an id stand for them
