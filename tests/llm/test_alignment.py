"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from skerry.llm.alignment import align
from tests.llm.test_token_files import PARTS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, batch string, n_a int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _brute(rows):
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}

    def a_bytes(i):
        return bytes(back[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    parsed = []
    for doc, text, *_ in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            parsed.append((doc, [], [], [], []))
            continue
        ends = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            at, here = 0, []
            for i in ids:
                at += len(of(i))
                here.append(at)
            ends.append(here)
        cuts, groups, links = sorted(set(ends[0]) & set(ends[1])), [], []
        for low, high in zip([0, *cuts], cuts):
            sides = [[i for i, e in zip(ids, es) if low < e <= high] for ids, es in zip((a, b), ends)]
            groups.append("|".join(",".join(map(str, s)) for s in sides))
            links.append((sides[0][-1], sides[1][-1]))
        parsed.append((doc, a, b, groups, links))
    counts = Counter(x for *_, links in parsed for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [
        (d, len(a), len(b), len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, g, k in parsed
    ]


def _rows():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    texts += ["", None, " ", "\n", "\nstarts with a line", "  two spaces", "ends \n", "Words of a text, an éclair; wordy worries 1234.\nNext line" * 200, "x" * 5000, "a▁b", "same text", "same text", "<s> </s> <unk> <0x0A>", "ﬁ ＡＢ é ​"]
    return [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id and words", None, None), (3, "twice", "y", 2), (3, "twice", "y", 2)]


@pytest.mark.parametrize("limits", [{}, {"batch_rows": 7, "batch_chars": 300}])
def test_alignment_against_whole_texts(spark, limits):
    got = align(spark.createDataFrame(_rows(), SCHEMA), A, B, **limits)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(_brute(_rows()))


def test_alignment_of_no_documents(spark):
    assert align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    assert [tuple(r) for r in align(spark.createDataFrame([(1, None, None, None)], SCHEMA), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
