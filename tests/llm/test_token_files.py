"""Token-id files: the coder's round trip and damage, chunked encoding against the library, files against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skerry.llm import ans
from skerry.llm.chunks import ChunkMemo
from skerry.llm.scratch import Scratch
from skerry.llm.token_files import count_ids, encode_texts, joined_crc, read_documents, read_pieces, token_rows, tokenise_write_read, write_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "　", "a", "Word", "don't", "é", "中文", ".", "12", "<|endoftext|>", "!?", "▁"]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 65_537, 300_001])
def test_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint32)
    coder = ans.Coder(ans.table(np.bincount(ids)))
    block = coder.encode(ids, every=50)
    assert (coder.decode(block) == ids).all()
    lanes = max(1, min(ans.LANES, n // 64))
    segments = -(-n // (lanes * 50))
    for first, last in ((0, 1), (segments - 1, segments), (segments // 2, segments)):
        assert (coder.decode(block, first, last) == ids[first * 50 * lanes : last * 50 * lanes]).all()


def test_coder_is_near_the_entropy_and_finds_damage():
    ids = (np.random.default_rng(1).zipf(1.2, 1 << 19) % 50_000).astype(np.uint32)
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    coder = ans.Coder(ans.table(counts))
    block = coder.encode(ids)
    assert len(block) * 8 < 1.05 * len(ids) * -(share * np.log2(share)).sum()
    for at in (len(block) // 2, len(block) - 3):
        broken = bytearray(block)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        coder.decode(block[:-1])
    with pytest.raises(ValueError):
        coder.encode(np.array([60_000], np.uint32) % len(counts) * 0 + counts.argmin())


def test_frequencies_add_up_with_every_id_present():
    for counts in ([5], [1, 0, 10**12], np.r_[np.ones(50_000, int), 10**9], np.arange(1, 3000)):
        freq = ans.table(np.array(counts))
        assert freq.sum() == 1 << ans.SCALE_BITS and ((freq > 0) == (np.array(counts) > 0)).all()
    assert ans.table(np.zeros(0, int)).sum() == 0


def _odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("prefix", ["", " "])
def test_chunks_are_encoded_as_whole_texts(prefix):
    library = Tokenizer.from_file(PATH)
    memo = ChunkMemo(lambda s: [library.encode(x, add_special_tokens=False).ids for x in s], most=40)
    texts = _odd_texts(1500)
    for i in range(0, len(texts), 50):
        some = texts[i : i + 50]
        assert [[t for c in r for t in c] for r in memo.results(some, prefix)] == [library.encode(prefix + t, add_special_tokens=False).ids for t in some]


def test_words_go_to_the_model_as_the_library_cuts_them():
    library = Tokenizer.from_file(PATH)
    rng, parts = random.Random(8), ["word", "Ärger", "ª", "ß", "ŋ", "ж", "'s", "'", ".", ",", ")", '"', "1", "-", "²", "'ll", "éa", "x\u0301", "<|endoftext|>"]
    texts = [rng.choice(["", " ", "\n", "a "]) + "".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(["", " b", "\nc"]) for _ in range(4000)]
    assert [x.tolist() for x in encode_texts(texts, PATH, None)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _rows():
    texts = [*_odd_texts(40), "", None, " ", "long words and lines\n" * 3000, "x" * 20_000]
    return [(i * 7 % 45, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (None, "other null id", "x", 1), (3, "twice", "x", 1), (3, "twice", "x", 1), (3, None, None, None)]


SCHEMA = "doc_id bigint, text string, part string, n int"


def _brute(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    found = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t, *_ in rows]
    for d, ids in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("sizes", [{}, {"ids_per_file": 3000, "block_ids": 1000}])
def test_files_against_brute_force(spark, sizes):
    rows = _rows()
    got = sorted(tuple(r) for r in ((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenise_write_read(spark.createDataFrame(rows, SCHEMA), PATH, **sizes).collect()))
    want, total = _brute(rows)
    # rows of one id come in the order of a hash, so hold each row and the places taken
    assert sorted((d is None, d or 0, n, c) for _, d, n, c in got) == sorted((d is None, d or 0, n, c) for d, _, n, c in want)
    assert [s for s, *_ in got] == [sum(g[2] for g in got[:i]) for i in range(len(got))] and sum(g[2] for g in got) == total
    assert [g[1] for g in got] == [d for d, *_ in want]
    again = tokenise_write_read(spark.createDataFrame(rows[::-1], SCHEMA), PATH, **sizes)
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in again.collect()) == [(s, n, c) for s, _, n, c in got]


def test_files_hold_the_ids(spark, tmp_path):
    rows = [r for r in _rows() if r[0] is not None and r[0] != 3]
    scratch = Scratch(spark, "test-token-files")
    stored = scratch.write(token_rows(spark.createDataFrame(rows, SCHEMA), PATH), "ids")
    folder = f"file://{tmp_path}/files"
    files = scratch.write(write_files(stored.where("counts is null"), folder, count_ids(stored), 5000, 700), "paths")
    assert files.count() > 3
    parts = sorted((r.start, r.doc, r.ids) for r in read_pieces(files, folder, scratch, with_ids=True).collect())
    by_doc = {}
    for _, doc, ids in parts:
        by_doc.setdefault(doc, []).extend(ids)
    assert by_doc == {d: [*encode_texts([t or ""], PATH, None)[0].tolist(), 0] for d, t, *_ in rows}
    assert read_documents(files, folder, scratch).count() == len(rows)


def test_no_documents(spark):
    assert tokenise_write_read(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_joined_checksums():
    data = np.random.default_rng(0).bytes(10_000)
    cuts = [0, 1, 1, 400, 9_000, 10_000]
    assert joined_crc([(b - a, zlib.crc32(data[a:b])) for a, b in zip(cuts, cuts[1:])]) == zlib.crc32(data)


def test_each_word_is_encoded_once_whatever_stands_around_it():
    from skerry.llm import token_files

    asked = []
    library = token_files._Library(PATH)
    library.model = type("Counted", (), {"tokenize": lambda self, piece, model=library.model: asked.append(piece) or model.tokenize(piece)})()
    words = [f"w{a}{b}é" for a in "abcdefgh" for b in "klmnopqr"]
    words = [w.replace("w", "Ŵo") for w in words]
    ends = ["", ".", ",", "***", "$$$", "&&&,", "'", "…", "|>", "~", "'s", "1"]
    texts = [" ".join(w + e for w in words for e in ends), "\n".join(w + e for e in ends for w in words), "  two  blanks " + words[0], words[1], "\n", "a\r\nb c\n\nd"] * 2
    whole = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in library.ids(texts, b"")] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) <= 2 * len(words) + 40  # with a space before it and without
    assert len(asked) == len(set(asked))


def test_library_ids_of_odd_texts_in_one_call():
    texts = [t for t in _odd_texts(3000, seed=11) if t]
    library = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in encode_texts(texts, PATH, 7)] == [[*library.encode(t, add_special_tokens=False).ids, 7] for t in texts]
