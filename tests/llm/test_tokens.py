import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, normalizers

from millrace.llm import tokens
from millrace.llm.queries import TOKENIZER
from millrace.session import scratch

from . import awkward


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_the_library(plain):
    rng = random.Random(3)
    letters = " \n\t aé.,'1<|>endoftext 　日🙂sS\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [None, "", "a<|endoftext|> b", "don't I'LL  x"]
    ids, n = tokens.Encoder(TOKENIZER, most=50).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n, strict=True):
        assert ids[e - k : e].tolist() == plain(t)[:-1].tolist()


@pytest.mark.parametrize("kind", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes(kind, n):
    ids = np.random.default_rng(n).integers(0, [3, 70000, 1 << 32][n % 3], n).astype(np.uint32)
    assert (tokens.from_planes(tokens.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", [1, 8])
def test_files_round_trip(spark, plain, kind):
    docs = awkward.frame(spark)
    manifest = tokens.write_id_files(docs, scratch(spark, "ids"), TOKENIZER, chunk_ids=100, kind=kind)
    got = sorted(tokens.read_id_digests(manifest).collect(), key=lambda r: r.start)
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        ids = plain(w.text)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (w.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing(spark, plain):
    docs = awkward.frame(spark)
    got = tokens.packed_pieces(docs, TOKENIZER, window=64).collect()
    by_id = {}
    for r in docs.collect():
        by_id.setdefault(r.doc_id, plain(r.text))
    assert sum(r.length for r in got) == sum(len(plain(r.text)) for r in docs.collect())
    sequences = {}
    for r in got:
        ids = by_id[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(sequences)


def test_empty(spark):
    assert tokens.id_file_digests(awkward.empty(spark), TOKENIZER).count() == 0
    assert tokens.packed_pieces(awkward.empty(spark), TOKENIZER).count() == 0


def test_tokenizers_of_other_kinds(tmp_path):
    """One that lower-cases first must get whole texts; the ids are the library's either way."""


    usual = Tokenizer.from_file(TOKENIZER)
    usual.normalizer = normalizers.Lowercase()
    usual.save(str(tmp_path / "lower.json"))
    texts = ["Some  TEXT here's", None, "", "é İ " * 5, "x" * 1200 + " <|end|> y"]
    for path, by_words in ((str(tmp_path / "lower.json"), False), (TOKENIZER, True)):
        enc = tokens.Encoder(path)
        assert enc.by_words is by_words
        ids, sizes = enc.encode(pa.array(texts, pa.string()))
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_text_longer_than_a_piece(spark):
    long = " ".join(f"word{i % 977} {i}" for i in range(130_000))
    docs = spark.createDataFrame([(1, "a b"), (2, long), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.id_file_digests(docs, TOKENIZER).collect()}
    ids = tokens.encoder(TOKENIZER).tokenizer.encode(long, add_special_tokens=False).ids
    assert len(long) > 1 << 20 and got[2].n_tokens == len(ids) + 1 and got[3].start == got[2].start + got[2].n_tokens
    assert got[2].ids_crc32 == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


def test_memory_of_a_batch_of_texts():
    """Arrays beside the texts are bounded, however large a batch is."""
    import tracemalloc

    column = pa.array([" ".join(f"word{i * j % 997}" for j in range(400)) for i in range(800)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), column], names=["doc_id", "text"])
    assert batch.nbytes > 2_000_000
    whole = tokens.encoder(TOKENIZER).encode(column)
    tracemalloc.start()
    n, ids = [], []
    for part, found, cut in tokens.encoded(iter([batch]), TOKENIZER, None):
        n.append(part.num_rows)
        ids.append(found)
        assert cut[-1] == len(found)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n) == 800 and np.array_equal(np.concatenate(ids), whole[0])
    assert most < 18_000_000, most
