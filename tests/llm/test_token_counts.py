import random

import numpy as np
import pytest

from tidemark.llm import token_counts as T
from tidemark.llm.queries import QUERIES

SEP = 50256


def files_of(tmp_path, lists, width=2):
    for k, ids in enumerate(lists):
        (tmp_path / f"{k}.bin").write_bytes(np.array(ids, f"<u{width}").tobytes())


def plain(ids):
    out, n = [], 0
    for x in ids:
        if x == SEP:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


@pytest.mark.parametrize("block_bytes", [2, 6, 64, T.BLOCK_BYTES])
def test_scan_equals_plain_version(spark, tmp_path, block_bytes, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 5)
    rng = random.Random(block_bytes)
    # Id 0xC4 then 0x50 puts the separator's two bytes side by side across ids.
    lists = [[SEP if rng.random() < p else rng.choice([1, 0x5000, 0x00C4, 50255]) for _ in range(rng.randint(0, 120))] for p in (0, 0.02, 0.3, 0.9, 1, 0.1, 0.1)]
    lists += [[], [SEP], [7], [SEP] * 9, [3] * 90 + [SEP]]
    files_of(tmp_path, lists)
    got = {}
    for r in T.count_tokens(T.list_files(spark, str(tmp_path)), SEP, 2, block_bytes).collect():
        got.setdefault(int(r.path.rsplit("/", 1)[1][:-4]), {})[r.ordinal] = r.n_tokens
    for k, ids in enumerate(lists):
        assert [n for _, n in sorted(got.get(k, {}).items())] == plain(ids)
        assert sorted(got.get(k, {})) == list(range(len(plain(ids))))


def test_documents_equal_direct_encoding(spark):
    encode = T.encoder(T.read_vocabulary(T.VOCABULARY)).encode_ordinary
    texts = [None, "", " ", "<|endoftext|>", "one <|endoftext|> two", "Ünï çode 😀", "word " * 20000, "a" * 3000, "\x00\n"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, "twice", 5), (None, "no id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(4)
    got = sorted(map(tuple, T.document_tokens(df, block_bytes=100).collect()), key=str)
    assert got == sorted(((d, len(encode(t or ""))) for d, t, _ in rows), key=str)
    assert T.document_tokens(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    encode = T.encoder(T.read_vocabulary(T.VOCABULARY)).encode_ordinary
    want = {r.doc_id: len(encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, sf).collect()} == want


def test_large_vocabularies_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_bytes(b"YQ== 0")
    with pytest.raises(ValueError):
        T.read_vocabulary(str(tmp_path / "v"))
