import base64
import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers as P

from granary.llm import bpe, token_file
from granary.session import scratch

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello  world's 12,345 <|endoftext|> don't!'s", "naïve ÀÉß ÿ Ǆ \u0130 e\u0301 \u00a0x\u2003y\x1cz\x85w", "日本語 текст ΑΣ", "a" * 200_000, "word " * 50_000, "x\n\n  y\t \r\n z ", "🙂 \ud7ff ok", "no.spaces," * 9000]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library_and_round_trips(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(TEXTS, 10**6)), "doc_id bigint, text string")).selectExpr("*", "1 AS n_tokens", "'x' AS d", "2 AS ids")
    want = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect()}
    assert got == want
    ids = bpe.encoded(docs)
    assert {r["doc_id"]: bytes(r["data"]) for r in bpe.decoded(ids).collect()} == {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert bpe.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 3, 10, 100])
def test_safe_boundaries(library, most):
    codec = bpe.Codec()
    for text in [t for t in TEXTS if t and len(t) < 1000] + ["it's  a   'll b\n\n c 's", "  lead", "trail  ", "a\u00a0b \u2003c", "!\x1c?\x1f!! \x1d .\x85?\u00a0!\x0b,\x0c;"]:
        assert "".join(codec.pieces(text, most)) == text
        assert codec.encode(text, most) == library.encode_ordinary(text)


def test_encoder_matches_the_library(spark):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_file.Encoder(P.path("word_bpe_49k.json"), most=5000)
    assert own.by_word
    rng = np.random.default_rng(5)
    marks = list("aAzÉéßΣς×÷…09'.,;:!?#<|>-_&(@\u0301\u00a0\x1c\u0130 ") + ["'s", "'RE", "<|endoftext|>", "<|ENDOFTEXT|>"]
    odd = ["".join(rng.choice(marks, rng.integers(1, 12))) for _ in range(4000)]
    texts = TEXTS + odd + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for _ in range(2):
        for text, ids in zip(texts, own.batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert list(own.batch([])) == []
    own.by_word = False
    assert [len(x) for x in own.batch([None, "ab"])] == [0, 4]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([*[(None, f"no id {i}") for i in range(40)], (None, None), (10**6, None), (10**6 + 1, ""), (5, "a second five"), (5, "a second five")], "doc_id bigint, text string"))
    docs = docs.selectExpr("*", "1 AS tie", "'x' AS ids", "2 AS start")
    root = scratch(spark, "test-tokens")
    files = token_file.write_tokens(docs, root, max_ids=5000)
    assert files.count() > 4
    rows = sorted(docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want, start = [], 0
    for k, text, _ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_file.read_tokens(files, root).collect()), key=lambda r: r[1])
    assert got == want
    empty = token_file.write_tokens(docs.limit(0), root + "-none")
    assert token_file.read_tokens(empty, root + "-none").count() == 0


def test_any_token_directly():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 1 << b, 3000) for b in (8, 9, 16, 20, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    file = token_file.Reader(token_file.packed(ids, [7, None], [100, len(ids)]))
    assert len(file.levels) == 4 and file.n == len(ids)
    assert all(file[int(i)] == ids[i] for i in rng.integers(0, len(ids), 400))
    for a, b in [(0, len(ids)), (5, 5), (511, 513), (1000, 9000), (len(ids) - 1, len(ids))]:
        assert (file.span(a, b) == ids[a:b]).all()
    assert file.offsets.tolist() == [0, 100, len(ids)] and file.known.tolist() == [1, 0]
    assert token_file.Reader(token_file.packed(np.zeros(0, np.uint32), [], [])).n == 0
