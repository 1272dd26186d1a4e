"""Chunked encoding against the tokenizers library, for both families of vocabularies; others are refused."""

import hashlib
import json
import random

import pytest

from quillfind.llm import bpe


def texts():
    r = random.Random(21)
    pool = list("abcdeXYZ 0123.,'!?-\n\t  é日本ßİ😀́\xa0 ") + ["don't", " we'll", "  ", "\n\n", "the ", "<|", "|>"]
    shared = "".join(r.choice(pool) for _ in range(900))
    out = ["", " ", "   ", "\n \n", "a", "<|endoftext|>", "x<|endoftext|> y <|startoftext|>", "word " * 500, " " * 700, "x" * 2000, "\n" * 600 + "end", "é" * 900]
    out += ["".join(r.choice(pool) for _ in range(r.randint(1, 400))) for _ in range(400)]
    out += [shared[r.randrange(300) :] + "".join(r.choice(pool) for _ in range(50)) for _ in range(60)]
    return out


@pytest.mark.parametrize("name,mean", [("byte_bpe_50k.json", 256), ("byte_bpe_50k.json", 8), ("word_bpe_49k.json", 256), ("word_bpe_49k.json", 8)])
def test_chunks_agree_with_whole_texts(name, mean):
    path, sha = bpe.vocabulary(name), lambda s: hashlib.sha256(s.encode()).hexdigest()
    for _ in range(2):  # from a cold and from a filled memo
        got = [(n, sha(a), sha(b)) for n, a, b in bpe.encoder(path, mean).encode(texts())]
        want = bpe.brute_force(texts(), path)
        assert [k for k, (a, b) in enumerate(zip(got, want)) if a != b] == []


def test_chunks_are_encoded_once_per_process():
    path = bpe.vocabulary("byte_bpe_50k.json")
    e = bpe.ByteEncoder(path, 16)
    seen, pieces = [], e.pieces
    e.pieces = lambda t: seen.append(t) or pieces(t)
    text = "some words that are cut into chunks by what they contain, and more of them " * 3
    e.encode([text])
    first = len(seen)
    e.encode([text])
    assert len(seen) - first < first and bpe.encoder(path) is bpe.encoder(path)


def test_other_vocabularies_are_refused(spark, tmp_path):
    for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with open(bpe.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
            d = json.load(f) | change
        (tmp_path / "v.json").write_text(json.dumps(d))
        with pytest.raises(ValueError, match="another kind"):
            bpe.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "v.json"))


def test_rows_with_byte_vocabulary(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "one two", "x"), (3, "one two", "x"), (3, "one two", "x"), (4, "long words " * 30_000, "x")]
    path = bpe.vocabulary("byte_bpe_50k.json")
    got = bpe.digest(bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids_text string"), path)).collect()
    want = bpe.brute_force([t for _, t, _ in rows], path)
    assert sorted((str(x[0]), *tuple(x)[1:]) for x in got) == sorted((str(i), *w) for (i, _, _), w in zip(rows, want))
