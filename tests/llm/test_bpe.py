import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillframe.llm import bpe
from rillframe.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_encode, build_lexicon
from rillframe.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    alphabet = "abcdeXYZ  \t\n'é中😀0129.,!?<|>  \x1c\x85_-"
    out = ["", " ", "  a", "a  ", "hello world", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "It's we'll I'd", "\x1c\x1d a", "a" * 3000,
           "ab" * 2000 + " the", "the of and to in", "naïve café über", "😀😀 👩‍👩‍👧", "\r\n\r\n", "١٢٣ ²³ ½", "0" * 999]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    out += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14))) for _ in range(60)) for _ in range(60)]
    return out


def test_lexicon_ranks_and_shared_suffixes():
    rng = random.Random(2)
    words = {("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) + rng.choice(("", "ing", "ation"))).encode() for _ in range(900)}
    lex = Lexicon(compile_lexicon({w: [i, i + 1] for i, w in enumerate(sorted(words))}))
    order = sorted(words)
    assert lex.find(order).tolist() == list(range(len(order)))
    assert all(lex.ids_of(i).tolist() == [i, i + 1] for i in range(0, len(order), 37))
    assert (lex.find([b"zzz", b"abcabcabcd", b"", order[0] + b"q"]) < 0).all()
    assert len(lex.final) < sum(map(len, order)) / 4  # states are shared
    assert Lexicon(compile_lexicon({})).find([b"a"]).tolist() == [-1]


def test_encode_and_decode_equal_the_library(library):
    for frequent in ([], ["the", "of", "hello", "world", "naïve", "a" * 60]):
        got = list(Encoder(PATH, build_lexicon(frequent, PATH)).encode(texts()))
        for text, ids in zip(texts(), got):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
            assert Vocabulary.decode(Encoder(PATH, build_lexicon([], PATH)).vocab, np.array(want)) == library.decode(want, skip_special_tokens=False)


def test_operator_round_trip_and_cases(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(100, None), (None, "the"), (3, "dup"), (3, "dup"), (200, "the cat " * 20_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    got = bpe_encode(df, PATH, 50)
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in bpe_decode(got, PATH).collect()) == sorted((i is None, i or 0, t or "") for i, t in rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i is None, i or 0, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode()))
                  for i, t in rows for x in [library.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in bpe_encode(df, PATH, 50, digests=True).collect()) == want
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_full_cache_is_dropped_and_clashing_names_are_refused(spark, monkeypatch):
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = bpe.Encoder(path, bpe.build_lexicon(["the"], path))
    monkeypatch.setattr(bpe, "CACHE_CHARS", 1000)
    texts = [f"{'ab' * n} the {n}" for n in range(400)]
    want = [np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [x for t in texts for x in encoder.encode([t])] == want and encoder.chars < 4000
    df = spark.createDataFrame([(1, "a b", "s", 3)], "doc_id long, text string, source string, n_tokens int")
    row = bpe.bpe_encode(df, path, carry={"c_source": F.col("source")}).first()
    assert (row.doc_id, row.n_tokens, row.c_source) == (1, 2, "s")
    with pytest.raises(ValueError):
        bpe.bpe_encode(df, path, carry={"n_tokens": F.col("n_tokens")})


def test_vocabularies_that_need_more_are_refused(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    (tmp_path / "v.json").write_text(json.dumps(spec | {"normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))
