import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import bpe, token_counts

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def test_counts_are_the_librarys(odd_docs, no_docs):
    tok = Tokenizer.from_file(WORD)
    rows = token_counts.count_tokens(odd_docs, WORD).select("text", "n_bytes", "n_tokens", "over_limit").collect()
    for r in rows:
        text = r["text"] or ""
        want = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(text.encode()), want > 2048), text[:80]
    assert token_counts.count_tokens(no_docs, WORD).count() == 0


def test_proven_words_are_one_token():
    tok, proven = Tokenizer.from_file(WORD), sorted(token_counts.prove_whole_tokens(WORD))
    assert len(proven) > 10_000
    for word in proven[::97]:
        if tok.normalizer.normalize_str(word) == word and len(tok.pre_tokenizer.pre_tokenize_str(word)) == 1:
            assert len(tok.encode(word, add_special_tokens=False).ids) == 1, word


def test_whole_test_table(spark):
    tok = Tokenizer.from_file(WORD)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in token_counts.count_tokens(docs, WORD).collect():
        assert r["n_tokens"] == len(tok.encode(r["text"], add_special_tokens=False).ids)


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_ids_are_the_librarys_and_decode(odd_docs, no_docs, spark):
    enc = library()
    docs = odd_docs.select("text", "ids").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", F.lit("x").alias("ids")))
    for r in bpe.encode_and_decode(docs, RANKS, P.PATTERN).collect():
        text = r["text"] or ""
        assert bpe.id_list(r["ids"]) == enc.encode_ordinary(text), text[:80]
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode_and_decode(no_docs, RANKS, P.PATTERN).count() == 0


def test_plain_texts_split_alike():
    import random

    r = random.Random(8)
    chars = [chr(x) for x in (9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x180))] + list("  'st123_")
    c = bpe.Coder(RANKS, P.PATTERN)
    for _ in range(3000):
        text = "".join(r.choices(chars, k=r.randint(0, 40)))
        assert bpe.PLAIN.fullmatch(text) and c.split.findall(text) == c.split_plain.findall(text)
    for x in ("\x1c", "²", "½", "\u0660", "\u2028", "\xa0", "中"):
        assert not bpe.PLAIN.fullmatch(x)


def test_columns_alone(odd_docs):
    coded = odd_docs.withColumn("ids", bpe.encode_column(RANKS, P.PATTERN)).withColumn("back", bpe.decode_column(RANKS, P.PATTERN))
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in coded.collect())


def test_heap_and_recursive_query_agree(monkeypatch):
    words = ["internationalisation", "übergrößenträger", "aaaaaaaabaaaab" * 12, " données", "数据数据"]
    one, other = bpe.Coder(RANKS, P.PATTERN), bpe.Coder(RANKS, P.PATTERN)
    a = one.words(words)
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert a == other.words(words)


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    c, enc = bpe.Coder(RANKS, P.PATTERN), library()
    for k in range(6):
        texts = [f"word{k}x{i} of thing{i}zz {'q' * (i + 40)}" for i in range(30)]
        assert [bpe.id_list(x) for x in c.encode(texts)] == [enc.encode_ordinary(t) for t in texts]
        assert len(c.kept) + len(c.older) <= 300


def test_unknown_token_is_an_error():
    import pytest

    with pytest.raises(ValueError):
        bpe.Coder(RANKS, P.PATTERN).decode([(60_000).to_bytes(4, "little")])


def code_points():
    return [chr(x) for x in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200))]


def test_every_code_point_counts_as_in_the_library():
    tok, own = Tokenizer.from_file(WORD), token_counts.Counter(WORD)
    texts = [f"a{c}b" for c in code_points()] + [f"\u10d0K{c}w {c}" for c in code_points()[::7]]
    wrong = [t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if own.count(t) != len(e.ids)]
    assert not wrong


def test_every_code_point_splits_as_in_the_library():
    enc, own = library(), bpe.Coder(RANKS, P.PATTERN)
    texts = [f"{c}'s {c}1a{c} .{c}" for c in code_points()]
    wrong = [t for t, ids in zip(texts, own.encode(texts), strict=True) if bpe.id_list(ids) != enc.encode_ordinary(t)]
    assert not wrong


def test_both_unicode_tables_are_known():
    odd, exact = bpe.as_library(P.PATTERN)
    assert odd and "\\p" not in exact and bpe.as_library("a+") == ("", "a+")
