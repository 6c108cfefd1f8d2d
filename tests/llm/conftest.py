import random

import pytest

WORDS = "the of and token über Straße señal naïve ΑΣΣ İstanbul ﬁne 数据 don't it's l'été 12345 x=1 %%% … 🙂🙂 a_b AKIA".split()


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that break simple code: null, empty, blank, special strings, long words, mixed scripts, repeats."""
    r = random.Random(3)
    mixed = [" ".join(r.choices(WORDS, k=r.randint(1, 60))) for _ in range(60)]
    return [None, "", " ", "\n\t  ", "a", "<|endoftext|>", "x<|startoftext|><|endoftext|>y <|ENDOFTEXT|>", "a" * 700, "Aa" * 900 + "é" * 300, "\x00\x01\x1f b", "é̂ ÅÅ K ſ", "ΣΑΣ Σ", *mixed, *mixed[:5], " ".join(r.choices(WORDS, k=30_000))]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string, secrets string, score string, ids string"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """odd_texts as documents with repeated and null ids, null columns, and columns named like the outputs."""
    rows = [(None if i % 17 == 3 else i, t, None if i % 5 == 0 else "ab"[i % 2], None, None, "x", "x", "x", "x", "x") for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows + rows[-3:], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
