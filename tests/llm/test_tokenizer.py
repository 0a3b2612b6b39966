import base64
import random

import pytest

from skerry.llm import tokenizer as tk

FILE = tk.DEFAULT_VOCABULARY
TEXTS = ["", " ", "\n\n  x", "don't we'll I'M", "a" * 3000, " " * 500 + "b", "日本語のテキスト、混在 mixed", "😀👍🏽 e\u0301", "x\ty\r\nz\u00a0\u3000", "<|endoftext|> plain", "0123456789" * 40, "naïve café\u2028end"]


@pytest.fixture(scope="module")
def encoder():
    return tk.PrefixEncoder(FILE)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_merging(encoder, reference):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["the ", "ing", "\n", "  ", "é", "ß", "語", "😀", "_", "{", "9", "'s", "Q"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t), ascii(t)
        assert b"".join(encoder.tokens[i] for i in ids) == t.encode()


def test_every_token_that_stands_alone(encoder):
    rng = random.Random(4)
    for token in rng.sample(sorted(encoder.ranks), 300):
        word = token.decode("latin-1")
        assert b"".join(encoder.tokens[i] for i in encoder._word(word)) == word.encode()


def test_documents(spark, encoder):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (91, "", "y"), (0, TEXTS[3], "again"), (None, "word", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((str(r.doc_id), r.ids) for r in tk.encode_documents(df).collect())
    assert got == sorted((str(i), encoder.encode(t)) for i, t, _ in rows)
    assert tk.encode_documents(df.limit(0)).count() == 0
