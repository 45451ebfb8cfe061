import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epiloom.llm.token_counts import ByteMerges, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", " ", "\n\n", "it's 'system' ''s !'s \n's  's", "x" * 5000, "ab" * 3000, "<|endoftext|>a<|endoftext|>", "<|endoftext", "naïve café 中文 ال \U0001f600\U0001f600 ՘֋",
    "tabs\t\tand   spaces  ", " \u0085x\x1c\x1dy", "1234567890 ²³ ½", "Ḁḁ ǅ Ͱα", " " * 3000 + "z",
]


@pytest.fixture(scope="module")
def both():
    return ByteMerges(PATH), Tokenizer.from_file(PATH)


def test_equals_the_library(both):
    ours, theirs = both
    rng = random.Random(5)
    alphabet = "abcdeE 'éß\n\t 12.,!?Δ中\U0001f600 -"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for t in TEXTS + made:
        assert ours.count(t) == len(theirs.encode(t, add_special_tokens=False).ids), t[:60]


def test_rows_nulls_ties_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "hello world", "z"), (3, "hello world", "z"), (3, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(df, limit=1).collect()), key=repr)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, True), (3, 11, 2, True), (3, 11, 2, True)], key=repr)
    assert token_counts(df.limit(0)).count() == 0
