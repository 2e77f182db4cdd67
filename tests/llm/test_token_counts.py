import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import ODD, SF
from triplespark.llm import queries
from triplespark.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, limit=2048):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((i, len((text or "").encode()), n, n > limit))
    return out


def test_query_is_the_library(spark, documents):
    got = sorted(map(tuple, queries.op2_token_counts(spark, SF).collect()))
    assert got == sorted(brute([(d["doc_id"], d["text"]) for d in documents]))


def test_odd_rows(spark, odd, no_docs):
    got = sorted(map(tuple, token_counts(odd, PATH, 5).collect()), key=str)
    assert got == sorted(brute([r[:2] for r in ODD], 5), key=str)
    assert token_counts(no_docs, PATH).collect() == []


def test_long_pretokens_are_joined(spark):
    """Texts without spaces, beyond the length of a key, some of them shared."""
    han = "".join(chr(0x4E00 + i * 7 % 2000) for i in range(300))
    rows = [(1, han), (2, han + " " + han), (3, han[:40]), (4, "x" * 64 + " " + "x" * 65), (5, "x" * 65 + han)]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2048).collect()))
    assert got == sorted(brute(rows))
