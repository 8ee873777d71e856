import random

import duckdb
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTS = tokens.RunCounts(tokens.load_pieces(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdetions  \n▁<s>0é漢\x00\t"), st.characters(exclude_categories=["Cs"]))))
def test_any_text_counts_as_the_library(text):
    assert tokens.count_text(text, COUNTS) == len(PROCESSOR.encode(text))


def test_table_texts_count_as_the_library():
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    random.Random(1).shuffle(texts)
    for t in texts:
        assert tokens.count_text(t, COUNTS) == len(PROCESSOR.encode(t))


def test_rows(spark):
    long = "ab" * 50_000
    df = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "a  b", 5), (4, long, 5), (4, long, 5)], "doc_id long, text string, n_tokens int"
    )
    got = sorted((tuple(r) for r in tokens.count_tokens(df, PATH).collect()), key=str)
    n = len(PROCESSOR.encode(long))
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 4, 3, False), (4, 100_000, n, n > 4096), (4, 100_000, n, n > 4096)], key=str)
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0
