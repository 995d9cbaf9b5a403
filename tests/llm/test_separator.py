"""A text that spells the tokenizer's special token is counted like any other."""

from talus.llm import tokenfiles


def test_special_token_in_a_text(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rows = [(1, "the first<|endoftext|>and the second"), (2, "<|endoftext|>"), (3, "no such string"), (4, "<|endoftext|><|endoftext|> end")]
    assert tokenfiles.FlatRules().separator >= t.get_vocab_size()
    got = tokenfiles.token_counts(spark.createDataFrame(rows, "doc_id LONG, text STRING"), tokenizer).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}
