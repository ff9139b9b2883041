"""Known sentences of the full tokenizer, and the streaming operators."""

import pytest

from sylva.functions.tokenizer import tokenize, tokenize_df
from sylva.operators import evaluation
from sylva.streaming import sentences as streams


@pytest.mark.parametrize(
    ("sentence", "tokens"),
    [
        ("Sort the red buttons, Anna.", "Sort the red buttons , Anna ."),
        ("Stop! Who's there? #{&", "Stop ! Who 's there ? # -LCB- &"),
        ("They won't pay (or will they?). [7]", "They will n't pay -LRB- or will they ? -RRB- . -LSB-7 -RSB-"),
        ("Didn't you see two?", "Did n't you see two ?"),
        ("It cost $3,000.50 in the U.S. today.", "It cost $ 3,000.50 in the U.S. today ."),
        ('He said "yes".', "He said `` yes '' ."),
        ("We'll go, they've gone...", "We 'll go , they 've gone .. ."),
        ("the '60s", "the '60s"),
        ("", ""),
    ],
)
def test_sentences(sentence, tokens):
    assert tokenize(sentence) == tokens.split()


def test_kernel(spark):
    df = spark.createDataFrame([(1, "Is it?"), (2, None)], "id long, sentence string")
    assert {r.id: r.forms for r in tokenize_df(df).collect()} == {1: ["Is", "it", "?"], 2: []}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One, two.\n\n(Three)\n")
    stream = streams.tokenized(streams.read_lines(spark, str(tmp_path / "in"))).select("text", "forms")
    streams.write(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {r.text: r.forms for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"One, two.": ["One", ",", "two", "."], "(Three)": ["-LRB-", "Three", "-RRB-"]}


def test_randomisation(spark):
    a = spark.createDataFrame([(k, 10, 10, 9) for k in range(30)], "sent_id long, n_gold int, n_test int, n_matched int")
    b = spark.createDataFrame([(k, 10, 10, 5) for k in range(30)], "sent_id long, n_gold int, n_test int, n_matched int")
    assert evaluation.randomisation_test(a, b, 200).first()[0] < 0.05
    assert evaluation.randomisation_test(a, a, 200).first()[0] == 1.0
