import os
import random

import pytest

from lexiloom.llm import encode as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.VOCABULARY), reason="no vocabulary")

TEXTS = [None, "", " ", "a", "Hello  world \n\n x", "don't I'll we've", "<|endoftext|> [UNK] <s>", "naïve café 123 4567", "中文没有空格的句子，很长很长很长。", "ไทยไม่มีช่องว่าง", "👩‍👩‍👧 🇽🇰 ☃", "\t\r\n\x00\x7f\x85\xa0　​ x", "مرحبا بالعالم؟", "हिन्दी में वाक्य।", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300, "﻿word", "é   ¹²½"]


def expected(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, [9], "r") for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>, ranks string")


def by_id(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("cached", [0, 3, 131_072])
def test_ids_equal_the_library(spark, cached):
    df = docs(spark, TEXTS)
    got = E.encode(df, cached=cached)
    assert by_id(got, "ids") == expected(TEXTS)
    assert set(got.columns) == set(df.columns)


def test_random_strings_and_round_trip(spark):
    rnd = random.Random(4)
    texts = ["".join(chr(rnd.choice([rnd.randint(0, 0x24F), rnd.randint(0x370, 0x52F), rnd.randint(0x3040, 0x30FF), rnd.randint(0x1F600, 0x1F64F), 32, 32])) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = docs(spark, texts)
    assert by_id(E.encoded(df), "ids") == expected(texts)
    assert by_id(E.decoded(df), "text") == texts


def test_decoding_of_odd_ids(spark, rows):
    df = spark.createDataFrame([(1, None), (2, []), (3, [10**6, 15496]), (4, [None, 15496])], "doc_id bigint, ids array<int>")
    assert rows(E.decode(df).select("doc_id", "text")) == [(1, None), (2, ""), (3, "Hello"), (4, "Hello")]


def test_empty_table_and_repeated_rows(spark, rows):
    df = docs(spark, ["a b", "a b"])
    assert rows(E.encoded(df.where("doc_id = 9"))) == []
    assert E.encoded(df.unionAll(df)).count() == 4


def test_a_very_long_text(spark):
    text = "the cat sat on the mat, and went. " * 20_000
    assert by_id(E.encoded(docs(spark, [text])), "ids") == expected([text])


def test_a_very_long_word_without_spaces(spark):
    text = "文字列の中には空白がなくとても長い" * 3_000
    assert by_id(E.encoded(docs(spark, [text])), "ids") == expected([text])
