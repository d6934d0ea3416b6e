"""The pipeline against a plain version of its stages."""

import re

import pytest
from pyspark.sql import functions as F
from test_text_operators import LONG, ODD, base_of, components_of, contamination_of

import corpus_pipeline
from chronoloom.llm import sentencepiece_codec, toxicity
from chronoloom.llm.common import read_table
from chronoloom.llm.queries import tokenizer_path


def test_stages_in_turn(spark, data):
    docs = read_table(spark, data, "documents")
    labels = read_table(spark, data, "labels")
    columns = docs.columns
    toxic = {x["doc_id"] for x in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns
        after[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    all_docs = {x["doc_id"]: x["text"] for x in read_table(spark, data, "documents").collect()}
    want = {i: t for i, t in all_docs.items() if i not in toxic}
    assert after["toxicity"] == want
    want = {i: want[i] for i, _, c in components_of(list(want.items())) if i == c}
    assert after["ngram_join"] == want
    items = [(x["item_id"], x["text"]) for x in read_table(spark, data, "benchmark").collect()]
    want = {i: want[i] for i, x in contamination_of(list(want.items()), items).items() if not x[4]}
    assert after["decontamination"] == want
    assert set(after["pii"]) == set(want)
    for i, text in after["pii"].items():
        assert sum(base_of(text)[0][:4]) == 0
        if not base_of(want[i])[1]:
            assert text == want[i]
        else:
            assert re.search("<(EMAIL|IP|CARD|PHONE)>", text)
    got = {tuple(x) for x in corpus_pipeline.run(spark, data).collect()}
    assert got == {tuple(x) for x in sentencepiece_codec.encode_documents(docs, tokenizer_path()).collect()}


CLASH = ["score", "label", "n", "gram", "component", "row_key", "base", "terms", "side", "rep", "token_ids", "n_hit"]


@pytest.fixture
def odd(spark, data):
    """Documents with null ids, null and empty texts, repeated rows, a very long text, and
    columns named as the stages name theirs."""
    given = read_table(spark, data, "documents").limit(30)
    rows = [(1_000 + i, t) for i, t in enumerate([*ODD, "mail ann@corp.example.com now", "mail ann@corp.example.com now"])]
    rows += [(None, "a row without an id of its own"), (None, None), (1_001, ""), (1_009, LONG[:100]), (1_009, LONG[:100])]
    own = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = given.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(own)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def plain(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_stages_of_odd_rows(spark, data, odd, tmp_path):
    labels = read_table(spark, data, "labels")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, data)
        assert got.columns == odd.columns and got.dtypes == odd.dtypes
        assert stage(spark, odd.limit(0), data).count() == 0
        kept, all_rows = plain(got), plain(odd)
        if name == "ngram_join":
            # rows without id stay, as do repeated rows of an id; of equal texts the smallest id
            best = {i: c for i, _, c in components_of([(x[0], x[1]) for x in all_rows if x[0] is not None and all_rows.index(x) == [y[0] for y in all_rows].index(x[0])])}
            assert sum(x[0] is None for x in kept) == 2 and {x[0] for x in kept} <= {None, *best}
        elif name == "pii":
            assert [x[2:4] + x[5:] for x in kept] and len(kept) == len(all_rows)
            assert all(x[4] == (None if x[1] is None else len(x[1])) for x in kept if x[0] is None or x[0] >= 1_000)
        else:
            assert all(x in all_rows for x in kept)
    toxic = toxicity.score_toxicity(odd, labels).where("predicted = 1").count()
    assert len(plain(corpus_pipeline.STAGES[0][1](spark, odd, data))) == len(plain(odd)) - toxic


def test_run_of_odd_rows(spark, data, odd, tmp_path):
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        root = f"{tmp_path}/{name}"
        docs.write.parquet(f"{root}/documents.parquet")
        for table in ("labels", "benchmark"):
            read_table(spark, data, table).write.parquet(f"{root}/{table}.parquet")
        got = corpus_pipeline.run(spark, root).collect()
        assert (len(got) > 30) == (name == "odd")
        empty = [x for x in got if x["n_tokens"] == 0]
        assert name == "none" or empty and all(x["ids_sha256"] == x["decoded_sha256"] for x in empty)
