"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from hedgerow.llm import (
    decontamination,
    jump_sharding,
    line_dedup,
    lm_scoring,
    pii,
    quality_rules,
    sentencepiece_sampling,
    simhash_dedup,
    simhash_similar,
    tool_calls,
    toxicity,
)

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h", "é ▁ ▁ {{ \0 x", LONG, "mail a@b.c or +1 (555) 123-4567", "|", "the of and to in\nthe of and to in"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n string, fp string, score string, word string, h string, at string, kept string, q_text string, q_words string, v_letters string, `__key` string, `__row` string, doc string, `row` string, marks string, `new` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s" if i % 2 else None, None, *"xxxxxxxxxxxxxxxxx") for i, t in enumerate(TEXTS)]
    rows += [(None, "null id here", None, "s", None, *"xxxxxxxxxxxxxxxxx"), rows[4], rows[4], (4, "another text with the same id", None, "s", None, *"xxxxxxxxxxxxxxxxx")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g h"), (3, "q w e r t y")], "item_id long, text string")


def operators(bench, labels):
    return {
        "lm": lm_scoring.score_documents, "quality": quality_rules.judge, "keep": quality_rules.keep, "pii": pii.detect, "sanitised": pii.sanitised,
        "encode": sentencepiece_sampling.encode_sampled, "decontamination": lambda d: decontamination.judge(d, bench), "remove": lambda d: decontamination.remove(d, bench),
        "simhash": simhash_dedup.near_duplicates, "keep_one": simhash_dedup.keep_one, "keep_similar": simhash_similar.keep_one, "lines": line_dedup.judge, "dropped": line_dedup.drop_boilerplate,
        "shards": jump_sharding.shard_documents, "toxicity": lambda d: toxicity.score_documents(d, labels),
    }


NAMES = ["lm", "quality", "keep", "pii", "sanitised", "encode", "decontamination", "remove", "simhash", "keep_one", "keep_similar", "lines", "dropped", "shards", "toxicity"]


@pytest.fixture(scope="module")
def all_operators(spark, bench):
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (3, None, None), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    return operators(bench, labels)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(all_operators, docs, name):
    found = all_operators[name](docs).collect()
    one_for_each = {"lm", "quality", "pii", "sanitised", "decontamination", "simhash", "lines", "dropped", "shards", "toxicity"}
    if name in one_for_each:
        assert len(found) == len(TEXTS) + 4
    if name in ("keep_one", "keep_similar"):
        assert len({r["text"] for r in found}) == len(found)
    if name == "encode":
        assert all(r["round_trip"] for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(all_operators, docs, name):
    assert all_operators[name](docs.where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage):
    for rows in (docs, docs.where("doc_id < 0")):
        out = stage(spark, rows, "/root/testdata/sf0.001")
        if stage is not corpus_pipeline.encode:
            assert out.columns == docs.columns
        out.collect()


def test_repeated_rows_share_their_results(docs):
    scores = {r["score"] for r in lm_scoring.score_documents(docs).collect() if r["n_tokens"] == 9}
    assert len(scores) == 1
    slots = [(r["shard"], r["slot"]) for r in jump_sharding.shard_documents(docs).collect()]
    assert len(set(slots)) == len(slots)


def test_tool_calls_odd(spark):
    calls = "conv_id long, call_id string, name string, arguments string, depends_on array<string>, extra string"
    rows = [(1, "a", "f", '{"y":2,"x":"1"}', [], "z"), (1, "b", "f", '{"x":5}', ["a"], "z"), (1, "c", "f", "nonsense", ["b", "zz", None], None), (None, "d", None, '{"b":1,"a":[{"d":1,"c":2}]}', ["e"], None),
            (1, "e", "g", None, ["d"], None), (1, "a", "f", '{"y":2,"x":"1"}', [], "z"), (1, None, "f", "{}", None, None)]
    results = spark.createDataFrame([("a", "ok"), ("a", None), (None, "lost")], "call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "string", True), ("f", "y", "integer", True)], "name string, property string, type string, required boolean")
    df = spark.createDataFrame(rows, calls)
    got = {r["call_id"]: r for r in tool_calls.link(df, results, schemas).collect()}
    assert [got[k]["level"] for k in "abcde"] == [0, 1, 2, None, None]
    assert got["a"]["json"] == '{"arguments":{"x":"1","y":2},"call_id":"a","name":"f","result":"ok"}' and got["a"]["n_calls"] == 2 and got["a"]["n_results"] == 2
    assert got["b"]["problems"] == ["missing y", "not a string x"] and not got["b"]["valid"]
    assert got["c"]["n_missing"] == 1 and got["c"]["problems"] == ["arguments are no object"]
    assert '"arguments":{"a":[{"c":2,"d":1}],"b":1}' in got["d"]["json"]
    (lost,) = tool_calls.link(df.where("false"), results, schemas).collect()
    assert lost["call_id"] == "a" and lost["n_calls"] == 0 and lost["problems"] == ["no call"] and lost["json"] == '{"arguments":null,"call_id":"a","name":null,"result":"ok"}'
    assert tool_calls.link(df.where("false"), results.where("false"), schemas).collect() == []
    turns = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 3, "user", "u"), (2, 5, "assistant", "lost"), (2, 6, "user", "v")]
    found = {r["call_id"]: r for r in tool_calls.link_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r["level"], r["valid"], r["n_calls"], r["n_results"], r["n_missing"]) for k, r in found.items()} == {"1:0": (0, True, 1, 0, 0), "1:1": (0, False, 1, 1, 0), "1:3": (1, True, 1, 0, 0), "2:4": (None, False, 0, 1, 0), "2:6": (0, True, 1, 0, 1)}
    assert tool_calls.link_conversations(spark.createDataFrame([(None, 0, "user", "x"), (1, 0, "user", None), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")).count() == 1


def test_levels_of_calls(spark):
    """A chain of 3,000 calls, a ladder of calls with two dependencies, a cycle, and calls behind each."""
    rows = [(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(3000)]
    rows += [("l0", []), ("l1", ["l0"])] + [(f"l{i}", [f"l{i - 1}", f"l{i - 2}"]) for i in range(2, 6)]
    rows += [("x", ["y"]), ("y", ["z"]), ("z", ["x"]), ("behind", ["x"]), ("waits", ["behind", "c5"]), ("both", ["c2999", "l5", "none"]), ("last", ["both"])]
    calls = spark.createDataFrame([(1, k, "f", "{}", d) for k, d in rows], "conv_id long, call_id string, name string, arguments string, depends_on array<string>")
    got = {r["call_id"]: (r["level"], r["n_missing"]) for r in tool_calls.link(calls, spark.createDataFrame([], "call_id string, content string")).collect()}
    assert all(got[f"c{i}"] == (i, 0) for i in range(3000)) and [got[f"l{i}"][0] for i in range(6)] == list(range(6))
    assert all(got[k] == (None, 0) for k in ("x", "y", "z", "behind", "waits")) and got["both"] == (3000, 1) and got["last"] == (3001, 0)
