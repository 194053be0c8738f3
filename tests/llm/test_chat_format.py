import hashlib

import pytest
from hypothesis import given, strategies as st

from tastegrid.llm import chat_format

PIECES = st.lists(st.sampled_from(["<turn>", "</turn>", "\\", "\n", "user", " ", "ok", "é", "### Assistant:"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "<turn>", "\\n"]), PIECES), max_size=6))
def test_round_trip(turns):
    assert chat_format.read_turns("".join(chat_format.format_turn(r, t) for r, t in turns)) == turns


def test_broken_text_is_an_error():
    with pytest.raises(ValueError):
        chat_format.read_turns("<turn>user\nhello")


def expected(turns):
    text = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest()


def test_every_conversation_comes_back(spark):
    talks = {
        1: [("user", "hi"), ("assistant", "yo </turn>\n<turn>assistant"), ("user", "q"), ("assistant", "")],
        2: [("system", "s"), ("user", "only a question")],
        3: [("assistant", None), ("assistant", "b"), (None, "c"), ("assistant", "d"), ("user", "e")],
        None: [("user", "x" * 200_000), ("assistant", "\\" * 9 + "</turn>")],
        4: [(("user", "assistant")[k % 2], f"turn {k} \\</turn>") for k in range(300)],
    }
    rows = [(c, k, r, t, "extra", 1.0) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string, loss_start double")
    examples = chat_format.expand(table.repartition(5))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(examples).collect()}
    assert got == {c: expected(turns) for c, turns in talks.items()}
    # the prefix of each example is all that came before, and only its reply is trained
    for e in examples.where("conv_id = 4").collect():
        turns = chat_format.read_turns(e.text)
        assert turns == talks[4][: 2 * e.example + 2]
        assert chat_format.unescape(e.text[e.loss_start : e.loss_end]) == turns[-1][1]


def test_probe_and_ties(spark):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "user", "c")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.expand(chat_format.with_probe(table))).collect()}
    probe = "\\### Assistant: </turn> ok"
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_chars, got[-7].loss_sha256) == expected([("user", probe), ("assistant", probe)])
    assert got[1].turns_sha256 == expected([("user", "c"), ("assistant", "b"), ("user", "a"), ("user", "a")])[1]


def test_empty(spark):
    assert chat_format.read_back(chat_format.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
