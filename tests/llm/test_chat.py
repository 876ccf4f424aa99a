"""Chat formatting: layouts, exact round trips, forged control strings."""

import hashlib
import json

from hypothesis import given, settings, strategies as st

from lectern.llm.chat import MAPPINGS, canonical_turns, fingerprint, format_records, format_turns, masked_text, read_back
from lectern.llm.chat import records_of_rows
from lectern.llm.chat_queries import _digest, DIGESTS

AWKWARD = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a|b>\n", "</s>"]),
                             st.text(st.sampled_from("ab<>[]|\\/s\n INSTé\U0001F600lbp"), max_size=30)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_round_trip(turns):
    formatted, spans = format_turns(turns)
    assert read_back(formatted) == turns
    assert masked_text(formatted, spans) == "".join(text for role, text in turns if role == "assistant")
    assert formatted.count("</s>") == len(turns) and formatted.count("<|") == len(turns)


def test_layouts():
    cases = {
        "message_contents": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7},
        "message_texts": {"messages": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}], "meta": {"x": [1]}},
        "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "speaker_utterance": {"dialogue": [{"speaker": "user", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]},
        "plain_turns": {"dialog": ["q", "a"]},
        "instruction": {"instruction": "q", "input": "", "output": "a"},
        "prompt_completion": {"prompt": "q", "completion": "a"},
        "prompt_response": {"prompt": "q", "response": "a", "score": 1.5},
        "question_answer": {"question": "q", "answer": "a"}}
    assert set(cases) == {m.name for m in MAPPINGS}
    for name, record in cases.items():
        assert canonical_turns(json.dumps(record)) == (name, [("user", "q"), ("assistant", "a")])
    with_system = {"system": "s", "instruction": "q", "input": "i", "output": "a"}
    assert canonical_turns(json.dumps(with_system))[1] == [("system", "s"), ("user", "q\ni"), ("assistant", "a")]
    assert fingerprint({"b", "a"}) == fingerprint(["a", "b"])


def test_records_that_fit_nothing(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, '{"x": 1}'), (6, '{"messages": []}'), (7, '{"messages": [{"role": null, '
            '"text": null}, 3]}'), (8, '{"prompt": {"a": 1}, "response": null}')]
    got = {r["conv_id"]: r for r in format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert len(got) == 8 and all(got[i]["layout"] is None and got[i]["formatted"] == "" for i in range(1, 7))
    assert got[7]["n_turns"] == 1


def test_rows_by_turn(spark):
    rows = [(1, 1, "assistant", "a\\</s>[x"), (1, 0, "user", None), (1, None, None, "first"), (None, 0, "user", "u"), (2, 0, "user", ""),
            (2, 0, "assistant", "tie"), (3, 0, "assistant", "long " * 50_000), (4, 0, "user", "x"), (4, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: r for r in format_records(records_of_rows(df)).mapInArrow(_digest, DIGESTS).collect()}
    want = {1: [("", "first"), ("user", ""), ("assistant", "a\\</s>[x")], None: [("user", "u")],
            2: [("assistant", "tie"), ("user", "")], 3: [("assistant", "long " * 50_000)], 4: [("user", "x")] * 2}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert format_records(records_of_rows(df.limit(0))).count() == 0
