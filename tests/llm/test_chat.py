import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vivaspark.llm import chat

ADDED = r"\### Assistant: </turn> ok"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a: b", "x:", "#<\\"]), st.text(alphabet="\\#</turn>: \nabé", max_size=30)), max_size=6))
def test_round_trip(turns):
    text, spans = chat.compile_template()([{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_compiler_folds_and_renders():
    tree = chat.fold(chat.parse("a{{ 'b' ~ (1 + 2) }}{% if not true %}x{% elif 1 == 1 %}y{% else %}z{% endif %}{{ 'q' | upper }}"))
    assert tree == [("text", "ab3yQ")]
    assert chat.fold(chat.parse(chat.DEFAULT))[0][3][-1] == ("text", " </turn>\n")
    render = chat.compile_template("{% set n = messages[0].text | length %}{% for m in messages %}{{ n }}{{ m['role'] | trim | lower }}{% if m.text == 'hi' and n < 9 or false %}!{% endif %}{% endfor %}")
    assert render([{"role": " A ", "text": "hi"}, {"role": "B", "text": "yo"}])[0] == "2a!2b"


@pytest.mark.parametrize("bad", ["{% for x in y %}", "{{ __class__ }}", "{{ m.__class__ }}", "{{ f(1) }}", "{{ x | nope }}", "{% import os %}", "{% endif %}", "{{ 1 + }}", "{{ @ }}"])
def test_sandbox_and_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.parse(bad)


def test_query_equals_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    convs = {-7: [(0, "user", ADDED), (1, "assistant", ADDED)]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in chat.op6_chat(spark, sf).collect()}
    assert set(got) == set(convs)
    for i, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[i].n_turns == len(turns)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[i].formatted_chars > sum(len(t) for *_, t in turns)


def test_defined_cases(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (2, None, "bot", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, messages int")
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_conversations(df).collect()}
    assert got == {1: [("user", "q"), ("assistant", ""), ("assistant", "b")], None: [("user", "x")], 2: [("bot", "")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_constants_that_do_not_go_together_and_very_long_turns():
    import pytest

    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ 'a' + 1 }}")
    text = "\\### Assistant: </turn> ok <x> # " * 60_000
    messages = [{"role": "user", "text": text}, {"role": "assistant", "text": "ok"}]
    formatted, spans = chat.compile_template()(messages)
    assert chat.read_back(formatted) == [("user", text), ("assistant", "ok")]
    assert "".join(chat.unescape(formatted[a:b]) for a, b in spans) == "ok"
