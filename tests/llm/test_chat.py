import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ratingloom.llm import chat

ROWS = [(1, 0, "user", "hello <|im_end|>"), (1, 1, "assistant", "a\n<|im_start|>b<\\|c"), (1, 2, None, None),
        (2, 0, "assistant", ""), (2, 1, "assistant", "x<"), (2, 1, "assistant", "x<"), (3, None, "we%0Aird\nrole", "|>"),
        (None, 0, "user", "no id"), (4, 5, "user", "y" * 100_000)]
SCHEMA = "conv_id long, turn int, role string, text string"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA + ", part string, start int").repartition(3)
    found = chat.conversation_digests(rows).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == expected(ROWS)
    parts = chat.format_conversations(rows).toPandas().sort_values("part")
    whole = {r.conv_id: r.formatted_chars for r in found}
    for conv, mine in parts.groupby("conv_id", dropna=False):
        text = "".join(mine["text"])
        conv = None if conv != conv else int(conv)
        assert len(text) == whole[conv]
        assert text.count(chat.END) == sum(r[0] == conv for r in ROWS)
        loss = [chat.unescape(text[s:s + len(t)]) for s, t, m in zip(mine["start"], mine["text"], mine["in_loss"]) if m]
        assert hashlib.sha256("".join(loss).encode()).hexdigest() == expected(ROWS)[conv][3]


def test_empty_table(spark):
    assert chat.conversation_digests(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.text(alphabet="<|\\>im_endstart \n%0Aé"))
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unheader(chat.header(text)) == text
    assert "<|" not in chat.escape(text) and "\n" not in chat.header(text)


def render(source, messages=(), **names):
    return list(chat._render(chat.fold(chat.parse(source)), [0])({"messages": list(messages), **names}, 0))


def test_language():
    assert "".join(t for t, _ in render('{% if a == "x" and not b %}1{% elif c %}2{% else %}3{% endif %}', a="x", b=False)) == "1"
    assert "".join(t for t, _ in render('{% if a != "x" or b %}1{% else %}{{ a ~ "-" ~ 3 | upper }}{% endif %}', a="x")) == "x-3"
    assert render("{{ m.__class__ }}{{ m.nope.deep }}", m={"x": 1}) == [("", 0), ("", 0)]
    assert render('{% for m in messages %}{{ m.text }}{% generation %}{{ m.text | trim }}{% endgeneration %}{% endfor %}',
                  [{"text": " a "}]) == [(" a ", 0), ("", 1), ("a", 1)]
    for bad in ("{% for x y %}{% endfor %}", "{% if a %}", "{{ a( }}", '{{ a | system }}', "{% import os %}", "{{ 1 2 }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_constants_are_folded():
    tree = chat.fold(chat.parse('a{{ "b" ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if not true %}d{% endif %}e'))
    assert tree == ("block", [("const", "ab1ce")])


def test_large_ids_beside_a_missing_one(spark):
    rows = [(2**53, 0, "user", "a"), (2**53 + 1, 0, "user", "b"), (None, 0, "user", "c"), (2**53 + 1, 1, "assistant", "d")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    assert {r.conv_id: r.n_turns for r in chat.conversation_digests(df).collect()} == {2**53: 1, 2**53 + 1: 2, None: 1}
    assert {r.conv_id for r in chat.format_conversations(df).collect()} == {2**53, 2**53 + 1, None}
