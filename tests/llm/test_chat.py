import hashlib

from compare import compare, duck
from llm_fixtures import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat, queries

PIECES = st.sampled_from(["\\", "</turn>", "### ", ":", "\n", "a", "é", "<", "</", "turn>", "#", "\r", "\u2028", ""])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_rendered_turns_parse_back(turns):
    whole = "".join(chat.render(r, t)[0] for r, t in turns)
    back = chat.parse(whole)
    assert [(r, t) for r, t, _, _ in back] == turns
    assert [chat.unescape(whole[a:b]) for _, _, a, b in back] == [t for _, t in turns]


def test_plain_text_is_not_escaped():
    assert chat.render("user", "a < b, c > d # e")[1] == 0
    assert chat.render("user", "x </turn> y") == ("### user:\nx \\</turn> y\n</turn>\n", 1)


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    res = set()
    for conv, turns in out.items():
        said = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(chat.render(r, t)[0]) for r, t in turns)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        res.add((conv, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), size))
    return res


def test_edge_rows(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, None, "x\\"), (None, 0, "assistant", "a")]
    rows += [(2, 5, "assistant", "b" * 3_000_000), (2, 4, "assistant", "</turn>\n" * 9), (2, None, "a:b", "\n"), (3, 0, "", "")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} </turn>") for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, block string")
    assert set(map(tuple, chat.round_trip(spark, df).collect())) == brute(rows)
    assert chat.round_trip(spark, df.limit(0)).collect() == []


def test_long_conversations_come_in_parts(spark):
    df = spark.createDataFrame([(1, i, "user", "x" * 400_000) for i in range(20)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df).collect()
    assert len(parts) > 3 and sum(len(p["levels"]) for p in parts) == 20


def test_query_equals_sql(spark):
    res = compare(queries.op10_chat(spark, SF), duck(SF), queries.ORACLES["op10_chat"])
    assert res["cols_match"] and res["rows_match"] and res["values_match"], res
