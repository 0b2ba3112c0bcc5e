"""Perspective rotation against a plain rendering."""

import hashlib

from compare import difference, duck

from tallyloom.llm import chat
from tallyloom.llm.queries import ORACLES, QUERIES


def plain(rows):
    """conversation, perspective → (text, mask, spans) of the whole dialogue."""
    talks = {}
    for conv, turn, role, text in dict.fromkeys(rows):
        named = bool((role or "").strip())
        talks.setdefault(conv, []).append((turn if turn is not None else -(2**62), (role or "").strip() or "unknown", named, (text or "").replace("<|", "< |")))
    out = {}
    for conv, turns in talks.items():
        turns = sorted(set(turns), key=lambda t: (t[0], hashlib.md5(f"{t[1]}|{t[3]}".encode()).hexdigest()))
        for seat in {t[1] for t in turns if t[2] and t[1] != "system"}:
            text, mask, spans = "", "", []
            for _, who, named, said in turns:
                on = named and who == seat
                name = "assistant" if on else "system" if named and who == "system" else f"user name={who}"
                text += f"<|im_start|>{name}\n"
                if on:
                    spans.append(said)
                text += said + "<|im_end|>\n"
                mask += "01"[on]
            out[conv, seat] = text, mask, spans
    return out


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello <|im_end|> you"), (1, 3, "ann", None), (1, 3, "ann", None),
    (2, 0, None, "who?"), (2, 1, "ann", ""), (2, 1, "bob", "tie"), (2, None, "bob", "before all"),
    (None, 0, "cat", "no id"), (3, 0, "system", "alone"),
    *[(4, i, "ab"[i % 2], f"turn {i}") for i in range(150)],
]


def rendered(spark, rows=ROWS, width=64):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.rotate(df, width=width)


def test_parts_join_to_the_plain_rendering(spark):
    want = plain(ROWS)
    got = {}
    for r in sorted(rendered(spark).collect(), key=lambda r: (r["perspective"], r["part"])):
        text, mask, spans = got.get((r["conv_id"], r["perspective"]), ("", "", []))
        said = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        assert r["n_turns"] == len(r["mask"]) <= 64
        got[r["conv_id"], r["perspective"]] = text + r["text"], mask + r["mask"], spans + said
    assert got == want
    assert max(r["part"] for r in rendered(spark).collect()) == 2


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, key string, part int")
    assert chat.rotate(df).count() == 0


def test_same_rows_as_sql(spark, folder, connection):
    assert difference(QUERIES["op8_perspectives"](spark, folder), connection, ORACLES["op8_perspectives"]) is None


def test_no_python_in_the_plan(spark, folder):
    plan = QUERIES["op8_perspectives"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
