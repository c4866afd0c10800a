import hashlib
import random

import pytest

from weftline.llm.chat_format import GrammarError, digests, format_turns, parse, render
from weftline.llm.queries import op7_chat_format

NASTY = ["", " ", "\\", "\\\\", "###", "### User: ", ": ", " </turn>", " </turn>\n", "\n", "</turn>", "\\### Assistant: </turn> ok", "a: b", "x \\", "User", "### Assistant: hi </turn>\n### User: ", "é 漢"]


def test_round_trip_of_any_turn():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [("".join(rng.choices(NASTY, k=rng.randint(0, 2))) or rng.choice(["user", "assistant", "User"]), "".join(rng.choices(NASTY, k=rng.randint(0, 5)))) for _ in range(rng.randint(1, 3))]
        pieces = [render(r, t) for r, t in turns]
        assert [(r, t) for r, t, _, _ in parse("".join(p for p, _, _ in pieces))] == turns


def test_plain_text_is_not_escaped():
    assert render("user", "Hello: you")[0] == "### User: Hello: you </turn>\n"
    assert render("user", "a\\b")[0] == "### User: a\\\\b </turn>\n"
    with pytest.raises(GrammarError):
        parse("### User: no end")


def want(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    result = {}
    for c, turns in out.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        text = "".join(render(r, x)[0] for r, x in turns)
        all_ = "".join(f"{r}\n{x}\n" for r, x in turns)
        result[c] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    return result


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", NASTY[11]), (-7, 1, "assistant", NASTY[11])]
    assert {r[0]: tuple(r)[1:] for r in op7_chat_format(spark, sf_dir).collect()} == want(rows)


def test_edges(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (1, 2, "assistant", "b"), (None, 0, "tool", "t"), (2, 0, "user", "")]
    rows += [(3, i, "assistant", "long " * 5000) for i in range(30)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn int, role string, text string, piece string, no int")
    pieces = format_turns(df)
    assert {r[0]: tuple(r)[1:] for r in digests(pieces).collect()} == want(rows)
    assert {r[0]: tuple(r)[1:] for r in digests(pieces.repartition(7, "piece"), in_order=False).collect()} == want(rows)
    assert digests(format_turns(df.limit(0))).collect() == []
