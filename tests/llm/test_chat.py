"""Round trips, the role machine, and the SQL of the query."""

import hashlib
import random

from pyspark.sql import functions as F

from tablelearn.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, TEXT string"


def texts_under_attack():
    rng = random.Random(4)
    bits = ["<", "|", "\\", ">", "\n", "<|im_end|>", "<|im_start|>", "assistant", "é", "a", "im_end", "<\\|", "%0A"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]


def test_round_trip(spark):
    texts = texts_under_attack()
    rng = random.Random(5)
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "a\nb%0A<|", "", None, "<|im_start|>", "x\\"]),
             t if i % 17 else None, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    out = (chat.format_chats(spark.createDataFrame(rows, SCHEMA))
           .withColumn("back", chat.parse(F.col("formatted")))
           .withColumn("learned", chat.loss_text(F.col("segments"))).collect())
    assert len(out) == 100
    for r in out:
        want = [(x or "", t or "") for c, _, x, t, _ in sorted(
            (y for y in rows if y[0] == r.conv_id), key=lambda y: y[1])]
        assert [(t.role, t.text) for t in r.back] == want
        assert r.learned == "".join(t for x, t in want if x == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want) == r.n_turns
        assert [s.text for s in r.segments if s.loss and s.text] == [
            s.text for i, s in enumerate(r.segments) if i % 3 == 1 and want[i // 3][0] == "assistant" and s.text]


def plain_machine(roles, template=chat.CHATML):
    moves, state = {(s, r): n for s, r, n in template.moves}, template.initial
    for i, r in enumerate(roles):
        state = moves.get((state, r))
        if state is None:
            return False, False, i
    return True, state in template.final, None


def test_machine(spark):
    rng = random.Random(6)
    chats = [[rng.choice(["user", "assistant", "system", "tool", "odd"][:rng.choice((2, 4, 5))])
              for _ in range(rng.randint(1, 6))] for _ in range(300)]
    chats += [["system", "user", "assistant", "user", "assistant"], ["user"], ["user", "assistant", "tool", "tool", "assistant"]]
    rows = [(i, k, r, "t", None) for i, c in enumerate(chats) for k, r in enumerate(c)]
    got = {r.conv_id: (r.valid, r.complete, r.bad_turn)
           for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: plain_machine(c) for i, c in enumerate(chats)}


def test_odd_rows(spark):
    rows = [(None, 1, "user", "b", None), (None, None, "user", "a", None), (1, 0, "user", "x", None),
            (1, 0, "user", "x", None), (2, 0, None, None, None), (3, 0, "user", "w" * 200_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert out[None].formatted == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n"
    assert out[1].n_turns == 2 and not out[1].valid and out[1].bad_turn == 1
    assert out[2].formatted == "<|im_start|>\n<|im_end|>\n" and len(out[3].formatted) > 200_000
    assert chat.format_chats(df.limit(0)).count() == 0


def test_other_template(spark):
    t = chat.Template(start="[[turn]]", end="[[/turn]]", loss_roles=("bot",),
                      moves=(("begin", "me", "me"), ("me", "bot", "bot")), final=("bot",))
    df = spark.createDataFrame([(1, 0, "me", "hi", None), (1, 1, "bot", "yo", None)], SCHEMA)
    r = (chat.format_chats(df, template=t).withColumn("back", chat.parse(F.col("formatted"), t))
         .withColumn("l", chat.loss_text(F.col("segments"))).first())
    assert r.complete and r.l == "yo" and [x.text for x in r.back] == ["hi", "yo"]
    assert hashlib.sha256(r.formatted.encode()).hexdigest()
