import hashlib
import random

import numpy as np

from heapscope.llm import chat

PATH = chat.default_path()
SCHEMA = "conv_id long, turn long, role string, text string"


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    pieces = [*"<s>/[]INT|.", *chat.CONTROL, chat.ESCAPE, chat.ESCAPE + "."]
    for _ in range(5000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_read_back(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(20):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "[INST]"]), "".join(rng.choices(["a", "é", " ", "\n", "</s>", "[INST]", "␛", "𝄞", "0"], k=rng.randint(0, 30)))))
    rows += [(50, 0, "assistant", None), (50, 1, None, "x"), (51, None, "assistant", "first"), (51, 0, "assistant", "second"), (None, 0, "assistant", "no id")]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(turns, PATH), PATH).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        r = got[conv]
        learned = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.formatted(turns.limit(0), PATH), PATH).count() == 0


def test_ids_masks_and_offsets(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "</s>[INST] ok [/INST]")]
    out = sorted(chat.formatted(spark.createDataFrame(rows, SCHEMA), PATH).collect(), key=lambda r: r["turn_no"])
    c = chat.codec(PATH)
    ids = np.concatenate([r["ids"] for r in out])
    assert (ids == c.end).sum() == 2 and (ids == c.start).sum() == 1 and (ids == c.open).sum() == 2
    assert out[1]["first_token"] == len(out[0]["ids"]) and out[1]["first_char"] == len(out[0]["text"])
    assert sum(out[0]["mask"]) == 0
    masked = c.decode(np.array(out[1]["ids"])[np.array(out[1]["mask"]) == 1])
    assert chat.unescape(masked) == rows[1][3]
    assert "".join(r["text"] for r in out) == c.text(ids)
    assert out[0]["text"].startswith("<s>[INST]user[/INST]hi ")


def test_ties_long_texts_and_other_columns(spark):
    long = "very long text </s> " * 20_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "c"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (2, 0, "assistant", long)]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("ids", chat.F.lit(1)).withColumn("Mask", chat.F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(turns, PATH), PATH).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"assistant\nz\nuser\na\nuser\na\nuser\nb\nuser\nc\n").hexdigest()
    assert got[2]["loss_chars"] == len(long) and got[2]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
