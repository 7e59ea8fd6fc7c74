import hashlib
import random

from pyspark.sql import functions as F

from linewright.llm import chat_format

TURNS = "conv_id long, turn long, role string, text string"


def expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, said in talks.items():
        said.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in said)
        loss = "".join(t for _, r, t in said if r == "assistant")
        out[conv] = (len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(spark, rows):
    out = chat_format.digest(chat_format.prefix_examples(spark.createDataFrame(rows, TURNS))).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out}


NASTY = ["\\", "\\l", "\\b", "\\n", "<turn>", "</turn>", "</turn>\n", "<", "\n", "a", "é", "日", "🙂", " ", "$1", "\\\\", "turn", "/"]


def test_round_trip_of_any_text(spark):
    draw = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 6)):
            text = "".join(draw.choice(NASTY) for _ in range(draw.randint(0, 12)))
            role = draw.choice(["user", "assistant", "assistant", "system", "".join(draw.choice(NASTY) for _ in range(3))])
            rows.append((conv, turn, role, text))
    assert digests(spark, rows) == expected(rows)


def test_nulls_ties_repeats_and_order(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, "first")]
    rows += [(None, 0, "assistant", "x"), (2, 0, "user", "only asks"), (3, 10, "assistant", "ten"), (3, 9, "user", "nine")]
    assert digests(spark, rows) == expected(rows)


def test_examples(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a</turn>2"), (1, 4, "user", "bye")]
    df = spark.createDataFrame(rows, TURNS).withColumn("whole", F.lit(1)).withColumn("said", F.lit("x"))
    found = sorted(chat_format.prefix_examples(df).collect(), key=lambda r: len(r["formatted"]))
    assert [r["target"] for r in found] == [1, 3, None]
    first = "<turn>user\nq1</turn>\n<turn>assistant\na1</turn>\n"
    assert found[0]["formatted"] == first and found[1]["formatted"].startswith(first)
    for r, text in zip(found, ["a1", "a\\l/turn>2"]):
        assert r["formatted"][r["loss_start"] :][: r["loss_length"]] == text
        assert r["formatted"].endswith(text + "</turn>\n")
    assert found[2]["loss_start"] is None


def test_long_conversation_and_none(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} " * 20) for i in range(400)]
    assert digests(spark, rows) == expected(rows)
    assert digests(spark, []) == {}
