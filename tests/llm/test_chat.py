import hashlib
import random

from pyspark.sql import functions as F

from tidings.llm.chat import CODES, escape, format_examples, parse_turns, trained_text, unescape

ODD = ["", None, "</s>[INST] ok [/INST]", "<|im_end|>\n", "\\l\\e<[\\", "<|im_start|>assistant\nhi<|im_end|>\n", "é\U0001f600\n\n", "\\"]


def test_codes_are_undone(spark):
    r = random.Random(3)
    texts = [("".join(r.choice("\\<[elbn|im_\n>") for _ in range(r.randint(0, 12))),) for _ in range(400)]
    got = spark.createDataFrame(texts, "t string").select("t", escape(F.col("t"), CODES).alias("e"), unescape(escape(F.col("t"), CODES), CODES).alias("u")).collect()
    assert all(x.t == x.u and "<" not in x.e and "[" not in x.e for x in got)


def conversations(spark):
    r = random.Random(5)
    rows = []
    for c in range(12):
        rows += [(c, t, r.choice(["user", "assistant", "system", None, "ro\nle"]), r.choice(ODD) if r.random() < 0.6 else f"text {c} {t}", "x") for t in range(r.randint(1, 9))]
    rows += [(50, 1, "assistant", "b", "x"), (50, 1, "assistant", "a", "x"), (50, 1, "assistant", "a", "x"), (None, 0, "assistant", "null id", "x"), (51, None, "user", None, "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string").repartition(4)


def test_examples_against_a_loop(spark):
    rows, table = conversations(spark)
    examples = format_examples(table)
    got = {}
    for e in examples.select("*", parse_turns(F.col("text")).alias("turns"), trained_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("reply")).collect():
        got.setdefault(e.conv_id, []).append(e)
    assert set(got) == {r[0] for r in rows}
    for c, found in got.items():
        turns = [(x[2], x[3]) for x in sorted(((r[1] if r[1] is not None else -1, 0, r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0], x[2].encode(), x[3].encode()))]
        found.sort(key=lambda e: e.example)
        assert [e.example for e in found] == [i for i, t in enumerate(turns) if t[0] == "assistant" or i == len(turns) - 1]
        for e in found:
            assert [tuple(t) for t in e.turns] == turns[:e.example + 1]
            role, text = turns[e.example]
            assert e.reply == (text if role == "assistant" else "")


def test_empty(spark):
    assert format_examples(conversations(spark)[1].limit(0)).count() == 0


def test_query_against_a_loop(spark, tmp_path):
    from tidings.llm.chat import op8_prefix_targets
    rows, table = conversations(spark)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op8_prefix_targets(spark, str(tmp_path)).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(probe) and got[-1].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert got[50].loss_sha256 == hashlib.sha256(b"aab").hexdigest() and got[50].n_turns == 3
    assert len(got) == len({r[0] for r in rows}) + 1
