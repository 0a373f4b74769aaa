import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import chat, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query(spark, sf):
    chats = {}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for c, t, r, x in [*rows, *queries.CONTROL]:
        chats.setdefault(c, []).append((t, r, x or ""))
    got = {r["conv_id"]: r for r in queries.op4_chat(spark, sf).collect()}
    assert set(got) == set(chats) and -7 in got
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_escaping_is_reversible(spark):
    rng = random.Random(3)
    bits = ["<", "s>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "[", "INST]", "[\\INST]", "/", "[:]", "[ROLE]", "$1", "x", "\n", "é🙂", "]"]
    texts = ["", *("".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(800))]
    rows = []
    for i, t in enumerate(texts):
        rows += [(i, 0, rng.choice(["system", "user", "tool", "", "odd[:]role", "[/ROLE]"]), t), (i, 1, "assistant", rng.choice(texts)), (i, 2, "user", t)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "formatted")
    got = {r["conv_id"]: r for r in made.collect()}
    for i in range(len(texts)):
        assert [tuple(t) for t in got[i]["turns"]] == [(r, x) for c, _, r, x in rows[3 * i : 3 * i + 3]]
        assert got[i]["loss"] == rows[3 * i + 1][3]
    marks = chat.TEMPLATE.marks
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escape(F.col("t")).alias("e")).collect()
    assert not any(m in r["e"] for r in plain for m in marks)


def test_machine_and_edges(spark):
    seq = {1: "system user assistant", 2: "user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user assistant tool assistant", 6: "user", 7: "user robot"}
    rows = [(c, i, r, "x") for c, s in seq.items() for i, r in enumerate(s.split())]
    rows += [(8, None, "user", None), (8, 1, None, "y"), (8, 1, "assistant", "z" * 300000), (None, 1, "user", "q"), (9, 1, "user", "tie b"), (9, 1, "user", "tie a"), (9, 1, "user", "tie a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert [got[c]["valid"] for c in range(1, 8)] == [True, True, False, False, True, False, False]
    assert [got[c]["state"] for c in (3, 6)] == ["error", "user"]
    assert None in got and got[8]["state"] == "error"
    assert got[9]["formatted"] == "[INST]tie a[/INST][INST]tie a[/INST][INST]tie b[/INST]"
    assert [(s["text"], s["loss"]) for s in got[2]["segments"]][3:6] == [("<s>", False), ("x", True), ("</s>", False)]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op4_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_states_and_flags_equal_a_plain_machine(spark):
    rng = random.Random(8)
    seqs = [[rng.choice(["system", "user", "assistant", "tool", "odd", "start", "error"][: rng.choice([3, 4, 7])]) for _ in range(rng.randint(1, 7))] for _ in range(400)]
    df = spark.createDataFrame([(c, i, r, f"t{i}") for c, s in enumerate(seqs) for i, r in enumerate(s)], "conv_id long, turn long, role string, text string")
    for r in chat.format_chats(df).collect():
        state, out = "start", []
        for i, role in enumerate(seqs[r["conv_id"]]):
            state = role if role in chat.TEMPLATE.turns.get(state, ()) and state != "error" else "error"
            opening, closing, loss = chat.TEMPLATE.roles.get(role, (f"[ROLE]{role}[:]", "[/ROLE]", False))
            out += [(opening, False), (f"t{i}", loss), (closing, False)]
        assert r["state"] == state and [tuple(s) for s in r["segments"]] == out


def test_the_plan_of_the_query_holds_the_machine(spark, sf):
    plan = queries.op4_chat(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert all(edge in plan for edge in ("start>user", "assistant>tool", "error>assistant"))
