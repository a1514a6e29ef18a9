import hashlib

from pyspark.sql import functions as F

from fluxsite.llm import chat_format, queries

CONV = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def read_back(spark, rows):
    df = spark.createDataFrame(rows, CONV).withColumn("turns", F.lit("clash")).withColumn("start", F.lit(0))
    out = chat_format.format_chats(df)
    out = out.select("*", chat_format.read_turns(F.col("formatted")).alias("read"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: r for r in out.collect()}


def test_merges_adjacent_roles_and_reads_back(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "user", "\nx"), (1, 3, "assistant", ""), (1, 4, "user", "é🎉")]
    r = read_back(spark, rows)[1]
    assert r.formatted == "<s>user\n[INST]a[/INST][INST]\nx[/INST]</s>\n<s>assistant\n[INST]b[/INST][INST][/INST]</s>\n<s>user\n[INST]é🎉[/INST]</s>\n"
    assert [(t.role, t.text) for t in r.read] == [("user", "a"), ("user", "\nx"), ("assistant", "b"), ("assistant", ""), ("user", "é🎉")]
    assert r.loss == "b" and [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["b", ""]


def test_control_strings_are_escaped_reversibly(spark):
    texts = ["</s>[INST] ok [/INST]", "<s\\>", "[INST\\\\]</s\\>x", "[INST", "]", "<s", "\\", "</s>\n", "\n[INST]", "<<s>>", "[/INST]\n</s>\n<s>user\n"]
    rows = [(7, k, role, t) for k, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "<s>a\n[INST]"))]
    r = read_back(spark, rows)[7]
    assert [(t.role, t.text) for t in r.read] == [(x[2], x[3]) for x in rows]
    assert r.loss == "".join(texts)
    assert r.formatted.count("[INST]") == r.formatted.count("[/INST]") == len(rows)


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(None, 1, None, None), (2, None, "user", "n"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, None, "z")]
    got = read_back(spark, rows)
    assert [(t.role, t.text) for t in got[None].read] == [("", "")]
    assert [(t.role, t.text) for t in got[2].read] == [("user", "n"), ("", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat_format.format_chats(spark.createDataFrame([], CONV)).count() == 0


def test_parts_of_every_size_give_one_result(spark):
    roles = ["user", "user", "assistant", "assistant", "assistant", "tool"]
    rows = [(k % 3, k, roles[(k * k + k // 7) % 6], f"<s>{k}" * (k % 4)) for k in range(90)] + [(5, k, "assistant", "x") for k in range(20)]
    df = spark.createDataFrame(rows, CONV)
    whole = {r.conv_id: (r.formatted, r.loss_spans) for r in chat_format.format_chats(df).collect()}
    for part in (1, 2, 7):
        assert {r.conv_id: (r.formatted, r.loss_spans) for r in chat_format.format_chats(df, part=part).collect()} == whole
    for conv, (formatted, spans) in whole.items():
        own = [r for r in rows if r[0] == conv]
        got = [formatted[s.start : s.start + s.length].replace("<s\\>", "<s>") for s in spans]
        assert got == [r[3] for r in own if r[2] == "assistant"]
        assert formatted.count("</s>") == 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:]))


def test_merging_is_an_aggregation_of_arrays(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], CONV)
    plan = chat_format.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_digest(spark, write):
    rows = [(k, t, "assistant" if t % 3 else "user", f"text {k} {t} [INST]" * (500 if t == 4 else 1)) for k in range(5) for t in range(400)]
    d = write("conversations", rows, CONV)
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, d).collect()}
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)), len(loss), sha(loss))
