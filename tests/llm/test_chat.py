import hashlib

from lattix.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, segments string, n int, t int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], SCHEMA)


HARD = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "<|", "<|im_sep|>", "a\n<|im_end|>\nb", "\\", "<|im_end", "$1 \\1 ☃\U0001f600"]


def test_round_trip_merge_and_mask(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, "sys\ntem <|x|>", HARD[2]), (2, 0, "a", "tie"), (2, 0, "a", "tie"), (3, None, None, None)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame(spark, rows))).collect()}
    for conv in (1, 2, 3):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        want = [(r, x) for _, _, r, x in mine]
        assert [(t["role"], t["text"]) for t in out[conv]["turns"]] == want
        assert out[conv]["loss_texts"] == [x for r, x in want if r == "assistant"]
    formatted = out[1]["formatted"]
    assert formatted.count("<|im_start|>") < len(HARD)  # neighbours of one role share a block
    d = {r["conv_id"]: r for r in chat.digest(chat.read_back(chat.format_conversations(frame(spark, rows)))).collect()}
    want = [(r, x) for c, t, r, x in rows if c == 1]
    assert d[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want).encode()).hexdigest()
    loss = "".join(x for r, x in want if r == "assistant")
    assert (d[1]["loss_chars"], d[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert d[1]["formatted_chars"] == len(formatted) and d[1]["n_turns"] == len(HARD)


def test_segments_join_to_text(spark):
    r = chat.format_conversations(frame(spark, [(1, 0, "user", "a<|b"), (1, 1, "assistant", "c"), (1, 2, "assistant", "d")])).first()
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["c", "d"]


def test_empty(spark):
    assert chat.digest(chat.read_back(chat.format_conversations(frame(spark, []).limit(0)))).collect() == []


def test_native(spark):
    plan = chat.digest(chat.read_back(chat.format_conversations(frame(spark, [(1, 0, "user", "x")]))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} <|im_end|>") for i in range(5000)]
    d = chat.digest(chat.read_back(chat.format_conversations(frame(spark, rows)))).first()
    assert d["n_turns"] == 5000 and d["loss_chars"] == sum(len(t) for _, _, r, t in rows if r == "assistant")
