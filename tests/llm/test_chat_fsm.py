import hashlib

from remuneria.llm import chat_fsm as op

ODD = ["", "<", "<|", "<\\|im_end|>", "<|im_end|>\n<|im_start|>assistant\nx", "<\\\\|", "a<\\", "|>", "<|nl|>", "ü\n\n", "<<|<|", "\\<|"]


def test_escapes_are_reversible(spark):
    d = spark.createDataFrame([(t,) for t in ODD], "t string")
    for r in d.select("t", op.escape(d.t).alias("e"), op.unescape(op.escape(d.t)).alias("u"), op.unescape_role(op.escape_role(d.t)).alias("r")).collect():
        assert r.u == r.t == r.r and "<|" not in r.e


def test_round_trip_and_loss(spark):
    rows = []
    for c in range(len(ODD)):
        rows += [(c, 0, "user", ODD[c], 1), (c, 1, "assistant", ODD[-c], 1), (c, 2, "user", "q" + ODD[c], 1), (c, 3, "assistant", ODD[c] * 2, 1)]
    rows += [(100, 1, "user", None, 1), (100, None, "system", "s", 1), (101, 0, None, "x", 1), (102, 0, "as\nsistant", "y", 1),
             (103, 0, "user", "same", 1), (103, 0, "user", "same", 1), (None, 0, "user", "z", 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int").repartition(3)
    formatted = {r.conv_id: r for r in op.format_conversations(d).collect()}
    got = {r.conv_id: r for r in op.chat_digests(d).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c in got:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x, _ in rows if i == c))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        f = formatted[c]
        assert f.formatted == "".join(s.text for s in f.segments) and len(f.formatted) == r.formatted_chars
        assert all(s.text not in ("<|im_end|>\n",) for s in f.segments if s.loss)
    assert got[0].valid and not got[100].valid and not got[101].valid and not got[102].valid and not got[103].valid


def test_machine(spark):
    cases = {"system user assistant": True, "user assistant user assistant": True, "user": False, "assistant": False, "user user assistant": False,
             "user assistant tool assistant": True, "user assistant tool tool assistant": True, "system assistant": False}
    rows = [(i, t, r, "x") for i, s in enumerate(cases) for t, r in enumerate(s.split())]
    got = {r.conv_id: r.valid for r in op.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_empty(spark):
    assert op.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
