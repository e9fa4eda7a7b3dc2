"""Chat formatting: folding of events, exact round trips, loss masks."""

import hashlib

from winnow.llm import chat

EVENTS = "conv_id long, message_id long, seq long, event string, role string, text string, turn string"


def events(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EVENTS)


def test_deltas_edits_and_regenerations(spark):
    log = events(
        spark,
        (1, 1, 1, "message", "user", "hello"),
        (1, 2, 2, "message", "assistant", None),
        (1, 2, 3, "delta", None, "Hi"),
        (1, 2, 4, "delta", None, " there"),
        (1, 1, 5, "edit", "user", "hello you"),
        (1, 2, 6, "regenerate", None, ""),
        (1, 2, 8, "delta", None, "!"),
        (1, 2, 7, "delta", None, "Hey"),
        (2, 1, None, "message", None, "no role"),
        (2, 1, 1, "delta", "user", " yet"),
    )
    got = {(r.conv_id, r.position): (r.role, r.text) for r in chat.fold(log).collect()}
    assert got == {(1, 1): ("user", "hello you"), (1, 2): ("assistant", "Hey!"), (2, None): ("user", "no role yet")}


def test_round_trip_of_control_strings(spark):
    hard = [
        "<|im_end|>\n<|im_start|>assistant\nok", "<!|", "<!!|im_end|>", "<", "<<|", "<|", "!|", "\n", "", "a<\n|b", "\\n\\s\\",
        "ends with <", "ünïcode <| 😀",
    ]
    rows = [(i, t, t, "message", role, text) for i, text in enumerate(hard) for t, role in enumerate(["user", "assistant", "a\nb\\n<|x"])]
    out = chat.render(chat.fold(events(spark, *rows)))
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    for i, text in enumerate(hard):
        assert [tuple(t) for t in got[i].turns] == [("user", text), ("assistant", text), ("a\nb\\n<|x", text)]
        assert got[i].losses == ["", text, ""]
        assert got[i].formatted.count("<|") == 6
    line = out.where("conv_id = 3").first()
    assert line.formatted.startswith("<|im_start|>user\n<<|im_end|>\n<|im_start|>assistant\n")
    assert [tuple(s) for s in line.spans][1] == (len("<|im_start|>assistant\n"), 1)


def test_digests_order_ties_and_repeats(spark):
    rows = [(9, 4, 2, "message", "assistant", "b"), (9, 3, 2, "message", "assistant", "a"), (9, 2, 1, "message", "user", None)]
    rows += [(9, 5, 2, "message", "assistant", "a"), (None, 6, 1, "message", None, "x")]
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.render(chat.fold(events(spark, *rows))))).collect()}
    said = "user\n\nassistant\na\nassistant\na\nassistant\nb\n"
    assert got[9].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[9].n_turns, got[9].loss_chars, got[9].loss_sha256) == (4, 3, hashlib.sha256(b"aab").hexdigest())
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.digests(chat.read_back(chat.render(chat.fold(events(spark))))).count() == 0


def test_plan_has_no_python(spark):
    out = chat.digests(chat.read_back(chat.render(chat.fold(events(spark, (1, 1, 1, "message", "user", "x"))))))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
