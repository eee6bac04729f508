"""Chat layouts by fingerprint, the template's round trip, and the loss mask."""

import hashlib
import json
import random

import pytest

from voxarbor.llm import chat

LONG = "word | <| \\ " * 40_000


def turns_of(spark, records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r), "x", "y") for i, r in enumerate(records)],
                               "conv_id long, record string, turn string, text string")
    out = {}
    for r in chat.record_turns(df).collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.layout))
    return {k: sorted(v, key=lambda t: (t[0] is None, t[0])) for k, v in out.items()}


def test_each_layout_becomes_turns(spark):
    got = turns_of(spark, [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "name": "n"}], "id": 7},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s", "extra": {"x": [1]}},
        {"instruction": "do", "input": "this", "output": "done", "history": [["a", "b"], ["c", "d"]]},
        {"instruction": "do", "context": "", "response": 5},
        {"prompt": "a", "completion": "b"},
        {"question": "a", "answer": "b", "source": None},
        {"dialogue": ["a", "b", "c"]},
    ])
    said = {k: [(r, t) for _, r, t, _ in v] for k, v in got.items()}
    assert said[0] == [("user", "a"), ("assistant", "")]
    assert said[1] == [("user", "ab")]
    assert said[2] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert said[3] == [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "do\n\nthis"), ("assistant", "done")]
    assert said[4] == [("user", "do"), ("assistant", "5")]
    assert said[5] == said[6] == [("user", "a"), ("assistant", "b")]
    assert said[7] == [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert [got[i][0][3] for i in range(8)] == [
        "messages", "message parts", "speakers", "instruction", "instruction and response", "prompt and completion",
        "question and answer", "dialogue"]


def test_unknown_and_broken_records_are_reported(spark):
    deep = "[" * 100_000
    got = turns_of(spark, [None, "", "{", "[1]", {}, {"messages": []}, {"text": "a"}, {"prompt": "a"}, deep,
                           {"instruction": "a", "output": "b", "prompt": "c"}])
    assert [v[0][3] for _, v in sorted(got.items())] == ["no record"] * 4 + ["unknown"] * 4 + ["no record", "unknown"]
    assert all(v == [(None, None, None, v[0][3])] for v in got.values())


def test_fingerprints_depend_on_paths_alone():
    known = chat.vocabulary()
    a = chat.fingerprint(chat.record_paths({"prompt": 1, "completion": {"x": 1}, "meta": {"y": [1]}}), known)
    b = chat.fingerprint(chat.record_paths({"prompt": "z", "other": []}), known)
    assert a == b != chat.fingerprint(["prompt", "completion"], known)
    assert list(chat.record_paths({"a": [{"b": [1, 2]}, {"c": {}}], "d": []})) == ["a[].b[]", "a[].b[]", "a[].c", "d[]"]
    with pytest.raises(ValueError):
        chat.fingerprints((*chat.LAYOUTS, chat.Layout("again", ("prompt", "completion"))))


def test_table_layouts(spark):
    df = spark.createDataFrame([(1, 0, "user", None, "x", "y")], "conv_id long, turn long, role string, text string, formatted string, _role string")
    row = chat.table_turns(df).collect()[0]
    assert (row.conv_id, row.turn, row.role, row.text, row.layout) == (1, 0, "user", "", "turn rows")
    with pytest.raises(ValueError):
        chat.table_turns(df.drop("turn"))


def said_rows(seed):
    rnd = random.Random(seed)
    signs = ["<", "|", "\\", "<|", "|>", "<|im_end|>", "<|im_start|>", "\n", "a", "é", "😀", "%0A", "%", " ", "<\\|", "<\\\\|im_end|>"]
    return [(c, t, rnd.choice(["user", "assistant", "system", "to\nol%", "<|x"]), "".join(rnd.choice(signs) for _ in range(rnd.randrange(30))))
            for c in range(60) for t in range(rnd.randrange(1, 6))]


def want(rows):
    out, order = {}, lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _, role, text in sorted(rows, key=order):
        role, text = role or "", text or ""
        turns, learned, n = out.get(c, ("", "", 0))
        out[c] = turns + f"{role}\n{text}\n", learned + (text if role == "assistant" else ""), n + 1
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, digest(t), len(x), digest(x)) for c, (t, x, n) in out.items()}


def digests(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = chat.read_back(chat.conversations(chat.table_turns(df), **options)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_round_trip(spark):
    for seed in range(3):
        rows = said_rows(seed)
        assert digests(spark, rows) == want(rows)
        assert digests(spark, rows, part_chars=20) == want(rows)


def test_no_control_string_survives(spark):
    df = spark.createDataFrame(said_rows(9), "conv_id long, turn long, role string, text string")
    for r in chat.rendered(chat.table_turns(df)).collect():
        assert r.formatted.count("<|") == 2 and r.formatted.count("<|im_end|>") == 1
        if r.loss_from is not None:
            assert chat.unescaped(r.formatted[r.loss_from:r.loss_to]) == r.text


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "b"), (None, 3, "assistant", "c"),
            (2, 0, "assistant", LONG), (2, 1, "user", LONG), (2, 2, "assistant", "<|im_end|>")]
    assert digests(spark, rows) == want(rows)
    assert digests(spark, []) == {}


def test_one_large_conversation_in_parts(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} <|") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.conversations(chat.table_turns(df), part_chars=1000).collect()
    assert [p.part for p in parts] == list(range(len(parts))) and len(parts) > 50
    assert digests(spark, rows, part_chars=1000) == want(rows)
