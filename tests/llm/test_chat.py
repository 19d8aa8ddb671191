import hashlib
import random

import pytest

from censora.llm import chat
from censora.session import materialise

CONTROL = ["<", "|", ">", "\\", "/s>", "s>", "[", "INST]", "/INST]", "a", "</s>", "[INST]", "<|", "]", "/", "é"]


def test_control_strings_are_escaped_reversibly():
    pick = random.Random(15)
    for _ in range(20_000):
        text = "".join(pick.choice(CONTROL) for _ in range(pick.randint(0, 8)))
        shown = chat.escaped(text)
        assert chat.unescaped(shown) == text
        assert not any(c in shown for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))
        turns = [(text, text), ("user", text[::-1]), (text, "")]
        assert list(chat.parsed("".join(chat.formatted_turn(*t)[0] for t in turns))) == turns


def brute(rows):
    said = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in said.items():
        turns = [t[2:] for t in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        size = sum(len(chat.formatted_turn(r, t)[0]) for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), size))
    return sorted(map(str, out))


DDL = "conv_id long, turn long, role string, text string"


@pytest.fixture
def rows():
    pick = random.Random(16)
    out = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "x"), (None, 1, None, None)]
    out += [(5000, k, "user", "again") for k in (0, 0, 1)] + [(5001, None, "user", "first"), (5001, 0, "assistant", "y" * 200_000)]
    for conv in range(300):
        out.append((conv, 0, "system", "Be kind." if conv % 3 else "Be short."))
        for turn in range(1, pick.randint(1, 6)):
            out.append((conv, turn, ("user", "assistant")[turn % 2], pick.choice(["yes", "no", "<|maybe|>"])))
    out += [(conv, 0, "user", "the same") for conv in range(6000, 8500)]
    return out


def test_what_is_read_back(spark, rows):
    df = spark.createDataFrame(rows, DDL).repartition(4).selectExpr("*", "1 AS node", "'n' AS path", "'t' AS turns")
    packed = materialise(chat.sequences(df), "chat")
    assert sorted(str(tuple(r)) for r in chat.read_back(packed).collect()) == brute(rows)
    assert all(len(r["leaves"]) <= chat.SEQUENCE_LEAVES for r in packed.select("leaves").collect())


def test_shared_turns_are_written_once_and_ancestors_are_seen(spark, rows):
    df = spark.createDataFrame(rows[9:2000], DDL).coalesce(1)
    found = chat.sequences(df).collect()
    total = sum(len(chat.formatted_turn(r, t)[0]) for _, _, r, t in rows[9:2000])
    assert sum(len(s["text"]) for s in found) < 0.4 * total
    for s in found:
        ids = chat.position_ids(s)
        assert len(ids) == len(s["text"])
        for n in s["nodes"]:
            above, at = [], n["parent"]
            while at >= 0:
                above.append(s["nodes"][at])
                at = s["nodes"][at]["parent"]
            want = {i for a in above for i in range(a["start"], a["end"])}
            assert {i for a in n["attends"] for i in range(a["start"], a["end"])} == want
            # Position ids run on from the ancestors' without a gap.
            assert sorted(int(ids[i]) for i in want) == list(range(n["position"]))
            assert n["parent"] < len(s["nodes"]) and all(a["end"] <= n["start"] for a in above)


def test_empty_table(spark):
    assert chat.read_back(chat.sequences(spark.createDataFrame([], DDL))).collect() == []
