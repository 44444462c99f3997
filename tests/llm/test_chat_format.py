import random

from tidemark.llm import chat_format as C
from tidemark.llm.queries import ORACLES, QUERIES

from .oracle import same_rows


def test_round_trip_of_hard_texts(spark):
    rng = random.Random(8)
    parts = [*C.INSTRUCT.control, "\\", "<", ">", "[", "]", "/", "s", "INST", "\n", " ", "é", "😀", "$1", "<<", "</", "ok", *(c[:-1] for c in C.INSTRUCT.control), *(c[1:] for c in C.INSTRUCT.control)]
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "".join(rng.choices(parts, k=2)), None])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choices(parts, k=rng.randint(1, 8)))]) if rng.random() < 0.9 else "x" * 5000))
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df)).collect()}
    for conv in range(300):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [(x.role, x.text) for x in got[conv].turns] == own
        assert list(got[conv].loss_texts) == [t for r, t in own if r == "assistant"]
        inner = [s.text for i, s in enumerate(got[conv].segments) if i % 3 == 1]
        assert not any(c in t for c in C.INSTRUCT.control for t in inner)


def test_the_machine(spark):
    rows = [(c, i, r, "t") for c, roles in enumerate(["ua", "sua", "uaua", "su", "au", "uua", "usa", "x", "sa", "suaa"]) for i, r in enumerate(roles)]
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    df = spark.createDataFrame([(c, i, names[r], t) for c, i, r, t in rows], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.bad_turns) for r in C.format_conversations(df).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 2), 7: (False, 1), 8: (False, 1), 9: (False, 1)}


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, None, "user", "a"), (None, 1, "user", None), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [t.text for t in r.turns] for r in C.read_back(C.format_conversations(df)).collect()}
    assert got == {None: ["a", ""], 1: ["a", "b", "b"]}
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_query_equals_sql(spark):
    same_rows(spark, QUERIES["op5_chat_format"], ORACLES["op5_chat_format"])
