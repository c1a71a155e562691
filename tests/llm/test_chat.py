import hashlib
import random

from mailshift.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int"


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def check(rows, turns):
    own = {}
    for conv_id, turn, role, text in turns:
        own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert {r.conv_id for r in rows} == set(own) and len(rows) == len(own)
    for r in rows:
        told = [(role, text) for _, _, role, text in sorted(own[r.conv_id])]
        loss = "".join(t for role, t in told if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(told), digest(told))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_query_against_brute_force(spark, sf):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    odd = "\\### Assistant: </turn> ok"
    check(queries.op8_chat(spark, sf).collect(), [*turns, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])


def test_windows_round_trip():
    random.seed(1)
    parts = ["a ", "###", "</turn>", "\\", ":", " ", "\n", "### user: ", " </turn>\n", "é", "<", "/turn>", "#"]
    roles = ["user", "assistant", "system", "", "x:y", "a\\", "b ###"]
    for _ in range(1500):
        turns = [(random.choice(roles), "".join(random.choice(parts) for _ in range(random.randint(0, 12)))) for _ in range(random.randint(1, 12))]
        budget, history = random.choice([20, 60, 120]), random.choice([0, 15, 50])
        back, loss = [], []
        for n, (text, repeated, new, spans) in enumerate(chat.windows(iter(turns), len, budget, history)):
            read = chat.read_window(text)
            assert len(read) == repeated + new and new
            assert len(text) <= budget or new == 1
            if n and turns[0][0] == "system":
                assert read[0] == turns[0]
            start = len(back) - (repeated - (1 if n and turns[0][0] == "system" else 0))
            assert read[:repeated][-(len(back) - start):] == back[start:] or start == len(back)
            back += read[repeated:]
            loss += [chat.unescaped(text[a:b]) for a, b in spans]
        assert back == turns and loss == [t for r, t in turns if r == "assistant"]


def test_hard_rows(spark):
    turns = [(1, 0, None, None), (1, 1, "assistant", ""), (2, None, "user", "x"), (2, 5, "assistant", "tie b"), (2, 5, "assistant", "tie a"), (2, 5, "assistant", "tie a"),
             (None, 0, "user", "no id"), (None, 1, "assistant", "still"), (3, 0, "system", "s " * 3000), (3, 1, "assistant", "long " * 9000), (3, 2, "user", "u")]
    table = spark.createDataFrame([(*t, 1) for t in turns], SCHEMA)
    windows = chat.format_conversations(table)
    check(chat.read_back(windows).collect(), turns)
    assert windows.where("conv_id = 3").count() == 3
    none = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(none)).count() == 0
