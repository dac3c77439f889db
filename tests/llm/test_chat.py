from __future__ import annotations

import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from sensorloom.llm import chat, queries

from ..compare import connect, mismatch
from .data import SF

CONTROL = re.compile(r"</?s>|\[/?(?:INST|SYS|ANS|ROLE)\]")
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/ROLE]", "\\", "<", "[", "/", "s>", "INST]", "ROLE]", "x", " ", "\n", "é", "\U0001f600", "$1", "\x00"]


def test_sql(spark):
    assert mismatch(queries.op13(spark, SF), connect(SF), queries.ORACLES["op13_chat_format"]) is None


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(20_000)] + ["<" + "\\" * 200_000 + "/s>", "[" * 100_000, "a" * 3_000_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert back == t and not CONTROL.search(e)
        if not re.search(r"<\\*/?s>|\[\\*/?(INST|SYS|ANS|ROLE)\]", t):
            assert e == t


def folded(events):
    """Final messages of one log, by hand: conv -> [(role, text)]."""
    seen, logs = set(), {}
    for e in sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[2], e[4], e[5] or "", e[6] or "")):
        if e not in seen:
            seen.add(e)
            logs.setdefault(e[0], {}).setdefault(e[3], []).append(e)
    out = {}
    for c, messages in logs.items():
        rows = []
        for es in messages.values():
            text, role = "", ""
            for e in es:
                text = (text if e[4] == "delta" else "") + (e[6] or "")
                role = role if e[5] is None else e[5]
            rows.append(((es[0][1] is not None, es[0][1] or 0, es[0][2]), role, text))
        out[c] = [r[1:] for r in sorted(rows)]
    return out


def random_log(rng):
    events = []
    for c in (1, 2, None):
        seq = 0
        for m in range(12):
            for kind in ["message", *rng.choices(["delta", "delta", "edit", "regenerate"], k=rng.randrange(6))]:
                seq += 1
                role = rng.choice(["user", "assistant", "system", "tool [ROLE]", None]) if kind == "message" else None
                text = rng.choice([None, "", "".join(rng.choice(PARTS) for _ in range(5))])
                events.append((c, seq, 0, m, kind, role, text))
    events += rng.sample(events, 20)  # delivered twice
    rng.shuffle(events)
    return events


def test_logs_fold_to_final_messages(spark):
    events = random_log(random.Random(9))
    log = spark.createDataFrame([(*e, "extra", 1) for e in events], chat.LOG + ", place string, row int").repartition(5)
    want = folded([tuple(e) for e in events])
    for per_row in (256, 5, 1):
        path = chat.chat_folder(spark)
        chat.write_chats(log, path, per_row)
        rows = spark.read.parquet(path)
        assert rows.agg(F.max("n_turns")).first()[0] <= per_row
        got, learned = {}, {}
        for r in chat.read_turns(rows).orderBy("row").collect():
            got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
            learned.setdefault(r.conv_id, []).extend(r.learned)
        assert got == want
        assert learned == {c: [t for role, t in turns if role == "assistant"] for c, turns in want.items()}
        for d in chat.read_digests(spark, path).collect():
            turns = want[d.conv_id]
            assert d.n_turns == len(turns)
            assert d.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            text = "".join(t for r, t in turns if r == "assistant")
            assert (d.loss_chars, d.loss_sha256) == (len(text), sha256(text.encode()).hexdigest())


def test_conversations_come_back(spark):
    rows = [(1, None, "user", "first"), (1, 0, "assistant", None), (1, 0, "user", "<s>" * 2_000), (1, 0, "user", "<s>" * 2_000), (2, 5, None, "no role"),
            (2, 4, "system", "[SYS]" + "long \n" * 100_000), (None, 1, "assistant", "no id"), (3, 0, "[/ROLE]", "")]
    rows += [(4, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1500)]  # most of all turns
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, message string").repartition(6)
    path = chat.chat_folder(spark)
    chat.write_chats(chat.log_of(df), path)
    got = {d.conv_id: d for d in chat.read_digests(spark, path).collect()}
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert got[c].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == sum(len(t) for r, t in turns if r == "assistant")
    chat.write_chats(chat.log_of(df.limit(0)), path + "-none")
    assert chat.read_digests(spark, path + "-none").count() == 0
