"""Chat formatting: folds against one event at a time, exact round trips, SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pulseloom.llm.chat import MARKERS, escaped, formatted, log_of_turns, parse, read_back, reconstruct, render, unescaped

LOG = "conv_id long, seq long, kind string, message long, role string, text string"
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "<|role|>", "<|says|>", "<|end|>"]


def walk(events):
    """The final (opened, role, text) of one conversation, by one event after the other."""
    order = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3}
    state, spans = {}, []
    for seq, kind, message, role, text in sorted(events, key=lambda e: (e[0], order[e[1]], e[4] or "")):
        m = state.setdefault(message, {"opened": seq, "role": None, "text": ""})
        m["role"] = role if m["role"] is None else m["role"]
        m["text"] = (m["text"] if kind == "delta" else "") + (text or "")
        if kind == "regenerate":
            spans.append((m["opened"], seq))
    return sorted((m["opened"], m["role"] or "", m["text"]) for m in state.values() if not any(a < m["opened"] < b for a, b in spans))


def test_reconstruct_by_brute_force(spark):
    rng = random.Random(7)
    log = []
    for conv in [*range(40), None]:
        events, opened = [], []
        for seq in range(rng.randrange(60)):
            if not opened or rng.random() < 0.3:
                opened.append(len(opened))
                events.append((seq * 3, "open", opened[-1], rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["", "hm ", None])))
            else:
                m = rng.choice(opened)
                kind = rng.choices(["delta", "edit", "regenerate"], [6, 1, 1])[0]
                events.append((seq * 3 - (rng.random() < 0.2), kind, m, None, rng.choice([f"w{seq} ", "é\n", "", None])))
        log += [(conv, *e) for e in events]
    rng.shuffle(log)
    d = spark.createDataFrame(log, LOG).withColumns({c: F.lit(1) for c in ("opened", "part", "reach", "piece", "before")}).repartition(5)
    got = {}
    for r in reconstruct(d).collect():
        got.setdefault(r.conv_id, []).append((int(r.opened), r.role, r.text))
    want = {c: walk([e[1:] for e in log if e[0] == c]) for c in {e[0] for e in log}}
    assert {c: sorted(v) for c, v in got.items()} == {c: v for c, v in want.items() if v}
    assert reconstruct(d.limit(0)).count() == 0 and read_back(formatted(d.limit(0))).count() == 0
    # an unknown kind, and a message without an opening
    odd = spark.createDataFrame([(1, 5, "delta", 1, None, "a"), (1, 4, "what", 1, "user", "b"), (1, None, "delta", 2, "user", "c")], LOG)
    assert sorted((r.role, r.text) for r in reconstruct(odd).collect()) == [("", "a"), ("user", "c")]


def test_escapes(spark):
    rng = random.Random(8)
    parts = [*CONTROLS, "\\", "<", "[", ">", "]", "<\\s>", "[\\\\INST]", "<\\\\\\|end|>", "/", "s>", " ", "\n", "é", "𝄞", "INST]", "<<s>>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(1500)] + CONTROLS
    rows = spark.createDataFrame([(i, t, rng.choice(["user", "assistant", "system", "tool", t])) for i, t in enumerate(texts)], "conv_id long, text string, role string")
    for r in rows.withColumn("e", escaped(F.col("text"))).collect():
        assert unescaped(r.e) == r.text and not any(c in r.e for c in CONTROLS)
    whole, want = "", []
    for r in render(rows).join(rows.select("conv_id", "text"), "conv_id").collect():
        role = r.role
        assert parse(r.piece) == [(role, r.text)]
        assert unescaped(r.piece[r.loss_from : r.loss_to]) == (r.text if role == "assistant" else "")
        whole += r.piece
        want.append((role, r.text))
    assert parse(whole) == want
    with pytest.raises(ValueError):
        parse("[INST] open")


def digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_turns(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["é" * rng.randrange(1600), "", None, "<s>[INST] hi</s>", "𝄞\n" * 700])) for c in range(60) for t in range(rng.randrange(9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(900)]
    rows += [(101, None, "user", "first"), (101, -5, "assistant", "second"), (101, 2**62, None, "third"), (None, 1, "user", "x"), (102, 1, "user", "same"), (102, 1, "user", "same"), (103, 0, "assistant", "y" * 300_000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    d = spark.createDataFrame(shuffled, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("message", "seq", "kind", "step", "e", "opened")}).repartition(6)
    log = log_of_turns(d)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    got = {r.conv_id: r for r in read_back(formatted(log)).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == {c: digest(v) for c, v in by.items()}
    assert got[102].formatted_chars == 2 * (len("same") + len("".join(MARKERS["user"])))


def test_sql(spark, sf):
    from pulseloom.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = QUERIES["op12_event_sourced_chat"](spark, sf)
    want = con.sql(ORACLE_SQL["op12_event_sourced_chat"])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows == sorted(want.fetchall())
    said = "</s>[INST] ok [/INST]"
    assert rows[0][:5] == (-7, *digest([("user", said), ("assistant", said)]))
