"""Folding of events, escapes, and the read-back against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from sparkloom.llm import chat_format as C
from sparkloom.llm import queries as Q

SCHEMA = "conv_id long, seq long, message long, kind string, role string, text string"


def plain_fold(events):
    messages = {}
    for e in events:
        messages.setdefault((e[0], e[2]), []).append(e)
    out = {}
    for key, rows in messages.items():
        rows = sorted(set(rows), key=lambda e: (e[1], e[3] == "delta", e[3], e[5] or ""))
        text, role, last = "", None, None
        for _, seq, _, kind, r, t in rows:
            role = r if r is not None else role
            if kind == "delta":
                text += t or ""
            else:
                text = t or ""
        out[key] = (role or "", text)
    return out


def test_folds_like_a_replay(spark):
    rng = random.Random(5)
    events = []
    for conv in range(6):
        for message in range(3):
            for seq in range(rng.choice([1, 2, 9])):
                kind = rng.choice(["delta", "delta", "delta", "edit", "regenerate", "message"]) if seq else "message"
                events.append((conv, 100 * message + seq, message, kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "</s>", None, ""])))
    rng.shuffle(events)
    events += events[:5]  # repeated events count once
    found = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in C.fold_events(spark.createDataFrame(events, SCHEMA)).collect()}
    assert found == plain_fold(events)


NASTY = ["", "</s>", "</s>\n", "<s>[INST] x [/INST]\n", "<\\s>", "<\\\\/s>", "[\\INST]", "[/INST]", "<</s>", "a\nb", "\\", "<", "[", "$1 \\$2", "é\u0001😀", " [/INST]\ny"]


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "x", "\n", "<s>"]
    texts = NASTY + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_read_back(spark):
    rows = [(k % 3 if k % 5 else None, k // 3, ["user", "assistant", "system", None, "[/INST]\n"][k % 5], t) for k, t in enumerate(NASTY)] + [(9, 0, "assistant", None), (9, 0, "assistant", None)]
    table = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "conv_id long, turn long, role string, text string, formatted string, message double")
    found = {r["conv_id"]: r for r in C.read_back(C.format_conversations(C.table_events(table))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == conv)
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == [(r[2], r[4]) for r in own]
        assert found[conv]["loss_texts"] == [r[4] for r in own if r[2] == "assistant"]


def test_empty_log(spark):
    assert C.read_back(C.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_digests(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", Q.PROBE), (-7, 1, "assistant", Q.PROBE)]
    found = {r["conv_id"]: r for r in Q.op2_chat_format(spark, sf_dir).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, got in found.items():
        own = sorted(r for r in rows if r[0] == conv)
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert got["n_turns"] == len(own)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
