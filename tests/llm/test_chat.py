"""Chat logs folded, rendered and read back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import chat
from ebbtide.llm.common import table

EVENTS = "conv_id long, message long, turn long, seq long, kind string, role string, text string, mask string"
SAID = "</s>[INST] ok [/INST]"


def events(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EVENTS)


def fold(rows):
    """One message at a time, in order of seq."""
    order = ("message", "regenerate", "edit", "delta", "delete")
    out = {}
    for c, m, turn, seq, kind, role, text in sorted((r for r in rows if r[4] in order), key=lambda r: (r[3] if r[3] is not None else -1, order.index(r[4]), r[6] or "")):
        s = out.setdefault((c, m), {"gone": True, "text": "", "turn": None, "role": None, "place": seq})
        s["turn"], s["role"] = (turn if turn is not None else s["turn"]), (role if role is not None else s["role"])
        if kind in ("message", "edit"):
            s.update(gone=False, text=text or "")
        elif kind == "regenerate":
            s.update(gone=False, text="")
        elif kind == "delta":
            s.update(gone=False, text=(s["text"] if not s["gone"] else "") + (text or ""))
        else:
            s.update(gone=True, text="")
    return sorted(((c, s["turn"], s["role"], s["text"]) for (c, _), s in out.items() if not s["gone"]), key=str)


def test_fold_equals_a_walk_through_the_log(spark):
    rng = random.Random(4)
    rows = []
    for c in (1, 2, None):
        for m in range(15):
            seqs = rng.sample(range(1000), 9)
            rows.append((c, m, m // 2, min(seqs), "message", rng.choice(["user", "assistant", None]), "start "))
            for s in seqs[1:]:
                rows.append((c, m, None, s if s > min(seqs) else s + 1000, rng.choice(["delta", "delta", "edit", "regenerate", "delete", "odd"]), None, rng.choice(["a", "b\n", None, "<s>", ""])))
    rows += [(9, 1, 0, 1, "delta", "assistant", "streamed "), (9, 1, None, 2, "delta", None, "text"), (9, 2, 1, 5, "delete", "user", None)]
    got = chat.messages(events(spark, rows)).select("conv_id", "turn", "role", "text").collect()
    assert sorted((tuple(r) for r in got), key=str) == fold(rows)


@pytest.mark.parametrize("text", ["", SAID, "\\", "\\\\l", "\\b[", "<s><</SYS>>", "a\\", "x" * 100_000, "[[<<\\\\>>]]\n\t", "Zoë 🙂"])
def test_escape_is_reversible_and_hides_marks(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(m in safe for m in (chat.OPEN, chat.CLOSE, chat.INST, chat.END_INST, chat.SYS, chat.END_SYS))
    assert list(chat.parse(f"<s>[INST]{chat.escape(text)}[/INST]{safe}</s>")) == [(text, text)]


def digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("part", [50, 1 << 20])
def test_turns_read_back(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", SAID), (1, 2, "assistant", None), (1, 3, "assistant", SAID * 40), (2, 5, "user", "b"), (2, 4, None, "a"), (None, 1, "assistant", "no id"), (3, None, "as[INST]sistant", "x"), (4, 0, "assistant", "long " * 30_000)]
    rows += [(5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "assistant", "tie")]
    turns = spark.createDataFrame([(c, t, 0, r, x, "extra") for c, t, r, x in rows], "conv_id long, turn long, place int, role string, text string, part string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.render(turns)).collect()}
    want = {}
    for c, _, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r, x))
    assert got == {c: digest(t) for c, t in want.items()}


def test_query_over_given_conversations(spark, sf_dir):
    from ebbtide.llm import queries

    want = {-1: [("user", SAID), ("assistant", SAID)]}
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = queries.QUERIES["op6_chat_format"](spark, sf_dir).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {c: digest(t) for c, t in want.items()}
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_empty_table(spark):
    empty = events(spark, [])
    assert chat.digests(chat.render(chat.messages(empty))).collect() == []


def test_a_long_conversation_is_rendered_by_many_tasks(spark):
    rows = [(1, t, 0, "assistant" if t % 2 else "user", f"turn {t} <s> " + "x" * (t % 50)) for t in range(4000)] + [(c, 0, 0, "user", "hi") for c in range(2, 60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, place long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be put together again
    try:
        parts = spark.createDataFrame(chat.render(turns).collect(), chat.render(turns).schema).withColumn("task", F.shiftright("part", 32))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.filter("conv_id = 1").select("task").distinct().count() > 1
    said = [p for r in parts.filter("conv_id = 1").orderBy("part").collect() for p in chat.parse(r["text"])]
    assert said == [(r[3], r[4]) for r in rows[:4000]]
    got = {r["conv_id"]: r for r in chat.digests(parts.drop("task")).collect()}
    want = hashlib.sha256("".join(f"{r[3]}\n{r[4]}\n" for r in rows[:4000]).encode()).hexdigest()
    assert got[1]["turns_sha256"] == want and got[1]["n_turns"] == 4000 and len(got) == 59
