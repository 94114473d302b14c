import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, mixing

CONV = "conv_id long, turn long, role string, text string"
TRAPS = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "<\\/s>", "<<SYS>> a <</SYS>>", "a\nb", "", None, "<s><s></s></s>", "[[INST]]", "\\\\[INST]\\", "é日本", "<|im_end|>", "x" * 50_000]


def rendered(spark, rows):
    conv = spark.createDataFrame(rows, CONV)
    return chat.render(chat.fold_events(chat.events_of(conv)))


def test_round_trip(spark):
    rows = [(i, t, role, TRAPS[(i + t) % len(TRAPS)]) for i in range(len(TRAPS)) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(99, 0, "we\nird\\</s>", "t"), (99, 1, None, None), (99, 1, "assistant", "b"), (99, 1, "assistant", "b"), (None, None, "assistant", "lost"), (7, None, "user", "last")]
    got = {r["conv_id"]: r for r in chat.read_back(rendered(spark, rows)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest(), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_control_string_survives_in_a_text(spark):
    for r in rendered(spark, [(0, i, "user", t) for i, t in enumerate(TRAPS)]).collect():
        inner = re.sub(r"<s>user\n|</s>(?=<s>|$)", "", r["formatted"])
        assert not re.search(chat.CONTROL, inner)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "a"), (1, 3, 2, "delta", None, "b"), (1, 4, 2, "regenerate", None, None), (1, 5, 2, "delta", None, "c"), (1, 6, 2, "delta", None, "d"),
        (1, 7, 1, "edit", None, "hello"), (1, 8, 3, "edit", "user", "x"), (1, 9, 3, "delta", None, "y"), (1, 10, 4, "delta", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string").repartition(3)
    got = sorted((r["message"], r["role"], r["text"]) for r in chat.fold_events(events).collect())
    assert got == [(1, "user", "hello"), (2, "assistant", "cd"), (3, "user", "xy"), (4, "", "")]


def test_chat_empty_and_clashing(spark):
    conv = spark.createDataFrame([], CONV)
    assert chat.read_back(chat.render(chat.fold_events(chat.events_of(conv)))).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "a")], CONV).withColumn("seq", F.lit("q")).withColumn("head", F.lit(1))
    assert chat.read_back(chat.render(chat.fold_events(chat.events_of(more)))).head()["n_turns"] == 1


def test_a_very_long_conversation_is_read_back_in_proportion(spark):
    """20,000 turns: looking every span up from the string's start would be a day's work of copying."""
    import time

    said = [("assistant" if t % 2 else "user", f"turn {t} " + "word " * 40) for t in range(20_000)]
    conv = spark.createDataFrame([(1, t, role, text) for t, (role, text) in enumerate(said)], CONV)
    shown = chat.render(chat.fold_events(chat.events_of(conv)))
    assert shown.head()["n_turns"] == len(said)
    began = time.time()
    got = chat.read_back(shown).head()
    assert time.time() - began < 60
    loss = "".join(x for role, x in said if role == "assistant")
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (len(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_read_back_takes_only_what_the_spans_say(spark):
    """A span that is no body gives nothing, and a body without a span is not under the mask."""
    shown = chat.render(chat.fold_events(chat.events_of(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc")], CONV))))
    for change, loss in (("loss_spans", "bc"), ("filter(loss_spans, x -> false)", ""), ("transform(loss_spans, x -> struct(x.start + 1 AS start, x.length AS length))", ""), ("transform(loss_spans, x -> struct(x.start AS start, x.length - 1 AS length))", "")):
        got = chat.read_back(shown.withColumn("loss_spans", F.expr(change))).head()
        assert got["n_turns"] == 2 and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# --------------------------------------------------------------------------- mixing


def water_fill(sizes):
    """(source, size) in code-point order, null last -> targets, by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * left / total > 3 * sizes[s] + 1e-9]
        if not full:
            return target | {s: weight[s] * left / total for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in full)
    return target


def mix(docs, rows):
    df = docs(rows, {"size": F.lit("z"), "position": F.lit("p"), "cell": F.lit(0)})
    return mixing.curriculum(df).collect()


@pytest.mark.parametrize("case", [0, 1, 2])
def test_mixing(docs, case):
    import random

    r = random.Random(case)
    share = [[400, 5, 5, 50, 0, 3], [10, 900, 10, 10, 10, 10], [100] * 6][case]
    names = ["b", "a", "É", None, "z", ""]
    rows, i = [], 0
    for s, n in zip(names, share):
        for _ in range(n):
            rows.append((i, " ".join("w" for _ in range(r.randint(0, 40))), s))
            i += 1
    got = mix(docs, rows)
    sizes, taken, source = {}, {}, {i: s for i, _, s in rows}
    for x in got:
        s = source[x["doc_id"]]
        sizes[s] = sizes.get(s, 0) + x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
    want = water_fill(sizes)
    assert len(got) == len(rows)
    for x in got:
        s = source[x["doc_id"]]
        assert x["size"] == len(rows[x["doc_id"]][1].split()) and x["source_size"] == sizes[s]
        assert x["target"] == pytest.approx(want[s]) and 0 <= x["taken"] <= 3 * x["size"] and 0 <= x["position"] <= 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = sorted(tuple(x) for x in mix(docs, rows[::-1]))
    assert again == sorted(tuple(x) for x in got)


def test_mixing_edges(docs):
    assert mix(docs, []) == []
    got = {x["doc_id"]: (x["size"], x["taken"]) for x in mix(docs, [(1, None, "a"), (2, "", "a"), (3, " \t", None)])}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0)}
    df = docs([(i, "w " * (i % 5 + 1), f"s{i % 2}") for i in range(60)])
    out, plan = mixing.mix_documents(df), mixing.curriculum(df).collect()
    assert out.columns == df.columns and out.count() == sum(x["copies"] for x in plan)


def test_positions_follow_the_schedule(docs):
    rows = [(i, "w", f"s{i % 3}") for i in range(3000)]
    by = {}
    for x in mix(docs, rows):
        by.setdefault(x["doc_id"] % 3, []).append(x["position"])
    early, even, late = (sum(by[k]) / len(by[k]) for k in (0, 1, 2))
    assert early < 0.45 < even < 0.55 < late


def schedule(slope, t):
    return (1 - slope) * t + slope * t * t


@pytest.mark.parametrize("sizes", [(1000, 1000, 1000), (60, 1500, 1500), (2000, 500, 700), (400, 1000, 150)])
def test_taken_copies_follow_the_schedule_to_its_end(docs, sizes):
    """Targets below, at and above the source's size: at each time the words taken so far are the schedule's share of all taken."""
    rows, source = [], {}
    for s, n in enumerate(sizes):
        for _ in range(n):
            source[len(rows)] = s
            rows.append((len(rows), "w " * (1 + len(rows) % 3), f"s{s}"))
    size = {i: len(t.split()) for i, t, _ in rows}
    copies = {s: [] for s in range(3)}
    for x in mix(docs, rows):
        assert len(x["positions"]) == x["copies"] and x["positions"] == sorted(x["positions"])
        copies[source[x["doc_id"]]] += [(p, size[x["doc_id"]]) for p in x["positions"]]
    for s, slope in enumerate(mixing.SLOPES):
        total = sum(w for _, w in copies[s])
        for t in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0):
            assert sum(w for p, w in copies[s] if p <= t) / total == pytest.approx(schedule(slope, t), abs=2.5 / total + 1e-9), (s, t)


def test_mixed_rows_stand_at_their_copies_positions(docs):
    df = docs([(i, "w", f"s{i % 3}") for i in range(900)])
    got = [x["doc_id"] for x in mixing.mix_documents(df).collect()]
    last = [i % 3 for i in got[-len(got) // 4 :]]
    assert all(last.count(k) for k in range(3))
    want = sorted((p, x["doc_id"]) for x in mixing.curriculum(df).collect() for p in x["positions"])
    assert got == [i for _, i in want]
