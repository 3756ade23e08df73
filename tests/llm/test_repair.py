"""Conversation repair against exhaustive search, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from steppe.llm import repair

TURNS = "conv_id long, turn long, role string, text string, dropped boolean"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else None if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edits, with up to two inserts in each gap."""
    faults, best = faults_of(rows), None
    inserts = [[("I", 2, r + ":") for r in rs] for n in range(3) for rs in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        late = fault == "truncated"
        stay = [] if fault in ("blank", "duplicate") else [("K", late, f"{role}:{text}")] + [("R", 2 + late, f"{r}:{text}") for r in ("user", "assistant")]
        choices.append([[("D", 3, None)], *[[c] for c in stay]])
    slots = [inserts]
    for c in choices:
        slots += [c, inserts]
    for picked in itertools.product(*slots):
        edits = [e for part in picked for e in part]
        kept = [e[2] for e in edits if e[2] is not None]
        if GRAMMAR.fullmatch("".join(k[:1] for k in kept)):
            found = (sum(e[1] for e in edits), "".join(e[0] for e in edits), "\n".join(kept))
            best = min(best, found) if best else found
    return best


def summaries(spark, rows):
    frame = spark.createDataFrame(rows, TURNS)
    return {r["conv_id"]: r for r in repair.summarize(repair.repair(frame)).collect()}


def test_equal_to_exhaustive_search(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c!", " ", "d?\n", "e."])) for _ in range(rng.randint(0, 3))]
        rows += [(conv, t, role, text, False) for t, (role, text) in enumerate(turns)] + [(conv, None, "user", "gone", True)]
        want[conv] = cheapest(turns)
    got = summaries(spark, rows)
    assert set(got) == set(want)
    for conv, (cost, audit, repaired) in want.items():
        assert (got[conv]["cost"], got[conv]["audit"]) == (cost, audit), rows
        assert got[conv]["repaired_sha256"] == hashlib.sha256(repaired.encode()).hexdigest()


def test_settled_turns_change_nothing():
    """Long conversations, also ones whose states never share an edit, against one undivided path."""
    rng = random.Random(7)
    for roles in (["user", "assistant"], ["user", "assistant", "system", ""], ["tool"], ["system"], ["user"]):
        rows = [(rng.choice(roles), rng.choice(["x.", "y", " "]) if rng.random() < 0.3 else f"{i}.") for i in range(700)]
        faults = faults_of(rows)
        plain, now, out, most = repair.Viterbi(), repair.Conversation(1), [], 0
        for turn, ((role, text), fault) in enumerate(zip(rows, faults, strict=True)):
            plain.turn(role[:1], fault)
            out += now.add(turn, role, text, fault)
            most = max(most, len(now.open))
        out += now.end()
        assert "".join(r[2] for r in out) == plain.best()
        assert GRAMMAR.fullmatch("".join(r[6][:1] for r in out if r[6] is not None))
        if roles[:2] == ["user", "assistant"]:
            assert most < 120


def test_odd_rows_have_defined_results(spark):
    rows = [
        (1, None, "user", "no turn.", None), (1, 5, "assistant", "five.", False), (1, 5, "assistant", "five.", False), (1, 9, None, None, False),
        (None, 0, "user", "no id.", False), (None, 1, "assistant", "fine.", False), (2, 0, "user", "all gone.", True), (3, None, "", "x.", False),
        (4, 0, "user", "\x00é\U0001f600" * 50_000, False),
    ]
    got = summaries(spark, rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1]["audit"], got[1]["cost"], got[1]["gaps"], got[1]["blank"], got[1]["duplicate"], got[1]["illegal"]) == ("KKDD", 6, 3, 1, 1, 2)
    assert got[None]["audit"] == "KK" and got[None]["cost"] == 0
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[3]["audit"] == "D" and got[3]["gaps"] == 0
    assert got[4]["audit"] == "D" and got[4]["truncated"] == 1
    frame = spark.createDataFrame(rows, TURNS)
    edits = repair.repair(frame.drop("dropped").withColumns({c: F.lit("x") for c in ("copy", "fault", "seq", "edit")}))
    kept = [(r["role"], r["text"]) for r in edits.filter("conv_id = 1 AND role IS NOT NULL").orderBy("seq").collect()]
    assert kept == [("user", "no turn."), ("assistant", "five.")]
    assert repair.summarize(repair.repair(frame.limit(0))).collect() == []


def test_damage_keeps_every_conversation(spark):
    rows = [(c, t, "user", None if t == 3 else f"turn {t}. And?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.damage(frame)
    assert {r["conv_id"] for r in got.select("conv_id").collect()} == {*range(40), None}
    assert 0 < got.filter("dropped").count() < 20
    assert repair.summarize(repair.repair(got)).count() == 41
