import random
import re

from rentlens.llm import chat

SHAPE = "conv_id long, turn long, role string, text string, n long, chat string, a int"


def expected(rows):
    said = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((chat.LAST if turn is None else turn, role or "unknown", text or ""))
    said = {c: tuple(sorted(v)) for c, v in said.items()}
    prefixes = set()
    for v in said.values():
        for turn in {t for t, _, _ in v}:
            part = tuple(x for x in v if x[0] <= turn)
            if len(part) < len(v):
                prefixes.add(part)
    best = {}
    for c in sorted(said, key=lambda c: (c is None, c)):
        if said[c] not in prefixes:
            best.setdefault(said[c], c)
    safe = lambda s: s.replace("<|", "< |")
    return {c: (len(v), "".join(f"<|{safe(r)}|>\n{safe(t)}\n<|end|>\n" for _, r, t in v)) for v, c in best.items()}


def render(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SHAPE).repartition(5)
    return {r.conv_id: (r.n_turns, r.chat) for r in chat.render(frame).collect()}


def test_equals_brute_force(spark):
    draw = random.Random(2)
    rows = []
    for conv in range(150):
        rows += [(conv, t, draw.choice("ua"), draw.choice(["hi", "", None, "<|user|>", "yes"])) for t in range(draw.randint(1, 4))]
    base = [(t, "user" if t % 2 == 0 else "assistant", f"line {t}") for t in range(300)]
    rows += [(1000 + n, *line) for n in (1, 5, 64, 65, 128, 299, 300, 300) for line in base[:n]] + [(2000, *line) for line in base]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (3000, 1, "user", "x"), (3000, 1, "user", "x"), (3001, 1, "user", "x"), (3002, None, "user", "x")]
    assert render(spark, rows) == expected(rows)


def test_long_texts_and_empty_table(spark):
    rows = [(1, 0, "user", "y" * 1_000_000), (2, 0, "user", "y" * 1_000_000), (2, 1, "assistant", "z")]
    assert render(spark, rows) == expected(rows)
    assert chat.render(spark.createDataFrame([], SHAPE)).count() == 0


def test_column_functions_only(spark):
    plan = chat.render(spark.createDataFrame([(1, 0, "user", "x", 1, "c", 1)], SHAPE))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)
