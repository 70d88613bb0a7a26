from __future__ import annotations

import random
import re

import pytest

from cases import documents, prose
from cueline.llm import line_dedup
from cueline.llm.line_dedup import UNITS, drop_lines, line_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near(a, b):
    if min(len(a), len(b)) < UNITS:
        a, b = " ".join(a), " ".join(b)
    if a == b or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < UNITS:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """Numbers of the lines of each id that go, by comparing all pairs of different lines."""
    lines = sorted({(-1 if d is None else d, k, tuple(WORD.findall(x))) for d, t in rows for k, x in enumerate((t or "").split("\n"))})
    lines = [x for x in lines if x[2]]
    first = {}
    for d, k, w in lines:
        first.setdefault(w, (d, k))
    order = sorted(first, key=first.get)
    gone = {w for i, w in enumerate(order) if any(near(w, v) for v in order[:i])}
    out = {-1 if d is None else d: [0, 0, 0, []] for d, _ in rows}
    for d, k, w in lines:
        own = out[d]
        repeated = first[w] < (d, k)
        own[0] += 1
        own[1] += repeated
        own[2] += not repeated and w in gone
        own[3] += [k] * (repeated or w in gone)
    return out


def inputs(spark):
    rng = random.Random(8)
    base = [" ".join(prose(rng, "en", rng.randrange(6, 14)).split()) for _ in range(60)]
    made = []
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["new"], ["é"]])
            lines.append("  ".join(words) if rng.random() < 0.1 else " ".join(words))
        made.append((5000 + i, "\n".join([*lines, "" if i % 3 else "short line"])))
    short = ["Privacy policy", "read more é", "Read more é", "1234567", "12345678", "123456789", "x 1 2 3 4", "one two three four five six seven", "one two three four five six seven e", "ab cd ef gh ij kl mn op", "ab cd ef gh ij klmn op", "ab cd ef gh ij kl mn op q"]
    for i in range(120):
        own = []
        for _ in range(3):
            x = rng.choice(short)
            at = rng.randrange(len(x))
            own.append(rng.choice([x, x[:at] + x[at + 1 :], x[:at] + rng.choice("é z世") + x[at:], x[:at] + "y" + x[at + 1 :], x.replace(" ", "  ")]))
        made.append((5500 + i, "\n".join(own)))
    made += [(6000, "a a a a a a a a b\na a a a a a a b\na a a a a a a a a b"), (6001, "\r\n x \n\n")]
    df = documents(spark).filter("length(text) < 5000 OR text IS NULL")
    return df.unionByName(spark.createDataFrame(made, "doc_id bigint, text string"), allowMissingColumns=True).repartition(4)


@pytest.mark.parametrize("most", [1 << 27, 64])
def test_matches_brute_force(spark, monkeypatch, most):
    """Also if the filter is full and admits all lines."""
    monkeypatch.setattr(line_dedup, "FILTER_MOST", most)
    df = inputs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute([r for r in rows if r[0] is not None])
    found = {r["doc_id"]: [r["n_lines"], r["n_repeated"], r["n_near"], list(r["dropped"])] for r in line_counts(df.filter("doc_id IS NOT NULL")).collect()}
    assert sum(w[2] for w in want.values()) > 30
    assert found == want


def test_lines_go(spark):
    df = inputs(spark).filter("doc_id IS NOT NULL")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    cleaned = drop_lines(df)
    assert cleaned.columns == df.columns
    before = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in cleaned.collect():
        t = before[r["doc_id"]]
        gone = set(want[r["doc_id"]][3])
        assert r["text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))


def test_empty(spark):
    df = documents(spark)
    assert line_counts(df.limit(0)).count() == 0
    rows = line_counts(df.filter("text IS NULL")).collect()
    assert rows and all((r["n_lines"], list(r["dropped"])) == (0, []) for r in rows)


def test_rows_of_one_id_and_different_texts(spark):
    """Each keeps its own lines: what is a copy in one row is not taken from the other's line of that number."""
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\nfirst row only"), (1, f"second row only\n{line} ten"), (2, f"{line}\n{line} ten"), (None, "of no id\nfirst row only"), (None, None), (None, "another of no id")]
    df = spark.createDataFrame([*rows, rows[1]], "doc_id bigint, text string")
    cleaned = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in drop_lines(df).collect()), key=str)
    want = [(1, line), (1, "second row only"), (1, "second row only"), (2, ""), (None, "of no id\nfirst row only"), (None, None), (None, "another of no id")]
    assert cleaned == sorted(((d is None, d, t) for d, t in want), key=str)
    assert line_counts(df).count() == 6
