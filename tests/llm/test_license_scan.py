from __future__ import annotations

import math
import random
import re

from cases import documents, lower, prose
from pyspark.sql import functions as F

from cueline.llm.license_scan import NOTICE_SHARE, NOTICES, PHRASES, STRIDE, blocks_of, candidates, license_scan, stride_of, template_index, template_words, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, notices=NOTICES):
    w = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for notice, label in notices:
        tokens, stride = set(template_words(notice)), stride_of(len(template_words(notice)))
        for i in range(0, len(w), stride):
            block = set(w[i : i + 2 * stride])
            shared = len(tokens & block)
            if shared >= math.ceil(round(NOTICE_SHARE * len(tokens), 6)):
                labels.add(label)
                score = max(score, shared / len(tokens))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def test_matches_brute_force(spark):
    rng = random.Random(2)
    planted = []
    for i in range(60):
        words = prose(rng, "en", rng.randrange(1, 200)).split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            if rng.random() < 0.5:
                words[at:at] = [rng.choice(["MIT License.", "the Apache\nLicense", "(CC-BY)", "GNU General Public License", "mit liKense", "Apache-Licenses"])]
            else:
                own = template_words(rng.choice(NOTICES)[0])
                words[at:at] = [w for w in own if rng.random() < 0.93]
        planted.append((2000 + i, " ".join(words)))
    df = documents(spark)
    extra = spark.createDataFrame(planted, "doc_id bigint, text string")
    df = df.unionByName(extra, allowMissingColumns=True)
    found = license_scan(df)
    assert found.columns == [*df.columns, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = found.collect()
    assert len(rows) == df.count() and sum(r["n_base"] > 0 for r in rows) > 10 and any(r["labels"] != r["base_labels"] for r in rows)
    for r in rows:
        got = tuple(r[c] for c in found.columns[-7:])
        want = brute(r["text"])
        assert got[:6] == want[:6] and abs(got[6] - want[6]) < 1e-9, (r["doc_id"], got, want)


def test_empty(spark):
    df = documents(spark)
    assert license_scan(df.limit(0)).count() == 0
    rows = license_scan(df.filter("text IS NULL")).collect()
    assert rows and all((r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0) for r in rows)


def test_templates_of_any_length(spark):
    """Long templates on both sides of a stride's bound are found wherever they stand; half of one is not."""
    rng = random.Random(4)
    assert [stride_of(n) for n in (0, 1, 64, 65, 128, 129, 1700)] == [STRIDE, STRIDE, STRIDE, 128, 128, 256, 2048]
    long_ = [(" ".join(f"w{k}x{i}" for i in range(n)), f"l{n}") for k, n in enumerate((64, 65, 128, 900, 5000))]
    rows = []
    for text, label in long_:
        words = text.split()
        for shift in (0, 63, 65, 129, 4000):
            rows.append((len(rows), " ".join([*prose(rng, "en", shift).split()[:shift], *words, "end"]), label))
        rows.append((len(rows), " ".join(words[: len(words) // 2]), ""))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, want string")
    for r in license_scan(df, notices=long_).collect():
        assert r["labels"] == r["want"] == brute(r["text"], long_)[5]


def test_positional_filter_prunes(spark):
    """Fewer pairs are compared with it, and none that reaches its share is lost."""
    rng = random.Random(3)
    vocabulary = sorted({w for text, _ in NOTICES for w in template_words(text)})
    texts = [" ".join(rng.choice(vocabulary) if rng.random() < 0.4 else "other" for _ in range(rng.randrange(20, 200))) for _ in range(80)] + [" ".join(template_words(t)) for t, _ in NOTICES]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    order, rows = template_index(df, "text", PHRASES, NOTICES, NOTICE_SHARE, STRIDE)
    blocks = blocks_of(df.select("id", words_of(F.col("text")).alias("words")), rows)
    pairs = {on: candidates(blocks, order, rows, on).select("id", "stride", "start", "template", (F.size("shared") >= F.col("least")).alias("found")).collect() for on in (True, False)}
    assert 0 < len(pairs[True]) < 0.9 * len(pairs[False])
    found = {on: {tuple(r[:4]) for r in pairs[on] if r["found"]} for on in pairs}
    assert found[True] == found[False] and len(found[True]) >= len(NOTICES)
