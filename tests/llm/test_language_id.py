from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cases import documents, prose
from cueline.llm.language_id import BUCKETS, LENGTHS, UNKNOWN, Model, calibrate, counted, fit, held_out, identify, keep_identified, predict, subwords


def labelled(spark, n=600):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randrange(3, 60)), lang) for i in range(n) for lang in [("en", "de", "fr")[i % 3]]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)


def test_held_out_accuracy(spark):
    df = labelled(spark)
    rows = identify(df).withColumn("held_out", held_out()).collect()
    assert len(rows) == 600
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.01


def test_labels_and_ids_are_no_inputs(spark):
    """Held-out rows get the same prediction whatever their label, source or id is, as nothing of them is learnt."""
    df = labelled(spark)
    spoilt = df.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang")))
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df).collect()}
    two = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(spoilt).collect()}
    assert one == two
    model = fit(df, learn=~held_out())
    moved = predict(df.withColumn("doc_id", F.col("doc_id") + 10_000).repartition(1), model).collect()
    assert {r["doc_id"] - 10_000: (r["lang_pred"], r["score"]) for r in moved} == one


def test_awkward_rows(spark):
    df = documents(spark)
    found = identify(df)
    assert found.columns == [*df.columns, "lang_pred", "score", "rejected"]
    rows = found.collect()
    assert len(rows) == df.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == UNKNOWN) == (not lettered)
        if not lettered:
            assert r["score"] == 0 and r["rejected"]
    assert keep_identified(df).columns == df.columns
    assert identify(df.limit(0)).count() == 0
    nobody = identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nobody} == {UNKNOWN}


def test_subwords_stay_inside_words_and_texts():
    texts = ["Ab, c", "d", "", "é1x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    together = [[] for _ in texts]
    for rows, owner in subwords(data, offsets):
        assert ((rows >= 0) & (rows < BUCKETS)).all()
        for r, o in zip(rows, owner, strict=True):
            together[o].append(int(r))
    for t, own in zip(texts, together, strict=True):
        b = np.frombuffer(t.encode(), np.uint8)
        found, n = counted(b, np.array([0, len(b)]))
        assert sorted(set(own)) == found.tolist() and n.tolist() == [own.count(x) for x in found.tolist()]
    # "ab c": letters 3, bigrams "ab" "b " " c" (not the two blanks), trigrams "ab " (not across words)
    assert len(together[0]) == 3 + 3 + 1 and LENGTHS == (1, 2, 3, 4)


def test_calibration():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3))
    logits[np.arange(4000), labels] += 2
    scale, least = calibrate(logits * 5, labels, 0.001)
    assert 0.1 < scale < 0.7 and 0 < least <= 0.5
    assert calibrate(np.zeros((0, 3)), np.zeros(0, int), 0.1) == (1.0, 0.0)


def test_other_languages_go_and_mixed_texts_stay(spark):
    """The held-back texts alone set the score; no constant keeps it near a guess."""
    df = labelled(spark)
    model = fit(df, learn=~held_out())
    own = {lang: [r["text"] for r in df.filter(held_out() & (F.col("lang") == lang)).orderBy("doc_id").collect()] for lang in ("en", "de", "fr")}
    mixed = [f"{x} {y}" for a, b in (("en", "de"), ("de", "fr"), ("fr", "en")) for x, y in zip(own[a], own[b], strict=False)]
    other = ["το κορίτσι κάθεται στο παράθυρο και κοιτάζει το δρόμο"]
    rows = spark.createDataFrame(list(enumerate([*mixed, *other])), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["score"], r["rejected"]) for r in predict(rows, model).collect()}
    assert len(mixed) > 90 and not any(found[i][1] for i in range(len(mixed)))
    score, gone = found[len(mixed)]
    assert gone and score > 1 / 3 + 0.05


def plain_scores(model, text):
    """The model's probabilities for one text, subword by subword."""
    out = "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text).encode().lower()
    total, n = np.zeros(model.table.shape[1]), 0
    for size in LENGTHS:
        for i in range(len(out) - size + 1):
            gram = out[i : i + size]
            if b" " in gram[1:-1] or size < 3 and gram.strip() == b"":
                continue
            code = 0
            for c in gram:
                code = (code * 0x01000193 + c + 1) % (1 << 32)
            code = ((code ^ (code >> 15)) * 0x2C1B3C6D + size * 0x9E3779B1) % (1 << 32)
            total += model.table[(code >> 16) % BUCKETS]
            n += 1
    mean = total / max(n, 1)
    logits = (mean if model.weight is None else mean @ model.weight) + model.bias
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_matches_a_plain_evaluation(spark):
    df = documents(spark)
    model = fit(df)
    for r in predict(df, model).collect():
        if any(c.isalpha() for c in r["text"] or ""):
            p = plain_scores(model, r["text"])
            assert r["lang_pred"] == model.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-5
            assert r["rejected"] == (r["score"] < model.least)


def test_both_forms_of_a_model_agree(spark):
    rng = np.random.default_rng(1)
    embed, weight, bias = rng.normal(0, 1, (BUCKETS, 8)), rng.normal(0, 1, (8, 5)), rng.normal(0, 1, 5)
    few = Model.of(list("abcde"), embed, weight, bias, 1.0, 0.0)
    many = Model(few.languages, embed.astype(np.float32), weight.astype(np.float32), few.bias, 0.0)
    assert few.weight is None and few.table.shape == (BUCKETS, 5)
    df = documents(spark).select("text")
    one, two = ([(r["lang_pred"], round(r["score"], 3)) for r in predict(df, m).collect()] for m in (few, many))
    assert one == two


def test_any_number_of_languages(spark):
    """More labels than a table of class scores would be kept for; each is learnt."""
    rng = random.Random(8)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(450)]
    rows = [(i, " ".join([own[i % 450]] * 12), f"l{i % 450:03d}") for i in range(450 * 6)]
    model = fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 450 and model.weight is not None and model.table.shape[1] < 450


def test_all_subwords_of_a_text_are_learnt():
    """No text is cut and no count is clipped."""
    text = ("a" * 50 + " ") * 4000 + ("b" * 50 + " ") * 10
    data = np.frombuffer(text.encode(), np.uint8)
    rows, n = counted(data, np.array([0, len(data)]))
    assert n.sum(dtype=int) == sum(len(r) for r, _ in subwords(data, np.array([0, len(data)]))) and n.max() > 65_535
    short = np.frombuffer(b"aaa", np.uint8)
    assert counted(short, np.array([0, 3]))[1].dtype == np.uint16


def test_columns_and_dirty_labels(spark):
    """Columns of any name stay; a label for each of 100,000 rows leaves a sample of the stated size, and rows of one id count once."""
    df = labelled(spark).withColumns({c: F.lit("x") for c in ("Readable", "readable_", "_readable_")})
    assert set(df.columns) <= set(identify(df).columns)
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("label"), F.col("id").cast("string")).alias("lang"))
    model = fit(rows, sample_all=300)
    assert 200 < len(model.languages) < 400
    same = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert fit(same, sample=5000, sample_all=5000).languages == ["en"]
