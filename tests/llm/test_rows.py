"""Rows that share an id or have none, texts in no learned language, and the bounds of training samples."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatelake.llm import common, language_id, mixing, packing, quality_classifier
from test_llm import ENGLISH, check_packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the house and garden were quiet when morning came over every green hill with sunlight",
         "de": "das haus und der garten waren still als morgens licht über jeden hügel kam dann schlief",
         "fr": "la maison et le jardin étaient calmes quand le matin venait sur chaque colline verte avec lumière",
         "es": "la casa y el jardín estaban tranquilos cuando la mañana llegaba sobre cada colina verde con luz"}


def labelled(n=60, seed=1):
    rng = random.Random(seed)
    return [(k * 1000 + i, " ".join(rng.choices(t.split(), k=40)), lang, "s", 1) for k, (lang, t) in enumerate(WORDS.items()) for i in range(n)]


def test_text_of_no_learned_language_goes(spark):
    rng = random.Random(5)
    strange = [(9001, "今日はとても天気がいいので散歩に行きましょう と言いました", None, "s", 1), (9002, "сегодня хорошая погода и мы пойдём гулять в парк", "ru", "s", 1),
               (9003, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40)), "en", "s", 1), (9004, "!!! 123", "en", "s", 1), (9005, None, "en", "s", 1)]
    mixed = [(9100, " ".join(t for t in WORDS.values()), None, "s", 1), (9101, WORDS["en"] + " " + WORDS["fr"], None, "s", 1)]
    good = labelled()
    kept = language_id.keep_identified(spark.createDataFrame(good + strange + mixed, DOCS)).collect()
    assert Counter(map(tuple, kept)) == Counter(good + mixed)


@pytest.mark.parametrize("shared", [1, 2, 3, 4, 5, 7])
def test_language_sample_with_a_shared_id(spark, monkeypatch, shared):
    monkeypatch.setattr(language_id, "DOCS_PER_LANGUAGE", 20)
    rows = [(shared, f"{ENGLISH[i % 4]} number {i}", "en", "s", 1) for i in range(600)] + [(100 + i, WORDS["de"], "de", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    sample = language_id.training_sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert Counter(lang for lang, _ in sample) == {"en": 20, "de": 20}


def test_language_sample_takes_equal_rows_once_and_labels_as_they_are(spark, monkeypatch):
    rows = [(1, ENGLISH[0], "en", "s", 1)] * 400 + [(1, ENGLISH[0], "de", "s", 1)] * 3 + [(2, "x" * (language_id.SAMPLE_CHARS + 1), "de", "s", 1)]
    sample = language_id.training_sample(spark.createDataFrame(rows, DOCS), F.lit(True), "doc_id", "text", "lang")
    assert Counter(lang for lang, _ in sample) == {"en": 1, "de": 1} and sample[0][1] == ENGLISH[0].split()
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    assert [lang for lang, _ in language_id.training_sample(spark.createDataFrame(rows, DOCS), F.lit(True), "doc_id", "text", "lang")] == ["en"]


def test_quality_sample_with_shared_ids_and_labels(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE_PER_LABEL", 10)
    ids = [i for i in range(1, 200) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(ids[0], f"text {i}", "en", "s", 1) for i in range(300)] + [(i, f"one {i}", "en", "s", 1) for i in ids], DOCS)
    labels = spark.createDataFrame([(ids[0], 0), (ids[0], 1), (None, 1)] + [(i, i % 2) for i in ids[1:]], "doc_id long, quality int")
    sample = quality_classifier.training_sample(docs, labels, 4, 2, "doc_id", "text", "quality")
    assert Counter(y for _, y in sample) == {0: 10, 1: 10} and len({t for t, _ in sample}) == 20


def test_quality_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 1), (1, "", "en", "s", 1), (None, " ", "en", "s", 1), (3, "some words", "en", "s", 1)], DOCS)
    rows = quality_classifier.quality(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).collect()
    bare = {r.score for r in rows if r.doc_id != 3}
    assert len(rows) == 4 and len(bare) == 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_a_source_without_ids_is_drawn_like_others(spark):
    """Rows are placed by id and text, and equal rows are counted: no source is lost to a shared key."""
    rows = [(None, f"w{i} " * 10, "en", "big", 1) for i in range(500)] + [(i, "a b c", "en", "small", 1) for i in range(30)]
    rows += [(7, "same words here", "en", "copies", 1)] * 200
    got = mixing.mixed(spark.createDataFrame(rows, DOCS).repartition(5), target_entropy=None, max_repeats=None, budget=2800).select("whole.source", "n_tokens", "draws", "weight").collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    for source, n in Counter(r[3] for r in rows).items():
        size = sum(len(r[1].split()) for r in rows if r[3] == source)
        drawn = [r for r in got if r.source == source]
        spent, each = sum(r.n_tokens * r.draws for r in drawn), drawn[0].n_tokens
        quota = int(round(drawn[0].weight, 9) * 2800)
        assert len(drawn) == n and quota - each < spent <= quota and max(r.draws for r in drawn) - min(r.draws for r in drawn) <= 1
        assert total > 0 and size > 0


def test_pieces_without_ids_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(None, f"text number {i}", "en", "s", 1) for i in range(400)]
        packed = packing.pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_packing(packed, Counter((None, r[1]) for r in rows), 1024)
    tasks = {r.sequence_id >> 33 for r in packed if r.sequence_id < 1 << 60}
    assert common.tasks(spark) == 4 and len(tasks) <= 4


def test_attention_by_plain_loops():
    """Scores of whole texts against a forward pass written out word by word, passage by passage."""
    import numpy as np
    rng = random.Random(2)
    texts = [None, "", " ".join(rng.choices("alpha Beta GAMMA, x1 !! 12 word word".split(), k=200)), "one", " ".join(rng.choices("a bb CC".split(), k=64))]
    model = quality_classifier.train([t or "" for t in texts], [0, 1, 1, 0, 1])
    got = model.run(quality_classifier.passages_of(texts, quality_classifier.Encoder()))["score"]
    p = model.parts
    for text, score in zip(texts, got, strict=True):
        words = (text or "").split()
        hidden, raw = [], []
        for at in range(0, max(1, len(words)), quality_classifier.PASSAGE):
            rows = [quality_classifier.word_row(w) for w in words[at:at + quality_classifier.PASSAGE]]
            n, sums = max(1, len(rows)), [sum(r[k] for r in rows) for k in range(1, 8)]
            chars = max(1, sums[0])
            buckets = [r[0] for r in rows]
            mean = sum((p["words"][b] for b in buckets), np.zeros(quality_classifier.EMBED)) / n
            shares = [sums[1] / chars, sums[2] / chars, sums[3] / chars, sums[4] / n, sums[5] / n, sums[6] / n, (len(rows) - len(set(buckets))) / n,
                      sum(a == b for a, b in zip(buckets, buckets[1:], strict=False)) / n, min(sums[0] / n / 10, 3), min(len(rows) / quality_classifier.PASSAGE, 1)]
            h = np.tanh(np.concatenate([mean, shares]) @ p["mix"] + p["bias"])
            hidden.append(h)
            raw.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        weights = np.exp(np.array(raw) - max(raw))
        z = (weights / weights.sum()) @ np.array(hidden)
        assert abs(score - 1 / (1 + np.exp(-(z @ p["o"] + p["b"])))) < 1e-9
