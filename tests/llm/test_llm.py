"""The corpus operators against brute force, exact round trips and held-out accuracy."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from gatelake.llm import (ORACLES, QUERIES, common, components, exact_dedup, language_id, mixing, packing, pii, quality_classifier, quality_rules,
                          simhash, token_counts, token_files, tokens)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b", "x" * 5000, "é" * 700 + " \U0001F600", "one two three four five " * 40, "a\x00b <|endoftext|> <s> ▁ ▁▁  b\t\x0b"]


def rows_of(texts, **more):
    """Documents with the given texts, some fields null, some rows twice, and columns named like the results."""
    out = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", 1) for i, t in enumerate(texts)]
    return out + out[:2] + [(None, "null id", None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(rows_of(ODD), DOCS)
    for name in ("kept", "n_words", "row", "whole", "key", "draws", "text_sha256", "fp", "spans", "score", "n_tokens", "source_2"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- quality rules ------------------------------------------------------------------------------

def brute_measures(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    return (len(found), sum(map(len, found)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))


def measured(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_quality_rules(docs, texts, odd, empty):
    got = by_id(QUERIES["op1_quality_rules"](docs.sparkSession, SF))
    assert {i: measured(r) for i, r in got.items()} == {i: brute_measures(t) for i, t in texts.items()}
    for i, r in got.items():
        n, _, _, _, repeated = brute_measures(texts[i])
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)
    ledger = quality_rules.ledger(odd)
    want = Counter((i, brute_measures(t)) for i, t, *_ in rows_of(ODD))
    assert Counter((r.doc_id, measured(r)) for r in ledger.collect()) == want
    assert quality_rules.verdicts(quality_rules.ledger(empty)).count() == 0


def test_ablations(docs):
    ledger = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in ledger.collect()]
    for r in quality_rules.ablations(ledger).collect():
        policy = next(p for p in quality_rules.POLICIES if p.name == r.policy)
        bit = quality_rules.BITS[r.rule]
        assert (r.failed, r.dropped, r.only, r.dropped_without) == (
            sum(bool(b & bit) for b in bits), sum(bool(b & policy.mask) for b in bits), sum(b & policy.mask == bit for b in bits),
            sum(bool(b & policy.mask & ~bit) for b in bits))


def test_repeated_words_need_equal_words(spark):
    """Overlapping windows, and windows repeated next to each other, cover each word once."""
    texts = ["a a a a a a a", "a b c d e f a b c d e", "a b c d e a b c d e f", "a b c d e", "1 2 3 4 5 6 1 2 3 4 5 6 2 3 4 5 6"]
    got = by_id(quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].n_repeat_words for i in range(5)] == [brute_measures(t)[4] for t in texts] == [7, 10, 10, 0, 17]


# --- mixing -------------------------------------------------------------------------------------

def brute_draws(rows, exponent, seed=1):
    """How often each row is drawn: whole passes, then rows in order of their key until one no longer fits."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    total = sum(sizes.values())
    raised = {s: (n / total) ** exponent for s, n in sizes.items() if n}
    out = {}
    for source in sizes:
        mine = sorted((hashlib.md5(f"{seed}:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(),
                       len(WORD.findall(t or "")), i) for i, t, s in rows if s == source)
        if not sizes[source]:
            out |= {i: 1 for _, _, i in mine}
            continue
        passes, left = divmod(int(round(raised[source] / sum(raised.values()), 9) * total), sizes[source])
        for _, n, i in mine:
            left -= n
            out[i] = passes + (left >= 0)
    return out


def test_mixing(spark, docs, empty, odd):
    skewed = docs.withColumn("source", F.expr("case when doc_id % 10 < 7 then 'hot' when doc_id % 10 < 9 then null else 'small' end"))
    rows = [(r.doc_id, r.text, r.source) for r in skewed.collect()]
    # Equal weights ask for three passes and more of the small source.
    for limits, exponent in (({"target_entropy": 1.0, "max_repeats": None}, 0.0), ({"target_entropy": None, "max_repeats": 1.0}, 1.0)):
        got = by_id(mixing.draws(skewed, **limits))
        assert {i: r.draws for i, r in got.items()} == brute_draws(rows, exponent)
    shares = mixing.shares_of(skewed.select(F.coalesce("source", F.lit("?")).alias("source"), mixing.token_count(F.col("text")).alias("n_tokens")))
    total = shares.agg(F.sum("tokens")).first()[0]
    exponent = mixing.exponent_for(shares, total, 0.9, None)
    weights = mixing.weights_at(shares, F.lit(exponent)).agg(F.sum(-F.col("weight") * F.log("weight")), F.sum("weight")).first()
    assert abs(weights[0] - 0.9 * np.log(3)) < 1e-6 and abs(weights[1] - 1) < 1e-9
    exponent = mixing.exponent_for(shares, total, None, 1.5)
    assert abs(mixing.weights_at(shares, F.lit(exponent)).agg(F.max(F.col("weight") * total / F.col("tokens"))).first()[0] - 1.5) < 1e-5
    got = by_id(mixing.draws(skewed, target_entropy=None, max_repeats=1.5))
    assert {i: r.draws for i, r in got.items()} == brute_draws(rows, exponent)
    assert max(r.draws for r in got.values()) == 2
    mixed = mixing.mix(skewed, target_entropy=None, max_repeats=1.5)
    assert mixed.columns == skewed.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: r.draws for i, r in got.items() if r.draws})
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).columns == odd.columns
    assert mixing.draws(odd).count() == odd.count()


# --- token counts -------------------------------------------------------------------------------

def test_token_counts(docs, texts, odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    got = by_id(QUERIES["op3_token_counts"](docs.sparkSession, SF))
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {
        i: (len(t.encode()), (n := len(sp.encode(t))), n > 4096) for i, t in texts.items()}
    rows = [(r.doc_id, r.n_tokens) for r in token_counts.token_counts(odd).collect()]
    assert Counter(rows) == Counter((i, len(sp.encode(t or ""))) for i, t, *_ in rows_of(ODD))
    assert token_counts.token_counts(empty).count() == 0


def test_pre_tokens_merge_alone():
    sp, counts, rng = token_counts.model(), token_counts.Counts(token_counts.whole_tokens()), random.Random(3)
    signs = ["a", "b", " ", "  ", "▁", "é", "\n", "<s>", "</s>", "the", "日", "\U0001F600", "\0", " the", " of", "ﬁ"]
    made = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(5000)]
    assert counts.tokens(made) == [len(x) for x in sp.encode(made)]


# --- exact dedup --------------------------------------------------------------------------------

def check_groups(rows, got):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(-1 if i is None else i)
    want = Counter()
    for t, ids in groups.items():
        digest, keep = hashlib.sha256(t.encode()).hexdigest(), max(ids)
        for place, i in enumerate(sorted(ids, reverse=True)):
            want[(i, keep, len(ids), place == 0, digest)] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept, r.text_sha256)
                   for r in got) == want


@pytest.mark.parametrize("bits", [exact_dedup.FILTER_BITS, 64])  # a filter that is far too small shuffles all rows
def test_exact_dedup(spark, docs, texts, odd, empty, bits):
    check_groups(texts.items(), exact_dedup.exact_groups(docs, filter_bits=bits).collect())
    check_groups([(r[0], r[1]) for r in rows_of(ODD)], exact_dedup.exact_groups(odd, filter_bits=bits).collect())
    kept = exact_dedup.drop_copies(odd, filter_bits=bits)
    assert kept.columns == odd.columns
    largest = {}
    for i, t, *_ in rows_of(ODD):
        largest[t or ""] = max(largest.get(t or "", -1), -1 if i is None else i)
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == sorted(largest.values())
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.drop_copies(empty).count() == 0


# --- SimHash ------------------------------------------------------------------------------------

def brute_print(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """Smallest id reachable over links of at most radius bits, for (id, fingerprint) rows."""
    values = sorted(set(p for _, p in prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ np.uint64(v)) <= radius):
            parent[root(values[i + 1 + j])] = root(v)
    low = {}
    for i, p in prints:
        low[root(p)] = min(low.get(root(p), 1 << 60), 1 << 60 if i is None else i)
    return Counter((i, f"{p:016x}", None if low[root(p)] == 1 << 60 else low[root(p)]) for i, p in prints)


def test_simhash(spark, docs, texts, odd, empty):
    prints = [(i, brute_print(t)) for i, t in texts.items()]
    got = Counter(tuple(r) for r in QUERIES["op6_simhash"](spark, SF).collect())
    assert got == brute_components(prints)
    got = Counter(tuple(r) for r in simhash.near_groups(odd).collect())
    assert got == brute_components([(i, brute_print(t)) for i, t, *_ in rows_of(ODD)])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for (_, _, c) in brute_components(prints)})
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(odd).columns == odd.columns


def planted_prints(n=3000, seed=5):
    """Chains, dense groups within few bits, and fingerprints that share single blocks."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        v = rng.choice(out[-50:])
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            v ^= 1 << b
        out.append(v)
    return out


@pytest.mark.parametrize("limit", [4096, 40, 4])  # below it shards are cut by further blocks, then into slices
def test_bk_shards_lose_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", limit)
    prints = planted_prints(1500 if limit == 4 else 3000)
    signed = np.array(sorted(set(prints)), np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.vertex: r.root for r in components.components(simhash.links(classes)).collect()}
    groups = defaultdict(set)
    for v in signed:
        groups[found.get(v, v)].add(v)
    brute = defaultdict(set)
    for (i, p, c) in brute_components([(k, v) for k, v in enumerate(sorted(set(prints)))]):
        brute[c].add(int(np.array([int(p, 16)], np.uint64).view(np.int64)[0]))
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in brute.values()}


def test_bk_tree():
    values, tree = planted_prints(400), simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]


# --- personal data ------------------------------------------------------------------------------

PRIVATE = ["a@b.c%foo@bar.com x@y 1.2.3.4.5.6.7.8 300.1.2.3 é 4111 1111 1111 1111 +49 (30) 1234567.", "mail: joe [at] example [dot] com 4111-1111-1111-1112 +1-2",
           "+1 555 555 5555 " * 700 + "+((((((" * 200, "1.1." * 5000 + "a@b." + "c." * 9000, "9" * 30000 + "%" * 30000, "call 555-123-4567 or (030) 1234 5678", "0.0.0.0 0255.1.1.1 @a.b"]


def luhn(digits):
    return sum(x - 9 * (x > 9) for i, c in enumerate(reversed(digits)) for x in [int(c) * (1 + i % 2)]) % 10 == 0


def brute_spans(text):
    only = lambda m: re.sub(r"\D", "", m)
    kinds = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
             "ip": (r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(x) <= 255 for x in m.split("."))),
             "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15)}
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_personal_data(spark, docs, texts, odd, empty):
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string")
    got = by_id(pii.private_digests(docs.select("doc_id", "text").unionByName(more)))
    for i, text in [*texts.items(), *((10_000 + i, t) for i, t in enumerate(PRIVATE) if i != 4)]:
        want, r = brute_spans(text), got[i]
        told = [":".join(map(str, s)) for s in want]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest(), i
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert set(told) <= set(spans)
        if i < 10_000:
            assert spans == told  # nothing is added to clean text
    assert f"email:{PRIVATE[1].index('joe')}:{PRIVATE[1].index(' 4111')}" in got[10_001].spans
    assert pii.private_digests(odd).count() == odd.count() and pii.private_digests(empty).count() == 0


def test_reliabilities_find_the_noisy_labeler():
    rng, counts = random.Random(1), Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        vote = lambda right: (1 if y else -1) * (1 if rng.random() < right else -1)
        counts[(0, (vote(0.95), vote(0.9), vote(0.9), vote(0.5), 0))] += 1
    truth = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert truth[0, (1, 1, 1, -1, 0)] > 0.95 and truth[0, (-1, -1, -1, 1, 0)] < 0.05


# --- packing ------------------------------------------------------------------------------------

def check_packing(rows, texts, capacity):
    """texts: Counter of (doc_id, text)."""
    by_sequence, cuts = defaultdict(list), Counter()
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        cuts[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    want = Counter()
    for (i, text), n in texts.items():
        ids = np.append(tokens.library_ids(text or ""), packing.END_ID).astype("<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids), capacity), len(ids)], strict=True)):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += n
    assert cuts == want
    return len(by_sequence), sum(r.length for r in rows) / capacity


def test_packing(spark, texts, odd, empty):
    used, least = check_packing(QUERIES["op8_packing"](spark, SF).collect(), Counter(texts.items()), 1024)
    assert used <= 1.03 * least + 1
    check_packing(packing.pack_documents(odd).collect(), Counter((i, t) for i, t, *_ in rows_of(ODD)), 1024)
    check_packing(packing.pack_documents(odd, capacity=7).collect(), Counter((i, t) for i, t, *_ in rows_of(ODD)), 7)
    assert packing.pack_documents(empty).count() == 0


def test_packing_hierarchy(spark, monkeypatch):
    """Many tasks, tiny buffers and lengths that never pair up: bounded bins go up, every item is placed once."""
    rng = random.Random(2)
    lengths = [rng.randrange(1, 1025) for _ in range(6000)] + [600] * 2000
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(items.repartition(20)).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    alone = sum(n > 512 for n in lengths)
    assert max(fills.values()) <= 1024 and len(fills) <= 1.05 * max(alone, sum(lengths) / 1024)


def test_packing_tree(spark, monkeypatch):
    """Underfull bins are items of the next level: what is named into a bin fits it, and only underfull bins rise."""
    monkeypatch.setattr(packing, "CHUNK", 50)
    rng = random.Random(8)
    fills = {k * 7: rng.randrange(1, 900) for k in range(400)}
    levels = packing.merged_bins(spark.createDataFrame(list(fills.items()), "bin long, fill long").repartition(8), 64)
    assert len(levels) >= 2
    for level in levels:
        rows = level.collect()
        assert {r.bin: f for r in rows for f in [fills[r.bin]]} == fills
        into = defaultdict(list)
        for r in rows:
            into[r.into].append((r.shift, fills[r.bin], r.fill, r.underfull))
        for placed in into.values():
            end = 0
            for shift, fill, _, _ in sorted(placed):
                assert shift == end
                end += fill
            assert {(f, u) for _, _, f, u in placed} == {(end, end < 1024 - packing.SLACK)} and end <= 1024
        fills = {r.into: r.fill for r in rows if r.underfull}


@pytest.mark.parametrize("few", [common.FEW_IDS, 0])
def test_dropping_ids(spark, monkeypatch, odd, few):
    """Few ids are broadcast, more are joined; null is an id like any other, repeated rows go together."""
    monkeypatch.setattr(common, "FEW_IDS", few)
    kept = common.without(odd, spark.createDataFrame([(1,), (None,), (1,)], "x long"), "doc_id")
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows_of(ODD) if r[0] not in (1, None))


# --- language -----------------------------------------------------------------------------------

def test_forward_backward_blocks():
    rng = np.random.default_rng(0)
    trans, first, lengths = np.exp(rng.normal(size=(3, 3))), np.exp(rng.normal(size=3)), np.array([1, 7, 3, 30, 2, 4, 8])
    emit = np.exp(rng.normal(size=(lengths.sum(), 3)))
    at = 0
    for block in (1000, 4, 1):
        at, got = 0, language_id.posteriors(emit, lengths, first, trans, block=block)
        for n in lengths:
            ahead, back = [first * emit[at]], [np.ones(3)]
            for t in range(1, n):
                ahead.append((ahead[-1] @ trans) * emit[at + t])
            for t in range(n - 1, 0, -1):
                back.append(trans @ (back[-1] * emit[at + t]))
            want = np.array(ahead) * np.array(back[::-1])
            assert np.allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True))
            at += n


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text)))
    held = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 150 and sum(held) / len(held) > 0.97
    got = by_id(language_id.identify(odd))
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[4].lang_pred == "en"
    assert language_id.identify(empty).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {0, 1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())


def test_words_of_switched_text():
    rng = random.Random(1)
    words = {"xx": ["tion", "ning", "ther", "ould"], "yy": ["zung", "keit", "lich", "schen"]}
    made = lambda lang, n: [rng.choice(words[lang]) + rng.choice("aeiou") for _ in range(n)]
    model = language_id.train([(lang, made(lang, 60)) for lang in words for _ in range(30)])
    text = made("xx", 30) + made("yy", 25) + made("xx", 20)
    labels = language_id.label_words(model, [text])[0].argmax(axis=1)
    assert (labels == [0] * 30 + [1] * 25 + [0] * 20).mean() > 0.95


# --- quality classifier -------------------------------------------------------------------------

def test_gradient_of_attention():
    model = quality_classifier.train([], [])
    bags = quality_classifier.passages_of(["a b " * 70, "", "HELLO!! WORLD " * 90, "x | y | z " * 40], quality_classifier.Encoder())
    truth, weight = np.array([1.0, 0, 0, 1]), np.ones(4) / 4

    def loss():
        p = model.run(bags)["score"]
        return -(weight * (truth * np.log(p) + (1 - truth) * np.log(1 - p))).sum()

    for name, slope in model.slopes(bags, truth, weight).items():
        at = (int(bags.buckets[3]), 2) if name == "words" else tuple(0 for _ in slope.shape)
        kept, seen = model.parts[name], []
        for step in (1e-5, -1e-5):
            model.parts[name] = kept.copy()
            model.parts[name][at] += step
            seen.append(loss())
        model.parts[name] = kept
        assert abs((seen[0] - seen[1]) / 2e-5 - slope[at]) < 1e-7, name


def test_quality_classifier(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.quality(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r.predicted == r.quality for r in rows if r.held_out and r.quality is not None]
    assert len(held) > 50 and sum(held) / len(held) > 0.93
    assert quality_classifier.quality(odd, labels).count() == odd.count()
    assert quality_classifier.quality(empty, labels.limit(0)).count() == 0


# --- token files --------------------------------------------------------------------------------

def test_codec_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2 ** 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.encode(ranks)
        assert len(control) == -(-n // 4) and (token_files.decode(control, data, n) == ranks).all()


def test_token_files(spark, texts, odd, empty, tmp_path):
    def check(rows, source):
        at, want = 0, Counter()
        for i, t in sorted(source, key=lambda x: (-1 if x[0] is None else x[0])):
            ids = np.append(tokens.library_ids(t or ""), token_files.END_ID).astype("<u4")
            want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
            at += len(ids)
        assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want

    check(QUERIES["op10_token_files"](spark, SF).collect(), texts.items())
    docs, path = spark.read.parquet(f"{SF}/documents.parquet"), f"{tmp_path}/files"
    check(token_files.token_index(docs, path, file_tokens=20_000).collect(), texts.items())
    files = spark.read.parquet(f"{path}/documents").select("part", "doc_id").groupBy("part").agg(F.min("doc_id"), F.max("doc_id")).orderBy("part").collect()
    assert len(files) > 5 and all(a[2] < b[1] for a, b in zip(files, files[1:]))
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in token_files.read_files(spark, path).collect()}
    assert all((ids[i] == np.append(tokens.library_ids(t), 0)).all() for i, t in texts.items())
    check([r for r in token_files.token_index(odd).collect()], [(r[0], r[1]) for r in sorted(rows_of(ODD), key=str)])
    assert token_files.token_index(empty).count() == 0


def test_fast_ids_are_the_library_s():
    """Both over every code point in several places, and over odd texts."""
    made = [f"a{c}b 1{c}2 {c}!{c}?\n{c}{c} x" for c in map(chr, range(0, 0x110000, 7)) if not "\ud800" <= c <= "\udfff"]
    for i in range(0, len(made), 50):
        text = "\n".join(made[i:i + 50])
        assert tokens.byte_bpe_ids(text).tolist() == tokens.library_ids(text).tolist()
    for text in [*filter(None, ODD), "x<|endoftext|> y <|endoftext|>\n\n", "a" * 100_000, " " * 100_000, "\n \n" * 3000]:
        assert tokens.byte_bpe_ids(text).tolist() == tokens.library_ids(text).tolist()


# --- queries and pipeline -----------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


def test_pipeline(spark, texts):
    """Every stage on what the one before it kept, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language id", "exact dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    kept, rows = {}, docs
    for name, stage in list(stages.items())[:-1]:
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == docs.columns
        kept[name] = [r.doc_id for r in rows.collect()]
    assert sorted(kept["language id"]) == sorted(i for i, t in texts.items() if any(map(str.isalpha, t)))
    last = {}
    for i in kept["language id"]:
        last[texts[i]] = max(i, last.get(texts[i], -1))
    assert sorted(kept["exact dedup"]) == sorted(last.values())
    near = brute_components([(i, brute_print(texts[i])) for i in last.values()])
    assert sorted(kept["simhash near-dedup"]) == sorted({c for _, _, c in near})
    assert set(kept["source mixing"]) <= set(kept["simhash near-dedup"])
    packed = stages["best-fit packing"](spark, rows, SF).collect()
    check_packing(packed, Counter((i, texts[i]) for i in kept["source mixing"]), 1024)
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, run)) == Counter(map(key, packed))


# --- rows judged one by one, not by id ------------------------------------------------------------

ENGLISH = ["the cat sat on the mat and looked out of the window", "she went to the market to buy bread and milk",
           "they walked along the river until the sun went down", "we will meet again when the work is done"]


def test_identified_rows_by_their_own_text(spark):
    """A letterless text goes alone: other rows with its null or repeated id stay."""
    good = [(i, ENGLISH[i % 4] + f" part {'abcdefgh'[i % 8]}", "en", "s", 1) for i in range(40)]
    shared = [(None, ENGLISH[0], None, "s", 2), (None, ENGLISH[1], None, "s", 2), (7, ENGLISH[2], None, "s", 2)]
    junk = [(None, "12 34 !!", None, "s", 3), (None, None, None, "s", 3), (7, "", None, "s", 3)]
    kept = language_id.keep_identified(spark.createDataFrame(good + shared + junk, DOCS).repartition(3)).collect()
    assert Counter(tuple(r) for r in kept) == Counter(good + shared)


def test_one_row_of_each_near_group(spark):
    """Null and repeated ids: a near copy goes alone, and of each component exactly one row stays."""
    rng = random.Random(4)
    base = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400)) for _ in range(9)]
    near = [next(t for t in (f"{b} end{k}" for k in range(99)) if 0 < (brute_print(b) ^ brute_print(t)).bit_count() <= 3) for b in base]
    rows = [(1, base[0]), (None, near[0]), (None, base[1]),           # a null id beside an id, and one alone
            (5, base[2]), (6, near[2]), (6, base[3]),                 # a repeated id, once a near copy, once unique
            (None, base[4]), (None, near[4]),                         # only null ids
            (2, base[5]), (2, near[5]), (3, near[5]),                 # the smallest id twice
            (9, base[6]), (9, base[6]), (9, base[6]), (None, base[7]), (None, base[7])]  # rows sent again
    lowest = lambda *group: min((hashlib.sha256(t.encode()).hexdigest(), t) for t in group)[1]
    want = [(1, base[0]), (None, base[1]), (5, base[2]), (6, base[3]), (None, lowest(base[4], near[4])),
            (2, lowest(base[5], near[5])), (9, base[6]), (None, base[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    for few in (common.FEW_IDS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "FEW_IDS", few)
            assert Counter((r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect()) == Counter(want)


def test_packing_by_counts():
    """Best fit on counts against best fit item by item: the same number of bins, every item in one slot."""
    rng = random.Random(6)
    for capacity, n in ((1024, 5000), (7, 300), (100, 1), (50, 2000)):
        lengths = [min(capacity, 1 + int(rng.expovariate(5 / capacity))) for _ in range(n)]
        rooms, bins = Counter(), 0
        for length in sorted(lengths, reverse=True):
            room = min((r for r, k in rooms.items() if k and r >= length), default=capacity)
            if rooms[room]:
                rooms[room] -= 1
            else:
                bins += 1
            if room > length:
                rooms[room - length] += 1
        patterns = packing.fitted(Counter(lengths), capacity)
        assert sum(times for times, _ in patterns) == bins
        assert all(sum(length * k for length, k in held) <= capacity for _, held in patterns)
        held = Counter()
        for times, parts in patterns:
            for length, k in parts:
                held[length] += times * k
        assert held == Counter(lengths)


@pytest.mark.parametrize("few", [packing.FEW_COUNTS, 0])
def test_packing_ordered_by_source(spark, monkeypatch, few):
    """Over 65,536 items a task, the long ones first and in other tasks than the short ones: pairs meet all the same."""
    monkeypatch.setattr(packing, "FEW_COUNTS", few)
    items = spark.range(0, 280_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                                 F.when(F.col("id") < 140_000, 600).otherwise(424).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    for parts in (1, 4):
        packed = packing.pack(items.coalesce(parts)).withColumn("until", F.col("offset") + F.col("length"))
        bins = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.max("until").alias("until"), F.min("offset").alias("low"))
        assert packed.select("doc_id").distinct().count() == packed.count() == 280_000
        assert bins.where("fill <> until or low <> 0 or fill > 1024").isEmpty()
        assert bins.count() == 140_000


def test_evenly_mixed_text_is_identified(spark):
    """Four languages in equal parts: no label has a third of the words, yet every word is told with certainty."""
    rng = random.Random(3)
    stems = {"ww": ["tion", "ning"], "xx": ["zung", "keit"], "yy": ["rrado", "mente"], "zz": ["ykka", "lliss"]}
    made = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice("aeiou") for _ in range(n))
    rows = [(k * 100 + i, made(lang, 60), lang, "s", 1) for k, lang in enumerate(stems) for i in range(40)]
    rows.append((999, " ".join(made(lang, 40) for lang in stems), None, "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    mixed = {r.doc_id: r.score for r in language_id.identify(docs).collect()}[999]
    assert mixed < 0.3
    assert language_id.keep_identified(docs).count() == len(rows)
