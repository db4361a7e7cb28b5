"""Conversation trie, spelling variants and vector search against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelake.llm import ORACLES, QUERIES, prefix_trie, spelling, vector_search

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
sort_key = lambda row: tuple((x is not None, x) for x in row)


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- conversation trie -----------------------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        whole = tuple(own.get(conv - int(math.fmod(conv, 100)), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(conv)
        ends[whole].append(conv)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]),
                    leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=sort_key)


def odd_turns():
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "yy", None, "", "é\U0001F600"]))
            for c in [*range(25), *range(100, 112), 205, 206, -5, -100] for t in range(rng.randint(0, 9))]
    rows += [(3, None, "u", "n"), (3, None, "u", "n"), (None, 1, "u", "n"), (7, 2, None, None), (9, 1, "u", "z" * 50_000)]
    return rows + [(c, t, "u", "same") for c, n in ((1, 60), (8, 40)) for t in range(n)]


def test_trie(spark, monkeypatch):
    assert sorted((tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SF).collect()), key=sort_key) == brute_trie(
        [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    monkeypatch.setattr(prefix_trie, "IDS_CHUNK", 3)
    turns = clashing(spark.createDataFrame(odd_turns(), TURNS).repartition(3), "depth", "node", "part", "place", "row", "h", "kids")
    assert sorted((tuple(r) for r in prefix_trie.trie(turns).collect()), key=sort_key) == brute_trie(odd_turns())
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_contraction_of_chains_and_stars(spark):
    """Unary chains are spliced, so a chain takes far fewer rounds than it has nodes; every node gets its total."""
    rng = random.Random(4)
    parent = {0: None, **{i: i - 1 for i in range(1, 120)}, **{i: 0 for i in range(120, 300)}, **{i: rng.randrange(i) for i in range(300, 400)}}
    own = {i: (rng.randrange(3), rng.randrange(9)) for i in parent}
    total = {i: list(own[i]) for i in parent}
    for i in sorted(parent, key=lambda i: -i):
        if parent[i] is not None:
            for k in (0, 1):
                total[parent[i]][k] += total[i][k]
    node = "struct<wa:long,wb:long>"
    nodes = spark.createDataFrame([((i, i), None if p is None else (p, p), *own[i]) for i, p in parent.items()],
                                  f"node {node}, parent {node}, leaves long, saved long")
    got = {r.node.wa: [r.leaves, r.saved] for r in prefix_trie.contracted(nodes).collect()}
    assert got == total


# --- spelling variants -----------------------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word):
    """Patterns that two words share if one replaced code point, and words that one deleted code point makes."""
    return {word[:k] + "\0" + word[k + 1:] for k in range(len(word))}, {word[:k] + word[k + 1:] for k in range(len(word))}


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run
            counts[run] += len(run) >= 6
    words = {w: n for w, n in counts.items() if n >= 5}
    near, alike = defaultdict(set), defaultdict(set)
    for w in words:
        replaced, shorter = edits(w)
        for pattern in replaced:
            alike[pattern].add(w)
        for s in shorter & set(words):
            near[w].add(s)
            near[s].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in best.items() if words[f] >= 5 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def made_texts(seed=2):
    """Frequent words, their variants and variants of those, long words, accents, and a hot beginning."""
    rng = random.Random(seed)
    base = ["hotbegin" + "".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(60)] + ["Éléphant", "straßen", "über" * 6, "aaaaaa", "aaaaaaa", "ababab"]
    found = []
    for n, w in enumerate(base):
        found += [w] * (rng.choice([5, 30, 200]) if n % 3 else 6)
        for _ in range(3):
            k = rng.randrange(len(w))
            found += [rng.choice([w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1:]])] * rng.choice([5, 6, 1])
    rng.shuffle(found)
    return [(i, " ".join(found[i::40]).replace("a", "A", i % 3)) for i in range(40)]


@pytest.mark.parametrize("frequent,limit", [(32, 2048), (2, 5)])
def test_variants(spark, monkeypatch, frequent, limit):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "LIST_LIMIT", limit)
    rows = made_texts() + [(None, "Nulltext nulltext-nulltext;nulltext nulltexts"), (5, None), (5, ""), (6, "q" * 100_000), (None, "Nulltext")] * 2
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "word", "n", "id", "run", "form", "root")
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    assert got == brute_variants(rows) and any(f and f != r for _, f, r, *_ in got)
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r) for r in QUERIES["op12_spelling_variants"](spark, SF).collect()) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_every_word_keeps_a_gram_in_any_edit():
    """The bound is below the number of grams whatever is frequent, so some list always holds both words."""
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choices("ab", k=rng.randint(6, 30)))
        frequent = frozenset("".join(rng.choices("ab^$", k=rng.randint(2, 12))) for _ in range(rng.randint(0, 3000)))
        for kind in (len(word), len(word) - 1):
            if kind >= spelling.SHORTEST:
                grams = spelling.decomposed(word, spelling.largest_gram(kind), frequent)
                assert 0 < spelling.affected(grams, len(word)) < len(grams)


# --- vector search ---------------------------------------------------------------------------------

def brute_nearest(rows, every, k):
    """rows of (vec_id, vector)."""
    used = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(used):
        if i is None or i % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0) for b, (j, v) in enumerate(used) if a != b)
        out += [(i, rank + 1, None if null else j, -score) for rank, (score, null, j) in enumerate(found[:k])]
    return sorted(out, key=sort_key)


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "LEAST_BLOCK", block)
    monkeypatch.setattr(vector_search, "SAMPLE", 20)
    monkeypatch.setattr(vector_search, "CHUNK", 16)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(200, 290)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (10, [9.0] * 5), (10, [9.0] * 5), (10, [-9.0] * 5), (20, None), (30, [1.0, None]), (31, [math.nan, 1.0]),
             (40, [math.inf]), (50, []), (51, [2.0]), (60, [1.0] * 20), (-10, [0.5] * 5)]
    vectors = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "row", "vector", "score", "class", "query")
    assert sorted((tuple(r) for r in vector_search.nearest(vectors, 10).collect()), key=sort_key) == brute_nearest(rows, 10, 5)
    assert vector_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), 10).count() == 0


def test_nearest_of_large_numbers(spark):
    rows = [(0, [2.0 ** 22, 1.0]), (1, [2.0 ** 22, -1.0]), (2, [-2.0 ** 21, 3.0]), (3, [0.0, 2.0 ** 20])]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()
    assert sorted((tuple(r) for r in got), key=sort_key) == brute_nearest(rows, 1, 5)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (40, 32)), rng.integers(-300, 300, (50, 32)) * (rng.random((50, 1)) < 0.9)
    exact = a @ b.T
    for x, y in zip(vector_search.statistics(a), vector_search.statistics(b), strict=True):
        assert (x @ y.T >= exact - 1e-6).all()


def test_nearest_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op13_vector_search"](spark, SF).collect())) == sorted(con.execute(ORACLES["op13_vector_search"]).fetchall())
