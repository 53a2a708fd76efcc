"""Near-dedup, substring dedup and decontamination against brute force, skew and edge cases included."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rulesift.llm import decontamination, simhash, substring

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)] + ["É", "é", "ÀB", "x.y"]


def corpus(seed=0, n=60):
    """Texts with exact copies, near copies, a passage that many share, periodic text, and odd rows."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(VOCABULARY) for _ in range(k)]
    shared, rows = words(60), []
    for i in range(n):
        w = words(rng.randint(1, 160))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + shared + w[at:]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    for i in range(n, n + 25):
        w = rows[3][1].split()
        if i % 2:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a " * 80), (1004, "one two"), (1005, "One two"), (1006, "\u00a0x\u2003y"), (7, "same id other text"), (3, rows[3][1]), (3, rows[3][1]), (None, " ".join(shared)), (1007, " ".join(words(60_000)))]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "v", 1) for i, t in rows], "doc_id long, text string, fp string, key int").repartition(parts)


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, pairs):
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return {x: root(x) for x in items}


def test_simhash_against_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None]
    prints = [fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    of = roots(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 4])
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        least[of[p]] = min(i, least.get(of[p], i))
    want = sorted((i, f"{p:016x}", least[of[p]]) for (i, _), p in zip(rows, prints, strict=True))
    assert sorted(tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()) == want


def test_simhash_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e"), (None, "z"), (4, "a b c d e")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 3 and {r["component_id"] for r in got} == {4, None}
    assert sorted(r["text"] for r in simhash.keep_first(frame(spark, rows)).collect()) == ["a b c d e", "z"]  # a row of each class, with an id if one has it
    assert [r["doc_id"] for r in simhash.keep_first(frame(spark, rows)).where("text <> 'z'").collect()] == [4]
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def assert_first_of_similar(before, after):
    """Of texts with a similarity of 0.85 or more one stays; every class of 0.8 keeps one. before, after: (id, text)."""
    sets = {}
    for i, t in before:
        sets.setdefault(" ".join((t or "").lower().split()), (shingle_set(t), []))[1].append(i)
    texts = list(sets)
    pairs = {x: [(a, b) for k, a in enumerate(texts) for b in texts[:k] if jaccard(sets[a][0], sets[b][0]) >= x] for x in (0.8, 0.85)}
    loose, tight = (roots(texts, pairs[x]) for x in (0.8, 0.85))
    stays = {" ".join((t or "").lower().split()) for _, t in after}
    assert len(after) == len(stays) and {(str(i), t) for i, t in after} <= {(str(i), t) for i, t in before}
    for t in set(tight.values()):
        assert sum(tight[x] == t for x in stays) <= 1
    assert {loose[x] for x in stays} == set(loose.values())
    return len([p for p in pairs[0.85]]), len(before) - len(after)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 5])  # small: buckets fall apart
def test_keep_first_by_similarity(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (simhash.WIDE, bucket))
    rng = random.Random(8)
    rows = [(i, t) for i, t in corpus(3, 30)]
    for i in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(300)]
        for k in range(6):
            w = list(base)
            for at in rng.sample(range(300), k):
                w[at] = f"new{k}"
            rows.append((5000 + 10 * i + k, " ".join(w).upper() if k == 3 else "\n".join(w)))
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "key"]
    similar, gone = assert_first_of_similar(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])
    assert similar > 100 and gone > 60


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1, max_size=150), st.integers(0, 80))
def test_pairs_counted_side_by_side(pairs, radius):
    x = np.array(pairs, np.uint64)
    assert simhash.near_pairs(x, radius).tolist() == [a.bit_count() + b.bit_count() <= radius for a, b in pairs]
    q = int.from_bytes(x[0].tobytes(), "little")
    near = simhash.Planes(x).near(q, radius, (1 << len(x)) - 1)
    assert [near >> i & 1 for i in range(len(x))] == [int((int.from_bytes(m.tobytes(), "little") ^ q).bit_count() <= radius) for m in x]


@pytest.mark.parametrize("most", [simhash.LINKS, 2])
def test_links_are_checked_exactly(spark, most):
    rng = random.Random(3)
    base = set(range(100))
    sets = {i: {x for x in base if rng.random() < 0.9} | {1000 + i} for i in range(20)} | {50: set(), 51: set()}
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)] + [(50, 51), (0, 50)]
    rows = spark.createDataFrame([(i, np.array(sorted(x), np.uint64).tobytes()) for i, x in sets.items()], "id long, set binary")
    got = {tuple(r) for r in simhash.alike(spark.createDataFrame(pairs, "a long, b long"), rows, 0.8, most).collect()}
    assert got == {(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) >= 0.8} and 20 < len(got) < 190


@pytest.mark.parametrize("first", [simhash.APART, 2])
def test_no_pair_is_lost_behind_nearer_ones(spark, monkeypatch, first):
    """Two similar texts with 20 others nearer to both, none of which is similar to any: the bucket's forest and nearest links pass their pair over."""
    monkeypatch.setattr(simhash, "APART", first)
    rng = random.Random(5)
    far = sum(1 << b for b in range(50))
    prints = [0, far] + [sum(1 << b for b in rng.sample(range(50), 25)) | sum(1 << b for b in rng.sample(range(60, 250), 4)) for _ in range(20)]
    rows = [(i, *[int(w) for w in np.array([p >> 64 * k & (1 << 64) - 1 for k in range(4)], np.uint64).view(np.int64)], [7], [8]) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "id long, w0 long, w1 long, w2 long, w3 long, keys array<long>, finer array<long>")
    sets = [(i, np.arange(100, dtype=np.uint64) + np.uint64(i if i < 2 else 1000 * i)) for i in range(len(rows))]
    met = simhash.similar_links(nodes)
    assert (0, 1) not in {(r["a"], r["b"]) for r in met.collect()}
    found = simhash.similar_classes(nodes, met, spark.createDataFrame([(i, x.tobytes()) for i, x in sets], "id long, set binary"))
    assert sorted(map(tuple, found.where("node <> root").collect())) == [(1, 0)]


def test_keep_first_keeps_a_row_of_each_class(spark):
    long, other = " ".join(f"alpha{i} beta" for i in range(30)), " ".join(f"gamma{i} delta" for i in range(30))
    rows = [(1, long, "x", 1), (1, other, "x", 1), (2, long, "x", 1), (1, long, "y", 1), (1, long, "x", 1), (3, None, "n", 1), (4, "", "n", 1), (None, other, "z", 1)]
    for parts in (1, 3):
        got = sorted((str(r["doc_id"]), r["text"] or "", r["fp"]) for r in spark.createDataFrame(rows, "doc_id long, text string, fp string, __a int").repartition(parts, "fp", "doc_id").transform(simhash.keep_first).collect())
        assert [(i, t) for i, t, _ in got] == [("1", long), ("1", other), ("3", "")]
        chosen = got if parts == 1 else chosen
        assert got == chosen  # ties don't follow the order of rows


def test_hot_fingerprints_are_broadcast(spark):
    rows = [(i, "the same text over and over") for i in range(50)] + [(100 + i, f"w{i} x{i} y{i} z{i} q{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in simhash.classes(df).select("doc_id", "fp", "component_id").collect()}
    assert {tuple(r) for r in simhash.classes(df, hot=10).select("doc_id", "fp", "component_id").collect()} == want and len(want) == 70


@pytest.mark.parametrize("bucket", [4096, 7])
def test_links_span_all_pairs_also_where_buckets_fall_apart(spark, bucket):
    rng = random.Random(5)
    values = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(15):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            values.add(x)
    nodes = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in nodes], "fp long")
    got = [(int(np.int64(r["a"]).astype(np.uint64)), int(np.int64(r["b"]).astype(np.uint64))) for r in simhash.links(df, bucket=bucket).collect()]
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 4]
    groups = lambda of: sorted(sorted(k for k in of if of[k] == r) for r in set(of.values()))
    assert all((a ^ b).bit_count() <= 4 for a, b in got) and groups(roots(nodes, got)) == groups(roots(nodes, pairs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 2**64 - 1), st.integers(0, 8))
def test_planes(members, query, radius):
    near = simhash.Planes(np.array(members, np.uint64)).near(query, radius, (1 << len(members)) - 1)
    assert [near >> i & 1 for i in range(len(members))] == [int((m ^ query).bit_count() <= radius) for m in members]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) <= {0, 100} and all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def recorded_tables(monkeypatch):
    """The names of the tables that the stage writes from now on."""
    names, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: (names.append(name), write(df, name))[1])
    return names


def test_stars_are_classes_without_a_round(spark, monkeypatch):
    tables = recorded_tables(monkeypatch)
    edges = [(9, i) for i in range(10, 30)] + [(40, 41), (41, 40), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 9 for i in range(10, 30)} | {41: 40} and tables == ["star"]


def test_classes_in_rounds_are_those_of_all_similar_links(spark, monkeypatch):
    """Links of many classes, found in two parts: the classes are those of all links between similar sets, new links alone are contracted, and there are few rounds."""
    rng, contracted, of = random.Random(11), [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: (contracted.append(edges.count()), of(edges))[1])
    tables = recorded_tables(monkeypatch)
    sets = {i: frozenset(range(200 * (i % 9), 200 * (i % 9) + 100)) ^ frozenset(rng.sample(range(200 * (i % 9), 200 * (i % 9) + 100), rng.randint(0, 18))) for i in range(150)}
    pairs = [(a, b) for a in sets for b in sets if a < b and (a % 9 == b % 9 or rng.random() < 0.1)]
    rng.shuffle(pairs)
    links = [(a, b, rng.randint(0, 56)) for a, b in pairs]
    frame = spark.createDataFrame([(i, np.array(sorted(x), np.uint64).tobytes()) for i, x in sets.items()], "id long, set binary")
    first, second = (spark.createDataFrame(x, "a long, b long, bits int") for x in (links[:600], links[600:]))
    got = {r["node"]: r["root"] for r in simhash.good_classes(second, frame, simhash.good_classes(first, frame)).collect()}
    want = roots(sets, [(a, b) for a, b, _ in links if jaccard(sets[a], sets[b]) >= 0.8])
    least = {r: min(i for i in want if want[i] == r) for r in want.values()}
    assert got == {i: least[want[i]] for i in want if least[want[i]] != i} and len(got) > 60
    # each part's first round has many links, all others few, and no link comes twice
    assert sorted(contracted)[-3] < 20 and tables.count("simhash-left") < 8 and tables.count("star") < 20


def stripped(rows):
    words = [SPLIT.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("hot, entries, held", [(substring.HOT, substring.ENTRIES, substring.HELD), (2, 3, 50)])  # small: hot phrases fall into parts, rows and shards into pieces
def test_substring_against_brute_force(spark, monkeypatch, hot, entries, held):
    for name, value in (("HOT", hot), ("ENTRIES", entries), ("HELD", held)):
        monkeypatch.setattr(substring, name, value)
    rows = corpus(1)
    want = stripped(rows)
    sha = lambda kept: hashlib.sha256(" ".join(kept).encode()).hexdigest()
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted((tuple(r) for r in substring.report(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=key)
    assert got == sorted(((i, n, r, sha(k)) for i, n, r, k in want), key=key) and sum(r for *_, r, _ in want) > 1000
    texts = Counter((r["doc_id"], r["text"]) for r in substring.strip_repeats(frame(spark, rows)).collect())
    assert texts == Counter((i, t if not r else " ".join(k)) for (_, t), (i, _, r, k) in zip(rows, want, strict=True))
    assert substring.report(frame(spark, rows).limit(0)).count() == 0


def test_substring_with_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, passage, "a", 7, "s"), (2, f"x {passage} y", "b", 8, "t"), (3, None, "c", 9, None)], "doc_id long, text string, n_words string, N_removed int, kept_sha256 string")
    kept = {r["doc_id"]: tuple(r) for r in substring.strip_repeats(df).collect()}
    assert substring.strip_repeats(df).columns == df.columns and kept == {1: (1, "", "a", 7, "s"), 2: (2, "x y", "b", 8, "t"), 3: (3, None, "c", 9, None)}
    got = substring.remove_repeats(df, digest=True)
    assert got.columns == ["doc_id", "kept_sha256", "n_words", "n_removed"] and {(r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()} == {(1, 40, 40), (2, 42, 40), (3, 0, 0)}


def test_the_automaton_decides(spark):
    """Windows go only where the automaton locates their phrase."""
    words = [f"p{i}".encode() for i in range(50)]
    hashes = substring.word_hashes(words)
    letter = substring.letters(hashes)
    codes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letter, substring.PHRASE)).view(np.uint64).reshape(-1, 2)
    entries = np.zeros(16, substring._ENTRY)
    entries["w"], entries["x"] = substring.window_hashes(hashes)
    listed, whole = np.zeros(len(codes), bool), np.ones(len(codes), bool)
    assert substring.Passages(codes, listed, entries).occurrences(hashes).tolist() == list(range(16))
    at = substring.anchors(substring.phrase_keys(letter))
    some = np.flatnonzero(at == at[0]).tolist()
    assert substring.Passages(codes[[at[0]]], listed[:1], entries).occurrences(hashes).tolist() == some
    assert substring.Passages(codes[[at[0]]], whole[:1], entries[:0]).occurrences(hashes).tolist() == some
    assert substring.Passages(codes[:0], listed[:0], entries).occurrences(hashes).tolist() == []
    assert substring.Passages(codes, listed, entries[4:6]).occurrences(hashes).tolist() == [4, 5]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=35, max_size=120))
def test_windows_have_equal_hashes_exactly_where_equal(letters):
    words = [x.encode() for x in letters]
    h = list(zip(*(x.tolist() for x in substring.window_hashes(substring.word_hashes(words))), strict=True))
    w = [tuple(words[k : k + 35]) for k in range(len(words) - 34)]
    assert all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(i))
    keys = substring.phrase_keys(substring.letters(substring.word_hashes(words)))
    at, order = substring.anchors(keys).tolist(), (keys >> np.uint64(32)).tolist()
    assert at == [min(range(i, i + substring.RUNS), key=lambda p: (order[p], p)) for i in range(len(w))]


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(rows, items):
    windows = {}
    for i, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, own = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    own |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])  # 0: the way for benchmarks that aren't broadcast
def test_decontamination_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    rows = corpus(2)
    item = rows[0][1].split()
    items = [(1, rows[8][1]), (2, "W1, w2!"), (3, ""), (4, None), (10, " ".join(item[:30]).upper()), (9, "one two"), (11, " ".join(item[5:16])), (12, "É"), (13, "w7 w7 w7")]
    docs = [*rows, (2000, "x " + " ".join(item[:12]) + " y"), (2001, "ÀB É one, TWO"), (2002, "w7 w7 w7 w7")]
    key = lambda r: (str(r[0]), *r[1:])
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, at int")
    got = decontamination.report(frame(spark, docs), bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = contaminated(docs, items)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    kept = decontamination.keep_clean(frame(spark, docs), bench)
    assert kept.columns == ["doc_id", "text", "fp", "key"] and Counter(str(r["doc_id"]) for r in kept.collect()) == Counter(str(r[0]) for r in want if not r[-1])
    assert decontamination.report(frame(spark, docs).limit(0), bench).count() == 0
    clean = decontamination.report(frame(spark, docs), bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_decontamination_runs_no_python(spark):
    plan = decontamination.report(frame(spark, [(1, "a")]), spark.range(1).selectExpr("id AS item_id", "'b' AS text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
