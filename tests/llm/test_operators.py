"""Every operator against brute force, held-out labels or a round trip, odd inputs included."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectrail.fs import children
from vectrail.llm import anchors, automaton, capfilters, contamination, jaccard, language, lines, links, packing, quality, scratch, substrings, tokens, urls
from vectrail.session import scratch_root

DOCS = "doc_id long, text string, node string, id string"  # the last two clash with names used inside
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "re", "tu", "ün") for b in ("ba", "do", "fe", "gi", "s", "zon")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else rng.choice(VOCABULARY) for w in text.split())


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, repeated lines, odd and missing texts."""
    rng = random.Random(seed)
    shared = [prose(rng, 45) for _ in range(3)]
    out = [prose(rng, rng.randint(3, 120)) for _ in range(40)]
    out += [edited(rng, t, 0.02) for t in out[:12]] + out[:6]
    out += [f"{prose(rng, 20)}\n{rng.choice(shared)}\n{prose(rng, 9)}" for _ in range(14)]
    out += ["", None, "  \n\t ", "ONE two", "one TWO", "a", "x " * 400, "é" * 300, "\n", prose(rng, 4000)]
    return [(i, t, "n", "z") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + [(None, "null id text", "n", "z")], DOCS)


def split_words(text):
    return (text or "").encode().lower().split()


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_hubs_and_cycles(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + k) for k in range(50)] + [(7, 7), (2000, 2001), (2001, 2002), (2002, 2000), (3000, 3000)]
    edges += [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(250)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == roots({x for e in edges for x in e}, edges)
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_groups_match_all_pairs(spark, rows, docs):
    def shingles(text):
        w = split_words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, *_ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) > 15
    want = roots(sets, pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()}
    assert got.pop(None) == (1, None)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_lists_split_into_shares(spark, rows, docs, monkeypatch):
    want = sorted(map(tuple, jaccard.similar_groups(docs).collect()), key=repr)
    monkeypatch.setattr(jaccard, "_stars", lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    monkeypatch.setattr(jaccard, "HUB_MEMBERS", 2)
    assert sorted(map(tuple, jaccard.similar_groups(docs).collect()), key=repr) == want


def test_overlap_bounds_and_parities():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (set(rng.integers(0, 3000, rng.integers(1, 400)).tolist()) for _ in range(2))
        both = len(a & b)
        enough = 100 * both >= 80 * len(a | b)
        assert enough == (both >= jaccard.overlap_needed(len(a), len(b), 80))
        raw = [jaccard._parities(np.array(sorted(s), np.uint64)) for s in (a, b)]
        assert jaccard._Apart([*raw, None])(0, np.array([1, 2])).tolist() <= [len(a ^ b), 0]


@pytest.mark.parametrize("large_group", [8192, 1])
def test_substrings_match_brute_force(spark, rows, docs, monkeypatch, large_group):
    monkeypatch.setattr(substrings, "LARGE_GROUP", large_group)
    raw = {i: (t or "").encode() for i, t, *_ in rows} | {None: b"null id text"}
    counts = Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    got = {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in substrings.remove_repeats(docs).collect()}
    for i, text in raw.items():
        gone = bytearray(len(text))
        for k in range(len(text) - 199):
            if counts[text[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(text)) if gone[k] and (not k or not gone[k - 1]))
        assert got[i] == (len(text), bytes(b for b, g in zip(text, gone) if not g), spans)
    assert sum(len(t) for t in raw.values()) > sum(len(k) for _, k, _ in got.values())


def test_substrings_move_only_texts_with_lists(spark, docs, monkeypatch):
    texts = spark.range(4000).select(F.xxhash64("id").alias("doc"), F.col("id").cast("string").alias("text"))
    lists = scratch.stored(texts.where("text % 100 = 0").select("doc", F.array("text").alias("wanted")), "lists")
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    seen = substrings.may_have(texts, lists).groupBy((F.col("text") % 100 == 0).alias("listed"), "known").count().collect()
    counts = {(r.listed, r.known): r["count"] for r in seen}
    assert counts[True, True] == 40 and (True, False) not in counts and counts.get((False, True), 0) < 200
    assert {r.text for r in substrings.with_lists(texts, lists).collect()} == {str(i) for i in range(0, 4000, 100)}
    every = substrings.with_lists(texts, lists, every=True).collect()
    assert len(every) == 4000 and all((r.wanted == [r.text]) == (int(r.text) % 100 == 0) and (r.wanted is None) == (int(r.text) % 100 != 0) for r in every)

    def folders():
        return set(children(spark, f"{scratch_root(spark)}/vectrail"))

    there = folders()
    long_lists = substrings.remove_repeats(docs.union(docs)).collect()
    labels = {name.rsplit("-", 1)[0] for name in folders() - there}
    assert "repeats" in labels and not {"anchors", "keys"} & labels
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 1 << 30)
    assert Counter(map(str, long_lists)) == Counter(map(str, substrings.remove_repeats(docs.union(docs)).collect()))


def test_ranges_are_merged_before_they_are_joined():
    ranges = [[(9, 12), (0, 5), (3, 4), (5, 7)], [(0, 2)], [(20, 30), (8, 20), (40, 41), (1, 2)]]
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
    column = pa.array([[{"begin": a, "stop": b} for a, b in r] for r in ranges], kind)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), column], names=["doc", "ranges"])
    (got,) = substrings._merged([batch.slice(0, 0), batch])
    merged = [[(r["begin"], r["stop"]) for r in x] for x in got.column("ranges").to_pylist()]
    assert merged == [[(0, 7), (9, 12)], [(0, 2)], [(1, 2), (8, 30), (40, 41)]]
    (last,) = substrings._merged([batch.slice(2)])
    assert last.column("ranges").to_pylist() == got.column("ranges").to_pylist()[2:]


def test_anchors_do_not_depend_on_units(monkeypatch):
    import pyarrow as pa

    text = pa.array([prose(random.Random(3), 9000)])

    def found():
        out = set()
        for run in anchors.governed(text, 200):
            for key, start, windows, place in zip(run["key"], run["start"], run["windows"], run["place"]):
                out |= {(int(start + w), int(key), int(place - w)) for w in range(windows)}
        return out

    whole = found()
    monkeypatch.setattr(anchors, "UNIT_BYTES", 5000)
    assert found() == whole and len(whole) == len(text[0].as_py().encode()) - 199


def test_lines_keep_the_last_holder(spark):
    shared, other = "A line that is long enough to be counted here", "b" * 39
    texts = [f"{shared}\n{other}\nown {i}" for i in range(6)] + [f"  {shared.upper()}\t", "", None, shared]
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, batch string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(frame, batches=3).collect()}
    for i in range(6):
        assert got[i] == (f"{other}\nown {i}", 3, 1)
    assert got[6] == ("", 1, 1) and got[7] == ("", 1, 0) and got[8] == (None, 1, 0) and got[9] == (shared, 1, 0)
    assert lines.dedup_lines(frame.where("false")).count() == 0


def test_line_runs_are_levelled_and_total_right(spark):
    rng, runs, total = random.Random(2), lines.LineRuns(spark, "bigint", fanout=2), Counter()
    for batch in range(5):
        found = [(bytes([rng.randrange(9)]), batch * 100 + k) for k in range(12)]
        total.update(k for k, _ in found)
        runs.add(spark.createDataFrame(found, "key binary, id long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert {bytes(r.key): r.n_docs for r in runs.totals(4).collect()} == {k: n for k, n in total.items() if n >= 4}


def test_packing_round_trip(spark, rows, docs):
    exact = tokens._load("byte_bpe_50k.json")
    got = packing.pack(docs.repartition(4), open_bins=8).collect()
    want = {i: exact.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    pieces, bins = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 1024
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        found = sorted(pieces[i])
        assert [p for p, *_ in found] == list(range(len(found)))
        assert [x for _, _, part in found for x in part] == ids
        assert all(len(part) == 1024 for _, _, part in found[1:]) and (len(ids) > 1024) == (len(found) > 1)
        assert [s for _, s, _ in found] == [sum(len(p) for _, _, p in found[:k]) for k in range(len(found))]
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(docs.where("false")).count() == 0


def test_best_fit_closes_the_fullest():
    packer = packing.BestFit(10, 2, 0)
    assert [packer.put(n) for n in (6, 7, 3, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert packer.put(9) == (3, 0)  # bin 0, the fullest open one, closes
    assert packer.open() == {2: 5, 3: 9}


def test_piecewise_ids_equal_the_tokenizer():
    import pyarrow as pa

    texts = ["", None, "a  b\n\n c ", " x", "end<|endoftext|> y", "it's  1,000 — ok\t\tz ", "ab'll x1y2,z,—,é,' 's", "nb\u00a0sp \u2003q", "Üñ“q”…a.b"]
    for ranks in (None, "byte_bpe_50k.tiktoken"):
        encoder = tokens.PieceEncoder("byte_bpe_50k.json", ranks)
        for row, ids in encoder.texts(pa.array(texts)):
            assert ids.tolist() == encoder.tokenizer.encode(texts[row] or "", add_special_tokens=False).ids


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    items = [prose(rng, rng.randint(9, 30)) for _ in range(12)] + ["tiny item", "", None]
    texts = []
    for k in range(40):
        inside = items[k % 12]
        if k % 3 == 1:
            cut = inside.split()
            inside = " ".join(cut[1:] if k % 2 else cut + [rng.choice(VOCABULARY)])
        texts.append(f"{prose(rng, rng.randint(0, 30))} {inside.upper() if k % 5 == 0 else inside} {prose(rng, rng.randint(0, 30))}")
    texts += ["tiny item", "", None, prose(rng, 300)]

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])

    want = set()
    for d, text in enumerate(texts):
        w = (text or "").lower().split()
        for i, item in enumerate(items):
            own = Counter(shingles(x := (item or "").lower().split()))
            for start in range(-len(x) + 1, len(w)):
                other = Counter(shingles(w[max(start, 0) : start + len(x)]))
                if own and other and 100 * sum((own & other).values()) >= 80 * sum((own | other).values()):
                    want.add((d, i))
    frame = spark.createDataFrame([(d, t, "w", 0) for d, t in enumerate(texts)], "doc_id long, text string, words string, m int")
    bench = spark.createDataFrame([(i, t, "w") for i, t in enumerate(items)], "item_id long, text string, least string")
    found = contamination.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 30
    assert all(0.8 <= r.similarity <= 1 for r in found)
    assert contamination.find_leaks(frame, bench.where("false")).count() == 0
    assert contamination.find_leaks(frame.where("false"), bench).count() == 0


def test_leaks_at_the_ends_of_texts(spark):
    words = [f"w{i}" for i in range(25)]
    fewer = [w for i, w in enumerate(words) if i not in (1, 2)]
    rest = [f"r{i}" for i in range(40)]
    backward = [w for i, w in enumerate(words) if i not in (22, 23)]
    texts = [(1, " ".join(backward + rest)), (2, " ".join(rest + fewer)), (3, " ".join(rest)), (None, " ".join(backward + rest))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = contamination.find_leaks(frame, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))

    def best(text):
        own, split = {tuple(words[i : i + 5]) for i in range(21)}, text.split()
        other = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for s in range(-24, len(split)) if (w := split[max(s, 0) : s + 25])]
        return max(len(own & set(o)) / len(own | set(o)) for o in other)

    want = {d: best(t) for d, t in texts if best(t) >= 0.8}
    assert set(want) == {1, 2, None} and {r.doc_id: r.similarity for r in found.collect()} == pytest.approx(want)


def test_lossless_stride():
    assert contamination.lossless_stride([1]) == 1 and contamination.lossless_stride([4]) == 2
    assert contamination.lossless_stride([9, 40, 400]) == 3


def test_simhash_is_the_majority(spark):
    rng = random.Random(4)
    found = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(31)]
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in found) > 31)
    got = spark.range(1).select(contamination.simhash(F.array(*[F.lit(h) for h in found])).alias("s")).first().s
    assert got % (1 << 64) == want


def test_automaton_matches_brute_force(spark, rows):
    import math

    frame = spark.createDataFrame(rows, DOCS)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = {r.doc_id: r for r in automaton.score_texts(frame, trainable=train, block_bytes=6000).collect()}
    texts = {i: split_words(t) + ["end"] for i, t, *_ in rows}
    learned = {i: w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    count, pair = Counter(), Counter()
    for w in learned.values():
        count.update(w), pair.update(zip(["end", *w], w))
    n, v = sum(count.values()), len(count)
    states = {w for w, c in count.items() if c >= max(2, 1e-5 * n)} | {"end"}
    arcs = {p: c for p, c in pair.items() if c >= 2 and set(p) <= states}
    mass = Counter()
    for (a, _), c in arcs.items():
        mass[a] += c - automaton.DISCOUNT
    for i, w in texts.items():
        base = [(count[x] + 1) / (n + v + 1) for x in w]
        chance = [
            (1 - mass[a] / count[a] if a in states else 1) * p + ((arcs[a, b] - automaton.DISCOUNT) / count[a] if (a, b) in arcs else 0)
            for (a, b), p in zip(zip(["end", *w], w), base)
        ]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in learned, len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, base))) and r.score == pytest.approx(sum(map(math.log10, chance)))
    assert automaton.score_texts(frame, trainable=F.lit(False)).agg(F.max("score")).first()[0] == 0
    assert automaton.score_texts(frame.where("false")).count() == 0


def test_automaton_keeps_rare_histories_of_large_inputs(spark):
    rows = [(1, "x " * 400_000), (2, "rare pair"), (3, "rare pair"), (4, "rare other")]
    got = {r.doc_id: r for r in automaton.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, v = 400_000 + 6 + 4, 5
    root = {w: (c + 1) / (n + v + 1) for w, c in (("rare", 3), ("pair", 2), ("end", 4))}
    d = automaton.DISCOUNT
    after_end = (3 - d) / 4 + (1 - (3 - d) / 4) * root["rare"]
    after_rare = (2 - d) / 3 + (1 - (2 - d) / 3) * root["pair"]
    after_pair = (2 - d) / 2 + (1 - (2 - d) / 2) * root["end"]
    assert got[2].train_tokens == n
    assert got[2].score == pytest.approx(float(np.log10(after_end * after_rare * after_pair)))


def vectors(spark, dim=64):
    rng = np.random.default_rng(6)
    out = []
    for k in range(60):
        x = rng.normal(size=dim)
        x /= np.linalg.norm(x)
        for c in (1.0, 0.99, 0.95, 0.94, 0.90):
            y = rng.normal(size=dim)
            y -= (y @ x) * x
            out.append((c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)) * rng.uniform(0.1, 9))
    table = [(i, [float(a) for a in v], i % 5 // 5 + (i // 50) % 2) for i, v in enumerate(out)]
    table += [(len(table) + i, v, 0) for i, v in enumerate([table[0][1], table[0][1], None, [], [0.0] * dim, [float("nan")] * dim, [1.0, None], [1e300, 1e300], [1.0, 1.0]])]
    return table + [(len(table), table[0][1], None)]


@pytest.mark.parametrize("bucket", [1024, 3])
def test_cap_filters_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(capfilters, "BUCKET_ROWS", bucket)
    table = vectors(spark)
    frame = spark.createDataFrame([(*r, "s") for r in table], "vec_id long, embedding array<double>, label int, unit string")
    got = {r.vec_id: r for r in capfilters.near_vectors(frame).collect()}
    assert len(got) == len(table)

    def linked(a, b):
        (_, x, k), (_, y, m) = a, b
        if None in (x, y, k, m) or k != m or len(x) != len(y) or not x or None in x or None in y:
            return False
        x, y = np.array(x) / max(map(abs, x)) if any(x) else np.array(x), np.array(y) / max(map(abs, y)) if any(y) else np.array(y)
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            return False
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93

    pairs = [(a[0], b[0]) for i, a in enumerate(table) for b in table[:i] if linked(a, b)]
    degree = Counter(x for p in pairs for x in p)
    assert all(got[i].n_links <= degree[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(pairs) > 100
    assert got[0].n_links >= 3 and all((r.component_id == r.vec_id) == r.kept for r in got.values())


@pytest.mark.parametrize("dim", [64, 128, 384, 768])
def test_cap_filters_recall_in_many_components(dim):
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(2, 200, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    schema = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("filter", pa.int64())])
    reps = np.arange(400)
    batch = pa.RecordBatch.from_arrays([pa.array(reps), pa.array(reps), pa.array([*x.tolist(), *y.tolist()])], names=["rep", "label", "vector"])
    held = [set() for _ in reps]
    for out in capfilters._filters(None, schema)([batch]):
        for rep, found in zip(out.column("rep").to_pylist(), out.column("filter").to_pylist()):
            held[rep].add(found)
    recall = np.mean([bool(held[i] & held[i + 200]) for i in range(200)])
    print(dim, recall, np.mean([len(h) for h in held]))
    assert recall >= 0.95


def test_urls_with_long_rule_paths(spark):
    long = "/" + "x" * 3000
    rules = urls.rules_frame(spark, [("org", "/", "allow"), ("org", long, "block")])
    pages = spark.createDataFrame([(1, f"http://a.org{long}/y"), (2, f"http://a.org{long[:-1]}")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_urls(spark):
    rules = urls.rules_frame(spark, [("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")])
    cases = {
        "http://a.example.org/es/x": ("org/", "example.org/es/", "block"),
        "https://EXAMPLE.org/en/17?q=/es/": (None, "example.org/en/1", "block"),
        "http://example.org/en/2": (None, "org/", "allow"),
        "http://notexample.org/es/": (None, "org/", "allow"),
        "http://example.org": (None, None, "allow"),
        "http://x.com/de/#y": (None, "com/de/", "block"),
        "http://com/fr/": (None, "com/fr/", "allow"),
        "http://x.com/d?/de/": (None, None, "allow"),
        "no url": (None, None, "allow"),
        None: (None, None, "allow"),
        "": (None, None, "allow"),
        "a://b://org/": (None, None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "h", "p")], "page_id long, url string, host string, path string")
    got = urls.judge_urls(pages, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.rule, r.verdict) == list(cases.values())[r.page_id][1:]
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].host, by_id[1].path) == ("example.org", "/en/17") and (by_id[8].host, by_id[8].path) == ("", "")
    assert urls.judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_languages(spark):
    rng = random.Random(1)
    parts = {"aa": ["kal", "mor", "tin", "esh"], "bb": ["üzo", "lüp", "kwa", "jö"], "cc": ["ção", "nha", "mente", "iro"]}

    def text(lang):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40))

    data = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 --- 34", "cc"), (903, text("bb"), None)]
    frame = spark.createDataFrame([(*r, 1.0) for r in data + odd], "doc_id long, text string, lang string, score double")
    model = language.fit_languages(frame, key=F.col("doc_id"), trainable=F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in language.predict_languages(frame, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in data if i % 4 == 0]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[900].ambiguous
    empty = language.fit_languages(frame.where("false"))
    assert {r.lang_pred for r in language.predict_languages(frame, empty).collect()} == {"und"}


def test_quality_learns_from_all_blocks_of_long_texts():
    text = "".join(f"{i:08d}" for i in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1], pa.int32())], names=["text", "label"])
    found = [b for out in quality._sampled_blocks([batch]) for b in out.column("block").to_pylist()]
    assert b"".join(found) == text.encode()


def test_quality(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(20, 200)) for _ in range(150)]
    bad = ["".join(rng.choice("$%&#*!|") * 3 + rng.choice(VOCABULARY) for _ in range(rng.randint(20, 200))) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + ["", None]
    frame = spark.createDataFrame([(i, t, "q", 3) for i, t in enumerate(texts)], "doc_id long, text string, label string, predicted int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(frame, labels, trainable=F.col("id") % 5 != 0)
    got = {r.doc_id: r for r in quality.score_quality(frame, model).collect()}
    assert np.mean([got[i].predicted == 1 - i % 2 for i in range(0, 300, 5)]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[300].score == got[301].score
    one_sided = quality.fit_quality(frame, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score_quality(frame, one_sided).collect()} == {1}
    none = quality.fit_quality(frame, labels.where("false"))
    assert {r.score for r in quality.score_quality(frame, none).collect()} == {0.5}
