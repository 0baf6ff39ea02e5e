"""The conversation trie and list ranking against brute force."""

import hashlib
import random
import zlib

import pytest

from vectrail.llm import ranking, trie

CONVERSATIONS = "conv_id long, turn int, role string, text string, depth string, c string, k1 string"  # the last three clash with names used inside


def conversations(seed=1, n=140):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 420), n):
        opening = rng.choice(["hello", "hi", "hello", ""])
        for turn in range(rng.randint(1, 7)):
            text = opening if turn == 0 else rng.choice(["yes", "no", "né", "a b", None])
            rows.append((c, turn if turn else None, rng.choice(["user", "user", None]), text))
    rows += [(500 + k, t, "user", f"t{t}") for k in range(40) for t in range(3)]  # a group of equal conversations
    rows += [(700, t, "user", f"line {t}") for t in range(60)] + [(701, 0, "user", "x"), (1403, 0, "user", "y")]
    rows += [(None, 0, "user", "nobody")]
    return [r + ("d", "e", "f") for r in rows]


def brute_trie(rows):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(lender, [])[:h] + own[h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = {}
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in who if rebuilt[c] == node)))
        out[(min(who), len(node))] = (
            min(members[node[:-1]]) if node else None,
            len(who),
            len(children),
            len(leaves),
            saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out, {(r.conv_id, r.depth): (r.enter_at, r.leave_at) for r in rows}


def test_trie_equals_brute_force(spark):
    rows = conversations()
    got, tour = found(trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(5)))
    assert got == brute_trie(rows)
    assert sorted(x for at in tour.values() for x in at) == list(range(1, 2 * len(tour) + 1))  # every place once


def test_trie_of_tiny_ranges_and_many_rounds(spark):
    rows = conversations(seed=2, n=60)
    got, _ = found(trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS), per_task=6, last=3))
    assert got == brute_trie(rows)


def test_conversation_over_several_ranges(spark):
    rows = [(7, t, "user", f"t{t % 3}", "", "", "") for t in range(400)] + [(8, 0, "user", "a", "", "", "")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = trie.numbered_turns(spark.createDataFrame(rows, CONVERSATIONS))
        assert numbered.select("part").distinct().count() > 3
        assert sorted(r.pos for r in numbered.where("conv_id = 7").collect()) == list(range(1, 401))
        got, _ = found(trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert trie.conversation_trie(empty).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", "", "", "")], CONVERSATIONS)
    assert trie.conversation_trie(nobody).count() == 0
    rows = [(3, 1, "user", "same", "", "", "")] * 3 + [(4, 1, "user", "z" * 200_000, "", "", ""), (6, None, None, None, "", "", "")]
    got, _ = found(trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS)))
    assert got == brute_trie(rows)  # repeated rows are turns of their own
    single = [(0, 0, "user", "only", "", "", "")]
    got, _ = found(trie.conversation_trie(spark.createDataFrame(single, CONVERSATIONS)))
    assert got == brute_trie(single)


@pytest.mark.parametrize("per_task, last", [(1 << 18, 1 << 16), (5, 2)])
def test_list_ranking(spark, per_task, last):
    rng = random.Random(3)
    rows, want = [], {}
    for size in (1, 2, 57, 300):
        keys = [(rng.randrange(1 << 40), k) for k in range(size)]
        rng.shuffle(keys)
        total = 0
        for here, after in zip(keys, keys[1:] + [(None, None)]):
            weight = rng.randrange(10)
            total += weight
            want[here] = total
            rows.append((*here, *after, weight))
    links = spark.createDataFrame(rows, "c long, s long, nc long, ns long, w long")
    got = {(r.c, r.s): r.w for r in ranking.rank_list(links, ["w"], per_task, last).collect()}
    assert got == want
    assert ranking.rank_list(links.where("false"), ["w"]).count() == 0
