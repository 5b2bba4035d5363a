"""The conversation trie against a plain trie built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyweave.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv_ids int, x string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        built[c] = convs.get(family, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        words = len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * words
            leaves[node[:d]] += node not in kids
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((own[0], len(node), parent, len(own), kids[node], leaves[node], saved[node], digest))
    return sorted(map(str, out))


def some_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, 120):
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 30])):
            turn = None if not t and rng.random() < 0.3 else t
            text = rng.choice(["x y", "z", "", None]) if rng.random() < 0.5 else "x"
            rows.append((c, turn, rng.choice(["u", "a", None]), text, 1, "clash"))
    # copies of one long conversation, one that goes on, and one of a single repeated row
    rows += [(1000 + i, t, "u", f"same words {t // 40}", 1, "") for i in range(40) for t in range(90 if i < 2 else 4)]
    rows += [(2000, 7, "u", "again", 1, "")] * 50 + [(None, 0, "u", "no id", 1, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [trie.SIZES, trie.Sizes(conversations=7, turns=40, band=4)])
def test_nodes_match_a_trie_in_memory(spark, sizes, monkeypatch):
    monkeypatch.setattr(trie, "HOT_PARENTS", 4)
    rows = some_turns(3)
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), sizes)
    assert found.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows)


def test_no_turns_give_no_node(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "")], SCHEMA)).count() == 0


def test_a_conversation_that_rebuilds_to_nothing_ends_at_the_root(spark):
    # crc32 of "1" modulo 4 is 3, and there is no conversation 0
    rows = [(1, 0, None, None, 1, "")]
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [str(tuple(r)) for r in found] == brute(rows) and found[0].depth == 0
