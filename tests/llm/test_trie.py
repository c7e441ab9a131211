"""The prefix trie against a brute-force one, with buckets of all kinds."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from terrane.llm.prefix_trie import NODE_COLUMNS, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if built[c] == p).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def found(df, **how):
    return sorted(tuple(r) for r in prefix_trie(df, **how).select(*NODE_COLUMNS).collect())


def made(seed):
    rnd, rows = random.Random(seed), []
    for c in range(90):
        if rnd.random() < 0.2:
            continue
        base = rnd.choice("xyz") * rnd.randint(0, 3)
        for k in range(rnd.choice([1, 2, 3, 5])):
            text = (base[k] if k < len(base) else rnd.choice("ab")) + " w" * (k % 3)
            rows.append((c, k, "user" if k % 2 == 0 else "bot", text))
    rows += [(40, k, "user", "hot") for k in range(30)]  # one long conversation
    rows += [(c, k, "user", "hot copy") for c in range(100, 112) for k in range(6)]  # a group of copies
    rows += [(7, None, None, None), (7, None, "user", ""), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (7, 3, "bot", "tie"), (None, 1, "user", "nobody's"), (21, 0, "user", "x"), (-5, 0, "user", "minus")]
    return rows


@pytest.mark.parametrize("local_turns", [1, 4, 40, 50_000])
def test_trie_matches_brute_force(spark, local_turns):
    rows = made(local_turns)
    want = [r for r in brute([x for x in rows if x[0] is None or x[0] >= 0])]
    df = spark.createDataFrame([r for r in rows if r[0] is None or r[0] >= 0], SCHEMA)
    assert found(df, local_turns=local_turns) == want


def test_trie_of_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    none_left = [(c, 0, "user", "t") for c in (21, 22, 23)]  # shorter than what they would borrow
    assert found(spark.createDataFrame(none_left, SCHEMA)) == brute(none_left)
    clash = "label string, depth string, tid string, pos string, len string, at string, range string, n string"
    rows = made(3)[:40]
    wide = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], f"{SCHEMA}, {clash}")
    assert found(wide, local_turns=5) == brute(rows)


def test_long_texts_and_many_ends(spark):
    long = "word " * 200_000
    rows = [(c, 0, "user", long) for c in range(0, 10_000, 20)] + [(3, 0, "user", long), (3, 1, None, long)]
    assert found(spark.createDataFrame([(c, t, r, None) for c, t, r, _ in rows[:-2]] + rows[-2:], SCHEMA), local_turns=100) == brute([(c, t, r, None) for c, t, r, _ in rows[:-2]] + rows[-2:])
