"""Prefix trie, conversation repair and passage removal against brute force, with nulls, ties, repeats, empty and long texts."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import chat_repair, prefix_trie, relative_lz

SAID = "conv_id long, turn long, role string, text string, pos long, key string, size long, there boolean, kind long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, False, 3) for r in rows], SAID).repartition(5)


def some_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 9_007_199_254_740_993]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["hi", "hi", None, "", " ", "é?", "so. what", "日本。", "\t\n", "done. \n"])))
    rows += [(70, None, "user", "b"), (70, None, "user", "a"), (70, 1, "assistant", "x"), (70, 1, "assistant", "x"), (70, 5, None, None)]
    rows += [(c, t, "user", "same.") for c in range(100, 140) for t in range(3)]
    rows += [(200, t, "user" if t % 2 == 0 else "assistant", f"long {t}. " * 50) for t in range(700)] + [(201, 0, "user", "word " * 200_000)]
    return rows


def in_order(rows):
    """The rows of each conversation by turn, role and text, nulls first in turns and empty elsewhere."""
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(rows)] for c, rows in convs.items()}


def brute_trie(rows):
    convs = in_order([r for r in rows if r[0] is not None])
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (min(of), len(p), min(members[p[:-1]]) if p else None, len(of), children[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(of) if len(rebuilt[c]) == len(p))))
        for p, of in members.items()
    }


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("merged", ["true", "false"])
def test_prefix_trie(spark, merged):
    rows = [r for r in some_rows() if r[0] != 201]
    turns = conversations(spark, [*rows, (None, 0, "user", "in no conversation")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)  # false: a shard for each of 8 ranges
    try:
        out = prefix_trie.prefix_trie(prefix_trie.mixed(prefix_trie.numbered(turns))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r[c] for c in COLUMNS) for r in out} == brute_trie(rows) and len(out) == len(brute_trie(rows))


@pytest.mark.parametrize("shard", [1, 2, 5, 64])
def test_shards_of_any_size_add_up(monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rng = random.Random(shard)
    said = {c: [bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 5))] for c in range(40)}
    shards = list(prefix_trie._shards(iter([prefix_trie.pa.RecordBatch.from_pydict({"c": list(said), "k": list(said.values()), "s": [[1] * len(v) for v in said.values()]})])))
    assert [c for s in shards for c, *_ in s] == list(said) and max(map(len, shards)) <= shard
    counts = collections.Counter()
    for part in shards:
        for node, _, depth, members, _ in prefix_trie.bitmap_nodes([r[1] for r in part]):
            counts[node, depth] += members.bit_count()
    want = collections.Counter(tuple(v[:d]) for v in said.values() for d in range(len(v) + 1))
    assert sorted(counts.values()) == sorted(want.values())


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.mixed(prefix_trie.numbered(conversations(spark, [])))).count() == 0


ROLES = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """The least (cost, audit) by a search over all edits, and the digest of what it leaves."""
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and ROLES.match(roles):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if not any(ROLES.match(roles + t) for t in ("", "a", "ua")):
            continue
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            for letter, price, to in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")) if not gone else ():
                heapq.heappush(heap, (cost + price + 5 * cut, audit + letter, i + 1, roles + (to[:1] or "?"), (*out, f"{to}:{text}")))
        if audit[-2:] != "II":
            for to in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + to[0], (*out, f"{to}:")))
    return best[0], best[1], sha("\n".join(best[2]))


def test_parser_finds_the_cheapest_repair():
    rng = random.Random(1)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "u", "super"]), f"t{i}", rng.random() < 0.15, rng.random() < 0.2) for i in range(rng.randint(0, 5))]
        parser = chat_repair.Parser()
        for row in rows:
            parser.push(*row)
        assert parser.finish() == cheapest(rows), rows


def fold(rows):
    """The cheapest repair by dynamic programming from the last row: each letter leads to one state."""
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    given = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(p):
        return {q: min(p[q], *((c + 5 * n, "I" * n + a) for n, (c, a) in ((1, p[given[q]]), (2, p[given[given[q]]])))) for q in p}

    last = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    for role, _, gone, cut in reversed(rows):
        now = {}
        for q in last:
            ways = [(last[q][0] + 2, "D" + last[q][1])]
            if not gone:
                ways.append((last[given[q]][0] + 1 + 5 * cut, "R" + last[given[q]][1]))
                if role[:1] in follows[q]:
                    ways.append((last[follows[q][role[:1]]][0] + 5 * cut, "K" + last[follows[q][role[:1]]][1]))
            now[q] = min(ways)
        last = inserted(now)
    cost, audit = last[0]
    out, i = [], 0
    for letter in audit:
        turn = "" if not out or out[-1][0][:1] in "sa" else "a"
        if letter == "I":
            out.append(("assistant" if turn else "user", ""))
            continue
        role, text, *_ = rows[i]
        i += 1
        if letter != "D":
            out.append((role if letter == "K" else "assistant" if turn else "user", text))
    return cost, audit, sha("\n".join(f"{a}:{b}" for a, b in out))


def brute_repair(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        own = convs[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, *_ in own if t is not None]
        seen, faults, rows = set(), collections.Counter(), []
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *fold(rows))
    return out


REPAIR = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_chat_repair(spark):
    rows = some_rows() + [(None, 0, "user", "Who?"), (None, 1, "assistant", "You."), (None, 1, "assistant", "You.")]
    rows += [(300 + c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system"]), f"Text {t % 4}{'.' * (c % 2)}") for c in range(60) for t in range(c % 9)]
    got = {r.conv_id: tuple(r[c] for c in REPAIR) for r in chat_repair.repair(chat_repair.damaged(conversations(spark, rows).drop("there", "kind")), F.col("there")).collect()}
    assert got == brute_repair(rows)
    assert (0, 0, 0, 0, 0, 0, "", sha("")) in got.values()  # a conversation all of whose rows are dropped


def test_repair_of_given_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 1, "user", "Hi!"), (1, 4, "assistant", "Hello."), (2, None, None, None), (None, 3, "assistant", "One?")]
    got = {r.conv_id: tuple(r[c] for c in REPAIR) for r in chat_repair.repair(conversations(spark, rows)).collect()}
    assert got[1] == (2, 0, 1, 0, 1, 2, "KKDK", sha("system:Be kind.\nuser:Hi!\nassistant:Hello."))
    assert got[2] == (0, 1, 0, 0, 0, 2, "D", sha(""))
    assert got[None] == (0, 0, 0, 0, 0, 2, "D", sha(""))
    assert chat_repair.repair(conversations(spark, [])).count() == 0


DOCS = "doc_id long, text string, text_key long, start long, marks string, anchor long, kept string, _id long"


def brute_passages(rows, length):
    first, cut = {}, []
    for d, text in rows:
        d = -(2**63) if d is None else d
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        cut.append((d, w))
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, w), (own, _) in zip(cut, rows, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.append((own, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return collections.Counter(out)


def passages(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, "m", 3, "k", 4) for r in rows], DOCS).repartition(7)
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in relative_lz.remove_passages(docs, **options).collect())


def passage_rows():
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, base = words(130), words(260)
    rows = [(None, "null id " + " ".join(passage[:60])), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ab " * 300), (10, "ab " * 90), (11, "ab cd " * 90), (12, "cd ab " * 90)]
    for i in range(30):  # a passage in other surroundings, whole and cut
        a, b = sorted(rng.integers(0, 131, 2))
        rows.append((20 + i, " ".join(words(40) + passage[a:b] + words(30)) + "\n" * (i % 2)))
    for i in range(25):  # near copies: many blocks of the same anchors
        w = list(base)
        for _ in range(i % 4 + 1):
            w[rng.integers(len(w))] = "é" * (i % 3 + 1)
        rows.append((100 + i, "\x0b ".join(w)))
    rows += [(100, " ".join(base))] * 3 + [(130, " ".join(base)), (131, " ".join(base)), (131, " ".join(base[5:])), (132, " ".join(base[:49])), (133, " ".join(base[:50])), (134, "\x00 \x1c\x85 " + " ".join(base[60:130]))]
    return rows


@pytest.mark.parametrize("length, gram", [(50, 16), (8, 3)])
def test_passages(spark, length, gram):
    rows = passage_rows()
    assert passages(spark, rows, length=length, gram=gram) == brute_passages(rows, length)


def test_passages_of_few_words_and_of_none(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), " ".join(rng.choice(["a", "b"], 30))) for i in rng.integers(0, 60, 80)]
    assert passages(spark, rows, length=6, gram=2) == brute_passages(rows, 6)
    assert passages(spark, []) == collections.Counter()


def test_passages_of_very_long_texts(spark):
    rng = np.random.default_rng(4)
    long = [f"{x:x}" for x in rng.integers(0, 1 << 40, 70_000)]
    huge = ["x" * 20_000 + str(i) for i in range(60)]
    rows = [(1, " ".join(long[30_000:30_200])), (2, " ".join(long)), (3, " ".join(huge)), (4, " ".join(huge[3:] + long[100:60_000])), (5, "y" * 1_500_000), (6, "y" * 1_500_000 + " z")]
    assert passages(spark, rows) == brute_passages(rows, 50)


def test_thue_morse_words_are_told_apart(spark):
    word = "a"
    while len(word) < 256:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(word)), (2, " ".join(word.translate(str.maketrans("ab", "ba")))), (3, " ".join(word[64:]))]
    assert passages(spark, rows) == brute_passages(rows, 50)
