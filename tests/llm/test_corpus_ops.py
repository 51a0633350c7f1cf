"""The corpus operators against brute force, on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlake.llm import cap_filters, chat, decontaminate, langid, licenses, packing, queries, secrets, signature_tree, suffix_dedup, tokens, warc
from auditlake.llm.common import row_key
from auditlake.llm.components import components
from auditlake.sources import table as source

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, place long, rank string, token string"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base, passage = words(rng, 300), words(rng, 60)
    out = [base, base, base.replace("a", "A"), None, "", "x", "  \n\t ", passage, "ab " * 4000, "ab " * 100, "é" * 400, "日本語 " * 60, base[7:], passage.upper()]
    for i in range(20):
        w = base.split()
        for _ in range(i):
            w[rng.integers(len(w))] = "zz"
        out += [" ".join(w), words(rng, 30) + " " + passage + " " + words(rng, 40)]
    out += [f'{words(rng, 5)} api_key: "Ab{i % 3}cdefgh" AKIA{"Z9" * 8} {"0a" * 15} token=secret:abcdefgh' for i in range(6)]
    return out


def table(spark, texts):
    rows = [(i, t, None if t is None else "en", f"s{i % 4}", None, i, "r", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_word_ids_equal_the_tokenizer(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = np.random.default_rng(1)
    bits = ["'s", "'re", "'LL", "'", " ", "  ", "\n", "\t", "a", "É", "1", "²", "!", "?!", "\xa0", "日本", "😀", "\r\n", "é", "_", "<|endoftext|>", "\x00", "\x85"]
    some = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(1500)] + [x or "" for x in texts]
    ids, counts = tokens.word_ids(P.path("byte_bpe_50k.tiktoken")).ids(some)
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, e in enumerate(t.encode_batch(some, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomials_modulo_two_to_the_64_confuse(spark, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, counts = tokens.word_ids(P.path("byte_bpe_50k.tiktoken")).encode([f"{a} {b}", b, a])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in t.encode_batch([f"{a} {b}", b, a], add_special_tokens=False)]
    docs = spark.createDataFrame([(1, f"one two {a} three"), (2, f"one two {b} three"), (3, f"one two {a} three")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in signature_tree.near_duplicates(docs, 4, 85).collect()} == {1: 1, 2: 2, 3: 1}
    cut = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    seen, want = set(), {}
    for i, text in ((1, a), (2, b)):
        gone = set()
        for k in range(n - 99):
            gone |= set(range(k, k + 100)) if text[k : k + 100] in seen else set()
            seen.add(text[k : k + 100])
        want[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(cut).collect()} == want


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens.Rolling, "span", lambda self, a, b: (b - a).astype(np.uint64))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, _ = tokens.WordIds(P.path("byte_bpe_50k.tiktoken")).encode(["abc def xyz abc", "zzz"])
    assert ids.tolist() == t.encode("abc def xyz abc").ids + t.encode("zzz").ids


@pytest.mark.parametrize("text", ["boys'”", "d'я", "x '日", "'s", "a'd", "'“"])
def test_word_ids_of_a_last_apostrophe(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for some in ([text], ["other", text]):
        ids, counts = tokens.word_ids(P.path("byte_bpe_50k.tiktoken")).ids(some)
        assert ids[len(ids) - counts[-1] :].tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end, rng = "<|endoftext|>", np.random.default_rng(7)
    bits = [end, end, " ", "a", "'s", "é", "\n", "<|", "endoftext|>", "1", "日本"]
    some = [f"a{end}b", end, end * 3, f" {end} ", "none", "", f"{end}x"] + ["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(500)]
    want = [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
    assert want[0] == [64, 50256, 65]
    ids, counts = tokens.word_ids(P.path("byte_bpe_50k.tiktoken")).encode(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), keep_ids=True).collect()}
    assert got == {i: [*w, 1] for i, w in enumerate(want)}


@pytest.mark.parametrize("max_len", [64, 2048])
def test_packing(spark, texts, max_len):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    placed = packing.pack(table(spark, texts), P.path("byte_bpe_50k.tiktoken"), max_len=max_len, keep_ids=True)
    rows = placed.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32, list(r.ids)) == (at, len(ids), zlib.crc32(part), part.tolist())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_len
    whole = packing.sequences(placed, max_len).collect()
    assert len(whole) == len(by_sequence) and {len(r.input_ids) for r in whole} == {max_len}


def test_packing_of_nothing(spark):
    assert packing.pack(table(spark, ["x"]).limit(0), P.path("byte_bpe_50k.tiktoken")).count() == 0


@pytest.mark.parametrize("wide", [1, 4096])
def test_suffix_dedup(spark, texts, monkeypatch, wide):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    seen = set()
    for i, text in enumerate(texts):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)


def test_suffix_dedup_keeps_repeated_rows_and_blocks_agree(spark, texts, monkeypatch):
    rows = table(spark, ["q" * 50 + words(np.random.default_rng(2), 60)])
    assert {r.n_removed for r in suffix_dedup.remove_repeats(rows.union(rows)).collect()} == {0}
    long = words(np.random.default_rng(3), 3000)
    raw = np.frombuffer(long.encode(), np.uint8)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    pieces = list(suffix_dedup._blocks(np.array([0, len(raw)]), 100))
    starts = [b + s for _, _, b, e in pieces for s in range(e - b - 99)]
    assert starts == list(range(len(raw) - 99))


def test_suffix_dedup_tells_texts_of_an_id_apart(spark):
    abc = words(np.random.default_rng(12), 36)
    rows = [(1, "q" * 99 + abc), (1, "z" * 40 + abc), (0, abc), (None, abc[:120]), (None, abc[:120]), (2, None), (2, "")]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n, none = len(abc), -(2**63)
    assert got == {(1, 99 + n, n): 1, (1, 40 + n, n): 1, (0, n, 120): 1, (none, 120, 0): 2, (2, 0, 0): 2}


def brute_contamination(texts, items):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(ASCII))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - 12, 1)):
            if w:
                windows[tuple(w[i : i + 13])].add(item)
    out = {}
    for i, text in enumerate(texts):
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination(spark, texts):
    passage = texts[7].split()
    items = [(1, " ".join(passage[10:40])), (20, " ".join(passage[30:50]).upper()), (3, "ab"), (4, None), (5, ""), (6, "absent words here"), (7, " ".join(["ab"] * 14))]
    got = decontaminate.contamination(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == brute_contamination(texts, items)


def test_proximity(spark):
    rng = np.random.default_rng(15)
    long = words(rng, 13).split()
    shuffled = [*long[5:], *long[:5]]
    spread = [x for i, w in enumerate(long) for x in ([w, "zz"] if i % 3 == 0 else [w])]
    rows = [
        (1, "one two three"), (2, "three x one y two"), (3, "one " + "x " * 9 + "two three"), (4, " ".join(long)), (5, "zz " * 20 + " ".join(shuffled)), (6, " ".join(spread)),
        (7, " ".join(long[:-1])), (8, "one one two"), (9, " ".join(["yy zz"] * 3 + spread[:9] + ["zz"] * 4 + spread[9:])), (10, None), (11, "one one one two three"), (11, "other text"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "one two three"), (2, " ".join(long)), (3, "one one two three one")]
    phrases = decontaminate.phrases_of(spark.createDataFrame(items, "item_id long, text string"))
    terms = phrases.select(F.explode("words").alias("term"))
    anchors = decontaminate.anchors_of(phrases, decontaminate.term_frequencies(docs, terms))
    index = decontaminate.build_index(docs, anchors)
    ids = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"))
    named = lambda found: {(r.doc_id, " ".join(r["words"])) for r in found.join(ids, "row_key").join(phrases, "phrase").collect()}
    assert named(decontaminate.phrase_matches(docs, index, anchors)) == {(1, items[0][1]), (11, items[0][1]), (4, items[1][1])}
    want = set()
    for i, text in rows:
        w = (text or "").split()
        for _, item in items:
            need = collections.Counter(item.split())
            n = sum(need.values()) + 4
            if any(not need - collections.Counter(w[a : a + n]) for a in range(len(w))):
                want.add((i, item))
    assert named(decontaminate.proximity_matches(docs, index, anchors, 4)) == want and {(2, items[0][1]), (5, items[1][1]), (11, items[2][1])} <= want


def test_contamination_of_odd_tables(spark, texts, monkeypatch):
    passage = texts[7]
    docs = spark.createDataFrame([(1, passage, 0), (1, "other words", 0), (1, passage, 0), (None, passage, 0), (2, None, 0), (3, "x " * 5000 + passage, 0)], "doc_id long, text string, term long")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    want = sorted([(1, 60, 60), (1, 2, 0), (1, 60, 60), (None, 60, 60), (2, 0, 0), (3, 5060, 60)], key=repr)
    for size in (64 << 20, -1):  # -1: nothing is broadcast
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
        got = decontaminate.contamination(docs, items).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in got), key=repr) == want
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}


def test_secrets(spark, texts):
    docs = table(spark, texts)
    scanned = secrets.scan(docs)
    got = {r.doc_id: r for r in secrets.digest(scanned).collect()}
    kinds = [(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("AKIA[A-Z0-9]+", 0, 0, 20), ("[0-9a-f]+", 0, 0, 24)]
    for i, text in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (p, f, g, n) in enumerate(kinds) for m in re.finditer(p, text or "", f) if len(m[g]) >= n)
        written = ",".join(f"{secrets.ORDER[k]}:{a}:{b}" for a, k, b in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
    # The access key has four owners and is an example; the values of single owners are live, and masked.
    masked = {r.doc_id: r.text for r in secrets.mask(docs, scanned).collect()}
    last = len(texts) - 1
    assert "AKIA" in masked[last] and "Ab2cdefgh" not in masked[last] and masked[0] == texts[0] and masked[3] is None


def test_secrets_found_elsewhere(spark):
    value = "Zx81" * 6
    rows = [(1, f'token = "{value}"', "a"), (2, f"see {value} there", "b"), (3, "none", None)]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got == {1: "assign:0:33", 2: "owned:4:28", 3: ""}


def test_secrets_found_elsewhere_whatever_their_form(spark):
    values = ["eyJhbGci.eyJzdWIi.c2ln-x_y", "hunterpass", "a1b2c3", "K9+/x==", "q-q-q-q", "======", "Abc.def/ghi1", "0a" * 16]
    around = ["{}", "see {} there", "AUTH={}", "?key={}&x", "/{}/", "x-{}_{}.", "é😀{}日", "{}\n{}", "a{}", "{}9", "{}-{}", "a.b/c={}+d", "q-{}"]
    rows = [(i, f'password: "{v}"', "a") for i, v in enumerate(values)]
    rows += [(100 + i, " ".join(a.replace("{}", v) for v in values), "b") for i, a in enumerate(around)]
    rows += [(200, None, None), (201, "", None), (None, "then hunterpass", "b"), (300, "hunterpass", "b"), (300, "x hunterpass", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scanned = secrets.scan(docs)
    base = [re.compile(k.pattern) for k in secrets.KINDS]
    want = collections.defaultdict(set)
    for i, text, _ in rows:
        taken = [m.span() for p, k in zip(base, secrets.KINDS, strict=True) for m in p.finditer(text or "") if len(m[k.group]) >= k.least]
        for v in values:
            kind = "[A-Za-z0-9]" if re.search("[A-Za-z0-9]", v) else "[+/_.=-]"
            for a in range(len(text or "")):
                b = a + len(v)
                inside = lambda k: 0 < k < len(text) and re.match(kind, text[k - 1]) and re.match(kind, text[k])  # noqa: B023, E731
                if text[a:b] == v and not inside(a) and not inside(b) and not any(x < b and a < y for x, y in taken):
                    want[i, text].add((a, b))
    key = docs.select("doc_id", "text", row_key("doc_id", "text").alias("row_key"))
    got = {(r.doc_id, r.text): {(s.start, s.end) for s in r.spans if s["rank"] == 3} for r in scanned.drop("doc_id").join(key, "row_key").collect()}
    assert got == {(i, t): want[i, t] for i, t, _ in rows} and all(want[rows[len(values) + i][:2]] for i in (0, 1, 2, 3, 4, 5, 6))
    masked = {r.doc_id: r.text for r in secrets.mask(docs, scanned).collect()}
    assert "hunterpass" not in masked[102] and "eyJ" not in masked[104] and masked[200] is None


def test_secrets_of_rows_that_share_an_id(spark):
    value, rows = "Zx81" * 6, []
    rows = [(1, f'token = "{value}"', "o/a"), (1, f"other text {value}", "o/b"), (1, f'token = "{value}"', "o/a"), (None, f"x{value} {value}", None), (2, "", "o/c"), (2, None, "p/c")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, value long")
    scanned = secrets.scan(docs)
    assert sorted(((r.doc_id, r.spans) for r in secrets.digest(scanned).collect()), key=repr) == sorted([(1, "assign:0:33"), (1, "owned:11:35"), (1, "assign:0:33"), (None, "owned:26:50"), (2, ""), (2, "")], key=repr)
    masked = secrets.mask(docs, scanned)
    assert masked.columns == docs.columns
    assert sorted((r.text for r in masked.collect()), key=repr) == sorted(['[secret]"', "other text [secret]", '[secret]"', f"x{value} [secret]", "", None], key=repr)
    assert secrets.digest(secrets.scan(docs.limit(0))).count() == 0
    owners = secrets.ownership(secrets.candidates(docs)).first()
    assert (owners.n_repos, owners.n_owners, owners.live) == (1, 1, True)


def test_values_that_stand_for_another_are_not_live(spark):
    rows = [(1, "password=example-pass1", "a"), (2, "password=realpass77", "a")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id: [s.live for s in r.spans] for r in got.collect()} == {1: [False], 2: [True]}


def test_words_that_many_owners_have_are_not_live(spark):
    rows = [(1, "password: please", "a"), (2, "would you please come and please stay", "b"), (3, "please", "c"), (4, "token = zq81kk07", "a"), (5, "zq81kk07, please", "b"), (6, "zq81kk07", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scanned = secrets.scan(docs)
    assert {r.doc_id: [(s.start, s["rank"], s.live) for s in r.spans] for r in scanned.collect()} == {1: [(0, 0, False)], 2: [], 3: [], 4: [(0, 0, True)], 5: [(0, 3, True)], 6: [(0, 3, True)]}
    assert {r.doc_id: r.text for r in secrets.mask(docs, scanned).collect()} == {1: rows[0][1], 2: rows[1][1], 3: "please", 4: "[secret]", 5: "[secret], please", 6: "[secret]"}


def test_many_further_places_in_a_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "password: hunter2x", "a"), (2, "日 hunter2x" * n, "a"), (3, "hunter2x", "b")], "doc_id long, text string, source string")
    begun = time.time()
    scanned = secrets.scan(docs)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in scanned.collect()}
    assert got == {1: [(0, 18)], 2: [(10 * i + 2, 10 * i + 10) for i in range(n)], 3: [(0, 8)]}
    assert {r.doc_id: r.text for r in secrets.mask(docs, scanned).collect()} == {1: "[secret]", 2: "日 [secret]" * n, 3: "[secret]"}
    assert time.time() - begun < 120


def test_many_matches_in_a_text(spark):
    n = 100_000
    text = " ".join(f"token=abc{i:07d}" for i in range(n))
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    scanned = secrets.scan(docs)
    spans = scanned.first().spans
    assert [(s.start, s.end) for s in spans] == [(17 * i, 17 * i + 16) for i in range(n)]
    assert secrets.mask(docs, scanned).first().text == " ".join(["[secret]"] * n)


def test_language_id(spark):
    german, english, french, spanish = "der die das und nicht ist ein mit", "the and of that is was for with", "le la les des est dans pour que", "el los las que de una por con"
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(t.split(), 12)), c) for i, (t, c) in enumerate([(german, "de"), (english, "en"), (french, "fr"), (spanish, "es")] * 60)]
    docs = spark.createDataFrame([*rows, (9000, None, "en"), (9001, "123 !?", "en"), (9002, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 4 <> 9 and doc_id < 160"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert all(got[i].lang_pred == c and 0 <= got[i].score <= 1 for i, _, c in rows if i >= 160)
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_sample_of_null_and_shared_ids(spark):
    """A fixed number of each label, whatever the ids; repeated rows count once."""
    rows = [(None, f"text {i}", "de") for i in range(3000)] + [(7, f"words {i}", "en") for i in range(3000)] + [(None, "the same", "fr")] * 2000 + [(1, None, "fr"), (2, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = langid.sample(docs).collect()
    assert collections.Counter(r.lang for r in got) == {"de": 400, "en": 400, "fr": 1}
    assert len({r.text for r in got}) == 801 and sorted(langid.sample(docs).collect()) == sorted(got)


def test_every_label_is_learned(spark):
    rows = [(c * 10 + i, " ".join(f"{chr(97 + c % 26)}{chr(97 + c // 26)}q{w}" for w in range(i, i + 8)), f"l{c:03d}") for c in range(300) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 300
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert sum(got[i] == c for i, _, c in rows) > 850


def test_prediction_against_a_loop(spark, texts):
    """predict() against plain sums over the same weights."""
    docs = spark.createDataFrame([(i, t, ["de", "en", "fr", "es"][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    of = [langid.FAMILY_OF.get(code, code) for code in model.languages]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        raw = bytes(c | 32 if 65 <= c <= 90 else c for c in text.encode())
        raw = b" " + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in raw) + b" "
        counts = collections.Counter()
        for k in range(1, 4):
            for a in range(len(raw) - k):
                counts[((int.from_bytes(raw[a : a + k + 1], "big") * 2654435761 + k * 40503) % 2**32) >> 19] += 1
        total = sum(counts.values())
        x = {c: (n / total) ** 0.5 for c, n in counts.items()}
        margin = lambda w: sum(v * float(w[c]) for c, v in x.items()) + float(w[-1])  # noqa: B023, E731
        sure = lambda m: 1 / (1 + np.exp(-4 * m))
        each = [sure(margin(w)) for w in model.family_weights]
        family = int(np.argmax(each))
        members = [n for n, f in enumerate(of) if f == model.families[family]]
        votes = dict.fromkeys(members, 0.0)
        for a, b, w in model.pairs.get(family, []):
            votes[a] += sure(margin(w))
            votes[b] += 1 - sure(margin(w))
        best = max(votes.values())
        score = each[family] / sum(each) * (best / (len(members) - 1) if len(members) > 1 else 1)
        near = [m for m in members if abs(votes[m] - best) < 1e-3]
        assert got[i].lang_pred in {model.languages[m] for m in near} or sorted(each)[-1] - sorted(each)[-2] < 1e-3
        if len(near) == 1:
            assert abs(got[i].score - score) < 2e-3


def test_language_id_of_held_out_documents(spark):
    """The registered query's answers on documents that it wasn't fitted on."""
    folder = "/root/testdata/sf0.01"
    labels = source(spark, folder, "documents").select(F.col("doc_id"), "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held"))
    rows = queries.op5_language_id(spark, folder).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held and r.lang is not None and r.lang_pred != "und"]
    assert all(r.held == r.held_out and 0 <= r.score <= 1 for r in rows) and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/ b", big), (2, None, big), (5, "u", big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", "x" * 999), (8, "u", "x" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, manifest = warc.write_archives(pages, roll=200)
    got = {r.page_id: r for r in warc.read_archives(spark, folder, manifest).collect()}
    for page, _, html in rows:
        b = (html or "").encode()
        r = got[page]
        revisit = page in (1, 2)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)
        assert r.payload == (None if revisit else b)
    again = warc.write_archives(pages.repartition(3), roll=200)[1]
    assert sorted(r.sha1 for r in manifest.collect()) == sorted(r.sha1 for r in again.collect())
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_warc_shards_follow_from_the_pages_alone(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_SHARD", 200_000)
    html = F.repeat(F.sha2((F.col("id") % 15_000).cast("string"), 256), 20)
    url = F.concat(F.lit("http://x/"), F.col("id"))
    pages = spark.range(20_000).select((F.col("id") * 37 % 20_011).alias("page_id"), url.alias("url"), html.alias("html"), F.lit(1).alias("shard"))
    folder, manifest = warc.write_archives(pages)
    again = warc.write_archives(pages.repartition(13))[1]
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect())) and manifest.count() > 50
    read = warc.read_archives(spark, folder, manifest)
    assert read.rdd.getNumPartitions() == manifest.count() and read.where("record_type = 'revisit'").count() == 5000
    # A third of the rows without an id, a third with one and the same: dealt to several shards, judged by payload.
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    hot = spark.range(6000).select(key.alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html"))
    folder, manifest = warc.write_archives(hot)
    got = warc.read_archives(spark, folder, manifest)
    assert got.count() == 6000 and manifest.count() > 10 and got.where("page_id is null").agg(F.count("refers_to"), F.count(F.lit(1))).first() == (0, 2000)
    folder, manifest = warc.write_archives(hot.limit(0))
    assert warc.read_archives(spark, folder, manifest).count() == 0


def test_licenses(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    rows = [(1, mit.lower()), (2, "x y\n  released under the MIT license \nz"), (3, None), (4, ""), (5, "licensed under nothing at all"), (6, mit.replace("Software", "Program"))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    grams = lambda t: set(zip(licenses.normalised(t), licenses.normalised(t)[1:], strict=False))
    for i, text in rows:
        units = {u for u in [text, *(text or "").split("\n")] if u}
        best = max((dice(grams(u), grams(t)) for u in units for _, t in licenses.TEMPLATES if grams(u)), default=0)
        assert got[i].dice == (round(best, 6) if 100 * best >= licenses.PERCENT else None)
    assert got[1].license == got[2].license == "MIT" and got[5].license is None


def test_licenses_inside_other_text(spark, monkeypatch):
    rng, full = np.random.default_rng(8), {n: t for n, t in licenses.TEMPLATES if len(t) > 200}
    wrap = lambda t, n, before="", end="\n": end.join(before + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    paragraphs = lambda t, gap: t.replace(". ", "." + gap)
    prose = lambda n: words(rng, n)
    rows, want = [], {}

    def add(text, license, n=1, dice=1.0):
        rows.append((len(rows), text))
        want[len(want)] = (license, dice if license else None, n)

    for name, text in full.items():
        for gap in ("\n\n", "\r\n\r\n", "\n \t\n"):
            add(f"{prose(700)}\n\n{paragraphs(text, gap)}\n\n{prose(900)}", name)
        for n in (0, 450, 499, 500, 501):
            add(f"{prose(n)}\n{wrap(text, 9, '# ')}\n{prose(60)}", name)
        add(f"{prose(40)}\r\n{wrap(text, 11, ' * ', chr(13) + chr(10))}\r\n{prose(80)}", name)
        add(f"{prose(300)} {text} {prose(300)} {text} {prose(3)}", name)
    add(f"{prose(12)} released under the MIT license {prose(12)}", "MIT")
    add(f"{prose(12)} released under the MIT license {prose(12)} licensed under CC BY 4.0 {prose(12)}", "CC-BY-4.0", 2)
    add(f"{prose(12)} released under nothing {prose(12)} the MIT license", None, 0)
    add("\n".join([prose(300), full["MIT"], prose(300)] * 2), "MIT")
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (-1, None), (-2, "")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.dice, r.n_matches) for r in licenses.scan(docs).collect()}
    assert got == {**want, None: want[0], -1: (None, None, 0), -2: (None, None, 0)}
    monkeypatch.setattr(licenses, "BLOCK_WORDS", 37)
    assert got == {r.doc_id: (r.license, r.dice, r.n_matches) for r in licenses.scan(docs).collect()}


@pytest.mark.parametrize(("kind", "block"), [("double", 2048), ("float", 16)])
def test_near_vectors(spark, monkeypatch, kind, block):
    monkeypatch.setattr(cap_filters, "BLOCK", block)  # 16: directions come as pairs of blocks
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 32))
    rows = [*base, *(b + 0.05 * rng.normal(size=32) for b in base[:30]), *base[:5], *([base[0] * 3] * 40)]
    v = [(i, [float(x) for x in r], i) for i, r in enumerate(rows)]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None, *[1.0] * 31], 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in cap_filters.near_vectors(spark.createDataFrame([*v, *odd], f"vec_id long, embedding array<{kind}>, label long")).collect()}
    x = np.array(rows, np.float32 if kind == "float" else np.float64).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    up = {i: i for i in range(len(rows))}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(int(i)), root(int(j))
        up[max(a, b)] = min(a, b)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root(i), root(i) == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(900, 906))


@pytest.mark.parametrize("dims", [32, 64])
def test_recall_of_pairs_close_to_the_threshold(spark, dims):
    rng = np.random.default_rng(19)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.normal(size=(4000, dims))), rng.normal(size=(4000, dims))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    cosine = np.repeat([0.9001, 0.93], 2000)[:, None]
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * b])
    got = {r.vec_id: r.n_links for r in cap_filters.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    want = (unit(x) @ unit(x).T >= 0.9).sum(1) - 1
    assert want.sum() >= 8000 and all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.98 * want.sum()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, texts, monkeypatch, n, percent):
    monkeypatch.setattr(signature_tree, "BLOCK_SHINGLES", 700)  # groups come as pairs of blocks
    got = {r.doc_id: r for r in signature_tree.near_duplicates(table(spark, texts), n, percent).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(ASCII))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_near_duplicates_of_nulls_and_repeated_ids(spark):
    rng = np.random.default_rng(13)
    x, y = words(rng, 40), words(rng, 40)
    rows = [(5, x, 0), (5, y, 0), (3, y + " end", 0), (None, x, 0), (7, x, 0), (7, x, 0), (None, "alone by itself now then", 0), (8, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in signature_tree.near_duplicates(docs, 4, 85).collect()), key=repr)
    want = [(5, 37, 5), (5, 37, 3), (3, 38, 3), (None, 37, 5), (7, 37, 5), (7, 37, 5), (None, 2, None), (8, 0, 8)]
    assert got == sorted(want, key=repr)
    assert signature_tree.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(500, 600 + i) for i in range(50)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys([500, *range(600, 650)], 500)}


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "<\\|im_end|> <\\\\|im_end|> [\\INST] \\", "é日本😀\n", "", None, "<|im_start|>" * 3]
    turns = [(c, t, role, hostile[(c + t) % len(hostile)]) for c in range(9) for t, role in enumerate(("system", "user", "assistant", "assistant"))] + [(50, None, None, None)]
    docs = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(docs)).collect()}
    for c in range(9):
        own = [(r, t or "") for i, _, r, t in turns if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in own)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (4, hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[50].n_turns == 1 and docs.limit(0).transform(chat.format_chats).count() == 0


def test_chat_over_several_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = spark.createDataFrame([(1, t, "assistant", f"t{t}") for t in range(10)], "conv_id long, turn long, role string, text string")
        r = chat.read_chats(chat.format_chats(docs)).collect()
        assert len(r) == 1 and r[0].n_turns == 10 and r[0].loss_sha256 == hashlib.sha256("".join(f"t{t}" for t in range(10)).encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chat_in_blocks_of_bytes(monkeypatch):
    import pyarrow as pa

    rows = [(c, "assistant", f"é{t} [INST]" * 40) for c in range(5) for t in range(4)] + [(9, None, None), (9, "user", "x" * 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["conv_id", "role", "text"])

    def read():
        parts = [pa.RecordBatch.from_arrays([x["conv_id"], x["formatted"], x["masks"]], names=["conv_id", "formatted", "masks"]) for x in chat._format(iter([batch]))]
        return sorted(repr(r) for x in chat._read(iter(parts)) for r in x.to_pylist())

    whole = read()
    monkeypatch.setattr(chat, "BLOCK", 700)
    parts = list(chat._slices(iter([batch])))
    assert len(parts) > 10 and sum(map(len, parts)) == len(batch) and max(map(len, parts)) > 1
    assert read() == whole and len(whole) == 6


def test_vectors_without_id(spark):
    v = np.random.default_rng(3).normal(size=32)
    rows = [(i, (v + d).tolist()) for i, d in ((1, 0.0), (None, 1e-6), (None, 2e-6), (2, 3e-6))] + [(3, None)]
    got = sorted(map(tuple, cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, False), (None, 0, None, False)], key=repr)


def test_pipeline(spark, texts, tmp_path):
    """All rows of run(), with repeated, null and shared ids, against loops over Python lists."""
    import corpus_pipeline

    rng = np.random.default_rng(17)
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 4}", len(t or ""), 7) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, words(rng, 50), "en", "s1", 0, 7), (None, texts[20] + " end", "de", "s2", 0, 7), (20, words(rng, 60), "en", "s3", 0, 7), (None, "123 !", "en", "s1", 5, 7)]
    rows += [(900 + i, f"{words(rng, 30)} password={v}", "en", s, 0, 7) for i, (v, s) in enumerate([("hunter22", "a"), ("hunter22", "b"), ("common77", "a"), ("common77", "b"), ("common77", "c")])]
    rows += [(920, f"{words(rng, 30)} password: please {words(rng, 9)}", "en", "a", 0, 7), *((921 + i, f"{words(rng, 30)} please {words(rng, 9)}", "en", f"p{i}", 0, 7) for i in range(3))]
    rows += [(910, f"{words(rng, 30)} then hunter22 {words(rng, 10)}", "en", "b", 0, 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(texts[7].split()[10:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    distinct = list({r[1]: None for r in rows})
    got = langid.predict(spark.createDataFrame(list(enumerate(distinct)), "doc_id long, text string"), langid.fit(docs)).collect()
    named = {distinct[r.doc_id]: r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE for r in got}
    kept = [r for r in rows if named[r[1]]]

    sets = []
    for r in kept:
        w = re.findall(r"[^\x20\x09-\x0d]+", r[1].translate(ASCII))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    up = list(range(len(kept)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    key = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", row_key("doc_id", "text").alias("k")).collect()}
    groups = collections.defaultdict(list)
    for i, r in enumerate(kept):
        groups[root(i)].append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0, key[r[:2]])) for g in groups.values()]
    bad = brute_contamination([r[1] for r in kept], [(1, item)])
    kept = [r for i, r in enumerate(kept) if not bad[i][4]]

    found = collections.defaultdict(set)
    for r in kept:
        for k in secrets.KINDS:
            for m in re.finditer(k.pattern, r[1]):
                if len(m[k.group]) >= k.least:
                    found[m[k.group]].add(r[3])
    live = {v for v, owners in found.items() if len(owners) <= 2}

    def places(text, v):
        spans = [m.span() for k in secrets.KINDS for m in re.finditer(k.pattern, text) if len(m[k.group]) >= k.least]
        at = [m.start() for m in re.finditer(rf"(?<![A-Za-z0-9])(?={re.escape(v)}(?![A-Za-z0-9]))", text)]
        return [(x, x + len(v)) for x in at if not any(a < x + len(v) and x < b for a, b in spans)]

    live = {v for v in live if len(found[v] | {r[3] for r in kept if places(r[1], v)}) <= 2}
    assert "hunter22" in live and "please" in found and "please" not in live

    def masked(text):
        hidden = [m.span() for k in secrets.KINDS for m in re.finditer(k.pattern, text) if m[k.group] in live]
        hidden += [x for v in live for x in places(text, v)]
        out, at = "", 0
        for a, b in sorted(hidden):
            if b > at:
                out += text[at : max(a, at)] + ("" if a < at else "[secret]")
                at = b
        return out + text[at:]

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in kept:
        ids = np.array([*t.encode(masked(r[1]), add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[r[0], start, len(part), zlib.crc32(part), len(ids)] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    assert {900, 901, 902, 903, 904, 910} <= {r.doc_id for r in out} and masked(rows[-1][1]).count("[secret]") == 1
    after = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, after, str(tmp_path)), "stage")
        assert after.columns == docs.columns
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_very_long_texts_in_blocks():
    """Ids and features of texts that are worked on in several blocks."""
    rng = np.random.default_rng(9)
    long = " ".join("".join(rng.choice(list("abcdé日'1 \n"), rng.integers(1, 12))) for _ in range(45_000))
    assert len(long) > 4 * tokens.BLOCK_CHARS
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, counts = tokens.word_ids(P.path("byte_bpe_50k.tiktoken")).encode(["ab", long, "", "cd " + long])
    want = [t.encode(x, add_special_tokens=False).ids for x in ("ab", long, "", "cd " + long)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    raw = np.frombuffer(long.encode(), np.uint8)
    assert len(raw) > 2 * langid.BLOCK
    whole = langid.features(raw, np.array([0, len(raw)]))
    before, langid.BLOCK = langid.BLOCK, 1 << 30
    try:
        assert np.array_equal(whole, langid.features(raw, np.array([0, len(raw)])))
    finally:
        langid.BLOCK = before
