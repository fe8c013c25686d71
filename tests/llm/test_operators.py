"""The ten operators against brute-force versions of them on small fixtures."""

import fnmatch
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import decontaminate, language_id, mixing, neighbours, pii, secret_scan, simhash, similar, suffix_dedup, token_count, url_filter
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- 1: repeated passages -----------------------------------------------------------------------


def brute_repeats(rows, length=200):
    seen = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((str(d), len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket", [30, 10_000])
def test_repeats_equal_brute_force(documents, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(20)]
    piece = lambda: rng.choice(base)[rng.randint(0, 60) :][: rng.randint(150, 500)] if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(50))
    rows = [(i, " ".join(piece() for _ in range(rng.randint(1, 6)))) for i in range(90)]
    rows += [(201, "x" * 199), (202, "x" * 200), (203, "y" * 201), (204, "ab" * 400), (None, base[0] * 3), (None, base[0] * 3), (205, rows[0][1]), (205, rows[0][1]), *[r[:2] for r in ODD if r[0] != 6]]
    got = suffix_dedup.remove_repeats(documents(rows)).drop("kept").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


@pytest.mark.parametrize("bits, bucket", [(5, 40), (5, 10_000), (12, 10_000)])
def test_weak_digests_change_nothing(documents, monkeypatch, bits, bucket):
    monkeypatch.setattr(suffix_dedup, "DIGEST_BITS", bits)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(300, 900))) for _ in range(40)]
    rows = [(i, rng.choice(base)[rng.randint(0, 200) :] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 300)))) for i in range(120)]
    got = suffix_dedup.remove_repeats(documents(rows)).drop("kept").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_many_copies_of_one_row_are_fetched_once(documents, spark, monkeypatch):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    df = documents([(7, long)]).crossJoin(spark.range(3000).select(F.col("id").alias("copy"))).unionByName(documents([(8, "-" + long[500:900]), (9, "alone")]).withColumn("copy", F.lit(0)))
    fetched, plain = [], suffix_dedup.Workspace.write
    monkeypatch.setattr(suffix_dedup.Workspace, "write", lambda self, df, name: fetched.append(out.count()) or out if (out := plain(self, df, name)) is not None and name == "fetched" else out)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans): r["count"] for r in suffix_dedup.remove_repeats(df, with_kept=False).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()}
    assert got == {(7, 4000, 4000, 1): 3000, (8, 401, 400, 1): 1, (9, 5, 0, 0): 1} and fetched[0] < 150


def test_repeats_of_nothing(documents):
    assert suffix_dedup.remove_repeats(documents([(1, "short")]).limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(documents([(1, "short")])).first().kept == b"short"


def test_long_texts_are_cut_between_windows(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, a), (2, a[400:2600]), (3, a[::-1])]
    got = suffix_dedup.remove_repeats(documents(rows)).drop("kept").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_multikey_quicksort_equals_sorted(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL", 8)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1500:1900] = data[100:500]
    at = np.arange(len(data) - 200)
    order, same = suffix_dedup.multikey_quicksort(data, at)
    texts = [data[i : i + 200].tobytes() for i in at]
    assert [texts[i] for i in order] == sorted(texts)
    assert same.tolist() == [bool(i) and texts[order[i]] == texts[order[i - 1]] for i in range(len(order))]


# -- 2 and 7: spans -----------------------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_private(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m)]


def brute_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


TOKENS = ["a", "é", "😀", "@", ".", "-", "_", "%", "+", " ", "1", "2", "255", "256", "4111111111111111", "\n", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "5500-0000-0000-0004", "password", "=", ":", '"', "'", "token", "api_key", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef0123456789", "SECRET", "abcdef", "/"]


@pytest.fixture(scope="module")
def tangled():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 30))), f"s{i % 7}") for i in range(1500)]
    return [*rows, (5001, "9" * 60_000, "s1"), (5002, "a." * 30_000, "s1"), (5003, "a@b.co " * 8_000, "s1"), (5003, "a@b.co " * 8_000, "s1"), *[r[:3] for r in ODD]]


def test_private_data_equals_plain_patterns(documents, tangled):
    got = pii.find_personal_data(documents(tangled)).collect()
    base = sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in got)
    assert base == sorted((str(d), brute_private(t or "")) for d, t, _ in tangled)
    for r in got:  # what the method adds is apart from the base
        more = [s for s in r.spans if s.kind == "context"]
        assert [tuple(s) for s in r.spans if s.kind != "context"] == [tuple(s) for s in r.base]
        assert all(m.stop <= b.start or m.start >= b.stop for m in more for b in r.base)


def test_contexts_of_seeds_find_unseen_identifiers(documents):
    rows = [(i, f"please call mobile +1 555 000 {1000 + i} soon") for i in range(30)]
    seeds = [(100 + i, f"my account 4111 1111 1111 1111 is blocked, hotline 10.0.0.{i}") for i in range(20)]
    unseen = [(200, "my hotline 10.0.0.999 rings"), (201, "version 10.0.0.999 rings")]
    spans = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(documents(rows + seeds + unseen[:1]), support=5, belief=0.9).collect()}
    assert spans[200] == ["context"] and spans[100] == ["ip", "card"]


def plain_accepted(edges, support, belief):
    """Rounds over (pattern, instance, seed) in plain Python."""
    of, accepted = {}, set()
    for p, i, seed in edges:
        of.setdefault(p, {})[i] = of.get(p, {}).get(i, False) or seed
    seeds = {i for p, i, seed in edges if seed}
    while True:
        believed = seeds | {i for p in accepted for i in of[p]}
        new = set()
        for p, held in of.items():
            n = sum(held[i] or i in believed - seeds for i in held)
            if p not in accepted and n >= support and n >= belief * len(held):
                new.add(p)
        if not new:
            return accepted
        accepted |= new


@pytest.mark.parametrize("seed", range(3))
def test_pattern_scores_equal_a_plain_graph(spark, seed):
    from tallymark.llm.common import Workspace

    rng = random.Random(seed)
    seeds = {i for i in range(300) if rng.random() < 0.5}
    edges = set()
    for p in range(60):
        pool = [i for i in range(300) if (i in seeds) == (rng.random() < rng.choice([0.5, 0.95, 1.0]))]
        edges |= {(f"p{p}", i, i in seeds) for i in rng.sample(pool, rng.randint(1, 14))}
    df = spark.createDataFrame(sorted(edges), "pattern string, instance long, seed boolean")
    got = {r.pattern for r in pii.accepted_patterns(df, Workspace(spark), 3, 0.7).collect()}
    assert got == plain_accepted(edges, 3, 0.7) and got


def context_spans(documents, rows, **how):
    return {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == "context"] for r in pii.find_personal_data(documents(rows), **how).collect()}


def test_a_pattern_does_not_vouch_for_itself(documents):
    """Eleven seeds and nine others by one word: 55 per cent, now and after any number of rounds."""
    rows = [(i, f"dial 10.0.0.{i}") for i in range(11)] + [(100 + i, f"dial 10.0.0.9{i}9") for i in range(9)]
    assert not any(context_spans(documents, rows).values())


def test_what_is_found_induces_patterns_in_its_turn(documents):
    rows = [(i, f"zzz hotline 10.0.0.{i}") for i in range(120)]
    middle = [(200 + i, f"hotline 10.0.0.9{10 + i} zzz") for i in range(12)]  # no ip; believed by their word
    again = [(300 + i, f"desk 10.0.0.9{10 + i} yyy") for i in range(12)]  # the same under another word, which they induce
    last = [(400, "desk 77-88-99-00 xxx"), (401, "floor 77-88-99-01 xxx"), (402, "mail bob@intranet")]
    got = context_spans(documents, rows + middle + again + last)
    assert got[400] == [(5, 16)] and got[401] == [] and got[402] == [] and all(got[200 + i] and got[300 + i] for i in range(12)) and not any(got[i] for i in range(120))


def test_contexts_have_no_window(documents):
    rows = [(i, f"hotline 10.0.0.{i}") for i in range(40)] + [(100, "hotline" + " " * 300 + "10.0.0.991"), (101, "hotline" + ":" * 99 + "(10.0.0.992)."), (102, "HOTLINE\n-- 555 123 4567"), (103, "hotlinehotline 10.0.0.993"), (104, "hotline 3 10.0.0.994")]
    got = context_spans(documents, rows)
    assert [got[100], got[101], got[102], got[103], got[104]] == [[(307, 317)], [(107, 117)], [(11, 23)], [], []]


@pytest.mark.parametrize("word", ["a", "é" * 5_000])
def test_words_of_any_length_are_contexts(documents, word):
    rows = [(i, f"{word} a{i}@b.co x") for i in range(9)] + [(100, f"{word} bob@intranet x")]
    assert context_spans(documents, rows)[100] == [(len(word) + 1, len(word) + 13)]


def test_texts_with_the_mark_are_split_alike(documents):
    from tallymark.llm.spans import MARK

    rows = [(1, f"{MARK}a@b.co{MARK} and 10.0.0.1{MARK}"), (2, MARK), (3, f"a@b.co{MARK}c@d.co")]
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_personal_data(documents(rows)).collect()}
    assert got == {d: brute_private(t) for d, t in rows}


def test_redaction(documents):
    df = documents([(1, "write a@b.co or call +1 555 123 4567 now"), (2, "nothing"), (3, None), (1, "other text of the same id x@y.zz")])
    out = pii.redact(df, pii.find_personal_data(df))
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == ["None", "nothing", "other text of the same id <email>", "write <email> or call <phone> now"]


def test_secrets_equal_plain_patterns(documents, tangled):
    got = secret_scan.scan_secrets(documents(tangled)).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in got) == sorted((str(d), brute_secrets(t or "")) for d, t, _ in tangled)


def test_owner_frequency_parts_examples_from_live_secrets(documents):
    live, example = "Zx9Kq2Lm8Vb4Nc7Tg1Hd5Wp3", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
    rows = [(i, f"see {example} here", f"s{i}") for i in range(5)] + [(10, f"see {live} here", "s1"), (11, f"also {live}", "s1"), (12, 'token = "copied-secret-1"', "s1"), (13, 'token = "copied-secret-1"', "s2"), (14, 'token = "copied-secret-1"', "s3")]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(documents(rows)).collect()}
    assert [tuple(s) for s in got[10].spans] == [("live", 4, 28)] and [tuple(s) for s in got[11].spans] == [("live", 5, 29)]
    assert got[0].spans == [] and got[12].n_example == 1 and got[12].n_live == 0 and got[10].n_live == 1


def test_tokens_in_many_repositories_of_one_owner_are_examples(documents):
    example, live = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "Zx9Kq2Lm8Vb4Nc7Tg1Hd5Wp3"
    rows = [(i, f"part {i}: see {example} and token = \"pasted-secret-1\" here", "hot") for i in range(40)] + [(100 + i, f"row {i} has {live}", "hot") for i in range(3)]
    rows += [(200, f"again {live[::-1]}", "hot")] * 40  # equal rows are one repository
    got = {r.doc_id: r for r in secret_scan.scan_secrets(documents(rows)).collect()}
    assert [s.kind for s in got[0].spans] == ["assign"] and (got[0].n_example, got[0].n_live) == (1, 0)
    assert [s.kind for s in got[100].spans] == ["live"] and (got[100].n_example, got[100].n_live) == (0, 1) and got[200].n_live == 1


# -- 3: neighbours ------------------------------------------------------------------------------


def brute_nearest(ids, m, q, n=10):
    d = np.sqrt(((m - m[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:n]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_neighbours_have_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(1500, 24)).astype(np.float32)
    m[700:760] = m[5]  # a vector of many rows
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [1.0] * 23 + [float("inf")]), (9006, [1.0] * 23 + [None]), (9007, [1.0] * 7), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>").withColumn("node", F.lit("clash")).withColumn("v", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [*range(0, 1500, 20)]
    found, ids = 0, np.arange(1500)
    for q, rs in got.items():
        want, rs = brute_nearest(ids, m.astype(float), q), sorted(rs)
        assert [r[0] for r in rs] == [*range(1, 11)] and [(r[2], r[1]) for r in rs] == sorted((r[2], r[1]) for r in rs)
        exact = np.sqrt(((m.astype(float) - m[q].astype(float)) ** 2).sum(1))
        assert all(abs(exact[v] - s) < 1e-9 for _, v, s in rs)
        found += len({v for _, v, _ in rs} & {v for v, _ in want})
    assert found >= 0.95 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[700])] == [5, *range(701, 710)]


def test_neighbours_of_few_and_of_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2, 0.0), (2, 1, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_each_length_is_searched_by_itself(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 6)] + [(i, [float(i), 1.0, 2.0]) for i in range(10, 13)] + [(20, [3.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, n=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(10, 1, 11, 1.0), (10, 2, 12, 2.0)]


@pytest.mark.parametrize("tight", [False, True])
def test_recall_over_many_blocks_whatever_the_batches(spark, monkeypatch, tight):
    """More blocks than one order could cover, and a code that most vectors share; batches of Arrow change nothing."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(2000, 16)).astype(np.float32)
    if tight:
        m[500:] = m[500:] * 1e-3 + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    results = []
    for batch in ("10000", "77") if tight else ("77",):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        results.append(sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(q, v) for q in range(0, 2000, 100) for v, _ in brute_nearest(np.arange(2000), m.astype(float), q)}
    assert results[0] == results[-1] and len({(q, v) for q, _, v in results[0]} & want) >= 0.97 * len(want)


# -- 4: decontamination -------------------------------------------------------------------------


def test_leaks_and_paraphrases_are_found_and_clean_documents_left(spark, documents):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, say(rng.randint(16, 60))) for i in range(30)]
    docs, expected = [], set()
    for i, ws in items:
        docs.append((i, " ".join(say(80) + ws + say(150))))
        changed = [w if k % 8 else "altered" for k, w in enumerate(ws)]
        docs.append((100 + i, " ".join([*say(30), *changed, *say(40)]).title()))
        expected |= {(i, i), (100 + i, i)}
    docs += [(200 + k, " ".join(say(300))) for k in range(80)] + [r[:2] for r in ODD if r[0] not in (1, 2, 3, 4, 5, 6, 7)] + [(900, None), (901, "")]
    bench = spark.createDataFrame([(i, " ".join(ws) + ".") for i, ws in items] + [(98, None), (99, "..."), (97, "")], "item_id long, text string")
    df = documents(docs)
    found = decontaminate.leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    left = decontaminate.remove_leaks(df, found)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d[0]) for d in docs if d[0] is None or d[0] >= 200)
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark, documents, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(9)]
    df, bench = documents([(i, "before " * 20 + t + " after" * 9) for i, t in items[:5]]), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(i, i) for i in range(5)}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_leaks(docs, items):
    """Every place of every document against every item, by the table of common subsequences."""
    out = set()
    for d, t in docs:
        text = re.findall(r"\w+", (t or "").lower())
        for i, x in items:
            item, answer = re.findall(r"\w+", x.lower()), decontaminate.answer_of(x)
            span = len(item) + len(item) // 2 + 2
            for s in range(max(1, len(text) - span + 1)):
                near = text[s : s + span]
                covered = plain_lcs(item, near) / len(item) if len(set(item) & set(near)) >= 0.5 * len(set(item)) else 0
                if covered >= 0.8 or covered >= 0.6 and plain_lcs(answer, near) >= 0.8 * len(answer):
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark, documents):
    """Items changed word by word to shares of 1.0 to 0.4, with and without their answers, once or in two places."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(15)) + "? " + " ".join(say(5))) for i in range(12)]
    docs = []

    def worn(ws, share):
        kept = set(rng.sample(range(len(ws)), round(share * len(ws))))
        return [w if k in kept else "altered" for k, w in enumerate(ws)]

    for i, x in items:
        question, answer = (re.findall(r"\w+", part) for part in x.split("?"))
        for share, whole in ((1.0, True), (0.9, False), (0.53, True), (0.53, False), (0.2, True)):
            docs.append((100 * i + len(docs), " ".join(say(40) + worn(question, share) + (answer if whole else say(5)) + say(40))))
        # most of the question in one place, and enough of it with the answer in another
        docs.append((100 * i + len(docs), " ".join(say(10) + worn(question, 0.95) + say(60) + worn(question, 0.55) + answer + say(10))))
    docs += [(9000 + k, " ".join(say(120))) for k in range(20)]
    found = decontaminate.leaks(documents(docs), spark.createDataFrame(items, "item_id long, text string"))
    got, want = {(r.doc_id, r.item_id) for r in found.collect()}, brute_leaks(docs, items)
    assert got == want and len(want) >= 36


def test_a_place_with_less_of_the_item_but_all_of_its_answer_counts(spark, documents):
    item = [f"q{i}" for i in range(30)] + [f"a{i}" for i in range(10)]
    without, with_answer = item[:29] + ["x"] * 11, item[:17] + ["y"] * 13 + item[30:]
    fill = [f"f{i}" for i in range(300)]
    docs = [(1, " ".join(fill[:50] + without + fill[50:200] + with_answer + fill[200:])), (2, " ".join(fill[:50] + without + fill[50:])), (3, " ".join(fill[:50] + with_answer + fill[50:]))]
    found = decontaminate.leaks(documents(docs), spark.createDataFrame([(7, " ".join(item[:30]) + "? " + " ".join(item[30:]))], "item_id long, text string"))
    assert {(r.doc_id, round(r.covered, 3)) for r in found.collect()} == {(1, 0.675), (3, 0.675)}


def test_many_items_cost_one_tokenisation(spark, documents, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(1500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(5000)]
    docs = [(i, "some words before " + t + " and after") for i, t in items[::500]] + [(9000, "nothing of them")]
    calls, plain = [], decontaminate.tokenise
    monkeypatch.setattr(decontaminate, "tokenise", lambda *a: calls.append(1) or plain(*a))
    found = decontaminate.leaks(documents(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i, _ in items[::500]} and len(calls) == 1


def test_groups_and_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 1 << 20)
    rows = [(i, " ".join(f"v{i}x{k}" for k in range(n))) for i, n in enumerate([20] * 300 + [30_000] + [20] * 5)]
    held = list(decontaminate.groups(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text"))
    assert [i for g in held for i in g.ids] == [*range(306)] and len(held) > 3
    assert all(len(b.words) <= decontaminate.WINDOW * decontaminate.BLOCK_ITEMS + 1 for g in held for b in g.blocks)
    assert all(sum(len(ws) for b in g.blocks for j, ws in b.pieces if j == i) == len(g.words[i]) for g in held for i in range(len(g.ids)))


def test_verbatim_items_of_any_length_are_found(spark, documents):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([64, 65, 100, 200, 300, 400, 600, 1000, 2000] * 3)]
    docs = [(i, " ".join(say(rng.randint(0, 200)) + ws + say(rng.randint(0, 200)))) for i, ws in items]
    docs += [(100 + i, " ".join(ws[: len(ws) // 2] + say(300))) for i, ws in items] + [(200 + k, " ".join(say(400))) for k in range(60)]
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.covered for r in decontaminate.leaks(documents(docs), bench).collect()}
    assert found == {(i, i): 1.0 for i, _ in items}


def test_pieces_of_items_hold_all_words_evenly():
    for n in (1, 63, 64, 65, 128, 129, 2000):
        pieces = decontaminate.pieces_of([*range(n)])
        assert sum(pieces, []) == [*range(n)] and max(map(len, pieces)) <= decontaminate.WINDOW and max(map(len, pieces)) - min(map(len, pieces)) <= 1


def test_bit_parallel_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 40))] for _ in range(2))
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for j, y in enumerate(b):
                rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
        assert decontaminate.lcs(decontaminate._masks(a), len(a), b) == rows[-1][-1]


# -- 5: language --------------------------------------------------------------------------------

COMMON = {"en": "the and with from this that have were which their house water night", "de": "der und mit von dieser nicht haben wurde welche ihre haus wasser nacht", "fr": "le et avec dans cette pas avoir leurs maison eau nuit étaient quelle", "es": "el y con desde esta que tienen fueron cual su casa agua noche mañana"}


def language_rows(n=400):
    rng = random.Random(4)
    return [(i, " ".join(rng.choice(COMMON[lang].split()) for _ in range(rng.randint(5, 60))), "s0", lang) for i in range(n) for lang in [rng.choice(list(COMMON))]]


def test_languages_of_held_out_rows(documents):
    import zlib

    rows = language_rows() + [(1000, "12 34 !!", "s0", "en"), *ODD]
    df = documents(rows)
    model = language_id.train(df)
    got = [r for r in language_id.identify(df, model).collect()]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 8}
    truth = {r[0]: r[3] for r in rows if r[0] is not None and 8 <= r[0] < 1000}
    held = [d for d in truth if by[d].held_out]
    assert sum(by[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert by[1000].lang_pred == "und" and by[1000].score == 0 and by[1000].rejected
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.rejected)


def plain_language(model, text):
    """(label, probability) by a loop over the pieces."""
    b = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode())
    line, total, n = b" " + b + b"   ", np.zeros(len(model.labels)), 0
    for i in range(len(b)):
        if line[i + 1] != 32:
            three = int.from_bytes(line[i : i + 3], "little")
            four = int.from_bytes(line[i : i + 4], "little")
            for h in ((three * 2654435761 & 0xFFFFFFFF) >> 18, ((four ^ 0x5BD1E995) * 2246822519 & 0xFFFFFFFF) >> 18):
                total += model.scores[h]
                n += 1
    logits = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    p /= p.sum()
    return model.labels[int(p.argmax())], float(p.max())


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 17])
def test_predictions_equal_a_plain_loop(monkeypatch, part):
    import pyarrow as pa

    monkeypatch.setattr(language_id, "PART", part)
    rng = np.random.default_rng(4)
    model = language_id.LanguageModel(list("abcde"), rng.normal(size=(language_id.BUCKETS, 5)).astype(np.float32), rng.normal(size=5), 0.7, 0.1)
    draw = random.Random(3)
    texts = ["", "a", "é", "12", "x" * 300, *["".join(draw.choice("abcé ß漢 .\n") for _ in range(draw.randint(0, 60))) for _ in range(40)], ""]
    best, score = model.predict(pa.array(texts))
    for t, b, x in zip(texts, best, score, strict=True):
        label, p = plain_language(model, t)
        assert model.labels[b] == label and abs(p - x) < 1e-5


def test_a_very_long_text_is_summed_in_parts():
    import tracemalloc

    import pyarrow as pa

    model = language_id.LanguageModel([f"l{i}" for i in range(60)], np.ones((language_id.BUCKETS, 60), np.float32), np.zeros(60), 1.0, 0.1)
    texts = pa.array(["some words of a text " * 400_000, None, "short"])
    tracemalloc.start()
    model.predict(pa.compute.fill_null(texts, "") if hasattr(pa, "compute") else texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # the text has 8.4 MB; a number for each place and label would be 2 GB


def test_copies_of_a_row_come_to_the_driver_once(documents, spark, monkeypatch):
    rows = language_rows(60)
    df = documents(rows).unionByName(documents([(5000, "the and with from", "s0", "en")]).crossJoin(spark.range(3000).toDF("copy")).drop("copy"))
    fitted, plain = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda features, names, *a: fitted.append(len(features)) or plain(features, names, *a))
    language_id.train(df, sample=30)
    language_id.train(df)
    assert fitted[0] == 30 and fitted[1] < 62


def test_training_survives_steps_that_are_too_long():
    rng = np.random.default_rng(0)
    rows = [(np.arange(50) + 50 * (i % 2), rng.integers(1, 9, 50)) for i in range(40)]
    model = language_id.fit(rows, ["a" if i % 2 else "b" for i in range(40)], rate=1e9)
    assert np.isfinite(model.scores).all()


def test_no_labels_and_no_rows(documents):
    df = documents([(1, "some text", "s0", None)])
    assert language_id.train(df) is None
    r = language_id.identify(df, None).first()
    assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) and language_id.identify(df.limit(0), None).count() == 0


# -- 6: tokens ----------------------------------------------------------------------------------


def test_token_counts_equal_the_library(documents):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = list("abcdeth '.,12é漢😀\n\t\x1c\x85\u3000") + ["<|endoftext|>", "  ", "'ll"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))) for i in range(400)] + [r[:2] for r in ODD]
    got = token_count.count_tokens(documents(rows), path, limit=20).collect()
    want = [(str(d), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for d, t in rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)


def test_remembered_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    merger = token_count.PairMerger([("a", "b"), ("ab", "c")], [])
    assert [merger.count(x) for x in ("abc", "ab", "aab", "abcabc", "q w e r t y abc")] == [1, 1, 2, 2, 13]
    assert len(merger.known) <= 3


# -- 8: near copies -----------------------------------------------------------------------------


def brute_fingerprint(t):
    import xxhash

    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("chunk", [4, 4096])
def test_links_join_what_brute_force_joins(spark, monkeypatch, chunk):
    from tallymark.llm.common import Workspace
    from tallymark.llm.components import components

    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(6)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(6):
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r.u: r.v for r in components(simhash.links(df), Workspace(spark)).collect()}
    want = brute_components(prints)
    groups = lambda label: sorted(sorted(p for p, x in zip(prints, label, strict=True) if x == y) for y in set(label))
    assert groups([got.get(signed(p), signed(p)) for p in prints]) == groups(want)


def test_near_copies_equal_brute_force(documents):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(50)]
    rows = []
    for i in range(40):
        t = [rng.choice(words) for _ in range(rng.randint(1, 300))]
        rows += [(3 * i, " ".join(t)), (3 * i + 1, " ".join(t).upper()), (3 * i + 2, " ".join(t[:-1]))]
    rows = rows[::-1] + [(500, None), (501, ""), (502, "  ")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    least = {x: min(rows[j][0] for j in range(len(rows)) if label[j] == x) for x in set(label)}
    assert got == {d: (f"{p:016x}", least[x]) for (d, _), p, x in zip(rows, prints, label, strict=True)}


def brute_similar(texts, threshold=0.8):
    def cut(t):
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(5, len(words))
        return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    sets, parent = [cut(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a or b) and len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("size", [2000, 16 << 20])
def test_one_of_each_group_of_similar_texts_stays(documents, monkeypatch, size):
    monkeypatch.setattr(similar, "CHUNK_BYTES", size)
    rng = random.Random(12)
    words = ["w%d" % i for i in range(400)]
    rows, number = [], 0
    for _ in range(12):
        t = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 9)):
            rows.append((number, " ".join(t)))
            number += 1
            t = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 60))):
                t[rng.randrange(len(t))] = rng.choice(words)
    rows += [(900, "A b c d"), (901, "a B c d"), (901, "a B c d"), (902, "a b c d e f g h")]
    rng.shuffle(rows)
    rows += [r[:2] for r in ODD if r[0] != 6]
    df = documents(rows)
    kept = similar.keep_one(df)
    assert kept.columns == df.columns
    label = brute_similar([t for _, t in rows])
    least = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    want = sorted(str(rows[min((r for r in range(len(rows)) if label[r] == x), key=least)][0]) for x in set(label))
    assert len(set(label)) < len(rows) - 20
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_short_texts_equal_brute_force(documents):
    """Down to one shingle: words and a word more or less, whose similarity is often exactly 0.8 or just below."""
    rng = random.Random(77)
    rows, number = [], 0
    for _ in range(150):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(1, 14))]
        for more in (0, 1, 2):
            rows.append((number, " ".join([*words, *[f"w{rng.randrange(4000)}" for _ in range(more)]])))
            number += 1
    label = brute_similar([t for _, t in rows])
    want = sorted(min(i for i in range(len(rows)) if label[i] == x) for x in set(label))
    assert sorted(r.doc_id for r in similar.keep_one(documents(rows)).collect()) == want and len(want) < number - 100


@pytest.mark.parametrize("shared, more", [(4, 1), (8, 2), (80, 20), (400, 100)])
def test_bands_and_fingerprints_pass_pairs_of_the_least_similarity(shared, more):
    rng = np.random.default_rng(shared)
    n, bands = 3000 if shared < 100 else 300, []
    for _ in range(n):
        both = rng.integers(0, 1 << 63, shared + more).astype(np.uint64)
        a, b = np.unique(both[:shared]), np.unique(both)
        x, y = similar.bands([a, b])
        bands.append(int((x == y).sum()))
        assert int(np.bitwise_count(similar.sketch(a) ^ similar.sketch(b)).sum()) <= similar.RADIUS
    assert min(bands) > 0 and abs(np.mean(bands) - similar.BANDS * 0.8**similar.ROWS) < 1


def test_near_copies_of_the_pivot_are_not_compared_with_each_other(documents, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:200], f"x{i}", *words[200:]])) for i in range(400)] + [(500 + i, " ".join(rng.sample(words, 300))) for i in range(20)]
    rows += [(600, " ".join([*words[:365], *[f"y{i}" for i in range(35)]])), (601, " ".join([*words[:330], *[f"y{i}" for i in range(70)]]))]
    label = brute_similar([t for _, t in rows])
    want = sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label))
    assert sorted(r.doc_id for r in similar.keep_one(documents(rows)).collect()) == want


def test_all_fingerprints_are_compared_whatever_the_similarity(documents):
    """At a half an index made for 0.8 would keep a third of the pairs from meeting."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(8, 90))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, *[f"z{rng.randrange(10**6)}" for _ in range(len(words) * 4 // 5)]]))]
    label = brute_similar([t for _, t in rows], 0.5)
    want = sorted(min(i for i in range(len(rows)) if label[i] == x) for x in set(label))
    assert sorted(r.doc_id for r in similar.keep_one(documents(rows), threshold=0.5).collect()) == want and len(want) < 140


@pytest.mark.parametrize("chunk, chunks", [(8, 3), (50, 32)])
def test_chunks_of_fingerprints_lose_no_pair(spark, monkeypatch, chunk, chunks):
    """Every two near fingerprints of like sizes are in one block, however the tiles are cut."""
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "CHUNKS", chunks)
    rng, sets = np.random.default_rng(4), [np.zeros(0, np.uint64)]
    for _ in range(80):
        own = rng.integers(0, 1 << 62, rng.integers(1, 70)).astype(np.uint64)
        sets += [np.unique(own[: len(own) - d]) for d in range(min(len(own), 4))]
    prints, sizes = [similar.sketch(s) for s in sets], [len(s) for s in sets]
    nodes = spark.createDataFrame([(i, n, p.tobytes()) for i, (n, p) in enumerate(zip(sizes, prints, strict=True))], "key long, n long, prints binary")
    block = {r.key: r.block for r in similar.blocks(nodes, similar.Workspace(spark)).collect()}
    found = [(i, j) for i in range(len(sets)) for j in range(i) if similar.similarity(sets[i], sets[j]) >= 0.8]
    assert len(found) > 150 and all(i in block and block[i] == block.get(j) for i, j in found)


def test_similar_texts_of_nothing(documents):
    assert similar.keep_one(documents([(1, "a")]).limit(0)).count() == 0


def test_a_large_group_of_copies_costs_no_pairs():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    home = similar._Home(0.8)
    sets = [np.unique(np.concatenate([base[3:], rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for _ in range(2500)]
    prints = np.array([similar.sketch(s) for s in sets])
    calls = []
    plain = similar.similarity
    similar.similarity = lambda a, b: calls.append(1) or plain(a, b)
    try:
        home.add(np.arange(2500), np.array([len(s) for s in sets]), prints, sets)
        out = home.forest()
    finally:
        similar.similarity = plain
    assert len(out[0]) == 2499 and len(calls) < 3 * 2500


# -- 9: mixing ----------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, budget = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing_and_budgets_are_met(documents, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", "c", None, "É", "Z"][: seed + 2])) for i in range(300)] + [(9001, None, "a"), (9002, "x y", "a"), (9002, "x y", "a")]
    got = mixing.mix(documents(rows)).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORDS.findall(t or ""))
    target, taken = brute_targets(size), {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(documents(rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_equal_rows_are_one_step_and_share_evenly(documents, spark):
    rows = [(i, " ".join("w" * (i % 7 + 1)), "a" if i % 3 else None) for i in range(60)]
    df = documents(rows).unionByName(documents([(None, "x y z", "hot")]).crossJoin(spark.range(5000).toDF("copy")).drop("copy"))
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.countDistinct("taken").alias("kinds"), F.count("*").alias("n")).collect()
    held = {r.source: r for r in got}
    assert held["hot"].n == 5000 and held["hot"].kinds == 1 and held["hot"].target - 5000 < held["hot"].taken <= held["hot"].target
    assert all(abs(held[s].taken - held[s].target) <= 1 for s in ("a", None))


def test_carried_columns_come_with_their_rows(documents):
    rows = [(i, " ".join(["w"] * (i % 9)), f"s{i % 2}") for i in range(80)] + [(None, "p q", "s1"), (None, "p q r", "s1"), (3, "other text", "s0")]
    df = documents(rows)
    out = mixing.mix(df, carry=tuple(df.columns))
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str(r[:2]) for r in rows)
    plain = mixing.mix(df)
    assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_mix_of_nothing_and_of_empty_texts(documents):
    assert mixing.mix(documents([(1, "a")]).limit(0)).count() == 0
    assert [(r.size, r.taken) for r in mixing.mix(documents([(1, ""), (2, None)])).collect()] == [(0, 0), (0, 0)]
    assert len(mixing.mix(documents(ODD)).collect()) == len(ODD)


# -- 10: URLs -----------------------------------------------------------------------------------


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.action
    blocked = any(fnmatch.fnmatchcase("." + host, g.host) and fnmatch.fnmatchcase(path, g.path) for g in url_filter.GLOB_RULES)
    return host, path, None, "block" if blocked else "allow"


def test_urls_equal_plain_matching(spark):
    rng = random.Random(7)
    parts = ["http://", "https://", "://", "org", "example", ".", "com", "/", "de", "fr", "es", "en", "1", "?", "#", "ADS", "admin", "cart", ".exe", "é", "x", "notexample.org", "\n", "*"]
    urls = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(2500)]
    urls += [(5000, None), (5001, ""), (5002, "no scheme"), (5003, "http://a.org/" + "x" * 20_000), (5004, "http://example.org/en/12"), (5005, "http://EXAMPLE.org/es/"), (5006, "http://org"), (5007, "http://m.ads.net/"), (5008, "http://a.b://c/de/"), (None, "http://x.com/de/"), (5010, "http://x.com/de/"), (5010, "http://x.com/de/")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter.filter_urls(df).collect())
    assert got == sorted((str(i), h, p, str(r), v) for i, u in urls for h, p, r, v in [brute_verdict(u)])
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_many_globs_over_several_words_equal_fnmatch():
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab*?") for _ in range(n))
    globs = [url_filter.GlobRule("block", make(rng.randint(0, 9)), make(rng.randint(0, 40))) for _ in range(60)]
    automaton = url_filter.Automaton([g.symbols() for g in globs])
    assert automaton.words > 5
    import pyarrow as pa

    hosts, paths = (["".join(rng.choice("ab") for _ in range(rng.randint(0, n))) for _ in range(200)] for n in (6, 30))
    hit = automaton.run(*url_filter.canonical(pa.array(hosts), pa.array(paths)))
    assert hit.tolist() == [[fnmatch.fnmatchcase("." + h, g.host) and fnmatch.fnmatchcase(p, g.path) for g in globs] for h, p in zip(hosts, paths, strict=True)]
