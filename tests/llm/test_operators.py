"""Each operator against brute force on small tables, with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trialstats import session
from trialstats.llm import line_dedup, mixing, passages, personal_data, quality, registered, secret_scan, simhash, url_filter
from trialstats.llm.components import connected
from trialstats.llm.decontaminate import contamination, drop_contaminated
from trialstats.llm.exact_dedup import drop_exact_copies, exact_groups, merged
from trialstats.session import removing_stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, cut string, _id string"


def documents(spark, rows):
    """Rows of (id, text[, lang, source]), with extra columns named as operators name theirs."""
    full = [(i, t, *(rest or ("en", "s")), None, "x", "y", "z") for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


ODD = [(None, None), (None, ""), (7, ""), (7, ""), (8, None), (9, "one"), (9, "one"), (10, "x " * 3000)]


def test_exact_groups(spark):
    docs = documents(spark, [(3, "a  b"), (1, "a b"), (2, "a\tb"), (4, " a b"), *ODD])
    got = exact_groups(docs, counters=1).collect()
    by_id = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got if r.doc_id in (1, 2, 3, 4, 8)}
    assert by_id == {1: (1, 3, True), 2: (1, 3, False), 3: (1, 3, False), 4: (4, 1, True), 8: (7, 5, False)}
    assert len(got) == 12 and sum(r.kept for r in got) == 5
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b"), (4, " a b"), (7, ""), (9, "one"), (10, "x " * 3000)]
    assert exact_groups(docs.limit(0)).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(1)
    items = ["hot"] * 400 + ["warm"] * 250 + [str(rng.random()) for _ in range(350)]
    rng.shuffle(items)
    counters: Counter = Counter()
    for at in range(0, len(items), 50):
        counters.update(Counter(items[at : at + 50]))
        counters = merged(counters, 4)
    assert len(counters) <= 4 and {"hot", "warm"} <= set(counters)


def test_connected(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, k) for k in range(501, 560)]
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {n: root(n) for link in links for n in link if link[0] != link[1]}
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == want


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash._TO_LOWER))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("node", [simhash.NODE, 3])
def test_simhash_groups(spark, node):
    rows = list(ODD)
    for k in range(12):
        words = prose(k, 150).split()
        for copy in range(6):
            changed = list(words)
            for _ in range(copy):
                changed[random.Random(k * 10 + copy).randrange(150)] = "New"
            rows.append((100 + k * 10 + copy, " ".join(changed)))
    docs = documents(spark, rows)
    got = simhash.simhash_groups(docs, node=node).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    assert sorted(r.fp % 2**64 for r in got) == sorted(fps)
    part = list(range(len(rows)))
    for _ in range(len(rows)):
        part = [min(part[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(rows))]
    least = defaultdict(list)
    for (i, _), p in zip(rows, part, strict=True):
        least[p].append(i)
    want = sorted((str(i), str(min((x for x in least[p] if x is not None), default=None))) for (i, _), p in zip(rows, part, strict=True))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id} == {int(c) for _, c in want if c != "None"}
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_spark_hash_is_the_contract_hash(spark):
    text = prose(5, 9)
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_walk_of_a_dense_group_spans_it():
    rng = np.random.default_rng(3)
    leaves = np.unique(rng.integers(0, 2**62, 1, dtype=np.uint64) ^ np.bitwise_or(np.uint64(1) << rng.integers(0, 20, 400).astype(np.uint64), np.uint64(1) << rng.integers(0, 20, 400).astype(np.uint64)))
    made = simhash.walk(leaves, np.array([[0, len(leaves), 0, len(leaves), 0]]), 0)
    assert len(made) < len(leaves)
    group = list(range(len(leaves)))
    for _ in leaves:
        for i, j in made:
            group[i] = group[j] = min(group[i], group[j])
    for i, a in enumerate(leaves):
        for j, b in enumerate(leaves):
            if (int(a) ^ int(b)).bit_count() <= 2:
                assert group[i] == group[j]


def test_contamination(spark):
    item, short = prose(1, 30), "Tiny Item"
    docs = documents(spark, [(1, f"{prose(2, 50)}, {item.upper()}! {prose(3, 20)}"), (2, prose(4, 400) + " tiny\nitem é"), (3, "tiny"), *ODD])
    bench = spark.createDataFrame([(1, item, 0), (2, short, 0), (2, None, 0), (None, item, 0), (10, item, 0), (11, "", 0)], "item_id bigint, text string, n_hit int")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(docs, bench).collect()}
    assert got[1] == (100, 30, ["", "1", "10"], True)
    assert got[2] == (403, 2, ["2"], False)
    assert got[3] == (1, 0, [], False) and got[8] == (0, 0, [], False)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 10
    assert contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0


def test_rake_against_numpy(spark):
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 100, (3, 4))
    rows = [(None if a == 2 else f"s{a}", f"l{b}", "0", int(tokens[a, b])) for a in range(3) for b in range(4)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    shares = {"source": [("s0", 0.2), ("s1", 0.5), (None, 0.3), ("none", 0.4)], "lang": [(f"l{b}", 1.0) for b in range(4)]}
    targets = {k: spark.createDataFrame(v, f"{k} string, share double") for k, v in shares.items()}
    got = {(r.source, r.lang): r.mass for r in mixing.rake(cells, targets, tolerance=1e-9).collect()}
    mass = tokens.astype(float)
    for _ in range(200):
        mass *= (np.array([0.2, 0.5, 0.3]) * tokens.sum() / mass.sum(1))[:, None]
        mass *= tokens.sum() / 4 / mass.sum(0)
    for (s, lang), m in got.items():
        assert m == pytest.approx(mass[2 if s is None else int(s[1]), int(lang[1])], rel=1e-5)


def test_rake_runs_few_jobs_per_sweep(spark):
    """Thirty sweeps over contradictory targets, values of three dimensions and nulls: the masses of NumPy, and two Spark jobs per sweep at most."""
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 50, (6, 3, 4)) * (rng.random((6, 3, 4)) < 0.6)
    names = [[None, *range(1, 6)], ["a", None, "c"], [f"t{c}" for c in range(4)]]
    rows = [(names[0][a], names[1][b], names[2][c], int(tokens[a, b, c])) for a in range(6) for b in range(3) for c in range(4)]
    cells = spark.createDataFrame(rows, "source int, lang string, topic string, tokens bigint")
    wants = [rng.random(n) + 0.1 for n in tokens.shape]
    wants[0][2] = 0  # a value without a share
    targets = {
        k: spark.createDataFrame([(v, float(w)) for v, w in zip(names[i], wants[i], strict=True)], f"{k} {'int' if i == 0 else 'string'}, share double")
        for i, k in enumerate(("source", "lang", "topic"))
    }
    spark.sparkContext.setJobGroup("rake", "thirty sweeps")
    fitted = mixing.rake(cells, targets, sweeps=30, tolerance=-1.0)
    spark.sparkContext.setJobGroup("other", "")
    assert fitted.columns == [*cells.columns, "mass"]
    got = {(r.source, r.lang, r.topic): r.mass for r in fitted.collect()}
    mass = tokens.astype(float)
    for _ in range(30):
        for axis, want in enumerate(wants):
            rest = tuple(i for i in range(3) if i != axis)
            live = want * (tokens.sum(rest) > 0)
            sums = mass.sum(rest)
            factor = np.where(sums > 0, live / live.sum() * tokens.sum() / np.where(sums > 0, sums, 1), 0)
            mass *= factor.reshape([-1 if i == axis else 1 for i in range(3)])
    assert len(got) == len(rows)
    for a, b, c in np.ndindex(*tokens.shape):
        assert got[names[0][a], names[1][b], names[2][c]] == pytest.approx(mass[a, b, c], rel=1e-9, abs=1e-12)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rake")) <= 30 * 2 + 60


def test_mixture(spark):
    rows = [(i, prose(i, 20), f"l{i % 3}", f"s{i % 2}" if i % 7 else None) for i in range(400)]
    docs = documents(spark, rows + [(None, None, None, None), (5, "", "l0", "s0")])
    got = mixing.mixture(docs).collect()
    assert len(got) == 402 and all(r.probability == 0 and not r.sampled for r in got if not r.n_tokens)
    assert sum(r.probability * r.n_tokens for r in got) == pytest.approx(0.5 * 8000, rel=1e-6)
    sampled = mixing.sampled_documents(docs)
    assert sampled.columns == [*docs.columns, "mix_weight"]
    assert sampled.count() == sum(r.sampled for r in got)
    assert 2800 < sum(r.n_tokens for r in got if r.sampled) < 5200
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_quality(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", None, "new", 0)], docs.schema))
    judged = quality.judge(docs, labels).join(labels, "doc_id")
    right = judged.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean")).agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.clean: r.kept for r in right.collect()}
    assert kept[True] > 0.99 and kept[False] < 0.15
    assert quality.judge(docs, labels).count() == 1002
    assert quality.judge(docs, labels.limit(0)).filter("NOT kept").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.drop_poor(docs, labels).columns == docs.columns


def test_site_rates_shrink_sparse_sites(spark):
    rows = [("big", "a", 0.9)] * 200 + [("big", "b", 0.1)] * 200 + [("good", "a", 0.05)] * 300 + [("one", None, 1.0)]
    sites, rate = quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): (r.prior + r.s) / (r.strength + r.n) for r in sites.collect()}
    assert got["big", "a"] > 0.85 and got["good", "a"] < 0.1
    assert rate < got["one", None] < 1.0


BITS = ["password = 'hunter22'", "api_key:short", "token=\"abcdefgh\"", "AKIA" + "A1" * 9, "AKIA123", "0" * 23, "deadbeef" * 4, "é✓ secret: Zx9/+=abc", "SECRET:token:abcdefgh"]
MORE = ["me@x.io", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+49 (30) 123-4567.", "+1", "00.000.0255.1", "x@y", "12 " * 9, "DE89 3704 0044 0532 0130 00", "DE88370400440532013000"]


def plain_secrets(t):
    assign = [m for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    access = [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return [("assign", assign), ("access", access), ("hex", [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])]


def plain_luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def plain_personal(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    ip = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) < 256 for p in m[0].split("."))]
    card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(only(m[0])) <= 19 and plain_luhn(only(m[0]))]
    phone = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(only(m[0])) <= 15]
    email = list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t))
    return [("email", email), ("ip", ip), ("card", card), ("phone", phone)]


@pytest.mark.parametrize("which", ["secrets", "personal"])
def test_spans(spark, which):
    bits, plain = (BITS, plain_secrets) if which == "secrets" else (MORE, plain_personal)
    rng = random.Random(6)
    texts = [rng.choice(["", " ", "é "]).join(rng.choices([*bits, "word", "\n", "ü"], k=rng.randint(0, 12))) for _ in range(300)]
    texts += ["a" * 60_000, "1" * 60_000, " ".join(bits) * 300, None, ""]
    docs = documents(spark, list(enumerate(texts)))
    report = (
        secret_scan.report(secret_scan.secrets(docs)) if which == "secrets" else personal_data.report(personal_data.personal_data(docs))
    )
    got = {r.doc_id: r for r in report.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        kinds = plain(t or "")
        spans = sorted((m.start(), k, m.end(), name) for k, (name, found) in enumerate(kinds) for m in found)
        shown = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), t
        for name, found in kinds:
            assert got[i][f"n_{name}"] == len(found)


def test_entropy_and_checksums(spark):
    random_key, words = "q7Zt0LxP4mB9vKc2Rj8W" + "uE5s", "internationalization"
    texts = [f"x {random_key} y", f"x {words} {words.upper()} y", "0123456789" * 3, "see a/long/path/of/many-words here", "A9" * 14]
    got = [r.spans for r in secret_scan.report(secret_scan.secrets(documents(spark, list(enumerate(texts))))).orderBy("doc_id").collect()]
    assert got[0] == "base64_entropy:2:26" and got[1] == "" and got[2] == "hex:0:30" and got[3] == "" and got[4] == ""
    peak = spark.createDataFrame([(random_key,)], "s string").select(
        secret_scan.peak_entropy(F.col("s"), secret_scan.CLASSES["base64_entropy"][1]).alias("e")
    )
    windows = [Counter(random_key[i : i + 20]) for i in range(len(random_key) - 19)]
    assert peak.first().e == pytest.approx(max(-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows))
    text = "IBAN DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00; call +49 30 1234567"
    row = personal_data.personal_data(documents(spark, [(1, text)])).first()
    assert [(s.kind, s.start) for s in row.found] == [("iban", 5), ("phone", text.index("+"))]
    assert row.scores == pytest.approx([1.0, 0.7])


def test_ibans_before_short_words(spark):
    texts = [
        "IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "ES9121000418450200051332 EUR", "BE68 5390 0754 7034 BIC",
        "BE68 5390 0754 7034 ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00 EUR", "ES92 2100 0418 4502 0005 1332 BIC",
    ]
    got = [r.found for r in personal_data.personal_data(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    es = "ES91 2100 0418 4502 0005 1332"
    want = [[es], ["ES9121000418450200051332"], ["BE68 5390 0754 7034"], ["BE68 5390 0754 7034", es], ["DE89 3704 0044 0532 0130 00"], []]
    assert [[s.match for s in found if s.kind == "iban"] for found in got] == want


def test_lines(spark):
    block, notice = [prose(k, 12) for k in range(6)], "All rights reserved, whatever they are, by whoever holds them, for good."
    rows = [(1, "\n".join([prose(20, 9), *block, prose(21, 9)])), (2, "\n".join([prose(22, 9), *block[:3], "", *block[3:], prose(23, 9)]))]
    rows += [(k, f"{prose(k, 30)}\n{notice}\n{prose(k + 500, 30)}") for k in range(30, 130)] + ODD
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in line_dedup.repeated_lines(docs, rare=8).collect()}
    assert got[1].cut == [] and got[2].refs == [1] and got[2].cut == [1, 2, 3, 5, 6, 7]
    assert all(got[k].cut == [] for k in range(30, 130))
    clean = line_dedup.without_repeats(docs, rare=8)
    assert clean.columns == docs.columns
    assert clean.filter("doc_id = 2").first().text.split("\n") == [prose(22, 9), "", prose(23, 9)]
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


def test_common_lines_go_at_every_count(spark):
    header = [f"{prose(40, 6)} one", f"{prose(41, 6)} two", f"{prose(42, 6)} three"]
    notice = prose(43, 20)
    rows = [(k, "\n".join([*header, prose(100 + k, 30), notice, prose(400 + k, 30)])) for k in range(40)]
    # A rare pair beside the common lines does not hide them.
    rows += [(90, f"{prose(500, 30)}\n{prose(501, 30)}"), (91, f"{prose(501, 30)}\n{prose(502, 30)}\n{notice}")]
    for rare in (4, 64):
        got = {r.doc_id: r for r in line_dedup.repeated_lines(documents(spark, rows), rare=rare).collect()}
        assert got[0].cut == [] and got[90].cut == []
        assert all((got[k].cut, got[k].refs) == ([0, 1, 2, 4], [0]) for k in range(1, 40))
        assert (got[91].cut, got[91].refs) == ([0, 2], [0, 90])


def test_patience():
    assert line_dedup.patience("abcde", "abxde") == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert line_dedup.patience("", "a") == [] and line_dedup.rising([3, 1, 2, 5, 4]) == [1, 2, 4]


def test_a_notice_that_stands_twice(spark):
    notice = prose(43, 20)
    other = [f"{prose(600 + k, 5)}" for k in range(12)]
    rows = [(1, "\n".join([other[0], notice, other[1], notice, other[2]])), (2, "\n".join([other[3], notice, other[4], notice, other[5]])), (3, "\n".join([other[6], notice, other[7]]))]
    got = {r.doc_id: r.cut for r in line_dedup.repeated_lines(documents(spark, rows)).collect()}
    assert got == {1: [], 2: [1, 3], 3: [1]}
    assert line_dedup.patience("xnynz", "anbnc") == [(1, 1), (3, 3)]


def test_passages(spark):
    shared = prose(1, 80).split()
    changed = list(shared)
    changed[30], changed[50:51] = "other", []
    rows = [(k, f"{prose(100 + k, 40)} {' '.join(shared)} {prose(200 + k, 30)}") for k in range(5)]
    rows += [(9, f"{prose(300, 20)} {' '.join(changed).upper()} {prose(301, 20)}"), (10, prose(302, 200) + " " + " ".join(shared[:20]))]
    docs = documents(spark, rows + [(None, rows[0][1]), (11, None), (12, ""), (13, "two words")])
    got = {(r.doc_id, r.ref_id): r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {(k, 0) for k in (1, 2, 3, 4, 9)}
    assert all((got[k, 0].from_word, got[k, 0].to_word, got[k, 0].identity) == (40, 120, 1.0) for k in (1, 2, 3, 4))
    assert (got[9, 0].from_word, got[9, 0].to_word) == (20, 99) and 0.9 < got[9, 0].identity < 1
    clean = passages.without_passages(docs)
    assert clean.columns == docs.columns
    assert clean.filter("doc_id = 3").first().text == f"{prose(103, 40)} {prose(203, 30)}"
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_passages_around_a_foreign_middle(spark):
    head, foot = prose(1, 60), prose(2, 60)
    rows = [(1, f"{head} {prose(3, 100)} {foot}"), (2, f"{head} {prose(4, 100)} {foot}"), (3, f"{head} {foot}")]
    long = prose(5, 1000).split()
    rows += [(11, " ".join(long)), (12, " ".join([*long[:350], prose(6, 300), *long[650:]]))]
    got = sorted((r.doc_id, r.from_word, r.to_word, r.ref_id, r.ref_from, r.ref_to) for r in passages.repeated_passages(documents(spark, rows)).collect())
    assert got == [
        (2, 0, 60, 1, 0, 60), (2, 160, 220, 1, 160, 220), (3, 0, 60, 1, 0, 60), (3, 60, 120, 1, 160, 220),
        (12, 0, 350, 11, 0, 350), (12, 650, 1000, 11, 650, 1000),
    ]


def test_passages_whose_seeds_all_lead_elsewhere(spark):
    shared = prose(1, 54).split()
    # Earlier documents hold all seeds of the passage, each of them in a fragment that is too short to count.
    rows = [(k, f"{prose(100 + k, 20)} {' '.join(shared[s : s + 18])} {prose(200 + k, 20)}") for k, s in enumerate(range(0, 37, 4))]
    rows += [(50, f"{prose(300, 30)} {' '.join(shared)} {prose(301, 30)}"), (51, f"{prose(302, 10)} {' '.join(shared)} {prose(303, 10)}")]
    got = [(r.doc_id, r.from_word, r.to_word, r.ref_id, r.ref_from, r.identity) for r in passages.repeated_passages(documents(spark, rows)).collect()]
    assert got == [(51, 10, 64, 50, 30, 1.0)]


def every_fifth_other(words, seed):
    other = prose(seed, len(words)).split()
    return [o if k % 5 == 4 else w for k, (w, o) in enumerate(zip(words, other, strict=True))]


def test_passages_that_differ_in_every_fifth_word(spark):
    """No five words in a row are the same in both."""
    shared = prose(600, 80).split()
    rows = [(1, f"{prose(601, 30)} {' '.join(shared)} {prose(602, 30)}"), (2, f"{prose(603, 20)} {' '.join(every_fifth_other(shared, 604))} {prose(605, 20)}")]
    got = passages.repeated_passages(documents(spark, rows)).collect()
    assert [(r.doc_id, r.from_word, r.to_word, r.ref_id, r.ref_from, r.ref_to) for r in got] == [(2, 20, 99, 1, 30, 109)]
    assert 0.8 <= got[0].identity < 0.82


def test_passages_of_later_documents_whose_seeds_lead_elsewhere(spark):
    """Earlier documents hold every seed in short fragments, and no 25 words in a row are the same in the two later ones."""
    shared = prose(610, 90).split()
    changed = [f"x{k}" if k % 12 == 11 else w for k, w in enumerate(shared)]
    rows = [(k, f"{prose(620 + k, 20)} {' '.join(shared[s : s + 18])} {prose(640 + k, 20)}") for k, s in enumerate(range(0, 73, 4))]
    rows += [(50, f"{prose(660, 30)} {' '.join(shared)} {prose(661, 30)}"), (51, f"{prose(662, 10)} {' '.join(changed)} {prose(663, 10)}")]
    got = passages.repeated_passages(documents(spark, rows)).collect()
    assert [(r.doc_id, r.from_word, r.to_word, r.ref_id, r.ref_from, r.ref_to) for r in got] == [(51, 10, 100, 50, 30, 120)]


def test_passages_of_common_windows_only(spark):
    """More than ``FEW`` documents hold each window of the passage, in another order and with other words between."""
    phrases = [prose(700 + k, 4) for k in range(16)]
    rng = random.Random(5)
    mixed = lambda seed: f"{prose(seed, 3)} " + " ".join(f"{p} {prose(seed + k + 1, 3)}" for k, p in enumerate(rng.sample(phrases, len(phrases))))
    rows = [(k, mixed(1000 + 100 * k)) for k in range(passages.FEW + 4)]
    rows += [(60 + k, f"{prose(9000 + k, 20)} " + " ".join(f"{p} {w}" for p, w in zip(phrases, prose(9100 + k, 16).split(), strict=True))) for k in range(2)]
    got = passages.repeated_passages(documents(spark, rows)).collect()
    assert [(r.doc_id, r.from_word, r.to_word, r.ref_id, r.ref_from, r.ref_to) for r in got] == [(61, 20, 99, 60, 20, 99)]


def test_passages_leave_little_behind(spark):
    """Tables that no plan reads any more go while the passages are looked for: only those of the result stay."""
    words = [f"w{k}" for k in range(90)]
    with removing_stored(spark):
        before = set(session._STORED)
        docs = documents(spark, [(1, " ".join(words)), (2, " ".join(["x", *words]))])
        assert [(r.doc_id, r.ref_id) for r in passages.repeated_passages(docs).collect()] == [(2, 1)]
        left = [c for p in session._STORED if p not in before for c in spark.read.parquet(p).columns]
    assert not {"seed", "win", "words", "short", "keys", "gram"} & set(left)


def test_windows_that_stand_in_two_places(spark):
    """Blocks and buckets find each window that another place has, with its document, its place and the word after it."""
    rng = np.random.default_rng(5)
    texts = {d: rng.integers(0, 9, n).astype(np.uint16) for d, n in ((7, 300), (2, 25), (9, 4000), (4, 1200))}
    had = {7: [{"from_word": 0, "to_word": 250}], 4: [{"from_word": 30, "to_word": 1200}]}
    rows = pd.DataFrame({"doc": list(texts), "short": [t.tobytes() for t in texts.values()], "had": [had.get(d) for d in texts]})
    new = [passages._in_no(had.get(d), len(t)) for d, t in texts.items()]
    blocks = [passages._block(k, rows["doc"].tolist()[s], rows["short"].tolist()[s], new[s]) for k, s in enumerate((slice(0, 2), slice(2, 4)))]
    keys = pd.concat(passages._key_rows(iter(blocks))).sort_values("bucket", kind="stable")
    held = pd.concat(passages._held_rows(iter([keys.iloc[:500], keys.iloc[500:]])))
    asked = [b.assign(held=[[{"bucket": x.bucket, "held": x.held} for x in held[held["block"] == k].itertuples()]]) for k, b in enumerate(blocks)]
    got = set()
    for part in passages._held_windows(iter(asked)):
        hashes = passages._keys_of(part)[0] << np.uint64(20) | passages._of_planes(part["rest"].tolist(), np.uint32)
        columns = [passages._of_planes(part[c].tolist(), kind) for c, kind in (("doc", np.int64), ("at", np.int32), ("info", np.int32))]
        got |= set(zip(hashes.tolist(), *(c.tolist() for c in columns), strict=True))

    grams = {d: passages._mixed(passages._fours(t)).tolist() for d, t in texts.items()}
    often = Counter(g for x in grams.values() for g in x)
    wanted = set()
    for (d, t), no in zip(texts.items(), new, strict=True):
        fresh = [no[i : i + 4].any() for i in range(len(t) - 3)]
        for i, g in enumerate(grams[d]):
            if often[g] > 1:
                after = int(t[i + 4]) + 1 if i + 4 < len(t) else 0
                far = passages.STEP + passages.PIECE
                flags = any(fresh[max(i - 21, 0) : i + 1]) * passages._IN_RUN | any(fresh[max(i - far, 0) : i + far + 1]) * passages._NEAR
                wanted.add((g, d, i, after | flags))
    assert len(wanted) > 500 and got == wanted


def test_places_that_can_give_new_words():
    """A place stays if windows in common span twelve words and a word in no piece lies between the first and the last three that agree."""
    rng = np.random.default_rng(6)
    wanted, rows = [], []
    for k in range(600):
        a, b = rng.integers(0, 64, 500), rng.integers(64, 128, 500)
        n, new = int(rng.integers(4, 40)), int(rng.integers(215, 300))
        at = 240 if k % 2 else 250  # beyond 128 words no window is looked for, within 192 three words are
        b[at : at + n] = a[at : at + n]
        bits = (a << 1).astype(np.uint8)
        bits[new] |= 1
        wanted.append(n >= 12 and at <= new < at + n)
        rows.append((k, 0, 244, 250, 244, 250, bits[52:446].tobytes(), (b << 1).astype(np.uint8)[52:446].tobytes()))
    rows = pd.DataFrame(rows, columns=["doc", "ref", "at", "to_at", "ref_at", "to_ref", "a", "b"])
    got = set(pd.concat(passages._hopeful_rows(iter([rows])))["doc"])
    wanted = set(np.flatnonzero(wanted).tolist())
    assert wanted <= got and len(wanted) > 50 and len(got - wanted) < 20  # by chance three words agree elsewhere


def test_each_piece_has_seventeen_of_twenty_five_words():
    seen = np.zeros(1 << 16, bool)
    for n in range(passages.PIECE, 120):
        a = np.arange(n).astype(np.uint16)
        wrong = n // 5
        for start in range(n - wrong + 1):
            b = a.copy()
            b[start : start + wrong] += 1000
            assert passages._dense(a, b, seen) and not seen.any()
    assert not passages._dense(np.arange(40), np.append(np.arange(15), np.arange(24, 40)), seen)
    assert not passages._dense(np.arange(24), np.arange(24), seen)


def test_short_tables_of_edits():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(1, 30))
        assert passages._short_costs(a.tolist(), b.tolist()) == [row.tolist() for row in passages._costs(a, b)]


def test_edits_and_longest_stretch():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 30)), rng.integers(0, 4, rng.integers(0, 30))
        path = passages.edits(a, b)
        assert (path != passages.ONLY_B).sum() == len(a) and (path != passages.ONLY_A).sum() == len(b)
        if len(a) and len(b) and not (len(a) == len(b) and (a == b).mean() >= passages.IDENTITY):
            assert (path != passages.SAME).sum() == passages.edit_distance(a, b, 30)
        worth = rng.integers(-4, 2, 25)
        s, e = passages._longest(worth)
        assert e - s == max((j - i for i in range(26) for j in range(i, 26) if worth[i:j].sum() >= 0), default=0)


def test_chains_against_all_predecessors():
    rng = np.random.default_rng(7)
    for _ in range(20):
        pairs = np.unique(rng.integers(0, 60, (25, 2)), axis=0)
        at, ref = pairs.T
        score = np.zeros(len(at))
        for i in range(len(at)):
            before = [
                score[j] + min(5, at[i] - at[j], ref[i] - ref[j]) - passages.GAP * (at[i] - at[j] + ref[i] - ref[j])
                for j in range(i) if at[j] < at[i] and ref[j] < ref[i]
            ]
            score[i] = max([5, *before])
        found = passages.chains(at, ref)
        for chain in found:
            assert (np.diff(at[chain]) > 0).all() and (np.diff(ref[chain]) > 0).all()
        assert sum(map(len, found)) <= len(at)
        if score.max() > 5:
            best, gone = found[0], np.diff(np.stack([at, ref])[:, found[0]])
            assert 5 + (np.minimum(5, gone.min(0)) - passages.GAP * gone.sum(0)).sum() == pytest.approx(score.max())
            assert score[best[-1]] == pytest.approx(score.max())


def spans(df):
    return sorted((r.doc_id, r.from_word, r.to_word, r.ref_id, r.ref_from, r.ref_to) for r in df.collect())


def test_passages_of_a_single_pair(spark):
    """One pair of documents in all, in one Arrow batch or in many, and each task with few rows."""
    shared = prose(90, 700)
    docs = documents(spark, [(1, prose(91, 20) + " " + shared), (2, shared + " " + prose(92, 30))])
    wanted = [(2, 0, 700, 1, 20, 720)]
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    had = {k: spark.conf.get(k) for k in settings if k != "spark.sql.adaptive.coalescePartitions.enabled"}
    assert spans(passages.repeated_passages(docs)) == wanted
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert spans(passages.repeated_passages(docs)) == wanted
    finally:
        for k in settings:
            spark.conf.set(k, had[k]) if k in had else spark.conf.unset(k)


def test_passages_of_repeated_ids(spark):
    """A row that is there twice gives each span once; a row with the id and another text loses nothing."""
    shared, other = prose(93, 60), prose(94, 150)
    late = prose(95, 10) + " " + shared
    rows = [(1, shared), (5, late), (5, late), (6, shared)]
    assert spans(passages.repeated_passages(documents(spark, rows))) == [(5, 10, 70, 1, 0, 60), (6, 0, 60, 1, 0, 60)]
    docs = documents(spark, [*rows, (5, other)])
    cut = [(r.doc_id, r.text) for r in passages.without_passages(docs).collect()]
    assert (5, other) in cut and len(cut) == 5
    assert sum(1 for i, t in cut if i == 5 and t in (late, prose(95, 10))) == 2


def test_alignment_along_runs_is_no_better_than_the_best():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a = rng.integers(0, 50, 120).astype(np.int32)
        keep = rng.random(120) > 0.05
        b = np.where(rng.random(120) < 0.05, 99, a)[keep]
        found = np.cumsum(keep) - 1
        at = np.flatnonzero(keep & (np.where(keep, b[np.maximum(found, 0)], -1) == a))
        runs = np.stack([at, found[at], np.ones(len(at), int)], axis=1)
        plain, quick = passages.aligned(a, b, (0, 120), (0, len(b))), passages.aligned(a, b, (0, 120), (0, len(b)), runs)
        assert plain[:4] == quick[:4] and quick[4] <= plain[4] + 1e-12
        assert (quick[4] >= passages.IDENTITY) == (plain[4] >= passages.IDENTITY)


def test_alignment_at_the_edge_of_the_threshold():
    """60 words allow twelve edits: a chain with more does not pass for one of twelve, and twelve words left out do."""
    a = np.arange(60, dtype=np.int32)
    other = a + 1000
    other[:4], other[50:54], other[56:] = a[:4], a[20:24], a[56:]
    assert passages.aligned(a, other, (0, 60), (0, 60), np.array([0, 0, 4, 20, 50, 4, 56, 56, 4]))[4] < 0.8
    left = np.delete(a, range(2, 60, 5))
    assert len(left) == 48 and passages.aligned(a, left, (0, 60), (0, 48))[4] == 0.8


def test_edit_distance_stops_where_more_edits_than_asked_for_are_sure():
    a, b = np.arange(40), np.arange(40) + np.where(np.arange(40) % 3 == 0, 100, 0)
    assert [passages.edit_distance(a, b, most) for most in (0, 5, 13, 14, 40)] == [1, 6, 14, 14, 14]


def test_edit_distance():
    a, b = np.array(list(b"kitten sitting")), np.array(list(b"sitting kitten"))
    assert passages.edit_distance(np.array(list(b"kitten")), np.array(list(b"sitting")), 5) == 3
    assert passages.edit_distance(a, a, 1) == 0 and passages.edit_distance(a, b, 20) == passages.edit_distance(b, a, 20)


def test_url_filter(spark):
    entries = [("bad.example.com", 10, True), ("bad.example.com", 20, False), ("bad.example.com", 30, True), ("example.org", 5, True), ("x.example.net/ads", 7, True), (None, 1, True), ("late.com", None, True)]
    urls = ["https://www.BAD.example.com:80/a", "http://user@a.b.example.org/", "http://x.example.net/ads?q=1", "http://x.example.net/news", "not a url", None]
    rows = [(n, u, t, "k") for n, u in enumerate(urls) for t in (1, 9, 15, 20, 40, None)] * 2
    captures = spark.createDataFrame(rows, "page_id int, url string, fetched_at bigint, key string")
    got = url_filter.filtered(captures, spark.createDataFrame(entries, "key string, ts bigint, listed boolean")).collect()
    assert len(got) == len(rows)
    blocked = {(r.id, r.fetched_at) for r in got if r.blocked}
    assert blocked == {(0, 15), (0, 40), (1, 9), (1, 15), (1, 20), (1, 40), (2, 9), (2, 15), (2, 20), (2, 40)}
    assert {(r.rule, r.valid_from, r.valid_to) for r in got if r.id == 0 and r.blocked} == {("bad.example.com", 10, 20), ("bad.example.com", 30, None)}
    none = spark.createDataFrame([], "key string, ts bigint, listed boolean")
    assert url_filter.filtered(captures, none).filter("blocked").count() == 0
    assert url_filter.filtered(captures.limit(0), none).count() == 0


def test_url_filter_of_paths(spark):
    """Paths of any depth, on the host and on domains above it, against a check of every entry."""
    names = ("example.com", "example.com/a/b", "example.com/ads/", "www.example.com/ads/x", "www.example.com/a", "example.net//", "deep.org/" + "s/" * 40 + "t", "com")
    urls = [
        "http://example.com/a/b/c", "http://example.com/a/bc", "http://www.example.com/ads/x?q=/a/b", "http://www.example.com//ads///x/", "http://x.www.example.com/a#/b",
        "http://example.net", "https://sub.deep.org/" + "s/" * 40 + "t/u", "https://deep.org/" + "s/" * 40, "http://notexample.com/ads", "http://example.com/" + "a/" * 20_000, "http:///a", "", None,
    ]

    def expected(url, listed):
        host, _, path = (url or "").partition("://")[2].split("?")[0].split("#")[0].partition("/")
        steps = [x for x in path.split("/") if x]
        hits = []
        for key in listed:
            name, _, under = key.rstrip("/").partition("/")
            wanted = under.split("/") if under else []
            if host and (host == name or "." in name and host.endswith("." + name)) and steps[: len(wanted)] == wanted:
                hits.append(key.rstrip("/"))
        return len(hits), max(hits, key=lambda k: (len(k), k), default=None)

    captures = spark.createDataFrame([(n, u, 5) for n, u in enumerate(urls)] * 2, "page_id int, url string, fetched_at bigint")
    for listed in (names, names[1:3], names[:1], names[4:]):
        entries = spark.createDataFrame([(k, 1, True) for k in listed], "key string, ts bigint, listed boolean")
        got = url_filter.filtered(captures, entries).collect()
        assert len(got) == 2 * len(urls)
        assert {(r.id, r.n_listed, r.rule) for r in got} == {(n, *expected(u, listed)) for n, u in enumerate(urls)}


def test_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, corpus_pipeline.stored_table(stage(spark, kept, tiny))
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        held = [r.doc_id for r in before.select("doc_id").orderBy("doc_id").collect()]
        assert set(kept.columns) >= set(docs.columns)
        if k == 1:
            first = {}
            for i in held:
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
            assert ids == set(first.values())
        if k == 2:
            fps = {i: plain_fingerprint(texts[i]) for i in held}
            part = {i: i for i in held}
            for _ in range(6):
                part = {i: min(part[j] for j in held if (fps[i] ^ fps[j]).bit_count() <= 2) for i in held}
            assert ids == {i for i in held if part[i] == i}
        if k == 3:
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            windows = set()
            for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect():
                w = words(r.text or "")
                windows |= {tuple(w[s : s + 13]) for s in range(max(1, len(w) - 12)) if w}
            clean = set()
            for i in held:
                w = words(texts[i])
                hit = {p for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
                if not hit or 20 * len(hit) < len(w):
                    clean.add(i)
            assert ids == clean
        assert ids <= set(held)
    assert set(registered.QUERIES) == {f"op{n}_{name}" for n, name in enumerate(("mixing", "passages", "quality", "simhash", "line_dedup", "secrets", "personal_data", "url_filter", "exact_dedup", "decontaminate", "whitening", "bpe", "conversations"), 1)}
