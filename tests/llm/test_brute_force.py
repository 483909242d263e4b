"""The operators against plain Python."""

import collections
import hashlib
import itertools
import math
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hedgerow.llm import common, jump_sharding, line_dedup, lm_scoring, pii, quality_rules, simhash_dedup, simhash_similar, tool_calls, toxicity, vantage
from hedgerow.llm import queries as Q
from hedgerow.llm import sentencepiece_sampling as S

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize(("name", "sql"), [("op4_tool_calls", tool_calls.ORACLE_SQL), ("op8_line_dedup", line_dedup.ORACLE_SQL)])
def test_sql(spark, name, sql):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    relation = c.sql(sql)
    dicts = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    theirs = sorted(tuple(str(d[k]) for k in sorted(d)) for d in dicts)
    df = Q.QUERIES[name](spark, DATA)
    assert sorted(tuple(str(r[k]) for k in sorted(df.columns)) for r in df.collect()) == theirs


def test_base_scores(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*WORD.findall("".join(c.lower() if c.isascii() else c for c in t)), None] for i, t in texts.items()}
    counts = collections.Counter(x for i, ws in tokens.items() if not held[i] for x in ws)
    n, v = sum(counts.values()), len(counts)
    got = Q.op1_lm_scoring(spark, DATA).collect()
    gain = []
    for r in got:
        ws = tokens[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / len(ws))
    assert np.mean(gain) > 0.05


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(50, lm_scoring.CLASSES)).astype(np.float32)
    rows, prior = rng.integers(0, 50, (4, 7)).astype(np.int32), np.zeros(lm_scoring.CLASSES, np.float32)
    total = sum(np.exp(lm_scoring.log_probability(table, rows, prior, np.full(7, c))) for c in range(lm_scoring.CLASSES))
    assert total == pytest.approx(np.ones(7), abs=1e-4)


def test_quality_counts(spark, texts):
    for r in Q.op2_quality_rules(spark, DATA).collect():
        w = WORD.findall(texts[r["doc_id"]])
        seen = collections.defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in texts[r["doc_id"]].split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[r["doc_id"]])), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_expectation_maximisation(spark):
    rules = tuple(quality_rules.Rule(f"r{i}", "", "") for i in range(3))
    rows = [(-1, -1, 0, 10), (1, 1, 1, 70), (1, 0, 1, 15), (-1, 1, -1, 5)]
    patterns = spark.createDataFrame(rows, "v_r0 int, v_r1 int, v_r2 int, n long")
    got = quality_rules.estimate(patterns, rules, rounds=5)
    good, given = quality_rules.PRIOR_GOOD, [(quality_rules.BAD_FIRST, quality_rules.GOOD_FIRST)] * 3
    for _ in range(5):
        sums, n_good = [[[0.0] * 3, [0.0] * 3] for _ in rules], 0.0
        for *votes, n in rows:
            b, g = 1 - good, good
            for v, (bad, ok) in zip(votes, given, strict=True):
                b, g = b * bad[v + 1], g * ok[v + 1]
            p = g / (b + g)
            n_good += p * n
            for j, v in enumerate(votes):
                sums[j][0][v + 1] += (1 - p) * n
                sums[j][1][v + 1] += p * n
        s = quality_rules.SMOOTH
        good = (n_good + s * quality_rules.PRIOR_GOOD) / (100 + s)
        given = [tuple(tuple((x + s * q) / (sum(own) + s) for x, q in zip(own, first, strict=True)) for own, first in zip(pair, (quality_rules.BAD_FIRST, quality_rules.GOOD_FIRST), strict=True)) for pair in sums]
    assert got.good == pytest.approx(good)
    assert np.array(got.given) == pytest.approx(np.array(given))


def luhn(digits):
    r = [int(c) for c in digits[::-1]]
    return sum(r[0::2] + [2 * v - 9 * (v > 4) for v in r[1::2]]) % 10 == 0


def entities(t):
    found = []
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        found += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t) if good(m[0])]
    return ",".join(found)


def test_personal_data(spark, texts):
    odd = ["a@b.c_x@d.e and 1.2.3.4.5.6.7.8 +1 (555) 123-4567 x", "4111 1111 1111 1111, 256.1.1.1 0.0.0.255 00001.2.3.4", "é a.b@c.d.e- +12 345 678 9..", "x@y@z.w +1+1234567890", "5555-5555 5555-4444 " * 700]
    every = texts | {10_000 + i: t for i, t in enumerate(odd)}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    for r in pii.detect(df).collect():
        own = entities(every[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert r["spans"].startswith(own)


def test_disclosing_terms(spark):
    rows = [(i, f"{'w' * (i % 7 + 4)} quokka contact bob@x.org about zebra{'abcdefg'[i % 7]} matters") for i in range(6)]
    rows += [(100 + i, f"contact someone about matters number {'klmnopqr'[i % 8] * 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.detect(df).collect()}
    text = rows[0][1]
    terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[0]["spans"].split(",")) if k == "term"]
    assert "quokka" in terms and "contact" not in terms and "matters" not in terms
    assert found[100]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert "[EMAIL]" in clean[0] and "bob@x.org" not in clean[0] and "quokka" not in clean[0] and clean[100] == rows[6][1]


def test_terms_of_unique_entities(spark):
    """A term is read from the whole text, for an entity that occurs once, and marked wherever it occurs."""
    filler = " ".join(["contact someone about matters"] * 20)
    rows = [(0, f"Wu {filler} quokka {filler} mail ann@x.org {filler} quokka"), (1, f"a quokka {filler}")]
    rows += [(100 + i, f"{filler} number {i}") for i in range(1500)]
    rows += [(5000 + i, f"{filler} mail {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.detect(df).collect()}

    def terms(i):
        text = dict(rows)[i]
        return [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i]["spans"].split(",") if s) if k == "term"]

    assert terms(0) == ["Wu", "quokka", "quokka"] and terms(1) == ["quokka"]
    assert all(found[i]["n_term"] == 0 for i, _ in rows[2:])


@pytest.mark.parametrize("most", [pii.MAX_BROADCAST, 0])
def test_terms_by_brute_force(spark, monkeypatch, most):
    """Spans of terms as by the definition, with copies counted once, on both ways of joining."""
    monkeypatch.setattr(pii, "MAX_BROADCAST", most)
    rng = np.random.default_rng(31)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "Nu", "pe") for b in ("ba", "do", "gu", "ra", "sé", "ti")]
    rows = []
    for k in range(160):
        own = list(rng.choice(words, rng.integers(3, 9), p=np.arange(30, 0, -1) / 465))
        if rng.random() < 0.3:
            own.insert(int(rng.integers(0, len(own))), f"m{rng.integers(0, 6)}@x.org")
        rows += [(k, " ".join(own))] * int(rng.choice([1, 1, 1, 3]))
    texts_ = sorted({t for _, t in rows})
    n = len(texts_)
    terms = {t: {w.lower() for w in re.findall(r"[^\W\d_]+", t)} for t in texts_}
    held = {t: {x for m in re.finditer(r"\S+@\S+", t) for x in ("email", m[0])} for t in texts_}
    n_term = collections.Counter(w for t in texts_ for w in terms[t])
    n_entity = collections.Counter(e for t in texts_ for e in held[t])
    both = collections.Counter((w, e) for t in texts_ for w in terms[t] for e in held[t])
    told = set()
    for (w, e), c in both.items():
        given = (c + pii.SMOOTHING * n_entity[e] / n) / (n_term[w] + pii.SMOOTHING)
        if n_entity[e] < n and math.log2(given * n / n_entity[e]) >= math.log2(n / n_entity[e]) / pii.ALPHA:
            told.add(w)
    assert told
    for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        inside = [m.span() for m in re.finditer(r"\S+@\S+", text)]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in told and not any(a < m.end() and m.start() < b for a, b in inside)]
        assert [x for x in r["spans"].split(",") if x.startswith("term")] == want


def test_language_model_by_brute_force(spark, texts):
    """Scores from the weights and counts, token by token in plain Python."""
    L = lm_scoring
    own = spark.createDataFrame([(i, i % 5 == 1, t) for i, t in texts.items() if i < 40] + [(900, False, "x" * 90 + " ok " + "X" * 90), (901, False, "")], "doc_id long, held_out boolean, text string")
    counts = L.count_words(own.where("not held_out")).cache()
    lexicon = spark.sparkContext.broadcast(L.lexicon_of(counts))
    lex, weights = lexicon.value, L.train(own.where("not held_out"), lexicon)
    c = {r["word"] % (1 << 64): r["c"] for r in counts.collect()}
    slots = dict(zip(lex.hashes.tolist(), lex.slots.tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in L.score(own, counts, lexicon, spark.sparkContext.broadcast(weights)).collect()}
    assert weights.class_rows.any() and weights.slot_rows.any()

    def softmax(z, at):
        return z[at] - math.log(sum(math.exp(x) for x in z))

    for r in own.collect():
        raw = r["text"].encode()
        hashes, classes, _ = (x.tolist() for x in L.tokens_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        total = 0.0
        for i, (h, k) in enumerate(zip(hashes, classes, strict=True)):
            w = [int(L.mixed(np.array([hashes[i - d]], np.uint64), 1)[0] >> np.uint64(40)) if i >= d else 0 for d in (1, 2)]
            q = [classes[i - d] if i >= d else 0 for d in (1, 2, 3)]
            f1 = [w[0] % L.WORD_ROWS, L.WORD_ROWS + w[1] % L.WORD_ROWS, 2 * L.WORD_ROWS + q[0] * L.CLASSES + q[1], 2 * L.WORD_ROWS + L.CLASSES**2 + q[1] * L.CLASSES + q[2]]
            f2 = [k * L._W1_BUCKETS + w[0] % L._W1_BUCKETS, L.CLASSES * L._W1_BUCKETS + k * L.CLASSES + q[1]]
            slot = slots.get(h, L.SLOTS - 1)
            total += softmax([float(lex.prior1[j] + sum(weights.class_rows[f, j] for f in f1)) for j in range(L.CLASSES)], k)
            total += softmax([float(lex.prior2[k, j] + sum(weights.slot_rows[f, j] for f in f2)) for j in range(L.SLOTS)], slot)
            if slot == L.SLOTS - 1:
                total += math.log(c.get(h, 0) + 0.5) - lex.rest_log[k]
        assert got[r["doc_id"]] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def test_long_words_are_told_apart():
    a = b"a"
    for _ in range(10):  # two words that polynomial hashes modulo a power of two take for one
        a += bytes(195 - x for x in a)
    hashes, _, _ = lm_scoring.tokens_of(np.frombuffer(a + b" " + bytes(195 - x for x in a) + b" " + a.upper(), np.uint8), np.array([0, 3 * len(a) + 2]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_fingerprints_and_components(spark, texts):
    def fingerprint(t):
        w = t.encode().lower().split()
        own = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in own]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    expected = {i: fingerprint(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if (expected[a] ^ expected[b]).bit_count() <= 4:
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    for r in Q.op7_simhash_dedup(spark, DATA).collect():
        assert r["fingerprint"] == f"{expected[r['doc_id']]:016x}" and r["component_id"] == group[r["doc_id"]]


def test_crowded_shards(spark):
    """Many fingerprints around few centres: shards are dealt again, and no link between components is lost."""
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 20, np.uint64)
    flips = [np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 60, np.uint64) for _ in range(3)]) for _ in centres]
    points = np.unique(np.concatenate([c ^ f for c, f in zip(centres, flips, strict=True)]))
    links = simhash_dedup.links_of(spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long"), leaf=32).collect()

    def labels(pairs):
        parent = list(range(len(points)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return [root(x) for x in range(len(points))]

    place = {int(x): k for k, x in enumerate(points.view(np.int64))}
    near = [(i, j) for i in range(len(points)) for j in range(i) if int(points[i] ^ points[j]).bit_count() <= 4]
    assert labels(near) == labels([(place[r["a"]], place[r["b"]]) for r in links])


def test_components_of_many_links(spark, monkeypatch):
    """Label propagation and the single task give the same components."""
    rng = np.random.default_rng(8)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)).tolist()] + [(1000 + i, 1001 + i) for i in range(60)], "a long, b long")
    names = spark.range(2000).select(F.col("id").alias("fp"), (5000 - F.col("id")).alias("name"))
    one = {tuple(r) for r in simhash_dedup.components(links, names).collect()}
    monkeypatch.setattr(simhash_dedup, "ONE_TASK", 0)
    assert {tuple(r) for r in simhash_dedup.components(links, names).collect()} == one and len({c for _, c in one}) > 5


def test_similar_texts(spark, texts):
    """The groups are those of all pairs with an exact similarity of 0.8 or more."""
    rows = spark.createDataFrame(list(texts.items()), "row long, text string")
    assert {r["row"]: r["component"] for r in simhash_similar.groups(rows, 0.8, 5).collect()} == _exact_groups(texts)


def test_every_doubtful_pair_counts(spark):
    """Two groups are joined by their only pair of 0.8, whichever pair of them is checked first."""
    rng = np.random.default_rng(3)
    every, alone = {}, simhash_similar.shingles_of
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(400)]
        for k, edits in enumerate((0, 3, 8)):  # the first two are clearly similar, the third is similar to the second only
            for i in rng.choice(np.arange(k * 130, k * 130 + 130, 6), edits, replace=False):
                words[i] = f"g{g}k{k}x{i}"
            every[10 * g + k] = " ".join(words)
    sets = {i: set(alone(t.encode(), 5).tolist()) for i, t in every.items()}
    expected = {i: i for i in every}
    for a, b in itertools.combinations(sorted(every), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((expected[a], expected[b]))
            expected = {k: low if v == high else v for k, v in expected.items()}
    rows = spark.createDataFrame(list(every.items()), "row long, text string")
    assert {r["row"]: r["component"] for r in simhash_similar.groups(rows, 0.8, 5).collect()} == expected


def test_shards_check_all_doubtful_pairs():
    """The links of all shards join what all pairs within the radius that share a band and are similar join."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    points, far = np.bitwise_and.reduce(rng.integers(0, 1 << 63, (3, 90, simhash_similar.WORDS), np.uint64)), 105
    sets = [np.sort(rng.choice(9, 6, replace=False)).astype(np.uint64) for _ in range(90)]
    bands = simhash_similar.bands_of(90, 0.8)
    values = simhash_similar.band_values(points, bands)
    shards = sorted((int(v) + (k << bands.shape[1]), i) for i in range(90) for k, v in enumerate(values[i]))
    who = [i for _, i in shards]
    batch = pa.record_batch({"shard": [s for s, _ in shards], "own": [i // 2 for i in who], "shingles": [sets[i].tobytes() for i in who], "bits": [points[i].tobytes() for i in who]})
    close = [(i, j) for i, j in itertools.combinations(range(90), 2) if (values[i] == values[j]).any() and sum(int(x).bit_count() for x in points[i] ^ points[j]) <= far]
    good = np.array([(i // 2, j // 2) for i, j in close if len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 0.8 * len(set(sets[i].tolist()) | set(sets[j].tolist()))])
    whole, found = vantage.Forest(45), vantage.Forest(45)
    whole.join(good[:, 0], good[:, 1])
    for b in simhash_similar._checked_links(iter([batch]), far, 0.8, bands):
        found.join(b.column("a").to_numpy(), b.column("b").to_numpy())
    assert (found.root == whole.root).all() and 2 < len(set(whole.root.tolist())) < 45


@pytest.mark.parametrize(("words", "radius", "first"), [(1, 4, None), (8, 90, 25)])
def test_vantage_trees_find_all_pairs(words, radius, first):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (9, words), np.uint64)
    points = centres[rng.integers(0, 9, 300)] ^ np.bitwise_and.reduce(rng.integers(0, 1 << 63, (4, 300, words), np.uint64))
    firsts = np.array([0, 1, 3, 40, 150])
    ends = np.r_[firsts[1:], 300]
    near = {(i, j) for a, b in zip(firsts, ends, strict=True) for i, j in itertools.combinations(range(a, b), 2) if np.bitwise_count(points[i] ^ points[j]).sum() <= radius}
    seen = vantage.Pruning()
    found = [tuple(sorted(p)) for a, b, _ in vantage.near_pairs(points, firsts, radius, None, first, seen) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == near and len(near) > 50
    assert seen.compared < seen.all == sum(n * (n - 1) // 2 for n in ends - firsts)
    linked, whole = vantage.Forest(300), vantage.Forest(300)
    for a, b, _ in vantage.near_pairs(points, firsts, radius, linked, first):
        linked.join(a, b)
    whole.join(*np.array(sorted(near)).T)
    assert (linked.root == whole.root).all()


def _exact_groups(every):
    """Smallest id of each group of all pairs with an exact similarity of 0.8 or more."""
    sets = {i: set(simhash_similar.shingles_of(t.encode(), 5).tolist()) for i, t in every.items()}
    group = {i: i for i in every}
    for a, b in itertools.combinations(sorted(every), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    return group


def test_families_near_the_radius(spark):
    """Families of two clear groups that some pairs of just over 0.8 join: at least nine tenths of the groups are whole."""
    rng = np.random.default_rng(11)
    every = {}
    for g in range(120):
        words = [f"g{g}w{i}" for i in range(200)]
        other = list(words)
        for i in rng.choice(np.arange(0, 196, 6), 4, replace=False):
            other[i] = f"g{g}o{i}"
        for k, base in enumerate((words, other)):
            for m in range(4):
                own = list(base)
                if m:
                    own[rng.integers(0, 200)] = f"g{g}k{k}m{m}"
                every[100 * g + 10 * k + m] = " ".join(own)
    expected = collections.defaultdict(dict)
    for i, text in every.items():
        expected[i // 100][i] = text
    expected = {k: v for own in expected.values() for k, v in _exact_groups(own).items()}
    rows = spark.createDataFrame(list(every.items()), "row long, text string")
    got = {r["row"]: r["component"] for r in simhash_similar.groups(rows, 0.8, 5).collect()}
    families = collections.defaultdict(bool)
    for i in every:
        families[i // 100] |= got[i] != expected[i]
    assert sum(families.values()) <= 0.1 * len(families)


def _shuffle_files(spark):
    """Path and size of the shuffle files that there are now."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    every = [files.apply(i) for i in range(files.size())]
    return {f.getPath(): f.length() for f in every if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_kept_rows_are_not_shuffled(spark, tmp_path, monkeypatch):
    """keep_one returns the rows by bits for their numbers, not by a shuffle of texts; beyond MAX_BLOCKS the rows are the same."""
    rng = np.random.default_rng(14)
    docs = spark.createDataFrame([(k // 2 if k < 20 else k, rng.bytes(3000).hex()) for k in range(300)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash_dedup, "cut", lambda df, name: df.localCheckpoint())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = docs.localCheckpoint()
        grouped = lambda r: r.select("row", (F.col("row") % 64).alias("component"))
        before = _shuffle_files(spark)
        found = sorted(simhash_dedup.smallest_of_each(rows, grouped, "doc_id", "text").collect())
        moved = sum(n for f, n in _shuffle_files(spark).items() if f not in before)
        assert 64 <= len(found) <= 192 and moved < 300 * 3000 / 4
        monkeypatch.setattr(simhash_dedup, "MAX_BLOCKS", 0)
        assert sorted(simhash_dedup.smallest_of_each(rows, grouped, "doc_id", "text").collect()) == found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_cut_leaves_no_shuffle_files(spark):
    import time

    before = set(_shuffle_files(spark))
    written = common.cut(spark.range(5000).groupBy((F.col("id") % 50).alias("x")).agg(F.count("*").alias("n")), "grouped")
    assert {r["n"] for r in written.collect()} == {100} and spark.conf.get(common.CLEANUP) == "false"
    for _ in range(10):
        if set(_shuffle_files(spark)) <= before:
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files are left")


def test_shards_get_short_fingerprints():
    """Shards are searched by the first HEAD words: clear pairs are linked, members of the others told."""
    rng = np.random.default_rng(4)
    points = rng.integers(0, 1 << 63, (40, simhash_similar.HEAD), np.uint64)
    points[1] = points[0] ^ np.uint64(1 << 9)
    points[3] = points[2] ^ np.bitwise_and.reduce(rng.integers(0, 1 << 63, (3, simhash_similar.HEAD), np.uint64))
    near, far, first = simhash_similar.radii(0.8, simhash_similar.HEAD, simhash_similar.HEAD_DEVIATIONS)
    batch = pa.record_batch({"shard": np.zeros(40, np.int64), "fp": np.arange(40), "bits": [x.tobytes() for x in points]})
    found = pa.Table.from_batches(simhash_similar._clear_links(iter([batch]), near, far, first, simhash_similar.HEAD)).to_pylist()
    assert near < np.bitwise_count(points[2] ^ points[3]).sum() <= far
    assert [(r["a"], r["b"]) for r in found if r["shard"] is None] == [(1, 0)] and [r["a"] for r in found if r["shard"] is not None] == [2, 3]


def test_encoding_needs_little_memory():
    """A worker's memory has a bound that doesn't grow with the texts: fresh words in each."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join(f"{a:x}" for a in rng.integers(0, 1 << 40, 200).tolist()) for _ in range(800)]
    batch = pa.record_batch({"text": texts, "key": np.arange(800)})
    lattices, seen = S.Lattices(S.Vocabulary.load()), []
    tracemalloc.start()
    for part in S._chunks(batch):
        found = S.sample_chunk(lattices, part.column("text").to_pylist(), part.column("key").to_numpy().view(np.uint64), 2)
        seen += [s.log_p for samples, _ in found for s in samples]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == 1600 and peak < 160 << 20, peak >> 20


def test_crowd_of_near_copies(spark):
    """A crowd whose members are nearly all within the doubtful zone is grouped as by all pairs, with few checks for each member."""
    rng = np.random.default_rng(12)
    base, every = [f"w{i}" for i in range(180)], {}
    for k in range(300):
        own = list(base)
        for i in rng.choice(180, rng.integers(1, 9), replace=False):
            own[i] = f"k{k}x{i}"
        every[k] = " ".join(own)
    rows = spark.createDataFrame(list(every.items()), "row long, text string")
    got, expected = {r["row"]: r["component"] for r in simhash_similar.groups(rows, 0.8, 5).collect()}, _exact_groups(every)
    assert sum(got[k] != expected[k] for k in every) <= 3


def test_jump_hash():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(3).integers(0, 1 << 63, 3000, np.uint64)
    for n in (1, 24, 25):
        assert jump_sharding.jump(keys, n).tolist() == [plain(int(k), n) for k in keys]
    a, b = jump_sharding.jump(keys, 24), jump_sharding.jump(keys, 25)
    assert set(b[a != b]) == {24} and 0.02 < (a != b).mean() < 0.06


def test_shards(spark, texts):
    got = Q.op9_jump_sharding(spark, DATA).collect()
    for shard, own in itertools.groupby(sorted(got, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        assert 0 <= shard < 24
        assert [r["slot"] for r in own] == list(range(sum(r["shard"] == shard for r in got)))
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] in (r["shard"], 24)


def test_toxicity(spark):
    got = {r["doc_id"]: r for r in Q.op10_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in labels)
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x and not y]
    assert np.mean(pairs) > 0.75
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_ftrl_by_brute_force():
    """Weights after some steps, coordinate by coordinate in plain Python."""
    rng, T = np.random.default_rng(6), toxicity
    rows = [(np.unique(rng.integers(0, 9, 5)).astype(np.int32), int(rng.integers(0, 2))) for _ in range(200)]
    model, z, n = T.Ftrl(), collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        penalty = 0 if i == "bias" else T.L1
        return 0.0 if abs(z[i]) <= penalty else -(z[i] - math.copysign(penalty, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    for codes, label in rows:
        model.learn(codes, label)
        own = [*codes.tolist(), "bias"]
        w = [weight(i) for i in own]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, x in zip(own, w, strict=True):
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA * x
            n[i] += g * g
    assert model.weights(np.arange(9)) == pytest.approx([weight(i) for i in range(9)], abs=1e-9)
    assert model.weights(np.array([1 << T.BITS]))[0] == pytest.approx(weight("bias"), abs=1e-9)


def test_ftrl_is_sparse():
    rng = np.random.default_rng(4)
    texts = [np.unique(np.r_[rng.integers(0, 5000, 30), 77 if k % 3 == 0 else 78]).astype(np.int32) for k in range(600)]
    m = toxicity.fit(texts, np.array([k % 3 == 0 for k in range(600)], int))
    w = m.dense()
    assert w[77] > 0.5 > w[78] and len(m.codes) < 300


@pytest.fixture(scope="module")
def tiny():
    pieces = ["▁", "a", "b", "▁a", "ab", "ba", "▁ab", "aba", *(f"<0x{b:02X}>" for b in range(256))]
    weights = np.r_[np.log([0.1, 0.2, 0.15, 0.2, 0.1, 0.05, 0.1, 0.1]), np.full(256, -6.0)]
    return S.Vocabulary(pieces, weights, list(range(8, 264)))


@pytest.mark.parametrize("group", [2, 48])
def test_samples_are_exact(tiny, monkeypatch, group):
    """The first two of the distinct samples have the probabilities of draws without replacement, and inclusion is unbiased."""
    monkeypatch.setattr(S, "GROUP", group)

    def every(u):
        if not u:
            return {(): 0.0}
        return {(i, *rest): tiny.log_weights[i] + w for i, p in enumerate(tiny.pieces[:8]) if u.startswith(p) for rest, w in every(u[len(p) :]).items()}

    paths = every("▁aba▁ab")
    z = math.log(sum(map(math.exp, paths.values())))
    p = {k: math.exp(w - z) for k, w in paths.items()}
    n, lattices = 3000, S.Lattices(tiny)
    found = S.sample_chunk(lattices, ["aba ab"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), 3)
    pairs, total = collections.Counter(), []
    for samples, after in found:
        own = [tuple(S.pieces_of(lattices, s.edges).tolist()) for s in samples]
        assert len(set(own)) == 3 and samples[0].value > samples[1].value > samples[2].value > after
        assert all(s.log_p == pytest.approx(math.log(p[k])) for s, k in zip(samples, own, strict=True))
        pairs[own[0], own[1]] += 1
        total.append(sum(math.exp(s.log_p) / -math.expm1(-math.exp(s.log_p - after)) for s in samples))
    for a, b in itertools.permutations(p, 2):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / n - q) < 5 * math.sqrt(q / n) + 0.002
    assert np.mean(total) == pytest.approx(1, abs=0.03)


def test_all_segmentations_of_a_short_text(tiny):
    lattices = S.Lattices(tiny)
    (samples, after), (empty, _) = S.sample_chunk(lattices, ["a", ""], np.arange(2, dtype=np.uint64), 5)
    assert sorted(S.pieces_of(lattices, s.edges).tolist() for s in samples) == [[0, 1], [3]] and after == -math.inf
    assert len(empty) == 1 and not len(empty[0].edges)


def test_round_trip(spark, texts):
    got = S.encode_sampled(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = S.decode(got.select("doc_id", "rank", "pieces", "round_trip")).collect()
    assert all(r["round_trip"] and r["text"] == texts[r["doc_id"]] for r in rows)
    assert len({(r["doc_id"], tuple(r["pieces"])) for r in rows}) == len(rows)


def test_samples_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 20")
    same = [{(r["doc_id"], r["rank"], tuple(r["pieces"]), r["log_prob"], r["perturbed"], r["inclusion"]) for r in S.encode_sampled(d).collect()} for d in (docs, docs.repartition(5))]
    assert same[0] == same[1]


def test_scores_do_not_depend_on_what_came_before(tiny, texts):
    own, keys = ["ab a", "ba ab aba", "b"], np.arange(3, dtype=np.uint64)
    used = S.Lattices(tiny)
    S.sample_chunk(used, [" ".join(p) for p in itertools.product("ab", repeat=6)], np.arange(64, dtype=np.uint64), 2)
    both = [[[(S.pieces_of(x, s.edges).tolist(), s.log_p, s.value) for s in samples] + [after] for samples, after in S.sample_chunk(x, own, keys, 3)] for x in (S.Lattices(tiny), used)]
    assert both[0] == both[1]


def test_pieces_across_spaces():
    """With a piece that goes on after a space, no segmentation is missing."""
    v = S.Vocabulary(["▁", "a", "b", "a▁b", *(f"<0x{b:02X}>" for b in range(256))], np.r_[np.log([0.2, 0.3, 0.2, 0.3]), np.full(256, -6.0)], list(range(4, 260)))
    lattices = S.Lattices(v)
    ((samples, _),) = S.sample_chunk(lattices, ["a b"], np.arange(1, dtype=np.uint64), 5)
    assert sorted(S.pieces_of(lattices, s.edges).tolist() for s in samples) == [[0, 1, 0, 2], [0, 3]]


def test_decontamination(spark):
    from hedgerow.llm import decontamination

    item = "Alice had 12 apples and gave 5 kg of them to Bob who then sold the rest for 7 dollars at the market"
    rows = [
        (1, f"Some words before. {item} and some words behind it."),
        (2, "Some words. Carol had 34 apples and gave 9 kg of them to Dave who then sold the rest for 8 dollars at the market today"),
        (3, "A text about something else altogether that has nothing in common with the question except a few words"),
        (4, item.upper()),
        (5, "she had 3 apples and that was all of them"),
    ]
    got = {r["doc_id"]: r for r in decontamination.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert [got[i]["contaminated"] for i in (1, 2, 3, 5)] == [True, True, False, False] and got[1]["items"] == [7]


def test_occurrences_are_judged_apart(spark):
    from hedgerow.llm import decontamination

    item = "Alice had 12 apples and gave 5 kg of them to Bob who then sold the rest for 7 dollars at the market"
    other = "Carol had 34 apples and gave 9 kg of them to Dave who then sold the rest for 8 dollars at the market"
    recipe = "now add 3 kg of salt to the big pot and stir it well now add 5 kg of salt to the big pot and stir it well"
    rows = [(1, f"First. {item}. Then again. {other}."), (2, f"So {recipe} and serve."), (3, "nothing of the kind is in this text at all, not even a part of it")]
    bench = spark.createDataFrame([(7, item), (8, recipe)], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.judge(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [7], 2: [8], 3: []}


def test_items_of_values_and_short_items(spark):
    from hedgerow.llm import decontamination

    sums, short = "What is 12 + 7 + 9 + 4 + 11 + 6 + 2 + 8 + 3?", "Define entropy briefly"
    rows = [(1, f"Answer this. {sums} Good."), (2, f"Please now: {short}, in a line."), (3, "What is 13 + 1 + 8 + 5 + 10 + 3 + 1 + 7 + 2? Define it briefly")]
    bench = spark.createDataFrame([(7, sums), (8, short)], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.judge(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [7], 2: [8], 3: []}


def test_names_begin_sentences(spark):
    from hedgerow.llm import decontamination

    item = "Natalia sold 48 clips to her friends in April and half as many in May so how many did she sell"
    rows = [(1, "Yolanda sold 51 clips to her friends in June and half as many in July so how many did she sell"), (2, "Yolanda sold 51 clips to Paul and 3 pens to her")]
    got = {r["doc_id"]: r["items"] for r in decontamination.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: [7], 2: []}


def _contaminated(text, items):
    """The ids of the items in the text, by the definition, in plain Python."""
    from hedgerow.llm import decontamination as D

    def canonical(t):
        t = re.sub(r"(?<=[0-9])(?=[A-Za-z%°])", " ", t or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c for c in t if c.isalpha() or unicodedata.category(c)[0] == "N" or c in " \t\n\v\f\r")) if w]
        kinds = []
        for i, w in enumerate(words):
            title = len(w) > 1 and unicodedata.category(w[0]) == "Lu" and all(unicodedata.category(c) == "Ll" for c in w[1:])
            unit = i > 0 and kinds[i - 1] == "#" and w.lower() in D.UNITS
            kinds.append("#" if re.fullmatch("[0-9]+", w) else "%" if unit else "@" if title else w.lower())
        return kinds, [w.lower() for w in words]

    def windows(t, size):
        kinds, values = t
        for i in range(len(kinds) - size + 1):
            k, v = kinds[i : i + size], values[i : i + size]
            typed = [x in "#%@" for x in k]
            if size < D.MIN_TOKENS or sum(typed) > D.MAX_SLOTS:
                yield i, ("literal", *v), {}
            else:
                yield i, tuple(k), {j: x for j, (x, y) in enumerate(zip(v, typed, strict=True)) if y}

    doc, found = canonical(text), set()
    for item, raw in items.items():
        own = canonical(raw)
        n = len(own[0])
        size = min(n, D.WINDOW)
        mine = list(windows(own, size)) if n else []
        first = {}
        for i, h, s in mine:
            first[h] = min(first.get(h, ((), 0)) or (), ("\x01".join(s.get(j, "") for j in range(size)) if s else "", i)) if h in first else ("\x01".join(s.get(j, "") for j in range(size)) if s else "", i)
        occurrences = collections.defaultdict(list)
        for at, h, s in windows(doc, size) if n else ():
            for i, h2, s2 in mine:
                if h == h2:
                    occurrences["aligned", at - i].append((h, s2, s))
                    if first[h] == ("\x01".join(s2.get(j, "") for j in range(size)) if s2 else "", i):
                        for o in (("text",), ("near", (at + 1) // n), ("near", (at + 1) // n - 1)):
                            occurrences[o].append((h, s2, s))
        total = len({h for _, h, _ in mine})
        for hits in occurrences.values():
            ways = collections.defaultdict(set)
            for _, a, b in hits:
                for j in a:
                    ways[a[j]].add(b[j])
            consistent = sum(len(w) == 1 for w in ways.values()) / len(ways) if ways else 1
            if len({h for h, _, _ in hits}) >= D.SHARE * total and consistent >= D.CONSISTENT:
                found.add(item)
    return found


def test_decontamination_by_brute_force(spark):
    """Texts mixed of items, changed items and other words: every verdict is that of the definition."""
    from hedgerow.llm import decontamination

    rng = np.random.default_rng(21)
    names, nouns = ["Anna", "Bo", "Carl", "Dora", "Élan", "Über"], ["apples", "boxes", "clips", "days", "the", "of", "a", "gave", "sold"]

    def sentence(n):
        return [str(rng.choice([rng.choice(names), str(rng.integers(1, 9)), f"{rng.integers(1, 9)}kg", rng.choice(nouns), "km"], p=[0.15, 0.15, 0.05, 0.6, 0.05])) for _ in range(n)]

    items = {k: " ".join(sentence(rng.integers(1, 26))) + "." for k in range(40)}
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.integers(1, 4)):
            words = items[int(rng.integers(0, 40))].split()
            for i, w in enumerate(words):
                if rng.random() < 0.1:
                    words[i] = str(rng.choice(names)) if w in names else str(rng.integers(1, 9)) if w.isdigit() else w
            parts += sentence(rng.integers(0, 12)) + words
        rows.append((k, " ".join(parts)))
    got = decontamination.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    expected = {k: _contaminated(t, items) for k, t in rows}
    assert {r["doc_id"]: set(r["items"]) for r in got} == expected and 30 < sum(map(bool, expected.values()))


def test_benchmark_items_are_found(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    holding = {i for i, t in texts.items() for b in items.values() if b.lower() in t.lower()}
    found = {r["doc_id"] for r in Q.op6_decontamination(spark, DATA).collect() if r["contaminated"]}
    assert holding <= found and len(found) <= 1.5 * len(holding) + 1


def test_lines(spark):
    rows = [(i, "hot", f"menu\nown line {i}\n\nfooter") for i in range(40)] + [(100 + i, "cold", f"menu\nline {i}") for i in range(5)]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[3]["text"] == "own line 3\n" and got[3]["__n_dropped"] == 2
    assert got[101]["text"] == "line 1"
    few = line_dedup.drop_boilerplate(spark.createDataFrame([(i, "s", f"same\n{i // 2}") for i in range(4)], "doc_id long, source string, text string")).collect()
    assert {r["text"] for r in few} == {"0", "1"}  # a page and its copy keep their own line


def test_pipeline(spark, texts):
    """The stages one after the other, each against what it should have done."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in Q.op2_quality_rules(spark, DATA).collect() if r["kept"]}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, DATA)
        ids, after = {r["doc_id"] for r in before.select("doc_id").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= ids
        if name == "quality rules":
            assert after == kept
        if name == "line dedup":
            assert after == ids
        if name == "SimHash near-dedup":
            own = [r["text"] for r in out.select("text").collect()]
            assert len(own) == len(set(own))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == after
