"""Registered corpus queries and rare inputs against plain versions."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from fieldtrace.llm import embedding_dedup, licenses, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, suffix_dedup, toxicity
from fieldtrace.llm.queries import queries

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, token string, chunk string, shard int, n int, cls long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts():
    base = prose(1, 90)
    near = base.split()
    near[40] = "Changed"
    out = [base, " ".join(near), base.upper(), None, "", "\n\n", "one two", base + "\n" + prose(2, 60), prose(3, 50) + "\n" + prose(2, 60), prose(4, 40_000), "long " * 40_000]
    return out + [prose(k, 70) + (" ###" * 30 if k % 9 == 0 else "") for k in range(20, 70)] + ["é" * 60 + "日本" * 40, prose(25, 70)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, ["en", None][k % 2], f"s{k % 3}" if k % 5 else None, 0, 1, "t", "c", 2, 3, 4) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 9 != 0), int(k % 7 == 0)) for k in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    g = np.random.default_rng(4)
    v = g.normal(size=(60, 32))
    v[30:] = v[:30] + g.normal(size=(30, 32)) * 0.15
    spark.createDataFrame([(k, [float(x) for x in e], k % 30 % 2) for k, e in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def collected(spark, folder, name):
    return {r[0]: r for r in queries()[name](spark, folder).collect()}


def linked(pairs, ids):
    up = {i: i for i in ids}
    for a, b in pairs * len(ids):
        if up[a] == up[b]:
            continue
        low = min(up[a], up[b])
        up[a] = up[b] = low
    for _ in ids:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_op1(spark, folder):
    sets = {}
    for k, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = linked(pairs, sets)
    got = collected(spark, folder, "op1_ngram_join")
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), want[k]) for k, s in sets.items()} and pairs


def test_op3(spark, folder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collected(spark, folder, "op3_byte_bpe")
    for k, t in enumerate(texts()):
        ids = theirs.encode_ordinary(t or "")
        assert got[k][1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def cut(docs):
    """By doc_id, in order: bytes, removed bytes, spans, what is left."""
    seen, out = {}, []
    for doc, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], doc) != doc:
                gone[i : i + 50] = True
        left = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((doc, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_op4(spark, folder):
    got = queries()["op4_suffix_dedup"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == cut(list(enumerate(texts())))


def test_suffix_dedup_with_shared_and_missing_ids(spark):
    a, b = prose(5, 40), prose(6, 40)
    rows = [(3, a), (3, a + b), (None, b), (5, a), (1, b[:120]), (5, a), (None, b)]
    got = suffix_dedup.digests(suffix_dedup.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_bytes=300)).collect()
    assert sorted(map(tuple, got), key=str) == cut(rows)


def test_op6_and_its_updates(spark, folder):
    got = collected(spark, folder, "op6_quality_classifier")
    assert len(got) == len(texts()) and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    g = np.random.default_rng(1)
    rows = [(np.sort(g.choice(64, 9, replace=False)), g.random(9), int(g.random() < 0.5)) for _ in range(40)]
    z, n, w = [0.0] * 64, [0.0] * 64, [0.0] * 64
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 1.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(3):
        for at, x, y in rows:
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
            for i, v in zip(at, x, strict=True):
                grad = (p - y) * v
                z[i] += grad - (math.sqrt(n[i] + grad**2) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += grad**2
    assert np.allclose(quality_classifier.ftrl(rows, bits=6, epochs=3), [weight(i) for i in range(64)], atol=1e-6)


def test_op7(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in rows}
    label = {r.vec_id: r.label for r in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(v), 2) if label[a] == label[b] and v[a] @ v[b] / math.sqrt(v[a] @ v[a] * (v[b] @ v[b])) >= 0.93]
    got, links = collected(spark, folder, "op7_embedding_dedup"), collections.Counter(x for p in pairs for x in p)
    want = linked(pairs, v)
    assert pairs and {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (links[k], want[k], want[k] == k) for k in v}


@pytest.mark.parametrize("n", [1000, 50_000])
def test_recall_right_at_the_cosine(n):
    g = np.random.default_rng(8)
    for dim in (16, 64):
        parts, size, threshold = embedding_dedup.sized(n, 0.93, dim, embedding_dedup.PARTS)
        code, found = embedding_dedup.code(dim, parts, size, 7), 0
        for _ in range(200):
            x, z = g.normal(size=(2, dim))
            x /= np.linalg.norm(x)
            z -= z @ x * x
            y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z)
            found += len(np.intersect1d(*(embedding_dedup.decode(v, *code, threshold) for v in (x, y)))) > 0
        assert found >= 180, (n, dim, found)


def test_unrelated_vectors_meet_as_seldom_as_there_are_more():
    met = lambda n: (lambda p, s, t: n * s**p * embedding_dedup.both(t, 0.0, 64))(*embedding_dedup.sized(n, 0.93, 64, 2))
    assert all(met(n) <= embedding_dedup.UNRELATED for n in (100, 10_000, 10**6, 10**8))


def test_vectors_with_repeated_and_missing_ids_and_clashing_columns(spark):
    v = [float(x) for x in np.random.default_rng(2).normal(size=8)]
    rows = [(1, v, 0, 9, 9, "k"), (1, v, 0, 9, 9, "k"), (2, v, 0, 9, 9, "k"), (None, v, 0, 9, 9, "k"), (3, None, None, 9, 9, "k")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls long, copies int, key string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, True)], key=str)


def test_op8(spark, folder):
    got = collected(spark, folder, "op8_quality_rules")
    for k, t in enumerate(texts()):
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = len({j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)})
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        assert got[k][1:7] == (len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, failed) and not (failed and got[k].kept)


def test_robust_distances_against_a_loop(spark):
    r = random.Random(3)
    rows = [(k, prose(k, r.randint(60, 90)) + (" ###" * 40 if k % 50 == 0 else "") + ("\n#" if k % 3 == 0 else ""), "en", "s") for k in range(300)]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    x = {}
    for k, t, *_ in rows:
        w = t.split()
        lines = [s for s in t.split("\n") if s.strip()]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = len({j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)})
        if not got[k].base_failed:
            x[k] = [math.log(sum(map(len, w)) / len(w)), math.log1p(100 * t.count("#") / len(w)), math.log1p(20 * (len(lines) - len(set(lines))) / len(lines)), math.log1p(20 * repeated / len(w))]
    keys, data = list(x), np.array(list(x.values()))
    floor = np.diag(np.square(list(quality_rules.STATISTICS.values())))
    centre = np.sort(data, 0)[(len(data) - 1) // 2]
    cov = np.diag((1.4826 * np.sort(abs(data - centre), 0)[(len(data) - 1) // 2]) ** 2) + floor
    distance = lambda: np.einsum("ij,jk,ik->i", data - centre, np.linalg.inv(cov), data - centre)
    for _ in range(quality_rules.STEPS):
        d = distance()
        bins = np.floor(np.log2(d + 1e-9) * 32)
        edge = np.sort(bins)[math.ceil(len(d) * quality_rules.SHARE) - 1]
        core = data[bins <= edge]
        centre, cov = core.mean(0), (core.T @ core / len(core) - np.outer(core.mean(0), core.mean(0))) * quality_rules.CONSISTENCY + floor
    d = distance()
    assert np.allclose([got[k].d2 for k in keys], d, rtol=1e-3, atol=1e-4)
    assert [got[k].kept for k in keys] == (d <= quality_rules.CUTOFF).tolist() and not all(got[k].kept for k in keys)


def test_small_groups_are_drawn_to_their_language(spark):
    rows = [(k, prose(k, 70) + (" ###" * 40 if k == 5 else ""), "en", f"s{k % 10}") for k in range(100)] + [(1000 + k, prose(k, 70) + " ###" * 40, "xx", f"t{k % 10}") for k in range(100)]
    rows += [(2000, prose(1, 70), "zz", "only"), (2000, prose(1, 70), "zz", "only")]
    got = collections.Counter((r.doc_id // 1000, r.kept) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect())
    assert got[0, False] == 1 and got[1, True] == 100 and got[2, True] == 2


def test_op9_features_calibration_and_repeats(spark, folder):
    got = queries()["op9_toxicity"](spark, folder).collect()
    assert len(got) == len(texts()) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.Lexicon({}, 0.5)
    text = "You IDIOT! you are a st*pid moron, really? #1"  # ten words: signs part them
    f = dict(zip(toxicity.FEATURES, toxicity.describe(text, none), strict=True))
    assert (f["hits"], f["density"]) == (pytest.approx(math.log1p(2)), pytest.approx(2 / 10)) and f["you"] == pytest.approx(2 / 10) and f["near_you"] == pytest.approx(2 / 10)
    assert f["hidden"] == pytest.approx(1 / 10) and f["exclaims"] == pytest.approx(1 / len(text)) and f["capitals"] == pytest.approx(1 / 10) and f["length"] == pytest.approx(math.log1p(10))
    assert toxicity.describe(None, none) == toxicity.describe("", none) == [0.0] * len(toxicity.FEATURES)
    held = toxicity.Lexicon({"grunk": (10, 1)}, 0.3)
    assert held.odds(["grunk"], None)[0][1] == pytest.approx(math.log(10.5 / 1.5 * 0.7 / 0.3)) and held.odds(["grunk"], 1.0)[0][1] == pytest.approx(math.log(9.5 / 1.5 * 0.7 / 0.3))


def test_op10(spark, folder):
    got = collected(spark, folder, "op10_source_mix")
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts())}
    source = {k: f"s{k % 3}" if k % 5 else None for k in size}
    total = collections.Counter()
    for k, n in size.items():
        total[source[k]] += n
    want, open_, left = {}, dict(zip(["s0", "s1", "s2", None], (1, 2, 3, 1), strict=True)), float(sum(total.values()))
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * total[s]] or list(open_)
        capped = any(share[s] > 3 * total[s] for s in open_)
        for s in over:
            want[s] = 3.0 * total[s] if capped else share[s]
            left -= want[s]
            del open_[s]
    assert all(r.size == size[k] and r.source_size == total[source[k]] and r.target == pytest.approx(want[source[k]]) and 0 <= r.taken <= 3 * r.size for k, r in got.items())
    for s in total:
        assert abs(sum(r.taken for k, r in got.items() if source[k] == s) - want[s]) <= 2 * mixing.BLOCK_WORDS


def test_mix_keeps_rows_without_an_id(spark):
    rows = [(None if k % 10 == 0 else k, prose(k, 50), "a") for k in range(100)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(str, out)) == sorted(str(r) for r in spark.createDataFrame(rows, "doc_id long, text string, source string").collect())


def test_lines_long_common_and_without_an_id(spark):
    common, long = prose(7, 30), prose(8, 30_000)
    rows = [(k, f"{prose(100 + k, 40)} {common} {prose(200 + k, 40)}\n{common}\nown {common}") for k in range(40)]
    rows += [(500, long), (501, long + " more"), (None, common), (502, "x" * 50_000)]
    got = {r.doc_id: list(r.nos) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {0: [2], **{k: [1, 2] for k in range(1, 40)}, 501: [0]}


def test_join_with_missing_ids(spark):
    rows = [(None, prose(9, 60)), (4, prose(9, 60)), (5, prose(10, 60)), (None, prose(11, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.join(df).collect()), key=str)
    assert got == sorted([(None, None), (4, None), (5, 5), (None, None)], key=str)
    assert sorted((r.doc_id for r in ngram_join.keep_one(df).collect()), key=str) == sorted([None, 5, None], key=str)


def test_licenses_with_other_columns_and_repeated_ids(spark):
    mit = next(t for i, t in licenses.KNOWN_LICENSES if i == "MIT" and len(t) > 500)
    rows = [(1, mit, "a", "b", 3), (1, "Released under the MIT License.", "a", "b", 3), (2, "z " * 60_000 + "\nReleased under the MIT License.", "a", "b", 3), (None, mit, "a", "b", 3)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license_id string, digest string, n_words int"), licenses.known_digests(spark)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "MIT", "MIT"), (2, None, "MIT"), (None, "MIT", "")], key=str)


def test_pipeline_stages_against_plain_versions(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    score = collected(spark, folder, "op6_quality_classifier")
    good = p.quality(spark, docs, folder)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(k for k, r in score.items() if r.predicted == 1)
    lines = {r.doc_id: r.text for r in p.lines(spark, docs, folder).collect()}
    seen, want = [], {}
    for k, t in enumerate(texts()):
        kept, hit = [], False
        for line in (t or "").split("\n"):
            w = line.lower().split()
            s = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else None
            if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                hit = True
            else:
                kept.append(line)
            seen += [s] if s else []
        if not hit or "".join(kept).strip():
            want[k] = "\n".join(kept) if hit else t
    assert lines == want
    one = p.near_duplicates(spark, docs, folder)
    sets = {}
    for k, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    up = linked([(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])], sets)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(k for k in sets if up[k] == k)
    assert p.mix(spark, docs, folder).columns == docs.columns
    at = docs
    for name, stage in p.STAGES:
        at = stage(spark, at, folder)
    assert sorted(map(tuple, at.collect())) == sorted(map(tuple, p.run(spark, folder).collect())) and at.count() > 0


def test_pipeline_without_documents(spark, folder):
    import corpus_pipeline as p

    at = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        at = stage(spark, at, folder)
    assert at.count() == 0


def test_license_query_and_oracle_find_whole_texts(spark, tmp_path):
    import duckdb

    from fieldtrace.llm.oracles import oracle_sql

    known = licenses.whole_texts() + [(i, t) for i, t in licenses.KNOWN_LICENSES]
    rows = [(k, f"Copyright (c) {1990 + k} Someone\n" + t.replace(" license ", " Licence ").replace("\n", " \n") if k % 2 else t) for k, (_, t) in enumerate(known)]
    rows += [(5000, known[0][1] + "\nand more"), (5001, None), (5002, ""), (5003, "copyright\nCopyrights matter.\n© all\n(c) and\nMIT\nReleased under the MIT License")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(oracle_sql()["op5_license_scan"]).fetchall()}
    got = {r.doc_id: (r.text_license, r.line_licenses) for r in queries()["op5_license_scan"](spark, str(tmp_path)).collect()}
    assert got == want and all(got[k][0] for k in range(len(known))) and got[5000] == (None, "") and got[5003] == (None, "MIT")
