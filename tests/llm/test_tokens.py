"""Packing, token alignment and collocations against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldtrace.llm import collocations, packing, token_alignment
from fieldtrace.llm.byte_tokens import ByteTokens
from fieldtrace.llm.queries import BYTES, PIECES, queries

SCHEMA = "doc_id long, text string, lang string, source string, piece int, part int, nth long, length long, a long, n long, w1 string, rank int, chunk string"
SPEC, PATTERN, MODEL = public_tokenizers.path(BYTES), public_tokenizers.PATTERN, public_tokenizers.path(PIECES)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(40)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


ODD = [
    None, "", " ", "\n\n", "a", "A  b\tc", "▁x ▁▁", "nul \x00 here", "<|endoftext|> and <s> </s> <0x41> <unk>", "ſ ǅ Ⅷ ½ 日本語 🙂👩‍👩‍👧", "x" * 20_000, " " * 3000,
    "é é ​﻿ \u0085  ", "don't WON'T 's", "The the THE, the? the! The; the: the\rthe\x0bthe\x0cthe", prose(3, 9000),
]


def texts() -> list:
    copies = [prose(1, 60)] * 12
    return ODD + copies + [prose(k, 5 + 37 * (k % 11)) for k in range(60)] + [prose(5, 42)] * 3


@pytest.fixture(scope="module")
def rows():
    return [(k if k != 20 else None, t, ["en", None, "fr", "en"][k % 4], f"s{k % 3}", 1, 2, 3, 4, 5, 6, "w", 7, "c") for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "text")


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    return at


def test_ids_are_those_of_the_library():
    mine, whole = ByteTokens(open(SPEC, encoding="utf-8").read(), PATTERN), Tokenizer.from_file(SPEC)
    assert mine._ranked is not None
    for text in [t for t in texts() if t]:
        assert mine.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    whole.encode_special_tokens = True
    for text in [t for t in ODD if t]:
        assert mine.encode(text, plain=True).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert mine.encode("a<|endoftext|>").tolist() != mine.encode("a<|endoftext|>", plain=True).tolist()


def test_other_byte_vocabularies_go_to_the_library():
    import json

    spec = json.load(open(SPEC, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    mine = ByteTokens(json.dumps(spec), PATTERN)
    assert mine._ranked is None and mine.encode("hello there").tolist() == Tokenizer.from_str(json.dumps(spec)).encode("hello there", add_special_tokens=False).ids


def check_places(pieces, capacity):
    """Every sequence is filled from 0 without gaps or overlaps; how many there are."""
    by = collections.defaultdict(list)
    for sequence, offset, length in pieces:
        by[sequence].append((offset, length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_op11_against_a_plain_version(spark, folder, rows):
    got = queries()["op11_best_fit_packing"](spark, folder).collect()
    whole, expect = Tokenizer.from_file(SPEC), collections.Counter()
    for doc, text, *_ in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        k = -(-len(ids) // 1024)
        cuts = [0, *range(len(ids) - (k - 1) * 1024, len(ids) + 1, 1024)]
        expect.update((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expect
    made = check_places([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    assert made <= best_fit([r.length for r in got], 1024)


@pytest.mark.parametrize("capacity", [1, 7, 30, 64])
def test_plans_place_every_piece_once(capacity):
    r = random.Random(capacity)
    for _ in range(40):
        some = r.sample(range(1, capacity + 1), r.randint(1, capacity))
        counts = {k: r.choice([1, 1, 2, 3, 9, 40]) for k in some}
        pieces = []
        for length, n in counts.items():
            runs = sorted((x for x in packing.plan(counts, capacity) if x.length == length), key=lambda x: x.low)
            for rank in range(n):
                x = [x for x in runs if x.low <= rank][-1]
                pieces.append((x.base + (rank - x.low) // x.each, x.offset + (rank - x.low) % x.each * length, length))
        made = check_places(pieces, capacity)
        assert made <= best_fit([p[2] for p in pieces], capacity)
    assert packing.plan({}) == []
    with pytest.raises(ValueError, match="outside"):
        packing.plan({capacity + 1: 1}, capacity)


def test_large_pieces_are_matched_to_the_fewest_sequences():
    r = random.Random(3)
    for _ in range(30):
        lengths = [r.randint(11, 30) for _ in range(9)]

        def fewest(left):
            if not left:
                return 0
            a, rest = left[0], left[1:]
            return 1 + min([fewest(rest)] + [fewest(rest[:k] + rest[k + 1 :]) for k, b in enumerate(rest) if a + b <= 30])

        runs = packing.plan(collections.Counter(lengths), 30)
        assert len({x.base + k for x in runs for k in range((sum(n == x.length for n in lengths) if x == max((y for y in runs if y.length == x.length), key=lambda y: y.low) else min(y.low for y in runs if y.length == x.length and y.low > x.low)) - x.low)}) == fewest(sorted(lengths))


def test_packed_sequences_hold_the_documents(docs, rows):
    packed = packing.pack(docs.filter("length(text) < 400"), SPEC, PATTERN, end_id=2, capacity=50)
    whole, found = Tokenizer.from_file(SPEC), collections.Counter()
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 50 and list(r.offsets) == sorted(r.offsets)
        found.update(r.ids)
    expect = collections.Counter()
    for _, text, *_ in rows:
        if text is not None and len(text) < 400:
            expect.update(whole.encode(text, add_special_tokens=False).ids + [2])
    assert found == expect


def plain_alignment(rows):
    a_coder, b_coder = Tokenizer.from_file(SPEC), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_coder.encode_special_tokens = True
    a_bytes = ByteTokens(open(SPEC, encoding="utf-8").read(), PATTERN).bytes_of
    b_bytes = lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b_coder.id_to_piece(i)) else p.replace("▁", " ").encode()
    found, counts = [], collections.Counter()
    for _, text, *_ in rows:
        text = text or ""
        a, b, whole = a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text), (" " + text).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(map(b_bytes, b)) != whole:
            found.append(([], [], [], []))
            continue
        spans = []
        for ids, size in ((a, lambda i: len(a_bytes[i])), (b, lambda i: len(b_bytes(i)))):
            at, out = 0, []
            for i in ids:
                out.append((at, at + size(i), i))
                at += size(i)
            spans.append(out)
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        links, j = [], 0
        for x in spans[0]:
            while spans[1][j][1] <= x[0]:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < x[1]:
                links.append((x[2], spans[1][k][2]))
                k += 1
        group = lambda side, e: [str(s[2]) for s in spans[side] if (ends[e - 1] if e else 0) <= s[0] < ends[e]]
        groups = [",".join(group(0, e)) + "|" + ",".join(group(1, e)) for e in range(len(ends))] if len(whole) < 3000 else None
        found.append((a, b, links, groups if groups is not None else ends))
        counts.update(set(links))
    return found, counts


def test_op12_against_a_plain_version(spark, folder, rows):
    got = collections.defaultdict(list)
    for r in queries()["op12_token_alignment"](spark, folder).collect():
        got[r.doc_id].append(r)
    found, counts = plain_alignment(rows)
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    assert sum(map(len, got.values())) == len(rows)
    for (doc, *_), (a, b, links, groups) in zip(rows, found, strict=True):
        (r,) = got[doc]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links))
        assert (r.n_best, r.count_sum) == (sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links))
        if not groups or isinstance(groups[0], str):
            assert r.groups_sha256 == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
    assert sum(not a for a, *_ in found) >= 3


def test_alignment_of_chunks_and_its_own_output(spark, docs, rows):
    args = (docs, SPEC, PATTERN, MODEL)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, token_alignment.link_counts(*args, chunk_chars=900).collect())) == sorted(map(key, token_alignment.link_counts(*args).collect()))
    for r in token_alignment.align(*args).collect():
        assert sum(r.group_a) == len(r.a_ids) == len(r.link_n) and sum(r.group_b) == len(r.b_ids)
        assert all(n >= 1 and 0 <= k and k + n <= len(r.b_ids) for k, n in zip(r.link_first, r.link_n, strict=True))
    assert token_alignment.link_counts(docs.limit(0), SPEC, PATTERN, MODEL).count() == 0


def test_coalescing_of_random_tilings():
    g = np.random.default_rng(1)
    for _ in range(50):
        total = int(g.integers(1, 40))
        tiles = [np.diff(np.concatenate([[0], np.sort(g.choice(np.arange(1, total), int(g.integers(0, total)), replace=False)), [total]])) for _ in range(2)]
        in_a, in_b, first, n = token_alignment.coalesce(*tiles)
        ends = sorted(set(np.cumsum(tiles[0]).tolist()) & set(np.cumsum(tiles[1]).tolist()))
        assert np.bincount(in_a, tiles[0]).cumsum().tolist() == np.bincount(in_b, tiles[1]).cumsum().tolist() == ends
        spans = [[(e - s, e) for s, e in zip(t.tolist(), np.cumsum(t).tolist(), strict=True)] for t in tiles]
        for (s, e), f, k in zip(spans[0], first, n, strict=True):
            assert [j for j, (x, y) in enumerate(spans[1]) if x < e and s < y] == list(range(f, f + k))


def plain_collocations(rows, least, longest, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w))
    out = []
    wide = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for (lang, *w), a in wide.items():
        holds = any(len(q) > len(w) + 1 and q[0] == lang and b >= a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) for q, b in wide.items())
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        if not holds:
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked, seen = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


@pytest.mark.parametrize(("least", "longest", "top", "bits", "chunk"), [(3, 5, 2000, 26, 16_000_000), (3, 5, 10, 6, 2_000), (12, 3, 2000, 12, 50_000)])
def test_collocations_against_a_plain_version(docs, rows, least, longest, top, bits, chunk):
    got = collocations.collocations(docs, least=least, longest=longest, top=top, map_bits=bits, chunk_bytes=chunk)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, longest, top)


def test_windows_have_one_row_however_many_chunks_hold_them(docs):
    bits = collocations.frequent_map(docs, 3, 4, 12, 2_000)
    found, whole = (collocations.windows(docs, bits, 5, size) for size in (2_000, 16_000_000))
    rows = sorted(map(tuple, found.collect()))
    assert len({r[:-1] for r in rows}) == len(rows) and rows == sorted(map(tuple, whole.collect()))


def test_op13_counts_pass_64_bits_and_empty_tables(spark, docs, folder):
    big = 10**14
    counts = spark.createDataFrame([("en", 0, [], big), ("en", 1, ["a"], 3 * 10**12), ("en", 1, ["b"], 7 * 10**11), ("en", 2, ["a", "b"], 5 * 10**11)], "lang string, size int, words array<string>, f long")
    (r,) = collocations.scored(counts).collect()
    assert (r.score, r.a, r.l, r.r, r.n) == (1000 * 5 * 10**11 * big // (3 * 10**12 * 7 * 10**11), 5 * 10**11, 3 * 10**12, 7 * 10**11, big)
    assert collocations.collocations(docs.limit(0)).count() == 0
    found = queries()["op13_collocations"](spark, folder)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.count() == len(plain_collocations([tuple(r) for r in docs.collect()], 100, 5, 2000))


def test_scratch_tables_go_but_the_last(spark, tmp_path):
    from fieldtrace.llm import common

    common.drop_scratch(spark)
    first, second = (common.materialise(spark.range(n), f"t{n}") for n in (3, 5))
    paths = list(common._written)
    common.drop_scratch(spark, keep=1)
    assert common._written == paths[1:] and second.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(paths[0]).count()
    common.drop_scratch(spark)
    assert common._written == []
