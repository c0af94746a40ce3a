"""The ten operators against brute force on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import datetime
import hashlib
import itertools
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bin_completion, components, op1_bpe, op2_language, op3_bitplanes, op4_packing, op5_tiff, op6_line_dedup, op7_quality, op8_ngram_join, op9_url_filter, op10_sharding, tiff
from riskloom.llm.common import new_path, tokenizer_file
from riskloom.llm.shingles import shingle_sets

PATH = tokenizer_file()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary files")
WORDS = "the of and to in is that for with on stone river light green house walking quickly über straße cœur niño".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) * (rng.random() < 0.5) for _ in range(n))


LONG = prose(1, 6000)
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two\nthree, four!"), (6, LONG), (7, prose(2, 200) + ".\n" + prose(3, 80) + "."), (8, prose(2, 200) + ".\n" + prose(3, 80) + "."),
    (8, prose(2, 200) + ".\n" + prose(3, 80) + "."), (9, prose(2, 199) + " changed.\n" + prose(3, 80) + "."), (10, "ÉÀ ª² <|endoftext|>x 漢字 \x1c\x1f İstanbul it's"), (None, "no id here"), (11, "| a | b | c | d |\n" * 3 + prose(4, 90) + "."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src1", len(t) if t else 0, 1, "x", 2, 3, 4) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, words string, n int, rank int, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda x: tuple((v is None, v) for v in x))


def test_bpe_equals_the_library(docs, empty, library):
    got = rows(op1_bpe.encode(docs, PATH, decoded=True), "doc_id", "n_tokens", "ids", "decoded")
    want = sorted(((i, len(x := ids_of(library, t)), x.tobytes(), library.decode(x.tolist(), skip_special_tokens=False)) for i, t in ODD), key=lambda x: (x[0] is None, x))
    assert got == want
    assert rows(op1_bpe.decode(op1_bpe.encode(docs, PATH), PATH), "doc_id", "decoded") == [(i, d) for i, _, _, d in want]
    assert op1_bpe.encode(empty, PATH).count() == 0


def test_bpe_on_strange_strings(library):
    from riskloom.llm.chunks import AutomatonEncoder, LibraryEncoder

    rng = random.Random(4)
    alphabet = "abehinorstTHE019 .,!'|<&Éñßσςİ´́²ª\x1c\x85\xa0　漢😀\n"
    both = [kind(PATH) for kind in (AutomatonEncoder, LibraryEncoder)]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) + "<|endoftext|>" * (rng.random() < 0.05) + rng.choice("ael!") * rng.randrange(40)
        want = ids_of(library, text).tobytes()
        assert [e(text) for e in both] == [want, want]


def test_automaton_follows_merge_order():
    from riskloom.llm.bpe_automaton import MergeAutomaton

    def merged(word, merges):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    merges = [("a", "b"), ("b", "b"), ("a", "a"), ("aa", "aa"), ("ab", "b"), ("bb", "a"), ("aa", "ab")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(u + v for u, v in merges)])}
    machine = MergeAutomaton(vocab, merges)
    for n in range(1, 10):
        for word in map("".join, itertools.product("ab", repeat=n)):
            assert [machine.labels[i] for i in machine.encode_word(word)] == merged(word, merges)


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the given tables")
    d = spark.read.parquet(f"{folder}/documents.parquet")
    model = op2_language.fit_text_model(d.where("doc_id % 5 > 0"))
    held = op2_language.document_evidence(d.where("doc_id % 5 = 0")).withColumn("declared", F.lit(None).cast("string"))
    got = op2_language.identify(held, model).join(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("true")), "id").toPandas()
    assert (got.text_lang == got.true).mean() > 0.98 and (got.lang == got.true).mean() > 0.98 and got.kept.mean() > 0.99


def test_language_fuses_evidence_and_rejects(spark, docs, empty):
    text = {"en": "the house and the river with the light", "de": "das haus und der fluss mit dem licht der straße"}
    train = spark.createDataFrame([(i, text[k] + f" {k}", k) for i, k in enumerate(["en", "de"] * 30)], "doc_id long, text string, lang string")
    model = op2_language.fit_text_model(train)
    data = [(i, text["de"], "de", "de", "h.de", "de") for i in range(50)] + [(100, "", "de", "de", "h.de", "de"), (101, None, None, None, None, None), (102, "漢字漢字漢字漢字", None, None, None, None)]
    got = {r["id"]: r for r in op2_language.identify(spark.createDataFrame(data, "id long, text string, declared string, suffix string, host string, domain string"), model).collect()}
    assert got[0]["lang"] == "de" and got[0]["kept"] and got[100]["lang"] == "de"
    assert not got[100]["kept"] and not got[101]["kept"] and not got[102]["kept"]
    kept = op2_language.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3})
    assert op2_language.keep(empty).count() == 0


def test_posteriors_equal_bayes_rule_in_plain_python(spark):
    """Every factor is worked out anew: trigram likelihoods, evidence by votes, a host's counts smoothed towards its domain's and those towards all."""
    from collections import Counter
    from math import exp, log

    text = {"en": "the house and the river with the light of that quiet morning", "de": "das haus und der fluss mit dem licht der straße am morgen", "fr": "la maison et la rivière avec la lumière du matin"}
    train = spark.createDataFrame([(i, text[k], k) for i, k in enumerate(["en", "de", "fr"] * 20)], "doc_id long, text string, lang string")
    names, logs = op2_language.fit_text_model(train)
    rng = random.Random(3)
    data = []
    for i in range(120):
        words = text[rng.choice(list(text))].split()
        said = " ".join(rng.sample(words, 3)) if i % 3 else " ".join(rng.choice(text["en"].split() + text["de"].split()) for _ in range(2))
        data.append((i, rng.choice([said, said, "", None]) if i % 10 == 0 else said, rng.choice(["en", "de", "xx", None]), rng.choice(["com", "de", None]), f"h{rng.randrange(6)}", rng.choice(["d0", "d1", None])))
    got = {r["id"]: r for r in op2_language.identify(spark.createDataFrame(data, "id long, text string, declared string, suffix string, host string, domain string"), (names, logs)).collect()}
    grams = {i: op2_language.trigrams(t) for i, t, *_ in data}
    scores = {i: [float(logs[k, g].sum()) for k in range(3)] for i, g in grams.items()}
    vote = {i: int(np.argmax(scores[i])) for i, g in grams.items() if len(g) and max(scores[i]) / len(g) >= log(2 / op2_language.BUCKETS)}
    every = [sum(v == k for v in vote.values()) for k in range(3)]
    prior = [(n + 1) / (sum(every) + 3) for n in every]

    def counts(key):
        out = {}
        for row in data:
            if row[0] in vote:
                out.setdefault(key(row), Counter())[vote[row[0]]] += 1
        return out

    hosts, domains = counts(lambda r: (r[4], r[5])), counts(lambda r: r[5])
    smooth = lambda c, p, m: [(c[k] + m * p[k]) / (sum(c.values()) + m) for k in range(3)]
    for row in data:
        i = row[0]
        domain = smooth(domains[row[5]], prior, 20.0) if row[5] in domains else prior
        host = smooth(hosts[row[4], row[5]], domain, 10.0) if (row[4], row[5]) in hosts else prior
        total = [log(p) + (0.3 * s if i in vote else 0.0) for p, s in zip(host, scores[i], strict=True)]
        for c in (2, 3):
            values, by = {r[c] for r in data if r[c] is not None}, counts(lambda r, c=c: r[c])
            if row[c] is not None and row[c] in by:
                total = [x + log((by[row[c]][k] + 1) / (every[k] + len(values))) for k, x in enumerate(total)]
        best = int(np.argmax(total))
        assert abs(got[i]["posterior"] - 1 / sum(exp(x - total[best]) for x in total)) < 2e-5, row
        assert got[i]["lang"] == names[best] and got[i]["kept"] == (i in vote and got[i]["posterior"] >= 0.5)


def test_language_model_has_every_label(spark):
    rng = random.Random(8)

    def spoken(k, n):
        letters = random.Random(k).sample("abcdefghijklmnopqrstuvwxyz", 6)
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))

    many = [(i, spoken(0, 8), "x00") for i in range(3000)]
    few = [(10_000 + 100 * k + i, spoken(k, 60), f"x{k:02}") for k in range(1, 80) for i in range(3)]
    far = [(50_000 + i, " ".join("".join(rng.choice("漢字語文") for _ in range(4)) for _ in range(60)), "zz") for i in range(4)]
    df = spark.createDataFrame(many + few + far, "doc_id long, text string, lang string").repartition(3)
    model = op2_language.fit_text_model(df, train_rows=80)
    assert model[0] == sorted({x[2] for x in many + few + far}) and model[1].shape == (81, op2_language.BUCKETS)
    evidence = df.select(F.col("doc_id").alias("id"), "text", *[F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host", "domain")])
    found = {r["id"]: r for r in op2_language.identify(evidence, model).collect()}
    assert all(found[i]["text_lang"] == "zz" and found[i]["kept"] for i, _, _ in far)
    assert sum(found[i]["text_lang"] == lang for i, _, lang in few) > 0.95 * len(few)
    # labels without a sampled row of their own by a share of all rows; one id for all
    same = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert op2_language.fit_text_model(same, train_rows=80)[0] == model[0]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_blocks_of_planes(planes):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 1000):
        x = rng.integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4")
        assert (op3_bitplanes.unpack_block(op3_bitplanes.pack_block(x, planes)) == x).all()
    parts = [b"ab", b"", b"cdefg"]
    assert op3_bitplanes.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_files(spark, docs, empty, library):
    path = new_path(spark, "tokens")
    op3_bitplanes.write_tokens(docs, path, PATH, end_id=1, planes="bit", block_ids=64)
    got = rows(op3_bitplanes.read_tokens(spark, path), "start", "n_tokens", "doc_id", "ids_crc32")
    at, want = 0, []
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        x = np.append(ids_of(library, t), 1).astype("<u4")
        want.append((at, len(x), i, zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    path = new_path(spark, "tokens")
    op3_bitplanes.write_tokens(empty, path, PATH, end_id=1)
    assert op3_bitplanes.read_tokens(spark, path).count() == 0


def fewest(items, capacity):
    """Fewest bins by trying everything."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_bin_completion_is_near_the_optimum():
    rng, gaps = random.Random(2), 0
    for _ in range(60):
        items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = {n: items.count(n) for n in items}
        packing = bin_completion.complete_bins(counts, 20, nodes=500)
        used = {}
        for pattern, bins in packing:
            assert sum(n * k for n, k in pattern) <= 20
            for n, k in pattern:
                used[n] = used.get(n, 0) + k * bins
        best = fewest(items, 20)
        assert used == counts and bin_completion.lower_bound(counts, 20) <= best <= sum(b for _, b in packing)
        gaps += sum(b for _, b in packing) - best
    assert gaps == 0


def test_bin_completion_searches_by_default():
    rng, capacity = random.Random(7), 512
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(90, 400), 60)}
    packing, used = bin_completion.complete_bins(counts, capacity), {}
    for pattern, bins in packing:
        assert sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            used[n] = used.get(n, 0) + k * bins
    assert used == counts
    assert bin_completion.lower_bound(counts, capacity) <= sum(b for _, b in packing) <= 605 < sum(b for _, b in bin_completion.best_fit(counts, capacity))


def test_packing(docs, empty, library):
    got = op4_packing.pack_documents(docs, PATH, capacity=256).collect()
    want = sorted((i is None, i, k, a, len(p := x[a : a + 256]), zlib.crc32(p.tobytes())) for i, t in ODD for x in [np.append(ids_of(library, t), 0).astype("<u4")] for k, a in enumerate(range(0, len(x), 256)))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= 256
    assert len(by) == -(-sum(r["length"] for r in got) // 256)
    assert op4_packing.pack_documents(empty, PATH).count() == 0


def test_tiff_codecs():
    sample = bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")
    assert tiff.unpack_bits(bytes.fromhex("feaa0280002afdaa0380002a22f7aa"), len(sample)) == sample  # the format's own example
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    bits += "0" * (-len(bits) % 8)
    assert tiff.lzw_encode(data) == int(bits, 2).to_bytes(len(bits) // 8, "big")
    rng = random.Random(0)
    for n in (0, 1, 2, 300, 9000):
        for x in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.randrange(3) for _ in range(n)), b"\xff" * n):
            assert tiff.unpack_bits(tiff.pack_bits(x), n) == x
            assert tiff.lzw_decode(tiff.lzw_encode(x), n) == x


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((1, 1), (70, 33), (5, 576))]
    got = list(tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, 16, tile)))
    assert all((a == b).all() for a, b in zip(got, pages, strict=True))


def test_tiff_rejects_loops():
    data = bytearray(tiff.write_tiff([np.zeros((2, 2), np.uint8)]))
    at = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack_from("<H", data, at)[0]
    struct.pack_into("<I", data, at + 2 + 12 * n, at)
    with pytest.raises(ValueError):
        list(tiff.read_tiff(bytes(data)))


def test_media_columns(docs, empty):
    files = op5_tiff.store_texts(docs)
    got = rows(op5_tiff.features(op5_tiff.read_pages(files)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in ODD:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want, key=lambda x: (x[0] is None, x))
    same = {r["media_sha256"] for r in op5_tiff.features(op5_tiff.read_pages(files)).where("doc_id in (7, 8)").collect()}
    assert len(same) == 1 and op5_tiff.features(op5_tiff.read_pages(op5_tiff.store_texts(empty))).count() == 0


def lines_removed(texts, percent=90):
    """(document, line) pairs to remove, by comparing every line with every earlier one."""
    lines = [((i, k), frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, t in texts for k, x in enumerate(t.split("\n"))]
    lines = sorted((p, s) for p, s in lines if s)
    return {p for n, (p, s) in enumerate(lines) for q, o in lines[:n] if q < p and 100 * len(s & o) >= percent * len(s | o)}


def test_line_dedup(spark, docs, empty):
    rng = random.Random(7)
    base = [prose(100 + k, rng.choice([3, 9, 12, 30, 60])) for k in range(12)]

    def varied(x):
        w = x.split()
        for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        return " ".join(w)

    texts = [(i, "\n".join(varied(rng.choice(base)) if rng.random() < 0.9 else rng.choice(["", "of.", "and of."]) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    got = {(r["doc_id"], r["line_no"]) for r in op6_line_dedup.removed_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert got == lines_removed(texts)
    out = op6_line_dedup.dedup_lines(docs.drop("n"))
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert out.count() == len(ODD) and by[1][0]["text"] is None and by[2][0]["text"] == "" and by[3][0]["text"] == " \n\t " and by[None][0]["text"] == "no id here"
    assert by[7][0]["n_removed"] == 0 and all(r["text"] == "" and r["n_removed"] == 2 for r in by[8]) and by[8][0]["shard"] == 1
    assert op6_line_dedup.dedup_lines(empty).count() == 0


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["a", "b", "c", "é#", "\n"]) for _ in range(rng.randrange(0, 120)))) for i in range(60)] + ODD
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, words int")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in texts for b in [base_counts(t)]), key=lambda x: tuple((v is None, v) for v in x))
    assert rows(op7_quality.judge(df), "doc_id", *columns) == want
    kept = op7_quality.clean(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {7, 8, 9, 11}  # 6 is one endless line
    cleaned = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert "|" not in cleaned.get(11, "") and op7_quality.clean(empty).count() == 0


def line_fails(line, items):
    """The line rules, one after the other."""
    n = lambda marks: sum(c in marks for c in line)
    bare, spaces = line.rstrip(" \t\n\x0b\x0c\r"), line.count(" ")
    symbols = n("#*$%&|<>!?={}[]^_~@/\\+")
    return (
        (symbols >= 4 and symbols * 100 > len(line) * 8) or (n("|>»•·") >= 4 and n("|>»•·") * 4 >= spaces) or (spaces >= 40 and not n(".!?:;,…。"))
        or bare.endswith(("...", "…")) or line in items or any(p in line.lower() for p in op7_quality.BOILERPLATE)
    )


def test_quality_judges_lines(spark):
    good = "the river runs below the old mill and the light of the morning falls on it , as it did on other days ."
    odd = ["Home", "Home", "About us", "About us ", "Read more", "so the story goes on and on and on ...", "a teaser for another text…", "All Rights Reserved 2020", "Alle Rechte vorbehalten", "Tous droits réservés", "haga clic aquí para ver", "End.", "End.", "(aside)", "(aside)", "Contact", " a | b | c | d | e", "x " * 45, "x, " * 45]
    rng = random.Random(6)
    texts = [(i, "\n".join(rng.sample(odd, rng.randrange(1, 9)) + [good.replace("old", f"old{j}") for j in range(rng.randrange(1, 5))])) for i in range(80)] + [(900, "\n".join(odd)), (901, good), (902, None), (903, "Home\n" * 60)]
    got = {r["doc_id"]: r for r in op7_quality.judge(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        like = [x for x in lines if x.count(" ") <= 3 and x.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?:;,…。\"')]"]
        left = [x for x in lines if not line_fails(x, {x for x in like if like.count(x) > 1})]
        assert got[i]["cleaned"] == "\n".join(left), i
        whole = base_counts(t)
        assert got[i]["kept"] == (not got[i]["base_failed"] and 2 * base_counts("\n".join(left))[1] >= whole[1])


def components_of(sets, percent=75):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_shingles_follow_their_definition():
    def plain(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    texts = [t for _, t in ODD]
    hashes, at = shingle_sets(texts)
    assert np.diff(at).tolist() == [len(plain(t)) for t in texts]
    a, b = (set(hashes[at[k] : at[k + 1]].tolist()) for k in (6, 9))
    assert len(a & b) == len(plain(texts[6]) & plain(texts[9]))


def test_ngram_join(spark, docs, empty):
    rng = random.Random(3)
    source = [prose(200 + k, rng.choice([4, 8, 40, 120])) for k in range(6)]
    texts = []
    for i in range(90):
        w = rng.choice(source).split()
        for _ in range(rng.randrange(0, max(1, len(w) // 15) + 1)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        texts.append((i, rng.choice([" ", "\n"]).join(w) if i % 20 else rng.choice([None, "", "X"])))
    plain = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        plain[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = components_of(plain)
    got = op8_ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(plain[i]), want[i]) for i in plain}
    odd = op8_ngram_join.jaccard_components(docs).collect()
    found = {r["doc_id"]: r["component_id"] for r in odd}
    assert len(odd) == len(ODD) and found[8] == 7 and found[9] == 7 and found[1] == 1 and found[None] is None
    assert op8_ngram_join.jaccard_components(empty).count() == 0


def test_shingle_counts_add_up_in_a_tree(spark, monkeypatch, empty):
    """Whatever the number of tables a group adds up, codes and columns to split are the same, and those of all shingles."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(30)) if i % 9 else "one two three four five six") for i in range(120)]
    described = op8_ngram_join.describe(spark.createDataFrame(rows, "doc_id long, text string").repartition(11)).cache()
    monkeypatch.setattr(op8_ngram_join, "HOT_ROWS", 6)
    flat = op8_ngram_join.shingle_rarity(described)
    monkeypatch.setattr(op8_ngram_join, "FAN_IN", 2)
    tree = op8_ngram_join.shingle_rarity(described)
    described.unpersist()
    assert all(np.array_equal(a, b) for a, b in zip(flat, tree, strict=True))
    hashes, _ = shingle_sets([t for _, t in rows])
    counts = np.bincount((hashes >> np.uint64(64 - op8_ngram_join.BUCKET_BITS)).astype(np.int64), minlength=1 << op8_ngram_join.BUCKET_BITS)
    assert np.array_equal(tree[0], np.minimum(np.log2(counts + 1.0) * 8, 255).astype(np.uint8))
    assert np.array_equal(tree[1], np.flatnonzero(counts >= 6)) and len(tree[1])
    assert not op8_ngram_join.shingle_rarity(op8_ngram_join.describe(empty))[0].any()


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(links).collect()} == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_url_filter(spark):
    d = datetime.date
    entries = spark.createDataFrame([("host:a.org", "spam", d(2024, 1, 10), 1, True), ("host:a.org", "spam", d(2024, 3, 5), 2, False), ("host:a.org", "spam", d(2024, 3, 5), 3, True), ("host:a.org", "spam", d(2024, 4, 1), 4, False), ("path:x.a.org/p", "adult", d(2024, 2, 1), 5, True), (None, "spam", d(2024, 1, 1), 6, True)], "key string, category string, day date, entry_id long, listed boolean")
    captures = [(1, "http://x.a.org/p/q", d(2024, 1, 9)), (2, "http://x.a.org/p/q", d(2024, 1, 10)), (3, "https://u@X.A.org:80/p?z", d(2024, 3, 31)), (4, "http://x.a.org/", d(2024, 4, 1)), (5, None, d(2024, 2, 2)), (6, "junk", d(2024, 2, 2)), (7, "http://a.org", None), (7, "http://a.org", None)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    got = rows(op9_url_filter.filter_captures(frame, op9_url_filter.validity_intervals(entries)), "page_id", "n_matches", "categories", "kept")
    assert got == [(1, 0, "", True), (2, 1, "spam", False), (3, 2, "adult,spam", False), (4, 0, "", True), (5, 0, "", True), (6, 0, "", True), (7, 0, "", True), (7, 0, "", True)]
    assert op9_url_filter.filter_captures(frame, op9_url_filter.validity_intervals(entries.where("false"))).where("kept").count() == 8
    assert op9_url_filter.filter_captures(frame.where("false"), op9_url_filter.validity_intervals(entries)).count() == 0


def test_url_filter_derives_hosts_paths_and_domains(spark):
    pages = spark.createDataFrame([(i, "http://x.a.org/p/q?r") for i in (0, 4, 8, 5)], "page_id long, url string")
    assert rows(op9_url_filter.derived_entries(pages), "entry_id", "key") == [(0, "host:a.org"), (4, "host:x.a.org"), (8, "path:x.a.org/p/q")]


def test_url_filter_takes_every_prefix_of_a_path(spark):
    d = datetime.date(2024, 1, 10)
    entries = spark.createDataFrame([("path:a.org/p/q", "spam", d, 1, True), ("path:x.a.org/p/q/r", "adult", d, 2, True), ("host:b.org", "spam", d, 3, True)], "key string, category string, day date, entry_id long, listed boolean")
    urls = ["http://a.org/p/q/r/s?x/y", "http://a.org/p/qq", "http://a.org/p/", "https://u@X.a.org:8/p/q/r/#/z", "http://a.org//p/q", "http://a.org", "http://y.x.b.org/p"]
    frame = spark.createDataFrame([(i, u, d) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    got = rows(op9_url_filter.filter_captures(frame, op9_url_filter.validity_intervals(entries)), "page_id", "n_keys", "n_matches", "categories")
    assert got == [(0, 5, 1, "spam"), (1, 3, 0, ""), (2, 2, 0, ""), (3, 5, 1, "adult"), (4, 3, 0, ""), (5, 1, 0, ""), (6, 4, 1, "spam")]


def test_sharding(spark, docs, empty):
    got = op10_sharding.assign_shards(docs, shards=4).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD)
    many = spark.createDataFrame([(i * 7 % 1000, "x" * (i % 50)) for i in range(1000)], "doc_id long, text string").repartition(6)
    out = op10_sharding.assign_shards(many).collect()
    total, at, by = sum(r["size"] for r in out), 0, {}
    for r in sorted(out, key=lambda r: r["doc_id"]):
        assert r["shard"] == min(23, (2 * at + r["size"]) * 24 // (2 * total))
        at += r["size"]
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(24)) and all(s == list(range(len(s))) for s in by.values())
    assert op10_sharding.assign_shards(empty).count() == 0


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    lines = ["alpha beta gamma", "alpha beta gamma", "delta epsilon zeta"]
    df = spark.createDataFrame(list(zip([1, 8, 8], lines, [5, 6, 7])), "doc_id long, text string, `a.b` int")
    got = op6_line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "a.b", "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["a.b"]) for r in got.collect()) == [(1, lines[0], 5), (8, "", 6), (8, lines[2], 7)]
    words = spark.createDataFrame([(1, prose(9, 80) + ".", 3)], "doc_id long, text string, `a.b` int")
    assert op7_quality.clean(words).columns == ["doc_id", "text", "a.b"]


def test_piece_table_grows_and_starts_anew():
    from riskloom.llm.pieces import PieceTable

    table = PieceTable(slots=16)
    learn = lambda pieces: [np.array([len(p), ord(p[0])], "<u4").tobytes() for p in pieces]
    rng = random.Random(6)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(0, 30))).encode() for _ in range(4)]
        assert table.encode(texts, learn) == [b"".join(learn(t.decode().split())) for t in texts]
