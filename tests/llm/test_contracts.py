"""The registered queries' results against brute force over whole tables, and each operator on odd inputs."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import (decontaminate, fingerprints, licenses, mixing, near_dup, secrets, sharding, token_counts, token_store,
                          toxicity)
from flowtide.llm.queries import QUERIES

from .odd import LONG, TEXTS, documents, prose

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df):
    return df.collect()


# --- 1 secrets --------------------------------------------------------------------------------------------------------

_KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                                re.I | re.A), 2, 6),
          ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(_KINDS):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secret_query(spark, docs):
    got = {r["doc_id"]: r for r in rows(QUERIES["op1_secret_scan"](spark, SF))}
    assert len(got) == len(docs)
    for i, t in docs:
        spans = base_spans(t)
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))
        for kind in ("assign", "access", "hex"):
            assert got[i][f"n_{kind}"] == sum(s[2] == kind for s in spans)


@pytest.mark.parametrize("text", [
    "password=token = abcdefgh", "token = 'ab' secret=abcdef", "AKIA" * 7, "PASSWORD\": \"abcdef\"", "api_key==abc/def=",
    "🙂🙂token=abcdef🙂 " + "0123456789abcdef" * 4, "ab" * 11 + "A" + "c" * 24, "ſecret=abcdef secret=abcdef"])
def test_secret_positions(spark, tmp_path, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = rows(secrets.scan_versions(df, str(tmp_path / "l"), secrets.BASE))[0]["findings"]
    assert [(f["start"], f["kind"], f["end"]) for f in got] == [(a, k, b) for a, _, k, b in base_spans(text)]


def test_ledger_is_incremental(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, "password=abcdef"), (2, "password=abcdef"), (3, None)], "doc_id int, text string")
    two = one.unionAll(spark.createDataFrame([(4, "token=zzzzzz")], "doc_id int, text string"))
    rows(secrets.scan_versions(one, path, secrets.BASE[:1]))
    ledger = spark.read.parquet(path)
    assert ledger.count() == 2                                  # two blobs at three paths
    rows(secrets.scan_versions(two, path, secrets.BASE[:1]))
    assert spark.read.parquet(path).count() == 3                # only the new blob
    got = rows(secrets.scan_versions(two, path, secrets.BASE[:2]))
    batch = [r for r in spark.read.parquet(path).collect() if r["versions"] == ["access@1"]]
    assert len(batch) == 3                                      # the new rule alone, for every blob
    assert {r["doc_id"]: [f["kind"] for f in r["findings"]] for r in got} == {1: ["assign"], 2: ["assign"], 3: [], 4: ["assign"]}


def test_secret_odd(spark, tmp_path):
    got = rows(secrets.scan_versions(documents(spark), str(tmp_path / "a")))
    assert len(got) == len(TEXTS)
    want = {(i, blob_text(t)): [(a, k, b) for a, _, k, b in base_spans(t)] for i, t, *_ in TEXTS}
    for r in got:
        spans = [(f["start"], f["kind"], f["end"]) for f in r["findings"]]
        assert spans in [v for (i, _), v in want.items() if i == r["doc_id"]]
    assert rows(secrets.scan_versions(documents(spark, []), str(tmp_path / "b"))) == []


def blob_text(t):
    return t or ""


# --- 2 token store ----------------------------------------------------------------------------------------------------

def test_pack_round_trip():
    for bits in (1, 5, 11, 16, 17, 31):
        for n in (0, 1, 4095, 4096, 4097, 9001):
            ids = np.random.default_rng(n).integers(0, 2 ** bits, n).astype("<u4")
            seg = token_store.pack(ids, bits)
            assert (token_store.unpack(seg) == ids).all()
            assert (token_store.unpack(seg, n // 3, n - 1) == ids[n // 3:max(n // 3, n - 1)]).all()
    with pytest.raises(ValueError):
        token_store.pack(np.array([8], "<u4"), 3)


def whole(text, tok):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_token_query(spark, docs):
    tok, start = tokenizer(), 0
    got = {r["doc_id"]: r for r in rows(QUERIES["op2_token_store"](spark, SF))}
    assert len(got) == len(docs)
    for i, t in sorted(docs):
        ids = whole(t, tok)
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_store_odd(spark, tmp_path):
    import public_tokenizers

    file, tok = str(public_tokenizers.path("word_bpe_49k.json")), tokenizer()
    path = str(tmp_path / "store")
    token_store.write_store(documents(spark), path, file, 49_408, 2, segment=1000, block=64)
    got = sorted(rows(token_store.documents_of(spark, path)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((t[0] for t in TEXTS), key=lambda i: (i is not None, i))
    lengths = sorted(len(whole(t[1], tok)) for t in TEXTS)
    assert sorted(r["n_tokens"] for r in got) == lengths
    total = sum(lengths)
    everything = token_store.read_range(spark, path, 0, total)
    assert len(everything) == total and (token_store.read_range(spark, path, 700, 33_000) == everything[700:33_000]).all()
    for r in got:
        assert zlib.crc32(everything[r["start"]:r["start"] + r["n_tokens"]].tobytes()) == r["ids_crc32"]
    token_store.write_store(documents(spark, []), str(tmp_path / "none"), file, 49_408, 2)
    assert rows(token_store.documents_of(spark, str(tmp_path / "none"))) == []


def test_encoder_equals_library():
    import public_tokenizers

    enc, tok = token_store.Encoder(str(public_tokenizers.path("word_bpe_49k.json")), limit=50), tokenizer()
    odd = ["", "Été  İstanbul ΣΑΣ σ don't I'LL <|endoftext|>x a<|startoftext|>b", "\x1c a\x1db é é Å 日本語 ²x µm 12,5%% ×÷ ſ ǅ ɏ",
           "a b\u0085c d", "'s's'd 'x don''t", "\x00x\x7fy\x0bz", "ŉ ĸ İ ı ß ẞ ﬁ", "🙂a🙂", LONG]
    for _ in range(2):
        for text, ids in zip(odd, enc.encode(odd)):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text[:50]


# --- 3 fingerprints ---------------------------------------------------------------------------------------------------

def jaccard(a, b):
    def grams(t):
        w = re.split("[\x20\x09-\x0d]+", (t or "").lower())
        w = [x for x in w if x]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def edited_texts(pairs):
    order = sorted(pairs, key=lambda p: -p[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        yield i, t, t[:len(t) - half] + nxt[:half], nxt


def test_fingerprint_query(spark, docs):
    got = {r["doc_id"]: r for r in rows(QUERIES["op3_fingerprints"](spark, SF))}
    assert len(got) == len(docs)
    prints, off = defaultdict(set), []
    for i, t, edited, nxt in edited_texts(docs):
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == sha(edited)
        prints[t].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
        off.append(abs(r["near_edited"] - jaccard(t, edited)))
        assert abs(r["near_next"] - jaccard(t, nxt)) < 0.25
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean(off) < 0.05 and max(off) < 0.25


def test_fingerprint_many_buckets(spark):
    pairs = [(7 * i - (3000 if i % 5 else 0), prose(i % 50, 12)) for i in range(1500)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["edited_sha256"] for r in rows(fingerprints.edited_pairs(df))}
    assert got == {i: sha(e) for i, _, e, _ in edited_texts(pairs)}


def test_fingerprint_frequent_ids(spark):
    """Rows without an id and rows of one id are spread over buckets, in the order of their hashes."""
    pairs = ([(None, f"no id {i} " + prose(i % 40, 8)) for i in range(2500)] + [(900, f"same {i} " + prose(i % 30, 9)) for i in range(3000)]
             + [(i, f"own {i} " + prose(i % 20, 7)) for i in range(0, 2000) if i != 900])
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    hashed = [((-1 if r[0] is None else r[0]), r[1], r[2]) for r in rows(df.select("doc_id", "text", F.xxhash64("text")))]
    order = [(k, t) for k, t, h in sorted(hashed, key=lambda r: (-r[0], r[2]))]
    want = Counter()
    for at, (k, t) in enumerate(order):
        nxt, half = order[(at + 1) % len(order)][1], len(t) // 2
        want[(None if k == -1 else k), sha(t[:len(t) - half] + nxt[:half])] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in rows(fingerprints.edited_pairs(df))) == want
    placed = fingerprints._neighbours(df.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("_k"), F.xxhash64("text").alias("_h")))
    sizes = [r["count"] for r in rows(placed.groupBy("_b").count())]
    assert sum(sizes) == len(pairs) + len(sizes) and max(sizes) <= 3 * fingerprints.BUCKET_ROWS


def test_fingerprint_odd(spark):
    got = rows(fingerprints.edited_pairs(documents(spark)))
    assert len(got) == len(TEXTS)
    by = defaultdict(set)
    for r in got:
        by[r["n_chars"]].add(tuple(r["own"]))
    assert len(by[0]) == 1 and len(by[50_000]) == 1
    assert rows(fingerprints.edited_pairs(documents(spark, []))) == []
    one = rows(fingerprints.edited_pairs(documents(spark, [(4, "alone here", "en", "a")])))[0]
    assert one["edited_sha256"] == sha("alone" + "alone") and one["own"] == one["next"]


# --- 4 shards ---------------------------------------------------------------------------------------------------------

def test_shard_query(spark, docs):
    got = rows(QUERIES["op4_byte_shards"](spark, SF))
    check_shards([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got], docs, 16)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def check_shards(got, pairs, shards):
    assert sorted(g[:3] for g in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    got.sort(key=lambda g: (g[3], g[4]))
    assert [g[0] for g in got] == sorted(g[0] for g in got)
    sizes, largest = defaultdict(int), max(g[1] for g in got)
    for s in range(shards):
        own = [g for g in got if g[3] == s]
        assert [g[4] for g in own] == list(range(len(own)))
        sizes[s] = sum(g[1] for g in own)
    mean = sum(g[1] for g in got) / shards
    assert all(abs(sizes[s] - mean) <= largest for s in range(shards))


def test_shards_odd(spark):
    known = [t for t in TEXTS if t[0] is not None]
    got = rows(sharding.shard_by_bytes(documents(spark, known), 3))
    check_shards([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got], [t[:2] for t in known], 3)
    assert len(rows(sharding.shard_by_bytes(documents(spark), 3))) == len(TEXTS)
    assert rows(sharding.shard_by_bytes(documents(spark, []), 3)) == []


# --- 5 token counts ---------------------------------------------------------------------------------------------------

def unigram():
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.read_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(token_counts.MARK, "always", True)
    return tok


def test_count_query(spark, docs):
    tok = unigram()
    got = {r["doc_id"]: r["n_tokens"] for r in rows(QUERIES["op5_token_counts"](spark, SF))}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in docs}


def test_count_odd(spark):
    import public_tokenizers

    tok, file = unigram(), str(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a  b", " lead", "trail ", "  two", "x\n\ny", "日本語 テ", "▁▁", "▁▁b ▁", "☃☃☃ q☃q☃", "a" * 3000]
    made = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = rows(token_counts.count_tokens(documents(spark, TEXTS + made), file))
    want = sorted(len(tok.encode(t[1] or "", add_special_tokens=False).ids) for t in TEXTS + made)
    assert sorted(r["n_tokens"] for r in got) == want
    assert rows(token_counts.count_tokens(documents(spark, []), file)) == []


def test_count_ties():
    from tokenizers import models

    vocab = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("bab", -3.0), ("c", -9.0)]
    model, counter = models.Unigram(vocab, 0, False), token_counts.Counter(vocab[1:])
    for n in range(1, 7):
        for k in range(4 ** n):
            word = "".join("abcx"[(k >> 2 * j) & 3] for j in range(n))
            assert counter.count(word) == len(model.tokenize(word)), word


# --- 6 licences -------------------------------------------------------------------------------------------------------

def test_licenses(spark):
    files = spark.createDataFrame([
        ("LICENSE", "Released under the MIT License."), ("a/x.py", "code without a notice"), ("a/b/y.py", "no notice either"),
        ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/z.py", "nothing"),
        ("a/b/own.py", "first line\nAll rights reserved.\nmore"), ("d/e.py", None), ("a/b/c/z.py", "nothing"),
        ("g.py", "This work is licensed under the GNU General Public License, version 3."),
        ("h.py", "This work is licensed under the GNU General Public License, version 2."), (None, "x"),
    ], "path string, text string")
    speaks = F.col("path").rlike(r"(^|/)LICENSE$")
    clash = files.withColumns({c: F.lit("own") for c in ("license", "cosine", "own_license", "inherited_from", "dir", "_dir")})
    got = sorted((r["path"], r["own_license"], r["license"], r["inherited_from"]) for r in rows(licenses.scan(clash, speaks)))
    assert got == sorted([
        ("", None, "MIT", ""), ("LICENSE", "MIT", "MIT", None), ("a/x.py", None, "MIT", ""), ("a/b/y.py", None, "Apache-2.0", "a/b"),
        ("a/b/LICENSE", "Apache-2.0", "Apache-2.0", None), ("a/b/c/z.py", None, "Apache-2.0", "a/b"),
        ("a/b/c/z.py", None, "Apache-2.0", "a/b"), ("a/b/own.py", "Proprietary", "Proprietary", None), ("d/e.py", None, "MIT", ""),
        ("g.py", "GPL-3.0", "GPL-3.0", None), ("h.py", "GPL-2.0", "GPL-2.0", None)])
    assert rows(licenses.scan(files.limit(0), speaks)) == []


def plain_licence(text):
    """TF-IDF by the definition: every unit against every template."""
    bag = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    bags = [(name, bag(t)) for name, t in licenses.TEMPLATES]
    seen = Counter(t for _, b in bags for t in b)
    idf = lambda t: np.log((1 + len(bags)) / (1 + seen[t])) + 1
    norm = lambda b: np.sqrt(sum((n * idf(t)) ** 2 for t, n in b.items()))
    norms = [norm(b) for _, b in bags]
    marks = lambda s: sum(bool(re.search(m, s, re.I)) for m in licenses.MARKS)
    units = [(0, text)] + [(1, s) for s in re.split(licenses.PARAGRAPH_END, text)] + [(2, s) for s in re.split(licenses.SENTENCE_END, text)]
    found = []
    for kind, s in units:
        if marks(s) >= (licenses.LONG_MARKS if kind < 2 else 1):
            own = bag(s)
            for (name, b), size in zip(bags, norms):
                both = set(own) & set(b)
                if sum(t not in licenses.COMMON and not (t.isdigit() and len(t) < 2) for t in both) > 1:
                    found.append((-round(sum(own[t] * b[t] * idf(t) ** 2 for t in both) / norm(own) / size, 6), name, kind))
    best = min((x for x in found if -x[0] >= licenses.LEAST), default=None)
    return best and (best[1], -best[0], ("whole", "paragraph", "sentence")[best[2]])


MIT = next(t for n, t in licenses.NOTICES if n == "MIT" and t.startswith("Permission"))
GNU = next(t for n, t in licenses.NOTICES if n == "GPL-3.0" and "free software" in t)
HEADERS = [     # not in the table; as they stand in files
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("Licensed under MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os\n", "GPL-2.0"), (MIT, "MIT"), (GNU, "GPL-3.0"),
    ("MIT License\n\nCopyright (c) 2020 Some One\n\n" + MIT.replace(". ", ".\n"), "MIT"),
    ("/*\n * " + re.sub("((?:\\S+ ){12})", "\\1\n * ", GNU) + "\n */\nint main() { return 0; }\n", "GPL-3.0"),
    ("def f():\n    pass\n\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file.\n", "Apache-2.0"),
    ("The mit licenced reader permits nothing.", None), ("A story about a copyright lawyer who had a licence to fish.", None),
    ("no mark at all", None), ("", None)]


def test_license_headers_and_files(spark):
    texts = [*HEADERS, (prose(3, 400) + "\n\n" + MIT + "\n\n" + prose(4, 400), "MIT")]
    files = spark.createDataFrame([(f"d{k}/f", t) for k, (t, _) in enumerate(texts)] + [("d0/f", "another text of this path")],
                                  "path string, text string")
    got = {(r["path"], k): r for k, r in enumerate(rows(licenses.scan(files, F.lit(False))))}
    assert len(got) == len(texts) + 1
    by = defaultdict(list)
    for (path, _), r in got.items():
        by[path].append((r["own_license"], r["cosine"], r["license_unit"]))
    for k, (t, name) in enumerate(texts):
        want = plain_licence(t)
        assert (want and want[0]) == name and (want or (None, None, None)) in by[f"d{k}/f"], t
    assert sorted(map(str, by["d0/f"])) == sorted(map(str, [("Apache-2.0", 1.0, "sentence"), (None, None, None)]))


def test_license_query(spark, docs):
    got = rows(QUERIES["op6_license_scan"](spark, SF))
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        want = plain_licence(texts[r["doc_id"]] or "")
        assert (r["own_license"], r["cosine"], r["license_unit"]) == (want or (None, None, None))
    assert any(r["own_license"] for r in got) and not all(r["own_license"] for r in got)


def test_license_rows_without_id(spark, tmp_path):
    """Rows without an id are files of their own; one's notice is not another's."""
    rows_ = [(None, MIT, "en", "a"), (None, "a story without any notice", "en", "b"), (None, None, "en", "b"), (7, "text", "en", "b"),
             (None, "another story", "en", "a")]
    documents(spark, rows_, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(QUERIES["op6_license_scan"](spark, str(tmp_path)))
    assert len({r["path"] for r in got}) == 5
    assert sorted((str(r["own_license"]), str(r["license"]), str(r["inherited_from"])) for r in got) == sorted([
        ("MIT", "MIT", "None"), ("None", "MIT", "a/en"), *[("None", "None", "None")] * 3])


# --- 7 toxicity -------------------------------------------------------------------------------------------------------

def told(labels, texts):
    """By brute force: the words that at least three toxic training rows hold, and toxic rows twenty times as often."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    bags = {i: set(re.findall(r"\w+", (texts.get(i) or "").lower())) for i in labels}
    n = [sum(1 for i, y in labels.items() if y == k and not held(i)) for k in (0, 1)]
    seen = [Counter(w for i, y in labels.items() if y == k and not held(i) for w in bags[i]) for k in (0, 1)]
    cues = {w for w, k in seen[1].items() if k >= 3 and k / n[1] > 20 * (seen[0][w] + 0.5) / n[0]}
    return {i for i in labels if bags[i] & cues}


def test_toxicity_held_out(spark):
    """A text with an insult is caught; a label without any cue in its text cannot be learnt from the text (4 of 18 here,
    some 6 % at the larger size), so recall over all labels has the bound of its binomial."""
    for size, least in (("0.01", 0.6), ("0.1", 0.93 - 3 * (0.93 * 0.07 / 144) ** 0.5)):
        sf = f"/root/testdata/sf{size}"
        labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        got = rows(QUERIES["op7_toxicity"](spark, sf))
        assert len(got) == len(texts)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        held = {r["doc_id"]: r["predicted"] for r in got if r["held_out"] and r["doc_id"] in labels}
        toxic, clear = [i for i in held if labels[i]], told(labels, texts)
        caught = [i for i in toxic if held[i]]
        assert len(caught) >= 0.9 * sum(held.values()) and len(caught) >= least * len(toxic)
        assert sum(held[i] for i in toxic if i in clear) >= 0.95 * sum(i in clear for i in toxic)


def test_toxicity_short_words(spark):
    """A toxic word of three letters is learnt; it stands for itself, not for longer words."""
    rows_ = [(i, prose(i, 30) + (" zug" if i % 4 == 0 else " zugo zugabe" if i % 4 == 1 else ""), "en", "a") for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(documents(spark, rows_), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert b"zug" in model.stems and model.score("you zug you") > 0.7 > 0.3 > model.score("you zugo you")


def test_toxicity_unlabelled_rows_vote(spark):
    """Rows without a label take part, at most `per_class` of them, and rows of held-out labels by their texts alone."""
    rows_ = [(i, f"word{i}", "en", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    picked = [(r["_y"], int(r["_t"][4:])) for r in rows(toxicity.sample(documents(spark, rows_), labels, 50))]
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for y, i in picked if y >= 0} == set(range(60)) - held
    assert sum(y < 0 for y, _ in picked) == 50 and all(i >= 60 or i in held for y, i in picked if y < 0)


def test_toxicity_reads_no_held_out_label(spark):
    rows_ = [(i, prose(i, 30) + (" zorgle" if i % 4 == 0 else ""), "en", "a") for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    one, two = (toxicity.fit(documents(spark, rows_), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert one.stems == two.stems and np.allclose(one.weights, two.weights)
    assert one.score("what a zorgle this is") > 0.7 > 0.3 > one.score("what a day this is")


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (8, 0), (8, 1), (99, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(documents(spark), known)
        got = rows(toxicity.score(documents(spark), model))
        assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
        assert model.score("you stupid idiot, you are pathetic scum") > model.score("good day") == model.score(None)
        assert rows(toxicity.score(documents(spark, []), model)) == []


def test_label_model():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in (0.9, 0.8, 0.7, 0.6, 0.5)], axis=1)
    votes = np.hstack([votes, votes[:, 3:4], votes[:, 3:4]])           # two copies of a weak voter
    votes[rng.random(votes.shape) < 0.3] = -1
    post, theta, weight = toxicity.label_model(votes)
    right = [(theta[1, j, 2] / theta[1, j, 1:].sum() + theta[0, j, 1] / theta[0, j, 1:].sum()) / 2 for j in range(3)]
    assert np.abs(np.array(right) - (0.9, 0.8, 0.7)).max() < 0.05
    assert ((post > 0.5) == y).mean() > 0.8 and weight[5] < 0.8 and weight[0] > 0.8


# --- 8 mixing ---------------------------------------------------------------------------------------------------------

def test_mixing_meets_targets(spark, docs):
    got = rows(QUERIES["op8_source_mixing"](spark, SF))
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in docs)
    for margin, power in mixing.POWER.items():
        own, kept = defaultdict(float), defaultdict(float)
        for r in got:
            own[r[margin]] += r["n_tokens"]
            kept[r[margin]] += r["n_tokens"] * r["probability"]
        want = {k: v ** power for k, v in own.items()}
        for k in want:
            assert abs(kept[k] / sum(kept.values()) - want[k] / sum(want.values())) < 1e-6
    assert max(r["probability"] for r in got) == 1
    for r in got:
        u = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert r["kept"] == (u < r["probability"])


def test_mixing_odd(spark):
    got = rows(mixing.calibrate(documents(spark), mixing.POWER))
    assert len(got) == len(TEXTS) and all(0 < r["probability"] <= 1 for r in got)
    assert rows(mixing.calibrate(documents(spark, []), mixing.POWER)) == []


def mixed(spark, cells, **kw):
    """Rows of one document for each (source, lang, topic, words), calibrated."""
    df = spark.createDataFrame([(i, " ".join(["w"] * (n - 1)), s, g, t) for i, (s, g, t, n) in enumerate(cells)],
                               "doc_id long, text string, source string, lang string, topic string")
    return {r["doc_id"]: r for r in rows(mixing.calibrate(df, mixing.POWER, topic=F.col("topic"), **kw))}


def expected(got):
    return sum(r["n_tokens"] * r["probability"] for r in got.values()) / sum(r["n_tokens"] for r in got.values())


def test_mixing_rare_source(spark):
    """One short document of its own source neither empties the mixture nor is itself left out."""
    even = [(s, g, t, 3000) for s in "abc" for g in ("en", "de") for t in ("x", "y")]
    assert expected(mixed(spark, even)) > 0.99
    got = mixed(spark, [*even, ("rare", "en", "x", 5)])
    assert abs(expected(got) - mixing.KEEP) < 1e-6 and got[len(even)]["probability"] == 1
    assert min(r["probability"] for r in got.values()) > 0.3
    assert abs(expected(mixed(spark, [*even, ("rare", "en", "x", 5)], keep=0.9)) - 0.9) < 1e-6


def test_mixing_targets_that_do_not_hold_together(spark):
    """A value of source and lang with the same documents has two targets for one cell; a source within a language of
    almost no others has a target beyond what the language gets."""
    even = [(s, g, t, 2000 + 100 * k) for k, s in enumerate("abc") for g in ("en", "de") for t in ("x", "y")]
    for odd in ([(None, None, "x", 50)], [("A", "is", "x", 1000), ("a", "is", "x", 3)]):
        cells = [*even, *odd]
        got = mixed(spark, cells)
        assert len(got) == len(cells) and all(0.01 < r["probability"] <= 1 for r in got.values())
        assert expected(got) >= mixing.KEEP - 1e-6
        for margin, power in mixing.POWER.items():      # the values that others share are near their targets
            own, kept = defaultdict(float), defaultdict(float)
            for r in got.values():
                if r["source"] in ("a", "b", "c") and r["lang"] in ("en", "de"):
                    own[r[margin]] += r["n_tokens"]
                    kept[r[margin]] += r["n_tokens"] * r["probability"]
            want = {k: v ** power for k, v in own.items()}
            for k in want:
                assert abs(kept[k] / sum(kept.values()) - want[k] / sum(want.values())) < 0.02


def test_mixing_draw_is_of_rows(spark):
    """Rows without an id, or with that of another, are drawn by themselves."""
    docs_ = [(None if k % 3 else k, prose(k, 20), "en", "ab"[k % 2]) for k in range(400)]
    df = documents(spark, docs_ + [(500, prose(9, 5000), "en", "a")])
    got = rows(mixing.draw(df, mixing.POWER, keep=0.3))
    free = sum(r["doc_id"] is None for r in got)
    assert 0 < free < sum(r[0] is None for r in docs_)
    want = [r for r in rows(mixing.calibrate(df, mixing.POWER, keep=0.3)) if r["kept"]]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in want)


# --- 9 near duplicates ------------------------------------------------------------------------------------------------

def grams(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x)
         for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(pairs, percent):
    sets = [(i, grams(t)) for i, t in pairs]
    up = {i: i for i, _ in pairs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    posting = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            posting[g].append(k)
    for k, (i, s) in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for o in posting[g]:
                if o < k:
                    common[o] += 1
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o][1]) - n):
                a, b = find(i), find(sets[o][0])
                up[max(a, b)] = min(a, b)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_query(spark, sf):
    d = [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(QUERIES["op9_near_duplicates"](spark, f"/root/testdata/{sf}"))
    assert {tuple(r) for r in got} == near_brute(d, 85) and len(got) == len(d)


def test_near_large_group(spark, monkeypatch):
    """Blocks far smaller than the group: every pair of blocks is a task, and no link is lost."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 11)
    pairs = []
    for k in range(120):
        w = prose(4, 90).split()
        for e in range(k % 7):
            w[(k * 31 + e * 17) % 90] = f"edit{k}x{e}"
        pairs.append((k * 3 + 1, " ".join(w)))
    pairs += [(1000 + k, prose(60 + k, 50)) for k in range(40)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    for percent in (80, 85):
        assert {tuple(r) for r in rows(near_dup.near_duplicates(df, percent))} == near_brute(pairs, percent)


def test_near_reach():
    assert near_dup.reach(85) == 25 and near_dup.reach(100) == 0
    rng = np.random.default_rng(1)
    for limit in (8, 25, 30):
        use = near_dup.patterns(limit)
        assert sorted({p for u in use for p in u}) == list(range(64))
        for _ in range(300):
            off = set(rng.choice(64, limit, replace=False).tolist())
            assert any(not off & set(u) for u in use)
            one = rng.integers(0, 9, (1, 64)).astype("<u2")
            two = one.copy()
            two[0, sorted(off)] += 1
            assert near_dup._first_key(limit, one, two)[0] == next(k for k, u in enumerate(use) if not off & set(u))


def test_near_odd(spark):
    known = [t for t in TEXTS if t[0] is not None]
    got = {tuple(r) for r in rows(near_dup.near_duplicates(documents(spark, known), 80))}
    assert got == near_brute([t[:2] for t in known], 80)
    assert len(rows(near_dup.near_duplicates(documents(spark), 80))) == len(TEXTS)
    assert rows(near_dup.near_duplicates(documents(spark, []), 80)) == []


# --- 10 decontamination -----------------------------------------------------------------------------------------------

def bwords(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def contaminated(text, items):
    windows = defaultdict(set)
    for key, t in items:
        w = bwords(t)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            windows[tuple(w[i:i + 10])].add(key)
    sizes, w, hit, found = {len(x) for x in windows}, bwords(text), set(), set()
    for n in sizes:
        for i in range(len(w) - n + 1):
            if (own := windows.get(tuple(w[i:i + n]))) is not None:
                hit.update(range(i, i + n))
                found |= own
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def test_decontamination_query(spark):
    sf = "/root/testdata/sf0.01"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in rows(QUERIES["op10_decontamination"](spark, sf))}
    want = {r["doc_id"]: contaminated(r["text"], items) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want and any(v[4] for v in want.values())


ITEMS = [(1, "a b a b a b a b a b a b c"), (2, "b a b a"), (3, "Ünï 日本 x"), (4, None), (5, "..."), (6, "x"), (7, "b a b a"),
         (8, "one two three four five six seven eight nine ten eleven"), (10, "seven eight nine ten eleven twelve thirteen one two three")]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_decontamination_small(spark, most):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "a-b", "c", "x"], rng.integers(0, 40))) for _ in range(60)]
    texts += ["One,two THREE four five six seven eight nine ten", "ünï 日本 x", "Ünï 日本 x y", None, "", "zz " * 5000 + "b a b a",
              "six seven eight nine ten eleven twelve thirteen one two three four five six seven eight nine ten eleven"]
    docs_ = [(i, t, "en", "a") for i, t in enumerate(texts)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in rows(decontaminate.contamination(documents(spark, docs_), items, most=most))}
    assert got == {i: contaminated(t, ITEMS) for i, t, *_ in docs_}


def test_clean(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs_ = [(1, "before it " + item + " and after", "en", "a"), (2, item, "en", "a"), (3, "all clean", "en", "a"), (4, None, "en", "a"),
             (5, "w0 w1 w2 w3 w4 " + item + " w5 w6 w7 w8 w9 " + prose(1, 50), "en", "a")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in rows(decontaminate.clean(documents(spark, docs_), items, share=0.9))}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1]["text"].split() == "before it and after".split() and got[1]["n_chars"] == len(got[1]["text"])
    assert got[5]["text"].split() == prose(1, 50).split()               # what closed up went as well
    assert rows(decontaminate.clean(documents(spark, []), items)) == []
    assert len(rows(decontaminate.clean(documents(spark), items.limit(0)))) == len(TEXTS)


def test_clean_in_parts(spark):
    """One part or many: documents that lose their words to several parts, and windows that close up over an earlier
    part's item, are judged alike."""
    one, two = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    docs_ = [(1, one + " " + prose(1, 6) + " " + two, "en", "a"), (2, one + " " + prose(2, 40), "en", "a"), (3, None, "en", "a"),
             (4, "a0 a1 a2 a3 a4 a5 " + two + " a6 a7 a8 a9 a10 a11 " + prose(3, 90), "en", "a"), (5, "", "en", "a"),
             (6, "b0 b1 b2 b3 b4 b5 " + one + " b6 b7 b8 b9 b10 b11 " + prose(4, 90), "en", "a"), (7, prose(5, 30), "en", "a")]
    items = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    got = [{r["doc_id"]: tuple(r) for r in rows(decontaminate.clean(documents(spark, docs_), items, most=most))}
           for most in (1_000_000, 3)]
    assert got[0] == got[1] and sorted(got[0]) == [2, 3, 4, 5, 6, 7]
    assert got[1][4][1].split() == prose(3, 90).split() and got[1][6][1].split() == prose(4, 90).split()
