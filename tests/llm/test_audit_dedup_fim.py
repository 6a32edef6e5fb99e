"""Source divergence, substring dedup and fill-in-middle against brute force, and on odd inputs."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import divergence, fim, substring_dedup
from flowtide.llm.queries import QUERIES

from .odd import TEXTS, documents, prose

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def given(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 11 divergence ----------------------------------------------------------------------------------------------------

_FOLD = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least=10):
    """Every group, every kept term, one by one."""
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))
        df[lang or ""].update(set(terms))
        groups[lang or "", source or ""].update(terms)
    out = []
    for lang in df:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        own = {s: c for (k, s), c in groups.items() if k == lang}
        whole = sum(own.values(), Counter())

        def weights(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, w = weights(whole), {s: weights(c) for s, c in own.items()}
        for s, p in w.items():
            pairs = [(o, sum(f(p[t], v[t]) for t in kept)) for o, v in w.items() if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if own[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out, key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


def test_audit_query(spark):
    want = plain_audit(given(spark.read.parquet(f"{SF}/documents.parquet")))
    assert {w[2] for w in want} == {"pair", "term"}
    assert got(QUERIES["op11_source_divergence"](spark, SF), *AUDIT) == want


@pytest.mark.parametrize("least, sources", [(1, 64), (2, 2), (1, 1), (10, 64)])
def test_audit_odd(spark, least, sources):
    df = documents(spark)
    assert got(divergence.audit(df, least, sources), *AUDIT) == plain_audit(given(df), least)


def test_audit_empty(spark):
    assert divergence.audit(documents(spark, [])).collect() == []


def test_levels_against_every_term():
    """Joint cells and complements give the sum over all terms, with bitsets, single bits, and ids at word edges."""
    rnd = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 3000, 1 << 15):
        for scale in (2, 40, 5000):
            n = [np.minimum(rnd.integers(0, scale, size), rnd.integers(0, scale, size)) for _ in range(2)]
            held = []
            for c in n:
                rows = []
                for v in sorted(set(c.tolist()) - {0}):
                    ids = np.flatnonzero(c == v)
                    rows.append({"count": v, "terms": len(ids), "few": len(ids) <= divergence.FEW, "bits": divergence._bits(ids)})
                held.append(divergence.Levels(rows, int(c.sum()), size))
                ids, of = held[-1].terms()
                assert ids.tolist() == np.flatnonzero(c).tolist()
            p, q = ([1 + 10 ** 9 * (int(x) + 2) // (int(c.sum()) + 2 * size) for x in c] for c in n)
            want = sum((a - b) ** 2 // (a + b) for a, b in zip(p, q))
            assert divergence.divergence(*held, size) == divergence.divergence(*held[::-1], size) == want


# --- 12 substrings ----------------------------------------------------------------------------------------------------

def plain_removal(texts, target):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]
    at = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - target + 1):
            at[tuple(w[i:i + target])].append((d, i))
    gone = {(d, i + k) for places in at.values() if len(places) > 1 for d, i in places for k in range(target)}
    return [(len(w), sum((d, i) in gone for i in range(len(w))), " ".join(x for i, x in enumerate(w) if (d, i) not in gone))
            for d, w in enumerate(words)]


KEPT = ("doc_id", "n_words", "n_removed", "kept")


def wanted(rows, target=35):
    return sorted(((r[0], *x) for r, x in zip(rows, plain_removal([r[1] for r in rows], target))), key=repr)


def test_removal_query(spark):
    rows = given(spark.read.parquet(f"{SF}/documents.parquet"))
    want = sorted(((i, n, m, sha(kept)) for i, n, m, kept in wanted(rows)), key=repr)
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    assert got(QUERIES["op12_substring_dedup"](spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 1, "range_hashes": 50}, {"target": 10, "first": 3}, {"target": 5, "first": 5}, {"target": 40, "first": 2},
                                {"target": 1, "first": 9}])
def test_removal_odd(spark, kw):
    df = documents(spark)
    assert got(substring_dedup.without_repeats(df, **kw), *KEPT) == wanted(given(df), kw.get("target", 35))


def test_removal_cases(spark):
    """Overlaps with itself, a passage at every place in a text, ends of texts, near copies, case, white space."""
    passage = prose(50, 40)
    texts = ["a " * 36, "b " * 35, "c d " * 40, passage, "x " + passage, passage + " y", prose(51, 300) + " " + passage + " " + prose(52, 200),
             passage.upper(), passage.replace(" ", "\n\t "), " ".join(passage.split()[:34]), prose(53, 500),
             prose(53, 250) + " new " + " ".join(prose(53, 500).split()[250:]), " ".join(passage.split()[:35]), ""]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    df = documents(spark, rows)
    assert got(substring_dedup.without_repeats(df.repartition(3), block_bytes=1000, range_hashes=100), *KEPT) == wanted(rows)


def test_removal_hot(spark):
    """One passage in every text: a range gets it once a block, whatever the number of texts."""
    rows = [(i, prose(1000 + i, 20) + " " + prose(7, 60) + " " + prose(5000 + i, 20), "en", "s") for i in range(400)]
    df = documents(spark, rows).coalesce(2)
    assert got(substring_dedup.without_repeats(df), *KEPT) == wanted(rows)
    levels = substring_dedup.lengths()
    blocks = substring_dedup._blocks(df, "doc_id", "text", 1 << 20)
    sent = blocks.drop("ids", "most_words").mapInArrow(substring_dedup._sending(levels[-1:], [1]), substring_dedup._SENT).collect()
    assert sum(len(r["keys"]) // 8 for r in sent) < 400 * 66 - 398 * 25


def test_removal_empty(spark):
    assert substring_dedup.without_repeats(documents(spark, [])).collect() == []
    assert substring_dedup.lengths() == [9, 18, 35] and substring_dedup.lengths(9, 100) == [9, 18, 36, 72, 100]


def test_agreeing_keys():
    """Windows that agree in 64 bits are told apart by the others; keys are packed without loss."""
    keys, marks = np.array([9, 5, 5, 5, 5], np.uint64), np.array([2, 7, 1, 7, 3], np.uint16)
    k, m, n, which = substring_dedup._distinct(keys, marks)
    assert (k.tolist(), m.tolist(), n.tolist(), which.tolist()) == ([5, 5, 5, 9], [1, 3, 7, 2], [1, 1, 2, 1], [3, 2, 0, 2, 1])
    for sent in ([], [0], [1, 2 ** 63, 2 ** 64 - 1], sorted(np.random.default_rng(1).integers(0, 2 ** 63, 999).tolist())):
        assert substring_dedup._unpacked_keys(substring_dedup._packed_keys(np.array(sent, np.uint64))).tolist() == sent


# --- 13 fill in the middle --------------------------------------------------------------------------------------------

def plain_fim(doc_id, text, seed=7, fim_percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


FIM = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def wanted_fim(rows, **kw):
    return sorted(((i, *(x := plain_fim(i, t, **kw))[:4], sha(x[4]), sha(t or "")) for i, t, *_ in rows), key=repr)


def test_fim_query(spark):
    rows = given(spark.read.parquet(f"{SF}/documents.parquet"))
    want = wanted_fim(rows)
    assert {w[2] for w in want} >= {"psm", "spm"}
    assert got(QUERIES["op13_fill_in_middle"](spark, SF), *FIM) == want


LINES = [(100 + k, t, "en", "a") for k, t in enumerate([
    "\n", "\n\n\n", "a\nb\nc\n", "no end", "ends\n", "<P>", "x <M> y\nz\n", "<", "<P\n<S\n<M\n", "é" * 7 + "\n" + "日本🙂" * 9, "S>\n<\nP>\n<\nM>\n" * 5,
    "\n".join("line %d 🙂" % i for i in range(500)), "\r\nwin\r\nlines\r\n"])]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_fim_odd(spark, chunk):
    rows = [r for r in TEXTS if len(r[1] or "") < 60_000 or chunk > 7] + LINES
    df = documents(spark, rows).repartition(5)
    assert got(fim.transform(df, chunk=chunk), *FIM) == wanted_fim(rows)


def test_fim_shares_and_outputs(spark):
    rows = [(i, f"one {i}\ntwo\nthree 🙂\n", "en", "a") for i in range(300)]
    df = documents(spark, rows)
    kw = {"seed": 11, "fim": 60, "spm": 20}
    want = {i: plain_fim(i, t, 11, 60, 20) for i, t, *_ in rows}
    forms = Counter(w[1] for w in want.values())
    assert forms["plain"] > forms["spm"] > 0
    assert {r["doc_id"]: r["output"] for r in fim.outputs(df, chunk=5, **kw).collect()} == {i: w[4] for i, w in want.items()}
    assert got(fim.transform(df, **kw), *FIM) == wanted_fim(rows, seed=11, fim_percent=60, spm=20)


def test_fim_moves_texts_once(spark):
    plan = fim.transform(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_fim_empty(spark):
    assert fim.transform(documents(spark, [])).collect() == []


def test_restored_from_output(spark):
    """The digests of the restored texts come from the pieces of the output, not from the text."""
    df = documents(spark, LINES)
    broken = fim.pieces(df, chunk=3).withColumn("piece", F.when(F.length("piece") > 3, F.col("piece")).otherwise(F.lit(b"?")))
    back = broken.sortWithinPartitions("doc", "place").mapInArrow(fim._assembled, fim._RETOLD).sortWithinPartitions(
        "doc", "turn", "place").mapInArrow(fim._restored, fim._RESULT).collect()
    assert any(r["restored_sha256"] != sha(t) for r, (_, t, *_) in zip(sorted(back, key=lambda r: int(r["id"])), LINES))
