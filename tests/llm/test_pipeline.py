"""Each pipeline stage against brute force on its own input, and the run as a whole."""
import hashlib

import corpus_pipeline
from flowtide.llm import toxicity

from .odd import TEXTS, documents, prose
from .test_contracts import bwords, check_shards, contaminated, near_brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, after = docs, stored(stage(spark, docs, SF), tmp_path / str(k))
        old, new = dict(pairs(before)), None
        if name != "sharding":
            assert after.columns == COLUMNS
            new = dict(pairs(after))
            assert set(new) <= set(old) and after.count() == len(new)
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert new == {i: t for i, t in old.items() if model.score(t) < toxicity.CUT}
        elif name == "near_dedup":
            assert set(new) == {i for i, _, _, kept in near_brute(list(old.items()), 80) if kept}
        elif name == "decontamination":
            for i, t in old.items():
                n, hit, *_ = contaminated(t, items)
                if not hit:
                    assert new[i] == t
                elif i in new:
                    assert not contaminated(new[i], items)[1] and len(bwords(new[i])) >= n / 2
                else:
                    assert hit > 0.3 * n
        elif name == "mixing":
            assert 0 < len(new) <= len(old) and all(new[i] == old[i] for i in new)
        else:
            got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in after.collect()]
            check_shards(got, list(old.items()), corpus_pipeline.SHARDS)
        docs = after
    again = corpus_pipeline.run(spark, SF).collect()
    digest = lambda rows: hashlib.sha256(repr(sorted(tuple(r) for r in rows)).encode()).hexdigest()
    assert digest(again) == digest(docs.collect())


def test_odd_inputs(spark, tmp_path):
    for k, rows in enumerate((TEXTS, [])):
        docs = documents(spark, rows, extra=False)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stored(stage(spark, docs, SF), tmp_path / f"{k}-{n}")
            if name == "near_dedup":
                assert docs.count() == docs.select("doc_id").distinct().count()
        assert docs.count() <= len(rows)


def test_extra_columns_stay(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_near_dedup_keeps_every_text(spark):
    """Different texts without an id, or of one id, are all kept once, and copies of them link no other classes."""
    one, two, three, four = (prose(70 + k, 60) for k in range(4))
    rows = [(5, one), (None, one), (9, two), (None, two), (None, three), (None, three + " more"), (None, four),
            (7, prose(80, 60)), (7, prose(81, 60)), (7, prose(81, 60)), (None, ""), (3, None), (3, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, documents(spark, [(i, t, "en", "a") for i, t in rows]), SF)
    left = sorted((str(i), t or "") for i, t in pairs(got))
    shown = [r for r in left if not r[1].startswith(three)]
    assert shown == sorted([("5", one), ("9", two), ("None", four), ("7", prose(80, 60)), ("7", prose(81, 60)),
                            ("None", ""), ("3", "")])
    assert len(left) == len(shown) + 1
