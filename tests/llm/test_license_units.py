"""Every unit of a text is compared, with or without marks of a licence."""
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flowtide.llm import licenses

EPL = next(t for n, t in licenses.NOTICES if n == "EPL-2.0")


def best_of_all(text):
    """TF-IDF by the definition over all units; of equal ones those with marks enough first."""
    bag = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    bags = [(name, bag(t)) for name, t in licenses.TEMPLATES]
    seen = Counter(t for _, b in bags for t in b)
    idf = lambda t: np.log((1 + len(bags)) / (1 + seen[t])) + 1
    norm = lambda b: np.sqrt(sum((n * idf(t)) ** 2 for t, n in b.items()))
    norms = [norm(b) for _, b in bags]
    units = [(0, text)] + [(1, s) for s in re.split(licenses.PARAGRAPH_END, text)] + [(2, s) for s in re.split(licenses.SENTENCE_END, text)]
    found = []
    for kind, s in units:
        own = bag(s)
        weak = sum(bool(re.search(m, s, re.I)) for m in licenses.MARKS) < (licenses.LONG_MARKS if kind < 2 else 1)
        for (name, b), size in zip(bags, norms):
            both = set(own) & set(b)
            if sum(t not in licenses.COMMON and not (t.isdigit() and len(t) < 2) for t in both) > 1:
                found.append((-round(sum(own[t] * b[t] * idf(t) ** 2 for t in both) / norm(own) / size, 6), name, weak, kind))
    best = min((x for x in found if -x[0] >= licenses.LEAST), default=None)
    return best and (best[1], -best[0], ("whole", "paragraph", "sentence")[best[3]])


def scanned(spark, texts):
    files = spark.createDataFrame([(f"d{k}/f", t) for k, t in enumerate(texts)], "path string, text string")
    got = {r["path"]: (r["own_license"], r["cosine"], r["license_unit"]) for r in licenses.scan(files, F.lit(False)).collect()}
    return [got[f"d{k}/f"] for k in range(len(texts))]


def test_wrapped_notices(spark):
    """A notice over two lines, whose lines have no marks enough, is compared as a whole and as a paragraph."""
    wrapped = EPL.replace("terms of the", "terms of\nthe")
    texts = [wrapped, "code;\n\n" + wrapped + "\n\nmore code", "Released under the\nMIT License."]
    got = scanned(spark, texts)
    assert got == [("EPL-2.0", 1.0, "whole"), ("EPL-2.0", 1.0, "paragraph"), ("MIT", 1.0, "whole")]
    assert got == [best_of_all(t) for t in texts]


def test_no_unit_is_lost(spark):
    """Parts of notices among other words, near the least cosine on both sides, against the definition."""
    draw, texts = random.Random(5), []
    for k in range(60):
        words = draw.choice(licenses.NOTICES)[1].split()
        at = draw.randrange(max(1, len(words) // 2))
        part = words[at:at + draw.randrange(4, 60)] + [f"other{draw.randrange(9)}" for _ in range(draw.randrange(12))]
        part += draw.choices(["the", "of", "and", "1", "you"], k=draw.randrange(30))
        draw.shuffle(part)
        texts.append("".join(w + draw.choice([" ", " ", " ", "\n", ". ", "\n\n"]) for w in part))
    want = [best_of_all(t) or (None, None, None) for t in texts]
    assert scanned(spark, texts) == want
    assert 10 < sum(w[0] is not None for w in want) < 55
