"""The pipeline and each of its stages against a plain Python version, on tables with cases of every kind."""

import hashlib
import math
import random

import pytest

import corpus_pipeline
from siltlog.llm import mixing, quality
from tests.llm.test_operators import SCHEMA, awkward, brute_classes, brute_lines, brute_spans, empty, gram_set, prose

BAD = "grubbly snarf vexit morzul".split()


def made_tables(spark, folder):
    """Clean, junk and toxic documents, copies, near copies, shared lines, benchmark passages; a third of all rows in one source."""
    rng = random.Random(21)
    items = [(i, prose(rng, 40)) for i in range(6)]
    texts = []
    for k in range(90):
        texts.append("\n".join(prose(rng, rng.choice([4, 9, 15])) for _ in range(rng.choice([1, 4, 8]))))
    notice = "\n".join(prose(rng, 6) for _ in range(4))
    texts += [f"{t}\n{notice}" for t in texts[:12]] + texts[12:20] + [texts[30]] * 5
    texts += [" ".join(w if rng.random() > 0.03 else "changed" for w in t.split(" ")) for t in texts[40:52]]
    for k in range(8):
        w = rng.choice(items)[1].split()
        texts.append(f"{prose(rng, 30)} {' '.join(w[5:30])} {prose(rng, 9)}")
    n_good = len(texts)
    texts += ["### &&& ### $$$ " * rng.randrange(3, 9) + str(k) for k in range(30)]
    texts += [" ".join(rng.choice(BAD) if rng.random() < 0.4 else x for x in prose(rng, 30).split()) for _ in range(30)]
    texts += ["", None, " ", "word", "\n\n\n"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en", "hot" if i % 3 == 0 else f"s{i % 5}", len(t or "")) for i, t in zip(ids, texts)]
    labels = [(i, int(k < n_good), int(n_good + 30 <= k < n_good + 60)) for k, (i, t) in enumerate(zip(ids, texts)) if k % 2 and k < n_good + 60]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items


def brute_clean(docs, labels, _):
    label = {i: 2 if t else 0 if q else 1 for i, q, t in labels}
    known = sorted((d[0], d[1] or "", label[d[0]]) for d in docs if d[0] in label)
    model = quality.fit([x[1] for x in known], [x[2] for x in known])
    return [d for d in docs if not (d[1] or "").strip() or model.probabilities([d[1]])[0][0] >= quality.KEEP]


def brute_dedup(docs, *_):
    new = {i: (t, n) for i, t, n in brute_lines([(d[0], d[1] or "") for d in docs])}
    out = []
    for d in docs:
        t, n = new[d[0]]
        if not n:
            out.append(d)
        elif t.replace("\n", "").strip(" "):
            out.append((d[0], t, d[2], d[3], len(t)))
    return out


def brute_near(docs, *_):
    docs = sorted(docs)
    classes = brute_classes([d[0] for d in docs], [gram_set(d[1], 2) for d in docs], 0.6)
    return [d for d, (i, root, _) in zip(docs, classes) if i == root]


def brute_leaks(docs, _, items):
    bad = {x[0] for x in brute_spans([(d[0], d[1] or "") for d in docs], items)}
    return [d for d in docs if d[0] not in bad]


def brute_mix(docs, *_):
    size = {}
    for d in docs:
        size[d[3]] = size.get(d[3], 0) + len(d[1] or "")
    share = {s: n**mixing.TEMPERATURE for s, n in size.items() if n}
    out = []
    for d in docs:
        if d[3] not in share:
            continue
        rate = share[d[3]] / sum(share.values()) * sum(size.values()) / size[d[3]]
        u = int(hashlib.md5(f"{mixing.SEED}|{d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, cdf = 0, math.exp(-rate)
        while cdf <= u:
            n += 1
            cdf += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        out += [(*d, k + 1) for k in range(n)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    return folder, *made_tables(spark, folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_and_run(spark, tables):
    folder, rows, labels, items = tables
    docs = rows
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (brute_clean, brute_dedup, brute_near, brute_leaks, brute_mix)):
        before, docs = docs, brute(docs, labels, items)
        df = stage(spark, df, folder)
        assert rows_of(df) == sorted(docs, key=repr), name
        df = spark.createDataFrame(docs, df.schema)
        assert docs != before, name  # each stage has something to do
    assert rows_of(corpus_pipeline.run(spark, folder)) == sorted(docs, key=repr)



def test_awkward_tables(spark, tables):
    """Nulls in any column, empty and long texts, repeated rows and columns with clashing names: what stays of them is what the docstrings say."""
    a = awkward(spark)
    left = {"quality classifier": None, "line dedup": 9, "n-gram Jaccard join": 8, "benchmark decontamination": 9}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, a, tables[0])
        assert stage(spark, empty(spark), tables[0]).count() == 0, name
        if name == "source mixing":
            # five distinct ids, of which the same draw is made for each of their rows
            assert out.columns == [*a.columns, "copy_"]
            every = {(r.doc_id, r.text): 0 for r in a.collect()}
            for r in out.collect():
                every[r.doc_id, r.text] += 1
            drawn = {}
            for r in a.collect():
                drawn.setdefault((r.doc_id, r.source), set()).add(every[r.doc_id, r.text] / sum((x.doc_id, x.text) == (r.doc_id, r.text) for x in a.collect()))
            assert all(len(x) == 1 for x in drawn.values())
            continue
        assert out.columns == a.columns, name
        if left[name] is not None:
            assert out.count() == left[name], name
        else:
            kept = [r.doc_id for r in out.collect() if not (r.text or "").strip()]
            assert sorted(map(str, kept)) == ["1", "3", "None"]
