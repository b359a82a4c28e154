"""Every stage of the pipeline, and the whole, against plain Python over what the stage was given."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute
from test_ops import brute_lines, size_of, water

from quire.llm import common, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, row string, size string, label string, copies string"
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    r = random.Random(21)
    good = lambda n: " ".join(f"the{r.randrange(400)} of and{r.randrange(60)}" for _ in range(n))
    shared = [good(15) for _ in range(3)]
    rows = []
    for i in range(160):
        lines = [good(r.randint(2, 9)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        text = "\n".join(lines) if i % 4 else " ".join(f"x{r.randrange(300)}!!! %%%" for _ in range(40))
        rows.append((i, text, f"s{min(r.randrange(7), 3)}"))
    near = rows[1][1].split(" ")
    rows += [(200 + i, " ".join([*near[:-2], f"new{i}", near[-1]]), "s0") for i in range(4)]  # near copies
    rows += [(300 + i, rows[2][1], "s1") for i in range(60)]  # copies
    rows += [(400, None, "s1"), (401, "", None), (402, " \n", "s0"), (None, good(30), None), (None, good(30), None), (404, good(9000), "s2")]
    return rows + [rows[3]] * 3  # repeated rows


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("sf")
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", s, len(t or ""), "h", "r", "z", "l", "c") for d, t, s in rows], SCHEMA)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 160, 2)] + [(1, 0, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return str(sf)


@pytest.fixture(scope="module")
def stages(spark, given):
    """(before, after) of each stage, as the pipeline runs them."""
    docs, out = common.table(spark, given, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = common.stash(stage(spark, docs, given))
        out[name] = (docs, made)
        docs = made
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        assert after.columns == before.columns or name == "packing"
        if name != "packing":
            assert after.select("_h", "row", "size", "label", "copies").distinct().collect() == [("h", "r", "z", "l", "c")]


def test_quality_rejects_junk_and_keeps_the_rest(spark, given, stages):
    before, after = stages["quality"]
    got = Counter(pairs(after))
    chosen = Counter()
    labels = common.table(spark, given, "labels")
    for r in quality.score(before, labels).select("doc_id", "chosen").collect():
        chosen[r.doc_id] += r.chosen
    assert Counter(d for d, _ in got.elements()) == +chosen
    junk = lambda t: "%%%" in t
    assert all(re.search(r"\S", t or "") for _, t in got)
    kept, there = Counter(junk(t) for _, t in got.elements()), Counter(junk(t) for _, t in pairs(before) if t and t.strip())
    assert kept[True] <= 0.1 * there[True] and kept[False] >= 0.97 * there[False]


def test_lines(stages):
    before, after = stages["line_dedup"]
    assert sorted(pairs(after), key=str) == sorted(((d, t) for d, t, n in brute_lines(pairs(before), 32) if not n or t.split()), key=str)
    assert all(r.n_chars == len(r.text or "") for r in after.collect())


def test_join(stages):
    before, after = stages["ngram_join"]
    rows = pairs(before)
    least = {}
    for (d, t), (_, n, component) in zip(sorted(rows, key=lambda r: str((r[0], 0, 0))), brute(sorted(rows, key=lambda r: str((r[0], 0, 0)))), strict=True):
        if n and component is not None and d == component:
            least[d] = t
    kept = pairs(after)
    known = Counter(d for d, _ in kept if d is not None)
    assert {d for d in known} >= set(least) and max(known.values()) == 1
    # what stays is linked with nothing else that stays, and all that went was linked
    again = brute(kept)
    assert len({c for _, n, c in again if n and c is not None}) == len([1 for d, n, c in again if n and c is not None])
    assert {c for _, n, c in brute(rows) if n and c is not None} == {c for _, n, c in again if n and c is not None}


def test_mix(stages):
    before, after = stages["mixing"]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    sums, taken, times = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sums[s] += size_of(t)
    want = water(sums)
    for r in after.collect():
        taken[r.source] += size_of(r.text)
        times[r.doc_id, r.text] += 1
    there = Counter((d, t) for d, t, _ in rows)
    assert all(n <= 2 * there[k] for k, n in times.items())
    for s in sums:
        sizes = [size_of(t) for _, t, x in rows if x == s]
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], max(sizes) / 2)


def test_packing(stages):
    before, after = stages["packing"]
    assert Counter((d, size_of(t)) for d, t in pairs(before)) == Counter((r.doc_id, r.tokens) for r in after.collect())
    batches = defaultdict(list)
    for r in after.collect():
        assert r.tokens <= r.bucket_tokens
        batches[r.bucket, r.batch].append(r)
    assert all(len(b) == 1 or len(b) * b[0].bucket_tokens <= 65_536 for b in batches.values())


def test_run_is_its_stages_and_leaves_no_files_of_the_earlier_ones(spark, given, stages):
    want = stages["packing"][1]
    common.sweep(spark)
    got = corpus_pipeline.run(spark, given)
    columns = sorted(got.columns)
    rows = Counter(map(tuple, got.select(columns).collect()))
    assert rows.total() > 100 and sorted(want.columns) == columns
    path = spark._jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
    left = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    assert len(left) <= 3
    assert Counter(map(tuple, corpus_pipeline.run(spark, given).select(columns).collect())) == rows


def test_an_empty_table_goes_through(spark, given):
    docs = common.table(spark, given, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, given)
        assert made.count() == 0 and (name == "packing" or made.columns == docs.columns)
    assert docs.filter(F.col("doc_id") > 0).count() == 0
